"""Each operator against brute force on small tables, and on a table of awkward rows."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import exact_dedup, langid, minhash, mixing, packing, passages, secrets, sharding, vectors, warc
from tagloom.llm.components import components

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
AWKWARD = [(1, "", "en", "a"), (2, None, None, None), (3, "one", "en", "a"), (3, "one", "en", "a"), (None, "a b c d e f", "fr", "b"), (None, None, None, None),
           (4, LONG, "en", "a"), (5, LONG + " end", "en", "c"), (6, " \t\n", "de", ""), (7, "ONE", "en", "a"), (8, "été " * 5, "fr", "b")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, bucket string, norm string, n int, keys int, label int, node int, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame([(*r, 0, "x", "y", "z", "q", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def ids(rows):
    return Counter(r.doc_id for r in rows)


EVERY = {
    "exact": lambda d: exact_dedup.exact_dedup(d, digest_all=True), "refined": exact_dedup.exact_dedup, "shard": sharding.shard, "mix": mixing.mix, "secrets": secrets.scan_secrets,
    "near": minhash.near_dups, "lang": lambda d: langid.predict(d, *langid.fit(d.select("doc_id", "text", "lang"))),
}


@pytest.mark.parametrize("name", EVERY)
def test_awkward_and_empty_tables(spark, name):
    d = awkward(spark)
    assert ids(EVERY[name](d).collect()) == Counter(r[0] for r in AWKWARD)
    assert EVERY[name](d.limit(0)).count() == 0


def test_exact_dedup_by_brute_force(spark, docs):
    d = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 1000, F.concat(F.lit(" "), "text")).limit(50)).cache()
    groups = defaultdict(list)
    for r in d.collect():
        groups["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(r.text or ""), r.doc_id))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    for out in (exact_dedup.exact_dedup(d), exact_dedup.exact_dedup(d, digest_all=True)):
        assert {r.doc_id: (r.keep_id, r.group_size) for r in out.collect()} == want
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(d).collect()} == {w for w, _ in want.values()}
    assert exact_dedup.drop_exact_copies(awkward(spark)).where("doc_id = 3").count() == 1


def test_sharding(docs):
    rows = sharding.shard(docs, buckets=7).collect()
    n = len(rows)
    assert sorted(r.row_number for r in rows) == list(range(n))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    assert sorted(map(tuple, sharding.shard(docs.repartition(5), buckets=7).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    a, b = (F.lit(v).cast("long") for v in sharding.sides(n))
    out = spark.range(n).select(sharding.feistel(F.col("id"), F.lit(n).cast("long"), a, b, 3).alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(n))


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source_size][1] += r.taken
        by[r.source_size][2] = r.target
    total = sum(r.size for r in rows)
    assert all(abs(t - want) <= max(3, 1e-3 * total) and want <= 2 * s + 1e-6 for s, (_, t, want) in by.items())
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect())) == sorted(map(tuple, rows))


def test_targets_and_apportionment():
    t = mixing.targets([100, 10, 50], [3, 1, 2], Fraction(3, 2))
    assert sum(t) == 240 and t[1] == 20 and t[0] == 2 * t[2] * Fraction(3, 4) or t[0] <= 200
    assert mixing.sainte_lague([Fraction(53), Fraction(24), Fraction(23)], [7], [9, 9, 9]) == [[3, 2, 2]]
    houses = mixing.sainte_lague([Fraction(v) for v in (60, 28, 12)], list(range(1, 30)), [99] * 3)
    assert all(x <= y for a, b in zip(houses, houses[1:], strict=False) for x, y in zip(a, b, strict=True))


def test_secrets_battery(spark):
    rng = random.Random(5)
    rows = [(i, f"see {''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', k=44))} here") for i in range(60)]
    rows += [(100 + i, "user_name_1_user_name_2_user_name_3 zzzzzzzzzzzzzz11111111111111") for i in range(20)]
    rows += [(200, "token: token: abcdef é api_key='" + "0a" * 13 + "' AKIA" + "Q" * 16)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i].spans) for i in range(60)) >= 50 and not any(got[100 + i].spans for i in range(20))
    assert got[200].spans == "assign:23:58,hex:32:58,access:60:80" and (got[200].n_assign, got[200].n_access, got[200].n_hex) == (1, 1, 1)


def _jaccard_components(sets, num, den):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def _components_of(links):
    """The least node that each node reaches."""
    out = {}
    for start in sorted(links):
        todo = [] if start in out else [start]
        while todo:
            i = todo.pop()
            if i not in out:
                out[i] = start
                todo += links[i]
    return out


def _edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def test_near_dups_by_brute_force(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, _edited(rng, base, rng.randrange(0, 9))) for i in range(150)] + [(500 + i, " ".join(f"o{rng.randrange(400)}" for _ in range(30))) for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = _jaccard_components(sets, 85, 100)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in sets}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(999, i) for i in range(500, 540)]
    root = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {v for v in root if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: r for v, r in root.items() if v not in loops}


def test_language_accuracy(spark, docs):
    names, protos = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = langid.predict(docs, names, protos).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert {(r.lang_pred, r.score) for r in langid.predict(awkward(spark), names, protos).where("doc_id in (1, 2, 6)").collect()} == {("und", 0.0)}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t, d = Tokenizer.from_file(path), docs.select("doc_id", "text").union(awkward(spark).select(F.col("doc_id") + 5000, "text").where("doc_id is not null").limit(8))
    rows, want = packing.pack_documents(d, path).collect(), Counter()
    for r in d.collect():
        x = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, k, s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(x), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(d.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([1, 2, 3, 7, 20, 33, 50, 64, rng.randrange(1, 65)]) for _ in range(400)), reverse=True)
    bins = []
    for x in lengths:
        room = min((r for r in bins if r >= x), default=None)
        if room is None:
            bins.append(64 - x)
        else:
            bins[bins.index(room)] = room - x
    n, runs = packing.best_fit_decreasing(Counter(lengths), 64)
    fill = Counter()
    for i, (length, rank, start, per, _) in enumerate(runs):
        end = next((r[1] for r in runs[i + 1 :] if r[0] == length), Counter(lengths)[length])
        for k in range(end - rank):
            fill[start + k // per] += length
    assert n == len(bins) and sorted(fill.values()) == sorted(64 - r for r in bins)


def test_warc_round_trip_and_lookup(spark):
    rows = [(1, "http://a.example.com/x?y=1", "p" * 2000), (2, "http://b.example.com/", "p" * 2000), (3, None, None), (None, "http://[bad", "q" * 5), (5, "http://a.example.com/x?y=1", "é" * 600),
            (5, "http://a.example.com/x?y=1", "é" * 600), (None, "u", "p" * 2000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory, folder = warc.archive_pages(d)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_all(directory, folder).collect())
    assert got == [(0, 5, "response", 0), (0, 2000, "revisit", 2), (1, 2000, "revisit", 2), (2, 2000, "response", 0), (3, 0, "response", 0), (5, 1200, "response", 0), (5, 1200, "response", 0)]
    found = warc.lookup(directory, folder, "http://a.example.com/x?y=1")
    assert sorted(len(b) for _, b in found) == [0, 1200, 1200]
    assert warc.lookup(directory, folder, "http://none.example.com/") == [] and warc.archive_pages(d.limit(0))[0].count() == 0
    assert warc.surt("http://WWW.Example.com:80/a?b") == "com,example,www:80)/a?b"


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 16))
    x = np.concatenate([x, x[:40] + 0.05 * rng.standard_normal((40, 16)), x[:30], x[:10] * 1e200])
    rows = [(i, [float(v) for v in r], int(i % 120 % 3)) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [1.0], 0), (906, [], 0)]
    out = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=50).collect()}
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[: len(x)]])
    linked = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(linked, False)
    found, there = sum(out[i].n_links for i in range(len(x))), linked.sum()
    assert 0.98 * there <= found <= there and all(out[i].n_links <= linked[i].sum() for i in range(len(x)))
    assert all(out[i].n_links == 0 and out[i].kept for i in range(900, 907))
    want = _components_of({i: [int(j) for j in np.flatnonzero(linked[i])] for i in range(len(x))})
    assert {i: (out[i].component_id, out[i].kept) for i in want} == {i: (c, i == c) for i, c in want.items()}


def test_repeated_passages_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(51), []
    for i in range(12):
        w = text(200)
        if i < 6:
            w[100:100] = passage
        rows.append((i, " ".join(w)))
    para = text(80)
    rows += [(20 + i, "\n".join([" ".join(text(60)), _edited(rng, para, i % 3 and 1), " ".join(text(60))])) for i in range(4)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, 20, 21, 22, 23}
    assert all(100 <= r.start and r.end <= 151 and r.end - r.start >= passages.WINDOW for r in got if r.doc_id < 6)
    assert all(r.kept for r in got if r.doc_id == 0) and {r.doc_id for r in got if r.first_doc == 0 and not r.kept} == {1, 2, 3, 4, 5}
    assert {r.doc_id for r in got if r.kind == "paragraph" and r.kept} == {20}
    d = awkward(spark)
    assert {r.doc_id for r in passages.repeated_passages(d).collect()} == {4, 5}
    nameless = spark.createDataFrame([(None, " ".join(passage)), (None, " ".join([*passage, "x"])), (7, "a"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc) for r in passages.repeated_passages(nameless).collect()} == {(None, None)}
    assert passages.repeated_passages(d.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    d, columns = docs, docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, SF).write.parquet(str(tmp_path / str(k)))
        before, d = d, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert d.columns == columns
        if k == 0:
            assert d.count() == before.count()
        if k == 2:
            sets = {r.doc_id: {tuple(r.text.lower().split()[i : i + 5]) for i in range(max(1, len(r.text.split()) - 4))} for r in before.collect()}
            want = _jaccard_components(sets, 80, 100)
            assert {r.doc_id for r in d.collect()} == {i for i, c in want.items() if i == c}
    assert d.select("length").groupBy().sum().collect()[0][0] > 0
    a = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, a, SF).columns == a.columns and stage(spark, a.limit(0), SF).count() == 0


def _labels(spark, edges):
    return {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}


def test_components_keep_nodes_that_join_late(spark):
    assert _labels(spark, [(5, 1), (5, 3)]) == {5: 1, 3: 1, 1: 1}
    rng = random.Random(8)
    stars = [(100 * s + 50, 100 * s + i) for s in range(20) for i in rng.sample([*range(50), *range(51, 100)], 9)]
    assert _labels(spark, stars) == {v: min(min(e) for e in stars if e[0] // 100 == v // 100) for e in stars for v in e}


def test_vectors_of_a_group_share_one_component(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((12, 16)), 10, axis=0) + 0.03 * rng.standard_normal((120, 16))
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.component_id, r.kept) for r in out} == {i: (i - i % 10, i % 10 == 0) for i in range(120)}


@pytest.mark.parametrize("n", [60, 3000])
def test_mix_stage_meets_the_targets(spark, n):
    rng = random.Random(n)
    # source a holds most words, so its ratio is low; every ninth document is long
    rows = [(i, "w " * (rng.randrange(2000, 4000) if i % 9 == 0 else rng.randrange(5, 200)), "abc"[max(0, i % 8 - 5)]) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.target for r in mixing._mixed(d, mixing.WEIGHTS, Fraction(3, 2), 7, "doc_id", "text", "source", 100_000, 8, 4096).select("source", "target").distinct().collect()}
    sizes, got, long_ = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t) // 2
        long_[s] += len(t) // 2 * (len(t) >= 4000)
    for r in corpus_pipeline.mix_sources(spark, d, SF).collect():
        got[r.source] += len(r.text) // 2
        long_[r.source, "got"] += len(r.text) // 2 * (len(r.text) >= 4000)
    for s in "abc":
        assert abs(got[s] - want[s]) <= 200 + 0.002 * want[s], (s, got[s], want[s])
        assert not long_[s] or abs(long_[s, "got"] / long_[s] - want[s] / sizes[s]) <= (0.5 if n < 100 else 0.03)


def test_wrapped_paragraphs_are_banded(spark):
    rng = random.Random(6)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage = text(60)
    edited = [*passage[:30], "other", *passage[31:]]
    wrap = lambda w, k: "\n".join(" ".join(w[i : i + k]) for i in range(0, len(w), k))
    # inside neighbouring short lines, and as a block that is wrapped in another way
    rows = [(1, wrap(text(40), 20) + "\n" + wrap(passage, 30) + "\n" + wrap(text(60), 20)), (2, wrap(text(25), 25) + "\n" + wrap(edited, 30) + "\n" + wrap(text(60), 20)),
            (3, wrap(text(45), 15) + "\n\n" + wrap(edited, 7) + "\n\n" + wrap(text(45), 15)), (4, wrap(text(200), 12))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'paragraph'").collect()
    assert {(1, 40, 100, True), (2, 25, 85, False), (3, 45, 105, False)} <= {(r.doc_id, r.start, r.end, r.kept) for r in got}
    assert {r.doc_id for r in got} == {1, 2, 3} and all(r.first_doc == 1 for r in got if r.end - r.start == 60)
