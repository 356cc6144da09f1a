"""Whole results against plain Python that shares no code with the operators, but for fixed numbers."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from math import isqrt

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import langid, mixing, passages, secrets, sharding, warc

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """Spark's xxhash64: nulls are passed over, each hash is the seed of the next."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", int(v))
            h = xxhash.xxh64(data, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


class Int(float):
    """A number that Spark holds as an int of 32 bits."""


def places(n, seed):
    """The permutation of 0..n-1, walked step by step."""
    a = max(1, isqrt(n))
    b = max(1, -(-n // a))
    out = []
    for x in range(n):
        while True:
            left, right = divmod(x, b)
            for r in range(4):
                if r % 2 == 0:
                    left = (left + spark_hash(right, Int(seed), Int(r)) % a) % a
                else:
                    right = (right + spark_hash(left, Int(seed), Int(r)) % b) % b
            x = left * b + right
            if x < n:
                break
        out.append(x)
    return out


def test_sharding(spark):
    rows = [(i * 7 % 90, f"text {i % 9} é") for i in range(90)] + [(200, None)]
    facts = [(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows]
    order = sorted(facts, key=lambda f: (spark_hash(*f) % 4096, *f))
    want = {(f[0], f[1], p % 8, p // 8) for f, p in zip(order, places(len(rows), 42), strict=True)}
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text_crc32, r["shard"], r.slot) for r in got} == want and len(got) == len(rows)


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["b", "a", "a", "a", None, "é"])) for i in range(120)]
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    weights, left, target, full = [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), {}, set()
    while True:
        free = [i for i in range(len(names)) if i not in full]
        per = (left - sum(2 * sizes[i] for i in full)) / max(1, sum(weights[i] for i in free))
        more = {i for i in free if per * weights[i] > 2 * sizes[i]}
        if not more:
            break
        full |= more
    target = {n: 2 * sizes[i] if i in full else per * weights[i] for i, n in enumerate(names)}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=60).collect()
    by, shards = defaultdict(int), defaultdict(lambda: [0] * 8)
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[names.index(s)] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and sum(r.shard_words) == r.taken
        by[s] += r.taken
        shards[s] = [x + y for x, y in zip(shards[s], r.shard_words, strict=True)]
    block = sum(target.values()) / 60
    assert all(abs(by[s] - target[s]) <= 2 * block for s in names)
    # quotas of a source differ by little from shard to shard
    assert all(max(w) - min(w) <= 4 * block for w in shards.values())


BASE = ((0, "assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), lambda m: len(m[2]) >= 6),
        (1, "access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, "hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def test_base_secrets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(7)
    parts = ["Password: 'abc", "TOKEN=", "tokentoken: x", "api_key\"=\"A+/b.c-d=\"", "AKIA", "AKIAQQ", "Q" * 16, "0af3" * 7, "deadbeef", " ", "é", ":", "secret:secret:abcdef", "\n", "ſecret=abcdef"]
    extra = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(300)] + [(5000, None)]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.scan_secrets(docs).collect():
        spans = sorted((m.start(), k, m.end(), name) for k, name, pattern, fits in BASE for m in pattern.finditer(texts[r.doc_id]) if fits(m))
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3)), r.doc_id
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in joined.split(",") if x]


def test_language_profiles(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect() if r.text]
    letter = {}

    def profile(text):
        line = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
        line = re.sub("\0+", "\0", line)
        total = np.zeros(langid.DIM)
        for i in range(len(line) - 2):
            v = np.ones(langid.DIM)
            for turn, c in zip((2, 1, 0), line[i : i + 3], strict=True):
                if c not in letter:
                    letter[c] = np.random.Generator(np.random.PCG64(ord(c) + 1)).integers(0, 2, langid.DIM, dtype=np.int8) * 2.0 - 1
                v *= np.roll(letter[c], turn)
            total += v
        n = np.linalg.norm(total)
        return total / n if n else total

    df = spark.createDataFrame([(r.doc_id, r.text[:1500], r.lang) for r in rows], "doc_id long, text string, lang string")
    sums = defaultdict(lambda: np.zeros(langid.DIM))
    for r in rows:
        if r.lang:
            sums[r.lang] += profile(r.text[:1500])
    names = sorted(sums)
    table = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    got = {r.doc_id: r for r in langid.predict(df, *langid.fit(df)).collect()}
    for r in rows:
        cos = table @ profile(r.text[:1500])
        if abs(np.sort(cos)[-1] - np.sort(cos)[-2]) > 1e-3:
            assert got[r.doc_id].lang_pred == names[int(cos.argmax())]
        assert abs(got[r.doc_id].score - max(0.0, cos.max())) < 1e-3


FOREIGN = ("Это предложение написано на русском языке и не похоже ни на один из выученных языков. " * 5, "Tämä lause on kirjoitettu suomeksi eikä se muistuta yhtäkään opituista kielistä lainkaan. " * 5,
           "これは日本語で書かれた文章であり、学習した言語のどれにも似ていません。" * 8, "qzxv wqkj zzxq vvkq jjxz qqwk zxvq kkqz " * 10, "12345 67890", None, "")


def test_language_stage_drops_foreign_rows_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = docs.where("text is not null").first()
    planted = [(lang.doc_id if i % 2 else None, t, None, "src0", 1) for i, t in enumerate(FOREIGN)]
    good = [(None, lang.text, lang.lang, "src0", 1), (None, lang.text, lang.lang, "src0", 1)]
    all_ = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([*planted, *good], "doc_id long, text string, lang string, source string, n_chars long"))
    out = corpus_pipeline.identify(spark, all_, SF).collect()
    texts = [r.text for r in out]
    assert not set(FOREIGN) & set(texts) and texts.count(lang.text) >= 3
    assert len(out) >= 0.99 * docs.where("text is not null").count() + 2


def test_paragraph_clusters(spark):
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(3000)}"
    base, rows = [[word() for _ in range(rng.randrange(50, 90))] for _ in range(12)], []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = list(rng.choice(base)) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(50, 80))]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    spans = []
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            w = line.split()
            spans.append((i, at, at + len(w), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
            at += len(w)
        if "\n" in t:  # the block as a whole
            w = t.split()
            spans.append((i, 0, at, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    root = list(range(len(spans)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(spans)):
        for b in range(a):
            both = len(spans[a][3] & spans[b][3])
            if 100 * both >= 80 * (len(spans[a][3]) + len(spans[b][3]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = defaultdict(set)
    for k, s in enumerate(spans):
        docs[find(k)].add(s[0])
    want = {(s[0], s[1], s[2], min(docs[find(k)])) for k, s in enumerate(spans) if len(docs[find(k)]) > 1}
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'paragraph'").collect()
    got = {(r.doc_id, r.start, r.end, r.first_doc) for r in out}
    assert len(want & got) >= 0.97 * len(want) and {g[:3] for g in got} <= {w[:3] for w in want}


def test_warc_directory(spark):
    rng = random.Random(2)
    urls = [f"http://h{rng.randrange(5)}.example.com/p{rng.randrange(9)}" for _ in range(200)]
    rows = [(i, u, f"page {i} of {u}") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/warc-test"
    entries = warc.write_archives(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.sha1(F.col("html").cast("binary")).alias("sha1"), F.lit(None).cast("long").alias("refers_to")), folder)
    table = warc.write_index(entries, folder, block=7)
    for index in (warc.Directory(table, folder), warc.Directory(table, folder, most=0)):
        for u in (*sorted(set(urls))[::9], "http://none.example.com/", "http://h0.example.com/"):
            assert sorted(b.decode() for _, b in index.lookup(u)) == sorted(h for _, x, h in rows if x == u)
