"""Near-duplicate documents by min-max hashing, banding, and confirmation on full shingle sets.

One permutation yields two signature values, its minimum and its maximum over the set; so half the permutations
give as many values, with less variance. Bands of ``rows`` values are the buckets.

How links are found without all pairs of a bucket: documents of equal shingle sets are one class. In each bucket
the least class is a pivot that is compared with all others, then leaves, and components are taken. A bucket whose
classes are in one component is done, as no further link can change anything. The classes of the others get new,
finer buckets by prefix filtering, which loses no pair; there up to ``PIVOTS`` classes at a time are compared with
the classes of other components, and leave, until every bucket is done. A large bucket, such as copies of one text with
changes of their own, is parted before by what its classes do not share with one of them, which loses no pair either.
Nothing caps partners or candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import WORD, drop_stash, keep_rows, row_key, stash
from tagloom.llm.components import components
from tagloom.llm.words import Words, band_keys, bands_for, lists, shingle_set, slices

PIVOTS = 256
#: Buckets of more members are replaced by finer ones, at most ``DEPTH`` times.
HOT, DEPTH = 64, 4


def signatures(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, keys`` of a table ``doc_id, text_hash, text`` (text as binary).

    ``node`` names the shingle set by 64 bits of its digest, null without shingles.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                h, first = words.hashes, words.first
                sets = [shingle_set(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                full = np.flatnonzero([len(s) > 0 for s in sets])
                ends = np.cumsum([len(sets[i]) for i in full], dtype=np.int64)
                spans = np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1) if len(full) else np.empty((0, 2), np.int64)
                keys = band_keys(np.concatenate([np.empty(0, np.uint64), *sets]), spans, bands, rows)
                of, found = dict(zip(full, range(len(full)), strict=True)), np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets], pa.int64()),
                    lists([keys[of[i]] if i in of else found for i in range(len(sets))])], names=["doc_id", "text_hash", "n_shingles", "node", "keys"])

    return texts.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, keys array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """``node, items`` of a table ``node, text`` (text as binary): the whole shingle set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                sets = [shingle_set(words.hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), lists(sets)], names=["node", "items"])

    node = texts.schema["node"].dataType
    return texts.select("node", "text").mapInArrow(run, T.StructType([T.StructField("node", node), T.StructField("items", T.ArrayType(T.LongType()))]))


def at_least(num: int, den: int):
    """The condition den * |a and b| >= num * |a or b| on two item arrays without repeats."""

    def test(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b)).cast("long")
        return den * both >= num * (F.size(a) + F.size(b) - both)

    return test


def confirm(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs ``u, v`` whose items pass ``test``; the sets meet the pairs at v first, then at u."""
    at_v = pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("iv")), "v")
    at_u = at_v.join(sets.select(F.col("node").alias("u"), F.col("items").alias("iu")), "u")
    return at_u.where(test(F.col("iu"), F.col("iv"))).select("u", "v")


def linked_components(members: DataFrame, sets_of, num: int, den: int) -> DataFrame:
    """Components of the classes with Jaccard similarity num/den or more that share a bucket: ``node, component``.

    ``members``: ``bucket, node, n`` (set size, or 0 for all); ``sets_of(nodes)`` gives ``node, items`` for a table of nodes.
    Only linked nodes are returned. If ``members`` has ``low, high``, the range of the owners of a node, buckets
    that only one owner has are passed over.
    """
    may = lambda a, b: den * F.least(a, b) >= num * F.greatest(a, b)
    # plain numbers as aggregates, so that Spark hashes and combines before the shuffle
    low, high = ("low", "high") if "low" in members.columns else ("node", "node")
    shared = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min(low).alias("a"), F.max(high).alias("b"))
    shared = stash(shared.where("c > 1 and a != b").select("bucket"), "shared")
    # nodes do not compress, and most buckets have one member: so pivots only now
    whole = stash(members.select("bucket", "node", "n").join(shared, "bucket"), "members")
    pivots = whole.groupBy("bucket").agg(F.min("node").alias("p"), F.min_by("n", "node").alias("pn"))
    rest = stash(whole.join(pivots, "bucket").where("node != p"), "members")
    drop_stash(shared, whole)
    pairs = rest.where(may(F.col("n"), F.col("pn"))).select(F.col("node").alias("u"), F.col("p").alias("v")).distinct()
    pairs = stash(pairs, "pairs")
    nodes = stash(rest.select("node").union(rest.select("p")).distinct(), "nodes")
    sets = stash(sets_of(nodes), "sets")
    links = stash(confirm(pairs, sets, at_least(num, den)), "links")
    found = components(links)
    drop_stash(pairs, nodes, links)
    named = rest.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    open_ = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
    open_ = stash(open_, "open")
    nodes = stash(rest.select("bucket", "node").join(open_, "bucket", "left_semi").select("node").distinct(), "nodes")
    drop_stash(rest, open_)
    if nodes.isEmpty():
        drop_stash(sets, nodes)
        return found
    left = stash(sets.join(nodes, "node", "left_semi"), "sets")
    drop_stash(sets, nodes)
    return _by_prefix(left, found, num, den)


def _by_prefix(sets: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """What the first pivots left open, settled exactly by the rarest items of each set.

    Items are ordered by how many of these sets hold them, then by value. If two sets of sizes m <= n pass, their
    overlap is at least num * (m + n) / (num + den); so their first common item in that order stands among the
    first n - overlap + 1 of both. These prefixes are the new buckets: in a large group of half-similar texts
    the rare items of each text fill its prefix and part it from the rest. Of any pair that passes, the smaller
    has the item in its short prefix (overlap for m = n), so only such members need to be pivots.

    Rows have ``left``, the number of items from ``pos`` on, and a weight ``w``; two sets must have
    ``(w + w') / 2 / (num + den)`` items in common. A bucket of more than ``HOT`` members is replaced by finer ones, see
    :func:`_about`; after ``DEPTH`` times it is left to the pivots.
    """
    size = F.size("items").cast("long")
    each = sets.select("node", size.alias("n"), size.alias("d"), F.explode("items").alias("item"))
    rest = stash(_ranked(each, [], F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1, num, den), "prefixes")
    need = lambda a, b: F.ceil((a + b) / F.lit(2 * (num + den)))
    columns = ["bucket", "node", "pos", "left", "w"]
    checked, others_only, depth = None, True, 0

    def settle(pairs: DataFrame) -> None:
        nonlocal checked, found
        pairs = stash(pairs if checked is None else pairs.join(checked, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        checked = pairs if checked is None else checked.unionByName(pairs)
        links = stash(confirm(pairs, sets, at_least(num, den)), "links")
        if not links.isEmpty():
            old = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
            found = components(links.unionByName(old))

    while True:
        dead = rest
        named = stash(rest.join(found, "node", "left").select(*columns, F.coalesce("component", "node").alias("comp")), "named")
        largest = named.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.min("w").alias("w"), F.min(F.struct("pos", "node")).alias("first")).groupBy("bucket").agg(
            F.max(F.struct("c", "comp", "first")).alias("big"), F.min("w").alias("least"), F.sum("c").alias("members"), F.count("*").alias("k")).where("k > 1")
        largest = stash(largest.select("bucket", "members", F.col("big.comp").alias("big"), F.col("big.first.node").alias("ref"), "least"), "open")
        # a member that stands too far back in its order for even the smallest partner can go
        rest = named.join(largest, "bucket").where(F.col("left") >= need(F.col("w"), F.col("least")))
        rest = stash(rest.drop("least"), "members")
        drop_stash(dead, named)
        hot = rest.where(F.col("members") > HOT)
        if depth < DEPTH and not hot.isEmpty():
            depth, others_only = depth + 1, True
            settle(hot.where("comp != big").select(F.greatest("node", "ref").alias("u"), F.least("node", "ref").alias("v")).where("u != v").distinct())
            fine = _about(hot.select("bucket", "node", "ref"), sets, found, num, den)
            dead, rest = rest, stash(rest.where(F.col("members") <= HOT).select(*columns).unionByName(fine), "prefixes")
            drop_stash(dead, fine)
            continue
        rest = rest.drop("members", "ref")
        slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("slot")
        eligible = (F.col("left") >= need(F.col("w"), F.col("w"))) & ((F.col("comp") != F.col("big")) if others_only else F.lit(True))
        pivots = rest.where(eligible).groupBy("bucket", slot).agg(F.min(F.struct("node", "w", "comp", "left")).alias("p"))
        pivots = stash(pivots.select("bucket", "p"), "pivots")
        if pivots.isEmpty():
            if not others_only:
                return found
            others_only, rest = False, rest.drop("big", "comp")  # what is left may need the largest components' members
            continue
        near = F.least("left", "p.left") >= need(F.col("w"), F.col("p.w"))
        pairs = rest.drop("big").join(pivots, "bucket").where((F.col("comp") != F.col("p.comp")) & near)
        pairs = pairs.select(F.greatest("node", "p.node").alias("u"), F.least("node", "p.node").alias("v")).distinct()
        rest = rest.drop("big", "comp").join(pivots.select("bucket", F.col("p.node").alias("node")), ["bucket", "node"], "left_anti")
        settle(pairs)


def _ranked(each: DataFrame, group: list[str], most: Column, num: int, den: int) -> DataFrame:
    """``bucket, node, pos, left, w`` of the first ``most`` items of each set of a group, rarest first; those that no other set has only count as places.

    ``each``: ``group, node, n, d, item`` for sets of ``d`` items that stand for ``n``.
    """
    n, d = F.col("n"), F.col("d")
    counts = stash(each.groupBy(*group, "item").agg(F.count("*").alias("f")).where("f > 1"), "counts")
    order = F.array_sort(F.collect_list(F.struct("f", "item")))
    ranked = each.join(counts, [*group, "item"]).groupBy(*group, "node", *[c for c in each.columns if c not in (*group, "node", "item")]).agg(order.alias("order"))
    alone = d - F.size("order")
    first = ranked.select(*group, "node", "n", "d", alone.alias("alone"), F.posexplode(F.slice("order", 1, F.greatest(most - alone, F.lit(0)).cast("int"))).alias("i", "o"))
    pos = F.col("alone") + F.col("i")
    bucket = F.xxhash64(*group, "o.item") if group else F.col("o.item")
    return first.select(bucket.alias("bucket"), "node", pos.alias("pos"), (d - pos).alias("left"), (2 * num * n + (num + den) * (d - n)).alias("w"))


def _about(members: DataFrame, sets: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Finer buckets for large ones: prefixes of what parts each set from one of them. ``members``: ``bucket, node, ref``.

    ``ref``, a member that has been compared with all others of its bucket, is r. With D = what only one of S and r
    has, d = |D| and k = (den - num) / (den + num), two sets S, T pass if and only if d(S, T) <= k (m + n). If d(S) + d(T)
    is no more than that, both pass with r: as d <= k m for one of them, say S, and m - d(S) <= |r|, so is
    d(T) <= k n + k m - d(S) <= k (n + |r|). So a pair that is still to be found shares at least
    (d(S) + d(T) - k (m + n)) / 2 >= 1 items of D, and the first of them in a common order stands in both prefixes. What
    all copies of a text share is in no D, so copies with changes of their own share no bucket.
    """
    label = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    named = members.join(label("node", "cn"), "node", "left").join(label("ref", "cr"), "ref", "left")
    about = stash(named.select("bucket", "node", "ref", (F.coalesce("cn", "node") == F.coalesce("cr", "ref")).alias("own")), "about")
    open_ = stash(about.where("not own").select("bucket").distinct(), "open")
    named = about.join(open_, "bucket", "left_semi")
    centers = stash(named.select("bucket", "ref").distinct().join(sets.select(F.col("node").alias("ref"), F.col("items").alias("center")), "ref").select("bucket", "center"), "centers")
    at = stash(named.join(sets, "node").select("bucket", "node", "own", "items"), "at")
    parted = F.concat(F.array_except("items", "center"), F.array_except("center", "items"))
    parts = at.join(centers, "bucket").select("bucket", "node", "own", F.size("items").cast("long").alias("n"), parted.alias("parts"))
    parts = stash(parts.withColumn("d", F.size("parts").cast("long")).withColumn("w", 2 * num * F.col("n") + (num + den) * (F.col("d") - F.col("n"))), "parts")
    # those that are linked with the reference have partners among the others only
    least = stash(parts.groupBy("bucket").agg(F.min("w").alias("least"), F.min(F.when(~F.col("own"), F.col("w"))).alias("other")), "least")
    partner = F.when(F.col("own"), F.col("other")).otherwise(F.col("least"))
    most = F.col("d") - F.greatest(F.ceil((F.col("w") + partner) / F.lit(2 * (num + den))), F.lit(1)) + 1
    each = parts.join(least, "bucket").where(most > 0).select("bucket", "node", "n", "d", most.alias("most"), F.explode("parts").alias("item"))
    out = stash(_ranked(each, ["bucket"], F.col("most"), num, den), "finer")
    drop_stash(about, open_, centers, at, parts, least)
    return out


def near_dups(docs: DataFrame, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when the Jaccard similarity of their sets of 5-word shingles is num/den or more, checked
    on the full sets; candidates come from bands that miss a pair at the threshold once in 100,000.
    ``component_id`` is the smallest id reachable, ``kept`` whether that is the row's own.

    Null and wordless texts have no shingles and link with nothing, so they are kept. Repeated rows are copies
    of each other, and all of them carry the same ``kept``. Rows with a null id are compared like all others; a null
    id is never a component's name while another member has one, and a component without any id has the name null, so
    all its members are kept. Rows that share an id but not a text are documents of their own. Empty tables give empty
    results, other columns are ignored.
    """
    return _near(docs, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _near(docs: DataFrame, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`near_dups` with ``text_hash`` and ``first``: the hash of the text of the member that stays."""
    bands, rows = bands_for(num / den, values=100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    signed = stash(signatures(texts, bands, rows), "signatures")
    key = row_key(F.col("doc_id"), F.col("text_hash"))
    # any one row stands for its set, as rows of a set differ in nothing that is compared
    places = signed.where("node is not null").groupBy("node").agg(F.min(key).alias("place"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        at = places.join(nodes, "node", "left_semi")
        keyed = texts.withColumn("place", key)
        return full_sets(keyed.join(at, "place")).dropDuplicates(["node"]) if repeated else full_sets(keyed.join(at, "place"))

    repeated = not signed.groupBy(key).count().where("count > 1").isEmpty()
    members = signed.where("node is not null").dropDuplicates(["node"]).select(F.explode("keys").alias("bucket"), "node", F.col("n_shingles").alias("n"))
    found = linked_components(members, sets_of, num, den)
    named = signed.drop("keys").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stash(named, "named")
    drop_stash(signed)
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("least")
    first = named.where("component is not null").groupBy("component").agg(least, F.min("text_hash").alias("nameless"))
    first = stash(first.select("component", F.col("least.doc_id").alias("least"), F.coalesce("least.text_hash", "nameless").alias("first")), "least")
    out = named.join(first, "component", "left")
    out = out.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))).withColumn("first", F.coalesce("first", "text_hash"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash", "n_shingles", "component_id", "kept", "first")


def drop_near_copies(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns unchanged; wordless texts all stay.

    The row with the least id stays; of a group without any id, the one with the least hash of its text.
    """
    decided = _near(docs, num, den, id_col, text_col)
    one = decided.where((F.col("n_shingles") > 0) & F.col("kept") & (F.col("text_hash") == F.col("first"))).select("doc_id", "text_hash")
    keys = {"doc_id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(text_col)}
    wordless = ~F.coalesce(F.rlike(text_col, F.lit(WORD)), F.lit(False))
    alone = docs.where(wordless)
    return keep_rows(docs.where(~wordless), keys, stash(one, "kept")).unionByName(alone)


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id != b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN links ON b = u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id
"""
