"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Each vector, scaled to length one, is projected on random lines. On ``PROJECTIONS`` of them two vectors collide when
their projections lie within a window ``WIDTH`` of each other, centred on either. For a pair at the threshold the
difference on a line is normal with variance 2 - 2c, so the number of collisions is binomial with a known chance;
``need`` is the largest count that such a pair still reaches with probability ``RECALL``. Pairs that reach it are
verified by their cosine in double precision.

A window at such a threshold holds about a third of all points of a line, so windows alone would let every vector
meet a third of its label. Which pairs are counted at all is therefore settled by tables of other lines: sorted on
each of ``m`` lines and cut in two at zero, a table has 2**m ranges, and vectors in the same range of one of ``t``
tables meet. A pair at the threshold parts on a line with chance angle / pi, which gives the ``t`` that misses it
with probability 1 - ``RECALL``. With ``m`` = log2(n) + 3, strangers hardly ever meet; so work grows as n**1.2, not
with the square.

Equal vectors of a label are one class. The members of a range are dealt into blocks, and each pair of blocks is one
small piece of work, so a range that many share spreads over tasks. What comes out is per vector the number of its
links and one edge to its component within the piece, never the pairs. A pair is counted in the first table where
it meets, which each piece of work finds out by itself from the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import drop_stash, parallelism, stash
from tagloom.llm.components import components

PROJECTIONS, WIDTH, RECALL = 32, 1.25, 0.9995
BLOCK, PAIRS = 1024, 1 << 18


def need(lines: int, hit: float, recall: float = RECALL) -> int:
    """The largest k with P(Binomial(lines, hit) >= k) >= recall."""
    tail, k = 0.0, 0
    while k <= lines and tail <= 1 - recall:
        tail += comb(lines, k) * hit**k * (1 - hit) ** (lines - k)
        k += 1
    return k - 1


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that neither huge nor tiny values are lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component of n nodes under the edges a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(m, t) lines of a table and tables for a label of n different vectors."""
    m = max(4, ceil(log2(max(n, 2))) + 3)
    same = (1 - acos(threshold) / pi) ** m
    return m, max(1, ceil(log(1 - recall) / log(1 - same)))


def lines(d: int, k: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, k))


def ranges(u: np.ndarray, m: int, t: int) -> np.ndarray:
    """Which range of each of t tables the rows of u fall in; m is at most 63."""
    above = (u @ lines(u.shape[1], m * t, 2) > 0).reshape(len(u), t, m)
    return above @ (np.int64(1) << np.arange(m, dtype=np.int64))


def pairs_of(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs a < b of rows in the same group, about ``PAIRS`` at a time; ``ends`` has where each row's partners end."""
    at = np.arange(len(ends))
    n = ends - at - 1
    total = np.cumsum(n)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS)))
        a = np.repeat(at[i:j], n[i:j])
        first = np.cumsum(n[i:j]) - n[i:j]
        yield a, a + 1 + np.arange(len(a)) - np.repeat(first, n[i:j])
        i = j


def linked(x: np.ndarray, group: np.ndarray, side: np.ndarray, table: np.ndarray, m: int, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of x in the same group (sorted), of different sides, that meet in no earlier table."""
    hit, width = erf(WIDTH / sqrt(2)), np.float32(WIDTH * sqrt(2 - 2 * threshold))
    u = _unit(x)
    p, cells = (u @ lines(x.shape[1], PROJECTIONS, 1)).astype(np.float32), ranges(u, m, t)
    least, out = need(PROJECTIONS, hit), [(np.empty(0, np.int64),) * 2]
    for a, b in pairs_of(np.searchsorted(group, group, "right")):
        keep = side[a] != side[b]
        a, b = a[keep], b[keep]
        count = np.zeros(len(a), np.uint8)
        for k in range(PROJECTIONS):
            count += np.abs(p[a, k] - p[b, k]) <= width
        a, b = a[count >= least], b[count >= least]
        before = np.zeros(len(a), bool)
        for k in range(t - 1):
            before |= (cells[a, k] == cells[b, k]) & (k < table[a])
        a, b = a[~before], b[~before]
        cos = np.einsum("ij,ij->i", u[a], u[b])
        out.append((a[cos >= threshold], b[cos >= threshold]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of ``rows``: ``vec_id, n_links, component_id, kept``.

    Only rows of equal, non-null label are compared. Null, empty and zero vectors and those with a null, NaN or
    infinite component link with nothing, nor do vectors of different length. Repeated rows are vectors of their
    own: each counts the others. A null id is never a component's name while another member has one. An empty
    table gives an empty result, other columns are ignored. A vector's ``n_links`` counts rows, ``component_id``
    is the smallest id reachable, ``kept`` whether that is the row's own.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda v: v != 0)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))
    base = base.withColumn("sha", F.when(fit, F.sha2(F.concat_ws(":", "label", F.concat_ws(",", F.col("v").cast("array<string>"))).cast("binary"), 256)))
    base = stash(base, "vectors")
    classes = base.where("sha is not null").groupBy("sha").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    # numbers are given once, as the table is written
    classes = stash(classes.withColumn("d", F.size("v")).withColumn("key", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label", "d").count().groupBy("d").agg(F.max("count").alias("n")).collect()  # a row for each length of vectors
    shape = {r["d"]: tables_for(r["n"], threshold) for r in most}

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d, v = part.column("d").to_numpy(), part.column("v")
                for k in np.unique(d):
                    rows = np.flatnonzero(d == k)
                    u = _unit(v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), k))
                    cells = ranges(u, *shape[k])
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows)), part.column("label").take(pa.array(rows)), part.column("d").take(pa.array(rows)), pa.ListArray.from_arrays(
                        pa.array(np.arange(len(rows) + 1) * cells.shape[1], pa.int32()), np.ascontiguousarray(cells).reshape(-1))], names=["key", "label", "d", "cells"])

    signed = classes.select("key", "label", "d", "v").mapInArrow(sign, "key long, label string, d int, cells array<long>")
    place = signed.select("key", "label", "d", F.posexplode("cells").alias("t", "cell"))
    # 64 bits for a range; two that agree by chance only let strangers meet, whom the cosine parts again
    place = stash(place.select(F.xxhash64("label", "d", "t", "cell").alias("range"), "t", "key"), "places")
    shared = place.groupBy("range").agg(F.count("*").alias("c")).where("c > 1").select("range", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    dealt = place.join(stash(shared, "ranges"), "range").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "range", "t", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key")
    # a piece of work is a range's pair of blocks; pieces are dealt by hash, and lie together when they are read
    pieces = stash(pairs.join(classes.select("key", "d", "copies", "v"), "key").withColumn("piece", F.xxhash64("range", "i", "j")), "pieces")

    def run(batches):
        names, whole = ["piece", "t", "i", "j", "mine", "d", "key", "copies", "v"], []
        for batch in batches:
            whole.append(batch)
            piece = batch.column("piece")
            if batch.num_rows and piece[0] != piece[-1]:  # the last piece may go on
                table = pa.Table.from_batches(whole)
                of = table.column("piece").to_numpy()
                cut = int(np.flatnonzero(of != of[-1])[-1]) + 1
                yield from work(table.slice(0, cut).combine_chunks().to_batches())
                whole = table.slice(cut).combine_chunks().to_batches()
        yield from work(pa.Table.from_batches(whole, schema=pa.schema([whole[0].schema.field(n) for n in names])).combine_chunks().to_batches() if whole else [])

    def work(batches):
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                rows = batch.take(pa.array(np.flatnonzero(lengths == d)))
                piece, t, i, j, mine, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "t", "i", "j", "mine", "copies"))
                v = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(piece), d)
                # within a block all meet; of two blocks, the one meets the other
                side = np.where(i == j, np.arange(len(piece)) + 2, mine == i)
                a, b = linked(v, np.unique(piece, return_inverse=True)[1], side, t, *shape[d], threshold)
                links = np.bincount(a, copies[b], len(piece)) + np.bincount(b, copies[a], len(piece))
                root, got = _roots(len(piece), a, b), np.flatnonzero(links > 0)
                keys = rows.column("key")
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(got)), pa.array(links[got].astype(np.int64)), keys.take(pa.array(root[got]))], names=["key", "links", "root"])

    parts = max(parallelism(rows.sparkSession), pieces.count() // 200_000)
    spread = pieces.repartition(parts, "piece").sortWithinPartitions("piece").select("piece", "t", "i", "j", "mine", "d", "key", "copies", "v")
    partial = stash(spread.mapInArrow(run, "key long, links long, root long"), "partial")
    drop_stash(place, pieces)
    found = components(partial.select(F.col("key").alias("u"), F.col("root").alias("v")))
    links = partial.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("sha", "key", "node", "copies").join(links, "key", "left").join(found.withColumnRenamed("node", "key"), "key", "left")
    named = stash(named.select("sha", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")), "named")
    least = stash(named.groupBy("component").agg(F.min("node").alias("component_id")), "least")
    named = stash(named.join(least, "component").select("sha", "n_links", F.col("component_id").alias("least")), "named")
    out = base.select("vec_id", "sha").join(named, "sha", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                                        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b USING (label) WHERE a.vec_id != b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT a, w FROM reach JOIN links ON b = u)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""
