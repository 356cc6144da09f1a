"""Sharding by a Feistel permutation with cycle walking over global row numbers.

DataFrame functions only. Rows get global numbers 0..n-1 (by a hash bucket, then by id), a keyed permutation of
[0, n) moves them, and shard and slot follow by division: ``shard = p mod shards``, ``slot = p div shards``. So
counts differ by one at most, slots have no gaps, and :func:`feistel` alone says where row number i goes.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.llm.common import stash

ROUNDS = 4


def sides(n: int) -> tuple[int, int]:
    """a and b with a*b >= n, near square; fewer than max(a, b) cells are over."""
    a = max(1, isqrt(max(n, 1)))
    return a, max(1, -(-n // a))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _network(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One application to x in [0, a*b): the halves, added modulo a and modulo b, take turns."""
    left, right = _div(x, b), x % b
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(r)), a)) % a
        else:
            right = (right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(r)), b)) % b
    return left * b + right


def feistel(x: Column, n: Column, a: Column, b: Column, seed: int) -> Column:
    """The place of x in a keyed permutation of [0, n); ``a, b = sides(n)``.

    Places beyond n walk on through the network until they fall below n. The walk takes at most a*b - n steps,
    as it visits each surplus cell once, and only the few rows that need it evaluate it.
    """
    first = _network(x, a, b, seed)
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), first,
                       lambda at, _: F.when(at < n, at).otherwise(_network(at, a, b, seed)))
    return F.when(first < n, first).otherwise(walk)


def global_numbers(rows: DataFrame, order: list[str], buckets: int, name: str = "row_number") -> DataFrame:
    """Gapless numbers from 0 without a single-task sort: a hash bucket's rows follow those of lower buckets.

    One row for each bucket is broadcast, ``buckets`` rows at most. Rows equal in all of ``order`` change
    nothing in the result when they swap. ``rows`` must be a written table.
    """
    b = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", b)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    inner = rows.withColumn("_in", F.row_number().over(w) - 1)
    return inner.join(F.broadcast(before), "_bucket").withColumn(name, F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in")


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, row_number, shard, slot, grown_shard``.

    The law is ``rows``: the shards' row counts differ by one at most; ``grown_shard`` is null. ``size`` is the
    UTF-8 length plus 1, a null text counts as none and has the checksum 0. Null ids come last in their bucket;
    repeated rows get places of their own, and so do groups of equal texts, which this law may part. An empty
    table gives an empty result; other columns are ignored.
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(binary) + 1).cast("long").alias("size"),
                             F.crc32(binary).alias("text_crc32")), "sizes")
    n = rows.count()
    a, b = (F.lit(v).cast("long") for v in sides(n))
    placed = global_numbers(rows, ["doc_id", "text_crc32", "size"], buckets).withColumn(
        "place", feistel(F.col("row_number").cast("long"), F.lit(n).cast("long"), a, b, seed))
    k = F.lit(shards).cast("long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % k).cast("int").alias("shard"),
                         _div(F.col("place"), k).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("row_number").cast("long").alias("row_number"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
