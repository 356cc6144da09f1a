"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

DataFrame functions only. Each source's documents, in seeded order, form one stream of words that is cut into
blocks of equal length. The method of highest quotients (divisors 1, 3, 5, ...) hands the blocks of the mix to
the sources. It is house monotone, so that the seats won between two sizes of the house are the integer quota
of one shard. Which blocks of a source are taken is a keyed permutation of its block numbers; a quota beyond
the number of blocks takes all of them once and the rest a second time.

The driver holds one row per source (name, words), never rows of documents.
"""

from __future__ import annotations

import heapq
import itertools
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.llm.common import n_words, stash
from tagloom.llm.sharding import _div, feistel, sides

WEIGHTS = (3, 1, 2)
#: Documents of a source over which rounding to whole copies is carried on.
CHUNK = 512
#: Sources up to which their plan is broadcast; the driver holds one row of each in any case.
BROADCAST = 10_000


def targets(sizes: list[int], weights: list[int], share: Fraction, most: int = 2) -> list[Fraction]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``most`` times a size is reshared by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def sainte_lague(votes: list[Fraction], seats: list[int], caps: list[int]) -> list[list[int]]:
    """Seats of each party in houses of the growing sizes ``seats``; ties go to the lower index."""
    won, heap, out, given = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0], [], 0
    heapq.heapify(heap)
    for house in seats:
        while given < house and heap:
            _, i = heapq.heappop(heap)
            won[i] += 1
            given += 1
            if won[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
        out.append(list(won))
    return out


def quotas(sizes: list[int], weights: list[int], share: Fraction, blocks: int, shards: int) -> tuple[int, list[Fraction], list[list[int]]]:
    """Block length, the sources' targets, and for each shard the blocks that it takes of each source."""
    want = targets(sizes, weights, share)
    total = sum(want)
    length = max(1, int(total // blocks))
    house = round(total / length)
    caps = [2 * -(-s // length) for s in sizes]
    won = sainte_lague([Fraction(w) for w in want], [house * (s + 1) // shards for s in range(shards)], caps)
    return length, want, [[b - a for a, b in zip(before, now, strict=True)] for before, now in zip([[0] * len(sizes), *won], won, strict=False)]


def mix(docs: DataFrame, weights=WEIGHTS, share: Fraction = Fraction(3, 2), seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", blocks: int = 100_000, shards: int = 8, buckets: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, shard_words``.

    ``shard_words`` has, for each of ``shards`` shards, how many of the taken words are its: a source's draws, in seeded
    order, go to the shards by their integer quotas of it.

    ``size`` is the number of words (null text: 0), ``taken`` how many of them the mix takes, repeats counted,
    never more than twice ``size``. Sources are ranked by code point, null last, and null is a source of its own.
    ``blocks`` is about how many blocks the mix has, so a source's taken words miss its target by about one
    block, ``1 / blocks`` of the mix. Repeated rows are documents of their own, null ids come last in their
    bucket, an empty table gives an empty result, other columns are ignored. Equal rows that swap places change
    nothing; reruns agree.
    """
    return _mixed(docs, weights, share, seed, id_col, text_col, source_col, blocks, shards, buckets).select("doc_id", "size", "source_size", "target", "taken", "shard_words")


def _mixed(docs: DataFrame, weights, share: Fraction, seed: int, id_col: str, text_col: str, source_col: str, blocks: int, shards: int, buckets: int) -> DataFrame:
    """The rows of :func:`mix` with ``source``, ``text_hash`` and ``place``, and its source's ``full`` and ``extra``."""
    rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                             n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")), "words")
    order = F.xxhash64("doc_id", "text_hash", "size", F.lit(seed))
    rows = rows.withColumns({"bucket": F.pmod(order, F.lit(buckets)).cast("int"), "place": order})
    per_bucket = stash(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = per_bucket.groupBy("source").agg(F.sum("words").alias("words")).collect()
    sources = sorted(((r["source"], r["words"]) for r in sources), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [s for _, s in sources]
    length, want, shares = quotas(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, blocks, shards)
    plan = []
    for i, (name, words) in enumerate(sources):
        quota, n = sum(s[i] for s in shares), -(-words // length)
        a, b = sides(n)
        ends = list(itertools.accumulate(s[i] for s in shares))
        plan.append((name, words, float(want[i]), n, a, b, quota // n if n else 0, quota % n if n else 0, ends))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, n long, a long, b long, full long, extra long, ends array<long>")
    before = per_bucket.select(F.col("source").alias("bucket_source"), F.col("bucket").alias("bucket_no"),
                               (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("before"))
    before = stash(before, "before")
    inner = Window.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_last(), "text_hash", "size")
    rows = rows.withColumn("within", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(before, rows["source"].eqNullSafe(before["bucket_source"]) & (rows["bucket"] == before["bucket_no"]))
    plan = plan.withColumnRenamed("source", "plan_source")
    plan = F.broadcast(plan) if len(sources) <= BROADCAST else plan  # one row per source
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).withColumn("start", F.col("before") + F.col("within"))
    size, start, step = F.col("size"), F.col("start"), F.lit(length).cast("long")

    def drawn(block):
        """What is drawn of a block: an array of (words, shard), one for each time. Draw number c * n + rank is copy c."""
        overlap = F.least(start + size, (block + 1) * step) - F.greatest(start, block * step)

        def copies(rank):
            times = F.col("full") + (rank < F.col("extra")).cast("long")
            return F.transform(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>")), lambda c: F.struct(
                overlap.alias("words"), F.size(F.filter("ends", lambda e: e <= c * F.col("n") + rank)).alias("shard")))

        rank = F.when(F.col("n") > 0, feistel(block, F.col("n"), F.col("a"), F.col("b"), seed))
        return F.element_at(F.transform(F.array(rank), copies), 1)

    spans = F.when(size > 0, F.sequence(_div(start, step), _div(start + size - 1, step))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("drawn", F.flatten(F.transform(spans, drawn)))
    total = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda s, d: s + d["words"])
    by_shard = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: total(F.filter("drawn", lambda d: d["shard"] == k)))
    return rows.select("doc_id", "size", "source_size", "target", "source", "text_hash", "place", "full", "extra", total(F.col("drawn")).alias("taken"), by_shard.alias("shard_words"))


def whole_copies(docs: DataFrame, weights=WEIGHTS, share: Fraction = Fraction(3, 2), seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", chunk: int = CHUNK) -> DataFrame:
    """The mix in whole documents: ``doc_id, text_hash, source, copies`` of those that are taken once or twice.

    Each source's documents are dealt into chunks of about ``chunk``. In a chunk, from the longest to the shortest,
    a document is taken as often as brings the words of the whole copies nearest to the words that the mix takes,
    so what rounding leaves over is carried on, and documents of every length are taken at their source's ratio. A
    chunk ends about half a short document off. A source whose ratio lies between two whole numbers gets no other
    copies than these two. Rows that agree in id, text and source are taken equally often.
    """
    rows = _mixed(docs, weights, share, seed, id_col, text_col, source_col, 100_000, 8, 4096).where("size > 0")
    units = rows.groupBy("source", "doc_id", "text_hash", "place").agg(
        F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.first("full").alias("full"), F.first("extra").alias("extra"))
    units = stash(units, "units")
    chunks = units.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    chunks = F.broadcast(stash(chunks.withColumnRenamed("source", "chunk_source"), "chunks"))  # one row per source
    dealt = units.join(chunks, units["source"].eqNullSafe(chunks["chunk_source"])).withColumn("no", F.pmod(F.xxhash64("place"), F.col("chunks")))
    unit = F.struct((-F.col("size")).alias("less"), "place", "doc_id", "text_hash", "taken")
    lists = dealt.groupBy("source", "no").agg(F.array_sort(F.collect_list(unit)).alias("units"), F.first("full").alias("full"), F.first("extra").alias("extra"))

    def step(acc, u):
        due = acc["due"] + u["taken"]
        copies = F.least(F.greatest(F.round(due / -u["less"]).cast("long"), F.col("full")), F.col("full") + (F.col("extra") > 0).cast("long"))
        return F.struct((due + copies * u["less"]).alias("due"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0).cast("long").alias("due"), F.array().cast("array<bigint>").alias("copies"))
    lists = lists.select("source", F.explode(F.arrays_zip("units", F.aggregate("units", start, step)["copies"].alias("copies"))).alias("u"))
    return lists.select("u.units.doc_id", "u.units.text_hash", "source", F.col("u.copies").alias("copies")).where("copies > 0")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
