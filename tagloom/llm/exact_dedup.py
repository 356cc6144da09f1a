"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

DataFrame functions only. The first pass takes from each row the length of the normalised text and a hash of
its first ``prefix`` characters; no text goes through a shuffle. Grouping by both together leaves what grouping
by length and then by prefix hash would leave, with one shuffle less. Only rows whose (length, prefix hash) has
another member get to the SHA-256 of the whole normalised text, and equal digests make the groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import fresh, keep_rows, stash, without_space

PREFIX = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=without_space,
                prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when ``normalise`` makes them identical; null counts as empty, and empty texts are equal to
    each other. Of equal texts the row with the most code points in the original text stays, then the smallest
    id; a null id comes last. ``text_sha256`` is null for rows whose length and prefix no other row has, as
    their text was never hashed, unless ``digest_all`` asks for all digests.

    Repeated rows (same id, same text) form one group, and each repeat of the row that stays is marked
    ``kept``; :func:`drop_exact_copies` leaves one of them. An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    norm = normalise(F.col(text_col))
    digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    ids = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("points")]
    texts = docs.select(*ids, norm.alias("norm")).select(
        "doc_id", "points", F.char_length("norm").cast("long").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("pre"), "norm")
    if digest_all:
        rows = stash(texts.select("doc_id", "points", "len", "pre", digest), "exact")
        shared = rows.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        groups = rows.join(stash(shared, "shared"), ["len", "pre"], "left_semi")
        return _resolve(rows, groups)
    narrow = stash(texts.drop("norm"), "narrow")
    shared = stash(narrow.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    hashed = stash(texts.join(shared, ["len", "pre"], "left_semi").select("doc_id", "points", digest), "hashed")
    alone = narrow.join(shared, ["len", "pre"], "left_anti").select("doc_id", "points", F.lit(None).cast("string").alias("text_sha256"))
    return _resolve(hashed.unionByName(alone), hashed)


def _resolve(rows: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """The result with ``more`` columns of ``rows``. Counts per digest go back to the rows through a written table, so that a hot digest can be split."""
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("rev"))).alias("best")
    per = groups.groupBy("text_sha256").agg(best, F.count("*").alias("n")).where("n > 1")
    per = stash(per.select(F.col("text_sha256").alias("sha"), F.bitwise_not("best.rev").alias("first_id"), F.col("best.points").alias("most"), "n"), "groups")
    grouped = F.col("sha").isNotNull()
    return rows.join(per, F.col("text_sha256") == F.col("sha"), "left").select(
        "doc_id",
        F.when(grouped, F.col("first_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("points") == F.col("most"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256", *more,
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=without_space, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    Only texts whose length and prefix hash have another member are hashed as a whole. Rows are known again by id, length
    and prefix hash; the few that agree in these and still differ in what becomes of them (repeated ids) by their digest.
    """
    norm = normalise(F.col(text_col))
    key = {"doc_id": F.col(id_col).cast("long"), "len": F.char_length(norm).cast("long"), "pre": F.xxhash64(F.substring(norm, 1, prefix))}
    narrow = stash(docs.select(*[v.alias(k) for k, v in key.items()]), "narrow")
    shared = stash(narrow.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    points = F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("points")
    texts = docs.select(*[v.alias(k) for k, v in key.items()], points, norm.alias("norm")).join(shared, ["len", "pre"], "left_semi")
    hashed = stash(texts.select("doc_id", "len", "pre", "points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "hashed")
    decided = _resolve(hashed, hashed, "len", "pre").groupBy("doc_id", "len", "pre").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    decided = stash(decided.where("not (n = 1 and k = 1)"), "decided")  # single rows of other keys stay
    names = {k: fresh(docs, f"_{k}") for k in (*key, "n", "k")}
    rows, gone = docs.withColumns({names[k]: v for k, v in key.items()}), decided.select(*[F.col(k).alias(f"{v}_r") for k, v in names.items()])
    same = F.lit(True)
    for k in key:
        same = same & rows[names[k]].eqNullSafe(gone[f"{names[k]}_r"])
    out = [F.col(f"`{c}`") for c in docs.columns]
    stay = rows.join(gone, same, "left_anti").select(*out)
    if decided.where("k > 0").isEmpty():
        return stay
    mixed = rows.join(gone.where(F.col(f"{names['k']}_r") > 0), same, "left_semi").select(*out)
    kept = stash(_resolve(hashed, hashed).where("kept").select("doc_id", "text_sha256"), "kept")
    return stay.unionByName(keep_rows(mixed, {"doc_id": key["doc_id"], "text_sha256": F.sha2(norm.cast("binary"), 256)}, kept))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


OP8_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, points, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w
         AND points = max(points) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST)
"""
