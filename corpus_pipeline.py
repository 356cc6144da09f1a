"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import exact_dedup, langid, minhash, mixing, packing
from tagloom.llm.common import fresh, shared_dir, stash

SIMILAR = (80, 100)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter, and those that resemble no language that the corpus is labelled with."""
    names, prototypes = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.in_known_language(docs, names, prototypes)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.drop_near_copies(docs, *SIMILAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents, each taken at most twice; a source's words meet its target. Those without a word leave."""
    name = {c: fresh(docs, f"_{c}") for c in ("id", "hash", "source", "times", "copy")}
    taken = mixing.whole_copies(docs).select(F.col("doc_id").alias(name["id"]), F.col("text_hash").alias(name["hash"]), F.col("source").alias(name["source"]),
                                             F.col("copies").cast("int").alias(name["times"]))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col(name["id"])) & (F.xxhash64("text") == F.col(name["hash"]))
            & F.col("source").cast("string").eqNullSafe(F.col(name["source"])))
    rows = docs.where(mixing.n_words(F.col("text")) > 0).join(stash(taken, "times"), same)
    return rows.withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["times"])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("language", identify), ("exact", drop_copies), ("near", drop_near_copies), ("mix", mix_sources), ("pack", pack)]
#: Tokens, shingle links and seeded blocks are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
