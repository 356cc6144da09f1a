"""What the operators share: the shared folder, written intermediate tables, words and hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a character class for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, or below what ``setCheckpointDir`` has named.

    All executors share it. Only a local session, whose executors are threads of the driver, may name none: there
    a temporary folder is used; a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _runs:
        base = context.getConf().get("spark.checkpoint.dir", None)
        if not base and context._jsc.sc().getCheckpointDir().isDefined():
            base = context._jsc.sc().getCheckpointDir().get()
        if not base:
            if not re.match(r"local(\[[^-]*\])?$", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        _runs[app] = f"{base.rstrip('/')}/tagloom-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _runs[app])
    return _runs[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop_stash(*frames: DataFrame | None) -> None:
    """Delete the files of tables that :func:`stash` returned and that no later plan reads."""
    for df in frames:
        if df is not None and hasattr(df, "stash_path"):
            delete(df.sparkSession, df.stash_path)


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None]) -> None:
    """``owner`` is about to use what it keeps in this Python worker; other owners let go of theirs.

    Workers live on from stage to stage, so that without this the tables of all operators add up.
    """
    for name in [n for n in _held if n != owner]:
        _held.pop(name)()
    _held[owner] = release


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_space(text: Column) -> Column:
    """The text with every character of ``[\\x20\\x09-\\x0D]`` deleted; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def each_slice(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what Python holds of long texts stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def row_key(doc_id: Column, text_hash: Column) -> Column:
    """One number for a row by its id, which may be null, and the hash of its text."""
    return F.xxhash64(doc_id, text_hash)


def fresh(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def keep_rows(docs: DataFrame, keys: dict[str, Column], kept: DataFrame, once: bool = True) -> DataFrame:
    """The rows of ``docs`` whose keys are among ``kept`` (columns named as ``keys``), all columns unchanged.

    Keys compare null-safe. Each row of ``kept`` admits the rows of its key; with ``once``, of rows that agree
    in every key and for which ``kept`` has repeats, one stays. ``kept`` must be a written (stashed) table.
    """
    names = {k: fresh(docs, f"_{k}") for k in keys}
    count = fresh(docs, "_rows")
    per_key = kept.groupBy(*keys).agg(F.count("*").alias(count))
    per_key = per_key.select(*[F.col(k).alias(f"{names[k]}_r") for k in keys], count)
    rows = docs.withColumns({names[k]: v for k, v in keys.items()})
    on = F.lit(True)
    for n in names.values():
        on = on & rows[n].eqNullSafe(per_key[f"{n}_r"])
    out = docs.columns
    if not once or per_key.where(F.col(count) > 1).isEmpty():
        return rows.join(per_key, on, "left_semi").select(*[F.col(f"`{c}`") for c in out])
    both = rows.join(per_key, on, "inner")
    single = both.where(F.col(count) == 1)
    repeated = both.where(F.col(count) > 1).dropDuplicates(list(names.values()))
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in out])
