"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities.

Best fit places by length alone, so the driver packs the histogram of piece lengths, at most ``capacity`` rows
whatever the corpus: for each length, from the longest, the tightest open bins that it fits come from a segment
tree over capacities that counts the open bins of each; equal bins are handled as intervals of bin numbers, with
exactly the result of placing piece after piece. Each interval yields a run (length, ranks, first bin, pieces
per bin, offset). On the executors, a piece's rank among those of its length finds its run by binary search.

A bin holds at most 63 different lengths and a length splits at most two intervals, so the number of runs is
bounded by the capacity, not by the data.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.llm.common import hold, stash

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"


class Capacities:
    """Segment tree over remaining capacities 0..size: finds the least capacity >= x that has open bins."""

    def __init__(self, size: int) -> None:
        self.base = 1 << (size + 1).bit_length()
        self.any = [False] * (2 * self.base)

    def set(self, capacity: int, has: bool) -> None:
        i = self.base + capacity
        self.any[i] = has
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, x: int) -> int | None:
        i = self.base + x
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """(bins, runs): a run is (length, first rank, first bin, pieces per bin, offset); ranks count from 0.

    Pieces rank..: the k-th piece of a run goes to bin ``first bin + k // per`` at ``offset + k % per * length``.
    """
    tree, open_, bins, runs = Capacities(capacity), [[] for _ in range(capacity + 1)], 0, []

    def put(left: int, interval: tuple[int, int]) -> None:
        if left:
            open_[left].append(interval)
            tree.set(left, True)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            room = tree.tightest(length)
            if room is None:
                room, start, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                start, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            per = room // length
            use = min(n, todo // per)
            if use:
                runs.append((length, rank, start, per, capacity - room))
                put(room - per * length, (start, use))
                rank, todo, start, n = rank + use * per, todo - use * per, start + use, n - use
            if n and todo and todo < per:
                runs.append((length, rank, start, per, capacity - room))
                put(room - todo * length, (start, 1))
                rank, todo, start, n = rank + todo, 0, start + 1, n - 1
            if n:
                put(room, (start, n))
    return bins, runs


#: Latin letters, then ASCII punctuation: this tokenizer parts a text between them in any case. U+0130 is no such
#: letter, as its lower case has a combining dot, which joins the marks.
_WORD_AND_MARKS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-/:-@\[-`{-~]*)")
#: What a tokenizer must say of itself if white space is to part texts for it, and letters from marks, whatever their case.
_NORMALISE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def parts_at_space(tokenizer: str) -> bool:
    """Whether the ids of a text are those of its runs of other characters than white space, one after the other."""
    with open(tokenizer, encoding="utf-8") as f:
        said = json.load(f)
    return ((said.get("normalizer") or {}).get("normalizers") == _NORMALISE and (said.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0] == _SPLIT
            and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in said.get("added_tokens", ())))


class Known(dict):
    """Ids, as little-endian bytes, of runs of other characters than white space; emptied when it is full."""

    limit = 1_200_000

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.encode, self.runs = Tokenizer.from_file(tokenizer).encode, parts_at_space(tokenizer)

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        """All ids of a text: by its runs where that is right for the tokenizer, else of the text as a whole."""
        return b"".join(map(self.__getitem__, text.split())) if self.runs else self.ids(text.decode("utf-8", "replace"))

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        parts = _WORD_AND_MARKS.fullmatch(text) if len(run) <= 64 else None
        if parts and parts[2]:
            ids = self[parts[1].encode().lower()] + self[parts[2].encode()]
        elif parts and (lower := run.lower()) != run:
            ids = self[lower]
        else:
            ids = self.ids(text)
        if len(run) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[run] = ids
        return ids


_tables: dict[str, Known] = {}


def _known(tokenizer: str) -> Known:
    """One table for all tasks of a Python worker."""
    hold("packing", _tables.clear)
    if tokenizer not in _tables:
        _tables[tokenizer] = Known(tokenizer)
    return _tables[tokenizer]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of a table ``doc_id, text`` (text as binary, null: empty).

    Where white space parts a text for the tokenizer, and it ignores case, ids are looked up for each distinct run of
    other characters; for any other tokenizer, each text is encoded as a whole.
    """

    def run(batches):
        known, step = _known(tokenizer), 4 * capacity
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), ([], [], [], [], [])
            for doc, text in zip(ids, batch.column("text"), strict=True):
                tokens = known.of(text.as_py() or b"") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(tokens), step)):
                    part = tokens[at : at + step]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table ``doc_id, piece, start, length, ids_crc32``.

    Ranks among the pieces of one length come from hash buckets and the counts of the buckets before, so no
    length, however common, meets in one task.
    """
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    buckets = buckets or max(64, sum(histogram.values()) // 1_000_000)
    _, runs = best_fit_decreasing(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, *rest in runs:
        by_length.setdefault(length, []).append(rest)
    table = {k: np.array(v, np.int64).T for k, v in by_length.items()}
    shared = rows.sparkSession.sparkContext.broadcast(table)
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", key)
    counts = rows.groupBy(F.col("length").alias("_length"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = stash(counts.select("_length", "_b", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_b")) - F.col("_n")).alias("_before")), "before")
    inner = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("_in", F.row_number().over(inner) - 1)
    ranked = ranked.join(before, (ranked["length"] == before["_length"]) & (ranked["_bucket"] == before["_b"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_in")).cast("long").alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    ranks, starts, per, offset = shared.value[int(length[part[0]])]
                    at = np.searchsorted(ranks, rank[part], "right") - 1
                    k = rank[part] - ranks[at]
                    bins[part], offsets[part] = starts[at] + k // per[at], offset[at] + k % per[at] * length[part]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins), pa.array(offsets)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each row of ``docs``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and an id 0, so a null or empty text is one piece of length 1. Documents longer than
    ``capacity`` are cut into full pieces and a rest. Repeated rows and null ids are packed like any other, equal
    pieces may swap places, an empty table gives an empty result, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return pack(stash(pieces(rows, tokenizer, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
