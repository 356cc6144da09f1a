"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A trigram's vector binds (multiplies) the
vectors of its letters, permuted (rolled) by their place; a text's vector bundles (adds) those of its trigrams;
a language's prototype bundles its training texts, each scaled to length one. A text gets the language whose
prototype has the largest cosine. Whole texts are used, in pieces of bounded memory; a model is ``DIM`` numbers
per language.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.llm.common import each_slice as _each
from tagloom.llm.common import drop_stash, hold, stash

DIM = 512
PIECE = 1_000_000
#: At most so many labelled texts of each language make its prototype.
TRAIN_PER_LANG = 4000
#: A cosine of unrelated vectors has the standard deviation 1 / sqrt(DIM); a text in a learned language is beyond so many of them.
DEVIATIONS, SHORT = 4.0, 50
_BMP = None


def _letters(text: str) -> np.ndarray:
    """Code points in lower case, each run of other characters as one 0, with a 0 at both ends."""
    global _BMP
    if _BMP is None:
        _BMP = np.array([chr(i).isalpha() for i in range(0x10000)])
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = c >= 0x10000
    ok = _BMP[np.where(wide, 0, c)]
    if wide.any():
        ok[wide] = [chr(x).isalpha() for x in c[wide]]
    c = np.concatenate([[0], np.where(ok, c, 0), [0]]).astype(np.uint64)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (21 bits a letter) and their counts; empty for a text without a letter."""
    keys, counts = [], []
    for i in range(0, len(text), PIECE):
        x = _letters(text[i : i + PIECE])
        if len(x) >= 3:
            k, n = np.unique((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:], return_counts=True)
            keys.append(k)
            counts.append(n)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


class Space:
    """The vectors of letters and trigrams; trigrams are kept up to ``limit``."""

    def __init__(self, dim: int = DIM, limit: int = 20_000) -> None:
        self.dim, self.limit, self.letters = dim, limit, {}
        self.keys, self.table = np.empty(0, np.uint64), np.empty((0, dim), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) > self.limit:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64(c + 1)).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[c] = bits * 2 - 1
        return self.letters[c]

    def bind(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << 21) - 1)
        out = np.ones((len(keys), self.dim), np.int8)
        for turn, shift in ((2, 42), (1, 21), (0, 0)):
            letters, at = np.unique((keys >> np.uint64(shift)) & mask, return_inverse=True)
            out *= np.roll(np.stack([self.letter(int(c)) for c in letters]), turn, axis=1)[at]
        return out

    def learn(self, keys: np.ndarray) -> None:
        """Adds the vectors of trigrams that the table lacks; a full table starts anew."""
        keys = np.setdiff1d(keys, self.keys)
        if len(keys):
            if len(self.keys) + len(keys) > self.limit:
                self.keys, self.table = self.keys[:0], self.table[:0]
            keys = keys[: self.limit]
            for i in range(0, len(keys), 4096):
                at = np.searchsorted(self.keys, keys[i : i + 4096])
                self.table = np.insert(self.table, at, self.bind(keys[i : i + 4096]), axis=0)
                self.keys = np.insert(self.keys, at, keys[i : i + 4096])

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float32)
        for i in range(0, len(keys), 4096):
            k, n = keys[i : i + 4096], counts[i : i + 4096].astype(np.float32)
            at = np.searchsorted(self.keys, k)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == k if len(self.keys) else np.zeros(len(k), bool)
            out += n[known] @ self.table[at[known]].astype(np.float32)
            if not known.all():
                out += n[~known] @ self.bind(k[~known]).astype(np.float32)
        return out

    def profiles(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The texts' vectors of length one; None without a letter."""
        return [v for v, _ in self.measured(texts)]

    def measured(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, int]]:
        """The texts' vectors of length one and their numbers of trigrams, None and 0 without a letter."""
        out: list[tuple[np.ndarray | None, int]] = []
        for i in range(0, len(texts), 64):
            grams = [trigrams(t or "") for t in texts[i : i + 64]]
            self.learn(np.unique(np.concatenate([k for k, _ in grams])))
            for k, n in grams:
                v = self.bundle(k, n)
                norm = float(np.linalg.norm(v))
                out.append((None if not len(k) else v / norm if norm else v, int(n.sum())))
        return out


_spaces: dict[int, Space] = {}


def _space(dim: int) -> Space:
    """One space for all tasks of a Python worker."""
    hold("langid", _spaces.clear)
    if dim not in _spaces:
        _spaces[dim] = Space(dim)
    return _spaces[dim]


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Prototypes from a table ``doc_id, text, lang``: of each language the ``per_lang`` rows of least hash.

    Rows without a text or language teach nothing. The driver gets ``dim`` numbers for each language.
    """
    rows = docs.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("_total"))
    h = F.xxhash64("doc_id", "text")
    # thin out first, so that ranking sees little more than per_lang rows of a language
    share = F.least(F.lit(1.0), F.lit(1.2) * per_lang / F.col("_total") + F.lit(2.0) / F.sqrt("_total"))
    thin = rows.join(F.broadcast(counts), "lang").withColumn("_h", h).where(F.pmod("_h", F.lit(1_000_003)) < share * 1_000_003)
    ids = stash(thin.select("lang", "doc_id", "_h"), "sample")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    chosen = stash(ids.withColumn("_r", rank).where(F.col("_r") <= per_lang).select("_h").distinct(), "chosen")

    def run(batches):
        space, sums = _space(dim), {}
        for batch in batches:
            for part in _each(batch):
                for lang, v in zip(part.column("lang").to_pylist(), space.profiles(part.column("text").to_pylist()), strict=True):
                    if v is not None:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

    drop_stash(ids)
    picked = thin.join(chosen, "_h", "left_semi").select("lang", "text")
    sums = picked.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas()  # languages times dim
    drop_stash(chosen)
    names = sorted(sums["lang"].unique())
    if not names:
        return [], np.zeros((0, dim), np.float32)
    table = sums.pivot(index="lang", columns="i", values="v").reindex(index=names, columns=range(dim)).to_numpy()
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-30)
    return names, table.astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score, letters``; looks at nothing but the text.

    ``score`` is the cosine with the best prototype, at least 0; ties go to the first name. Null, empty and
    letterless texts, and all texts where nothing was learned, are ``und`` with score 0. Repeated rows get equal
    answers, null ids are kept, an empty table gives an empty result, other columns are ignored.
    """
    dim = prototypes.shape[1]

    def run(batches):
        space = _space(dim)
        for batch in batches:
            langs, scores = [], []
            for part in _each(batch):
                for v in space.profiles(part.column("text").to_pylist()) if names else [None] * part.num_rows:
                    cos = prototypes @ v if v is not None else None
                    best = int(cos.argmax()) if v is not None else -1
                    langs.append(names[best] if v is not None else "und")
                    scores.append(float(min(1.0, max(0.0, cos[best]))) if v is not None else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_known_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, all columns unchanged; each row is judged by itself.

    A row stays if its best cosine is ``DEVIATIONS / sqrt(dimensions)`` or more. What is asked of a text falls with
    its length n (in trigrams) as n / (n + ``SHORT``), as a short text in the language may hold few of its common
    trigrams. Null, empty and letterless texts go. Where nothing was learned, all texts with a letter stay.
    """
    dim = prototypes.shape[1]

    def run(batches):
        space = _space(dim)
        for batch in batches:
            for part in _each(batch):
                keep = []
                for v, n in space.measured(part.column(text_col).to_pylist()):
                    least = DEVIATIONS / dim**0.5 * n / (n + SHORT)
                    keep.append(v is not None and (not names or float((prototypes @ v).max()) >= least))
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, prototypes = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = predict(docs, names, prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
