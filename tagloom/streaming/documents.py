"""Markup in Structured Streaming.

Whole documents need no state: :func:`tagloom.operators.lexer.tokens` works on a streaming table as it is. For
documents that come in chunks, whatever way they are cut, :func:`fragments` gives out their text early: all that is
complete, that is up to the last tag, comment or other construct whose end has come. What it keeps of a document is the
start of what is incomplete, the open tags about it, and chunks that came before their turn. A fragment begins with
those open tags, so that lexer and path expressions can treat it like a document of its own, without state; what they
find in the repeated tags is passed over.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.functions.entities import PREDEFINED
from tagloom.operators.ahead import with_tokens
from tagloom.operators.lexer import _COMPLETE, _NAME, _PAIR, _WS, CHUNK
from tagloom.plans.automaton import select_paths

_chunk, _complete, _pair = re.compile(CHUNK), re.compile(rf"(?s)(?:{_COMPLETE})"), re.compile(_PAIR)
_open, _shut, _entity = re.compile(rf"<{_NAME}"), re.compile(rf"/{_WS}*>$"), re.compile(r"&([A-Za-z_][^;\s&<#]{0,14});")
_BLANK = "".join(map(chr, range(1, 33)))
#: Fragments of a batch.
SLICE = 1000
FRAGMENT = "doc_id string, text string, skip int, base int, last boolean"


class Cutter:
    """One document that comes in chunks. :attr:`state` is what is kept of it, as text."""

    def __init__(self, state: str | None = None, entities: tuple[str, ...] = ()) -> None:
        have = json.loads(state) if state else {}
        self.next, self.early, self.carry = have.get("next", 0), have.get("early", {}), have.get("carry", "")
        self.stack, self.seq, self.begun, self.seek, self.over = have.get("stack", []), have.get("seq", 0), have.get("begun", False), have.get("seek", False), have.get("over", False)
        self.names = {*PREDEFINED, *entities}

    @property
    def state(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("next", "early", "carry", "stack", "seq", "begun", "seek", "over")})

    def feed(self, number: int, data: str | None, is_last: bool) -> Iterator[tuple[str, int, int, bool]]:
        """The fragments (text, tokens to pass over, number of the next token, last) that a chunk completes. Chunks that come twice count once."""
        if number >= self.next:
            self.early.setdefault(str(number), [data or "", is_last])
        while not self.over and str(self.next) in self.early:
            data, is_last = self.early.pop(str(self.next))
            self.next += 1
            yield from self._add(data, is_last)

    def finish(self) -> Iterator[tuple[str, int, int, bool]]:
        """What there is when no more chunks will come."""
        if not self.over:
            yield from self._add("", True)

    def _add(self, data: str, is_last: bool) -> Iterator[tuple[str, int, int, bool]]:
        nul = data.find("\0")
        if nul >= 0:
            data, is_last = data[:nul], True
        text = self.carry + data
        if not self.begun:
            text = text.lstrip(_BLANK)
        parts = _chunk.findall(text)
        if not is_last and parts and (not parts[-1].startswith("<") or not _complete.fullmatch(parts[-1])):
            # content may go on, and so may what has no end yet
            self.carry = parts.pop()
        else:
            self.carry = ""
        if not parts and not is_last:
            return
        if self.seek and parts and not parts[0].startswith("<"):
            parts[0] = parts[0].lstrip(_BLANK)
            parts = parts if parts[0] else parts[1:]
            self.seek = False
        # a close tag that nothing has opened lets content come first; then the open tags
        prefix, base, skip, count = ["</_>", *self.stack] if self.begun else [], self.seq, 0, 0
        skip = sum(1 + 2 * len(_pair.findall(t)) for t in prefix)
        for i, part in enumerate(parts):
            tokens, wrong = self._count(part, self.begun or i > 0)
            count += tokens
            if wrong:
                parts, self.over = parts[: i + 1], True
                break
        self.begun, self.seq, self.over = self.begun or bool(parts), self.seq + count, self.over or is_last
        yield "".join([*prefix, *parts]), skip, base, self.over

    def _count(self, part: str, inside: bool) -> tuple[int, bool]:
        """How many tokens a chunk has, and whether it is an error, which ends the document."""
        seek, self.seek = self.seek, False
        names = not {m for m in _entity.findall(part)} <= self.names
        if not part.startswith("<"):
            return int(bool(part.strip(_BLANK) or not seek)), names or not inside
        if not _complete.fullmatch(part):
            return 1, True
        if part.startswith("<!--"):
            self.seek = True
            return 0, False
        if part.startswith("<![CDATA["):
            return 0, False
        if part.startswith("<!"):
            self.seek = True
            return len(re.findall(r"\"[^\"]*\"|'[^']*'|[^\x01-\x20\"']+", part[2:].rstrip()[:-1])) + 1, False
        if part.startswith("<?"):
            self.seek = not inside
            return (0 if inside else 2 + 2 * len(_pair.findall(part))), not inside and not part.startswith("<?xml")
        if part.startswith("</"):
            if self.stack:
                self.stack.pop()
            return 1, False
        shut = bool(_shut.search(part))
        if not shut:
            self.stack.append(part)
        return 1 + 2 * len(_pair.findall(part)) + shut, names


def _rows(key: str, found: Iterator[tuple[str, int, int, bool]]) -> pd.DataFrame:
    return pd.DataFrame([(key, *f) for f in found], columns=["doc_id", "text", "skip", "base", "last"])


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.string(), "text": pa.string(), "skip": pa.int32(), "base": pa.int32(), "last": pa.bool_()}
    columns = zip(*found, strict=True) if found else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def fragments(chunks: DataFrame, timeout_ms: int | None = None, entities: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, skip, base, last`` of ``doc_id string, chunk int, data string, is_last boolean``.

    Chunks are numbered from 0 in each document and may come in any order and more than once. ``timeout_ms`` ends
    a document of which nothing has come for so many milliseconds; without one, a document that never gets its last
    chunk is kept. A table that is no stream is done by document at once. What is kept of a document whose end has come
    is one word, so that late repeats of its chunks do nothing; with ``timeout_ms`` that goes too.
    """
    if not chunks.isStreaming:
        def whole(batches):
            cutter, key, found = None, None, []
            for batch in batches:
                for doc, c, d, e in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "chunk", "data", "is_last")), strict=True):
                    if cutter is None or doc != key:
                        found += [] if cutter is None else [(key, *f) for f in cutter.finish()]
                        cutter, key = Cutter(entities=entities), doc
                    found += [(key, *f) for f in cutter.feed(int(c), d, bool(e))]
                    if len(found) >= SLICE:
                        yield _batch(found)
                        found = []
            found += [] if cutter is None else [(key, *f) for f in cutter.finish()]
            yield _batch(found)

        # one document after the other, chunk by chunk: nothing is held but what the cutter keeps
        rows = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk", "data", "is_last").repartition("doc_id")
        return rows.sortWithinPartitions("doc_id", "chunk").mapInArrow(whole, FRAGMENT)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            cutter = Cutter(state.get[0], entities)
            found = list(cutter.finish())
            state.remove()
            if found:
                yield _rows(key[0], iter(found))
            return
        cutter = Cutter(state.get[0] if state.exists else None, entities)
        for pdf in frames:
            pdf = pdf.sort_values("chunk")
            found = [f for c, d, e in zip(pdf["chunk"], pdf["data"], pdf["is_last"], strict=True) for f in cutter.feed(int(c), d, bool(e))]
            if found:
                yield _rows(key[0], iter(found))
        state.update((json.dumps({"over": True}) if cutter.over else cutter.state,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("doc_id").applyInPandasWithState(step, FRAGMENT, "state string", "append", kind)


def scan_chunks(chunks: DataFrame, timeout_ms: int | None = None, entities: dict[str, str] | None = None, **options) -> DataFrame:
    """``doc_id, seq, type, value, error`` of documents in chunks, each token as soon as its construct is complete: as :func:`tokens` of the whole texts."""
    parts = fragments(chunks, timeout_ms, tuple(entities or ()))
    rows, every = with_tokens(parts.where("text != '' or last"), "text", entities=entities, **options)
    # the end is that of the last fragment
    rows = rows.select("doc_id", "skip", "base", "last", F.posexplode_outer(every).alias("at", "t")).where("t is not null and at >= skip and (t.type != 'Exit' or last)")
    return rows.select("doc_id", (F.col("base") + F.col("at") - F.col("skip")).cast("int").alias("seq"), "t.type", "t.value", "t.error")


def select_chunks(chunks: DataFrame, expressions: dict, timeout_ms: int | None = None, entities: dict[str, str] | None = None, **options) -> DataFrame:
    """``doc_id, seq, type_id, token_type, value`` of documents in chunks, as early as :func:`scan_chunks`; expressions may not have an index or range."""
    parts = fragments(chunks, timeout_ms, tuple(entities or ()))
    one = F.struct("doc_id", "skip", "base").alias("id")
    found = select_paths(parts.select(one, "text"), "id", "text", expressions, entities=entities, **options).where("seq >= doc_id.skip")
    return found.select("doc_id.doc_id", (F.col("seq") - F.col("doc_id.skip") + F.col("doc_id.base")).alias("seq"), "type_id", "token_type", "value")


def assemble(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``doc_id, text`` of documents in chunks, each whole, once its last chunk has come."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        have, last = ({}, -1) if not state.exists else (dict(zip(state.get[0], state.get[1], strict=True)), state.get[2])
        for pdf in frames:
            for chunk, data, is_last in zip(pdf["chunk"], pdf["data"], pdf["is_last"], strict=True):
                have[int(chunk)] = data
                last = int(chunk) if is_last else last
        if last >= 0 and len(have) == last + 1:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "text": ["".join(have[i] for i in range(last + 1))]})
        else:
            state.update((list(have), list(have.values()), last))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("doc_id").applyInPandasWithState(step, "doc_id string, text string", "chunks array<int>, data array<string>, last int", "append", kind)
