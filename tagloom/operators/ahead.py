"""The quick lane ahead of the expressions: texts of complete constructs are lexed and folded in Python workers.

An expression costs some microseconds for each of its parts and chunks, as Spark interprets what stands in lambdas.
:func:`ahead` does texts of the quick lane by compiled regular expressions, a slice of a batch at a time, equal texts of
a slice once. What it is not sure of (errors, unknown entities, odd headers and references, bytes that are no UTF-8) it
hands on as it is, to the expressions of :mod:`tagloom.operators.lexer`; so it decides nothing by itself, and both give
the same tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.entities import _PIECES, PREDEFINED
from tagloom.operators.lexer import _COMPLETE, _NAME, _PAIR, _QUICK, _WS, TOKEN, chunks_of

#: Rows and bytes of a slice; kinds and sizes of chunks that are remembered, and how many.
ROWS, LIMIT, SHORT, KEEP = 10_000, 2 << 20, 100, 1 << 14
BLANK = "".join(map(chr, range(1, 33)))
_quick, _complete, _pair = re.compile(_QUICK), re.compile(rf"(?s)(?:{_COMPLETE})"), re.compile(_PAIR)
_tag, _piece, _eol = re.compile(rf"<({_NAME}++)"), re.compile(_PIECES, re.ASCII), re.compile("\r\n?")
_quoted = rf"{_WS}++({_NAME}++){_WS}*+={_WS}*+(\"[^\"<]*+\"|'[^'<]*+')"
_header, _field = re.compile(rf"<\?xml(?:{_quoted})*+{_WS}*+\?>"), re.compile(_quoted)
_bracket, _word = re.compile(r"\[[^\]]*\]"), re.compile(r"\"[^\"]*\"|'[^']*'|[^\x01-\x20\"']+")
#: ``(head type, head value, attribute type, attributes (name, value), last type or None, tokens, further values of a declaration)``.
Chunk = tuple[str, str | None, str, list[tuple[str, str | None]], str | None, int, list[str]]
EXIT: Chunk = ("Exit", "", "", [], None, 1, [])


class Unsure(Exception):
    """The expressions must do this text."""


class Lane:
    """Chunks of texts; options as for :func:`tagloom.operators.lexer.tokens`."""

    def __init__(self, entities: dict[str, str] | None = None, cdata: bool = False, strip_bom: bool = False, values: tuple[str, ...] | None = None) -> None:
        self.names = (entities or {}) | PREDEFINED
        self.cdata, self.strip_bom = cdata, strip_bom
        self.content, self.attribute = (values is None or k in values for k in ("Content", "TagAttribValue"))
        self.known: dict[str, Chunk | None] = {}

    def _decoded(self, raw: str) -> str:
        raw = _eol.sub("\n", raw) if "\r" in raw else raw
        if "&" not in raw:
            return raw
        return "".join([self._reference(p) if p[0] == "&" and len(p) > 1 else p for p in _piece.findall(raw)])

    def _reference(self, piece: str) -> str:
        if piece[1] != "#":
            value = self.names.get(piece[1:-1])
            if value is None:
                raise Unsure
            return value
        hexes = piece[2] == "x"
        digits = piece[3:-1] if hexes else piece[2:-1]
        point = int(digits, 16) if hexes else int(digits)
        if not (0 < point < 0xD800 or 0xDFFF < point < 0xFEFF or 0xFEFF < point <= 0x10FFFF):
            raise Unsure
        return chr(point)

    def _value(self, raw: str, wanted: bool) -> str | None:
        return (self._decoded(raw) if "&" in raw or "\r" in raw else raw) if wanted else None

    def _chunk(self, c: str, first: bool) -> Chunk | None:
        """The tokens of a complete chunk; None if it has none."""
        if c[0] != "<":
            return ("Content", self._value(c, self.content), "", [], None, 1, [])
        if c[1] == "/":
            return ("CloseTag", c[2:-1].rstrip(BLANK), "", [], None, 1, [])
        if c[1] == "!":
            if c.startswith("<!--"):
                return None
            if c.startswith("<![CDATA["):
                return ("Content", c[9:-3], "", [], None, 1, []) if self.cdata else None
            words = [w[1:-1] if w[0] in "'\"" else w for w in _word.findall(_bracket.sub(" ", c.rstrip(BLANK)[2:-1]))]
            if not words:
                return ("DocAttribEnd", "", "", [], None, 1, [])
            return ("DocAttribValue", words[0], "", [], "DocAttribEnd", len(words) + 1, words[1:])
        if c[1] == "?":
            if not first:
                return None
            if not _header.fullmatch(c):
                raise Unsure
            fields = [(n, self._decoded(v[1:-1])) for n, v in _field.findall(c)]
            return ("HeaderStart", "?xml", "HeaderAttrib", fields, "HeaderEnd", 2 + 2 * len(fields), [])
        pairs = [(n, self._value(v[1:-1] if v[0] in "'\"" else v, self.attribute)) for n, v in _pair.findall(c)] if "=" in c else []
        shut = c[:-1].rstrip(BLANK).endswith("/")
        return ("OpenTag", _tag.match(c)[1], "TagAttrib", pairs, "CloseTagIm" if shut else None, 1 + 2 * len(pairs) + shut, [])

    def chunks(self, text: str) -> list[Chunk]:
        """All chunks that have tokens, and the end."""
        if "\0" in text:
            text = text[: text.index("\0")]
        if self.strip_bom and text.startswith("\ufeff"):
            text = text[1:]
        text = text.lstrip(BLANK)
        if not text.startswith("<"):
            raise Unsure
        found = _quick.findall(text)
        if found[-1][0] == "<" and not _complete.fullmatch(found[-1]):
            raise Unsure
        if text[1] == "?" and len(found) > 1 and found[1][0] != "<":
            found[1] = found[1].lstrip(BLANK)
            if not found[1]:
                del found[1]
        out, known = [], self.known
        for i, c in enumerate(found):
            if c in known and i:
                chunk = known[c]
            else:
                chunk = self._chunk(c, not i)
                if i and len(c) <= SHORT:
                    if len(known) >= KEEP:
                        known.clear()
                    known[c] = chunk
            if chunk is not None:
                out.append(chunk)
        out.append(EXIT)
        return out


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    begin, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(at)).fill_null(0).to_pylist()):
        if i > begin and (i - begin == ROWS or size + n > LIMIT):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def ahead(df: DataFrame, text_col: str, kind: T.ArrayType, lane: Lane, gather: Callable[[], tuple[Callable[[list[Chunk]], int], Callable[[], pa.Array]]]) -> DataFrame:
    """``df`` with a column ``found`` of what the lane finds; then the text is null, else ``found`` is. A null text has nothing.

    ``gather()`` gives a function that takes the chunks of a text and returns how many items they have, and one
    that gives the items of all texts so far. ``text_col`` must be binary; it is so in the result.
    """
    at = df.columns.index(text_col)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], T.StructField("found", kind)])

    def run(batches):
        for batch in batches:
            for part in _slices(batch, at):
                # equal texts once
                coded = part.column(at).dictionary_encode()
                take, items = gather()
                offsets, unsure, total = [0], [], 0
                for raw in coded.dictionary.to_pylist():
                    try:
                        total += take(lane.chunks(raw.decode()))
                        unsure.append(False)
                    except (Unsure, UnicodeDecodeError):
                        unsure.append(True)
                    offsets.append(total)
                values = items()
                unsure = pa.array(unsure, pa.bool_())
                each = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=unsure) if len(unsure) else pa.array([], pa.list_(values.type))
                found = each.take(coded.indices)
                left = coded.dictionary.take(pc.if_else(unsure.take(coded.indices), coded.indices, pa.scalar(None, coded.indices.type)))
                columns = [*part.columns, found]
                columns[at] = left
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "found"])

    return df.mapInArrow(run, schema)


def _tokens():
    """Gathers all tokens, for :func:`ahead`."""
    out: list[tuple] = []

    def take(chunks: list[Chunk]) -> int:
        begin = len(out)
        for head, first, family, attrs, last, _, more in chunks:
            out.append((head, first, None, None, None))
            for word in more:
                out.append((head, word, None, None, None))
            if attrs:
                names, values = family + "Name", family + "Value"
                for i, (n, v) in enumerate(attrs):
                    out.append((names, n, first, n, i))
                    out.append((values, v, first, n, i))
            if last:
                out.append((last, "", None, None, None))
        return len(out) - begin

    def items() -> pa.Array:
        kind, value, tag, name, place = zip(*out, strict=True) if out else [()] * 5
        text = [pa.array(x, pa.string()) for x in (kind, value, tag, name)]
        return pa.StructArray.from_arrays([*text[:2], pa.nulls(len(kind), pa.string()), *text[2:], pa.array(place, pa.int32())], names=["type", "value", "error", "tag", "name", "ord"])

    return take, items


def with_tokens(df: DataFrame, text_col: str, **options) -> tuple[DataFrame, Column]:
    """``df``, whose text is not as it was, and the array of all tokens of each row's text; options as for :func:`tagloom.operators.lexer.tokens`."""
    every = F.flatten(chunks_of(text_col, options))
    if options.get("html"):  # such texts have no quick lane
        return df, every
    lane = Lane(**{k: v for k, v in options.items() if k != "html"})
    rows = ahead(df.withColumn(text_col, F.col(text_col).cast("binary")), text_col, T.ArrayType(T._parse_datatype_string(TOKEN)), lane, _tokens)
    return rows.withColumn(text_col, F.col(text_col).cast("string")), F.when(F.col(text_col).isNull(), F.col("found")).otherwise(every)
