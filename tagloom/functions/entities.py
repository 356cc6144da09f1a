"""Character entities, line ends, and escapes for printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``nbsp`` is a plain space in this engine.
PREDEFINED = {"quot": '"', "amp": "&", "apos": "'", "lt": "<", "gt": ">", "nbsp": " "}
_PIECES = r"&#[0-9]{1,16};|&#x[0-9A-Fa-f]{1,16};|&[A-Za-z_][^;\s&<#]{0,14};|[^&]+|&"


def _code_point(value: Column, literal: Column) -> Column:
    """The character of a code point; what is no character stays as written."""
    ok = value.between(1, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")).otherwise(literal)


def decode_entities(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Entities replaced by characters; null if an entity has an unknown name.

    Decimal and hexadecimal (lower-case x) references, the predefined names, then ``entities``. An ampersand
    that starts no entity is copied.
    """
    names = PREDEFINED | {k: v for k, v in (entities or {}).items() if k not in PREDEFINED}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#([0-9]+);$", 1)
        hexes = F.regexp_extract(p, "^&#x([0-9A-Fa-f]+);$", 1)
        name = F.substring(p, F.lit(2), F.char_length(p) - 2)
        return (F.when(~p.startswith("&") | (p == "&"), p)
                .when(digits != "", _code_point(F.expr("1") * digits.cast("long"), p))
                .when(hexes != "", _code_point(F.conv(F.when(F.char_length(F.ltrim(hexes, F.lit("0"))) <= 8, hexes).otherwise(F.lit("0")), 16, 10).cast("long"), p))
                .otherwise(F.try_element_at(table, name)))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), piece)
    # an array of one, so that the pieces are found once
    joined = F.element_at(F.transform(F.array(pieces), lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, ""))), 1)
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def normalise_eol(text: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def _replace_all(text: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_CONTENT = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\0": "&#0;", "\b": "&#8;"}
_VALUE = _CONTENT | {"'": "&apos;", '"': "&quot;", "\t": "&#9;", "\n": "&#10;", "\r": "&#13;"}


def escape_content(text: Column) -> Column:
    return _replace_all(text, _CONTENT)


def escape_attribute(text: Column) -> Column:
    """Escaped and quoted."""
    return F.concat(F.lit('"'), _replace_all(text, _VALUE), F.lit('"'))
