"""Charsets: decoding and printing as native expressions, and the encoding that a header declares.

Latin pages 1 to 9 are ISO-8859-1, 2, 3, 4, 9, 10, 13, 14 and 15. Characters that a charset lacks are printed as
``&#x...;`` in lower case.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = {1: 1, 2: 2, 3: 3, 4: 4, 5: 9, 6: 10, 7: 13, 8: 14, 9: 15}
UNKNOWN = "\ufffd"


def _high(page: int) -> str:
    """What the bytes 80 to FF stand for."""
    if page not in LATIN:
        raise ValueError(f"no such Latin page: {page}")
    return bytes(range(128, 256)).decode(f"iso8859-{LATIN[page]}", "replace")


_HIGH1 = bytes(range(128, 256)).decode("latin-1")


def decode_latin(data: Column, page: int = 1) -> Column:
    text = F.decode(data, "ISO-8859-1")
    return text if page == 1 else F.translate(text, _HIGH1, _high(page))


def _reference(c: Column, point: Column) -> Column:
    return F.concat(F.lit("&#x"), F.lower(F.hex(point)), F.lit(";"))


def code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")


def limit(text: Column, allowed: str | None = None, most: int | None = None) -> Column:
    """The text with characters outside of ``allowed`` (beyond ASCII) or above ``most`` as references."""
    def one(c: Column) -> Column:
        fine = (F.contains(F.lit(allowed), c) | (F.octet_length(c) == 1)) if allowed is not None else code_point(c) <= most
        return F.when(fine, c).otherwise(_reference(c, code_point(c)))

    # not $, which also stands before a last line end, and U+0085, U+2028 and U+2029 are line ends
    clean = F.rlike(text, F.lit(r"^[\x00-\x7F]*\z"))
    return F.when(clean, text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def encode_latin(text: Column, page: int = 1) -> Column:
    high = _high(page)
    pairs = [(a, b) for a, b in zip(high, _HIGH1, strict=True) if a != UNKNOWN]
    safe = limit(text, "".join(a for a, _ in pairs))
    if page != 1:
        safe = F.translate(safe, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.encode(safe, "ISO-8859-1")


def _swap(data: Column, unit: int) -> Column:
    """Each unit of bytes reversed."""
    pairs = "(..)" * unit
    back = "".join(f"${i}" for i in range(unit, 0, -1))
    return F.unhex(F.regexp_replace(F.hex(data), pairs, back))


def _units(data: Column, unit: int, big: bool) -> Column:
    """The hexadecimal numbers of the whole units of ``data``, most significant digit first; a rest is dropped."""
    digits = F.hex(data if big else _swap(data, unit))
    return F.regexp_extract_all(digits, F.lit(f"[0-9A-F]{{{2 * unit}}}"), F.lit(0))


def _scalar(code: Column) -> Column:
    """The character of eight hexadecimal digits, or U+FFFD for what is none."""
    value = F.conv(code, 16, 10).cast("long")
    fine = value.between(0, 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(code), "UTF-32")).otherwise(F.lit(UNKNOWN))


def _repaired(data: Column, unit: int, big: bool, pairs: bool) -> Column:
    """Text of wide units one by one; lone surrogates, numbers beyond Unicode and an incomplete last unit give U+FFFD each."""
    units = _units(data, unit, big)
    rest = F.when(F.octet_length(data) % unit != 0, F.lit(UNKNOWN)).otherwise(F.lit(""))
    if not pairs:
        return F.concat(F.array_join(F.transform(units, lambda u: _scalar(F.lpad(u, 8, "0"))), ""), rest)
    # surrogate pairs are one match, all else is a unit
    joined = F.regexp_extract_all(F.array_join(units, " "), F.lit(r"D[89AB]..\x20D[C-F]..|[0-9A-F]{4}"), F.lit(0))

    def one(u: Column) -> Column:
        high, low = (F.conv(F.substring(u, at, 4), 16, 10).cast("long") for at in (1, 6))
        code = F.lpad(F.hex(0x10000 + (high - 0xD800) * 0x400 + low - 0xDC00), 8, "0")
        return F.when(F.octet_length(u) == 9, F.decode(F.unhex(code), "UTF-32")).otherwise(_scalar(F.lpad(u, 8, "0")))

    return F.concat(F.array_join(F.transform(joined, one), ""), rest)


_custom: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {}


def register_charset(name: str, decoder: Callable[[Column], Column], encoder: Callable[[Column], Column]) -> None:
    """Adds a charset of the user: two functions of columns, of built-in expressions or of pandas UDFs."""
    _custom[name.upper()] = (decoder, encoder)


def decode(data: Column, charset: str) -> Column:
    """Text of a binary column in ``UTF-8``, ``UTF-16BE/LE``, ``UCS-2BE/LE``, ``UCS-4BE/LE``, ``IsoLatin-N`` or a registered charset.

    What is malformed becomes U+FFFD and never stops a job. UCS-2 has no surrogates: each is malformed by itself.
    """
    name = charset.upper().replace("_", "-")
    if name in _custom:
        return _custom[name][0](data)
    if name in ("UTF-8", "UTF8"):
        return F.make_valid_utf8(data.cast("string"))
    big = name.endswith("BE")
    if name in ("UTF-16BE", "UTF-16LE", "UCS-2BE", "UCS-2LE"):
        surrogates = "|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2}" if name.startswith("UTF") else ""
        plain = F.rlike(F.hex(data if big else _swap(data, 2)), F.lit(f"^(?:(?!D[89A-F])[0-9A-F]{{4}}{surrogates})*+$"))
        # where all is well formed, the built-in decoder cannot fail
        return F.when(plain, F.decode(data, "UTF-16" + name[-2:])).otherwise(_repaired(data, 2, big, name.startswith("UTF")))
    if name in ("UCS-4BE", "UCS-4LE", "UTF-32BE", "UTF-32LE"):
        wide = F.hex(data if big else _swap(data, 4))
        plain = F.rlike(wide, F.lit("^(?:0000(?!D[89A-F])[0-9A-F]{4}|000[1-9A-F][0-9A-F]{4}|0010[0-9A-F]{4})*+$"))
        return F.when(plain, F.decode(F.unhex(wide), "UTF-32")).otherwise(_repaired(data, 4, big, False))
    if name.startswith("ISOLATIN-"):
        return decode_latin(data, int(name[9:]))
    raise ValueError(f"no such charset: {charset}")


def encode(text: Column, charset: str) -> Column:
    """Bytes of a text; what the charset lacks is printed as a reference."""
    name = charset.upper().replace("_", "-")
    if name in _custom:
        return _custom[name][1](text)
    if name in ("UTF-8", "UTF8"):
        return text.cast("binary")
    if name in ("UTF-16BE", "UTF-16LE"):
        return F.encode(text, name)
    if name in ("UCS-2BE", "UCS-2LE"):
        return F.encode(limit(text, most=0xFFFF), "UTF-16" + name[-2:])
    if name in ("UCS-4BE", "UCS-4LE", "UTF-32BE", "UTF-32LE"):
        big = F.encode(text, "UTF-32")
        return big if name.endswith("BE") else _swap(big, 4)
    if name.startswith("ISOLATIN-"):
        return encode_latin(text, int(name[9:]))
    raise ValueError(f"no such charset: {charset}")


def sniff_encoding(data: Column) -> Column:
    """``struct(encoding, error)`` of the header of a binary column; NUL bytes are passed over, so wide charsets work.

    Four NULs in a row are an error, attributes other than version, encoding and standalone too; values must be
    quoted. A text that begins with a tag has no encoding and no error.
    """
    # up to the end of the first tag, wherever that is
    raw = F.substring_index(F.decode(data, "ISO-8859-1"), ">", 1)
    text = F.concat(F.regexp_replace(F.replace(raw, F.lit("\0"), F.lit("")), r"^[\x01-\x20]+", ""), F.when(F.contains(F.decode(data, "ISO-8859-1"), F.lit(">")), F.lit(">")).otherwise(F.lit("")))
    attr = r"""(?:[\x01-\x20]+(?:version|encoding|standalone)[\x01-\x20]*=[\x01-\x20]*(?:"[^"]*"|'[^']*'))"""
    good = F.rlike(text, F.lit(rf"^<\?xml{attr}*[\x01-\x20]*\?>"))
    found = F.regexp_extract(text, r"""^<\?xml[^>]*?[\x01-\x20]encoding[\x01-\x20]*=[\x01-\x20]*["']([^"']*)["']""", 1)
    unknown = F.regexp_extract(text, rf"^<\?xml{attr}*[\x01-\x20]+([^\x01-\x20=?>]+)", 1)
    error = (F.when(F.contains(raw, F.lit("\0\0\0\0")), F.lit("illegal xml header"))
             .when(good | F.rlike(text, F.lit(r"^<[\x01-\x20]*[^?!\x01-\x20]")), F.lit(None).cast("string"))
             .when((unknown != "") & ~unknown.isin("version", "encoding", "standalone"), F.lit("unknown xml header attribute name"))
             .otherwise(F.lit("illegal xml header")))
    return F.struct(F.when(good & (found != ""), found).alias("encoding"), error.alias("error"))


#: Classes of characters that the scanner tells apart, in the order in which they are asked for: a fixed value.
CLASSES = (("EndOfText", r"^\x00$"), ("Undef", r"^\x05$"), ("EndOfLine", r"^\n$"), ("Space", r"^[\t\r ]$"), ("Cntrl", r"^[\x01-\x1F]$"), ("Amp", "^&$"), ("Lt", "^<$"), ("Equal", "^=$"),
           ("Gt", "^>$"), ("Slash", "^/$"), ("Dash", "^-$"), ("Exclam", "^!$"), ("Questm", r"^\?$"), ("Sq", "^'$"), ("Dq", '^"$'), ("Osb", r"^\[$"), ("Csb", "^]$"), ("Any", r"^[\x21-\x7F]$"))


def characters(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, pos, chr, code_point, ascii, control``: a row for each character up to the first NUL; ``ascii`` is 0 beyond 127."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.substring_index(text_col, "\0", 1), "")).alias("pos", "chr")).where("chr != ''")
    point = code_point(F.col("chr"))
    control = F.lit("Undef")
    for name, pattern in reversed(CLASSES):
        control = F.when(F.rlike("chr", F.lit(pattern)), F.lit(name)).otherwise(control)
    return rows.select("doc_id", "pos", "chr", point.alias("code_point"), F.when(point <= 127, point).otherwise(F.lit(0)).alias("ascii"), control.alias("control"))


def python_name(page: int) -> str:
    """Python's codec of a Latin page."""
    return codecs.lookup(f"iso8859-{LATIN[page]}").name
