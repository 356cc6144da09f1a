"""Reading markup: files of bytes with their declared encoding, texts of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.charset import LATIN, decode, sniff_encoding

#: Names that headers use, in capitals and without ``-``, ``_`` and ``:``, and the charset that decodes them.
NAMES = {"UTF8": "UTF-8", "USASCII": "UTF-8", "ASCII": "UTF-8", "UTF16BE": "UTF-16BE", "UTF16LE": "UTF-16LE", "UCS2BE": "UCS-2BE", "UCS2LE": "UCS-2LE", "ISO10646UCS2": "UCS-2BE",
         "UTF32BE": "UCS-4BE", "UTF32LE": "UCS-4LE", "UCS4BE": "UCS-4BE", "UCS4LE": "UCS-4LE",
         **{name: f"IsoLatin-{page}" for page, part in LATIN.items() for name in (f"ISO8859{part}", f"LATIN{page}", f"ISOLATIN{page}", f"L{page}")}}
#: Names that leave the order of bytes to the text itself.
WIDE = {"UTF16": ("UTF-16", 2), "UCS2": ("UCS-2", 2), "UTF32": ("UCS-4", 4), "UCS4": ("UCS-4", 4), "ISO10646UCS4": ("UCS-4", 4)}


def _starts_big(data: Column, unit: int) -> Column:
    """A byte order mark says which byte comes first, else the first character of markup, which is ASCII."""
    head = F.hex(F.substring(data, 1, unit))
    big = {2: "FEFF", 4: "0000FEFF"}[unit]
    little = {2: "FFFE", 4: "FFFE0000"}[unit]
    return F.when(head == big, True).when(head == little, False).otherwise(head.startswith("00"))


def decode_declared(df: DataFrame, data_col: str, text_col: str = "text") -> DataFrame:
    """Adds ``encoding`` (as the header names it, in capitals), the text that it gives, and ``encoding_error``.

    Without a header, or with one that names no encoding, the text is UTF-8. A name that is not known, or a header that
    is wrong, is said in ``encoding_error``; the text is then read as UTF-8 too.
    """
    data, found = F.col(data_col), sniff_encoding(F.col(data_col))
    named = df.withColumns({"encoding": F.upper(found["encoding"]), "encoding_error": found["error"]})
    plain = F.regexp_replace("encoding", "[-_: ]", "")
    text, known = F.when(F.lit(False), F.lit("")), plain.isNull() | plain.isin(*NAMES, *WIDE)
    for charset in dict.fromkeys(NAMES.values()):
        text = text.when(plain.isin(*[n for n, c in NAMES.items() if c == charset]), decode(data, charset))
    for name, (charset, unit) in WIDE.items():
        text = text.when((plain == name) & _starts_big(data, unit), decode(data, charset + "BE")).when(plain == name, decode(data, charset + "LE"))
    error = F.coalesce("encoding_error", F.when(~known, F.concat(F.lit("unknown encoding "), F.col("encoding"))))
    return named.withColumns({text_col: text.otherwise(decode(data, "UTF-8")), "encoding_error": error})


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, content, encoding, encoding_error, text`` of whole files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return decode_declared(files, "content")


def read_source(spark: SparkSession, parts: int, read: Callable[[int], Iterable[tuple[str, bytes]]]) -> DataFrame:
    """``path, content`` from a source of the user: ``read(i)`` gives the documents of part i, on the executor that reads it."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(parts)]

        def read(self, partition):
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "markup_source"

        def schema(self):
            return "path string, content binary"

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format("markup_source").load()
