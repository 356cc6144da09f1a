"""Where printed markup goes: text files, and buffers of a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.charset import encode


def write_text(df: DataFrame, text_col: str, path: str, mode: str = "error") -> None:
    """Writes a column of texts as files, one line after the other; a document of several lines keeps them."""
    df.select(F.col(text_col).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def fixed_buffer(text: Column, size: int, charset: str = "UTF-8") -> Column:
    """``struct(data, overflow)``: the first ``size`` bytes of a text in a charset, and whether there were more."""
    data = encode(text, charset)
    return F.struct(F.substring(data, 1, size).alias("data"), (F.octet_length(data) > size).alias("overflow"))
