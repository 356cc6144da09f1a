"""Printing: tokens or rows back to markup text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.functions.entities import escape_attribute, escape_content
from tagloom.operators.structure import levels


def header(encoding: str = "UTF-8", standalone: str | None = None) -> str:
    tail = f' standalone="{standalone}"' if standalone else ""
    return f'<?xml version="1.0" encoding="{encoding}"{tail}?>\n'


def doctype(root: str | None, public: str | None = None, system: str | None = None) -> str:
    """Nothing without a root; a public name needs a system name."""
    if root is None:
        return ""
    if public is not None and system is None:
        raise ValueError("a public name needs a system name")
    names = f' PUBLIC "{public}" "{system}"' if public is not None else f' SYSTEM "{system}"' if system is not None else ""
    return f"<!DOCTYPE {root}{names}>\n"


def element(name: str, *content: Column, attributes: dict[str, Column] | None = None) -> Column:
    """One element as text; null attributes are left out, no content closes the tag at once. Content is markup."""
    head = F.concat(F.lit(f"<{name}"), *[F.coalesce(F.concat(F.lit(f" {k}="), escape_attribute(v)), F.lit("")) for k, v in (attributes or {}).items()])
    if not content:
        return F.concat(head, F.lit("/>"))
    return F.concat(head, F.lit(">"), *[F.coalesce(c, F.lit("")) for c in content], F.lit(f"</{name}>"))


def text(value: Column) -> Column:
    return escape_content(value)


def document(df: DataFrame, keys: list[str], root: str, row: Column, order: list[str], encoding: str = "UTF-8") -> DataFrame:
    """One document for each key: the rows' elements, in order, below ``root``."""
    parts = F.array_sort(F.collect_list(F.struct(*order, row.alias("_x"))))
    body = F.array_join(F.transform(parts, lambda p: p["_x"]), "")
    return df.groupBy(*keys).agg(F.concat(F.lit(header(encoding) + f"<{root}>"), body, F.lit(f"</{root}>\n")).alias("xml"))


def checked(tokens: DataFrame, sub_document: bool = False) -> DataFrame:
    """Adds ``state`` (Init, Content, TagElement or TagAttribute after the token) and ``print_error``: why a token may not be printed where it stands.

    A document begins with its header; with ``sub_document`` it is a part of one and needs none. Null means no error.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    kind = F.col("type")
    after = (F.when(kind == "OpenTag", "TagElement").when(kind == "TagAttribName", "TagAttribute").when(kind == "TagAttribValue", "TagElement")
             .when(kind.isin("HeaderEnd", "Content", "CloseTag", "CloseTagIm"), "Content"))
    begin = F.lit("Content" if sub_document else "Init")
    t = levels(tokens).withColumn("state", F.coalesce(F.last(after, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), begin))
    before = F.coalesce(F.lag("state").over(order), begin)
    error = (F.when((kind == "HeaderStart") & ((F.col("seq") > 0) | F.lit(sub_document)), "printing xml header not at the beginning of the document")
             .when(kind.isin("OpenTag", "Content") & (before == "Init"), "printed xml without root element")
             .when((kind == "TagAttribName") & (before != "TagElement"), "attribute outside of an open tag")
             .when((kind == "TagAttribValue") & (before != "TagAttribute"), "attribute value without a name")
             .when(kind.isin("CloseTag", "CloseTagIm") & F.col("floor"), "close tag without an open one"))
    return t.withColumn("print_error", error).drop("level", "floor")


def print_tokens(tokens: DataFrame) -> DataFrame:
    """``doc_id, xml``: a token table printed. A tag that is still open gets ``>`` before what follows it."""
    t = levels(tokens)
    order = Window.partitionBy("doc_id").orderBy("seq")
    kind, before = F.col("type"), F.lag("type").over(order)
    pending = before.isin("OpenTag", "TagAttribValue")
    shut = F.when(pending & ~kind.isin("TagAttribName", "TagAttribValue", "CloseTagIm", "CloseTag"), F.lit(">")).otherwise(F.lit(""))
    end = F.when((F.col("level") == 0) & ~F.col("floor"), F.lit("\n")).otherwise(F.lit(""))
    piece = (F.when(kind == "HeaderStart", F.lit("<?xml"))
             .when(kind.isin("HeaderAttribName", "TagAttribName"), F.concat(F.lit(" "), F.col("value"), F.lit("=")))
             .when(kind.isin("HeaderAttribValue", "TagAttribValue"), escape_attribute(F.col("value")))
             .when(kind == "HeaderEnd", F.lit("?>\n"))
             .when((kind == "DocAttribValue") & (before.isNull() | (before != "DocAttribValue")), F.concat(F.lit("<!"), F.col("value")))
             .when(kind == "DocAttribValue", F.concat(F.lit(" "), F.when(F.rlike("value", F.lit("^[A-Za-z0-9_.:-]+$")), F.col("value")).otherwise(F.concat(F.lit('"'), F.col("value"), F.lit('"')))))
             .when(kind == "DocAttribEnd", F.lit(">\n"))
             .when(kind == "OpenTag", F.concat(F.lit("<"), F.col("value")))
             .when((kind == "CloseTagIm") | (kind == "CloseTag") & pending, F.concat(F.lit("/>"), end))
             .when(kind == "CloseTag", F.concat(F.lit("</"), F.col("value"), F.lit(">"), end))
             .when(kind == "Content", escape_content(F.col("value"))).otherwise(F.lit("")))
    pieces = t.select("doc_id", "seq", F.concat(shut, piece).alias("piece"))
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "").alias("xml"))
