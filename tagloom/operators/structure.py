"""Elements, attributes and texts of a token table, by region encoding.

One exchange on ``doc_id`` serves all windows. Closing tags pop one level whatever their name; at level 0 they
are ignored. Elements that are never closed reach to the end of their document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = (1 << 31) - 1


def levels(tokens: DataFrame) -> DataFrame:
    """Adds ``level``: the depth after the token, and ``floor``: whether it is a closing tag that was ignored."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = F.when(F.col("type") == "OpenTag", 1).when(F.col("type").isin("CloseTag", "CloseTagIm"), -1).otherwise(0)
    t = tokens.withColumn("_d", d).withColumn("_s", F.sum("_d").over(w))
    t = t.withColumn("_m", F.least(F.lit(0), F.min("_s").over(w)))
    before = F.coalesce(F.lag("_m").over(Window.partitionBy("doc_id").orderBy("seq")), F.lit(0))
    return t.withColumn("level", (F.col("_s") - F.col("_m")).cast("int")).withColumn("floor", F.col("_m") < before).drop("_d", "_s", "_m")


@dataclass
class Relations:
    """``elements(doc_id, eid, end_seq, region_end, level, name, end_type, end_value, parent_eid)``, ``spans`` (the
    same without ``parent_eid``, for steps that need none), ``attributes(doc_id, eid, ord, seq, name, value, type)``,
    ``texts(doc_id, seq, owner_eid, level, value)``, ``first(doc_id, seq, type, value)``: the first token of each
    document. From wide tokens, ``attributes`` has ``tag`` and needs no shuffle, nor does
    ``opens(doc_id, seq, type, value)``; from others ``opens`` is None."""

    elements: DataFrame
    spans: DataFrame
    attributes: DataFrame
    texts: DataFrame
    first: DataFrame
    opens: DataFrame | None


def _attributes(tokens: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("seq")
    owner = F.last(F.when(F.col("type").isin("OpenTag", "HeaderStart"), F.col("seq")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    a = tokens.withColumns({"eid": owner, "name": F.lag("value").over(order)}).where(F.col("type").isin("TagAttribValue", "HeaderAttribValue"))
    a = a.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "eid").orderBy("seq")) - 1)
    return a.select("doc_id", "eid", "ord", "seq", "name", "value", "type")


def relations(tokens: DataFrame) -> Relations:
    """Parents and owners are the last open tag of the level in question, found by windows; no join is needed."""
    wide = "tag" in tokens.columns
    t = levels(tokens.select("doc_id", "seq", "type", "value"))
    order = Window.partitionBy("doc_id").orderBy("seq")
    opens, closes = F.col("type") == "OpenTag", F.col("type").isin("CloseTag", "CloseTagIm") & ~F.col("floor")
    tags = t.where(opens | closes).withColumn("at", F.col("level") + F.when(opens, 0).otherwise(1))
    pair = Window.partitionBy("doc_id", "at").orderBy("seq")
    e = tags.withColumns({"end_seq": F.lead("seq").over(pair), "end_type": F.lead("type").over(pair), "end_value": F.lead("value").over(pair)}).where(opens)
    e = e.select("doc_id", F.col("seq").alias("eid"), "end_seq", F.coalesce("end_seq", F.lit(END)).alias("region_end"), "level", F.col("value").alias("name"), "end_type", "end_value")
    head = tokens.where(F.col("type").isin("HeaderStart", "HeaderEnd"))
    head = head.withColumn("end_seq", F.lead("seq").over(order)).where("type = 'HeaderStart'")
    head = head.select("doc_id", F.col("seq").alias("eid"), "end_seq", F.coalesce("end_seq", F.lit(END)).alias("region_end"), F.lit(1).alias("level"), F.col("value").alias("name"),
                       F.lit("HeaderEnd").alias("end_type"), F.lit("").alias("end_value"))
    # each element stands at its own level as a possible parent, and one level up as a child
    roles = e.withColumn("child", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("at", F.col("level") - F.col("child").cast("int"))
    above = Window.partitionBy("doc_id", "at").orderBy("eid").rowsBetween(Window.unboundedPreceding, 0)
    c = roles.withColumn("parent_eid", F.last(F.when(~F.col("child"), F.col("eid")), ignorenulls=True).over(above)).where("child").drop("child", "at")
    elements = c.unionByName(head.withColumn("parent_eid", F.lit(None).cast("int")))
    same = Window.partitionBy("doc_id", "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = t.where(F.col("type").isin("OpenTag", "Content")).withColumn("owner_eid", F.last(F.when(opens, F.col("seq")), ignorenulls=True).over(same)).where("type = 'Content'")
    if wide:
        a = tokens.where(F.col("type").isin("TagAttribValue", "HeaderAttribValue"))
        a = a.select("doc_id", (F.col("seq") - 2 * F.col("ord") - 2).alias("eid"), "ord", "seq", "name", "value", "type", "tag")
    else:
        a = _attributes(tokens)
    plain = tokens.select("doc_id", "seq", "type", "value")
    return Relations(elements, e.unionByName(head), a, x.select("doc_id", "seq", "owner_eid", "level", "value"), plain.where("seq = 0"),
                     plain.where(F.col("type").isin("OpenTag", "HeaderStart")) if wide else None)
