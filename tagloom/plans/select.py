"""Plans of path expressions over the relations of structured tokens.

A step is an equi-join on ``doc_id`` (and parent or owner), with the region condition as residual; the first
step from the root is a filter. Results are a bag: nested matches repeat. Each expression adds its ``type_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.operators.structure import Relations
from tagloom.plans.pathexpr import Path, Step, parse

OUT = ("doc_id", "seq", "type_id", "token_type", "value")


def _named(names: tuple[str, ...] | None, column: str = "name") -> Column:
    return F.lit(True) if names is None else F.col(column).isin(*names)


def _join(ctx: DataFrame | None, step: Step, right: DataFrame, own: str, point: str, self_too: bool) -> DataFrame:
    """Rows of ``right`` below the context: by the column ``own`` for a plain step, by region for a deep one."""
    if ctx is None:
        return right.withColumns({"c_ord": F.lit(-1), "act": F.array().cast("array<int>")})
    right = right.withColumnRenamed("doc_id", "r_doc")
    on = ctx["doc_id"] == right["r_doc"]
    if step.deep:
        low = right[point] >= ctx["c_eid"] if self_too else right[point] > ctx["c_eid"]
        on = on & low & (right[point] < ctx["c_end"])
    else:
        on = on & (right[own] == ctx["c_eid"])
    return ctx.join(right, on).drop("r_doc")


def _narrow(rel: Relations, path: Path) -> DataFrame | None:
    """Paths that single tokens answer (``//n``, ``//@n``, ``//n@m``): filters of the token table, no shuffle."""
    kinds = [s.kind for s in path.steps]
    ranged = path.low or path.high is not None
    if rel.opens is None or not path.steps or not path.steps[0].deep or any(s.deep for s in path.steps[1:]):
        return None
    if kinds == ["tag"]:
        rows = rel.opens.where(_named(path.steps[0].names, "value"))
    elif kinds[-1] in ("attr", "has") and kinds in (["attr"], ["has"], ["tag", "attr"], ["tag", "has"]) and not (ranged and kinds[-1] == "attr"):
        rows = rel.attributes.where(_named(path.steps[-1].names))
        if len(kinds) == 2:
            rows = rows.where(_named(path.steps[0].names, "tag"))
        if path.steps[-1].value is not None:
            rows = rows.where(F.col("value") == path.steps[-1].value)
    else:
        return None
    return rows.select("doc_id", "seq", F.col("type").alias("token_type"), "value")


def plan(rel: Relations, path: Path) -> DataFrame:
    """``doc_id, seq, token_type, value`` of one expression."""
    narrow = _narrow(rel, path)
    if narrow is not None:
        return narrow
    ctx: DataFrame | None = None
    for step in path.steps:
        if step.kind == "tag":
            right = (rel.spans if ctx is None or step.deep else rel.elements).where(_named(step.names))
            if ctx is None and not step.deep:
                right = right.where("level = 1")
            j = _join(ctx, step, right, "parent_eid", "eid", False)
            kind = F.when(F.col("name") == "?xml", F.lit("HeaderStart")).otherwise(F.lit("OpenTag"))
            j = j.withColumns({"k": kind, "act": F.array_append("act", F.col("eid"))})
            ends = ("end_seq", "end_type", "end_value")
            ctx = j.select("doc_id", F.col("eid").alias("c_seq"), F.col("k").alias("c_type"), F.col("name").alias("c_value"), F.col("eid").alias("c_eid"),
                           F.col("region_end").alias("c_end"), F.lit(-1).alias("c_ord"), "act", *[F.col(c).alias(f"c_{c}") for c in ends])
        elif step.kind in ("has", "attr"):
            right = rel.attributes.where(_named(step.names)).withColumnRenamed("eid", "a_eid")
            if step.value is not None:
                right = right.where(F.col("value") == step.value)
            if ctx is None and not step.deep:
                right = right.where(F.lit(False))
            j = _join(ctx, step, right, "a_eid", "a_eid", True)
            if ctx is not None and not step.deep:
                j = j.where(F.col("ord") > F.col("c_ord"))
            act = F.array_append("act", F.col("seq")) if step.kind == "has" else F.col("act")
            j = j.withColumn("act", act)
            if ctx is None or step.deep:  # the region of the element that has the attribute
                e = rel.spans.select(F.col("doc_id").alias("e_doc"), F.col("eid").alias("e_eid"), "region_end", "end_seq", "end_type", "end_value")
                j = j.drop("end_seq", "end_type", "end_value").join(e, (j["doc_id"] == e["e_doc"]) & (j["a_eid"] == e["e_eid"]))
            else:
                j = j.withColumns({"region_end": F.col("c_end"), "end_seq": F.col("c_end_seq"), "end_type": F.col("c_end_type"), "end_value": F.col("c_end_value")})
            ctx = j.select("doc_id", F.col("seq").alias("c_seq"), F.col("type").alias("c_type"), F.col("value").alias("c_value"), F.col("a_eid").alias("c_eid"),
                           F.col("region_end").alias("c_end"), F.col("ord").alias("c_ord"), "act", F.col("end_seq").alias("c_end_seq"),
                           F.col("end_type").alias("c_end_type"), F.col("end_value").alias("c_end_value"))
        elif step.kind == "content":
            right = rel.texts.withColumnRenamed("level", "x_level")
            if ctx is None and not step.deep:
                right = right.where("owner_eid is null")
            j = _join(ctx, step, right, "owner_eid", "seq", True)
            ctx = j.select("doc_id", F.col("seq").alias("c_seq"), F.lit("Content").alias("c_type"), F.col("value").alias("c_value"), "act")
        else:
            if ctx is None:
                ctx = rel.spans.where(F.lit(False)).select("doc_id", F.col("eid").alias("c_seq"), F.col("name").alias("c_type"), F.col("name").alias("c_value"), F.array("eid").alias("act"))
            else:
                ctx = ctx.where("c_end_seq is not null").select("doc_id", F.col("c_end_seq").alias("c_seq"), F.col("c_end_type").alias("c_type"), F.col("c_end_value").alias("c_value"), "act")
    if ctx is None:
        return rel.first.select("doc_id", "seq", F.col("type").alias("token_type"), "value")
    if path.steps[-1].kind in ("content", "attr") and (path.low or path.high is not None):
        w = Window.partitionBy("doc_id", "act").orderBy("c_seq")
        ctx = ctx.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") >= path.low)
        if path.high is not None:
            ctx = ctx.where(F.col("_n") <= path.high)
    return ctx.select("doc_id", F.col("c_seq").alias("seq"), F.col("c_type").alias("token_type"), F.col("c_value").alias("value"))


def select(rel: Relations, expressions: dict[int, str | Path]) -> DataFrame:
    """``doc_id, seq, type_id, token_type, value`` of all expressions together."""
    out = None
    for type_id, e in expressions.items():
        one = plan(rel, parse(e) if isinstance(e, str) else e).withColumn("type_id", F.lit(type_id)).select(*OUT)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no expression")
    return out
