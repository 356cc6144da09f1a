"""Python workers ahead of the expressions: what they take on is as the expressions have it, and texts of complete constructs are all taken on."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tagloom.operators.ahead import Lane, ahead, with_tokens
from tagloom.operators.lexer import chunks_of
from tagloom.plans.automaton import OUT, Fold, _let, walk
from tagloom.plans.pathexpr import ROOT, parse

PIECES = ("<a>", "</a>", "<b x='1' y=\"2\">", "<b x = 'p > q'/>", "<b y=z\t>", "<c/>", "</b>", "</c >", "text", " \n ", "&amp;", "&#65;", "&#x1f600;", "&copy;", "&nope;", "& ", "\r\n", "<!-- - -> -->", "<![CDATA[ <x> ]]>", "<?pi?>",
          "<!DOCTYPE a \"b c\" 'd'>", "<a x>", "<a", "\0", "ä\U0001f600", "<a x='&lt;&#xFEFF;'>", "<x y='a b=\"c\"'>", "\x85", "</>", "<!x>")
HEADS = ("", "", "<?xml version='1.0'?>", "<?xml version=\"1.0\" encoding='x'  ?>\n", " \t<a>", "<?xml a=b?>", "<?xml?>", "<?xsl?>", "<!DOCTYPE html>", "\ufeff")
PATHS = [*map(parse, ("//a", "/a/b", "//b@x", "//b[@x='1']()", "/a()", "//()", "//@*", "//a~", "//b~", "//a//b()")), ROOT, ROOT.descendants().tag("b").having("y").attribute("x"),
         ROOT.tag("a").tag("b").having("x").descendants().attribute("y"), ROOT.descendants().having("x", "1").close(), ROOT.descendants().having(None).descendants().content(), ROOT.tag("?xml").attribute("version"), ROOT.tag("?xml").close()]


def _texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(HEADS) + rng.choice(("<a>", "")) + "".join(rng.choice(PIECES[: 14 if i % 2 else None]) for _ in range(rng.randrange(9)))) for i in range(n)]


def test_paths_ahead_are_those_of_the_expressions(spark):
    paths, options = PATHS, {"entities": {"copy": "©"}}
    rows = spark.createDataFrame(_texts(3000), "id long, t string").repartition(4).withColumn("text", F.col("t").cast("binary"))
    got = ahead(rows, "text", _parse_datatype_string(f"array<{OUT}>"), Lane(**options), walk(paths, True))
    both = got.where("text is null").select("t", "found", _let(chunks_of("t", options), Fold(paths).matches).alias("want")).collect()
    assert 800 < len(both) < 3000
    for r in both:
        assert r["found"] == r["want"], r["t"]
    assert sum(map(len, (r["want"] for r in both))) > 3000


@pytest.mark.parametrize("options", [{"entities": {"copy": "©"}}, {"cdata": True, "strip_bom": True}, {"values": ("Content",)}])
def test_tokens_ahead_are_those_of_the_expressions(spark, options):
    rows = spark.createDataFrame(_texts(1500, 2), "id long, t string").repartition(4).withColumn("text", F.col("t"))
    got = with_tokens(rows, "text", **options)[0]
    both = got.where("text is null").select("t", "found", F.flatten(chunks_of("t", options)).alias("want")).collect()
    assert 400 < len(both) < 1500
    for r in both:
        assert r["found"] == r["want"], r["t"]


def test_complete_texts_are_taken_on_and_others_handed_on(spark):
    good = ["<?xml version=\"1.0\" encoding=\"UTF-8\"?>\n<item flag=\"A\">17</item>", "<a>1 &lt; 2</a>", "<!DOCTYPE html><p>x<br>y", "<a/>"]
    bad = ["x<a/>", "<a>&nope;</a>", "<a b>", "<a>1</a", ""]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad, *good]], "t string").coalesce(1).withColumn("text", F.col("t").cast("binary")).union(spark.sql("select null, null union all select null, x'3c613eff'"))
    got = ahead(rows, "text", _parse_datatype_string(f"array<{OUT}>"), Lane(), walk([parse("//a")], False)).collect()
    assert {r["t"] for r in got if r["found"] is not None} == set(good)
    assert sorted(bytes(r["text"]) for r in got if r["text"] is not None) == sorted([*(t.encode() for t in bad), b"<a>\xff"])
    assert sum(r["text"] is None and r["found"] is None for r in got) == 1 and len(got) == 2 * len(good) + len(bad) + 2


@pytest.mark.parametrize("query", ["rt_lineitem_xml", "rt_orders_xml", "select_many"])
def test_selections_go_ahead_of_the_expressions(spark, query):
    from oracles import SF
    from tagloom.queries import QUERIES

    assert "MapInArrow" in QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["chunked_scan", "chunked_select"])
def test_chunks_of_a_table_are_cut_in_order_and_not_gathered(spark, query):
    """A document's chunks pass the cutter one by one, they are no group in memory; the lexer of fragments goes ahead of the expressions."""
    from oracles import SF
    from tagloom.queries import QUERIES

    plan = QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 2
