"""Documents in chunks: the same tokens and matches as the whole texts, early, and whatever the order of arrival."""

import random

import pytest

from tagloom.operators.lexer import tokens
from tagloom.plans.automaton import select_paths
from tagloom.streaming import documents
from tagloom.streaming.documents import Cutter, scan_chunks, select_chunks

TEXTS = {
    "plain": "<?xml version='1.0'?>\n<shop>\n <item id='7' kind=\"a>b\">pen &amp; ink</item><!-- no --> <item/>tail</shop>\nafter",
    "decl": "<!DOCTYPE html>  <p>one<br>two<!-- x -->\n three</p>", "cdata": "<a>x<![CDATA[ <b> ]]>y<?pi z?> w</a>", "error": "<a><b c></b></a>", "entity": "<a>&nope;</a><b/>",
    "open": "<a><b>never closed", "late": "<a>1</a", "leading": "text<a/>", "empty": "", "blank": " \n\t ", "nul": "<a>1</a>\0<b>", "extra": "<a></a></b></c><d>e</d>",
}
PATHS = {1: "//item()", 2: "//item@id", 3: "/shop/item", 4: "//b()", 5: "//p//()", 6: "//a~", 7: "/d()"}


def _chunks(seed, size):
    rng, rows = random.Random(seed), []
    for name, text in TEXTS.items():
        cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(len(text) // size))})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [""]
        rows += [(name, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id string, chunk int, data string, is_last boolean"


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "size"), [(1, 1), (2, 5), (3, 20)])
def test_chunks_give_what_whole_texts_give(spark, seed, size):
    whole = spark.createDataFrame(list(TEXTS.items()), "id string, t string")
    chunks = spark.createDataFrame(_chunks(seed, size), SCHEMA)
    assert _sorted(scan_chunks(chunks)) == _sorted(tokens(whole, "id", "t"))
    assert _sorted(select_chunks(chunks, PATHS)) == _sorted(select_paths(whole, "id", "t", PATHS))


def test_tokens_come_before_the_end_and_little_is_kept():
    cutter, given = Cutter(), []
    for i in range(2000):
        given += cutter.feed(i, ("<list>" if i == 0 else "") + f"<row n='{i}'>value</row>", False)
        assert len(cutter.state) < 400 and Cutter(cutter.state).state == cutter.state
    assert len(given) == 2000 and not any(last for *_, last in given)
    assert list(cutter.feed(5, "again", False)) == [] and [f[3] for f in cutter.feed(2000, "</list>", True)] == [True]


def test_stream(spark, tmp_path):
    rows = _chunks(4, 6)
    for i in range(2):
        spark.createDataFrame(rows[i::2], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = scan_chunks(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    ended = query.awaitTermination(240)
    query.stop()
    assert ended
    whole = spark.createDataFrame(list(TEXTS.items()), "id string, t string")
    assert _sorted(spark.read.parquet(str(tmp_path / "out"))) == _sorted(tokens(whole, "id", "t"))


def test_an_unfinished_document_ends_at_its_timeout():
    cutter = Cutter()
    assert list(cutter.feed(0, "<a>1<b", False)) == [("<a>1", 0, 0, False)]
    assert list(cutter.finish()) == [("</_><a><b", 2, 2, True)] and list(cutter.finish()) == []
    assert documents.Cutter(cutter.state).over
