import pytest

from tagloom.functions import charset


@pytest.mark.parametrize("name", [f"IsoLatin-{i}" for i in range(1, 10)] + ["UCS-2BE", "UCS-2LE"])
def test_texts_that_end_in_a_line_separator(spark, name):
    texts = [end for c in ("\u0085", "\u2028", "\u2029", "\n", "\r\n") for end in (c, f"a{c}", f"{c}a")] + ["\U0001F600\u2028"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    back = {r.id: r.back for r in rows.select("id", charset.decode(charset.encode(rows.text, name), name).alias("back")).collect()}
    lacks = (lambda c: ord(c) > 0xFFFF) if name.startswith("UCS") else (lambda c: ord(c) > 0xA0)
    assert back == {i: "".join(f"&#x{ord(c):x};" if lacks(c) else c for c in t) for i, t in enumerate(texts)}
