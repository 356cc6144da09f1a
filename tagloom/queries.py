"""Registered queries over the reference's operators, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import charset
from tagloom.functions.entities import escape_attribute, escape_content
from tagloom.operators import printer
from tagloom.operators.lexer import tokens
from tagloom.operators.structure import levels
from tagloom.plans.automaton import select_paths
from tagloom.streaming.documents import scan_chunks, select_chunks

#: The entities that the test pages use beyond the predefined ones.
ENTITIES = {"copy": "\u00a9", "middot": "\u00b7"}


def _pages(spark: SparkSession, d: str, **options) -> DataFrame:
    return tokens(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html", entities=ENTITIES, **options)


def _paths(expressions: dict[int, str], multi: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = select_paths(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html", expressions, entities=ENTITIES).withColumnRenamed("doc_id", "page_id")
        return out.select("page_id", *(["type_id"] if multi else []), "value")
    return run


def scan_tokens_by_kind(spark, d):
    return _pages(spark, d, values=()).groupBy("type").agg(F.count("*").alias("n"))


def scan_doctype_tokens(spark, d):
    return _pages(spark, d, values=("DocAttribValue",)).where(F.col("type") == "DocAttribValue").select(F.col("doc_id").alias("page_id"), "value")


def scan_attributes(spark, d):
    return _pages(spark, d, values=()).where(F.col("type") == "TagAttribName").groupBy(F.col("value").alias("name")).agg(F.count("*").alias("n"))


def content_decoded(spark, d):
    return _pages(spark, d, values=("Content",)).where(F.col("type") == "Content").select(F.col("doc_id").alias("page_id"), "value")


def eol_normalised(spark, d):
    """Line ends in content and attributes, through the lexer: texts with CR LF and lone CR."""
    t = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    doc = F.concat(F.lit("<d a='x\r\ny\rz'>"), F.replace(t, F.lit("\n"), F.lit("\r\n")), F.lit("\r</d>"))
    rows = spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select("doc_id", doc.alias("doc"))
    return tokens(rows, "doc_id", "doc").where(F.col("type").isin("TagAttribValue", "Content")).select("doc_id", "type", "value")


#: Beginnings of markup that is wrong in a way of its own, and the error that it gives; the text after them does not matter.
WRONG = (("x", "expected open tag"), ("<a><!-- ", "unexpected end of text"), ("<a b>", "expected equal"), ("<a b='1'c='2'>", "expected tag attribute"), ("<a b=\"", "string not terminated"),
         ("<a></a b>", "expected tag end"), ("<a>&nope;", "undefined character entity"), ("<a><!-x-->", "expected 2nd dash"), ("<?xsl?>", "expected XML tag"), ("<a><![CDA[", "expected CDATA tag"))


def scan_errors(spark, d):
    """Each kind of error, at the start of a text."""
    starts = F.array(*[F.lit(w) for w, _ in WRONG])
    text = F.concat(F.element_at(starts, (F.col("doc_id") % len(WRONG) + 1).cast("int")), F.lit("<a"))
    t = tokens(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.alias("text")), "doc_id", "text").where(F.col("type") == "ErrorOccurred")
    return t.select("doc_id", "error")


def select_any_attr(spark, d):
    return _paths({0: "//@*"})(spark, d).groupBy("page_id").agg(F.count("*").alias("n"))


def select_close_events(spark, d):
    return _paths({0: "//li~"})(spark, d).groupBy("page_id").agg(F.count("*").alias("n"))


def token_depth(spark, d):
    return levels(_pages(spark, d, values=())).groupBy(F.col("doc_id").alias("page_id")).agg(F.max("level").alias("depth"))


def print_escape(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", escape_content(F.concat(F.lit("<&>"), "text")).alias("content"), escape_attribute(F.concat(F.lit("'<&>\""), "text")).alias("attribute"))


def rt_orders_xml(spark, d):
    """Orders printed as one document per customer, scanned, selected, and summed again."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    row = printer.element("order", printer.element("price", printer.text(F.col("o_totalprice").cast("string"))), attributes={"status": F.col("o_orderstatus"), "id": F.col("o_orderkey").cast("string")})
    docs = printer.document(o, ["o_custkey"], "orders", row, ["o_orderkey"])
    out = select_paths(docs, "o_custkey", "xml", {1: "/orders/order[@status='F']/price()"})
    return out.groupBy(F.col("doc_id").alias("o_custkey")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


def rt_lineitem_xml(spark, d):
    """Line items printed as documents of their own, scanned again, selected by return flag, and summed."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    xml = printer.element("item", printer.text(F.col("l_quantity").cast("string")), attributes={"flag": F.col("l_returnflag")})
    flags = ("A", "N", "R")
    out = select_paths(li.select("l_orderkey", F.concat(F.lit(printer.header()), xml).alias("xml")), "l_orderkey", "xml", {i: f"/item[@flag='{f}']()" for i, f in enumerate(flags)})
    sums = out.groupBy("type_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("quantity"))
    return sums.select(F.element_at(F.array(*[F.lit(f) for f in flags]), F.col("type_id") + 1).alias("flag"), "n", "quantity")


def print_round_trip(spark, d):
    """Tokens printed and scanned again give the same contents."""
    again = tokens(printer.print_tokens(_pages(spark, d)), "doc_id", "xml")
    return again.where(F.col("type") == "Content").select(F.col("doc_id").alias("page_id"), "value")


def chunked_scan(spark, d):
    """Pages that come in pieces of 500 characters, scanned by the stateful scanner of streams."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length("html") / 500)).cast("int")
    parts = spark.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", "html", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    chunks = parts.select(F.col("page_id").cast("string").alias("doc_id"), "chunk", F.substring("html", F.col("chunk") * 500 + 1, F.lit(500)).alias("data"), (F.col("chunk") == F.col("n") - 1).alias("is_last"))
    return scan_chunks(chunks, entities=ENTITIES).groupBy("type").agg(F.count("*").alias("n"))


def scan_chunks_select(spark, d):
    """Two paths over the same pieces, by the selector of streams."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length("html") / 500)).cast("int")
    parts = spark.read.parquet(f"{d}/pages.parquet").where("html is not null").select("page_id", "html", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    chunks = parts.select(F.col("page_id").cast("string").alias("doc_id"), "chunk", F.substring("html", F.col("chunk") * 500 + 1, F.lit(500)).alias("data"), (F.col("chunk") == F.col("n") - 1).alias("is_last"))
    out = select_chunks(chunks, {1: "//a@href", 2: "//title()"}, entities=ENTITIES)
    return out.select(F.col("doc_id").cast("long").alias("page_id"), "type_id", "value")


def charset_roundtrip(spark, d):
    """Numbers as characters, printed and read again in each charset; what it lacks comes back as a reference."""
    names = ("UTF-8", "UTF-16BE", "UTF-16LE", "UCS-2BE", "UCS-2LE", "UCS-4BE", "UCS-4LE", *(f"IsoLatin-{i}" for i in range(1, 10)))
    point = (F.col("l_orderkey") * 37 + F.col("l_linenumber")) % 0xD7FF + 1
    c = F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(point.cast("long").alias("point"), c.alias("c")).distinct()
    out = None
    for name in names:
        back = charset.decode(charset.encode(F.col("c"), name), name)
        one = rows.select(F.lit(name).alias("charset"), ((back == F.col("c")) | (back == F.concat(F.lit("&#x"), F.lower(F.hex("point")), F.lit(";")))).alias("ok"),
                          F.octet_length(charset.encode(F.col("c"), name)).alias("bytes"), (back == F.col("c")).alias("has"))
        out = one if out is None else out.unionByName(one)
    wide = ~F.col("charset").startswith("IsoLatin")
    return out.groupBy("charset").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.sum(F.when(wide, F.col("bytes"))).alias("bytes"), F.count_if(F.col("has") & wide).alias("has"))


def character_classes(spark, d):
    """How many characters of each class the scanner sees in pages."""
    return charset.characters(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html").groupBy("control").agg(F.count("*").alias("n"))


def print_checked(spark, d):
    """Which tokens of pages the printer refuses: they have no header, so nothing may stand outside of a part of a document."""
    t = printer.checked(_pages(spark, d))
    return t.where("print_error is not null").groupBy("print_error").agg(F.count("*").alias("n"))


def charset_latin(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return t.select("doc_id", charset.decode(charset.encode(F.col("text"), "IsoLatin-1"), "IsoLatin-1").alias("text"), F.octet_length(charset.encode(F.col("text"), "IsoLatin-1")).alias("bytes"))


def charset_utf16(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return t.select("doc_id", charset.decode(charset.encode(F.col("text"), "UTF-16LE"), "UTF-16LE").alias("text"), F.octet_length(charset.encode(F.col("text"), "UCS-4LE")).alias("bytes"))


def sniff_encoding(spark, d):
    head = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-'), (F.col("item_id") % 9 + 1).cast("string"), F.lit('"?>'), F.col("text"))
    found = charset.sniff_encoding(F.encode(head, "UTF-16BE"))
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", found["encoding"].alias("encoding"), found["error"].alias("error"))


_C = r"<!--.*?-->|<![^>]*>|</[^>]*>|<[^>]*>|[^<]+"
_CHUNKS = f"c AS (SELECT page_id, unnest(regexp_extract_all(html, '{_C}', 0, 's')) AS c FROM pages)"
_PLAIN = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&amp;', '&')"


def _texts(pattern: str, group: int = 1) -> str:
    return f"SELECT page_id, {_PLAIN.format('v')} AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '{pattern}', {group}, 's')) AS v FROM pages)"


_KIND = "CASE WHEN c LIKE '<!--%' THEN NULL WHEN c LIKE '<!%' THEN 'D' WHEN c LIKE '</%' THEN 'CloseTag' WHEN c LIKE '<%' THEN 'OpenTag' ELSE 'Content' END"
_ATTRS = "SELECT page_id, unnest(regexp_extract_all(c, '\\s([a-z-]+)=\"[^\"]*\"', 1)) AS name FROM c WHERE c LIKE '<%' AND c NOT LIKE '<!%'"
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

#: Thirteen expressions that share beginnings.
MANY = {1: "//a@href", 2: "//title()", 3: "//html@lang", 4: "//h1()", 5: "//li~", 6: "//div[@class='ad']()", 7: "//{h1,title}()", 8: "//a()", 9: "//html", 10: "//article//h1()", 11: "//div[@class='ad']",
        12: "//nav//a@href", 13: "//meta@charset"}

QUERIES = {
    "scan_tokens_by_kind": scan_tokens_by_kind, "scan_doctype_tokens": scan_doctype_tokens, "scan_attributes": scan_attributes, "content_decoded": content_decoded,
    "eol_normalised": eol_normalised, "scan_errors": scan_errors, "select_anchor_href": _paths({0: "//a@href"}), "select_child_path": _paths({0: "/html/head/meta/title()"}),
    "select_if_attribute": _paths({0: "//div[@class='ad']()"}), "select_alternation": _paths({0: "//{h1,title}()"}), "select_any_attr": select_any_attr,
    "select_close_events": select_close_events, "select_index": _paths({0: "//article//[0]()"}), "select_multi": _paths({1: "//a@href", 2: "//title()", 3: "//html@lang"}, True),
    "token_depth": token_depth, "print_escape": print_escape, "print_round_trip": print_round_trip, "rt_orders_xml": rt_orders_xml, "rt_lineitem_xml": rt_lineitem_xml,
    "select_many": _paths(MANY, True), "chunked_scan": chunked_scan, "chunked_select": scan_chunks_select, "charset_roundtrip": charset_roundtrip, "character_classes": character_classes,
    "print_checked": print_checked, "charset_latin": charset_latin, "charset_utf16": charset_utf16, "sniff_encoding": sniff_encoding,
}
ORACLES = {
    "scan_tokens_by_kind": f"""WITH {_CHUNKS}, a AS ({_ATTRS}), k AS (SELECT {_KIND} AS type FROM c)
        SELECT type, count(*) AS n FROM k WHERE type != 'D' GROUP BY type UNION ALL SELECT unnest(['TagAttribName', 'TagAttribValue']), count(*) FROM a
        UNION ALL SELECT 'DocAttribValue', 2 * count(*) FROM pages UNION ALL SELECT unnest(['DocAttribEnd', 'Exit']), count(*) FROM pages""",
    "scan_doctype_tokens": "SELECT page_id, unnest(['DOCTYPE', 'html']) AS value FROM pages",
    "scan_attributes": f"WITH {_CHUNKS}, a AS ({_ATTRS}) SELECT name, count(*) AS n FROM a GROUP BY name",
    "content_decoded": f"WITH {_CHUNKS} SELECT page_id, {_PLAIN.format('c')} AS value FROM c WHERE c NOT LIKE '<%'",
    "eol_normalised": "SELECT doc_id, unnest(['TagAttribValue', 'Content']) AS type, unnest(['x' || chr(10) || 'y' || chr(10) || 'z', text || chr(10)]) AS value FROM documents WHERE text IS NOT NULL",
    "scan_errors": "SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(WRONG)) + " END AS error FROM documents",
    "select_anchor_href": _texts('<a href="([^"]*)"'),
    "select_child_path": _texts("<title>([^<]+)"),
    "select_if_attribute": _texts('<div class="ad">([^<]+)'),
    "select_alternation": _texts("<(h1|title)>([^<]+)", 2),
    "select_any_attr": f"WITH {_CHUNKS}, a AS ({_ATTRS}) SELECT page_id, count(*) AS n FROM a GROUP BY page_id",
    "select_close_events": "SELECT page_id, len(regexp_extract_all(html, '</li>')) AS n FROM pages WHERE html LIKE '%</li>%'",
    "select_index": f"SELECT page_id, {_PLAIN.format('v')} AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<article[^>]*>(?:<[^>]*>)*([^<]+)', 1, 's')) AS v FROM pages)",
    "select_multi": f"""SELECT 1 AS type_id, * FROM ({_texts('<a href="([^"]*)"')}) UNION ALL SELECT 2, * FROM ({_texts('<title>([^<]+)')})
        UNION ALL SELECT 3, * FROM ({_texts('<html lang="([^"]*)"')})""",
    "token_depth": f"""WITH {_CHUNKS.replace("AS c FROM pages", "AS c, generate_subscripts(regexp_extract_all(html, '" + _C + "', 0, 's'), 1) AS i FROM pages")},
        d AS (SELECT page_id, i, CASE {_KIND} WHEN 'OpenTag' THEN 1 WHEN 'CloseTag' THEN -1 ELSE 0 END AS d FROM c),
        s AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM d), m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS level FROM s)
        SELECT page_id, max(level)::INT AS depth FROM m GROUP BY page_id""",
    "print_escape": f"SELECT item_id, '&lt;&amp;&gt;' || {_ESC.format('text')} AS content, '\"&apos;&lt;&amp;&gt;&quot;' || replace(replace(replace({_ESC.format('text')}, '''', '&apos;'), '\"', '&quot;'), chr(10), '&#10;') || '\"' AS attribute FROM benchmark",
    "print_round_trip": f"WITH {_CHUNKS} SELECT page_id, {_PLAIN.format('c')} AS value FROM c WHERE c NOT LIKE '<%'",
    "chunked_select": f"SELECT 1 AS type_id, * FROM ({_texts('<a href="([^"]*)"')}) UNION ALL SELECT 2, * FROM ({_texts('<title>([^<]+)')})",
    "select_many": " UNION ALL ".join(f"SELECT {i} AS type_id, page_id, value FROM ({q})" for i, q in {
        1: _texts('<a href="([^"]*)"'), 2: _texts("<title>([^<]+)"), 3: _texts('<html lang="([^"]*)"'), 4: _texts("<h1>([^<]+)"), 5: _texts("</(li)>"), 6: _texts('<div class="ad">([^<]+)'),
        7: _texts("<(h1|title)>([^<]+)", 2), 8: _texts("<a [^>]*>([^<]+)"), 9: _texts("<(html) "), 10: _texts("<h1>([^<]+)").replace("html,", "regexp_extract(html, '<article.*</article>', 0, 's'),"),
        11: _texts('<div class="(ad)">'), 12: _texts('<a href="([^"]*)"').replace("html,", "regexp_extract(html, '<nav.*</nav>', 0, 's'),"), 13: _texts('<meta charset="([^"]*)"')}.items()),
    "charset_roundtrip": """WITH p AS (SELECT DISTINCT (l_orderkey * 37 + l_linenumber) % 55295 + 1 AS p FROM lineitem),
        b AS (SELECT count(*) AS n, sum(CASE WHEN p < 128 THEN 1 WHEN p < 2048 THEN 2 ELSE 3 END) AS utf8 FROM p),
        c AS (SELECT unnest(['UTF-8', 'UTF-16BE', 'UTF-16LE', 'UCS-2BE', 'UCS-2LE', 'UCS-4BE', 'UCS-4LE']) AS charset, unnest([0, 2, 2, 2, 2, 4, 4]) AS w
              UNION ALL SELECT 'IsoLatin-' || i, NULL FROM range(1, 10) t(i))
        SELECT charset, n, n AS ok, CASE w WHEN 0 THEN utf8 ELSE w * n END::BIGINT AS bytes, CASE WHEN w IS NULL THEN 0 ELSE n END AS has FROM b, c""",
    "character_classes": r"""WITH c AS (SELECT unnest(string_split(html, '')) AS c FROM pages)
        SELECT CASE WHEN c = chr(10) THEN 'EndOfLine' WHEN c IN (' ', chr(9), chr(13)) THEN 'Space' WHEN ascii(c) = 5 THEN 'Undef' WHEN ascii(c) < 32 THEN 'Cntrl' WHEN c = '&' THEN 'Amp' WHEN c = '<' THEN 'Lt'
          WHEN c = '=' THEN 'Equal' WHEN c = '>' THEN 'Gt' WHEN c = '/' THEN 'Slash' WHEN c = '-' THEN 'Dash' WHEN c = '!' THEN 'Exclam' WHEN c = '?' THEN 'Questm' WHEN c = chr(39) THEN 'Sq' WHEN c = chr(34) THEN 'Dq'
          WHEN c = '[' THEN 'Osb' WHEN c = ']' THEN 'Csb' WHEN ascii(c) < 128 THEN 'Any' ELSE 'Undef' END AS control, count(*) AS n FROM c WHERE c != '' GROUP BY 1""",
    "print_checked": "SELECT 'printed xml without root element' AS print_error, count(*) AS n FROM pages HAVING count(*) > 0",
    "rt_orders_xml": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey",
    "rt_lineitem_xml": "SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag",
    "charset_latin": "SELECT doc_id, text, length(text) AS bytes FROM documents",
    "charset_utf16": "SELECT doc_id, text, 4 * length(text) AS bytes FROM documents",
    "sniff_encoding": "SELECT item_id, 'ISO-8859-' || (item_id % 9 + 1) AS encoding, NULL::VARCHAR AS error FROM benchmark",
}
ORACLES["chunked_scan"] = ORACLES["scan_tokens_by_kind"]
