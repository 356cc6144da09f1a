"""The token table of markup texts, in one narrow stage of built-in functions.

A text is cut into chunks (comment, CDATA, instruction, declaration, tag, content) by one regular expression
without backtracking, and each chunk becomes an array of token structs. Two lanes do this: the quick one has an
expression that only takes well-formed tags, so that a chunk's first characters say what it is and few string
functions give its tokens. A text that it does not cover to its end, or that has an unknown entity, takes the exact
lane, which finds the first error and its kind. The first error ends a document's tokens, else ``Exit`` does.
Most texts of the quick lane do not come here, see :mod:`tagloom.operators.ahead`.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.entities import decode_entities, normalise_eol

#: The names of the token kinds and of the errors.
TYPES = ("None", "ErrorOccurred", "HeaderStart", "HeaderAttribName", "HeaderAttribValue", "HeaderEnd", "DocAttribValue", "DocAttribEnd", "TagAttribName",
         "TagAttribValue", "OpenTag", "CloseTag", "CloseTagIm", "Content", "Exit")
#: The exact lane's chunks; the last branch is markup without an end.
CHUNK = (r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\s*\?.*?\?>|<\s*!(?!--|\[)(?:[^>\[\"']++|\"[^\"]*+\"|'[^']*+'|\[[^\]]*+\])*+>"
         r"|<\s*/[^>]*>|<(?!\s*[!?/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<.*")
_NAME = r"[^\x00-\x20&<=>/!?'\"\[\]]"
_WS = r"[\x01-\x20]"
_VALUE = rf"(\"[^\"<]*+\"|'[^'<]*+'|{_NAME}*+)"
_ATTR = rf"\G{_WS}*+({_NAME}++){_WS}*+={_WS}*+{_VALUE}(?={_WS}|/|>|\?|$)"
_QUOTED = rf"(?:\"[^\"<]*+\"|'[^'<]*+'|{_NAME}++)"
_PAIR = rf"{_WS}++({_NAME}++){_WS}*+={_WS}*+({_QUOTED})"
#: The quick lane's chunks: complete ones only, white space that does not count belongs to what stands before it.
_COMPLETE = (rf"<!--.*?-->{_WS}*+|<!\[CDATA\[.*?\]\]>|<![A-Za-z](?:[^>\[\"'<]++|\"[^\"]*+\"|'[^']*+')*+>{_WS}*+|<\?.*?\?>|</{_NAME}++{_WS}*+>"
             rf"|<{_NAME}++(?:{_WS}++{_NAME}++{_WS}*+={_WS}*+{_QUOTED})*+{_WS}*+/?+{_WS}*+>|[^<]++")
_QUICK = rf"(?s){_COMPLETE}|<.*"
TOKEN = "struct<type:string,value:string,error:string,tag:string,name:string,ord:int>"
E = {"tag": "expected open tag", "xml": "expected XML tag", "attr": "expected tag attribute", "end": "expected tag end", "equal": "expected equal",
     "string": "string not terminated", "eot": "unexpected end of text", "entity": "undefined character entity", "dash": "expected 2nd dash",
     "cdata": "expected CDATA tag", "doctype": "illegal document attribute definition", "syntax": "syntax token", "internal": "internal (illegal state)", "eoi": "unexpected end of input",
     "eol": "expected end of line"}
#: What a token's value may be left out for, so that it is not built (see ``values`` of :func:`tokens`).
MASKABLE = ("Content", "TagAttribValue", "HeaderAttribValue", "DocAttribValue")


def _token(kind: str, value: Column | str = "", error: str | None = None, owner: tuple[Column, Column, Column] | None = None) -> Column:
    """``owner``: the tag, name and place of an attribute."""
    value = F.lit(value) if isinstance(value, str) else value
    tag, name, place = owner or (F.lit(None),) * 3
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(error).cast("string").alias("error"),
                    tag.cast("string").alias("tag"), name.cast("string").alias("name"), place.cast("int").alias("ord"))


def _error(code: str, value: Column | str = "") -> Column:
    return _token("ErrorOccurred", value, E[code])


def _tokens(*parts: Column) -> Column:
    return F.array(*parts).cast(f"array<{TOKEN}>")


_NONE = lambda: F.array().cast(f"array<{TOKEN}>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _value(kind: str, raw: Column, entities, owner=None) -> Column:
    """A token with line ends and entities resolved, or the error of an unknown entity."""
    return _let(decode_entities(normalise_eol(raw), entities), lambda v: F.when(v.isNull(), _error("entity", raw)).otherwise(_token(kind, v, None, owner)))


def _attributes(tag: Column, rest: Column, names: str, values: str, last, entities) -> Column:
    """Name and value tokens of ``rest`` (what follows the tag's name), then ``last(remainder)``."""
    found = F.regexp_extract_all(rest, F.lit(_ATTR), F.lit(0))

    def pair(a: Column, i: Column) -> Column:
        raw = F.regexp_extract(a, _ATTR, 2)
        raw = F.when(F.rlike(raw, F.lit("^[\"']")), F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)
        return _let(F.regexp_extract(a, _ATTR, 1), lambda name: F.array(
            _token(names, name, None, (tag, name, i)).cast(TOKEN), _value(values, raw, entities, (tag, name, i)).cast(TOKEN)))

    def done(found: Column) -> Column:
        used = F.aggregate(found, F.lit(0), lambda n, a: n + F.char_length(a))
        remainder = F.regexp_replace(F.substring(rest, used + 1, F.char_length(rest)), rf"^{_WS}+", "")
        return F.concat(F.flatten(F.transform(found, pair)), _let(remainder, last))

    return _let(found, done)


def _tag_rest(names: str):
    """What may stand after the attributes: the tag's end, or which error."""
    def last(r: Column) -> Column:
        name = F.regexp_extract(r, rf"^({_NAME}+)", 1)
        after = F.regexp_extract(r, rf"^{_NAME}+{_WS}*={_WS}*(.*)$", 1)
        quoted = F.regexp_extract(r, rf"(?s)^{_NAME}+{_WS}*={_WS}*(\"[^\"<]*\"|'[^'<]*')", 1)  # complete, but what follows cannot
        partial = F.regexp_extract(r, rf"(?s)^{_NAME}+{_WS}*={_WS}*[\"']([^<]*)", 1)
        return (F.when(F.rlike(r, F.lit(r"^>$")), _NONE())
                .when(F.rlike(r, F.lit(rf"^/{_WS}*>$")), _tokens(_token("CloseTagIm")))
                .when(r.startswith("/"), _tokens(_error("end")))
                .when(r == "", _tokens(_error("eot")))
                .when(quoted != "", _tokens(_token(names, name), _token(names.replace("Name", "Value"), F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)), _error("attr")))
                .when(F.rlike(r, F.lit(rf"(?s)^{_NAME}+{_WS}*={_WS}*[\"']")), _tokens(_token(names, name), _error("string", partial)))
                .when(F.rlike(r, F.lit(rf"(?s)^{_NAME}+{_WS}*=")), _tokens(_token(names, name), _error("attr", after)))
                .when(name != "", _tokens(_error("equal", name)))
                .otherwise(_tokens(_error("attr"))))
    return last


def _open_tag(chunk: Column, entities, html: bool) -> Column:
    rest = F.regexp_replace(chunk, rf"^<{_WS}*{_NAME}*", "")
    if html:  # lenient: attributes without a value have an empty one
        rest = F.regexp_replace(rest, rf"(?<={_WS})({_NAME}+)(?={_WS}*(?:/?>|{_WS}{_NAME}))(?!{_WS}*=)", "$1=\"\"")
    ok = F.rlike(rest, F.lit(rf"^(?:{_WS}|/|>)"))
    return _let(F.regexp_extract(chunk, rf"^<{_WS}*({_NAME}*)", 1), lambda name: F.when(ok & (name != ""), F.concat(
        _tokens(_token("OpenTag", name)), _attributes(name, rest, "TagAttribName", "TagAttribValue", _tag_rest("TagAttribName"), entities))).otherwise(_tokens(_error("attr", name))))


def _header(chunk: Column, entities) -> Column:
    rest = F.regexp_replace(chunk, rf"^<{_WS}*\?xml", "")
    last = lambda r: F.when(F.rlike(r, F.lit(rf"^\?{_WS}*>$")), _tokens(_token("HeaderEnd"))).otherwise(_tokens(_error("equal", F.regexp_extract(r, rf"^({_NAME}+)", 1))))
    body = F.concat(_tokens(_token("HeaderStart", "?xml")), _attributes(F.lit("?xml"), rest, "HeaderAttribName", "HeaderAttribValue", last, entities))
    return F.when(F.rlike(chunk, F.lit(rf"^<{_WS}*\?xml[\x01-\x20?]")), body).otherwise(_tokens(_error("xml")))


def _declaration(chunk: Column) -> Column:
    inner = F.regexp_replace(F.regexp_extract(chunk, rf"(?s)^<{_WS}*!(.*)>$", 1), r"\[[^\]]*\]", " ")
    words = F.regexp_extract_all(inner, F.lit(r"\"[^\"]*\"|'[^']*'|[^\x01-\x20\"']+"), F.lit(0))
    unquoted = lambda w: F.when(F.rlike(w, F.lit("^[\"']")), F.substring(w, F.lit(2), F.char_length(w) - 2)).otherwise(w)
    return F.concat(F.transform(words, lambda w: _token("DocAttribValue", unquoted(w)).cast(TOKEN)), _tokens(_token("DocAttribEnd")))


def _exact(text: Column, entities, cdata: bool, html: bool) -> Column:
    """Arrays of tokens by chunk, whatever the text; what follows an error is not cut off yet."""
    chunks = F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))

    def each(chunks: Column):
        def one(c: Column, i: Column) -> Column:
            before = F.get(chunks, i - 1)
            seek = F.rlike(before, F.lit(rf"^<!|^<{_WS}+!")) & ~before.startswith("<![CDATA[") | (i == 1) & F.rlike(before, F.lit(rf"^<{_WS}*\?"))
            content = F.when(seek, F.regexp_replace(c, rf"^{_WS}+", "")).otherwise(c)
            full = c.endswith(">")
            return (F.when(~c.startswith("<"), F.when(i == 0, _tokens(_error("tag"))).when(content == "", _NONE()).otherwise(_tokens(_value("Content", content, entities))))
                    .when(c.startswith("<!--"), F.when(F.rlike(c, F.lit("(?s)^<!--.*-->$")), _NONE()).otherwise(_tokens(_error("eot"))))
                    .when(c.startswith("<![CDATA["), F.when(c.endswith("]]>"), _tokens(_token("Content", F.substring(c, F.lit(10), F.char_length(c) - 12))) if cdata else _NONE()).otherwise(_tokens(_error("eot"))))
                    .when(c.startswith("<!["), _tokens(_error("cdata", F.regexp_extract(c, r"^<!\[([A-Z]*)", 1))))
                    .when(F.rlike(c, F.lit(rf"^<{_WS}*!")), F.when(c.startswith("<!-"), _tokens(_error("dash"))).when(full, _declaration(c)).otherwise(_tokens(_error("eot"))))
                    .when(F.rlike(c, F.lit(rf"^<{_WS}*\?")), F.when(~c.endswith("?>"), _tokens(_error("eot"))).when(i == 0, _header(c, entities)).otherwise(_NONE()))
                    .when(F.rlike(c, F.lit(rf"^<{_WS}*/")), F.when(F.rlike(c, F.lit(rf"^<{_WS}*/{_NAME}+{_WS}*>$")), _tokens(_token("CloseTag", F.regexp_extract(c, rf"^<{_WS}*/({_NAME}+)", 1))))
                          .otherwise(_tokens(_error("end", F.regexp_extract(c, rf"^<{_WS}*/({_NAME}*)", 1)))))
                    .otherwise(_open_tag(c, entities, html)))

        return F.transform(chunks, one)

    return _let(chunks, each)


def _fast(kind: str, raw: Column, entities, values, owner=None) -> Column:
    """A token whose value seldom needs work; with an unknown entity it is an error, which sends the text to the exact lane."""
    if values is not None and kind not in values:
        return _token(kind, F.lit(None).cast("string"), None, owner)
    return F.when(F.contains(raw, F.lit("&")) | F.contains(raw, F.lit("\r")), _value(kind, raw, entities, owner)).otherwise(_token(kind, raw, None, owner))


def _quick(chunks: Column, entities, cdata: bool, values) -> Column:
    """Arrays of tokens of complete chunks."""
    def inner(v: Column) -> Column:
        return F.when(v.startswith("'") | v.startswith('"'), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v)

    def open_tag(c: Column) -> Column:
        shut = F.rlike(c, F.lit(rf"/{_WS}*+>$"))
        start = lambda name: _tokens(_token("OpenTag", name))
        end = lambda a: F.when(shut, F.concat(a, _tokens(_token("CloseTagIm")))).otherwise(a)

        def full(name: Column) -> Column:
            def pair(n: Column, i: Column, found: Column) -> Column:
                owner = (name, n, i)
                return F.array(_token("TagAttribName", n, None, owner).cast(TOKEN), _fast("TagAttribValue", inner(F.get(found, i)), entities, values, owner).cast(TOKEN))

            pairs = _let(F.regexp_extract_all(c, F.lit(_PAIR), F.lit(2)), lambda found: F.flatten(F.transform(F.regexp_extract_all(c, F.lit(_PAIR), F.lit(1)), lambda n, i: pair(n, i, found))))
            return F.concat(start(name), F.when(F.contains(c, F.lit("=")), pairs).otherwise(_NONE()))

        return end(_let(F.regexp_extract(c, rf"^<({_NAME}++)", 1), full))

    def one(c: Column, i: Column) -> Column:
        marked = (F.when(c.startswith("<!--"), _NONE())
                  .when(c.startswith("<![CDATA["), _tokens(_token("Content", F.substring(c, F.lit(10), F.char_length(c) - 12))) if cdata else _NONE())
                  .when(c.startswith("<!"), _declaration(F.regexp_replace(c, rf"{_WS}+$", "")))
                  .otherwise(F.when(i == 0, _header(c, entities)).otherwise(_NONE())))
        return (F.when(~c.startswith("<"), _tokens(_fast("Content", c, entities, values)))
                .when(c.startswith("</"), _tokens(_token("CloseTag", F.regexp_extract(c, rf"^</({_NAME}++)", 1))))
                .when(c.startswith("<!") | c.startswith("<?"), marked)
                .otherwise(open_tag(c)))

    return F.transform(chunks, one)


def token_chunks(text: Column, entities: dict[str, str] | None = None, cdata: bool = False, html: bool = False, strip_bom: bool = False, values: tuple[str, ...] | None = None) -> Column:
    """All tokens of a text, as an array of arrays: those of a tag, or of another construct, together. None is empty."""
    text = F.substring_index(text, "\0", 1)
    if strip_bom:
        text = F.regexp_replace(text, "^\ufeff", "")
    text = F.regexp_replace(text, rf"^{_WS}+", "")

    def cut(chunks: Column) -> Column:
        at = F.array_position(F.transform(chunks, lambda c: F.exists(c, lambda t: t["error"].isNotNull())), True).cast("int")
        done = F.when(at > 0, F.slice(chunks, 1, at)).otherwise(F.concat(chunks, F.array(_tokens(_token("Exit")))))
        return F.filter(done, lambda c: F.size(c) > 0)

    exact = _let(_exact(text, entities, cdata, html), cut)
    none = F.array().cast(f"array<array<{TOKEN}>>")
    if html:  # attributes without a value are not in the quick lane's tags
        return F.when(text.isNull(), none).otherwise(exact)
    header = F.rlike(text, F.lit(r"^<\?"))

    def trimmed(chunks: Column) -> Column:
        """After a header, white space does not count."""
        left = F.filter(F.transform(chunks, lambda c, i: F.when(i == 1, F.regexp_replace(c, rf"^{_WS}+", "")).otherwise(c)), lambda c: c != "")
        return F.when(header & F.rlike(F.get(chunks, F.lit(1)), F.lit("^[^<]")), left).otherwise(chunks)

    def quick(chunks: Column) -> Column:
        return F.when(F.rlike(F.element_at(chunks, -1), F.lit(rf"(?s)^(?:{_COMPLETE})$")), _let(
            F.filter(_quick(chunks, entities, cdata, values), lambda c: F.size(c) > 0),
            lambda q: F.when(~F.exists(q, lambda c: F.exists(c, lambda t: t["error"].isNotNull())), F.concat(q, F.array(_tokens(_token("Exit")))))))

    found = F.when(text.startswith("<"), _let(_let(F.regexp_extract_all(text, F.lit(_QUICK), F.lit(0)), trimmed), quick))
    return F.when(text.isNull(), none).otherwise(F.coalesce(found, exact))


_built: dict = {}


def built(key: tuple, make):
    """The expression ``make()``, made once for each ``key`` and driver: it has thousands of parts, each a call to the JVM."""
    context = SparkContext._active_spark_context
    if _built.get("context") is not context:
        _built.clear()
        _built["context"] = context
    if key not in _built:
        _built[key] = make()
    return _built[key]


def frozen(options: dict) -> tuple:
    return tuple(sorted((k, tuple(sorted(v.items())) if isinstance(v, dict) else v) for k, v in options.items()))


def chunks_of(text_col: str, options: dict) -> Column:
    """:func:`token_chunks` of a column, built once."""
    return built((text_col, frozen(options)), lambda: token_chunks(F.col(text_col), **options))


def tokens(df: DataFrame, id_col: str, text_col: str, wide: bool = False, **options) -> DataFrame:
    """``doc_id, seq, type, value, error``: one row per token; a null text has none.

    ``wide`` adds ``tag, name, ord``, what an attribute's tokens belong to, which spares later plans a shuffle.
    ``entities`` maps further names to characters, ``cdata`` gives CDATA as content, ``html`` allows attributes without
    a value, ``strip_bom`` passes over a byte order mark. ``values`` names the kinds (of :data:`MASKABLE`) whose values
    are wanted: those of others are null and not built, except that a text with an error has all of them.
    """
    from tagloom.operators.ahead import with_tokens

    rows, arr = with_tokens(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **options)
    # outer: else Spark tests the array for being empty first, and lexes twice
    rows = rows.select("doc_id", F.posexplode_outer(arr).alias("seq", "t")).where("t is not null")
    return rows.select("doc_id", "seq", "t.type", "t.value", "t.error", *(["t.tag", "t.name", "t.ord"] if wide else []))


def valid(tokens: DataFrame) -> DataFrame:
    """The tokens that are elements of a document: without errors and the end."""
    return tokens.where(~F.col("type").isin("None", "ErrorOccurred", "Exit"))
