"""Secret scanning: rule-based spans, and a battery of randomness tests on the tokens that no rule matches.

DataFrame functions only; the text is read once and never shuffled. Spans are code points, end exclusive. Spark
has no expression for the places of regex matches, so they are summed from the lengths of matches
(``regexp_extract_all``) and of what lies between them (``split`` by the same pattern).

The battery: tokens of at least ``MIN_TOKEN`` characters of the base64 alphabets get the least encoding that
explains them (hex, base32, base36, base62, base64). Under the hypothesis that a token is uniform over that
encoding's alphabet, chi-squared (Wilson-Hilferty), a runs test about the middle of the alphabet and a serial
correlation test give three p-values, combined by Fisher's method. Tokens fall into strata by length, as short
tokens give the tests little power; in each stratum Benjamini-Hochberg at level ``Q`` over all tokens of the
table rejects what is not random. A token is reported when it is not rejected and holds a digit and a letter.
The step-up threshold comes from a histogram of fixed size (strata times ``BINS``), not from sorted p-values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import stash

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # runs are maximal, so a length in the pattern drops what a later test would
HEX = r"[0-9a-f]{24,}+"
MIN_TOKEN, STRATA, BINS, Q = 20, (28, 40, 64), 2000, 0.05
_CHARS = "A-Za-z0-9+/_="
TOKEN = rf"(?<![{_CHARS}-])[{_CHARS}-]{{{MIN_TOKEN},}}+"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Pattern and alphabet, from the least to the largest.
ENCODINGS = (
    ("[0-9a-f]+", _DIGITS + "abcdef"), ("[0-9A-F]+", _DIGITS + "ABCDEF"), ("[A-Z2-7]+", _UPPER + "234567"), ("[a-z2-7]+", _LOWER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER), ("[0-9A-Z]+", _DIGITS + _UPPER), ("[0-9A-Za-z]+", _UPPER + _LOWER + _DIGITS),
    ("[0-9A-Za-z+/]+", _UPPER + _LOWER + _DIGITS + "+/"), ("[0-9A-Za-z_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
)
_SPAN = "struct<start:bigint,ord:int,end:bigint,text:string>"


def _places(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches; ``text`` of a span is the group ``value``."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("v"),
                         F.slice(F.split(text, pattern, -1), 1, F.regexp_count(text, F.lit(pattern))).alias("b"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(f"array<{_SPAN}>").alias("out"))

    def step(acc, x):
        at = acc["at"] + F.char_length(x["b"])
        end = at + F.char_length(x["m"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("ord"), end.alias("end"), x["v"].alias("text"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(f"array<{_SPAN}>")), F.array(span)).alias("out"))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(F.rlike(text, F.lit(pattern)), F.coalesce(F.aggregate(found, start, step)["out"], none)).otherwise(none)


def _two_sided(z: Column) -> Column:
    """erfc(|z| / sqrt 2) by Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), poly * F.exp(-x * x)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def p_random(token: Column, alphabet: Column) -> Column:
    """Combined p-value of the three tests that ``token`` is uniform over ``alphabet``."""
    n, a = F.char_length(token).cast("double"), F.char_length(alphabet).cast("double")

    def upper():
        squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0),
                              lambda s, c: s + F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        spread = 2 / (9 * (a - 1))
        z = (F.pow(F.greatest(a / n * squares - n, F.lit(0.0)) / (a - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        return _let(z, lambda z: F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2))

    def runs(codes):
        line = F.array_join(F.transform(codes, lambda c: F.when(2 * c + 1 >= a, F.lit("1")).otherwise(F.lit("0"))), "")

        def test(line):
            ones = F.char_length(F.replace(line, F.lit("0"), F.lit(""))).cast("double")
            turns = n - (F.char_length(F.replace(line, F.lit("01"), F.lit(""))) + F.char_length(F.replace(line, F.lit("10"), F.lit("")))) / 2
            mean = 1 + 2 * ones * (n - ones) / n
            return _let(F.struct(turns.alias("turns"), mean.alias("mean")), lambda v: F.when(
                v["mean"] > 2, _two_sided((v["turns"] + 1 - v["mean"]) / F.sqrt((v["mean"] - 1) * (v["mean"] - 2) / (n - 1)))).otherwise(F.lit(1e-12)))

        return _let(line, test)

    def serial(dev):
        zero, total = F.lit(0.0), lambda s, d: s + d
        power = F.aggregate(F.transform(dev, lambda d: d * d), zero, total)
        lag = F.aggregate(F.zip_with(dev, F.slice(dev, 2, F.size(dev)), lambda x, y: x * F.coalesce(y, zero)), zero, total)
        return _let(power, lambda power: F.when(power > 0, _two_sided((lag / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-12)))

    def both(codes):
        mid = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
        dev = _let(mid, lambda mid: F.transform(codes, lambda c: c - mid))
        return -(F.ln(F.greatest(upper(), F.lit(1e-12))) + F.ln(runs(codes)) + F.ln(_let(dev, serial)))

    codes = F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, alphabet).cast("double") - 1)
    return _let(_let(codes, both), lambda x: F.exp(-x) * (1 + x + x * x / 2))


def _stratum(token: Column) -> Column:
    n = F.char_length(token)
    return sum(((n >= limit).cast("int") for limit in STRATA), F.lit(0))


def _alphabet(token: Column) -> Column:
    out = F.lit(_UPPER + _LOWER + _DIGITS + "+/-_")
    for pattern, letters in reversed(ENCODINGS):
        out = F.when(F.rlike(token, F.lit(f"^{pattern}$")), F.lit(letters)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.greatest(F.lit(0.0), -F.log10(p)) * (BINS / 40))).cast("int")


def _thresholds(counts: list[tuple[int, int, int]]) -> list[int]:
    """Per stratum the least bin that Benjamini-Hochberg rejects, from (stratum, bin, count) rows."""
    out = []
    for k in range(len(STRATA) + 1):
        mine = {b: n for s, b, n in counts if s == k}
        total, seen, least = sum(mine.values()), 0, BINS
        for b in sorted(mine, reverse=True):  # from the smallest p-values
            seen += mine[b]
            if 10 ** (-b * 40 / BINS) <= Q * seen / total:
                least = b
        out.append(least)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, found``.

    ``found`` is an array of (kind, start, end, text), the rest digests it. A null text counts as empty: no
    spans, and the SHA-256 of the empty string. Rules may overlap each other; a random token is reported only
    where no rule's span overlaps it. Repeated rows and null ids are scanned like any row, an empty table gives an
    empty result, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    assign = F.filter(_places(F.col("text"), ASSIGN, 0, 2), lambda s: F.char_length(s["text"]) >= 6)
    rows = rows.select("doc_id", "text", F.concat(assign, _places(F.col("text"), ACCESS, 1), _places(F.col("text"), HEX, 2)).alias("base"))

    def open_token(t):
        mixed = F.rlike(t["text"], F.lit("[0-9]")) & F.rlike(t["text"], F.lit("[A-Za-z]"))
        return mixed & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    rows = rows.select("doc_id", "base", F.filter(_places(F.col("text"), TOKEN, 3), open_token).alias("tokens"))
    rows = stash(rows.select("doc_id", "base", F.transform("tokens", lambda t: F.struct(
        t["start"].alias("start"), t["ord"].alias("ord"), t["end"].alias("end"), t["text"].alias("text"),
        _stratum(t["text"]).alias("stratum"), _let(_alphabet(t["text"]), lambda a: _let(p_random(t["text"], a), _bin)).alias("bin"))).alias("tokens")), "secrets")
    counts = rows.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()  # strata times bins at most
    least = F.array(*[F.lit(x) for x in _thresholds([tuple(r) for r in counts])])
    random = F.filter("tokens", lambda t: t["bin"] < F.element_at(least, t["stratum"] + 1))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["ord"].alias("ord"), t["end"].alias("end"), t["text"].alias("text")))
    base, every = F.array_sort("base"), F.array_sort(F.concat("base", random))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    found = F.transform(every, lambda s: F.struct(F.element_at(kinds, s["ord"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"), found.alias("found"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
