"""Scalar functions on page and document text, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.functions.patterns import java

SPACES = java(r"\s+")
EDGES = java(r"^\s+|\s+$")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def squeeze(text: Column) -> Column:
    return trim(F.regexp_replace(text, SPACES, " "))


def first_of(*choices: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for when, value in choices:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out if otherwise is None else out.otherwise(otherwise)


def distinct(values: Column) -> Column:
    """Distinct values, each at its first place."""
    return F.array_distinct(values)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def is_html(text: Column) -> Column:
    return F.coalesce(has(text, P.HTML_TAG), F.lit(False))


def word_count(text: Column) -> Column:
    """Tokens between white space, and each CJK character once more."""
    return F.size(words(text)) + F.regexp_count(text, F.lit(java(P.CJK)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_count(text: Column) -> Column:
    """A quarter of the length, rounded up; the offline estimate."""
    return F.ceil(F.length(text) / 4).cast("long")


def strip_noise(text: Column) -> Column:
    for pattern, by in P.NOISE:
        text = F.regexp_replace(text, java(pattern), by)
    return trim(text)


def emails(text: Column, limit: int = 5) -> Column:
    return F.slice(distinct(F.regexp_extract_all(text, F.lit(java(P.EMAIL)), 0)), 1, limit)


def phones(text: Column, limit: int = 5) -> Column:
    """Runs that look like phone numbers with 7 to 15 digits, but no dates and
    no network addresses."""

    def good(p: Column) -> Column:
        digits = F.length(F.regexp_replace(p, r"[^0-9]", ""))
        return digits.between(7, 15) & ~has(p, P.DATE_LIKE) & ~has(p, P.ADDRESS_LIKE)

    found = F.transform(F.regexp_extract_all(text, F.lit(java(P.PHONE)), 0), trim)
    return F.slice(distinct(F.filter(found, good)), 1, limit)


def md_headings(text: Column) -> Column:
    """Headings of Markdown lines, as structs of level and text."""
    line = java(r"^(#{1,6})\s+(.+)")
    found = F.filter(F.split(trim(text), "\n"), lambda x: x.rlike(line))
    return F.transform(found, lambda x: F.struct(F.concat(F.lit("h"), F.length(F.regexp_extract(x, line, 1))).alias("level"), trim(F.regexp_extract(x, line, 2)).alias("text")))


def md_title(text: Column) -> Column:
    """The first line that is a first-level heading."""
    return trim(F.regexp_extract(trim(text), java(r"(?m)^#\s+(.+)"), 1))


def md_tables(text: Column) -> Column:
    return F.regexp_count(trim(text), F.lit(java(r"\|[\s-]+\|")))


def md_code_blocks(text: Column) -> Column:
    """Half the number of fences, so an open one counts a half."""
    return F.regexp_count(trim(text), F.lit("```")) / 2


def price(text: Column) -> Column:
    """price and currency of the first price, by three patterns in turn."""
    rules = [java(p) for p in P.PRICES]
    which = first_of(*[(text.rlike(r), F.lit(k)) for k, r in enumerate(rules)])
    amount = first_of(*[(which == k, F.regexp_extract(text, r, 2 if k < 2 else 1)) for k, r in enumerate(rules)])
    sign = F.upper(first_of(*[(which == k, F.regexp_extract(text, r, 1)) for k, r in enumerate(rules)]))
    value = F.regexp_replace(amount, ",", "").try_cast("double")
    good = (value > 0) & (value < 1_000_000)
    name = first_of(*[(sign == s, F.lit(n)) for s, n in P.CURRENCIES], otherwise=F.nullif(sign, F.lit("")))
    return F.struct(F.when(good, value).alias("price"), F.when(good, name).alias("currency"))


def chosen(text: Column, values: tuple[str, ...], pattern: str, name) -> Column:
    """Those of a fixed list whose pattern the text has, in the list's order."""
    found = [F.when(has(text, pattern.replace("@", v)), F.lit(name(v))) for v in values]
    return distinct(F.array_compact(F.array(*found)))


ALPHA_SIZE = r"(?i)\b(?:size\s+@|@\s+size|size\s*:\s*@)\b"
#: its parts, each with the size alone
SIZE_WORDS = (r"(?i)\bsize\s+(@)\b", r"(?i)\b(@)\s+size\b", r"(?i)\bsize\s*:\s*(@)\b")


def _upper(size: str) -> str:
    return size.upper() if len(size) <= 3 else size


def listed(text: Column, values: tuple[str, ...], patterns: tuple[str, ...], name) -> Column:
    """Like `chosen` for values of which none can hide another in a text, with a
    scan for each pattern and none for each value."""
    every = "|".join(values)
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(java(p.replace("@", every))), 1) for p in patterns)), F.lower)
    return distinct(F.transform(F.filter(F.array(*(F.struct(F.lit(v.lower()).alias("key"), F.lit(name(v)).alias("name")) for v in values)), lambda v: F.array_contains(found, v["key"])), lambda v: v["name"]))


def page_colors(text: Column) -> Column:
    """Words of the list, which are whole runs of ASCII letters, digits and `_`."""
    own = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), 0)), F.lower)
    return F.coalesce(F.array_intersect(F.array(*map(F.lit, P.PAGE_COLORS)), own), F.array().cast("array<string>"))


def page_sizes(text: Column) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(java(P.PAGE_NUMBER_SIZE)), 1)
    # few texts have the word that all these patterns need
    named = F.when(F.contains(F.lower(text), F.lit("size")), listed(text, P.PAGE_SIZES, SIZE_WORDS, _upper)).otherwise(F.array().cast("array<string>"))
    return distinct(F.concat(named, numbers))


def page_stock(text: Column) -> Column:
    """False, true, or null where the text doesn't say."""
    return F.when(has(text, P.OUT_OF_STOCK), False).when(has(text, P.IN_STOCK), True)
