"""Query understanding: constraints, intent, guardrails, expansion.

All expressions are built in; model calls are left to the caller, whose answers
come as columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.functions.patterns import java
from corvane.functions.text import ALPHA_SIZE, _upper, chosen, distinct, first_of, has, squeeze, trim, words


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, java(pattern), group).try_cast("double")


def prices(query: Column) -> Column:
    """least and most: a range, else an upper and a lower bound each."""
    q = F.lower(query)
    ranged, (first, second) = has(q, P.RANGE), P.AT_MOST
    most = F.when(ranged, _number(q, P.RANGE, 2)).when(has(q, first), _number(q, first, 1)).when(has(q, second), _number(q, second, 1))
    least = F.when(ranged, _number(q, P.RANGE, 1)).when(has(q, P.AT_LEAST), _number(q, P.AT_LEAST, 1))
    return F.struct(least.alias("least"), most.alias("most"))


def colors(query: Column) -> Column:
    return chosen(F.lower(query), P.QUERY_COLORS, r"(?i)\b@\b", str)


def _around(n: Column, *shapes: tuple[str, str]) -> Column:
    """An alternation of patterns around a number taken from the text."""
    parts = [x for k, (before, after) in enumerate(shapes) for x in ((F.lit("|"),) if k else ()) + (F.lit(java(before)), n, F.lit(java(after)))]
    return F.concat(F.lit(java(r"\b") + "(?:"), *parts, F.lit(")" + java(r"\b")))


def sizes(query: Column) -> Column:
    """Sizes asked for; none if the query denies them.

    Numbers count only when glued to their word (`size10`): a number that stands
    alone is taken for a price.  With no other size a lone letter counts, also
    the one of `it's`."""
    q = F.lower(query)
    bounds = prices(query)
    numbers = F.regexp_extract_all(q, F.lit(java(P.NUMBER_SIZE)), 1)

    def wanted(n: Column) -> Column:
        value = n.try_cast("double")
        alone = F.regexp_like(q, _around(n, (r"\s*", "")))
        named = F.regexp_like(q, _around(n, (r"size\s*[:=]?\s*", ""), ("", r"\s*size"), (r"waist\s*[:=]?\s*", ""), ("", r"\s*waist"), (r"uk\s+", ""), (r"us\s+", ""), (r"eu\s+", "")))
        return ~(F.coalesce(value == bounds["most"], F.lit(False)) | F.coalesce(value == bounds["least"], F.lit(False)) | alone) & named

    found = distinct(F.concat(chosen(q, P.QUERY_SIZES, ALPHA_SIZE, _upper), F.filter(numbers, wanted)))
    lone = F.upper(F.regexp_extract(q, java(P.STANDALONE_SIZE), 1))
    found = F.when((F.size(found) == 0) & (lone != ""), F.array(lone)).otherwise(found)
    return F.when(has(q, P.NO_SIZE), F.array().cast("array<string>")).otherwise(found)


def wants_stock(query: Column) -> Column:
    q = F.lower(query)
    return has(q, P.WANTS_STOCK) & ~has(q, P.WANTS_NO_STOCK)


def is_comparison(query: Column) -> Column:
    return has(F.lower(query), P.COMPARES)


def compared(query: Column) -> Column:
    """Two or three things to compare, else none."""
    q = F.lower(query)

    def parts(text: Column, by: str, lead: str | None = None) -> Column:
        cut = F.split(text, java(by))
        if lead:
            cut = F.transform(cut, lambda x: F.regexp_replace(x, java(lead), ""))
        cut = F.filter(F.transform(cut, trim), lambda x: x != "")
        return F.when(F.size(cut) >= 2, F.slice(cut, 1, 3)).otherwise(F.array().cast("array<string>"))

    after = lambda word: trim(F.regexp_replace(q, java(rf"^.*?\b{word}\b"), ""))
    versus = parts(q, r"\bvs\b", r"^(?:compare|difference between|\s)+")
    found = F.when(has(q, r"\bvs\b"), versus)
    found = found.when(has(q, r"compare\b"), parts(after("compare"), r"\s+(?:and|with|to|vs)\s+"))
    found = found.when(has(q, r"difference between\b"), parts(after("difference between"), r"\s+(?:and|with)\s+"))
    return F.when(is_comparison(query), F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def cleaned(query: Column) -> Column:
    """The query without conversational fluff, itself where too little is left."""
    q = F.lower(query)
    short = squeeze(F.regexp_replace(q, java(P.FLUFF), ""))
    return F.when(F.length(short) < 3, q).otherwise(short)


def parsed(query: Column) -> Column:
    """All constraints in one struct.  confidence is high where any of them but
    the lower price bound is there; `ask_model` marks complex queries without."""
    p, c, s, stock, versus = prices(query), colors(query), sizes(query), wants_stock(query), is_comparison(query)
    sure = p["most"].isNotNull() | (F.size(c) > 0) | (F.size(s) > 0) | stock | versus
    fields = (p["most"].alias("most"), p["least"].alias("least"), c.alias("colors"), s.alias("sizes"), stock.alias("in_stock"), versus.alias("comparison"), compared(query).alias("compared"), cleaned(query).alias("cleaned"))
    return F.struct(*fields, F.when(sure, "high").otherwise("low").alias("confidence"), (~sure & has(query, P.COMPLEX)).alias("ask_model"))


_SAID = "maxPrice double, minPrice double, colors array<string>, sizes array<string>, inStockOnly boolean, isComparison boolean, comparisonEntities array<string>"


def constrained(query: Column, said: Column) -> Column:
    """The constraints in the query, and where a model was to be asked those of its
    JSON `said`, field by field: a field that is absent or of another kind leaves
    what the query gave, and fewer than two things are no comparison."""
    p = parsed(query)
    m = F.when(p["ask_model"], F.from_json(F.regexp_extract(F.coalesce(said, F.lit("")), r"\{[\s\S]*\}", 0), _SAID))
    either = lambda ours, theirs: F.coalesce(p[ours], F.lit(False)) | F.coalesce(m[theirs], F.lit(False))
    return F.struct(
        F.coalesce(m["maxPrice"], p["most"]).alias("most"), F.coalesce(m["minPrice"], p["least"]).alias("least"), F.coalesce(m["colors"], p["colors"]).alias("colors"), F.coalesce(m["sizes"], p["sizes"]).alias("sizes"),
        either("in_stock", "inStockOnly").alias("in_stock"), either("comparison", "isComparison").alias("comparison"), F.when(F.size(m["comparisonEntities"]) >= 2, m["comparisonEntities"]).otherwise(p["compared"]).alias("compared"),
    )


def guardrail(message: Column) -> Column:
    out = F.lit(False)
    for pattern in P.GUARDRAILS:
        out = out | has(message, pattern)
    return F.coalesce(out, F.lit(False))


def intent(message: Column, last_user: Column, has_history: Column, model: Column | None = None) -> Column:
    """Label of a message given the last thing the user said before it."""
    text = trim(message)
    many = F.size(words(text)) + F.regexp_count(text, F.lit(java(P.CJK)))
    rules = [(has(text, P.GRATITUDE), F.lit("gratitude")), (has(text, P.GREETING) | has(text, P.SMALL_TALK), F.lit("greeting"))]
    rules += [(has(text, rule), F.lit(name)) for name, rule in P.INTENTS]
    rules.append((F.coalesce(has(last_user, P.INTENTS[0][1]), F.lit(False)), F.lit("product")))
    rules.append(((many < 3) & ~has_history, F.lit("vague")))
    return first_of(*rules, otherwise=F.lit("general") if model is None else F.coalesce(model, F.lit("general")))


def branch(label: Column) -> Column:
    return first_of(*[(label == a, F.lit(b)) for a, b in P.BRANCHES], otherwise=F.lit("semantic"))


def augmented(message: Column, label: Column) -> Column:
    return first_of(*[(label == a, F.concat(message, F.lit(f" {b}"))) for a, b in P.AUGMENTATIONS], otherwise=message)


def likely_english(text: Column) -> Column:
    clean = trim(F.lower(F.coalesce(text, F.lit(""))))
    known = F.arrays_overlap(F.split(clean, "[^a-z]+"), F.array(*map(F.lit, P.ENGLISH_WORDS)))
    return (clean == "") | (~clean.rlike(r"[^\x20-\x7E]") & (has(clean, P.ENGLISH_PHRASE) | known))


def language_name(code: Column) -> Column:
    return first_of(*[(code == a, F.lit(b)) for a, b in P.LANGUAGE_NAMES], otherwise=code)


def language(text: Column, top: Column, score: Column, asked: Column | None = None) -> Column:
    """code, name, non_english, ask_model, from a detector's best code and score.

    Short texts and unsure ones count as English; where that isn't certain a
    model is to be asked, whose code, if there is one, wins."""
    clean = trim(F.coalesce(text, F.lit("")))
    sure = (F.length(clean) >= 40) & (score >= 0.85) & (top != "und") & ~top.isin(*P.ENGLISH_CODES)
    code = F.when(F.coalesce(sure, F.lit(False)), top).otherwise("eng")
    ask = ~((code == "eng") & ((F.length(text) >= 40) | likely_english(text)))
    if asked is not None:
        alias = first_of(*[(asked == a, F.lit(b)) for a, b in P.LANGUAGE_ALIASES], otherwise=asked)
        code = F.when(ask, F.coalesce(alias, F.lit("eng"))).otherwise(code)
    return F.struct(code.alias("code"), language_name(code).alias("name"), (code != "eng").alias("non_english"), ask.alias("ask_model"))


def hyde_reason(query: Column, label: Column, resolved: Column) -> Column:
    """Why a hypothetical document is wanted: short, pronoun or catalog; null
    where it isn't."""
    text = trim(F.coalesce(query, F.lit("")))
    skip = resolved | label.isin("greeting", "contact", "vague") | (text == "") | has(text, P.CORRECTION) | has(text, P.DIRECT)
    return F.when(~skip, first_of((F.size(words(text)) <= 3, F.lit("short")), (has(text, P.AMBIGUOUS), F.lit("pronoun")), (has(text, P.DISCOVERY), F.lit("catalog"))))


def expanded(query: Column, label: Column, resolved: Column, document: Column | None = None) -> Column:
    """The search text: with the hypothetical document where one is wanted and
    there is one, else with catalog synonyms where none is wanted."""
    text = trim(query)
    plain = F.when(has(text, P.CATALOG), F.concat(text, F.lit(f" {P.CATALOG_SUFFIX}"))).otherwise(text)
    written = text
    if document is not None:
        written = F.when(F.coalesce(trim(document), F.lit("")) != "", F.concat(text, F.lit("\n\n"), trim(document))).otherwise(text)
    return F.when(hyde_reason(query, label, resolved).isNull(), plain).otherwise(written)


def needs_context(query: Column) -> Column:
    """pronoun, implicit, short and needed: whether a query leans on what was
    said before."""
    text = trim(F.coalesce(query, F.lit("")))
    pronoun, implicit, objection = has(text, P.PRONOUNS), has(text, P.IMPLICIT), has(text, P.OBJECTION)
    alone = has(text, P.STANDALONE) & ~pronoun
    short = (F.size(F.split(text, java(r"\s+"))) <= 4) & ~alone
    return F.struct(pronoun.alias("pronoun"), implicit.alias("implicit"), short.alias("short"), ((pronoun | implicit | objection | short) & ~alone & (text != "")).alias("needed"))


def entity(history: Column) -> Column:
    """What recent messages, newest first, name in bold or as a link; empty if
    nothing.  A generic bold name is passed over; a generic link name is kept
    only if nothing better follows."""
    blank = F.struct(F.lit("").alias("name"), F.lit(False).alias("done"))

    def step(got: Column, message: Column) -> Column:
        text = F.coalesce(message, F.lit(""))
        bold = trim(F.regexp_replace(F.regexp_extract(text, java(P.BOLD), 1), java(P.BOLD_PREFIX), ""))
        is_bold = has(text, P.BOLD) & ~has(bold, P.GENERIC_BOLD)
        link = trim(F.regexp_replace(F.regexp_extract(text, java(P.LINK_TEXT), 1), java(P.LINK_PREFIX), ""))
        is_link = has(text, P.LINK_TEXT)
        good_link = (F.length(link) > 2) & ~has(link, P.GENERIC_LINK)
        name = F.when(got["done"], got["name"]).when(is_bold, bold).when(is_link, link).otherwise(got["name"])
        return F.struct(name.alias("name"), (got["done"] | is_bold | (is_link & good_link)).alias("done"))

    return F.aggregate(history, blank, step, lambda got: got["name"])


def resolved(query: Column, history: Column, model: Column | None = None) -> Column:
    """text and was_resolved: a follow-up made self-contained by what recent
    messages (newest first) name, else by a model's answer."""
    text = trim(F.coalesce(query, F.lit("")))
    needs = needs_context(query)
    name = F.when(F.size(history) > 0, entity(history)).otherwise("")
    rest = trim(F.regexp_replace(text, java(P.PRONOUNS), ""))
    direct = (name != "") & (needs["pronoun"] | needs["implicit"] | needs["short"])
    joined = trim(F.concat(name, F.when(has(text, P.SPEC_WORDS), F.lit(f" {P.SPEC_SUFFIX} ")).otherwise(" "), rest))
    answer = F.lit(None).cast("string") if model is None else F.nullif(trim(F.regexp_replace(model, "^[\"']|[\"']$", "")), F.lit(""))
    by_model = answer.isNotNull() & (answer != text)
    out = F.when(direct, joined).when(by_model, answer).when(name != "", F.concat(name, F.lit(" "), text))
    out = F.when(needs["needed"] & (F.size(history) > 0), out)
    return F.struct(F.coalesce(out, text).alias("text"), out.isNotNull().alias("was_resolved"))


def _reply(text: str, business: Column, other: str) -> Column:
    return F.replace(F.lit(text), F.lit("@"), F.coalesce(F.nullif(business, F.lit("")), F.lit(other)))


def greeting_reply(message: Column, has_history: Column, business: Column, welcome: Column) -> Column:
    """The reply to a greeting.  Apostrophes are gone before the patterns run."""
    text = trim(F.regexp_replace(F.lower(message), "[,!?.']", " "))
    rules = [(text.rlike(rule), _reply(said, business, P.SITE)) for rule, said in P.GREETING_REPLIES]
    rules.append((has_history, _reply(P.GREETING_AGAIN, business, P.GOODS)))
    return first_of(*rules, otherwise=F.coalesce(F.nullif(welcome, F.lit("")), _reply(P.GREETING_FIRST, business, P.SITE)))


def route(label: Column, guarded: Column, abstained: Column | None = None) -> Column:
    """The path that a message takes.  Thanks and greetings come before the
    guardrail, which comes before everything else."""
    path = F.when(label == "gratitude", "gratitude").when(label == "greeting", "greeting").when(guarded, "none").when(label == "vague", "clarify")
    if abstained is not None:
        path = path.when(abstained, "abstained")
    return path.when(label == "product", "structured").otherwise("semantic")


def is_logged(path: Column) -> Column:
    return path.isin(*P.LOGGED_PATHS)


def fixed_reply(message: Column, path: Column, has_history: Column, business: Column, welcome: Column) -> Column:
    """The reply of the paths that need no search and no model, else null."""
    return (
        F.when(path == "gratitude", _reply(P.GRATITUDE_REPLY, business, P.GOODS))
        .when(path == "greeting", greeting_reply(message, has_history, business, welcome))
        .when(path == "none", _reply(P.GUARDED_REPLY, business, P.SITE))
    )


def payload_filter(most: Column, stock_only: Column, price: Column, in_stock: Column) -> Column:
    """Whether a point passes a query's constraints: only the upper price bound
    and stock filter; a point without a price fails a bound."""
    return F.coalesce(most.isNull() | (price <= most), F.lit(False)) & F.coalesce(~stock_only | in_stock, F.lit(False))
