"""URL predicates and parts, as expressions on the text of a URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.functions.text import first_of, has

#: scheme, host without user and port, path
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:\s]+)(?::[0-9]*)?(/[^?#]*)?(?:[?#].*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 1))


def host(url: Column) -> Column:
    """Lower-case host, empty for a relative URL or the local host."""
    name = F.lower(F.regexp_extract(url, ABSOLUTE, 2))
    return F.when(name == "localhost", "").otherwise(name)


def path(url: Column) -> Column:
    """Lower-case path; a relative URL is taken from the root."""
    own = F.regexp_extract(url, ABSOLUTE, 3)
    relative = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    relative = F.when(relative.startswith("/"), relative).otherwise(F.concat(F.lit("/"), relative))
    return F.lower(F.when(F.coalesce(url, F.lit("")) == "", "").when(url.rlike(ABSOLUTE), F.when(own == "", "/").otherwise(own)).otherwise(relative))


def origin(url: Column) -> Column:
    """Scheme and host; the port is dropped."""
    return F.when(url.rlike(ABSOLUTE), F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, ABSOLUTE, 2))))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, ABSOLUTE, 2)), r"^www\.", "")


def is_crawlable(url: Column) -> Column:
    """An absolute web address that isn't a file or an asset."""
    ok = url.rlike(ABSOLUTE) & has(url, r"(?i)^https?://") & ~has(path(url), P.FILE_EXTENSION) & ~has(path(url), P.ASSET_PATH)
    return F.coalesce(ok, F.lit(False))


def same_domain(a: Column, b: Column) -> Column:
    """Equal hosts but for a leading www."""
    return F.coalesce(a.rlike(ABSOLUTE) & b.rlike(ABSOLUTE) & (bare_host(a) == bare_host(b)), F.lit(False))


def page_type(url: Column, types: Column | None = None, og: Column | None = None, title: Column | None = None, body: Column | None = None) -> Column:
    """The first rule that holds: schema types, path, home page, then what the
    page says of itself.  Path rules are unanchored, so `workshop` is a shop."""
    where = path(F.coalesce(url, F.lit("")))
    rules = []
    if types is not None:
        lower = F.transform(types, F.lower)
        rules += [(F.arrays_overlap(lower, F.array(*map(F.lit, names))), F.lit(kind)) for kind, names in P.SCHEMA_TYPES]
    rules += [(has(where, rule), F.lit(kind)) for kind, rule in P.PATH_TYPES]
    rules.append((where.isin(*P.HOME_PATHS), F.lit("homepage")))
    if og is not None:
        rules += [(F.lower(og).contains(word), F.lit(kind)) for kind, word in P.OG_TYPES]
    if title is not None:
        rules += [(has(F.lower(title), rule), F.lit(kind)) for kind, rule in P.TITLE_TYPES]
    if body is not None:
        rules += [(has(F.lower(body), rule), F.lit(kind)) for kind, rule in P.BODY_TYPES]
    return first_of(*rules, otherwise=F.lit("general_page"))
