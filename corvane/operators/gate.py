"""The quality gate: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.functions.text import first_of, has, trim


def skip_reason(url: Column, title: Column, text: Column, words: Column) -> Column:
    """Null for a page that passes."""
    rules = [(has(url, p), F.lit(f"Excluded utility or sitemap URL pattern ({P.script(p)})")) for p in P.EXCLUDED_URLS]
    rules.append((trim(F.coalesce(text, F.lit(""))) == "", F.lit("Empty page body text")))
    rules.append((words < P.LEAST_WORDS, F.concat(F.lit("Low word count ("), words.cast("string"), F.lit(f" words < {P.LEAST_WORDS} threshold)"))))
    head = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(text, 1, 1000))
    rules += [(has(head, p), F.lit(f"Soft-404 or HTTP error page detected ({P.script(p)})")) for p in P.ERROR_PAGES]
    return first_of(*rules)
