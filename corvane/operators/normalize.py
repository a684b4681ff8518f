"""Pages to normalised records: one pass over the tree, then built-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions import urls as U
from corvane.operators import html
from corvane.operators.gate import skip_reason


def normalize(pages: DataFrame, *carried: str) -> DataFrame:
    """url, title, type, text, contacts, headings, metrics, shop metadata, hash,
    and the gate's reason, of pages (columns url, html), with the columns to be
    carried along.  Input that isn't HTML is read as Markdown."""
    rows = html.with_tree(pages.select("url", "html", *carried).withColumn("is_html", X.is_html(F.col("html"))))
    t, raw, web = F.col("tree"), F.col("html"), F.col("is_html")
    ld = F.when(F.coalesce(t["ld_text"], F.lit("")) != "", F.concat(F.lit("## Structured Data (JSON-LD)\n"), t["ld_text"], F.lit("\n\n"))).otherwise("")
    rows = rows.withColumn("text", F.when(web, X.strip_noise(F.concat(ld, F.coalesce(t["markdown"], F.lit(""))))).otherwise(X.trim(F.coalesce(raw, F.lit("")))))
    own = F.nullif(F.when(web, t["title"]).otherwise(X.md_title(raw)), F.lit(""))
    text, scan = F.col("text"), F.when(web, t["body"]).otherwise(F.col("text"))
    rows = rows.withColumn("title", F.coalesce(own, F.nullif(U.host(F.col("url")), F.lit("")), F.nullif(U.path(F.col("url")), F.lit("")), F.lit("Untitled Page")))
    merged = lambda links, found: F.slice(F.array_distinct(F.concat(F.coalesce(links, F.array().cast("array<string>")), found)), 1, 5)
    price = X.price(text)
    rows = rows.select(
        *carried, "url", "title", "text", t["error"].alias("error"),
        F.when(web, U.page_type(F.col("url"), t["ld_types"], t["og"], t["title"], t["body"])).otherwise(U.page_type(F.col("url"))).alias("page_type"),
        merged(t["mails"], X.emails(scan)).alias("emails"), merged(t["calls"], X.phones(scan)).alias("phones"),
        F.when(web, t["headings"]).otherwise(X.md_headings(raw)).alias("headings"), t["links"].alias("links"),
        X.word_count(text).alias("words"), F.when(web, t["tables"]).otherwise(X.md_tables(raw)).alias("tables"), F.when(web, t["code"].cast("double")).otherwise(X.md_code_blocks(raw)).alias("code_blocks"),
        price["price"].alias("price"), price["currency"].alias("currency"), X.page_stock(text).alias("in_stock"), X.page_colors(text).alias("colors"), X.page_sizes(text).alias("sizes"), X.content_hash(text).alias("content_hash"),
    )
    return rows.withColumn("skip_reason", skip_reason(F.col("url"), F.col("title"), F.col("text"), F.col("words")))
