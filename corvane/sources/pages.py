"""Reading pages, sitemaps and links; writing points and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import urls as U
from corvane.functions.patterns import java
from corvane.operators.accounts import latest

MOST_PAGES, MOST_CHILDREN, MOST_DEPTH = 500, 15, 2
_LOC = java(r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*(https?://[^\s\]<]+)\s*(?:\]\]>)?\s*</loc>")


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A table of fetched pages; only the named columns are read."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def locations(sitemaps: DataFrame, site: str) -> DataFrame:
    """place, url, is_map of each location in sitemaps (place, xml): maps, and
    crawlable pages of the site."""
    rows = sitemaps.select("place", F.posexplode(F.regexp_extract_all("xml", F.lit(_LOC), 1)).alias("pos", "url"))
    child = F.col("url").endswith(".xml") | F.contains("url", F.lit("sitemap"))
    return rows.withColumn("is_map", child).where(child | (U.same_domain(F.col("url"), F.lit(site)) & U.is_crawlable(F.col("url"))))


def sitemap(fetched: DataFrame, root: str, site: str) -> DataFrame:
    """Pages reached from one sitemap among those fetched (address, xml), going
    into at most 15 child maps a level and two levels deep."""
    at, pages = fetched.where(F.col("address") == root), None
    for depth in range(MOST_DEPTH + 1):
        found = locations(at.select(F.col("address").alias("place"), "xml"), site)
        own = found.where(~F.col("is_map")).select(F.lit(depth).alias("depth"), "place", "pos", "url")
        pages = own if pages is None else pages.union(own)
        if depth < MOST_DEPTH:
            maps = found.where("is_map").groupBy("url").agg(F.min(F.struct("place", "pos")).alias("first")).orderBy("first").limit(MOST_CHILDREN)
            at = fetched.join(maps.select(F.col("url").alias("address")), "address", "left_semi")
    return pages.groupBy("url").agg(F.min(F.struct("depth", "place", "pos")).alias("first")).select("url", "first.depth")


def discover(fetched: DataFrame, site: str, robots: list[str] = ()) -> str | None:
    """The first of the usual addresses, then of those that robots.txt names,
    whose map gives a page."""
    for at in [*(f"{site}/{p}" for p in ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "xmlsitemap.php")), *robots]:
        if not sitemap(fetched, at, site).isEmpty():
            return at
    return None


def queue(pages: DataFrame, order: str, limit: int = MOST_PAGES) -> DataFrame:
    """The first crawlable addresses by a number that tells when they were found,
    each once, with their place."""
    first = pages.groupBy("url").agg(F.min(order).alias("first")).where(U.is_crawlable(F.col("url"))).orderBy("first", "url").limit(limit)
    return first.select("url", F.row_number().over(Window.orderBy("first", "url")).alias("place"))


def not_visited(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Addresses (url) that weren't fetched yet."""
    return found.join(visited.select("url").distinct(), "url", "left_anti")


def upsert(stored: DataFrame | None, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """What is stored with `new` over it: the last row of each key."""
    return latest(new if stored is None else stored.unionByName(new, allowMissingColumns=True), key, order)


def write_points(points: DataFrame, path: str) -> None:
    """Points by bot, so that a bot's are read alone."""
    points.write.mode("overwrite").partitionBy("bot_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def open_points(spark: SparkSession, path: str, size: int) -> DataFrame | None:
    """The stored points; None where there are none yet, or where their vectors
    have another size and they are to be written anew."""
    from pyspark.errors import AnalysisException

    try:
        points = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    # all of a collection are of one size, as `with_vectors` sees to
    first = points.where("vector is not null").select(F.size("vector")).head()
    return points if first is None or first[0] == size else None


def with_vectors(points: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """`points` with the vector of their text (text, vector).  Texts are looked
    up once each; a vector of another size is an error."""
    held = vectors.dropDuplicates(["text"]).select("text", F.when(F.size("vector") == size, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector must have {size} numbers"))).alias("vector"))
    return points.join(held, "text", "left")


def require_points(points: DataFrame) -> DataFrame:
    """`points`; an error if an ingest gave none."""
    if points.isEmpty():
        raise ValueError("no page gave a point")
    return points


def drop_bot(points: DataFrame, bot: str) -> DataFrame:
    """All points but a bot's."""
    return points.where(F.col("bot_id") != bot)
