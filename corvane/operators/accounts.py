"""Usage, cost, feedback and ingest bookkeeping: append logs and what is latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import patterns as P

MEASURES = ("input_tokens", "output_tokens", "cache_tokens")
COSTS = ("input_cost", "output_cost", "cache_cost", "total_cost")


def tokens(given: Column, usage: Column) -> Column:
    """The tokens that a provider's usage struct states, else those given."""
    return F.struct(
        F.coalesce(usage["prompt_tokens"], given["input_tokens"]).alias("input_tokens"), F.coalesce(usage["completion_tokens"], given["output_tokens"]).alias("output_tokens"),
        F.coalesce(usage["prompt_tokens_details"]["cached_tokens"], usage["cache_tokens"], given["cache_tokens"]).alias("cache_tokens"),
    )


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(P.RATES), "model string, per_request double, per_input double, per_output double, per_cache double")


def costs(usage: DataFrame) -> DataFrame:
    """`usage` (model and the three token counts) with its four costs in
    hundred-millionths of a dollar.  A model without rates has the default ones;
    one with a price a request has nothing else; cached tokens aren't also
    input."""
    rows = usage.join(F.broadcast(rates(usage.sparkSession)), "model", "left")  # a dozen rows
    rate = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("per_request", "per_input", "per_output", "per_cache"), P.DEFAULT_RATE, strict=True)}
    fixed, n = rate["per_request"] > 0, {c: F.coalesce(F.col(c), F.lit(0)) for c in MEASURES}
    each = {"input_cost": F.greatest(n["input_tokens"] - n["cache_tokens"], F.lit(0)) * rate["per_input"], "output_cost": n["output_tokens"] * rate["per_output"], "cache_cost": n["cache_tokens"] * rate["per_cache"]}
    each = {k: F.when(fixed, 0.0).otherwise(v) for k, v in each.items()}
    each["total_cost"] = F.when(fixed, rate["per_request"]).otherwise(each["input_cost"] + each["output_cost"] + each["cache_cost"])
    return rows.select(*usage.columns, *(F.floor(each[c] * 1e8 + 0.5).cast("long").alias(c) for c in COSTS))


def totals(costed: DataFrame) -> DataFrame:
    """Calls, tokens and costs of each bot."""
    return costed.groupBy("bot").agg(F.count("*").alias("calls"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in (*MEASURES, *COSTS)))


def records(usage: DataFrame) -> DataFrame:
    """Each bot's usage records with their place, the newest first."""
    newest = Window.partitionBy("bot").orderBy(F.desc("ts"), F.desc("event_id"))
    return usage.withColumn("place", F.row_number().over(newest))


def log_rows(turns: DataFrame) -> DataFrame:
    """The analytics log: twelve fields of each turn (bot_id, session_id, ts, ...),
    defaults where one is null.  A turn on a path that isn't known isn't logged."""
    given = {"session_id": "", "detected_lang": "eng", "is_non_english": False, "intent": "general", "rag_path": "semantic", "query_text": "", "translated_query": "", "reply_text": "", "chunks_retrieved": 0, "guardrail_fired": False}
    rows = turns.select("bot_id", "ts", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in given.items()), F.when(F.col("feedback").isin("up", "down"), F.col("feedback")).alias("feedback"))
    return rows.where(F.col("bot_id").isNotNull() & F.col("rag_path").isin(*P.LOGGED_PATHS))


def documents_of(documents: DataFrame, bots: DataFrame) -> DataFrame:
    """Documents of the named bots (bot_id), with what the bots' rows say of them."""
    return documents.join(bots, "bot_id")


def upsert_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by (bot_id, url): a field that `new` has replaces what is stored,
    one that is null or absent leaves it.  `new` has one row a document."""
    key, old, now = ["bot_id", "url"], stored.alias("old"), new.alias("new")
    rows = old.join(now, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], "full_outer")
    fields = list(dict.fromkeys([*stored.columns, *new.columns]))
    both = lambda c: F.coalesce(*(F.col(f"{side}.{c}") for side, f in (("new", new), ("old", stored)) if c in f.columns)).alias(c)
    return rows.select(*map(both, fields))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate, so a key with very many rows is
    reduced before it is shuffled."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("corvane_last")).select("corvane_last.*")


def feedback(logs: DataFrame, votes: DataFrame) -> DataFrame:
    """`logs` (log_id, ...) with the last valid vote (log_id, thumbs, ts, seq);
    votes on unknown logs are dropped."""
    good = latest(votes.where(F.col("thumbs").isin("up", "down")), ["log_id"], ["ts", "seq"])
    return logs.join(good.select("log_id", F.col("thumbs").alias("feedback")), "log_id", "left")


def ingest_status(pages: DataFrame) -> DataFrame:
    """status of each normalised page: failed, skipped or completed."""
    return pages.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("completed"))


def business_name(pages: DataFrame) -> DataFrame:
    """The first page's title up to its first dash or bar, if that page was
    completed.  Columns page_no, title, status."""
    first = pages.agg(F.min_by(F.struct("title", "status"), "page_no").alias("p"))
    name = F.trim(F.regexp_extract("p.title", "^([^-|–]*)", 1))
    return first.select(F.when(F.col("p.status") == "completed", F.nullif(name, F.lit(""))).alias("business_name"))
