"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import mixing, packing, quality, secrets, similar, store
from corvane.sources.spread import spread

CAPACITY = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised rules reject."""
    model = quality.fit(quality.measure(docs.select("text")))
    own = [f"_{c}" for c in docs.columns]
    # other columns under names that can't clash with a measure's
    renamed = docs.select(F.col("text"), *(F.col(c).alias(o) for c, o in zip(docs.columns, own, strict=True) if c != "text"))
    kept = quality.judge(quality.measure(renamed), model).where("kept")
    return kept.select(*(F.col("text") if c == "text" else F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of equal or similar ones."""
    return similar.firsts(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document goes."""
    import public_tokenizers

    return secrets.redact(docs, words=public_tokenizers.path("byte_bpe_50k.json"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the mix: none, once, or up to three times, each time a
    row."""
    key, times, turn = (store.fresh(docs, f"corvane_{c}") for c in ("id", "times", "turn"))
    placed = mixing.mix(docs).where(F.array_size("places") > 0).select(F.col("doc_id").alias(key), F.array_size("places").alias(times))
    # repeated rows are placed alike, so one plan row an id serves them all
    plan = store.keep(placed.groupBy(key).agg(F.max(times).alias(times)), "mix-plan")
    taken = docs.join(store.small(plan, similar.FEW), F.col("doc_id").eqNullSafe(F.col(key)))
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences: one row for each piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "leading", end=0, capacity=CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("best_fit", best_fit),
]

#: Expectation-maximisation, the join's recursion, the forest and the packing
#: have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
