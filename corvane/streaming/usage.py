"""Usage facts as a stream: windowed cost of each bot, and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import accounts


def windowed(usage: DataFrame, late: str = "10 minutes", wide: str = "1 hour") -> DataFrame:
    """Calls and total cost of each bot and window of event time `ts`; rows later
    than the watermark are dropped.  Works on streams and on tables."""
    rows = accounts.costs(usage).withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", wide).alias("w"), "bot").agg(F.count("*").alias("calls"), F.sum("total_cost").alias("total_cost"))
    return sums.select(F.col("w.start").alias("start"), "bot", "calls", "total_cost")


def _manifest(spark: SparkSession, path: str, batch: int) -> dict[int, int] | None:
    """Of each bucket the batch that wrote it last, as of a batch; None if that
    batch was never finished."""
    try:
        return dict(map(tuple, spark.read.parquet(f"{path}/manifest/{batch}").select("bucket", "batch").collect()))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upserted(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """The table as it was after a batch; None if nothing was ever written."""
    held = _manifest(spark, path, batch)
    if held is None:
        raise ValueError(f"{path} has no finished batch {batch}")
    return _read(spark, path, held, set(held))


def _read(spark: SparkSession, path: str, held: dict[int, int], buckets: set[int]) -> DataFrame | None:
    at = [f"{path}/data/batch={held[k]}/bucket={k}" for k in sorted(buckets & set(held))]
    return spark.read.parquet(*at) if at else None


def upserter(path: str, key: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key.

    Rows lie in `buckets` by a hash of the key; a batch writes those buckets anew
    that it has rows for, then a manifest of where every bucket is, which makes it
    count.  A batch that runs again starts from the same one before and writes the
    same.  A batch whose predecessor has no manifest, and batch 0 where batch 1 is
    there, are errors: never is a lost state taken for an empty one."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, number - 1) if number else {}
        if before is None:
            raise ValueError(f"{path} has no finished batch {number - 1} before batch {number}")
        if number == 0 and _manifest(spark, path, 1) is not None:
            raise ValueError(f"{path} is of a stream that is further; a new stream needs a new path")
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket", bucket).persist()
        try:
            touched = {r[0] for r in rows.select("bucket").distinct().collect()}  # at most `buckets`
            old = _read(spark, path, before, touched)
            if old is not None:
                rows_all = rows.drop("bucket").unionByName(old).withColumn("bucket", bucket)
            else:
                rows_all = rows
            last = accounts.latest(rows_all, [*key, "bucket"], order)
            last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
        finally:
            rows.unpersist()
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")

    return run
