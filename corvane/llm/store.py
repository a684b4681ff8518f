"""Tables that a job writes for its own later steps.

They lie in the folder that the cluster names in spark.checkpoint.dir, so every
executor and the driver reach them, and a lost executor loses nothing.  Where that
setting is absent a temporary folder is made if the master is local, as in a test;
on a cluster it is an error, as executors wouldn't see each other's files.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_job: contextvars.ContextVar[str] = contextvars.ContextVar("job", default="all")
#: names in the catalogue, by job
_tables: dict[str, list[str]] = {}


@contextlib.contextmanager
def job(name: str | None = None) -> Iterator[str]:
    """Within this, tables belong to a job of their own, whose name it gives and
    which `cleanup` can remove by itself."""
    name = name or uuid.uuid4().hex
    token = _job.set(name)
    try:
        yield name
    finally:
        _job.reset(token)


def folder(spark: SparkSession) -> str:
    """The shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="corvane-"))
        at = f"file://{_own[0]}"
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/corvane/{_job.get()}/{name}-{uuid.uuid4().hex}"


def keep(frame: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes `frame` and reads it back: a cut in lineage that survives the loss
    of executors.  `rows` bounds the rows of an Arrow batch while it is made, for
    rows that may be large."""
    spark = frame.sparkSession
    at, key = place(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if rows:
            spark.conf.set(key, str(rows))
        frame.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(frame.schema).parquet(at)


def keep_by(frame: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """Like `keep`, in `parts` buckets by `key`: grouping by the key, or joining
    by it with a side that is shuffled into as many partitions, moves no row of
    this table."""
    spark, at = frame.sparkSession, place(frame.sparkSession, name)
    table = f"corvane_{at.rsplit('/', 1)[1].replace('-', '_')}"
    frame.write.option("compression", "zstd").option("path", at).bucketBy(parts, key).saveAsTable(table)
    _tables.setdefault(_job.get(), []).append(table)
    return spark.table(table)


def labels(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of `parts` partitions a whole number that Spark's hash sends there,
    so that groups named by them spread evenly over partitions and buckets."""
    found, n = {}, 16 * parts + 64
    while len(found) < parts:
        rows = spark.range(n).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("at")).groupBy("at").agg(F.min("id")).collect()
        found, n = dict(map(tuple, rows)), 4 * n
    return np.array([found[k] for k in range(parts)])


def small(frame: DataFrame, rows: int) -> DataFrame:
    """`frame`, to be broadcast if it has at most `rows` rows.  It must lie in a
    table, as it is counted; beyond that Spark shuffles both sides."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def fresh(frame: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `frame` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    """The number of partitions that the session wants of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop(spark: SparkSession, at: str) -> None:
    """Removes what `place` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_frame(frame: DataFrame) -> None:
    """Removes the table behind what `keep` returned."""
    for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        drop(frame.sparkSession, file)


def cleanup(spark: SparkSession, job: str | None = None) -> None:
    """Removes the tables of a job, or of all, from the shared folder; for when no
    result that reads them is needed any more."""
    for own in [job] if job else list(_tables):
        for table in _tables.pop(own, ()):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop(spark, f"{folder(spark)}/corvane" + (f"/{job}" if job else ""))
