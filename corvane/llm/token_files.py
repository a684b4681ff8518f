"""Token-ID output: Parquet list columns in ascending doc_id order.

`write` cuts doc_id into ranges of about equal row counts, encodes each range in
order and writes one file a range.  A file has, for each document, its number
of ids and its start in the file as plain columns beside the list column, so
metadata can be read without any id.  Ids are stored by dictionary, or with
encoding="delta" by bit-packed differences; rows a page and bytes a row group
are parameters, and Parquet's page index is there to skip pages by doc_id.

`read` gives a document's ids as they are in the files, `starts` the number of
ids before each document.  A null text is an empty one; a null doc_id sorts
first; equal doc_ids sort by text and all are written; an empty table gives no
row; columns other than doc_id and text are ignored.  A text of any length is
one row of the list column.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import store
from corvane.llm.encode import batch_of, encoded

_FILE = "part int, seq long, doc_id long, n_tokens long, at long, ids array<int>"


def ranged(docs: DataFrame, parts: int, key: str = "doc_id") -> DataFrame:
    """Column part: ranges of `key` with about as many rows each, from quantiles
    that Spark estimates on the key column alone."""
    if parts < 2:
        return docs.withColumn("part", F.lit(0))
    from pyspark.ml.feature import Bucketizer

    found = docs.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).head()[0] or [0]
    cuts = [float("-inf"), *sorted({float(c) for c in found}), float("inf")]
    # by binary search on doubles: conversion keeps the order, so equal doubles share a range
    at, out = store.fresh(docs, "corvane_key"), store.fresh(docs, "corvane_part")
    rows = docs.withColumn(at, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    rows = Bucketizer(splits=cuts, inputCol=at, outputCol=out).transform(rows)
    return rows.withColumn("part", F.col(out).cast("int")).drop(at, out)


def write(docs: DataFrame, path: str, tokenizer: str, pieces: str, end: int, files: int | None = None, encoding: str = "dictionary", group_bytes: int = 32 << 20, page_rows: int = 2_000) -> None:
    """Encodes all documents and writes them under `path`."""
    spark = docs.sparkSession
    files = files or store.parts(spark)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        seq = at = 0
        for rows, values, ends in encoded(batches, tokenizer, pieces):
            n = rows.num_rows
            ids = np.insert(values[0], ends[1:], end)
            ends = (ends + np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
            yield batch_of(schema, [rows.column("part"), seq + np.arange(n), rows.column("doc_id"), np.diff(ends).astype(np.int64), at + ends[:-1].astype(np.int64), lists])
            seq, at = seq + n, at + int(ends[-1])

    rows = ranged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), files)
    rows = rows.repartitionById(files, "part").sortWithinPartitions("part", "doc_id", "text")
    (
        rows.mapInArrow(run, _FILE).write.option("compression", "zstd").option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "v2" if encoding == "delta" else "v1").parquet(path)
    )


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("part", "seq", "doc_id", "n_tokens", "at", "ids")) -> DataFrame:
    """The files' rows; only the named columns are read."""
    return spark.read.schema(_FILE).parquet(path).select(*columns)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Column base: the ids in all files before a part.  One row a file."""
    from pyspark.sql import Window

    sizes = read(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for rows in batches:
            lists = rows.column("ids")
            ends = np.asarray(lists.offsets)
            ids = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield batch_of(schema, [rows.column("part"), rows.column("doc_id"), rows.column("at"), np.diff(ends).astype(np.int64), np.array(crc, np.int64)])

    found = read(spark, path, ("part", "doc_id", "at", "ids")).mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row a file on the small side, at most as many as `files` of write()
    found = found.join(F.broadcast(starts(spark, path)), "part")
    return found.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
