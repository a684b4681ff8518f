"""The queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hpyp, language, media, mixing, packing, quality, secrets, similar, store, token_counts, token_files
from corvane.sources.spread import spread

BYTE_BPE, WORD_BPE = ("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "words")


def _tokenizer(kind: tuple[str, str]) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(kind[0]), kind[1]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_hpyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four in five."""
    held = F.coalesce(_remainder(5) == 1, F.lit(False))
    return hpyp.score(_documents(spark, sf_dir).withColumn("held", held))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of each document."""
    taken = F.col("size") * F.array_size("places")
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of each document's stored image, by its page."""
    docs, at = _documents(spark, sf_dir), store.place(spark, "media")
    media.save(docs, at)
    found = media.resolve(media.sequences(media.illustrated(docs)), media.features(spark, at))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    return token_counts.counts(_documents(spark, sf_dir), *_tokenizer(BYTE_BPE))


def op5_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal shingle sets, its links and its group."""
    return similar.join(_documents(spark, sf_dir)).drop("cid")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(_documents(spark, sf_dir), *_tokenizer(BYTE_BPE), end=0, capacity=2048)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three in four."""
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(_remainder(4) != 2))
    return language.predict(docs, model).withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, posterior and verdict of each document."""
    measured = store.keep(quality.measure(_documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "quality")
    return quality.judge(measured, quality.fit(measured)).select("doc_id", *quality.MEASURES, "base_failed", "kept", "posterior")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token files, read back."""
    at = store.place(spark, "token-files")
    token_files.write(_documents(spark, sf_dir), at, *_tokenizer(WORD_BPE), end=2)
    return token_files.digests(spark, at)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate secrets of all documents and the forest's verdicts."""
    return secrets.scan(_documents(spark, sf_dir), words=_tokenizer(BYTE_BPE)[0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hpyp, op2_mixing, op3_media, op4_token_counts, op5_similar, op6_packing, op7_language, op8_quality, op9_token_files, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {}
