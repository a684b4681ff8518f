"""Hybrid retrieval: exact dense search, BM25, fusion, selection.

Rankings carry (query, id) and a rank from 1; every order has a tie-break by id
or by the rank before.  Scores that decide an order are rounded to millionths
first, so that engines which add in another order agree.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import patterns as P
from corvane.functions.text import has
from corvane.operators.batches import release, small

TOP, LEAST_DENSE, RRF, CAP, POOL, KEPT = 30, 0.05, 60, 2, 12, 5
LEAST_RERANK, LEAST_TOP, LEAST_TOP_CATALOG = 0.10, 0.05, 0.10
K1, B = 1.2, 0.75
#: queries that are compared with all points at once, their bytes, and the cells of
#: the matrix of queries and terms; more go in several passes
QUERY_BLOCK, QUERY_BYTES, QUERY_CELLS = 4_096, 32_000_000, 32_000_000
#: cells of a matrix that a task works on at once
TASK_CELLS = 2_000_000


def micro(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5).cast("long")


def ranked(rows: DataFrame, order: list[Column], limit: int, by: str = "query") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit)


def _keep(held: np.ndarray, score: np.ndarray, ids: np.ndarray, limit: int, least: float | None) -> np.ndarray:
    """The best `limit` of (score, id) rows and new ones, the lower id on ties."""
    fit = np.isfinite(score)
    if least is not None:
        fit &= score >= math.floor(least * 1e6 + 0.5)
    if len(held) == limit:
        fit &= score >= held[-1, 0]
    at = np.flatnonzero(fit)
    if len(at) > 4 * limit:
        at = at[score[at] >= np.partition(score[at], len(at) - limit)[len(at) - limit]]
    both = np.concatenate([held, np.stack([score[at].astype(np.int64), ids[at]], 1)])
    return both[np.lexsort((both[:, 1], -both[:, 0]))[:limit]]


_FOUND = "query long, id long, score long"
_FOUND_SCHEMA = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _rows(names: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
    many = np.array([len(h) for h in held], np.int64)
    rows = np.concatenate(held) if len(held) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, many)), pa.array(rows[:, 1]), pa.array(rows[:, 0])], schema=_FOUND_SCHEMA)


def _hopeful(score: np.ndarray, held: list[np.ndarray], limit: int, least: float | None) -> np.ndarray:
    """The queries that get something better than what they hold."""
    low = np.array([h[-1, 0] if len(h) == limit else -np.inf for h in held])
    if least is not None:
        low = np.maximum(low, math.floor(least * 1e6 + 0.5))
    with np.errstate(invalid="ignore"):
        return np.flatnonzero((score >= low[:, None]).any(axis=1))


def _best(block, limit: int, least: float | None):
    """Scores a partition's points against a block of queries (a broadcast of
    their names and vectors) in matrix products and keeps `limit` a query."""

    def run(batches):
        names, queries = block.value
        size = np.linalg.norm(queries, axis=1)
        held = [np.zeros((0, 2), np.int64) for _ in names]
        step = max(1, min(2_048, TASK_CELLS // len(names)))
        for b in batches:
            lists = b.column("vector")
            ids = np.asarray(b.column("id"))
            n = np.diff(np.asarray(lists.offsets))
            good = np.flatnonzero((n == queries.shape[1]) & ~np.asarray(lists.is_null()))
            for low in range(0, len(good), step):
                at = good[low : low + step]
                own = lists.take(pa.array(at))
                points = np.asarray(own.flatten(), dtype=np.float64).reshape(len(at), -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = queries @ points.T
                    score /= size[:, None] * np.linalg.norm(points, axis=1)[None]
                score *= 1e6
                score += 0.5
                np.floor(score, out=score)
                for q in _hopeful(score, held, limit, least):
                    held[q] = _keep(held[q], score[q], ids[at], limit, least)
        yield _rows(names, held)
        release()

    return run


def _blocks(queries: DataFrame, column: str, most: int):
    """Queries in blocks of some `most`, each as it comes to the driver."""
    parts = max(1, -(-queries.count() // most))
    for k in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == k)
        if rows := block.select("query", column).where(F.col(column).isNotNull()).collect():
            yield rows


def dense(queries: DataFrame, points: DataFrame, limit: int = TOP, least: float | None = LEAST_DENSE) -> DataFrame:
    """query, id, score (millionths), rank: the nearest points (id, vector) of
    each query (query, vector) by cosine.

    Points are read once for each block of queries and never shuffled; a block is
    broadcast, has at most `QUERY_BLOCK` queries and `QUERY_BYTES` bytes, and a task
    sends on `limit` rows a query.  A vector of another size or without length is
    passed over; a query of another size than the first is an error."""
    spark, found = queries.sparkSession, None
    first = queries.where("vector is not null").select(F.size("vector")).head()
    for rows in _blocks(queries, "vector", max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * max(first[0], 1)))) if first else 1):
        block = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
        part = points.select("id", "vector").mapInArrow(_best(block, limit, least), _FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    return ranked(found, [F.desc("score"), F.col("id")], limit)


def dense_with_fallback(queries: DataFrame, points: DataFrame, kept: Column, typed: Column | None = None, limit: int = TOP) -> DataFrame:
    """Dense search under a filter.  A query that finds nothing searches again
    under the page types alone without a least score, then, if types were given
    and still nothing is found, all points; tier tells which search it was."""
    tiers = [dense(queries, points.where(kept), limit).withColumn("tier", F.lit(0))]
    wider = points if typed is None else points.where(typed)
    tiers.append(dense(queries, wider, limit, None).withColumn("tier", F.lit(1)))
    if typed is not None:
        tiers.append(dense(queries, points, limit, None).withColumn("tier", F.lit(2)))
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.union(t)
    first = Window.partitionBy("query")
    return rows.withColumn("first", F.min("tier").over(first)).where("tier = first").drop("first")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9À-ɏ]+"), 0)


_WORD = re.compile("[a-z0-9À-ɏ]+")


def split_words(text: str | None) -> list[str]:
    """What `tokens` gives, for Python code."""
    return _WORD.findall((text or "").lower())


def term_stats(docs: DataFrame) -> DataFrame:
    """term, df: in how many documents (id, text) a term is."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _postings(block):
    """Of each document its length and its terms among those of a block of queries
    (a broadcast), with their counts."""
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        terms = block.value[1]
        for b in batches:
            ids, texts = b.column("id"), b.column("text").to_pylist()
            sizes, at, many, ends = [], [], [], [0]
            for text in texts:
                words = split_words(text)
                found = [(terms[w], c) for w, c in Counter(words).items() if w in terms]
                sizes.append(len(words))
                at += [t for t, _ in found]
                many += [c for _, c in found]
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, many))], schema=schema)

    return run


def _scored(block, idf: np.ndarray, mean: float, limit: int):
    """Scores a partition's postings against a block of queries: the weights of
    some documents' terms times the queries' terms, and the best of each."""

    def run(batches):
        names, terms, (ptr, which) = block.value
        held = [np.zeros((0, 2), np.int64) for _ in names]
        for b in batches:
            ids, sizes = np.asarray(b.column("id")), np.asarray(b.column("size"))
            for low in range(0, len(ids), 512):
                part = b.slice(low, 512)
                lists = part.column("terms")
                row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                at, tf = np.asarray(lists.flatten()), np.asarray(part.column("counts").flatten())
                # only terms that some of these documents have take part
                used, place = np.unique(at, return_inverse=True)
                weight = np.zeros((len(lists), len(used)))
                weight[row, place] = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[low : low + 512][row] / mean))
                column = np.full(len(terms), -1)
                column[used] = np.arange(len(used))
                step = max(1, TASK_CELLS // max(len(used), len(lists)))
                for first in range(0, len(names), step):
                    ends = ptr[first : first + step + 1]
                    asks = column[which[ends[0] : ends[-1]]]
                    own = np.zeros((len(ends) - 1, len(used)))
                    own[np.repeat(np.arange(len(ends) - 1), np.diff(ends))[asks >= 0], asks[asks >= 0]] = 1
                    score = np.floor(own @ weight.T * 1e6 + 0.5)
                    score[own @ (weight > 0).T.astype(float) == 0] = np.nan
                    kept = held[first : first + step]
                    for q in _hopeful(score, kept, limit, None):
                        held[first + q] = _keep(kept[q], score[q], ids[low : low + 512], limit, None)
        yield _rows(names, held)
        release()

    return run


def bm25(queries: DataFrame, docs: DataFrame, limit: int = TOP) -> DataFrame:
    """query, id, score (millionths), rank of the best documents (id, text) for
    each query (query, text) that share a term with it.

    For each block of queries texts are read once, into postings of the queries'
    terms; these are kept on disk, counted, and scored, and never shuffled: a task
    sends on counts of terms, then `limit` rows a query.  A block is broadcast and
    has at most `QUERY_BLOCK` queries and `QUERY_CELLS` (query, term) cells."""
    spark, found = queries.sparkSession, None
    mean_terms = queries.agg(F.avg(F.size(F.array_distinct(tokens(F.col("text")))))).head()[0] or 1.0
    for rows in _blocks(queries, "text", max(1, min(QUERY_BLOCK, int((QUERY_CELLS / mean_terms) ** 0.5)))):
        asked = [(r[0], set(split_words(r[1]))) for r in rows]
        terms = {w: i for i, w in enumerate(sorted({w for _, words in asked for w in words}))}
        if not terms:
            continue
        ptr = np.cumsum([0, *(len(words) for _, words in asked)])
        block = spark.sparkContext.broadcast((np.array([q for q, _ in asked], np.int64), terms, (ptr, np.array([terms[w] for _, words in asked for w in words], np.int32))))
        held = docs.select("id", "text").mapInArrow(small(_postings(block), "text"), "id long, size long, terms array<int>, counts array<int>").persist(StorageLevel.DISK_ONLY)
        n, total = held.agg(F.count("*"), F.sum("size")).head()
        df = np.zeros(len(terms))
        for term, count in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():
            df[term] = count
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        part = held.mapInArrow(_scored(block, idf, total / n if total else 1.0, limit), _FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    return ranked(found, [F.desc("score"), F.col("id")], limit)


def containing(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of `questions` (query, text) whose lower-case text is in that of some
    document (id, text).  Texts are read once for each block of questions, which an
    automaton looks for at once; a task sends on each question once."""
    spark, found = questions.sparkSession, None
    lower = questions.select("query", F.lower("text").alias("text"))
    size = lower.agg(F.avg(F.length("text"))).head()[0] or 1.0

    def search(block):
        def run(batches):
            names, texts = block.value
            at, met = {}, set()
            for q, t in zip(names, texts, strict=True):
                at.setdefault(t, []).append(q)
            blank = at.pop("", [])
            automaton = ahocorasick.Automaton()
            for t in at:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for b in batches:
                for text in b.column("text").to_pylist():
                    if text is not None:
                        met.update(blank)
                        if at:
                            for _, t in automaton.iter(text):
                                met.update(at[t])
            yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.int64())], names=["query"])

        return run

    for rows in _blocks(lower, "text", max(1, int(QUERY_BYTES / 4 // size))):
        block = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        part = docs.select(F.lower("text").alias("text")).mapInArrow(small(search(block), "text"), "query long")
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], "query long") if found is None else found.distinct()


def fuse(one: DataFrame, two: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of a dense and a sparse ranking; 999 stands for the
    rank on the side that a point isn't on."""
    a, b = one.select("query", "id", F.col("rank").alias("dense_rank")), two.select("query", "id", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    rows = a.join(b, ["query", "id"], "full_outer").withColumn("raw", part("dense_rank") + part("sparse_rank"))
    rows = rows.fillna(999, ["dense_rank", "sparse_rank"])
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("raw"), "dense_rank", "sparse_rank", "id"))
    return rows.select("query", "id", "dense_rank", "sparse_rank", micro(F.col("raw")).alias("score"), place.alias("rank"))


def interleave(lists: DataFrame) -> DataFrame:
    """One ranking of several (query, entity, rank, id): by rank, then entity,
    each id at its first place."""
    first = lists.groupBy("query", "id").agg(F.min(F.struct("rank", "entity")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("at", "id"))
    return first.select("query", "id", F.col("at.entity").alias("entity"), place.alias("rank"))


def diverse(rows: DataFrame, cap: int = CAP, limit: int = POOL) -> DataFrame:
    """At most `cap` of one URL (else parent, else id), then the first `limit`."""
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(blank("url"), blank("parent_id"), F.col("id").cast("string"))
    own = F.row_number().over(Window.partitionBy("query", key).orderBy("rank", "id"))
    return ranked(rows.withColumn("own", own).where(F.col("own") <= cap).drop("own"), [F.col("rank"), F.col("id")], limit)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def four(x: Column) -> Column:
    """Rounded to four places, as whole ten-thousandths."""
    return F.floor(x * 1e4 + 0.5).cast("long")


def calibrated(provider: str, score: Column, logits: bool = True) -> Column:
    """A provider's score on the scale from 0 to 1."""
    if provider == "jina":
        return F.when(F.lit(logits) | ~score.between(0, 1), logistic(score)).otherwise(score)
    if provider == "bge":
        safe = F.greatest(F.least(score, F.lit(0.999999)), F.lit(1e-10))
        return logistic((F.log(safe / (1 - safe)) + 4.5) / 1.5)
    return score


def chain(fused: Column, *scores: Column) -> Column:
    """The first provider's score there is, in order, else the fused one, which
    is always below the gate."""
    return F.coalesce(*scores, fused)


def model_score(reply: Column, rank: Column, fused: Column, default: float = 0.8) -> Column:
    """A candidate's score in a model's reply, a JSON list: that of the first entry
    that names its place, from 0 or from 1, else of the entry at its place, else
    the default.  A reply without a list leaves the fused score."""
    entries = F.from_json(F.nullif(F.regexp_extract(reply, r"\[[\s\S]*\]", 0), F.lit("")), "array<string>")
    place = lambda e: F.coalesce(*(F.get_json_object(e, f"$.{n}").try_cast("int") for n in ("index", "chunk", "item")))
    named = F.filter(entries, lambda e: place(e).isin(0) & (rank == 1) | (place(e) == rank - 1) | (place(e) == rank))
    entry = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(entries, rank.cast("int")))
    value = F.coalesce(entry.try_cast("double"), F.get_json_object(entry, "$.score").try_cast("double"), F.lit(default))
    return F.when(entries.isNull(), F.coalesce(fused, F.lit(default))).otherwise(F.floor(value * 1e4 + 0.5) / 1e4)


def top_n(rows: DataFrame, n: int = 10) -> DataFrame:
    """What a provider that gives its `n` best returns of each query's candidates."""
    return ranked(rows.withColumnRenamed("rank", "before"), [F.desc_nulls_last("score"), F.col("before"), F.col("id")], n).drop("before")


def scored_text(contextual: Column, text: Column) -> Column:
    """What a scorer reads of a candidate."""
    return F.coalesce(F.nullif(contextual, F.lit("")), F.nullif(text, F.lit("")), F.lit(""))


def scored_query(query: Column) -> Column:
    """A query without the hypothetical document behind its first blank line."""
    return F.trim(F.split(query, "\n\n")[0])


def ladder(rank: Column, floor: float) -> Column:
    """Scores that fall with the rank, for want of a model."""
    return F.greatest(0.85 - (rank - 1) * 0.02, F.lit(floor))


def select(rows: DataFrame) -> DataFrame:
    """The five best scored at 0.10 or more, else the three best (query, id,
    rank, score).  Where all scores are 0 or absent the ranks decide."""
    best = F.max(F.coalesce("score", F.lit(0.0))).over(Window.partitionBy("query"))
    rows = rows.withColumn("score", F.when(best <= 0, ladder(F.col("rank"), 0.75)).otherwise(F.col("score")))
    some = F.max((F.col("score") >= LEAST_RERANK).cast("int")).over(Window.partitionBy("query")) == 1
    rows = rows.withColumn("some", some).where(~F.col("some") | (F.col("score") >= LEAST_RERANK)).withColumnRenamed("rank", "before")
    rows = ranked(rows, [F.desc_nulls_last("score"), F.col("before"), F.col("id")], KEPT)
    return rows.where(F.col("some") | (F.col("rank") <= 3)).drop("some", "before")


def gate(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """query, top, abstained: whether the best score is too low to answer; more
    is asked of a question about the catalog."""
    top = selected.groupBy("query").agg(F.max("score").alias("top"))
    least = F.when(has(F.col("text"), P.CATALOG_QUERY), LEAST_TOP_CATALOG).otherwise(LEAST_TOP)
    rows = queries.select("query", "text").join(top, "query", "left")
    return rows.select("query", F.coalesce("top", F.lit(0.0)).alias("top"), (F.col("top").isNull() | (F.col("top") < least)).alias("abstained"))


def parents(rows: DataFrame, compat: bool = True) -> DataFrame:
    """The first child of each parent, with the parent's text.  Parent ids are
    not unique across pages; with compat=False a parent belongs to its URL."""
    key = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.col("id").cast("string"))
    keys = [key] if compat else [F.coalesce("url", F.lit("")), key]
    own = F.row_number().over(Window.partitionBy("query", *keys).orderBy("rank", "id"))
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("parent_text", "contextual_text", "text")])
    return rows.withColumn("text", text).withColumn("own", own).where("own = 1").drop("own")


def context(rows: DataFrame, limit: int = 8_000) -> DataFrame:
    """query, context: the first five results as numbered blocks, cut at `limit`
    characters with a mark."""
    said = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Page"))), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("Type: "), "page_type"), said("Emails", F.col("emails")), said("Phones", F.col("phones")), F.lit(""), F.col("text"))
    top = rows.where(F.col("rank") <= KEPT).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("block")))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b, i: F.concat(F.lit("RESULT "), (i + 1).cast("string"), F.lit(":\n"), b["block"])), "\n\n---\n\n")
    return top.select("query", F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n...[truncated]"))).otherwise(text).alias("context"))


def evaluate(golden: DataFrame, results: DataFrame, gated: DataFrame) -> DataFrame:
    """One row: recall at 1 and 5 and mean reciprocal rank over the questions
    that have an answer, and how often the others were rightly declined.

    golden: query, keywords, should_abstain; results: query, rank, text."""
    hit = F.exists("keywords", lambda k: F.contains(F.lower("text"), F.lower(k)))
    found = results.join(golden, "query").where(hit).groupBy("query").agg(F.min("rank").alias("rank"))
    rows = golden.join(gated.select("query", "abstained"), "query", "left").join(found, "query", "left")
    rank = F.when(~F.col("abstained") & ~F.col("should_abstain"), F.col("rank"))
    inside, outside = F.sum((~F.col("should_abstain")).cast("long")), F.sum(F.col("should_abstain").cast("long"))
    share = lambda x, n: F.when(n > 0, micro(F.coalesce(x, F.lit(0)) / n))
    return rows.agg(
        F.count("*").alias("queries"), share(F.sum((rank == 1).cast("long")), inside).alias("recall_1"), share(F.sum((rank <= 5).cast("long")), inside).alias("recall_5"), share(F.sum(1.0 / rank), inside).alias("mrr"),
        share(F.sum((F.col("should_abstain") & F.col("abstained")).cast("long")), outside).alias("abstention"),
    )
