"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths, what attention within documents costs).  A piece goes
to an open sequence that can take it under all three and scores best, by the
least weighted norm of what would remain ("norm") or the largest weighted
dot-product of its needs and what is left ("dot"); a new one opens where none
can.  Pieces come longest first.

Equal lengths have equal needs, so the plan is made on counts: at most
`capacity` lengths, and open sequences with the same residual vector are one
entry with a number.  One step places as many pieces as the entry has
sequences.  The plan is a list of runs (length, first rank, number, first
sequence, offset), whose size follows the number of different lengths and not
of documents; workers look up each piece by its rank among those of its
length.  Ranks come from per-task counters and one prefix sum over (task,
length), so no length is gathered in one task, however many pieces share it.

A null text is an empty one, which is a piece of one id, the end; equal rows are
packed one by one; an empty table gives no row; columns other than doc_id and
text are ignored.  A text is cut only where it is longer than what one sequence can
take by tokens and by attention, from its end, so only its first piece may be
shorter.  A capacity below 1 and an unknown score are errors before any work.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import store
from corvane.llm import words as W
from corvane.llm.encode import batch_of, encoded

SCORES = ("norm", "dot")
_PIECES = "task int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"


def pieces_of(docs: DataFrame, tokenizer: str, pieces: str, end: int, capacity: int) -> DataFrame:
    """A row for each piece; rank counts equal lengths within a task."""
    schema = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("rank", pa.int64())])

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows, values, ends in encoded(batches, tokenizer, pieces):
            n = rows.num_rows
            ids = np.insert(values[0], ends[1:], end).astype("<u4")
            total = np.diff(ends) + 1
            ends = ends[1:] + np.arange(1, n + 1)
            count = -(-total // capacity)
            row = np.repeat(np.arange(n), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            stop = total[row] - (count[row] - 1 - piece) * capacity
            start = np.maximum(stop - capacity, 0)
            length = stop - start
            first = (ends - total)[row]
            crc = np.array([zlib.crc32(ids[a:b]) for a, b in zip((first + start).tolist(), (first + stop).tolist(), strict=True)], np.int64)
            order = np.argsort(length, kind="stable")
            own = length[order]
            head = np.flatnonzero(np.diff(own, prepend=-1))
            many = np.diff(np.append(head, len(own)))
            rank = np.empty(len(own), np.int64)
            rank[order] = seen[own] + np.arange(len(own)) - np.repeat(head, many)
            seen[own[head]] += many
            yield batch_of(schema, [np.full(len(row), task, np.int32), rows.column("doc_id").take(pa.array(row)), piece.astype(np.int32), start, length.astype(np.int32), crc, rank])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(W.frugal(run), _PIECES)


def plan(counts: dict[int, int], capacity: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm") -> dict[str, np.ndarray]:
    """Runs (length, rank, n, sequence, offset) that place `counts` pieces."""
    limit = np.array([capacity, documents, attention], float)
    room = np.zeros((1024, 3))
    #: of each entry: how many sequences; their numbers are runs of (first, n)
    size = np.zeros(1024, np.int64)
    held: list[list[tuple[int, int]]] = [[] for _ in range(1024)]
    where: dict[tuple, int] = {}
    free = list(range(1023, -1, -1))
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    w = np.array(weights) / limit**2

    def put(left: np.ndarray, runs: list[tuple[int, int]], n: int) -> None:
        nonlocal room, size
        key = tuple(left)
        if key not in where:
            if not free:
                m = len(size)
                room, size = np.concatenate([room, np.zeros((m, 3))]), np.concatenate([size, np.zeros(m, np.int64)])
                held.extend([] for _ in range(m))
                free.extend(range(2 * m - 1, m - 1, -1))
            where[key] = k = free.pop()
            room[k], size[k], held[k] = left, 0, []
        k = where[key]
        held[k] += runs
        size[k] += n

    for length in sorted(counts, reverse=True):
        todo, rank = int(counts[length]), 0
        need = np.array([length, 1, length * length], float)
        if (need > limit).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity")
        while todo:
            fits = np.flatnonzero((room[:, 0] >= need[0]) & (room[:, 1] >= need[1]) & (room[:, 2] >= need[2]) & (size > 0))
            if len(fits):
                left = room[fits]
                value = ((left - need) ** 2 @ w) if score == "norm" else -(left @ (w * need))
                k = int(fits[np.lexsort((left[:, 0], value))[0]])
                before, runs, size[k], held[k] = room[k].copy(), held[k], 0, []
                taken: list[tuple[int, int]] = []
                rest: list[tuple[int, int]] = []
                n = 0
                for first, m in runs:
                    use = min(m, todo - n)
                    if use:
                        taken.append((first, use))
                        n += use
                    if m > use:
                        rest.append((first + use, m - use))
                if rest:
                    held[k], size[k] = rest, sum(m for _, m in rest)
                else:
                    del where[tuple(before)]
                    free.append(k)
                    room[k] = 0
            else:
                # as many new sequences as the pieces fill when each takes all it can
                each = int(min(limit // need))
                n = min(todo, -(-todo // each))
                before, taken = limit.copy(), [(opened, n)]
                opened += n
            offset = int(limit[0] - before[0])
            for first, m in taken:
                out.append((length, rank, m, first, offset))
                rank += m
            todo -= n
            after = before - need
            if after[0] >= 1 and after[1] >= 1 and after[2] >= 1:
                put(after, taken, n)
    table = np.array(out, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "n", "sequence", "offset"), table.T, strict=True)) | {"sequences": np.array(opened)}


def place(pieces: DataFrame, capacity: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm") -> DataFrame:
    """`pieces` with sequence_id and offset.  They must lie in a table, as they
    are read three times."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # one row a task and length: a prefix sum over tasks
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `capacity` rows
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    runs = plan(counts, capacity, documents, attention, weights, score)
    key = runs["length"] * (1 << 44) + runs["rank"]
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], runs["rank"][order], runs["sequence"][order], runs["offset"][order]))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        keys, ranks, sequences, offsets = sent.value
        for rows in batches:
            length = np.asarray(rows.column("length")).astype(np.int64)
            rank = np.asarray(rows.column("rank")) + np.asarray(rows.column("base"))
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            yield batch_of(schema, [rows.column("doc_id"), rows.column("piece"), rows.column("start"), length, rows.column("ids_crc32"), sequences[at] + rank - ranks[at], offsets[at]])

    found = pieces.join(base, ["length", "task"])
    return found.mapInArrow(W.frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, pieces: str, end: int = 0, capacity: int = 2048, documents: int | None = None, attention: int | None = None, **how) -> DataFrame:
    """Packs all documents; a row for each piece.  documents and attention
    default to what never binds before the tokens do."""
    documents, attention = capacity if documents is None else documents, capacity * capacity if attention is None else attention
    if min(capacity, documents, attention) < 1:
        raise ValueError("a sequence must take a token, a document and an attention of 1")
    if how.get("score", "norm") not in SCORES:
        raise ValueError(f"the score must be one of {', '.join(SCORES)}")
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    made = store.keep(pieces_of(docs, tokenizer, pieces, end, min(capacity, math.isqrt(attention))), "pieces", rows=1_000)
    return place(made, capacity, documents, attention, **how)
