"""Quality rules combined by weak supervision.

Each rule votes good, bad or abstains.  Expectation-maximisation over all
documents estimates the share of good ones and, for each rule, how it votes on
good and on bad ones; the posterior probability of "good" given the votes
replaces all-must-pass filtering.  Documents enter the estimate as counts of
vote patterns, at most 3 to the power of the number of rules, so what reaches
the driver doesn't grow with the corpus.

A null or empty text has no word and no line, measures 0 everywhere and fails
the length rule; equal texts vote alike; an empty table has no row and the model
keeps its starting values; other columns pass through `measure` untouched, but one
that has a measure's name gets underscores behind it until nothing else has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import words as W

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: the order of the votes in `measures`
RULES = ("length", "word length", "symbols", "duplicate lines", "repeated passages", "commonest word", "letters", "variety")
_SYMBOL, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The measures of each row, and its votes (1, 0, -1 by rule)."""
    n = len(offsets) - 1
    starts, ends = W.words(data, offsets)
    row = W.rows_of(starts, offsets)
    h = W.hashes(data, starts, ends)
    point = np.concatenate([[0], np.cumsum(W.code_points(data))])
    count = lambda at, weights=None: np.bincount(at, weights=weights, minlength=n).astype(np.int64)
    m = {"n_words": count(row), "word_chars": count(row, point[ends] - point[starts]), "n_symbols": _per_row(_SYMBOL[data], offsets)}

    line_s, line_e = W.runs(data != 0x0A, offsets)
    cum = np.concatenate([[0], np.cumsum(~W._SPACE[data])])
    full = cum[line_e] > cum[line_s]
    line_s, line_e = line_s[full], line_e[full]
    line_row = W.rows_of(line_s, offsets)
    _, first = np.unique(_in_row(W.hashes(data, line_s, line_e), line_row), return_index=True)
    lines = count(line_row)
    m["n_dup_lines"] = lines - count(line_row[first])

    window, whole = W.windows(h, row, 5)
    at = np.flatnonzero(whole)
    _, which, times = np.unique(_in_row(window[at], row[at]), return_inverse=True, return_counts=True)
    edge = np.zeros(len(h) + 6, np.int64)
    again = at[times[which] > 1]
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 5, -1)
    m["n_repeat_words"] = count(row[np.cumsum(edge)[: len(h)] > 0])

    _, first, times = np.unique(_in_row(h, row), return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[first], times)
    variety = count(row[first])

    with np.errstate(divide="ignore", invalid="ignore"):
        words = np.maximum(m["n_words"], 1).astype(float)
        mean, symbols = m["word_chars"] / words, m["n_symbols"] / words
        dup, repeat = m["n_dup_lines"] / np.maximum(lines, 1), m["n_repeat_words"] / words
        common, kinds = top / words, variety / words
        letters = _per_row(_LETTER[data], offsets) / np.maximum(_per_row(~W._SPACE[data], offsets), 1)
    enough = m["n_words"] >= 20
    vote = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    votes = np.stack([
        vote(m["n_words"] < 10, m["n_words"] >= 30),
        vote((mean < 2.5) | (mean > 15), (mean >= 3.5) & (mean <= 10)),
        vote(symbols > 0.1, symbols < 0.02),
        vote((dup > 0.3) & (m["n_dup_lines"] >= 3), (dup < 0.05) & (lines >= 3)),
        vote(repeat > 0.2, (repeat < 0.05) & enough),
        vote((common > 0.25) & enough, (common < 0.15) & enough),
        vote(letters < 0.7, letters > 0.9),
        vote((kinds < 0.2) & enough & (words < 2000), (kinds > 0.4) & enough),
    ])
    return m, votes


#: names that `measure` and `judge` give
_OWN = frozenset([*MEASURES, "votes", "posterior", "base_failed", "kept"])


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with the measures and a column votes: the pattern as a number in
    base 3, first rule last."""
    for name in docs.columns:
        if name.lower() in _OWN:
            taken = {c.lower() for c in docs.columns} | _OWN
            free = name
            while free.lower() in taken:
                free += "_"
            docs = docs.withColumnRenamed(name, free)
    kept = docs.schema
    out = T.StructType([*kept.fields, *(T.StructField(c, T.LongType()) for c in MEASURES), T.StructField("votes", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for rows in W.slices(batch):
                m, votes = measures(*W.flat(rows.column("text")))
                code = (votes.astype(np.int64) + 1).T @ 3 ** np.arange(len(RULES))
                columns = [*rows.columns, *(pa.array(m[c], pa.int64()) for c in MEASURES), pa.array(code, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept.names, *MEASURES, "votes"])

    return docs.mapInArrow(W.frugal(run), out)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, trust: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """EM on vote patterns (rows of -1, 0, 1) with their counts.

    Returns the share of good documents, P(vote | class, not abstaining) as
    [class, rule, vote] with class 0 bad and votes in the order bad, good, and
    the posterior of good for each pattern.  An abstention says nothing.  The
    starting table, weighing `trust` of the corpus, stays as a prior, so classes
    can't swap or collapse."""
    rules = patterns.shape[1]
    start = np.tile(np.array([[[0.45, 0.55]], [[0.01, 0.99]]]), (1, rules, 1))
    share, table, total = 0.85, start.copy(), counts.sum()
    votes = np.stack([patterns == -1, patterns == 1], axis=2).astype(float)
    post = np.full(len(patterns), share)
    for _ in range(rounds + 1):
        logs = np.einsum("prv,crv->pc", votes, np.log(table)) + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if not total:
            break
        mass = np.stack([counts * (1 - post), counts * post])
        seen, weight = np.einsum("cp,prv->crv", mass, votes), trust * total
        table = (seen + weight * start) / (seen.sum(2, keepdims=True) + weight)
        share = float((mass[1].sum() + weight * 0.85) / (total + weight))
    return share, table, post


def _patterns(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1


def fit(measured: DataFrame) -> DataFrame:
    """votes, posterior: one row for each pattern that occurs."""
    # at most 3 ** len(RULES) rows
    found = measured.groupBy("votes").count().orderBy("votes").collect()
    codes = np.array([r[0] for r in found], np.int64)
    _, _, post = estimate(_patterns(codes), np.array([r[1] for r in found], float))
    return measured.sparkSession.createDataFrame(list(zip(codes.tolist(), post.tolist(), strict=True)), "votes int, posterior double")


def judge(measured: DataFrame, model: DataFrame, least: float = 0.5) -> DataFrame:
    """`measured` with base_failed, posterior and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # the model has at most 3 ** len(RULES) rows
    return measured.join(F.broadcast(model), "votes").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
