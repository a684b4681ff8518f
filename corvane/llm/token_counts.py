"""Offset-mapped token counts of fields or sections.

A document is encoded once, whole.  Its tokens' code-point spans are joined
with its sections' spans by an interval join: both are sorted, so each token
finds the sections it overlaps by binary search.  A token inside one section
counts there.  A token that crosses a boundary is allocated by `rule`:

"most"   to the section with most of its code points, the earlier on a tie;
"start"  to the section in which it begins, else the first it overlaps.

A token that overlaps no section counts as outside.  Sections are disjoint and
ascending; `lines` makes one of each line with its line feed.  Every token
counts exactly once, so counts and outside add up to the tokens of the text.
A null or empty text has no section and no token; repeated rows give repeated
rows; an empty table gives no row; a text of any length is encoded whole;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.encode import batch_of, encoded


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end in code points of each line."""
    cut = np.zeros(len(data), bool)
    cut[1:] = data[:-1] == 0x0A
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    row = W.rows_of(starts, offsets)
    point = np.concatenate([[0], np.cumsum(W.code_points(data))])
    base = point[offsets[row]]
    return row, point[starts] - base, point[ends] - base


def allocate(token_row, token_start, token_end, row, start, end, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """For each token the index of its section, -1 for none, and whether it
    overlaps more than one.  Sections are sorted by row and start."""
    if not len(row):
        return np.full(len(token_row), -1), np.zeros(len(token_row), bool)
    wide = np.int64(1) << 32
    token_end = np.maximum(token_end, token_start + 1)
    # first section that ends after the token's start, last that starts before its end
    first = np.searchsorted(row * wide + end, token_row * wide + token_start, side="right")
    last = np.searchsorted(row * wide + start, token_row * wide + token_end, side="left") - 1
    none = (last < first) | (first >= len(row))
    first = np.minimum(first, len(row) - 1)
    none |= row[first] != token_row
    last = np.where(none, first, last)
    best = first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "most" and len(crossing):
        most = np.minimum(token_end[crossing], end[first[crossing]]) - np.maximum(token_start[crossing], start[first[crossing]])
        for step in range(1, int((last - first).max()) + 1):
            k = np.minimum(first[crossing] + step, last[crossing])
            own = np.minimum(token_end[crossing], end[k]) - np.maximum(token_start[crossing], start[k])
            better = own > most
            best[crossing[better]], most = k[better], np.maximum(most, own)
    return np.where(none, -1, best), ~none & (last > first)


def counts(docs: DataFrame, tokenizer: str, pieces: str, rule: str = "most", sections=lines) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, n_outside, and the tokens of
    each section in order."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_tokens", "n_sections", "n_crossing", "n_outside")), ("section_tokens", pa.list_(pa.int64()))])

    def run(batches):
        for rows, values, ends in encoded(batches, tokenizer, pieces, spans=True):
            n = rows.num_rows
            row, start, end = sections(*W.flat(rows.column("text")))
            token_row = np.repeat(np.arange(n), np.diff(ends))
            which, crossing = allocate(token_row, values[1].astype(np.int64), values[2].astype(np.int64), row, start, end, rule)
            inside = which >= 0
            got = np.bincount(which[inside], minlength=len(row))
            many = np.bincount(row, minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(got, pa.int64()))
            yield batch_of(schema, [rows.column("doc_id"), np.diff(ends), many, np.bincount(token_row[crossing], minlength=n), np.bincount(token_row[~inside], minlength=n), lists])

    out = "doc_id long, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out)
