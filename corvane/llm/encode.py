"""Encoding whole texts with a tokenizers file, each distinct piece once.

Both public files cut a text before the merges in a way that no token spans a
boundary between words, so the ids of a text are the ids of its pieces in
order.  Pieces repeat, so a worker encodes each distinct one and keeps it.
`pieces` names the rule that is safe for a file:

"words"    white space makes no ids: a piece is a word.
"leading"  a space belongs to the word after it: a text is cut before single
           ASCII white space that stands between two other characters.  Where
           a neighbour may be Unicode white space it isn't cut.
"whole"    no rule is known; each text is encoded as it is.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from corvane.llm import words as W

#: pieces that a worker keeps at most, and those that it keeps apart
_KEEP, _FEW = 2_000_000, 100_000


def _leading(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        space = W._SPACE[data]
        before, after = data[:-2], data[2:]
        lead = np.zeros(n - 2, np.uint8)
        lead[1:] = data[: n - 3]
        # two-byte characters from U+00C0 on are never white space
        safe = (before < 0x80) | ((lead >= 0xC3) & (lead <= 0xDF))
        safe &= (before > 0x20) & (before != 0x7F)
        safe &= (after > 0x20) & ((after < 0x7F) | ((after >= 0xC3) & (after <= 0xDF)) | (after >= 0xE4))
        cut[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:] & safe
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """ids(data, offsets) of a batch's rows; with spans=True also code-point
    spans."""

    def __init__(self, path: str, pieces: str = "whole", spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pieces, self.spans = pieces, spans
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self):
        """What is known: two tables of keys and slots, the second small, so that
        new pieces don't move all; slot k's ids are values[at[k] : at[k + 1]]."""
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32)) for _ in range(2)]
        self.slots, self.at = 0, np.zeros(1 << 12, np.uint32)
        narrow = not self.spans and self.tokenizer.get_vocab_size() <= 1 << 16
        self.values = np.zeros((3 if self.spans else 1, 1 << 14), np.uint16 if narrow else np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't known."""
        out = np.full(len(keys), -1, np.int64)
        for own, slot in self.known:
            todo = np.flatnonzero(out < 0)
            if len(own) and len(todo):
                place = np.minimum(np.searchsorted(own, keys[todo]), len(own) - 1)
                out[todo] = np.where(own[place] == keys[todo], slot[place].astype(np.int64), -1)
        return out

    def _learn(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Keeps the ids of new ascending keys; their slots."""
        slots, end = self.slots + np.arange(len(keys)), int(self.at[self.slots])
        while self.slots + len(keys) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(len(self.at) // 4 + 1, np.uint32)])
        while end + values.shape[1] > self.values.shape[1]:
            self.values = np.concatenate([self.values, np.zeros((len(self.values), self.values.shape[1] // 4 + 1), self.values.dtype)], axis=1)
        self.at[self.slots + 1 : self.slots + 1 + len(keys)] = end + np.cumsum(counts)
        self.values[:, end : end + values.shape[1]] = values
        self.slots += len(keys)
        few, slot = self.known[1]
        place = np.searchsorted(few, keys)
        self.known[1] = np.insert(few, place, keys), np.insert(slot, place, slots.astype(np.uint32))
        if len(self.known[1][0]) > _FEW:
            (all_, of), (few, slot) = self.known
            place = np.searchsorted(all_, few)
            self.known = [(np.insert(all_, place, few), np.insert(of, place, slot)), (few[:0], slot[:0])]
        return slots

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.spans:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        else:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [x.ids for x in found]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(counts.sum())
        values = np.zeros((3 if self.spans else 1, total), np.int32)
        values[0] = np.fromiter((i for x in ids for i in x), np.int32, total)
        if self.spans:
            values[1:] = np.array([p for x in found for p in x.offsets], np.int32).reshape(-1, 2).T
        return counts, values

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token columns (ids; with spans also starts and ends in code points of
        the row) of all rows in order, and the number of each row's tokens."""
        rows = len(offsets) - 1
        if self.pieces == "whole":
            counts, values = self._encode([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return values, counts
        if self.pieces == "words":
            starts, ends = W.words(data, offsets)
        else:
            starts = _leading(data, offsets)
            ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros((3 if self.spans else 1, 0), np.int32), np.zeros(rows, np.int64)
        distinct, first, which = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
        slot = self._find(distinct)
        if (slot < 0).any():
            if self.slots > _KEEP:
                self._forget()
                slot[:] = -1
            new = np.flatnonzero(slot < 0)
            raw, at = data.tobytes(), first[new]
            found = self._encode([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot[new] = self._learn(distinct[new], *found)
        slot = slot[which]
        low = self.at[slot].astype(np.int64)
        n = self.at[slot + 1].astype(np.int64) - low
        out = np.cumsum(n) - n
        total = int(out[-1] + n[-1])
        values = self.values[:, np.repeat(low - out, n) + np.arange(total)].astype(np.int32)
        row = W.rows_of(starts, offsets)
        if self.spans:
            point = np.concatenate([[0], np.cumsum(W.code_points(data))])
            values[1:] += np.repeat(point[starts] - point[offsets[row]], n).astype(np.int32)
        return values, np.bincount(row, weights=n, minlength=rows).astype(np.int64)


_made: dict[tuple, Encoder] = {}


def encoder(path: str, pieces: str, spans: bool = False) -> Encoder:
    """One encoder a worker and file."""
    key = (path, pieces, spans)
    if key not in _made:
        _made[key] = Encoder(path, pieces, spans)
    return _made[key]


def encoded(batches, path: str, pieces: str, spans: bool = False, column: str = "text"):
    """For each slice of each batch: the slice, its token columns, and the
    token offsets of its rows."""
    make = encoder(path, pieces, spans)
    for batch in batches:
        for part in W.slices(batch, column):
            values, counts = make.ids(*W.flat(part.column(column)))
            yield part, values, np.concatenate([[0], np.cumsum(counts)])


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of arrays given as Arrow or numpy."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
