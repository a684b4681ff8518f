"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier a bit, on byte n-grams of
letters, says which side of the bit a text is on.  A bit's classifier is the
mean, over a text's n-grams, of log P(n-gram | languages with the bit set) less
log P(n-gram | the others), scaled by a logistic fit on the training documents;
bits that fit better weigh more.  Decoding takes the language whose codeword has
the least weighted logistic loss; the score is its softmax share, and a text
whose two best are within `margin` is flagged ambiguous.

`fit` learns from a bounded sample: about `sample` documents, spread evenly over
the languages, chosen by a hash of doc_id; fewer where there are fewer.  Scoring
reads whole texts and neither lang nor source.  A text that is null or without a
letter gives `und` with score 0; no training document gives `und` for all; a
single language is predicted for all with a letter; repeated rows score alike;
an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import store
from corvane.llm import words as W
from corvane.llm.encode import batch_of

_BUCKETS = 1 << 14
_GRAMS = (1, 2, 3)
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each length of n-gram, its buckets and rows.  Anything that is no
    letter is a space, and a run of them one space."""
    own = _LETTER[data]
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != 0x20) | (own[:-1] != 0x20)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    own = own[keep].astype(np.uint32)
    for n in _GRAMS:
        m = max(len(own) - n + 1, 0)
        code = np.zeros(m, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + own[k : k + m] + np.uint32(1)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        whole = row[:m] == row[n - 1 :] if m else np.zeros(0, bool)
        yield ((code >> np.uint32(12)) & np.uint32(_BUCKETS - 1))[whole].astype(np.int64), row[:m][whole]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages, +1 and -1: all splits for up to 5, else random
    ones of 10 bits for each doubling, the best apart of 50 draws."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = np.arange(1, 1 << (n - 1))
        return np.stack([np.ones(len(bits), np.int8), *(np.where(bits >> k & 1, -1, 1).astype(np.int8) for k in range(n - 1))])
    rng, width, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        drawn = rng.choice(np.array([-1, 1], np.int8), (n, width))
        far = (drawn[:, None] != drawn[None]).sum(2) + width * np.eye(n, dtype=int)
        if far.min() > apart:
            best, apart = drawn, far.min()
    return best


def _bits(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log odds of each row's bits, and whether the row has an n-gram."""
    n = len(offsets) - 1
    total, seen = np.zeros((n, table.shape[1])), np.zeros(n)
    for code, row in grams(data, offsets):
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[first]] += np.add.reduceat(table[code], first, axis=0)
            seen += np.bincount(row, minlength=n)
    return total / np.maximum(seen, 1)[:, None], seen > 0


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    count = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[offsets[1:]] - c[offsets[:-1]]
    ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) & (data < 128)
    has = count(ascii_letter) > 0
    for k in np.flatnonzero(~has & (count(data >= 128) > 0)):
        has[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
    return has


class Model:
    """What scoring needs; a few hundred kB for each ten bits."""

    def __init__(self, langs: list[str], words: np.ndarray, table: np.ndarray):
        self.langs, self.words, self.table = langs, words, table.astype(np.float32)
        self.scale, self.shift, self.weight = np.ones(table.shape[1]), np.zeros(table.shape[1]), np.ones(table.shape[1])

    def calibrate(self, f: np.ndarray, which: np.ndarray) -> None:
        """A logistic fit of each bit on training documents; bits weigh by how
        far their accuracy is above chance."""
        for b in range(f.shape[1]):
            y, x = (self.words[which, b] + 1) / 2, f[:, b]
            unit = x.std() or 1.0
            a, c = 1.0, 0.0
            for _ in range(200):
                p = 1 / (1 + np.exp(-np.clip(a * x / unit + c, -50, 50)))
                a -= 0.5 * (((p - y) * x / unit).mean() + 0.01 * a)
                c -= 0.5 * (p - y).mean()
            self.scale[b], self.shift[b] = a / unit, c
            self.weight[b] = max(0.05, 2 * (((a * x / unit + c) > 0) == (y > 0.5)).mean() - 1)

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share, and its lead over the next."""
        z = f * self.scale + self.shift
        loss = np.stack([(np.logaddexp(0, -z * w) * self.weight).sum(1) for w in self.words], axis=1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        lead = order[:, -1] - order[:, -2] if share.shape[1] > 1 else order[:, -1]
        return share.argmax(1), share.max(1), lead


def fit(docs: DataFrame, sample: int = 4_000) -> Model:
    """Learns from rows with a lang."""
    spark = docs.sparkSession
    docs = docs.where(F.col("lang").isNotNull())
    # a row for each language
    many = dict(docs.groupBy("lang").count().collect())
    langs = sorted(many)
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((_BUCKETS, 1)))
    share = spark.createDataFrame([(x, min(1.0, sample / len(langs) / many[x])) for x in langs], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6
    chosen = docs.select("doc_id", "text", "lang").join(F.broadcast(share), "lang").where(draw < F.col("share"))
    chosen = store.keep(chosen.select("text", F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int").alias("which")), "lang-sample")
    counts_of, bits_of = pa.schema([("which", pa.int32()), ("counts", pa.binary())]), pa.schema([("which", pa.int32()), ("bits", pa.list_(pa.float64()))])

    def count(batches):
        got = np.zeros((len(langs), _BUCKETS), np.int64)
        for batch in batches:
            for rows in W.slices(batch):
                which = np.asarray(rows.column("which")) - 1
                for at, row in grams(*W.flat(rows.column("text"))):
                    got += np.bincount(which[row] * _BUCKETS + at, minlength=got.size).reshape(got.shape)
        yield batch_of(counts_of, [np.arange(len(langs), dtype=np.int32), pa.array([x.tobytes() for x in got], pa.binary())])

    # the sample is bounded, so are its partitions and what they count
    total = np.zeros((len(langs), _BUCKETS))
    for r in chosen.coalesce(8).mapInArrow(count, "which int, counts binary").collect():
        total[r[0]] += np.frombuffer(r[1], np.int64)
    # each language weighs the same, however much text it has
    rate = (total + 0.1) / (total.sum(1, keepdims=True) + 0.1 * _BUCKETS)
    table = np.zeros((_BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        one, other = code[:, b] > 0, code[:, b] < 0
        if one.any() and other.any():
            table[:, b] = np.log(rate[one].mean(0)) - np.log(rate[other].mean(0))
    model = Model(langs, code, table)

    def bits(batches):
        for batch in batches:
            for rows in W.slices(batch, limit=1 << 19):
                f, _ = _bits(*W.flat(rows.column("text")), model.table)
                yield batch_of(bits_of, [rows.column("which"), pa.array(f.tolist(), pa.list_(pa.float64()))])

    if len(langs) > 1:
        got = chosen.mapInArrow(bits, "which int, bits array<double>").collect()
        model.calibrate(np.array([r[1] for r in got]), np.array([r[0] - 1 for r in got]))
    return model


def predict(docs: DataFrame, model: Model, margin: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches):
        m = sent.value
        for batch in batches:
            for rows in W.slices(batch, limit=1 << 19):
                data, offsets = W.flat(rows.column("text"))
                has = lettered(data, offsets) & bool(m.langs)
                lang, score, lead = np.full(rows.num_rows, "und", object), np.zeros(rows.num_rows), np.zeros(rows.num_rows)
                if has.any():
                    f, _ = _bits(data, offsets, m.table)
                    best, share, apart = m.decode(f)
                    lang[has] = np.array(m.langs, object)[best[has]]
                    score[has], lead[has] = share[has], apart[has]
                yield batch_of(schema, [rows.column("doc_id"), pa.array(lang.tolist(), pa.string()), score, lead < margin])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
