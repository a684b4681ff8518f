"""Language-model scores by a hierarchical Pitman-Yor process.

Each context, the token before, has a restaurant of its own, however seldom it
occurs, whose base is the predictive distribution of the parent they all share,
the restaurant of single tokens, over a uniform base.

Seating is sampled by Gibbs: a sweep draws the number of tables of every token
in the parent, then that of every pair, from its exact law given all else, for
all numbers of customers alike.  What other tasks hold stays as the sweep found
it, as in distributed samplers of topic models.  Strengths and the discount of
contexts are drawn on grids that narrow while sweeps burn in, by the seatings of
all contexts and pairs, however large and wherever they lie; the parent's
discount is estimated from its customers.  After `burn` sweeps each of `samples`
ones gives a predictive distribution, and a token's probability is their mean.

How it runs: texts are coded once into blocks of some million tokens with their
own vocabulary.  A token's hash names the partition that owns it; the owner
counts it, numbers it by its frequency and seats it in the parent.  A context's
pairs lie with the context's owner; those of a frequent context are dealt over
as many partitions as its share of all tokens asks for, so no partition is
larger for a hot word.  Blocks send each partition their distinct pairs once, in
order, as numbers; what all tasks tell all others goes by a square of relays; a
sweep exchanges one count for each token of which a
partition has a pair with several customers; the answer tells a block only what
it can't know itself: a pair met once, there, is a pair of one customer.  Nothing
that grows with the vocabulary is broadcast, and no row a token is shuffled.
Memory follows the size of a block and of a partition; both are parameters, and
either must be under 2 GiB, packed.

A null or empty text is one token, the end.  Repeated rows are learned and
scored each.  A null doc_id is in the training part.  An empty table gives no
row; without training documents every probability is 1, as V is 0 then.  A long
text is one run of tokens in its block.  Other columns are ignored.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import store
from corvane.llm import words as W
from corvane.llm.encode import batch_of
from corvane.llm.seating import draw, log_rising, seated

END = np.uint64(0x0123456789ABCDEF)
_NONE = -(1 << 63)
_CODED = "block long, doc_ids binary, held binary, lengths binary, vocab binary, train binary, ids binary, learned long"
#: what partitions and blocks tell each other: for whom, what kind, from whom
_SAID = "p int, kind int, who long, a binary, b binary, c binary, d binary, e binary, f binary, sums array<double>"
_SAID_SCHEMA = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("who", pa.int64()), *((x, pa.binary()) for x in "abcdef"), ("sums", pa.list_(pa.float64()))])
NAMED, COUNTED, PAIRS, ALONE, MET, OWNED, COUNTS, SEATS, ROOT, REPLY, SHARED, BUNDLE = range(12)
_HEAD = struct.Struct("<iiq7i")
#: a context with over 1 / (SHARE * partitions) of all tokens is dealt over several
SHARE = 4


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes: planes of equal significance of as few
    bytes as they need, compressed."""
    size = next(s for s in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * s))
    a = np.ascontiguousarray(a).astype(f"u{size}")
    return bytes([size]) + (zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), size).T.tobytes()) if len(a) else b"")


def unpack(b: bytes | None) -> np.ndarray:
    """What was packed, as 64-bit integers; as unsigned ones if they need all bits."""
    if not b or len(b) == 1:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    a = np.ascontiguousarray(raw.reshape(b[0], -1).T).view(f"u{b[0]}").ravel()
    return a if b[0] == 8 and int(a.max()) >> 63 else a.astype(np.int64)


def rises(a: np.ndarray) -> bytes:
    """Numbers in ascending order, packed as their differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def risen(b: bytes | None, kind=np.int64) -> np.ndarray:
    return np.cumsum(unpack(b).astype(kind), dtype=kind)


def steps(a: np.ndarray, many: np.ndarray) -> bytes:
    """Runs of `many` ascending numbers each, packed as differences."""
    d = np.diff(a, prepend=0)
    first = (np.cumsum(many) - many)[many > 0]
    d[first] = a[first]
    return pack(d)


def stepped(b: bytes, many: np.ndarray) -> np.ndarray:
    a = np.cumsum(unpack(b))
    at = np.cumsum(many) - many
    before = np.where(at > 0, a[np.maximum(at, 1) - 1], 0) if len(a) else np.zeros(len(many), np.int64)
    return a - np.repeat(before, many)


def said(p: int, kind: int, who: int, *blobs: bytes, sums=None) -> tuple:
    return (p, kind, who, *blobs, *[None] * (6 - len(blobs)), sums)


def table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SAID_SCHEMA)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SAID_SCHEMA, strict=True)], schema=_SAID_SCHEMA)


def bundle(rows: list[tuple]) -> bytes:
    """Rows in one value: each row's numbers, the lengths of its blobs, -1 for null,
    and the blobs."""
    out = []
    for p, kind, who, *blobs, sums in rows:
        blobs.append(None if sums is None else np.asarray(sums, np.float64).tobytes())
        out.append(_HEAD.pack(p, kind, who, *(-1 if b is None else len(b) for b in blobs)))
        out += [b for b in blobs if b]
    return b"".join(out)


def unbundle(b: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(b):
        p, kind, who, *lengths = _HEAD.unpack_from(b, at)
        at += _HEAD.size
        row = {"p": p, "kind": kind, "who": who}
        for name, n in zip("abcdefs", lengths, strict=True):
            row[name] = None if n < 0 else b[at : at + n]
            at += max(n, 0)
        last = row.pop("s")
        out.append(row | {"sums": None if last is None else np.frombuffer(last, np.float64).tolist()})
    return out


def opened(told: pa.Table) -> list[dict]:
    """All rows, those in bundles too."""
    out = []
    for row in told.to_pylist():
        out += unbundle(row["a"]) if row["kind"] == BUNDLE else [row]
    return out


def values(row: dict) -> tuple:
    return tuple(row[f.name] for f in _SAID_SCHEMA)


class Routes:
    """How rows get from each of many tasks to each of many others: partitions are
    a square of relays.  A task sends a bundle to each relay of its own line, which
    sends one to each of the partitions, or blocks, of its column; so n tasks send
    n times the square root of n rows, and not n times n."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.parts, self.side = labels, len(labels), math.isqrt(len(labels))
        self.at = {int(p): k for k, p in enumerate(labels)}

    def line(self, source: int) -> int:
        """Of a partition; a block's is as good as random."""
        return source * self.side // self.parts if 0 <= source < self.parts else int(W.mix(np.array([source], np.uint64))[0]) % self.side

    def send(self, rows: list[tuple], line: int, to_blocks: bool = False) -> pa.Table:
        cells: dict[int, list[tuple]] = {}
        for row in rows:
            cells.setdefault(int(W.mix(np.array([row[2] + 1], np.uint64))[0]) % self.side if to_blocks else self.at[row[0]] % self.side, []).append(row)
        return table([said(int(self.labels[line * self.side + c]), BUNDLE, -1, bundle(held)) for c, held in cells.items()])

    def relay(self, sent: DataFrame, to_blocks: bool = False) -> DataFrame:
        """What was sent, a row for each partition or block and line."""
        key = "who" if to_blocks else "p"

        def run(told: pa.Table) -> pa.Table:
            cells: dict[int, list[tuple]] = {}
            for row in opened(told):
                cells.setdefault(row[key], []).append(values(row))
            return table([said(0, BUNDLE, to, bundle(held)) if to_blocks else said(to, BUNDLE, -1, bundle(held)) for to, held in cells.items()])

        return sent.where(F.col("kind") == BUNDLE).groupBy("p").applyInArrow(run, _SAID)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def cut(owner: np.ndarray, parts: int) -> np.ndarray:
    """Where each owner's run begins among owners in order."""
    return np.searchsorted(owner, np.arange(parts + 1))


def shares(n: np.ndarray, total: int, parts: int) -> np.ndarray:
    """Over how many partitions contexts of n customers are dealt."""
    return np.clip(-(-n * (SHARE * parts) // max(total, 1)), 1, parts)


def code(docs: DataFrame, tokens: int) -> DataFrame:
    """Blocks of coded documents (columns doc_id, text, held)."""

    def emit(block: int, held: list):
        h, lengths = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        ids, out = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        vocab, which, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        train = np.bincount(which[~np.repeat(out, lengths)], minlength=len(vocab))
        values = [ids.view(np.uint64), out, lengths, vocab[order], train, which]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([pack(v)], pa.binary()) for v in values), pa.array([int(train.sum())])], names=[x.split()[0] for x in _CODED.split(", ")])

    def run(batches):
        block, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for rows in W.slices(batch):
                data, offsets = W.flat(rows.column("text"))
                starts, ends = W.words(data, offsets)
                row = W.rows_of(starts, offsets)
                many = np.bincount(row, minlength=rows.num_rows) + 1
                h = np.full(int(many.sum()), END, np.uint64)
                inside = np.ones(len(h), bool)
                inside[np.cumsum(many) - 1] = False
                h[inside] = W.hashes(data, starts, ends, lower=True)
                ids = np.asarray(rows.column("doc_id").fill_null(_NONE)).astype(np.int64)
                held.append((h, many, ids, np.asarray(rows.column("held").cast(pa.uint8())).astype(bool)))
                size += len(h)
                if size >= tokens:
                    yield emit(block, held)
                    block, size, held = block + 1, 0, []
        if held:
            yield emit(block, held)

    return docs.mapInArrow(run, _CODED)


def _owners(vocab: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A vocabulary's places by owner and hash, and where owners begin there."""
    owner = part_of(vocab, parts)
    order = np.lexsort((vocab, owner))
    return order, cut(owner[order], parts)


def _tally(routes: Routes):
    """A block's vocabulary and its training counts, for each owner."""
    parts, labels = routes.parts, routes.labels

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, n = unpack(row["vocab"]).astype(np.uint64), unpack(row["train"])
                order, cuts = _owners(h, parts)
                cells = [order[cuts[k] : cuts[k + 1]] for k in range(parts)]
                rows = [said(int(labels[k]), NAMED, row["block"], rises(h[c]), pack(n[c])) for k, c in enumerate(cells) if len(c)]
                yield from routes.send(rows, routes.line(row["block"] + parts)).to_batches()

    return run


def _name(total: int, parts: int):
    """An owner's numbers for the tokens of each block, from 1 in order of their
    frequency, 0 where training has none, and how their contexts are dealt."""

    def run(asked: pa.Table) -> pa.Table:
        rows = opened(asked)
        held = [risen(r["a"], np.uint64) for r in rows]
        h, which = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([unpack(r["b"]) for r in rows])).astype(np.int64)
        order = np.lexsort((h, -n))
        number = np.empty(len(h), np.int64)
        number[order] = np.arange(1, len(h) + 1)
        number[n == 0] = 0
        split = shares(n, total, parts) - 1
        ends = np.cumsum([len(x) for x in held])
        out = [said(r["p"], NAMED, r["who"], pack(number[w]), pack(split[w])) for r, w in zip(rows, np.split(which, ends[:-1]), strict=True)]
        known = n[order][: int((n > 0).sum())]
        p = rows[0]["p"]
        return table([said(p, BUNDLE, -1, bundle(out)), said(p, COUNTED, -1, pack(known), sums=[float(n.sum()), float(len(known))])])

    return run


def _deal(routes: Routes):
    """Owners' numbers, to blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from routes.send([values(r) for r in unbundle(row["a"])], routes.line(routes.at[row["p"]]), to_blocks=True).to_batches()

    return run


class Block:
    """A block's tokens and its distinct pairs of known ones, in the order of
    partition, context and token that partitions get them in."""

    def __init__(self, row: dict, parts: int):
        self.row, self.parts = row, parts
        self.vocab, self.lengths, self.ids = unpack(row["vocab"]).astype(np.uint64), unpack(row["lengths"]), unpack(row["ids"])
        self.order, self.cuts = _owners(self.vocab, parts)
        self.number, self.split = np.zeros(len(self.vocab), np.int64), np.zeros(len(self.vocab), np.int64)
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[np.cumsum(self.lengths) - self.lengths] = int(np.flatnonzero(self.vocab == END)[0])

    def cells(self, k: int) -> np.ndarray:
        """The places in the vocabulary of what owner k has."""
        return self.order[self.cuts[k] : self.cuts[k + 1]]

    def pairs(self):
        """Each distinct pair's partition, context, token and training count, and
        each token's pair, -1 where one of the two isn't known."""
        parts, owner = self.parts, part_of(self.vocab, self.parts)
        known = np.flatnonzero(self.number > 0)
        name = (self.number - 1) * parts + owner
        known = known[np.argsort(name[known])]
        at = np.full(len(self.vocab), -1)
        at[known] = np.arange(len(known))
        u, w = at[self.before], at[self.ids]
        inside = np.flatnonzero((u >= 0) & (w >= 0))
        learned = ~np.repeat(unpack(self.row["held"]).astype(bool), self.lengths)[inside]
        key, pair, n = np.unique(u[inside] * max(len(known), 1) + w[inside], return_inverse=True, return_counts=True)
        n = np.bincount(pair, weights=learned, minlength=len(key)).astype(np.int64)
        u, w = (known[x] for x in np.divmod(key, max(len(known), 1)))
        p = owner[u]
        hot = np.flatnonzero(self.split[u] > 0)
        p[hot] = (p[hot] + (self.vocab[w[hot]] % (self.split[u[hot]] + 1).astype(np.uint64)).astype(np.int64)) % parts
        order = np.argsort(p, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = np.full(len(self.ids), -1)
        of[inside] = rank[pair]
        return p[order], u[order], w[order], n[order], name, of


def _ask(routes: Routes):
    """A block's distinct pairs, for each partition."""
    parts, labels, at = routes.parts, routes.labels, routes.at

    def run(coded: pa.Table, names: pa.Table) -> pa.Table:
        b, out = Block(coded.to_pylist()[0], parts), []
        for r in opened(names):
            cells = b.cells(at[r["p"]])
            b.number[cells], b.split[cells] = unpack(r["a"]), unpack(r["b"])
        p, u, w, n, name, _ = b.pairs()
        cuts = cut(p, parts)
        for k in np.flatnonzero(np.diff(cuts)):
            x = slice(cuts[k], cuts[k + 1])
            first = np.flatnonzero(np.diff(u[x], prepend=-1))
            many = np.diff(np.append(first, cuts[k + 1] - cuts[k]))
            ctx = u[x][first]
            out.append(said(int(labels[k]), MET, b.row["block"], rises(name[ctx]), pack(many), steps(name[w[x]], many), pack(n[x]), pack(b.split[ctx])))
        return routes.send(out, routes.line(b.row["block"] + parts))

    return run


def _seat(parts: int):
    """A partition's pairs, one table each, from what blocks asked: contexts,
    their pairs of several customers and how many others; the tokens of those
    others; and for each block what it can't know of the pairs it asked for."""

    def run(asked: pa.Table) -> pa.Table:
        rows = opened(asked)
        p = rows[0]["p"]
        ctxs, manys = [risen(r["a"]) for r in rows], [unpack(r["b"]) for r in rows]
        words, n = np.concatenate([stepped(r["c"], m) for r, m in zip(rows, manys, strict=True)]), np.concatenate([unpack(r["d"]) for r in rows])
        split = np.concatenate([unpack(r["e"]) for r in rows])
        ctx, first, which = np.unique(np.concatenate(ctxs), return_index=True, return_inverse=True)
        split = split[first]
        word, w = np.unique(words, return_inverse=True)
        key, pair = np.unique(np.repeat(which, np.concatenate(manys)) * len(word) + w, return_inverse=True)
        total = np.bincount(pair, weights=n).astype(np.int64)
        u, w = np.divmod(key, len(word))
        multi = np.flatnonzero(total > 1)
        alone = total == 1
        # tokens by owner, so that what owners say can be put together in their order
        order = np.lexsort((word, word % parts))
        place = np.empty(len(word), np.int64)
        used = np.bincount(w[multi], minlength=len(word))[order] > 0
        place[order] = np.cumsum(used) - 1
        names = word[order[used]]
        many = np.bincount(u[multi], minlength=len(ctx))
        single = np.bincount(w[alone], minlength=len(word))
        ones, twos = float(alone.sum()), float((total == 2).sum())
        out = [
            said(p, PAIRS, -1, rises(ctx), pack(np.bincount(u[alone], minlength=len(ctx))), pack(many), pack(place[w[multi]]), pack(total[multi] - 2), pack(split), sums=[ones, twos]),
            said(p, ALONE, -1, pack(names % parts), steps(names // parts, np.bincount(names % parts, minlength=parts)), rises(word[single > 0]), pack(single[single > 0])),
        ]
        # 0: as the block counts it; 1: once, elsewhere; 2: a pair of several customers
        index = np.full(len(key), -1)
        index[multi] = np.arange(len(multi))
        mark = np.where(index[pair] >= 0, 2, np.where((total[pair] == 1) & (n == 0), 1, 0))
        at = np.cumsum([int(m.sum()) for m in manys])[:-1]
        met = [said(p, MET, r["who"], pack(m), rises(i[m == 2])) for r, m, i in zip(rows, np.split(mark, at), np.split(index[pair], at), strict=True)]
        return table([*out, said(p, BUNDLE, -1, bundle(met))])

    return run


def _register(routes: Routes):
    """To owners: the tokens of which a partition has pairs, and the contexts that
    it shares with others."""
    parts, labels, at = routes.parts, routes.labels, routes.at

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == ALONE:
                    many = np.bincount(unpack(row["a"]), minlength=parts)
                    ranks = np.split(stepped(row["b"], many), np.cumsum(many)[:-1])
                    word, n = risen(row["c"]), unpack(row["d"])
                    order = np.argsort(word % parts, kind="stable")
                    cuts = cut(word[order] % parts, parts)
                    cells = [order[cuts[k] : cuts[k + 1]] for k in range(parts)]
                    out = [said(int(labels[k]), ALONE, at[row["p"]], rises(r), rises(word[c] // parts), pack(n[c])) for k, (r, c) in enumerate(zip(ranks, cells, strict=True)) if len(r) or len(c)]
                    yield from routes.send(out, routes.line(at[row["p"]])).to_batches()
                elif row["kind"] == PAIRS:
                    ctx = risen(row["a"])[unpack(row["f"]) > 0]
                    out = [said(int(labels[k]), PAIRS, at[row["p"]], rises(ctx[ctx % parts == k] // parts)) for k in np.unique(ctx % parts)]
                    yield from routes.send(out, routes.line(at[row["p"]])).to_batches()

    return run


def _own(told: pa.Table) -> pa.Table:
    """What an owner keeps: for each partition the numbers of the tokens that it
    has pairs of, how often tokens have pairs of one customer, and who shares
    which contexts."""
    rows = sorted(opened(told), key=lambda r: (r["kind"], r["who"]))
    tokens, shared = [r for r in rows if r["kind"] == ALONE], [r for r in rows if r["kind"] == PAIRS]
    ranks, contexts = [risen(r["a"]) for r in tokens], [risen(r["a"]) for r in shared]
    many, wide = (np.array([len(x) for x in y], np.int64) for y in (ranks, contexts))
    alone, n = [risen(r["b"]) for r in tokens], [unpack(r["c"]) for r in tokens]
    size = 1 + max([-1, *(int(x[-1]) for x in [*ranks, *alone] if len(x))])
    single = np.bincount(np.concatenate([*alone, np.zeros(0, np.int64)]), weights=np.concatenate([*n, np.zeros(0)]), minlength=size).astype(np.int64)
    join = lambda a: np.concatenate([*a, np.zeros(0, np.int64)])
    both = [pack(np.array(x, np.int64)) for x in ([r["who"] for r in tokens], many, [r["who"] for r in shared], wide)]
    # who and how many, of both lists, in one: each is preceded by its length
    heads = b"".join(len(x).to_bytes(4, "little") + x for x in both)
    return table([said(rows[0]["p"], OWNED, -1, heads, steps(join(ranks), many), pack(single), steps(join(contexts), wide))])


def _heads(b: bytes) -> list[np.ndarray]:
    out = []
    while b:
        n = int.from_bytes(b[:4], "little")
        out.append(unpack(b[4 : 4 + n]))
        b = b[4 + n :]
    return out


class Law:
    """Discounts and strengths of contexts and of the parent, the parent's
    customers and tables, and the number of tokens, during a sweep."""

    def __init__(self, discounts, strengths, customers, seats, size):
        (self.d, self.d0), (self.s, self.s0) = discounts, strengths
        self.customers, self.seats, self.size = customers, seats, size
        self.fresh = (self.s0 + self.d0 * seats) / (size + 1)

    def base(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The parent's probability of tokens with c customers at t tables."""
        return (c - self.d0 * t + self.fresh) / (self.s0 + self.customers)


def _tell(routes: Routes, pairs: dict, names: dict, t: np.ndarray, tables: np.ndarray, size: np.ndarray) -> list[pa.RecordBatch]:
    """A partition's tables of each token and of shared contexts, to owners; those
    of contexts also by themselves, with customers, to stay with the sample."""
    parts, labels, k = routes.parts, routes.labels, routes.at[pairs["p"]]
    place, split, ctx = unpack(pairs["d"]), unpack(pairs["f"]) > 0, risen(pairs["a"])
    cuts = cut(unpack(names["a"]), parts)
    own = np.bincount(place, weights=t, minlength=int(cuts[-1])).astype(np.int64)
    ctx, tables, size = ctx[split], tables[split], size[split]
    out, shared = [], []
    for q in range(parts):
        mine, theirs = own[cuts[q] : cuts[q + 1]], tables[ctx % parts == q]
        if len(mine) or len(theirs):
            out.append(said(int(labels[q]), COUNTS, k, pack(mine), pack(theirs)))
        if len(theirs):
            shared.append(said(int(labels[q]), SHARED, k, None, pack(theirs), rises(ctx[ctx % parts == q] // parts), pack(size[ctx % parts == q])))
    return [*routes.send(out, routes.line(k)).to_batches(), *table(shared).to_batches()]


def _start(routes: Routes):
    """One table for each pair, told as after a sweep."""

    def run(stated: pa.Table) -> pa.Table:
        kinds = {r["kind"]: r for r in stated.to_pylist()}
        pairs = kinds[PAIRS]
        many, alone = unpack(pairs["c"]), unpack(pairs["b"])
        t = np.ones(int(many.sum()), np.int64)
        size = np.bincount(np.repeat(np.arange(len(many)), many), weights=unpack(pairs["e"]) + 2, minlength=len(many)).astype(np.int64) + alone
        own = [float(len(t) + alone.sum()), 0.0, 0.0, 0.0, *pairs["sums"]]
        seats = said(pairs["p"], SEATS, -1, pack(t), pack(many + alone), sums=own)
        return pa.Table.from_batches([*table([seats]).to_batches(), *_tell(routes, pairs, kinds[ALONE], t, many + alone, size)], _SAID_SCHEMA)

    return run


def _parent(law: Law, routes: Routes, turn: int, seed: int):
    """An owner's part of a sweep: customers of the parent from all partitions,
    their tables drawn, and both told to those who have such tokens."""

    def run(stated: pa.Table, told: pa.Table) -> pa.Table:
        rows, own = opened(told), stated.to_pylist()
        out = [values(r) for r in rows if r["kind"] == SEATS]
        if not own:
            return routes.send(out, routes.line(routes.at[rows[0]["p"]])) if out else table([])
        p, own, labels = own[0]["p"], own[0], routes.labels
        k = routes.at[p]
        who, many, sharer, wide = _heads(own["a"])
        ranks, c, contexts = stepped(own["b"], many), unpack(own["c"]), stepped(own["d"], wide)
        said_by = {r["who"]: r for r in rows if r["kind"] == COUNTS}
        join = lambda a: np.concatenate([*a, np.zeros(0, np.int64)])
        c = c + np.bincount(ranks, weights=join([unpack(said_by[w]["a"]) for w in who[many > 0]]), minlength=len(c)).astype(np.int64)
        shared, which = np.unique(contexts, return_inverse=True)
        tables = np.bincount(which, weights=join([unpack(said_by[w]["b"]) for w in sharer]), minlength=len(shared)).astype(np.int64)
        last = [r for r in rows if r["kind"] == ROOT]
        t = unpack(last[0]["b"]) if last else np.ones(len(c), np.int64)
        rng = np.random.default_rng([seed, turn, k, 0])
        rest = (law.s0 + law.d0 * np.maximum(law.seats - t, 0)) / (law.size + 1)
        each = law.d0 / (law.size + 1)
        t = draw(c, lambda i, j: rest[i] + each * j, law.d0, rng)
        sums = [0.0, float(t.sum()), float((c == 1).sum()), float((c == 2).sum())]
        out.append(said(p, ROOT, k, pack(c), pack(t), sums=sums))
        spots = dict(zip(sharer.tolist(), np.split(which, np.cumsum(wide))[:-1], strict=True))
        for w, r in zip(who.tolist(), np.split(ranks, np.cumsum(many))[:-1], strict=True):
            out.append(said(int(labels[w]), REPLY, k, pack(c[r]), pack(t[r]), pack(tables[spots.pop(w)] if w in spots else np.zeros(0, np.int64))))
        out += [said(int(labels[w]), REPLY, k, pack(np.zeros(0, np.int64)), pack(np.zeros(0, np.int64)), pack(tables[s])) for w, s in spots.items()]
        return routes.send(out, routes.line(k))

    return run


def _contexts(law: Law, routes: Routes, turn: int, seed: int, grid: tuple[list[float], list[float]] | None):
    """A partition's part of a sweep: the tables of its pairs drawn and told."""

    def run(stated: pa.Table, told: pa.Table) -> pa.Table:
        rows, kinds = opened(told), {r["kind"]: r for r in stated.to_pylist()}
        out = [values(r) for r in rows if r["kind"] == ROOT]
        if PAIRS not in kinds:
            return table(out)
        pairs = kinds[PAIRS]
        k = routes.at[pairs["p"]]
        seats = next(r for r in rows if r["kind"] == SEATS)
        replies = sorted((r for r in rows if r["kind"] == REPLY), key=lambda r: r["who"])
        join = lambda x: np.concatenate([*(unpack(r[x]) for r in replies), np.zeros(0, np.int64)])
        c, roots = join("a"), join("b")
        ctx, alone, many, place, n, split = risen(pairs["a"]), *(unpack(pairs[x]) for x in "bcde"), unpack(pairs["f"]) > 0
        n, t, tables = n + 2, unpack(seats["a"]), unpack(seats["b"])
        dealt = np.flatnonzero(split)
        tables[dealt[np.argsort(ctx[dealt] % routes.parts, kind="stable")]] = join("c")
        u = np.repeat(np.arange(len(ctx)), many)
        # without this pair's tables: the weight of one more in the context, what
        # the parent has of the token, and all that it has
        one = law.s + law.d * np.maximum(tables[u] - t, 0)
        other = np.maximum(c[place] - t, 0)
        other = other - law.d0 * np.maximum(np.minimum(roots[place], other), 1) + law.fresh
        full = law.s0 + law.customers - t
        t = draw(n, lambda i, j: (one[i] + law.d * j) * (other[i] + j) / (full[i] + j), law.d, np.random.default_rng([seed, turn, k, 1]))
        tables = np.bincount(u, weights=t, minlength=len(ctx)).astype(np.int64) + alone
        # all pairs, and contexts held whole, tell of strength and discount here;
        # those dealt over several partitions do so in `_whole`
        size = np.bincount(u, weights=n, minlength=len(ctx)).astype(np.int64) + alone
        plain = ~split & (size > 1)
        sums = [float(tables.sum()), 0.0, 0.0, 0.0, *(_likelihood(size[plain], tables[plain], n, t, grid) if grid else [])]
        out.append(said(pairs["p"], SEATS, -1, pack(t), pack(tables), sums=sums))
        return pa.Table.from_batches([*table(out).to_batches(), *_tell(routes, pairs, kinds[ALONE], t, tables, size)], _SAID_SCHEMA)

    return run


def _whole(grid: tuple[list[float], list[float]]):
    """An owner's part of what tells of strength and discount: the contexts of which
    several partitions hold pairs, put together."""

    def run(told: pa.Table) -> pa.Table:
        rows = told.to_pylist()
        ctx, which = np.unique(np.concatenate([risen(r["c"]) for r in rows]), return_inverse=True)
        tables, size = (np.bincount(which, weights=np.concatenate([unpack(r[x]) for r in rows]), minlength=len(ctx)).astype(np.int64) for x in "bd")
        none = np.zeros(0, np.int64)
        return table([said(rows[0]["p"], SHARED, -1, sums=[0.0] * 4 + _likelihood(size, tables, none, none, grid))])

    return run


def _likelihood(size: np.ndarray, tables: np.ndarray, n: np.ndarray, t: np.ndarray, grid: tuple[list[float], list[float]]) -> list[float]:
    """The logarithm of the probability of the seatings of contexts, by their sizes
    and tables, and of pairs, for each discount and strength of the grid."""
    count = lambda a: np.unique(a, return_counts=True)
    high = int(t.max(initial=0)) + 1
    (sizes, of_size), (seats, of_seats), (pair, of_pair) = count(size), count(tables), count(n * high + t)
    n, t = np.divmod(pair, high)
    out = []
    for d in grid[0]:
        own = float((seated(d, n, t) * of_pair).sum())
        for s in grid[1]:
            out.append(own + float((log_rising(s, d, seats) * of_seats).sum()) - float((log_rising(s, 1.0, sizes) * of_size).sum()))
    return out


def _answer(samples: list[Law], routes: Routes):
    """What one partition knows of what blocks asked: of tokens their count, and
    in each sample their customers and tables in the parent and their tables as a
    context; of pairs of several customers these and their tables, added up."""

    parts = routes.parts

    def run(stated: pa.Table, told: pa.Table) -> pa.Table:
        rows, fixed = opened(told), opened(stated)
        names = [r for r in rows if r["kind"] == NAMED]
        p = (rows or fixed)[0]["p"]
        count = unpack(next((r["a"] for r in rows if r["kind"] == COUNTED), None))
        pairs = next((r for r in fixed if r["kind"] == PAIRS), None)
        met = {r["who"]: r for r in fixed if r["kind"] == MET}
        roots, seats = ([next((r for r in rows if r["kind"] == kind and r["who"] == s), None) for s in range(len(samples))] for kind in (ROOT, SEATS))
        c, w, u = (np.zeros((len(samples), len(count)), np.int64) for _ in range(3))
        n = total = np.zeros(0, np.int64)
        for s, root in enumerate(roots):
            if root is not None:
                for into, x in ((c, "a"), (w, "b")):
                    own = unpack(root[x])
                    into[s, : len(own)] = own
        if pairs is not None:
            n, ctx, whole = unpack(pairs["e"]) + 2, risen(pairs["a"]), unpack(pairs["f"]) == 0
            total = np.sum([unpack(r["a"]) for r in seats], axis=0) if len(n) else n
            for s, r in enumerate(seats):
                u[s, ctx[whole] // parts] = unpack(r["b"])[whole]
        for r in rows:
            if r["kind"] == SHARED:
                u[r["who"], risen(r["c"])] += unpack(r["b"])
        out = []
        asked = {r["who"]: r["a"] for r in names}
        for block in [*asked, *(b for b in met if b not in asked)]:
            at = unpack(asked.get(block))
            at = at[at > 0] - 1
            mine = met.get(block)
            which = risen(mine["b"]) if mine else np.zeros(0, np.int64)
            own = b"".join(len(x).to_bytes(4, "little") + x for x in (pack(n[which] - 2), pack(total[which] - len(samples))))
            out.append(said(p, MET, block, asked.get(block), pack(count[at]), *(pack(np.concatenate([x[0, at], *(_fold(x[s, at] - x[0, at]) for s in range(1, len(samples)))])) for x in (c, w, u)), (mine["a"] if mine else pack(np.zeros(0, np.int64))), sums=None))
            out.append(said(p, PAIRS, block, own))
        return routes.send(out, routes.line(routes.at[p]), to_blocks=True)

    return run


def _fold(a: np.ndarray) -> np.ndarray:
    """Whole numbers as ones from 0 on, small where they are near 0."""
    return np.where(a >= 0, 2 * a, -2 * a - 1)


def _unfold(a: np.ndarray) -> np.ndarray:
    return np.where(a % 2 == 0, a // 2, -(a + 1) // 2)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])


def _finish(samples: list[Law], routes: Routes, total: int, size: int):
    """Adds up the answers for a block's documents."""
    parts, many, at = routes.parts, len(samples), routes.at

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        row = coded.to_pylist()[0]
        b, rows = Block(row, parts), opened(answers)
        of = np.zeros(len(b.vocab), np.int64)
        c, w, u = (np.zeros((many, len(b.vocab)), np.int64) for _ in range(3))
        met = [r for r in rows if r["kind"] == MET]
        for r in met:
            if r["a"] is None:
                continue
            cells, number = b.cells(at[r["p"]]), unpack(r["a"])
            b.number[cells] = number
            cells = cells[number > 0]
            of[cells] = unpack(r["b"])
            for into, x in ((c, "c"), (w, "d"), (u, "e")):
                own = unpack(r[x]).reshape(many, -1)
                into[0, cells] = own[0]
                for s in range(1, many):
                    into[s, cells] = own[0] + _unfold(own[s])
        b.split[:] = np.where(of > 0, shares(of, total, parts) - 1, 0)
        p, _, _, n, _, pair = b.pairs()
        cuts, tables = cut(p, parts), n.copy()
        tables[n > 0] = 1
        n = tables.copy()
        marks, own = {r["p"]: unpack(r["f"]) for r in met}, {r["p"]: _heads(r["a"]) for r in rows if r["kind"] == PAIRS}
        tables = n * many
        for label, mark in marks.items():
            here = cuts[at[label]] + np.arange(len(mark))
            n[here[mark == 1]], tables[here[mark == 1]] = 1, many
            n[here[mark == 2]], tables[here[mark == 2]] = own[label][0] + 2, own[label][1] + many
        law = samples[0]
        base = np.array([x.base(c[s], w[s]) for s, x in enumerate(samples)])
        mine = np.append((n * many - law.d * tables) / many, 0.0)[pair]
        total_of = of[b.before]
        share = np.zeros(len(b.ids))
        for s in range(many):
            share += np.where(total_of > 0, law.s + law.d * u[s][b.before], 1.0) * base[s][b.ids]
        logs = np.log10((mine + share / many) / np.where(total_of > 0, law.s + total_of, 1.0))
        start = np.cumsum(b.lengths) - b.lengths
        add = lambda v: np.add.reduceat(v, start)
        doc, held = unpack(row["doc_ids"]).astype(np.uint64).view(np.int64), unpack(row["held"]).astype(bool)
        plain, score = np.log10((of + 0.5) / (total + 0.5 * (size + 1))), add(logs)
        columns = [pa.array(doc, mask=doc == _NONE), held, b.lengths, add((of > 0).astype(np.int64)[b.ids]), np.full(len(doc), total), add(plain[b.ids]), score, 10.0 ** (-score / b.lengths)]
        return pa.Table.from_batches([batch_of(_SCORED, columns)])

    return run


def _added(rows: DataFrame) -> list[float]:
    """What partitions say to be added up, place by place."""
    added = rows.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect()
    return [x for _, x in sorted(map(tuple, added))]


def _choose(weights: np.ndarray, rng: np.random.Generator) -> int:
    share = np.exp(weights - weights.max())
    return int(np.searchsorted(np.cumsum(share / share.sum()), rng.random()).clip(0, len(share) - 1))


def score(docs: DataFrame, tokens: int = 2_000_000, burn: int = 3, samples: int = 3, law: tuple[tuple[float, float], tuple[float, float]] | None = None, seed: int = 17) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    perplexity of all documents (columns doc_id, text, held); learns from those
    not held.  `law` fixes the discounts and the strengths of contexts and of their
    parent, which are else learned."""
    spark = docs.sparkSession
    parts = store.parts(spark)
    routes = Routes(store.labels(spark, parts))
    rng = np.random.default_rng(seed)
    coded = store.keep_by(code(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held"), tokens), "coded", "block", parts)
    total = int(coded.agg(F.sum("learned")).head()[0] or 0)
    tally = routes.relay(coded.select("block", "vocab", "train").mapInArrow(_tally(routes), _SAID))
    named = store.keep(tally.groupBy("p").applyInArrow(_name(total, parts), _SAID), "names")
    size = int((_added(named.where(F.col("kind") == COUNTED)) or [0, 0])[1])
    names = routes.relay(named.where(F.col("kind") == BUNDLE).mapInArrow(_deal(routes), _SAID), to_blocks=True)
    asked = routes.relay(coded.drop("doc_ids").groupBy("block").cogroup(names.groupBy("who")).applyInArrow(_ask(routes), _SAID))
    stated = store.keep_by(asked.groupBy("p").applyInArrow(_seat(parts), _SAID), "pairs", "p", parts)
    fixed = stated.where(F.col("kind").isin(PAIRS, ALONE))
    owned = store.keep_by(routes.relay(fixed.mapInArrow(_register(routes), _SAID)).groupBy("p").applyInArrow(_own, _SAID), "owners", "p", parts)
    now = store.keep(fixed.groupBy("p").applyInArrow(_start(routes), _SAID), "seats")
    customers, _, _, _, ones, twos = _added(now) or [0.0] * 6
    discount, strength, parent = max(0.05, min(0.95, ones / max(ones + 2 * twos, 1))), 4.0, (0.5, 1.0)
    if law:
        (discount, d0), (strength, s0) = law
        parent = (d0, s0)
    seats, held, known, made = float(size), [], None, [coded, named, stated, owned]
    for turn in range(burn + samples):
        # the grid narrows while sweeps burn in
        wide = 0.08 / 2**turn
        grid = None if law or turn >= burn else (sorted({min(0.95, max(0.05, discount + k * wide)) for k in (-2, -1, 0, 1, 2)}), [strength * 4.0 ** (k / 2**turn) for k in (-2, -1, 0, 1, 2)])
        current = Law((discount, parent[0]), (strength, parent[1]), customers, seats, size)
        said_now = now.where(F.col("kind").isin(SEATS, ROOT)).union(routes.relay(now))
        roots = routes.relay(owned.groupBy("p").cogroup(said_now.groupBy("p")).applyInArrow(_parent(current, routes, turn, seed), _SAID))
        after = store.keep(fixed.groupBy("p").cogroup(roots.groupBy("p")).applyInArrow(_contexts(current, routes, turn, seed, grid), _SAID), "seats")
        customers, tables, ones, twos, *logs = _added(after) or [0.0] * 5
        if grid and len(logs):
            shared = _added(after.where(F.col("kind") == SHARED).groupBy("p").applyInArrow(_whole(grid), _SAID))
            logs = [x + y for x, y in zip(logs, shared[4:] or [0.0] * len(logs), strict=True)]
        if turn >= burn:
            held.append(Law((discount, parent[0]), (strength, parent[1]), current.customers, tables, size))
            made.append(after)
            kept = after.where(F.col("kind").isin(SEATS, ROOT, SHARED)).withColumn("who", F.lit(turn - burn).cast("long"))
            known = kept if known is None else known.union(kept)
        elif grid and len(logs):
            pick = _choose(np.array(logs), rng)
            discount, strength = grid[0][pick // len(grid[1])], grid[1][pick % len(grid[1])]
            d0 = max(0.05, min(0.95, ones / max(ones + 2 * twos, 1)))
            some = np.array([parent[1] * 4.0 ** (k / 2**turn) for k in (-2, -1, 0, 1, 2)])
            parent = (d0, float(some[_choose(np.array([float((log_rising(s, d0, np.array([max(tables, 1)])) - log_rising(s, 1.0, np.array([max(customers, 1)])))[0]) for s in some]), rng)]))
        if all(now is not x for x in made):
            store.drop_frame(now)
        seats, now = tables, after
    told = known.unionByName(named)
    answers = routes.relay(stated.groupBy("p").cogroup(told.groupBy("p")).applyInArrow(_answer(held, routes), _SAID), to_blocks=True)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    scores = store.keep(coded.groupBy("block").cogroup(answers.groupBy("who")).applyInArrow(_finish(held, routes, total, size), out), "scores")
    for frame in made:
        store.drop_frame(frame)
    return scores
