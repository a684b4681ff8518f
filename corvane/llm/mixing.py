"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Sources get targets in words: they share all words by weight, no target above
`most` times its source, the excess reshared.  A source whose target is e times
its size is taken floor(e) times whole and once in part.

Documents fall into blocks of a source by a hash of doc_id; an affine permutation
drawn for each source and epoch orders the blocks without a sort, and the part is a
prefix of that order: whole blocks, then of one block the documents with the
least hash that fit and others that fill what is then missing; if one of these is
too long, shorter ones go for it.  The blocks
taken of each source are its exact quota.  A binary tree over output shards
splits the quotas: at each node the left half's share of every source is drawn
from the multivariate hypergeometric distribution, seeded by the node, so any
worker finds the same split by walking down from the root and nothing is
gathered.  A shard so gets disjoint runs of each source's permuted blocks, and
its documents are shuffled locally by a hash.

A hot source is many blocks; all sums by block and prefix sums over chunks of
blocks are aggregates of small rows.  A null text has size 0; a null source is a
source of its own, last; repeated rows are placed alike, each of its own; an
empty table gives no row; sources without words have target 0; other columns
are ignored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import store
from corvane.llm import words as W
from corvane.llm.encode import batch_of

_CHUNK = 1024
_NONE = -(1 << 63)


def targets(sizes: list[int], weights: list[float], total: float, most: float = 3.0) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.discard(k)
    return out


def step(n: int, seed: int, source: int, epoch: int) -> tuple[int, int]:
    """a and b of the permutation block -> (a * block + b) mod n."""
    rng = random.Random(f"{seed}/{source}/{epoch}")
    a = rng.randrange(1, n + 1)
    while math.gcd(a, n) != 1:
        a = rng.randrange(1, n + 1)
    return a % n, rng.randrange(n)


class Tree:
    """Splits quotas of blocks among shards; nodes are drawn when first met."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed = np.array(quotas, np.int64), shards, seed
        self.drawn: dict[tuple[int, int], np.ndarray] = {}

    def left(self, low: int, high: int, quotas: np.ndarray) -> np.ndarray:
        """The left half's quotas at the node of shards [low, high)."""
        if (low, high) not in self.drawn:
            rng = np.random.default_rng([self.seed, low, high])
            middle, total = (low + high) // 2, int(quotas.sum())
            draw = total * (middle - low) // (high - low)
            got, rest = np.zeros_like(quotas), total
            # one source after another: hypergeometric given what remains
            for k, q in enumerate(quotas.tolist()):
                rest -= q
                got[k] = _hypergeometric(rng, q, rest, draw)
                draw -= int(got[k])
            self.drawn[low, high] = got
        return self.drawn[low, high]

    def shard(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The shard that holds each place in its source's permuted blocks."""
        out = np.zeros(len(place), np.int64)
        todo = [(0, self.shards, self.quotas, np.arange(len(place)), place.astype(np.int64))]
        while todo:
            low, high, quotas, at, where = todo.pop()
            if not len(at):
                continue
            if high - low == 1:
                out[at] = low
                continue
            left = self.left(low, high, quotas)
            first = where < left[source[at]]
            middle = (low + high) // 2
            todo.append((low, middle, left, at[first], where[first]))
            todo.append((middle, high, quotas - left, at[~first], where[~first] - left[source[at[~first]]]))
        return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    if draw <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(good, draw)
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draw))
    n = good + bad  # beyond what numpy draws: its normal limit, clipped to what is possible
    mean, var = draw * good / n, draw * good / n * (bad / n) * ((n - draw) / max(n - 1, 1))
    return int(min(max(round(rng.normal(mean, math.sqrt(var))), draw - bad, 0), good, draw))


class Plan:
    """One entry a source: name, size, target, blocks, whole epochs, and the cut
    of the partial one."""

    def __init__(self, names, sizes, target, blocks, seed, shard_blocks):
        self.names, self.sizes, self.target, self.blocks, self.seed = names, sizes, target, np.array(blocks, np.int64), seed
        self.whole = np.array([math.floor(t / s + 1e-9) if s else 0 for t, s in zip(target, sizes, strict=True)], np.int64)
        self.cut = np.zeros(len(names), np.int64)  # blocks taken whole in the partial epoch
        self.edge = np.full(len(names), -1, np.int64)  # hash up to which the next block is taken
        self.edge_id = np.full(len(names), _NONE, np.int64)
        self.more: dict[int, set[tuple[int, int]]] = {}  # and others of it, by hash and id
        self.less: dict[int, set[tuple[int, int]]] = {}  # but not these
        self.shard_blocks = shard_blocks

    def steps(self, epoch) -> tuple[np.ndarray, np.ndarray]:
        """The permutation of each source in its own epoch."""
        found = [step(int(n), self.seed, k, int(e)) for k, (n, e) in enumerate(zip(self.blocks, np.broadcast_to(epoch, self.blocks.shape), strict=True))]
        return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)

    def quotas(self) -> list[int]:
        return (self.whole * self.blocks + self.cut + ((self.edge >= 0) | np.isin(np.arange(len(self.cut)), list(self.more)))).tolist()

    def tree(self) -> Tree:
        quotas = self.quotas()
        return Tree(quotas, max(1, -(-sum(quotas) // self.shard_blocks)), self.seed)


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash that places the document."""
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    spot = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), 1)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count.alias("size"), spot.alias("spot"))


def plan(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block_rows: int = 256, shard_blocks: int = 64, seed: int = 11) -> Plan:
    """Targets and cuts, from sums by source and by block of `rows` (sizes_of)."""
    # a row a source: code-point order, null last
    found = rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    names, sizes = [r[0] for r in found], [int(r[1] or 0) for r in found]
    target = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], float(sum(sizes)), most)
    made = Plan(names, sizes, target, [max(1, -(-r[2] // block_rows)) for r in found], seed, shard_blocks)
    part = [t - e * s for t, e, s in zip(target, made.whole.tolist(), sizes, strict=True)]
    if not names or max(part) < 0.5:
        return made
    spark = rows.sparkSession
    a, b = made.steps(made.whole)
    info = [(k, n, float(part[k]), int(made.blocks[k]), int(a[k]), int(b[k])) for k, n in enumerate(names) if part[k] >= 0.5]
    info = spark.createDataFrame(info, "k int, source string, part double, blocks long, a long, b long")
    # a row a source
    placed = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["source"])).withColumn("place", F.pmod(F.col("a") * F.pmod("spot", "blocks") + F.col("b"), "blocks"))
    placed = placed.select("k", "part", "place", F.expr(f"place div {_CHUNK}").alias("chunk"), "size", "spot", "doc_id")
    ordered = store.keep(placed.groupBy("k", "part", "chunk", "place").agg(F.sum("size").alias("size")), "mix-blocks")
    # prefix sums in two steps: over chunks, then within the chunk where the target lies
    reached = lambda upto: (upto - F.col("size") <= F.col("part")) & (upto > F.col("part"))
    over = Window.partitionBy("k").orderBy("chunk")
    chunks = ordered.groupBy("k", "part", "chunk").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(over)).where(reached(F.col("upto")))
    within = Window.partitionBy("k").orderBy("place")
    # a row a source on the small sides
    blocks = ordered.join(F.broadcast(chunks.select("k", "chunk", (F.col("upto") - F.col("size")).alias("base"))), ["k", "chunk"])
    blocks = blocks.withColumn("upto", F.col("base") + F.sum("size").over(within)).where(reached(F.col("upto")))
    # the block in which the target lies, one a source
    edge = {r[0]: (r[1], r[2]) for r in blocks.select("k", "place", (F.col("part") - F.col("upto") + F.col("size")).alias("need")).collect()}
    if not edge:
        return made
    edges = spark.createDataFrame([(k, *v) for k, v in edge.items()], "k int, place long, need double")
    near = placed.select("k", "place", "spot", "doc_id", "size").join(F.broadcast(edges), ["k", "place"]).groupBy("k", "place", "need", "spot", "doc_id").agg(F.sum("size").alias("size"))
    # a group is the documents of one block, repeated rows already added up
    columns = "k int, place long, spot long, id long, more array<long>, more_id array<long>, less array<long>, less_id array<long>"
    for k, at, spot, own, more, more_id, less, less_id in near.groupBy("k").applyInArrow(_edges, columns).collect():
        made.cut[k] = at
        made.edge[k], made.edge_id[k] = spot, own
        if more:
            made.more[k] = set(zip(more, more_id, strict=True))
        if less:
            made.less[k] = set(zip(less, less_id, strict=True))
    return made


def _edges(block: pa.Table) -> pa.Table:
    """The last document by hash whose prefix fits, and those of the block's others
    that fill what is then missing: the largest that fits, again and again, then
    the nearest if that is nearer than none."""
    ids = np.asarray(block.column("doc_id").fill_null(_NONE).combine_chunks()).astype(np.int64)
    spots, size = np.asarray(block.column("spot").combine_chunks()), np.asarray(block.column("size").combine_chunks())
    order = np.lexsort((ids, spots))
    ids, spots, size = ids[order], spots[order], size[order]
    need = block.column("need")[0].as_py()
    n = int(np.searchsorted(np.cumsum(size), need, side="right"))
    gap, left, more = need - float(size[:n].sum()), list(range(n, len(size))), []
    while left:
        fits = [k for k in left if 0 < size[k] <= gap]
        k = max(fits, key=lambda k: size[k]) if fits else min(left, key=lambda k: abs(size[k] - gap))
        if abs(size[k] - gap) >= gap:
            break
        more.append(k)
        left.remove(k)
        gap -= float(size[k])
    less = []
    for k in sorted(range(n), key=lambda k: -size[k]) if gap < 0 else ():
        if 0 < size[k] <= -gap:
            less.append(k)
            gap += float(size[k])
    row = [block.column("k")[0].as_py(), block.column("place")[0].as_py(), int(spots[n - 1]) if n else -1, int(ids[n - 1]) if n else _NONE, *([int(x[k]) for k in own] for own in (more, less) for x in (spots, ids))]
    return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4), strict=True)], names=["k", "place", "spot", "id", "more", "more_id", "less", "less_id"])


def draw(rows: DataFrame, made: Plan) -> DataFrame:
    """`rows` with their source's number, size and target, and places: for each
    time a document is taken its epoch, shard and rank in the shard's shuffle."""
    spark = rows.sparkSession
    info = spark.createDataFrame([(k, n, int(made.sizes[k]), float(made.target[k])) for k, n in enumerate(made.names)], "k int, name string, source_size long, target double")
    # a row a source
    named = rows.join(F.broadcast(info), rows["source"].eqNullSafe(info["name"])).drop("name", "source")
    pairs = pa.list_(pa.struct([("epoch", pa.int64()), ("shard", pa.int64()), ("rank", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int32()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("places", pairs)])

    def run(batches):
        tree, turns = made.tree(), [made.steps(e) for e in range(int(made.whole.max(initial=0)) + 1)]
        for rows in batches:
            k, spot = np.asarray(rows.column("k")).astype(np.int64), np.asarray(rows.column("spot"))
            ids = np.asarray(rows.column("doc_id").fill_null(_NONE))
            block = spot % made.blocks[k]
            row, epoch, shard, rank = [], [], [], []
            for e, (a, b) in enumerate(turns):
                at = np.flatnonzero(e <= made.whole[k])
                place = (a[k[at]] * block[at] + b[k[at]]) % made.blocks[k[at]]
                own, s, i = k[at], spot[at], ids[at]
                last = place == made.cut[own]
                cut = np.flatnonzero(last)
                own, s, i = own[cut], s[cut], i[cut]
                named = list(zip(own.tolist(), zip(s.tolist(), i.tolist(), strict=True), strict=True))
                more, less = (np.array([x in held.get(n, ()) for n, x in named], bool) for held in (made.more, made.less))
                last[cut] = ((s < made.edge[own]) | ((s == made.edge[own]) & (i <= made.edge_id[own])) | more) & ~less
                took = (e < made.whole[k[at]]) | (place < made.cut[k[at]]) | last
                at, place = at[took], place[took]
                row.append(at)
                epoch.append(np.full(len(at), e))
                shard.append(tree.shard(k[at], e * made.blocks[k[at]] + place))
                with np.errstate(over="ignore"):
                    rank.append((W.mix(spot[at].astype(np.uint64) + np.uint64(made.seed + 7919 * e)) >> np.uint64(1)).astype(np.int64))
            row, epoch, shard, rank = map(np.concatenate, (row, epoch, shard, rank))
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows.num_rows))]).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(x[order], pa.int64()) for x in (epoch, shard, rank)], ["epoch", "shard", "rank"])
            yield batch_of(schema, [*(rows.column(c) for c in ("doc_id", "k", "size", "source_size", "target")), pa.ListArray.from_arrays(pa.array(ends), inner)])

    return named.mapInArrow(run, "doc_id long, k int, size long, source_size long, target double, places array<struct<epoch: long, shard: long, rank: long>>")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row a document with its places in the mix."""
    rows = store.keep(sizes_of(docs), "mix-sizes")
    return draw(rows, plan(rows, **how))
