"""N-gram Jaccard self-join by chosen paths.

A document's set is its five-word shingles (fewer words: one shingle of all).
Documents with equal sets are one class, represented by the least doc_id; only
classes are compared, so copies cost one row each.

A class has a MinHash signature.  In each run a tree splits the classes: a node
samples a coordinate, always one and with some probability a second (on average
1 / threshold), and a class goes to the child of its value there, so a pair that
shares a sampled token stays together with at least the chance of a branching
process that doesn't die out.  Nodes of one class end; nodes of at most `small`
classes are leaves and are compared by brute force; larger ones split on, up to
`depth`, where what is left is compared in blocks, every block with every other,
so no bucket is capped.  Leaves grow with the corpus at one depth, so the depth
grows by one with each tenfold number of classes.  The number of runs follows from the recall wanted of a
pair at the threshold that needs the full depth and whose signatures agree in
2.5 standard deviations less than they should; other pairs have more.

In a leaf, signatures name the pairs worth checking (a pair that is above the
threshold is missed with the probability of 5 standard deviations), and the
whole shingle sets of those classes are then compared exactly.  A pair that
meets in several leaves counts in the least of its common leaves, which each
side can tell from its own list of leaves; so links are counted without a row a
pair, and a leaf gives each class its links and a component label.

A null or empty text, or one without a word, has the empty set: all of them are
one class, linked to nothing.  Repeated rows are copies.  An empty table gives
no row.  A text of any length is whole.  A null doc_id sorts before all others.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import graph, store
from corvane.llm import words as W
from corvane.llm.encode import batch_of

WIDTH, COORDINATES = 5, 128
#: rows of two numbers that are broadcast at most, about 16 MB
FEW = 500_000
_NONE = -(1 << 63)
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all rows, each ascending and distinct, and their offsets."""
    n = len(offsets) - 1
    starts, ends = W.words(data, offsets)
    row = W.rows_of(starts, offsets)
    h = W.hashes(data, starts, ends)
    window, whole = W.windows(h, row, WIDTH)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    short = np.zeros(len(few), np.uint64)
    for k in range(WIDTH - 1):
        on = count[few] > k
        with np.errstate(over="ignore"):
            short[on] = W.mix(short[on] * np.uint64(0x9E3779B97F4A7C15) + h[first[few[on]] + k] + np.uint64(1))
    value, of = np.concatenate([window[whole], short]), np.concatenate([row[whole], few])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def signatures(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash of each set, zeros for an empty one."""
    out = np.zeros((len(ends) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        x, first = (value >> np.uint64(32)).astype(np.uint32), ends[:-1][full]
        for k in range(COORDINATES):
            h = x * _A[k] + _B[k]
            h ^= h >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(h, first)
    return out


def class_ids(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each set."""
    raw = value.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)


def _deviation(threshold: float) -> float:
    return math.sqrt(threshold * (1 - threshold) / COORDINATES)


def runs_needed(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with this probability."""
    p, second = 1.0, 1 / threshold - 1
    agree = threshold - 2.5 * _deviation(threshold)
    for _ in range(depth):
        q = agree * p
        p = (1 - second) * q + second * (1 - (1 - q) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def depth_for(classes: int) -> int:
    """Levels of splits: four up to a million classes, one more for each tenfold."""
    return 4 + max(0, math.ceil(math.log10(max(classes, 1)) - 6))


def children(parent: np.ndarray, sig: np.ndarray, threshold: float, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the children to which each (node, signature) goes."""
    own = np.arange(len(parent))
    with np.errstate(over="ignore"):
        draw = W.mix(parent + np.uint64(0x51ED270B7F4A7C15))
    a = (draw % np.uint64(COORDINATES)).astype(np.int64) if first is None else first
    b = (a + 1 + ((draw >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    more = (draw >> np.uint64(40)).astype(float) / (1 << 24) < 1 / threshold - 1
    rows, at = np.concatenate([own, own[more]]), np.concatenate([a, b[more]])
    with np.errstate(over="ignore"):
        return rows, W.mix(parent[rows] * np.uint64(0x9E3779B97F4A7C15) + (at.astype(np.uint64) << np.uint64(32)) + sig[rows, at].astype(np.uint64))


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = W.flat(column)
    return data.view(np.uint32).reshape(-1, COORDINATES)


def sketch(docs: DataFrame, signed: bool = True) -> DataFrame:
    """doc_id, class, size of the set, signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            for rows in W.slices(batch):
                value, ends = shingles(*W.flat(rows.column("text")))
                sig = [x.tobytes() for x in signatures(value, ends)] if signed else [None] * rows.num_rows
                yield batch_of(schema, [rows.column("doc_id"), class_ids(value, ends), np.diff(ends), pa.array(sig, pa.binary())])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(W.frugal(run), "doc_id long, cid long, n long, sig binary")


_PATHS = pa.schema([("path", pa.int64()), ("cid", pa.int64())])


def _begin(runs: int, threshold: float):
    def run(batches):
        for batch in batches:
            sig, cid = _matrix(batch.column("sig")), np.asarray(batch.column("cid"))
            for r in range(runs):
                root = np.full(len(cid), W.mix(np.array([r + 1], np.uint64))[0])
                row, path = children(root, sig, threshold, np.full(len(cid), r % COORDINATES))
                again, path = children(path, sig[row], threshold)
                yield batch_of(_PATHS, [path.view(np.int64), cid[row[again]]])

    return run


def _split(threshold: float):
    def run(batches):
        for batch in batches:
            row, path = children(np.asarray(batch.column("path")).view(np.uint64), _matrix(batch.column("sig")), threshold)
            yield batch_of(_PATHS, [path.view(np.int64), np.asarray(batch.column("cid"))[row]])

    return run


def leaves(classes: DataFrame, runs: int, threshold: float, depth: int, small: int, block: int) -> DataFrame:
    """path, cid, parts: the classes of each leaf, and into how many blocks it
    falls."""
    paths = store.keep(classes.where("n > 0").select("cid", "sig").mapInArrow(W.frugal(_begin(runs, threshold)), "path long, cid long"), "paths")
    found = []
    for level in range(2, depth + 1):
        # a table, so that both sides of the join are plain and a hot path can be dealt out
        many = store.keep(paths.groupBy("path").count().where("count > 1"), "many")
        sized = store.keep(paths.join(many, "path"), "sized")
        parts = F.lit(1).cast("long") if level < depth else F.ceil(F.greatest(F.col("count") - small, F.lit(0)) / block) + F.when(F.col("count") > small, 0).otherwise(1)
        found.append(sized.where(F.lit(level == depth) | (F.col("count") <= small)).select("path", "cid", parts.cast("int").alias("parts")))
        big = sized.where(f"count > {small}")
        if level == depth or big.isEmpty():
            break
        paths = store.keep(big.select("path", "cid").join(classes.select("cid", "sig"), "cid").mapInArrow(W.frugal(_split(threshold)), "path long, cid long"), "paths")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i <= j) of its leaf in which a class is;
    side tells in which."""
    own = F.pmod(F.xxhash64("cid", "path"), F.col("parts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - F.lit(1).cast("long"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return rows.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side")).drop("own", "other")


def _groups(batches, key: tuple[str, ...] = ("path", "i", "j")):
    """Whole groups of rows sorted by key, however batches cut them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = np.stack([np.asarray(table.column(c).combine_chunks()) for c in key], 1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        ends = [0, *cut.tolist()]
        table = table.combine_chunks()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(ends[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _products(row: np.ndarray, which: np.ndarray, rows: int) -> np.ndarray:
    """How many of `which` each two rows have in common."""
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    shared = np.zeros((rows, rows), np.float32)
    wide = max(1, 4_000_000 // rows)
    for low in range(0, int(which[-1]) + 1 if len(which) else 0, wide):
        x, y = np.searchsorted(which, [low, low + wide])
        part = np.zeros((rows, min(wide, int(which[-1]) + 1 - low)), np.float32)
        part[row[x:y], which[x:y] - low] = 1
        shared += part @ part.T
    return shared


def _own_pairs(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) count here: those of whose common leaves this
    is the least; in a pair of two blocks, those across them."""
    path, side = _column(table, "path")[0].as_py(), np.asarray(_column(table, "side"))
    across = _column(table, "i")[0].as_py() != _column(table, "j")[0].as_py()
    lists = [x[x < path] for x in (np.frombuffer(x, np.int64) for x in _column(table, "all").to_pylist())]
    _, which, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(lists)), list(map(len, lists))), times > 1
    place = np.cumsum(often) - 1
    row, which = row[often[which]], place[which[often[which]]]
    good = _products(row, which, len(lists))[a, b] == 0
    return good & (side[a] != side[b]) if across else good


def _near(cut: float):
    schema = pa.schema([("path", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.bool_()), ("cid", pa.int64()), ("all", pa.binary())])

    def run(batches):
        for table in _groups(batches):
            sig = _matrix(_column(table, "sig"))
            a, b = [], []
            step = max(1, 8_000_000 // (len(sig) * COORDINATES))
            for k in range(0, len(sig), step):
                same = (sig[k : k + step, None] == sig[None]).sum(2)
                x, y = np.nonzero(same >= cut * COORDINATES)
                a.append(x[x + k < y] + k)
                b.append(y[x + k < y])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                own = _own_pairs(table, a, b)
                used = np.unique(np.concatenate([a[own], b[own]]))
                if len(used):
                    yield batch_of(schema, [_column(table, c).take(pa.array(used)) for c in schema.names])

    return run


def _compare(threshold: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])

    def run(batches):
        for table in _groups(batches):
            sets = [np.frombuffer(x, np.uint64) for x in _column(table, "value").to_pylist()]
            n = np.array(list(map(len, sets)))
            m = len(n)
            _, which = np.unique(np.concatenate(sets), return_inverse=True)
            shared = _products(np.repeat(np.arange(m), n), which, m)
            a, b = np.nonzero(np.triu(shared >= threshold * (n[:, None] + n[None] - shared) - 1e-3, 1))
            # decided in whole numbers
            inter = np.rint(shared[a, b]).astype(np.int64)
            exact = 1_000_000 * inter >= round(1_000_000 * threshold) * (n[a] + n[b] - inter)
            a, b = a[exact], b[exact]
            if not len(a):
                continue
            own = _own_pairs(table, a, b)
            a, b = a[own], b[own]
            cid = np.asarray(_column(table, "cid"))
            label = cid.copy()
            while True:
                before = label.copy()
                np.minimum.at(label, a, before[b])
                np.minimum.at(label, b, before[a])
                if (label == before).all():
                    break
            links = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
            got = links > 0
            yield batch_of(schema, [cid[got], links[got], label[got]])

    return run


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, value: the shingle sets of the wanted classes (cid, id)."""
    schema = pa.schema([("cid", pa.int64()), ("value", pa.binary())])

    def run(batches):
        for batch in batches:
            for rows in W.slices(batch):
                value, ends = shingles(*W.flat(rows.column("text")))
                same = np.flatnonzero(class_ids(value, ends) == np.asarray(rows.column("cid")))
                yield batch_of(schema, [rows.column("cid").take(pa.array(same)), pa.array([value[ends[k] : ends[k + 1]].tobytes() for k in same.tolist()], pa.binary())])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("id"), F.col("text").cast("string"))
    # repeated rows of a representative are few: a class has one of each doc_id and text
    return texts.join(wanted, "id").select("cid", "text").mapInArrow(W.frugal(run), "cid long, value binary").dropDuplicates(["cid"])


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, depth: int | None = None, small: int = 64, block: int = 512) -> DataFrame:
    """doc_id, class_id (least doc_id with the same set), n_copies of the class,
    n_links (other classes at the threshold or above), group_id (least class_id
    of the component that links make), and cid."""
    drawn = store.keep(sketch(docs), "sketch", rows=1_000)
    least = F.min(F.coalesce("doc_id", F.lit(_NONE))).alias("id")
    classes = store.keep(drawn.groupBy("cid").agg(least, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    depth = depth_for(classes.count()) if depth is None else depth
    found = store.keep(leaves(classes, runs_needed(recall, threshold, depth), threshold, depth, small, block), "leaves")
    # a class has as many leaves as the runs and their branches
    lists = found.groupBy("cid").agg(F.sort_array(F.collect_list("path")).alias("all"))
    schema = pa.schema([("cid", pa.int64()), ("all", pa.binary())])

    def packed(batches):
        for batch in batches:
            yield batch_of(schema, [batch.column("cid"), pa.array([np.array(x, np.int64).tobytes() for x in batch.column("all").to_pylist()], pa.binary())])

    lists = lists.mapInArrow(W.frugal(packed), "cid long, all binary").join(classes.select("cid", "sig"), "cid")
    rows = _blocks(found.join(store.keep(lists, "lists"), "cid"))
    parts = max(store.parts(docs.sparkSession), 1)
    key = ("path", "i", "j")
    cut = threshold - 5 * _deviation(threshold)
    near = rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(W.frugal(_near(cut)), "path long, i long, j long, side boolean, cid long, all binary")
    near = store.keep(near, "near")
    wanted = store.keep(near.select("cid").distinct().join(classes.select("cid", "id"), "cid"), "wanted")
    sets = store.keep(_sets(docs, store.small(wanted, FEW)), "sets", rows=1_000)
    checked = near.join(sets, "cid").repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(W.frugal(_compare(threshold)), "cid long, links long, label long")
    checked = store.keep(checked, "checked", rows=1_000)
    roots = graph.components(checked.select(F.col("cid").alias("a"), F.col("label").alias("b")))
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    # a component's least document, from the classes that have links
    linked = classes.select("cid", "id").join(links, "cid").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "links", "id", F.coalesce("root", "cid").alias("root"))
    linked = store.keep(linked, "linked")
    group = linked.groupBy("root").agg(F.min("id").alias("group"))
    info = classes.select("cid", "id", "copies").join(linked.drop("id").join(group, "root"), "cid", "left")
    info = store.keep(info.select("cid", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "id").alias("group")), "classes")
    null = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return drawn.select("doc_id", "cid").join(info, "cid").select("doc_id", null("id").alias("class_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"), null("group").alias("group_id"), "cid")


def firsts(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each group, the one with the least doc_id.

    Where doc_id is a key, which one sum over the ids tells, what goes is found
    by its id, and texts aren't shuffled while few go; else by id and class."""
    found = store.keep(join(docs, **how).select(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.coalesce("group_id", F.lit(_NONE)).alias("group"), "cid"), "groups")
    key, cls = store.fresh(docs, "corvane_id"), store.fresh(docs, "corvane_class")
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)))
    if found.groupBy("id").count().where("count > 1").isEmpty():
        gone = store.small(store.keep(found.where("id <> group").select(F.col("id").alias(key)), "gone"), FEW)
        return rows.join(gone, key, "left_anti").select(*docs.columns)
    kept = store.keep(found.where("id = group").select(F.col("id").alias(key), F.col("cid").alias(cls)).distinct(), "firsts")
    # repeated rows of a kept document: the join's partitioning serves
    return with_class(rows, cls).join(kept, [key, cls]).dropDuplicates([key, cls]).select(*docs.columns)


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with the class of each row as a column `name`."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            for rows in W.slices(batch):
                cid = class_ids(*shingles(*W.flat(rows.column("text"))))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cid, pa.int64())], names=[*names, name])

    return docs.mapInArrow(W.frugal(run), docs.select("*", F.lit(0).cast("long").alias(name)).schema)
