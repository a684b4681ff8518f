"""Media columns: interleaved sequences of text and media.

`parse` turns HTML into an ordered list of items, text or media reference, each
with its position; a media item has the digest it refers to and its caption (the
figure's figcaption, else alt).  `save` stores payloads content-addressed: a
payload of 8-bit samples becomes a 64-wide PGM image, whose header also holds the
unpadded length, in a Parquet table keyed by the SHA-256 of the stored form.
`features` reads the stored bytes back and computes what is wanted of each, and
`resolve` joins sequences to it by digest; positions and captions stay with the
reference, and a digest that isn't stored gives nulls.

Only references and small feature rows are shuffled, never payloads; copies of a
payload are stored once a task and merge when features are aggregated by digest.
A null text is an empty payload; equal texts give equal bytes and values; texts
of any length are one image; HTML that is null or without a tag gives its text
or nothing; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import store
from corvane.llm import words as W
from corvane.llm.encode import batch_of

WIDTH = 64
#: a digest is hot from this many items on, and from this share of all items on
LEAST_HOT, SHARES = 256, 10_000
_REF = re.compile(r"sha256:([0-9a-f]{64})\Z")
_HEAD = re.compile(rb"P5\n# (\d+) bytes\n(\d+) (\d+)\n255\n")
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("src", pa.string()), ("caption", pa.string())])
ITEMS = "array<struct<position: int, kind: string, text: string, digest: string, src: string, caption: string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Reader(HTMLParser):
    MEDIA = ("img", "video", "audio", "source", "embed")
    HIDDEN = ("script", "style", "noscript", "template")

    def __init__(self, shown: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        #: where open figures begin, and the media that one within them explained
        self.figures: list[int] = []
        self.explained: set[int] = set()
        #: tags in which text isn't shown, while they are open
        self.shown, self.hidden = shown, []

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "src": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN and tag not in self.shown:
            self.hidden.append(tag)
        elif tag == "figure":
            self.flush()
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            found = _REF.search(src)
            self.items.append({"kind": "media", "text": None, "digest": found and found[1], "src": src, "caption": dict(attrs).get("alt")})

    def handle_startendtag(self, tag, attrs):
        if tag in self.MEDIA:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.reverse()
            self.hidden.remove(tag)
            self.hidden.reverse()
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for k in range(self.figures[-1], len(self.items)) if said and self.figures else ():
                if self.items[k]["kind"] == "media" and k not in self.explained:
                    self.items[k]["caption"] = said
            self.caption = None
        elif tag == "figure":
            self.flush()
            if self.figures:
                self.explained.update(range(self.figures.pop(), len(self.items)))

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.text.append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page in order.  A caption is that of the innermost figure
    around a medium which has one; text in a tag that hides it and never ends is
    shown, as else the rest of the page would be lost."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if shown := frozenset(reader.hidden) - {"script", "style"}:
        reader = _Reader(shown)
        reader.feed(html or "")
        reader.close()
    reader.flush()
    return [{"position": k, **item} for k, item in enumerate(reader.items)]


def image(payload: bytes) -> bytes:
    """The stored form: a PGM of 8-bit samples, 64 wide, zeros at the end."""
    rows = max(1, -(-len(payload) // WIDTH))
    return b"P5\n# %d bytes\n%d %d\n255\n" % (len(payload), WIDTH, rows) + payload + bytes(rows * WIDTH - len(payload))


def samples(stored: bytes) -> tuple[int, bytes]:
    """The unpadded length and the padded payload of a stored image."""
    head = _HEAD.match(stored)
    body = stored[head.end() :]
    if len(body) != int(head[2]) * int(head[3]):
        raise ValueError("the image is cut short")
    return int(head[1]), body


def describe(body: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash of
    8 by 8 cells."""
    x = np.frombuffer(body, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    level = np.arange(256)
    mean = float((n * level).sum() / len(x))
    sd = float(np.sqrt((n * (level - mean) ** 2).sum() / len(x)))
    rows = len(x) // WIDTH
    columns = x.reshape(rows, 8, WIDTH // 8).sum(2, dtype=np.int64)
    edge = np.arange(8) * rows // 8
    height = np.maximum(np.diff(np.append(edge, rows)), 1)
    cells = np.add.reduceat(columns, edge, axis=0) / height[:, None]
    code = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"mean={mean:.3f};sd={sd:.3f};entropy={-float((p * np.log2(p)).sum()):.4f};hash={code}"


def save(docs: DataFrame, path: str) -> None:
    """Stores each text's payload."""
    schema = pa.schema([("digest", pa.string()), ("media", pa.binary())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for rows in W.slices(batch):
                data, ends = W.flat(rows.column("text"))
                keys, bodies = [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    stored = image(data[a:b].tobytes())
                    digest = hashlib.sha256(stored)
                    if digest.digest()[:12] not in seen:
                        seen.add(digest.digest()[:12])
                        keys.append(digest.hexdigest())
                        bodies.append(stored)
                if len(seen) > 500_000:
                    seen.clear()
                yield batch_of(schema, [pa.array(keys, pa.string()), pa.array(bodies, pa.binary())])

    docs.select(F.col("text").cast("string")).mapInArrow(run, "digest string, media binary").write.option("compression", "zstd").parquet(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored payload, from the bytes read back."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    schema = pa.schema([(n, pa.int64() if n in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            out = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                stored = media.as_py()
                n, body = samples(stored)
                own = hashlib.sha256(stored).hexdigest()
                if own != digest:
                    raise ValueError(f"stored media {digest} reads back as {own}")
                out.append((digest, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(stored), own, describe(body)))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield batch_of(schema, [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)])

    rows = spark.read.schema("digest string, media binary").parquet(path).mapInArrow(run, FEATURES)
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in names[1:]))


def sequences(pages: DataFrame) -> DataFrame:
    """doc_id and the items of its html."""
    schema = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(_ITEM))])

    def run(batches):
        for batch in batches:
            yield batch_of(schema, [batch.column("doc_id"), pa.array([parse(x) for x in batch.column("html").to_pylist()], pa.list_(_ITEM))])

    return pages.select(F.col("doc_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, f"doc_id long, items {ITEMS}")


def resolve(found: DataFrame, stored: DataFrame) -> DataFrame:
    """A row for each media item of `found` (sequences), with what is stored
    under its digest.

    Digests that many items refer to, at most SHARES of all items each and so at
    most SHARES of them, are counted first and joined by broadcast, so no task has
    all items of one; the others are shuffled."""
    items = found.select("doc_id", F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = store.keep(items.select("doc_id", "item.position", "item.caption", "item.src", F.col("item.digest").alias("digest")), "media-items")
    many = refs.where("digest is not null").groupBy("digest").count().where(F.col("count") > F.lit(max(LEAST_HOT, refs.count() // SHARES))).select("digest")
    hot, stored = store.keep(many, "media-hot"), store.keep(stored, "media-features")
    hot_rows = refs.join(F.broadcast(hot), "digest", "left_semi")
    held = F.broadcast(stored.join(F.broadcast(hot), "digest", "left_semi"))
    rest = refs.join(F.broadcast(hot), "digest", "left_anti")
    return rest.join(stored, "digest", "left").unionByName(hot_rows.join(held, "digest", "left"))


def illustrated(docs: DataFrame) -> DataFrame:
    """doc_id and a page that shows the text's stored image between a heading
    and a caption."""
    schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string())])

    def run(batches):
        for batch in batches:
            for rows in W.slices(batch):
                data, ends = W.flat(rows.column("text"))
                html = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    payload = data[a:b].tobytes()
                    html.append(f'<article><h1>Document</h1><figure><img src="sha256:{hashlib.sha256(image(payload)).hexdigest()}" alt="text"><figcaption>A text of {len(payload)} bytes</figcaption></figure><p>End.</p></article>')
                yield batch_of(schema, [rows.column("doc_id"), pa.array(html, pa.string())])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, html string")
