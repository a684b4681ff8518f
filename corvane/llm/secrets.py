"""Secret scans: candidates by pattern, false positives removed by a forest.

Patterns find candidates in the whole text, of any length.  A random forest judges
each on its length, its character classes and their transitions, how far common
letter pairs and the words of a dictionary cover it, the document's path, and the
words beside it.  The dictionary is the lower-case words of four letters and more
in a tokenizer's vocabulary file, whose path is a parameter; without one no word
covers anything.  The forest is trained from labelled findings: rows of (value,
before, after, path, label); `findings` makes a documented set of them where a
user has none, `n` of which (2,400) are learned from.

A null or empty text has no candidate; equal texts have equal findings; a text
of any length is scanned whole; overlapping candidates of several patterns are
one, the first pattern's; an empty table gives no row; `redact` keeps all other
columns as they are.
"""

from __future__ import annotations

import bisect
import functools
import json
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import words as W
from corvane.llm.encode import batch_of
from corvane.llm.forest import Forest

#: name, what a match must contain, pattern with the value as group v
PATTERNS = (
    ("private_key", "-----BEGIN", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("cloud_key", "AKIA", r"\b(?P<v>AKIA[0-9A-Z]{16})\b"),
    ("forge_token", "gh", r"\b(?P<v>gh[pousr]_[A-Za-z0-9]{36,}+)\b"),
    ("chat_token", "xox", r"\b(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})\b"),
    ("map_key", "AIza", r"\b(?P<v>AIza[0-9A-Za-z_-]{35})\b"),
    ("web_token", "eyJ", r"\b(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    ("quoted", None, r"(?i:password|passwd|pwd|secret|token|api_?-?key|access_?-?key|auth_?-?key|credential)s?[\"']?[ \t]{0,4}(?::|=|=>|:=)[ \t]{0,4}(?P<q>[\"'])(?P<v>[^\s\"']{6,}+)(?P=q)"),
    ("assigned", None, r"(?i:password|passwd|pwd|secret|token|api_?-?key|access_?-?key|auth_?-?key|credential)s?[\"']?[ \t]{0,4}(?::|=|=>|:=)[ \t]{0,4}[\"']?(?P<v>[^\s\"'<>,;]{6,}+)"),
    ("opaque", None, r"(?<![0-9A-Za-z+/_=-])(?P<v>(?=[A-Za-z+/_-]*+[0-9])[0-9A-Za-z+/_-]{32,}+={0,2}+)(?![0-9A-Za-z+/_=-])"),
)
_RULES = [(name, must, re.compile(pattern)) for name, must, pattern in PATTERNS]
_KEY_END = re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_ASSIGN = re.compile(r"(?i)password|passwd|pwd|secret|token|key|credential")
#: fixed values: common letter pairs of the languages scanned
_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur qu la ie ei un ge sc ue ai ci os ad do".split())
#: fixed values: words that speak for a secret, and against
_FOR = ("password", "passwd", "pwd", "secret", "token", "api", "key", "credential", "auth", "access", "private", "bearer", "login")
_AGAINST = ("example", "sample", "dummy", "placeholder", "your", "changeme", "test", "sha", "md5", "hash", "checksum", "commit", "digest", "uuid", "guid", "revision", "etag", "fingerprint", "id", "isbn")
_NAMES = [r[0] for r in PATTERNS]
#: letters of a dictionary's words
_LEAST_WORD, _MOST_WORD = 4, 16


@functools.cache
def dictionary(path: str | None) -> frozenset[str]:
    """The words of a vocabulary file; a mark of the space before them is no letter."""
    if path is None:
        return frozenset()
    with open(path, encoding="utf-8") as f:
        known = json.load(f)["model"]["vocab"]
    found = (w.lstrip("\u0120\u2581") for w in known)
    return frozenset(w for w in found if len(w) >= _LEAST_WORD and w.isascii() and w.isalpha() and w.islower())


def covered(value: str, words: frozenset[str]) -> float:
    """The share of a value that words cover, the longest first at each place."""
    lower, k, n = value.lower(), 0, 0
    while k < len(lower):
        size = next((m for m in range(min(_MOST_WORD, len(lower) - k), _LEAST_WORD - 1, -1) if lower[k : k + m] in words), 0)
        n += size
        k += size or 1
    return n / max(len(lower), 1)


def _keys(text: str, rule: re.Pattern):
    """Each begin mark of a private key with the first end mark behind it."""
    ends, k, at = [m.end() for m in _KEY_END.finditer(text)], 0, 0
    for m in rule.finditer(text):
        if m.start() < at:
            continue
        while k < len(ends) and ends[k] <= m.end():
            k += 1
        if k == len(ends):
            return
        at = ends[k]
        yield m.start(), at


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and pattern of each candidate, disjoint and in order."""
    found: list[tuple[int, int, str]] = []  # in order, so a clash is beside its place
    for name, must, rule in _RULES:
        if name in ("quoted", "assigned") and not _ASSIGN.search(text):
            continue
        if must is None or must in text:
            for a, b in _keys(text, rule) if name == "private_key" else (m.span("v") for m in rule.finditer(text)):
                k = bisect.bisect_left(found, (a, b))
                if (k == 0 or found[k - 1][1] <= a) and (k == len(found) or b <= found[k][0]):
                    found.insert(k, (a, b, name))
    return found


def describe(value: str, before: str, after: str, path: str, kind: str, known: frozenset[str] = frozenset()) -> list[float]:
    """The features of one candidate."""
    n = len(value)
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value]
    share = [classes.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(classes[:-1], classes[1:], strict=True)) / max(n - 1, 1)
    counts = np.array([value.count(c) for c in set(value)]) / n
    entropy = float(-(counts * np.log2(counts)).sum())
    lower = value.lower()
    pairs = sum(lower[k : k + 2] in _PAIRS for k in range(n - 1)) / max(n - 1, 1)
    words = re.findall(r"[a-z]+", before.lower())[-4:]
    beside = re.findall(r"[a-z]+", after.lower())[:3]
    near = sum(any(w.startswith(x) or w.endswith(x) for x in _FOR) for w in words)
    far = sum(w in _AGAINST for w in [*words, *beside]) + sum(x in lower for x in _AGAINST if len(x) > 4)
    where = path.lower()
    quoted = before[-1:] in "\"'" if before else False
    repeat = max((len(m[0]) for m in re.finditer(r"(.)\1*", value, re.S)), default=0) / n
    return [n, *share, moves, entropy, pairs, covered(value, known), len(set(value)) / n, near, far, float(any(x in where for x in ("test", "example", "doc", "sample"))), float(quoted), float(re.search(r"[:=]>?\s*[\"']?$", before) is not None), repeat, float(_NAMES.index(kind))]


def findings(n: int = 2_400, seed: int = 3) -> list[tuple[str, str, str, str, bool]]:
    """Labelled findings: (value, before, after, path, is a secret).  Half are
    secrets of the known forms; half are what scanners wrongly report: ordinary
    words after a keyword, placeholders, checksums, identifiers and long words."""
    r = random.Random(seed)
    hexes, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice(sorted(_PAIRS)) for _ in range(r.randint(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))
    key = lambda: r.choice(["token", "password", "secret", "api_key", "apikey", "access_key", "auth_key", "credential", "db_password", "client_secret"])
    ident = lambda: r.choice(["commit", "sha", "md5", "checksum", "digest", "etag", "revision", "uuid", "fingerprint", "hash"])
    join = lambda: r.choice([" = ", "=", ": ", ":"])
    out = []
    for k in range(n):
        path = r.choice(["src0", "web/page", "blog", "config/prod", "app/main", "forum", ""])
        after, quote = " " + prose(3), r.choice(['"', "'", ""])
        if k % 2:
            form = r.randrange(9)
            before = f"{prose(4)} {key()}{join()}{quote}"
            if form == 0:
                value, before = "AKIA" + some(upper, 16), r.choice([f"{prose(4)} ", before])
            elif form == 1:
                value, before = "gh" + r.choice("pousr") + "_" + some(mixed, 36), r.choice([f"{prose(4)} ", before])
            elif form == 2:
                value, before = "eyJ" + some(mixed, 20) + "." + some(mixed, 40) + "." + some(mixed, 30), r.choice([f"{prose(3)} bearer ", before])
            elif form == 3:
                value, before = "AIza" + some(mixed + "_-", 35), r.choice([f"{prose(4)} ", before])
            elif form == 4:
                value = some(mixed + "!#%+*_-", r.randint(10, 24))
            elif form == 5:
                value = some(mixed, r.randint(24, 64))
            elif form == 6:
                value = "xoxb-" + some("0123456789", 12) + "-" + some(mixed, 24)
            elif form == 7:
                value, before = some(mixed + "+/", r.choice([r.randint(100, 300), 300, 400, 1_000])), r.choice([f"{prose(4)} ", before])
            else:
                value = some(hexes, r.choice([16, 18, 20, 24, 32, 40, 64]))
            out.append((value, before, quote + after, path, True))
        else:
            form = r.randrange(8)
            if form == 0:
                value, before = word() + word(), f"{prose(3)} {key()}{join()}{quote}"
            elif form == 1:
                value, before = r.choice(["changeme", "your_password", "xxxxxxxx", "********", "placeholder", "example-token", "<redacted>", "your-api-key-here", "password123", "000000000000", "undefined", "required"]), f"{prose(3)} {key()}{join()}{quote}"
            elif form == 2:
                value, before = some(hexes, r.choice([32, 40, 64])), f"{prose(3)} {ident()}{r.choice([' ', ': ', '=', ' '])}"
            elif form == 3:
                value, before = some(hexes, 8) + "-" + "-".join(some(hexes, 4) for _ in range(3)) + "-" + some(hexes, 12), f"{prose(3)} {r.choice(['id', 'uuid', 'guid'])} "
            elif form == 4:
                value, before = "-".join(word() for _ in range(8)) + "-" + some("0123456789", 2), f"{prose(4)} "
            elif form == 5:
                value, before = some("0123456789", r.choice([r.randint(32, 48), r.randint(100, 1_000)])), f"{prose(4)} "
            elif form == 6:
                value, before = r.choice("-/_").join(word() for _ in range(r.randint(20, 200))) + "-" + some("0123456789", 2), r.choice([f"{prose(4)} ", f"{prose(3)} {key()}{join()}{quote}"])
            else:
                value, before = "/".join(word() for _ in range(9)) + "/" + some("0123456789", 3), f"{prose(4)} "
                path = r.choice(["docs/api", "tests/data", path])
            out.append((value, before, after, path, False))
    return out


def _kind(value: str, before: str = "") -> str:
    for name, must, rule in _RULES:
        if name == "private_key" and value.startswith(must):
            return name
        if name not in ("private_key", "quoted", "assigned") and (must is None or must in value) and (m := rule.search(value)) and m.span("v") == (0, len(value)):
            return name
    return "quoted" if before[-1:] in ("'", '"') else "assigned"


def train(rows: list[tuple[str, str, str, str, bool]] | None = None, words: str | None = None) -> Forest:
    """The forest of some labelled findings."""
    rows = findings() if rows is None else rows
    x = np.array([describe(v, before, after, path or "", _kind(v, before), dictionary(words)) for v, before, after, path, _ in rows])
    return Forest().fit(x, np.array([r[4] for r in rows]))


@functools.cache
def _default(words: str | None) -> Forest:
    return train(words=words)


def _judged(text: str | None, path: str | None, forest: Forest, known: frozenset[str]) -> list[tuple[int, int, str, float]]:
    found = candidates(text) if text else []
    if not found:
        return []
    x = np.array([describe(text[a:b], text[max(0, a - 60) : a], text[b : b + 40], path or "", kind, known) for a, b, kind in found])
    return [(*f, float(p)) for f, p in zip(found, forest.predict(x), strict=True)]


def scan(docs: DataFrame, forest: Forest | None = None, words: str | None = None, least: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, its span in code points, the pattern,
    the forest's probability and verdict.  A forest of one's own must have been
    trained with the same dictionary `words`."""
    forest = forest or _default(words)
    known = docs.sparkSession.sparkContext.broadcast(dictionary(words))  # as large as the vocabulary file
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())])

    def run(batches):
        for batch in batches:
            out = []
            for rows in W.slices(batch):
                for doc, text, path in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                    out += [(doc, a, b, kind, p, p >= least) for a, b, kind, p in _judged(text, path, forest, known.value)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield batch_of(schema, [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(W.frugal(run), "doc_id long, start long, stop long, kind string, score double, secret boolean")


def redact(docs: DataFrame, forest: Forest | None = None, words: str | None = None, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret in text replaced; n_chars follows where it was
    the length."""
    forest, names = forest or _default(words), docs.columns
    known = docs.sparkSession.sparkContext.broadcast(dictionary(words))

    def run(batches):
        for batch in batches:
            for rows in W.slices(batch):
                texts, paths = rows.column("text").to_pylist(), rows.column("source").to_pylist()
                changed = {}
                for k, (text, path) in enumerate(zip(texts, paths, strict=True)):
                    bad = [f for f in _judged(text, path, forest, known.value) if f[3] >= least]
                    for a, b, _, _ in reversed(bad):
                        text = text[:a] + mark + text[b:]
                    if bad:
                        changed[k] = text
                columns = dict(zip(names, rows.columns, strict=True))
                if changed:
                    columns["text"] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], columns["text"].type)
                    if "n_chars" in columns:
                        old = columns["n_chars"].to_pylist()
                        columns["n_chars"] = pa.array([len(changed[k]) if k in changed and old[k] == len(texts[k]) else v for k, v in enumerate(old)], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(W.frugal(run), docs.schema)
