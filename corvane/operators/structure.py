"""Blocks, chunks and their ids.

Blocks come from a line automaton and chunks from a greedy fill, both stateful
within a document, so they run on Arrow batches; everything after is built in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.batches import small

PARENT, CHILD, OVERLAP = 850, 350, 50
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_QUESTION = re.compile(r"^(?:Q:|Question:|FAQ:|\d+\.\s+Q:)", re.I)

Counter = Callable[[str], int]


def quarter(text: str) -> int:
    """The offline token estimate."""
    return math.ceil(len(text) / 4)


def blocks(text: str | None) -> list[tuple[str, str]]:
    """(kind, content) of each block: text, table, code_block or qa_pair.

    A question block goes on until a table or a fence.  A fence directly after a
    table leaves the automaton in its table state, so a table after it is text."""
    out: list[tuple[str, str]] = []
    kind, held, fenced, table = "text", [], False, False

    def close(after: str) -> None:
        nonlocal kind, held
        content = "\n".join(held).strip()
        if content:
            out.append((kind, content))
        kind, held = after, []

    for line in (text or "").split("\n"):
        if line.strip().startswith("```"):
            if fenced:
                held.append(line)
                close("text")
            else:
                close("code_block")
                held.append(line)
            fenced = not fenced
        elif fenced:
            held.append(line)
        elif _TABLE.match(line):
            if not table:
                close("table")
                table = True
            held.append(line)
        else:
            if table:
                table = False
                close("text")
            if _QUESTION.match(line) and kind != "qa_pair":
                close("qa_pair")
            held.append(line)
    close("text")
    return out


def _tail(chunk: str, budget: int, count: Counter) -> str:
    """Whole last lines within the budget, one at least."""
    if budget <= 0 or not chunk.strip():
        return ""
    kept, used = [], 0
    for line in reversed(chunk.strip().split("\n")):
        n = count(line) if line else 0
        # an empty line adds a line feed, so something is kept from then on
        if kept and used + n > budget:
            break
        kept.append(line)
        used += n
    return "".join(line + "\n" for line in reversed(kept))


def _units(text: str, most: int, count: Counter) -> Iterator[tuple[str, str, bool]]:
    """Pieces that aren't cut: paragraphs, or the lines of a long one; the flag
    marks the start of a long paragraph."""
    for paragraph in re.split(r"\n\s*\n", text):
        if count(paragraph) <= most:
            yield paragraph, "\n\n", False
        else:
            for k, line in enumerate(paragraph.split("\n")):
                yield line, "\n", k == 0


def split(text: str | None, most: int, overlap: int = 0, count: Counter = quarter) -> list[str]:
    """Chunks of at most `most` tokens where the pieces allow it, each beginning
    with the last lines of the one before.  A long paragraph ends the chunk
    before it; its first line may not fit beside the overlap, which then is a
    chunk of its own."""
    if not text or not text.strip():
        return []
    if count(text) <= most:
        return [text.strip()]
    out: list[str] = []
    held, used = "", 0
    size = lambda x: count(x) if x else 0

    def end() -> str:
        rest = _tail(held, overlap, count)
        out.append(held.strip())
        return rest

    for piece, gap, long in _units(text, most, lambda x: size(x)):
        n = size(piece)
        if long and held.strip():
            held = end()
            used = size(held)
        if used + n > most and held.strip():
            held = end() + piece + gap
            used = size(held)
        else:
            held += piece + gap
            used += n
    if held.strip():
        out.append(held.strip())
    return out


_BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("content", pa.string())]))
_CHUNKS = pa.list_(pa.struct([("parent", pa.int32()), ("child", pa.int32()), ("parent_id", pa.string()), ("parent_text", pa.string()), ("text", pa.string())]))
CHUNK = "array<struct<parent: int, child: int, parent_id: string, parent_text: string, text: string>>"


def with_blocks(pages: DataFrame, column: str = "text") -> DataFrame:
    """`pages` with the blocks of a column."""
    names = pages.columns

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "content": c} for k, c in blocks(t)] for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _BLOCKS)], names=[*names, "blocks"])

    return pages.mapInArrow(small(run, column), pages.withColumn("blocks", F.array().cast("array<struct<kind: string, content: string>>")).schema)


def source_text(found: list[tuple[str, str]]) -> str:
    """The text that is chunked: tables and code stand apart."""
    return "\n\n".join(f"\n\n{c}\n\n" if k in ("code_block", "table") else c for k, c in found)


def chunked(text: str | None, count: Counter = quarter, parent: int = PARENT, child: int = CHILD, overlap: int = OVERLAP) -> list[dict]:
    """All child chunks of a document with their parents."""
    found = blocks(text)
    out = []
    for p, own in enumerate(split(source_text(found) if found else text, parent, overlap, count)):
        key = f"parent_{p}_{count(own)}"
        out += [{"parent": p, "child": c, "parent_id": key, "parent_text": own, "text": t} for c, t in enumerate(split(own, child, overlap, count))]
    return out


def with_chunks(pages: DataFrame, column: str = "text", count: Counter = quarter) -> DataFrame:
    """A row for each child chunk of each page."""
    names = pages.columns

    def run(batches):
        for b in batches:
            found = [chunked(t, count) for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _CHUNKS)], names=[*names, "chunk"])

    rows = pages.mapInArrow(small(run, column), pages.withColumn("chunk", F.lit(None).cast(CHUNK)).schema)
    rows = rows.withColumn("chunk", F.explode("chunk"))
    parts = [F.col(f"chunk.{c}").alias(n) for c, n in (("parent", "parent_index"), ("child", "child_no"), ("parent_id", "parent_id"), ("parent_text", "parent_text"), ("text", "chunk_text"))]
    return rows.select(*names, *parts).withColumn("child_index", F.concat_ws("_", "parent_index", "child_no"))


def context_header(title: Column, kind: Column, url: Column, topics: Column) -> Column:
    """Title, type, URL and the first five headings; only the first underscore of
    the type becomes a space."""
    name = F.when(F.coalesce(title, F.lit("")).isin("", "Untitled Page"), "Page").otherwise(title)
    label = F.when(F.coalesce(kind, F.lit("")) == "", "document").otherwise(F.regexp_replace(kind, "^([^_]*)_", "$1 "))
    said = F.array_join(F.filter(F.slice(topics, 1, 5), lambda x: x != ""), " > ")
    where = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(" | URL: "), url)).otherwise("")
    return F.concat(F.lit("Document Title: "), name, F.lit(" | Page Type: "), label, where, F.when(said != "", F.concat(F.lit(" | Topics: "), said)).otherwise(""))


def contextual(text: Column, title: Column, header: Column) -> Column:
    """A chunk's text under its page's title and header."""
    page = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("[Page: "), title, F.lit("]\n"))).otherwise("")
    return F.concat(page, F.when(F.coalesce(header, F.lit("")) != "", F.concat(F.lit("[Document Context: "), header, F.lit("]\n\n"))).otherwise(""), text)


def point_id(url: Column, index: Column, text: Column) -> Column:
    """A UUID of version 4's form from url, chunk index and text."""
    h = F.sha2(F.concat_ws("::", url, index, F.sha2(text, 256)), 256)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
