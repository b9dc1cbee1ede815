"""Packing of text pieces into chunks for a model, with a map back.

A piece is (text, offset). Lengths count code points. Pieces of a line concatenate to
the line; a chunk's mapping holds (place in chunk, place in text, length) per piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, MINIMUM = 1500, 32
_SENTENCE, _CLAUSE = "。！？!?", "、，,；;　 "
_J = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ々〆ヶ"
_RUN = re.compile(f"[{_J}](?:[ 　、。・：「」（）]*[{_J}])*")


class Chunk(NamedTuple):
    text: str
    mapping: list[tuple[int, int, int]]

    def origin(self, start: int, length: int) -> int | None:
        """Where a range of the chunk lies in the text; None across pieces."""
        entry = next((m for m in reversed(self.mapping) if m[0] <= start), None)
        if entry is None or start - entry[0] + length > entry[2]:
            return None
        return entry[1] + start - entry[0]


def cut(text: str, start: int, limit: int) -> int:
    """Where the piece from ``start`` on ends: after the last sentence end within the
    limit, else the last clause end, else at the limit. The first character is
    never a cut."""
    for ends in (_SENTENCE, _CLAUSE):
        at = max(text.rfind(c, start + 1, start + limit) for c in ends)
        if at >= 0:
            return at + 1
    return start + limit


def split_to_fit(text: str, offset: int, limit: int = LIMIT) -> list[tuple[str, int]]:
    if limit <= 0 or len(text) <= limit:
        return [(text, offset)]
    out, at = [], 0
    while at < len(text):
        stop = len(text) if len(text) - at <= limit else cut(text, at, limit)
        out.append((text[at:stop], offset + at))
        at = stop
    return out


def built(pieces: list[tuple[str, int]]) -> Chunk:
    mapping, at = [], 0
    for text, offset in pieces:
        mapping.append((at, offset, len(text)))
        at += len(text) + 1
    return Chunk("\n".join(t for t, _ in pieces), mapping)


def pack(segments: list[tuple[str, int]], limit: int = LIMIT, minimum: int = MINIMUM) -> list[Chunk]:
    """Pieces in order, as many to a chunk as fit with joining newlines. A chunk below
    the minimum joins its neighbour: the next joins a small one before it, else it
    joins the one before."""
    groups: list[list[tuple[str, int]]] = []
    size = 0
    for piece in (p for s in segments for p in split_to_fit(*s, limit)):
        more = len(piece[0])
        if groups and size + more + 1 <= limit:
            groups[-1].append(piece)
            size += more + 1
        else:
            groups.append([piece])
            size = more
    joined = lambda g: sum(len(t) + 1 for t, _ in g) - 1
    out: list[list[tuple[str, int]]] = []
    for g in groups:
        if out and (joined(out[-1]) < minimum or joined(g) < minimum):
            out[-1] = out[-1] + g
        else:
            out.append(g)
    return [built(g) for g in out]


def narrowed(chunk: Chunk, text: str) -> Chunk | None:
    """The chunk's runs of Japanese only; None when there are none."""
    runs = [(m[0], at + m.start()) for _, at, n in chunk.mapping for m in _RUN.finditer(text[at : at + n])]
    return built(runs) if runs else None


_MAP = pa.list_(pa.struct([("chunk_at", pa.int32()), ("text_at", pa.int32()), ("len", pa.int32())]))
SCHEMA = "id long, n int, total int, chunk string, mapping array<struct<chunk_at: int, text_at: int, len: int>>"


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", lines_col: str = "lines", limit: int = LIMIT, minimum: int = MINIMUM) -> DataFrame:
    """A row per chunk of each document's (offset, text) lines; a table function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks = pack([(x["text"], x["offset"]) for x in lines or []], limit, minimum)
                rows += [(i, k + 1, len(chunks), c.text, [{"chunk_at": a, "text_at": b, "len": n} for a, b, n in c.mapping]) for k, c in enumerate(chunks)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], _MAP),
            ], ["id", "n", "total", "chunk", "mapping"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(lines_col)).mapInArrow(run, SCHEMA)
