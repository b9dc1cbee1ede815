"""Hosts for models that callers bring: a token tagger and a language model.

The callables run in Python workers, on Arrow batches; they are made once per worker
by a factory, so a model is loaded there and not shipped. Without one the layer is
reported as disabled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.kinds import SPAN
from .operators.batches import Chunk, narrowed, pack
from .operators.lexicon import Names, has_japanese

WINDOW, OVERLAP = 254, 64


class Token(NamedTuple):
    """An id and its place in the line; empty for one that spells nothing."""

    id: int
    start: int
    end: int


class Tagger(Protocol):
    """tokenize(line) -> tokens; predict(ids) -> a label per id, 0 none, 1 begins a
    name, 2 goes on; ``cls`` and ``sep`` frame every window."""

    cls: int
    sep: int

    def tokenize(self, line: str) -> list[Token]: ...

    def predict(self, ids: list[int]) -> list[int]: ...


def bio_spans(tokens: list[Token], labels: list[int]) -> list[tuple[int, int]]:
    """B opens a span, I goes on or opens one, an empty token closes."""
    out: list[tuple[int, int]] = []
    is_open = False
    for t, label in zip(tokens, labels):
        if t.start == t.end:
            is_open = False
        elif label == 2 and is_open:
            out[-1] = (out[-1][0], t.end)
        elif label in (1, 2):
            out.append((t.start, t.end))
            is_open = True
        else:
            is_open = False
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans become one; those that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def tagged_spans(tagger: Tagger, line: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of a line of any length, by windows that overlap."""
    tokens, found, at = tagger.tokenize(line), [], 0
    while True:
        part = tokens[at : at + window]
        labels = tagger.predict([tagger.cls, *(t.id for t in part), tagger.sep])
        if len(labels) != len(part) + 2:
            raise ValueError(f"the tagger gave {len(labels)} labels for {len(part) + 2} ids")
        found += bio_spans(part, labels[1:-1])
        if at + window >= len(tokens):
            return merge_spans(found)
        at += window - overlap


def tagged_names(tagger: Tagger, text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, text) of the plausible names of a text, line by line."""
    out, base = [], 0
    for line in text.split("\n"):
        if line.strip():
            for s, e in tagged_spans(tagger, line):
                t = line[s:e]
                if names.plausible_span(t) and (has_japanese(t) or names.latin(t)):
                    out.append((base + s, base + e, t))
        base += len(line) + 1
    return out


class Run(NamedTuple):
    found: list[tuple[int, int, str]]
    ungrounded: list[str]
    failures: list[tuple[int, int, int, str]]


def run_chunks(text: str, chunks: list[Chunk], respond: Callable[[str], list[str]], retry: Callable[[Exception], bool] = lambda e: False, started: Callable[[int, int], None] = lambda i, n: None, accept: Callable[[str, str], bool] = lambda t, c: True) -> Run:
    """Ask for each chunk, once more for its Japanese alone where ``retry`` says so;
    ground every answer at all its places. A failing chunk is noted and the rest go
    on; answers that don't occur are counted and dropped."""
    found, lost, failures = [], [], []
    for k, chunk in enumerate(chunks):
        started(k + 1, len(chunks))
        sent = chunk
        try:
            try:
                answers = respond(sent.text)
            except Exception as e:
                smaller = narrowed(chunk, text) if retry(e) else None
                if smaller is None:
                    raise
                sent = smaller
                answers = respond(sent.text)
        except Exception as e:  # one chunk's failure must not lose the others
            failures.append((k + 1, len(chunks), len(chunk.text), str(e)))
            continue
        for answer in answers:
            if not answer or not accept(answer, sent.text):
                continue
            at = sent.text.find(answer)
            if at < 0:
                lost.append(answer)
            while at >= 0:
                place = sent.origin(at, len(answer))
                if place is not None:
                    found.append((place, place + len(answer), text[place : place + len(answer)]))
                at = sent.text.find(answer, at + len(answer))
    return Run(found, lost, failures)


_SPAN = pa.struct([("kind", pa.string()), ("source", pa.string()), ("start", pa.int32()), ("len", pa.int32()), ("text", pa.string()), ("confidence", pa.int32())])
_FAILURE = pa.struct([("index", pa.int32()), ("total", pa.int32()), ("characters", pa.int32()), ("reason", pa.string())])
_STATE = pa.struct([("token", pa.string()), ("detail", pa.string())])


def _with(docs: DataFrame, ddl: str) -> StructType:
    return StructType([*docs.schema.fields, *StructType.fromDDL(ddl).fields])


def _rows(found: list[tuple[int, int, str]], source: str) -> list[dict]:
    return [{"kind": "personalName", "source": source, "start": s, "len": e - s, "text": t, "confidence": None} for s, e, t in found]


def with_tagger(docs: DataFrame, make: Callable[[], Tagger] | None, names: Names | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``ner_spans`` and ``ner_state``. Without a factory the layer is
    disabled; a document on which the tagger fails carries the reason."""
    if make is None:
        return docs.withColumns({"ner_spans": F.array().cast(f"array<{SPAN}>"), "ner_state": F.struct(F.lit("disabled").alias("token"), F.lit(None).cast("string").alias("detail"))})
    lists = names or Names()
    schema = _with(docs, f"ner_spans array<{SPAN}>, ner_state struct<token: string, detail: string>")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None
        for batch in batches:
            spans, states = [], []
            for text in batch.column(at).to_pylist():
                try:
                    tagger = tagger or make()
                    spans.append(_rows(tagged_names(tagger, text or "", lists), "ner"))
                    states.append({"token": "used", "detail": None})
                except Exception as e:  # reported with the document
                    spans.append([])
                    states.append({"token": "failed", "detail": str(e)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(_SPAN)), pa.array(states, _STATE)], [*batch.schema.names, "ner_spans", "ner_state"])

    return docs.mapInArrow(run, schema)


def with_language_model(docs: DataFrame, make: Callable[[], Callable[[str], list[str]]] | None, names: Names | None = None, retry: Callable[[Exception], bool] = lambda e: False, text_col: str = "text", limit: int = 1500) -> DataFrame:
    """docs with ``model_spans``, ``model_state``, ``model_failures`` and
    ``model_ungrounded``. Only lines with Japanese are sent."""
    failures = "array<struct<index: int, total: int, characters: int, reason: string>>"
    if make is None:
        return docs.withColumns({
            "model_spans": F.array().cast(f"array<{SPAN}>"), "model_state": F.struct(F.lit("disabled").alias("token"), F.lit(None).cast("string").alias("detail")),
            "model_failures": F.array().cast(failures), "model_ungrounded": F.array().cast("array<string>"),
        })
    lists = names or Names()
    schema = _with(docs, f"model_spans array<{SPAN}>, model_state struct<token: string, detail: string>, model_failures {failures}, model_ungrounded array<string>")
    at = docs.columns.index(text_col)

    def lines(text: str) -> list[tuple[str, int]]:
        out, base = [], 0
        for line in text.split("\n"):
            if has_japanese(line):
                out.append((line, base))
            base += len(line) + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        respond, broken = None, None
        for batch in batches:
            spans, states, failed, lost = [], [], [], []
            for text in batch.column(at).to_pylist():
                text = text or ""
                try:
                    respond = respond or make()
                except Exception as e:
                    broken = str(e)
                if respond is None:
                    spans.append([]), states.append({"token": "unavailable", "detail": broken}), failed.append([]), lost.append([])
                    continue
                r = run_chunks(text, pack(lines(text), limit), respond, retry, accept=lists.plausible_answer)
                spans.append(_rows(r.found + lists.mentions(r.found, text), "languageModel"))
                states.append({"token": "used", "detail": None})
                failed.append([dict(zip(("index", "total", "characters", "reason"), f)) for f in r.failures])
                lost.append(r.ungrounded)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans, pa.list_(_SPAN)), pa.array(states, _STATE), pa.array(failed, pa.list_(_FAILURE)), pa.array(lost, pa.list_(pa.string()))],
                [*batch.schema.names, "model_spans", "model_state", "model_failures", "model_ungrounded"],
            )

    return docs.mapInArrow(run, schema)
