"""Personal data: patterns, and information-theoretic sanitisation around them.

Base entities (e-mail, IPv4, card, phone) are found by pattern. A term that the
corpus sees next to one entity value, and hardly elsewhere, reveals that entity even
where the value itself is masked. With documents as events, over all documents:

    information of entity e      I(e) = log(N / n(e))
    what term t reveals of it    PMI(e; t) = log(N * n(e, t) / (n(e) * n(t)))

n(e, t) counts documents with t near e. The share PMI / I, 1 at most, is the
disclosure; a term at ``generalise`` or above is generalised to its shape, at
``remove`` or above it is removed. One co-occurrence proves nothing: a pair counts when
it is significant, by a Chernoff bound on meeting as often by chance, times the number
of pairs looked at. For this, documents of equal text count once.

Document frequencies of all terms are counted exactly, with 64-bit term hashes that
each task adds up before the shuffle. Contexts are only as many as entities.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8, materialize, slices, splitmix, word_hashes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "term")
#: Terms on either side of an entity that make up its context.
WINDOW = 8
#: Different texts that a pair needs besides being significant.
SUPPORT = 1
#: The chance that any pair of the corpus is taken for significant wrongly, at most.
SIGNIFICANCE = 0.01
GENERALISE, REMOVE = 0.85, 0.97
#: Distinct terms that a task holds before it passes its counts on.
HOLD = 1 << 20

#: Terms are runs of ASCII letters and digits and of all other non-ASCII bytes.
TERM_SPACE = np.ones(256, dtype=bool)
TERM_SPACE[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    TERM_SPACE[_lo:_hi] = False

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: No match begins inside a run of digits, as it would end as the run's first does;
#: this keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each @ outwards: linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Base entities by kind as listed, then start."""
    found = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CTX = pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SCAN = "id long, row long, d long, base array<struct<kind: string, start: bigint, end: bigint>>, ctx array<struct<e: bigint, t: bigint, c: bigint, start: bigint, end: bigint>>"


def _value_hash(kind: str, value: str) -> int:
    value = value.lower() if kind == "email" else _digits(value) if kind != "ip" else value
    h, _, _ = word_hashes(np.frombuffer(f"{kind}:{value}".encode(), np.uint8), np.array([0, len(f"{kind}:{value}".encode())]))
    return int(h[0].astype(np.int64))


def contexts(text: str, spans: list[Span], window: int = WINDOW) -> np.ndarray:
    """The terms near each entity, a row each: hashes of entity, term and context, and
    the term's place. A term inside any entity is none."""
    raw = text.encode()
    flat = np.frombuffer(raw, np.uint8)
    h, _, first = word_hashes(flat, np.array([0, len(raw)]), space=TERM_SPACE)
    if not len(h):
        return _NO_CONTEXT
    # places in code points: bytes that begin a character, counted
    point = np.cumsum((flat & 0xC0) != 0x80) - 1
    ends = np.flatnonzero(np.append(TERM_SPACE[flat], True))
    start = point[first]
    stop = np.append(point, point[-1] + 1)[ends[np.searchsorted(ends, first)]]
    free = np.ones(len(h), bool)
    for _, s, e in spans:
        free[np.searchsorted(stop, s, side="right") : np.searchsorted(start, e)] = False
    places = np.flatnonzero(free & (stop - start >= 3))
    starts = start[places]
    out = []
    for kind, s, e in spans:
        k = int(np.searchsorted(starts, s))
        near = places[max(0, k - window) : k + window]
        if len(near):
            context = splitmix(h[near] + np.arange(len(near), dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)
            one = np.empty((len(near), 5), np.int64)
            one[:, 0], one[:, 1], one[:, 2], one[:, 3], one[:, 4] = _value_hash(kind, text[s:e]), h[near].astype(np.int64), context, start[near], stop[near]
            out.append(one)
    return np.concatenate(out) if out else _NO_CONTEXT


_NO_CONTEXT = np.zeros((0, 5), np.int64)


def _context_column(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else _NO_CONTEXT
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    columns = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(5)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_CTX)))


def _scan(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            base, ctx = [], []
            for t in batch.column(2).to_pylist():
                spans = base_spans(t or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                ctx.append(contexts(t, spans, window) if spans else _NO_CONTEXT)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(base, pa.list_(_SPAN)), _context_column(ctx)], ["id", "row", "d", "base", "ctx"])

    return docs.mapInArrow(run, _SCAN)


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(t, n): in how many documents each term occurs, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            terms, back = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def out(terms: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(terms[at : at + (1 << 16)].astype(np.int64)), pa.array(n[at : at + (1 << 16)])], ["t", "n"])

        size = 0
        for batch in slices(batches, "x", limit=1 << 22):
            h, row, _ = word_hashes(*flat_utf8(batch.column(0)), space=TERM_SPACE)
            if not len(h):
                continue
            # distinct terms of each row: sort by row and hash together
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            terms, n = np.unique(h[first], return_counts=True)
            held.append((terms, n))
            size += len(terms)
            if size > 2 * HOLD:
                held = [merged()]
                size = len(held[0][0])
                if size > HOLD:
                    yield from out(*held.pop())
                    size = 0
        if held:
            yield from out(*merged())

    parts = docs.select(docs[text_col].cast("string").alias("x")).mapInArrow(run, "t long, n long")
    return parts.groupBy("t").agg(F.sum("n").alias("n"))


def disclosure(ctx: DataFrame, counts: DataFrame, total: int, support: int = SUPPORT, significance: float = SIGNIFICANCE) -> DataFrame:
    """(e, t, share) for the significant pairs of entity and term. ``ctx``: (row, d, e,
    t), a row per occurrence; d is a hash of the row's text."""
    each = ctx.select("e", "t", "d", "row").distinct().groupBy("e", "t", "d").agg(F.count(F.lit(1)).alias("docs"))
    pairs = materialize(each.groupBy("e", "t").agg(F.count(F.lit(1)).alias("seen"), F.sum("docs").alias("n_et")), "pii-pairs")
    rows = ctx.select("e", "d", "row").distinct().groupBy("e", "d").agg(F.count(F.lit(1)).alias("docs"))
    entity = rows.groupBy("e").agg(F.sum("docs").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    known = pairs.where(F.col("seen") >= support).join(entity, "e").join(counts, "t")
    # as many texts by chance: log P <= k - m - k log(k / m), where m are expected
    expected = F.col("texts") * F.col("n") / F.lit(float(max(total, 1)))
    chance = F.col("seen") - expected - F.col("seen") * F.log(F.col("seen") / expected)
    known = known.where((F.col("seen") > expected) & (chance <= F.lit(math.log(significance / max(pairs.count(), 1)))))
    info = F.log(F.lit(float(max(total, 1))) / F.col("n_e"))
    n_et = F.least("n_et", "n_e", "n")
    pmi = F.log(F.lit(float(max(total, 1))) * n_et / (F.col("n_e") * F.col("n")))
    return known.select("e", "t", F.when(info > 0, F.least(F.lit(1.0), pmi / info)).otherwise(F.lit(0.0)).alias("share"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """A row for each row of docs: id, base (entity spans), terms (spans of disclosing
    terms with their share and the action, ``generalise`` or ``remove``).

    Offsets are code points, ends exclusive. Null texts are empty. Rows are told
    apart by an own number, so repeated rows and null ids each keep their own result.
    An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), docs[text_col].cast("string").alias("t"))
    found = materialize(_scan(rows.withColumn("d", F.xxhash64("t")), window), "pii-scan")
    ctx = found.select("row", "d", F.explode("ctx").alias("x")).select("row", "d", "x.*")
    flagged = disclosure(ctx, term_counts(docs, text_col), found.count(), support).where(F.col("share") >= generalise)
    spans = (
        ctx.join(flagged, ["e", "t"])
        .groupBy("row", "start", "end").agg(F.max("share").alias("share"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    )
    action = F.transform("terms", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.share.alias("share"), F.when(x.share >= remove, "remove").otherwise("generalise").alias("action")))
    empty = F.array().cast("array<struct<start: bigint, end: bigint, share: double, action: string>>")
    return found.select("id", "row", "base").join(spans.select("row", action.alias("terms")), "row", "left").select("id", "base", F.coalesce("terms", empty).alias("terms"))


def shape(term: str) -> str:
    """What a generalised term becomes."""
    return "[NUMBER]" if term.isdigit() else "[CODE]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[WORD]"


def redact(text: str, base: list[Span], terms: list[tuple[int, int, str]]) -> str:
    """The text with entities replaced by their kind and terms generalised or
    removed. Longer spans win over those they touch."""
    spans = [(s, e, f"[{k.upper()}]") for k, s, e in base] + [(s, e, "" if a == "remove" else shape(text[s:e])) for s, e, a in terms]
    taken: list[tuple[int, int, str]] = []  # disjoint, in order
    for s, e, by in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        k = bisect_left(taken, (s, e, by))
        if (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or e <= taken[k][0]):
            taken.insert(k, (s, e, by))
    out, at = [], 0
    for s, e, by in taken:
        out += [text[at:s], by]
        at = e
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): the texts of docs with what ``sanitise`` found taken out. Rows that
    repeat an id should repeat its text: they share its spans. Rows without a result,
    null ids among them, get their base entities only."""
    spans = found.where("id IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("__id"), "terms")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))
    joined = texts.join(spans, texts["id"] == spans["__id"], "left").select("id", "t", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            out = []
            for t, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(None if t is None else redact(t, base_spans(t), [(x["start"], x["end"], x["action"]) for x in terms or []]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return joined.mapInArrow(run, "id long, text string")
