"""Spans: where a pattern matches, and relations between intervals.

Offsets are code points, as Spark's string functions count; UTF-16 offsets are made
where a report needs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import SPAN


def empty(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once. Named inside a lambda, an expression
    would run again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that a fold appends one by one; longer arrays are folded in blocks, so
#: that appending, which copies, stays cheap.
BLOCK = 64


def blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK elements; of none for an empty one."""
    return let(values, lambda v: F.transform(
        F.sequence(F.lit(1), F.size(v) + 1, F.lit(BLOCK)), lambda at: F.slice(v, at, F.lit(BLOCK)),
    ))


def _scan(values: Column, first: Column, combine: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct(
        combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"),
    ), lambda acc: acc["out"])


def prefix(values: Column, zero: int, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element what combine makes of all before it, for an associative
    combine over integers."""
    def over(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero).cast("int"), lambda a, x: combine(a, x).cast("int")))
        return F.flatten(F.zip_with(parts, _scan(totals, F.lit(zero), combine), lambda p, base: _scan(p, base, combine)))

    return let(blocks(values), over)


def _add(a: Column, b: Column) -> Column:
    return a + b


def clusters(spans: Column) -> Column:
    """Spans in order of start, as arrays of those that overlap, directly or through
    others. What relates spans of a document does so within a cluster, so quadratic
    steps stay small however many spans there are."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["len"]).alias("b"), s["kind"].alias("k"), s.alias("s"))))

    def cut(ordered: Column) -> Column:
        # a cluster begins where all before have ended
        reach = prefix(F.transform(ordered, end), -1, lambda a, b: F.greatest(a, b))
        begins = F.filter(F.transform(F.arrays_zip(F.transform(ordered, lambda s: s["start"]).alias("s"), reach.alias("r")), lambda x, i: F.when(x["s"] >= x["r"], i)), lambda i: i.isNotNull())
        return let(begins, lambda heads: F.transform(heads, lambda h, j: F.slice(ordered, h + 1, F.coalesce(F.get(heads, j + 1), F.size(ordered)) - h)))

    return let(F.transform(keyed, lambda x: x["s"]), cut)


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and the lengths of the pieces between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))


def _place(hits: Column, gaps: Column) -> Column:
    """(start, text) of matches, from the pieces between them: a running sum of both.
    The last piece has no match after it; either side is named once, so it runs once."""
    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))), lambda p: p["hit"].isNotNull())

    def placed(found: Column) -> Column:
        before = prefix(F.transform(found, lambda p: p["gap"] + F.char_length(p["hit"])), 0, _add)
        return F.zip_with(found, before, lambda p, at: F.struct((at + p["gap"]).cast("int").alias("start"), p["hit"].alias("text")))

    return let(pairs, placed)


def matches(text: Column, pattern: str) -> Column:
    """(start, text) of all non-overlapping matches. Spark gives the matches and the
    pieces between them but no places. The pattern must not match the empty string."""
    return _place(*_cut(text, pattern))


def spans_of_many(text: Column, patterns: list[tuple[str, str, str, Column]]) -> Column:
    """Spans of many patterns (kind, source, pattern, guard). What places the matches
    is one expression for all of them, so that the plan stays small and quick to make."""
    rows = F.array(*[
        F.when(guard, F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), hits.alias("hits"), gaps.alias("gaps")))
        for kind, source, (hits, gaps), guard in ((k, s, _cut(text, p), g) for k, s, p, g in patterns)
    ])

    def placed(row: Column) -> Column:
        return F.transform(_place(row["hits"], row["gaps"]), lambda m: F.struct(
            row["kind"].alias("kind"), row["source"].alias("source"), m["start"].alias("start"), F.char_length(m["text"]).cast("int").alias("len"),
            m["text"].alias("text"), F.lit(None).cast("int").alias("confidence"),
        ))

    return F.flatten(F.transform(F.filter(rows, lambda r: r.isNotNull()), placed))


def span(kind: str, source: str, start: Column, text: Column, confidence: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(source).alias("source"), start.cast("int").alias("start"),
        F.char_length(text).cast("int").alias("len"), text.alias("text"),
        (F.lit(None) if confidence is None else confidence).cast("int").alias("confidence"),
    )


def spans(text: Column, pattern: str, kind: str, source: str, guard: Column | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern's matches. ``guard`` is a cheap test without which the
    pattern is not run; ``keep`` filters by the matched text."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["text"]))
    out = F.transform(found, lambda m: span(kind, source, m["start"], m["text"]))
    return out if guard is None else F.when(guard, out).otherwise(empty())


def occurrences(text: Column, needle: Column) -> Column:
    """Starts of all non-overlapping occurrences of a literal; none for an empty one."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.transform(F.split(text, quoted, -1), lambda x: F.char_length(x))
    size = F.char_length(needle)

    def starts(gaps: Column) -> Column:
        # after the last piece there is none
        ends = F.zip_with(gaps, prefix(F.transform(gaps, lambda g: g + size), 0, _add), lambda g, at: (at + g).cast("int"))
        return F.slice(ends, F.lit(1), F.size(gaps) - 1)

    return F.when(size > 0, let(pieces, starts)).otherwise(F.array().cast("array<int>"))


def end(s: Column) -> Column:
    return s["start"] + s["len"]


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < end(b)) & (b["start"] < end(a)) & (a["len"] > 0) & (b["len"] > 0)


def contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (end(outer) >= end(inner))


def utf16(text: Column, points: Column) -> Column:
    """UTF-16 units in the first ``points`` code points."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), points), "UTF-16BE")) / 2).cast("int")
