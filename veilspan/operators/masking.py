"""Masking: choose disjoint findings, number them, splice placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kinds import label
from ..functions.spans import blocks, clusters, let, overlap


def _greedy(findings: Column) -> Column:
    keyed = F.array_sort(F.transform(findings, lambda f: F.struct((-f["len"]).alias("a"), f["start"].alias("b"), f["kind"].alias("k"), f.alias("f"))))
    return let(F.transform(keyed, lambda x: x["f"]), lambda ordered: F.aggregate(
        ordered, F.slice(ordered, F.lit(1), F.lit(0)),
        lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x))),
    ))


def disjoint(findings: Column) -> Column:
    """Greedy choice: the longest first, then the leftmost. Findings only compete with
    those of their cluster."""
    return F.flatten(F.transform(clusters(findings), _greedy))


def numbered(chosen: Column) -> Column:
    """(start, len, text, kind, placeholder) in reading order. Numbers run per kind in
    order of first appearance; equal texts, compared as bytes, share one."""
    keyed = F.array_sort(F.transform(chosen, lambda f: F.struct(f["start"].alias("a"), f.alias("f"))))

    def of(ordered: Column) -> Column:
        def texts(kinds: Column) -> Column:
            return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.array_distinct(F.transform(F.filter(ordered, lambda g: g["kind"] == k), lambda g: g["text"]))))

        kinds = F.array_distinct(F.transform(ordered, lambda f: f["kind"]))
        return let(let(kinds, texts), lambda lists: F.transform(ordered, lambda f: one(f, lists)))

    def one(f: Column, lists: Column) -> Column:
        number = F.array_position(F.try_element_at(lists, f["kind"]), f["text"])
        return F.struct(
            f["start"].alias("start"), f["len"].alias("len"), f["text"].alias("text"), f["kind"].alias("kind"),
            F.concat(F.lit("["), label(f["kind"]), F.lit("_"), number.cast("string"), F.lit("]")).alias("placeholder"),
        )

    return let(F.transform(keyed, lambda x: x["f"]), of)


def splice(text: Column, replacements: Column) -> Column:
    """The text with replacements, which are disjoint and in reading order, put in. Each
    block of replacements works on its own stretch of the text, as a substring is
    found by counting from the start."""
    def stretch(block: Column, begin: Column, stop: Column) -> Column:
        piece = F.substring(text, begin + 1, stop - begin)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return let(piece, lambda p: F.aggregate(
            block, start,
            lambda acc, r: F.struct(
                (r["start"] + r["len"] - begin).cast("int").alias("at"),
                F.concat(acc["out"], F.array(F.substring(p, acc["at"] + 1, r["start"] - begin - acc["at"]), r["placeholder"])).alias("out"),
            ),
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(p, acc["at"] + 1, F.char_length(p))),
        ))

    def over(parts: Column) -> Column:
        # a stretch begins with its first replacement; what leads the first is its own
        begins = F.transform(parts, lambda b, i: F.when((i == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.get(b, F.lit(0))["start"]))

        def joined(heads: Column) -> Column:
            return F.array_join(F.transform(parts, lambda b, i: stretch(b, F.get(heads, i), F.coalesce(F.get(heads, i + 1), F.char_length(text)))), "")

        return let(begins, joined)

    # blocks() ends with an empty block when the count is a multiple: it has nothing to do
    filled = F.filter(blocks(replacements), lambda b: F.size(b) > 0)
    return F.when(F.size(replacements) == 0, text).otherwise(let(filled, over))


def replacements(findings: Column) -> Column:
    return numbered(disjoint(findings))


def with_placeholder(findings: Column, made: Column) -> Column:
    """Findings with the placeholder of the replacement of their range, or null.
    Replacements are disjoint, so a range names one."""
    key = lambda x: F.shiftleft(x["start"].cast("long"), 32) + x["len"]
    by_range = F.map_from_arrays(F.transform(made, key), F.transform(made, lambda r: F.struct(r["kind"].alias("kind"), r["placeholder"].alias("placeholder"))))

    def one(f: Column, places: Column) -> Column:
        hit = F.try_element_at(places, key(f))
        return F.struct(*[f[c].alias(c) for c in ("kind", "start", "len", "text", "confidence", "sources")], F.when(hit["kind"] == f["kind"], hit["placeholder"]).alias("placeholder"))

    return let(by_range, lambda places: F.transform(findings, lambda f: one(f, places)))
