"""Reconciliation of spans: merge, promote, drop what a stronger kind covers.

As columns over a document's array of spans, and as joins over a long table of spans
for documents with very many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import MODEL_SOURCES, base_confidence, effective_confidence, precedence, promoted
from ..functions.spans import clusters, contains, let, overlap


def merge_same_kind(spans: Column) -> Column:
    """One finding per kind and range. Its confidence is the best of its spans, one
    step up when several sources agree; sources are distinct and in name order."""
    keys = F.array_distinct(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["len"].alias("len"))))

    def merged(k: Column) -> Column:
        own = F.filter(spans, lambda s: (s["kind"] == k["kind"]) & (s["start"] == k["start"]) & (s["len"] == k["len"]))
        sources = F.array_sort(F.array_distinct(F.transform(own, lambda s: s["source"])))
        best = F.array_max(F.transform(own, lambda s: effective_confidence(s["confidence"], s["source"])))
        return F.struct(
            k["kind"].alias("kind"), k["start"].alias("start"), k["len"].alias("len"), F.get(own, F.lit(0))["text"].alias("text"),
            F.when(F.size(sources) > 1, promoted(best)).otherwise(best).cast("int").alias("confidence"), sources.alias("sources"),
        )

    return F.transform(keys, merged)


def model_only(sources: Column) -> Column:
    return F.size(F.array_except(sources, F.array(*[F.lit(s) for s in MODEL_SOURCES]))) == 0


def drops(other: Column, one: Column) -> Column:
    """Whether ``other`` removes ``one``: a stronger kind that contains it, or, for a
    finding of models alone, an overlapping surer finding of another layer."""
    stronger = contains(other, one) & (precedence(other["kind"]) > precedence(one["kind"]))
    base = F.coalesce(F.array_max(F.transform(one["sources"], base_confidence)), one["confidence"])
    yields = model_only(one["sources"]) & ~model_only(other["sources"]) & overlap(other, one) & (other["confidence"] > base)
    return (other["kind"] != one["kind"]) & (stronger | yields)


def apply_precedence(findings: Column) -> Column:
    """One pass over all findings: one that is dropped still drops others."""
    return let(findings, lambda fs: F.filter(fs, lambda one: ~F.exists(fs, lambda other: drops(other, one))))


def reading_order(findings: Column) -> Column:
    """By place; of those at one place the longest and strongest first."""
    keyed = F.transform(findings, lambda f: F.struct(f["start"].alias("a"), (-f["len"]).alias("b"), (-precedence(f["kind"])).alias("c"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def reconcile(spans: Column) -> Column:
    """All steps, cluster by cluster: spans that don't overlap have no say in each
    other's fate."""
    return F.flatten(F.transform(clusters(spans), lambda c: reading_order(apply_precedence(merge_same_kind(c)))))


def merge_long(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``merge_same_kind`` over a table of spans (id, kind, source, start, len, text,
    confidence): one shuffle by document and range."""
    sure = effective_confidence(F.col("confidence"), F.col("source"))
    out = spans.groupBy(id_col, "kind", "start", "len").agg(F.min("text").alias("text"), F.max(sure).alias("best"), F.sort_array(F.collect_set("source")).alias("sources"))
    return out.select(id_col, "kind", "start", "len", "text", F.when(F.size("sources") > 1, promoted(F.col("best"))).otherwise(F.col("best")).cast("int").alias("confidence"), "sources")


def precedence_long(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``apply_precedence`` as an anti join on the document with an interval residual."""
    fields = ["kind", "start", "len", "text", "confidence", "sources"]
    one = findings.select(id_col, F.struct(*fields).alias("one"))
    other = findings.select(F.col(id_col).alias("__id"), F.struct(*fields).alias("other"))
    return one.join(other, (F.col(id_col) == F.col("__id")) & drops(F.col("other"), F.col("one")), "left_anti").select(id_col, "one.*")
