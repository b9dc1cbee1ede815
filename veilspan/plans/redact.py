"""Detection and masking of a text column, in batch or streaming.

Without models the plan is one narrow stage of JVM expressions: no shuffle, no Python.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import masking, patterns, report
from ..operators.lexicon import Names
from ..operators.reconcile import reconcile
from ..operators.terms import term_spans
from ..plugins import Tagger, with_language_model, with_tagger


@dataclass
class Config:
    """terms: the user's list. tagger and model: factories of models, or None.
    use_tagger, use_model: False turns a given one off. given_names: the seed list
    of English names, empty to look for none. keep: a test of (text, span) that spans
    of the patterns must pass, a function of a module, or None."""

    terms: list[str] = field(default_factory=list)
    tagger: Callable[[], Tagger] | None = None
    model: Callable[[], Callable[[str], list[str]]] | None = None
    names: Names | None = None
    use_tagger: bool = True
    use_model: bool = True
    given_names: list[str] = field(default_factory=lambda: list(patterns.GIVEN_NAMES))
    keep: Callable[[Column, Column], Column] | None = None


@functools.lru_cache(maxsize=64)
def _built(gateway: int, make: Callable[..., Column], *args: object) -> Column:
    return make(*args)


def _column(make: Callable[..., Column], *args: object) -> Column:
    """make(*args), once per JVM: expressions are immutable, and sending a large one over
    takes longer than planning it. Streams and repeated calls gain most."""
    return _built(id(SparkContext._gateway), make, *args)


def raw_spans(text: str, terms: tuple[str, ...], given_names: tuple[str, ...], keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """All spans of the deterministic detectors over the column named ``text``."""
    return F.concat(patterns.all_spans(F.col(text), given_names, keep), term_spans(F.col(text), list(terms)))


def _reconciled(spans: str) -> Column:
    return reconcile(F.col(spans))


def _replacements(findings: str) -> Column:
    return masking.replacements(F.col(findings))


def _spliced(text: str, replacements: str) -> Column:
    return masking.splice(F.col(text), F.col(replacements))


def _placeholders(findings: str, replacements: str) -> Column:
    return masking.with_placeholder(F.col(findings), F.col(replacements))


#: Columns that the plans add, for good or on the way.
_DETECTED = ("findings", "model_state", "ner_state", "model_failures", "ner_spans", "model_spans", "model_ungrounded", "__spans")
_MASKED = (*_DETECTED, "masked", "replacements", "warnings")


def _free(df: DataFrame, names: tuple[str, ...]) -> None:
    taken = {c.lower() for c in df.columns} & set(names)
    if taken:
        raise ValueError(f"rename these columns first, the result has columns of the same name: {sorted(taken)}")


def detect(df: DataFrame, config: Config | None = None, text: str = "text", extra: str | None = None) -> DataFrame:
    """df with ``findings``, ``model_state``, ``ner_state`` and ``model_failures``. A null
    text is empty. ``extra`` names a column of further spans. A column of df with one of
    the names that are added is an error."""
    config = config or Config()
    _free(df, _DETECTED)
    df = df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = with_tagger(df, config.tagger if config.use_tagger else None, config.names, text_col=text)
    df = with_language_model(df, config.model if config.use_model else None, config.names, text_col=text)
    spans = [_column(raw_spans, text, tuple(config.terms), tuple(config.given_names), config.keep), F.col("ner_spans"), F.col("model_spans")] + ([F.col(extra)] if extra else [])
    # apart, so that neither spans nor findings are worked out twice
    df = df.withColumn("__spans", F.concat(*spans))
    return df.withColumn("findings", _column(_reconciled, "__spans")).drop("__spans", "ner_spans", "model_spans", "model_ungrounded")


def mask_with(df: DataFrame, findings: str = "findings", text: str = "text") -> DataFrame:
    """df with ``masked`` and ``replacements`` for a column of findings, which a caller
    may have filtered."""
    df = df.withColumn("replacements", _column(_replacements, findings))
    return df.withColumn("masked", _column(_spliced, text, "replacements"))


def mask(df: DataFrame, config: Config | None = None, text: str = "text", extra: str | None = None) -> DataFrame:
    """df with ``masked``, ``findings`` (with placeholders) and ``warnings``; see
    ``detect`` for columns of these names."""
    _free(df, _MASKED)
    df = mask_with(detect(df, config, text, extra), "findings", text)
    df = df.withColumn("findings", _column(_placeholders, "findings", "replacements"))
    return df.withColumn("warnings", report.warnings(F.col("model_state"), F.col("ner_state"), F.col("model_failures"))).drop("replacements", "model_failures")


def with_report(df: DataFrame, text: str = "text", pretty: bool = True) -> DataFrame:
    """A masked frame with ``report``: the JSON of each document."""
    return df.withColumn("report", report.report_json(F.col(text), F.col("masked"), F.col("findings"), F.col("model_state"), F.col("ner_state"), F.col("warnings"), pretty))


def long_findings(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per finding. The outer form keeps Catalyst from testing the array's size
    below, which would work the findings out twice."""
    return df.select(id_col, F.inline_outer("findings")).where("kind IS NOT NULL")
