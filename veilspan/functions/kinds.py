"""Kinds, sources, confidence and labels, as literal maps.

All tables here are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds in report order, with precedence and placeholder label.
KINDS = {
    "email": (70, "EMAIL"),
    "phoneNumber": (50, "PHONE"),
    "address": (40, "ADDRESS"),
    "postalCode": (60, "POSTAL"),
    "personalName": (30, "NAME"),
    "organizationName": (20, "ORG"),
    "placeName": (10, "PLACE"),
    "myNumber": (100, "MYNUMBER"),
    "credential": (90, "SECRET"),
    "dictionaryTerm": (80, "TERM"),
}

LOW, MEDIUM, HIGH = 0, 1, 2
CONFIDENCE = ("low", "medium", "high")

#: Confidence that a source gives its spans when they carry none.
SOURCES = {
    "dataDetector": MEDIUM,
    "nameTagger": LOW,
    "regex": HIGH,
    "dictionary": HIGH,
    "languageModel": LOW,
    "credentialContext": MEDIUM,
    "ner": LOW,
}

MODEL_SOURCES = ("languageModel", "ner")

SPAN = "struct<kind: string, source: string, start: int, len: int, text: string, confidence: int>"
FINDING = "struct<kind: string, start: int, len: int, text: string, confidence: int, sources: array<string>>"


def _lookup(values: dict[str, object], key: Column) -> Column:
    """The value of a key in a literal map, null for others."""
    entries = ", ".join(f"'{k}', {v!r}" for k, v in values.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def precedence(kind: Column) -> Column:
    return _lookup({k: p for k, (p, _) in KINDS.items()}, kind)


def label(kind: Column) -> Column:
    return _lookup({k: name for k, (_, name) in KINDS.items()}, kind)


def report_order(kind: Column) -> Column:
    return _lookup({k: i for i, k in enumerate(KINDS)}, kind)


def base_confidence(source: Column) -> Column:
    return _lookup(SOURCES, source)


def effective_confidence(given: Column, source: Column) -> Column:
    """What the detector said, else what its source is worth."""
    return F.coalesce(given, base_confidence(source))


def promoted(confidence: Column) -> Column:
    return F.least(confidence + 1, F.lit(HIGH))


def confidence_name(confidence: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), confidence + 1)


def confidence_value(name: Column) -> Column:
    """The rank of a name, null for an unknown one."""
    return _lookup({c: i for i, c in enumerate(CONFIDENCE)}, name)
