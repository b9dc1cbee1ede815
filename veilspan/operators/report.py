"""The report of a document: JSON, layer states and warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kinds import confidence_name
from ..functions.spans import utf16

#: States of a layer; the reason is prose beside them.
STATES = ("used", "disabled", "unavailable", "failed")


def state(token: str, detail: str | None = None) -> Column:
    if token not in STATES:
        raise ValueError(f"unknown state {token}")
    return F.struct(F.lit(token).alias("token"), F.lit(detail).cast("string").alias("detail"))


def _begins(layer: str, s: Column) -> Column:
    return (
        F.when(s["token"] == "disabled", F.lit(f"{layer} disabled"))
        .when(s["token"] == "unavailable", F.concat(F.lit(f"{layer} "), s["detail"]))
        .when(s["token"] == "failed", F.concat(F.lit(f"{layer} failed ("), s["detail"], F.lit(")")))
    )


def warnings(model: Column, ner: Column, failures: Column | None = None) -> Column:
    """Sentences for every layer or chunk that did not run; empty only if all ran
    over the whole input. failures: array of (index, total, characters, reason)."""
    left = lambda other, name: F.when(other["token"] == "used", F.lit(f"; Japanese personal names were looked for by the {name} alone")).otherwise(F.lit("; Japanese personal names were not looked for"))
    out = F.filter(F.array(
        F.concat(_begins("language model", model), left(ner, "NER model")),
        F.concat(_begins("NER model", ner), left(model, "language model")),
    ), lambda x: x.isNotNull())
    if failures is None:
        return out
    return F.concat(out, F.transform(F.coalesce(failures, F.array().cast("array<struct<index: int, total: int, characters: int, reason: string>>")), lambda f: F.concat(
        F.lit("chunk "), f["index"].cast("string"), F.lit(" of "), f["total"].cast("string"), F.lit(" ("), f["characters"].cast("string"),
        F.lit(" characters) was not examined for names: "), f["reason"],
    )))


def reported(text: Column, findings: Column) -> Column:
    """Findings with UTF-16 location and length and the confidence by name; the
    fields are in the order of their names, as the JSON has them."""
    def one(f: Column) -> Column:
        location = utf16(text, f["start"])
        return F.struct(
            confidence_name(f["confidence"]).alias("confidence"), f["kind"].alias("kind"),
            (utf16(text, f["start"] + f["len"]) - location).alias("length"), location.alias("location"),
            f["placeholder"].alias("placeholder"), f["sources"].alias("sources"), f["text"].alias("text"),
        )

    return F.transform(findings, one)


def report_json(text: Column, masked: Column, findings: Column, model: Column, ner: Column, notes: Column, pretty: bool = True) -> Column:
    """One JSON object, keys sorted, null details and placeholders written."""
    body = F.struct(
        reported(text, findings).alias("findings"), masked.alias("masked"), model["token"].alias("model"), model["detail"].alias("modelDetail"),
        ner["token"].alias("ner"), ner["detail"].alias("nerDetail"), notes.alias("warnings"),
    )
    return F.to_json(body, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
