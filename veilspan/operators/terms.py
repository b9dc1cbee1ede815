"""User terms: case- and width-insensitive search, longest term first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import empty, occurrences, overlap
from ..functions.text import _fold_pairs, fold

#: Terms are part of the plan: a longer list belongs in a table and a join.
MAX_TERMS = 5000


def prepared(terms: list[str]) -> list[str]:
    """Trimmed, without blanks and repeats, the longest first."""
    kept = dict.fromkeys(t.strip() for t in terms if t and t.strip())
    return sorted(kept, key=lambda t: (-len(t), t))


def term_spans(text: Column, terms: list[str]) -> Column:
    """Each term's occurrences, leaving out those that overlap one taken before;
    the text as written is reported."""
    ordered = prepared(terms)
    if len(ordered) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    if not ordered:
        return empty()
    table = str.maketrans(*_fold_pairs())
    folded, needles = fold(text), [t.translate(table) for t in ordered]
    any_term = "|".join(re.escape(n) for n in needles)

    def sized(n: str) -> Column:
        return F.transform(occurrences(folded, F.lit(n)), lambda s: F.struct(s.alias("start"), F.lit(len(n)).cast("int").alias("len")))

    found = F.concat(*[sized(n) for n in needles])
    taken = F.aggregate(
        found, F.array().cast("array<struct<start: int, len: int>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    out = F.transform(taken, lambda x: F.struct(
        F.lit("dictionaryTerm").alias("kind"), F.lit("dictionary").alias("source"), x["start"].alias("start"), x["len"].alias("len"),
        F.substring(text, x["start"] + 1, x["len"]).alias("text"), F.lit(None).cast("int").alias("confidence"),
    ))
    return F.when(folded.rlike(any_term), out).otherwise(empty())
