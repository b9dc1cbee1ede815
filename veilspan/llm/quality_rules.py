"""Quality rules as one threshold table, compiled into Spark expressions.

A rule is a row (name, measure, low, high): a document fails it when the measure is
below low or above high. ``compile_rules`` turns the table into one projection over
the measures; no user function runs. The measures need the words of a text once:
they are split in a projection of their own that Catalyst keeps apart, as its
output is used more than once.

Repeated 3-word windows are found by sorting, per document, one long per window
(40 bits of hash, 24 bits of position) and comparing the words of neighbours. A text in
which neighbours have equal hashes but different words, and one with more words than
there are positions, has its windows sorted by the words themselves. No row leaves its
task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this "
    "der die das und von zu den mit ist des dem im für auf ein eine "
    "le la les et de des en un une que qui est pour dans au par sur "
    "el los las y del se por con no su para es al lo"
).split()

#: Position bits of a packed window, and what is taken of the window's hash.
POSITION_BITS, HASH_MASK = 24, -1


class Rule(NamedTuple):
    """A document fails when measure < low or measure > high; None: no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules decide ``base_failed``.
BASE_RULES = (Rule("too_few_words", "n_words", low=50), Rule("repeated_words", "repeat_percent", high=50))

#: The rules of the method beside them.
RULES = (
    Rule("too_many_words", "n_words", high=10_000_000),
    Rule("word_length", "mean_word_length", low=2, high=14),
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("short_lines", "words_per_line", low=1.5),
    Rule("letters", "letter_ratio", low=0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def derived(c: dict[str, Column]) -> dict[str, Column]:
    """Ratios that rules may name, from the counted columns."""
    return {
        "repeat_percent": _ratio(F.lit(100.0) * c["n_repeat_words"], c["n_words"]),
        "mean_word_length": _ratio(c["word_chars"], c["n_words"]),
        "symbols_per_word": _ratio(c["n_symbols"], c["n_words"]),
        "stop_word_ratio": _ratio(c["n_stop_words"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
        "words_per_line": _ratio(c["n_words"], c["n_lines"]),
        "letter_ratio": _ratio(c["n_letters"], c["word_chars"]),
    }


def compile_rules(rules: tuple[Rule, ...], values: dict[str, Column]) -> Column:
    """The names of the rules that fail, as one array expression."""
    tests = []
    for r in rules:
        v = values[r.measure]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (v < r.low)
        if r.high is not None:
            bad = bad | (v > r.high)
        tests.append(F.when(bad, F.lit(r.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def _covered(hits: str) -> str:
    """Words under the windows that start at the sorted positions ``hits``."""
    return f"""
      aggregate({hits}, named_struct('upto', 0L, 'n', 0L),
        (a, p) -> named_struct('upto', p + 3L, 'n', a.n + p + 3L - greatest(a.upto, p)),
        a -> a.n)"""


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """id and the counted columns of each row. Null texts have no words."""
    words = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in (STOP_WORDS if stop_words is None else stop_words)) or "''"
    bits = POSITION_BITS
    first = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    split = first.selectExpr(
        "id", "t",
        r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '') AS w",
        r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]') AS l",
    )
    packed = split.selectExpr(
        "id", "t", "w", "l", "size(w) AS n",
        f"""CASE WHEN size(w) < 3 THEN array()
                 WHEN size(w) < {1 << bits} THEN sort_array(transform(sequence(0L, size(w) - 3L),
                   p -> (xxhash64(w[int(p)], w[int(p) + 1], w[int(p) + 2]) & {(HASH_MASK << bits) & ((1 << 64) - 1) if HASH_MASK > 0 else -(1 << bits)}L) | p))
            END AS s""",
    )
    low = f"{(1 << bits) - 1}L"
    # i: the window there and the next one in order have the same hash; few have
    alike = packed.selectExpr("id", "t", "w", "l", "n", "s", f"""CASE WHEN size(s) > 1 THEN
      filter(sequence(0, size(s) - 2), i -> shiftright(s[i], {bits}) = shiftright(s[i + 1], {bits})) ELSE array() END AS e""")
    p, q = f"int(s[i] & {low})", f"int(s[i + 1] & {low})"
    clash = f"exists(e, i -> NOT (w[{p}] = w[{q}] AND w[{p} + 1] = w[{q} + 1] AND w[{p} + 2] = w[{q} + 2]))"
    told = alike.selectExpr(
        "id", "t", "w", "l", "n", "s", "e",
        f"""CASE WHEN s IS NULL OR {clash} THEN array_sort(transform(sequence(0L, size(w) - 3L),
                   p -> named_struct('a', w[int(p)], 'b', w[int(p) + 1], 'c', w[int(p) + 2], 'p', p)))
            END AS big""",
    )
    neighbour = lambda o: f"(big[{o}].a = x.a AND big[{o}].b = x.b AND big[{o}].c = x.c)"
    hits = told.selectExpr(
        "id", "t", "w", "l", "n",
        f"""CASE WHEN big IS NULL THEN sort_array(array_distinct(flatten(transform(e, i -> array(s[i] & {low}, s[i + 1] & {low})))))
            ELSE sort_array(transform(filter(big, (x, i) -> (i > 0 AND {neighbour('i - 1')}) OR (i + 1 < size(big) AND {neighbour('i + 1')})), x -> x.p)) END AS hits""",
    )
    return hits.selectExpr(
        "id",
        "CAST(n AS BIGINT) AS n_words",
        "CAST(length(array_join(w, '')) AS BIGINT) AS word_chars",
        "CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT) AS n_symbols",
        "CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines",
        f"CAST({_covered('hits')} AS BIGINT) AS n_repeat_words",
        "CAST(size(l) AS BIGINT) AS n_lines",
        f"CAST(size(filter(w, x -> lower(x) IN ({words}))) AS BIGINT) AS n_stop_words",
        r"CAST(length(regexp_replace(t, '[^\\p{L}]+', '')) AS BIGINT) AS n_letters",
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, failed (rule names), kept.

    A null or empty text has no words and fails the base. Lines are cut at \\n and
    count when they have a word. A document is kept when it passes the base and
    every rule. One narrow stage: nothing is shuffled; repeated rows each get their
    own result; an empty table gives an empty result.
    """
    m = measured(docs, id_col, text_col)
    counts = {c: F.col(c) for c in m.columns if c != "id"}
    values = counts | derived(counts)
    base = F.size(compile_rules(base_rules, values)) > 0
    failed = compile_rules(rules, values)
    return m.select("id", *MEASURES, base.alias("base_failed"), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
