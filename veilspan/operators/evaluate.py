"""Evaluation of detections against a labelled corpus, as joins.

Corpus rows: sample (id, text, genre, writer), expected (id, n, kind, text, tags),
forbidden (id, n, text). Detections: (id, kind, source, start, len, text). Each result
is a DataFrame; joins are on the sample id with interval residuals.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import report_order
from ..functions.spans import end, occurrences, overlap
from ..functions.text import japanese_lines, written_script
from ..functions.unicode import nfkc

SCRIPTS = ("kanji", "hiragana", "katakana", "romaji", "mixed")
FORMS = ("full", "familyOnly", "givenOnly")
TAGS = (*SCRIPTS, *FORMS, "honorific")
GENRES = ("incident", "log", "slack", "markdown", "email", "messy")
WRITERS = ("opus", "sonnet", "haiku", "human")


class Corpus(NamedTuple):
    samples: DataFrame
    expected: DataFrame
    forbidden: DataFrame


def _at(alias: str) -> Column:
    return F.struct(F.col(f"{alias}.start"), F.col(f"{alias}.len"))


def _placed(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, n, ..., start, len): every occurrence of each text in its sample."""
    joined = texts.join(samples.select("id", F.col("text").alias("__text")), "id")
    return joined.withColumn("start", F.explode(occurrences(F.col("__text"), F.col("text")))).withColumn("len", F.char_length("text")).drop("__text")


def corpus_errors(c: Corpus) -> DataFrame:
    """(id, text): expected texts that their sample lacks."""
    joined = c.expected.join(c.samples.select("id", F.col("text").alias("__text")), "id")
    return joined.where(~F.contains(F.col("__text"), F.col("text"))).select("id", "text")


def kind_hits(c: Corpus, found: DataFrame) -> DataFrame:
    """(id, n, kind, text, hit) of each expectation that occurs: hit when any detection
    of its kind overlaps any of its places."""
    places = _placed(c.expected, c.samples)
    real = places.select("id", "n", "kind", "text").distinct()
    hit = places.alias("p").join(found.alias("d"), (F.col("p.id") == F.col("d.id")) & (F.col("p.kind") == F.col("d.kind")) & overlap(_at("p"), _at("d")), "left_semi").select("id", "n").distinct().withColumn("hit", F.lit(True))
    return real.join(hit, ["id", "n"], "left").select("id", "n", "kind", "text", F.coalesce("hit", F.lit(False)).alias("hit"))


def kind_recall(c: Corpus, found: DataFrame) -> DataFrame:
    """(kind, expected, hit, missed) in report order of kinds."""
    tally = kind_hits(c, found).groupBy("kind").agg(F.count(F.lit(1)).alias("expected"), F.sum(F.col("hit").cast("long")).alias("hit"))
    return tally.withColumn("missed", F.col("expected") - F.col("hit")).orderBy(report_order(F.col("kind")))


def unexpected(c: Corpus, found: DataFrame) -> DataFrame:
    """Detections that overlap no expectation of their kind."""
    places = _placed(c.expected, c.samples)
    known = found.join(c.samples.select("id"), "id", "left_semi")
    return known.alias("d").join(places.alias("p"), (F.col("p.id") == F.col("d.id")) & (F.col("p.kind") == F.col("d.kind")) & overlap(_at("p"), _at("d")), "left_anti")


def violations(c: Corpus, found: DataFrame) -> DataFrame:
    """(id, forbidden, kind, source, start, len, text): detections over text that must
    survive, one for each forbidden text and detection."""
    places = _placed(c.forbidden, c.samples)
    both = places.alias("p").join(found.alias("d"), (F.col("p.id") == F.col("d.id")) & overlap(_at("p"), _at("d")))
    return both.select(F.col("d.id").alias("id"), F.col("p.n").alias("n"), F.col("p.text").alias("forbidden"), "d.kind", "d.source", "d.start", "d.len", F.col("d.text").alias("text")).distinct().drop("n")


def render_kinds(c: Corpus, found: DataFrame) -> str:
    """The report as text. The corpus is labelled by hand, so its tables are small."""
    out = ["", "## Recall by kind", "", f"{'kind':<20} {'expected':>8} {'hit':>4} {'missed':>7}"]
    out += [f"{r['kind']:<20} {r['expected']:>8} {r['hit']:>4} {r['missed']:>7}" for r in kind_recall(c, found).collect()]
    for title, rows in (
        ("Missed (false negatives)", [f"{r['kind']}: {r['text']}" for r in kind_hits(c, found).where("NOT hit").orderBy("id", "n").collect()]),
        ("Unexpected detections (candidate false positives)", [f"[{r['id']}] {r['kind']}/{r['source']}: {r['text']!r}" for r in unexpected(c, found).orderBy("id", "start").collect()]),
        ("Violations (over-masking)", [f"[{r['id']}] {r['kind']}/{r['source']}: {r['text']!r} overlaps {r['forbidden']!r}" for r in violations(c, found).orderBy("id", "start").collect()]),
        ("Corpus errors", [f"[{r['id']}] expected text not present: {r['text']}" for r in corpus_errors(c).collect()]),
    ):
        if rows or title != "Corpus errors":
            out += ["", f"## {title}", "", *([f"  - {r}" for r in rows] or ["(none)"])]
    return "\n".join(out) + "\n"


# Names


def checked_detections(samples: DataFrame, detections: DataFrame) -> DataFrame:
    """(id, text, start, len, problem): detections (id, text, location, length in UTF-16
    units or both null) grounded in their samples. Without a place a name stands for
    all its occurrences. ``problem`` says what is wrong with an invalid one; its place
    is null."""
    d = detections.join(samples.select("id", F.col("text").alias("__text")), "id")
    wide = F.encode(F.col("__text"), "UTF-16BE")
    units = F.octet_length(wide) / 2
    # null where the range is out of bounds or cuts a surrogate pair
    inside = (F.col("location") >= 0) & (F.col("length") > 0) & (F.col("location") + F.col("length") <= units)
    actual = F.when(inside, F.expr("decode(substring(encode(__text, 'UTF-16BE'), location * 2 + 1, length * 2), 'UTF-16BE')"))
    start = F.when(inside, F.char_length(F.expr("decode(substring(encode(__text, 'UTF-16BE'), 1, location * 2), 'UTF-16BE')")))
    half = F.col("location").isNull() != F.col("length").isNull()
    given = F.col("location").isNotNull() & F.col("length").isNotNull()
    problem = (
        F.when(half, F.when(F.col("location").isNull(), F.lit("length but no location")).otherwise(F.lit("location but no length")))
        .when(given & ~inside, F.lit("out of bounds"))
        .when(given & (actual != F.col("text")), F.lit("does not match"))
        .when(~given & ~F.contains(F.col("__text"), F.col("text")), F.lit("does not occur"))
    )
    places = F.when(problem.isNotNull(), F.array(F.lit(None).cast("int"))).when(given, F.array(start.cast("int"))).otherwise(occurrences(F.col("__text"), F.col("text")))
    safe = F.coalesce(F.try_element_at(F.array(problem), F.lit(1)), F.lit(None))
    return d.withColumn("problem", safe).withColumn("start", F.explode(places)).select("id", "text", "start", F.when(F.col("start").isNotNull(), F.char_length("text")).alias("len"), "problem")


def found_names(checked: DataFrame) -> DataFrame:
    """Distinct valid places (id, start, len, text)."""
    return checked.where("problem IS NULL").groupBy("id", "start", "len").agg(F.min("text").alias("text"))


def expected_names(c: Corpus) -> DataFrame:
    """(id, text, tags, start, len): places of expected names, without those strictly
    inside another and without repeats."""
    places = _placed(c.expected.where("kind = 'personalName'"), c.samples)
    inside = (F.col("a.id") == F.col("b.id")) & (F.col("b.start") <= F.col("a.start")) & (F.col("b.start") + F.col("b.len") >= F.col("a.start") + F.col("a.len")) & (F.col("b.len") > F.col("a.len"))
    outer = places.alias("a").join(places.select("id", "start", "len").distinct().alias("b"), inside, "left_anti")
    return outer.groupBy("id", "start", "len").agg(F.min_by(F.struct("text", "tags"), "n").alias("x")).select("id", "x.text", "x.tags", "start", "len")


def name_outcomes(c: Corpus, detections: DataFrame, rejected: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
    """One row per expected name: outcome (covered, partial, missed) by the union of
    detections over its characters other than white space and middle dots, cause of a
    miss, and the labels that a breakdown uses. rejected: (id, text) that a filter
    threw out; late: (id, start, len) of text in a model chunk after the first."""
    names = expected_names(c)
    found = found_names(checked_detections(c.samples, detections))
    # one join: the detections that touch a name, then its characters against them
    touch = (F.col("n.id") == F.col("f.id")) & overlap(_at("n"), _at("f"))
    hits = F.collect_list(F.when(F.col("f.start").isNotNull(), F.struct("f.start", "f.len")))
    rows = names.alias("n").join(found.alias("f"), touch, "left").groupBy("n.id", "n.start", "n.len").agg(F.min("n.text").alias("text"), F.first("n.tags").alias("tags"), hits.alias("hits"))
    place, letter = F.sequence(F.lit(0), F.col("len") - 1), lambda k: F.substring("text", k + 1, F.lit(1))
    need = F.filter(place, lambda k: ~letter(k).rlike(r"^(?U)[\s・･]$"))
    covered = F.forall(need, lambda k: F.exists("hits", lambda h: (h["start"] <= F.col("start") + k) & (F.col("start") + k < end(h))))
    outcome = F.when((F.size(need) > 0) & covered, "covered").when(F.size("hits") > 0, "partial").otherwise("missed")
    out = rows.withColumn("outcome", outcome).drop("hits")
    if rejected is not None:
        thrown = out.alias("n").join(rejected.alias("r"), (F.col("n.id") == F.col("r.id")) & F.contains(F.col("r.text"), F.col("n.text")), "left_semi").select("id", "start", "len").withColumn("thrown", F.lit(True))
        out = out.join(thrown, ["id", "start", "len"], "left")
    else:
        out = out.withColumn("thrown", F.lit(None).cast("boolean"))
    cause = F.when(F.col("outcome") == "missed", F.when(F.col("thrown"), "filterRejected").otherwise("neverReturned"))
    out = out.withColumn("cause", cause).drop("thrown")
    if late is not None:
        within = (F.col("n.id") == F.col("l.id")) & (F.col("n.start") >= F.col("l.start")) & (F.col("n.start") + F.col("n.len") <= F.col("l.start") + F.col("l.len"))
        after = out.alias("n").join(late.alias("l"), within, "left_semi").select("id", "start", "len").withColumn("late", F.lit(True))
        out = out.join(after, ["id", "start", "len"], "left").withColumn("late", F.coalesce("late", F.lit(False)))
    else:
        out = out.withColumn("late", F.lit(False))
    out = out.withColumn("spaced", F.col("text").rlike(r"(?U)[\p{Zs}\t]"))
    return out.join(c.samples.select("id", "genre", "writer"), "id")


def family_name(tags: Column) -> Column:
    """Whether a surname list has a say: a kanji or katakana name with its family part."""
    has = lambda *v: F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(*v))
    return has("kanji", "katakana") & has("full", "familyOnly")


_LABEL_ORDER = ["all", *(f"tag:{t}" for t in TAGS), "spaced", "late", *(f"genre:{g}" for g in GENRES), *(f"writer:{w}" for w in WRITERS), "surname:listed", "surname:unlisted"]


def breakdown(outcomes: DataFrame) -> DataFrame:
    """(label, expected, covered, partial, recall) over every label that occurs, in a
    fixed order. Labels are several a name, so rows are exploded by label; a column
    ``listed``, if there is one, splits family names."""
    surname = F.when(family_name(F.col("tags")) & F.col("listed").isNotNull(), F.when(F.col("listed"), "surname:listed").otherwise("surname:unlisted")) if "listed" in outcomes.columns else F.lit(None).cast("string")
    labels = F.concat(
        F.array(F.lit("all")), F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.concat(F.lit("tag:"), t)),
        F.filter(F.array(F.when(F.col("spaced"), F.lit("spaced")), F.when(F.col("late"), F.lit("late")), F.concat(F.lit("genre:"), "genre"), F.concat(F.lit("writer:"), "writer"), surname), lambda x: x.isNotNull()),
    )
    rows = outcomes.select(F.explode(labels).alias("label"), "outcome").groupBy("label").agg(
        F.count(F.lit(1)).alias("expected"), F.sum((F.col("outcome") == "covered").cast("long")).alias("covered"), F.sum((F.col("outcome") == "partial").cast("long")).alias("partial"),
    )
    order = F.array_position(F.array(*[F.lit(x) for x in _LABEL_ORDER]), F.col("label"))
    return rows.withColumn("recall", F.try_divide("covered", "expected")).orderBy(order, "label")


def false_names(c: Corpus, detections: DataFrame) -> DataFrame:
    """Detected names that overlap no expected one."""
    found = found_names(checked_detections(c.samples, detections))
    return found.alias("d").join(expected_names(c).alias("n"), (F.col("d.id") == F.col("n.id")) & overlap(_at("d"), _at("n")), "left_anti")


def name_summary(c: Corpus, detections: DataFrame) -> DataFrame:
    """One row: expected, covered, partial, detections, false_positives, recall,
    precision. Ratios over nothing are null."""
    o = name_outcomes(c, detections).agg(
        F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum((F.col("outcome") == "covered").cast("long")), F.lit(0)).alias("covered"),
        F.coalesce(F.sum((F.col("outcome") == "partial").cast("long")), F.lit(0)).alias("partial"),
    )
    d = found_names(checked_detections(c.samples, detections)).agg(F.count(F.lit(1)).alias("detections"))
    f = false_names(c, detections).agg(F.count(F.lit(1)).alias("false_positives"))
    # one row each
    both = o.join(d, F.lit(True)).join(f, F.lit(True))
    return both.withColumn("recall", F.try_divide("covered", "expected")).withColumn("precision", F.try_divide(F.col("detections") - F.col("false_positives"), "detections"))


def unknown_samples(c: Corpus, examined: DataFrame) -> DataFrame:
    """Ids that the corpus lacks."""
    return examined.select("id").distinct().join(c.samples, "id", "left_anti")


def unexamined_samples(c: Corpus, examined: DataFrame) -> DataFrame:
    """Samples that the detections don't mention; scored as missed."""
    return c.samples.select("id").join(examined.select("id"), "id", "left_anti")


def comparison(tables: dict[str, DataFrame]) -> DataFrame:
    """Breakdowns of several systems side by side, a column for each."""
    both = None
    for system, t in tables.items():
        t = t.select("label", "expected", F.lit(system).alias("system"), F.concat(F.round(F.col("recall") * 100, 1).cast("string"), F.lit("% p"), F.col("partial").cast("string")).alias("cell"))
        both = t if both is None else both.unionByName(t)
    order = F.array_position(F.array(*[F.lit(x) for x in _LABEL_ORDER]), F.col("label"))
    return both.groupBy("label").pivot("system", list(tables)).agg(F.first("cell")).join(both.groupBy("label").agg(F.max("expected").alias("n")), "label").orderBy(order, "label")


def render_names(c: Corpus, systems: dict[str, tuple[DataFrame, DataFrame | None]]) -> str:
    """The comparison as text: recall by label, precision, misses and false positives
    of each system (its detections and rejected texts). For a corpus labelled by hand."""
    late = late_text(c.samples)
    outcomes = {s: name_outcomes(c, names, rejected, late) for s, (names, rejected) in systems.items()}
    out = ["## Recall (covered / expected)", "", "label".ljust(18) + "n".rjust(6) + "  " + "".join(s.ljust(16) for s in systems)]
    for r in comparison({s: breakdown(o) for s, o in outcomes.items()}).collect():
        out.append(r["label"].ljust(18) + str(r["n"]).rjust(6) + "  " + "".join((r[s] or "-").ljust(16) for s in systems))
    out += ["", "## Precision", ""]
    for s, (names, _) in systems.items():
        x = name_summary(c, names).first()
        share = "-" if x["precision"] is None else f"{x['precision'] * 100:.1f}%"
        out.append(f"{s.ljust(16)} {share}  {x['false_positives']} false positives of {x['detections']} detections")
    for s, (names, _) in systems.items():
        misses = outcomes[s].where("outcome <> 'covered'").orderBy("id", "start").collect()
        wrong = false_names(c, names).orderBy("id", "start").collect()
        bad = checked_detections(c.samples, names).where("problem IS NOT NULL").orderBy("id", "text").collect()
        out += ["", f"## {s}", "", f"missed or partial ({len(misses)}):", *[f"  [{r['id']}] {r['text']}  {r['cause'] or r['outcome']}" for r in misses]]
        out += [f"false positives ({len(wrong)}):", *[f"  [{r['id']}] {r['text']!r}" for r in wrong], *[f"INVALID detection: [{r['id']}] {r['text']!r} {r['problem']}" for r in bad]]
    return "\n".join(out) + "\n"


def lint(c: Corpus) -> DataFrame:
    """(id, text, problem): what a name corpus must not have. Scripts are judged on the
    NFKC-folded name."""
    s, e = c.samples, c.expected
    none = F.lit(None).cast("string")
    rows = [
        s.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id", none.alias("text"), F.lit("duplicate id").alias("problem")),
        s.where("genre IS NULL").select("id", none.alias("text"), F.lit("no genre").alias("problem")),
        s.where("writer IS NULL").select("id", none.alias("text"), F.lit("no writer").alias("problem")),
        e.where("kind <> 'personalName'").select("id", "text", F.concat(F.lit("kind "), "kind", F.lit(" in a name corpus")).alias("problem")),
    ]
    names = e.where("kind = 'personalName'")
    tags = F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))
    scripts = F.array_intersect(tags, F.array(*[F.lit(x) for x in SCRIPTS]))
    forms = F.array_intersect(tags, F.array(*[F.lit(x) for x in FORMS]))
    names = names.withColumn("__folded", nfkc(F.col("text")))
    written = written_script(F.col("__folded"))
    tests = F.array(
        F.when(F.size(scripts) == 0, F.lit("no script tag")), F.when(F.size(scripts) > 1, F.lit("more than one script tag")),
        F.when((F.size(scripts) == 1) & written.isNotNull() & (F.get(scripts, F.lit(0)) != written), F.concat(F.lit("tagged "), F.get(scripts, F.lit(0)), F.lit(" but written in "), written)),
        F.when(F.size(forms) == 0, F.lit("no form tag")), F.when(F.size(forms) > 1, F.lit("more than one form tag")),
    )
    rows.append(names.select("id", "text", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("problem")))
    names = names.drop("__folded")
    rows.append(corpus_errors(Corpus(s, names, c.forbidden)).select("id", "text", F.lit("not in the text").alias("problem")))
    bad = _placed(names, s).alias("n").join(_placed(c.forbidden, s).alias("f"), (F.col("n.id") == F.col("f.id")) & overlap(_at("n"), _at("f")), "left_semi")
    rows.append(bad.select("id", "text").distinct().withColumn("problem", F.lit("also inside a forbidden text")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def late_text(samples: DataFrame, limit: int = 1500) -> DataFrame:
    """(id, start, len) of the pieces of each sample that lie in a model chunk after
    the first."""
    from .batches import chunk_documents

    numbered = samples.select("id", F.xxhash64("id").alias("__n"), japanese_lines(F.col("text")).alias("lines"))
    chunks = chunk_documents(numbered, "__n", "lines", limit).where("n > 1").select(F.col("id").alias("__n"), F.inline("mapping"))
    return chunks.join(numbered.select("id", "__n"), "__n").select("id", F.col("text_at").alias("start"), "len")


