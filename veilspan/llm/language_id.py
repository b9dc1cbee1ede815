"""Language identification by hierarchical discrimination.

First a linear model predicts the language family; within the family, one-versus-one
linear support vector machines separate its languages and vote. Features are counts
of byte trigrams of the whole, lower-cased text, hashed into buckets, square-rooted
and scaled to unit length. The models are fitted on a bounded sample of labelled
rows; prediction is one narrow pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat_utf8, slices

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: Labelled documents per language and of all languages that a fit uses at most
#: (documented bounds): with many languages each has fewer, and none is left out.
PER_LANGUAGE, LABELLED = 400, 16_000
#: More distinct labels are an error: they are no languages.
MAX_LANGUAGES = 800
UNDETERMINED = "und"
_ROWS = 512

#: Families of common languages. Others join the family whose mean
#: profile is nearest, so the table need not be complete.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "hr", "sr", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "mr", "ur"),
    "semitic": ("ar", "he"),
}

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a character of a text is a letter by its Unicode category."""
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def profiles(col: pa.Array, fold: bool = True) -> np.ndarray:
    """A unit row of hashed trigram weights for each text; zero for texts under one
    byte. ``fold`` lowers A-Z."""
    flat, offsets = flat_utf8(col)
    n = len(offsets) - 1
    flat = (LOWER[flat] if fold else flat).astype(np.uint32)
    if len(flat) < 1:
        return np.zeros((n, BUCKETS), np.float32)
    b1, b2 = np.roll(flat, -1), np.roll(flat, -2)
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1  # trigrams don't cross rows
    b1[last], b2[last] = 32, 32
    before = last - 1
    b2[before[before >= 0]] = 32
    idx = ((flat | (b1 << np.uint32(8)) | (b2 << np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.bincount(row * BUCKETS + idx, minlength=n * BUCKETS).reshape(n, BUCKETS)
    x = np.sqrt(counts.astype(np.float32))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, epochs: int = 30, batch: int = 32) -> np.ndarray:
    """Weights of a linear SVM with hinge loss and a bias in the last place, by
    averaged mini-batch subgradient steps. y is +1 or -1; the classes weigh the same.
    x is read a batch at a time and never copied."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * n
    w, mean, t = np.zeros(d + 1), np.zeros(d + 1), 0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            k = order[at : at + batch]
            t += 1
            step = 1 / (lam * (t + 1000))
            part = x[k]
            wrong = y[k] * (part @ w[:-1] + w[-1]) < 1
            w *= 1 - lam * step
            if wrong.any():
                push = step / len(k) * (weight[k] * y[k] * wrong)
                w[:-1] += push @ part
                w[-1] += push.sum()
            mean += (w - mean) / t
    return mean.astype(np.float32)


def families_of(langs: list[str], means: dict[str, np.ndarray]) -> dict[str, str]:
    """The family of each language: the table, else the nearest mean profile of a
    language in the table, else its own name."""
    known = {lang: family for family, members in FAMILIES.items() for lang in members}
    out = {lang: known[lang] for lang in langs if lang in known}
    rest = [lang for lang in langs if lang not in known]
    near = {lang: max(out, key=lambda o: (float(means[lang] @ means[o]), o)) if out else lang for lang in rest}
    return out | {lang: out.get(o, o) for lang, o in near.items()}


class Model:
    """families: names in order; family_w: a row of weights each; members: languages
    by family; pair_w: weights by (family, i, j), positive for language i."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        names = sorted(set(langs.tolist()))
        self.family = families_of(names, {n: x[langs == n].mean(axis=0) for n in names})
        self.families = sorted(set(self.family.values()))
        of = np.array([self.family[n] for n in langs])
        self.family_w = np.stack([fit_svm(x, np.where(of == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else np.zeros((len(self.families), x.shape[1] + 1), np.float32)
        self.members = {f: [n for n in names if self.family[n] == f] for f in self.families}
        self.pair_w = {}
        for f, m in self.members.items():
            for i, j in combinations(range(len(m)), 2):
                use = (langs == m[i]) | (langs == m[j])
                self.pair_w[f, i, j] = fit_svm(x[use], np.where(langs[use] == m[i], 1, -1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1 of each row."""
        n = len(x)
        if not self.families:
            return [UNDETERMINED] * n, np.zeros(n)
        squash = lambda m: 1 / (1 + np.exp(-np.clip(2.0 * m, -30, 30)))
        m = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
        p = squash(m)
        p = p / p.sum(axis=1, keepdims=True)
        pick = p.argmax(axis=1)
        lang, score = np.empty(n, object), p[np.arange(n), pick].astype(float)
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero(pick == k), self.members[f]
            if len(rows):
                votes = np.zeros((len(rows), len(names)))
                for i, j in combinations(range(len(names)), 2):
                    w = self.pair_w[f, i, j]
                    first = squash(x[rows] @ w[:-1] + w[-1])
                    votes[:, i] += first
                    votes[:, j] += 1 - first
                if len(names) == 1:
                    votes[:] = 1
                best = votes.argmax(axis=1)
                lang[rows] = np.array(names, object)[best]
                score[rows] *= votes[np.arange(len(rows)), best] / max(1, len(names) - 1)
        return lang.tolist(), np.clip(score, 0, 1)


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, labelled: int = LABELLED) -> Model:
    """Fit on labelled rows whose crc32 of the id, as text, mod 5 is not 0. At most
    ``per_language`` rows of each language and ``labelled`` of all are used, those with
    the smallest hashes of id, one row for each id; the driver receives their sparse
    profiles, which has that bound however often an id is repeated. More than
    MAX_LANGUAGES labels are an error."""
    key = docs[id_col].cast("long")
    usable = docs.select(
        F.xxhash64(key).alias("h"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("t"), key.alias("id"), held_out(key).alias("out"),
    ).where("id IS NOT NULL AND lang IS NOT NULL AND NOT out")
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("count")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in {lang_col}")
    if counts:
        per_language = max(1, min(per_language, labelled // len(counts)))
    # a hash threshold per language, a little high, then the exact bound on the driver
    bound = {r["lang"]: min((1 << 63) - 1, int((2 * min(1.0, 1.5 * (per_language + 20) / r["count"]) - 1) * (1 << 63))) for r in counts}
    if not bound:
        return Model(np.zeros((0, BUCKETS), np.float32), np.zeros(0, object))
    limit = F.create_map(*[F.lit(v) for kv in bound.items() for v in kv])
    sample = usable.where(F.col("h") <= limit[F.col("lang")]).select("h", "lang", "t")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", rows=_ROWS):
            x = profiles(batch.column(2))
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([a.tobytes() for a in at], pa.binary()),
                pa.array([r[a].astype(np.float16).tobytes() for r, a in zip(x, at)], pa.binary()),
            ], ["h", "lang", "at", "w"])

    # rows that repeat an id are one before they leave their tasks
    profiled = sample.mapInArrow(sparse, "h long, lang string, at binary, w binary").groupBy("lang", "h").agg(F.min(F.struct("at", "w")).alias("x"))
    got = sorted(profiled.select("lang", "h", "x.*").collect(), key=lambda r: (r["lang"], r["h"], r["at"]))
    taken: dict[str, int] = {}
    rows = []
    for r in got:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language and r["at"]:
            rows.append(r)
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["w"], np.float16)
    return Model(x, np.array([r["lang"] for r in rows], object))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, held_out, lang_pred, score.

    Only the text is read for a prediction. Texts that are null or have no letter
    get ``und`` with score 0. Repeated rows each get the same result; an empty table
    gives an empty result; without any labelled row all texts get ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", rows=_ROWS):
            lang, score = sent.value.predict(profiles(batch.column(2)))
            none = [not has_letter(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([UNDETERMINED if u else v for u, v in zip(none, lang)], pa.string()),
                pa.array([0.0 if u else float(v) for u, v in zip(none, score)], pa.float64()),
            ], ["id", "held_out", "lang_pred", "score"])

    key = docs[id_col].cast("long")
    return docs.select(key.alias("id"), held_out(key).alias("held_out"), docs[text_col].cast("string").alias("t")).mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")


def identified_only(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told. Nothing is
    shuffled or joined: rows pass through the worker that judges them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, rows=_ROWS):
            texts = batch.column(batch.schema.get_field_index(text_col))
            lang, _ = sent.value.predict(profiles(texts))
            keep = [has_letter(t) and v != UNDETERMINED for t, v in zip(texts.to_pylist(), lang)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows of docs that are not held out, then identify all rows."""
    return identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
