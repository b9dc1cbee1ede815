"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (+1), bad (-1) or nothing (0) on each
document. Expectation-maximisation over the counts of all vote patterns, which are
at most 3^L and gathered from all documents, estimates how often each labeller is
right on good and on bad documents, without any true label. The posterior of a
document's votes is its soft label; on a bounded sample of these a linear scorer over
hashed trigrams is fitted, which then scores every document by its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, flat_utf8, slices, word_hashes
from .language_id import BUCKETS, profiles
from .quality_rules import STOP_WORDS

#: Documents of each side that the scorer is fitted on at most (documented bound).
PER_SIDE = 2000
#: Documents with this score or more are kept. Texts of fewer words than SHORT have too
#: few trigrams for a score of their own: they are also kept if no labeller objects.
KEEP, SHORT = 0.5, 20
ROUNDS = 100
_ROWS = 512


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _SHOUT = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"!")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(195, 256)))
_LINE, _END = _table(b"\n"), _table(b".!?:;")


def _stops() -> np.ndarray:
    words = [w.encode() for w in STOP_WORDS]
    offsets = np.cumsum([0, *map(len, words)])
    return np.unique(word_hashes(np.frombuffer(b"".join(words), np.uint8), offsets)[0])


_STOPS = _stops()


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[first], minlength=n)


def measures(col: pa.Array) -> dict[str, np.ndarray]:
    """Ratios of each text that the labellers look at; null is empty."""
    flat, offsets = flat_utf8(col)
    n = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[offsets[1:]] - c[offsets[:-1]]

    h, row, _ = word_hashes(flat, offsets)
    words = np.bincount(row, minlength=n)
    lines_h, lines_row, first = word_hashes(flat, offsets, fold=False, space=_LINE)
    lines = np.bincount(lines_row, minlength=n)
    after = np.append(flat, 10)
    stop = np.flatnonzero(~_LINE[flat] & np.append(_LINE[flat][1:], True)) if len(flat) else np.zeros(0, np.int64)
    inner = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    stop = np.union1d(stop, inner[~_LINE[flat[inner]]]) if len(flat) else stop
    ended = np.bincount(np.searchsorted(offsets, stop[_END[after[stop]]], side="right") - 1, minlength=n)
    letters = total(_LETTER[flat])
    ratio = lambda a, b: a / np.maximum(b, 1)
    return {
        "words": words.astype(float),
        "symbols": ratio(total(_SYMBOL[flat]), words),
        "stops": ratio(np.bincount(row[np.isin(h, _STOPS)], minlength=n), words),
        "upper": ratio(total(_UPPER[flat]), letters),
        "shouts": ratio(total(_SHOUT[flat]), words),
        "repeated_lines": 1 - ratio(_distinct(lines_h, lines_row, n), np.maximum(lines, 1)) if len(lines_h) else np.zeros(n),
        "ended_lines": ratio(ended, lines),
        "word_bytes": ratio(total(~SPACE[flat]), words),
        "distinct_words": ratio(_distinct(h, row, n), words) if len(h) else np.zeros(n),
    }


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good | np.zeros_like(bad), 1, 0)).astype(np.int8)


_NO = np.bool_(False)

#: Name and rule of each labeller: overlapping, each wrong at times. Most know one
#: fault only and abstain where they don't see it; three know good prose.
LABELLERS: tuple[tuple[str, Callable[[dict[str, np.ndarray]], np.ndarray]], ...] = (
    ("length", lambda m: _vote(m["words"] >= 50, m["words"] < 1)),
    ("symbols", lambda m: _vote(_NO, m["symbols"] > 0.1)),
    ("stop_words", lambda m: _vote(m["stops"] > 0.1, (m["stops"] < 0.03) & (m["words"] >= 30))),
    ("capitals", lambda m: _vote(_NO, m["upper"] > 0.4)),
    ("shouting", lambda m: _vote(_NO, m["shouts"] > 0.1)),
    ("repeated_lines", lambda m: _vote(_NO, m["repeated_lines"] > 0.3)),
    ("sentences", lambda m: _vote(m["ended_lines"] > 0.6, m["ended_lines"] < 0.05)),
    ("word_length", lambda m: _vote(_NO, (m["word_bytes"] < 2.5) | (m["word_bytes"] > 12))),
    ("variety", lambda m: _vote(_NO, (m["distinct_words"] < 0.2) & (m["words"] >= 50))),
)


def votes(col: pa.Array) -> np.ndarray:
    """(n, L) votes."""
    m = measures(col)
    return np.stack([rule(m) for _, rule in LABELLERS], axis=1)


class LabelModel:
    """prior of a good document; right[y, j]: how often labeller j, when it votes, is
    right on documents of class y (0 bad, 1 good)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
        n = patterns.shape[1] if patterns.size else len(LABELLERS)
        self.prior, self.right = 0.8, np.full((2, n), 0.75)
        if not len(counts):
            return
        weight = counts / counts.sum()
        for _ in range(rounds):
            p = self.posterior(patterns)
            self.prior = float(np.clip((weight * p).sum(), 0.02, 0.98))
            for y, q in ((0, 1 - p), (1, p)):
                w = weight * q
                voted = (w[:, None] * (patterns != 0)).sum(axis=0)
                agree = (w[:, None] * (patterns == (1 if y else -1))).sum(axis=0)
                # a pull towards 0.75, and labellers are better than chance on either
                # side: this keeps what good and bad mean
                new = (agree + 0.75 * 1e-3) / (voted + 1e-3)
                self.right[y] = np.clip(new, 0.55, 0.98)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that a document with these votes is good."""
        logs = []
        for y, prior in ((0, 1 - self.prior), (1, self.prior)):
            right = self.right[y]
            hit = patterns == (1 if y else -1)
            logs.append(np.log(prior) + np.where(patterns == 0, 0.0, np.where(hit, np.log(right), np.log(1 - right))).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights, bias last, of a logistic scorer on soft targets; both sides weigh the
    same. Gradient steps with momentum."""
    n, d = x.shape
    if not n:
        return np.zeros(d + 1, np.float32)
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    good = max(target.sum(), 1e-6)
    weight = target * (0.5 / good) + (1 - target) * (0.5 / max(n - good, 1e-6))
    share = np.where(weight > 0, target * (0.5 / good) / weight, 0)
    w, speed = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 4.0 * (((p - share) * weight) @ x + l2 * w)
        w = (w + speed).astype(np.float32)
    return w


def _voted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_side: int = PER_SIDE) -> tuple[LabelModel, np.ndarray]:
    """The label model, from the votes on all documents, and the scorer, from
    ``per_side`` documents of either side at most, chosen by a hash of id and text. Rows
    that repeat both are one; null ids are hashed by their texts."""
    rows = _voted(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in slices(batches, "t"):
            seen, n = np.unique(votes(batch.column(1)), axis=0, return_counts=True)
            for v, k in zip(seen, n.tolist()):
                held[v.tobytes()] = held.get(v.tobytes(), 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["votes", "n"])

    patterns = rows.mapInArrow(count, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    table = np.array([np.frombuffer(r["votes"], np.int8) for r in patterns], np.int8).reshape(-1, len(LABELLERS))
    counts = np.array([r["n"] for r in patterns], float)
    model = LabelModel(table, counts)
    side = model.posterior(table) >= 0.5 if len(table) else np.zeros(0, bool)
    share = [min(1.0, 1.5 * (per_side + 20) / max(1.0, counts[side == s].sum())) for s in (False, True)]
    bounds = [min((1 << 63) - 1, int((2 * s - 1) * (1 << 63))) for s in share]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", rows=_ROWS):
            p = sent.value.posterior(votes(batch.column(1)))
            h = np.asarray(batch.column(0))
            use = np.flatnonzero(h <= np.where(p >= 0.5, bounds[1], bounds[0]))
            if not len(use):
                continue
            x = profiles(batch.column(1).take(pa.array(use)), fold=False)
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            yield pa.RecordBatch.from_arrays([
                pa.array(h[use]), pa.array(p[use]), pa.array([a.tobytes() for a in at], pa.binary()),
                pa.array([r[a].astype(np.float16).tobytes() for r, a in zip(x, at)], pa.binary()),
            ], ["h", "p", "at", "w"])

    # rows beyond both bounds can't be chosen: their texts are not looked at
    near = rows.select(F.xxhash64("id", "t").alias("h"), "t").where(F.col("h") <= max(bounds))
    sampled = near.mapInArrow(sample, "h long, p double, at binary, w binary").groupBy("h").agg(F.min(F.struct("p", "at", "w")).alias("x"))
    got = sampled.select("h", "x.*").collect()
    chosen = []
    for good in (False, True):
        own = sorted((r for r in got if (r["p"] >= 0.5) == good), key=lambda r: (r["h"], r["at"]))
        chosen += own[:per_side]
    x = np.zeros((len(chosen), BUCKETS), np.float32)
    for i, r in enumerate(chosen):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["w"], np.float16)
    return model, fit_scorer(x, np.array([r["p"] for r in chosen], np.float32))


def score(docs: DataFrame, model: LabelModel, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """A row for each row of docs: id, votes (string of +, - and 0), posterior, score,
    kept. Null and empty texts have no trigrams: their score is that of the bias.
    Repeated rows get the same result; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = sent.value
        for batch in slices(batches, "t", rows=_ROWS):
            read = measures(batch.column(1))
            v = np.stack([rule(read) for _, rule in LABELLERS], axis=1)
            spared = (read["words"] < SHORT) & ~(v < 0).any(axis=1)
            s = 1 / (1 + np.exp(-np.clip(profiles(batch.column(1), fold=False) @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(["".join("-0+"[x + 1] for x in r) for r in v.tolist()], pa.string()),
                pa.array(m.posterior(v)), pa.array(s.astype(float)), pa.array((s >= keep) | spared),
            ], ["id", "votes", "posterior", "score", "kept"])

    return _voted(docs, id_col, text_col).mapInArrow(run, "id long, votes string, posterior double, score double, kept boolean")


def quality_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on docs and score all of them. True labels are never read."""
    return score(docs, *fit(docs, id_col, text_col), id_col=id_col, text_col=text_col)
