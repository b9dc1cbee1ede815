"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. The j-th block (from 1) of a source with
weight w may be placed from slot floor((j-1)/w) on and has to be placed by slot
ceil(j/w); of the blocks that may be placed, the one with the earliest deadline gets
the slot. With weights that add up to 1 every deadline is met, so after any number t
of slots a source has had w*t blocks, give or take less than one.

Weights are taken exactly, as the fractions p/q that the floats are; q is as large as
that needs. The schedule repeats every q slots, so the driver simulates q slots or those
of the phase, whichever are fewer: a step and eight bytes a block at most. A block is
BLOCK_ROWS rows, or the MAX_BLOCKS-th part of all rows if that is more, so the simulation
and what workers are sent stay within MAX_BLOCKS steps and 8 MB however many rows there
are. When a source runs out, the others go on with their weights scaled up: a new phase;
sources of weight 0 come after all others. All rows are placed, each once. Callers may
give a period q instead; weights are then rounded to it.

Rows are numbered within their source by counting, not by one sort per source: rows
are dealt to (source, bucket) groups of bounded size, numbered there, and shifted by
the counts of the buckets before. A source with a third of all rows has as many more
buckets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK_ROWS = 64
#: More sources are an error.
MAX_SOURCES = 1000
#: Blocks of all sources together, at most and but for one more each.
MAX_BLOCKS = 1 << 20
#: Rows that a numbering group has on average, and groups of a source at most.
BUCKET_ROWS = 4096
MAX_BUCKETS = 1 << 20
#: Without given weights, a source weighs its rows to this power.
TEMPERATURE = 0.5


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Slots of each source in the shortest period that has the weights exactly."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(f.denominator for f in parts.values()))
    p = {s: int(f * scale) for s, f in parts.items()}
    common = math.gcd(*p.values())
    return {s: x // common for s, x in p.items()}


def period_shares(weights: dict[str, float], q: int) -> dict[str, int]:
    """Slots of each source in a period of q slots, four for each source at least, by
    largest remainder, one at least."""
    total = sum(weights.values())
    q = max(q, 4 * len(weights))
    exact = {s: w / total * q for s, w in weights.items()}
    p = {s: max(1, int(x)) for s, x in exact.items()}
    left = q - sum(p.values())
    order = sorted(weights, key=lambda s: (-(exact[s] - int(exact[s])), s))
    k = 0
    while left > 0:
        p[order[k % len(order)]] += 1
        left, k = left - 1, k + 1
    while left < 0:
        big = max(p, key=lambda s: (p[s], s))
        p[big] -= 1
        left += 1
    return p


def edf_period(p: dict[str, int], blocks: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """The slots of each source's blocks within one period of sum(p) slots, or up to
    the slot where the first source has had all its ``blocks``."""
    q = sum(p.values())
    names = sorted(p)
    release = lambda s, j: (j - 1) * q // p[s]
    deadline = lambda s, j: -(-j * q // p[s])
    waiting = [(0, s, 1) for s in names]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in names}
    t = 0
    while t < q:
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, j), s, j))
        due, s, j = heapq.heappop(ready)
        if t >= due:
            raise AssertionError("a deadline is missed: the shares don't add up to the period")
        slots[s].append(t)
        t += 1
        if blocks and j == blocks[s]:
            break
        if j < p[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return {s: np.array(v, np.int64) for s, v in slots.items()}


class Phase:
    """Slots from ``start`` on, for the sources that still have blocks: a period's
    slots and the first block of each. Where a source's ``blocks`` run out within the
    period, only the slots up to there are held."""

    def __init__(self, start: int, first: dict[str, int], p: dict[str, int], blocks: dict[str, int]):
        self.start, self.first, self.p, self.q = start, dict(first), p, sum(p.values())
        self.slots = edf_period(p, blocks)
        placed = sum(map(len, self.slots.values()))
        out = [s for s, n in blocks.items() if len(self.slots[s]) == n]
        #: slots of the phase, where it ends within its first period
        self.length = placed if out else None

    def slot(self, source: str, block: np.ndarray) -> np.ndarray:
        k = block - self.first[source]
        if self.length is not None:
            return self.start + self.slots[source][k]
        p = self.p[source]
        return self.start + k // p * self.q + self.slots[source][k % p]


def plan(blocks: dict[str, int], weights: dict[str, float], q: int | None = None) -> list[Phase]:
    """The phases that place ``blocks`` of each source, by the exact weights or, if q is
    given, by weights rounded to a period of q slots."""
    left = {s: n for s, n in blocks.items() if n > 0}
    first = dict.fromkeys(left, 0)
    phases, start = [], 0
    while left:
        # what weighs nothing waits until nothing else is left
        own = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1.0)
        going = {s: left[s] for s in own}
        ph = Phase(start, {s: first[s] for s in own}, exact_shares(own) if q is None else period_shares(own, q), going)
        if ph.length is not None:
            end = start + ph.length
        else:
            end = min(int(ph.slot(s, np.array([first[s] + n - 1]))[0]) for s, n in going.items()) + 1
        for s in going:
            if ph.length is not None:
                used = len(ph.slots[s])
            else:
                whole, rest = divmod(end - start, ph.q)
                used = whole * ph.p[s] + int(np.searchsorted(ph.slots[s], rest))
            first[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        phases.append(ph)
        start = end
    return phases


def target_weights(rows: dict[str, int], weights: dict[str, float] | None, temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights that add up to 1; sources that ``weights`` lacks get the smallest given
    one above 0. A negative weight or none above 0 is an error."""
    if weights:
        if min(weights.values()) < 0 or not all(map(math.isfinite, weights.values())) or not any(weights.values()):
            raise ValueError("weights have to be finite, 0 or more, and not all 0")
        least = min(w for w in weights.values() if w > 0)
        raw = {s: weights.get(s, least) for s in rows}
    else:
        raw = {s: float(n) ** temperature for s, n in rows.items()}
    total = sum(raw.values()) or 1.0
    return {s: w / total for s, w in raw.items()}


def numbered(docs: DataFrame, rows: dict[str, int], id_col: str, source_col: str, bucket_rows: int) -> DataFrame:
    """(id, source, nth): rows of each source from 0, in the order of a hash of id. Rows
    that repeat an id, null ones too, are told apart by their place in docs, so they
    spread over the groups like others; ids and places are written first, so that all
    that follows sees the same ones."""
    many = {s: max(1, min(MAX_BUCKETS, -(-n // bucket_rows))) for s, n in rows.items()}
    buckets = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    keyed = docs.select(
        docs[id_col].cast("long").alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"), F.monotonically_increasing_id().alias("place"),
    ).select("id", "source", F.xxhash64("id").alias("h"), "place")
    keyed = materialize(keyed.withColumn("bucket", F.pmod(F.xxhash64("id", "place"), buckets[F.col("source")]).cast("int")), "mix-rows")
    counts = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "id", "place")
    ranked = keyed.select("id", "source", "bucket", (F.row_number().over(within) - 1).alias("rn"))
    return ranked.join(offsets, ["source", "bucket"]).select("id", "source", (F.col("offset") + F.col("rn")).alias("nth"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, q: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each row of docs: id, source, block, slot, position.

    position orders the mixture and is unique; the last block of a source may be
    short and leaves a gap. A null source is a source of its own, the empty string.
    Repeated rows have positions of their own; an empty table gives an empty result;
    more than MAX_SOURCES sources raise an error.
    """
    source = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    counts = docs.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    rows = {r["source"]: r["n"] for r in counts}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(rows.values()) // MAX_BLOCKS))
    phases = plan({s: -(-n // block_rows) for s, n in rows.items()}, target_weights(rows, weights), q)
    schema = "id long, source string, block long, slot long, position long"
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext.broadcast(phases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {s: ([ph.first[s] for ph in sent.value if s in ph.first], [ph for ph in sent.value if s in ph.first]) for s in rows}
        for batch in batches:
            nth = np.asarray(batch.column(2), np.int64)
            block, slot = nth // block_rows, np.empty(len(nth), np.int64)
            coded = batch.column(1).dictionary_encode()
            codes = np.asarray(coded.indices)
            for k, s in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(codes == k)
                first, of = firsts[s]
                which = np.searchsorted(first, block[at], side="right") - 1
                for w in np.unique(which):
                    slot[at[which == w]] = of[w].slot(s, block[at[which == w]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block), pa.array(slot), pa.array(slot * block_rows + nth % block_rows)], ["id", "source", "block", "slot", "position"])

    return numbered(docs, rows, id_col, source_col, bucket_rows).mapInArrow(run, schema)


def exact_share(weights: dict[str, float], q: int | None = None) -> dict[str, Fraction]:
    """The fractions that the first phase follows."""
    p = exact_shares(weights) if q is None else period_shares(weights, q)
    return {s: Fraction(x, sum(p.values())) for s, x in p.items()}
