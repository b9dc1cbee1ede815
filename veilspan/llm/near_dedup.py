"""Near duplicates: SetSketch bands find groups, full shingle sets confirm links.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes), a
   fingerprint of the set and a SetSketch. Equal sets are one class from here on.
2. Bands of registers hash classes into buckets; buckets with the same members are
   one. The members of a bucket are compared by their registers, block by block: each
   is paired with the one most alike whose joint likelihood leaves room for the wanted
   similarity, and further pairs connect whatever such pairs connect. In buckets of
   several blocks, members outside the largest group then meet all others. So no two
   classes that share a bucket and may link are left in different groups.
3. Within a group links are confirmed on full sets. Components are what counts: in
   small groups every set outside the main component is compared with all others. In
   large ones the candidate pairs are confirmed first, each by itself, and what is
   then outside the main component meets all members, in blocks.

Comparing registers within a bucket is quadratic, at two bytes a register. So is
comparing sets, but only in members that no candidate pair links to their group.

Recall: at similarity s a pair shares one of BANDS buckets with probability
1 - (1 - s^ROWS)^BANDS, 0.999995 at 0.75. Confirmed links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .common import flat_utf8, materialize, slices, splitmix, word_hashes
from .components import connected_components

SHINGLE = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
BANDS, ROWS = 32, 4
#: A pair is let go when its likelihood at the wanted similarity is e^-SLACK of its
#: best: 18 is about six standard errors.
SLACK = 18.0
#: Members of a bucket that a task compares at once, on either side.
BLOCK_MEMBERS = 512
#: Similarities below the wanted one at which the likelihood of a pair is tried.
_TRIED = tuple(k / 20 for k in range(2, 20))
#: Elements of the sets that a task compares at once, and what a set itself counts for.
TASK_WEIGHT, ROW_WEIGHT = 512_000, 256
#: Member ids are broadcast up to this many (24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(col: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, ascending within a row, and
    the row of each. Words are lower-cased in A-Z; a text with fewer words than a
    shingle has its whole sequence as one; without words it has none."""
    flat, offsets = flat_utf8(col)
    n = len(offsets) - 1
    h, row, _ = word_hashes(flat, offsets)
    words = np.bincount(row, minlength=n)
    ends = np.cumsum(words)
    whole = np.flatnonzero(np.arange(len(h)) + size <= ends[row]) if len(h) else np.zeros(0, np.int64)
    key = np.full(len(whole), size, np.uint64) * _GOLDEN
    for k in range(size):
        key = splitmix(key ^ h[whole + k])
    short = np.flatnonzero((words > 0) & (words < size))
    lone = words[short].astype(np.uint64) * _GOLDEN
    for k in range(size - 1):
        more = words[short] > k
        lone[more] = splitmix(lone[more] ^ h[(ends - words)[short[more]] + k])
    el, of = np.concatenate([key, lone]), np.concatenate([row[whole], short])
    order = np.argsort(el)
    order = order[np.argsort(of[order].astype(np.uint32), kind="stable")]
    el, of = el[order], of[order]
    first = np.ones(len(el), bool)
    first[1:] = (el[1:] != el[:-1]) | (of[1:] != of[:-1])
    return el[first], of[first]


def fingerprints(el: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each set: two sums of its mixed elements."""
    out = np.zeros((n, 2), np.uint64)
    if len(el):
        rows, head = np.unique(row, return_index=True)
        for k, salt in enumerate((0x5851F42D4C957F2D, 0xB0A3E85A9AFE5A5B)):
            out[rows, k] = np.add.reduceat(splitmix(el ^ np.uint64(salt)), head)
    return out


def sketched(docs: DataFrame, id_col: str, text_col: str, m: int) -> DataFrame:
    """(id, n, f1, f2, regs) of every row; regs is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", limit=1 << 20, rows=4096):
            rows = batch.num_rows
            el, row = shingle_sets(batch.column(1))
            n = np.bincount(row, minlength=rows)
            f = fingerprints(el, row, rows).view(np.int64)
            regs = setsketch.sketch(el, row, rows, m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n.astype(np.int64)), pa.array(f[:, 0]), pa.array(f[:, 1]),
                pa.array([r.tobytes() if k else None for r, k in zip(regs, n)], pa.binary()),
            ], ["id", "n", "f1", "f2", "regs"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(run, "id long, n long, f1 long, f2 long, regs binary")


def _matrix(col: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, id): the buckets of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = setsketch.bands(_matrix(part.column(1), np.uint16, bands * rows), rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), bands))], ["key", "id"])

    return classes.select("id", "regs").mapInArrow(run, "key long, id long")


def _room(regs: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int, slack: float) -> np.ndarray:
    """Whether the joint likelihood of members x[k] and y[k] leaves room for the wanted
    similarity: it is not e^-slack of that at any similarity tried, or less."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 8192):
        i, j = x[at : at + 8192], y[at : at + 8192]
        a, b = regs[:, i], regs[:, j]
        larger, equal = (a > b).sum(axis=0), (a == b).sum(axis=0)
        counts = (larger, len(regs) - larger - equal, equal, n[i].astype(float), n[j].astype(float))
        likelihood = lambda tried: setsketch.log_likelihood(np.full(len(i), tried), *counts)  # noqa: B023, E731
        want = likelihood(percent / 100)
        # a similarity above the wanted one is a link as well
        best = np.maximum.reduce([want, *(likelihood(t) for t in _TRIED if t * 100 < percent)])
        out[at : at + 8192] = want >= best - slack
    return out


def _cell_pairs(regs: np.ndarray, n: np.ndarray, group: np.ndarray, side: np.ndarray, percent: int, slack: float) -> list[tuple[int, int]]:
    """Pairs of members of different groups that may link: for each member the one that
    looks most alike among those no smaller, and as many more as connect whatever any
    such pair connects. Where there are two sides, pairs within one don't count."""
    order = np.argsort(n, kind="stable")
    regs, n, side = np.ascontiguousarray(regs[order].T), n[order], side[order]
    names, group = np.unique(group[order], return_inverse=True)
    two, forest, out = bool(side.min() != side.max()), _Forest(len(names)), []
    # a pair with so few equal registers has no room whatever its sizes: the share of
    # equal ones is about the similarity, and this is twice the slack and more below
    m, share = len(regs), np.arange(len(regs) + 1) / len(regs)
    away = share * np.log(np.maximum(share, 1e-9) / (percent / 100)) + (1 - share) * np.log(np.maximum(1 - share, 1e-9) / (1 - percent / 100)) if percent < 100 else np.zeros(m + 1)
    few = (share < percent / 100) & (m * away > 2 * slack + 10)
    # the members from i + 1 to upto[i] are large enough, and not too large for i
    upto = np.searchsorted(n * percent, n * 100, side="right")
    total, at = len(n), 0
    while at < total:
        to = min(total, at + 64)
        end = int(upto[to - 1])
        i, j = np.arange(at, to)[:, None], np.arange(at, end)[None, :]
        fit = (j > i) & (j < upto[at:to, None]) & (group[at:to, None] != group[None, at:end])
        if two:
            fit &= side[at:to, None] != side[None, at:end]
        if fit.any():
            equal = np.zeros(fit.shape, np.uint16)
            for r in regs:
                equal += r[at:to, None] == r[None, at:end]
            fit &= ~few[equal]
            best = np.where(fit, equal + 1, 0).argmax(axis=1)
            x = np.flatnonzero(fit[np.arange(to - at), best])
            y = best[x]
            room = _room(regs, n, x + at, y + at, percent, slack)
            for u, v in zip((x[room] + at).tolist(), (y[room] + at).tolist()):
                forest.join(int(group[u]), int(group[v]))
                out.append((int(order[u]), int(order[v])))
            now = np.array([forest.root(k) for k in range(len(names))])[group]
            x, y = np.nonzero(fit & (now[at:to, None] != now[None, at:end]))
            room = _room(regs, n, x + at, y + at, percent, slack)
            for u, v in zip((x[room] + at).tolist(), (y[room] + at).tolist()):
                if forest.join(int(group[u]), int(group[v])):
                    out.append((int(order[u]), int(order[v])))
        at = to
    return out


def in_cells(cells: DataFrame, classes: DataFrame, m: int, percent: int, slack: float) -> DataFrame:
    """(id, p): the pairs of ``_cell_pairs`` in every cell. ``cells``: (key, lo, hi, side,
    id, g); a cell is what shares key, lo and hi."""
    # a number of its own: by bytes alone few tasks would get all this work
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.join(classes.select("id", "n", "regs"), "id").repartition(tasks, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").select("key", "lo", "hi", "side", "id", "g", "n", "regs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids = np.asarray(rows.column(4))
            found = _cell_pairs(_matrix(rows.column(7), np.uint16, m), np.asarray(rows.column(6)), np.asarray(rows.column(5)), np.asarray(rows.column(3)), percent, slack)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], ["id", "p"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            heads = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist()]
            if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != cell[0, k] for k in range(3)):
                yield pairs(pa.concat_batches(held))
                held = []
            for at, to in zip(heads, [*heads[1:], None]):
                held.append(batch.slice(at, None if to is None else to - at))
                if to is not None:
                    yield pairs(pa.concat_batches(held))
                    held = []
        if held:
            yield pairs(pa.concat_batches(held))

    return dealt.mapInArrow(run, "id long, p long")


def candidate_edges(classes: DataFrame, bands: int, rows: int, percent: int, slack: float, block_members: int) -> DataFrame:
    """(id, p): pairs of classes that share a bucket and may link, enough of them to
    connect all that such pairs connect."""
    keyed = band_rows(classes, bands, rows)
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x")).where("k > 1")
    # buckets with the same members are one
    shared = several.groupBy("k", "low", "high", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("k") / block_members).cast("long").alias("parts"))
    zero = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("id", "key"), F.col("parts"))
    buckets = materialize(keyed.join(shared, "key").select("key", "id", "parts", block.alias("b")), "near-buckets")
    within = buckets.select("key", F.col("b").alias("lo"), F.col("b").alias("hi"), zero.alias("side"), "id", F.col("id").alias("g"))
    edges = materialize(in_cells(within, classes, bands * rows, percent, slack).distinct(), "near-edges")
    cut = buckets.where("parts > 1")
    if cut.isEmpty():
        return edges
    return materialize(edges.unionByName(across_blocks(cut, edges, classes, bands * rows, percent, slack, block_members)).distinct(), "near-edges")


def across_blocks(cut: DataFrame, edges: DataFrame, classes: DataFrame, m: int, percent: int, slack: float, block_members: int) -> DataFrame:
    """(id, p) for buckets in several blocks: what connects members that ``edges`` leave
    in different groups. The members outside a bucket's largest group meet all its
    members, block by block."""
    groups = connected_components(edges.select(F.col("id").alias("a"), F.col("p").alias("b")), "near-open")
    placed = materialize(cut.join(groups, "id", "left").select("key", "id", "parts", "b", F.coalesce("root", "id").alias("g")), "near-placed")
    counts = placed.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("g", F.struct("n", "g")).alias("top"), F.sum("n").alias("k"), F.max("n").alias("most")).where("k > most")
    open_ = largest.select("key", "top", F.ceil((F.col("k") - F.col("most")) / block_members).cast("long").alias("strays"))
    facing = placed.join(open_, "key")
    zero = F.lit(0).cast("long")
    outside = facing.where("g <> top").withColumn("lo", F.pmod(F.xxhash64("id", "key"), F.col("strays"))).withColumn("hi", F.explode(F.sequence(zero, F.col("parts") - 1)))
    every = facing.withColumn("lo", F.explode(F.sequence(zero, F.col("strays") - 1))).withColumn("hi", F.col("b"))
    side = lambda df, k: df.select("key", "lo", "hi", F.lit(k).cast("long").alias("side"), "id", "g")
    return in_cells(side(outside, 0).unionByName(side(every, 1)), classes, m, percent, slack)


def _set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _linked(sets: list[np.ndarray], percent: int, whole: list[int], label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect sets: each set in ``whole`` is compared with all sets that
    are not yet in its component. Returns a spanning forest; ``label``, the component of
    each set, is brought up to date."""
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    heads = ends - size
    tokens, number = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(len(tokens), np.int32)
    out = []
    for i in whole:
        rest = np.flatnonzero((label != label[i]) & (np.minimum(size, size[i]) * 100 >= percent * np.maximum(size, size[i])))
        if not len(rest):
            continue
        own = number[heads[i] : ends[i]]
        has[own] = 1
        if len(rest) * 4 > len(sets):
            common = np.add.reduceat(has[number], heads)[rest]
        else:
            at = np.repeat(heads[rest] - (np.cumsum(size[rest]) - size[rest]), size[rest]) + np.arange(int(size[rest].sum()))
            common = np.add.reduceat(has[number[at]], np.cumsum(size[rest]) - size[rest])
        for j in rest[common * 100 >= percent * (size[i] + size[rest] - common)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
        has[own] = 0
    return out


def _small_group(percent: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("links", "descending"), ("id", "ascending")])
        ids, sets = np.asarray(t["id"].combine_chunks()), [_set(b) for b in t["elements"].to_pylist()]
        label = np.arange(len(ids))
        _linked(sets, percent, [0], label)
        _linked(sets, percent, np.flatnonzero(label != label[0]).tolist(), label)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        return pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array(least[label], pa.int64())})

    return run


def _blocks(percent: int):
    def run(stray: pa.Table, others: pa.Table) -> pa.Table:
        if not stray.num_rows or not others.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids = stray["id"].to_pylist() + others["id"].to_pylist()
        sets = [_set(b) for b in stray["elements"].to_pylist() + others["elements"].to_pylist()]
        label = np.unique(np.array(stray["root"].to_pylist() + others["root"].to_pylist()), return_inverse=True)[1]
        links = _linked(sets, percent, list(range(stray.num_rows)), label)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return run


def _true_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = _set(one), _set(other)
                common = len(np.intersect1d(a, b, assume_unique=True))
                near.append(common * 100 >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def confirmed(docs: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str, text_col: str, percent: int, task_weight: int) -> DataFrame:
    """(id, root) of the classes in candidate groups: the components of true links."""
    groups = connected_components(edges.select(F.col("id").alias("a"), F.col("p").alias("b")), "near-groups")
    links = edges.select(F.explode(F.array("id", "p")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    info = classes.select("id", "n", "f1", "f2")
    members = materialize(groups.join(links, "id").join(info, "id").select("id", F.col("root").alias("g"), "links", "n", "f1", "f2"), "near-members")
    wanted = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).join(wanted, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", limit=1 << 20, rows=4096):
            el, row = shingle_sets(batch.column(5))
            f = fingerprints(el, row, batch.num_rows).view(np.int64)
            ok = (f[:, 0] == np.asarray(batch.column(3))) & (f[:, 1] == np.asarray(batch.column(4)))
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            blobs = [s.tobytes() for s in np.split(el, ends[:-1])]
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], ["id", "g", "links", "elements"])
            yield out.filter(pa.array(ok))

    sets = texts.select("id", "g", "links", "f1", "f2", "t").mapInArrow(run, "id long, g long, links long, elements binary")
    # a repeated row gives its set again
    sets = materialize(sets.dropDuplicates(["id"]), "near-sets")
    sized = materialize(members.groupBy("g").agg(F.sum(_weight("n")).alias("total")), "near-sizes")
    small = sets.join(sized.where(F.col("total") <= task_weight), "g", "left_semi")
    done = small.groupBy("g").applyInArrow(_small_group(percent), "id long, root long")
    large = sized.where(F.col("total") > task_weight)
    if large.isEmpty():
        return done
    return done.unionByName(in_blocks(sets, members, large, edges, percent, task_weight))


def _weight(n: str) -> Column:
    """What a set costs a task: its elements, and as much for itself as ROW_WEIGHT."""
    return F.col(n) + F.lit(ROW_WEIGHT)


def in_blocks(sets: DataFrame, members: DataFrame, large: DataFrame, edges: DataFrame, percent: int, task_weight: int) -> DataFrame:
    """(id, root) within the groups ``large``: first the candidate edges are confirmed,
    pair by pair; then the members outside a group's main component, block by block,
    meet all members of the group."""
    big = materialize(members.join(large, "g").select("id", "g", "n", "total"), "near-big")
    elements = sets.join(big.select("id"), "id", "left_semi").select("id", "elements")
    first = edges.join(elements, "id").select("id", "p", F.col("elements").alias("x"))
    both = first.join(elements.select(F.col("id").alias("p"), F.col("elements").alias("y")), "p").select("id", "p", "x", "y")
    linked = materialize(both.mapInArrow(_true_links(percent), "a long, b long"), "near-linked")
    placed = materialize(big.join(connected_components(linked, "near-tree"), "id", "left").select("id", "g", "n", "total", F.coalesce("root", "id").alias("root")), "near-placed")
    counts = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("k"), F.sum(_weight("n")).alias("w"))
    main = counts.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max_by("w", F.struct("k", "root")).alias("own"))
    # several blocks at least, so that a group is never one task's, and no more than needed beyond
    parts = lambda w: F.greatest(F.lit(1), F.ceil(w / (4 * task_weight)), F.least(F.lit(8), F.ceil(w * 4 / task_weight))).cast("long")
    facing = placed.join(main, "g").withColumn("ap", parts(F.col("total"))).withColumn("sp", parts(F.col("total") - F.col("own")))
    zero = F.lit(0).cast("long")
    own = facing.where("root <> main").withColumn("sb", F.pmod(F.xxhash64("id"), F.col("sp"))).withColumn("ab", F.explode(F.sequence(zero, F.col("ap") - 1)))
    every = facing.where("total > own").withColumn("ab", F.pmod(F.xxhash64("id", F.lit(1)), F.col("ap"))).withColumn("sb", F.explode(F.sequence(zero, F.col("sp") - 1)))
    keys = ["g", "sb", "ab"]
    columns = [*keys, "id", "root", "elements"]
    deal = lambda df: df.join(elements, "id").select(*columns).toDF(*columns).groupBy(*keys)
    met = deal(own).cogroup(deal(every)).applyInArrow(_blocks(percent), "a long, b long")
    return connected_components(linked.unionByName(met), "near-large")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, slack: float = SLACK, block_members: int = BLOCK_MEMBERS, task_weight: int = TASK_WEIGHT) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id, kept.

    component_id is the smallest id that links reach, the row's own included; kept
    says that it is the row's own. Texts without words, null ones too, have an empty
    set and link with nothing. Rows with a null id join the component of an equal
    set, or have a null component_id and are kept. Rows that repeat an id count as
    one document; if their texts differ, the id's smallest component is meant by
    each. An empty table gives an empty result.
    """
    all_rows = materialize(sketched(docs, id_col, text_col, bands * rows), "near-sketches")
    full = all_rows.where("n > 0 AND id IS NOT NULL")
    classes = materialize(full.groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "regs")).alias("x")).select("f1", "f2", "n", "x.id", "x.regs"), "near-classes")
    edges = candidate_edges(classes, bands, rows, percent, slack, block_members)
    roots = confirmed(docs, classes, edges, id_col, text_col, percent, task_weight)
    named = classes.select("f1", "f2", "n", F.col("id").alias("class")).join(roots.select(F.col("id").alias("class"), "root"), "class", "left").select("f1", "f2", "n", F.coalesce("root", "class").alias("component"))
    out = all_rows.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
