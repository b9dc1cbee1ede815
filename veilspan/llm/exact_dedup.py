"""Exact duplicates against history, through minimal perfect hashes.

History is a table of distinct text digests with their winner. It is cut into
shards of bounded size; each shard gets a minimal perfect hash (hash and
displace): n digests, n slots. A slot holds the full 32-byte digest, the winner's
id and the number of rows, so a lookup compares all bytes and cannot mistake a
foreign digest for a member. Incoming digests that are no members group among
themselves.

Only digests and ids are shuffled. Both sides are aggregated per digest before
they meet, so a text that a third of all rows share is one row at a lookup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, splitmix

#: Digests that a shard holds on average.
SHARD_DIGESTS = 20_000
#: Digests that a displacement bucket holds on average.
BUCKET_DIGESTS = 4

INDEX_SCHEMA = "shard long, seeds binary, digests binary, winners binary, counts binary"
GROUP_SCHEMA = "digest binary, keep_id long, group_size long, known boolean"
_NO_ID = np.iinfo(np.int64).min


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row; the digest is SHA-256 of the whole text in UTF-8,
    a null text counts as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, winner, n): the largest id of each digest; null ids lose to all others."""
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest: one picks the bucket, one the slot."""
    words = raw.reshape(-1, 32)[:, :16].copy().view(np.uint64)
    return words[:, 0], words[:, 1]


def _slot(key: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (splitmix(key + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_mph(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket and the slot of each of n distinct digests, a permutation of
    0..n-1. Buckets are placed largest first; the seed of a bucket is the first
    that sends its digests to free, different slots."""
    n = len(raw) // 32
    pick, key = _keys(raw)
    buckets = max(1, n // BUCKET_DIGESTS)
    bucket = (splitmix(pick) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.empty(n, np.int64), np.zeros(n, bool)
    sizes = np.diff(bounds)
    tries = np.arange(64, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        members = order[bounds[b] : bounds[b + 1]]
        base = 0
        while True:
            at = _slot(key[members][None, :], (tries + np.uint64(base))[:, None], n)
            good = ~taken[at].any(axis=1)
            if len(members) > 1 and good.any():
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[b], slots[members] = base + k, at[k]
                taken[at[k]] = True
                break
            base += len(tries)
    return seeds, slots


def lookup(raw: np.ndarray, seeds: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each digest, and whether the slot's full digest is the same."""
    n = len(digests) // 32
    if not n:
        none = np.zeros(len(raw) // 32, np.int64)
        return none, none.astype(bool)
    pick, key = _keys(raw)
    slot = _slot(key, seeds[(splitmix(pick) % np.uint64(len(seeds))).astype(np.int64)], n)
    return slot, (digests.reshape(-1, 32)[slot] == raw.reshape(-1, 32)).all(axis=1)


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().fill_null(_NO_ID), dtype=np.int64)


def _build_shard(t: pa.Table) -> pa.Table:
    raw = _raw(t["digest"])
    seeds, slots = build_mph(raw)
    back = np.empty(len(slots), np.int64)
    back[slots] = np.arange(len(slots))
    return pa.table({
        "shard": t["shard"].slice(0, 1),
        "seeds": pa.array([seeds.tobytes()], pa.binary()),
        "digests": pa.array([raw.reshape(-1, 32)[back].tobytes()], pa.binary()),
        "winners": pa.array([_ids(t["winner"])[back].tobytes()], pa.binary()),
        "counts": pa.array([_ids(t["n"])[back].tobytes()], pa.binary()),
    })


def _groups(raw: np.ndarray, keep: np.ndarray, n: np.ndarray, known: np.ndarray) -> pa.Table:
    return pa.table({
        "digest": pa.array([x.tobytes() for x in raw.reshape(-1, 32)], pa.binary()),
        "keep_id": pa.array(keep, pa.int64(), mask=keep == _NO_ID),
        "group_size": pa.array(n, pa.int64()),
        "known": pa.array(known, pa.bool_()),
    })


def _probe_shard(index: pa.Table, incoming: pa.Table) -> pa.Table:
    blob = lambda name, kind: np.frombuffer(index[name][0].as_py() if index.num_rows else b"", kind)
    digests, keep, n = blob("digests", np.uint8), blob("winners", np.int64).copy(), blob("counts", np.int64).copy()
    raw, ids, rows = _raw(incoming["digest"]), _ids(incoming["winner"]), _ids(incoming["n"])
    slot, known = lookup(raw, blob("seeds", np.uint32), digests)
    hit = slot[known]  # distinct: incoming digests are
    keep[hit] = np.maximum(keep[hit], ids[known])
    n[hit] += rows[known]
    fresh = ~known
    return pa.concat_tables([
        _groups(digests, keep, n, np.ones(len(keep), bool)),
        _groups(raw.reshape(-1, 32)[fresh].reshape(-1), ids[fresh], rows[fresh], np.zeros(int(fresh.sum()), bool)),
    ])


def _with_shard(distinct: DataFrame, shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("long"))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard that has digests: displacement seeds and the slot arrays."""
    return _with_shard(distinct, shards).groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA)


def probe(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """Groups of history and incoming digests together: (digest, keep_id, group_size,
    known); known says that history has the digest."""
    return index.groupBy("shard").cogroup(_with_shard(incoming, shards).groupBy("shard")).applyInArrow(_probe_shard, GROUP_SCHEMA)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, digest (hex).

    ``history`` has the columns of docs; its rows count for groups and winners but
    are not returned. None: the earlier half of docs by id is the history and both
    halves are returned. Of equal texts the largest id stays; null texts count as
    empty; a null id loses to any other; rows that repeat an id and text get the
    same decision. An empty table gives an empty result.
    """
    rows = materialize(digest_rows(docs, id_col, text_col), "exact-rows")
    if history is None:
        lo, hi, total = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
        middle = F.lit((lo + hi) // 2 if lo is not None else 0)
        past, new = rows.where(F.col("id") < middle), rows.where(F.coalesce(F.col("id") >= middle, F.lit(True)))
    else:
        past, new = materialize(digest_rows(history, id_col, text_col), "exact-history"), rows
        total = rows.count() + past.count()
    shards = total // shard_digests + 1
    groups = probe(build_index(distinct_digests(past), shards), distinct_digests(new), shards)
    return (
        rows.join(groups, "digest")
        .select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))
    )
