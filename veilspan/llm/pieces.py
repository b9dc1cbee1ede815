"""SentencePiece encoding and decoding with the n best segmentations.

A lattice has an edge for each vocabulary piece that a text contains, and an edge to
the byte pieces for each character that no piece spells. A forward Viterbi pass gives
the best score of every prefix; these are exact heuristics for an A* search that runs
backwards from the end, which so meets complete segmentations best first.

A text's lattice falls apart where no piece can cross, at least before each run of
spaces, and the parts repeat. So the forward and backward passes run over all new
parts of a batch at once in numpy, and give each part's best score and its gap to the
second best. A text's n best segmentations can only differ from its best one in the
n - 1 parts with the smallest gaps (any other part costs as much as n - 1 cheaper
choices), so A* runs on these alone and their results are merged. Nothing is cut or
approximated; texts without spaces are one part. A long part costs n steps a place, equal
scores or not.

The vocabulary is a parameter and never part of the package. Normalisation is the
identity with a dummy prefix space, as in byte-fallback vocabularies, so decoding
gives back every text exactly: U+2581 in a text is spelt as bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: The default vocabulary of the queries; a parameter everywhere.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Parts whose results a worker remembers before it begins anew.
REMEMBER = 100_000
#: New parts that are segmented at once; this bounds the edges in memory.
LEARN = 8192
#: Longer parts are segmented one by one.
LONG = 64
#: Below the worst piece, a character that no piece spells scores this much less.
UNKNOWN_PENALTY = 10.0

SPACE = "▁"
_MARK = "\udc00"  # stands for U+2581 in a text; no text holds a lone surrogate
_CUTS = "\n\t\r"


class Vocabulary:
    """Pieces with ids and scores, a trie over code points, and byte pieces."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], unk_id: int = 0, names: dict[int, bytes] | None = None):
        self.ids = {p: i for i, p, _ in pieces}
        self.scores = {p: s for _, p, s in pieces}
        self.byte_ids, self.unk_id = byte_ids, unk_id
        usual = [s for s in self.scores.values() if s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p))}
        size = max([unk_id, *byte_ids, *self.ids.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        if not byte_ids:
            self.bytes[unk_id] = " ⁇ ".encode()
        self.by_id = np.zeros(size)
        for p, i in self.ids.items():
            self.by_id[i] = self.scores[p]
        # a part begins at each run of spaces, unless a piece goes on into one
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        chars = set().union(*self.ids) if self.ids else set()
        cut = "".join(c for c in _CUTS if c not in chars)
        self.part = re.compile("(?s).+" if crossing else f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|[{cut}]" if cut else ""))
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._trie()

    def parts(self, text: str) -> list[str]:
        """The parts of a normalised text. A long one is cut further wherever no piece
        has the two characters side by side, so none can cross."""
        found = self.part.findall(text)
        if max(map(len, found), default=0) <= LONG:
            return found
        out = []
        for p in found:
            if len(p) <= LONG:
                out.append(p)
                continue
            at = 0
            for i in range(1, len(p)):
                if p[i - 1 : i + 1] not in self.pairs:
                    out.append(p[at:i])
                    at = i
            out.append(p[at:])
        return out

    def _trie(self) -> None:
        edge: dict[int, int] = {}
        piece = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                key = node << 21 | ord(c)
                if key not in edge:
                    edge[key] = len(piece)
                    piece.append(-1)
                node = edge[key]
            piece[node] = i
        self.node_piece = np.array(piece, np.int64)
        self.bits = max(4, (4 * len(edge)).bit_length())
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_node = np.zeros(1 << self.bits, np.int64)
        keys = np.array(list(edge), np.int64)
        nodes = np.array(list(edge.values()), np.int64)
        at = self._hash(keys)
        left = np.arange(len(keys))
        while len(left):  # a key per free place, the others move on
            free = left[self.table_key[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.table_key[at[put]], self.table_node[at[put]] = keys[put], nodes[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next trie nodes, -1 where there are none."""
        key = node << 21 | char
        at = self._hash(key)
        seen = self.table_key[at]
        out = np.where(seen == key, self.table_node[at], -1)
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.table_key[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.table_node[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out

    def spell(self, char: str) -> list[int]:
        """The ids of a character that no piece spells."""
        char = SPACE if char == _MARK else char
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk_id]


def load_vocabulary(model_file: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(m.get_piece_size())
    byte_ids = [i for i in ids if m.is_byte(i)]
    plain = [(i, m.id_to_piece(i), m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return Vocabulary(plain, byte_ids, m.unk_id())


def normalised(text: str) -> str:
    return SPACE + text.replace(SPACE, _MARK).replace(" ", SPACE) if text else ""


def nbest(v: Vocabulary, part: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a part, best first, as (score, ids). Of equal scores
    the search takes the one that is furthest on, then in the order that it meets them,
    which is always the same. A place is left n times at most, as n paths from it to the
    end are enough, so a part costs n steps a place whatever repeats in it."""
    size = len(part)
    into: list[list[tuple[int, float, object]]] = [[] for _ in range(size + 1)]
    forward = [0.0] + [float("-inf")] * size
    for i in range(size):
        spelt, base = False, forward[i]
        for k in range(1, min(v.longest, size - i) + 1):
            p = part[i : i + k]
            s = v.scores.get(p)
            if s is not None:
                spelt = spelt or k == 1
                into[i + k].append((i, s, p))
                if base + s > forward[i + k]:
                    forward[i + k] = base + s
            elif p not in v.prefixes:
                break
        if not spelt:
            into[i + 1].append((i, v.unknown, None))
            if base + v.unknown > forward[i + 1]:
                forward[i + 1] = base + v.unknown
    found, tick, left = [], 0, [0] * (size + 1)
    slack = 1e-9 * max(1.0, abs(forward[size]))
    queue: list = [(-forward[size], size, 0, 0.0, None)]
    while queue and len(found) < n:
        f, at, _, g, path = heapq.heappop(queue)
        if at == 0:
            ids, start, node = [], 0, path
            while node:
                end, p, node = node
                ids += v.spell(part[start]) if p is None else [v.ids[p]]
                start = end
            found.append((g, ids))
            continue
        left[at] += 1
        if left[at] > n:
            continue
        for start, s, p in into[at]:
            tick += 1
            cost = -(g + s + forward[start])
            # sums in another order differ in the last digits: that is no difference
            heapq.heappush(queue, (f if cost - f < slack else cost, start, tick, g + s, (at, p, path)))
    return found


def passes(v: Vocabulary, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For short parts at once: best score, gap to the second best (infinite if there
    is none), and the codes of the best segmentation with their count. A code is an
    id, or -1 - character for a character that no piece spells."""
    n = len(parts)
    size = np.array([len(p) for p in parts], np.int64)
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(n), size)
    place = np.arange(total) - begin[word]
    room = size[word] - place
    # edges: walk the trie from every place
    starts, lengths, codes, scores = [], [], [], []
    at, node = np.arange(total), np.zeros(total, np.int64)
    spelt = np.zeros(total, bool)
    for k in range(1, v.longest + 1):
        node = v.step(node, chars[at + k - 1])
        live = node >= 0
        at, node = at[live], node[live]
        piece = v.node_piece[node]
        hit = piece >= 0
        starts.append(at[hit])
        codes.append(piece[hit])
        scores.append(v.by_id[piece[hit]])
        lengths.append(np.full(int(hit.sum()), k))
        if k == 1:
            spelt[at[hit]] = True
        more = room[at] > k
        at, node = at[more], node[more]
        if not len(at):
            break
    lone = np.flatnonzero(~spelt)
    start = np.concatenate([*starts, lone])
    length = np.concatenate([*lengths, np.ones(len(lone), np.int64)])
    code = np.concatenate([*codes, -1 - chars[lone]])
    score = np.concatenate([*scores, np.full(len(lone), v.unknown)])
    group = place[start] * (v.longest + 1) + length
    order = np.argsort(group.astype(np.uint16) if group.max(initial=0) < 1 << 16 else group, kind="stable")
    start, length, code, score, group = start[order], length[order], code[order], score[order], group[order]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    bounds = list(zip(cuts, np.append(cuts[1:], len(group))))
    # nodes: size + 1 of each part
    origin = begin + np.arange(n)
    source = start + word[start]
    target = source + length
    forward = np.full(total + n, -np.inf)
    forward[origin] = 0
    via = np.full(total + n, -1, np.int64)
    for a, b in bounds:  # by place, then length: each target once in a group
        t = target[a:b]
        cand = forward[source[a:b]] + score[a:b]
        better = cand > forward[t]
        tb = t[better]
        forward[tb] = cand[better]
        via[tb] = np.flatnonzero(better) + a
    backward = np.full(total + n, -np.inf)
    backward[origin + size] = 0
    for a, b in reversed(bounds):
        s = source[a:b]
        backward[s] = np.maximum(backward[s], backward[target[a:b]] + score[a:b])
    best = forward[origin + size]
    # best segmentation, from the end
    on = np.zeros(len(start), bool)
    count = np.zeros(n, np.int64)
    steps = []
    live, node = np.arange(n), origin + size
    while len(live):
        e = via[node]
        on[e] = True
        count[live] += 1
        steps.append((live, code[e]))
        node = source[e]
        more = node > origin[live]
        live, node = live[more], node[more]
    out = np.empty(int(count.sum()), np.int64)
    first = np.cumsum(count) - count
    for k, (who, c) in enumerate(steps):
        out[first[who] + count[who] - 1 - k] = c
    # second best: the best segmentation through any edge off the best one
    gap = np.full(n, np.inf)
    off = np.flatnonzero(~on)
    np.minimum.at(gap, word[start[off]], best[word[start[off]]] - (forward[source[off]] + score[off] + backward[target[off]]))
    return best, np.maximum(gap, 0.0), out, count


class _Numbers(dict):
    """Numbers keys from 0 as they come."""

    def __missing__(self, key: str) -> int:
        out = self[key] = len(self)
        return out


class Encoder:
    """Encodes batches of texts and remembers parts between them."""

    def __init__(self, v: Vocabulary, n: int = N_BEST):
        self.v, self.n = v, n
        self.fresh()

    def fresh(self) -> None:
        self.number = _Numbers()
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.several: dict[int, list[tuple[float, list[int]]]] = {}

    def _learn(self, parts: list[str]) -> None:
        """Scores, gaps and ids of parts that are new."""
        v = self.v
        short = [k for k, p in enumerate(parts) if len(p) <= LONG]
        best, gap, count = np.zeros(len(parts)), np.full(len(parts), np.inf), np.zeros(len(parts), np.int64)
        flat = self.flat[:0]
        if short:
            best[short], gap[short], code, number = passes(v, [parts[k] for k in short])
            flat = code.astype(np.int32)
            at = np.flatnonzero(code < 0)
            if len(at):  # spell these characters as bytes
                spelt = [v.spell(chr(-1 - c)) for c in code[at].tolist()]
                width = np.ones(len(code), np.int64)
                width[at] = [len(s) for s in spelt]
                flat = np.repeat(flat, width)
                for b, s in zip((np.cumsum(width) - width)[at].tolist(), spelt):
                    flat[b : b + len(s)] = s
                number = np.add.reduceat(width, np.cumsum(number) - number)
            count[short] = number
        if len(short) < len(parts):
            long = {}
            for k, p in enumerate(parts):
                if len(p) > LONG:
                    ways = nbest(v, p, max(2, self.n))
                    self.several[len(self.score) + k] = ways[: self.n]
                    best[k], gap[k] = ways[0][0], ways[0][0] - ways[1][0] if len(ways) > 1 else np.inf
                    long[k], count[k] = ways[0][1], len(ways[0][1])
            first, some = np.cumsum(count) - count, flat
            flat = np.empty(int(count.sum()), np.int32)
            if short:
                own = count[short]
                flat[np.repeat(first[short] - (np.cumsum(own) - own), own) + np.arange(len(some))] = some
            for k, ids in long.items():
                flat[first[k] : first[k] + len(ids)] = ids
        self._append(best, gap, flat, count)

    def _append(self, best: np.ndarray, gap: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        self.score, self.gap = np.concatenate([self.score, best]), np.concatenate([self.gap, gap])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])

    def _of(self, number: int, part: str) -> list[tuple[float, list[int]]]:
        if number not in self.several:
            self.several[number] = nbest(self.v, part, self.n)
        return self.several[number]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], list[list[dict]]]:
        """Ids of the best segmentations, flat, with the count of each text; the best
        scores; and the further segmentations of each text, best first, as
        {score, edits}: an edit replaces ``drop`` ids of the best segmentation from
        ``at`` on by ``ids``."""
        if len(self.number) > REMEMBER:
            self.fresh()
        known = len(self.number)
        split = [self.v.parts(normalised(t)) for t in texts]
        sizes = np.array([len(s) for s in split], np.int64)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if len(self.number) > known:
            fresh = islice(self.number, known, None)
            while parts := list(islice(fresh, LEARN)):
                self._learn(parts)
        count = self.count[number]
        ends = np.cumsum(count)
        first = (np.cumsum(self.count) - self.count)[number]
        flat = self.flat[np.repeat(first - (ends - count), count) + np.arange(int(count.sum()))] if len(number) else self.flat[:0]
        gaps, scores = self.gap[number], self.score[number]
        lengths, best, further = np.zeros(len(texts), np.int64), [], []
        at = 0
        for text, size in enumerate(sizes.tolist()):
            own = slice(at, at + size)
            lengths[text] = count[own].sum()
            top = float(scores[own].sum())
            best.append(top)
            further.append(self._further(number[own], gaps[own], count[own], split[text], top) if size and self.n > 1 else [])
            at += size
        return flat, lengths, best, further

    def _further(self, number: np.ndarray, gaps: np.ndarray, count: np.ndarray, parts: list[str], top: float) -> list[dict]:
        need = self.n - 1
        k = np.argpartition(gaps, need - 1)[:need] if len(gaps) > need else np.arange(len(gaps))
        k = k[np.isfinite(gaps[k])]
        k = k[np.lexsort((k, gaps[k]))]
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for i in k.tolist():
            own = self._of(int(number[i]), parts[i])
            ways = heapq.nsmallest(self.n, ((c + own[0][0] - s, w + ((i, ids),) if r else w) for c, w in ways for r, (s, ids) in enumerate(own)), key=lambda x: x[0])
        before = np.cumsum(count) - count if len(ways) > 1 else count
        return [{"score": top - c, "edits": [{"at": int(before[i]), "drop": int(count[i]), "ids": ids} for i, ids in sorted(w, key=lambda x: x[0])]} for c, w in ways[1:]]


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: byte pieces are joined, the dummy space is taken off."""
    raw = b"".join(map(v.bytes.__getitem__, ids))
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def apply_edits(ids: list[int], edits: list[dict]) -> list[int]:
    """The ids of a further segmentation."""
    out, at = [], 0
    for e in edits:
        out += list(ids[at : e["at"]]) + list(e["ids"])
        at = e["at"] + e["drop"]
    return out + list(ids[at:])


_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_FURTHER = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))
SCHEMA = "id long, n_pieces long, ids array<int>, score double, further array<struct<score: double, edits: array<struct<at: int, drop: int, ids: array<int>>>>>, round_trip boolean"


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """A row for each row of docs: id, n_pieces, ids (best segmentation), score,
    further (the next n - 1 segmentations as edits of the best) and round_trip (the
    decoded ids are the text).

    Null and empty texts have no pieces and score 0. Repeated rows are encoded each;
    an empty table gives an empty result. One narrow stage over whole texts; only
    the vocabulary is broadcast, whose size is that of its file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        encoder = Encoder(v, n)
        for batch in slices(batches, "t"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            flat, lengths, score, further = encoder.encode(texts)
            ends = list(accumulate(lengths.tolist(), initial=0))
            same = [decode(v, flat[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat.astype(np.int32))),
                pa.array(score, pa.float64()), pa.array(further, _FURTHER), pa.array(same, pa.bool_()),
            ], ["id", "n_pieces", "ids", "score", "further", "round_trip"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_file: str = MODEL_FILE, id_col: str = "id", ids_col: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """(id, text) of encoded rows; null ids decode to an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [decode(sent.value, x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")
