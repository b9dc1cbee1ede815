"""Secrets in texts, with multipart credential linking.

Three strong kinds stand by themselves: assignments to a secret-naming key
(``assign``), published access key ids (``access``) and long lower-case hex runs
(``hex``). Weak candidates are too common to report alone: short or partial access
identifiers (``weak_id``), short assigned values and dense tokens
(``weak_secret``), and addresses of services (``endpoint``). They are parts of one
credential when complementary parts lie in one scope, a paragraph, within a reach:
an interval join of the parts of a document on (scope, start - reach, end + reach),
done by binary search over the sorted parts, so a scope with many parts costs
n log n and never all pairs. A weak candidate without a complement is dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("weak_id", "weak_secret", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS

#: Code points within which complementary parts belong together.
REACH = 400
#: Bits per character from which a token without a naming key counts as dense.
DENSE_BITS = 3.6

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ finds them
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ID_WORDS = ("akia", "asia", "key_id", "keyid", "client_id", "clientid", "account_id", "username", "user_id", "userid", "accountid", "access_key")
_WEAK_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{8,}"""
    r"""|(?ai:(?:access_?)?key_?id|client_?id|account_?id|user_?id|username|access_key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,}))"""
)
_DENSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(
    r"""(?ai:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,})|(?ai:(?<![a-z0-9_])(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9.-]{3,}"""
    r"""|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![0-9])"""
)
_ENDPOINT_WORDS = ("host", "endpoint", "server")
_PORT = re.compile(r"[0-9]:[0-9]{2}")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str, low: str) -> list[Span]:
    """Strong matches in order of start, then kind; ``low`` is the lower-cased text."""
    found: list[Span] = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _bits(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def _dense(token: str) -> bool:
    kinds = sum(bool(re.search(p, token)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return kinds == 3 and _bits(token) >= DENSE_BITS


def weak_parts(text: str, low: str, strong: list[Span]) -> list[Span]:
    """Weak candidates that no strong span touches. Each role is looked for behind
    literals that its pattern needs; ``link`` alone decides what belongs together. Every
    credential has a secret, so a text without one has no parts."""
    found: list[Span] = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("weak_secret", m.start(), m.end()) for m in _ASSIGN.finditer(text) if 6 <= m.end(2) - m.start(2) < 12]
    found += [("weak_secret", m.start(), m.end()) for m in _DENSE.finditer(text) if _dense(m[0])]
    if not found and not any(k != "access" for k, _, _ in strong):
        return []
    if any(w in low for w in _ID_WORDS):
        found += [("weak_id", m.start(), m.end()) for m in _WEAK_ID.finditer(text)]
    if "://" in text or any(w in low for w in _ENDPOINT_WORDS) or _PORT.search(text):
        found += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    taken = [(s, e) for _, s, e in strong]
    starts, ends = [s for s, _ in taken], sorted(e for _, e in taken)
    free = [p for p in found if bisect_left(starts, p[2]) - bisect_right(ends, p[1]) <= 0]
    return sorted(set(free), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: The part that a kind plays, and the parts that complete it. A hex run that nothing
#: names is a secret beside an identifier, but not beside an address: commits and
#: checksums stand next to links.
_ROLE = {"access": "id", "weak_id": "id", "assign": "secret", "hex": "bare", "weak_secret": "secret", "endpoint": "endpoint"}
_NEEDS = {"id": ("secret", "bare"), "secret": ("id", "endpoint"), "bare": ("id",), "endpoint": ("secret",)}


def link(text: str, strong: list[Span], weak: list[Span], reach: int = REACH) -> tuple[list[Span], list[tuple[int, int]]]:
    """All spans to report, and for each part its nearest complement in the same
    scope as a pair of positions in that list. Scopes end at blank lines. The nearest is
    the first that starts no earlier, or of those before the one that ends last."""
    if not weak:
        return strong, []
    cuts = [m.start() for m in _BLANK.finditer(text)]
    parts = sorted(strong + weak, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    by_role: dict[tuple[str, int], list[int]] = {}
    for i, (kind, start, _) in enumerate(parts):
        by_role.setdefault((_ROLE[kind], bisect_right(cuts, start)), []).append(i)
    starts = {k: [parts[i][1] for i in v] for k, v in by_role.items()}
    furthest = {k: list(accumulate(v, lambda a, b: b if parts[b][2] > parts[a][2] else a)) for k, v in by_role.items()}
    near: dict[int, int] = {}
    for i, (kind, start, end) in enumerate(parts):
        scope, best = bisect_right(cuts, start), None
        for role in _NEEDS[_ROLE[kind]]:
            key = (role, scope)
            if key not in by_role:
                continue
            at = bisect_left(starts[key], start)
            for j in ([furthest[key][at - 1]] if at else []) + by_role[key][at : at + 1]:
                gap = max(parts[j][1] - end, start - parts[j][2], 0)
                if gap <= reach and (best is None or gap < best[0]):
                    best = (gap, j)
        if best:
            near[i] = best[1]
    strong_at = set(strong)
    kept = [i for i, p in enumerate(parts) if p in strong_at or i in near]
    new = {old: k for k, old in enumerate(kept)}
    return [parts[i] for i in kept], [(new[i], new[j]) for i, j in near.items() if i in new and j in new]


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span], list[tuple[int, int]]]:
    """Base spans, all spans and links of one text; null is empty."""
    text = text or ""
    low = text.lower()
    strong = base_spans(text, low)
    spans, links = link(text, strong, weak_parts(text, low, strong), reach)
    return strong, spans, links


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_LINK = pa.struct([("part", pa.int32()), ("complement", pa.int32())])
SCHEMA = "id long, base array<struct<kind: string, start: bigint, end: bigint>>, spans array<struct<kind: string, start: bigint, end: bigint>>, links array<struct<part: int, complement: int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row for each row of docs: id, base spans, all spans (base ones included) and
    links. Offsets are code points, ends exclusive. Null texts are empty and have no
    spans; repeated rows are scanned each; an empty table gives an empty result.
    One narrow stage, whole texts, nothing shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = [scan(t, reach) for t in batch.column(1).to_pylist()]
            as_rows = lambda k: [[{"kind": a, "start": s, "end": e} for a, s, e in f[k]] for f in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array(as_rows(0), pa.list_(_SPAN)),
                pa.array(as_rows(1), pa.list_(_SPAN)),
                pa.array([[{"part": i, "complement": j} for i, j in f[2]] for f in found], pa.list_(_LINK)),
            ], ["id", "base", "spans", "links"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(run, SCHEMA)
