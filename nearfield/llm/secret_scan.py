"""Secrets in texts, with multipart credential linking.

Strong patterns stand by themselves. Weak parts (identifiers, secrets, endpoints)
are common in clean text, so they count only where complementary parts meet: the
parts of a text are joined by interval on scopes around them, an identifier
needs a secret in its scope, a secret an identifier, an endpoint both.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import table, texts

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
_SPACE_Q = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))" + _SPACE_Q + r"([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts; the value is the last group.
WEAK_ID = re.compile(r"(?ai:\b(user(?:_?name)?|login|account(?:_id)?|client_?id|access_?key(?:_?id)?))" + _SPACE_Q + r"([A-Za-z0-9@._-]{3,})")
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])([A-Za-z0-9+/_-]{32,64}={0,2})(?![A-Za-z0-9+/_=-])")
#: Hosts start where a token starts and have labels of at most 63 characters, so each character of a long run is looked at a bounded number of times.
WEAK_ENDPOINT = re.compile(r"(?a:(\b[a-z][a-z0-9+.-]{1,11}://[^\s\"'<>]{3,}|\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}|(?<![A-Za-z0-9_.-])(?:[a-z0-9-]{1,63}\.)+(?:amazonaws|googleapis|azure|internal)\.[a-z]{2,}))")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ID_WORDS = ("user", "login", "account", "client", "access")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the strong patterns: leftmost and not overlapping within a kind, short ones dropped."""
    out = []
    low = text.lower()
    # the pattern folds ASCII letters only; lower() may fold more, which costs a look and no match
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(w in low for w in _ID_WORDS):
        out += [("id", *m.span(2)) for m in WEAK_ID.finditer(text)]
    out += [("key", *m.span(1)) for m in WEAK_KEY.finditer(text)]
    if "://" in text or ":" in text or ".com" in low or ".net" in low or ".internal" in low:
        out += [("endpoint", *m.span(1)) for m in WEAK_ENDPOINT.finditer(text)]
    return out


_ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
_NEEDS = {"id": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}


def linked(strong: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], scope: int) -> list[tuple[str, int, int]]:
    """The weak parts that have their complementary parts within ``scope`` code points.

    An interval join: of each role the starts and the ends are kept in order, so the
    parts that touch a scope, and those of them that overlap the part in question,
    are counted by bisection. What overlaps a part is the same text and complements
    nothing; nor does a weak part count that a strong one of its own role overlaps.
    """
    roles: dict[str, list[tuple[int, int]]] = {"secret": [], "id": [], "endpoint": []}
    sure: dict[str, list[tuple[int, int]]] = {"secret": [], "id": [], "endpoint": []}
    for kind, a, b in strong:
        sure[_ROLE[kind]].append((a, b))
    for kind, a, b in strong + weak:
        roles[_ROLE[kind]].append((a, b))
    sides = lambda parts: (sorted(a for a, _ in parts), sorted(b for _, b in parts))
    every, certain = ({role: sides(parts) for role, parts in of.items()} for of in (roles, sure))

    def touching(of: tuple[list[int], list[int]], a: int, b: int) -> int:
        """Parts that share a place with a..b (end exclusive)."""
        return bisect_left(of[0], b) - bisect_right(of[1], a)

    out = []
    for kind, a, b in weak:
        if touching(certain[_ROLE[kind]], a, b):
            continue
        # a part that ends where the scope starts, or starts where it ends, is within it
        if all(touching(every[role], a - scope - 1, b + scope + 1) > touching(every[role], a, b) for role in _NEEDS[kind]):
            out.append((kind, a, b))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_text(text: str, scope: int = 200) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that linking adds."""
    strong = base_spans(text)
    weak = weak_parts(text)
    return strong, linked(strong, weak, scope) if weak else []


def _scan(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, digests, spans = [], [], []
            for cell in batch.column(1):
                strong, more = scan_text(cell.as_py() or "", scope)
                counts.append([sum(k == kind for k, _, _ in strong) for kind in KINDS[:3]])
                digests.append(hashlib.sha256(_joined(strong).encode()).hexdigest() if strong else empty)
                spans.append(_joined(strong + more))
            n = list(zip(*counts, strict=True)) or [[], [], []]
            out = table("n_assign:l,n_access:l,n_hex:l,base_sha256:s,spans:s", n_assign=n[0], n_access=n[1], n_hex=n[2], base_sha256=digests, spans=spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["doc_id", *out.schema.names])

    return run


def scan(documents: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Spans are kind:start:end in code points, end exclusive, by start and then kind
    (``KINDS``), comma-joined; ``base_sha256`` digests those of the strong patterns,
    ``spans`` has all. Null and empty texts have none. Rows are judged one by one,
    so repeated rows and null ids change nothing; no rows in, none out.
    """
    return texts(documents).mapInArrow(_scan(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
