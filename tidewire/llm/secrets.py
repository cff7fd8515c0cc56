"""Operator 10: secret scan with multipart credential linking.

Base kinds (assign, access, hex) are reported wherever they match. Weak parts, that is, account identifiers,
opaque tokens and endpoints, mean little alone: they are reported only when complementary parts co-occur in
a scope. A scope is the text between blank lines; within it, parts meet at any distance, unless a ``reach`` in
code points is given. An opaque token (``token``) needs an identifier
(``ident`` or ``access``) or an endpoint beside it; an identifier needs a token, hex or assigned secret; an
endpoint needs both an identifier and a secret. Each reported part carries its nearest partner. The join
looks up neighbours in sorted starts, so its cost follows the number of parts and no pairs are listed.

Defined cases: null and empty texts have no spans; every row is scanned by itself, so repeated rows repeat;
equal distances link to the earlier partner; positions are code points, end exclusive; other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import id_and_text, table

#: The order in which kinds of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"""(?:client_?id|access_?key(?:_?id)?|account(?:_?id)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
#: A whole run of token characters; it counts if it holds a digit and a capital.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", re.A)
DIGIT, CAPITAL = re.compile(r"[0-9]"), re.compile(r"[A-Z]")
#: The scheme of an endpoint backwards from its ``://``, which is looked for first; what follows it.
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
TARGET = re.compile(r"""[^\s"'<>]+""", re.A)
SCOPE = re.compile(r"\n[^\S\n]*\n")

PARTS = "spans array<struct<kind:string,start:int,end:int,partner_start:int,partner_end:int>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int32()) for c in ("start", "end", "partner_start", "partner_end"))]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers, endpoints and tokens that no base span and no earlier kind overlaps."""
    out: list[tuple[int, int, str]] = []
    for kind, found in (("ident", identifiers), ("endpoint", endpoints), ("token", tokens)):
        taken = Neighbours([*base, *out])
        out += [part for span in found(text) if not taken.overlap(part := (*span, kind))]
    return out


def identifiers(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in IDENT.finditer(text)) if ":" in text or "=" in text else iter(())


def tokens(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in TOKEN.finditer(text) if DIGIT.search(m[0]) and CAPITAL.search(m[0]))


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """scheme://target, leftmost and not overlapping; each character is read a few times at most."""
    end, at = 0, text.find("://")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in SCHEME:
            start -= 1
        while start < at and not text[start].isalpha():
            start += 1
        target = TARGET.match(text, at + 3) if start < at else None
        if target:
            end = target.end()
            yield start, end
        at = text.find("://", max(at + 1, end))


class Neighbours:
    """Parts by start, and for each the one that reaches furthest so far: both sides of a part in one lookup."""

    def __init__(self, parts: list[tuple[int, int, str]]):
        self.parts = sorted(parts)
        self.starts = [p[0] for p in self.parts]
        self.reaching = list(accumulate(self.parts, lambda a, b: b if b[1] > a[1] else a))

    def overlap(self, part: tuple[int, int, str]) -> bool:
        k = bisect_left(self.starts, part[1])
        return k > 0 and self.reaching[k - 1][1] > part[0]

    def nearest(self, part: tuple[int, int, str], reach: int | None) -> tuple[int, int] | None:
        """The nearest (within reach, if one is given); of equally near ones the earlier."""
        k = bisect_left(self.starts, part[0])
        sides = [*self.reaching[k - 1 : k][:1], *self.parts[k : k + 1]] if k else self.parts[:1]
        gaps = [(max(o[0] - part[1], part[0] - o[1], 0), o[0], o[1]) for o in sides]
        best = min(gaps, default=None)
        return best[1:] if best and (reach is None or best[0] <= reach) else None


def find_spans(text: str | None, reach: int | None = None) -> list[tuple[str, int, int, int | None, int | None]]:
    """(kind, start, end, partner's start and end): base spans, and weak ones that have their complement."""
    if not text:
        return []
    base = base_spans(text)
    weak = weak_parts(text, base)
    found = [(s, e, k, None) for s, e, k in base]
    if weak:
        cuts = [m.start() for m in SCOPE.finditer(text)]
        scopes: dict[int, list[tuple[int, int, str]]] = {}
        for part in sorted([*base, *weak]):
            scopes.setdefault(bisect_left(cuts, part[0]), []).append(part)
        for parts in scopes.values():
            of = lambda *kinds: Neighbours([p for p in parts if p[2] in kinds])  # noqa: B023, E731
            idents, secrets, ends = of("ident", "access"), of("token", "hex", "assign"), of("endpoint")
            for p in parts:
                if p[2] == "token":
                    link = idents.nearest(p, reach) or ends.nearest(p, reach)
                elif p[2] == "ident":
                    link = secrets.nearest(p, reach)
                elif p[2] == "endpoint":
                    link = secrets.nearest(p, reach) if idents.nearest(p, reach) else None
                else:
                    continue
                if link:
                    found.append((*p, link))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [(k, s, e, *(link or (None, None))) for s, e, k, link in found]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """doc_id and spans of every whole text, in order of start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "partner_start", "partner_end")
        for whole in batches:
            for b in slices(whole, 1):
                spans = [[dict(zip(names, s, strict=True)) for s in find_spans(t, reach)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, ARROW)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {PARTS}")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
