"""Secrets: three base patterns, and weak parts that are linked to each other."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import slices

#: The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Weak parts: none of these is reported alone.
IDENTIFIER = re.compile(
    r"""\b(?:access_?key(?:_?id)?|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""",
    re.IGNORECASE | re.ASCII,
)
ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
    r"""|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._/:-]{4,}""",
    re.IGNORECASE | re.ASCII,
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
WEAK_ASSIGN = re.compile(r"""\b(?:pwd|pass|key|credential|auth)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})""", re.IGNORECASE | re.ASCII)
SCOPE = 256
LEAST_ENTROPY_BITS = 3.2
#: Kinds that hide something; identifiers and endpoints stay in a redacted text.
HIDDEN = ("assign", "access", "hex", "weak")
KINDS = ("assign", "access", "hex", "id", "weak", "endpoint")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def _strong_enough(s: str) -> bool:
    kinds = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return kinds == 3 and _entropy(s) >= LEAST_ENTROPY_BITS


def _near(spans: list[Span], others: list[Span], scope: int) -> list[tuple[Span, Span]]:
    """Interval join: pairs whose distance is at most ``scope``.

    ``others`` are sorted by start and do not overlap, so the partners of a
    span are one run found by bisection.
    """
    starts = [o[0] for o in others]
    out = []
    for s in spans:
        i = bisect_left(starts, s[0] - scope)
        i -= i > 0 and others[i - 1][1] > s[0] - scope
        while i < len(others) and others[i][0] <= s[1] + scope:
            if others[i][:2] != s[:2]:
                out.append((s, others[i]))
            i += 1
    return out


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts that complement each other within a scope.

    A weak secret (a long mixed token, or a value assigned to a vague name) is
    reported with the identifier or endpoint that it is near; identifiers and
    endpoints are reported only with a secret, weak or of the base. Time grows
    with the text's length, however many parts it holds.
    """
    access = [s for s in base if s[2] == "access"]
    ids = [(m.start(), m.end(), "id") for m in IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)] if ":" in text or "=" in text else []
    if not (access or ids or ends):
        return []
    taken = _merged([*base, *ends])
    starts = [a for a, _ in taken]

    def free(span: Span) -> bool:
        i = bisect_left(starts, span[1]) - 1
        return i < 0 or taken[i][1] <= span[0]

    weak = [(m.start(), m.end(), "weak") for m in CANDIDATE.finditer(text) if _strong_enough(m[0])]
    weak += [(m.start(), m.end(), "weak") for m in WEAK_ASSIGN.finditer(text)]
    weak = _disjoint(list(filter(free, sorted(weak))))
    secrets = sorted([*weak, *(s for s in base if s[2] != "access")])
    found: set[Span] = set()
    parts = _disjoint(sorted([*access, *ids, *ends]))
    for secret, part in _near(secrets, parts, scope):
        found.update(x for x in (secret, part) if x[2] in ("id", "weak", "endpoint"))
    return sorted(found, key=_order)


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans cover, as intervals that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def scan(text: str | None, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a whole text."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted({*base, *linked_spans(text, base, scope)}, key=_order)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each merged span replaced by a mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    if end >= 0:
        out.append(mark)
        at = end
    return "".join(out) + text[at:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_linked`` per row.

    Spans are ``kind:start:end`` in code points, end exclusive. Linking works
    within a document, so there is no exchange. Null and empty texts have no
    spans; very long ones are scanned whole; repeated rows have a row each;
    other columns are not looked at; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, every = scan(text, scope)
                kinds = Counter(k for _, _, k in base)
                row = (
                    *(kinds[k] for k in ("assign", "access", "hex")),
                    hashlib.sha256(_joined(base).encode()).hexdigest(),
                    _joined(every),
                    len(every) - len(base),
                )
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )


def redact_documents(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span of the ``HIDDEN`` kinds replaced; all rows stay.

    Where there is a ``length_col``, it gets the new text's code points in the
    rows whose text changed. Null and empty texts stay as they are; very long
    ones are scanned whole; repeated rows are redacted alike; columns may have
    any names and types; an empty table gives no rows.
    """
    at, size_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols, texts = list(batch.columns), batch.column(at).to_pylist()
            sizes = cols[size_at].to_pylist() if size_at is not None else []
            for i, text in enumerate(texts):
                if text and (spans := [s for s in scan(text, scope)[1] if s[2] in HIDDEN]):
                    texts[i] = redact(text, spans)
                    if size_at is not None:
                        sizes[i] = len(texts[i])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if size_at is not None:
                cols[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
