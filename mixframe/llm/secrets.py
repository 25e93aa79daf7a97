"""Secret scan: three plain patterns, and the entropy of what else looks random.

Candidate strings are runs of characters that keys are written in. A window of
fixed width slides over a candidate; its Shannon entropy is kept up to date by
adding one count and taking one away. Windows at or above the threshold of the
candidate's character class are joined to spans. Spans inside a plain match and
candidates on the allow-list are left out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mapped

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
WINDOW = 20
#: Bits of entropy in a window of 20 from which on it counts, by character class.
THRESHOLDS = {"hex": 3.0, "upper": 3.5, "mixed": 3.7}
#: Candidates that match one of these as a whole are left alone.
ALLOW = (
    r"[A-Z]?[a-z]+",  # words
    r"[A-Z]+",
    r"[A-Za-z]+(?:[-_/][A-Za-z]+)+",  # compound words, paths
    r"[0-9_/+-]+",  # dates, phone numbers, rules
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"(.{1,4})\1+.{0,3}",  # repeated patterns
)
FIELDS = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> list[Span]:
    """Plain matches, leftmost and not overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def character_class(word: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", word):
        return "hex"
    return "upper" if re.fullmatch(r"[0-9A-Z]+", word) else "mixed"


def entropy_windows(word: str, width: int = WINDOW, threshold: float | None = None) -> list[tuple[int, int]]:
    """Joined windows of ``word`` whose entropy reaches the threshold of its class."""
    if threshold is None:
        threshold = THRESHOLDS[character_class(word)]
    counts: dict[str, int] = {}
    weighted, out = 0.0, []  # weighted: the sum of c log2 c

    def change(char: str, by: int) -> float:
        c = counts.get(char, 0)
        counts[char] = c + by
        return (c + by) * log2(c + by or 1) - c * log2(c or 1)

    for i, char in enumerate(word):
        weighted += change(char, 1)
        if i >= width:
            weighted += change(word[i - width], -1)
        if i >= width - 1 and log2(width) - weighted / width >= threshold - 1e-9:
            begin = i - width + 1
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((begin, i + 1))
    return out


def entropy_spans(text: str, base: list[Span], allow: _any_of) -> list[Span]:
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        if allow.fullmatch(m[0]):
            continue
        for begin, end in entropy_windows(m[0]):
            begin, end = begin + m.start(), end + m.start()
            # both lists are in order: of the plain matches up to here the one that reaches furthest decides
            while at < len(base) and base[at][0] <= begin:
                reach, at = max(reach, base[at][2]), at + 1
            if end > reach:
                out.append((begin, 3, end))
    return out


def scan_secrets(docs: DataFrame, allow: Iterable[str] = ALLOW) -> DataFrame:
    """Secrets in the texts of ``docs`` (``doc_id``, ``text``).

    Returns per row ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``,
    ``n_entropy``, ``base_sha256`` (of the plain spans) and ``spans``: all of
    them as ``kind:start:end``, by start and kind, joined by commas; positions
    count code points, the end is exclusive. A null text counts as empty;
    repeated rows stay; an empty table gives an empty result; other columns are
    ignored. Texts of any length are read whole, row by row.
    """
    patterns = list(allow)

    def scan(batches):
        allowed = _any_of(patterns)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = entropy_spans(text or "", base, allowed)
                for k in range(4):
                    rows[k].append(sum(s[1] == k for s in (base if k < 3 else more)))
                rows[4].append(hashlib.sha256(_written(base).encode()).hexdigest())
                rows[5].append(_written(sorted(base + more)))
            columns = [batch.column("doc_id")] + [pa.array(c, f.type) for c, f in zip(rows, list(FIELDS)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=FIELDS)

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), scan, SCHEMA)


class _any_of:
    """Patterns of which one must match the whole string."""

    def __init__(self, patterns: list[str]):
        self.patterns = [re.compile(p) for p in patterns]

    def fullmatch(self, word: str) -> bool:
        return any(p.fullmatch(word) for p in self.patterns)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)
