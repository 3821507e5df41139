"""Secrets in texts: fixed patterns, and runs of high entropy found with sliding windows."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from siftwell.llm.common import map_texts

#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")

# The base patterns and the shortest match that counts.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LENGTH, _ACCESS_LENGTH = 12, 18

#: Strings that may be secrets: long runs of characters that keys and tokens are made of.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Width of the sliding window, in characters.
WINDOW = 20
#: Bits per character that a window must have, by the narrowest class that holds the candidate.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.9}
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alphanumeric", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))
#: Candidates that are no secrets: words without digits, dates and numbers, UUIDs, paths and names of words, documented examples.
ALLOWED = (
    r"[A-Za-z+/_=-]+",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"/?([A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]*[0-9]{0,4}",
    r".*EXAMPLE.*",
)
#: c log2 c for the counts that a window can hold.
_TERMS = [0.0] + [c * math.log2(c) for c in range(1, 4096)]


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap per kind, too short ones left out."""
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        yield from ((m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LENGTH)
    if "AKIA" in text:
        yield from ((m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LENGTH)
    yield from ((m.start(), 2, m.end()) for m in _HEX.finditer(text))


def dense_runs(run: str, threshold: float, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Joined [start, end) places of the windows of ``run`` whose Shannon entropy reaches ``threshold``.

    Moving a window by one changes two counts, so its sum of c log2 c is kept and corrected.
    """
    if len(run) < window:
        return
    counts: dict[str, int] = {}
    total = 0.0
    start = end = -1
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        total += _TERMS[c + 1] - _TERMS[c]
        counts[char] = c + 1
        if i >= window:
            gone = run[i - window]
            c = counts[gone]
            total += _TERMS[c - 1] - _TERMS[c]
            counts[gone] = c - 1
        if i >= window - 1 and math.log2(window) - total / window >= threshold - 1e-9:
            at = i - window + 1
            if at <= end:
                end = i + 1
            else:
                if end > 0:
                    yield start, end
                start, end = at, i + 1
    if end > 0:
        yield start, end


class Scanner:
    """Finds all spans of a text; ``allowed`` patterns suppress whole candidates."""

    def __init__(self, allowed: tuple[str, ...] = ALLOWED, window: int = WINDOW, thresholds: dict[str, float] | None = None):
        if not 2 <= window < len(_TERMS):
            raise ValueError("the window is too wide or too narrow")
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None
        self.window, self.thresholds = window, thresholds or THRESHOLDS

    def added(self, text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Dense runs of candidates that the allow list does not name, but for those within one of the ``base`` spans, which are sorted."""
        starts = [a for a, _, _ in base]
        reach = list(accumulate((b for _, _, b in base), max))
        for m in _CANDIDATE.finditer(text):
            if self.allowed and self.allowed.fullmatch(m[0]):
                continue
            kind = next(name for name, chars in _CLASSES if chars.fullmatch(m[0]))
            for start, end in dense_runs(m[0], self.thresholds[kind], self.window):
                before = bisect_right(starts, m.start() + start)
                if not before or reach[before - 1] < m.start() + end:
                    yield m.start() + start, 3, m.start() + end

    def find(self, data: bytes | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base and all spans of a UTF-8 text as sorted (start, kind, end) in code points."""
        text = (data or b"").decode(errors="replace")
        base = sorted(base_spans(text))
        return base, sorted([*base, *self.added(text, base)])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", **options) -> DataFrame:
    """Columns ``keep`` with n_assign, n_access, n_hex, base_spans and spans (kind:start:end, comma-joined) of each whole text.

    A null text is an empty one and has no spans. Repeated rows are repeated, other
    columns are left out, an empty table gives no rows.
    """
    scanner = Scanner(**options)

    def found(texts: list[bytes | None]) -> tuple[list, ...]:
        both = [scanner.find(t) for t in texts]
        counts = ([sum(k == kind for _, k, _ in base) for base, _ in both] for kind in range(3))
        return (*counts, [listed(base) for base, _ in both], [listed(every) for _, every in both])

    return map_texts(docs, text, keep, "n_assign long, n_access long, n_hex long, base_spans string, spans string", found)
