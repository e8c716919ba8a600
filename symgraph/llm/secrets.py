"""Secret scan: fixed formats plus windows of high Shannon entropy.

Base kinds (leftmost, non-overlapping per kind, failing matches dropped without a retry):

* ``assign``  a keyword, ``:`` or ``=``, and a value of 12 or more characters
* ``access``  an access key id of 18 or more characters
* ``hex``     16 or more lower-case hexadecimal digits

The method adds ``entropy`` spans.  Candidates are unbroken runs of key characters.  Each run has a
character class (hexadecimal or base-64); a window of WINDOW characters slides over it, its character
counts are updated by one added and one dropped character, and every window whose Shannon entropy
reaches the class's threshold is marked.  Overlapping windows merge.  Allow-listed runs (identifiers in
UUID form, checksums named as such, placeholders, words without digits, plain numbers) are suppressed,
and so is a span that lies wholly inside a base span.

Null and empty texts have no spans.  Repeated rows are scanned each for itself; the row count is kept.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from .common import map_rows

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
#: Bits per character from which a window counts, by the class of the run.
THRESHOLD = {"hex": 2.9, "base64": 3.7}
_HEX_RUN = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z"
    r"|(?i:.*(?:example|placeholder|changeme|dummy|redacted|x{6,}|abcdef0?123|0?1234567))",
    re.S,
)
_CHECKSUM_BEFORE = re.compile(r"(?i)(?:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|digest|integrity|commit|revision)[\"']?\s*[:=-]?\s*[\"']?\Z")
#: c * log2(c) for the counts that a window can hold.
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def character_class(run: str) -> str | None:
    """hex, base64, or None where the run can't be a key: letters only, or digits only."""
    digits = any("0" <= c <= "9" for c in run)
    letters = any(c.isalpha() for c in run)
    if not (digits and letters):
        return None
    return "hex" if _HEX_RUN.match(run) else "base64"


def hot_windows(run: str, threshold: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows with at least `threshold` bits per character, by incremental counts."""
    if len(run) < width:
        return []
    counts: dict[str, int] = {}
    total = 0.0
    for c in run[:width]:
        n = counts.get(c, 0)
        total += _CLOGC[n + 1] - _CLOGC[n]
        counts[c] = n + 1
    spans: list[tuple[int, int]] = []
    log_w, limit = math.log2(width), threshold - 1e-9
    for at in range(len(run) - width + 1):
        if at:
            n = counts[run[at - 1]]
            total += _CLOGC[n - 1] - _CLOGC[n]
            counts[run[at - 1]] = n - 1
            c = run[at + width - 1]
            n = counts.get(c, 0)
            total += _CLOGC[n + 1] - _CLOGC[n]
            counts[c] = n + 1
        if log_w - total / width >= limit:
            if spans and spans[-1][1] >= at:
                spans[-1] = (spans[-1][0], at + width)
            else:
                spans.append((at, at + width))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        kind = character_class(run)
        if kind is None or _ALLOWED.match(run) or _CHECKSUM_BEFORE.search(text, max(0, m.start() - 24), m.start()):
            continue
        out += [("entropy", m.start() + s, m.start() + e) for s, e in hot_windows(run, THRESHOLD[kind])]
    return out


def spans(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, each ordered by start, then kind as listed."""
    if not text:
        return [], []
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text), key=order)
    more, reach, at = [], 0, 0
    for x in entropy_spans(text):  # by start, as the base spans: one pass over both
        while at < len(base) and base[at][1] <= x[1]:
            reach = max(reach, base[at][2])
            at += 1
        if x[2] > reach:
            more.append(x)
    return base, sorted(base + more, key=order)


def joined(found: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts per base kind, the base digest, and all spans."""

    def fn(cols: dict) -> dict:
        both = [spans(t) for t in cols[text_col]]
        count = lambda kind: [sum(x[0] == kind for x in b) for b, _ in both]
        return {
            id_col: cols[id_col],
            "n_assign": count("assign"),
            "n_access": count("access"),
            "n_hex": count("hex"),
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in both],
            "spans": [joined(a) for _, a in both],
            "n_entropy": [sum(x[0] == "entropy" for x in a) for _, a in both],
        }

    kind = dict(docs.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return map_rows(docs.select(id_col, text_col), fn, schema)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span (overlaps merged) replaced by the mask."""
    if not text:
        return text
    out, at = [], 0
    for _, s, e in spans(text)[1]:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])
