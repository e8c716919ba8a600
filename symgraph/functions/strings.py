"""Strings of the command line and of keys."""

from __future__ import annotations

import re


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in bytes."""
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
    return row[-1]


def similar(name: str, known: list[str]) -> str:
    """The first of the known names (in order) that is nearest, if it is two edits away at most."""
    best = min(sorted(known), key=lambda k: edit_distance(name, k), default="")
    return best if best and edit_distance(name, best) <= 2 else ""


def human_size(n: int) -> str:
    if n < 1024:
        return f"{n}B"
    value = float(n)
    for unit in ("KB", "MB", "GB"):
        value /= 1024
        if value < 1024 or unit == "GB":
            return f"{value:.1f}{unit}"
    raise AssertionError


def normalize_remote(url: str) -> str:
    """`user@host:path` and `scheme://host/path` as `host/path`, without a trailing slash or `.git`."""
    url = url.strip().removesuffix("/").removesuffix(".git")
    for pattern in (r"[^@]+@([^:]+):(.+)", r"[a-zA-Z]+://(?:[^@/]+@)?([^/]+)/(.+)"):
        if m := re.fullmatch(pattern, url):
            return f"{m[1]}/{m[2].lstrip('/')}"
    return url


def safe_key(raw: str) -> str:
    return re.sub(r"[^A-Za-z0-9._/-]", "_", raw).strip("/") or "unnamed"
