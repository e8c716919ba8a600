"""Where things are: home, stores, remotes, module and alias files."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess

from ..functions.strings import normalize_remote, safe_key


def absolute(path: str) -> str:
    """Absolute path, `~` expanded and links followed."""
    if path.startswith("~"):
        path = os.path.join(os.path.expanduser("~"), path[1:].lstrip("/"))
    return os.path.realpath(path)


def home() -> str:
    if own := os.environ.get("SYMGRAPH_HOME"):
        return absolute(own)
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return absolute(os.path.join(base, "symgraph"))


def registry_path() -> str:
    return os.path.join(home(), "registry.json")


def store_of(key: str) -> str:
    return os.path.join(home(), "stores", *key.split("/"))


def git_remote(root: str) -> str | None:
    try:
        found = subprocess.run(["git", "-C", root, "remote", "get-url", "origin"], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.SubprocessError):
        return None
    return (found.stdout.strip() or None) if found.returncode == 0 else None


def project_key(root: str, name: str = "") -> str:
    """From the name, else the remote, else the folder and a hash of its path."""
    if name:
        return safe_key(name)
    if remote := git_remote(root):
        return safe_key(normalize_remote(remote))
    return f"local/{os.path.basename(root.rstrip('/'))}-{hashlib.sha1(absolute(root).encode()).hexdigest()[:12]}"


def go_module(root: str) -> str:
    try:
        with open(os.path.join(root, "go.mod"), encoding="utf-8", errors="replace") as f:
            return next((line.split()[1] for line in map(str.strip, f) if line.startswith("module ")), "")
    except OSError:
        return ""


def path_aliases(root: str) -> list[tuple[str, str]]:
    """(pattern, first target) of the compiler's path settings, in file and pattern order; strict JSON only."""
    out = []
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                paths = json.load(f)["compilerOptions"]["paths"]
            out += [(p, t[0]) for p, t in paths.items() if t]
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            continue
    return out


def dir_size(root: str) -> int:
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, names in os.walk(root) for f in names)
