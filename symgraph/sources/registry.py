"""The registry of projects: a small JSON file on the driver."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..functions.strings import normalize_remote
from . import config


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    def __init__(self, target: str, candidates: list[str]):
        super().__init__(f'target "{target}" is ambiguous; candidates: {", ".join(candidates)}')
        self.target, self.candidates = target, candidates


def load() -> dict:
    """Entries by name; a file that is missing or broken counts as empty."""
    try:
        with open(config.registry_path(), encoding="utf-8") as f:
            data = json.load(f)
        return data if isinstance(data.get("entries"), dict) else {"version": 1, "entries": {}}
    except (OSError, ValueError, AttributeError):
        return {"version": 1, "entries": {}}


def save(data: dict) -> None:
    path = config.registry_path()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2, ensure_ascii=False)
        f.write("\n")
    os.replace(path + ".new", path)


def upsert(name: str, key: str, root: str, remote: str | None) -> None:
    data = load()
    now = datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")
    created = data["entries"].get(name, {}).get("created_at") or now
    data["entries"][name] = {"key": key, "root": root, "remote": remote, "created_at": created, "updated_at": now}
    save(data)


def remove(name: str) -> bool:
    data = load()
    if data["entries"].pop(name, None) is None:
        return False
    save(data)
    return True


def _token(value: str) -> str:
    return normalize_remote(value.strip().removesuffix("/").removesuffix(".git")).replace(os.sep, "/").strip("/")


def suffix_matches(data: dict, target: str) -> list[str]:
    """Names whose name, key, root or remote ends in the target's path."""
    token = _token(target)
    ends = lambda v: v is not None and ("/" + _token(v)).endswith("/" + token)
    return sorted(n for n, e in data["entries"].items() if token and any(map(ends, (n, e["key"], e["root"], e.get("remote")))))


def resolve(target: str, cwd: str) -> tuple[str, dict]:
    """By name, by root, by a suffix that one project has; without a target by the current folder."""
    data = load()
    if target in data["entries"]:
        return target, data["entries"][target]
    root = config.absolute(target or cwd)
    for name in sorted(data["entries"]):
        if config.absolute(data["entries"][name]["root"]) == root:
            return name, data["entries"][name]
    found = suffix_matches(data, target) if target else []
    if len(found) > 1:
        raise Ambiguous(target, found)
    if not found:
        raise NotFound("target not found")
    return found[0], data["entries"][found[0]]


def default_name(key: str, root: str) -> str:
    """The shortest end of the key that is free, or taken by this very project."""
    entries = load()["entries"]
    parts = [p for p in key.replace(os.sep, "/").strip("/").split("/")]
    for i in range(len(parts) - 1, -1, -1):
        name = "/".join(parts[i:])
        old = entries.get(name)
        if name and (old is None or old["key"] == key or (root and config.absolute(old["root"]) == config.absolute(root))):
            return name
    return _token(key) or "unnamed"


def as_table(spark: SparkSession) -> DataFrame:
    rows = [(n, e["key"], e["root"], e.get("remote"), e["created_at"], e["updated_at"]) for n, e in sorted(load()["entries"].items())]
    return spark.createDataFrame(rows, "name string, key string, root string, remote string, created_at string, updated_at string")
