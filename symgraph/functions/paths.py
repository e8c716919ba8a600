"""Paths, names and module candidates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LANGUAGES


def path_dir(path: Column) -> Column:
    """Directory part; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def package_path(path: Column) -> Column:
    """Directory part; `.` at the root."""
    return F.coalesce(F.nullif(path_dir(path), F.lit("")), F.lit("."))


def clean_posix(path: Column) -> Column:
    """Drops empty and `.` parts and lets `..` take the part before it, if there is one."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def module_base(module: Column) -> Column:
    return F.substring_index(F.regexp_replace(module, "^/+|/+$", ""), "/", -1)


def stable_id(path: Column, qualified_name: Column, line: Column) -> Column:
    return F.concat_ws("::", path, qualified_name, line.cast("string"))


def qualifier(callee_text: Column) -> Column:
    """What stands before the last dot of a callee; empty if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(callee_text, r"(?s)^(.*)\.[^.]*$", 1), F.lit("")), F.lit(""))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def has_source_ext(path: Column) -> Column:
    return language_of(path).isNotNull()


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression: `*` and `?` stop at `/`, sets may be negated by `^`."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{inner}]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i]
        else:
            out += "\\" + c if c in ".^$+{}()|]" else c
        i += 1
    return f"^(?:{out})$"


def glob_prefix(pattern: str) -> str:
    """The literal text that every match of a shell pattern begins with."""
    out, i = "", 0
    while i < len(pattern) and pattern[i] not in "*?[":
        if pattern[i] == "\\":
            i += 1
        out += pattern[i : i + 1]
        i += 1
    return out


def glob_filter(path: Column, globs: list[str]) -> Column:
    """Whether a path matches any of the patterns: a range of paths for each, which reaches the scan of a table that is sorted by path, and
    the regular expression for what is left."""
    hit = F.lit(False)
    for glob in globs:
        start, match = glob_prefix(glob), path.rlike(glob_regex(glob))
        hit = hit | ((path >= start) & (path < start + "\U0010ffff") & match if start else match)
    return hit


def alias_bases(module: Column, aliases: list[tuple[str, str]]) -> Column:
    """Module paths by (pattern, target) aliases, each with at most one `*`."""
    out = []
    for pattern, target in aliases:
        before, star, after = pattern.partition("*")
        if not star:
            out.append(F.when(module == pattern, F.lit(target.replace("*", ""))))
            continue
        middle = F.substring(module, F.lit(len(before) + 1), F.char_length(module) - len(before) - len(after))
        pieces = target.split("*")
        made = F.concat(*[x for i, p in enumerate(pieces) for x in ([middle] if i else []) + [F.lit(p)]])
        out.append(F.when(module.startswith(before) & module.endswith(after), made))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def module_candidates(module: Column, source_file: Column, go_module: str = "", aliases: list[tuple[str, str]] = ()) -> Column:
    """Files (or `dir/*.go`) that a module may stand for, in order, each once."""
    here = path_dir(source_file)
    relative = F.array(clean_posix(F.concat(here, F.lit("/"), module)))
    dotted = F.regexp_replace(module, r"^\.+", "")
    package = F.when(dotted == "", F.array().cast("array<string>")).otherwise(F.array(clean_posix(F.concat(here, F.lit("/"), F.translate(dotted, ".", "/")))))
    own = F.array().cast("array<string>")
    if go_module:
        own = F.when(module.startswith(go_module + "/"), F.array(F.substring(module, F.lit(len(go_module) + 2), F.char_length(module)))).otherwise(own)
    absolute = F.concat(alias_bases(module, list(aliases)), own, F.array(F.translate(module, ".", "/")))
    bases = F.when(module.startswith("./") | module.startswith("../"), relative).when(module.startswith("."), package).otherwise(absolute)
    endings = [*LANGUAGES, "/*.go", "/__init__.py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    spread = F.transform(bases, lambda b: F.when(has_source_ext(b), F.array(b)).otherwise(F.array(*[F.concat(b, F.lit(x)) for x in endings])))
    return F.array_distinct(F.flatten(spread))
