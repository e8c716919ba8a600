"""Python: a pass over lines with a stack of indented scopes (spaces only)."""

from __future__ import annotations

import re

from . import EXTRACTORS, NOT_CALLS, Extract, real, text_of

_WHITE = " \t\r\n\x0b\x0c\x85\xa0"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_HEAD = re.compile(rf"(?:(?P<kind>class)[ \t\n\r\f\v]+(?P<cls>{_NAME})|(?P<async>async[ \t\n\r\f\v]+)?def[ \t\n\r\f\v]+(?P<def>{_NAME})[ \t\n\r\f\v]*\()")
_IMPORT = re.compile(r"import[ \t\n\r\f\v]+(.+)$")
_FROM = re.compile(r"from[ \t\n\r\f\v]+([A-Za-z0-9_./]+)[ \t\n\r\f\v]+import[ \t\n\r\f\v]+(.+)$")
_CALL = re.compile(rf"{_NAME}(?:\.{_NAME})?[ \t\n\r\f\v]*\(")


class _Lines:
    """Lines with their indentation and stripped text."""

    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.bare = [x.strip(_WHITE) for x in self.raw]
        self.indent = [len(x) - len(x.lstrip(" ")) for x in self.raw]

    def body(self, start: int, indent: int):
        """Numbers of the lines with text that are indented deeper, from start on, up to the first that isn't."""
        for i in range(start, len(self.raw)):
            if self.bare[i]:
                if self.indent[i] <= indent:
                    return
                yield i

    def end(self, head: int) -> int:
        last = head
        for i in self.body(head + 1, self.indent[head]):
            last = i
        return last + 1

    def docstring(self, head: int) -> str | None:
        first = next(self.body(head + 1, self.indent[head]), None)
        if first is not None:
            text = self.bare[first]
            for mark in ('"""', "'''"):
                if text.startswith(mark) and text.endswith(mark):
                    return real(text.strip("\"'"))
        return None


def _parts(listed: str):
    """(name, alias) of a comma list; empty parts, as a trailing comma leaves, are skipped."""
    for part in listed.split(","):
        words = part.split()
        if words:
            yield words[0], words[2] if len(words) >= 3 and words[1] == "as" else words[0]


def extract(out: Extract, raw: bytes) -> None:
    lines = _Lines(text_of(raw))
    scopes: list[tuple[int, str, str, str]] = []  # indentation, kind, qualified name, id
    static: set[int] = set()
    for i, bare in enumerate(lines.bare):
        if not bare:
            continue
        indent, line = lines.indent[i], i + 1
        while scopes and indent <= scopes[-1][0]:
            scopes.pop()
        if bare.startswith("@staticmethod"):
            static.add(indent)
        elif m := _IMPORT.match(bare):
            for module, local in _parts(real(m[1])):
                name = local.replace(".", "/").strip("/").rsplit("/", 1)[-1]
                out.node("import", name, module, line, id_name=local, import_module=module)
        elif m := _FROM.match(bare):
            for symbol, local in _parts(real(m[2])):
                out.node("import", local, f"{m[1]}.{symbol}", line, import_module=m[1], import_symbol=symbol)
        elif m := _HEAD.match(bare):
            name = m["cls"] or m["def"]
            owner = next((s[2] for s in reversed(scopes) if s[1] == "class"), None)
            qualified = f"{owner}.{name}" if owner else name
            more = {"docstring": lines.docstring(i), "is_exported": not name.startswith("_")}
            around = next((s for s in reversed(scopes) if s[1] != "class"), None) if m["cls"] else (scopes[-1] if scopes else None)
            if m["cls"]:
                kind = "class"
            else:
                kind = "method" if scopes and scopes[-1][1] == "class" else "function"
                head = bare.removeprefix("async ").strip(_WHITE).removesuffix(":")
                more |= {"signature": real(head), "is_async": bool(m["async"]), "is_static": indent in static}
                static.discard(indent)
            found = out.node(kind, name, qualified, line, lines.end(i), **more)
            if around:
                out.contains(around[3], found)
            scopes.append((indent, kind, qualified, found))
        else:
            holder = next((s for s in reversed(scopes) if s[1] != "class"), None)
            for m in _CALL.finditer(bare) if holder else ():
                text = m[0][:-1]
                simple = text.rsplit(".", 1)[-1]
                if simple not in NOT_CALLS:
                    out.call(holder[3], simple, text, line, lines.raw[i].find(m[0]))


EXTRACTORS["python"] = extract
