"""JavaScript and TypeScript: whole-text patterns, brace matching, a bounded window for calls."""

from __future__ import annotations

import bisect
import re

from . import EXTRACTORS, NOT_CALLS, Extract, real, text_of

_S = r"[ \t\n\f\r]"
_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
_FROM = rf"{_S}+from{_S}+['\"]([^'\"]+)['\"]"
_NAMED = re.compile(rf"import{_S}+\{{([^}}]+)\}}{_FROM}")
_SPACE = re.compile(rf"import{_S}+\*{_S}+as{_S}+({_ID}){_FROM}")
_DEFAULT = re.compile(rf"import{_S}+({_ID}){_FROM}")
_CLASS = re.compile(rf"(?P<export>export{_S}+)?class{_S}+(?P<name>{_ID})")
_FUNCTION = re.compile(rf"(?P<export>export{_S}+)?(?P<async>async{_S}+)?function{_S}+(?P<name>{_ID}){_S}*\(")
_ARROW = re.compile(rf"(?P<export>export{_S}+)?const{_S}+(?P<name>{_ID}){_S}*={_S}*(?P<async>async{_S}+)?\([^)]*\){_S}*=>")
_METHOD = re.compile(rf"(?m)^{_S}*(?P<static>static{_S}+)?(?P<async>async{_S}+)?(?P<name>{_ID}){_S}*\(")
_CALL = re.compile(rf"(?:new{_S}+)?({_ID})(?:\.({_ID}))?{_S}*\(")
#: Bytes of a body that are searched for calls.
WINDOW = 1000


class _Text:
    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def closing(self, opening: int, end: int | None = None) -> int:
        """Place of the brace that closes the one at `opening`, strings and comments not told apart; -1 if none."""
        depth = 0
        for m in re.compile("[{}]").finditer(self.text, opening, len(self.text) if end is None else end):
            depth += 1 if m[0] == "{" else -1
            if depth == 0:
                return m.start()
        return -1

    def end_line(self, start: int, end: int | None = None) -> int:
        opening = self.text.find("{", start, end)
        closing = self.closing(opening, end) if opening >= 0 else -1
        return self.line(start if closing < 0 else closing)


def _calls(out: Extract, text: _Text, source: str, start: int, end: int | None = None) -> None:
    body = text.text[start : len(text.text) if end is None else end]
    stop = body.find("\n}")
    for m in _CALL.finditer(body[: stop if 0 <= stop <= WINDOW else WINDOW]):
        simple = m[2] or m[1]
        if simple not in NOT_CALLS and simple != "function":
            out.call(source, simple, f"{m[1]}.{m[2]}" if m[2] else m[1], text.line(start + m.start()), 0)


def extract(out: Extract, raw: bytes) -> None:
    text = _Text(text_of(raw))
    for m in _NAMED.finditer(text.text):
        module = real(m[2])
        for part in filter(None, map(str.split, real(m[1]).split(","))):
            local = part[2] if len(part) >= 3 and part[1] == "as" else part[0]
            out.node("import", local, f"{module}.{part[0]}", text.line(m.start()), import_module=module, import_symbol=part[0])
    for pattern, symbol in ((_SPACE, "*"), (_DEFAULT, "default")):
        for m in pattern.finditer(text.text):
            if symbol == "*" or not set("{*") & set(m[0]):
                out.node("import", m[1], m[1], text.line(m.start()), import_module=real(m[2]), import_symbol=symbol)
    for m in _CLASS.finditer(text.text):
        _class(out, text, m)
    for pattern in (_FUNCTION, _ARROW):
        for m in pattern.finditer(text.text):
            found = out.node("function", m["name"], m["name"], text.line(m.start()), text.end_line(m.start()), is_exported=bool(m["export"]), is_async=bool(m["async"]))
            _calls(out, text, found, m.end())


def _class(out: Extract, text: _Text, m: re.Match) -> None:
    line, opening = text.line(m.start()), text.text.find("{", m.end())
    closing = text.closing(opening) if opening >= 0 else -1
    whole = closing > opening + 1
    found = out.node("class", m["name"], m["name"], line, text.line(closing) if whole else line, is_exported=bool(m["export"]))
    if not whole:
        return
    body = text.text[opening + 1 : closing]
    for x in _METHOD.finditer(body):
        if x["name"] in ("if", "for", "while", "switch"):
            continue
        at = opening + 1 + x.start()
        method = out.node("method", x["name"], f"{m['name']}.{x['name']}", text.line(at), text.end_line(at, closing), is_exported=True, is_static=bool(x["static"]), is_async=bool(x["async"]))
        out.contains(found, method)
        _calls(out, text, method, opening + 1 + x.end(), closing)


for _language in ("javascript", "typescript", "tsx"):
    EXTRACTORS[_language] = extract
