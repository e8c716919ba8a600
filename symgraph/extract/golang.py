"""Go: a tokenizer and a recogniser of declarations and calls.

Strings, runes and comments are skipped as such; semicolons are put in at line ends as the language does.  On
text that can't be read on, what was found stays and a `parse failed:` error is added.
"""

from __future__ import annotations

import re

from . import EXTRACTORS, Extract, real, text_of

#: White space before a token is part of its match; names, of which there are most, are tried first.
_TOKEN = re.compile(
    r"[ \t\r]*(?:(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)"
    r"|(?P<rune>'(?:\\.[^']*|[^'\\\n]+)')|(?P<number>\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*)"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])|(?P<space>[ \t\r]))",
    re.S,
)
_KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_BRACKETS = _OPEN | _CLOSE


class _Broken(Exception):
    pass


class _Token:
    __slots__ = ("kind", "text", "at", "end", "line", "mate")

    def __init__(self, kind: str, text: str, at: int, end: int, line: int):
        self.kind, self.text, self.at, self.end, self.line, self.mate = kind, text, at, end, line, -1


def _tokens(text: str) -> tuple[list[_Token], str | None]:
    """Tokens with semicolons put in and brackets paired; the error that ended them, if any."""
    out: list[_Token] = []
    brackets: list[int] = []
    at, line, error = 0, 1, None

    def ends() -> bool:
        return bool(out) and (out[-1].kind in ("string", "rune", "number") or (out[-1].kind == "name" and out[-1].text not in _KEYWORDS) or out[-1].text in _ENDS)

    for m in _TOKEN.finditer(text):
        if m.start() != at:
            break
        at, kind = m.end(), m.lastgroup
        if kind == "name" or kind == "op" or kind == "number":
            start, word = m.start(kind), m[kind]
            if kind == "op" and word in _BRACKETS:
                brackets.append(len(out))
            out.append(_Token(kind, word, start, at, line))
        elif kind == "newline":
            if ends():
                out.append(_Token("op", ";", at - 1, at - 1, line))
            line += 1
        elif kind not in ("space", "line"):
            start, word = m.start(kind), m[kind]
            breaks = word.count("\n")
            if kind != "block":
                out.append(_Token(kind, word, start, at, line))
            elif breaks and ends():
                out.append(_Token("op", ";", start, start, line))
            line += breaks
    if at < len(text):
        error = f"unexpected character at line {line}"
    if ends():
        out.append(_Token("op", ";", at, at, line))
    stack: list[int] = []
    for i in brackets:
        t = out[i]
        if t.text in _OPEN:
            stack.append(i)
        else:
            if not stack or out[stack[-1]].text + t.text not in ("()", "[]", "{}"):
                error = error or f"unpaired {t.text} at line {t.line}"
                continue
            t.mate = stack.pop()
            out[t.mate].mate = i
    if stack:
        error = error or f"unpaired {out[stack[-1]].text} at line {out[stack[-1]].line}"
    return out, error


def _exported(name: str) -> bool:
    return real(name)[:1].isupper()


class _File:
    def __init__(self, out: Extract, raw: bytes):
        self.out, self.text = out, text_of(raw)
        self.toks, self.error = _tokens(self.text)
        self.toks.append(_Token("end", "", len(self.text), len(self.text), self.text.count("\n") + 1))

    def past(self, i: int) -> int:
        """The token after i, or after the bracket pair that i opens."""
        t = self.toks[i]
        if t.kind == "op" and t.text in _OPEN:
            if t.mate < 0:
                raise _Broken(f"unpaired {t.text} at line {t.line}")
            return t.mate + 1
        return i + 1

    def statement_end(self, i: int, stop: int) -> int:
        """The semicolon (or stop) that ends what begins at i."""
        while i < stop and self.toks[i].kind != "end" and not (self.toks[i].text == ";" and self.toks[i].kind == "op"):
            i = self.past(i)
        return min(i, stop)

    def run(self) -> None:
        i, last = 0, len(self.toks) - 1
        later = []
        if not (self.toks[0].text == "package" and self.toks[1].kind == "name"):
            self.error = self.error or "no package clause"
        try:
            while i < last:
                t = self.toks[i]
                if t.kind == "name" and t.text == "import":
                    i = self.specs(i, self.import_spec)
                elif t.kind == "name" and t.text in ("type", "var", "const", "func"):
                    later.append(i)
                    i = self.skip(i, last)
                else:
                    i = self.past(i) if t.text != ";" else i + 1
        except _Broken as e:
            self.error = self.error or str(e)
        for i in later:
            try:
                self.func(i) if self.toks[i].text == "func" else self.decl(i)
            except _Broken as e:
                self.error = self.error or str(e)
        if self.error:
            self.out.errors.append(f"parse failed: {self.out.path}: {self.error}")

    def skip(self, i: int, last: int) -> int:
        try:
            return self.statement_end(i, last)
        except _Broken:
            # Go on at the next declaration that starts a line.
            for k in range(i + 1, last):
                t = self.toks[k]
                if t.text in ("func", "type", "var", "const") and self.text[t.at - 1 : t.at] == "\n":
                    self.error = self.error or f"unpaired bracket after line {self.toks[i].line}"
                    return k
            raise

    def specs(self, i: int, fn) -> int:
        """Calls fn(first, end) for each spec of a declaration at i; gives where it ends."""
        keyword = i
        i += 1
        if self.toks[i].text != "(":
            end = self.statement_end(i, len(self.toks) - 1)
            fn(i, end, keyword)
            return end
        close = self.toks[i].mate
        if close < 0:
            raise _Broken(f"unpaired ( at line {self.toks[i].line}")
        k = i + 1
        while k < close:
            end = self.statement_end(k, close)
            if end > k:
                fn(k, end, keyword)
            k = end + 1
        return close + 1

    def import_spec(self, i: int, end: int, _: int) -> None:
        alias = self.toks[i].text if self.toks[i].kind == "name" or self.toks[i].text == "." else None
        path = self.toks[i + 1] if alias else self.toks[i]
        if path.kind != "string":
            raise _Broken(f"import without a path at line {path.line}")
        module = real(path.text.strip('"`'))
        base = module.strip("/").rsplit("/", 1)[-1]
        name = real(alias) if alias and alias not in (".", "_") else base
        self.out.node("import", name, name if alias else module, self.toks[i].line, import_module=module)

    def decl(self, i: int) -> int:
        return self.specs(i, self.type_spec if self.toks[i].text == "type" else self.value_spec)

    def type_spec(self, i: int, end: int, _: int) -> None:
        name, k = self.toks[i], i + 1
        if name.kind != "name":
            raise _Broken(f"type without a name at line {name.line}")
        if self.toks[k].text == "[" and self.type_parameters(k):
            k = self.past(k)
        if self.toks[k].text == "=":
            k += 1
        kind = {"struct": "struct", "interface": "interface"}.get(self.toks[k].text, "type_alias")
        text = real(name.text)
        self.out.node(kind, text, text, name.line, self.toks[end - 1].line, is_exported=_exported(name.text))

    def type_parameters(self, k: int) -> bool:
        """Whether the bracket at k holds `Name constraint`, not an array's length."""
        a, b = self.toks[k + 1], self.toks[k + 2]
        return a.kind == "name" and (b.kind == "name" or b.text in (",", "*", "~", "[", "interface")) and self.toks[k].mate > k + 2

    def value_spec(self, i: int, end: int, keyword: int) -> None:
        kind = "constant" if self.toks[keyword].text == "const" else "variable"
        while i < end and self.toks[i].kind == "name":
            t = self.toks[i]
            self.out.node(kind, real(t.text), real(t.text), t.line, is_exported=_exported(t.text))
            if self.toks[i + 1].text != ",":
                break
            i += 2

    def func(self, i: int) -> None:
        start, k = self.toks[i], i + 1
        kind, owner = "function", ""
        if self.toks[k].text == "(":
            kind, close = "method", self.toks[k].mate
            if close < 0:
                raise _Broken(f"unpaired ( at line {self.toks[k].line}")
            owner = self.receiver(k + 1, close)
            if close == k + 1:
                kind = "function"
            k = close + 1
        name = self.toks[k]
        if name.kind != "name":
            raise _Broken(f"func without a name at line {name.line}")
        k += 1
        while self.toks[k].text in ("[", "("):
            k = self.past(k)
            if self.toks[k - 1].text == ")":
                break
        body = -1
        while not (self.toks[k].text == ";" or self.toks[k].kind == "end"):
            if self.toks[k].text == "{" and self.toks[k - 1].text not in ("struct", "interface"):
                body = k
                break
            k = self.past(k)
        close = self.toks[body].mate if body >= 0 else k - 1
        last = self.toks[close] if close >= 0 else self.toks[-1]
        text = real(name.text)
        qualified = f"{owner}.{text}" if owner else text
        head = self.text[start.at :]
        head = head[: head.index("{")] if "{" in head else head.split("\n", 1)[0]
        found = self.out.node(kind, text, qualified, start.line, last.line, signature=real(head).strip(), is_exported=_exported(name.text))
        if body >= 0:
            self.body(body, close if close >= 0 else len(self.toks) - 1, found)

    def receiver(self, i: int, close: int) -> str:
        """Type name of `(name *Type[T])` or `(Type)`."""
        names = []
        while i < close:
            t = self.toks[i]
            if t.text == "[":
                i = self.past(i)
                continue
            if t.kind == "name":
                names.append(t.text)
            i += 1
        return real(names[-1]) if names else ""

    def body(self, i: int, close: int, source: str) -> None:
        """Declarations and calls in order of their places; a call of a call comes before the inner one."""
        found: list[tuple[int, int, object]] = []
        for k in range(i + 1, close):
            t = self.toks[k]
            if t.kind == "name" and t.text in ("type", "var", "const") and self.toks[k - 1].text in (";", "{", ":", "}"):
                found.append((t.at, 0, k))
            elif t.text == "(" and t.kind == "op":
                at, simple, text = self.callee(k, i)
                if simple:
                    found.append((at, -t.at, (t, simple, text)))
        for _, _, what in sorted(found, key=lambda x: x[:2]):
            if isinstance(what, int):
                self.decl(what)
            else:
                t, simple, text = what
                column = t.at - (self.text.rfind("\n", 0, t.at) + 1)
                self.out.call(source, real(simple), real(text), t.line, column)

    def callee(self, k: int, floor: int) -> tuple[int, str, str]:
        """(start, last name, whole text) of what the parenthesis at k calls; no name if it can't be told."""
        end = k - 1
        while self.toks[end].text == "]" and self.toks[end].mate > floor:  # instantiation or index
            end = self.toks[end].mate - 1
        if self.toks[end].kind != "name" or self.toks[end].text in _KEYWORDS:
            return 0, "", ""
        before = self.toks[end - 1].text
        if before == "func":
            return 0, "", ""
        simple, names, at = self.toks[end].text, [self.toks[end].text], end
        while self.toks[at - 1].text == ".":
            left = at - 2
            while self.toks[left].text == "]" and self.toks[left].mate > floor:
                left = self.toks[left].mate - 1
            if self.toks[left].kind == "name" and self.toks[left].text not in _KEYWORDS:
                names.append(self.toks[left].text)
                at = left
                continue
            names.append("")  # a call, literal or the like stands to the left
            while left > floor and self.toks[left].mate >= 0 and self.toks[left].text in _CLOSE:
                left = self.toks[left].mate - 1
                if self.toks[left].kind == "name" and self.toks[left - 1].text == ".":
                    left -= 2
            at = left if self.toks[left].kind == "name" else left + 1
            while self.toks[at].kind == "name" and self.toks[at - 1].text == "." and self.toks[at - 2].kind == "name":
                at -= 2
            break
        return self.toks[max(at, floor)].at, simple, ".".join(reversed(names))


def extract(out: Extract, raw: bytes) -> None:
    _File(out, raw).run()


EXTRACTORS["go"] = extract
