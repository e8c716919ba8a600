"""Symbols and placeholder calls of source files: bytes in, rows out."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..schemas import LANGUAGES, PLACEHOLDER


@dataclass
class Extract:
    """What a file yields, in order: node and edge rows (dicts) and errors."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def node(self, kind: str, name: str, qualified: str, line: int, end: int | None = None, *, id_name: str | None = None, **more) -> str:
        """Adds a node and gives its id."""
        found = f"{self.path}::{id_name or qualified}::{line}"
        row = {
            "id": found, "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "language": self.language,
            "start_line": line, "end_line": line if end is None else end, "start_column": 0, "end_column": 0, "docstring": None, "signature": None,
            "is_exported": False, "is_async": False, "is_static": False, "import_module": None, "import_symbol": None,
        }
        self.nodes.append(row | more)
        return found

    def contains(self, parent: str, child: str) -> None:
        self.edges.append({"source": parent, "target": child, "kind": "contains", "line": None, "col": None, "callee_text": None})

    def call(self, source: str, simple: str, text: str, line: int, col: int) -> None:
        self.edges.append({"source": source, "target": PLACEHOLDER + simple, "kind": "calls", "line": line, "col": col, "callee_text": text})


def detect_language(path: str) -> str:
    """By extension, case ignored; empty if unknown."""
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name[name.rfind(".") :].lower(), "") if "." in name else ""


def text_of(raw: bytes) -> str:
    """Bytes as characters one for one, so that offsets, columns and windows count bytes."""
    return raw.decode("latin-1")


def real(text: str) -> str:
    """A piece of such a text as what it says."""
    return text if text.isascii() else text.encode("latin-1").decode("utf-8", "replace")


#: Extractors by language; more can be registered.
EXTRACTORS: dict = {}


def extract_file(path: str, raw: bytes) -> Extract:
    from . import golang, jsts, python  # noqa: F401  they register themselves

    language = detect_language(path)
    out = Extract(path, language)
    if language in EXTRACTORS:
        EXTRACTORS[language](out, raw)
    return out


#: Words before a parenthesis that are no calls.
NOT_CALLS = frozenset(("if", "for", "while", "return", "await", "switch", "func"))
