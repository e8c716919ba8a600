"""Markdown of overviews and contexts."""

from __future__ import annotations


def _document(title: str, sections: list[tuple[str, list[str]]]) -> str:
    parts = [title]
    for head, lines in sections:
        if lines:
            parts.append("\n".join([f"## {head}", *lines] if head else lines))
    return "\n\n".join(parts).rstrip("\n") + "\n"


def _node(n: dict) -> str:
    return f"- `{n['qualified_name']}` ({n['kind']}) {n['file_path']}:{n['start_line']}"


def overview(p: dict) -> str:
    s = p["summary"]
    return _document(
        "# Symgraph Overview",
        [
            ("Summary", [f"- files={s['files']} nodes={s['nodes']} edges={s['edges']} resolved_edges={s['resolved_edges']}"]),
            ("Packages", [f"- `{x['path']}`: files={x['files']} nodes={x['nodes']}" for x in p["packages"]]),
            ("Core Symbols", [f"- `{x['qualified_name']}` ({x['kind']}) degree={x['degree']} {x['file_path']}:{x['start_line']}" for x in p["core_symbols"]]),
            ("Package Dependencies", [f"- `{x['source']}` -> `{x['target']}` ({x['kind']}, {x['count']})" for x in p["package_dependencies"]]),
        ],
    )


def context(p: dict) -> str:
    code = [line for b in p["code_blocks"] for line in (f"### `{b['qualified_name']}`", f"{b['file_path']}:{b['start_line']}", f"```{b['language']}", b["code"], "```", "")]
    return _document(
        f"# Code Context: {p['task']}",
        [
            ("Entrypoints", [_node(n) for n in p["entrypoints"]] or ["- No matching symbols found."]),
            ("Related Symbols", [_node(n) for n in p["related"]]),
            ("Relationships", [f"- `{e['source_name']}` -> `{e['target_qname']}` ({e['kind']})" for e in p["relationships"]]),
            ("Code", code),
        ],
    )


def context_summary(p: dict) -> str:
    return _document(
        f"# Code Context Summary: {p['task']}",
        [
            ("Entrypoints", [_node(n) for n in p["entrypoints"]] or ["- No matching symbols found."]),
            ("Related Symbols", [_node(n) for n in p["related"]]),
            ("Relationships", [f"- `{e['source_name']}` -> `{e['target_name']}` ({e['source_file']}:{e['line']})" for e in p["relationships"]]),
            ("", ["_Output truncated; rerun without `--summary` for full context._"] if p["truncated"] else []),
        ],
    )
