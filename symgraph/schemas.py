"""Row types of the graph tables, and the constants of its vocabulary."""

from __future__ import annotations

VERSION = "0.1.0"
SCHEMA_VERSION = 3
MAX_FILE_SIZE = 1024 * 1024

NODES = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, "
    "start_line int, end_line int, start_column int, end_column int, docstring string, signature string, "
    "is_exported boolean, is_async boolean, is_static boolean, import_module string, import_symbol string, "
    "updated_at long, node_ordinal long"
)
EDGES = "id long, source string, target string, kind string, resolved boolean, line int, col int, callee_text string"
FILES = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors array<string>"
METADATA = "key string, value string, updated_at long"

#: File extensions and their languages, in the order in which module candidates are tried.
LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".mts": "typescript",
    ".cts": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".go": "go",
}
#: Kinds that can be entry points, and edge kinds that carry impact.
ENTRY_KINDS = ("function", "method", "class", "struct", "interface")
IMPACT_KINDS = ("calls", "references", "imports")
PLACEHOLDER = "name:"
