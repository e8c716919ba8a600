"""The command line: `python -m symgraph.cli [--target T] [--json] [--verbose] COMMAND ...`."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import SparkSession

from . import index, render
from .functions.strings import human_size, similar
from .operators import context, find, impact, overview, search, status
from .schemas import SCHEMA_VERSION, VERSION
from .sources import config, registry, tree
from .sources.snapshot import Store

PROG = "symgraph"


class Failure(Exception):
    """What a user is told without a trace."""


class Flags:
    """A command's flags; they may follow positionals, and `--` ends them."""

    def __init__(self, command: str, **flags):
        self.command = command
        self.kinds = {k.replace("_", "-"): v for k, v in flags.items()}

    def usage(self) -> str:
        return f"Usage: {PROG} {self.command} [OPTIONS]\n" + "".join(f"  --{k} (default {v!r})\n" for k, v in sorted(self.kinds.items()))

    def parse(self, args: list[str]) -> tuple[argparse.Namespace, list[str]]:
        values = {k: list(v) if isinstance(v, list) else v for k, v in self.kinds.items()}
        rest, i = [], 0
        while i < len(args):
            arg = args[i]
            i += 1
            if arg == "--":
                rest += args[i:]
                break
            if not arg.startswith("-") or arg == "-":
                rest.append(arg)
                continue
            name, given, value = arg.lstrip("-").partition("=")
            if name not in self.kinds:
                raise Failure(self.unknown(arg, name))
            kind = self.kinds[name]
            if isinstance(kind, bool):
                values[name] = value.lower() not in ("false", "0", "f") if given else True
                continue
            if not given:
                if i >= len(args):
                    raise Failure(f"{arg} requires value")
                value, i = args[i], i + 1
            if isinstance(kind, list):
                values[name].append(value)
            else:
                try:
                    values[name] = type(kind)(value)
                except ValueError:
                    raise Failure(f"invalid value {value!r} for {arg}") from None
        return argparse.Namespace(**{k.replace("-", "_"): v for k, v in values.items()}), rest

    def unknown(self, arg: str, name: str) -> str:
        lines = [f'unknown flag {arg} for command "{self.command}"']
        if name == "target":
            lines.append(f"hint: --target is global; place it before the command, e.g. `{PROG} --target NAME_OR_PATH {self.command} ...`.")
            if "path" in self.kinds:
                lines.append("hint: when you have a project path, this command also accepts `--path /path/to/project`.")
        elif name == "path":
            lines.append("hint: this command does not accept --path; use global `--target /path/to/project` before the command.")
        else:
            if near := similar(name, list(self.kinds)):
                lines.append(f"hint: did you mean `--{near}`?")
            lines.append(f"hint: run `{PROG} {self.command} --help` for supported options.")
        return "\n".join(lines)


class App:
    def __init__(self, target: str = "", as_json: bool = False, verbose: bool = False, cwd: str | None = None, spark: SparkSession | None = None):
        self.target, self.json, self.verbose, self.cwd, self._spark = target, as_json, verbose, cwd or os.getcwd(), spark

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.appName(PROG).config("spark.ui.showConsoleProgress", "false").getOrCreate()
        return self._spark

    # Output

    def emit(self, payload, text: str = "") -> None:
        print(text if text and not self.json else json.dumps(payload, indent=2, ensure_ascii=False, sort_keys=True))

    def hint(self, stale: dict) -> str:
        if not stale["is_stale"]:
            return ""
        title = "The project has not been indexed." if stale["reason"] == "never_indexed" else "The index may be out of date: a source file changed after the last run."
        return f"\n\n{title}\nRun first: {stale['command']}\nThen run this command again."

    # Projects

    def project(self, path: str = "") -> tuple[str, str, Store]:
        """(root, name, store) of the target."""
        target = config.absolute(path) if path else self.target
        try:
            name, entry = registry.resolve(target, self.cwd)
        except LookupError as e:
            raise Failure(f"target not in the registry: {target or self.cwd}\nreason: {e}\nhint: run `{PROG} init`, or name a project with `{PROG} --target NAME ...`.") from None
        return config.absolute(entry["root"]), name, Store(config.store_of(entry["key"]))

    def staleness(self, root: str, store: Store) -> dict:
        out = {
            "is_stale": False, "reason": None, "last_indexed": None, "latest_source_mtime": None, "latest_source_file": None,
            "command": f"{PROG} index --path {root} --quiet", "retry": "rerun current command after indexing",
        }
        last = store.get("last_indexed")
        if not last:
            return out | {"is_stale": True, "reason": "never_indexed"}
        out["last_indexed"] = last
        if not last.lstrip("-").isdigit():
            return out | {"is_stale": True, "reason": "invalid_last_indexed"}
        try:
            found = status.staleness(tree.scan(self.spark, root), int(last)).first()
        except Exception as e:  # whatever keeps the tree from being listed is the answer
            return out | {"is_stale": True, "reason": f"staleness_check_failed: {e}"}
        return out | {k: found[k] for k in ("latest_source_mtime", "latest_source_file", "is_stale", "reason")}

    # Commands on projects

    def init(self, args):
        o, rest = Flags("init", path="", name="", key="", index=False, i=False).parse(args)
        if rest and o.path and config.absolute(rest[0]) != config.absolute(o.path):
            raise Failure("PATH and --path differ")
        root = config.absolute(o.path or (rest[0] if rest else self.cwd))
        if not os.path.isdir(root):
            raise Failure(f"no such folder: {root}")
        key = o.key or config.project_key(root, o.name)
        store = Store(config.store_of(key))
        store.put(project_root=root)
        name, remote = o.name or registry.default_name(key, root), config.git_remote(root)
        registry.upsert(name, key, root, remote)
        stats = index.index_all(self.spark, root, store.path) if o.index or o.i else None
        payload = {
            "status": "initialized", "name": name, "key": key, "root": root, "store": store.path, "remote": remote, "db": store.file("metadata.json"),
            "next": [f"{PROG} index", f"{PROG} status"], "indexed": stats is not None, "index": stats,
        }
        text = f"registered {name}\n  root  : {root}\n  store : {store.path}\n  key   : {key}\n  remote: {remote or '(no git remote)'}\n\n"
        self.emit(payload, text + (self._counts(stats) if stats else f"next: {PROG} index"))

    def _counts(self, s: dict) -> str:
        return f"scanned: {s['files_scanned']}  indexed: {s['files_indexed']}  skipped: {s['files_skipped']}  deleted: {s['files_deleted']}  failed: {s['files_failed']}\nnodes: {s['nodes']}  edges: {s['edges']}"

    def _index(self, path: str, force: bool, verb: str, lookups: bool = False):
        root, name, store = self.project(path)
        s = index.index_all(self.spark, root, store.path, force, lookups)
        payload = {"project": name, "root": root, "store": store.path} | s | {"errors": s["errors"][:20]}
        text = f"{verb} {name}\n{self._counts(s)}" + (f"\nerrors({s['errors_total']}): {s['errors'][0]}..." if s["errors"] else "")
        self.emit(payload, text)

    def index(self, args):
        o, _ = Flags("index", path="", force=False, quiet=False, lookups=False).parse(args)
        self._index(o.path, o.force, "indexed", o.lookups)

    def sync(self, args):
        o, _ = Flags("sync", path="").parse(args)
        self._index(o.path, False, "synced")

    def resolve(self, args):
        o, _ = Flags("resolve", path="").parse(args)
        _, name, store = self.project(o.path)
        s = index.resolve_all(self.spark, store.path)
        self.emit({"project": name} | s, f"resolved: now={s['edges_resolved_now']} unresolved={s['edges_still_unresolved']}")

    def unlock(self, args):
        self.emit({"status": "ok", "message": "no lock backend configured"}, "unlock: nothing to do")

    def list(self, args):
        entries = registry.load()["entries"]
        rows = [{"name": n, "key": e["key"], "root": e["root"], "remote": e.get("remote"), "size_bytes": config.dir_size(config.store_of(e["key"]))} for n, e in sorted(entries.items())]
        lines = [f"home: {config.home()}", ""] + [f"{r['name']:<24} {human_size(r['size_bytes']):>8}  {r['root']}" for r in rows]
        self.emit({"home": config.home(), "entries": rows}, "\n".join(lines) if rows else f"no projects yet; run `{PROG} init`.")

    def info(self, args):
        o, _ = Flags("info", path="").parse(args)
        root, name, store = self.project(o.path)
        entry = registry.load()["entries"][name]
        payload = {"name": name, "key": entry["key"], "root": root, "store": store.path, "remote": entry.get("remote")}
        self.emit(payload, "\n".join(f"{k:<6}: {v if v is not None else '(no git remote)'}" for k, v in payload.items()))

    def confirm(self, question: str) -> None:
        print(f"{question} [y/N]: ", end="", file=sys.stderr, flush=True)
        if sys.stdin.readline().strip().lower() not in ("y", "yes"):
            raise Failure("operation aborted")

    def uninit(self, args):
        o, _ = Flags("uninit", path="", y=False).parse(args)
        root, name, store = self.project(o.path)
        if not o.y:
            self.confirm(f"delete {store.path} (index of {name})?")
        shutil.rmtree(store.path, ignore_errors=True)
        self.emit({"status": "uninitialized", "name": name, "store": store.path, "root": root}, f"deleted {store.path}")

    def rm(self, args):
        o, rest = Flags("rm", purge=False, y=False).parse(args)
        if not rest:
            raise Failure("missing project name")
        entry = registry.load()["entries"].get(rest[0])
        if entry is None:
            raise Failure(f"no such project: {rest[0]}")
        if not o.y:
            self.confirm(f"remove {rest[0]} from the registry{' and delete its index' if o.purge else ''}?")
        store = config.store_of(entry["key"]) if o.purge else None
        if store:
            shutil.rmtree(store, ignore_errors=True)
        registry.remove(rest[0])
        self.emit({"status": "removed", "name": rest[0], "purged_store": store}, f"removed {rest[0]}" + (f" and deleted {store}" if store else ""))

    # Queries

    def status(self, args):
        o, _ = Flags("status", path="").parse(args)
        root, name, store = self.project(o.path)
        if not store.initialized():
            return self.emit({"initialized": False, "store": store.path, "project": name, "root": root}, f"(not indexed) {store.path}\nrun `{PROG} index` first.")
        g = store.graph(self.spark)
        by = lambda df, c: {r[0]: r[1] for r in status.group_counts(df, c).collect()}
        counts = status.counts(g).first().asDict()
        payload = {"initialized": True, "store": store.path, "schema_version": SCHEMA_VERSION, "last_indexed": store.get("last_indexed") or None}
        payload |= {k: counts[k] for k in ("files", "nodes", "edges")} | {"nodes_by_kind": by(g.nodes, "kind"), "files_by_language": by(g.files, "language"), "project": name, "root": root}
        self.emit(payload, "\n".join(f"{k}: {payload[k]}" for k in ("project", "root", "store", "schema_version", "files", "nodes", "edges")))

    def _answer(self, payload: dict, root: str, store: Store, text) -> None:
        payload["stale"] = stale = self.staleness(root, store)
        self.emit(payload, "" if self.json else text() + self.hint(stale))

    def query(self, args):
        o, rest = Flags("query", path="", limit=20, kind="").parse(args)
        if not rest:
            raise Failure("missing search term")
        root, name, store = self.project(o.path)
        rows = [_public(r.asDict()) for r in search.search(store.graph(self.spark), rest[0], o.kind, o.limit)]
        line = lambda r: f"  {r['kind']:<8} {r['qualified_name']:<40} {r['file_path']}:{r['start_line']}" + (f"  {r['signature'].encode()[:60].decode(errors='ignore')}" if r.get("signature") else "")
        payload = {"project": name, "query": rest[0], "kind": o.kind or None, "count": len(rows), "results": rows}
        self._answer(payload, root, store, lambda: "\n".join([f"{len(rows)} results:", *map(line, rows)]) if rows else f"(no results) query={rest[0]!r}")

    def files(self, args):
        o, _ = Flags("files", path="", glob=[]).parse(args)
        root, name, store = self.project(o.path)
        df = status.matching_files(store.graph(self.spark).files, o.glob)
        rows = [r.asDict() for r in df.select("path", "language", "size", "node_count", "indexed_at").orderBy("path").collect()]
        self._answer({"project": name, "count": len(rows), "files": rows}, root, store, lambda: "\n".join(f"{r['language']:<10} {r['node_count']:>6} nodes  {r['path']}" for r in rows) or "(no files)")

    def overview(self, args):
        o, _ = Flags("overview", path="", packages=20, symbols=12, dependencies=20).parse(args)
        root, name, store = self.project(o.path)
        payload = overview_payload(self.spark, store, o.packages, o.symbols, o.dependencies) | {"project": name, "root": root}
        self._answer(payload, root, store, lambda: render.overview(payload))

    architecture = overview

    def _calls(self, args, command: str):
        o, rest = Flags(command, path="", limit=20).parse(args)
        if not rest:
            raise Failure("missing symbol")
        root, name, store = self.project(o.path)
        g = store.graph(self.spark)
        rows, truncated = find.limited(getattr(find, command)(g, rest[0]), o.limit, "target_id" if command == "callers" else "source_id", "edge_id")
        out = [{k: v for k, v in r.asDict().items() if k != "edge_id"} for r in rows]
        payload = {"project": name, "symbol": rest[0], "matched": find.find_node(g, rest[0]).count(), command: out, "truncated": truncated}
        self._answer(payload, root, store, lambda: "\n".join([f"{len(out)} {command}:", *map(str, out)]) if out else f"(no {command}) {rest[0]}")

    def callers(self, args):
        self._calls(args, "callers")

    def callees(self, args):
        self._calls(args, "callees")

    def impact(self, args):
        o, rest = Flags("impact", path="", depth=2, limit=100).parse(args)
        if not rest:
            raise Failure("missing symbol")
        root, name, store = self.project(o.path)
        payload = impact_payload(self.spark, store, rest[0], o.depth, o.limit) | {"project": name}
        self._answer(payload, root, store, lambda: f"{len(payload['nodes'])} nodes" if payload["nodes"] else f"(no match) symbol={rest[0]!r}")

    def affected(self, args):
        o, files = Flags("affected", path="", depth=5, filter="", test_filter="", stdin=False, quiet=False).parse(args)
        if o.stdin:
            files += [x.strip() for x in sys.stdin if x.strip()]
        root, name, store = self.project(o.path)
        g = store.graph(self.spark)
        roots, reached = impact.affected(g, self.spark.createDataFrame([(f,) for f in files], "path string"), o.depth, o.test_filter or o.filter)
        rows = reached.orderBy("path").collect()
        tests = [r["path"] for r in rows if r["is_test"]]
        payload = {
            "changed_files": files, "root_symbols": [r.asDict() for r in roots.select(*find.NODE).orderBy("file_path", "start_line", "id").collect()],
            "impacted_files": [r["path"] for r in rows], "affected_tests": tests, "project": name,
        }
        if o.quiet and not self.json:
            return print("\n".join(tests))
        self._answer(payload, root, store, lambda: "\n".join([f"{len(tests)} affected test files:", *("  " + t for t in tests)]) if tests else "(no affected test files)")

    def context(self, args):
        o, rest = Flags("context", path="", max_nodes=20, max_code=8, max_json_bytes=60000, no_code=False, summary=False, allow_large=False, limit=0).parse(args)
        if not rest:
            raise Failure("missing task")
        task = " ".join(rest)
        root, name, store = self.project(o.path)
        payload = context.build(self.spark, store.graph(self.spark), root, task, o.limit if o.limit > 0 else o.max_nodes, o.max_code, not (o.no_code or o.summary))
        payload["entrypoints"] = list(map(_public, payload["entrypoints"]))
        if o.summary:
            payload = context.compact(payload)
        payload["project"] = name
        payload["stale"] = stale = self.staleness(root, store)
        if self.json:
            return self.emit(payload if o.summary else guarded(payload, task, root, o.max_json_bytes, o.allow_large))
        print((render.context_summary if o.summary else render.context)(payload) + self.hint(stale), end="")


def _public(row: dict) -> dict:
    """A search hit as it is shown: flags as numbers, nulls left out."""
    keep = [*find.NODE, "is_exported", "out_degree", "in_degree", "degree", "signature", "docstring", "score", "rank"]
    return {k: int(row[k]) if k == "is_exported" else row[k] for k in keep if row.get(k) is not None}


def overview_payload(spark: SparkSession, store: Store, packages: int = 20, symbols: int = 12, dependencies: int = 20) -> dict:
    g = store.graph(spark)
    pick = lambda n, d: n if n > 0 else d
    rows = lambda df: [r.asDict() for r in df.collect()]
    top = [r | {"languages": r["languages"] or {}, "symbols": r["symbols"]} for r in rows(overview.top_packages(g, pick(packages, 20)))]
    core = [{k: v for k, v in r.items() if k != "id"} | {"is_exported": int(r["is_exported"])} for r in rows(overview.core_symbols(g, pick(symbols, 12)))]
    deps = [{"source": r["source"], "target": r["target"], "kind": r["kind"], "count": r["n"]} for r in rows(overview.dependencies(g, pick(dependencies, 20)))]
    counts = status.counts(g).first().asDict()
    summary = {k: counts[k] for k in ("files", "nodes", "edges", "resolved_edges")}
    return {"summary": summary, "packages": top, "core_symbols": core, "package_dependencies": deps, "storage": store.catalog(spark)}


def impact_payload(spark: SparkSession, store: Store, symbol: str, depth: int, limit: int) -> dict:
    g = store.graph(spark)
    roots = find.in_order(find.find_node(g, symbol)).select(*find.NODE).collect()
    if not roots:
        return {"symbol": symbol, "matched": 0, "roots": [], "nodes": [], "edges": []}
    ranked = spark.createDataFrame([(r["id"], i) for i, r in enumerate(roots)], "id string, rank long")
    reached, edges = impact.impact(g, ranked, depth, limit)
    nodes = g.nodes.select("id", "kind", "name", "qualified_name", "file_path", "start_line").join(reached.select("id"), "id").orderBy("id")
    s = g.nodes.selectExpr("id as source", "kind as source_kind", "name as source_name", "qualified_name as source_qname", "file_path as source_file", "start_line as source_line")
    full = edges.join(s, "source").orderBy("level", "parent_rank", "edge_id")
    listed = [r.asDict() for r in full.selectExpr("edge_id as id", "source", "target", "kind", "line", "col", "source as source_id", "source_kind", "source_name", "source_qname", "source_file", "source_line").collect()]
    return {"symbol": symbol, "matched": len(roots), "roots": [r.asDict() for r in roots], "nodes": [r.asDict() for r in nodes.collect()], "edges": listed}


def guarded(payload: dict, task: str, root: str, most: int, allow: bool) -> dict:
    """The payload, or its compact form where it is larger than `most` bytes of JSON."""
    size = len(json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode())
    if allow or most <= 0 or size <= most:
        return payload
    again = f"{PROG} --json context {json.dumps(task)} --path {json.dumps(root)}"
    out = context.compact(payload) | {k: payload[k] for k in ("project", "stale") if k in payload}
    out["truncated"] = True
    out["output"] = {
        "truncated": True, "reason": "json payload exceeded max_json_bytes", "estimated_bytes": size, "max_json_bytes": most, "summary_command": again + " --summary",
        "full_command": again + " --allow-large", "no_code_command": again + " --no-code", "compact_payload": True,
        "preserved_fields": ["task", "entrypoints", "related", "relationships", "project", "stale"],
    }
    return out


COMMANDS = (
    "init", "uninit", "rm", "index", "sync", "unlock", "query", "files", "status", "list", "info", "resolve", "callers", "callees", "impact", "affected", "context", "overview", "architecture",
)


def run(args: list[str], spark: SparkSession | None = None, cwd: str | None = None) -> None:
    """Runs one command; global flags come before it."""
    app, i = App(spark=spark, cwd=cwd), 0
    while i < len(args):
        name, given, value = args[i].partition("=")
        if args[i] == "--json":
            app.json = True
        elif args[i] == "--verbose":
            app.verbose = True
        elif name == "--target":
            if not given:
                i += 1
                if i >= len(args):
                    raise Failure("--target requires value")
                value = args[i]
            app.target = value
        else:
            break
        i += 1
    command = args[i] if i < len(args) else "help"
    if command in ("-h", "--help", "help"):
        print(f"Usage: {PROG} [--target NAME_OR_PATH] [--json] [--verbose] COMMAND ...\n\nCommands: {', '.join(COMMANDS)}")
    elif command in ("--version", "version"):
        print(f"{PROG} {VERSION}")
    elif command not in COMMANDS:
        raise Failure(f"unknown command: {command}")
    elif {"-h", "--help"} & set(args[i + 1 :]):
        print(f"Usage: {PROG} {command} [OPTIONS]")
    else:
        try:
            getattr(app, command)(args[i + 1 :])
        except Failure:
            if app.verbose:
                raise RuntimeError(f"{command} failed") from sys.exc_info()[1]
            raise


def main() -> None:
    try:
        run(sys.argv[1:])
    except Failure as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
