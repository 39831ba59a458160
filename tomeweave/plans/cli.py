"""The engine on the command line: python -m tomeweave.plans.cli --home FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..operators.embed import hashing_embedder
from .engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tomeweave")
    p.add_argument("--home", required=True, help="folder of the store")
    p.add_argument("--semantic", action="store_true", help="embed chunks with the hashing embedder")
    commands = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [commands.add_parser(name)] and [commands.choices[name].add_argument(*a if isinstance(a, tuple) else (a,)) for a in args]
    add("add", "path")
    add("remove", "source")
    add("sources")
    add("load", ("--source",))
    add("status")
    add("list", ("--source",), ("--prefix",), ("--filter",))
    add("read", "path", ("--source",))
    add("chunks", "path", "source")
    add("context", "path", "source", "index")
    add("create", "source", "path", "content")
    add("modify", "path", "content", ("--source",))
    add("rename", "path", "title", ("--source",))
    add("move", "path", "to", ("--source",))
    add("delete", "path", ("--source",))
    add("search", "query", ("--source",), ("--prefix",), ("--mode",), ("--top",), ("--page",))
    add("uncompiled")
    add("compact")
    return p


def run(engine: Engine, a: argparse.Namespace):
    """What a command gives, ready for JSON."""
    rows = lambda df, *names: [{n: r[n] for n in names or df.columns} for r in df.collect()]
    match a.command:
        case "add":
            return engine.add_source(a.path)
        case "remove":
            return engine.remove_source(a.source)
        case "sources":
            return engine.sources()
        case "load":
            return engine.load(a.source) if a.source else engine.load_all()
        case "status":
            return engine.status()
        case "list":
            return [r for r in rows(engine.entries(a.source, a.prefix), "source_id", "rel_path", "title", "tags") if not a.filter or a.filter.lower() in " ".join([r["rel_path"], r["title"], *r["tags"]]).lower()]
        case "read":
            return engine.read(a.path, a.source)
        case "chunks":
            return rows(engine.chunks(a.path, a.source), "chunk_index", "heading", "chunk_type", "start_line", "end_line")
        case "context":
            return rows(engine.chunk_context(a.path, a.source, int(a.index)), "chunk_index", "heading", "raw_text")
        case "create":
            return engine.create(a.source, a.path, a.content)
        case "modify":
            return engine.modify(a.path, a.content, a.source)
        case "rename":
            return engine.rename(a.path, a.title, a.source)
        case "move":
            return engine.move(a.path, a.to, a.source)
        case "delete":
            return engine.delete(a.path, a.source)
        case "search":
            size, page = min(200, max(1, int(a.top or 10))), max(1, int(a.page or 1))
            hits = engine.search(a.query, a.mode or "hybrid", a.source, a.prefix, size * page)
            return rows(hits)[size * (page - 1) : size * page]
        case "uncompiled":
            from ..operators import manifest

            return rows(manifest.uncompiled(engine._rows("manifest")))
        case "compact":
            return engine.store.compact()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, a.home, hashing_embedder() if a.semantic else None)
    try:
        out = run(engine, a)
    except (KeyError, ValueError) as found:
        print(json.dumps({"error": str(found)}), file=sys.stderr)
        return 2
    print(json.dumps(out, ensure_ascii=False, indent=1))
    return 0 if out not in (False, None) else 1


if __name__ == "__main__":
    sys.exit(main())
