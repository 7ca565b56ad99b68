"""Command line: scan, slice, diagram, context, find, show, trace, map, serve."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .repository import PACK, Repository, file_name


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meshwright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "slice", "diagram", "context", "find", "show", "trace", "map", "serve"):
        c = sub.add_parser(name)
        c.add_argument("--repo", default=os.environ.get("MESHWRIGHT_REPO", "."))
        if name == "map":
            c.add_argument("query", nargs="?", default="")
        elif name not in ("scan", "serve"):
            c.add_argument("query")
        if name in ("slice", "diagram"):
            c.add_argument("--max-nodes", type=int, default=60)
        if name == "diagram":
            c.add_argument("--output")
        if name == "context":
            c.add_argument("--budget", type=int, default=PACK)
        if name == "show":
            c.add_argument("--detail", choices=("full", "outline", "signature"), default="full")
        if name == "trace":
            c.add_argument("to", nargs="?")
            c.add_argument("--up", action="store_true")
            c.add_argument("--depth", type=int, default=3)
    return p


def cache_folder() -> str | None:
    """Where scans are cached: MESHWRIGHT_CACHE (empty: nowhere), else a folder of the user's caches."""
    own = os.environ.get("MESHWRIGHT_CACHE")
    if own is not None:
        return "file://" + os.path.abspath(own) if own else None
    return "file://" + os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "meshwright", "scan")


def main(argv: list[str] | None = None) -> int:
    """0 for an answer, 1 for none or several meanings, 2 for a bad call."""
    args = parser().parse_args(argv)
    if not os.path.isdir(args.repo):
        print(f"not a folder: {args.repo}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    cache = cache_folder()
    if args.command == "serve":
        from .server import Server

        Server(spark, args.repo, cache).serve()
        return 0
    repo = Repository(spark, os.path.abspath(args.repo), cache=cache)
    if args.command == "scan":
        print("\n".join(f"{k}: {v}" for k, v in repo.scan().items()))
        return 0
    if args.command == "slice":
        got = repo.slice(args.query, args.max_nodes)
        rows = [f"{r.rank} {r.id} {r.cost}" for r in got["nodes"].orderBy("rank").collect()] if got["status"] == "ok" else [f"{i} {s}" for i, s in got.get("candidates", [])]
        print("\n".join([got["status"], *rows]))
        return int(got["status"] != "ok")
    if args.command == "diagram":
        status = repo.diagram(args.query, args.output or file_name(args.query), args.max_nodes)
        print(status)
        return int(status != "ok")
    text = {
        "context": lambda: repo.context(args.query, args.budget),
        "find": lambda: repo.find(args.query),
        "show": lambda: repo.show(args.query, args.detail),
        "trace": lambda: repo.trace(args.query, args.to, args.up, args.depth),
        "map": lambda: repo.map(args.query),
    }[args.command]()
    print(text)
    return int(text.split("\n")[0] in ("no_match", "ambiguous", "nothing found", "no path"))
