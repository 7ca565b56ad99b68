"""A tool server: JSON-RPC 2.0, one message a line, over standard input and output.

Methods: initialize, tools/list, tools/call. The first four tools answer in text for the
repository the server was started for; the others take a repository's path and answer in
JSON. A repository is scanned when it is first asked about and again when its files changed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from typing import Any, TextIO

from pyspark.sql import SparkSession

from ..sources.files import list_files
from . import results
from .repository import PACK, Repository, file_name

#: Seconds between two looks at a repository's files.
LOOK_EVERY = 0.5


def _tool(text: str, required: list[str], **fields: str) -> dict[str, Any]:
    return {"description": text, "inputSchema": {"type": "object", "properties": {k: {"type": v} for k, v in fields.items()}, "required": required}}


TOOLS = {
    "find_symbol": _tool("Definitions that match words, and where an identifier or phrase is used", ["query"], query="string"),
    "show": _tool("A definition with its source, callers and callees; up to four, separated by commas", ["symbol"], symbol="string", detail="string"),
    "trace": _tool("How a definition reaches another, or its tree of calls (direction down or up)", ["symbol"], symbol="string", to="string", direction="string"),
    "repo_map": _tool("The files that matter most below a path", [], path="string"),
    "scan": _tool("Counts of a repository's graph", ["repo_path"], repo_path="string"),
    "slice": _tool("The part of the graph that a question is about", ["repo_path", "query"], repo_path="string", query="string", max_nodes="integer"),
    "generate_diagram": _tool("A slice as a draw.io file", ["repo_path", "query"], repo_path="string", query="string", output_path="string", max_nodes="integer"),
    "get_context": _tool("Source for a question within a budget of tokens", ["repo_path", "query"], repo_path="string", query="string", token_budget="integer"),
}


class Server:
    """Answers messages about repositories; holds the last snapshot of each."""

    def __init__(self, spark: SparkSession, root: str = ".", cache: str | None = None) -> None:
        self.spark, self.root, self.cache = spark, os.path.abspath(root), cache
        self._held: dict[str, tuple[dict, float, Repository]] = {}

    def repository(self, root: str) -> Repository:
        """The repository as it is on disk: rebuilt if a file's size or time changed."""
        root = os.path.abspath(root)
        if not os.path.isdir(root):
            raise ValueError(f"not a folder: {root}")
        held = self._held.get(root)
        if held and time.monotonic() - held[1] < LOOK_EVERY:
            return held[2]
        stats = {p: os.stat(os.path.join(root, p)) for p in list_files(root)}
        state = {p: (s.st_size, s.st_mtime_ns) for p, s in stats.items()}
        repo = held[2] if held and held[0] == state else Repository(self.spark, root, cache=self.cache)
        self._held[root] = (state, time.monotonic(), repo)
        return repo

    def call(self, name: str, a: dict[str, Any]) -> str:
        """The text that a tool answers with."""
        if name not in TOOLS:
            raise ValueError(f"no such tool: {name}")
        lacking = [k for k in TOOLS[name]["inputSchema"]["required"] if k not in a]
        if lacking:
            raise ValueError(f"missing: {', '.join(lacking)}")
        repo = self.repository(a.get("repo_path", self.root))
        if name == "find_symbol":
            return repo.find(a["query"])
        if name == "show":
            return repo.show(a["symbol"], a.get("detail") or "full")
        if name == "trace":
            return repo.trace(a["symbol"], a.get("to") or None, a.get("direction") == "up")
        if name == "repo_map":
            return repo.map(a.get("path") or "")
        if name == "scan":
            got = results.scan_result(repo)
        elif name == "slice":
            got = results.slice_result(repo, a["query"], int(a.get("max_nodes", 60)))
        elif name == "generate_diagram":
            got = results.diagram_result(repo, a["query"], a.get("output_path") or file_name(a["query"]), int(a.get("max_nodes", 60)))
        else:
            got = results.context_result(repo, a["query"], int(a.get("token_budget", PACK)))
        return json.dumps(got, ensure_ascii=False)

    def answer(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The reply to one message; None to a notification."""
        if "id" not in message:
            return None
        head = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return head | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "meshwright", "version": "1"}}}
        if method == "tools/list":
            return head | {"result": {"tools": [{"name": k, **v} for k, v in TOOLS.items()]}}
        if method != "tools/call":
            return head | {"error": {"code": -32601, "message": f"no such method: {method}"}}
        try:
            text, wrong = self.call(params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:  # noqa: BLE001 - a failed call is an answer; the server goes on
            text, wrong = f"{type(e).__name__}: {e}", True
        return head | {"result": {"content": [{"type": "text", "text": text}], "isError": wrong}}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except json.JSONDecodeError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
