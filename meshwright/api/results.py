"""What the views found as JSON values: counts, slices, candidates, diagrams, packs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from .repository import PACK, Repository, tokens_of

#: Rows of a kind in one answer.
MOST_ROWS = 2000


def scan_result(repo: Repository) -> dict[str, Any]:
    """Counts of the build, evidence by tier, and edges that were dropped for want of an end."""
    tiers = {f"tier{r.tier}": r["count"] for r in repo.scanned[0].groupBy("tier").count().orderBy("tier").collect()}
    return {"status": "ok", **repo.scan(), "evidence": tiers, "dropped_edges": repo.edges.where("target is null").count()}


def _graph(repo: Repository, got: dict) -> dict[str, Any]:
    facts = repo.nodes.select(F.col("identity").alias("id"), "kind", "subtype", "file", "line", F.col("tier").cast("int").alias("tier"), "confidence")
    nodes = got["nodes"].join(facts, "id").orderBy("rank").limit(MOST_ROWS)
    edges = got["edges"].select("src", "dst", "relation", "file", "line").orderBy("src", "dst", "relation", "file", "line")
    rows = edges.limit(MOST_ROWS + 1).collect()
    return {"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in rows[:MOST_ROWS]], "more_edges": len(rows) > MOST_ROWS}


def slice_result(repo: Repository, query: str, max_nodes: int = 60) -> dict[str, Any]:
    got = repo.slice(query, max_nodes)
    if got["status"] == "ambiguous":
        return {"status": "ambiguous", "candidates": [{"id": i, "score": s} for i, s in got["candidates"]]}
    return {"status": got["status"], **(_graph(repo, got) if got["status"] == "ok" else {})}


def diagram_result(repo: Repository, query: str, path: str, max_nodes: int = 60) -> dict[str, Any]:
    status = repo.diagram(query, path, max_nodes)
    return {"status": status, **({"path": path} if status == "ok" else {})}


def context_result(repo: Repository, query: str, token_budget: int = PACK) -> dict[str, Any]:
    if token_budget < 200:
        raise ValueError("the budget must be 200 tokens or more")
    text = repo.context(query, token_budget)
    if text == "no_match":
        return {"status": "no_match"}
    return {"status": "ok", "text": text, "tokens": tokens_of(text), "whole_files": repo.baseline_tokens(query)}
