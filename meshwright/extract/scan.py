"""The extractors as one Spark scan: files in, evidence, raw edges and scan errors out."""

from __future__ import annotations

import dataclasses
import os
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.cache import cache_key, cached_rows, flush, missing, used_only
from ..operators.storage import materialize
from . import infrastructure, python_code, rules as rule_set, typescript_code
from .records import EDGE_SCHEMA, NODE_SCHEMA, Edge, Node

#: In this order: name and version (part of the cache key), which files, and the extractor.
Extractor = tuple[str, Callable[[str], bool], Callable[[str, str], tuple[list[Node], list[Edge]]]]
_COMPOSE = re.compile(r"(?:docker-compose.*|compose)\.ya?ml", re.I)


def _base(path: str) -> str:
    return os.path.basename(path)


def below(path: str, *folders: str) -> bool:
    """Whether a file lies in a folder of one of these names, at any depth."""
    return not set(folders).isdisjoint(path.split("/")[:-1])


def is_dockerfile(path: str) -> bool:
    name = _base(path)
    return name == "Dockerfile" or name.startswith("Dockerfile.") or name.lower().endswith(".dockerfile")


def default_extractors(catalogue: str = rule_set.CATALOGUE) -> list[Extractor]:
    """Infrastructure first, then rules, then code: the first evidence of a node decides its kind."""
    rules = rule_set.load_rules(catalogue)
    return [
        ("terraform@1", lambda p: p.endswith(".tf") and not below(p, ".terraform"), infrastructure.terraform),
        ("compose@1", lambda p: bool(_COMPOSE.fullmatch(_base(p))), infrastructure.compose),
        ("dockerfile@1", is_dockerfile, infrastructure.dockerfile),
        ("kubernetes@1", lambda p: p.lower().endswith((".yaml", ".yml")) and not _COMPOSE.fullmatch(_base(p)) and not below(p, "charts", "templates"), infrastructure.kubernetes),
        ("rules@1", lambda p: os.path.splitext(p)[1] in rule_set.LANGUAGES, lambda p, t: (rule_set.scan(p, t, rules), [])),
        (python_code.VERSION, lambda p: p.endswith(".py"), python_code.extract),
        (typescript_code.VERSION, lambda p: p.lower().endswith((".ts", ".tsx")), typescript_code.extract),
    ]


def _rows(items: list, ord_: list[tuple[int, int]]) -> list[dict[str, Any]]:
    out = []
    for item, (extractor, seq) in zip(items, ord_, strict=True):
        row = dataclasses.asdict(item)
        for k in ("bases",):
            if k in row:
                row[k] = [t._asdict() for t in getattr(item, k)]
        for k in ("returns", "receiver"):
            if k in row:
                v = getattr(item, k)
                row[k] = v._asdict() if v is not None else None
        if "attr_types" in row:
            row["attr_types"] = {k: v._asdict() for k, v in item.attr_types.items()}
        out.append(row | {"ord": extractor, "seq": seq})
    return out




def _struct(schema: str) -> StructType:
    return StructType.fromDDL(schema + ", ord int, seq int")


def scan_files(files: DataFrame, extractors: list[Extractor] | None = None, cache: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, raw edges, scan errors) of files (rel_path, text).

    With ``cache``, a folder, only files whose place and content no earlier scan by the same
    extractors has seen are worked on; rows that this scan does not use leave the cache.

    A file that an extractor cannot parse gives an error row and, of code, its module node;
    the scan goes on. ``ord`` and ``seq`` order the evidence of a node.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    use = extractors or default_extractors()
    node_type, edge_type = to_arrow_type(_struct(NODE_SCHEMA)), to_arrow_type(_struct(EDGE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, edges, errors = [], [], []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n_all, e_all, x_all = [], [], []
                for k, (name, applies, extract) in enumerate(use):
                    if text is None or not applies(path):
                        continue
                    try:
                        n, e = extract(path, text)
                    except Exception as problem:  # noqa: BLE001 - malformed input is reported, not fatal
                        n, e = [], []
                        if name == python_code.VERSION:
                            n = [Node(path, "module", None, path, 1, 2, 1.0, name=_base(path), qualname="", end_line=text.count("\n") + 1)]
                        x_all.append({"extractor": name, "problem": f"{type(problem).__name__}: {problem}"[:300]})
                    n_all += _rows(n, [(k, i) for i in range(len(n))])
                    e_all += _rows(e, [(k, i) for i in range(len(e))])
                nodes.append(n_all)
                edges.append(e_all)
                errors.append(x_all)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.list_(node_type)), pa.array(edges, pa.list_(edge_type)), pa.array(errors, pa.list_(pa.struct([("extractor", pa.string()), ("problem", pa.string())])))],
                ["rel_path", "nodes", "edges", "errors"],
            )

    schema = (
        f"rel_path string, nodes array<{_struct(NODE_SCHEMA).simpleString()}>, edges array<{_struct(EDGE_SCHEMA).simpleString()}>, "
        "errors array<struct<extractor:string,problem:string>>"
    )
    keyed = files.select("rel_path", "text", cache_key(",".join(name for name, _, _ in use), F.col("rel_path"), F.coalesce("text", F.lit(""))).alias("key"))
    known = cached_rows(files.sparkSession, cache) if cache else None
    todo = keyed if known is None else missing(keyed, known, "key")
    # three relations come from one pass
    scanned = materialize(todo.select("rel_path", "text").mapInArrow(run, schema), "scan")
    if cache:
        rows = scanned.join(keyed.select("rel_path", "key"), "rel_path")
        if known is not None:
            rows = rows.unionByName(used_only(known, keyed, "key"))
        scanned = materialize(rows, "scan")
        if known is None or not todo.isEmpty() or known.count() != keyed.count():
            flush(scanned, cache)
    evidence = scanned.select(F.explode("nodes").alias("n")).select("n.*")
    raw = scanned.select(F.explode("edges").alias("e")).select("e.*")
    problems = scanned.select("rel_path", F.explode("errors").alias("x")).select("rel_path", "x.*")
    return evidence, raw, problems
