"""Source files as a relation: git-aware listing on the driver, content read on the executors.

Spark's file sources hide names that begin with ``_`` or ``.``; code has many of those, so
paths are listed here and opened by ``mapInArrow``. Executors must see the same folders.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders that are never scanned, matched against parent components only.
SKIPPED = frozenset("""
.git node_modules vendor venv .venv __pycache__ dist build tests test __tests__ spec specs .claude
""".split())
GIT_SECONDS = 60


def list_files(root: str, skipped: frozenset[str] = SKIPPED) -> list[str]:
    """Paths below ``root`` with ``/``, sorted: what git tracks or would, else a pruned walk."""
    found = _git_files(root)
    if found is None:
        found = []
        for folder, below, names in os.walk(root):
            below[:] = sorted(d for d in below if d not in skipped)
            found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names]
    keep = [p for p in found if not skipped & set(p.split("/")[:-1]) and os.path.isfile(os.path.join(root, p))]
    return sorted(keep)


def _git_files(root: str) -> list[str] | None:
    command = ["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"]
    try:
        done = subprocess.run(command, capture_output=True, timeout=GIT_SECONDS, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    names = [n for n in done.stdout.decode("utf-8", "replace").split("\0") if n and not n.endswith("/")]
    return names or None


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, problem = [], []
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content.append(f.read())
                    problem.append(None)
                except OSError as e:
                    content.append(None)
                    problem.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(problem, pa.string())], ["rel_path", "content", "problem"])

    return run


def described(rows: DataFrame) -> DataFrame:
    """(rel_path, content) with name, ext, size, sha256 and text."""
    name = F.substring_index("rel_path", "/", -1)
    return rows.select(
        "rel_path",
        name.alias("name"),
        F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("").alias("ext"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.decode("content", "UTF-8").alias("text"),
        "content",
    )


def repository_files(spark: SparkSession, root: str, skipped: frozenset[str] = SKIPPED) -> DataFrame:
    """One row per readable file of a repository."""
    paths = list_files(root, skipped)
    frame = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    frame = frame.repartition(max(1, min(len(paths) // 64, 4096))) if len(paths) > 64 else frame.coalesce(1)
    read = frame.mapInArrow(_read(root), "rel_path string, content binary, problem string")
    return described(read.where("problem is null").drop("problem"))


def files_from_texts(spark: SparkSession, texts: dict[str, str] | Iterable[tuple[str, str]]) -> DataFrame:
    """The same relation from paths and texts in memory."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    rows = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in pairs], "rel_path string, content binary")
    return described(rows)
