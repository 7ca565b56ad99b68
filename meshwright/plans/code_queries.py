"""Code-graph queries over an embedded repository: extraction and resolution, held against rows read off its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..extract.scan import scan_files
from ..operators import code_graph as C
from ..operators import graph as G
from ..operators.layout import layout
from ..sources.files import files_from_texts
from . import sample_expected as E
from .registry import query
from .sample_repository import FILES


def _scan(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return scan_files(files_from_texts(spark, FILES))


@query(E.EVIDENCE_SQL)
def code_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark)[0].select("identity", "kind", "subtype", "file", "line", "tier", "confidence", "qualname", "signature")


@query(E.RAW_SQL)
def code_raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark)[1].select("src", "dst", "relation", "kind", "file", "line", F.array_join("chain", ".").alias("chain"))


@query(E.ERRORS_SQL)
def code_scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark)[2]


@query(E.RESOLVED_SQL)
def code_resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, raw, _ = _scan(spark)
    nodes, edges = C.resolve(evidence, raw)
    own = edges.where("target is not null").select("src", F.col("target").alias("dst"), F.col("relation_name").alias("relation"), "file", "line")
    return own.unionByName(C.containment(nodes))


@query(E.UNRESOLVED_SQL)
def code_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, raw, _ = _scan(spark)
    _, edges = C.resolve(evidence, raw)
    left = edges.where("target is null and kind is null and coalesce(relation, '') not in ('references', 'built_by')")
    return left.groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("dst")), ", ").alias("names"))


@query(E.LINKS_SQL)
def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, raw, _ = _scan(spark)
    nodes, edges = C.resolve(evidence, raw)
    return C.links(edges, C.symbols(nodes))


@query()
def code_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = code_links(spark, sf_dir)
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return layout(ids, links.select("src", "dst"))


@query(E.DEGREE_SQL)
def code_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree(code_links(spark, sf_dir))
