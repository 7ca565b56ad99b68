"""Graph queries over the entity graph of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph as G
from ..operators.components import connected_components
from ..sources.entity_graph import EDGES_SQL, NODES_SQL, edges, entity_id, nodes
from .registry import query, table

SMALL_PARTS = {"part": "p_size < 25"}
SMALL_NODES_SQL = NODES_SQL.replace("FROM part", "FROM part WHERE p_size < 25")
SEED = "orders:1"


def _seed(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(SEED).alias("id"))


@query(f"WITH {SMALL_NODES_SQL}, {EDGES_SQL} SELECT relation, CAST(count(*) AS BIGINT) AS n, CAST(sum(line) AS BIGINT) AS lines FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY relation")
def graph_assemble_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = G.kept_edges(nodes(spark, sf_dir, SMALL_PARTS), edges(spark, sf_dir))
    return kept.groupBy("relation").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query(f"WITH {SMALL_NODES_SQL}, {EDGES_SQL} SELECT relation, CAST(count(*) AS BIGINT) AS n FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes) GROUP BY relation")
def graph_assemble_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dropped = G.assemble(nodes(spark, sf_dir, SMALL_PARTS), edges(spark, sf_dir))
    return dropped.groupBy("relation").agg(F.count("*").alias("n"))


@query("""
SELECT 'customer:' || o_custkey AS identity, arg_min(l_returnflag, (o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS first_kind, CAST(count(*) AS BIGINT) AS n,
       string_agg(o_orderkey || '.' || l_linenumber, ',' ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS evidence
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(entity_id("customer", "o_custkey").alias("identity"), "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    got = G.merge_evidence(rows, ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag"])
    text = F.transform("evidence", lambda e: F.concat_ws(".", e["o_orderkey"].cast("string"), e["l_linenumber"].cast("string")))
    return got.select("identity", F.col("first.l_returnflag").alias("first_kind"), F.size("evidence").cast("bigint").alias("n"), F.array_join(text, ",").alias("evidence"))


@query("SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, CAST(count(*) AS BIGINT) AS n, CAST(min(nullif(l_linenumber, 0)) AS BIGINT) AS line FROM lineitem GROUP BY l_suppkey, l_partkey")
def link_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    raw = items.select(entity_id("supplier", "l_suppkey").alias("src"), entity_id("part", "l_partkey").alias("dst"), F.lit("supplies").alias("relation"), F.col("l_linenumber").cast("bigint").alias("line"))
    return G.collapse_links(raw).select("src", "dst", "n", "line")


@query("SELECT l_suppkey AS supplier, l_partkey AS part, string_agg(l_orderkey || ':' || l_linenumber, ' ' ORDER BY l_orderkey, l_linenumber) AS sites FROM lineitem GROUP BY ALL")
def parallel_edge_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = F.struct("l_orderkey", "l_linenumber")
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.sort_array(F.collect_list(site)).alias("s"))
    text = F.transform("s", lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string")))
    return got.select("supplier", "part", F.array_join(text, " ").alias("sites"))


@query(f"WITH {EDGES_SQL}, links AS (SELECT DISTINCT src, dst, relation FROM edges) SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree(edges(spark, sf_dir))


@query("""
SELECT event_type, CASE WHEN event_type = 'purchase' THEN 'references' WHEN event_type = 'view' THEN 'imports' ELSE 'calls' END AS relation,
       CASE WHEN event_type = 'purchase' THEN 'reference' WHEN event_type = 'click' THEN 'jsx' ELSE 'call' END AS index_relation, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY event_type""")
def relation_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns(
        {
            "explicit": F.when(F.col("event_type") == "purchase", F.lit("references")),
            "kind": F.when(F.col("event_type") == "view", F.lit("import")),
            "via": F.when(F.col("event_type") == "click", F.lit("jsx")),
        }
    )
    named = e.select("event_type", G.relation_name(F.col("explicit"), F.col("kind")).alias("relation"), G.index_relation(F.col("explicit"), F.col("via")).alias("index_relation"))
    return named.groupBy("event_type", "relation", "index_relation").agg(F.count("*").alias("n"))


_REACH_SQL = f"""
{NODES_SQL}, {EDGES_SQL},
links AS (SELECT a, b, min(w) AS w FROM (
  SELECT src AS a, dst AS b, CASE WHEN relation IN ('routes_to', 'depends_on', 'build_context_contains') THEN 0.5 ELSE 1.0 END AS w FROM edges
  UNION ALL SELECT dst, src, CASE WHEN relation IN ('routes_to', 'depends_on', 'build_context_contains') THEN 0.5 ELSE 1.0 END FROM edges) GROUP BY a, b),
step AS (SELECT a, b, w, b IN (SELECT id FROM nodes WHERE tier = 0) AS always FROM links),
reach(id, cost) AS (
  SELECT '{SEED}', CAST(0.0 AS DOUBLE)
  UNION
  SELECT b, CASE WHEN always THEN least(cost + CAST(w AS DOUBLE), 3.0) ELSE cost + CAST(w AS DOUBLE) END FROM reach JOIN step ON a = id WHERE always OR cost + CAST(w AS DOUBLE) <= 3.0),
best AS (SELECT id, min(cost) AS cost FROM reach GROUP BY id)"""
_CAP_SQL = f"{_REACH_SQL}, ranked AS (SELECT id, cost, row_number() OVER (ORDER BY id <> '{SEED}', tier <> 0, cost, id) AS rank FROM best JOIN nodes USING (id))"


@query(f"WITH RECURSIVE {_REACH_SQL} SELECT id, cost FROM best")
def weighted_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.expand(nodes(spark, sf_dir), edges(spark, sf_dir), _seed(spark))


@query(f"WITH RECURSIVE {_CAP_SQL} SELECT id, cost, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 60")
def slice_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return G.cap(G.expand(n, edges(spark, sf_dir), _seed(spark)), n, _seed(spark), 60)


@query(f"WITH RECURSIVE {_CAP_SQL} SELECT src, dst, relation, line FROM edges WHERE src IN (SELECT id FROM ranked WHERE rank <= 60) AND dst IN (SELECT id FROM ranked WHERE rank <= 60)")
def induced_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.induced(edges(spark, sf_dir), slice_cap(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES_SQL}, links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(id, hops) AS (SELECT '{SEED}', 0 UNION SELECT b, hops + 1 FROM reach JOIN links ON a = id WHERE hops < 4)
SELECT id, CAST(min(hops) AS BIGINT) AS hops FROM reach GROUP BY id""")
def hops_from_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hops(edges(spark, sf_dir), _seed(spark), 4)


#: Documents linked by equal texts or by a line of more than 200 characters that both have.
_DUP_SQL = """
keys AS (SELECT doc_id, sha256(text) AS k FROM documents UNION SELECT doc_id, sha256(line) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 200),
low AS (SELECT k, min(doc_id) AS root FROM keys GROUP BY k HAVING count(DISTINCT doc_id) > 1),
pairs AS (SELECT DISTINCT doc_id, root FROM keys JOIN low USING (k) WHERE doc_id <> root),
links AS (SELECT doc_id AS a, root AS b FROM pairs UNION SELECT root, doc_id FROM pairs),
walk(id, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT b, root FROM walk JOIN links ON a = id),
comp AS (SELECT id, min(root) AS component FROM walk GROUP BY id)"""


def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each document with the smallest that has its text, or one of its long lines."""
    docs = table(spark, sf_dir, "documents")
    whole = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    long = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 200)
    keys = whole.unionByName(long.select("doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("k"))).distinct()
    low = keys.groupBy("k").agg(F.min("doc_id").alias("dst"), F.max("doc_id").alias("high")).where("dst <> high").select("k", "dst")
    return keys.join(low, "k").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()


@query(f"WITH RECURSIVE {_DUP_SQL} SELECT id AS doc_id, CAST(component AS BIGINT) AS component FROM comp")
def connected_components_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = connected_components(duplicate_links(spark, sf_dir))
    return got.select(F.col("node").alias("doc_id"), "component")


@query(f"""WITH RECURSIVE {EDGES_SQL}, walk(id, path, hops) AS (
SELECT 'customer:1', ['customer:1'], 0 UNION ALL SELECT dst, list_append(path, dst), hops + 1 FROM walk JOIN (SELECT DISTINCT src, dst FROM edges) ON src = id WHERE hops < 8 AND NOT list_contains(path, dst) AND id NOT LIKE 'region:%')
SELECT CAST(hops AS BIGINT) AS hops, array_to_string(path, '>') AS path FROM walk WHERE id LIKE 'region:%' ORDER BY hops, path LIMIT 3""")
def paths_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1).select(F.lit("customer:1").alias("id"))
    return G.paths(edges(spark, sf_dir), start, F.col("node").startswith("region:"), 8, 3)


@query(f"""WITH RECURSIVE {EDGES_SQL}, walk(id, level) AS (SELECT '{SEED}', 0 UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = id WHERE level < 3),
least_level AS (SELECT id, min(level) AS level FROM walk GROUP BY id)
SELECT CAST(level AS BIGINT) AS level, split_part(id, ':', 1) AS kind, CAST(count(*) AS BIGINT) AS n FROM least_level GROUP BY ALL""")
def call_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = G.levels_down(edges(spark, sf_dir), _seed(spark), 3)
    return got.groupBy("level", F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, up AS (SELECT src, dst FROM edges WHERE relation IN ('in_nation', 'depends_on')),
walk(node, ancestor, depth) AS (SELECT src, dst, 1 FROM up UNION SELECT node, dst, depth + 1 FROM walk JOIN up ON src = ancestor WHERE depth < 4)
SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node, ancestor""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(edges(spark, sf_dir).where(F.col("relation").isin("in_nation", "depends_on")), 4)


@query(f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, walk(id, layer) AS (SELECT id, 0 FROM nodes UNION SELECT dst, layer + 1 FROM walk JOIN (SELECT DISTINCT src, dst FROM edges) ON src = id),
top AS (SELECT id, max(layer) AS layer FROM walk GROUP BY id)
SELECT split_part(id, ':', 1) AS kind, CAST(layer AS BIGINT) AS layer, CAST(count(*) AS BIGINT) AS n FROM top GROUP BY ALL""")
def layering_longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = G.longest_layers(nodes(spark, sf_dir), edges(spark, sf_dir))
    return got.groupBy(F.substring_index("id", ":", 1).alias("kind"), "layer").agg(F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL}, hashed AS (SELECT sha256(src || '|' || dst || '|' || relation) AS h FROM edges), parts AS (SELECT substr(h, 1, 4) AS part, sha256(string_agg(h, '' ORDER BY h)) AS digest, count(*) AS n FROM hashed GROUP BY 1)
SELECT substr(sha256(string_agg(digest, '' ORDER BY part)), 1, 16) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM parts""")
def graph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges hashed in a fixed order: sorted inside each of 65,536 ranges of their hash, then the ranges' digests."""
    hashed = edges(spark, sf_dir).select(F.sha2(F.concat_ws("|", "src", "dst", "relation").cast("binary"), 256).alias("h"))
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary"), 256).alias("digest")
    parts = hashed.groupBy(F.substring("h", 1, 4).alias("part")).agg(digest, F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
    return parts.agg(F.substring(F.sha2(whole.cast("binary"), 256), 1, 16).alias("fingerprint"), F.sum("n").alias("n"))


#: A prime below 2 ** 61.
_PRIME = 2305843009213693951


@query(f"""WITH {EDGES_SQL} SELECT relation, CAST(sum(CAST(('0x' || substr(sha256(src || '|' || dst), 1, 15)) AS BIGINT)) % {_PRIME} AS BIGINT) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY relation""")
def graph_fingerprint_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free fingerprint that combines map-side: a sum of hashes, in which repeated edges count each time."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "src", "dst").cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    rest = (F.sum(h) % F.lit(_PRIME).cast("decimal(20,0)")).cast("bigint")
    return edges(spark, sf_dir).groupBy("relation").agg(rest.alias("fingerprint"), F.count("*").alias("n"))
