"""Search queries: BM25 and token overlap over documents, symbol search over parts, names, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import all_words, word_usage
from ..operators import search as S
from ..operators.components import connected_components
from ..sources.lines import LINES_SQL, lines
from .graph_queries import _DUP_SQL, duplicate_links
from .registry import query, table

WORDS = ["license", "the", "mit"]

_BM25_SQL = """
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM words GROUP BY ALL),
dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw WHERE token IN ('license', 'the', 'mit')),
scores AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) ORDER BY token) AS score FROM tf JOIN idf USING (token) JOIN dl USING (doc_id), corpus GROUP BY doc_id)"""


@query(f"WITH {_BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM scores")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS)
    return got.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25_SQL} SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS BIGINT) AS rank FROM scores ORDER BY rank LIMIT 10")
def bm25_top_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = bm25_scores(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("bigint"))


@query("SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['license', 'idiot'])")
def token_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(S.overlaps(F.col("text"), ["license", "idiot"])).select("doc_id")


@query(f"""WITH RECURSIVE {_BM25_SQL}, {_DUP_SQL},
top AS (SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY score DESC, doc_id LIMIT 10),
clustered AS (SELECT doc_id, score, coalesce(component, doc_id) AS component FROM top LEFT JOIN comp ON comp.id = top.doc_id),
groups AS (SELECT component, max(score) AS best, arg_max(doc_id, (score, doc_id)) AS label, count(*) AS n FROM clustered GROUP BY component),
judged AS (SELECT *, row_number() OVER (ORDER BY best DESC, label) AS rank, lead(best) OVER (ORDER BY best DESC, label) AS second FROM groups)
SELECT CAST(label AS BIGINT) AS label, best AS score, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank,
  (SELECT count(*) >= 2 AND NOT (max(best) > 0 AND coalesce(max(second) FILTER (WHERE rank = 1), 0) < 0.5 * max(best)) FROM judged) AS ambiguous FROM judged""")
def ambiguity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by group of copies; ambiguous unless one group stands out."""
    top = bm25_top_docs(spark, sf_dir).select("doc_id", "score")
    comp = connected_components(duplicate_links(spark, sf_dir))
    grouped = (
        top.join(comp, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id"))
        .groupBy("component").agg(F.max("score").alias("score"), F.max_by("doc_id", F.struct("score", "doc_id")).alias("label"), F.count("*").alias("n"))
    )
    w = Window.orderBy(F.desc("score"), "label")  # ten rows at most
    ranked = grouped.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("second", F.lead("score").over(w))
    verdict = ranked.where("rank = 1").select((F.col("second").isNotNull() & ~((F.col("score") > 0) & (F.col("second") < 0.5 * F.col("score")))).alias("ambiguous"))
    return ranked.crossJoin(F.broadcast(verdict)).select("label", "score", "n", "rank", "ambiguous")


_FUZZY_SQL = """
fields AS (
  SELECT p_partkey AS id, 'name' AS field, 3.0 AS weight, unnest(string_split(lower(p_name), ' ')) AS word FROM part
  UNION ALL SELECT p_partkey, 'qual', 2.0, lower(p_type) FROM part
  UNION ALL SELECT p_partkey, 'doc', 1.0, unnest(list_filter(regexp_split_to_array(lower(p_brand), '[^a-z0-9]+'), lambda x: x <> '')) FROM part),
asked AS (SELECT unnest(['ring', 'econ']) AS q),
best AS (SELECT id, q, max(CASE WHEN word = q THEN weight WHEN (length(q) >= 3 AND starts_with(word, q)) OR (length(word) >= 4 AND starts_with(q, word)) THEN 0.6 * weight ELSE 0 END) AS s FROM fields, asked GROUP BY id, q),
scored AS (SELECT id, CAST(sum(s) AS DOUBLE) AS s, count(*) FILTER (WHERE s > 0) AS m FROM best GROUP BY id),
hits AS (SELECT id, round((s + CASE WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = 'ringecon' THEN 6 WHEN starts_with(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'ringecon') THEN 2 ELSE 0 END) * m / 2, 6) AS score
  FROM scored JOIN part ON p_partkey = id)"""


def part_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score) of parts for the words "ring" and "econ"."""
    fields = {"name": F.col("p_name"), "qual": F.col("p_type"), "doc": F.col("p_brand")}
    got = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(S.fuzzy_score(fields, ["ring", "econ"]), 6).alias("score"))
    return got.where("score > 0")


@query(f"WITH {_FUZZY_SQL} SELECT id, score FROM hits WHERE score > 0")
def fuzzy_symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_hits(spark, sf_dir)


@query(f"WITH {_FUZZY_SQL}, two AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r, lead(score) OVER (ORDER BY score DESC, id) AS second FROM hits WHERE score > 0) SELECT id, score, second IS NULL OR score >= 1.5 * second AS winner FROM two WHERE r = 1")
def clear_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clear_winner(part_hits(spark, sf_dir))


@query("""
WITH symbols AS (SELECT 'part:' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier),
tiered AS (SELECT *, CASE WHEN id = 'small ring' THEN 0 WHEN name = 'small ring' THEN 1 WHEN lower(name) = 'small ring' THEN 2 WHEN contains(lower(name), 'ring') THEN 3 END AS tier FROM symbols)
SELECT id, name, CAST(tier AS BIGINT) AS tier, CASE WHEN count(*) OVER () = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM tiered WHERE tier = (SELECT min(tier) FROM tiered)""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    sups = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    ask = "small ring"
    tiers = [F.col("id") == ask, F.col("name") == ask, F.lower("name") == ask, F.contains(F.lower("name"), F.lit("ring"))]
    got = S.resolve_cascade(parts.unionByName(sups), tiers, [F.col("id")])
    return got.select("id", "name", F.col("tier").cast("bigint").alias("tier"), "status")


_SPAN_SQL = f"""{LINES_SQL},
counts AS (SELECT doc_id, max(line_no) AS n FROM lines GROUP BY doc_id),
spans AS (SELECT doc_id, k, b, b * (1 << k) + 1 AS first, least((b + 1) * (1 << k), n) AS last, k || '/' || b AS span FROM counts, (SELECT unnest([1, 2, 3]) AS k), LATERAL (SELECT unnest(generate_series(0, (n - 1) // (1 << k))) AS b))"""


def document_spans(ls: DataFrame) -> DataFrame:
    """(doc_id, first, last, span): blocks of 2, 4 and 8 lines as nested definitions."""
    counts = ls.groupBy("doc_id").agg(F.max("line_no").alias("n"))
    sized = counts.select("doc_id", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(1 << k).cast("bigint").alias("size")) for k in (1, 2, 3)))).alias("s"))
    blocks = sized.select("doc_id", "n", "s.k", "s.size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("s.size")))).alias("b"))
    return blocks.select(
        "doc_id", (F.col("b") * F.col("size") + 1).alias("first"), F.least((F.col("b") + 1) * F.col("size"), F.col("n")).alias("last"), F.concat_ws("/", F.col("k").cast("string"), F.col("b").cast("string")).alias("span")
    )


@query(f"""WITH {_SPAN_SQL}, hits AS (SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])License([^A-Za-z0-9_]|$)') OR contains(line, 'Licensed'))
SELECT doc_id, line_no, arg_max(span, (first, span)) AS span FROM hits JOIN spans USING (doc_id) WHERE line_no BETWEEN first AND last GROUP BY doc_id, line_no""")
def enclosing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(table(spark, sf_dir, "documents"))
    hits = ls.where(word_usage(F.col("line"), "License") | F.contains("line", F.lit("Licensed"))).select("doc_id", "line_no")
    return S.enclosing(hits, document_spans(ls), "doc_id")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no FROM lines WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])idiot([^A-Za-z0-9_]|$)')")
def usages_word_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).where(word_usage(F.col("line"), "idiot")).select("doc_id", "line_no")


@query(f"WITH {LINES_SQL}, hits AS (SELECT doc_id, line_no, line, count(*) OVER () AS total FROM lines WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])clown([^A-Za-z0-9_]|$)')) SELECT doc_id, line_no, CAST(total AS BIGINT) AS total FROM hits ORDER BY doc_id, line_no LIMIT 15")
def usages_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 usages and how many there are."""
    hits = lines(table(spark, sf_dir, "documents")).where(word_usage(F.col("line"), "clown")).select("doc_id", "line_no")
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("doc_id", "line_no").limit(15).crossJoin(F.broadcast(total))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no FROM lines WHERE contains(lower(line), 'licensed') AND contains(lower(line), 'cc') ORDER BY doc_id, line_no LIMIT 5")
def phrase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lines(table(spark, sf_dir, "documents")).where(all_words(F.col("line"), ["licensed", "cc", "x"]))
    return hits.select("doc_id", "line_no").orderBy("doc_id", "line_no").limit(5)
