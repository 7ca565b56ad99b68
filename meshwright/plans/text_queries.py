"""Queries over lines, rules, budgets, pages and snapshots of the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import budget as B
from ..operators import resolve as R
from ..sources.lines import LINES_SQL, lines
from .registry import query, table

#: The scan's rules: (rule, pattern); the last group is the captured value, if there is one.
RULES = [("license-line", r"Licensed under ([A-Z0-9][A-Za-z0-9 .-]*[A-Za-z0-9])"), ("mail", r"([a-z0-9.]+@[a-z0-9.]+\.com)"), ("secret", r"token = .([0-9a-f]{8})"), ("shout", r"([A-Z]{6,})!!")]
_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}')" for r, p in RULES) + ") t(rule, pattern))"


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


def _rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, rule, value): every rule is an expression over a line; no join is needed."""
    ls = lines(table(spark, sf_dir, "documents"))
    tests = F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule"), F.regexp_extract("line", p, 1).alias("value"))) for r, p in RULES))
    return ls.select("doc_id", "line_no", F.explode(F.array_compact(tests)).alias("hit")).select("doc_id", "line_no", "hit.*")


@query(f"WITH {LINES_SQL}, {_RULES_SQL} SELECT doc_id, line_no, rule FROM lines, rules WHERE regexp_matches(line, pattern)")
def tier1_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_hits(spark, sf_dir).select("doc_id", "line_no", "rule")


@query(f"WITH {LINES_SQL}, {_RULES_SQL}, hits AS (SELECT doc_id, rule, regexp_extract(line, pattern, 1) AS value FROM lines, rules WHERE regexp_matches(line, pattern)) SELECT rule || ':' || value AS identity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS files FROM hits GROUP BY rule, value")
def tier1_capture_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rule_hits(spark, sf_dir).withColumn("identity", F.concat_ws(":", "rule", "value"))
    return hits.groupBy("identity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"))


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, rtrim(regexp_replace(line, '#.*', '')) AS code, CAST(length(line) AS BIGINT) AS width FROM lines WHERE contains(line, '#')")
def comment_blanking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = lines(table(spark, sf_dir, "documents")).where(F.contains("line", F.lit("#")))
    blank = T.blank_comments(F.col("line"))
    return ls.select("doc_id", "line_no", F.rtrim(blank).alias("code"), F.length(blank).cast("bigint").alias("width"))


@query("""
WITH raw AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '' ELSE event_type END AS file, CAST(event_id % 11 AS BIGINT) - 1 AS line, CAST(event_id % 5 AS BIGINT) AS tier, value / 100 AS confidence FROM events),
known AS (SELECT DISTINCT event_type AS file, CAST(8 AS BIGINT) AS n FROM events WHERE event_type <> 'error'),
judged AS (SELECT CASE WHEN file = '' THEN 'empty file' WHEN line <= 0 THEN 'bad line' WHEN confidence < 0 OR confidence > 1 THEN 'bad confidence' WHEN tier NOT BETWEEN 0 AND 3 THEN 'bad tier'
  WHEN n IS NULL THEN 'no such file' WHEN line > n THEN 'line past end' END AS reason FROM raw LEFT JOIN known USING (file))
SELECT coalesce(reason, 'ok') AS reason, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY 1""")
def verify_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence checks in order; the first failing one is reported."""
    e = table(spark, sf_dir, "events")
    raw = e.select(
        F.when(F.col("event_id") % 97 == 0, "").otherwise(F.col("event_type")).alias("file"), (F.col("event_id") % 11 - 1).alias("line"), (F.col("event_id") % 5).alias("tier"), (F.col("value") / 100).alias("confidence")
    )
    known = e.where("event_type <> 'error'").select(F.col("event_type").alias("file")).distinct().withColumn("n", F.lit(8).cast("bigint"))
    return verify(raw, known).groupBy("reason").agg(F.count("*").alias("n"))


def verify(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence (file, line, tier, confidence) against files (file, n lines), with ``reason``."""
    reason = (
        F.when(F.col("file").isNull() | (F.col("file") == ""), "empty file")
        .when(F.col("line") <= 0, "bad line")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "bad confidence")
        .when(~F.col("tier").between(0, 3), "bad tier")
        .when(F.col("n").isNull(), "no such file")
        .when(F.col("line") > F.col("n"), "line past end")
        .otherwise("ok")
    )
    return evidence.join(files, "file", "left").withColumn("reason", reason).drop("n")


@query("""
WITH paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages),
sole AS (SELECT path, min(page_id) AS resolved FROM paths GROUP BY path HAVING count(DISTINCT page_id) = 1)
SELECT page_id, path, resolved FROM paths JOIN sole USING (path)""")
def unique_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "").alias("path"))
    return R.unique_only(paths, paths, "path", "page_id").select("page_id", "path", "resolved")


@query("""
WITH cand AS (
  SELECT c_custkey, 0 AS tier, s_acctbal, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey
  UNION ALL SELECT c_custkey, 1, s_acctbal, s_suppkey FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN supplier ON s_nationkey = b.n_nationkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, -s_acctbal, s_suppkey) AS r FROM cand)
SELECT c_custkey, CAST(tier AS BIGINT) AS tier, s_suppkey FROM ranked WHERE r = 1""")
def priority_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's best supplier: of its nation, else of its region.

    The best supplier of each nation and region is found first, so customers are joined to
    one row each and never to all suppliers.
    """
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    placed = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("worst", -F.col("s_acctbal"))
    local = R.first_by_priority(placed, ["s_nationkey"], ["worst", "s_suppkey"], []).select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("near"))
    wide = R.first_by_priority(placed, ["n_regionkey"], ["worst", "s_suppkey"], []).select(F.col("n_regionkey").alias("_r"), F.col("s_suppkey").alias("far"))
    homes = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("_r")).join(local, "c_nationkey", "left").join(wide, "_r", "left")
    got = c.join(homes, "c_nationkey").where("near is not null or far is not null")
    return got.select("c_custkey", F.when(F.col("near").isNotNull(), 0).otherwise(1).cast("bigint").alias("tier"), F.coalesce("near", "far").alias("s_suppkey"))


@query(f"""WITH {LINES_SQL}, asked AS (SELECT doc_id, line_no, 'b' || ((line_no - 1) // 8) || '.' || ((line_no - 1) // 4) || '.' || ((line_no - 1) // 2) AS scope FROM lines),
defs AS (SELECT DISTINCT doc_id, 'b' || ((line_no - 1) // 8) || '.' || ((line_no - 1) // 4) AS scope FROM lines WHERE contains(line, 'idiot') UNION SELECT DISTINCT doc_id, 'b' || ((line_no - 1) // 8) FROM lines WHERE contains(line, 'clown')),
chain AS (SELECT doc_id, line_no, scope, 3 AS depth FROM asked UNION ALL SELECT doc_id, line_no, regexp_replace(scope, '[.][^.]*$', ''), 2 FROM asked UNION ALL SELECT doc_id, line_no, regexp_replace(scope, '[.].*$', ''), 1 FROM asked)
SELECT doc_id, line_no, arg_max(scope, depth) AS scope FROM chain JOIN defs USING (doc_id, scope) GROUP BY doc_id, line_no""")
def scope_chain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost enclosing block that defines a word, for every line."""
    ls = lines(table(spark, sf_dir, "documents"))
    n = F.col("line_no") - 1
    b8, b4, b2 = (F.floor(n / k).cast("string") for k in (8, 4, 2))
    asked = ls.select("doc_id", "line_no", F.concat(F.lit("b"), F.concat_ws(".", b8, b4, b2)).alias("scope"))
    inner = ls.where(F.contains("line", F.lit("idiot"))).select("doc_id", F.concat(F.lit("b"), F.concat_ws(".", b8, b4)).alias("scope"))
    outer = ls.where(F.contains("line", F.lit("clown"))).select("doc_id", F.concat(F.lit("b"), b8).alias("scope"))
    defs = inner.unionByName(outer).distinct()
    scopes = F.concat(R.ancestors(F.col("scope"), "[.]"), F.array("scope"))
    dotted = F.transform(scopes, lambda s: F.regexp_replace(s, "\\[\\.\\]", "."))
    chain = asked.select("doc_id", "line_no", F.posexplode(dotted).alias("depth", "scope"))
    return chain.join(defs, ["doc_id", "scope"]).groupBy("doc_id", "line_no").agg(F.max_by("scope", "depth").alias("scope"))


@query("""
WITH has AS (SELECT DISTINCT 'brand:' || p_brand AS cls, p_size AS member FROM part WHERE p_size % 3 = 0 UNION SELECT DISTINCT 'type:' || p_type, p_size FROM part WHERE p_size % 3 = 1 UNION SELECT DISTINCT 'any', p_size FROM part),
asked AS (SELECT p_partkey, 'brand:' || p_brand AS b, 'type:' || p_type AS t, p_size AS member FROM part),
chain AS (SELECT p_partkey, b AS cls, member, 0 AS depth FROM asked UNION ALL SELECT p_partkey, t, member, 1 FROM asked UNION ALL SELECT p_partkey, 'any', member, 2 FROM asked)
SELECT p_partkey, arg_min(cls, depth) AS owner, CAST(min(depth) AS BIGINT) AS depth FROM chain JOIN has USING (cls, member) GROUP BY p_partkey""")
def bounded_member_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's size looked up in its brand, then its type, then anywhere."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("member"), F.concat(F.lit("brand:"), F.col("p_brand")).alias("b"), F.concat(F.lit("type:"), F.col("p_type")).alias("t"))
    pair = lambda cls, cond: p.where(cond).select(cls.alias("cls"), "member").distinct()
    members = pair(F.col("b"), "member % 3 = 0").unionByName(pair(F.col("t"), "member % 3 = 1")).unionByName(pair(F.lit("any"), "true"))
    one = F.concat_ws("|", "b", "t")
    bases = p.select(one.alias("cls"), F.explode(F.array(F.struct(F.col("b").alias("base"), F.lit(0).alias("pos")), F.struct(F.col("t").alias("base"), F.lit(1).alias("pos")), F.struct(F.lit("any").alias("base"), F.lit(2).alias("pos")))).alias("x")).select("cls", "x.*").distinct()
    got = R.member_lookup(p.select(one.alias("cls"), "member").distinct(), bases, members, 1)
    at = F.when(F.col("owner").startswith("brand:"), 0).when(F.col("owner").startswith("type:"), 1).otherwise(2).cast("bigint")
    return p.withColumn("cls", one).join(got.drop("depth"), ["cls", "member"]).select("p_partkey", "owner", at.alias("depth"))


_PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""WITH paths AS (SELECT page_id, {_PATH_SQL} AS path FROM pages), parts AS (SELECT page_id, string_split(path, '/') AS p FROM paths),
up AS (SELECT page_id, array_to_string(p[1:k], '/') AS folder FROM parts, LATERAL (SELECT unnest(generate_series(1, len(p) - 1)) AS k))
SELECT folder, CAST(count(*) AS BIGINT) AS n FROM up GROUP BY folder""")
def containment_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every folder: ancestors are exploded, so containment is an equi-join key."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.explode(R.ancestors(path)).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


@query("""
WITH sel AS (SELECT DISTINCT s_nationkey % 5 AS g, s_nationkey FROM supplier), groups AS (SELECT g, list(s_nationkey ORDER BY s_nationkey)[1:2] AS ks FROM sel GROUP BY g),
labels AS (SELECT c_nationkey % 5 AS g, list(DISTINCT c_nationkey) AS ns FROM customer GROUP BY 1)
SELECT CAST(g AS BIGINT) AS g, len(list_filter(ks, lambda k: NOT list_contains(ns, k))) = 0 AND len(ks) > 0 AS matches FROM groups JOIN labels USING (g)""")
def selector_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors (the first two nations of suppliers) against label maps (nations of customers)."""
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).cast("bigint").alias("g")).agg(F.slice(F.sort_array(F.collect_set("s_nationkey")), 1, 2).alias("ks"))
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).cast("bigint").alias("g")).agg(F.collect_set("c_nationkey").alias("ns"))
    as_map = lambda keys: F.map_from_arrays(F.transform(keys, lambda k: k.cast("string")), F.transform(keys, lambda k: F.lit("yes")))
    return s.join(c, "g").select("g", T.selector_matches(as_map(F.col("ks")), as_map(F.col("ns"))).alias("matches"))


@query(f"WITH {LINES_SQL}, run AS (SELECT doc_id, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS running FROM lines) SELECT doc_id, CAST(count(*) AS BIGINT) AS shown, CAST(max(running) AS BIGINT) AS used FROM run WHERE running <= 500 GROUP BY doc_id")
def running_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = B.running_cut(lines(table(spark, sf_dir, "documents")), ["doc_id"], ["line_no"], F.length("line") + 1, 500)
    return cut.groupBy("doc_id").agg(F.count("*").alias("shown"), F.max("running").alias("used"))


@query("""
WITH RECURSIVE cand AS (SELECT doc_id // 60 AS block, doc_id, (length(text) + 3) // 4 AS cost, row_number() OVER (PARTITION BY doc_id // 60 ORDER BY doc_id) AS r FROM documents),
walk(block, r, used, taken) AS (SELECT DISTINCT block, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM cand UNION ALL
  SELECT c.block, c.r, CASE WHEN used + cost <= 6000 THEN used + cost ELSE used + 10 END, CASE WHEN used + cost <= 6000 THEN list_append(taken, doc_id) ELSE taken END FROM walk JOIN cand c ON c.block = walk.block AND c.r = walk.r + 1)
SELECT CAST(block AS BIGINT) AS block, CAST(arg_max(used, r) AS BIGINT) AS used, array_to_string(arg_max(taken, r), ',') AS taken FROM walk GROUP BY block""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 60 documents in a row packed into 6,000 tokens; a skipped one costs 10."""
    cand = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 60).alias("block"), "doc_id", T.token_estimate(F.col("text")).alias("cost"))
    got = B.greedy_pack(cand, ["block"], ["doc_id"], "doc_id", "cost", 6000, 10)
    return got.select("block", "used", F.array_join(F.transform("taken", lambda x: x.cast("string")), ",").alias("taken"))


LADDER = [(12, 25), (8, 20), (6, 15), (4, 12), (3, 10), (2, 8), (1, 6), (1, 3)]
_LADDER_SQL = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS step, CAST({p} AS BIGINT) AS per_group, CAST({m} AS BIGINT) AS most_groups, CAST(coalesce(sum(c) FILTER (WHERE r <= {p} AND g <= {m}), 0) AS BIGINT) AS cost FROM shown" for i, (p, m) in enumerate(LADDER))


@query(f"""
WITH ranked AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, length(p_name) AS c FROM part),
place AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS g FROM part GROUP BY p_brand), shown AS (SELECT * FROM ranked JOIN place USING (p_brand)), steps AS ({_LADDER_SQL})
SELECT * FROM steps WHERE cost <= 300 ORDER BY step LIMIT 1""")
def budget_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ladder(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], F.length("p_name"), LADDER, 300)


@query("SELECT lang, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


@query("WITH cache AS (SELECT DISTINCT 'text@1:' || source || ':' || sha256(text) AS key FROM documents WHERE lang IN ('en', 'fr')) SELECT doc_id, 'text@1:' || source || ':' || sha256(text) AS key FROM documents WHERE 'text@1:' || source || ':' || sha256(text) NOT IN (SELECT key FROM cache)")
def content_hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose extraction is not in a prior snapshot's cache (that of two languages)."""
    from ..operators.cache import cache_key, missing

    keyed = table(spark, sf_dir, "documents").select("doc_id", "lang", cache_key("text@1", F.col("source"), F.col("text")).alias("key"))
    return missing(keyed, keyed.where(F.col("lang").isin("en", "fr")).select("key"), "key").select("doc_id", "key")


@query("""
WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed' WHEN old.h <> new.h THEN 'changed' ELSE 'same' END AS status, CAST(count(*) AS BIGINT) AS n FROM old FULL JOIN new ON old.doc_id = new.doc_id GROUP BY 1""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed rows of two simulated snapshots."""
    from ..operators.cache import diff

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 7 <> 0")
    new = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return diff(old, new, "doc_id", "text").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^http://', ''), '^[^/]*/', '') AS rel, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM pages WHERE url LIKE 'http://%/%'")
def path_relativize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("url like 'http://%/%'")
    rel = F.regexp_replace(T.relative_path(F.col("url"), "http:/"), "^/?[^/]*/", "")
    return pages.select("page_id", rel.alias("rel"), T.slug(F.col("url")).alias("slug"))


@query("""WITH hrefs AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages)
SELECT page_id, CAST(k AS BIGINT) AS pos, hs[k] AS href, CASE WHEN starts_with(hs[k], 'http') THEN 'external' WHEN starts_with(hs[k], '#') THEN 'anchor' ELSE 'internal' END AS relation FROM hrefs, LATERAL (SELECT unnest(generate_series(1, len(hs))) AS k)""")
def html_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    relation = F.when(F.col("href").startswith("http"), "external").when(F.col("href").startswith("#"), "anchor").otherwise("internal")
    return got.select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "href", relation.alias("relation"))


@query(f"WITH {LINES_SQL} SELECT doc_id, substr(arg_min(line, line_no), 1, 140) AS value FROM lines WHERE regexp_matches(line, '^[A-ZÀ-Þ]') GROUP BY doc_id")
def module_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first top-level line of each document, capped at 140 characters."""
    ls = lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike("^[A-ZÀ-Þ]"))
    return ls.groupBy("doc_id").agg(F.substring(F.min_by("line", "line_no"), 1, 140).alias("value"))


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents WHERE text <> ''), d AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_distinct, arg_min(word, pos) AS first_word, arg_max(word, pos) AS last_new_word, md5(string_agg(word, ' ' ORDER BY pos)) AS words_md5 FROM d GROUP BY doc_id""")
def ordered_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of a whole text in order of first use: their number, the first, the last new one, and a digest of all."""
    words = F.array_distinct(F.split("text", " "))
    rows = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", words.alias("words"))
    return rows.select(
        "doc_id", F.size("words").cast("bigint").alias("n_distinct"), F.col("words")[0].alias("first_word"), F.element_at("words", -1).alias("last_new_word"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5")
    )
