"""Evaluation queries: medians, votes, recall, rankings, run records, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import budget as B
from ..sources.entity_graph import EDGES_SQL, edges
from ..operators.graph import degree
from .registry import query, table


@query("WITH m AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY ALL) SELECT event_type, CAST(median(m) AS DOUBLE) AS median, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY event_type")
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.median_of_medians(table(spark, sf_dir, "events"), "event_type", "user_id", "value")


_VOTES = "CAST(quality = 1 AS INT) + CAST(toxic = 0 AS INT) + CAST(n_chars > 1000 AS INT)"


@query(f"SELECT doc_id, ({_VOTES}) * 2 > 3 AS accepted FROM labels JOIN documents USING (doc_id)")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", A.majority(F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") > 1000).alias("accepted"))


@query("""
WITH j AS (SELECT lang, quality = 0 AS t, contains(text, '!!') OR contains(text, '%%%') OR contains(text, ' | ') AS f FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (WHERE t AND f) AS tp, count(*) FILTER (WHERE NOT t AND f) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn FROM j GROUP BY lang)
SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision FROM c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    found = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("%%%")) | F.contains("text", F.lit(" | "))
    return A.recall_precision(rows, ["lang"], F.col("quality") == 0, found)


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem WHERE l_quantity > 25), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount > 0.05)
SELECT 'hit' AS verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'extra', CAST(count(*) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'miss', CAST(count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def site_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    site = lambda cond: items.where(cond).select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
    return A.site_differences(site("l_quantity > 25"), site("l_discount > 0.05")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'dynamic' WHEN value < 10 THEN 'builtin' WHEN value < 50 THEN 'library' ELSE 'other' END AS cause, CAST(count(*) AS BIGINT) AS n,
  array_to_string(list(event_id ORDER BY event_id)[1:6], ',') AS examples FROM events GROUP BY 1""")
def relation_bucketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved calls by cause, six examples each; only six rows of a bucket are gathered."""
    cause = F.when(F.col("event_type") == "error", "dynamic").when(F.col("value") < 10, "builtin").when(F.col("value") < 50, "library").otherwise("other")
    rows = table(spark, sf_dir, "events").select(cause.alias("cause"), "event_id")
    six = A.top_of_group(rows, ["cause"], ["event_id"], 6).groupBy("cause").agg(F.sort_array(F.collect_list("event_id")).alias("e"))
    text = F.array_join(F.transform("e", lambda x: x.cast("string")), ",")
    return rows.groupBy("cause").agg(F.count("*").alias("n")).join(six, "cause").select("cause", "n", text.alias("examples"))


NEEDLES = [("anodized", "datastore"), ("economy", "queue"), ("promo", "gateway"), ("o", "service")]


@query("SELECT p_type, CASE WHEN contains(lower(p_type), 'anodized') THEN 'datastore' WHEN contains(lower(p_type), 'economy') THEN 'queue' WHEN contains(lower(p_type), 'promo') THEN 'gateway' WHEN contains(lower(p_type), 'o') THEN 'service' ELSE 'unknown' END AS kind, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL")
def image_kind_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type", T.first_match(F.col("p_type"), NEEDLES, "unknown").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""
WITH {EDGES_SQL}, links AS (SELECT DISTINCT src, dst, relation FROM edges), deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id),
scored AS (SELECT p_brand, p_partkey, degree + CASE WHEN p_type = 'PROMO' THEN 5 ELSE 0 END + CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS score FROM part JOIN deg ON id = 'part:' || p_partkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM scored)
SELECT p_brand, p_partkey, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 3""")
def repo_map_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("id", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    deg = degree(edges(spark, sf_dir).where("relation = 'contains'"))
    score = F.col("degree") + F.when(F.col("p_type") == "PROMO", 5).otherwise(0) + F.when(F.col("p_size") > 25, 2).otherwise(0)
    scored = parts.join(deg, "id").select("p_brand", "p_partkey", score.alias("score"))
    return A.top_of_group(scored, ["p_brand"], [F.desc("score"), F.col("p_partkey")], 3)


@query("SELECT e.event_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS latest FROM events e WHERE e.event_type = 'purchase'")
def event_enclosing_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    got = A.latest_before(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'").select("user_id", "ts"), "user_id", "ts")
    return got.select("event_id", "latest")


@query("""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), ok AS (SELECT lang, min(rank) AS best FROM r JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang)
SELECT CAST(count(*) FILTER (WHERE best <= 3) AS DOUBLE) / count(*) AS top3, CAST(count(*) AS BIGINT) AS n FROM ok""")
def top3_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of queries (languages) whose first accepted document is among the top three."""
    docs = table(spark, sf_dir, "documents").select("lang", F.struct((-F.col("n_chars")).alias("less"), "doc_id").alias("place"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("_good"))
    # the first accepted document of each language, then how many of all come no later: both combine map-side
    first = docs.join(good, F.col("place.doc_id") == F.col("_good")).groupBy("lang").agg(F.min("place").alias("first")).withColumnRenamed("lang", "_lang")
    best = docs.join(first, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("_lang").agg(F.count_if(F.col("place") <= F.col("first")).alias("best"))
    return best.agg((F.count_if(F.col("best") <= 3).cast("double") / F.count("*")).alias("top3"), F.count("*").alias("n"))


@query("SELECT doc_id, len(list_filter(['the', 'and', 'of'], lambda r: contains(text, r))) = 3 AS covered FROM documents")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all required strings are in an answer."""
    need = F.array(F.lit("the"), F.lit("and"), F.lit("of"))
    return table(spark, sf_dir, "documents").select("doc_id", F.forall(need, lambda r: F.contains("text", r)).alias("covered"))


@query("SELECT lang, CAST(max((length(text) + 3) // 4) AS BIGINT) AS most, CAST(median((length(text) + 3) // 4) AS DOUBLE) AS median, CAST(count(*) FILTER (WHERE (length(text) + 3) // 4 > 2000) AS BIGINT) AS over_budget FROM documents GROUP BY lang")
def size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = T.token_estimate(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("lang", size.alias("t"))
    return rows.groupBy("lang").agg(F.max("t").alias("most"), F.median("t").alias("median"), F.count_if(F.col("t") > 2000).alias("over_budget"))


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(count(DISTINCT md5(text)) AS BIGINT) AS messages, CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT) AS answered, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id""")
def session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's events folded into a run record."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("messages"), F.sum(F.when(F.col("role") == "assistant", F.length("text"))).cast("bigint").alias("answered"), F.min_by("role", "turn").alias("first_role")
    )


@query("SELECT c.conv_id, c.turn AS call, min(r.turn) AS result FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn > c.turn WHERE c.role = 'user' GROUP BY ALL")
def calls_joined_to_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return A.pair_calls(rows, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant")


@query("WITH q AS (SELECT lang, source, sum(n_chars) AS whole, sum(least(n_chars, 2000)) AS pack FROM documents GROUP BY ALL) SELECT lang, round(median(CAST(whole AS DOUBLE) / pack), 9) AS ratio FROM q GROUP BY lang")
def pack_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-file size over pack size, the median over sources."""
    q = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("whole"), F.sum(F.least("n_chars", F.lit(2000))).alias("pack"))
    return q.groupBy("lang").agg(F.round(F.median(F.col("whole").cast("double") / F.col("pack")), 9).alias("ratio"))


@query("WITH want AS (SELECT DISTINCT lang, source FROM documents, (SELECT 1)), grid AS (SELECT l.lang, s.source, r.rep FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s, (SELECT unnest([0, 1, 2]) AS rep) r), done AS (SELECT lang, source, doc_id % 3 AS rep FROM documents GROUP BY ALL HAVING max(n_chars) * count(*) >= 4 * sum(n_chars)) SELECT lang, source, CAST(rep AS BIGINT) AS rep FROM grid WHERE (lang, source, rep) NOT IN (SELECT (lang, source, rep) FROM done)")
def resumable_job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question x arm x repetition, less what is saved: a grid of small dimensions, then an anti join."""
    docs = table(spark, sf_dir, "documents")
    reps = F.explode(F.array(*(F.lit(r).cast("bigint") for r in range(3)))).alias("rep")
    arms = docs.agg(F.array_sort(F.collect_set("source")).alias("sources"))
    grid = docs.select("lang").distinct().crossJoin(F.broadcast(arms)).select("lang", F.explode("sources").alias("source")).select("lang", "source", reps)
    # as if saved: jobs whose longest document is four times the mean
    jobs = docs.groupBy("lang", "source", (F.col("doc_id") % 3).alias("rep"))
    done = jobs.agg((F.max("n_chars") * F.count("*") >= 4 * F.sum("n_chars")).alias("saved")).where("saved").drop("saved")
    return grid.join(done, ["lang", "source", "rep"], "left_anti")


_PACK_BUDGET = 6000


@query("""
WITH RECURSIVE s AS (SELECT doc_id, length(text) AS len, len(regexp_extract_all(lower(text), 'licensed')) AS hits, sha256(text) AS h FROM documents),
once AS (SELECT min(doc_id) AS doc_id, any_value(hits) AS hits, any_value(len) AS len FROM s WHERE hits > 0 GROUP BY h),
cand AS (SELECT doc_id, (len + 3) // 4 AS cost, row_number() OVER (ORDER BY hits DESC, doc_id) AS r FROM once ORDER BY r LIMIT 40),
walk(r, used, doc_id, full_text) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false UNION ALL
 SELECT c.r, CASE WHEN used + cost <= 6000 THEN used + cost ELSE used + 12 END, c.doc_id, used + cost <= 6000 FROM walk JOIN cand c ON c.r = walk.r + 1)
SELECT doc_id, full_text, CAST(used AS BIGINT) AS used FROM walk WHERE doc_id IS NOT NULL AND full_text""")
def context_pack_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents, one of each set of copies, best first, packed whole while they fit."""
    docs = table(spark, sf_dir, "documents")
    s = docs.select("doc_id", F.length("text").alias("len"), F.size(F.regexp_extract_all(F.lower("text"), F.lit("licensed"), F.lit(0))).alias("hits"), F.sha2(F.col("text").cast("binary"), 256).alias("h")).where("hits > 0")
    once = s.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("hits").alias("hits"), F.max("len").alias("len"))
    cand = once.select("doc_id", (-F.col("hits")).alias("worst"), F.floor((F.col("len") + 3) / 4).alias("cost")).orderBy("worst", "doc_id").limit(40)
    got = B.greedy_pack(cand, [], ["worst", "doc_id"], "doc_id", "cost", _PACK_BUDGET, 12)
    # what was used when each was taken: replayed over at most 40 candidates
    items = cand.agg(F.sort_array(F.collect_list(F.struct("worst", "doc_id", "cost"))).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<doc_id:bigint,full_text:boolean,used:bigint>>").alias("out"))

    def step(acc, x):
        fits = acc["used"] + x["cost"] <= _PACK_BUDGET
        used = F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"] + 12)
        return F.struct(used.alias("used"), F.array_append(acc["out"], F.struct(x["doc_id"].alias("doc_id"), fits.alias("full_text"), used.alias("used"))).alias("out"))

    trail = items.select(F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select("x.*").where("full_text")
    return trail.join(got.select(F.explode("taken").alias("doc_id")), "doc_id", "left_semi")


@query("""
WITH a AS (SELECT conv_id, turn, md5(text) AS h FROM conversations), b AS (SELECT conv_id, turn, md5(reverse(reverse(text))) AS h FROM conversations)
SELECT CAST(count(*) FILTER (WHERE a.h = b.h) AS BIGINT) AS equal, CAST(count(*) AS BIGINT) AS n FROM a JOIN b USING (conv_id, turn)""")
def outputs_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two runs of the same calls, compared call by call."""
    rows = table(spark, sf_dir, "conversations")
    digest = lambda c: F.md5(c.cast("binary"))
    one = rows.select("conv_id", "turn", digest(F.col("text")).alias("a"))
    two = rows.select("conv_id", "turn", digest(F.reverse(F.reverse("text"))).alias("b"))
    return one.join(two, ["conv_id", "turn"]).agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count("*").alias("n"))


@query("""
WITH runs AS (SELECT d.lang AS arm, d.source AS question, d.n_chars AS cost, l.quality = 1 AS correct FROM documents d JOIN labels l USING (doc_id)),
arms AS (SELECT arm, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS quality, median(cost) AS cost FROM runs GROUP BY arm),
won AS (SELECT arm, question, bool_or(correct) AS any_right FROM runs GROUP BY ALL), base AS (SELECT question FROM won WHERE arm = 'en' AND any_right),
lost AS (SELECT a.arm, count(*) AS lost FROM arms a CROSS JOIN base b LEFT JOIN won w ON w.arm = a.arm AND w.question = b.question WHERE NOT coalesce(w.any_right, false) GROUP BY a.arm)
SELECT a.arm, a.quality >= b.quality AND a.cost <= 0.7 * b.cost AND coalesce(l.lost, 0) = 0 AS passes, CAST(coalesce(l.lost, 0) AS BIGINT) AS lost
FROM arms a JOIN arms b ON b.arm = 'en' LEFT JOIN lost l ON l.arm = a.arm""")
def pass_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each arm (language) is as good as the base arm at 0.7 times its median cost, with no question lost."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("arm"), F.col("source").alias("question"), F.col("n_chars").alias("cost"))
    runs = runs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct")), "doc_id")
    arms = runs.groupBy("arm").agg(F.avg(F.col("correct").cast("int")).alias("quality"), F.median("cost").alias("cost"))
    won = runs.groupBy("arm", "question").agg(F.bool_or("correct").alias("any_right")).where("any_right")
    base = arms.where("arm = 'en'").select(F.col("quality").alias("base_quality"), F.col("cost").alias("base_cost"))
    # questions the base arm answered, less those the arm answered too: both are counted by question, not by run
    wanted = won.where("arm = 'en'").select("question")
    asked = wanted.agg(F.count("*").alias("asked"))
    kept = won.join(wanted, "question", "left_semi").groupBy("arm").agg(F.count("*").alias("kept"))
    lost = (F.col("asked") - F.coalesce("kept", F.lit(0))).alias("lost")
    judged = arms.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(asked)).join(kept, "arm", "left").select("*", lost)  # one row each
    return judged.select("arm", ((F.col("quality") >= F.col("base_quality")) & (F.col("cost") <= 0.7 * F.col("base_cost")) & (F.col("lost") == 0)).alias("passes"), "lost")
