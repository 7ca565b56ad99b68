"""Ranked search: postings, BM25, fuzzy scores, and the cascade that resolves a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import identifier_words, tokens

#: Okapi BM25's usual parameters: saturation, length weight, floor of negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): the inverted index."""
    words = docs.select(key, F.explode(tokens(F.col(text))).alias("token"))
    return words.groupBy(key, "token").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """(key, score) of documents with a query token; a repeated query token counts again.

    ``key`` is unique. Weights are ln(N - df + 0.5) - ln(df + 0.5); a negative one is EPSILON
    times the mean weight of all tokens of the corpus. Document frequencies combine map-side
    over each text's distinct tokens; of the postings only those of query tokens are made.
    """
    spark = docs.sparkSession
    words = docs.select(key, tokens(F.col(text)).alias("_words"))
    corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("_words")).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("_words")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighed = df.crossJoin(F.broadcast(corpus)).withColumn("raw", raw)  # one row of statistics
    terms = _query_frame(spark, query)
    # query words and, in the row without a token, the mean over all: one pass over the frequencies
    asked = F.when(F.col("token").isin(*set(query)), F.col("token"))
    kept = weighed.groupBy(asked.alias("token")).agg(F.sum("raw").alias("raw"), F.count("*").alias("number"), F.first("avgdl").alias("avgdl"))
    mean = kept.agg((F.sum("raw") / F.sum("number")).alias("mean"))
    idf = kept.join(F.broadcast(terms), "token").crossJoin(F.broadcast(mean)).select(
        "token", "times", "avgdl", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf")
    )
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    at = words.select(key, F.size("_words").cast("bigint").alias("dl"), F.explode(F.filter("_words", lambda w: w.isin(*set(query)))).alias("token"))
    hits = at.groupBy(key, "dl", "token").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "token").select(key, "token", part.alias("part"))
    # a fixed order of summation
    return hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token", "part"))).alias("p")).select(
        key, F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("score")
    )


def _query_frame(spark: SparkSession, query: list[str]) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in query] or [("",)], "token string")
    return words.where("token <> ''").groupBy("token").agg(F.count("*").alias("times"))


def overlaps(text: Column, query: list[str]) -> Column:
    """Whether a text has any query token."""
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, query)))


#: What a match in each field of a symbol is worth.
FIELD_WEIGHTS = {"name": 3.0, "qual": 2.0, "route": 2.0, "file": 1.5, "doc": 1.0, "dir": 0.5}


def _prefix_of(word: str):
    """Whether a field word begins with ``word``, or is a long enough beginning of it."""
    return lambda x: (F.lit(len(word) >= 3) & x.startswith(word)) | ((F.length(x) >= 4) & F.lit(word).startswith(x))


def fuzzy_score(fields: dict[str, Column], query: list[str]) -> Column:
    """The symbol score of query words against fields.

    Each word takes its best field: a whole word the field's weight, a prefix (of three
    characters or more; a field word of four may be the prefix too) 0.6 of it. A compact
    name equal to the compact query adds 6, one that begins with it 2; failing both, a
    single query word of five characters or more inside the name adds 3. The sum is scaled
    by the share of words that matched.
    """
    total, matched = F.lit(0.0), F.lit(0)
    for w in query:
        best = F.lit(0.0)
        for field, col in fields.items():
            words = identifier_words(F.coalesce(col, F.lit("")))
            weight = FIELD_WEIGHTS[field]
            whole = F.array_contains(words, w)
            prefix = F.exists(words, _prefix_of(w))
            best = F.greatest(best, F.when(whole, F.lit(weight)).when(prefix, F.lit(weight * 0.6)).otherwise(F.lit(0.0)))
        total = total + best
        matched = matched + F.when(best > 0, 1).otherwise(0)
    compact = F.regexp_replace(F.lower(fields["name"]), "[^a-z0-9]", "")
    goal = "".join(query)
    bonus = F.when(compact == goal, F.lit(6.0)).when(compact.startswith(goal), F.lit(2.0))
    if len(query) == 1 and len(goal) >= 5:
        bonus = bonus.when(F.contains(compact, F.lit(goal)), F.lit(3.0))
    return (total + bonus.otherwise(F.lit(0.0))) * matched / F.lit(len(query))


def clear_winner(hits: DataFrame, ratio: float = 1.5) -> DataFrame:
    """The top hit with ``winner``: it stands alone or scores ``ratio`` times the second."""
    top = hits.orderBy(F.desc("score"), "id").limit(2)
    w = Window.orderBy(F.desc("score"), "id")
    ranked = top.withColumn("second", F.lead("score").over(w)).withColumn("rank", F.row_number().over(w))
    return ranked.where("rank = 1").select("id", "score", (F.col("second").isNull() | (F.col("score") >= ratio * F.col("second"))).alias("winner"))


def resolve_cascade(symbols: DataFrame, tiers: list[Column], order: list[Column]) -> DataFrame:
    """Symbols of the first tier that matches anything; ``status`` ok for one, else ambiguous."""
    tier = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(tiers))):
        tier = F.when(cond, F.lit(i)).otherwise(tier)
    hits = symbols.withColumn("tier", tier).where("tier is not null")
    best = hits.agg(F.min("tier").alias("_best"))
    won = hits.join(F.broadcast(best), F.col("tier") == F.col("_best")).drop("_best")
    n = won.agg(F.count("*").alias("_n"))
    return won.crossJoin(F.broadcast(n)).withColumn("status", F.when(F.col("_n") == 1, "ok").otherwise("ambiguous")).drop("_n").orderBy(*order)


def enclosing(points: DataFrame, spans: DataFrame, key: str, at: str = "line_no") -> DataFrame:
    """Each point with the span that holds it and starts last; ties go to the greatest span id.

    Spans are (key, first, last, span). Points without one are left out.
    """
    hit = points.join(spans, (points[key] == spans[key]) & (F.col(at) >= F.col("first")) & (F.col(at) <= F.col("last"))).drop(spans[key])
    return hit.groupBy(*points.columns).agg(F.max_by("span", F.struct("first", "span")).alias("span"))
