"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

Terms are a text's words with their frequency as weight. For each of ``SAMPLES`` samples
and each term of weight s, with r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) drawn from a hash
of term and sample (Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1
Sketching", 2010):

    t = floor(ln s / r + b),  ln y = r (t - b),  ln a = ln c - ln y - r

and the sample is the (term, t) of least ln a. Two texts agree in a sample with probability
sum of minima / sum of maxima of their weights. ln a and a hash of (term, t) travel in one
long (the order of longs is the order of ln a), so a sample is a plain ``min``.

The samples of a term depend on the term and its weight alone, so they are drawn once for
all texts of a bucket that have the term equally often.

The share of equal samples has a standard error of sqrt(p (1 - p) / SAMPLES) at likeness p:
with 64 samples at most 0.063, and 0.050 at 0.8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import order_buckets

SAMPLES, BUCKET_BYTES = 64, 8 << 20
#: Resolution and range of ln a in the upper part of the packed long.
_SCALE, _LEAST, _LOW_BITS = 1 << 24, 48, 32
_ODD = 0x2545F491
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def _unit(h: Column, shift: int) -> Column:
    """A number in (0, 1] from 21 bits of a hash."""
    bits = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) if shift else h.bitwiseAND(F.lit((1 << 21) - 1))
    return (bits.cast("double") + F.lit(1.0)) * F.lit(1.0 / (1 << 21))


def packed_sample(term: Column, log_weight: Column, sample: int) -> Column:
    """ln a (upper bits) and a hash of (term, t) (lower 32 bits) of one term in one sample."""
    h, g = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))
    r = -F.log(_unit(h, 0) * _unit(h, 21))
    r = F.greatest(r, F.lit(1e-6))  # so that t times _ODD stays a long
    b = _unit(h, 42)
    log_c = F.log(-F.log(_unit(g, 0) * _unit(g, 21)) + F.lit(1e-12))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    upper = F.floor((F.greatest(F.least(log_a, F.lit(float(_LEAST))), F.lit(-float(_LEAST))) + F.lit(float(_LEAST))) * F.lit(float(_SCALE)))
    # h is of term and sample; an odd product of t makes its low bits a hash of all three
    lower = h.bitwiseXOR(t * F.lit(_ODD)).bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return F.shiftleft(upper.cast("bigint"), _LOW_BITS).bitwiseOR(lower)


def _fingerprint(mins: list[Column]) -> Column:
    """The low 32 bits of each sample as an array of ints: half the size of their digits, which are made at the end."""
    return F.array(*(F.shiftright(F.shiftleft(m, 64 - _LOW_BITS), 64 - _LOW_BITS).cast("int") for m in mins))


def _digits(ints: Column) -> Column:
    """Eight hex digits of each sample; empty for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(ints, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))), 8, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two arrays, an estimate of generalised Jaccard; 1 for two without words (null)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same / F.lit(float(samples)))


def sign_terms(texts: DataFrame, keys: list[str], samples: int = SAMPLES, within: int = 0) -> DataFrame:
    """``keys`` and m0, m1, ...: the packed samples of each row of ``texts`` that has a word.

    ``texts`` has the keys, which tell rows apart, and ``text``. Samples are drawn once for
    all rows of the same first ``within`` keys that have a term equally often; if ``texts``
    is already dealt by some of those, nothing is shuffled.
    """
    own, rest = keys[:within], keys[within:]
    words = texts.select(*keys, F.explode(F.split("text", WORD_SPLIT)).alias("_word")).where("_word <> ''")
    terms = words.select(*keys, F.xxhash64("_word").alias("_term")).groupBy(*keys, "_term").agg(F.count("*").alias("_n"))
    shared = terms.groupBy(*own, "_term", "_n").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    drawn = F.array(*(packed_sample(F.col("_term"), F.log(F.col("_n").cast("double")), i) for i in range(samples)))
    each = shared.select(*own, "_rows", drawn.alias("_drawn")).select(*own, F.explode("_rows").alias("_row"), "_drawn").select(*own, "_row.*", "_drawn")
    return each.groupBy(*keys).agg(*(F.min(F.col("_drawn")[i]).alias(f"m{i}") for i in range(samples)))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are taken in descending doc_id (nulls last, equal ids by text); the next of the
    last is the first. The edited text has its last floor(n_chars / 2) code points replaced
    by the first as many (or all) of the next row's text. A null text counts as empty.
    Equal texts have equal fingerprints; a text without words has the empty one, which is
    like itself (1.0) and unlike others (0.0). A single row is its own next. An empty table
    gives no rows; other columns are ignored.

    Rows are dealt once, into buckets of consecutive ids; the first row of a bucket is also
    given to the bucket before as a ghost, so that every row meets its next there.
    """
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    buckets = order_buckets(docs, "doc_id", bucket_bytes, least=2 * int(parts), in_steps=False)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = buckets.column("doc_id")
    # ids at which a bucket begins when read downwards: the largest of each bucket is the ghost of the bucket above
    tops = base.select("doc_id", own.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    top_of = {int(r.bucket): r.top for r in tops.collect()}  # one short row for each of at most MOST_BOUNDS buckets
    filled = sorted(top_of)
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    ghost_in: Column = F.lit(None).cast("bigint")
    if filled:
        lookup = F.create_map(*(F.lit(x) for b in filled for x in (b, above[b])))
        top = F.create_map(*(F.lit(x) for b in filled if top_of[b] is not None for x in (b, int(top_of[b])))) if any(v is not None for v in top_of.values()) else None
        is_top = F.col("doc_id").eqNullSafe(F.try_element_at(top, own.cast("int")) if top is not None else F.lit(None))
        ghost_in = F.when(is_top, F.try_element_at(lookup, own.cast("int")).cast("bigint"))
    dealt = base.withColumn("_in", F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("ghost")), F.when(ghost_in.isNotNull(), F.struct(ghost_in.alias("bucket"), F.lit(1).alias("ghost"))))))
    dealt = dealt.select("doc_id", "text", F.explode("_in").alias("_in")).select("doc_id", "text", F.col("_in.bucket").cast("int").alias("bucket"), "_in.ghost")
    # just one bucket for each task: terms take far more room than the texts, so two that meet by hash would spill
    dealt = dealt.repartitionById(buckets.number, F.col("bucket"))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = dealt.withColumn("rn", F.row_number().over(w)).withColumn("_next", F.lead("text").over(w))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    both = rows.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("_t"), "ghost")
    both = both.where("ghost = 0 or _t.which = 0").select("bucket", "rn", "_t.which", "_t.text")
    signed = sign_terms(both, ["bucket", "rn", "which"], samples, within=1)
    prints = signed.select("bucket", "rn", "which", _fingerprint([F.col(f"m{i}") for i in range(samples)]).alias("fp"))
    pair = prints.groupBy("bucket", "rn").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    facts = rows.select("bucket", "rn", "ghost", "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    joined = facts.join(pair, ["bucket", "rn"], "left")
    joined = joined.withColumn("_nfp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn")))
    return joined.where("ghost = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _digits(F.col("fp")).alias("fingerprint"),
        _digits(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp"), samples).alias("near_edited"),
        likeness(F.col("fp"), F.col("_nfp"), samples).alias("near_next"),
    )
