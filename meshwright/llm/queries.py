"""Queries of this subpackage for the driver: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_and_decode
from .common import table
from .fingerprints import fingerprint_documents
from .language_id import identify_languages
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .pii import replace_pii
from .quality_rules import apply_quality_rules, train as train_quality
from .sharding import shuffle_into_shards
from .token_files import read_token_files, write_token_files
from .toxicity import rate_documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_shards(shuffle_into_shards(table(spark, sf_dir, "documents")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_quality_rules(docs, train_quality(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def digest_shards(written: DataFrame) -> DataFrame:
    """The digest of written shards: the records' own size, crc32, shard and slot."""
    from pyspark.sql import functions as F

    return written.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join,
            op2_language_id,
            op3_sharding,
            op4_fingerprints,
            op5_packing,
            op6_bpe,
            op7_token_files,
            op8_quality_rules,
            op9_toxicity,
            op10_pii,
        )
    }


#: All pairs that share a shingle, their links, and the components of these; no trees.
_OP1_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS s FROM split, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y, o = p.n AND o = q.n AS equal FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)),
both_ways AS (SELECT x, y, equal FROM links UNION ALL SELECT y, x, equal FROM links),
walk(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM walk JOIN both_ways ON x = id),
components AS (SELECT id, min(root) AS component_id FROM walk GROUP BY id),
near AS (SELECT x AS id, count(*) AS n_links, count(*) FILTER (WHERE equal) AS n_equal, min(y) FILTER (WHERE equal) AS low FROM both_ways GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, CAST(1 + coalesce(n_equal, 0) AS BIGINT) AS class_size, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents d JOIN components c ON c.id = d.doc_id LEFT JOIN sizes USING (doc_id) LEFT JOIN near ON near.id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """For the query that SQL can express; the others are held against brute force in the tests."""
    return {"op1_ngram_jaccard_join": _OP1_SQL}
