"""From documents to packed training sequences, in five stages of whole-table operators.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept, and returns
a DataFrame that is written as Parquet and read again. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwright.llm.common import fold, table
from meshwright.llm.language_id import predict_language, train as train_language
from meshwright.llm.ngram_join import keep_one_of_each
from meshwright.llm.packing import pack_documents
from meshwright.llm.pii import replace_pii
from meshwright.llm.quality_rules import apply_quality_rules, train as train_quality
from meshwright.operators.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line model keep."""
    field = train_quality(docs, table(spark, sf_dir, "labels"))
    return apply_quality_rules(docs, field, docs.columns).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told without doubt: neither ``und`` nor flagged as ambiguous."""
    model = train_language(docs, ~F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    return predict_language(docs, model, docs.columns).where("not ambiguous").select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return replace_pii(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, with their ids."""
    return pack_documents(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", ngram_join), ("PII", pii), ("packing", packing)]

#: Trained models and iterative joins: not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
