"""The corpus pipeline: from documents to packed sequences, each stage one operator of blockquery.llm.

Every stage takes what the stage before kept and returns the columns of its input, all but the last one,
which returns pieces in sequences. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm import packing, private_data, quality, repeats, simhash
from blockquery.llm.common import Steps


def _in_one(docs: DataFrame) -> DataFrame:
    """``row``, the whole row, beside ``doc_id`` and ``text``: other columns of any name or type meet no name of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _with_text(docs: DataFrame, changed: DataFrame, text: F.Column) -> DataFrame:
    """The columns of ``docs`` from ``row``, with another text, and its length in ``n_chars`` where there is such a column."""
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return changed.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the posterior of the votes rejects go; NULL and empty texts do."""
    return quality.weak_quality(docs, carry=docs.columns).filter("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints differ in 2 bits or fewer, directly or by way of others, the one of smallest id stays.

    Fingerprints are those of ``op1_simhash``: 3-word shingles, 64 bits.

    Of several texts of that id, the one of smallest hash stays; rows that repeat both its id and its text are one
    document and stay with it. Only a group without any id keeps a row without one, and exactly one.
    """
    found = simhash.near_rows(docs, words=3, radius=2, parts=4)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    gone = found.filter(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    rows = _in_one(docs).withColumn("key", simhash.text_key())
    # rows without an id and of the same text cannot be told apart: one stands for all, before the others are removed
    whole = F.min_by("row", F.xxhash64(F.col("row").cast("string"))).alias("row")
    nameless = rows.filter("doc_id IS NULL").groupBy("key").agg(whole).select("row", F.col("row.doc_id").alias("doc_id"), "key")
    rows = rows.filter("doc_id IS NOT NULL").select("row", "doc_id", "key").union(nameless)
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti").select("row.*")


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that a document of smaller id has too, in strings of 50 bytes or more, goes."""
    return _with_text(docs, repeats.without_repeats(_in_one(docs), as_text=True), F.col("_kept"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _with_text(docs, private_data.redacted(_in_one(docs), private_data.fit(docs)), F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048), size=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("redaction", redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no form for the fitted votes, the trees and best-fit packing; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of a folder."""
    steps = Steps(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = steps.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
