"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from blockquery.llm import alignment, byte_bpe, language_model, languages, neighbours, packing, private_data, quality, repeats, simhash, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of fingerprints of 3-word shingles at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=3, radius=2, parts=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of each text, the base rule, and the verdict of the votes."""
    found = quality.weak_quality(table(spark, folder, "documents"))
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all others."""
    vectors = table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of each text by a model that has not seen the held-out documents."""
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    verdict = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", verdict)


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of each text and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_decode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of each text by unigram counts and by the model."""
    return language_model.score(table(spark, folder, "documents"))


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives of all pages say when they are read back."""
    return warc.round_trip(table(spark, folder, "pages"), min_bytes=0)


# base32 of a SHA-1 in hexadecimal digits: five of them are four letters
SQL["op7_warc"] = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM rows GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
 CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM rows JOIN firsts USING (h)"""


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    cut = packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)
    return packing.pack(cut, size=2048)


@query
def op9_private_data(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of each text: counts and digest of the base kinds, and all spans."""
    docs = table(spark, folder, "documents")
    found = private_data.find(docs, private_data.fit(docs))

    def text(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*private_data.BASE))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in private_data.BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query
def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each text without the strings that a document of smaller id has too."""
    found = repeats.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


@query
def op11_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each text by machines that have not seen the held-out documents."""
    docs = table(spark, folder, "documents")
    model = languages.fit(docs.filter(~languages.held_out(F.col("doc_id"))))
    found = languages.predict(docs, model)
    return found.select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over each text, and how often the corpus has the links."""
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(table(spark, folder, "documents"), *paths, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Four whitened components of every vector; a deviation that a long cannot hold is NULL there, and whole in its text."""
    found = whitening.whiten(table(spark, folder, "embeddings"), k=4)
    exact = F.col("deviation").alias("deviation_text")
    deviation = F.expr("try_cast(deviation AS BIGINT)").alias("deviation")
    return found.select("vec_id", "component", "n", deviation, "whitened", "explained", "identity_error", exact)
