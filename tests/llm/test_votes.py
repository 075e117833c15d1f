"""The vote model gives back what was planted, and its rules meet on documents."""

import json

import pytest
from pyspark.sql import functions as F

from blockquery.llm import quality

PLANTED = [(0.9, 0.8, 0.9), (0.7, 0.75, 0.6), (0.95, 0.9, 0.5), (0.8, 0.6, 0.8), (0.85, 0.85, 0.7), (0.99, 0.05, 0.95)]
"""(accuracy on good documents, on bad ones, share of documents voted on): the last rule votes keep on nearly everything."""
PRIOR = 0.7


@pytest.fixture(scope="module")
def planted(spark):
    """Documents with a known class, and votes of the planted accuracies; each draw is a hash of its own."""

    def draw(salt):
        return (F.xxhash64(F.col("id"), F.lit(salt)).bitwiseAND((1 << 40) - 1) / float(1 << 40)).cast("double")

    data = spark.range(120_000).withColumn("good", draw("class") < PRIOR)
    votes = []
    for j, (keep, reject, voted) in enumerate(PLANTED):
        right = draw(f"right{j}") < F.when(F.col("good"), keep).otherwise(reject)
        votes.append(F.when(draw(f"voted{j}") >= voted, 0).when(right == F.col("good"), 1).otherwise(-1))
    return data.withColumn("votes", F.array(*votes)).cache()


def test_planted_accuracies_come_back(planted):
    patterns = planted.groupBy("votes").agg(F.count("*").alias("rows"))
    found = quality.rule_accuracies(patterns, len(PLANTED)).orderBy("rule").collect()
    assert len(found) == len(PLANTED)
    for r, (keep, reject, _) in zip(found, PLANTED):
        assert r.keep == pytest.approx(keep, abs=0.05) and r.reject == pytest.approx(reject, abs=0.05)
        assert r.prior == pytest.approx(PRIOR, abs=0.05)


def test_verdicts_beat_the_best_rule_and_the_majority(planted):
    patterns = planted.groupBy("votes").agg(F.count("*").alias("rows"))
    judged = planted.join(quality.vote_posteriors(patterns, len(PLANTED), by_class=True), "votes")
    majority = F.aggregate("votes", F.lit(0), lambda s, v: s + v) >= 0
    single = [F.get("votes", j) >= 0 for j in range(len(PLANTED))]
    rates = judged.agg(*[F.avg((v == F.col("good")).cast("int")) for v in [F.col("posterior") >= 0.5, majority, *single]]).first()
    assert rates[0] > max(rates[1:]) + 0.02


def test_calibrated(planted):
    """Of documents with a posterior about p, a share of about p is good."""
    patterns = planted.groupBy("votes").agg(F.count("*").alias("rows"))
    judged = planted.join(quality.vote_posteriors(patterns, len(PLANTED), by_class=True), "votes")
    bins = judged.groupBy(F.floor(F.col("posterior") * 5).alias("bin")).agg(F.avg("posterior").alias("p"), F.avg(F.col("good").cast("int")).alias("share"), F.count("*").alias("n"))
    for r in bins.filter("n > 1000").collect():
        assert r.share == pytest.approx(r.p, abs=0.05)


def test_no_rows_and_patterns_of_no_rows(spark):
    empty = spark.createDataFrame([], "votes array<int>, rows long")
    assert quality.vote_posteriors(empty, 3, by_class=True).count() == 0
    unseen = spark.createDataFrame([([1, 1, 0], 0), ([-1, -1, 0], 0), ([0, 0, 0], 0)], "votes array<int>, rows long")
    found = {tuple(r.votes): r.posterior for r in quality.vote_posteriors(unseen, 3, by_class=True).collect()}
    assert found[1, 1, 0] > 0.5 > found[-1, -1, 0] and found[0, 0, 0] == pytest.approx(0.5)


def test_rules_meet_on_documents_and_agree_with_labels(spark):
    """On the given documents: several votes each, votes both ways, and verdicts that the labels share."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.weak_quality(docs).filter("NOT base_failed").cache()
    n = judged.count()
    assert judged.filter(F.size(F.filter("votes", lambda v: v != 0)) >= 2).count() > 0.9 * n
    assert judged.filter(F.array_contains("votes", 1) & F.array_contains("votes", -1)).count() > 0
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    both = judged.select("doc.doc_id", "kept").join(labels, "doc_id")
    counts = {(r.kept, r.quality): r["count"] for r in both.groupBy("kept", "quality").count().collect()}
    assert counts.get((False, 1), 0) <= 0.01 * counts[True, 1], json.dumps(str(counts))
    assert counts[False, 0] >= 0.9 * (counts[False, 0] + counts.get((True, 0), 0)), json.dumps(str(counts))
