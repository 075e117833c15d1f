"""Stages of the pipeline on documents whose other columns have the operators' own names, or types without an order."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import frames

NAMES = ["_gone", "_kept", "_n_removed", "gone_id", "key", "row", "doc", "_doc", "text_key"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_clashing_names_and_maps(spark, tmp_path, stage):
    text = frames.text(100, 71)
    rows = [(1, text), (2, text), (None, text + " once more"), (None, frames.text(90, 72)), (None, frames.text(90, 72)), (4, None), (5, frames.text(80, 73))]
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.withColumns({n: F.col("doc_id") * 10 for n in NAMES} | {"a map": F.create_map(F.lit("k"), F.col("doc_id"))})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = stage[1](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    seen = found.collect()
    assert seen
    for r in seen:
        assert r["_gone"] == r["_kept"] == r["row"] == (None if r.doc_id is None else 10 * r.doc_id)
        assert r["a map"] == {"k": r.doc_id}
    expected = stage[1](spark, docs.select(plain.columns), str(tmp_path)).collect()
    assert sorted(map(str, expected)) == sorted(str(r) for r in found.select(plain.columns).collect())
