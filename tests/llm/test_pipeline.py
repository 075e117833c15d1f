"""The pipeline on a small table, against a plain version of what each stage does."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from blockquery.llm import packing, private_data
from tests.llm import frames
from tests.llm.test_operators import encoded, groups, plain_fingerprint, plain_kept, smallest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [r for r in frames.rows()]
    rows += [(200, "## $$ %% " * 60, "en", "s", 0), (201, "STOP!! NOW!! " * 40, "en", "s", 0), (202, frames.text(120, 900) + " mail to me.too@example.org or +1 (269) 555-3296 now", "en", "s", 0)]
    path = tmp_path_factory.mktemp("pipeline")
    frames.documents(spark, rows).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, folder).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and not ids & {27, 28, 29, 30, 31, 200, 201} and ids >= {2, 3, 22, 25, 202}

    single = corpus_pipeline.near_dedup(spark, kept, folder).cache()
    rows = kept.collect()

    prints = [plain_fingerprint(encoded(r.text), 3) for r in rows]
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    expected = sorted(str(tuple(r)) for r, least in zip(rows, smallest([r.doc_id for r in rows], root)) if r.doc_id == least)
    assert single.columns == columns and sorted(str(tuple(r)) for r in single.collect()) == expected

    cut = corpus_pipeline.repeat_dedup(spark, single, folder).cache()
    plain = {i: text.decode() for i, text, _, _ in plain_kept([(r.doc_id, encoded(r.text)) for r in single.collect()])}
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == plain
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = corpus_pipeline.redaction(spark, cut, folder).cache()
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and "[EMAIL] or [PHONE] now" in by_id[202]
    assert not any(private_data.base_spans(t) for t in by_id.values())
    assert all(by_id[i] == plain[i] for i in by_id if not re.search("[0-9@]", plain[i]))

    packed = corpus_pipeline.best_fit_packing(spark, clean, folder).collect()
    words = packing.WordIds(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(ids) + 1 for i, ids in zip(by_id, words.ids([encoded(t) for t in by_id.values()]))}
    found = defaultdict(int)
    for r in packed:
        found[r.doc_id] += r.length
    times = Counter(r.doc_id for r in clean.collect())  # rows that share an id are all packed
    assert dict(found) == {i: n * times[i] for i, n in lengths.items()}


def test_near_dedup_of_missing_and_shared_ids(spark, folder):
    def near(text):
        """The text with another end, at one or two bits."""
        ends = (f"{text} end {i}" for i in range(1000))
        return next(t for t in ends if 1 <= (plain_fingerprint(encoded(t), 3) ^ plain_fingerprint(encoded(text), 3)).bit_count() <= 2)

    a, b, c, d, e = (frames.text(100, 950 + i) for i in range(5))
    rows = [(1, a), (None, near(a)), (None, b), (None, b), (None, near(b)), (None, c), (5, near(a)), (5, d), (7, e), (7, near(e)), (8, near(d))]
    docs = frames.documents(spark, [(i, t, "en", "s", 0) for i, t in rows])
    found = corpus_pipeline.near_dedup(spark, docs, folder)
    kept = [(r.doc_id, r.text) for r in found.collect()]
    one_of = {b: {b, near(b)}, e: {e, near(e)}}
    assert found.columns == docs.columns and len(kept) == 5
    assert {(1, a), (None, c), (5, d)} <= set(kept)
    assert sum(i is None and t in one_of[b] for i, t in kept) == 1 and sum(i == 7 and t in one_of[e] for i, t in kept) == 1


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
