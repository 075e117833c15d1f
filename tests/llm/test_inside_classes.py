"""Inside a class, the language model predicts a word from what stands before it."""

import numpy as np

from blockquery.llm import language_model


def test_words_of_a_class_are_told_apart_by_context(spark):
    """``aaxx`` and ``bbxx`` are equally frequent and of one class; which of the two comes next depends on the word before."""
    fill = " ".join(f"f{i}" for i in range(language_model.TOP))
    right, wrong = ["one aaxx", "two bbxx"], ["one bbxx", "two aaxx"]
    train = " ".join(f"{fill} {fill} {fill} {right[k % 2]}" for k in range(200))
    # crc32 of 6 and 29 is divisible by 10, of the others it is not
    rows = [(i, train) for i in (1, 2, 3, 4, 5, 7)] + [(6, f"{fill} {right[0]} {fill} {right[1]}"), (29, f"{fill} {wrong[0]} {fill} {wrong[1]}")]
    found = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, r in sorted(found.items()) if r.held_out] == [6, 29]
    assert abs(found[6].base_score - found[29].base_score) < 1e-9
    assert found[6].score > found[29].score + 0.2


def head(counts, rest, seed=6):
    """Frequent words of given counts, the first of them classes of their own, and ``rest`` other words, once each, in every class."""
    rng = np.random.default_rng(seed)
    top, classes = language_model.TOP, language_model.CLASSES
    counts = np.sort(np.asarray(counts, np.int64))[::-1]
    of = np.append(np.arange(top), rng.integers(top, classes - 1, len(counts) - top))  # none in the last class
    total = np.bincount(of, counts, classes).astype(np.int64)
    distinct = np.bincount(of, minlength=classes)
    total[top:] += rest
    distinct[top:] += rest
    hashes = np.sort(rng.integers(0, 1 << 62, len(counts)).astype(np.uint64))
    return language_model.Head(hashes, counts, of, int(total.sum()), int(distinct.sum()), total, distinct)


def test_leaves_of_a_class_sum_to_one():
    rng = np.random.default_rng(1)
    words = head(rng.zipf(1.4, 3000).clip(max=10**9), 7)
    inside = language_model.trees(words)
    others = np.arange(language_model.TOP, language_model.CLASSES)
    classes = np.append(words.classes, others)
    place = np.append(np.arange(len(words.counts)), np.full(len(others), -1))
    token, decision, side = inside.paths(place, classes)
    plain = np.append(words.counts + 0.1, inside.rest_weight[others]) / words.class_weight()[classes]
    features = np.tile(rng.integers(0, 1 << 63, 4).astype(np.uint64), (len(place), 1))
    slots = language_model._slots(features, token, decision)
    for weights in (np.zeros(language_model.SLOTS, np.float32), rng.normal(size=language_model.SLOTS).astype(np.float32)):
        odds = language_model._log_odds(inside, weights, slots, decision).astype(float)
        p = np.exp(-np.bincount(token, np.logaddexp(0, np.where(side, -odds, odds)), len(place)))
        assert np.allclose(np.bincount(classes, p)[others], 1)
        if not weights.any():
            assert np.allclose(p[classes >= language_model.TOP], plain[classes >= language_model.TOP], rtol=1e-4)
    assert not np.isin(token, np.flatnonzero(classes < language_model.TOP)).any()
