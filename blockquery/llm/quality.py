"""Quality rules as weak supervision, in Spark expressions only.

Rules vote keep (1), reject (-1) or abstain (0) on each document. Expectation-maximisation estimates how
accurate the votes of each rule are on good and on bad documents, and the share of good ones; a document's posterior probability of being good decides. Documents with the same votes have the same posterior, so the estimate runs on the counts of
vote patterns, of which there are at most 3 to the power of the number of rules, whatever the corpus size:
one map-side aggregation, then one row that holds the patterns. All documents past the base rule count.

Per text, everything is one narrow pass of array functions over the whole text: no shuffle of words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockquery.llm.common import Steps

# The white space that separates words, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

ROUNDS = 30
"""Rounds of expectation-maximisation."""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first one included.

    Windows are sorted by two hashes with their position in a field of its own; equal neighbours are compared word by word,
    so hashes that meet by chance do not count. The windows found again, in text order, cover up to three new words each.
    """

    def same(keys: Column, a: Column, b: Column) -> Column:
        x, y = keys[a], keys[b]
        p, q = x["i"], y["i"]
        near = (x["h"] == y["h"]) & (x["g"] == y["g"])
        return near & (words[p] == words[q]) & (words[p + 1] == words[q + 1]) & (words[p + 2] == words[q + 2])

    def window(w: Column, i: Column) -> Column:
        second, third = F.get(words, i + 1), F.get(words, i + 2)
        return F.struct(F.xxhash64(w, second, third).alias("h"), F.hash(third, w, second).alias("g"), i.alias("i"))

    def covered(keys: Column) -> Column:
        found = F.filter(keys, lambda k, i: ((i > 0) & same(keys, F.greatest(i - 1, F.lit(0)), i)) | ((i < F.size(keys) - 1) & same(keys, i, F.least(i + 1, F.size(keys) - 1))))
        places = F.sort_array(F.transform(found, lambda k: k["i"].cast("long")))
        return _let(places, lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, x: F.struct((s["n"] + x + 3 - F.greatest(s["end"], x)).alias("n"), (x + 3).alias("end")), lambda s: s["n"]))

    windows = F.slice(F.transform(words, window), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), covered))


def signals(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts of every row's whole text as long columns, beside ``doc``, a struct of the columns to ``carry``; a NULL text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), text.alias("text"))
    split = base.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = split.withColumn("lines", lines)

    def count(pattern: str) -> Column:
        return F.length("text").cast("long") - F.length(F.regexp_replace("text", pattern, "")).cast("long")

    return split.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count(r"\p{Lu}+").alias("n_upper"),
        count(r"\p{L}+").alias("n_letters"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_shouts"),
        (F.length("text") - F.length(F.translate("text", ".,", ""))).cast("long").alias("n_stops"),
    )


def rules() -> dict[str, Column]:
    """Votes over the columns of ``signals``: 1 keep, -1 reject, 0 abstain. Shares are taken of at least one.

    Each rule looks at one kind of evidence and votes both ways: keep where the text is plainly like prose in that respect,
    reject where it is plainly not, abstain between. So most documents have several votes, and rules meet on them.
    """
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    share = {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "letters": F.col("n_letters") / F.greatest("word_chars", F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "distinct_words": F.col("n_distinct") / words,
        "capitals": F.col("n_upper") / F.greatest("n_letters", F.lit(1)),
        "shouting": F.col("n_shouts") / words,
        "stops": F.col("n_stops") / words,
    }
    # the range in which a rule votes keep, and the wider one outside of which it votes reject
    ranges = {
        "word_length": ((4.5, 6.5), (3.0, 8.0)),
        "symbols": ((0.0, 0.01), (0.0, 0.05)),
        "letters": ((0.9, 1.0), (0.8, 1.0)),
        "repeated_words": ((0.0, 0.1), (0.0, 0.33)),
        "repeated_lines": ((0.0, 0.1), (0.0, 0.4)),
        "distinct_words": ((0.55, 1.0), (0.15, 1.0)),
        "capitals": ((0.0, 0.15), (0.0, 0.4)),
        "shouting": ((0.0, 0.02), (0.0, 0.1)),
        "stops": ((0.04, 0.3), (0.005, 0.6)),
    }
    return {n: F.when(x.between(*ranges[n][0]), F.lit(1)).when(~x.between(*ranges[n][1]), F.lit(-1)).otherwise(F.lit(0)) for n, x in share.items()}


def _posterior(votes: Column, model: Column) -> Column:
    """P(good | votes): log odds of the votes, added up from the prior odds.

    A keep vote weighs how much likelier it is of a good document than of a bad one, a reject vote the reverse. No vote
    counts against what it says: a rule that is no better than chance weighs nothing.
    """

    def weight(vote: Column, j: Column) -> Column:
        keep, reject = model["keep"][j], model["reject"][j]
        for_good = F.greatest(F.log(keep / (1 - reject)), F.lit(0.0))
        for_bad = F.greatest(F.log(reject / (1 - keep)), F.lit(0.0))
        return F.when(vote > 0, for_good).when(vote < 0, -for_bad).otherwise(0.0)

    odds = F.aggregate(F.transform(votes, weight), F.log(model["prior"] / (1 - model["prior"])), lambda s, x: s + x)
    return 1 / (1 + F.exp(-odds))


def _fitted(patterns: DataFrame, n: int, by_class: bool) -> DataFrame:
    """One row with all patterns (``all``) and the fitted ``model``: accuracies ``keep`` and ``reject`` by rule, and ``prior``."""
    counted = F.struct("votes", F.col("rows").cast("double").alias("rows"))
    one = patterns.agg(F.array_sort(F.collect_list(counted)).alias("all"))
    low, high = (0.02, 0.98) if by_class else (0.6, 0.99)

    def within(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(low)), F.lit(high))

    def refit(believed: Column) -> Column:
        def tally(j: Column) -> Column:
            def add(s: Column, p: Column) -> Column:
                vote, good, bad = p["votes"][j], p["good"], p["rows"] - p["good"]
                found = {"good_kept": (vote > 0, good), "good_rejected": (vote < 0, good), "bad_kept": (vote > 0, bad), "bad_rejected": (vote < 0, bad)}
                return F.struct(*[(s[k] + F.when(is_, x).otherwise(0.0)).alias(k) for k, (is_, x) in found.items()])

            def accuracy(s: Column) -> Column:
                good, bad = s["good_kept"] + s["good_rejected"], s["bad_kept"] + s["bad_rejected"]
                if by_class:
                    keep, reject = within((2 + s["good_kept"]) / (3 + good)), within((2 + s["bad_rejected"]) / (3 + bad))
                else:
                    keep = reject = within((2 + s["good_kept"] + s["bad_rejected"]) / (3 + good + bad))
                return F.struct(keep.alias("keep"), reject.alias("reject"))

            zero = F.struct(*[F.lit(0.0).alias(k) for k in ("good_kept", "good_rejected", "bad_kept", "bad_rejected")])
            return F.aggregate(believed, zero, add, accuracy)

        def model(rules_: Column) -> Column:
            good = F.aggregate(believed, F.lit(0.0), lambda s, p: s + p["good"])
            rows = F.aggregate(believed, F.lit(0.0), lambda s, p: s + p["rows"])
            prior = within((1 + good) / (2 + rows)) if by_class else F.lit(0.5)
            return F.struct(rules_["keep"].alias("keep"), rules_["reject"].alias("reject"), prior.alias("prior"))

        return _let(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), tally), model)

    def step(model: Column) -> Column:
        beliefs = F.transform(F.col("all"), lambda p: F.struct(p["votes"].alias("votes"), p["rows"].alias("rows"), (p["rows"] * _posterior(p["votes"], model)).alias("good")))
        return _let(beliefs, refit)

    start = F.struct(F.array_repeat(F.lit(0.8), n).alias("keep"), F.array_repeat(F.lit(0.8), n).alias("reject"), F.lit(0.5).alias("prior"))
    return one.select("all", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda m, _: step(m)).alias("model"))


def vote_posteriors(patterns: DataFrame, n: int, by_class: bool = False) -> DataFrame:
    """``(votes, posterior)`` for counted vote patterns ``(votes array<int>, rows)``.

    Expectation: the posterior of each pattern. Maximisation: a rule's accuracy is the mean belief in its
    votes, where it votes, smoothed by two right votes of three. ``ROUNDS`` times from an accuracy of 0.8 for each. All patterns
    stand in one row: at most ``3 ** n``.

    By default a rule has one accuracy, kept within 0.6 and 0.99 (rules are better than chance, and none is always
    right), and both classes are as likely. With ``by_class`` it has one on good and one on bad documents, kept within
    0.02 and 0.98, and the share of good documents is estimated as well, so a rule that votes keep on nearly everything
    weighs next to nothing. Patterns of no rows take no part in the estimate, but get a posterior.
    """
    placed = _fitted(patterns, n, by_class).select(F.explode("all").alias("p"), "model")
    return placed.select("p.votes", _posterior(F.col("p.votes"), F.col("model")).alias("posterior"))


def rule_accuracies(patterns: DataFrame, n: int) -> DataFrame:
    """``(rule, keep, reject, prior)`` of counted vote patterns: what ``vote_posteriors`` estimates by class.

    ``keep`` is how often the rule's votes on good documents say keep, ``reject`` how often those on bad ones say reject.
    """
    model = _fitted(patterns, n, True).select("model.*")
    both = model.select("prior", F.posexplode(F.arrays_zip("keep", "reject")).alias("rule", "of"))
    return both.select("rule", "of.keep", "of.reject", "prior")


def vote_patterns(judged: DataFrame) -> DataFrame:
    """``(votes, rows)``: every pattern of votes, with the number of rows past the base rule that have it."""
    return judged.groupBy("votes").agg(F.count_if(~F.col("base_failed")).alias("rows"))


def weak_quality(docs: DataFrame, carry: Sequence[str] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``signals`` of every row with ``base_failed``, ``votes``, ``posterior`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated windows. ``kept`` is false
    for those; for others the posterior decides, whose estimate rests on the votes of all others. Empty and NULL texts fail. Each row is judged on its own,
    repeated rows and NULL ids too; no row is dropped. Columns in ``carry`` come back in the struct ``doc``, whatever
    their names; others are not read. An empty table gives none.
    """
    votes = F.array(*rules().values())
    counted = signals(docs, carry).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    counted = Steps(docs.sparkSession, "quality").keep(counted.withColumn("votes", votes))
    verdicts = vote_posteriors(vote_patterns(counted), len(rules()), by_class=True)
    return counted.join(verdicts, "votes").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
