"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on figures of the whole
text.  Expectation-maximisation over all documents' votes estimates for each
rule how often its vote on a good document is right and how often its vote on a
bad one is; a document is kept if its posterior probability of being good
reaches one half.  The votes are counted by pattern first (at most 3 to the
number of rules, whatever the corpus), so the estimation itself works on a
small table.

Defined results: null and empty texts have no words and fail the base rules; a
text of any length is split once, within its row; rows are judged each, with or
without an id, repeated or not; with no documents, nothing is fitted and
nothing returned; ties at one half are kept; extra columns of any name are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store

SPACE = "[\\x20\\x09-\\x0D]"
SHINGLE = 8
POOLING = 0.5
BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and the figures that the base and the rules use."""
    text = F.col("_t")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select(
        "doc_id",
        words_of(text).alias("_w"),
        lines.alias("_l"),
        (F.length(text) - count(SPACE)).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count("[^\\p{L}\\x20\\x09-\\x0D]").alias("n_other"),
        count("\\p{Lu}").alias("n_upper"),
        count("[.,](?![^\\x20\\x09-\\x0D])").alias("n_stops"),
        count("[!?]").alias("n_calls"),
    )
    df = df.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        *(c for c in df.columns if c[0] != "_" and c != "doc_id"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(SHINGLE)))
    starts = F.when(F.size("_h") >= SHINGLE, F.sequence(F.lit(0), F.size("_h") - SHINGLE))
    df = df.withColumn("_h", F.coalesce(F.transform(starts, window), F.array().cast("array<bigint>")))
    sorted_ = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(twice, sorted_)).drop("_h")
    same = lambda x, k: F.get("_s", k)["h"] == x["h"]
    again = F.filter("_s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    df = df.withColumn("_s", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_s",
        F.struct(F.lit(0).alias("n"), F.lit(-SHINGLE).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(SHINGLE), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The voting rules, over the figures."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    c = F.col
    return {
        "length": _vote(c("n_words") < 30, c("n_words") >= 60),
        "word_length": _vote((c("word_chars") < 3 * n) | (c("word_chars") > 13 * n), c("word_chars").between(4 * n, 10 * n)),
        "symbols": _vote(10 * c("n_symbols") > n, 100 * c("n_symbols") <= n),
        "letters": _vote(100 * c("n_other") > 18 * chars, 100 * c("n_other") <= 10 * chars),
        "capitals": _vote(10 * c("n_upper") > 3 * chars, 100 * c("n_upper") <= 12 * chars),
        "stops": _vote(100 * c("n_stops") < n, 100 * c("n_stops") >= 4 * n),
        "marks": _vote(10 * (c("n_symbols") + c("n_calls")) > n, 100 * (c("n_symbols") + c("n_calls")) <= n),
        "plain": _vote(100 * (c("n_other") + c("n_upper")) > 25 * chars, 100 * (c("n_other") + c("n_upper")) <= 18 * chars),
        "calls": _vote(10 * c("n_calls") > n, 100 * c("n_calls") <= n),
        "lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), c("n_dup_lines") == 0),
        "repeats": _vote(10 * c("n_repeat_words") > 3 * n, 100 * c("n_repeat_words") <= 5 * n),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, pooling: float = POOLING) -> tuple[float, list[float], list[float]]:
    """Share of good documents, and how often each rule's vote on a bad one and on a good one is right.

    Bad documents are bad in different ways, each of which few rules see; so a
    rule's rate on them is drawn to the rate of all rules, by a prior that
    counts as ``pooling`` times the votes of all bad documents.  Every estimate
    is smoothed, and a rule is right on good documents more often than not, so
    that the classes keep their names.
    """
    kinds = len(patterns[0][0]) if patterns else 0
    share, caught, right = 0.8, [0.4] * kinds, [0.95] * kinds
    for _ in range(rounds):
        good = bad = 0.0
        on, ok, voted, accused = ([0.0] * kinds for _ in range(4))
        for votes, n in patterns:
            p = posterior(votes, share, caught, right)
            good += n * p
            bad += n * (1 - p)
            for r, v in enumerate(votes):
                if v:
                    on[r] += n * p
                    ok[r] += n * p * (v > 0)
                    voted[r] += n * (1 - p)
                    accused[r] += n * (1 - p) * (v < 0)
        share = min(max((good + 8) / (good + bad + 10), 0.05), 0.99)
        pooled = (sum(accused) + 4) / (sum(voted) + 10)
        weight = pooling * bad + 10
        caught = [min(max((k + weight * pooled) / (n + weight), 0.02), 0.98) for k, n in zip(accused, voted, strict=True)]
        right = [min(max((k + 1.9) / (n + 2), 0.6), 0.995) for k, n in zip(ok, on, strict=True)]
    return share, caught, right


def _weights(good: float, caught: float) -> tuple[float, float]:
    """Log-odds for good of a rule's good and bad vote."""
    return math.log(good) - math.log(1 - caught), math.log(1 - good) - math.log(caught)


def posterior(votes: tuple[int, ...], share: float, caught: list[float], right: list[float]) -> float:
    """Probability that a document with these votes is good."""
    odds = math.log(share) - math.log(1 - share)
    for v, bad, good in zip(votes, caught, right, strict=True):
        if v:
            odds += _weights(good, bad)[v < 0]
    return 1 / (1 + math.exp(-max(min(odds, 500.0), -500.0)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base figures, base_failed, quality (posterior) and kept of each row."""
    named = rules()
    seen = store.save(figures(docs).select("doc_id", "n_words", *BASE, *(v.alias(f"_{k}") for k, v in named.items())), "votes")
    votes = [f"_{k}" for k in named]
    patterns = sorted((tuple(r[v] for v in votes), r["count"]) for r in seen.groupBy(*votes).count().collect())
    share, caught, right = estimate(patterns)
    odds = F.lit(math.log(share) - math.log(1 - share))
    for v, bad, good in zip(votes, caught, right, strict=True) if patterns else ():
        plus, minus = _weights(good, bad)
        odds = odds + F.when(F.col(v) > 0, plus).when(F.col(v) < 0, minus).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-odds))
    return seen.select("doc_id", "n_words", *BASE, failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= 0.5)).alias("kept"))
