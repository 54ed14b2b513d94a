"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Every rule looks at one statistic of a text and votes good, bad or abstains. No rule is
trusted as it is: expectation-maximisation over the vote patterns estimates how each rule
votes on good and on bad texts, and a text is kept if its posterior probability of being
good reaches a threshold.

All is DataFrame work. A text's statistics are computed inside its row, without a shuffle.
The only shuffle counts vote patterns, of which there are at most 3 ** rules at any size;
the iterations run over that table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.llm.common import small_stage, words_of
from tagspark.sources.staging import stage

GOOD, BAD, ABSTAIN = 1, -1, 0
VOTES = (BAD, ABSTAIN, GOOD)
# Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio: bad beyond `bad`, good within `good`, else abstains.

    Bounds are closed intervals (low, high); a rule without `good` only finds bad texts. A null
    ratio abstains.
    """

    name: str
    ratio: str
    good: tuple[float, float] | None
    bad: tuple[tuple[float, float], ...]

    def vote(self) -> Column:
        value = F.expr(self.ratio)
        bad = F.lit(False)
        for low, high in self.bad:
            bad = bad | value.between(low, high)
        vote = F.when(bad, BAD)
        if self.good is not None:
            vote = vote.when(value.between(*self.good), GOOD)
        return vote.otherwise(ABSTAIN).cast("int").alias(f"v_{self.name}")


INF = float("inf")
RULES = (
    Rule("symbols", "try_divide(n_symbols, n_words)", None, ((0.2, INF),)),
    Rule("shouting", "try_divide(n_upper, word_chars)", None, ((0.3, INF),)),
    Rule("lines", "try_divide(n_dup_lines, n_lines)", None, ((0.4, INF),)),
    Rule("repeats", "try_divide(n_repeat_words, n_words)", (0, 0.1), ((0.4, INF),)),
    Rule("word_length", "try_divide(word_chars, n_words)", None, ((0, 2.5), (11, INF))),
    Rule("sentences", "try_divide(n_ends, n_words)", (0.02, 0.4), ((0, 0.005), (0.6, INF))),
)


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_repeat_percent: int = 50
    iterations: int = 20
    keep_at: float = 0.5
    # What is believed before any text is seen: the share of good texts, and per class how often
    # a rule votes bad and good. `trust` is the weight of that belief, as a share of the texts;
    # it keeps the two classes from trading places.
    prior: float = 0.8
    bad_votes: tuple[float, float] = (0.001, 0.2)
    good_votes: tuple[float, float] = (0.6, 0.5)
    trust: float = 0.1


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`(<keep>, n_words, word_chars, ...)`: the statistics the rules look at.

    `keep` names columns of `docs` to carry along. A null text has no words. `n_repeat_words`
    counts the words that lie in a 3-word window found at least twice; windows are compared by a 64-bit hash of their words.
    """
    text = F.coalesce("text", F.lit(""))
    # `words`, `windows` and `runs` are used more than once each, which keeps them computed once.
    split = docs.select(*keep, text.alias("text")).withColumn("words", words_of(F.col("text")))
    windows = F.expr(
        "case when size(words) >= 3 then transform(sequence(0, size(words) - 3),"
        " i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))"
        " else array() end"
    )
    counted = split.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_replace("text", rf"[^\p{{Lu}}{SYMBOLS}.!?]+", "").alias("marks"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window are sorted to find which ones repeat.
    sorted_runs = counted.select(
        "*",
        F.length(F.regexp_replace("marks", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("marks", r"\P{Lu}+", "")).alias("n_upper"),
        F.length(F.regexp_replace("marks", "[^.!?]+", "")).alias("n_ends"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "case when size(array_distinct(windows)) < size(windows)"
            " then sort_array(transform(windows, (h, i) -> struct(h, i))) else array() end"
        ).alias("runs"),
    ).drop("windows", "lines", "marks")
    covered = F.expr(
        "size(array_distinct(flatten(transform(filter(runs, (r, k) ->"
        " r.h <=> get(runs, k - 1).h or r.h <=> get(runs, k + 1).h),"
        " r -> array(r.i, r.i + 1, r.i + 2)))))"
    )
    return sorted_runs.withColumn(
        "n_repeat_words", F.when(F.size("runs") > 0, covered).otherwise(0).cast("long")
    ).drop("runs")


def estimate(patterns: DataFrame, rules: tuple[Rule, ...], settings: Settings) -> dict:
    """Expectation-maximisation over `(v_<rule>..., n)`, at most 3 ** rules rows.

    Returns the share of good texts and, per rule, vote and class, the probability of the vote.
    """
    votes = [f"v_{r.name}" for r in rules]
    belief = {}
    for rule in rules:
        good_votes = settings.good_votes if rule.good is not None else (1e-4, 1e-4)
        belief[f"v_{rule.name}"] = {
            BAD: settings.bad_votes,
            GOOD: good_votes,
            ABSTAIN: tuple(1 - b - g for b, g in zip(settings.bad_votes, good_votes)),
        }
    model = {"prior": settings.prior, "p": belief}
    for _ in range(settings.iterations):
        weighed = patterns.withColumn("_good", F.col("n") * posterior(model))
        sums = [F.sum("n").alias("n"), F.sum("_good").alias("good")]
        for v in votes:
            for vote in VOTES:
                cast = F.col(v) == vote
                sums.append(F.sum(F.when(cast, F.col("_good")).otherwise(0)).alias(f"g_{v}_{vote}"))
                sums.append(F.sum(F.when(cast, F.col("n")).otherwise(0)).alias(f"n_{v}_{vote}"))
        row = weighed.agg(*sums).first()
        if not row["n"]:
            return model
        good, bad = row["good"], row["n"] - row["good"]
        weight = settings.trust * row["n"] + 1
        believed = (weight * settings.prior, weight * (1 - settings.prior))
        p = {}
        for v in votes:
            p[v] = {}
            for vote in VOTES:
                in_good = row[f"g_{v}_{vote}"]
                in_bad = max(row[f"n_{v}_{vote}"] - in_good, 0.0)
                p[v][vote] = (
                    (in_good + believed[0] * belief[v][vote][0]) / (good + believed[0]),
                    (in_bad + believed[1] * belief[v][vote][1]) / (bad + believed[1]),
                )
        model = {"prior": (good + believed[0]) / (row["n"] + weight), "p": p}
    return model


def posterior(model: dict) -> Column:
    """Probability of a good text given its votes."""
    prior = min(max(model["prior"], 1e-9), 1 - 1e-9)
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, table in model["p"].items():
        term = F.lit(0.0)
        for vote, (good, bad) in table.items():
            term = F.when(F.col(v) == vote, math.log(good / bad)).otherwise(term)
        odds = odds + term
    return 1 / (1 + F.exp(-odds))


def judge_quality(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    settings: Settings = Settings(),
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per row of `docs (doc_id, text, ...)`: statistics, votes, `quality`, `kept`.

    `base_failed` (too few words, or mostly repeated ones) is never kept; it takes no part in
    the estimation. Null and empty texts have no words and so fail. Repeated rows are judged
    alike, each on its own; a null `doc_id` stays null; an empty table gives no rows. Other
    columns of `docs` are not looked at; those that `keep` names are carried along.
    """
    failed = (F.col("n_words") < settings.min_words) | (
        100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words")
    )
    judged = stage(
        text_statistics(docs, keep).withColumn("base_failed", failed).select("*", *[r.vote() for r in rules]),
        "quality",
    )
    votes = [f"v_{r.name}" for r in rules]
    counts = judged.filter(~F.col("base_failed")).groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    model = estimate(small_stage(counts, "votes"), rules, settings)
    quality = F.when(F.col("base_failed"), 0.0).otherwise(posterior(model))
    return judged.withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= settings.keep_at)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the votes keep, with all their columns, each judged on its own.

    The rows travel with their statistics, so that no text is shuffled to meet its verdict.
    """
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    return judge_quality(whole, keep=("_row",)).filter("kept").select("_row.*")
