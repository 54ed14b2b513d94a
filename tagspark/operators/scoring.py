"""Scores of all trained tags, the chosen tags, and how good the scores are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.functions.clean import words
from tagspark.functions.losses import soft_f_measure, squared_hinge
from tagspark.operators.joins import lookup, measured_bytes

# Fixed value: a tag is chosen when its score is above this.
THRESHOLD = 0.5
# Tags that are summed together: the generated code of one row stays small enough to be compiled,
# however many tags there are.
BLOCK = 8


@dataclass
class LinearModel:
    """Weights of a batch of tags: `weights(feature_id, w ARRAY<DOUBLE>)`.

    Position r of `w` belongs to `tags[r]`; the row with `feature_id` -1 holds
    the biases.
    """

    weights: DataFrame
    tags: list[str]
    _bytes: int | None = field(default=None, repr=False)

    @property
    def size_bytes(self) -> int:
        if self._bytes is None:
            self._bytes = measured_bytes(self.weights)
        return self._bytes

    def long_form(self) -> DataFrame:
        """`(feature_id, rank, w)`, one row per weight."""
        return self.weights.select("feature_id", F.posexplode("w").alias("rank", "w"))


def targets(
    df: DataFrame, names: Sequence[str], tags: str = "tags", idx: str = "idx"
) -> DataFrame:
    """`(idx, rank, target)`: 1 if the tag is a word of the raw tag string, else -1."""
    row_words = df.select(idx, words(F.col(tags)).alias("_words"))
    flags = [
        F.when(F.array_contains("_words", name), 1).otherwise(-1).alias(f"t{r}")
        for r, name in enumerate(names)
    ]
    return row_words.select(idx, *flags).select(
        idx, F.posexplode(F.array(*[f"t{r}" for r in range(len(names))])).alias("rank", "target")
    )


def label_bits(tags: Column, names: Sequence[str]) -> Column:
    """The targets of up to 63 tags as one long: bit r is set if `names[r]` occurs."""
    if len(names) > 63:
        raise ValueError("a batch has at most 63 tags")
    bits = F.lit(0).cast("long")
    for r, name in enumerate(names):
        has = F.array_contains(words(tags), name)
        bits = bits + F.when(has, F.lit(1 << r)).otherwise(F.lit(0)).cast("long")
    return bits


def label_bit(rank: int | str, labels: str = "labels") -> str:
    """SQL of the target of one tag: 0.0 or 1.0."""
    return f"cast(shiftright({labels}, {rank}) & 1 as double)"


def rank_of(r: int) -> str:
    """SQL of the rank of a block's tag `r`."""
    return f"(block * {BLOCK} + {r})"


def in_blocks(weights: DataFrame, n_tags: int) -> DataFrame:
    """`(feature_id, block, w0 .. w7)` from arrays of all tags; beyond the last tag is 0."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(-(-n_tags // BLOCK), 1) - 1))).alias("block")
    parts = [f"coalesce(get(w, {rank_of(r)}), 0D) as w{r}" for r in range(BLOCK)]
    return weights.select("feature_id", "w", blocks).selectExpr("feature_id", "block", *parts)


def linear_sums(
    features: DataFrame, blocks: DataFrame, dim_bytes: int, keys: Sequence[str]
) -> DataFrame:
    """`keys`, `block` and `z0..z7`: the dot product of each row with each tag's weights.

    `blocks` are weights as `in_blocks` makes them. The join emits one row per feature of a
    document and block of tags. The first key identifies the row; where the features are
    partitioned by it, nothing moves.
    """
    sums = [F.expr(f"sum(value * w{r}) as z{r}") for r in range(BLOCK)]
    rows = features.select(*keys, "feature_id", "value")
    return lookup(rows, blocks, "feature_id", keys[0], dim_bytes).groupBy(*keys, "block").agg(*sums)


def tag_rows(sums: DataFrame, n_tags: int, keys: Sequence[str], value: str = "z") -> DataFrame:
    """`keys, rank, <value>`: one row per tag of the blocks' columns `z0..z7`."""
    pairs = ", ".join(f"struct({rank_of(r)} as rank, z{r} as {value})" for r in range(BLOCK))
    return sums.selectExpr(*keys, f"inline(array({pairs}))").filter(F.col("rank") < n_tags)


def score(features: DataFrame, model: LinearModel, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """`keys` and `scores`, an array by rank. Needs features with the bias row, so
    that a document without any known term gets `sigmoid(bias)`."""
    n = len(model.tags)
    sums = linear_sums(features, in_blocks(model.weights, n), model.size_bytes, keys)
    scores = ", ".join(f"1D / (1D + exp(-z{r}))" for r in range(BLOCK))
    parts = sums.selectExpr(*keys, f"struct(block, array({scores}) as scores) as part")
    ordered = F.array_sort(F.collect_list("part"))
    return parts.groupBy(*keys).agg(ordered.alias("parts")).select(
        *keys, F.slice(F.flatten(F.col("parts.scores")), 1, n).alias("scores")
    )


def score_rows(scored: DataFrame, keys: Sequence[str] = ("idx",)) -> DataFrame:
    """`keys, rank, score`, one row per tag."""
    return scored.select(*keys, F.posexplode("scores").alias("rank", "score"))


def predict_tags(
    scored: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = ("test_idx",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`keys, tags`: names with a score above the threshold in rank order, '' if none."""
    chosen = [
        F.when(F.get("scores", F.lit(r)) > threshold, F.lit(name)) for r, name in enumerate(names)
    ]
    return scored.select(*keys, F.concat_ws(" ", *chosen).alias("tags"))


def f_measure(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`(rank, soft_f, hard_f)` of rows with `scores` and `labels` bits."""
    return f_measure_of_rows(
        scored.select("labels", F.posexplode("scores").alias("rank", "p")), threshold
    )


def f_measure_of_rows(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`(rank, soft_f, hard_f)` of `(labels, rank, p)`, one row per row and tag.

    The pairs are summed in the partition that makes them.
    """
    y = F.expr("(shiftright(labels, rank) & 1)").cast("double")
    pairs = pairs.select("rank", "p", y.alias("y"), (F.col("p") > threshold).cast("double").alias("h"))
    y, p, h = F.col("y"), F.col("p"), F.col("h")
    return pairs.groupBy("rank").agg(
        soft_f_measure(F.sum(y * p), F.sum(y + p)).alias("soft_f"),
        soft_f_measure(F.sum(y * h), F.sum(y + h)).alias("hard_f"),
    )


def eval_margin(outputs: DataFrame, squares: DataFrame, decay: float = 0.001) -> DataFrame:
    """A row per tag for margin outputs `(rank, output, target)`: mean absolute error, mean
    squared hinge, and the penalty `decay * squares / n` of `squares (rank, squares)`."""
    measured = outputs.groupBy("rank").agg(
        F.avg(F.abs(F.col("output") - F.col("target"))).alias("mean_abs_error"),
        F.avg(squared_hinge(F.col("target"), F.col("output"))).alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )
    penalty = F.lit(decay) * F.col("squares") / F.col("n")
    return measured.join(squares, "rank").select("rank", "mean_abs_error", "loss", penalty.alias("penalty"))


def best_iteration(scores: DataFrame) -> DataFrame:
    """`(rank, iteration, score)`: the best scored iteration of each tag, the
    earliest one if several are equal."""
    return scores.groupBy("rank").agg(
        F.min_by("iteration", F.struct(-F.col("score"), F.col("iteration"))).alias("iteration"),
        F.max("score").alias("score"),
    )
