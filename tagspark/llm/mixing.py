"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target over its size is how often each of its documents should be taken on average.
The whole part of that number is taken of every document; the fraction is an inclusion
probability. The flight phase moves the probabilities of three documents at a time along the
null space of two constraints, tokens and documents, until at least one of them is 0 or 1, so
both totals stay exactly as they are. It ends with a dozen undecided documents of a source, for
which the landing phase tries all ways of rounding and takes the one whose tokens come nearest
to the target.

Flights run in blocks of bounded size, in parallel; what a block leaves undecided (two
documents) flies again with the left-overs of other blocks, so each round is a thousandth of
the one before. Longer documents are decided first, so the last ones to land are short.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.llm.common import WORD
from tagspark.sources.staging import stage


# Documents of a source that the landing phase decides.
LANDING = 12


@dataclass(frozen=True)
class Mix:
    # Weights by the place of a source in code point order, repeating.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    # Words of the mix, as a share of all words.
    share: float = 1.5
    # No source, and no document, is taken more often than this.
    most: float = 2.0
    block: int = 4096
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """`(source, source_size, n_docs, target)`, one row a source.

    Targets stop at `most` times the source's size and the excess is shared again by weight.
    In order of `most * size / weight` the sources that stop come first, so one pass of running
    sums finds the level at which the others share the rest. The table has one row per source;
    it is the only one put in one task.
    """
    sizes = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in mix.weights])
    place = (F.row_number().over(by_name) - 1) % len(mix.weights)
    everything = Window.partitionBy()
    by_level = Window.orderBy("_level", "source").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("source_size") * mix.most
    weighed = (
        sizes.withColumn("_weight", F.get(pattern, place))
        .withColumn("_stop", stop)
        .withColumn("_level", F.col("_stop") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * mix.share)
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_stopped", F.coalesce(F.sum("_stop").over(by_level), F.lit(0.0)))
        .withColumn("_stopped_weight", F.coalesce(F.sum("_weight").over(by_level), F.lit(0.0)))
    )
    # The level if all sources before this one stop; it holds for the first it does not exceed.
    level = (F.col("_total") - F.col("_stopped")) / (F.col("_weights") - F.col("_stopped_weight"))
    shared = F.min(F.when(level <= F.col("_level"), F.struct("_level", level.alias("at")))).over(everything)
    target = F.least(F.col("_stop"), F.coalesce(shared["at"] * F.col("_weight"), F.col("_stop")))
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def fly(sizes: np.ndarray, chance: np.ndarray, draw: np.ndarray, leave: int = 2) -> np.ndarray:
    """Move probabilities, keeping their sum and their size-weighted sum, until `leave` are left.

    Documents are taken in the order given. `draw` has a number in [0, 1) per document.
    """
    chance = chance.copy()
    undecided = [k for k in range(len(chance)) if 0.0 < chance[k] < 1.0]
    undecided.reverse()
    now: list[int] = []
    while True:
        while len(now) < 3 and undecided:
            now.append(undecided.pop())
        if len(now) < 3 or len(now) + len(undecided) <= leave:
            return chance
        a, b, c = now
        sa, sb, sc = sizes[a], sizes[b], sizes[c]
        # The null space of (sizes, ones), or of ones alone if the sizes are equal.
        u = (sb - sc, sc - sa, sa - sb)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        ahead = back = math.inf
        for k, step in zip(now, u):
            if step > 0:
                ahead = min(ahead, (1.0 - chance[k]) / step)
                back = min(back, chance[k] / step)
            elif step < 0:
                ahead = min(ahead, chance[k] / -step)
                back = min(back, (1.0 - chance[k]) / -step)
        move = ahead if draw[a] * (ahead + back) < back else -back
        kept = []
        for k, step in zip(now, u):
            p = chance[k] + move * step
            p = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            chance[k] = p
            if 0.0 < p < 1.0:
                kept.append(k)
        now = kept


def land(sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round what is undecided (`LANDING` at most) so that the tokens come nearest to their sum,
    and of equally near ways the one with the nearest number of documents."""
    chance = chance.copy()
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    ways = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    tokens = np.abs(ways @ sizes[open_] - (sizes[open_] * chance[open_]).sum())
    documents = np.abs(ways.sum(1) - chance[open_].sum())
    chance[open_] = ways[np.lexsort((documents, np.round(tokens, 6)))[0]]
    return chance


def flight(rows: DataFrame, mix: Mix, last: bool) -> DataFrame:
    """One round: every (source, block) flies on its own."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "_draw"], ascending=[False, True], ignore_index=True)
        sizes = block["size"].to_numpy(float)
        chance, draw = block["_chance"].to_numpy(float), block["_draw"].to_numpy(float)
        chance = fly(sizes, chance, draw, LANDING if last else 2)
        return block.assign(_chance=land(sizes, chance) if last else chance)

    return rows.groupBy("source", "_block").applyInPandas(run, rows.schema)


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`(doc_id, source, size, source_size, target, copies, taken)`, one row per row of `docs`.

    A null text has no words; null sources are one source, the last; rows with equal ids are
    taken each on their own, by their place in the input; an empty table gives an empty one. Draws
    are hashes of the ids, so reruns agree.
    """
    # Rows that share an id are told apart by their place in the input; where none do, only ids count.
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first() is not None
    row = F.monotonically_increasing_id() if repeated else F.lit(0).cast("long")
    sized = stage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("_row")), "sizes"
    )
    targets = stage(source_targets(sized, mix), "targets")
    largest = targets.agg(F.max("n_docs").alias("n")).first()["n"] or 0
    ratio = F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(mix.most)), F.lit(0.0))
    draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(mix.seed), "_row"), F.lit(2**40)) / 2**40
    # Few rows: one per source, joined on a column of the wide side that can be hot.
    rows = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .select("doc_id", "_row", sized["source"], "size", "source_size", "n_docs", "target", ratio.alias("_ratio"))
        .withColumn("_copies", F.floor("_ratio"))
        .withColumn("_chance", F.col("_ratio") - F.col("_copies"))
        .withColumn("_draw", draw)
    )
    done, n, n_round = [], largest, 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / (mix.block // 2) ** n_round / mix.block))
        last = n <= mix.block
        place = F.lit(0) if last else F.pmod(F.xxhash64("doc_id", "size", F.lit(n_round), "_row"), blocks)
        rows = stage(flight(rows.withColumn("_block", place.cast("long")), mix, last), "flight")
        open_ = (F.col("_chance") > 0) & (F.col("_chance") < 1)
        done.append(rows if last else rows.filter(~open_))
        if last:
            break
        rows, n, n_round = rows.filter(open_).drop("_block"), 2 * -(-n // mix.block), n_round + 1
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    copies = (F.col("_copies") + F.col("_chance")).cast("long")
    return everything.select(
        "doc_id", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """`docs` with every row repeated as often as the mix takes it.

    Rows that share an id are all taken as often as the one taken most.
    """
    copies = (
        mixed.groupBy(F.col("doc_id").alias("_mix_id"))
        .agg(F.max("copies").cast("int").alias("_mix_copies"))
        .filter(F.col("_mix_copies") > 0)
    )
    return (
        docs.join(copies, docs["doc_id"].eqNullSafe(copies["_mix_id"]))
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select(*[docs[c] for c in docs.columns])
    )
