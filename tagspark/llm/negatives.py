"""Hard-negative mining by threshold joins with norm bounds.

Every anchor asks all rows, block by block, for scores of at least its threshold. Within a block
the rows are an inverted index by dimension, least energy first. The leading dimensions of a row
are left out of the index as long as their norm times the largest anchor's cannot reach any
threshold. Postings are summed from the last dimension down; a pair is dropped once its sum and
the norms of what remains stay below the anchor's threshold, and what is left is scored exactly.

Thresholds start high and are lowered for those anchors only whose windows are not full yet: first
for the best rows of the same label, then, under each of these, for rows of other labels. A block
returns at most a window's worth of rows for each window, so a group of copies of any size gives
no more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.sources.staging import stage

# Scores are longs; sums of integers below this are exact in double precision too.
EXACT = 2.0**53
LARGEST = 2**30
# Dimensions that are summed between two looks at the bounds.
STRIP = 16
PAIRS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    # A negative scores at least this many hundredths of the positive, and at most the positive.
    least_percent: int = 80
    block_rows: int = 8192
    chunk_anchors: int = 512
    # First threshold for positives, as a share of the largest possible score, and how it falls.
    first: float = 0.8
    fall: float = 2 / 3
    # Thresholds for negatives, in hundredths of the positive's score, before the least.
    steps: tuple[int, ...] = (95, 88)


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """`(vec_id, label, vector)` of the rows that take part, with `floor(scale * x)` components.

    Rows with a null label, a null vector or any null or non-finite component take no part, nor
    do those with integers beyond 2^30, whose scores would not fit a long.
    """
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.col("label").cast("int").alias("label"), whole.alias("vector")
    )


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros; `width` is at least their length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(width, 1)))
    if len(lengths) and (lengths == lengths[0]).all():
        out[:, : lengths[0]] = flat.reshape(len(lengths), lengths[0])
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def prefix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of the first 0, 1, .. dimensions."""
    squares = np.cumsum(x * x, axis=1)
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), squares], axis=1))


def threshold_pairs(
    q: np.ndarray, t: np.ndarray, x: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(i, k, score)` of all wanted pairs with `q[i] . x[k] >= t[i]`; all values are integers."""
    none = np.empty(0, np.int64)
    if not len(q) or not len(x):
        return none, none, none
    by_energy = np.argsort((x * x).sum(0), kind="stable")
    q, x = q[:, by_energy], x[:, by_energy]
    d = x.shape[1]
    norms_q, norms_x = prefix_norms(q), prefix_norms(x)
    slack = 1e-9 * (1 + norms_q[:, -1].max() * norms_x[:, -1].max())
    # Dimensions before `start` are not indexed.
    covered = norms_x[:, 1:] * norms_q[:, -1].max() < t.min() - slack
    start = covered.sum(1)
    order = np.argsort(start, kind="stable")
    x, norms_x, start, wanted = x[order], norms_x[order], start[order], wanted[:, order]
    indexed = np.where(np.arange(d) >= start[:, None], x, 0.0)
    sums = np.zeros((len(q), len(x)))
    alive = wanted
    every_row = np.arange(len(x))
    for high in range(d, 0, -STRIP):
        low = max(high - STRIP, 0)
        posted = np.searchsorted(start, high)
        sums[:, :posted] += q[:, low:high] @ indexed[:posted, low:high].T
        rest = np.maximum(low, start)
        alive = wanted & (sums + norms_q[:, rest] * norms_x[every_row, rest] >= t[:, None] - slack)
        if alive.mean() < 0.02:
            break
    i, k = np.nonzero(alive)
    exact = q.dtype.type if norms_q[:, -1].max() * norms_x[:, -1].max() < EXACT else np.int64
    q, x = q.astype(exact), x.astype(exact)
    parts = [
        (q[i[at : at + PAIRS_AT_ONCE]] * x[k[at : at + PAIRS_AT_ONCE]]).sum(1).astype(np.int64)
        for at in range(0, len(i), PAIRS_AT_ONCE)
    ]
    score = np.concatenate([none, *parts])
    reached = score >= t[i]
    return i[reached], order[k[reached]], score[reached]


def first_of_groups(group: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    """Places of the first `n` of each group: higher scores first, then smaller ids, null last."""
    order = np.lexsort([ids, ~known, -score, group])
    ordered = group[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
    at = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[at < n]


def blocks_of(rows: DataFrame, anchor: Column, settings: Mining) -> DataFrame:
    """`(block, rows)`, blocks of bounded size, stored; every row has a number of its own."""
    n = max(1, -(-rows.count() // settings.block_rows))
    numbered = rows.select(
        "vec_id", "label", "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("row"),
    )
    packed = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    members = F.collect_list(F.struct("row", "vec_id", "label", "anchor", "vector"))
    return stage(packed.groupBy("block").agg(members.alias("rows")), "blocks")


# An anchor and its windows: rows that score from `low` to `high`, looked for from `t` on.
WINDOWS = "array<struct<low:long,high:long,t:long>>"
FOUND = "row long, window int, other long, other_id long, score long"


def search_blocks(
    blocks: DataFrame, anchors: DataFrame, same_label: bool, n: int, settings: Mining
) -> DataFrame:
    """`(row, window, other, other_id, score)`: per window and block the best `n` rows.

    `anchors (row, label, vector, windows)` are packed into chunks, and each chunk meets every
    block: the chunks of a block follow it in one task, which holds one block and one chunk.
    """
    per_chunk = settings.chunk_anchors
    chunks = max(1, -(-anchors.count() // per_chunk))
    packed = (
        anchors.groupBy(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"))
        .agg(F.collect_list(F.struct("row", "label", "vector", "windows")).alias("asked"))
    )
    numbers = blocks.agg((F.coalesce(F.max("block"), F.lit(-1)) + 1).alias("n")).first()["n"]
    if not numbers:
        return blocks.sparkSession.createDataFrame([], FOUND)
    every = F.explode(F.sequence(F.lit(0), F.lit(numbers - 1)))
    # The chunk's number also orders what meets a block; the block itself comes first.
    feed = blocks.select("block", F.lit(-1).cast("long").alias("chunk"), "rows").unionByName(
        packed.select(every.alias("block"), "chunk", "asked"), allowMissingColumns=True
    )
    feed = feed.repartition(numbers, "block").sortWithinPartitions("block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Array] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                line = batch.slice(at, 1)
                if line.column("chunk")[0].as_py() < 0:
                    held = columns_of(line.column("rows"))
                else:
                    asked = columns_of(line.column("asked"))
                    yield found_in(held, asked, same_label, n)

    return feed.mapInArrow(run, FOUND)


def columns_of(lists: pa.Array) -> dict[str, pa.Array]:
    """The fields of the structs in a list array of one row."""
    structs = lists.flatten()
    return {f.name: structs.field(f.name) for f in structs.type}


def found_in(held: dict, asked: dict, same_label: bool, n: int) -> pa.RecordBatch:
    """What a chunk of anchors finds in a block."""

    def array(column: pa.Array, missing: int = 0) -> np.ndarray:
        return column.fill_null(missing).to_numpy(zero_copy_only=False)

    width = max([0, *(v for c in (held, asked) for v in c["vector"].value_lengths().to_pylist())])
    x, q = matrix(held["vector"], width), matrix(asked["vector"], width)
    rows, asking = array(held["row"]), array(asked["row"])
    alike = array(asked["label"])[:, None] == array(held["label"])[None, :]
    wanted = alike & (asking[:, None] != rows[None, :]) if same_label else ~alike
    lengths = asked["windows"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    windows = asked["windows"].flatten()
    t, low, high = (array(windows.field(f)) for f in ("t", "low", "high"))
    firsts = np.cumsum(lengths) - lengths
    least = np.minimum.reduceat(t, firsts).astype(float) if len(t) else np.empty(0)
    i, k, score = threshold_pairs(q, least, x, wanted)
    # Every pair is looked at for each window of its anchor.
    pair = np.repeat(np.arange(len(i)), lengths[i])
    number = np.arange(len(pair)) - np.repeat(np.cumsum(lengths[i]) - lengths[i], lengths[i])
    window = firsts[i[pair]] + number
    fits = (score[pair] >= np.maximum(t[window], low[window])) & (score[pair] <= high[window])
    pair, number, window = pair[fits], number[fits], window[fits]
    ids = array(held["vec_id"])
    known = ~held["vec_id"].is_null().to_numpy(zero_copy_only=False)
    best = first_of_groups(window, score[pair], ids[k[pair]], known[k[pair]], n)
    pair, number = pair[best], number[best]
    other = k[pair]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(asking[i[pair]], pa.int64()), pa.array(number, pa.int32()),
            pa.array(rows[other], pa.int64()), pa.array(ids[other], pa.int64(), mask=~known[other]),
            pa.array(score[pair], pa.int64()),
        ],
        names=[f.split()[0] for f in FOUND.split(", ")],
    )


def first_rows(found: DataFrame, n: int) -> DataFrame:
    """The first `n` rows of every window, with their `rank` from 1."""
    order = Window.partitionBy("row", "window").orderBy(
        F.desc("score"), F.asc_nulls_last("other_id"), F.asc("other")
    )
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def fill_windows(
    blocks: DataFrame, anchors: DataFrame, same_label: bool, n: int, settings: Mining,
    lower: Callable[[int], Column],
) -> DataFrame:
    """The first `n` rows of each window, lowering thresholds until every window is full or its
    threshold is at its low end.

    `anchors (row, label, vector, windows)` hold what is open; `lower(k)` is the threshold of a
    window `w` after `k` rounds.
    """
    spark = blocks.sparkSession
    done = spark.createDataFrame([], f"{FOUND}, rank int")
    step = 0
    while anchors.first() is not None:
        found = stage(first_rows(search_blocks(blocks, anchors, same_label, n, settings), n), "found")
        counts = found.groupBy("row", "window").agg(F.count(F.lit(1)).alias("n"))
        open_ = (
            anchors.select("row", F.posexplode("windows").alias("window", "w"))
            .join(counts, ["row", "window"], "left")
            .withColumn("full", (F.coalesce("n", F.lit(0)) >= n) | (F.col("w.t") <= F.col("w.low")) | (F.col("w.high") < F.col("w.low")))
        )
        marked = stage(open_.select("row", "window", "w", "full"), "windows")
        closed = marked.filter("full").select("row", "window")
        done = done.unionByName(found.join(closed, ["row", "window"], "left_semi"))
        step += 1
        # A window that is full stays in its place, but can find nothing any more.
        shut = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("low", 1), ("high", 0), ("t", 2**62))])
        next_ = F.struct("w.low", "w.high", F.greatest(F.col("w.low"), lower(step)).alias("t"))
        again = (
            marked.withColumn("w", F.when(F.col("full"), shut).otherwise(next_))
            .groupBy("row")
            .agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("window", "w"))), lambda s: s["w"]
                ).cast(WINDOWS).alias("windows"),
                F.bool_and("full").alias("all"),
            )
            .filter("not all")
            .drop("all")
        )
        anchors = stage(anchors.drop("windows").join(again, "row"), "anchors")
    return done


def hard_negatives(rows: DataFrame, anchor: Column, settings: Mining = Mining()) -> DataFrame:
    """`(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`.

    `rows (vec_id, label, vector)` are integer vectors, as `quantised` makes them; `anchor` is a
    condition on them. The score is the inner product; a missing dimension counts as 0. For each
    anchor its `positives` best other rows of the same label, and for each of these its first
    `negatives` rows of other labels that score at most as much, and at least `least_percent` of
    it. Equal scores are ordered by id, null ids last. Repeated rows count as rows of their own;
    an anchor without positives, or a positive without negatives, gives no row, so a positive
    with a negative score gives none. An empty table gives an empty one.
    """
    blocks = blocks_of(rows, anchor, settings)
    members = blocks.select(F.explode("rows").alias("r")).select("r.*")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    top = members.agg(F.coalesce(F.max(norm), F.lit(0.0)).alias("top")).first()["top"]
    # No score exceeds this, in either direction.
    reach = F.ceil(norm * top) + 1
    window = F.struct(
        (-reach).alias("low"), reach.alias("high"), F.floor(reach * settings.first).alias("t")
    )
    asked = members.filter("anchor").select(
        "row", "label", "vector", F.array(window).cast(WINDOWS).alias("windows")
    )
    asked = stage(asked, "anchors")

    def falling(step: int) -> Column:
        share = settings.first * settings.fall**step
        # Below a tenth, all that is not negative is asked for, and then everything.
        if share >= 0.1:
            return F.floor(F.col("w.high") * share)
        return F.lit(0).cast("long") if share >= 0.1 * settings.fall else F.col("w.low")

    positives = stage(
        fill_windows(blocks, asked, True, settings.positives, settings, falling), "positives"
    )
    least = settings.least_percent
    per_anchor = positives.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("rank", "other_id", "score"))).alias("p")
    )

    first = settings.steps[0] if settings.steps else least
    # The low end is rounded up; a positive below 0 has none that fit.
    low = f"({least} * x.score + 99 - pmod({least} * x.score + 99, 100)) div 100"
    windows = F.expr(
        f"transform(p, x -> struct({low} as low, x.score as high, greatest({first} * x.score, 0) div 100 as t))"
    )
    asked = stage(
        members.filter("anchor").join(per_anchor, "row").select("row", "label", "vector", windows.cast(WINDOWS).alias("windows")),
        "anchors",
    )

    def stepping(step: int) -> Column:
        if step < len(settings.steps):
            return F.expr(f"({settings.steps[step]} * w.high) div 100")
        return F.col("w.low")

    negatives = fill_windows(blocks, asked, False, settings.negatives, settings, stepping)
    ids = members.filter("anchor").select("row", F.col("vec_id").alias("anchor_id"))
    named = positives.select(
        "row", (F.col("rank") - 1).alias("window"), F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return (
        negatives.select("row", "window", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(named, ["row", "window"])
        .join(ids, "row")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
            "negative_id", "positive_score", "negative_score",
        )
    )
