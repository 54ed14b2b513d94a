"""Row positions, ranges, segments and running totals without a single-task sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.sources.staging import cut

# monotonically_increasing_id keeps the row number in its lower bits.
_ROW_BITS = 33
# Key ranges of a running total; also the most rows its small side can have.
RANGES = 16384


def with_row_index(
    df: DataFrame,
    *keys: str | Column,
    name: str = "row_index",
    start_sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add the 0-based position in the order of `keys`, which must be unique.

    The rows are range-partitioned and sorted once and the result is stored,
    so that positions never depend on a second sampling. Only one count per
    partition is brought together. `start_sums` maps new columns to the
    columns whose sum over all rows before they hold.
    """
    start_sums = dict(start_sums or {})
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _ROW_BITS))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(source).alias(f"_sum_{new}") for new, source in start_sums.items()],
    )
    # One row per partition.
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[
            F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_sum_{new}")
            for new in start_sums
        ],
    )
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_rows") + F.col("_at")).alias(name),
        *[
            (F.col(f"_sum_{new}") + F.coalesce(F.sum(source).over(within), F.lit(0))).alias(new)
            for new, source in start_sums.items()
        ],
    )


def running_totals(
    df: DataFrame, idx: str, columns: Sequence[str], ranges: int = RANGES
) -> DataFrame:
    """Replace `columns` by their sums over all rows up to this one in `idx` order.

    `idx` is a dense row position. Totals per key range are combined before
    the shuffle; there are at most `ranges` of them. Within a range the rows
    are summed by an ordinary window.
    """
    n = df.agg(F.coalesce(F.max(idx), F.lit(0)) + 1).first()[0]
    width = -(-n // ranges)
    df = df.withColumn("_range", F.floor(F.col(idx) / F.lit(width)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy("_range")
        .agg(*[F.sum(c).alias(f"_before_{c}") for c in columns])
        .select(
            "_range",
            *[
                F.coalesce(F.sum(f"_before_{c}").over(before), F.lit(0)).alias(f"_before_{c}")
                for c in columns
            ],
        )
    )
    within = Window.partitionBy("_range").orderBy(idx)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    return df.join(F.broadcast(totals), "_range").select(
        *[c for c in df.columns if c not in (*columns, "_range")],
        *[(F.col(f"_before_{c}") + F.sum(c).over(upto)).alias(c) for c in columns],
    )


def slice_rows(df: DataFrame, start: int = 0, end: int = -1, idx: str = "idx") -> DataFrame:
    """Rows between two record numbers of a file whose header is record 1.

    The filter is a plain range on `idx` and reaches the scan.
    """
    kept = df.filter(F.col(idx) >= max(start - 1, 0))
    return kept if end == -1 else kept.filter(F.col(idx) <= end - 2)


def split_rows(
    df: DataFrame, n_train: int, n_valid: int, idx: str = "idx"
) -> tuple[DataFrame, DataFrame]:
    """Training rows and the validation rows that follow them."""
    return slice_rows(df, 0, n_train, idx), slice_rows(df, n_train, n_train + n_valid, idx)


def count_records(df: DataFrame) -> DataFrame:
    """Number of records of the file, header included."""
    return df.agg((F.count(F.lit(1)) + 1).alias("n_records"))


def bin_of(idx: Column, total: int, bins: int) -> Column:
    """Segment of a row; null for a row beyond the last segment.

    All segments have the width `total // bins` (the first one less), so a
    remainder makes one segment more.
    """
    width = max(total // bins, 1)
    segment = F.floor((idx + 1) / F.lit(width))
    return F.when(segment * width < total, segment)


def top_k_per_group(
    counts: DataFrame, group: str, k: int, item: str, n: str = "cnt", splits: int = 64
) -> DataFrame:
    """The `k` most frequent items of each group, ties by item.

    Items are ranked within hashed splits of their group first, so the items of one group are
    ordered by many tasks; the second ranking sees `k` rows of each split at most.
    """
    by_rank = (F.desc(n), F.asc(item))
    split = Window.partitionBy(group, "_split").orderBy(*by_rank)
    best = (
        counts.withColumn("_split", F.pmod(F.xxhash64(item), F.lit(splits)).cast("int"))
        .withColumn("_place", F.row_number().over(split))
        .filter(F.col("_place") <= k)
        .drop("_split", "_place")
    )
    ranking = Window.partitionBy(group).orderBy(*by_rank)
    return best.withColumn("position", F.row_number().over(ranking).cast("long")).filter(F.col("position") <= k)
