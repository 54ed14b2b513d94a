"""Sparse random projection and noise."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tagspark.functions.hashing import PRIME, cell_hash, cell_normal
from tagspark.operators.joins import lookup, measured_bytes

# Fixed values.
WIDTH = 4000
SEED = 15
# End of fixed values.

# Values of the arrays that a task makes at once.
VALUES_AT_ONCE = 1_000_000


def draws(n_features: int) -> int:
    """Number of equally likely draws per cell; one is -1 and one is +1."""
    return math.floor(2 * math.sqrt(n_features))


def cells_per_feature(n_features: int, k: int) -> int:
    """Most non-zero cells of a feature: twelve standard deviations above their mean."""
    mean = k * min(1.0, 2.0 / draws(n_features))
    return min(k, math.ceil(mean + 12 * math.sqrt(mean) + 12))


def projection(
    features: DataFrame, n_features: int, k: int = WIDTH, seed: int = SEED
) -> DataFrame:
    """Non-zero cells `(feature_id, dim, sign)` of the matrix for these features.

    The gaps between the non-zero cells of a feature are drawn, geometrically distributed, so a
    feature costs its non-zero cells and not its width. A gap depends on the feature and on its
    number there only, a sign on its cell.
    """
    share = 2.0 / draws(n_features)
    steps = cells_per_feature(n_features, k)

    def gap(j: Column) -> Column:
        if share >= 1:
            return F.lit(1).cast("long")
        u = (cell_hash(F.col("feature_id") * steps + j, seed) + 1) / F.lit(float(PRIME + 1))
        return F.floor(F.ln(u) / F.lit(math.log(1 - share))) + 1

    numbers = F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))
    at = F.aggregate(
        F.transform(numbers, gap),
        F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("seen")),
        lambda s, g: F.struct(
            (s["at"] + g).alias("at"),
            F.when(s["at"] + g < k, F.concat(s["seen"], F.array(s["at"] + g))).otherwise(s["seen"]).alias("seen"),
        ),
        lambda s: s["seen"],
    )
    sign = cell_hash(F.col("feature_id") * k + F.col("dim"), seed + 1) % 2 * 2 - 1
    return features.select("feature_id", F.explode(at).alias("dim")).select(
        "feature_id", "dim", sign.cast("int").alias("sign")
    )


def project(features: DataFrame, cells: DataFrame, idx: str = "idx") -> DataFrame:
    """`(idx, dim, value)`: features times the matrix.

    A feature's cells are packed into one row, so the lookup side is unique
    and a frequent feature can be split.
    """
    packed = cells.groupBy("feature_id").agg(
        F.collect_list(F.struct("dim", "sign")).alias("_cells")
    )
    size = measured_bytes(cells)
    return (
        lookup(features.select(idx, "feature_id", "value"), packed, "feature_id", idx, size)
        .select(idx, "value", F.explode("_cells").alias("_c"))
        .groupBy(idx, F.col("_c.dim").alias("dim"))
        .agg(F.sum(F.col("value") * F.col("_c.sign")).alias("value"))
    )


def projected_rows(features: DataFrame, cells: DataFrame, k: int, idx: str = "idx") -> DataFrame:
    """`(idx, values ARRAY<DOUBLE>)`: features times the matrix, one array of width `k` a row.

    Features without cells, as the bias, add nothing. Partitioned by row they stay so. The cells of
    a row are added up in its array while its features pass by, so a task holds some arrays and no
    group per row and dimension.
    """
    # Dimension and sign in one number.
    signed = F.collect_list(((F.col("dim") + 1) * F.col("sign")).cast("int"))
    packed = cells.groupBy("feature_id").agg(signed.alias("_cells"))
    rows = features.select(idx, "feature_id", "value")
    found = lookup(rows, packed, "feature_id", idx, measured_bytes(cells), "left")
    # The window brings the features of a row together and tells how many there are.
    n = F.count(F.lit(1)).over(Window.partitionBy(idx)).alias("_n")
    schema = T.StructType([features.schema[idx], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def add_up(batches):
        return added_rows(batches, idx, k)

    return found.select(idx, "value", "_cells", n).mapInArrow(add_up, schema)


def added_rows(batches: Iterator[pa.RecordBatch], idx: str, k: int) -> Iterator[pa.RecordBatch]:
    """`(idx, values)` of features `(idx, value, _cells, _n)`, the `_n` of a row one after the other."""
    held, size, needed = [], 0, 1
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < needed:
            continue
        table = pa.Table.from_batches(held)
        n = table["_n"].to_numpy()
        starts, end = [], 0
        while end < len(n) and end + n[end] <= len(n):
            starts.append(end)
            end += int(n[end])
        # Of the last row some features may be in the next batches.
        needed = int(n[end]) if end < len(n) else 1
        at_once = max(1, VALUES_AT_ONCE // k)
        for at in range(0, len(starts), at_once):
            some = starts[at : at + at_once + 1]
            some = some if len(some) > at_once else [*some, end]
            yield summed_rows(table.slice(some[0], some[-1] - some[0]), np.diff(some), idx, k)
        rest = table.slice(end)
        held, size = rest.to_batches(), rest.num_rows


def summed_rows(table: pa.Table, n: np.ndarray, idx: str, k: int) -> pa.RecordBatch:
    """Arrays of the rows whose numbers of features are `n`."""
    cells = table["_cells"].combine_chunks()
    codes = cells.flatten().to_numpy()
    sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.repeat(np.arange(len(n)), n), sizes)
    value = np.repeat(table["value"].to_numpy(), sizes)
    sums = np.bincount(row * k + np.abs(codes) - 1, np.where(codes > 0, value, -value), len(n) * k)
    ids = table[idx].combine_chunks().take(pa.array(np.cumsum(n) - n))
    values = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * k, sums.astype(float))
    return pa.RecordBatch.from_arrays([ids, values], names=[idx, "values"])


def corrupt_row(values: Column, level: Column, row: Column, k: int, seed: int) -> Column:
    """`corrupt` for all values of a row's array."""
    return F.transform(values, lambda v, d: corrupt(v, level, row, d, k, seed))


def noise_level(step: Column, max_steps: int) -> Column:
    """Falls from 1 to 0 over the training, then stays 0."""
    return F.greatest(F.lit(1.0) - step / F.lit(float(max_steps)), F.lit(0.0))


def corrupt(
    value: Column, level: Column, row: Column, dim: Column, k: int, seed: int
) -> Column:
    """Add normal noise of the given deviation; the same cell gets the same noise."""
    cell = (row % PRIME) * k + dim
    return value + level * cell_normal(cell, seed)
