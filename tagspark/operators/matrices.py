"""Training rows as sparse matrices, and an iteration's sums over them.

A training reads its rows hundreds of times. So they are stored once more as matrices of up to
`CELLS` cells, each by rows and by features, and an iteration is one pass over them: a task takes
the outputs of its rows and adds the gradient parts per feature in arrays. The arrays of all tasks
are added up in slices of features, in the order of the tasks, so equal rows give equal sums.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from tagspark.sources.staging import discard, stage

# The functions of this module travel to the executors by value: they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of a matrix, and features whose sums are added up together.
CELLS = 1 << 18
SLICE = 512
# Sums of all tasks beyond this are added up before they go to the driver.
DIRECT_BYTES = 8 * 1024 * 1024
PARTS = "slice int, part int, sums binary"
TYPES = {
    "labels": np.int64, "starts": np.int64, "place": np.int32, "value": np.float64,
    "features": np.int32, "feature_starts": np.int64, "row": np.int32, "row_value": np.float64,
}
SCHEMA = pa.schema([("batch", pa.int32()), *[(name, pa.binary()) for name in TYPES]])


@dataclass
class Matrices:
    """A stored table of matrices in `files` files. A feature's place is that in the sorted `ids`."""

    table: DataFrame
    ids: np.ndarray
    files: int

    def of_batch(self, batch: int) -> Matrices:
        return Matrices(self.table.filter(F.col("batch") == batch), self.ids, self.files)

    def discard(self) -> None:
        discard(self.table)


def all_ids(rows: DataFrame, feature_ids: DataFrame, more: list[int]) -> np.ndarray:
    """The features of `rows`, `feature_ids` and `more`, in order."""
    seen = rows.select(F.inline("features")).select("feature_id").unionByName(feature_ids.select("feature_id"))
    found = seen.filter("feature_id is not null").distinct().toArrow()["feature_id"].to_numpy()
    return np.unique(np.concatenate([found, np.array(more)]).astype(np.int64))


def stored_matrices(rows: DataFrame, name: str, ids: np.ndarray) -> Matrices:
    """Matrices of packed rows `(labels, features)`, by their `batch` if there is one.

    A task makes one matrix at least, out of several partitions of small tables.
    """
    cells = rows.agg(F.sum(F.size("features"))).first()[0] or 0
    files = max(1, min(-(-cells // CELLS), rows.rdd.getNumPartitions()))
    known = rows.sparkSession.sparkContext.broadcast(ids)
    batch = F.col("batch") if "batch" in rows.columns else F.lit(0)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            numbers = some["batch"].to_numpy()
            for number in np.unique(numbers):
                yield from matrices_of(some.filter(pa.array(numbers == number)), known.value, int(number))

    schema = ", ".join(f"{field.name} {'int' if field.name == 'batch' else 'binary'}" for field in SCHEMA)
    packed = rows.select("labels", "features", batch.cast("int").alias("batch")).coalesce(files)
    stored = Matrices(stage(packed.mapInArrow(build, schema), name), ids, files)
    known.destroy()
    return stored


def matrices_of(rows: pa.RecordBatch, ids: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
    """Matrices of the rows; features that have no place are left out, and rows without others."""
    features = rows["features"]
    sizes = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cells = features.flatten()
    names = cells.field("feature_id").to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    known = ids[place] == names
    row = np.repeat(np.arange(len(sizes)), sizes)[known]
    place, value = place[known], cells.field("value").fill_null(0.0).to_numpy(zero_copy_only=False)[known]
    order = np.lexsort((value, place, row))
    row, place, value = row[order], place[order], value[order]
    kept, row = np.unique(row, return_inverse=True)
    labels = rows["labels"].to_numpy(zero_copy_only=False)[kept]
    ends = np.cumsum(np.bincount(row, minlength=len(kept))) if len(kept) else np.zeros(0, int)
    first, done = 0, 0
    while first < len(kept):
        last = max(int(np.searchsorted(ends, done + CELLS, "right")), first + 1)
        some = slice(done, int(ends[last - 1]))
        yield packed_matrix(labels[first:last], row[some] - first, place[some], value[some], number)
        first, done = last, some.stop


def packed_matrix(
    labels: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray, number: int
) -> pa.RecordBatch:
    """One matrix, from cells in the order of rows."""
    order = np.argsort(place, kind="stable")
    features, feature_starts = np.unique(place[order], return_index=True)
    arrays = {
        "labels": labels, "starts": np.unique(row, return_index=True)[1], "place": place, "value": value,
        "features": features, "feature_starts": feature_starts, "row": row[order], "row_value": value[order],
    }
    parts = [pa.array([arrays[name].astype(kind).tobytes()], pa.binary()) for name, kind in TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *parts], schema=SCHEMA)


class Matrix:
    """One matrix `labels, starts, place, ..` of the table."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        for name, kind in TYPES.items():
            setattr(self, name, np.frombuffer(batch[name][k].as_buffer(), kind))

    def outputs(self, weights: np.ndarray) -> np.ndarray:
        """The outputs, a line per tag, of weights with a line per tag."""
        z, held = np.empty((len(weights), len(self.labels))), np.empty(len(self.place))
        for tag, line in enumerate(weights):
            np.take(line, self.place, out=held, mode="clip")
            np.add.reduceat(np.multiply(held, self.value, out=held), self.starts, out=z[tag])
        return z

    def targets(self, n_tags: int) -> np.ndarray:
        """1.0 or 0.0 by tag and row."""
        return ((self.labels >> np.arange(n_tags)[:, None]) & 1).astype(np.float64)

    def add_slopes(self, sums: np.ndarray, slopes: np.ndarray) -> None:
        """Add each row's slopes times its values to the sums, by tag and feature."""
        held = np.empty(len(self.row))
        for total, line in zip(sums, slopes):
            np.take(line, self.row, out=held, mode="clip")
            total[self.features] += np.add.reduceat(np.multiply(held, self.row_value, out=held), self.feature_starts)

    def add_few_slopes(self, sums: np.ndarray, slopes: np.ndarray) -> None:
        """`add_slopes` that reads only the rows whose slope is not 0, for each tag."""
        sizes = np.diff(self.starts, append=len(self.place))
        for total, line in zip(sums, slopes):
            rows = np.flatnonzero(line)
            lengths = sizes[rows]
            shift = np.repeat(self.starts[rows] - np.cumsum(lengths) + lengths, lengths)
            cells = shift + np.arange(len(shift))
            parts = self.value[cells] * np.repeat(line[rows], lengths)
            total += np.bincount(self.place[cells], parts, len(total))


def terms(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, ...]:
    """What `training.row_terms` are: two that are added to the totals, and two to each feature."""
    if loss == "f_measure":
        p = probability(z)
        q = p * (1.0 - p)
        return y * p, y + p, y * q, q
    side = 2.0 * y - 1.0
    p = np.maximum(1.0 - side * z, 0.0)
    return p * p, np.abs(z - side), -2.0 * side * p, np.zeros_like(p)


def probability(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z))


def matrix_sums(rows: Matrices, weights: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, int]:
    """`training.gradient_sums` of weights with a line per tag: `a` and `b` by tag and feature,
    their totals by tag, and the number of rows."""
    n_tags, n_features = weights.shape
    held = rows.table.sparkSession.sparkContext.broadcast(weights)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals, n = np.zeros((2, n_tags, n_features)), np.zeros((2, n_tags)), 0
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = Matrix(batch, k)
                n += len(matrix.labels)
                whole, mass, first, second = terms(matrix.outputs(held.value), matrix.targets(n_tags), loss)
                totals += whole.sum(axis=1), mass.sum(axis=1)
                if loss == "f_measure":
                    matrix.add_few_slopes(sums[0], first)
                    matrix.add_slopes(sums[1], second)
                else:
                    matrix.add_slopes(sums[0], first)
        if not n:
            return
        found = [np.append(totals, n), *[sums[:, :, i : i + SLICE] for i in range(0, n_features, SLICE)]]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(-1, len(found) - 1), pa.int32()), pa.array([part] * len(found), pa.int32()),
                pa.array([f.tobytes() for f in found], pa.binary()),
            ],
            ["slice", "part", "sums"],
        )

    parts = rows.table.drop("batch").mapInArrow(add_up, PARTS)
    if 2 * weights.nbytes * rows.files > DIRECT_BYTES:
        parts = parts.groupBy("slice").applyInArrow(added_parts, PARTS)
    found: dict[int, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        sums = np.frombuffer(r["sums"])
        found[r["slice"]] = found[r["slice"]] + sums if r["slice"] in found else sums
    held.destroy()
    if not found:
        return np.zeros((2, n_tags, n_features)), np.zeros((2, n_tags)), 0
    totals = found.pop(-1)
    sums = np.concatenate([found[s].reshape(2, n_tags, -1) for s in sorted(found)], axis=2)
    return sums, totals[:-1].reshape(2, n_tags), int(totals[-1])


def added_parts(parts: pa.Table) -> pa.Table:
    """The sum of a slice's arrays, in the order of the tasks."""
    ordered = parts.sort_by("part")
    first, *others = ordered["sums"]
    total = np.frombuffer(first.as_buffer()).copy()
    for other in others:
        total += np.frombuffer(other.as_buffer())
    return ordered.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))


def matrix_scores(rows: Matrices, weights: np.ndarray, loss: str) -> list[float]:
    """`training.validation_scores` of weights with a line per tag."""
    n_tags = len(weights)
    held = rows.table.sparkSession.sparkContext.broadcast(weights)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros((2, n_tags)), 0
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = Matrix(batch, k)
                n += len(matrix.labels)
                whole, mass, _, _ = terms(matrix.outputs(held.value), matrix.targets(n_tags), loss)
                totals += whole.sum(axis=1), mass.sum(axis=1)
        if n:
            sums = np.append(totals, n).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums], pa.binary())],
                ["slice", "part", "sums"],
            )

    parts = sorted(rows.table.drop("batch").mapInArrow(add_up, PARTS).collect(), key=lambda r: r["part"])
    held.destroy()
    if not parts:
        return [float("-inf")] * n_tags
    sums = sum(np.frombuffer(r["sums"]) for r in parts)
    whole, mass = sums[:-1].reshape(2, n_tags)
    if loss != "f_measure":
        return [float(-w / sums[-1]) for w in whole]
    return [float(2.0 * w / m) if m > 0 else 0.0 for w, m in zip(whole, mass)]
