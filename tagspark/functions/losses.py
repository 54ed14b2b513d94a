"""Output transfer and losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def squared_hinge(target: Column, prediction: Column) -> Column:
    return F.pow(F.greatest(F.lit(1.0) - target * prediction, F.lit(0.0)), F.lit(2.0))


def soft_f_measure(hits: Column, mass: Column) -> Column:
    """`2 * sum(y*p) / (sum(y) + sum(p))` from the two sums, y in {0, 1}."""
    return F.coalesce(F.lit(2.0) * hits / F.nullif(mass, F.lit(0.0)), F.lit(0.0))
