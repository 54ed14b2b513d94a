"""Order-free pseudo-random numbers.

A polynomial over a prime field: the same cell always gets the same value,
whatever the partitioning and however often a task is run again. Degree three
makes any four values independent, which is what random projections need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

PRIME = 2147483647


def coefficients(seed: int) -> tuple[int, int, int, int]:
    """Four field elements from a seed."""
    state = seed % (PRIME - 1) + 1
    out = []
    for _ in range(4):
        for _ in range(3):
            state = state * 48271 % PRIME
        out.append(state)
    return tuple(out)


def cell_hash(cell: Column, seed: int) -> Column:
    """A value in [0, PRIME) for a non-negative integer; every product fits a long."""
    a, b, c, d = (F.lit(v).cast("long") for v in coefficients(seed))
    x = cell.cast("long") % PRIME
    h = (a * x + b) % PRIME
    h = (h * x + c) % PRIME
    return (h * x + d) % PRIME


def cell_normal(cell: Column, seed: int) -> Column:
    """A standard normal value (Box-Muller over two hashed uniforms)."""
    u = (cell_hash(cell, seed) + 1) / F.lit(float(PRIME + 1))
    v = cell_hash(cell, seed + 1) / F.lit(float(PRIME))
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)
