"""Lookups that hold when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagspark.sources.staging import cut

# A side is broadcast only when it was measured to be at most this large.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more than this share of the rows is split; there are at most 1/share such keys.
HOT_SHARE = 1e-4


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of a computed (staged) table, with a row overhead."""
    size: Column = F.lit(32)
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            part = F.octet_length(c)
        elif isinstance(field.dataType, T.ArrayType):
            part = F.size(c) * 8 + 16
        else:
            part = F.lit(8)
        size = size + F.coalesce(part, F.lit(0)).cast("long")
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]


def hot_keys(counts: DataFrame, key: str, n: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys over `share` of all rows, as `(_h, _splits)`, from a table of key counts.

    Keys are kept as hashes: at most `1/share` rows of a fixed width, which is
    the bound that allows this table to be broadcast.
    """
    counts = counts.select(F.xxhash64(key).alias("_h"), F.col(n).cast("double").alias("_n"))
    limit = counts.agg(F.coalesce(F.sum("_n"), F.lit(0.0)) * share).scalar()
    return (
        counts.withColumn("_limit", limit)
        .filter(F.col("_n") > F.col("_limit"))
        .groupBy("_h")
        .agg(F.ceil(F.sum("_n") / F.max("_limit")).cast("int").alias("_splits"))
    )


def split_lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: str,
    how: str = "inner",
    counts: tuple[DataFrame, str] | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join facts with a side that is unique on `key`, splitting the hot keys.

    Rows of a hot key are dealt over several splits by `spread_by`; only the
    few matching rows of the unique side are repeated, once per split.
    `counts` may name a known table of key counts; otherwise the facts are
    counted, combined before the shuffle.
    """
    if counts is None:
        counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("_count")), "_count"
    # Stored, as both sides need it; else the facts would be counted once more for each use.
    hot = F.broadcast(cut(hot_keys(counts[0], key, counts[1], share)))
    dealt = (
        facts.withColumn("_h", F.xxhash64(key))
        .join(hot, "_h", "left")
        .withColumn(
            "_split",
            F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_splits")).cast("int"), F.lit(0)),
        )
        .drop("_h", "_splits")
    )
    repeated = (
        dim.withColumn("_h", F.xxhash64(key))
        .join(hot, "_h", "left")
        .withColumn(
            "_split", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
        )
        .drop("_h", "_splits")
    )
    return dealt.join(repeated, [key, "_split"], how).drop("_split")


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: str,
    dim_bytes: int,
    how: str = "inner",
    counts: tuple[DataFrame, str] | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join with a unique side: broadcast if it was measured small, else split the hot keys."""
    if dim_bytes <= limit:
        return facts.join(F.broadcast(dim), key, how)
    return split_lookup(facts, dim, key, spread_by, how, counts)
