"""Tag vocabulary, counts, ranks, segment statistics and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.functions.clean import ascii_lower, clean_title, process_body, tag_detected, words
from tagspark.operators.joins import lookup, measured_bytes
from tagspark.operators.ordering import bin_of, running_totals, top_k_per_group, with_row_index
from tagspark.sources.staging import stage

COVERAGE = (
    "in_title", "in_both_bodies", "in_body", "in_title_body", "in_title_processed", "n_tags",
    "processed_length", "body_length",
)


def row_tags(tags: Column) -> Column:
    """Distinct lower-case tags of a row."""
    return F.array_distinct(words(F.lower(tags)))


def exploded_tags(df: DataFrame, tags: str = "tags", idx: str = "idx") -> DataFrame:
    """One `(idx, tag)` per row and distinct tag."""
    return df.select(idx, F.explode(row_tags(F.col(tags))).alias("tag"))


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Number of rows per tag; a tag twice in a row counts once."""
    return (
        df.select(F.explode(row_tags(F.col(tags))).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def tag_offsets(df: DataFrame, tags: str = "tags") -> DataFrame:
    """`(tag, cnt, tag_id, offset)`: ids in tag order, and where the run of each
    tag starts when all occurrences are sorted by id."""
    return with_row_index(tag_counts(df, tags), "tag", name="tag_id", start_sums={"offset": "cnt"})


def run_widths(offsets: DataFrame) -> DataFrame:
    """Add `width`: how far it is from the offset of each run to the next one, or to the end.

    `offsets` are stored `tag_offsets`, whose ids are dense.
    """
    following = offsets.select((F.col("tag_id") - 1).alias("tag_id"), F.col("offset").alias("_next"))
    end = offsets.agg(F.sum("cnt")).scalar()
    width = F.coalesce("_next", end) - F.col("offset")
    return offsets.join(following, "tag_id", "left").select(*offsets.columns, width.alias("width"))


def tag_vocabulary(df: DataFrame, tags: str = "tags") -> DataFrame:
    return tag_offsets(df, tags).select("tag", "tag_id")


def tag_rank(df: DataFrame, tags: str = "tags") -> DataFrame:
    """`tag_offsets` with `rank` 0 for the most frequent tag; ties: higher id first."""
    return with_row_index(tag_offsets(df, tags), F.desc("cnt"), F.desc("tag_id"), name="rank")


def top_tags(stats: DataFrame, n: int, start: int = 0) -> DataFrame:
    """Tags of the ranks `start` to `start + n - 1`."""
    return stats.filter(F.col("rank").between(start, start + n - 1))


def tag_names(stats: DataFrame, n: int, start: int = 0) -> list[str]:
    """Names in rank order, at most `n`: the tags one model is trained for."""
    rows = top_tags(stats, n, start).select("rank", "tag").orderBy("rank").collect()
    return [r["tag"] for r in rows]


def tag_ids(df: DataFrame, stats: DataFrame, tags: str = "tags", idx: str = "idx") -> DataFrame:
    """`(idx, tag, tag_id)` of every distinct tag of every row."""
    ids = stats.select("tag", "tag_id", "cnt")
    return lookup(
        exploded_tags(df, tags, idx), ids, "tag", idx, measured_bytes(ids), counts=(stats, "cnt")
    ).select(idx, "tag", "tag_id")


def tag_occurrences(df: DataFrame, stats: DataFrame, tags: str = "tags") -> DataFrame:
    """All `(tag_id, idx)` occurrences; sort by `tag_id` when writing them."""
    return tag_ids(df, stats, tags).select("tag_id", "idx")


@dataclass
class OccurrenceIndex:
    """Stored occurrences `(position, tag_id, idx, part)`, sorted by tag and row.

    A `part` is a folder of `part_rows` positions, so that the parts of a run are known from its
    offset and the others are not even listed.
    """

    rows: DataFrame
    part_rows: int

    def runs(self, stats: DataFrame) -> DataFrame:
        """`(position, tag_id, idx)` of the tags of `stats (tag_id, offset, cnt, ...)`, a few.

        Their offsets are filters on the files and on the rows in them.
        """
        spans = [(r["offset"], r["offset"] + r["cnt"]) for r in stats.select("offset", "cnt").collect()]
        if not spans:
            return self.rows.drop("part").limit(0)
        parts = sorted({p for a, b in spans for p in range(a // self.part_rows, (b - 1) // self.part_rows + 1)})
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | ((F.col("position") >= a) & (F.col("position") < b))
        return self.rows.filter(F.col("part").isin(parts) & inside).drop("part")


def index_occurrences(
    df: DataFrame, stats: DataFrame, tags: str = "tags", part_rows: int = 1 << 22
) -> OccurrenceIndex:
    """Write all occurrences in the order of their offsets."""
    placed = with_row_index(tag_occurrences(df, stats, tags), "tag_id", "idx", name="position")
    part = F.expr(f"cast(position div {part_rows} as int) as part")
    return OccurrenceIndex(stage(placed.select("position", "tag_id", "idx", part), "occurrences", "part"), part_rows)


def _top_by_bin(df: DataFrame, items: Column, bins: int, total: int, k: int, name: str):
    segment = bin_of(F.col("idx"), total, bins)
    counts = (
        df.select(segment.alias("bin"), items.alias("_items"))
        .filter(F.col("bin").isNotNull())
        .select("bin", F.explode_outer("_items").alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy("bin", name)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return top_k_per_group(counts, "bin", k, name)


def top_words_by_bin(df: DataFrame, bins: int, total: int, k: int = 1000) -> DataFrame:
    """Most frequent words of the clean `text` in each segment."""
    return _top_by_bin(df, words(F.col("text")), bins, total, k, "word")


def top_tags_by_bin(df: DataFrame, bins: int, total: int, k: int = 1000) -> DataFrame:
    """Most frequent tags in each segment."""
    return _top_by_bin(df, words(F.col("tags")), bins, total, k, "tag")


def row_coverage(df: DataFrame) -> DataFrame:
    """Per row: how many of its tags occur in title, body and processed body, and
    the byte lengths of both bodies."""
    texts = process_body(
        df.select(
            "idx",
            clean_title(F.col("title")).alias("title"),
            ascii_lower(F.col("body")).alias("body"),
            F.split("tags", " ", -1).alias("tags"),
        ),
        byte_blanks=True,
    )
    exploded = texts.select(
        "idx", "title", "body", "processed", F.posexplode("tags").alias("_at", "tag")
    )
    tag = F.col("tag")
    title, body, processed = F.col("title"), F.col("body"), F.col("processed")
    in_body = tag_detected(tag, body)
    hits = {
        "in_title": tag_detected(tag, title),
        "in_both_bodies": in_body & tag_detected(tag, processed),
        "in_body": in_body,
        "in_title_body": tag_detected(tag, F.concat(title, body)),
        "in_title_processed": tag_detected(tag, F.concat(title, processed)),
        "n_tags": F.lit(True),
    }
    # Lengths belong to the row, so only its first tag carries them.
    first = F.col("_at") == 0
    return exploded.select(
        "idx",
        *[F.when(hit, 1).otherwise(0).cast("long").alias(name) for name, hit in hits.items()],
        F.when(first, F.octet_length(processed)).otherwise(0).cast("long").alias("processed_length"),
        F.when(first, F.octet_length(body)).otherwise(0).cast("long").alias("body_length"),
    )


def tag_coverage(df: DataFrame) -> DataFrame:
    """One row: how many tags survive in each text, and the total lengths."""
    return row_coverage(df).agg(*[F.sum(c).alias(c) for c in COVERAGE])


def running_coverage(df: DataFrame) -> DataFrame:
    """The coverage counters after each row."""
    per_row = row_coverage(df).groupBy("idx").agg(*[F.sum(c).alias(c) for c in COVERAGE])
    # Both passes read the stored counters, so every post is cleaned once.
    return running_totals(stage(per_row, "coverage"), "idx", COVERAGE)
