"""TF-IDF over word 1-2-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagspark.functions.text import grams, tokens, word_pairs
from tagspark.operators import joins
from tagspark.operators.joins import lookup, measured_bytes
from tagspark.operators.ordering import with_row_index
from tagspark.sources.staging import cut, spread

# Fixed value: a term is kept when this share of the documents has it.
MIN_DF = 0.0005
# The constant feature that every row has; no token is empty.
BIAS_ID = -1
BIAS_TERM = ""


def with_grams(docs: DataFrame, keep: Sequence[str] = ("idx",)) -> DataFrame:
    """`keep` and `grams`, the n-grams of the clean `text`."""
    return docs.select(*keep, tokens(F.col("text")).alias("_tok")).select(
        *keep, grams(F.col("_tok")).alias("grams")
    )


def doc_freq(docs: DataFrame) -> DataFrame:
    """Number of documents per n-gram, combined before the shuffle."""
    terms = F.explode_outer(F.array_distinct("grams")).alias("term")
    return (
        with_grams(docs, ())
        .select(terms)
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def term_freq(docs: DataFrame, keep: Sequence[str] = ("idx",), bias: bool = False) -> DataFrame:
    """`keep`, `term` and its count `tf` in the document.

    A document is one row, so its grams are sorted and its runs measured in
    place: no shuffle, and memory for one document at a time. With `bias`,
    every document also has the empty term once.
    """
    all_grams = F.col("grams")
    if bias:
        all_grams = F.concat(F.array(F.lit(BIAS_TERM)), all_grams)
    ordered = with_grams(docs, keep).select(*keep, F.sort_array(all_grams).alias("_s"))
    s = F.col("_s")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(s) - 1),
        lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
    )
    runs = ordered.select(*keep, "_s", starts.alias("_starts"))
    counted = F.transform(
        "_starts",
        lambda at, j: F.struct(
            F.get(s, at).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), j + 1), F.size(s)) - at).alias("tf"),
        ),
    )
    # The outer form, with the test after it: a test moved below the explode
    # would evaluate the grams a second time.
    return (
        runs.select(*keep, counted.alias("_counted"))
        .select(*keep, F.explode_outer("_counted").alias("_c"))
        .select(*keep, "_c.term", "_c.tf")
        .filter(F.col("term").isNotNull())
    )


def term_counts(docs: DataFrame, idx: str = "idx") -> DataFrame:
    """`idx, term` and its count `n` in all documents of that id.

    A document is counted in its row. Only those whose id occurs again, which a count of the ids
    alone tells, are shuffled to be summed.
    """
    n = F.col("tf").cast("long").alias("n")
    again = cut(docs.groupBy(F.col(idx).alias("_again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if again.isEmpty():
        return term_freq(docs, (idx,)).select(idx, "term", n)
    same = docs[idx].eqNullSafe(again["_again"])
    alone, together = (term_freq(docs.join(again, same, how), (idx,)) for how in ("left_anti", "left_semi"))
    summed = together.groupBy(idx, "term").agg(F.sum("tf").alias("n"))
    return alone.select(idx, "term", n).unionByName(summed)


def neighbours(docs: DataFrame, keep: Sequence[str], tok: Column) -> DataFrame:
    """`keep`, `first` and `second`, a row per token and the one after it (null after the last).

    Neither the pairs nor their strings are made in arrays, whose functions are not compiled. The
    outer form, as in `term_freq`.
    """
    pairs = F.arrays_zip(F.col("_tok").alias("first"), F.slice("_tok", F.lit(2), F.size("_tok")).alias("second"))
    return docs.select(*keep, tok.alias("_tok")).select(*keep, F.inline_outer(pairs)).filter("first is not null")


def vocabulary(frequencies: DataFrame, n_docs: int, min_df: float = MIN_DF) -> DataFrame:
    """Terms in at least the share `min_df` of the documents."""
    return frequencies.filter(F.col("df") >= F.lit(min_df * n_docs))


def frequent_terms(docs: DataFrame, n_docs: int, min_df: float = MIN_DF) -> DataFrame:
    """`vocabulary` of the documents without counting every pair of words.

    A pair is in no more documents than either of its words, so words are counted first, and only
    pairs of two kept words are shuffled. The kept words are bounded like the vocabulary; they are
    broadcast only if measured to be small. Then neighbours are looked up before they are joined to
    pairs, and a document's pairs are taken once in the partition of its `idx`; else in its row.
    """
    placed = spread(docs.select("idx", "text"), "idx")
    # A step of its own, as pairs use the tokens more than once.
    docs = docs.select(tokens(F.col("text")).alias("_tok"))
    tok = F.col("_tok")
    words = docs.select(F.explode_outer(F.array_distinct(tok)).alias("term")).filter("term is not null")
    kept = cut(vocabulary(words.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs, min_df))
    size = measured_bytes(kept)
    small = size <= joins.BROADCAST_BYTES
    if small:
        # Rows that share an id, or have none, are documents of their own.
        rows = placed.withColumn("_row", F.monotonically_increasing_id())
        pairs = neighbours(rows, ("idx", "_row"), tokens(F.col("text")))
    else:
        pairs = (
            docs.select(F.explode_outer(word_pairs(tok)).alias("term"))
            .filter("term is not null")
            .select("term", F.substring_index("term", " ", 1).alias("first"), F.substring_index("term", " ", -1).alias("second"))
        )
    for side, other in (("first", "second"), ("second", "first")):
        known = kept.select(F.col("term").alias(side), "df")
        pairs = lookup(pairs, known.select(side), side, other, size, "left_semi", counts=(known, "df"))
    if small:
        term = F.concat("first", F.lit(" "), "second").alias("term")
        pairs = pairs.select("idx", "_row", term).distinct()
    counted = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return kept.unionByName(vocabulary(counted, n_docs, min_df))


def idf_of(df: Column, n_docs: int) -> Column:
    """Smoothed inverse document frequency, `ln((1+n)/(1+df)) + 1`."""
    return F.ln(F.lit(1.0 + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


@dataclass
class TfidfModel:
    """A fitted vocabulary: `terms(term, df, feature_id, idf)` and the corpus size.

    A document has a bounded number of distinct grams g and a term needs
    `min_df * n` documents, so there are at most g / min_df terms however many
    documents were fitted. The size is measured all the same before the table
    is broadcast, and a larger one goes through a shuffle with split hot terms.
    """

    terms: DataFrame
    n_docs: int
    _bytes: int | None = field(default=None, repr=False)

    @classmethod
    def fit(cls, docs: DataFrame, min_df: float = MIN_DF) -> TfidfModel:
        n_docs = docs.count()
        kept = frequent_terms(docs, n_docs, min_df)
        indexed = with_row_index(kept, "term", name="feature_id")
        return cls(cut(indexed.withColumn("idf", idf_of(F.col("df"), n_docs))), n_docs)

    @property
    def size_bytes(self) -> int:
        if self._bytes is None:
            self._bytes = measured_bytes(self.terms)
        return self._bytes

    def transform(
        self, docs: DataFrame, keep: Sequence[str] = ("idx",), bias: bool = False
    ) -> DataFrame:
        """`keep, term, feature_id, value`: counts times idf, scaled to norm 1.

        The first column of `keep` identifies the document. Terms outside the
        vocabulary are dropped; with `bias` every document has a row with
        `feature_id` -1 and value 1. The only shuffle is by document, after
        the lookup, and none if `docs` is already partitioned by it.
        """
        dim = self.lookup_terms(bias)
        found = lookup(
            term_freq(docs, keep, bias), dim, "term", keep[0], self.size_bytes, counts=(dim, "df")
        )
        return self.scaled(found, (*keep, "term"))

    def transform_placed(
        self, docs: DataFrame, keep: Sequence[str] = ("idx",), bias: bool = False
    ) -> DataFrame:
        """`transform` without `term`, for documents that are partitioned by the first of `keep`.

        A small vocabulary meets the grams before they are counted: those outside it are never
        sorted, and the others are counted by their ids where they are. Rows are counted apart also
        where they share an id.
        """
        if self.size_bytes > joins.BROADCAST_BYTES:
            return self.transform(docs, keep, bias).drop("term")
        rows = docs.withColumn("_row", F.monotonically_increasing_id())
        tok = tokens(F.col("text"))
        if bias:
            # No term begins with a space, so the pair with the empty token is not found.
            tok = F.concat(F.array(F.lit(BIAS_TERM)), tok)
        pairs = neighbours(rows, (*keep, "_row"), tok)
        both = F.array("first", F.concat("first", F.lit(" "), "second"))
        terms = pairs.select(*keep, "_row", F.explode(both).alias("term"))
        dim = self.lookup_terms(bias).select("term", "feature_id", "idf")
        found = lookup(terms, dim, "term", keep[0], self.size_bytes)
        counted = found.groupBy(*keep, "_row", "feature_id", "idf").agg(F.count(F.lit(1)).alias("tf"))
        return self.scaled(counted, keep)

    def lookup_terms(self, bias: bool) -> DataFrame:
        """`(term, df, feature_id, idf)`, with `bias` also of the empty term."""
        dim = self.terms.select("term", "df", "feature_id", "idf")
        if not bias:
            return dim
        one = self.terms.sparkSession.range(1).select(
            F.lit(BIAS_TERM).alias("term"),
            F.lit(self.n_docs).cast("long").alias("df"),
            F.lit(BIAS_ID).cast("long").alias("feature_id"),
            F.lit(1.0).alias("idf"),
        )
        return dim.unionByName(one)

    @staticmethod
    def scaled(found: DataFrame, keep: Sequence[str]) -> DataFrame:
        """`keep, feature_id, value` from `keep, feature_id, idf, tf`."""
        x = F.col("tf") * F.col("idf")
        is_term = F.col("feature_id") >= 0
        # Squares are added in the order of features, so equal texts get equal values in every run.
        whole = Window.partitionBy(keep[0]).orderBy("feature_id").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        squares = F.sum(F.when(is_term, x * x)).over(whole)
        return found.withColumn("_x", x).withColumn("_squares", squares).select(
            *keep,
            "feature_id",
            F.when(is_term, F.col("_x") / F.sqrt("_squares")).otherwise(F.lit(1.0)).alias("value"),
        )


def to_vectors(features: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    """One row per document with its feature ids in order and their values.

    `indices` and `values` are the parts of a sparse vector of width `size`,
    bounded by the document's own length.
    """
    pairs = F.sort_array(F.collect_list(F.struct("feature_id", "value")))
    return (
        features.groupBy(idx)
        .agg(pairs.alias("_pairs"))
        .select(
            idx,
            F.lit(size).alias("size"),
            F.col("_pairs.feature_id").alias("indices"),
            F.col("_pairs.value").alias("values"),
        )
    )
