"""Question posts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagspark.operators.features import BIAS_ID
from tagspark.operators.scoring import LinearModel, label_bit
from tagspark.sources.staging import cut, spread

# The same text runs on both engines; `{documents}` is the table.
Q_DOCS = """
select doc_id as idx,
       split_part(text, chr(10), 1) as title,
       '<p class="x">' || text || '</p>' || chr(10) ||
       '<pre><code>' || text || '</code></pre>' ||
       '<ul><li>Item ' || cast(doc_id as string) || ' of [ref] {{x}} &lt;b&gt; <code>K</code></li><li> </li></ul>' ||
       '<pre lang="z">C# ' || source || ' 12 x</pre><h1>gone</h1>' as body,
       lang || ' ' || source || ' len-' || cast(length(cast(n_chars as string)) as string) as tags
from {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts `(idx, title, body, tags)`, partitioned by `idx` if the scan is small."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    return spark.sql(Q_DOCS, documents=documents)


def q_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four fifths."""
    n = table(spark, sf_dir, "documents").count()
    return q_docs(spark, sf_dir).filter(F.col("idx") * 5 < 4 * n)


def q_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifth without tags, with positions of its own."""
    n = table(spark, sf_dir, "documents").count()
    n_train = -(-4 * n // 5)
    return (
        q_docs(spark, sf_dir)
        .filter(F.col("idx") * 5 >= 4 * n)
        .select((F.col("idx") - n_train).alias("test_idx"), "title", "body")
    )


def q_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real web pages as posts."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select(
        F.col("page_id").alias("idx"), F.col("url").alias("title"), F.col("html").alias("body")
    )


def odds_weights(features: DataFrame, names: list[str]) -> LinearModel:
    """Weights from term counts, so that scores have an exact SQL equivalent.

    `features` are `(idx, labels, feature_id)` with bias rows. The counts of
    all tags are taken in one aggregation; the bias row's are the totals.
    """
    n = range(len(names))
    counts = cut(
        features.groupBy("feature_id").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.expr(f"array({', '.join(f'sum({label_bit(r)})' for r in n)}) as pos"),
        )
    )
    total = counts.filter(F.col("feature_id") == BIAS_ID).select(F.struct("n", "pos")).scalar()

    def weight(r: int) -> str:
        pos, all_pos = f"get(pos, {r})", f"get(total.pos, {r})"
        neg, all_neg = f"(n - {pos})", f"(total.n - {all_pos})"
        odds = f"ln(({pos} + 1) / ({all_pos} + 2)) - ln(({neg} + 1) / ({all_neg} + 2))"
        return f"if(feature_id = {BIAS_ID}, ln(({pos} + 1) / ({neg} + 1)), {odds})"

    weights = counts.withColumn("total", total).selectExpr(
        "feature_id", f"array({', '.join(map(weight, n))}) as w"
    )
    return LinearModel(cut(weights), names)
