"""Fitted models as parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagspark.operators.features import TfidfModel
from tagspark.operators.scoring import LinearModel


def save_text_model(model: TfidfModel, path: str) -> None:
    model.terms.write.parquet(f"{path}/terms")
    spark = model.terms.sparkSession
    spark.range(1).select(F.lit(model.n_docs).cast("long").alias("n_docs")).write.parquet(
        f"{path}/corpus"
    )


def load_text_model(spark: SparkSession, path: str) -> TfidfModel:
    n_docs = spark.read.parquet(f"{path}/corpus").first()["n_docs"]
    return TfidfModel(spark.read.parquet(f"{path}/terms"), n_docs)


def save_tag_model(model: LinearModel, path: str) -> None:
    model.weights.write.parquet(f"{path}/weights")
    names = F.posexplode(F.array(*[F.lit(t) for t in model.tags])).alias("rank", "tag")
    model.weights.sparkSession.range(1).select(names).write.parquet(f"{path}/tags")


def load_tag_model(spark: SparkSession, path: str) -> LinearModel:
    rows = spark.read.parquet(f"{path}/tags").orderBy("rank").collect()
    return LinearModel(spark.read.parquet(f"{path}/weights"), [r["tag"] for r in rows])
