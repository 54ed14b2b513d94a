"""Language identification by fusing evidence.

The language of a page is that with the highest posterior probability given
* its visible text, by a naive Bayes model over letter trigrams;
* the language its markup declares;
* the suffix of its address (top-level domain);
* its host, by a prior that is smoothed by the suffix's and that by all pages'.

The text model is fitted on a bounded sample of labelled documents. All other tables are counts
over all pages, taken with the languages that the texts alone suggest; a page's own vote is
taken out of its host's prior. Counts combine before they are shuffled, so a host with a third
of the pages is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagspark.llm.urls import host_of
from tagspark.operators.joins import split_lookup
from tagspark.sources.staging import stage

BUCKETS = 1 << 15


@dataclass(frozen=True)
class Evidence:
    # Bound of the labelled documents that the text model is fitted on.
    sample: int = 20_000
    # Neighbouring trigrams and words depend on each other, so evidence grows slower than a text:
    # n trigrams count for n to this power.
    text_power: float = 0.75
    # Pages that the wider prior counts for in a suffix's and in a host's.
    smoothing: float = 20.0


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams; runs of other characters are one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letters = ((points >= 97) & (points <= 122)) | (points >= 192)
    points = np.where(letters, points, 32)
    points = points[(points != 32) | (np.concatenate([[0], points[:-1]]) != 32)]
    if len(points) < 3:
        return np.empty(0, np.int64)
    mixed = (points[:-2] * 7919 + points[1:-1]) * 7919 + points[2:]
    return (mixed ^ (mixed >> 13)) % BUCKETS


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS, log probabilities


def fit_text_model(labelled: DataFrame, evidence: Evidence = Evidence()) -> TextModel:
    """Trigram model of `labelled (doc_id, text, lang, ...)`; rows without a language are left out.

    Beyond `evidence.sample` rows a fixed share of them by the hash of their ids is taken. What
    comes to the driver is one count per language and bucket.
    """
    known = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    n = known.count()
    share = min(1.0, evidence.sample / max(n, 1))
    taken = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10**6)) < int(share * 10**6))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = np.bincount(trigrams(text or ""), minlength=BUCKETS)
                totals[lang] = totals.get(lang, 0) + found
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                names=["lang", "bucket", "n"],
            )

    counted = taken.mapInArrow(count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    totals = np.ones((len(languages), BUCKETS))
    for r in rows:
        totals[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return TextModel(languages, np.log(totals / totals.sum(1, keepdims=True)).astype(np.float32))


def visible_text(html: Column) -> Column:
    """Text outside of tags, scripts and styles, in one pass over each."""
    text = F.coalesce(html, F.lit(""))
    for block in ("script", "style"):
        parts = F.split(text, f"(?i)<{block}")
        ended = F.transform(
            parts, lambda p, i: F.when(i == 0, p).otherwise(F.element_at(F.split(p, f"(?i)</{block}>", 2), -1))
        )
        text = F.array_join(ended, " ")
    return F.regexp_replace(text, "<[^<>]*>", " ")


def text_evidence(texts: DataFrame, model: TextModel, evidence: Evidence) -> DataFrame:
    """Add `text_scores`, one log-likelihood per language, to `texts (..., text)`."""
    languages, weights = len(model.languages), model.weights
    field = T.StructField("text_scores", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*texts.drop("text").schema, field])

    def score(batches):
        for batch in batches:
            scores = np.zeros((batch.num_rows, languages))
            for k, text in enumerate(batch.column("text")):
                found = trigrams(text.as_py() or "")
                if len(found) and languages:
                    scores[k] = weights[:, found].mean(1) * len(found) ** evidence.text_power
            offsets = np.arange(0, scores.size + 1, languages, dtype=np.int32) if languages else np.zeros(batch.num_rows + 1, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, column], names=[*kept.schema.names, "text_scores"])

    return texts.mapInArrow(score, schema)


def best(scores: str) -> Column:
    """Place of the highest score; the first of equal ones."""
    return F.array_position(F.col(scores), F.array_max(scores)).cast("int") - 1


def identify_language(pages: DataFrame, model: TextModel, evidence: Evidence = Evidence()) -> DataFrame:
    """`(page_id, host, declared, text_language, language, probability)`, one row per page row.

    `pages (page_id, url, html, ...)`. A null page has no text, so only its address speaks;
    null urls have an empty host. Repeated rows count as often as they are there; an empty table
    gives an empty one. Without any language known to the model, `language` is null.
    """
    langs = model.languages
    # The first tag of the kind, wherever it is; neither pattern goes over a text twice.
    root = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html(\s[^<>]*)>", 1)
    declared = F.lower(F.regexp_extract(root, r"(?i)\slang\s*=\s*[\"']?([a-z]+)", 1))
    host = host_of(F.col("url"))
    prepared = pages.select(
        "page_id", host.alias("host"), F.regexp_extract(host, r"([^.:]*)(:[0-9]*)?$", 1).alias("suffix"),
        F.when(declared.isin(langs), declared).otherwise(F.when(declared == "", "none").otherwise("other")).alias("declared"),
        visible_text(F.col("html")).alias("text"),
    )
    scored = text_evidence(prepared, model, evidence)
    scored = stage(
        scored.withColumn("first", best("text_scores")).withColumn("_row", F.monotonically_increasing_id()), "text-evidence"
    )

    def counts(*by: str) -> DataFrame:
        per = F.array(*[F.sum((F.col("first") == k).cast("double")) for k in range(len(langs))])
        return scored.groupBy(*by).agg(per.cast("array<double>").alias("n"), F.count(F.lit(1)).alias("pages"))

    # One row: counts of all pages per language, and how often each language declares what.
    overall = counts().first()["n"] or []
    total = sum(x or 0.0 for x in overall)
    base = [((x or 0.0) + 1.0) / (total + len(langs)) for x in overall]
    base_array = F.array(*map(F.lit, base)).cast("array<double>")

    def smooth(n: Column, wider: Column) -> Column:
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, wider, lambda x, w: (x + evidence.smoothing * w) / (size + evidence.smoothing))

    suffixes = stage(counts("suffix").withColumnRenamed("n", "suffix_n"), "suffixes")
    hosts = stage(counts("host").withColumnRenamed("n", "host_n"), "hosts")
    # At most languages + 2 values are declared.
    declarations = stage(counts("declared").select("declared", F.col("n").alias("declared_n")), "declared")
    kinds = len(langs) + 2
    sizes = F.array(*[F.lit((x or 0.0) + kinds) for x in overall]).cast("array<double>")
    said = F.transform(F.zip_with("declared_n", sizes, lambda n, s: (n + 1.0) / s), lambda p: F.log(p))
    with_host = split_lookup(
        scored.join(F.broadcast(declarations), "declared"), hosts.drop("pages"), "host", "_row", counts=(hosts, "pages")
    )
    joined = (
        split_lookup(with_host, suffixes.drop("pages"), "suffix", "_row", counts=(suffixes, "pages"))
        .withColumn("own", F.expr("transform(text_scores, (s, i) -> if(i = first, 1D, 0D))"))
        .withColumn("host_rest", F.zip_with("host_n", "own", lambda n, o: n - o))
        .withColumn("suffix_prior", smooth(F.zip_with("suffix_n", "own", lambda n, o: n - o), base_array))
        .withColumn("prior", smooth(F.col("host_rest"), F.col("suffix_prior")))
        .withColumn("said", said)
        .withColumn("scores", F.zip_with(
            F.zip_with("text_scores", "said", lambda a, b: a + b), F.col("prior"), lambda a, p: a + F.log(p)
        ))
    )
    names = F.array(*map(F.lit, langs)).cast("array<string>")
    top = F.array_max("scores")
    mass = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return joined.select(
        "page_id", "host", "declared", F.get(names, F.col("first")).alias("text_language"),
        F.get(names, best("scores")).alias("language"), (1.0 / mass).alias("probability"),
    )
