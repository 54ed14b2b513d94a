"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagspark.llm.common import table
from tagspark.llm.language import fit_text_model, identify_language
from tagspark.llm.lm import lm_scores
from tagspark.llm.merkle import merkle_fingerprints
from tagspark.llm.mixing import Mix, mix_sources, source_targets, word_count
from tagspark.llm.negatives import hard_negatives, quantised
from tagspark.llm.neighbours import near_vectors
from tagspark.llm.packing import pack_documents
from tagspark.llm.quality import judge_quality
from tagspark.llm.simhash import near_duplicates
from tagspark.llm.sql import ORACLES
from tagspark.llm.spelling import spelling_variants
from tagspark.llm.templates import dedup_lines
from tagspark.llm.tokens import crc_of_ids, write_token_files
from tagspark.llm.urls import UrlRule, host_of, judge_urls, path_of, rule_for

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_TOKENIZER, BYTE_END = "byte_bpe_50k.json", 2
WORD_TOKENIZER, WORD_END = "word_bpe_49k.json", 0


def op1_token_files(spark, sf):
    files = write_token_files(table(spark, sf, "documents"), vocabulary(BYTE_TOKENIZER), BYTE_END)
    return files.documents(crc_of_ids, "ids_crc32 long")


def op2_line_templates(spark, sf):
    return dedup_lines(table(spark, sf, "documents"))


def op3_best_fit_packing(spark, sf):
    return pack_documents(table(spark, sf, "documents"), vocabulary(WORD_TOKENIZER), WORD_END)


def op4_mix_sources(spark, sf):
    return mix_sources(table(spark, sf, "documents"))


URL_RULES = [
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
]


def op5_url_templates(spark, sf):
    """A page is labelled by the document whose number its path ends with."""
    pages = table(spark, sf, "pages")
    number = F.regexp_extract("url", r"://[^/?#]*/[^?#]*?([0-9]{1,18})[^0-9?#]*([?#]|$)", 1)
    numbered = pages.select("page_id", number.try_cast("long").alias("doc_id"))
    labels = table(spark, sf, "labels").select(
        "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    return judge_urls(pages, numbered.join(labels, "doc_id").select("page_id", "good"), URL_RULES)


def op6_page_language(spark, sf):
    model = fit_text_model(table(spark, sf, "documents"))
    return identify_language(table(spark, sf, "pages"), model)


def op7_recurrent_scores(spark, sf):
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = table(spark, sf, "documents").withColumn("held_out", number % 7 == 2)
    return lm_scores(docs)


def op8_simhash(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=4, distance=4)


def op9_quality_votes(spark, sf):
    return judge_quality(table(spark, sf, "documents"))


def op10_merkle_trees(spark, sf):
    return merkle_fingerprints(table(spark, sf, "documents"))


def op11_neighbour_descent(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))


def op12_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


def op13_hard_negatives(spark, sf):
    vectors = table(spark, sf, "embeddings")
    # Every seventh row gets another label, so that rows much alike differ in theirs.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(
        quantised(vectors.withColumn("label", moved), 256), F.col("vec_id") % 100 == 0
    )


# What the operators above work with, for itself: these parts have a form in SQL.


def quality_statistics(spark, sf):
    """The statistics that base_failed rests on."""
    return judge_quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )


def mix_targets(spark, sf):
    """How many words the mix is to take from each source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return source_targets(docs, Mix()).select("source", "source_size", F.round("target", 3).alias("target"))


def url_rules(spark, sf):
    """Host, path and rule of every address."""
    pages = table(spark, sf, "pages").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    return pages.withColumn("rule", rule_for(URL_RULES, F.col("host"), F.col("path"))["rule"])


def edited_texts(spark, sf):
    """Digests of the edited texts that the Merkle trees are compared on."""
    return merkle_fingerprints(table(spark, sf, "documents")).select("doc_id", "n_chars", "edited_sha256")


QUERIES = (
    op1_token_files, op2_line_templates, op3_best_fit_packing, op4_mix_sources, op5_url_templates,
    op6_page_language, op7_recurrent_scores, op8_simhash, op9_quality_votes, op10_merkle_trees,
    op11_neighbour_descent, op12_spelling_variants, op13_hard_negatives,
    quality_statistics, mix_targets, url_rules, edited_texts,
)


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def llm_oracles() -> dict[str, str]:
    """For the queries that SQL can express; models, trees, XXH64, crc32 and file formats are
    tested against plain Python instead."""
    return dict(ORACLES)
