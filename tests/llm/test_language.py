import math

import numpy as np
from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.language import Evidence, fit_text_model, identify_language, trigrams
from conftest import SF


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = fit_text_model(docs.filter("doc_id % 2 = 0"))
    assert len(model.languages) == 4 and np.allclose(np.exp(model.weights.astype(float)).sum(1), 1, atol=1e-3)
    held = docs.filter("doc_id % 2 = 1").select(
        F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html"), "lang"
    )
    got = identify_language(held, model).join(held.select("page_id", "lang"), "page_id")
    assert got.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_pages(spark):
    model = fit_text_model(table(spark, SF, "documents"))
    pages = table(spark, SF, "pages")
    got = identify_language(pages, model).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(got) == pages.count()
    right = [r["language"] == r["url"].split("/")[3] for r in got]
    assert sum(right) / len(right) > 0.95


def test_evidence_by_hand(spark):
    """Without text only the declaration and the host's and suffix's pages speak."""
    docs = [(k, t * 30, l) for k, (t, l) in enumerate([("the house and ", "en"), ("der haus und ", "de")] * 5)]
    model = fit_text_model(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows = [(k, "http://a.xx/", "der haus und " * 20) for k in range(6)]
    rows += [(k, "http://b.xx/", "the house and " * 20) for k in range(6, 10)]
    rows += [(20, "http://a.xx/", None), (21, None, ""), (22, "http://b.xx/", '<html lang="de">'), (6, "http://b.xx/", "the house and " * 20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("language", F.lit("clash"))
    found = identify_language(frame, model).collect()
    assert len(found) == len(rows)
    got = {r["page_id"]: r for r in found}
    assert all(got[k]["language"] == ("de" if k < 6 else "en") for k in range(10))
    # Empty texts are nobody's: all scores equal, and the first language has their vote.
    n = {"de": 6 + 3, "en": 5}
    base = {k: (v + 1) / (sum(n.values()) + 2) for k, v in n.items()}
    suffix = {"de": 6 + 2, "en": 5}
    suffix = {k: v - (k == "de") for k, v in suffix.items()}
    prior = {k: (suffix[k] + 20 * base[k]) / (sum(suffix.values()) + 20) for k in base}
    host = {"de": 6, "en": 0}
    prior = {k: (host[k] + 20 * prior[k]) / (6 + 20) for k in base}
    said = {"de": (n["de"] - 1 + 1) / (n["de"] + 4), "en": (5 + 1) / (5 + 4)}
    odds = {k: math.log(prior[k]) + math.log(said[k]) for k in base}
    top = max(odds, key=odds.get)
    assert got[20]["language"] == top
    assert abs(got[20]["probability"] - math.exp(odds[top]) / sum(map(math.exp, odds.values()))) < 1e-9
    assert identify_language(frame.limit(0), model).count() == 0


def test_trigrams():
    assert len(trigrams("")) == 0 and len(trigrams("a")) == 1
    assert trigrams("Été 12").tolist() == trigrams(" été").tolist()
    assert Evidence().sample > 0


def test_the_whole_page_is_read(spark):
    """A declaration behind a long comment, and unclosed tags in any number."""
    model = fit_text_model(table(spark, SF, "documents"))
    rows = [
        (1, "http://a.xx/", "<!-- " + "c" * 5_000 + ' --><HTML class="x" LANG=\'de\'>'),
        (2, "http://a.xx/", "<html " * 50_000), (3, "http://a.xx/", '<html data-lang="de">'),
        (4, "http://a.xx/", '<html\nlang = fr-CH>'), (5, "http://a.xx/", '<html lang="xx">'),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["declared"] for r in identify_language(frame, model).collect()}
    assert got == {1: "de", 2: "none", 3: "none", 4: "fr", 5: "other"}


def test_longer_texts_speak_louder(spark):
    docs = [(k, t * 30, l) for k, (t, l) in enumerate([("the house and ", "en"), ("der haus und ", "de")] * 5)]
    model = fit_text_model(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    rows = [(k, None, "the house and der " * 4**k) for k in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in identify_language(frame, model).collect()}
    assert all(got[k]["language"] == "en" for k in got)
    found = [got[k]["probability"] for k in range(5)]
    assert found == sorted(found)
