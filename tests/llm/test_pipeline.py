from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tagspark.llm.common import table
from tagspark.llm.mixing import mix_sources
from tagspark.llm.quality import judge_quality
from tagspark.llm.simhash import fingerprint
from conftest import SF
from .test_simhash import classes
from .test_templates import plain as without_repeated_lines


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}

    good = stages["quality_rules"](spark, docs, SF).cache()
    kept = {r["doc_id"] for r in judge_quality(docs).filter("kept").collect()}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == kept < set(rows)

    lines = stages["line_dedup"](spark, good, SF).cache()
    want = without_repeated_lines({i: rows[i]["text"] for i in kept})
    want = {i: t for i, t in want.items() if t.strip() or t == rows[i]["text"]}
    assert lines.columns == columns
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want

    once = stages["simhash_near_dedup"](spark, lines, SF).cache()
    ids = sorted(want)
    named = classes(ids, [fingerprint(want[i], 4) for i in ids])
    assert once.columns == columns and {r["doc_id"] for r in once.collect()} == set(named)

    mixed = stages["mix_sources"](spark, once, SF).cache()
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(once).collect()}
    assert mixed.columns == columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    packed = stages["best_fit_packing"](spark, mixed, SF).toPandas()
    assert set(packed["doc_id"]) == {i for i, n in copies.items() if n}
    ends = packed.groupby("sequence_id")["length"].sum()
    assert (ends <= 2048).all() and len(ends) <= 1.02 * packed["length"].sum() / 2048 + 2


def test_odd_rows_go_through(spark):
    good = "Some words that make a good sentence here, number {k} of many. It has more than fifty words. " * 4
    rows = [(k, "".join(f"w{k}x{j} " for j in range(60)) + good.format(k=k), "en", "s", 1) for k in range(6)]
    rows += [(3, rows[3][1], "en", "s", 1), (None, rows[2][1] + " more", None, None, None), (50, None, None, None, None), (51, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs.withColumn("sequence_id", F.lit("clash")), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            given = stage(spark, given, SF)
        given.collect()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"
    ]
