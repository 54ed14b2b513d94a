"""What the physical plans may and may not contain."""

import re

import pytest

from conftest import SF
from tagspark.functions.clean import clean_questions
from tagspark.operators import dedup, features, ordering, projection, scoring, training
from tagspark.plans import catalog, jobs
from tagspark.plans.fixtures import q_docs, q_test, q_train, table
from tagspark.sources.staging import stage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan(df)))


@pytest.fixture(scope="module")
def documents(spark):
    docs = stage(clean_questions(q_docs(spark, SF)), "documents")
    return docs, features.TfidfModel.fit(docs, 0.01)


def test_no_python_and_no_cross_join(spark, documents):
    docs, model = documents
    for df in (
        clean_questions(q_docs(spark, SF)),
        model.transform(docs, bias=True),
        dedup.match_known(q_test(spark, SF), q_train(spark, SF)),
        catalog.all_queries()["running_coverage"](spark, SF),
    ):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text


def test_cleaning_does_not_shuffle(spark):
    assert exchanges(clean_questions(table(spark, SF, "pages").selectExpr(
        "page_id as idx", "url as title", "html as body"))) == 0


def test_tfidf_shuffles_once_and_only_after_the_lookup(documents):
    docs, model = documents
    text = plan(model.transform(docs))
    assert exchanges(model.transform(docs)) == 1
    assert text.index("Window") < text.index("Exchange hash") < text.index("BroadcastHashJoin")
    partitioned = docs.repartition(8, "idx")
    assert exchanges(model.transform(partitioned)) == 1


def test_columns_and_ranges_reach_the_scan(spark, documents):
    docs, _ = documents
    text = plan(catalog.ordering.slice_rows(docs, 10, 20).select("idx", "tags"))
    assert "GreaterThanOrEqual(idx,9)" in text and "LessThanOrEqual(idx,18)" in text
    assert "ReadSchema: struct<idx:bigint,tags:string>" in text


def test_duplicates_shuffle_bodies_by_row_only(spark):
    docs = table(spark, SF, "documents").selectExpr("doc_id as idx", "text as title", "text as body")
    text = plan(dedup.dedup_by_title(docs))
    # The rows with bodies are never partitioned by title.
    wide = [l for l in text.splitlines() if "Exchange hashpartitioning(title" in l]
    assert len(wide) == 1 and "partial_min" in text


@pytest.fixture
def fixed_plans(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.debug.maxToStringFields": "1000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def largest_method(spark, df) -> int:
    """Bytes of the largest generated method; those above 8000 are not compiled."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


@pytest.mark.parametrize("batches", [None, 3])
def test_an_iteration_neither_moves_nor_sorts_features(spark, documents, fixed_plans, batches):
    docs, model = documents
    names = ["en", "de", "fr", "es", "src1", "src2", "src3", "src4", "src5", "src6"]
    labelled = docs.withColumn("tags", docs["text"])
    packed = training.packed_rows(jobs.training_features(labelled, model, names))
    rows = training.stored_rows(packed, "plan_train", batches)
    if batches:
        rows = rows.filter("batch = 1").select("idx", "labels", "features")
    start = stage(training.initial_state(model.terms, len(names)), "state")
    sums = training.gradient_sums(rows, training.block_columns(start), 1000, "f_measure")
    text = plan(sums)
    assert "Sort" not in text and "ShuffledHashJoin" in text
    # The only exchanges: the broadcast weights, and the gradient sums by feature.
    assert exchanges(sums) == 1 and "hashpartitioning(feature_id" in text
    # Outputs are taken once a row, below the join that meets the features.
    above, below = text.split("ShuffledHashJoin")
    assert " AS t0#" in below and " AS t0#" not in above and "EXP" not in above
    if batches:
        assert "PartitionFilters: [isnotnull(batch" in text
    assert largest_method(spark, sums) < 8000


def test_scores_of_fifty_tags_are_compiled(spark, documents, fixed_plans):
    docs, model = documents
    weights = model.terms.select("feature_id", features.F.array_repeat(features.F.lit(0.5), 50).alias("w"))
    tags = scoring.LinearModel(stage(weights, "weights"), [f"t{r}" for r in range(50)])
    scored = scoring.score(model.transform(docs, bias=True), tags)
    assert exchanges(scored) == 1
    assert largest_method(spark, scored) < 8000


def test_only_pairs_of_kept_words_are_shuffled(spark, documents, fixed_plans):
    docs, _ = documents
    n = docs.count()
    text = plan(features.frequent_terms(docs, n, 0.05))
    grouped = text[text.index("hashpartitioning(term"):]
    assert grouped.count("BroadcastHashJoin") == 2 and "LeftSemi" in grouped
    all_terms = features.doc_freq(docs)
    kept = {(r["term"], r["df"]) for r in features.vocabulary(all_terms, n, 0.05).collect()}
    assert {tuple(r) for r in features.frequent_terms(docs, n, 0.05).collect()} == kept
    words = {t for t, _ in kept if " " not in t}
    pairs = [r["term"] for r in all_terms.filter("term like '% %'").collect()]
    assert sum(set(p.split(" ")) <= words for p in pairs) < len(pairs) / 2


def test_top_k_is_ranked_in_two_steps(spark, fixed_plans):
    counts = spark.range(5000).selectExpr("id % 2 as bin", "cast(id as string) as word", "id * 7919 % 1000 as cnt")
    best = ordering.top_k_per_group(counts, "bin", 20, "word")
    text = plan(best)
    assert len(re.findall(r"\bWindow \[", text)) == 2 and "hashpartitioning(bin" in text and "_split" in text
    rows = sorted(counts.collect(), key=lambda r: (r["bin"], -r["cnt"], r["word"]))
    want = [[r["word"] for r in rows if r["bin"] == b][:20] for b in (0, 1)]
    got = [[r["word"] for r in sorted(best.filter(f"bin = {b}").collect(), key=lambda r: r["position"])] for b in (0, 1)]
    assert got == want


def test_projected_rows_stay_where_they_are(spark, documents, fixed_plans):
    docs, model = documents
    cells = stage(projection.projection(model.terms, model.terms.count(), 32), "cells")
    rows = projection.projected_rows(model.transform(docs, bias=True), cells, 32)
    # By document for the norms, and by feature for the packed cells.
    text = plan(rows)
    assert exchanges(rows) == 2 and "hashpartitioning(dim" not in text
    assert all(len(r["values"]) == 32 for r in rows.collect()) and rows.count() == docs.count()


def test_runs_read_their_own_files(spark):
    docs = q_docs(spark, SF)
    stats = catalog.cut(catalog.tagstats.tag_rank(docs))
    index = catalog.tagstats.index_occurrences(docs, stats, part_rows=40)
    wanted = catalog.tagstats.top_tags(stats, 1, 5)
    run = index.runs(wanted)
    tag = wanted.first()
    rows = run.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(tag["offset"], tag["offset"] + tag["cnt"]))
    assert {r["tag_id"] for r in rows} == {tag["tag_id"]}
    assert [r["idx"] for r in rows] == sorted(r["idx"] for r in rows)
    names = features.F.input_file_name().alias("f")
    assert run.select(names).distinct().count() < index.rows.select(names).distinct().count() / 3
    assert "PartitionFilters: [part" in plan(run) and "position" in plan(run).split("PushedFilters")[1]
