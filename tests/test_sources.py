"""Files, models and the whole job from files to the submission."""

from pyspark.sql import functions as F

from conftest import SF
from tagspark.plans import catalog, jobs
from tagspark.plans.fixtures import q_test, q_train
from tagspark.sources.questions import (
    read_ordered, read_questions, write_presubmission, write_questions, write_submission,
)
from tagspark.sources.staging import discard, stage, stage_buckets

NASTY = [
    (1, 'quote " and ""', "line\nbreak\r\nand \\ backslash", "a b"),
    (2, "", "  blanks  ", ""),
    (3, "comma, and 'single'", '"', "éK"),
    (4, "\\", "\\\"", "t\n"),
]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(NASTY, "Id long, Title string, Body string, Tags string")
    path = str(tmp_path / "train")
    write_questions(df, path)
    assert sorted(map(tuple, read_questions(spark, path).collect())) == NASTY


def test_csv_test_file(spark, tmp_path):
    path = tmp_path / "test.csv"
    path.write_text('"Id","Title","Body"\n5,"a ""b""","x\ny"\n6,"",""\n')
    rows = sorted(map(tuple, read_questions(spark, str(path), testing=True).collect()))
    assert rows == [(5, 'a "b"', "x\ny"), (6, "", "")]


def test_submission_is_ordered(spark, tmp_path):
    df = spark.range(1000).select((999 - F.col("id")).alias("Id"), F.lit("t").alias("Tags"))
    path = str(tmp_path / "submission")
    write_submission(df, path)
    lines = []
    for part in sorted((tmp_path / "submission").glob("part-*")):
        lines += part.read_text().splitlines()[1:]
    assert [int(line.split(",")[0].strip('"')) for line in lines] == list(range(1000))


def test_predictions_are_writable(spark, tmp_path):
    tags = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit('a "b"\n'), F.col("id").cast("string")))
    predicted = spark.range(500).select((499 - F.col("id")).alias("test_idx"), tags.alias("tags")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_submission(predicted, str(tmp_path / "submission"))
    write_presubmission(predicted, str(tmp_path / "presubmission"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r["tags"] for r in predicted.orderBy("test_idx").collect()]
    whole = read_ordered(spark, str(tmp_path / "submission"), "Id long, Tags string").orderBy("position").collect()
    assert [tuple(r) for r in whole] == [(6034196 + k, t, k) for k, t in enumerate(want)]
    alone = read_ordered(spark, str(tmp_path / "presubmission"), "Tags string").orderBy("position").collect()
    assert [tuple(r) for r in alone] == [(t, k) for k, t in enumerate(want)]
    assert len(list((tmp_path / "presubmission").glob("part-*"))) > 1


def test_staged_tables_can_be_deleted(spark):
    import os

    rows = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("part"))
    for stored in (stage(rows, "t"), stage_buckets(rows, "t", "id", 4), stage_buckets(rows, "t", "id", 4, "part")):
        assert stored.count() == 100
        path = stored.staged_path.removeprefix("file:")
        assert os.path.isdir(path)
        discard(stored)
        assert not os.path.exists(path)


def test_whole_job(spark):
    train, test = q_train(spark, SF), q_test(spark, SF)
    prepared = jobs.prepare(train, test, min_df=0.01)
    assert prepared.documents.count() == train.select("title").distinct().count()
    settings = jobs.Settings(iterations=2, score_every=2)
    n = prepared.documents.count()
    positions = [r[0] for r in prepared.documents.select("position").collect()]
    assert sorted(positions) == list(range(n))
    rows, held_out = jobs.split_rows(prepared.documents, n * 3 // 4, n + 1 - n * 3 // 4, "position")
    assert (rows.count(), held_out.count()) == (n * 3 // 4 - 1, n + 1 - n * 3 // 4)
    size = n + 1 - n * 3 // 4
    model = jobs.train_all(prepared, 5, 3, n * 3 // 4, size, settings)
    apart = [jobs.train(prepared, first, k, n * 3 // 4, size, settings).model for first, k in ((0, 3), (3, 2))]
    weights = {r["feature_id"]: r["w"] for r in model.weights.collect()}
    first, second = ({r["feature_id"]: r["w"] for r in m.weights.collect()} for m in apart)
    assert weights == {k: first.get(k, [0.0] * 3) + second.get(k, [0.0] * 2) for k in first | second}
    answers = jobs.submission(test, train, prepared.repeated, prepared.text_model, model)
    rows = {r["Id"]: r["Tags"] for r in answers.collect()}
    assert len(rows) == test.count()
    known = {r["test_idx"]: r["train_idx"] for r in prepared.repeated.collect()}
    tags = {r["idx"]: r["tags"] for r in train.select("idx", "tags").collect()}
    assert all(rows[6034196 + t] == tags[i] for t, i in known.items())
