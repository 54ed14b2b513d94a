import re

from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.quality import Settings, judge_quality, text_statistics
from conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if twice is None:
        from collections import Counter

        twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


CASES = [
    (1, None), (2, ""), (3, "a b c a b c"), (4, "x\nx\n \n \ny #*$%&|<>"), (4, "x\nx\n \n \ny #*$%&|<>"),
    (None, "a\tb\x0bc\x0cd\re"), (5, "  é🙂 a b"), (6, "w " * 20_000), (7, "a b a b a b a"), (8, "\n\n"),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_of_odd_texts(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = sorted(map(repr, ((r[0], *r[1:]) for r in text_statistics(docs).select("doc_id", *COUNTS).collect())))
    assert got == sorted(map(repr, ((i, *base(t)) for i, t in CASES)))
    assert judge_quality(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = judge_quality(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == base(texts[r["doc_id"]])
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_posterior_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").withColumnRenamed("quality", "label")
    judged = judge_quality(table(spark, sf, "documents")).join(labels, "doc_id").filter(~F.col("base_failed"))
    right = judged.agg(F.avg(((F.col("label") == 1) == F.col("kept")).cast("int"))).first()[0]
    assert right > 0.97


def test_native_plan(spark):
    plan = judge_quality(table(spark, SF, "documents"), settings=Settings(iterations=1))
    assert "Python" not in plan._jdf.queryExecution().toString()
