import hashlib
import re

from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.merkle import branches, differing, merkle_fingerprints, tree
from conftest import SF


def edited(rows):
    """(doc_id, text) -> (own text, edited text, next of these), for distinct `rows`."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, r in enumerate(order):
        following = order[(k + 1) % len(order)]
        own, after = r[1] or "", following[1] or ""
        n = len(own) // 3
        out[r] = (own, own[: len(own) - n] + after[:n], following)
    return out


def phrases(fingerprint):
    return set(re.findall(r"([0-9a-f]{16})(?=[,\]])", fingerprint))


def compare(rows, frame):
    """`rows` are distinct, with an id each; `frame` may hold them several times."""
    found = merkle_fingerprints(frame).collect()
    given = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in given)
    got = {r["doc_id"]: r for r in found}
    want = edited(rows)
    for (i, _), (own, after, following) in want.items():
        r = got[i]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(after.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (own == after)
        for key, other in (("near_edited", r["edited_fingerprint"]), ("near_next", got[following[0]]["fingerprint"])):
            a, b = phrases(r["fingerprint"]), phrases(other)
            share = 2 * len(a & b) / (len(a) + len(b))
            alike = 1.0 if r["fingerprint"][:64] == other[:64] else min(share, 1 - 1e-9)
            assert abs(r[key] - alike) < 1e-9
    return got


def test_odd_rows(spark):
    rows = {
        1: None, 2: "", 7: "one two three four five six seven eight nine ten", 9: "é🙂" * 5_000, 4: "same text\nhere",
        5: "same text\nhere", None: "x y z", 11: "a\n\n\nb " * 2_000,
    }
    repeated = list(rows.items()) + [(4, "same text\nhere"), (2, None), (2, None)]
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = compare(list(rows.items()), frame)
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[5]["near_next"] == 1.0
    again = spark.createDataFrame(repeated, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    found = merkle_fingerprints(again).collect()
    assert len(found) == len(repeated)
    # Rows alike are alike in all columns; a row of the same id and another text is another document.
    assert len({tuple(r) for r in found if r["doc_id"] == 4}) == 1
    assert {r["fingerprint"] for r in found if r["doc_id"] == 2} == {got[2]["fingerprint"]}
    assert merkle_fingerprints(frame.limit(0)).count() == 0
    assert merkle_fingerprints(frame.filter("doc_id = 7")).count() == 1


def test_rows_of_one_id_keep_their_texts(spark):
    rows = [(2, "first text of two"), (2, "second text of two, longer"), (3, "third"), (None, "a"), (None, "b b b")]
    found = merkle_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in found) == sorted((str(i), len(t)) for i, t in rows)
    assert len({r["fingerprint"] for r in found}) == 5


def test_different_texts_have_different_roots(spark):
    pairs = [("a020878", "a089197"), ("x\x01y", "xy"), ("x\x01\x02y", "x\x01y"), ("x \x01 y", "x  y"), ("a\n", "a"), ("a b", "a\nb")]
    # A phrase is cut after words of some hashes only: a literal mark cannot stand for a cut.
    pairs += [(f"w{k} z", f"w{k}\x01\x03 z") for k in range(40)] + [(f"w{k} z", f"w{k}\x01 z") for k in range(40)]
    frame = tree(tree(spark.createDataFrame(pairs, "x string, y string"), "x", "a"), "y", "b")
    for r in frame.select("x", "y", "a", "b", differing("a", "b", "phrase").alias("d")).collect():
        assert r["a"][:64] != r["b"][:64], r
        assert r["d"] or r["x"] + "\n" == r["y"] or r["y"] + "\n" == r["x"]


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = compare([(r["doc_id"], r["text"]) for r in docs.collect()], docs)
    long_ = [r for r in got.values() if r["n_chars"] > 600]
    assert sum(r["near_edited"] for r in long_) / len(long_) > 0.5
    assert sorted(r["near_next"] for r in long_)[len(long_) // 2] < 0.2


def test_branches_locate_an_edit(spark):
    lines = [f"paragraph {k} with some words of its own" for k in range(40)]
    changed = lines[:17] + ["another line"] + lines[18:]
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "x string, y string")
    both = tree(tree(frame, "x", "a"), "y", "b")
    r = both.select(
        differing("a", "b", "paragraph").alias("paragraphs"), F.size(differing("a", "b", "section")).alias("sections"),
        F.size(branches("a", "paragraph")).alias("n"), F.size(branches("a", "section")).alias("all"),
    ).first()
    assert r["paragraphs"] == [17] and r["n"] == 40 and 1 <= r["sections"] <= 2 < r["all"]


def test_native_plan(spark):
    assert "Python" not in merkle_fingerprints(table(spark, SF, "documents"))._jdf.queryExecution().toString()
