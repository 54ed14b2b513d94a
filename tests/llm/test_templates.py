import re

from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.templates import Tree, dedup_lines, drop_repeated_lines
from conftest import SF

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain(docs, tree=Tree()):
    """The same templates with dictionaries of texts."""
    lines = {}
    for i, text in docs.items():
        for pos, line in enumerate((text or "").split("\n")):
            spaced = re.sub("^ +| +$", "", SPACE.sub(" ", line))
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in spaced.split(" "))
            if spaced and len(tokens) >= tree.min_tokens:
                lines.setdefault(tokens, []).append((i, pos))
    leaves = {}
    for tokens in lines:
        leaves.setdefault((len(tokens), tokens[: tree.depth]), []).append(tokens)
    templates = {}
    for leaf, kinds in leaves.items():
        ids = {i for t in kinds for i, _ in lines[t]}
        support = {}
        for t in kinds:
            for p in range(tree.depth, len(t)):
                support[p, t[p]] = support.get((p, t[p]), 0) + len({i for i, _ in lines[t]})
        for t in kinds:
            constant = tuple(tok if p < tree.depth or support[p, tok] >= tree.min_documents else None for p, tok in enumerate(t))
            share = sum(c is not None for c in constant) / len(t)
            general = len(kinds) > 1 and len(ids) > 1 and len(t) > tree.depth and share >= tree.constant_share
            templates.setdefault(("general", leaf, constant) if general else ("own", t), []).extend(lines[t])
    dropped = set()
    for where in templates.values():
        if len({i for i, _ in where}) >= tree.min_documents:
            dropped |= set(where) - {min(where)}
    return {
        i: None if text is None else "\n".join(l for p, l in enumerate(text.split("\n")) if (i, p) not in dropped)
        for i, text in docs.items()
    }


def test_templates(spark):
    docs = {
        1: "Posted on 2021 by Ann in the news section today\nkeep me one two\n\nshort",
        2: "Posted on 2022 by Ben in the news section today\nshort\n\nown words of this text",
        3: "Posted on 2023  by Cy in the news section today\nkeep me one two\nkeep me one two",
        4: None, 5: "", 6: "Posted on <*> or else nothing equal here at all", 7: "a b c\n" * 3_000,
        8: "The end of the line is here\r\nx y z", 9: "The end of the line is here\nx y  z",
    }
    rows = list(docs.items()) + [(8, docs[8]), (None, "keep me one two"), (None, "keep me one two\nand more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit(1)).withColumn("_row", F.lit(2))
    found = dedup_lines(frame).collect()
    assert len(found) == len(rows)
    assert sorted(r["text"] for r in found if r["doc_id"] is None) == ["keep me one two", "keep me one two\nand more"]
    got = {r["doc_id"]: r["text"] for r in found if r["doc_id"] is not None}
    want = plain(docs)
    assert got == want
    assert "Posted" in got[1] and "Posted" not in (got[2] + got[3]) and "Posted" in got[6]
    assert dedup_lines(frame.limit(0)).count() == 0
    assert drop_repeated_lines(frame).columns == frame.columns


def test_rows_of_one_id_keep_their_texts(spark):
    rows = [
        (2, "one text that is here alone\nand said by three of them", 1), (2, "another text that is not\nand said by three of them", 1),
        (3, "and said by three of them", 25), (4, "left out of this", 16),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("_text", F.lit("x"))
    kept = drop_repeated_lines(frame)
    assert kept.columns == frame.columns
    got = sorted((r["doc_id"], r["text"], r["n_chars"], r["_text"]) for r in kept.collect())
    firsts = [t.split("\n")[0] for _, t, _ in rows[:2]]
    assert [r[0] for r in got] == [2, 2, 4] and {r[1].split("\n")[0] for r in got[:2]} == set(firsts)
    # The line stays once, in one of the two documents of the smallest id.
    assert sum("three of them" in r[1] for r in got) == 1
    assert {r[2] for r in got if "three" not in r[1]} == {16, 27, 24} & {r[2] for r in got} | {len(r[1]) for r in got if r[0] == 2 and "three" not in r[1]}


def test_many_different_lines(spark):
    import time

    def seconds(n):
        texts = ["\n".join(f"line {d}{k:06x}q of many that differ in word z{k * 7:x}y" for k in range(n)) for d in ("a", "b")]
        texts = [t.replace("z", f"{i}z") for i, t in enumerate(texts)]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        start = time.perf_counter()
        rows = dedup_lines(frame).collect()
        assert [r["n_lines"] for r in rows] == [n, n]
        return time.perf_counter() - start

    seconds(100)
    assert seconds(50_000) < seconds(1_000) + 10


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = {r["doc_id"]: r for r in dedup_lines(table(spark, SF, "documents")).collect()}
    want = plain(docs)
    assert {i: r["text"] for i, r in got.items()} == want
    for i, r in got.items():
        assert r["n_lines"] == len(docs[i].split("\n"))
        assert r["n_dropped"] == (r["n_lines"] - len(want[i].split("\n")) if want[i] else r["n_dropped"])
