"""The cleaning rules on literal rows, and against plain patterns on random text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tagspark.functions import clean


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expression(F.col("c")).alias("r")).first()["r"]


def blocks(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    return clean.extract_blocks(df).first().asDict()


def text(spark, title, body):
    df = spark.createDataFrame([(1, title, body)], "idx long, title string, body string")
    return clean.clean_questions(df).first()["text"]


def test_blocks(spark):
    got = blocks(spark, "<pre><code>a b</code></pre>")
    assert (got["code"], got["pre"]) == (["a b"], [""])
    got = blocks(spark, "<li><p>x</p></li>")
    assert (got["p"], got["li"]) == (["x"], [""])
    got = blocks(spark, '<p class="q">x</p><prefix>y</prefix>')
    assert (got["p"], got["pre"]) == (["x"], [])
    assert blocks(spark, '<code class="c">x</code>')["code"] == []
    assert blocks(spark, "<p>a\nb</p><p\n>c</p>")["p"] == ["a\nb", "c"]


def test_unclosed_blocks(spark):
    got = blocks(spark, "<p>a</p><p>b<li>c</li><li>d")
    assert (got["p"], got["li"]) == (["a"], ["c"])
    # Scanned once, not once per tag.
    assert blocks(spark, "<p>x</p>" + "<p>y " * 200_000)["p"] == ["x"]
    for name in ("p", "li", "pre"):
        for tail in ("", f"</{name}>"):
            many = f"<{name} " * 200_000 + tail
            start = time.perf_counter()
            assert blocks(spark, f"<{name}>a</{name}>" + many)[name] == ["a"]
            assert blocks(spark, many)[name] == []
            assert time.perf_counter() - start < 10


@pytest.mark.parametrize(
    "title, body, expected",
    [
        ("T", "<h1>gone</h1><p>k</p>", "t k"),
        ("", "<li>l</li><code>c</code><p>p</p><pre>r</pre>", "p c l r"),
        ("", "<p>a &lt;b&gt; c</p>", "a c"),
        ("", "<p>a &amp; b</p>", "a amp b"),
        ("Got 12 of", "", "got one two of"),
        ("x [1] {y} (z)", "", "x z"),
        ("a 1 2 b", "", "a one two b"),
        ("a (12) 3", "", "a one two 3"),
        ("K İx", "<p>KÉ</p>", "x"),
        ("", "", ""),
    ],
)
def test_documents(spark, title, body, expected):
    assert text(spark, title, body) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a<b\nc>d", "a b c d"),
        ("a<b\rc>d", "ad"),
        ("5 x 6", "5 x 6"),
        ("a 4g b", "a 4g b"),
        ("c# c++ a-b", "c# c++ a-b"),
        ("K", ""),
    ],
)
def test_normalize(spark, value, expected):
    got = one(spark, value, lambda c: clean.normalize(clean.ascii_lower(c)))
    assert " ".join(got.split()) == expected


def test_trim_words(spark):
    forty = [f"w{i}" for i in range(40)]
    assert one(spark, " ".join(forty), clean.trim_words).split() == forty
    more = [f"w{i}" for i in range(41)]
    assert one(spark, " ".join(more), clean.trim_words).split() == more[:20] + more[-20:]
    assert one(spark, "  ", clean.trim_words) == ""


def test_join_fragments(spark):
    df = spark.createDataFrame([(["", " ", "a", "  "],), ([],)], "f array<string>")
    assert [r[0] for r in df.select(clean.join_fragments(F.col("f"))).collect()] == ["a", ""]


@pytest.mark.parametrize(
    "tag, value, expected", [("a-b", "xbxax", True), ("a-b", "a", False), ("-", "", True), ("", "", True)]
)
def test_tag_detected(spark, tag, value, expected):
    df = spark.createDataFrame([(tag, value)], "t string, v string")
    assert df.select(clean.tag_detected(F.col("t"), F.col("v"))).first()[0] is expected


def spelled(value):
    tokens = value.split(" ")
    for i, t in enumerate(tokens):
        if 0 < i < len(tokens) - 1 and re.fullmatch("[0-9]+", t):
            tokens[i] = "".join(clean.DIGIT_WORDS[int(d)] + " " for d in t)
    return " ".join(tokens)


def test_patterns_equal_their_plain_form(spark):
    rng = random.Random(5)
    rows = ["".join(rng.choices("<>[]{}\n\ra1 é€#", k=rng.randint(0, 40))) for _ in range(4000)]
    df = spark.createDataFrame([(r,) for r in rows], "c string").select(
        "c",
        clean.strip_tags(F.col("c")).alias("tags"),
        clean.strip_brackets(F.col("c")).alias("brackets"),
        clean.keep_chars(F.col("c")).alias("kept"),
    )
    for r in df.collect():
        assert r["tags"] == re.sub(r"<[^>\n]*>", "", r["c"])
        plain = re.sub(r"\[[^\]\n]*\]", "", r["c"])
        assert r["brackets"] == re.sub(r"\{[^}\n]*\}", "", plain)
        assert r["kept"] == re.sub("[^a-z0-9#+-]", " ", r["c"])
    rows = ["".join(rng.choices("012a    ", k=rng.randint(0, 20))) for _ in range(4000)]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    for c, got in df.select("c", clean.spell_numbers(F.col("c"))).collect():
        assert got == spelled(c)


def test_blocks_equal_their_plain_form(spark):
    rng = random.Random(6)
    pieces = ["<p>", "</p>", "<p a>", "<li>", "</li>", "<code>", "</code>", "<pre x>", "</pre>", "t", "\n"]
    rows = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)]
    df = clean.extract_blocks(spark.createDataFrame([(r,) for r in rows], "body string"))
    for r in df.collect():
        rest = r["body"]
        for name, pattern in clean.BLOCK_PATTERNS.items():
            assert r[name] == re.findall(pattern, rest), r
            rest = re.sub(pattern, "", rest)


def test_filter_on_the_text_stays_compilable(spark):
    df = spark.createDataFrame(
        [(1, "T", "<p>k 1 2 x</p>")], "idx long, title string, body string"
    )
    assert clean.clean_questions(df).filter(F.length("text") > 1).count() == 1
