"""Line dedup by a log-template tree.

Lines are parsed to a fixed depth: by their number of tokens, then by their leading tokens,
where a token with a digit counts as a variable field `<*>`. Within a leaf of that tree a token
is constant at its position if lines of several documents have it there, else it is a variable
field too. A line whose constants make up enough of it stands for the template of those
constants; any other line is a template of its own. A template that recurs in several documents
is dropped everywhere but at its first line, so nothing is lost that is said only once.

The order in which lines come does not matter, unlike in a parser that grows its tree line by
line, so every step is a grouping. Exact repeats are made one before leaves are looked at, and
only leaves with different lines of different documents are looked into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tagspark.llm.common import BETWEEN_WORDS, document_key
from tagspark.operators.joins import split_lookup
from tagspark.sources.staging import discard, stage

VARIABLE = "<*>"
WITH_DIGIT = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Tree:
    # Leading tokens of the tree.
    depth: int = 3
    # Shorter lines are not parsed and always stay.
    min_tokens: int = 3
    # A template recurs from this many documents on; so does a token at its position.
    min_documents: int = 2
    # Least share of constant tokens in a line that is generalised.
    constant_share: float = 0.7


def masked(line: Column) -> Column:
    """The line with single spaces, and with variable fields for tokens with digits."""
    spaced = F.trim(F.regexp_replace(line, BETWEEN_WORDS, " "))
    return F.regexp_replace(spaced, WITH_DIGIT, VARIABLE)


def parsed_lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """`(doc, pos, h, leaf)` of every line of `docs (doc, text)`; `h` and `leaf` are null for lines
    that are not parsed. They are left out only when the lines are read: a filter here would be
    moved below the patterns and take them once more."""
    lines = docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, tree.depth))
    is_parsed = (F.size("tokens") >= tree.min_tokens) & (F.col("masked") != "")
    return (
        lines.select("doc", "pos", masked(F.col("line")).alias("masked"))
        .withColumn("tokens", F.split(F.col("masked"), " "))
        .select(
            "doc", "pos", F.when(is_parsed, F.xxhash64("masked")).alias("h"), F.when(is_parsed, leaf).alias("leaf")
        )
    )


def marks_at(positions: str, mark: str) -> Column:
    """An array with `mark` (SQL of a string, of the number `i`) at the ascending `positions` and
    empty strings before and between them: `,,0,,,1` taken apart."""
    gap = f"repeat(',', x - coalesce(get({positions}, i - 1), 0))"
    return F.expr(f"split(array_join(transform({positions}, (x, i) -> concat({gap}, {mark})), ''), ',')")


def generalised(docs: DataFrame, kinds: DataFrame, tree: Tree) -> DataFrame:
    """`(h, template)` of the lines that stand for a template of constants, stored.

    `kinds (h, leaf, n_docs, first_doc, first_pos, last_doc)` are the distinct lines.
    """
    leaves = (
        kinds.groupBy(F.col("leaf").alias("shared"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("first_doc").alias("a"), F.max("last_doc").alias("b"))
        .filter("n > 1 and a != b")
        .select("shared")
    )
    wanted = kinds.join(leaves, F.col("leaf") == F.col("shared"), "left_semi")
    per_doc = (
        wanted.groupBy(F.col("first_doc").alias("doc"))
        .agg(F.array_sort(F.collect_list(F.struct("first_pos", "h", "leaf", "n_docs"))).alias("wanted"))
        .withColumn("at", F.col("wanted.first_pos"))
        .select("doc", "wanted", marks_at("at", "cast(i as string)").alias("marks"))
    )
    # A text is split once, and its lines are walked together with the marks of the wanted ones.
    lines = (
        docs.join(per_doc, "doc")
        .select("wanted", F.inline(F.arrays_zip(F.split("text", "\n").alias("line"), F.col("marks").alias("mark"))))
        .filter("mark != ''")
        .select(F.get("wanted", F.col("mark").cast("int")).alias("w"), masked(F.col("line")).alias("masked"))
        .select("w.h", "w.leaf", "w.n_docs", F.split("masked", " ").alias("tokens"))
    )
    places = stage(
        lines.select("h", "leaf", "n_docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token"))
        .filter(F.col("i") >= tree.depth)
        .select("h", "leaf", "n_docs", "n", "i", F.xxhash64("leaf", "i", "token").alias("place")),
        "places",
    )
    support = stage(places.groupBy("place").agg(F.sum("n_docs").alias("docs")), "support")
    constants = support.filter(F.col("docs") >= tree.min_documents).select("place")
    counts = (support, "docs")
    found = split_lookup(places, constants.withColumn("constant", F.lit(True)), "place", "h", "left", counts)
    # The constants of a line, whatever their order: their places are hashes already.
    merged = stage(
        found.groupBy("h", "leaf", "n")
        .agg(
            F.sum(F.col("constant").cast("int")).alias("known"),
            F.bit_xor(F.when(F.col("constant"), F.col("place"))).alias("constants"),
        )
        .filter(F.coalesce("known", F.lit(0)) + tree.depth >= tree.constant_share * F.col("n"))
        .select("h", F.xxhash64("leaf", "n", "constants").alias("template")),
        "templates",
    )
    discard(places)
    discard(support)
    return merged


def repeated_lines(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """`(doc, n_dropped, marks)` of the documents with lines that go, stored.

    `docs (doc, text)` are named by a `doc` of any type that has an order. `marks` has an `x` at
    the places of these lines.
    """
    stored = stage(parsed_lines(docs, tree), "lines")
    lines = stored.filter("h is not null")
    per_doc = lines.groupBy("h", "leaf", "doc").agg(F.min("pos").alias("pos"))
    kinds = stage(
        per_doc.groupBy("h", "leaf").agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.min(F.struct("doc", "pos")).alias("first"),
            F.max("doc").alias("last_doc"),
        ).select("h", "leaf", "n_docs", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"), "last_doc"),
        "kinds",
    )
    merged = generalised(docs, kinds, tree)
    named = stage(kinds.join(merged, "h", "left").withColumn("template", F.coalesce("template", "h")), "named")
    # Kinds of one template may share documents; that it has two is seen from its ids.
    totals = stage(
        named.groupBy("template").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("n_docs").alias("n"),
            F.min(F.struct("first_doc", "first_pos")).alias("first"), F.max("last_doc").alias("last_doc"),
        ),
        "totals",
    )
    recurring = (F.col("n") >= tree.min_documents) & (F.col("first.first_doc") != F.col("last_doc"))
    heads = totals.filter(recurring).select("template", "first")
    drops = stage(
        split_lookup(named.select("h", "template", "n_docs"), heads, "template", "h", counts=(totals, "kinds"))
        .select("h", "first", "n_docs"),
        "recurring",
    )
    is_first = (F.col("doc") == F.col("first.first_doc")) & (F.col("pos") == F.col("first.first_pos"))
    gone = split_lookup(lines, drops.select("h", "first"), "h", "doc", counts=(drops, "n_docs")).filter(~is_first)
    flags = stage(
        gone.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        .select("doc", F.size("at").alias("n_dropped"), marks_at("at", "'x'").alias("marks")),
        "flags",
    )
    for table in (stored, kinds, merged, named, totals, drops):
        discard(table)
    return flags


def with_lines_dropped(docs: DataFrame, tree: Tree) -> DataFrame:
    """`(_row, _n_lines, _n_dropped, _text)`, one row per row of `docs`; `_row` is that row.

    Rows travel whole, and once, to meet the lines that go.
    """
    rows = docs.select(document_key(docs).alias("doc"), F.struct(*docs.columns).alias("_row"))
    known = rows.select("doc", F.col("_row.text").alias("text")).filter(F.col("_row.doc_id").isNotNull())
    flags = repeated_lines(known, tree)
    lines = F.split("_row.text", "\n")
    kept = F.expr(
        "array_join(filter(split(_row.text, '\n'), (line, i) -> not coalesce(get(marks, i), '') = 'x'), '\n')"
    )
    # Texts are shuffled once at any size: a broadcast of small flags would hide what that costs.
    return rows.join(flags.hint("merge"), "doc", "left").select(
        "_row",
        F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(lines)).alias("_n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("_n_dropped"),
        F.when(F.col("n_dropped") > 0, kept).otherwise(F.col("_row.text")).alias("_text"),
    )


def dedup_lines(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """`(doc_id, n_lines, n_dropped, text)`, one row per row of `docs (doc_id, text, ...)`.

    `text` has the lines that stay, in their order. Of the lines of a template the one of the
    smallest id, and there the first one, stays. A null text stays null, an empty one empty. Rows
    that share an id are documents of their own, the smaller by a hash of their texts coming
    first; rows alike in id and text are one document, and each is returned. Rows without an id
    are left as they are. An empty table gives an empty one.
    """
    return with_lines_dropped(docs, tree).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"), F.col("_text").alias("text"),
    )


def drop_repeated_lines(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """`docs` without repeated lines, with all columns; a row that has no text left goes.

    `n_chars`, if there, is brought up to date where lines went.
    """
    changed = F.col("_n_dropped") > 0
    left = with_lines_dropped(docs, tree).filter(~changed | F.col("_text").rlike(r"\S"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))
    return left.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
