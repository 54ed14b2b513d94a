"""Fingerprints of documents as Merkle trees over sections, paragraphs and phrases.

A paragraph is a line. It is cut into phrases after words chosen by their own hash, so an
insertion moves no cut but those beside it; paragraphs are gathered into sections in the same
way. A phrase is named by its SHA-256, and every node above by the SHA-256 of the whole names
below it. So equal roots mean equal texts; unequal ones are compared branch by branch, and the
phrases below the differing branches locate the edit.

A fingerprint is the written tree: `root:section(paragraph[phrase,phrase]paragraph[..])..`. The
root is written whole, the names below it with their first 16 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagspark.llm.common import document_key
from tagspark.operators.ordering import with_row_index
from tagspark.sources.staging import stage

# Written between phrases while a paragraph is cut. A text's own ESCAPE is written twice as long
# before, so that none of its characters is taken for a cut.
ESCAPE, ESCAPED, CUT = "\x01", "\x01\x02", "\x01\x03"


@dataclass(frozen=True)
class Shape:
    # Words per phrase and paragraphs per section, on average.
    phrase_words: int = 4
    section_paragraphs: int = 8


def tree(df: DataFrame, text: str, name: str, shape: Shape = Shape()) -> DataFrame:
    """Add `<name>` (the written tree) and `<name>_leaves` (hashes of its phrases, as a set).

    A null text counts as empty. Each step is a column that is used more than once, so that it
    is computed once a row.
    """
    escaped = f"replace(coalesce({text}, ''), '{ESCAPE}', '{ESCAPED}')"
    cut = (
        f"transform(split({escaped}, '\\n'), p -> split(array_join(transform(split(p, ' '),"
        f" w -> if(xxhash64(w) % {shape.phrase_words} = 0, concat(w, '{CUT}'), w)), ' '), '{CUT}'))"
    )
    hashed = df.withColumn("_leaves", F.expr(f"transform({cut}, p -> transform(p, phrase -> sha2(phrase, 256)))"))
    written = "concat(left(h, 16), '[', array_join(transform(p, leaf -> left(leaf, 16)), ','), ']')"
    hashed = (
        hashed.withColumn(f"{name}_leaves", F.expr("array_distinct(transform(flatten(_leaves), x -> xxhash64(x)))"))
        .withColumn("_names", F.expr("transform(_leaves, p -> sha2(array_join(p, ','), 256))"))
        .withColumn("_paragraphs", F.expr(f"zip_with(_names, _leaves, (h, p) -> {written})"))
        .withColumn(
            "_ends",
            F.expr(
                "filter(sequence(0, size(_names) - 1), i -> i = size(_names) - 1"
                f" or xxhash64(get(_names, i)) % {shape.section_paragraphs} = 0)"
            ),
        )
        .drop("_leaves")
    )

    def in_section(array: str, by: str) -> str:
        start = "coalesce(get(_ends, j - 1) + 1, 0)"
        return f"array_join(slice({array}, {start} + 1, e + 1 - {start}), '{by}')"

    hashed = hashed.withColumn(
        "_sections", F.expr(f"transform(_ends, (e, j) -> sha2({in_section('_names', ',')}, 256))")
    ).withColumn("_inside", F.expr(f"transform(_ends, (e, j) -> {in_section('_paragraphs', '')})"))
    root = F.sha2(
        F.concat(
            F.octet_length(F.coalesce(text, F.lit(""))).cast("string"), F.lit(":"), F.array_join("_sections", ",")
        ),
        256,
    )
    body = F.array_join(
        F.zip_with("_sections", "_inside", lambda h, inside: F.concat(F.left(h, F.lit(16)), F.lit("("), inside, F.lit(")"))), ""
    )
    return hashed.withColumn(name, F.concat(root, F.lit(":"), body)).drop(
        "_names", "_paragraphs", "_ends", "_sections", "_inside"
    )


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else the share of phrases that two trees have in common (Dice)."""
    leaves_a, leaves_b = f"{a}_leaves", f"{b}_leaves"
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    common = 2.0 * F.size(F.array_intersect(leaves_a, leaves_b))
    share = F.try_divide(common, F.size(leaves_a) + F.size(leaves_b))
    # Different roots are never wholly alike, even if one text repeats phrases of the other.
    return F.when(same, 1.0).otherwise(F.least(share, F.lit(1.0 - 1e-9)))


def branches(fingerprint: str, level: str) -> Column:
    """Hashes of a level ('root', 'section', 'paragraph' or 'phrase') of a written tree."""
    pattern = {
        "root": "^([0-9a-f]{64}):", "section": r"([0-9a-f]{16})\(",
        "paragraph": r"([0-9a-f]{16})\[", "phrase": r"([0-9a-f]{16})(?=[,\]])",
    }[level]
    return F.regexp_extract_all(F.col(fingerprint), F.lit(pattern), F.lit(1))


def differing(a: str, b: str, level: str) -> Column:
    """Positions in tree `a`, from 0, of the branches of a level that tree `b` does not have."""
    mine, other = branches(a, level), branches(b, level)
    marked = F.transform(mine, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.transform(F.filter(marked, lambda x: ~F.array_contains(other, x["h"])), lambda x: x["i"])


def next_documents(docs: DataFrame, doc_id: Column) -> DataFrame:
    """`(doc, n_chars, next_doc)` of `docs (doc, text)`, in descending order of `doc_id`; after the
    last comes the first.

    A null id is the last of the order. Only ids and lengths move.
    """
    lengths = docs.select(
        "doc", F.coalesce(doc_id, F.lit(-(2**63))).alias("_order"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
    ).distinct()
    placed = with_row_index(stage(lengths, "lengths"), F.col("_order").desc(), "doc", name="_place")
    placed = stage(placed, "places")
    n = placed.count()
    after = placed.select(F.col("doc").alias("next_doc"), F.pmod(F.col("_place") - 1, F.lit(max(n, 1))).alias("_place"))
    return placed.join(after, "_place").select("doc", "n_chars", "next_doc")


def merkle_fingerprints(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Trees of every document and of its edited text, and how alike they are.

    `(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`,
    one row per row of `docs (doc_id, text, ...)`. The edited text has its last third replaced by
    the beginning of the next document, in descending order of ids. Null texts count as empty.
    Rows that share an id are documents of their own, ordered by a hash of their texts; rows alike
    in id and text are one document in the order, and each is returned. Rows without an id come
    last. An empty table gives an empty one.

    Each document sends its beginning and its set of phrases to the document before it; whole
    texts move once.
    """
    # A key that is never null, so that it can be joined on.
    key = F.struct(document_key(docs).alias("key"))
    # The id is read from the key: one shuffle of keys and texts then serves both uses of them.
    whole = docs.select(key.alias("doc"), "text")
    shared_ids = isinstance(whole.schema["doc"].dataType["key"].dataType, T.StructType)
    doc_id = F.col("doc.key.doc_id") if shared_ids else F.col("doc.key")
    order = stage(next_documents(whole, doc_id), "order")
    own = tree(whole.join(order.select("doc", "n_chars"), "doc"), "text", "fingerprint", shape)
    sent = order.select(F.col("doc").alias("to_doc"), F.col("n_chars").alias("to_chars"), F.col("next_doc").alias("doc"))
    # Of rows that are alike one sends.
    beginnings = (
        own.select("doc", "text", "fingerprint", "fingerprint_leaves").dropDuplicates(["doc"])
        if shared_ids
        else own
    )
    beginnings = beginnings.join(sent, "doc").select(
        "to_doc",
        F.expr("left(coalesce(text, ''), cast(to_chars div 3 as int))").alias("beginning"),
        F.substring("fingerprint", 1, 64).alias("next"),
        F.col("fingerprint_leaves").alias("next_leaves"),
    )
    edited_text = F.expr(
        "concat(left(coalesce(text, ''), cast(n_chars - n_chars div 3 as int)), beginning)"
    )
    met = own.join(beginnings, F.col("doc") == F.col("to_doc")).withColumn("edited", edited_text)
    edited = tree(met, "edited", "edited_fingerprint", shape)
    return edited.select(
        doc_id.alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next").alias("near_next"),
    )
