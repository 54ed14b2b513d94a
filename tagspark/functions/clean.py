"""Question cleaning as column expressions (no Python runs per row).

Every function takes and returns a Column and stays inside generated code.
The regular expressions are all linear in the length of the text: a post is
processed whole, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values the results depend on.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLOCK_PATTERNS = {
    "p": r"(?s)<p(?:\s[^>]*)?>(.*?)</p>",
    "li": r"(?s)<li(?:\s[^>]*)?>(.*?)</li>",
    "code": r"(?s)<code>(.*?)</code>",
    "pre": r"(?s)<pre(?:\s[^>]*)?>(.*?)</pre>",
}
ASSEMBLY_ORDER = ("p", "code", "li", "pre")
STRIPPED = " \t\n\r"
# All but `a-z 0-9 # + -` and the blank. As ranges: a negated class of this many
# parts runs ten times slower in Java.
DROPPED_CHARACTERS = r'[\x00-\x1f!"$-*,./:-`{-\x{10FFFF}]'
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
CODE_WORDS = 20
# End of fixed values.


def only_where(c: Column, part: str, change: Callable[[Column], Column]) -> Column:
    """`change` the texts that contain `part`; it must leave the others as they are.

    A search costs a fraction of a pattern. `c` is evaluated once, as the element of an array.
    """
    found = F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit(part)), change(x)).otherwise(x))
    return F.get(found, F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; letters outside ASCII stay as they are."""
    return F.translate(c, UPPER, LOWER)


def fold_case(c: Column) -> Column:
    """Lower case for text whose non-ASCII characters will be blanked out.

    The built-in `lower` is several times faster than a translation. Two
    characters outside ASCII have ASCII letters in their lower-case form; they
    are blanked first.
    """
    for character in ("\u212a", "\u0130"):
        c = only_where(c, character, lambda x: F.replace(x, F.lit(character), F.lit(" ")))
    return F.lower(c)


def take_block(c: Column, name: str) -> tuple[Column, Column]:
    """Contents of the `name` blocks, and the text with these blocks deleted.

    A start tag without an end tag, or without its own `>`, has no block after
    it either: the next `>`, and the next end tag after that, would serve both.
    From there on the text is passed over once, so that a page with many
    unclosed tags is not scanned once per tag. Each expression uses `c` once:
    should the optimizer inline the steps, for a filter on the result say, the
    expression stays small.
    """
    attributes = BLOCK_PATTERNS[name].removeprefix(f"(?s)<{name}").partition(">(.*?)")[0]
    end = f"</{name}>"
    # Up to the end tag without a step back: several times faster than a reluctant `.*?`.
    inner = rf"[^<]*+(?:<(?!/{name}>)[^<]*+)*+"
    block = f"{attributes}>{inner}{end}"
    without_end = rf"{attributes}>(?s:.*+)|\s[^>]*+\z"
    # All patterns begin with the same characters, which are searched for. Of a block without an
    # end only these are left.
    closed = F.regexp_replace(c, rf"<{name}(?:({block})|(?:{without_end}))", f"<{name}$1")
    found = F.regexp_extract_all(closed, F.lit(f"<{name}{attributes}>({inner}){end}"), F.lit(1))
    # A group keeps what it held when the rest fails, so the rest is tried before.
    rest = F.regexp_replace(c, rf"<{name}(?:{block}|(?={without_end})(?<=(<{name}))({without_end}))", "$1$2")
    return found, rest


def extract_blocks(df: DataFrame, body: str = "body") -> DataFrame:
    """Add array columns `p`, `li`, `code`, `pre` of block contents of `body`.

    Each kind is deleted before the next is looked for, so a `code` inside a
    paragraph stays paragraph text. Text outside the blocks is dropped. The
    steps are separate projections: each one's input is used more than once,
    and this way it is evaluated once.
    """
    keep = df.columns
    rest = F.col(body)
    done: list[str] = []
    for name in BLOCK_PATTERNS:
        found, left_over = take_block(rest, name)
        df = df.select(*keep, *done, found.alias(name), left_over.alias("_rest"))
        done.append(name)
        rest = F.col("_rest")
    return df.drop("_rest")


def join_fragments(fragments: Column) -> Column:
    """Join with blanks what is not `''` or `' '`, then strip the ends."""
    kept = F.array_remove(F.array_remove(fragments, ""), " ")
    return F.btrim(F.array_join(kept, " "), F.lit(STRIPPED))


def unescape_angle(c: Column) -> Column:
    """Decode `&lt;` and `&gt;`; no other entity is known."""
    for entity, character in (("&lt;", "<"), ("&gt;", ">")):
        c = only_where(c, entity, lambda x: F.replace(x, F.lit(entity), F.lit(character)))
    return c


def _strip_spans(c: Column, start: str, end: str) -> Column:
    # A span that closes on its line is deleted. An opening without an end is
    # put back from the groups, and passed over whole so that it is read once.
    inner = rf"[^{end}\n]*+"
    spans = rf"{start}(?:{inner}{end}|(?<=({start}))({inner}))"
    return only_where(c, start[-1], lambda x: F.regexp_replace(x, spans, "$1$2"))


def strip_tags(c: Column) -> Column:
    """Delete `<...>` within a line."""
    return _strip_spans(c, "<", ">")


def strip_brackets(c: Column) -> Column:
    """Delete `[...]`, then `{...}`, within a line. Round brackets stay."""
    return _strip_spans(_strip_spans(c, r"\[", r"\]"), r"\{", r"\}")


def keep_chars(c: Column) -> Column:
    """Blank out all but `a-z 0-9 # + -`."""
    return F.regexp_replace(c, DROPPED_CHARACTERS, " ")


def spell_numbers(c: Column) -> Column:
    """Spell the digits of numbers that stand between two blanks.

    Expects text after `keep_chars`, in which the marker letter cannot occur.
    """
    # A number's first digit is taken if a blank precedes it and only digits
    # follow up to a blank, its other digits because they continue the match before.
    c = F.regexp_replace(c, r"[0-9](?:(?<= .)(?=[0-9]*+ )|(?<=\G.)(?<!^.))", "D$0")

    def spelled(marked: Column) -> Column:
        for digit, word in enumerate(DIGIT_WORDS):
            marked = F.replace(marked, F.lit(f"D{digit}"), F.lit(f"{word} "))
        return marked

    return only_where(c, "D", spelled)


def trim_words(c: Column, n: int = CODE_WORDS) -> Column:
    """First `n` and last `n` words when there are more than `2n`."""
    words = F.split(F.btrim(c), " +")
    tail_start = F.greatest(F.lit(n), F.size(words) - n) + 1
    return F.array_join(F.concat(F.slice(words, 1, n), F.slice(words, tail_start, F.lit(n))), " ")


def _one_blank_per_byte(c: Column) -> Column:
    """Blank out non-ASCII characters by as many blanks as they have bytes."""
    for low, high, width in (("0080", "07FF", 2), ("0800", "FFFF", 3), ("10000", "10FFFF", 4)):
        c = F.regexp_replace(c, rf"[\x{{{low}}}-\x{{{high}}}]", " " * width)
    return c


def normalize(c: Column, trim: int | None = None, byte_blanks: bool = False) -> Column:
    """Plain text of a lower-case string: markup out, characters limited, numbers spelled.

    With `byte_blanks` the length of the result counts bytes of the input, as
    the coverage report needs; the words are the same.
    """
    c = F.btrim(c, F.lit(STRIPPED))
    c = strip_brackets(strip_tags(unescape_angle(c)))
    if byte_blanks:
        c = _one_blank_per_byte(c)
    c = spell_numbers(keep_chars(c))
    return c if trim is None else trim_words(c, trim)


def clean_title(title: Column) -> Column:
    return normalize(fold_case(title))


def collapse(c: Column) -> Column:
    """Single blanks between words, none at the ends."""
    return F.btrim(F.regexp_replace(c, "  +", " "))


def process_body(df: DataFrame, body: str = "body", byte_blanks: bool = False) -> DataFrame:
    """Add `processed`: the plain text of the blocks of a lower-case body."""
    keep = df.columns
    parts = [
        normalize(
            join_fragments(F.col(name)),
            trim=CODE_WORDS if name == "code" else None,
            byte_blanks=byte_blanks,
        )
        for name in ASSEMBLY_ORDER
    ]
    return extract_blocks(df, body).select(*keep, F.concat_ws(" ", *parts).alias("processed"))


def clean_questions(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Replace title and body by `text`, the clean document. Works on streams too."""
    keep = [c for c in df.columns if c not in (title, body)]
    lowered = df.select(
        *keep, clean_title(F.col(title)).alias("_title"), fold_case(F.col(body)).alias("_body")
    )
    return process_body(lowered, "_body").select(
        *keep, collapse(F.concat_ws(" ", "_title", "processed")).alias("text")
    )


def tag_detected(tag: Column, text: Column) -> Column:
    """The tag occurs in the text, or it is hyphenated and all its parts do."""
    parts = F.forall(F.split(tag, "-", -1), lambda part: F.contains(text, part))
    return F.contains(text, tag) | (F.contains(tag, F.lit("-")) & parts)


def words(c: Column) -> Column:
    """Whitespace-separated words; none for a blank string."""
    return F.array_remove(F.split(c, r"\s+"), "")
