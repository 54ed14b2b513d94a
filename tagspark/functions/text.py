"""Tokens and word n-grams of clean text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: a token is a run of two or more word characters.
TOKEN_PATTERN = "[a-z0-9_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def grams(tok: Column) -> Column:
    """The tokens followed by the pairs of neighbouring tokens."""
    # The pairing function sees only its arguments, so that an optimizer that
    # moves this expression never evaluates the tokens once per element.
    pairs = F.zip_with(
        tok, F.slice(tok, F.lit(2), F.size(tok)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(tok, F.array_compact(pairs))


def word_pairs(tok: Column) -> Column:
    """The distinct pairs of neighbouring tokens, joined by a space, which no token has."""
    pairs = F.zip_with(
        tok, F.slice(tok, F.lit(2), F.size(tok)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.array_distinct(F.array_compact(pairs))
