"""Spelling variants by search schemes over bidirectional FM-indexes.

Two words are near if one insertion, deletion or replacement of a code point turns one into the
other. Wherever that error lies, one half of the shorter word is unharmed: it is matched exactly,
and the search goes on across the other half, allowing one error. A word is indexed under the
halves that shorter or equally long words may ask for, so words meet in shards by their halves,
and every shard holds one bidirectional FM-index over its delimited words. Halves that very many
words share are dealt over several shards, and those who ask for them ask in each.

The error is looked for from the shorter word, so the other word has a code point more, or
another one; each pair is then told to both.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagspark.operators.joins import HOT_SHARE, hot_keys
from tagspark.sources.staging import stage

# Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)
# End of fixed values.

# Distinct words that a task counts before it passes them on, and bytes looked at in one go.
COUNTED_AT_ONCE = 300_000
BYTES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Spelling:
    min_letters: int = 7
    min_count: int = 2
    # One in so many runs of a document loses a letter; 0 for none.
    damaged: int = 31
    # A form occurs at least so many times as often.
    ratio: int = 10
    # Words of a shard, about.
    shard_words: int = 20_000


def count_words(docs: DataFrame, settings: Spelling = Spelling()) -> DataFrame:
    """`(word, n)` of the words that are long and frequent enough, stored.

    A run whose crc32 with its document's id (null: nothing) says so loses a letter first.
    """
    least = settings.min_letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            out = pa.RecordBatch.from_arrays(
                [words, pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                # Every letter is one byte in Latin-1; what is not in it is no letter.
                raw = (text.as_py() or "").encode("latin-1", "replace").translate(LETTERS)
                head = zlib.crc32(f"{doc_id.as_py()}:".encode() if doc_id.is_valid else b":")
                at = 0
                while at < len(raw):
                    end = raw.find(b" ", at + BYTES_AT_ONCE)
                    end = len(raw) if end < 0 else end
                    for word, n in Counter(raw[at:end].split()).items():
                        if len(word) < least:
                            continue
                        if settings.damaged:
                            utf8 = word if word.isascii() else word.decode("latin-1").encode()
                            h = zlib.crc32(utf8, head)
                            if h % settings.damaged == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < least:
                                    continue
                        counts[word] = counts.get(word, 0) + n
                    at = end
                    if len(counts) > COUNTED_AT_ONCE:
                        yield flush()
        if counts:
            yield flush()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    counted = parts.groupBy("word").agg(F.sum("n").alias("n"))
    return stage(counted.filter(F.col("n") >= settings.min_count), "words")


# The index.


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Sorted suffixes of a text that ends with its only 0, by doubling prefixes."""
    n = len(text)
    bits = max(1, int(symbols - 1).bit_length())
    length = 62 // bits
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(length, np.int64)])
    for j in range(length):
        key = (key << bits) | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        if length < n:
            after[:-length] = rank[length:] + 1
        key = rank * (n + 1) + after
        length *= 2


class OneWay:
    """Suffix ranks of a text read in one direction, with the words' places."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text, symbols)
        before = text[order - 1]
        n = len(text)
        # One column more, of zeros, for symbols that the text does not have.
        self.occ = np.zeros((n + 1, symbols + 1), np.int32)
        self.occ[np.arange(1, n + 1), before] = 1
        np.cumsum(self.occ, axis=0, out=self.occ)
        totals = self.occ[-1]
        self.first = (np.cumsum(totals) - totals).astype(np.int64)
        self.order = order
        # The number of the delimiter at a place, counted from the start of the text.
        self.number = np.cumsum(text == DELIMITER) - 1


END, DELIMITER, FIRST_LETTER = 0, 1, 2


@dataclass
class Interval:
    """Intervals of suffix ranks of patterns, in the text and in the reversed text."""

    lo: np.ndarray
    lo_back: np.ndarray
    size: np.ndarray

    def __getitem__(self, rows) -> "Interval":
        return Interval(self.lo[rows], self.lo_back[rows], self.size[rows])

    @staticmethod
    def joined(parts: list["Interval"]) -> "Interval":
        fields = ("lo", "lo_back", "size")
        return Interval(*(np.concatenate([getattr(p, f) for p in parts]) for f in fields))


class FmIndex:
    """A bidirectional FM-index over delimited words; `mirrored` reads everything backwards."""

    def __init__(self, words: list[str]):
        self.letters = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        self.symbols = len(self.letters) + FIRST_LETTER
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.full(int(lengths.sum()) + len(words) + 2, DELIMITER, np.int32)
        text[-1] = END
        places = np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(words) + 1), lengths)
        text[places] = self.coded(words)
        self.n = len(text)
        self.there = OneWay(text, self.symbols)
        self.back = OneWay(np.concatenate([text[-2::-1], text[-1:]]), self.symbols)
        self.n_words = len(words)
        self.backwards = False

    def coded(self, words: list[str]) -> np.ndarray:
        """Symbols of all letters; letters that the index lacks get the symbol after the last."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points if len(self.letters) else at < 0
        return np.where(known, at + FIRST_LETTER, self.symbols).astype(np.int32)

    def mirrored(self) -> "FmIndex":
        other = object.__new__(FmIndex)
        other.__dict__.update(self.__dict__)
        other.there, other.back, other.backwards = self.back, self.there, not self.backwards
        return other

    def everything(self, rows: int) -> Interval:
        zeros = np.zeros(rows, np.int64)
        return Interval(zeros, zeros.copy(), np.full(rows, self.n, np.int64))

    def left(self, at: Interval, symbol: np.ndarray) -> Interval:
        """The intervals of the patterns with a symbol more on the left."""
        low = self.there.occ[at.lo]
        counts = self.there.occ[at.lo + at.size] - low
        rows = np.arange(len(symbol))
        smaller = (np.cumsum(counts, axis=1) - counts)[rows, symbol]
        return Interval(self.there.first[symbol] + low[rows, symbol], at.lo_back + smaller, counts[rows, symbol].astype(np.int64))

    def right(self, at: Interval, symbol: np.ndarray) -> Interval:
        found = self.mirrored().left(Interval(at.lo_back, at.lo, at.size), symbol)
        return Interval(found.lo_back, found.lo, found.size)

    def right_letters(self, at: Interval) -> tuple[np.ndarray, np.ndarray, Interval]:
        """All letters that may follow on the right: `(row, letter, interval)`."""
        low = self.back.occ[at.lo_back]
        counts = self.back.occ[at.lo_back + at.size] - low
        smaller = np.cumsum(counts, axis=1) - counts
        row, letter = np.nonzero(counts[:, FIRST_LETTER : self.symbols])
        letter = letter + FIRST_LETTER
        return row, letter, Interval(
            at.lo[row] + smaller[row, letter], self.back.first[letter] + low[row, letter],
            counts[row, letter].astype(np.int64),
        )

    def word_at(self, at: Interval) -> np.ndarray:
        """The number of the word that follows the delimiter at which each pattern starts."""
        number = self.there.number[self.there.order[at.lo]]
        return self.n_words - 1 - number if self.backwards else number


def near_words(index: FmIndex, words: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """`(row, word number)` of all indexed words that start with the first `half` symbols of a
    row of `words` and go on with one symbol more, or another one, than the row.

    `words` are symbols, one row per word of the same length.
    """
    n, length = words.shape
    rows = np.arange(n)
    at = index.everything(n)
    for j in [*range(half - 1, -1, -1), None]:
        symbol = np.full(len(rows), DELIMITER) if j is None else words[rows, j]
        at = index.left(at, symbol)
        alive = at.size > 0
        rows, at = rows[alive], at[alive]
    # States without and with the error.
    clean, clean_at = rows, at
    wrong, wrong_at = rows[:0], at[:0]
    for j in range(half, length + 1):
        row, letter, found = index.right_letters(clean_at)
        row = clean[row]
        due = words[row, j] if j < length else np.full(len(row), DELIMITER)
        same = letter == due
        # A letter before the one that is due.
        wrong, wrong_at = np.concatenate([wrong, row[~same]]), Interval.joined([wrong_at, found[~same]])
        if j == length:
            break
        wrong_at = index.right(wrong_at, words[wrong, j])
        alive = wrong_at.size > 0
        # A letter instead of the one that is due.
        wrong = np.concatenate([wrong[alive], row[~same]])
        wrong_at = Interval.joined([wrong_at[alive], found[~same]])
        clean, clean_at = row[same], found[same]
    ended = index.right(wrong_at, np.full(len(wrong), DELIMITER))
    alive = ended.size > 0
    return wrong[alive], index.word_at(ended[alive])


# Shards.


def halves(word: str, length: str) -> str:
    """SQL of the halves of words that a word of `length` has, with their ends of the word."""
    return (
        f"struct('first' as kind, left({word}, {length} div 2) as half),"
        f" struct('last' as kind, right({word}, {length} - {length} div 2) as half)"
    )


def near_pairs(words: DataFrame, settings: Spelling) -> DataFrame:
    """`(word, near, n_near)`: pairs of near words, both ways; a pair may come several times."""
    sized = words.select("word", "n", F.length("word").alias("l"))
    key = F.xxhash64("h.kind", "h.half")
    # Words ask by their own halves; they are found by those of their length or one less.
    asking = sized.select("word", "n", F.expr(f"explode(array({halves('word', 'l')})) as h"))
    asking = asking.select("word", "n", "h.kind", key.alias("key"))
    indexed = sized.select(
        "word", "n", F.expr(f"explode(array_distinct(array({halves('word', 'l')}, {halves('word', '(l - 1)')}))) as h")
    ).select("word", "n", F.lit("").alias("kind"), key.alias("key"))
    counts = stage(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "halves")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, round(total / settings.shard_words))
    # A half that fills a shard on its own is dealt over several.
    share = max(min(1.0, settings.shard_words / max(total, 1)), HOT_SHARE)
    hot = F.broadcast(stage(hot_keys(counts, "key", "n", share), "hot-halves"))

    def dealt(rows: DataFrame, split: Column) -> DataFrame:
        splits = F.coalesce("_splits", F.lit(1))
        met = rows.withColumn("_h", F.xxhash64("key")).join(hot, "_h", "left").withColumn("_splits", splits)
        shard = F.pmod(F.xxhash64("key", "split"), F.lit(shards)).cast("int").alias("shard")
        return met.select("key", "kind", "word", "n", split.alias("split")).select(shard, "kind", "word", "n")

    feed = dealt(indexed, F.pmod(F.xxhash64("word"), F.col("_splits")).cast("int")).unionByName(
        dealt(asking, F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)))
    )
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    feed = feed.repartition(tasks, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names, index, sizes = None, {}, None, None
        for batch in batches:
            starts = batch.column("shard").to_numpy()
            kinds = batch.column("kind").to_pylist()
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            changes = [k for k in range(len(words)) if k == 0 or starts[k] != starts[k - 1] or kinds[k] != kinds[k - 1]]
            for a, b in zip(changes, [*changes[1:], len(words)]):
                if starts[a] != shard:
                    shard, names, index = starts[a], {}, None
                if kinds[a] == "":
                    names.update(zip(words[a:b], counts[a:b]))
                    continue
                if not names:
                    continue
                if index is None:
                    index, found, sizes = FmIndex(list(names)), list(names), np.array(list(names.values()), np.int64)
                yield from answers(index, found, sizes, words[a:b], counts[a:b], kinds[a] == "last")

    return feed.mapInArrow(run, "word string, near string, n_near long")


def answers(
    index: FmIndex, names: list[str], sizes: np.ndarray, words: list[str], counts: list[int], from_end: bool
) -> Iterator[pa.RecordBatch]:
    """Pairs of the asking words and what they find, each told to both."""
    index = index.mirrored() if from_end else index
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        asked = index.coded([words[k] for k in places]).reshape(len(places), length)
        half = length // 2
        if from_end:
            asked, half = asked[:, ::-1], length - half
        row, number = near_words(index, asked, half)
        if not len(row):
            continue
        mine, theirs = [words[places[k]] for k in row], [names[k] for k in number]
        own = np.array(counts, np.int64)[places[row]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(mine + theirs), pa.array(theirs + mine), pa.array(np.concatenate([sizes[number], own]))],
            names=["word", "near", "n_near"],
        )


def roots(forms: DataFrame) -> DataFrame:
    """`(word, root)` of the words that have a form: where following the forms ends.

    Every round goes twice as far as the one before.
    """
    at = stage(forms.toDF("word", "root"), "roots")
    while True:
        further = at.toDF("root", "_next")
        at = stage(
            at.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        if at.filter("_moved").first() is None:
            return at.select("word", "root")
        at = at.select("word", "root")


def group_spellings(words: DataFrame, settings: Spelling = Spelling()) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)`, one row per row of stored `words (word, n)`.

    `words` are distinct and at least two code points long. `n_near` is the number of words that
    one insertion, deletion or replacement makes; the `form` is the one of them that occurs most,
    ties by code points, if it occurs `ratio` times as often as the word, else null; `root` is
    where forms of forms end, the word itself if it has none. An empty table gives an empty one.
    """
    near = (
        near_pairs(words, settings)
        .groupBy("word")
        .agg(F.collect_set(F.struct((-F.col("n_near")).alias("less"), "near")).alias("found"))
        .select(
            F.col("word").alias("_word"), F.size("found").cast("long").alias("n_near"), F.array_min("found").alias("best")
        )
    )
    often = -F.col("best.less") >= settings.ratio * F.col("n")
    formed = stage(
        words.join(near, F.col("word") == F.col("_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(formed.filter("form is not null").select("word", "form"))
    ends = ends.select(F.col("word").alias("_word"), "root")
    return formed.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, settings: Spelling = Spelling()) -> DataFrame:
    """`group_spellings` of the words of `docs (doc_id, text, ...)`.

    Null and empty texts have no words; rows without an id count with an empty one; repeated rows
    count again; other columns are not looked at.
    """
    return group_spellings(count_words(docs, settings), settings)
