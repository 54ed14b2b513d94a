"""Token ids of whole texts, and directly addressable files of them.

Ids come from a public tokenizer. A text is cut before the single spaces between words, where
neither kind of tokenizer used here ever joins tokens, and every distinct piece is encoded once
per Python worker and looked up once per few megabytes of texts; the ids of the pieces follow
each other.

A file of ids splits every id into 8-bit chunks. Level 0 holds the low chunk of every id, level
1 the next chunk of those ids that have one, and so on. A bitmap per level marks the ids that
continue; a rank directory over each bitmap tells where they continue. Token `i` is read with
one chunk per level, wherever it is, and nothing before it is decoded.
"""

from __future__ import annotations

import gc
import os
import re
import string
import struct
import sys
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tagspark.llm.common import worker_memo
from tagspark.operators.ordering import with_row_index
from tagspark.sources.staging import new_path, stage

# Pieces that a worker remembers, twice: those seen since the last turnover, and those before.
REMEMBERED = 400_000
# Bytes of texts that are encoded at a time, up to the end of a text.
TEXT_AT_ONCE = 4 << 20
# Tokens that are read back at a time, or one longer document.
TOKENS_AT_ONCE = 1 << 18
# Stands for a line end that starts a piece.
LINE = "\x00"
# Marks that are one piece where they follow letters. An apostrophe may join with letters.
MARKS = string.punctuation.replace("'", "")


def byte_letters() -> str:
    """The printable letters that byte-level vocabularies write for the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return "".join([letters[b] for b in range(256)])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_file: str):
        # A task has one core, so the library's own threads would only wait for it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        # Ids of " " + word (of a line end and the word after LINE); None marks what has to be
        # seen with its neighbours.
        self.words: dict[str, bytes | None] = {"": None, LINE: None}
        self.before: dict[str, bytes | None] = {}
        # Ids of a line end, and of runs of marks after a word.
        self.line = self.ids(["\n"])[0]
        self.marks: dict[str, bytes] = {}
        self.spell = self.find_spelling()

    def find_spelling(self) -> tuple[str, bool] | None:
        """How the tokenizer's model sees a word of letters, if it is one of two known ways: what
        stands for a space before it, and whether it is in lower case."""
        probes = ["the", "Éta", "größe", "Streing", "ñaRÇ", "a"]
        wanted = self.ids([" " + w for w in probes]), self.ids(["\n" + w for w in probes])
        for space, lower in ((self.letters[32], False), ("", True)):
            bare = [self.spelled(w.lower() if lower else w) for w in probes]
            after_line = [self.line + ids for ids in self.model_ids(bare)]
            if (self.model_ids([space + w for w in bare]), after_line) == wanted:
                return space, lower
        return None

    def spelled(self, word: str) -> str:
        # ASCII letters are their own letters.
        return word if word.isascii() else charmap_decode(word.encode(), "strict", self.letters)[0]

    def model_ids(self, spelled: Iterable[str]) -> list[bytes]:
        ids, ends, tokenize = array("I"), [0], self.model.tokenize
        for word in spelled:
            ids.extend([t.id for t in tokenize(word)])
            ends.append(4 * len(ids))
        if sys.byteorder != "little":
            ids.byteswap()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def ids(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def learn(self, new: list[str]) -> list[bytes | None]:
        """Ids of new words, which are remembered. Latin letters, and a run of marks after them,
        are a piece each to any of these tokenizers, so only the letters are remembered there."""
        words, before, marks, spelled = self.words, self.before, self.marks, self.spelled
        space, lower = self.spell or ("", False)
        keys: list[str] = []
        others: list[str] = []
        # How words of letters are spelled, after a space and after a line end.
        spaced: dict[str, str] = {}
        opening: dict[str, str] = {}
        for word in new:
            key = word if word.isalpha() else word.rstrip(MARKS)
            first = word[0] == LINE
            letters = key[1:] if first else key
            plain = self.spell and letters.isalpha() and (letters.isascii() or max(letters) < "\u0100")
            if not plain:
                key = word
            keys.append(key)
            if key in words:
                continue
            ids = before.get(key)
            if ids is not None:
                words[key] = ids
            elif plain:
                if lower:
                    letters = letters.lower()
                if first:
                    opening[key] = spelled(letters)
                else:
                    spaced[key] = space + spelled(letters)
            elif word[0].isspace() or (first and word[1:2].isspace()):
                words[key] = None
            else:
                others.append(key)
        words.update(zip(spaced, self.model_ids(spaced.values())))
        words.update(zip(opening, [self.line + ids for ids in self.model_ids(opening.values())]))
        pieces = ["\n" + w[1:] if w[0] == LINE else " " + w for w in others]
        words.update(zip(others, self.ids(pieces)))
        found = []
        for word, key in zip(new, keys):
            ids = words[key]
            if len(key) < len(word):
                run = word[len(key) :]
                if run not in marks:
                    marks[run] = self.ids([run])[0]
                ids += marks[run]
            found.append(ids)
        return found

    def known(self, distinct: list[str]) -> list[bytes | None]:
        """Ids of distinct words; the new ones among them are learned in one go."""
        get = self.words.get
        found = [get(word, False) for word in distinct]
        new = [k for k, ids in enumerate(found) if ids is False]
        for k, ids in zip(new, self.learn([distinct[k] for k in new])):
            found[k] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        # Nothing here makes cycles, and the many small lists would set the collector off often.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.encode_new(texts) if texts else []
        finally:
            if collecting:
                gc.enable()

    def encode_new(self, texts: list[str]) -> list[bytes]:
        if len(self.words) + len(self.marks) > REMEMBERED:
            self.words, self.before = {"": None, LINE: None}, self.words
            self.marks.clear()
        # A text with the stand-in itself is encoded as it is.
        whole = [LINE in text for text in texts]
        column = pa.array(["" if w else text for w, text in zip(whole, texts)], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(column, "\n", " " + LINE), " ")
        starts = split.offsets.to_numpy()
        # A word is looked up once, however often the texts have it.
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().copy()
        found = self.known(words)
        opening = [
            text if w else words[k] for w, text, k in zip(whole, texts, at[starts[:-1]].tolist())
        ]
        firsts = self.ids(opening)
        # The first words are not after a space.
        at[starts[:-1]] = len(words)
        rest = pa.array([*found, b""], pa.large_binary()).take(pa.array(at))
        _, offsets, data = rest.buffers()
        places = np.frombuffer(offsets, np.int64, len(rest) + 1)[starts].tolist()
        view = memoryview(data or b"")
        encoded = [first + view[a:b] for first, a, b in zip(firsts, places, places[1:])]
        if rest.null_count:
            # Where something is unknown even now, the white space around it has to be seen.
            unknown = rest.is_null().to_numpy(zero_copy_only=False)
            spaced = np.flatnonzero(np.logical_or.reduceat(unknown, starts[:-1])).tolist()
            parts = []
            for k in spaced:
                after = at[starts[k] + 1 : starts[k + 1]].tolist()
                parts.append(
                    self.around_spaces(opening[k], firsts[k], [words[j] for j in after], [found[j] for j in after])
                )
            pieces = list({part for each in parts for part in each if isinstance(part, str)})
            ids = dict(zip(pieces, self.ids(pieces)))
            for k, each in zip(spaced, parts):
                encoded[k] = b"".join([ids[x] if isinstance(x, str) else x for x in each])
        return encoded

    def around_spaces(
        self, first: str, first_ids: bytes, words: list[str], rest: list[bytes | None]
    ) -> list[str | bytes]:
        """A text with runs of white space, as the ids of the words that stand alone and, whole,
        the pieces with such runs.

        `words` and `rest` are its words after the first, and what is known of them.
        """
        parts: list[str | bytes] = []
        held, alone = [first], first_ids
        for word, ids in zip(words, rest):
            part = "\n" + word[1:] if word[:1] == LINE else " " + word
            if ids is None or held[-1][-1:].isspace():
                held.append(part)
            else:
                parts.append(alone if len(held) == 1 else "".join(held))
                held, alone = [part], ids
        parts.append(alone if len(held) == 1 else "".join(held))
        return parts


def encoded_rows(
    batches: Iterator[pa.RecordBatch], tokenizer_file: str, end_id: int
) -> Iterator[tuple[int | None, bytes]]:
    """`(doc_id, ids with the end id)` of every row; a null text counts as empty."""
    encoder = worker_memo(f"encoder {tokenizer_file}", lambda: Encoder(tokenizer_file))
    end = struct.pack("<I", end_id)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_AT_ONCE)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = batch.slice(at, to - at)
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield from (
                (i, ids + end)
                for i, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts))
            )


# Directly addressable files.

MAGIC = b"DACIDS01"
CHUNK_BITS = 8
RANK_BLOCK = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def chunk_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level its chunks, its continuation bitmap and its rank directory."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        chunks = (rest & (2**CHUNK_BITS - 1)).astype(np.uint8)
        rest = rest >> CHUNK_BITS
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        block = RANK_BLOCK // 8
        padded = np.zeros(-(-max(len(bitmap), 1) // block) * block, np.uint8)
        padded[: len(bitmap)] = bitmap
        counts = _ONES[padded].reshape(-1, block).sum(1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8")
        levels.append((chunks, padded, ranks))
        rest = rest[more]
        if not len(rest):
            return levels


def file_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A file: header, documents, then chunks, bitmap and rank directory of every level."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype("<u8")
    levels = chunk_levels(flat)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    parts = [
        MAGIC,
        struct.pack("<QQQ", len(doc_ids), len(flat), len(levels)),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        ends.tobytes(),
    ]
    for chunks, bitmap, ranks in levels:
        parts += [struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks))]
        parts += [chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class TokenFile:
    """Random access to the ids of one file; `buffer` may be a memory map."""

    def __init__(self, buffer):
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", buffer, 8)
        self._at, self._buffer = 32, buffer
        self.doc_ids = self._take("<i8", self.n_docs)
        self.known = self._take("u1", self.n_docs)
        self.ends = self._take("<u8", self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<QQQ", buffer, self._at)
            self._at += 24
            self.levels.append(tuple(self._take(t, n) for t, n in zip(("u1", "u1", "<u8"), sizes)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        array = np.frombuffer(self._buffer, kind, n, self._at)
        self._at += array.nbytes
        return array

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        ids = np.zeros(len(at), np.uint32)
        which = np.arange(len(at))
        place = np.asarray(at, np.int64)
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            ids[which] |= chunks[place].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            more = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            which, place = which[more], place[more]
            if not len(which):
                break
            place = rank(bitmap, ranks, place)
        return ids

    def token(self, at: int) -> int:
        return int(self.tokens(np.array([at]))[0])

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from `start` to before `end`: on every level they are neighbours too."""
        ids = np.zeros(end - start, np.uint32)
        which: np.ndarray | slice = slice(None)
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            if end <= start:
                break
            ids[which] |= chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(bitmap[start >> 3 : (end + 7) >> 3], bitorder="little")
            more = np.flatnonzero(bits[start & 7 : (start & 7) + end - start])
            if not len(more):
                break
            which = more if level == 0 else which[more]
            start = int(rank(bitmap, ranks, np.array([start]))[0])
            end = start + len(more)
        return ids

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k]), int(self.ends[k + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of all documents in order, read in spans of many documents."""
        ends = self.ends.astype(np.int64)
        k = 0
        while k < self.n_docs:
            start = int(ends[k])
            last = max(k + 1, int(np.searchsorted(ends, start + TOKENS_AT_ONCE, "right")) - 1)
            ids = self.span(start, int(ends[last]))
            places = (ends[k : last + 1] - start).tolist()
            yield from (ids[a:b] for a, b in zip(places, places[1:]))
            k = last


def rank(bitmap: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Set bits before each place: the directory, then the bytes since its entry."""
    # Places are looked up in one sweep over the bytes they span, if they lie close together.
    low = int(place.min()) // RANK_BLOCK * (RANK_BLOCK // 8)
    high = int(place.max() >> 3)
    if high - low <= 8 * len(place) + RANK_BLOCK:
        sums = np.concatenate([[0], np.cumsum(_ONES[bitmap[low:high]], dtype=np.int64)])
        before = int(ranks[low // (RANK_BLOCK // 8)]) + sums[(place >> 3) - low]
    else:
        block = place // RANK_BLOCK
        first = block * (RANK_BLOCK // 8)
        window = first[:, None] + np.arange(RANK_BLOCK // 8)
        inside = window < (place >> 3)[:, None]
        before = ranks[block].astype(np.int64) + (_ONES[bitmap[window]] * inside).sum(1)
    own = bitmap[place >> 3] & ((1 << (place & 7)) - 1).astype(np.uint8)
    return before + _ONES[own]


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> str:
    """Write a file under a name of this attempt, and return it. What a lost attempt left behind
    is named by no table."""
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    name = f"{uri}-{attempt}.ids"
    store, path = filesystem(name)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)
    return name


def read_file(uri: str) -> TokenFile:
    store, path = filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        return TokenFile(pa.memory_map(path).read_buffer())
    with store.open_input_file(path) as file:
        return TokenFile(file.read_buffer())


@dataclass(frozen=True)
class TokenFiles:
    """Written files: `(path, part, number, n_docs, n_tokens, first_token)`, one row each."""

    files: DataFrame

    def documents(self, row: Callable[[np.ndarray], tuple], fields: str) -> DataFrame:
        """`(doc_id, start, n_tokens, <fields>)` of every document, read back from the files.

        `row` makes the values of `fields` from the ids of a document.
        """
        schema = f"doc_id long, start long, n_tokens long, {fields}"

        def read(batches):
            for batch in batches:
                for path, first in zip(batch["path"].to_pylist(), batch["first_token"].to_pylist()):
                    file = read_file(path)
                    names = zip(file.doc_ids.tolist(), file.known.tolist(), file.ends.tolist(), file.documents())
                    rows = [
                        (doc_id if known else None, first + start, len(ids), *row(ids))
                        for doc_id, known, start, ids in names
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow_schema)],
                        schema=arrow_schema,
                    )

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
        n = max(1, self.files.count())
        dealt = self.files.select("path", "first_token").repartition(n, "path")
        return dealt.mapInArrow(read, schema)


def write_token_files(
    docs: DataFrame, tokenizer_file: str, end_id: int, tokens_per_file: int = 4_000_000
) -> TokenFiles:
    """Encode every whole text of `docs (doc_id, text, ...)` into files in ascending doc_id order.

    A null or empty text has the end id only; null ids come first; rows with equal ids are all
    written, in the order of a hash of their texts; an empty table writes no file. A file holds
    whole documents up to `tokens_per_file` tokens, or one longer document. The files lie in the
    shared folder; the table of files has one row each.
    """
    folder = new_path(docs.sparkSession, "token-ids")
    schema = "path string, part int, number int, n_docs long, n_tokens long"

    def write(batches):
        part = TaskContext.get().partitionId()
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            data = file_bytes([i for i, _ in held], [x for _, x in held])
            path = write_file(f"{folder}/part-{part:06d}-{number:06d}", data)
            done = {"path": path, "part": part, "number": number, "n_docs": len(held), "n_tokens": size}
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([done], schema=arrow_schema)

        for doc_id, ids in encoded_rows(batches, tokenizer_file, end_id):
            if held and size + len(ids) // 4 > tokens_per_file:
                yield flush()
            held.append((doc_id, ids))
            size += len(ids) // 4
        if held:
            yield flush()

    arrow_schema = pa.schema(
        [("path", pa.string()), ("part", pa.int32()), ("number", pa.int32())]
        + [("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    )
    # Rows of one id are spread by their texts.
    order = ("doc_id", "_hash", "text")
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    files = stage(ordered.mapInArrow(write, schema), "token-files")
    return TokenFiles(
        with_row_index(files, "part", "number", name="file", start_sums={"first_token": "n_tokens"}).drop("file")
    )


def crc_of_ids(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
