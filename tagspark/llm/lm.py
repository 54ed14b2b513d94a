"""Scoring of documents by a recurrent language model learned from the corpus.

Words are counted over all training documents. The commonest words, the end and one symbol for
all other words are the vocabulary of a gated recurrent model (`gru.py`); a word outside of it
costs that symbol and then its own smoothed share of all such words, so every text has a proper
probability.

Training takes every training document once. It goes in rounds over disjoint parts of them: in
a round every learner trains the same model on its own documents, and the models are averaged by
their tokens, chunk by chunk, in a shuffle. Learners are given documents by a hash, and there are
as many as the tokens ask for, so the model depends on the documents and not on the number of
tasks. What comes to the driver is one model, whose size is fixed. The commonest `shipped` words travel with the tasks; the counts of all other words are
joined to the documents that have them, so no table of words is ever held in one place.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tagspark.llm.gru import Gru, Shape
from tagspark.sources.staging import stage

# Stands for the end of a text; no word has white space.
END = b"\n"


@dataclass(frozen=True)
class Settings:
    # Words that the recurrent model knows one by one.
    known: int = 2000
    # Words whose counts travel with the tasks: so many at most, each with more than a
    # `rare_below / shipped` share of the tokens. There are at most `shipped / rare_below` such
    # words, so no more are sent to the driver at any size.
    shipped: int = 200_000
    rare_below: float = 0.1
    rounds: int = 3
    # Training tokens of a learner in a round, about; fewer tokens than this have one learner.
    learner_tokens: int = 500_000
    hidden: int = 16
    # Words counted in a task before they are handed on.
    counted_at_once: int = 300_000
    chunk: int = 4096


@dataclass(frozen=True)
class WordCounts:
    """`table (word, n)` of the training tokens, their number and that of distinct ones."""

    table: DataFrame
    tokens: int
    distinct: int
    shipped: list[tuple[bytes, int]]  # commonest first, without the end
    fewest: float  # words counted more often than this are all shipped
    ends: int


def words_and_end(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_words(training: DataFrame, settings: Settings) -> WordCounts:
    def count(batches):
        held: Counter = Counter()

        def batch():
            words, numbers = list(held.keys()), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(numbers, pa.int64())], names=["word", "n"]
            )

        for rows in batches:
            for text in rows.column("text"):
                held.update(words_and_end(text.as_py()))
                if len(held) >= settings.counted_at_once:
                    yield batch()
        yield batch()

    parts = training.select("text").mapInArrow(count, "word binary, n long")
    table = stage(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    is_end = F.col("word") == F.lit(bytearray(END))
    end = table.filter(is_end).first()
    fewest = (totals["n"] or 0) * settings.rare_below / settings.shipped
    often = table.filter(~is_end & (F.col("n") > fewest))
    common = often.orderBy(F.desc("n"), "word").limit(settings.shipped).collect()
    shipped = [(bytes(r["word"]), r["n"]) for r in common]
    if len(shipped) == settings.shipped:
        fewest = shipped[-1][1]
    return WordCounts(table, totals["n"] or 0, totals["v"], shipped, fewest, end["n"] if end else 0)


def encoded(docs: DataFrame, counts: WordCounts, settings: Settings) -> DataFrame:
    """Documents as symbols, with the sums over words whose counts travel, and the other words.

    `log_counts` sums log10(count + 1) over all shipped words and the end, `log_unknown` over
    those that the recurrent model does not know one by one.
    """
    place = {w: k for k, (w, _) in enumerate(counts.shipped)}
    place[END] = len(counts.shipped)
    logs = np.log10(np.array([n for _, n in counts.shipped] + [counts.ends]) + 1.0)
    known = min(settings.known, len(counts.shipped))
    other, end, end_counts = known, known + 1, counts.ends > 0
    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_other long, n_known long,"
        " log_counts double, log_unknown double, symbols binary, rare array<long>, rare_n array<long>"
    )

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        get = place.get
        for batch in batches:
            columns: list[list] = [[] for _ in range(11)]
            held_out, ids = batch.column("held_out").to_pylist(), batch.column("doc_id").to_pylist()
            for doc_id, held, text in zip(ids, held_out, batch.column("text")):
                words = words_and_end(text.as_py())
                at = np.array([get(w, -1) for w in words])
                missing = np.flatnonzero(at < 0)
                rare = Counter([words[k] for k in missing])
                shipped = at[at >= 0]
                log = logs[shipped]
                symbols = np.where((at < 0) | (at >= known), other, at)
                symbols[-1] = end
                unknown = (shipped >= known) & (shipped < len(logs) - 1)
                hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in rare], np.uint64)
                row = (
                    first, doc_id, held, len(words), int((symbols == other).sum()),
                    len(shipped) - (not end_counts), float(log.sum()), float(log[unknown].sum()),
                    symbols.astype("<u2").tobytes(), hashes.view(np.int64), np.array(list(rare.values()), np.int64),
                )
                first += 1
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.binary()]
            kinds += [pa.list_(pa.int64())] * 2
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def symbols_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2") for x in batch.column("symbols")]


def train(rows: DataFrame, start: Gru, settings: Settings, tokens: int) -> Gru:
    """The model after every document that is not held out was read once; they have `tokens`."""
    model, vector = start, start.vector()
    learners = max(1, round(tokens / settings.rounds / settings.learner_tokens))
    place = F.xxhash64("doc_id", "symbols")
    training = rows.filter("not held_out").select(
        place.alias("place"), F.pmod(F.xxhash64(F.lit(3), place), F.lit(settings.rounds)).alias("round"),
        F.pmod(F.xxhash64(F.lit(4), place), F.lit(learners)).alias("learner"), "symbols",
    )
    n_chunks = -(-len(vector) // settings.chunk)
    for n_round in range(settings.rounds):
        # One array is sent to the tasks of the round.
        model.load(vector)
        sent = model

        def learned(documents: list[np.ndarray]) -> pa.RecordBatch:
            symbols = np.concatenate(documents)
            sent.load(vector)
            sent.squares = {}
            sent.train(symbols)
            mine = np.zeros(n_chunks * settings.chunk, np.float32)
            mine[: len(vector)] = sent.vector()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n_chunks), pa.int32()), pa.array([len(symbols)] * n_chunks, pa.int64()),
                    pa.array([part.tobytes() for part in mine.reshape(n_chunks, -1)], pa.binary()),
                ],
                names=["chunk", "n", "part"],
            )

        def learn(batches):
            learner, documents = None, []
            for batch in batches:
                for k, symbols in zip(batch.column("learner").to_pylist(), symbols_of(batch)):
                    if k != learner and documents:
                        yield learned(documents)
                        documents = []
                    learner = k
                    documents.append(symbols)
            if documents:
                yield learned(documents)

        def average(parts: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(settings.chunk)
            for n, part in zip(parts["n"], parts["part"]):
                total += n * np.frombuffer(part, np.float32)
            mean = (total / parts["n"].sum()).astype(np.float32).tobytes()
            return pd.DataFrame({"chunk": parts["chunk"][:1], "part": [mean]})

        own = training.filter(F.col("round") == n_round).drop("round")
        dealt = own.repartition(learners, "learner").sortWithinPartitions("learner", "place")
        parts = dealt.mapInArrow(learn, "chunk int, n long, part binary")
        found = parts.groupBy("chunk").applyInPandas(average, "chunk int, part binary").collect()
        if found:
            joined = b"".join(r["part"] for r in sorted(found, key=lambda r: r["chunk"]))
            vector = np.frombuffer(joined, np.float32)[: len(vector)]
    model.load(vector)
    model.squares = {}
    return model


def lm_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`, a row per row.

    `docs (doc_id, held_out, text, ...)`; the model learns from the rows that are not held out.
    `n_known` counts tokens that training has, `base_score` and `score` are log10 probabilities:
    of single words with one added to all counts, and of the recurrent model. A null or empty
    text is its end alone. Repeated rows are learned and scored each on their own; an empty
    table gives an empty one; without training documents every token is unknown.

    Words are matched by 64-bit hashes where their counts do not travel.
    """
    counts = count_words(docs.filter(~F.col("held_out")), settings)
    rows = stage(encoded(docs, counts, settings), "symbols")
    known = counts.shipped[: settings.known]
    unknown_tokens = counts.tokens - counts.ends - sum(n for _, n in known)
    unknown_words = max(counts.distinct - len(known) - (counts.ends > 0), 0)
    frequencies = np.array([n for _, n in known] + [unknown_tokens, counts.ends], float)
    shape = Shape(len(frequencies), len(frequencies) - 1, hidden=settings.hidden)
    model = train(rows, Gru.start(frequencies, shape), settings, counts.tokens)

    def score(batches):
        for batch in batches:
            documents = symbols_of(batch)
            found = np.empty(0)
            if documents:
                ends = np.cumsum([len(d) for d in documents])
                found = model.score(np.concatenate(documents).astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found / np.log(10))], names=["row", "model_score"]
            )

    scored = rows.select("row", "symbols").mapInArrow(score, "row long, model_score double")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x"))
    pairs = pairs.select("row", F.col("x.rare").alias("hash"), F.col("x.rare_n").alias("n"))
    # Words with fewer tokens than any that travels; each holds a small share of all rows.
    others = counts.table.filter(F.col("n") <= counts.fewest).select(
        F.xxhash64("word").alias("hash"), F.col("n").alias("c")
    )
    rare = (
        pairs.join(others, "hash", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"),
        )
    )
    base_room = float(np.log10(counts.tokens + counts.distinct + 1))
    unknown_room = float(np.log10(unknown_tokens + unknown_words + 1))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return (
        rows.drop("symbols", "rare", "rare_n")
        .join(scored, "row")
        .join(rare, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(counts.tokens).cast("long").alias("train_tokens"),
            (F.col("log_counts") + rare_logs - F.col("n_tokens") * base_room).alias("base_score"),
            (F.col("model_score") + F.col("log_unknown") + rare_logs - F.col("n_other") * unknown_room).alias("score"),
        )
    )
