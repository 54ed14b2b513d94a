"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Pieces are taken from the longest down; each goes to the open sequence that
fits it in every capacity and scores best, by the smallest weighted norm of what would stay
free, or by the largest weighted dot-product of its needs and what is free.

Pieces are dealt by hash into groups of a bounded number of tokens, and each group is packed
in one task. What a group leaves open at its end is less than one sequence in about two
thousand.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tagspark.llm.tokens import encoded_rows
from tagspark.sources.staging import stage


@dataclass(frozen=True)
class Capacities:
    tokens: int = 2048
    # At their defaults these two never bind before the tokens do.
    documents: int = 2048
    attention: float = 2048.0**2
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"
    # Tokens of a group that is packed in one task.
    group_tokens: int = 4_000_000


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, tokens: int) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32)`: whole texts, cut only where too long.

    A null or empty text has the end id only. Repeated rows give repeated pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        rows: list[tuple] = []

        def batch():
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for doc_id, ids in encoded_rows(batches, tokenizer_file, end_id):
            for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                part = ids[at : at + 4 * tokens]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= 10_000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces that come in descending order of length."""
    limits = np.array([caps.tokens, caps.documents, caps.attention], float)
    weights = np.array(caps.weights)
    n = len(lengths)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    free = np.empty((64, 3))  # of open sequences, in whole units
    names = np.empty(64, np.int64)
    n_open = n_all = 0
    least = float(lengths[-1]) if n else 0.0
    for k in range(n):
        length = float(lengths[k])
        need = np.array([length, 1.0, length * length])
        if (need > limits).any():
            raise ValueError(f"a piece of {int(length)} tokens exceeds a capacity")
        choice = -1
        if n_open:
            now = free[:n_open]
            fits = np.flatnonzero((now >= need).all(1))
            if len(fits):
                if caps.score == "dot":
                    choice = fits[np.argmax(((now[fits] / limits) * (need / limits)) @ weights)]
                else:
                    choice = fits[np.argmin((((now[fits] - need) / limits) ** 2) @ weights)]
        if choice < 0:
            if n_open == len(free):
                free, names = np.concatenate([free, free]), np.concatenate([names, names])
            choice, n_open = n_open, n_open + 1
            free[choice], names[choice] = limits, n_all
            n_all += 1
        sequence[k] = names[choice]
        offset[k] = caps.tokens - free[choice, 0]
        free[choice] -= need
        # A sequence that not even the shortest piece fits is closed.
        if free[choice, 0] < least or free[choice, 1] < 1 or free[choice, 2] < least * least:
            n_open -= 1
            free[choice], names[choice] = free[n_open], names[n_open]
    return sequence, offset


def pack_pieces(pieces: DataFrame, caps: Capacities = Capacities()) -> DataFrame:
    """`pieces (doc_id, piece, length, ...)` with `sequence_id` and `offset`.

    `pieces` should be stored, as it is read twice. Repeated rows are packed each on their own,
    an empty table gives an empty one, other columns are kept. Null lengths are an error.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, round(total / caps.group_tokens))
    added = [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
    schema = T.StructType([*pieces.schema, *added])

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        sequence, offset = best_fit(order["length"].to_numpy(), caps)
        order = order.drop(columns="_group")
        return order.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    # With the number of the stored row, so that pieces of one id, or of none, are spread too.
    row = F.monotonically_increasing_id()
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", row), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(
    docs: DataFrame, tokenizer_file: str, end_id: int, caps: Capacities = Capacities()
) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32, sequence_id, offset)` of all documents."""
    pieces = stage(token_pieces(docs, tokenizer_file, end_id, caps.tokens), "pieces")
    return pack_pieces(pieces, caps)
