"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most `k` bits are cut into `k // 2 + 1` segments; one segment
then differs in at most one bit. Every fingerprint is indexed under all variants of its
segments with one bit wiped out, so two fingerprints that may link always share a key; an
equality join finds them and all 64 bits are compared.

Keys that many share are cut again, by the bits outside their segment, so the comparisons of a
fingerprint do not grow with the number of fingerprints.

Equal fingerprints are made one before anything else. Inside a key only a spanning forest of
the links is written, never all pairs: members are taken up one by one, and everything within
reach of one leaves the list of those still to be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tagspark.operators.joins import split_lookup
from tagspark.sources.staging import stage

BITS = 64
# Members of a key that are compared in one task. Inside larger keys the method is applied again;
# what is large even then is cut into blocks, and every pair of blocks is compared.
BLOCK = 20_000
# Large keys, of a few bytes each, that are broadcast at most.
LARGE_AT_ONCE = 1_000_000
ROWS_AT_ONCE = 512


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """`(doc_id, fp)` of every row; `fp` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = [fingerprint(t.as_py(), shingle) for t in part.column("text")]
                fp = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """`(first bit, bits)` of the segments, as even as they go."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def segment_value(first: int, bits: int) -> str:
    mask = (1 << bits) - 1 if bits < BITS else -1
    return f"(shiftrightunsigned(fp, {first}) & {mask}L)"


def wiped_keys(value: str, first: int, bits: int, above: str = "") -> list[str]:
    """Keys of a segment's value with one of its bits wiped out, for each of its bits."""
    return [f"xxhash64({above}{bit}, {value} & ~{1 << (bit - first)}L)" for bit in range(first, first + bits)]


def keys_of(fps: DataFrame, distance: int) -> DataFrame:
    """`(key, part, fp)`: every fingerprint under each one-bit-wiped variant of each segment."""
    keys = [
        f"named_struct('key', {key}, 'part', {part})"
        for part, (first, bits) in enumerate(segments(distance))
        for key in wiped_keys(segment_value(first, bits), first, bits)
    ]
    return fps.selectExpr(f"inline(array({', '.join(keys)}))", "fp")


def rest_segments(first: int, bits: int, distance: int) -> list[tuple[int, int, str]]:
    """`(first bit, bits, value)` of the segments of all bits outside a segment.

    The bits are turned so that those outside come first; of the segments, again one differs in at
    most one bit.
    """
    outside = BITS - bits
    turn = (first + bits) % BITS
    turned = f"(shiftrightunsigned(fp, {turn}) | shiftleft(fp, {BITS - turn}))" if turn else "fp"
    n = distance // 2 + 1
    cuts = [outside * k // n for k in range(n + 1)]
    return [
        (a, b - a, f"(shiftrightunsigned({turned}, {a}) & {(1 << (b - a)) - 1}L)")
        for a, b in zip(cuts, cuts[1:])
        if b > a
    ]


def large_keys(fps: DataFrame, distance: int) -> DataFrame:
    """`key` of those that may hold more than 1.5 blocks.

    The members of a key have one of two values in its segment, so counting the values finds
    all large keys; nearly always there is none.
    """
    parts = None
    for first, bits in segments(distance):
        value = segment_value(first, bits)
        counts = (
            fps.groupBy(F.expr(value).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > BLOCK // 2)
        )
        part = counts.selectExpr(f"explode(array({', '.join(wiped_keys('value', first, bits))})) as key", "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK).select("key")


def large_inner_keys(fps: DataFrame, distance: int) -> DataFrame:
    """`(key, blocks)` of keys inside keys that may still hold more than one block.

    The members of an inner key have one of two values in each of its two segments. Of these four
    pairs of values those that are not counted hold at most a quarter of a block each.
    """
    parts = None
    for first, bits in segments(distance):
        outer = wiped_keys("value", first, bits)
        for a, n, value in rest_segments(first, bits, distance):
            counts = (
                fps.groupBy(F.expr(segment_value(first, bits)).alias("value"), F.expr(value).alias("rest"))
                .agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > BLOCK // 4)
            )
            inner = counts.selectExpr(f"explode(array({', '.join(outer)})) as above", "rest", "n")
            part = inner.selectExpr(f"explode(array({', '.join(wiped_keys('rest', a, n, 'above, '))})) as key", "n")
            parts = part if parts is None else parts.unionByName(part)
    blocks = F.ceil((F.sum("n") + 3 * (BLOCK // 4)) / BLOCK)
    return parts.groupBy("key").agg(blocks.cast("int").alias("blocks")).filter(F.col("blocks") > 1)


def refined(keyed: DataFrame, large: DataFrame, fps: DataFrame, distance: int) -> DataFrame:
    """`(key, fp)` with the method applied once more inside the large keys.

    There a fingerprint is indexed by all bits outside the key's segment, cut and wiped in the same
    way. Members that share an inner key agree in over half of their bits, so unrelated ones no
    longer meet; an inner key that is still large is a group of near copies, and is cut into blocks.
    """
    marked = large.withColumn("is_large", F.lit(True))
    marked = F.broadcast(marked) if large.count() <= LARGE_AT_ONCE else marked
    inner = F.array("key")
    for part, (first, bits) in enumerate(segments(distance)):
        keys = [
            key
            for a, n, value in rest_segments(first, bits, distance)
            for key in wiped_keys(value, a, n, "key, ")
        ]
        if keys:
            here = F.col("is_large") & (F.col("part") == part)
            inner = F.when(here, F.expr(f"array({', '.join(keys)})")).otherwise(inner)
    inside = keyed.join(marked, "key", "left").select(F.explode(inner).alias("key"), "fp")
    still_large = stage(large_inner_keys(fps, distance), "large-inner-keys")
    if still_large.first() is not None:
        # Each member of block i meets every block j in the run (i, j) or (j, i).
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)))
        runs = F.transform(
            F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
            lambda other: F.xxhash64("key", F.least(other, own), F.greatest(other, own)),
        )
        few = still_large.count() <= LARGE_AT_ONCE
        inside = inside.join(F.broadcast(still_large) if few else still_large, "key", "left").select(
            F.explode(runs).alias("key"), "fp"
        )
    return inside


def forest(values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between `values` that join all that are within reach of each other."""
    left = values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= distance
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), here), found
                queue.extend(found)


def links(fps: DataFrame, distance: int) -> DataFrame:
    """`(a, b)`: verified links that connect all distinct fingerprints within `distance` bits."""
    keyed = keys_of(fps, distance)
    large = stage(large_keys(fps, distance), "large-keys")
    keyed = keyed.select("key", "fp") if large.first() is None else refined(keyed, large, fps, distance)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def compare(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """Links of whole keys."""
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            a, b = [fp[:0]], [fp[:0]]
            pairs = starts[sizes == 2]
            near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= distance
            a.append(fp[pairs[near]])
            b.append(fp[pairs[near] + 1])
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for x, y in forest(np.unique(fp[start : start + size]), distance):
                    a.append(x)
                    b.append(y)
            columns = [np.concatenate(c).view(np.int64) for c in (a, b)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            whole = np.searchsorted(key, key[-1]) if len(key) else 0
            if whole:
                yield compare(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield compare(key, fp)

    found = sorted_.mapInArrow(run, "a long, b long")
    return found.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` of all nodes of `edges (a, b)`; the root is the smallest node reachable.

    Every round a node takes the smallest label of itself and its neighbours, and then the
    label of its label, so labels travel twice as far each round.
    """
    both = stage(edges.union(edges.select("b", "a")).toDF("node", "other"), "edges")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root")), "labels")
    while True:
        seen = labels.toDF("other", "seen")
        near = both.join(seen, "other").groupBy("node").agg(F.min("seen").alias("near"))
        nearer = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        nearer = stage(nearer, "labels")
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = stage(
            nearer.join(jump, "next", "left").select(
                "node", F.coalesce(F.least("next", "further"), "next").alias("root"),
                (F.coalesce(F.least("next", "further"), "next") < F.col("root")).alias("moved"),
            ),
            "labels",
        )
        labels = moved.select("node", "root")
        if moved.filter("moved").first() is None:
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """`(doc_id, fingerprint, component_id)`, one row per row of `docs (doc_id, text, ...)`.

    Documents link if their fingerprints differ in at most `distance` bits; `component_id` is
    the smallest `doc_id` that links reach. Null and empty texts have the fingerprint 0, which
    links like any other. Repeated rows each give a row; a null `doc_id` gives a row but is
    never a component's name, unless all of the component's ids are null; an empty table gives
    an empty one.
    """
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = stage(links(fps.select("fp"), distance), "links")
    roots = components(found).toDF("fp", "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    names = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = stage(rooted.join(names, "root").select("fp", "component_id"), "named")
    # A third of all rows may have one fingerprint.
    return split_lookup(rows, named, "fp", "doc_id", counts=(fps, "n")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of `docs` that name their component: one document of each.

    Rows of the same id all stay; rows without an id stay, as nothing can be said of them.
    """
    kept = near.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left").filter(
        F.col("_kept").isNotNull() | docs["doc_id"].isNull()
    ).select(*[docs[c] for c in docs.columns])
