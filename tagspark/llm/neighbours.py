"""Near-duplicate vectors by NN-descent over a cover of balls.

Equal vectors are made one. Dense groups are then covered by balls, so small that all members of
a ball link with each other: a vector joins a ball if it is close enough to its centre, and the
candidates for centres come from sign codes of growing length, one vector a code. Only the centres
and the vectors without a ball, a ball of their own each, take part in the search, so a group of
copies that holds a third of all rows is a few of them.

The neighbour lists of the centres start with windows of several sign-code orders. A round
compares the neighbours of every vector, in both directions, with each other, and keeps the best.
A list that holds nothing but possible links is enlarged, and its neighbours are compared anew.
When rounds find no more, the lists of some centres are audited against all centres; if too few
of their links are there, all lists are enlarged, more orders are tried, and rounds go on.

Links are then decided in double precision: a vector against the centres of balls near its own,
where bounds settle nearly all balls as a whole, and against single members where they cannot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tagspark.llm.simhash import components
from tagspark.operators.joins import HOT_SHARE, split_lookup
from tagspark.sources.staging import stage

# Probes have half precision: an inner product of two is off by less than this.
MARGIN = 0.002
# Bits of a code by which vectors are ordered.
CODE_BITS = 62
# Bits by which codes for centres grow.
CODE_STEP = 4


@dataclass(frozen=True)
class Descent:
    threshold: float = 0.93
    neighbours: int = 8
    # Vectors that have a vector in their lists and take part in its comparisons.
    reverse: int = 8
    orders: int = 3
    window: int = 24
    # A descent ends when new possible links are at most this share of all.
    settled: float = 0.001
    audited: int = 2000
    recall: float = 0.99
    seed: int = 11


def inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def cosine_of(angles: Column) -> Column:
    return F.cos(F.least(angles, F.lit(math.pi)))


def usable(vectors: DataFrame) -> DataFrame:
    """`(vec_id, label, x)` of rows that can link, with their vectors as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    return vectors.filter(F.col("label").isNotNull() & finite & some).select("vec_id", "label", x.alias("x"))


def copy_keys() -> tuple[Column, Column]:
    """128 bits that equal vectors of a label share."""
    return F.xxhash64("label", "x").alias("a"), F.xxhash64(F.lit(7), "x", "label").alias("b")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """`(node, space, a, b, first, n, x)`: equal vectors of a label made one, stored.

    Only vectors of one `space`, that is of one label and length, are compared.
    """
    return stage(
        rows.select("vec_id", "x", *copy_keys(), F.xxhash64("label", F.size("x")).alias("space"))
        .groupBy("a", "b")
        .agg(
            F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("space").alias("space"), F.first("x").alias("x"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"), "space", "a", "b", "first", "n", "x"
        ),
        "vectors",
    )


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of doubles as rows, shorter ones filled up with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def probes(parts: list[bytes]) -> np.ndarray:
    """Vectors in half precision as rows of single precision."""
    width = max(map(len, parts), default=0)
    if any(len(p) != width for p in parts):
        parts = [p.ljust(width, b"\0") for p in parts]
    return np.frombuffer(b"".join(parts), "<f2").reshape(len(parts), -1).astype(np.float32)


def sign_codes(x: np.ndarray, bits: int, seed: list[int]) -> np.ndarray:
    """The sides of random hyperplanes; a dimension has the same planes whatever the width."""
    planes = [np.random.default_rng([*seed, j]).normal(size=bits) for j in range(x.shape[1])]
    signs = x @ np.array(planes) > 0
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)[::-1])


def with_codes(vectors: DataFrame, lengths: list[int], seed: int) -> DataFrame:
    """Replace `x` by the `unit` vector, its `probe` and its `codes`, one of each of the lengths,
    stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            # Scaled first, so that squares neither overflow nor vanish.
            x /= np.abs(x).max(1, initial=1e-300, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            sizes = batch.column("x").value_lengths().to_pylist()
            units = pa.array([row[:n] for row, n in zip(x, sizes)], pa.list_(pa.float64()))
            half = [row[:n].astype("<f2").tobytes() for row, n in zip(x, sizes)]
            codes = np.array([sign_codes(x, bits, [seed, 1, bits]) for bits in lengths]).T
            kept = [name for name in batch.schema.names if name != "x"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in kept], units, pa.array(half, pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))],
                names=[*kept, "unit", "probe", "codes"],
            )

    kept = [f for f in vectors.schema.fields if f.name != "x"]
    doubles = T.ArrayType(T.DoubleType())
    added = [
        T.StructField("unit", doubles), T.StructField("probe", T.BinaryType()), T.StructField("codes", T.ArrayType(T.LongType()))
    ]
    return stage(vectors.mapInArrow(run, T.StructType([*kept, *added])), "coded-vectors")


def cover(vectors: DataFrame, n_codes: int, radius: float) -> DataFrame:
    """`(node, ball)` of the vectors that are in a ball, stored; a ball is named by its centre.

    For each code length the vectors of a code that are near the one that stands for it join its
    ball. Centres stand for their code before others do, so balls grow from length to length.
    """
    spark = vectors.sparkSession
    placed = spark.createDataFrame([], "node long, ball long")
    for k in range(n_codes):
        state = (
            vectors.select("node", "unit", F.xxhash64("space", F.get("codes", F.lit(k))).alias("code"))
            .join(placed, "node", "left")
            .filter(F.col("ball").isNull() | (F.col("ball") == F.col("node")))
        )
        state = stage(state, "uncovered")
        order = F.struct(F.col("ball").isNotNull(), F.xxhash64("node", F.lit(k)))
        stands = stage(
            state.groupBy("code")
            .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("node", "unit"), order).alias("c"))
            .filter("n > 1")
            .select("code", "n", F.col("c.node").alias("centre"), F.col("c.unit").alias("centre_unit")),
            "centres",
        )
        free = state.filter("ball is null").select("node", "unit", "code")
        near = split_lookup(free, stands.drop("n"), "code", "node", counts=(stands, "n")).filter(
            (F.col("node") != F.col("centre")) & (inner("unit", "centre_unit") >= math.cos(radius))
        )
        joined = stage(near.select("node", F.col("centre").alias("ball")), "joined")
        centres = joined.select(F.col("ball").alias("node"), "ball").distinct()
        placed = stage(placed.unionByName(joined).unionByName(centres).distinct(), "placed")
    return placed


def ball_table(vectors: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All vectors with their ball, `(node, ball, space, n, unit)`, and the balls,
    `(node, space, unit, probe, radius, members, total)`, both stored."""
    members = stage(
        vectors.join(placed, "node", "left").select(
            "node", F.coalesce("ball", "node").alias("ball"), "space", "n", "unit", "probe"
        ),
        "members",
    )
    centres = members.filter("node = ball").select("node", "space", "unit", "probe")
    others = members.filter("node != ball").select("node", "ball", "unit", "n")
    counts = stage(members.groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")), "sizes")
    far = split_lookup(
        others, centres.select(F.col("node").alias("ball"), F.col("unit").alias("centre_unit")), "ball", "node",
        counts=(counts, "members"),
    ).groupBy("ball").agg(F.max(angle(inner("unit", "centre_unit"))).alias("radius"))
    # Radii are rounded up.
    balls = centres.join(counts, F.col("node") == counts["ball"]).drop("ball").join(
        far, F.col("node") == far["ball"], "left"
    ).select(
        "node", "space", "unit", "probe", F.coalesce(F.col("radius") + 1e-9, F.lit(0.0)).alias("radius"), "members", "total"
    )
    return members.drop("probe"), stage(balls, "balls")


# The neighbour graph.

PAIRS = "node long, other long, sim float"


def pair_batch(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float32())],
        names=["node", "other", "sim"],
    )


def ordered_pairs(balls: DataFrame, settings: Descent, attempt: int) -> DataFrame:
    """`(node, other, sim)`: the best in windows of several sign-code orders."""
    orders, width, n = settings.orders, settings.window, settings.neighbours

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = probes(batch.column("probe").to_pylist())
            for k in range(orders):
                codes = sign_codes(x, CODE_BITS, [settings.seed, 2, attempt, k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), k, np.int32)), batch.column("space"), pa.array(codes), batch.column("node"), batch.column("probe")],
                    names=["k", "space", "code", "node", "probe"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.num_rows
            if total < 2:
                continue
            x = probes(batch.column("probe").to_pylist())
            node = batch.column("node").to_numpy()
            group = np.stack([batch.column("k").to_numpy().astype(np.int64), batch.column("space").to_numpy()], 1)
            size = min(width, total)
            starts = np.unique(np.minimum(np.arange(0, total, max(1, size // 2)), total - size))
            for at in range(0, len(starts), 256):
                places = starts[at : at + 256, None] + np.arange(size)
                sims = x[places] @ x[places].transpose(0, 2, 1)
                alike = (group[places][:, :, None, :] == group[places][:, None, :, :]).all(-1)
                sims[~alike | np.eye(size, dtype=bool)] = -2
                top = min(n, size - 1)
                best = np.argpartition(-sims, top - 1, axis=2)[:, :, :top]
                found = np.take_along_axis(sims, best, 2)
                w, i, j = np.nonzero(found > -2)
                yield pair_batch(node[places[w, i]], node[places[w, best[w, i, j]]], found[w, i, j])

    coded = balls.select("node", "space", "probe").mapInArrow(code, "k int, space long, code long, node long, probe binary")
    ordered = coded.repartitionByRange("k", "space", "code", "node").sortWithinPartitions("k", "space", "code", "node")
    return ordered.mapInArrow(compare, PAIRS)


def merged(lists: DataFrame, found: DataFrame, neighbours: int) -> DataFrame:
    """Lists with the best of what they had and what was found, stored.

    `lists (node, other, sim, fresh, k, bound)`; a list has up to `k` neighbours, of which those
    below `bound` cannot link. A list of possible links only doubles its `k`; a list that is new
    starts with `neighbours`.
    """
    own = lists.withColumn("fresh", F.lit(False))
    both = own.unionByName(found.withColumn("fresh", F.lit(True)), allowMissingColumns=True)
    one = both.repartition("node").groupBy("node", "other").agg(
        F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"), F.max("k").alias("k"), F.max("bound").alias("bound")
    )
    of_node = Window.partitionBy("node")
    ranked = one.select(
        "node", "other", "sim", "fresh", F.coalesce(F.max("k").over(of_node), F.lit(neighbours)).alias("k"),
        F.coalesce(F.max("bound").over(of_node), F.lit(-2.0)).alias("bound"),
        F.row_number().over(of_node.orderBy(F.desc("sim"), "other")).alias("rank"),
    )
    worst = F.max(F.when(F.col("rank") == F.col("k"), F.col("sim"))).over(of_node)
    full = F.coalesce(worst >= F.col("bound"), F.lit(False))
    return stage(
        ranked.withColumn("full", full)
        .filter(F.col("rank") <= F.col("k"))
        .select("node", "other", "sim", (F.col("fresh") | F.col("full")).alias("fresh"),
                F.when(F.col("full"), F.col("k") * 2).otherwise(F.col("k")).alias("k"), "bound"),
        "lists",
    )


def neighbours_of_neighbours(balls: DataFrame, lists: DataFrame, settings: Descent) -> DataFrame:
    """`(node, other, sim)`: pairs of neighbours of any vector, one of which is new to it, that
    are better than the worst in their lists."""
    in_order = Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64("node", "other"))
    back = lists.withColumn("_r", F.row_number().over(in_order)).filter(F.col("_r") <= settings.reverse)
    back = back.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
    members = (
        lists.select("node", "other", "fresh").unionByName(back).repartition("node")
        .groupBy("node", "other").agg(F.bool_or("fresh").alias("fresh"))
        .withColumn("_any", F.bool_or("fresh").over(Window.partitionBy("node")))
        .filter("_any").drop("_any")
    )
    worst = lists.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= F.max("k"), F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst")
    )
    facing = balls.select("node", "probe").join(worst, "node", "left").select(
        F.col("node").alias("other"), "probe", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst")
    )
    met = split_lookup(stage(members, "pools"), facing, "other", "node")
    pools = met.groupBy("node").agg(F.collect_list(F.struct("other", "fresh", "worst", "probe")).alias("pool"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_ = batch.column("pool")
            lengths = lists_.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            flat = lists_.flatten()
            if not len(flat):
                continue
            x = probes(flat.field("probe").to_pylist())
            node = flat.field("other").to_numpy()
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False)
            worst_ = flat.field("worst").to_numpy()
            by_length = np.argsort(lengths, kind="stable")
            at = 0
            while at < len(by_length):
                # Pools of about the same length are compared together.
                size = int(lengths[by_length[at]])
                room = max(1, 300_000 // max(1, (size + 4) ** 2))
                some = by_length[at : at + room]
                some = some[lengths[some] <= size + 4]
                at += len(some)
                size = int(lengths[some].max())
                inside = np.arange(size) < lengths[some][:, None]
                places = np.where(inside, starts[some][:, None] + np.arange(size), 0)
                sims = x[places] @ x[places].transpose(0, 2, 1)
                good = sims > worst_[places][:, :, None]
                good &= fresh[places][:, :, None] | fresh[places][:, None, :]
                good &= inside[:, :, None] & inside[:, None, :] & ~np.eye(size, dtype=bool)
                w, i, j = np.nonzero(good)
                yield pair_batch(node[places[w, i]], node[places[w, j]], sims[w, i, j])

    return pools.mapInArrow(run, PAIRS)


def audit(balls: DataFrame, lists: DataFrame, settings: Descent) -> tuple[float, DataFrame]:
    """The share of possible links of some centres that the lists have, and these links.

    At most `audited` centres, chosen by hash, are compared with all.
    """
    chosen = balls.select("node", "space", "probe", "radius").orderBy(F.xxhash64("node")).limit(settings.audited).collect()
    ids = np.array([r["node"] for r in chosen], np.int64)
    spaces = np.array([r["space"] for r in chosen], np.int64)
    radii = np.array([r["radius"] for r in chosen])
    parts = [bytes(r["probe"]) for r in chosen]
    reach = math.acos(settings.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = probes(parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = probes(part.column("probe").to_pylist())
                width = max(x.shape[1], asked.shape[1])
                wide = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (asked, x)]
                sims = wide[0] @ wide[1].T
                node = part.column("node").to_numpy()
                bound = np.cos(np.minimum(reach + radii[:, None] + part.column("radius").to_numpy()[None, :], math.pi))
                good = (sims >= bound) & (spaces[:, None] == part.column("space").to_numpy()[None, :])
                good &= ids[:, None] != node[None, :]
                i, j = np.nonzero(good)
                yield pair_batch(ids[i], node[j], sims[i, j])

    if not chosen:
        return 1.0, balls.sparkSession.createDataFrame([], PAIRS)
    true = stage(balls.select("node", "space", "probe", "radius").mapInArrow(run, PAIRS), "audit")
    there = lists.select("node", "other").union(lists.select("other", "node")).distinct().withColumn("there", F.lit(True))
    counts = true.join(there, ["node", "other"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("found")).first()
    return (counts["found"] / counts["n"] if counts["n"] else 1.0), true


def neighbour_graph(balls: DataFrame, settings: Descent) -> DataFrame:
    """`(node, other, sim)` of the audited lists of all centres, stored."""
    spark = balls.sparkSession
    widest = balls.agg(F.coalesce(F.max("radius"), F.lit(0.0)).alias("r")).first()["r"]
    bound = cosine_of(math.acos(settings.threshold) + F.col("radius") + widest) - MARGIN
    sizes = balls.select("node", F.lit(settings.neighbours).alias("k"), bound.alias("bound"))
    first = ordered_pairs(balls, settings, 0).join(sizes, "node")
    empty = spark.createDataFrame([], "node long, other long, sim float, fresh boolean, k int, bound double")
    lists = merged(empty, first, settings.neighbours)
    attempt = 0
    while True:
        while True:
            lists = merged(lists, neighbours_of_neighbours(balls, lists, settings), settings.neighbours)
            useful = F.col("sim") >= F.col("bound")
            seen = lists.agg(
                F.count(F.when(useful, 1)).alias("all"), F.count(F.when(useful & F.col("fresh"), 1)).alias("new")
            ).first()
            if seen["new"] <= settings.settled * seen["all"]:
                break
        share, links = audit(balls, lists, settings)
        if share >= settings.recall:
            return stage(lists.select("node", "other", "sim").unionByName(links), "graph")
        attempt += 1
        more = ordered_pairs(balls, settings, attempt).unionByName(links)
        lists = merged(lists.withColumn("k", F.col("k") * 2), more, settings.neighbours)


# Links.


def linked(members: DataFrame, balls: DataFrame, graph: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """`(node, links)`, links of vectors to other balls, and `(a, b)`, balls with a link between
    them; both stored. Every vector counts its own links, so nothing is counted for another."""
    reach = math.acos(threshold)
    both = graph.select("node", "other", "sim").unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim"))
    pairs = both.groupBy("node", "other").agg(F.max("sim").alias("sim")).filter("node != other")
    own = balls.select("node", F.col("radius").alias("own_radius"))
    theirs = balls.select(F.col("node").alias("other"), "radius", F.col("members").alias("others"), "total", F.col("unit").alias("centre"))
    edges = split_lookup(pairs.join(own, "node"), theirs, "other", "node").filter(
        F.col("sim") >= cosine_of(reach + F.col("own_radius") + F.col("radius")) - MARGIN
    )
    edges = stage(edges.select(F.col("node").alias("ball"), "other", "radius", "others", "total", "centre"), "edges")
    counts = stage(members.groupBy("ball").agg(F.count(F.lit(1)).alias("n")), "ball-counts")
    met = split_lookup(members.select("node", "ball", "unit"), edges, "ball", "node", counts=(counts, "n"))
    met = met.withColumn("cosine", inner("unit", "centre"))
    single = F.col("others") == 1
    # Bounds are drawn a little apart, so that rounding cannot decide for a ball as a whole.
    whole = F.when(single, F.col("cosine") >= threshold).otherwise(
        F.col("cosine") >= F.cos(F.greatest(reach - F.col("radius") - 1e-9, F.lit(0.0)))
    )
    partly = ~single & ~whole & (F.col("cosine") >= cosine_of(reach + F.col("radius") + 1e-9))
    met = stage(
        met.select("node", "ball", "other", "total", whole.alias("whole"), partly.alias("partly"), F.when(partly, F.col("unit")).alias("unit"))
        .filter("whole or partly"),
        "met",
    )
    asked = met.filter("partly").select("node", "ball", "other", "unit")
    inside = members.select(F.col("ball").alias("other"), F.col("unit").alias("member"), "n")
    # A thousand vectors that ask for a ball's members are no reason to split it yet.
    share = min(1.0, max(HOT_SHARE, 1000 / max(1, asked.count())))
    close = split_lookup(asked, inside, "other", "node", share=share).filter(inner("unit", "member") >= threshold)
    found = stage(
        met.filter("whole").select("node", "ball", "other", F.col("total").alias("links")).unionByName(
            close.groupBy("node", "ball", "other").agg(F.sum("n").alias("links"))
        ),
        "links",
    )
    per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    between = found.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct()
    return stage(per_node, "link-counts"), stage(between, "ball-links")


def near_vectors(vectors: DataFrame, settings: Descent = Descent()) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)`, one row per row of
    `vectors (vec_id, embedding, label, ...)`.

    Rows of one label and length link if their cosine is at least the threshold. `n_links` counts
    the other rows linked directly, `component_id` is the smallest id that links reach, and the
    row of that id is `kept`. Rows with a null label, or with a vector that is null, empty, zero or
    has null or non-finite components link with nothing and are components of their own. Repeated
    rows link with each other like any equal vectors; a null id is never a component's name unless
    it is alone there, and is not kept. An empty table gives an empty one. Other columns are not
    looked at.
    """
    if not 0 < settings.threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    rows = usable(vectors)
    distinct = distinct_vectors(rows)
    n = max(2, distinct.count())
    lengths = list(range(CODE_STEP, max(CODE_STEP, math.ceil(math.log2(n))) + 1, CODE_STEP))
    coded = with_codes(distinct, lengths, settings.seed)
    # Any two members of a ball are at most two radii apart.
    placed = cover(coded, len(lengths), math.acos(settings.threshold) / 2 - 1e-9)
    members, balls = ball_table(coded, placed)
    graph = neighbour_graph(balls, settings)
    counts, between = linked(members, balls, graph, settings.threshold)
    reached = components(between).toDF("ball", "root")
    sizes = balls.select(F.col("node").alias("ball"), "total")
    firsts = distinct.select("node", "a", "b", "first", F.col("n").alias("copies"))
    named = stage(
        members.select("node", "ball").join(firsts, "node")
        .join(sizes, "ball").join(counts, "node", "left").join(reached, "ball", "left")
        .select("a", "b", "copies", "first", (F.col("total") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "ball").alias("root")),
        "named",
    )
    ids = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("component_id"))
    ids = stage(ids, "component-ids")
    answers = stage(
        split_lookup(named, ids.select("root", "component_id"), "root", "a", counts=(ids, "n"))
        .select("a", F.col("b").alias("_b"), "copies", "n_links", "component_id"),
        "answers",
    )
    keyed = rows.select("vec_id", *copy_keys())
    found = split_lookup(keyed, answers.drop("copies"), "a", "vec_id", counts=(answers, "copies")).filter("b = _b")
    return found.select("vec_id", "n_links", "component_id").unionByName(unlinked(vectors)).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def unlinked(vectors: DataFrame) -> DataFrame:
    """Rows that cannot link, each a component of its own."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    can = F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))
    return vectors.filter(~can).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
