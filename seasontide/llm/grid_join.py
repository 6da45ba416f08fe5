"""Near duplicates of embeddings by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart; the join looks for pairs within
that distance. Vectors are sorted by their grid cells on the leading principal
dimensions and cut into blocks with bounding boxes. Intervals of the sequence, from
the whole of it down to single blocks, are joined with each other; a pair of
intervals whose boxes lie further apart than epsilon is skipped with all below it.
Blocks that are left are compared in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasontide.llm.common import stored
from seasontide.llm.components import components

#: Principal dimensions of the grid; they decide what is skipped, not what is found.
DIMENSIONS = 8
#: Rows on which the principal dimensions are fitted, the first in the order of a hash.
FITTED_ROWS = 10_000
BLOCK = 1024
#: Bytes of vectors that a task holds while their partners stream past it: a stretch of blocks.
STRETCH_BYTES = 32 << 20
#: Tasks over which the partners of one stretch are dealt, where there are fewer stretches than cores.
MOST_LANES = 32
#: Each interval has 32 parts; a partition numbers its blocks below 32 ** 4,
#: which is a thousand million rows.
FAN_BITS, SEQUENCE_BITS = 5, 20


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column in double precision, padded with zeros to one width."""
    lengths = np.diff(np.asarray(column.offsets))
    width = width or int(lengths.max(initial=0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """(embedding, rep, n): equal usable vectors, with their smallest id and the number of their ids."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", bad)
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.where(usable)
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"))


def _kind(classes: DataFrame) -> str:
    """How vectors travel: as given, so that single precision takes half the space."""
    return "f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"


def _blocks(classes: DataFrame, axes: np.ndarray, centre: np.ndarray, epsilon: float) -> DataFrame:
    """Blocks of the grid-ordered sequence: (block, part, rows_before, reps, sizes, vectors, lo, hi).

    rows_before counts the rows of the partition ahead of the block.
    """
    width, dims = axes.shape
    kind = _kind(classes)

    def place(batches):
        for batch in batches:
            spots = (_units(_matrix(batch.column(0), width)) - centre) @ axes
            cells = np.floor(spots / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    *(pa.array(cells[:, d]) for d in range(dims)),
                    pa.array(list(spots), pa.list_(pa.float64())),
                ],
                ["embedding", "rep", "n", *(f"g{d}" for d in range(dims)), "spot"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    cells = [f"g{d}" for d in range(dims)]
    placed = classes.mapInArrow(place, f"{kinds}, {', '.join(f'{c} int' for c in cells)}, spot array<double>")
    ordered = placed.repartitionByRange(*cells, "rep").sortWithinPartitions(*cells, "rep")

    def block(batches):
        part, seq, ahead, held = TaskContext.get().partitionId(), 0, 0, []

        def cut(table: pa.Table):
            nonlocal seq, ahead
            if seq >> SEQUENCE_BITS:
                raise ValueError("too many blocks in a partition: use more shuffle partitions")
            spots = _matrix(table.column("spot").combine_chunks(), dims)
            values = _matrix(table.column("embedding").combine_chunks(), width).astype(kind)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part << SEQUENCE_BITS | seq], pa.int64()),
                    pa.array([part], pa.int32()),
                    pa.array([ahead], pa.int64()),
                    pa.array([table.column("rep").to_pylist()], pa.list_(pa.int64())),
                    pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())),
                    pa.array([values.tobytes()], pa.binary()),
                    pa.array([spots.min(axis=0)], pa.list_(pa.float64())),
                    pa.array([spots.max(axis=0)], pa.list_(pa.float64())),
                ],
                ["block", "part", "rows_before", "reps", "sizes", "vectors", "lo", "hi"],
            )
            seq += 1
            ahead += table.num_rows
            return row

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK:
                table, at = pa.Table.from_batches(held), 0
                while table.num_rows - at >= BLOCK:
                    yield cut(table.slice(at, BLOCK))
                    at += BLOCK
                held, rows = table.slice(at).to_batches(), table.num_rows - at
        if rows:
            yield cut(pa.Table.from_batches(held))

    schema = "block long, part int, rows_before long, reps array<long>, sizes array<long>, vectors binary, lo array<double>, hi array<double>"
    return stored(ordered.mapInArrow(block, schema), "blocks")


def _stretches(blocks: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(block, stretch) and the number of stretches: about ``rows`` rows of the sequence each.

    Stretches go on across partitions; only a row count per partition comes to the driver.
    """
    parts = blocks.groupBy("part").agg(F.sum(F.size("reps")).alias("n")).orderBy("part").collect()
    ahead, total = [], 0
    for p in parts:
        ahead.append((p["part"], total))
        total += p["n"]
    starts = blocks.sparkSession.createDataFrame(ahead, "part int, ahead long")
    at = (F.col("ahead") + F.col("rows_before")) / F.lit(rows)
    placed = blocks.select("block", "part", "rows_before").join(starts, "part").select("block", F.floor(at).alias("stretch"))
    return placed, -(-total // rows)


def _near_blocks(boxes: DataFrame, epsilon: float, dims: int) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes lie within epsilon, by joining intervals top down."""
    levels = [stored(boxes.select(F.col("block").alias("node"), "lo", "hi"), "boxes")]
    while levels[-1].limit(2).count() > 1:
        lower = levels[-1].withColumn("node", F.shiftright("node", FAN_BITS))
        ends = [F.min(F.get("lo", F.lit(d))).alias(f"lo{d}") for d in range(dims)]
        ends += [F.max(F.get("hi", F.lit(d))).alias(f"hi{d}") for d in range(dims)]
        upper = lower.groupBy("node").agg(*ends)
        upper = upper.select("node", *[F.array(*[f"{x}{d}" for d in range(dims)]).alias(x) for x in ("lo", "hi")])
        levels.append(stored(upper, "boxes"))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    gap = F.lit(0.0)
    for d in range(dims):
        at = F.lit(d)
        apart = F.greatest(F.get("lo_b", at) - F.get("hi_a", at), F.get("lo_a", at) - F.get("hi_b", at), F.lit(0.0))
        gap = gap + apart * apart
    for level in reversed(levels[:-1]):
        side = lambda x: level.select(
            F.shiftright("node", FAN_BITS).alias(x), F.col("node").alias(f"node_{x}"), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")
        )
        # a hair more than epsilon, for the rounding of the projection
        near = pairs.join(side("a"), "a").join(side("b"), "b").where("node_a <= node_b").where(gap <= epsilon**2 + 1e-9)
        pairs = stored(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "intervals")
    return pairs


def _compare(pairs: DataFrame, blocks: DataFrame, least: float, width: int, kind: str) -> DataFrame:
    """(rep, links, joined): per block and vector with a link, the vectors it links and its component there.

    A task holds a stretch of blocks, as they travel, and compares each partner block
    that streams past with those of the stretch that it is paired with, two blocks at a
    time. So a block travels once per stretch and not once per pair.
    """
    rows = max(BLOCK, STRETCH_BYTES // (width * np.dtype(kind).itemsize))
    stretch, count = _stretches(blocks, rows)
    lanes = min(max(1, pairs.sparkSession.sparkContext.defaultParallelism // max(count, 1)), MOST_LANES)
    body = [F.col(c) for c in ("reps", "sizes", "vectors")]
    held = stretch.join(blocks, "block").select(
        "stretch", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(False).alias("partner"),
        "block", F.lit(None).cast("array<long>").alias("paired"), *body,
    )
    # a list holds the blocks of one stretch at most
    met = pairs.join(stretch, F.col("a") == F.col("block")).groupBy("stretch", "b").agg(F.sort_array(F.collect_list("a")).alias("paired"))
    passing = met.join(blocks, F.col("b") == F.col("block")).select(
        "stretch", F.pmod(F.xxhash64("b"), F.lit(lanes)).cast("int").alias("lane"), F.lit(True).alias("partner"),
        "block", "paired", *body,
    )
    dealt = held.union(passing).repartition("stretch", "lane").sortWithinPartitions("stretch", "lane", "partner", "block")

    def run(batches):
        now, own = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key != now:
                    now, own = key, {}
                b = batch.column(3)[i].as_py()
                reps, sizes = (np.asarray(batch.column(k)[i].values) for k in (5, 6))
                vectors = np.frombuffer(batch.column(7)[i].as_py(), kind).reshape(-1, width)
                if not batch.column(2)[i].as_py():
                    own[b] = np.array(reps), np.array(sizes), vectors
                    continue
                vb = _units(vectors.astype(np.float64))
                for a in batch.column(4)[i].as_py():
                    ra, na, va = own[a]
                    found = _links(ra, na, _units(va.astype(np.float64)), reps, sizes, vb, least, a == b)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["rep", "links", "joined"])

    return stored(dealt.mapInArrow(run, "rep long, links long, joined long"), "links")


def _links(ra, na, va, rb, nb, vb, least: float, same: bool):
    """Links between two blocks of unit vectors: (ids with a link, vectors linked, smallest place reached); None without any."""
    x, y = np.nonzero(va @ vb.T >= least)
    if same:
        x, y = x[x != y], y[x != y]
    if not len(x):
        return None
    links = np.zeros(len(ra), np.int64)
    np.add.at(links, x, nb[y])
    reps = ra
    if not same:
        back = np.zeros(len(rb), np.int64)
        np.add.at(back, y, na[x])
        reps, links, y = np.concatenate((ra, rb)), np.concatenate((links, back)), y + len(ra)
    label = np.arange(len(reps))
    while True:  # smallest label on both ends of each link, until nothing changes
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = links > 0
    return reps[keep], links[keep], reps[label][keep]


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Vectors link when their cosine in double precision is ``least`` or more. n_links
    counts the other ids with a vector linked directly, component_id is the smallest id reachable.
    Equal vectors are one class, so that many copies cost as much as one. Vectors that
    are null, zero, empty, or hold null or non-finite components, and rows without an
    id, link with nothing. Shorter vectors count as padded with zeros. Rows that repeat
    an id are one vertex of the graph. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding")
    classes = stored(_classes(rows), "classes")
    sample = classes.orderBy(F.xxhash64("rep", "embedding")).select("embedding").limit(FITTED_ROWS).toArrow()
    if not sample.num_rows:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    units = _units(_matrix(sample.column(0).combine_chunks(), width))
    centre = units.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(units.T).reshape(width, width) if len(units) > 1 else np.eye(width))
    axes = axes[:, ::-1][:, :DIMENSIONS]
    epsilon = float(np.sqrt(max(2 - 2 * least, 0.0)))
    blocks = _blocks(classes, axes, centre, max(epsilon, 1e-6))
    pairs = _near_blocks(blocks, epsilon, axes.shape[1])
    links = _compare(pairs, blocks, least, width, _kind(classes))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(links.where("rep != joined").select(F.col("rep").alias("a"), F.col("joined").alias("b")))
    found = (
        classes.join(counts, "rep", "left")
        .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            F.col("embedding").alias("_e"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    matched = rows.join(found, (F.col("embedding") == F.col("_e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return matched.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
