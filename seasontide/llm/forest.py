"""MinHash near-duplicates by an LSH forest.

Each document's word shingles give TREES rows of DEPTH min-hashes. A tree sorts the
documents by their row of min-hashes, so that near duplicates stand next to each
other, the longer their common prefix the nearer. Neighbours with a common prefix of
LEAST_DEPTH or more are candidates. A region of a tree is a common prefix: the
shortest that leaves at most REGION documents, down to DEPTH where documents crowd.
A longer prefix misses more linked pairs, so documents of crowded regions get more
trees: as many as make a miss at DEPTH no likelier than one at LEAST_DEPTH elsewhere.

Links are confirmed on whole shingle sets, in two rounds. First each document meets
the centre of its regions (the document that agrees with most of them) and its
nearest neighbour, which joins most groups. Then only regions that still hold
several groups are compared in full, in blocks, between groups and not within.
Members of a group need no further links, so that no group's pairs are ever listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasontide.llm.common import hash_words, mix, slices, stored, windows
from seasontide.llm.components import components

TREES, DEPTH, LEAST_DEPTH = 16, 6, 3
#: Members of a region beyond which it is split by a longer prefix, and of a block in the full comparison.
REGION, BLOCK = 64, 512
#: How far below the threshold the share of equal min-hashes may lie: over five standard deviations of it.
SLACK = 0.2


def _all_trees(percent: int) -> int:
    """Trees that documents of crowded regions need; percentages below 50 count as 50."""
    s = min(max(percent, 50), 99) / 100
    return math.ceil(TREES * math.log1p(-(s**LEAST_DEPTH)) / math.log1p(-(s**DEPTH)))


_HASHES = TREES * DEPTH
_rng = np.random.default_rng(977)
_FACTORS = _rng.integers(1, 2**31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, _HASHES, dtype=np.uint32)
_MORE = max(_all_trees(p) for p in range(50, 100)) * DEPTH - _HASHES
_FACTORS = np.append(_FACTORS, _rng.integers(1, 2**31, _MORE, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
_SHIFTS = np.append(_SHIFTS, _rng.integers(0, 2**32, _MORE, dtype=np.uint32))


def _sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Distinct shingle hashes of each text, sorted, end to end, and the texts' bounds.

    A text with fewer than ``k`` words has its whole word sequence as one shingle.
    """
    words, bounds = hash_words(data, offsets, fold=True)
    shingles, first = windows(words, bounds, k)
    out = []
    for i in range(len(offsets) - 1):
        if first[i + 1] > first[i]:
            out.append(np.unique(shingles[first[i] : first[i + 1]]))
        elif bounds[i + 1] > bounds[i]:
            own = words[bounds[i] : bounds[i + 1]]
            out.append(mix(windows(own, np.array([0, len(own)]), len(own))[0] + np.uint64(len(own))))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _min_hashes(hashes: np.ndarray, bounds: np.ndarray, begin: int = 0, end: int = _HASHES) -> np.ndarray:
    """One row of min-hashes (``begin`` up to ``end``) per text; texts without shingles must be left out."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, end - begin), ">u4")
    with np.errstate(over="ignore"):
        for j in range(begin, end):
            out[:, j - begin] = np.minimum.reduceat((short ^ _SHIFTS[j]) * _FACTORS[j], bounds[:-1])
    return out


def sketch(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, print1, print2, signature): the prints stand for the whole set; stored."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), 1 << 20):
                hashes, bounds = _sets(data, offsets, k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, len(sizes)), np.int64)
                signatures = [None] * len(sizes)
                if len(full):
                    starts = bounds[full]
                    for p, salt in enumerate((np.uint64(0x1234567), np.uint64(0xFEDCBA9876))):
                        prints[p, full] = np.add.reduceat(mix(hashes ^ salt), starts).view(np.int64)
                    rows = _min_hashes(hashes, np.append(starts, len(hashes)))
                    for i, signature in zip(full, rows):
                        signatures[i] = signature.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(sizes)), pa.array(sizes),
                        pa.array(prints[0]), pa.array(prints[1]), pa.array(signatures, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "print1", "print2", "signature"],
                )

    return stored(
        documents.select("doc_id", "text").mapInArrow(
            run, "doc_id long, n_shingles long, print1 long, print2 long, signature binary"
        ),
        "sketches",
    )


def _more_signatures(sets: DataFrame, trees: int) -> DataFrame:
    """(rep, signature) of the trees from TREES up to ``trees``, from whole shingle sets."""

    def run(batches):
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                held, size = [], 0
                while row + len(held) < batch.num_rows and size < 1 << 17:
                    held.append(np.frombuffer(batch.column(1)[row + len(held)].as_buffer(), np.uint64))
                    size += len(held[-1])
                bounds = np.cumsum([0, *map(len, held)])
                found = _min_hashes(np.concatenate(held), bounds, _HASHES, trees * DEPTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(held)), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["rep", "signature"],
                )
                row += len(held)

    return sets.where(F.length("shingles") > 0).mapInArrow(run, "rep long, signature binary")


def _neighbours(classes: DataFrame, begin: int = 0, end: int = TREES) -> DataFrame:
    """(tree, key, id, near, common): rows of the sorted orders that share a prefix with a neighbour; stored.

    ``near`` is the row before, if ``common`` hashes with it are LEAST_DEPTH or more.
    The signatures hold the trees ``begin`` up to ``end``. Ranges of the order end anywhere; rows at an end are kept, as their other
    neighbour isn't seen. The order has the id as its last key, so no key is hot.
    """
    part = F.transform(
        F.sequence(F.lit(0), F.lit(end - begin - 1)), lambda t: F.substring(F.col("signature"), t * (4 * DEPTH) + 1, F.lit(4 * DEPTH))
    )
    rows = classes.select(F.posexplode(part).alias("tree", "key"), F.col("rep").alias("id"))
    rows = rows.withColumn("tree", F.col("tree") + begin)
    ordered = rows.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")

    def lanes(batch):
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH)
        return np.asarray(batch.column(0)), keys, np.asarray(batch.column(2))

    def run(batches):
        before, last = None, None

        def emit(trees, keys, ids, near, common, keep):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(trees[keep].astype(np.int32)), pa.array([x.tobytes() for x in keys[keep]], pa.binary()),
                    pa.array(ids[keep]), pa.array(near[keep]), pa.array(common[keep].astype(np.int32)),
                ],
                ["tree", "key", "id", "near", "common"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            trees, keys, ids = lanes(batch)
            if last is not None:  # the last row of the batch before is judged with this one
                trees, keys, ids = (np.concatenate(x) for x in zip(last[:3], (trees, keys, ids)))
            equal = (keys[1:] == keys[:-1]) & (trees[1:] == trees[:-1])[:, None]
            common = np.concatenate(([DEPTH if last is None else before], np.cumprod(equal, axis=1).sum(axis=1)))
            near = np.concatenate((ids[:1] if last is None else last[3], ids[:-1]))
            after = np.append(common[1:], DEPTH)
            keep = np.maximum(common, after) >= LEAST_DEPTH
            last, before = (trees[-1:], keys[-1:], ids[-1:], near[-1:]), common[-1]
            yield emit(trees[:-1], keys[:-1], ids[:-1], near[:-1], common[:-1], keep[:-1])
        if last is not None:
            yield emit(*last[:3], last[3], np.array([before]), np.array([True]))

    schema = "tree int, key binary, id long, near long, common int"
    return stored(ordered.mapInArrow(run, schema), "neighbours")


def _regions(rows: DataFrame) -> DataFrame:
    """Rows (tree, region, key, id, modal, size): each in the region of adaptive depth, regions of one too.

    Only prefixes with more than REGION members are looked up, a small table that Spark
    can broadcast; a prefix of such a prefix has as many members at least, so their number gives the depth.
    """
    prefix = lambda d: F.substring("key", 1, 4 * d)
    depths = range(LEAST_DEPTH, DEPTH)
    counts = rows.select("tree", F.explode(F.array(*[prefix(d) for d in depths])).alias("prefix")).groupBy("tree", "prefix").count()
    crowded = stored(counts.where(F.col("count") > REGION).select("tree", "prefix"), "crowded")
    placed, depth = rows.select("tree", "key", "id"), F.lit(LEAST_DEPTH)
    for d in depths:
        named = crowded.where(F.length("prefix") == 4 * d).select("tree", F.col("prefix").alias(f"p{d}"), F.lit(1).alias(f"c{d}"))
        placed = placed.withColumn(f"p{d}", prefix(d)).join(named, ["tree", f"p{d}"], "left")
        depth = depth + F.coalesce(f"c{d}", F.lit(0))
    placed = placed.select("tree", F.substring(F.col("key"), F.lit(1), depth * 4).alias("region"), "key", "id")
    # sums of counts: one row per distinct key stands for all documents that share it
    groups = placed.groupBy("tree", "region", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("tree", "region").agg(F.max_by("key", F.struct("n", "key")).alias("modal"), F.sum("n").alias("size"))
    return stored(placed.join(sizes, ["tree", "region"]), "regions")


def _pairs(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates (a, b) of the first round: region centres and nearest neighbours."""
    score = regions.groupBy("id").agg(F.sum((F.col("key") == F.col("modal")).cast("int")).alias("score"))
    centres = (
        regions.join(score, "id")
        .groupBy("tree", "region")
        .agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("centre"))
    )
    middle = regions.join(centres, ["tree", "region"]).select(F.col("id").alias("a"), F.col("centre").alias("b"))
    beside = rows.where(F.col("common") >= LEAST_DEPTH).where("id != near").groupBy("id", "near").agg(F.sum("common").alias("s"))
    nearest = beside.groupBy("id").agg(F.max_by("near", F.struct("s", "near")).alias("near"))
    both = middle.union(nearest.select(F.col("id").alias("a"), F.col("near").alias("b"))).where("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose min-hashes agree enough for the threshold to be in reach."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u4").reshape(-1, _HASHES) for i in (2, 3))
                keep = (x == y).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the similarity."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                keep.append(_linked(x, y, percent))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def shingle_sets(documents: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents named in ``ids``: sorted 64-bit hashes as bytes; stored."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), 1 << 20):
                hashes, bounds = _sets(data, offsets, k)
                values = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(values)), pa.array(values, pa.binary())], ["id", "shingles"]
                )

    named = documents.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return stored(named.mapInArrow(run, "id long, shingles binary"), "sets")


def _mixed(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (tree, region, id, part, stray) of regions that hold several groups.

    The largest group of a region is its main one; all others are strays.
    """
    named = regions.select("tree", "region", "id").join(parts, "id", "left")
    named = named.select("tree", "region", "id", F.coalesce("component", "id").alias("part"))
    counts = named.groupBy("tree", "region", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids")
    )
    mains = counts.groupBy("tree", "region").agg(
        F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("size"),
        F.sum("ids").alias("print"),
    )
    mains = mains.where("groups > 1")
    return named.join(mains, ["tree", "region"]).withColumn("stray", F.col("part") != F.col("main"))


def _between(members: DataFrame, payload: DataFrame, column: str, judge) -> DataFrame:
    """Compare strays with the members of other groups of their region, in blocks.

    Strays are cut into blocks, and so are all members; each pair of blocks is one
    piece of work of bounded size. ``judge(ids, parts, stray, payloads, n_left)``
    yields (a, b) rows.
    """
    cut = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    strays = members.groupBy("tree", "region").agg(F.sum(F.col("stray").cast("int")).alias("strays"))
    rows = members.join(strays, ["tree", "region"]).withColumns({"rows": cut(F.col("strays")), "cols": cut(F.col("size"))})
    spot = F.abs(F.xxhash64("id"))
    # a stray stands in one row of blocks, and every member in one column; each meets all of the other
    left = rows.where("stray").select(
        "tree", "region", "id", "part", F.lit(True).alias("left"), (spot % F.col("rows")).cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"),
    )
    right = rows.select(
        "tree", "region", "id", "part", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"),
        (spot % F.col("cols")).cast("int").alias("c"),
    )
    dealt = left.union(right).join(payload.withColumnRenamed(column, "payload"), "id")
    keys = ["tree", "region", "r", "c"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("left").desc(), "id")

    def run(batches):
        key, held = None, []

        def done():
            ids = np.array([h[0] for h in held])
            parts = np.array([h[1] for h in held])
            left = sum(h[2] for h in held)
            found = judge(ids, parts, [h[3] for h in held], left) if 0 < left < len(held) else None
            return found if found is not None and len(found[0]) else None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "id", "part", "left", "payload")]
            for tree, region, r, c, i, part, left, payload in zip(*columns):
                if (tree, region, r, c) != key:
                    if held and (found := done()):
                        yield out(found)
                    key, held = (tree, region, r, c), []
                held.append((i, part, left, payload))
        if held and (found := done()):
            yield out(found)

    return dealt.select(*keys, "id", "part", "left", "payload").mapInArrow(run, "a long, b long")


def _judge_signatures(least: float):
    def judge(ids, parts, payloads, left):
        x = np.frombuffer(b"".join(payloads), ">u4").reshape(len(ids), _HASHES).astype(np.uint32)
        y, active = x[left:], np.zeros(len(ids), bool)
        for i in range(left):
            near = ((y == x[i]).mean(axis=1) >= least) & (parts[left:] != parts[i])
            if near.any():
                active[i] = True
                active[left:] |= near
        # one row per document that has a partner in reach
        return ids[active], ids[active]

    return judge


def _judge_sets(percent: int):
    def judge(ids, parts, payloads, left):
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets])
        parent = {p: p for p in set(parts.tolist())}

        def root(p):
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        # shared shingles of a stray with all others by one lookup in the others' joined sets
        right = np.concatenate(sets[left:])
        owner = np.repeat(np.arange(len(ids) - left), sizes[left:])
        order = np.argsort(right, kind="stable")
        right, owner = right[order], owner[order]
        a, b = [], []
        for i in range(left):
            low, high = np.searchsorted(right, sets[i], "left"), np.searchsorted(right, sets[i], "right")
            count = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            shared = np.bincount(owner[at], minlength=len(ids) - left)
            linked = 100 * shared >= percent * (sizes[i] + sizes[left:] - shared)
            for j in np.flatnonzero(linked) + left:
                x, y = root(int(parts[i])), root(int(parts[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return a, b

    return judge


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents`` (doc_id, text).

    A-Z read as a-z; words are runs of non-space; a document's set holds its distinct
    ``k``-word shingles, or its whole sequence if it has fewer words. Documents link
    when 100 * shared >= ``percent`` * united. component_id is the smallest doc_id
    reachable and kept marks it. Null, empty and blank texts have empty sets and link
    with nothing, not even each other. Documents with equal sets are one class and
    cost as much as one. Rows that repeat a doc_id are one vertex; with a null doc_id
    they link with nothing (component null, kept true). An empty table gives no rows.

    Sets are compared by 64-bit hashes of shingles. A linked pair is seen unless all
    TREES prefixes of LEAST_DEPTH differ: at the threshold of 80 (85) percent about 1e-5
    (3e-7) of pairs, and at most twice that in crowded regions, whose documents have
    38 (33) trees.
    """
    prints = sketch(documents, k)
    keys = ["n_shingles", "print1", "print2"]
    classes = stored(
        prints.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*keys)
        .agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")),
        "classes",
    )
    rows = _neighbours(classes)
    placed = _regions(rows)
    regions = placed.where("size > 1")
    crowded = placed.where(F.length("region") > 4 * LEAST_DEPTH).select("id").distinct()
    near = percent / 100 - SLACK
    wanted = placed.select("id").union(rows.where(F.col("common") >= LEAST_DEPTH).select("near")).distinct()
    sets = shingle_sets(documents, wanted, k)
    trees = _all_trees(percent)
    if trees > TREES:
        # both documents of a pair that shares a crowded prefix are in these trees
        more = _neighbours(_more_signatures(sets.join(crowded, "id", "left_semi"), trees), TREES, trees)
        rows = rows.union(more)
        regions = stored(regions.union(_regions(more).where("size > 1")), "regions")
    first = stored(_confirm(_similar(_pairs(rows, regions), classes, near), sets, percent), "links")
    parts = stored(components(first), "parts")

    members = _mixed(regions, parts)
    signatures = classes.select(F.col("rep").alias("id"), "signature")
    # the same groups meet in several trees: one region stands for those with equal members
    single = members.select("tree", "region", "print").distinct().groupBy("print").agg(F.min(F.struct("tree", "region")).alias("x"))
    members = members.join(single.select("x.tree", "x.region"), ["tree", "region"], "left_semi")
    members = stored(members, "members")
    active = _between(members, signatures, "signature", _judge_signatures(near)).select(F.col("a").alias("id")).distinct()
    rest = members.join(stored(active, "active"), "id", "left_semi")
    second = stored(_between(rest, sets, "shingles", _judge_sets(percent)), "links")
    # the stars of the first round stand for its links
    parts = components(parts.select(F.col("component").alias("a"), F.col("id").alias("b")).union(second))

    found = classes.select(*keys, "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select(*keys, F.coalesce("component", "rep").alias("component"))
    rated = prints.select("doc_id", *keys).join(found, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rated.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
