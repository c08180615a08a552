"""Exact near-duplicate vectors by cover trees and a dual traversal.

Vectors are scaled to unit length; a cosine of at least t is a distance of at
most r = sqrt(2 - 2t).  Equal vectors become one class with a count first.

Top levels: a bounded sample of classes gives the centres.  From the root down, a
cell with too many members for a block is cut by centres that halve its radius
(at most CENTRES of them), until cells fit.  Every class goes to its nearest
centre, and each cell's covering radius is measured over all its members.  Small
cells share a block; only a cell that is narrower than the finest level, where no
radius can prune, is dealt to several blocks by hash.

Lower levels: each block is a cover tree of nested levels with halving radii,
built where the block is.  Block pairs whose cells may hold links (distance of
the centres at most r plus both covering radii) are traversed dually: node pairs
further apart than r plus both covering radii are pruned, node pairs nearer than
r minus both are taken whole, and what is left at the last level is compared in
double precision.

A pair of blocks returns one row per vector that has links there: their number
and the least vector of its local component, never the pairs themselves.

Defined results: null, empty, zero or non-finite vectors (or null components)
link with nothing; vectors of different length never link; equal vectors link
with each other; rows that repeat a vec_id count as vectors of their own, each
with the links of its own vector; rows without a vec_id count and link as others
do, but never name a component (null if none of it has an id) and are not kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.components import components
from calorix.llm.shared import materialise

THRESHOLD = 0.9
#: Classes sampled for the top levels (by hash), and most centres that cut a cell.
SAMPLE, CENTRES = 16_384, 64
#: Most classes of a block and bytes of its vectors: a task holds two blocks.  There are BLOCKS of them at least, for the sake of small tables.
BLOCK, BLOCK_BYTES, BLOCKS = 8192, 32 << 20, 8
#: Radii of the levels inside a block: those above are the cells'.
RADII = (0.5, 0.25, 0.125, 0.0625)
#: Node or point pairs compared at once.
PAIRS_AT_ONCE = 1 << 18
SLACK = 1e-6
COARSE_SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the scale by the largest component avoids overflow."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of two sets of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover(points: np.ndarray, radius: float) -> np.ndarray:
    """Greedy centres (row numbers): every row is within the radius of one, and centres are further apart."""
    centres: list[int] = []
    for at in range(0, len(points), 256):
        batch = points[at : at + 256]
        free = np.ones(len(batch), bool)
        for c in range(0, len(centres), 4096):
            free &= (distances(batch, points[centres[c : c + 4096]]) > radius).all(1)
        left = np.flatnonzero(free)
        if len(left):
            near = distances(batch[left], batch[left]) <= radius
            open_ = np.ones(len(left), bool)
            for i in range(len(left)):
                if open_[i]:
                    centres.append(at + int(left[i]))
                    open_ &= ~near[i]
    return np.array(centres)


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree order of the points, and in that order each point's node on every level and whether it is that node's centre."""
    order, runs = np.arange(len(points)), [(0, len(points))]
    nodes, centres = np.zeros((len(points), len(RADII)), np.int32), np.zeros((len(points), len(RADII)), bool)
    central = np.zeros((len(points), len(RADII)), bool)  # by row number
    for level, radius in enumerate(RADII):
        found = []
        for a, b in runs:
            rows = order[a:b]
            if b - a == 1:
                central[rows[0], level] = True
                found.append((a, b))
                continue
            own = cover(points[rows], radius)
            nearest = np.concatenate([distances(points[rows[i : i + 1024]], points[rows[own]]).argmin(1) for i in range(0, len(rows), 1024)])
            nearest[own] = np.arange(len(own))  # a centre stays in its own node
            central[rows[own], level] = True
            order[a:b] = rows[np.argsort(nearest, kind="stable")]
            ends = a + np.cumsum(np.bincount(nearest, minlength=len(own)))
            found += zip([a, *ends[:-1].tolist()], ends.tolist())
        runs = found
        for n, (a, b) in enumerate(runs):
            nodes[a:b, level] = n
    centres = central[order]
    return order, nodes, centres


class CoverTree:
    """Levels of nodes over a block's unit vectors, which are in tree order: a node is a run of rows."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, centres: np.ndarray):
        self.points = points
        #: per level: starts, ends, centre vectors, covering radii, and first child and number of children in the next level
        self.levels: list[dict[str, np.ndarray]] = []
        for level in range(len(RADII)):
            start = np.flatnonzero(np.diff(nodes[:, level], prepend=-1))
            end = np.append(start[1:], len(points))
            at = np.flatnonzero(centres[:, level])
            far = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", points, points[np.repeat(at, end - start)]), 0))
            far[at] = 0
            radius = np.maximum.reduceat(far, start)
            self.levels.append({"start": start, "end": end, "centre": points[at], "radius": radius})
            if level:
                up = self.levels[level - 1]
                first = np.searchsorted(start, up["start"])
                up |= {"child": first, "children": np.diff(np.append(first, len(start)))}


def expand(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..first+count, and the range each is of."""
    owner = np.repeat(np.arange(len(first)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts), owner


def products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pair of ranges (first, count) all pairs of their numbers, about PAIRS_AT_ONCE at a time."""
    group = np.cumsum(a[1]) // PAIRS_AT_ONCE
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        left, owner = expand(a[0][at], a[1][at])
        first, counts = b[0][at][owner], b[1][at][owner]
        chunk = np.cumsum(counts) // PAIRS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(left)]
        for x, y in zip(edges, edges[1:]):
            if y > x:
                right, back = expand(first[x:y], counts[x:y])
                yield left[x:y][back], right


class Links:
    """Number of links and local component of every row of two blocks."""

    def __init__(self, times: np.ndarray):
        self.times, self.count, self.parent = times, np.zeros(len(times), np.int64), np.arange(len(times))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Different rows a[i] and b[i] are linked."""
        np.add.at(self.count, a, self.times[b])
        np.add.at(self.count, b, self.times[a])
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def root(self, rows: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[rows]
            if (up == rows).all():
                return rows
            self.parent[rows] = self.parent[up]
            rows = up


def traverse(a: CoverTree, b: CoverTree, offset: int, same: bool, threshold: float, links: Links) -> None:
    """Add all links between two trees (rows of b follow at offset); in a tree with itself each pair counts once."""
    r = np.sqrt(2 - 2 * threshold)

    def emit(left: np.ndarray, right: np.ndarray) -> None:
        if same:
            keep = left < right
            left, right = left[keep], right[keep]
        links.add(left, right + offset)

    def exact(left: np.ndarray, right: np.ndarray) -> None:
        for i in range(0, len(left), 1 << 15):
            x, y = left[i : i + (1 << 15)], right[i : i + (1 << 15)]
            near = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= threshold
            emit(x[near], y[near])

    def walk(depth: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        la, lb = a.levels[depth], b.levels[depth]
        for i, j, d in pairs:
            reach = la["radius"][i] + lb["radius"][j]
            near = d <= r + reach + SLACK
            if same:
                near &= i <= j
            i, j, d, reach = i[near], j[near], d[near], reach[near]
            inside = d + reach <= r - SLACK
            ranges = lambda level, n: (level["start"][n], level["end"][n] - level["start"][n])
            for x, y in products(ranges(la, i[inside]), ranges(lb, j[inside])):
                emit(x, y)
            i, j = i[~inside], j[~inside]
            if depth + 1 == len(RADII):
                for x, y in products(ranges(la, i), ranges(lb, j)):
                    exact(x, y)
            elif len(i):
                below = lambda: (
                    (x, y, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.levels[depth + 1]["centre"][x], b.levels[depth + 1]["centre"][y]), 0)))
                    for x, y in products((la["child"][i], la["children"][i]), (lb["child"][j], lb["children"][j]))
                )
                walk(depth + 1, below())

    def top() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the coarsest nodes within reach: found in single precision with slack, then measured in double."""
        ca, cb, ra, rb = a.levels[0]["centre"], b.levels[0]["centre"], a.levels[0]["radius"], b.levels[0]["radius"]
        least = lambda reach: 1 - reach * reach / 2 - COARSE_SLACK
        right, wide = cb.T.astype(np.float32), np.flatnonzero(rb > 0)
        for at in range(0, len(ca), 1024):
            own = ra[at : at + 1024]
            cosine = ca[at : at + 1024].astype(np.float32) @ right
            near = cosine >= np.float32(least(r))
            near[:, wide] = cosine[:, wide] >= least(r + own[:, None] + rb[wide]).astype(np.float32)
            for i in np.flatnonzero(own > 0):
                near[i] = cosine[i] >= least(r + own[i] + rb).astype(np.float32)
            i, j = np.nonzero(near)
            yield i + at, j, np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", ca[i + at], cb[j]), 0))

    walk(0, top())


def valid_classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct valid vector: a number of its own (``node``), least vec_id, number of rows, and the vector as stored."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).where(v.isNotNull() & finite & some)
    grouped = rows.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    return materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so that numbers stay


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double-precision matrix of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy().astype(float), column.offsets.to_numpy()[:-1]
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, values[starts[at][:, None] + np.arange(n)]


def block_size(length: int, classes: int) -> int:
    """Most classes of a block of vectors of this length."""
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * length), -(-classes // BLOCKS)))


def centres_of(points: np.ndarray, classes: float, size: int) -> np.ndarray:
    """Centres of cells that hold about ``size`` of so many classes, of which the points are a sample: row numbers."""
    found, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        far = distances(points[rows], points[rows[:1]])[:, 0]
        if len(rows) * classes <= size * len(points) or len(rows) < 2 or far.max() <= RADII[-1]:
            found.append(rows[0])
            continue
        chosen, goal, nearest = [0], far.max() / 2, np.zeros(len(rows), int)
        while len(chosen) < CENTRES and far.max() > goal:
            new = int(far.argmax())
            d = distances(points[rows], points[rows[new : new + 1]])[:, 0]
            d[new] = 0
            nearest[d < far] = len(chosen)
            far = np.minimum(far, d)
            chosen.append(new)
        open_ += [np.concatenate([rows[c : c + 1], rows[(nearest == k) & (np.arange(len(rows)) != c)]]) for k, c in enumerate(chosen)]
    return np.array(found)


def placed(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes with their block, and the pairs of blocks that may hold links."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.select("v").orderBy(F.xxhash64("node")).limit(SAMPLE).toPandas()["v"]  # bounded
    centres = {}
    for n in sorted({len(v) for v in sample}):
        points = unit(np.array([v for v in sample if len(v) == n]))
        share = total * len(points) / len(sample)
        centres[n] = points[centres_of(points, share, block_size(n, int(share)))]
    offsets = dict(zip(centres, np.cumsum([0, *map(len, centres.values())]).tolist()))
    spread = spark.sparkContext.broadcast((centres, offsets))  # at most SAMPLE vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, offsets = spread.value
        for batch in batches:
            cells, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, 2.0)
            for at, rows in matrices(batch.column("v")):
                n = rows.shape[1]
                if n in centres:
                    d = distances(unit(rows), centres[n])
                    cells[at], far[at] = d.argmin(1) + offsets[n], d.min(1)
                else:
                    cells[at] = -n  # a length that the sample doesn't have: one cell of its own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64()), pa.array(far)], [*batch.schema.names, "cell", "far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    in_cells = materialise(classes.mapInArrow(assign, f"{fields}, cell long, far double"), "cells")
    sizes = in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # one row per centre or length
    length_of = lambda cell: -cell if cell < 0 else max(n for n in centres if offsets[n] <= cell)
    # Small cells share a block; a cell that is too large for one is dealt to several.
    cells, used, room, last = [], 0, 0, None
    for s in sorted(sizes, key=lambda s: s["cell"]):
        n = length_of(s["cell"])
        size = block_size(n, total)
        parts = -(-s["n"] // size)
        if parts > 1 or s["n"] > room or n != last:
            used, room = used + parts, size if parts == 1 else 0
        room, last = room - s["n"], n
        cells.append((s["cell"], used - parts, parts, s["radius"], n))
    near, r = set(), np.sqrt(2 - 2 * threshold)
    for n in {c[4] for c in cells}:
        own = [c for c in cells if c[4] == n]
        if n in centres:
            at, radius = centres[n][[c[0] - offsets[n] for c in own]], np.array([c[3] for c in own])
            reach = np.concatenate([distances(at[i : i + 1024], at) <= r + radius[i : i + 1024, None] + radius + SLACK for i in range(0, len(own), 1024)])
        else:
            reach = np.ones((len(own), len(own)), bool)
        near |= {(*own[i][1:3], *own[j][1:3]) for i, j in zip(*np.nonzero(np.triu(reach)))}
    last = lambda first, parts: F.sequence(F.col(first), F.col(first) + F.col(parts) - 1)
    pairs = (
        spark.createDataFrame([tuple(map(int, x)) for x in sorted(near)], "f int, p int, g int, q int")
        .select(F.explode(last("f", "p")).alias("i"), "g", "q")
        .select("i", F.explode(last("g", "q")).alias("j"))
        .select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .distinct()
    )
    table = spark.createDataFrame([(int(c), int(f), int(p)) for c, f, p, *_ in cells], "cell long, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    return in_cells.join(F.broadcast(table), "cell").select("node", "times", "v", block.alias("block")), pairs  # at most SAMPLE rows, and one per other length


def grown(members: DataFrame) -> DataFrame:
    """Members with their place in their block's tree: built once per block, however many blocks it meets."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    added = [("size", pa.int32()), ("place", pa.int32()), ("levels", pa.list_(pa.int32())), ("centres", pa.list_(pa.bool_()))]

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = []
        for at, rows in matrices(table.column("v").chunk(0)):
            order, nodes, centres = grow(unit(rows))
            sizes = pa.array(np.full(len(at), rows.shape[1]), pa.int32())
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), t.value_type), len(RADII)).cast(t) for x, (_, t) in ((nodes, added[2]), (centres, added[3]))]
            part = table.take(pa.array(at[order]))
            for (name, _), column in zip(added, [sizes, pa.array(np.arange(len(at)), pa.int32()), *lists]):
                part = part.append_column(name, column)
            out.append(part)
        return pa.concat_tables(out)

    return members.groupBy("block").applyInArrow(build, f"{fields}, size int, place int, levels array<int>, centres array<boolean>")


def pair_links(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, n, root) for every class with links in a pair of blocks."""
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table, found = table.combine_chunks(), []
        of_block, size = table.column("block").to_numpy(), table.column("size").to_numpy()
        for n in np.unique(size):
            sides = []
            for block in (i,) if i == j else (i, j):
                rows = np.flatnonzero((of_block == block) & (size == n))
                rows = rows[np.argsort(table.column("place").to_numpy()[rows])]
                sides.append(table.take(pa.array(rows)).combine_chunks())
            if all(len(s) for s in sides):
                square = lambda c, w: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
                trees = [CoverTree(unit(square(s.column("v"), n).astype(float)), square(s.column("levels"), len(RADII)), square(s.column("centres"), len(RADII))) for s in sides]
                ids, times = (np.concatenate([s.column(c).to_numpy() for s in sides]) for c in ("node", "times"))
                links = Links(times)
                traverse(trees[0], trees[-1], 0 if i == j else len(sides[0]), i == j, threshold, links)
                hit = np.flatnonzero(links.count)
                found.append((ids[hit], links.count[hit], ids[links.root(hit)]))
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("node", "n", "root"), columns)})

    return members.join(sides, "block").groupBy("i", "j").applyInArrow(compare, "node long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    classes = valid_classes(vectors)
    members, pairs = placed(classes, threshold)
    links = materialise(pair_links(materialise(grown(members), "trees"), pairs, threshold), "vector-links")
    found = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    of_class = classes.select("node", "least", "times", "v").join(counts, "node", "left").join(found, "node", "left")
    of_class = materialise(of_class.select("least", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "node").alias("component")), "class-links")
    names = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    known = of_class.join(names, "component").select("v", "n", "component_id")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    # A valid vector is in a class; others are components of their own.
    return rows.join(known, "v", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id")), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs by hand: for small tables only.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
k AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM k a JOIN k b ON len(a.e) = len(b.e) AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.9e0),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT t.a, min(v.vec_id) AS least FROM t JOIN v ON v.r = t.b GROUP BY t.a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.r LEFT JOIN m ON m.a = v.r
"""
