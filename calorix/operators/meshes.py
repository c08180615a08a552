"""Triangle meshes: geometry, unions with rebased ids, welding, assignment, terrain, refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calorix.functions import geometry
from calorix.functions.rounding import half_up
from calorix.functions.solar import degrees_of
from calorix.operators import refinement
from calorix.operators.prefix import running
from calorix.operators.refinement import CAP
from calorix.sources.stage import written

#: Corners up to which a mesh is welded in one task, and meshes above that whose keys may be broadcast.
LARGE, BROADCAST_MESHES = 1_000_000, 100_000
#: Triangles up to which a mesh is refined to an indexed one in one task.
LARGE_MESH = 100_000


def with_geometry(triangles: DataFrame) -> DataFrame:
    """Area, unit normal, tilt and azimuth of each triangle; ``degenerate`` marks those without area."""
    a, b, c = (geometry.corner(i) for i in range(3))
    n = geometry.cross(geometry.minus(b, a), geometry.minus(c, a))
    out = triangles.withColumns(dict(zip(("__cx", "__cy", "__cz"), n))).withColumn("__len", F.sqrt(F.col("__cx") ** 2 + F.col("__cy") ** 2 + F.col("__cz") ** 2))
    out = out.withColumns({"degenerate": F.col("__len") < geometry.DEGENERATE, "area": F.col("__len") / 2.0, **{f"n{x}": F.when(F.col("__len") >= geometry.DEGENERATE, F.col(f"__c{x}") / F.col("__len")) for x in "xyz"}})
    return out.withColumns({"tilt": geometry.tilt(F.col("nz")), "azimuth": degrees_of(F.col("nx"), F.col("ny"))}).drop("__cx", "__cy", "__cz", "__len")


def missing_keys(facts: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """Keys of facts without a model, and how many facts use each."""
    return facts.join(models.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def split_frames(triangles: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame conductance from the original area and the glazed area that is left; only walls with both frame values have a frame."""
    known = frames.where(F.col("frame_u").isNotNull() & F.col("frame_fraction").isNotNull())
    joined = triangles.join(known, "wall_id", "left")
    share = F.coalesce("frame_fraction", F.lit(0.0))
    return joined.withColumns({"g_frame": share * F.coalesce("frame_u", F.lit(0.0)) * F.col("area"), "area": F.col("area") * (1.0 - share)})


def spread_evenly(triangles: DataFrame, share: float, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Mark a share of each group, evenly spread over its order: where the rounded running share steps up."""
    p = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return triangles.withColumn("glazed", half_up((p + 1) * share) > half_up(p * share))


def glazed_shares(marked: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Glazed area in percent of the group's area."""
    return marked.groupBy(*by).agg((F.sum(F.when(F.col("glazed"), F.col("area")).otherwise(0.0)) * 100.0 / F.sum("area")).alias("glazed_pct"))


def rebased(meshes: DataFrame, order: str, n_vertices: str) -> DataFrame:
    """First vertex number of each mesh when all are put after one another."""
    return running(meshes, (order,), (n_vertices,)).drop("place").withColumnRenamed(f"{n_vertices}_before", "vertex_offset")


def _place(columns: tuple[str, str, str], digits: int) -> Column:
    """Rounded place of a corner, by which corners are welded."""
    return F.struct(*[F.floor(F.col(c) * 10**digits + 0.5).alias(n) for c, n in zip(columns, "xyz")])


def welded(corners: DataFrame, mesh: str, order: str, digits: int = 5) -> DataFrame:
    """Corners with ``vertex``: equal rounded places share an id, in order of first appearance within the mesh, however large it is.

    Corners are dealt by mesh once; only meshes of more than LARGE corners are spread over tasks.
    """
    at = lambda rows: rows.withColumn("__at", _place(("x", "y", "z"), digits))
    large = written(corners.groupBy(mesh).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select(mesh), "large-meshes")
    n_large = large.count()
    keys = F.broadcast(large) if n_large <= BROADCAST_MESHES else large
    small = corners.join(keys, mesh, "left_anti") if n_large else corners
    first = at(small.repartition(mesh)).withColumn("__first", F.min(order).over(Window.partitionBy(mesh, "__at")))
    whole = first.withColumn("vertex", F.dense_rank().over(Window.partitionBy(mesh).orderBy("__first")) - 1).drop("__at", "__first")
    if not n_large:
        return whole
    placed = at(corners.join(keys, mesh, "left_semi"))
    first = placed.groupBy(mesh, "__at").agg(F.min(order).alias("__first"))
    ids = running(first.select(mesh, "__first").distinct(), ("__first",), by=(mesh,)).select(mesh, "__first", F.col("place").cast("int").alias("vertex"))
    spread = placed.join(first.join(ids, [mesh, "__first"]).drop("__first"), [mesh, "__at"]).drop("__at")
    return whole.unionByName(spread)


def terrain(spark: SparkSession, radius: float, step: float) -> tuple[DataFrame, DataFrame]:
    """Grid points (j outer, i inner) and the two faces of every cell."""
    n = int(2 * radius / step) + 1
    if n < 2 or n * n > 4000:
        raise ValueError("the grid needs 2 to 63 points a side")
    k = F.col("id")
    points = spark.range(n * n).select(k.cast("int").alias("vid"), (F.lit(-radius) + (k % n) * step).alias("x"), (F.lit(-radius) + F.floor(k / n) * step).alias("y"))
    a = (F.floor(k / (n - 1)) * n + k % (n - 1)).cast("int")
    faces = spark.range((n - 1) ** 2).select(a.alias("a")).select(F.inline(F.array(F.struct(F.col("a").alias("v0"), (F.col("a") + 1).alias("v1"), (F.col("a") + n + 1).alias("v2")), F.struct(F.col("a").alias("v0"), (F.col("a") + n + 1).alias("v1"), (F.col("a") + n).alias("v2")))))
    return points, faces


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a ring of a few corners."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if y0 != y1:
            at = F.lit(x0) + (y - y0) * ((x1 - x0) / (y1 - y0))
            crossings = crossings + F.when((y >= min(y0, y1)) & (y < max(y0, y1)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def box_mesh(spark: SparkSession, length: float, width: float, height: float) -> DataFrame:
    """Twelve outward triangles of a box with their groups: sol, toit, mur_1 to mur_4."""
    p = [(x, y, z) for z in (0.0, height) for y in (0.0, width) for x in (0.0, length)]
    quads = {"sol": (0, 2, 3, 1), "toit": (4, 5, 7, 6), "mur_1": (0, 1, 5, 4), "mur_2": (1, 3, 7, 5), "mur_3": (3, 2, 6, 7), "mur_4": (2, 0, 4, 6)}
    rows = []
    for group, (a, b, c, d) in quads.items():
        for v in ((a, b, c), (a, c, d)):
            rows.append((len(rows), group, *[x for i in v for x in p[i]]))
    return spark.createDataFrame(rows, "tri_id int, grp string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")


def gable_box(spark: SparkSession, length: float, width: float, height: float, ridge: float | None = None) -> DataFrame:
    """Outward triangles of a centred box: a flat roof, or with a ridge height two slopes and gables on the south and north walls."""
    x, y = width / 2, length / 2
    low, high = [(-x, -y, 0.0), (x, -y, 0.0), (x, y, 0.0), (-x, y, 0.0)], [(-x, -y, height), (x, -y, height), (x, y, height), (-x, y, height)]
    faces = {"sol": [(low[0], low[3], low[2]), (low[0], low[2], low[1])]}
    for name, a, b in (("mur_est", 1, 2), ("mur_ouest", 3, 0), ("mur_sud", 0, 1), ("mur_nord", 2, 3)):
        faces[name] = [(low[a], low[b], high[b]), (low[a], high[b], high[a])]
    if ridge is None:
        faces["toiture"] = [(high[0], high[1], high[2]), (high[0], high[2], high[3])]
    else:
        south, north = ((0.0, s, height + max(ridge, 0.01)) for s in (-y, y))
        faces["mur_sud"].append((high[0], high[1], south))
        faces["mur_nord"].append((high[2], high[3], north))
        faces["toiture_est"] = [(high[1], high[2], north), (high[1], north, south)]
        faces["toiture_ouest"] = [(high[3], high[0], south), (high[3], south, north)]
    rows = [(g, "ground" if g == "sol" else "exterior_air", *[v for p in t for v in p]) for g, ts in faces.items() for t in ts]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tri_id int, grp string, boundary string, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz"))


def floor_volume(triangles: DataFrame, by: tuple[str, ...], height: Column, floor: str = "sol") -> DataFrame:
    """Floor area of each mesh and its volume, rounded half up to whole cubic metres."""
    area = F.sum(F.when(F.col("grp") == floor, F.col("area")).otherwise(0.0))
    return triangles.groupBy(*by).agg(area.alias("floor_area"), F.max(height).alias("__h")).withColumn("volume", half_up(F.col("floor_area") * F.col("__h"))).drop("__h")


def joined_meshes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two meshes' faces (v0, v1, v2) in one list: the second's vertices follow the first's."""
    n = first.agg(F.coalesce(F.max(F.greatest("v0", "v1", "v2")) + 1, F.lit(0)).alias("__n"))
    moved = second.crossJoin(F.broadcast(n)).withColumns({v: F.col(v) + F.col("__n") for v in ("v0", "v1", "v2")}).drop("__n")  # n is one row
    return first.unionByName(moved, allowMissingColumns=True)


def _corner(t: Column, i: int) -> Column:
    return F.struct(*[t[f"{c}{i}"].alias(c) for c in "xyz"])


def with_pieces(triangles: DataFrame, digits: int = 5) -> DataFrame:
    """Triangles with ``piece``: the least tri_id of those of the mesh that are reached over shared edges.

    Corners are welded by rounding; an edge is its two corners in order, and one
    without length joins nothing.  Components are found by star contractions, each
    round written; only minima are gathered per edge or triangle.
    """
    place = lambda i: F.struct(*[F.floor(F.col(f"{c}{i}") * 10**digits + 0.5).alias(c) for c in "xyz"])
    sides = F.array(*[F.struct(F.least(place(i), place(j)).alias("a"), F.greatest(place(i), place(j)).alias("b")) for i, j in ((0, 1), (1, 2), (2, 0))])
    # Triangles are dealt by mesh once, so that neither their edges nor equal edges are dealt again.
    dealt = triangles.select("mesh_id", "tri_id", *[f"{c}{i}" for i in range(3) for c in "xyz"]).repartition("mesh_id")
    edges = dealt.select("mesh_id", "tri_id", F.explode(sides).alias("edge")).where("edge.a <> edge.b")
    least = edges.withColumn("v", F.min("tri_id").over(Window.partitionBy("mesh_id", "edge")))
    links = written(least.where("tri_id > v").select("mesh_id", F.col("tri_id").alias("u"), "v").distinct())

    def to_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("mesh_id", "u").agg(F.min("v").alias("m")).select("mesh_id", "u", F.least("u", "m").alias("m"))
        return pairs.join(least, ["mesh_id", "u"])

    seen, state = None, links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("mesh_id", "u", "v").cast("decimal(38,0)"))).first()
    while state[0] and state != seen:
        seen, both = state, links.union(links.select("mesh_id", F.col("v").alias("u"), F.col("u").alias("v")))
        met = to_least(to_least(both).where("v > u").select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        links = written(met.where("v <> m").select("mesh_id", F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("mesh_id", "u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("mesh_id", "u", "v").cast("decimal(38,0)"))).first()
    found = links.select("mesh_id", F.col("u").alias("tri_id"), F.col("v").alias("__piece"))
    if not state[0]:  # no edge is shared
        return triangles.withColumn("piece", F.col("tri_id"))
    return triangles.join(found, ["mesh_id", "tri_id"], "left").withColumn("piece", F.coalesce("__piece", "tri_id")).drop("__piece")


def vertices_after(triangles: DataFrame, digits: int = 5) -> DataFrame:
    """mesh_id and its vertices n after each piece's rounds: every round adds one on each edge, and edges double with three more in each triangle."""
    place = lambda i: F.struct(*[F.floor(F.col(f"{c}{i}") * 10**digits + 0.5).alias(c) for c in "xyz"])
    sides = F.array(*[F.struct(F.least(place(i), place(j)).alias("a"), F.greatest(place(i), place(j)).alias("b")) for i, j in ((0, 1), (1, 2), (2, 0))])
    first = triangles.select("mesh_id", F.explode(F.array(*map(place, range(3)))).alias("at")).distinct().groupBy("mesh_id").agg(F.count(F.lit(1)).alias("first"))
    edges = triangles.select("mesh_id", "piece", F.explode(sides).alias("edge")).distinct().groupBy("mesh_id", "piece").agg(F.count(F.lit(1)).alias("e"))
    pieces = triangles.groupBy("mesh_id", "piece").agg(F.max("rounds").alias("rounds"), F.count(F.lit(1)).alias("t")).join(edges, ["mesh_id", "piece"])
    two, four = (F.pow(F.lit(b), "rounds") - 1 for b in (2.0, 4.0))
    return pieces.groupBy("mesh_id").agg(F.sum(two * F.col("e") + 1.5 * F.col("t") * (four / 3 - two)).alias("more")).join(first, "mesh_id").select("mesh_id", (F.col("first") + F.col("more")).alias("n"))


def with_rounds(triangles: DataFrame, longest: float, max_rounds: int = 20) -> tuple[DataFrame, int]:
    """Triangles with ``rounds``, the times their piece is halved until no edge is longer than given, and the most of all.

    As in the reference, edges that are too long after ``max_rounds``, or a mesh of
    more than CAP vertices or triangles, are errors.
    """
    a, b, c = (geometry.corner(i) for i in range(3))
    edge = F.greatest(*[geometry.norm(geometry.minus(p, q)) for p, q in ((a, b), (b, c), (c, a))])
    rounds = F.greatest(F.lit(0), F.ceil(F.log2(F.max("__edge").over(Window.partitionBy("mesh_id", "piece")) / longest))).cast("int")
    long = lambda rows: rows.repartition("mesh_id").withColumn("rounds", rounds).drop("__edge")
    out = long(triangles.withColumn("__edge", edge))
    # A round needs four times all triangles to be under the cap, cut or not.
    light = long(triangles.select("mesh_id", "piece", edge.alias("__edge"))).withColumn("last", F.max("rounds").over(Window.partitionBy("mesh_id")))
    ahead = F.when(F.col("last") > 0, 4 * F.pow(F.lit(4.0), F.least("rounds", F.col("last") - 1))).otherwise(0.0)
    alone = F.when(F.col("last") > 0, (F.pow(F.lit(2.0), "rounds") + 1) * (F.pow(F.lit(2.0), "rounds") + 2) / 2).otherwise(0.0)
    sums = light.groupBy("mesh_id").agg(F.max("rounds").alias("rounds"), F.sum(ahead).alias("n"), F.sum(alone).alias("v"))
    most, largest, corners = (x or 0 for x in sums.agg(F.max("rounds"), F.max("n"), F.max("v")).first())
    if most >= max_rounds:
        raise ValueError(f"edges are too long after {max_rounds} rounds")
    if largest > CAP:
        raise ValueError(f"refinement makes {largest:.0f} triangles of a mesh, more than {CAP}")
    if corners > CAP:  # if no vertex were shared
        largest = vertices_after(out.join(sums.where(F.col("v") > CAP).select("mesh_id"), "mesh_id", "left_semi")).agg(F.max("n")).first()[0]
        if largest > CAP:
            raise ValueError(f"refinement makes {largest:.0f} vertices of a mesh, more than {CAP}")
    return out, most


def indexed(triangles: DataFrame, digits: int = 5) -> tuple[DataFrame, DataFrame]:
    """Vertices (mesh_id, vertex, x, y, z) and faces of triangles with corners: face (a number within the mesh), v0, v1, v2 and the other columns.

    Corners are welded by rounding; a vertex has the coordinates of one of its
    corners.  Faces with two corners in one place are left out.
    """
    spare = [c for c in triangles.columns if c[1:] not in ("0", "1", "2") or c[0] not in "xyz"]
    faces = running(triangles, ("tri_id",), by=("mesh_id",)).withColumnRenamed("place", "face")
    corner = lambda i: F.struct(F.lit(i).alias("slot"), (F.col("face") * 3 + i).alias("seq"), *[F.col(f"{c}{i}").alias(c) for c in "xyz"])
    corners = written(welded(faces.select("mesh_id", "face", F.inline(F.array(*map(corner, range(3))))), "mesh_id", "seq", digits), "corners")
    vertices = corners.groupBy("mesh_id", "vertex").agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("at")).select("mesh_id", "vertex", "at.*")
    named = corners.groupBy("mesh_id", "face").agg(*[F.max(F.when(F.col("slot") == i, F.col("vertex"))).alias(f"v{i}") for i in range(3)])
    whole = faces.select("face", *spare).join(named, ["mesh_id", "face"]).where("v0 <> v1 and v1 <> v2 and v2 <> v0")
    return vertices, whole


def _large_meshes(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Meshes of more rows than given, and their number; to be broadcast unless they are many."""
    large = written(rows.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mesh_id"), "large-meshes")
    n = large.count()
    return F.broadcast(large) if n <= BROADCAST_MESHES else large, n


def _by_mesh(triangles: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What a function makes of whole meshes in the order of their triangles, which are dealt once."""
    dealt = triangles.repartition("mesh_id").sortWithinPartitions("mesh_id", "tri_id")
    return dealt.mapInArrow(lambda batches: run(refinement.whole_meshes(batches)), schema)


def refined_figures(triangles: DataFrame, longest: float, max_rounds: int = 20) -> DataFrame:
    """mesh_id, n_vertices, n_faces, n_edges, n_borders (edges of one face) and area of every mesh after refinement to an indexed mesh, as ``refined_index`` makes it.

    Pieces are found on the way unless ``piece`` is there.  Nothing but the figures leaves the task that a mesh is dealt to.
    """
    names = ["n_vertices", "n_faces", "n_edges", "n_borders"]
    kept = triangles.select("mesh_id", "tri_id", *[c for c in triangles.columns if c == "piece"], *refinement.CORNERS)
    keys, n_large = _large_meshes(kept, LARGE_MESH)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for at, mesh, found in refinement.refined(rows, longest, max_rounds):
                of = refinement.figures(mesh, found)
                some = np.flatnonzero(of["n_faces"])
                ids = rows.column("mesh_id").take(pa.array(at + np.searchsorted(mesh, some)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(of[n][some]) for n in (*names, "area")]], ["mesh_id", *names, "area"])

    schema = f"mesh_id {kept.schema['mesh_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, area double"
    out = _by_mesh(kept.join(keys, "mesh_id", "left_anti") if n_large else kept, run, schema)
    if not n_large:
        return out
    large = kept.join(keys, "mesh_id", "left_semi")
    vertices, faces = _spread_index(large if "piece" in kept.columns else with_pieces(large), longest, max_rounds)
    return out.unionByName(index_figures(vertices, faces))


def index_figures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The figures of ``refined_figures`` of indexed meshes of any size."""
    at = lambda i: vertices.select("mesh_id", F.col("vertex").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"])
    placed = faces.select("mesh_id", "v0", "v1", "v2")
    for i in range(3):
        placed = placed.join(at(i), ["mesh_id", f"v{i}"])
    areas = with_geometry(placed).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"), F.sum("area").alias("area"))
    # An edge inside a face lies in two of its parts and belongs to it alone, also where another face has the same corners; one on a side lies in one part.
    sides = faces.select("mesh_id", "face", F.explode(F.array(*[F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v0", "v2"))])).alias("edge"))
    parts = sides.groupBy("mesh_id", "face", "edge").agg(F.count(F.lit(1)).alias("n"))
    edges = parts.groupBy("mesh_id", "edge", F.when(F.col("n") > 1, F.col("face")).alias("within")).agg(F.sum("n").alias("n")).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("n") == 1).alias("n_borders"))
    return vertices.groupBy("mesh_id").agg(F.count_distinct("vertex").alias("n_vertices")).join(areas, "mesh_id").join(edges, "mesh_id")


def refined_index(triangles: DataFrame, longest: float, max_rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Refinement to an indexed mesh: vertices (mesh_id, vertex, x, y, z) and faces (mesh_id, face: the one they are part of, v0, v1, v2, the other columns).

    Needs (mesh_id, tri_id, corners); pieces are found on the way unless ``piece`` is there.  Meshes
    are cut in the task that they are dealt to (see ``refinement``), where a mesh
    that breaks a limit is an error; only those of more than LARGE_MESH triangles are spread.
    """
    spare = [f for f in triangles.schema if f.name not in (*refinement.CORNERS, "mesh_id")]
    keys, n_large = _large_meshes(triangles, LARGE_MESH)
    small = triangles.join(keys, "mesh_id", "left_anti") if n_large else triangles
    kind = triangles.schema["mesh_id"].dataType.simpleString()

    def corners(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for at, mesh, found in refinement.refined(rows, longest, max_rounds):
                ids = rows.column("mesh_id").take(pa.array(at + np.searchsorted(mesh, found.mesh)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.number), *map(pa.array, found.xyz.T.copy())], ["mesh_id", "vertex", *"xyz"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for at, mesh, found in refinement.refined(rows, longest, max_rounds):
                source = rows.take(pa.array(at + found.row))
                ids = found.number[found.corners]
                face = found.row - np.searchsorted(mesh, mesh[found.row])
                yield pa.RecordBatch.from_arrays([source.column("mesh_id"), pa.array(face), *(source.column(f.name) for f in spare), *map(pa.array, ids.T.copy())], ["mesh_id", "face", *(f.name for f in spare), "v0", "v1", "v2"])

    vertices = _by_mesh(small, corners, f"mesh_id {kind}, vertex long, x double, y double, z double")
    faces = _by_mesh(small, cut, ", ".join([f"mesh_id {kind}", "face long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in spare), "v0 long", "v1 long", "v2 long"]))
    if not n_large:
        return vertices, faces
    large = triangles.join(keys, "mesh_id", "left_semi")
    more, cuts = _spread_index(large if "piece" in triangles.columns else with_pieces(large), longest, max_rounds)
    return vertices.unionByName(more), faces.unionByName(cuts.select(*faces.columns))


def _spread_index(triangles: DataFrame, longest: float, max_rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """``refined_index`` of meshes of any size: vertices (mesh_id, vertex, x, y, z) and faces (mesh_id, face: the one they are part of, v0, v1, v2, the other columns).

    Needs (mesh_id, piece, tri_id, corners).  Halving all edges of a triangle r times
    makes a grid of 2^r steps on each side, so nothing is done round by round: each
    edge has 2^r - 1 vertices of its own and each face those strictly inside.  An
    edge's vertices are numbered once, by running totals over the mesh's edges, and
    both faces that share it name them, so there is no crack.  New vertices follow
    the mesh's own: first those of edges in the order of their ends, then those of faces.
    """
    out, most = with_rounds(triangles, longest, max_rounds)
    vertices, faces = (written(df, n) for df, n in zip(indexed(out), ("vertices", "faces")))
    steps = F.expr("shiftleft(1L, rounds)")
    side = lambda i, j, slot: F.struct(F.lit(slot).alias("slot"), F.least(f"v{i}", f"v{j}").alias("lo"), F.greatest(f"v{i}", f"v{j}").alias("hi"))
    sides = faces.select("mesh_id", "face", "rounds", F.inline(F.array(side(0, 1, 0), side(1, 2, 1), side(0, 2, 2))))
    edges = sides.groupBy("mesh_id", "lo", "hi").agg(F.max("rounds").alias("rounds")).where("rounds > 0").withColumn("n", steps - 1)
    edges = running(edges, ("lo", "hi"), ("n",), by=("mesh_id",))
    grown = running(faces.withColumn("n", ((steps - 1) * (steps - 2) / 2).cast("long")), ("face",), ("n",), by=("mesh_id",))
    first = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("own"))
    base = first.join(edges.groupBy("mesh_id").agg(F.sum("n").alias("on_edges")), "mesh_id", "left").select("mesh_id", "own", (F.col("own") + F.coalesce("on_edges", F.lit(0))).alias("after_edges"))
    edges = written(edges.join(base, "mesh_id").select("mesh_id", "lo", "hi", "rounds", (F.col("own") + F.col("n_before")).alias("start")), "edges")
    starts = sides.join(edges.drop("rounds"), ["mesh_id", "lo", "hi"]).groupBy("mesh_id", "face").agg(*[F.max(F.when(F.col("slot") == i, F.col("start"))).alias(f"e{i}") for i in range(3)])
    grown = written(grown.join(base, "mesh_id").withColumn("inner", F.col("after_edges") + F.col("n_before")).drop("place", "n", "n_before", "own", "after_edges").join(starts, ["mesh_id", "face"], "left"), "grown")

    at = lambda v, name: vertices.select("mesh_id", F.col("vertex").alias(v), F.struct("x", "y", "z").alias(name))
    between = lambda *parts: [sum((F.col(p)[c] * w for p, w in parts[1:]), F.col(parts[0][0])[c] * parts[0][1]).alias(c) for c in "xyz"]
    ends = edges.join(at("lo", "p"), ["mesh_id", "lo"]).join(at("hi", "q"), ["mesh_id", "hi"]).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), steps - 1)))
    share = F.col("k") / steps
    on_edges = ends.select("mesh_id", (F.col("start") + F.col("k") - 1).alias("vertex"), *between(("p", 1.0 - share), ("q", share)))
    i, j = F.col("i"), F.col("j")
    place = (j - 1) * (steps - 1) - F.floor((j - 1) * j / 2) + i - 1  # of an inner point, by rows
    inner = grown.where("rounds > 1").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), steps - 2))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), steps - 1 - j)))
    corners = inner.join(at("v0", "p"), ["mesh_id", "v0"]).join(at("v1", "q"), ["mesh_id", "v1"]).join(at("v2", "s"), ["mesh_id", "v2"])
    inside = corners.select("mesh_id", (F.col("inner") + place).alias("vertex"), *between(("p", 1.0 - (i + j) / steps), ("q", i / steps), ("s", j / steps)))

    def named(i: Column, j: Column) -> Column:
        """Vertex of the grid point i steps towards v1 and j towards v2."""
        along = lambda e, a, b, k: F.col(f"e{e}") + F.when(F.col(f"v{a}") < F.col(f"v{b}"), k - 1).otherwise(steps - k - 1)
        on_side = F.when(j == 0, along(0, 0, 1, i)).when(i == 0, along(2, 0, 2, j)).when(i + j == steps, along(1, 1, 2, j))
        row = (j - 1) * (steps - 1) - F.floor((j - 1) * j / 2) + i - 1
        return F.when((i == 0) & (j == 0), F.col("v0")).when(i == steps, F.col("v1")).when(j == steps, F.col("v2")).otherwise(F.coalesce(on_side, F.col("inner") + row)).cast("long")

    cells = grown.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1 - j)))
    face = lambda a, b, c: F.struct(*[named(*p).alias(f"v{n}") for n, p in enumerate((a, b, c))])
    up, down = face((i, j), (i + 1, j), (i, j + 1)), face((i + 1, j), (i + 1, j + 1), (i, j + 1))
    cut = cells.withColumn("f", F.explode(F.when(i + j + 1 < steps, F.array(up, down)).otherwise(F.array(up))))
    spare = [c for c in faces.columns if c not in ("v0", "v1", "v2")]
    return vertices.withColumn("vertex", F.col("vertex").cast("long")).unionByName(on_edges).unionByName(inside), cut.select(*spare, "f.*")


def refined(triangles: DataFrame, longest: float, max_rounds: int = 20) -> DataFrame:
    """Triangles cut in four until no edge of the mesh is longer than given, each with corners of its own.

    A long edge marks its triangle, and marks spread over shared edges to the
    whole connected piece; a piece is cut as a whole, so its number of rounds
    follows from its longest edge alone: every round halves all its edges.
    Needs (mesh_id, piece, tri_id, corners); pieces are connected components, as
    ``with_pieces`` finds them.
    """
    out, most = with_rounds(triangles, longest, max_rounds)
    out = out.withColumn("path", F.lit(""))
    kept = [c for c in triangles.columns if c[1:] not in ("0", "1", "2")]
    for r in range(most):
        here = F.struct(*[f"{x}{i}" for i in range(3) for x in "xyz"])
        v = [_corner(here, i) for i in range(3)]
        mid = lambda p, q: F.struct(*[((p[x] + q[x]) / 2.0).alias(x) for x in "xyz"])
        m01, m12, m20 = mid(v[0], v[1]), mid(v[1], v[2]), mid(v[2], v[0])
        face = lambda n, p, q, s: F.struct(F.lit(n).alias("n"), p.alias("p"), q.alias("q"), s.alias("s"))
        children = F.array(face("a", v[0], m01, m20), face("b", v[1], m12, m01), face("c", v[2], m20, m12), face("d", m01, m12, m20))
        alone = F.array(face("", *v))
        cut = out.select(*kept, "rounds", "path", F.explode(F.when(F.col("rounds") > r, children).otherwise(alone)).alias("f"))
        out = cut.select(*kept, "rounds", F.concat("path", "f.n").alias("path"), *[F.col(f"f.{p}.{x}").alias(f"{x}{i}") for i, p in enumerate("pqs") for x in "xyz"])
    return out


def clipped_boxes(boxes: DataFrame, study: tuple[float, float, float, float]) -> DataFrame:
    """Status of axis-aligned boxes (x0, y0, x1, y1) against a study box, and the area that stays outside it.

    degenerate: no area; kept: no overlap; self: overlap over union above 0.3,
    or nothing of at least 1 m2 left outside; else clipped.
    """
    sx0, sy0, sx1, sy1 = map(F.lit, map(float, study))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    overlap = F.greatest(F.lit(0.0), F.least("x1", sx1) - F.greatest("x0", sx0)) * F.greatest(F.lit(0.0), F.least("y1", sy1) - F.greatest("y0", sy0))
    out = boxes.withColumns({"area": area, "overlap": overlap}).withColumn("left", F.col("area") - F.col("overlap"))
    union = F.col("area") + (sx1 - sx0) * (sy1 - sy0) - F.col("overlap")
    status = F.when(F.col("area") < 1e-9, "degenerate").when(F.col("overlap") <= 1e-9, "kept").when((F.col("overlap") / union > 0.3) | (F.col("left") < 1.0), "self").otherwise("clipped")
    return out.withColumn("status", status)
