"""Unions, intersections and differences of rings with holes, and what of an obstacle stays outside a study polygon.

A shape is a list of rings, inside by the even-odd rule, so holes need no mark and
rings may turn either way or cross themselves.  Operations sweep over horizontal
slabs between all corners and crossings: in a slab edges don't cross, and a result
is a run of trapezoids.  Every row's shapes are its own; Spark deals out the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorix.operators.footprints import SELF_OVERLAP, SLIVER

Ring = list[tuple[float, float]]
Shape = list[Ring]
Trapezoid = tuple[float, float, float, float, float, float]  # y below and above, left x below and above, right x below and above
SAME = 1e-9
#: Sides up to this length may end in one corner of a sweep's result.
SHORT = 1e-5
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
SHAPE = pa.list_(POINTS)
SHAPE_DDL = "array<array<struct<x:double,y:double>>>"
#: Triangles that are joined at once when many are dissolved.
AT_ONCE = 16


def signed_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def edges_of(shapes: list[Shape]) -> np.ndarray:
    """Rows (x0, y0, x1, y1, shape) of all edges, upwards; level ones have no part in a sweep."""
    rows = [(*min(a, b, key=lambda p: p[1]), *max(a, b, key=lambda p: p[1]), i) for i, s in enumerate(shapes) for ring in s for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1]]
    return np.array(rows, float).reshape(-1, 5)


def levels_of(edges: np.ndarray) -> np.ndarray:
    """Heights of all corners and crossings."""
    found = [edges[:, 1], edges[:, 3]]
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    for i in range(len(edges) - 1):
        rest, ds = edges[i + 1 :], slope[i + 1 :] - slope[i]
        apart = np.abs(ds) > 1e-12
        at_zero = (edges[i, 0] - slope[i] * edges[i, 1]) - (rest[:, 0] - slope[i + 1 :] * rest[:, 1])
        y = at_zero[apart] / ds[apart]
        found.append(y[(y > np.maximum(rest[apart, 1], edges[i, 1])) & (y < np.minimum(rest[apart, 3], edges[i, 3]))])
    ys = np.sort(np.concatenate(found))
    return ys[np.append(True, np.diff(ys) > SAME)] if len(ys) else ys


def sweep(shapes: list[Shape], keep: Callable[[list[bool]], bool]) -> list[Trapezoid]:
    """Trapezoids of the places for which ``keep`` holds, given in which shapes they are."""
    edges, out = edges_of(shapes), []
    ys = levels_of(edges)
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    for low, high in zip(ys, ys[1:]):
        here = np.flatnonzero((edges[:, 1] <= low + SAME) & (edges[:, 3] >= high - SAME))
        x = lambda y: edges[here, 0] + slope[here] * (y - edges[here, 1])  # noqa: B023, E731
        below, middle, above = x(low), x((low + high) / 2), x(high)
        inside, start = [False] * len(shapes), None
        order = np.argsort(middle, kind="stable")
        for n, k in enumerate(order):
            owner = int(edges[here[k], 4])
            inside[owner] = not inside[owner]
            if n + 1 < len(order) and middle[order[n + 1]] - middle[k] <= SAME:
                continue  # edges in one place count together
            if start is None and keep(inside):
                start = k
            elif start is not None and not keep(inside):
                out.append((float(low), float(high), float(below[start]), float(above[start]), float(below[k]), float(above[k])))
                start = None
    return out


def area_of(trapezoids: list[Trapezoid]) -> float:
    return sum((r0 - l0 + r1 - l1) / 2 * (high - low) for low, high, l0, l1, r0, r1 in trapezoids)


def rings_of(trapezoids: list[Trapezoid]) -> Shape:
    """The boundary of a run of trapezoids: outer rings turn left, holes right."""
    steps: list[tuple[tuple[float, float], tuple[float, float]]] = []
    levels: dict[float, tuple[list, list]] = {}
    for low, high, l0, l1, r0, r1 in trapezoids:
        steps += [((r0, low), (r1, high)), ((l1, high), (l0, low))]
        levels.setdefault(low, ([], []))[1].append((l0, r0))
        levels.setdefault(high, ([], []))[0].append((l1, r1))
    for y, (under, over) in levels.items():
        xs = sorted({x for run in under + over for x in run})
        for a, b in zip(xs, xs[1:]):
            if b - a <= SAME:
                continue
            m = (a + b) / 2
            up, down = (any(p <= m <= q for p, q in runs) for runs in (over, under))
            if up and not down:
                steps.append(((a, y), (b, y)))
            elif down and not up:
                steps.append(((b, y), (a, y)))
    key = lambda p: (round(p[0], 6), round(p[1], 6))
    leaving: dict[tuple[float, float], list] = {}
    for a, b in steps:
        if key(a) != key(b):
            leaving.setdefault(key(a), []).append((a, b))
    out = []
    while leaving:
        at = next(iter(leaving))
        ring, (a, b) = [], leaving[at].pop()
        while True:
            if not leaving[key(a)]:
                del leaving[key(a)]
            ring.append(a)
            options = leaving.get(key(b))
            if not options:
                break
            # Where rings touch, the sharpest left turn stays with this one.
            turn = lambda s: np.arctan2((b[0] - a[0]) * (s[1][1] - s[0][1]) - (b[1] - a[1]) * (s[1][0] - s[0][0]), (b[0] - a[0]) * (s[1][0] - s[0][0]) + (b[1] - a[1]) * (s[1][1] - s[0][1]))  # noqa: B023, E731
            step = max(options, key=turn)
            options.remove(step)
            a, b = step
            if key(a) == key(ring[0]):
                options.append(step)
                break
        ring = without_flat_corners(ring)
        if len(ring) >= 3:
            out.append(ring)
    return out


def without_flat_corners(ring: Ring) -> Ring:
    """The ring without corners on a straight line."""
    out = []
    for i, p in enumerate(ring):
        a, b = ring[i - 1], ring[(i + 1) % len(ring)]
        if abs((p[0] - a[0]) * (b[1] - p[1]) - (p[1] - a[1]) * (b[0] - p[0])) > SAME:
            out.append(p)
    return out


def inside(p: tuple[float, float], ring: Ring) -> bool:
    crossed = [a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1]) if (a[1] <= p[1]) != (b[1] <= p[1])]
    return sum(x > p[0] for x in crossed) % 2 == 1


def parts_of(rings: Shape) -> list[Shape]:
    """Rings grouped into parts: an outer ring and its holes."""
    outer = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    parts = [[r] for r in outer]
    for hole in (r for r in rings if signed_area(r) <= 0):
        a, b = hole[0], hole[1]
        middle = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        for part in parts:  # the smallest that holds it
            if inside(middle, part[0]):
                part.append(hole)
                break
    return parts


def combined(shapes: list[Shape], keep: Callable[[list[bool]], bool]) -> list[Shape]:
    return parts_of(rings_of(sweep(shapes, keep)))


def part_area(part: Shape) -> float:
    return sum(map(signed_area, part))


def repaired(shape: Shape) -> Shape:
    """The largest part of a shape, without crossings; empty if there is none."""
    return max(combined([shape], all), key=part_area, default=[])


def dissolved(shapes: list[Shape]) -> Shape:
    """The union of many shapes, some at a time, so that inner edges go early."""
    while len(shapes) > 1:
        shapes = [[r for part in combined(shapes[i : i + AT_ONCE], any) for r in part] for i in range(0, len(shapes), AT_ONCE)]
    return shapes[0] if shapes else []


def boxes_meet(a: Ring, b: Ring) -> bool:
    """Whether the boxes around two sets of points have a place in common."""
    return all(min(p[k] for p in a) <= max(p[k] for p in b) and min(p[k] for p in b) <= max(p[k] for p in a) for k in (0, 1))


def against(ring: Ring, study: Shape | None, study_area: float | None = None) -> dict:
    """Status of an obstacle against the study polygon, the overlap and the parts that stay.

    degenerate: no area; kept: no study polygon or no overlap (walls may touch);
    self: overlap over union above 0.3, or no part of 1 m2 is left; else clipped.
    ``study_area`` is the study polygon's, where it is known.
    """
    whole = area_of(sweep([[ring]], all)) if len(ring) >= 3 else 0.0
    if whole < SAME:
        return {"status": "degenerate", "area": whole, "overlap": 0.0, "parts": []}
    overlap = area_of(sweep([[ring], study], all)) if study and boxes_meet(ring, [p for r in study for p in r]) else 0.0
    if overlap <= SAME:
        return {"status": "kept", "area": whole, "overlap": 0.0, "parts": combined([[ring]], all)}
    union = whole + (area_of(sweep([study], all)) if study_area is None else study_area) - overlap
    left = [p for p in combined([[ring], study], lambda i: i[0] and not i[1]) if part_area(p) >= SLIVER]
    own = overlap / union > SELF_OVERLAP or not left
    return {"status": "self" if own else "clipped", "area": whole, "overlap": overlap, "parts": [] if own else left}


def points(ring: list[dict] | None) -> Ring:
    """Corners of a ring column, without a repeated closing one."""
    found = [(p["x"], p["y"]) for p in ring or []]
    return found[:-1] if len(found) > 1 and found[0] == found[-1] else found


def as_column(shape: Shape) -> list[list[dict]]:
    return [[{"x": x, "y": y} for x, y in ring] for ring in shape]


def convex_apart(rings: pa.Array, box: tuple[float, float, float, float] | None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(rows, areas, parts) of the convex rings that lie outside a box (west, south, east, north), many at a time: what a sweep gives for each.

    Rings with a flat or doubled corner, or with corners on almost one level, are left to the sweep.
    """
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in rings.flatten().flatten())
    first = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(sizes > 1)
    last = first[filled] + sizes[filled] - 1
    sizes[filled] -= (x[first[filled]] == x[last]) & (y[first[filled]] == y[last])
    for n in np.unique(sizes[sizes > 2]):
        rows = np.flatnonzero(sizes == n)
        at = first[rows, None] + np.arange(n)
        px, py = x[at], y[at]
        dx, dy = np.roll(px, -1, 1) - px, np.roll(py, -1, 1) - py
        turn = np.roll(dx, 1, 1) * dy - np.roll(dy, 1, 1) * dx
        left = (turn > SAME).all(1)
        up = (dy > 0) | ((dy == 0) & (dx > 0))
        once = (up != np.roll(up, 1, 1)).sum(1) == 2  # a ring that turns one way may still go round twice
        steps = np.diff(np.sort(py, 1), axis=1)
        good = (left | (turn < -SAME).all(1)) & once & ((steps == 0) | (steps > SAME)).all(1) & (np.hypot(dx, dy) > SHORT).all(1)
        if box is not None:
            west, south, east, north = box
            good &= (px.max(1) < west) | (px.min(1) > east) | (py.max(1) < south) | (py.min(1) > north)
        ox, oy = px - px[:, :1], py - py[:, :1]
        area = np.abs((ox * np.roll(oy, -1, 1) - np.roll(ox, -1, 1) * oy).sum(1)) / 2
        good &= area >= SAME
        px, py = (np.where(left[:, None], c, c[:, ::-1])[good] for c in (px, py))
        start = np.where(py == py.min(1)[:, None], px, -np.inf).argmax(1)[:, None]  # the lowest corner, the right one of two
        turned = (start + np.arange(n)) % n
        corners = pa.StructArray.from_arrays([pa.array(np.take_along_axis(c, turned, 1).ravel()) for c in (px, py)], ["x", "y"])
        one = pa.array(np.arange(good.sum() + 1), pa.int32())
        ring = pa.ListArray.from_arrays(pa.array(np.arange(good.sum() + 1) * n, pa.int32()), corners)
        yield rows[good], area[good], pa.ListArray.from_arrays(one, pa.ListArray.from_arrays(one, ring))


def resolved(candidates: DataFrame, study: Shape | None = None) -> DataFrame:
    """Candidates (with ``ring``) with status, area, overlap and parts; of any form, turning either way.

    The study polygon is the given one, or each row's own in a column ``study``
    (null or empty: everything is kept).  Convex rings off its box are resolved a batch
    at a time, all others by a sweep each.
    """
    own = "study" in candidates.columns
    study = None if own else study
    xs, ys = zip(*(p for r in study for p in r)) if study else ((), ())
    box = (min(xs), min(ys), max(xs), max(ys)) if study else None
    spare = [c for c in candidates.columns if c not in ("status", "area", "overlap", "parts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = area_of(sweep([study], all)) if study else None
        names = [*spare, "status", "area", "overlap", "parts"]
        for batch in batches:
            swept = np.ones(batch.num_rows, bool)
            free = pc.fill_null(pc.list_value_length(batch.column("study")), 0).to_numpy(zero_copy_only=False) == 0 if own else swept
            for at, areas, parts in convex_apart(batch.column("ring"), box):
                alone = free[at]
                at, areas, parts = at[alone], areas[alone], parts.filter(pa.array(alone))
                swept[at] = False
                columns = [pa.array(["kept"] * len(at), pa.string()), pa.array(areas), pa.array(np.zeros(len(at))), parts.cast(pa.list_(SHAPE))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in spare), *columns], names)
            batch = batch.filter(pa.array(swept))
            rings = batch.column("ring").to_pylist()
            studies = [[points(r) for r in s or []] for s in batch.column("study").to_pylist()] if own else [study] * len(rings)
            found = [against(points(r), s, whole) for r, s in zip(rings, studies)]
            columns = [pa.array([f["status"] for f in found], pa.string()), *(pa.array([f[c] for f in found], pa.float64()) for c in ("area", "overlap")), pa.array([[as_column(p) for p in f["parts"]] for f in found], pa.list_(SHAPE))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in spare), *columns], names)

    rows = candidates.select(*spare)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}status string, area double, overlap double, parts array<{SHAPE_DDL}>")


def study_polygons(triangles: DataFrame, by: str = "building_id") -> DataFrame:
    """(by, study): the union of each building's triangles on the ground plane; upright ones have no area there, and a building of these only gets an empty shape.

    A group is one building's mesh, at most 20 000 triangles.
    """

    def run(table: pa.Table) -> pa.Table:
        corners = np.stack([table.column(f"{c}{i}").to_numpy() for i in range(3) for c in "xy"], axis=1).reshape(-1, 3, 2)
        shapes = [[list(map(tuple, t.tolist()))] for t in corners]
        flat = dissolved([s for s in shapes if abs(signed_area(s[0])) > SAME])
        return pa.table({by: table.column(by)[:1], "study": pa.array([as_column(flat)], SHAPE)})

    kind = triangles.schema[by].dataType.simpleString()
    return triangles.groupBy(by).applyInArrow(run, f"{by} {kind}, study {SHAPE_DDL}")


def cap(part: Shape) -> list[Ring]:
    """Triangles that fill a part, turning left."""
    out = []
    for low, high, l0, l1, r0, r1 in sweep([part], all):
        for t in ([(l0, low), (r0, low), (r1, high)], [(l0, low), (r1, high), (l1, high)]):
            if signed_area(t) > SAME:
                out.append(t)
    return out


PRISM = pa.list_(pa.struct([("part", pa.int32()), ("grp", pa.string()), *[(f"{c}{i}", pa.float64()) for i in range(3) for c in "xyz"]]))
PRISM_DDL = "array<struct<part:int,grp:string," + ",".join(f"{c}{i}:double" for i in range(3) for c in "xyz") + ">>"


def prism(parts: list[Shape], height: float, base: float) -> list[dict]:
    """Triangles of the prisms over some parts: sol and toit caps, two for each side mur_1, mur_2, ...; heights are at least 1 m."""
    top, out = base + max(height, 1.0), []

    def face(part: int, grp: str, *corners: tuple[float, float, float]) -> None:
        out.append({"part": part, "grp": grp} | {f"{c}{i}": v for i, p in enumerate(corners) for c, v in zip("xyz", p)})

    for n, part in enumerate(parts):
        for a, b, c in cap(part):
            face(n, "sol", (*a, base), (*c, base), (*b, base))
            face(n, "toit", (*a, top), (*b, top), (*c, top))
        for k, (p, q) in enumerate(((p, q) for ring in part for p, q in zip(ring, ring[1:] + ring[:1])), 1):
            face(n, f"mur_{k}", (*p, base), (*q, base), (*q, top))
            face(n, f"mur_{k}", (*p, base), (*q, top), (*p, top))
    return out


def extruded_parts(rows: DataFrame) -> DataFrame:
    """Rows (with parts, height and base) with ``faces``: the triangles of their prisms, holes included."""
    spare = [c for c in rows.columns if c != "faces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [[[points(r) for r in part] for part in parts or []] for parts in batch.column("parts").to_pylist()]
            made = [prism(*x) for x in zip(shapes, batch.column("height").to_pylist(), batch.column("base").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in spare), pa.array(made, PRISM)], [*spare, "faces"])

    narrow = rows.select(*spare)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema)
    return narrow.mapInArrow(run, f"{schema}faces {PRISM_DDL}")


def corner_count(parts):
    """Vertices of the prisms over a parts column: two for each corner."""
    sizes = F.transform(F.flatten(parts), lambda ring: F.size(ring))
    return 2 * F.aggregate(sizes, F.lit(0), lambda s, n: s + n)
