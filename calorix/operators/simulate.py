"""Transient heat flow: implicit steps for walls and whole buildings.

Small recurrences are folds over a series' ordered hours in the JVM, or, for many rows
over one series, steps of a whole batch of rows at a time.
Walls and buildings run as maps over rows that hold one building each; the hours
of the series, a year at most, are broadcast.  Inside a task all walls of some
buildings advance together: walls meet only at their air node, so every wall is
eliminated to ``T = u + w * T_air`` by one tridiagonal sweep over all of them, and
the air is one scalar equation per building and hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calorix.functions.physics import STEP_S

MAX_HOURS = 8784
#: Caps of one run: unknowns of a building, nodes of a wall.
MAX_UNKNOWNS, MAX_NODES = 60_000, 300
#: Buildings and walls that advance together in a task.
BUILDINGS_AT_ONCE, WALLS_AT_ONCE, RUNS_AT_ONCE, LAST_AT_ONCE = 64, 4096, 256, 2048
# Added resistance and shares of direct and diffuse sun behind closed shading.
SHADING = {"volet-roulant": (0.20, 0.0, 0.0), "store-exterieur": (0.08, 0.15, 0.40)}
GRID_AZ, GRID_EL, GRID_STEP = 24, 7, 15.0
DEFAULTS = {
    "mode": "thermostat", "c_air": 1200.0 * 250.0, "t_init": 20.0, "t_int": 20.0, "t_min": 19.0, "t_max": 26.0,
    "t_ground": 12.0, "r_ground": 0.5, "lat": 0.0, "lon": 0.0, "north_offset_deg": 0.0,
}
HOUR_FIELDS = ("t_ext", "h_e", "g_vent", "gains", "e_dir", "e_dif", "declination", "solar_minutes", "closed", "t_min", "t_max")


def ordered_hours(hours: DataFrame, order: str, fields: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """One row per series with its hours as an ordered array of structs; a series is a year at most."""
    return hours.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("hours"))


def fold_hours(start: Column, hours: Column, step) -> Column:
    """State after all hours; ``step(state, hour)`` gives the next state."""
    return F.aggregate(hours, start, step)


def two_node_step(t: Column, hour: Column, p: Column) -> Column:
    """One implicit hour of a wall of one layer with a node on each side, by Cramer's rule.

    p: conductance g between the nodes, capacity c of each over the step, films
    h_e and h_i, inner temperature t_int.
    """
    a11, a22, a12 = p["c"] + p["g"] + p["h_e"], p["c"] + p["g"] + p["h_i"], -p["g"]
    b1 = p["c"] * t["t0"] + p["h_e"] * hour["t_ext"] + hour["sun"]
    b2 = p["c"] * t["t1"] + p["h_i"] * p["t_int"]
    det = a11 * a22 - a12 * a12
    return F.struct(((b1 * a22 - a12 * b2) / det).alias("t0"), ((a11 * b2 - a12 * b1) / det).alias("t1"))


def air_step(s: Column, hour: Column, p: Column, thermostat: bool) -> Column:
    """One implicit hour of an air node with conductance to outside, gains and, if asked, a thermostat.

    The state carries sums of heating, cooling, ventilation, envelope and gains
    in joules; hvac is the residual that pins the air to the bound it would pass.
    """
    g = p["ua"] + hour["g_vent"]
    a = p["c"] / STEP_S + g
    b = p["c"] / STEP_S * s["t"] + g * hour["t_ext"] + hour["gains"]
    free = b / a
    t = F.when(free < p["t_min"], p["t_min"]).when(free > p["t_max"], p["t_max"]).otherwise(free) if thermostat else free
    hvac = a * t - b if thermostat else F.lit(0.0)
    return F.struct(
        t.alias("t"),
        (s["t_sum"] + t).alias("t_sum"),
        (s["heat"] + F.when(hvac > 0, hvac).otherwise(0.0) * STEP_S).alias("heat"),
        (s["cool"] + F.when(hvac > 0, 0.0).otherwise(-hvac) * STEP_S).alias("cool"),
        (s["vent"] + hour["g_vent"] * (hour["t_ext"] - t) * STEP_S).alias("vent"),
        (s["envelope"] + p["ua"] * (hour["t_ext"] - t) * STEP_S).alias("envelope"),
        (s["gain"] + hour["gains"] * STEP_S).alias("gain"),
    )


def air_start(t: Column) -> Column:
    """The air node's first state."""
    return F.struct(t.alias("t"), *[F.lit(0.0).alias(n) for n in ("t_sum", "heat", "cool", "vent", "envelope", "gain")])


def series_arrays(hours: DataFrame, order: str, fields: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The hours of one series as arrays (null: NaN); more than a leap year's are an error."""
    rows = hours.select(order, *[F.col(c).cast("double") for c in fields]).limit(MAX_HOURS + 1).toArrow().sort_by(order)
    if rows.num_rows > MAX_HOURS:
        raise ValueError("more hours than a leap year")
    return {c: rows[c].to_numpy() for c in fields}


def advanced(rows: DataFrame, key: str, hours: dict[str, np.ndarray], fields: tuple[str, ...], run: Callable[..., dict[str, np.ndarray]], ends: tuple[str, ...]) -> DataFrame:
    """key and the end states of rows (key and parameter ``fields``) over the hours of one series, a batch of rows at a time.

    ``run(parameters, hours)`` takes and gives arrays by name, a value for each row.
    """
    spread = rows.sparkSession.sparkContext.broadcast(hours)  # at most MAX_HOURS rows

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in fields}
            end = run(given, spread.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(end[c], from_pandas=True) for c in ends)], [key, *ends])

    kind = rows.schema[key].dataType.simpleString()
    return spread_out(rows.select(key, *[F.col(c).cast("double") for c in fields]), key).mapInArrow(steps, f"{key} {kind}, " + ", ".join(f"{c} double" for c in ends))


def two_node_run(p: dict[str, np.ndarray], hours: dict[str, np.ndarray], t_init: float = 15.0) -> dict[str, np.ndarray]:
    """Node temperatures t0 and t1 of many walls after all hours (t_ext, sun), each as ``two_node_step`` has it."""
    a11, a22, a12 = p["c"] + p["g"] + p["h_e"], p["c"] + p["g"] + p["h_i"], -p["g"]
    det, held = a11 * a22 - a12 * a12, p["h_i"] * p["t_int"]
    t0 = t1 = np.full(len(det), t_init)
    for t_ext, sun in zip(hours["t_ext"], hours["sun"]):
        b1, b2 = p["c"] * t0 + p["h_e"] * t_ext + sun, p["c"] * t1 + held
        t0, t1 = (b1 * a22 - a12 * b2) / det, (a11 * b2 - a12 * b1) / det
    return {"t0": t0, "t1": t1}


AIR_STATE = ("t", "t_sum", "heat", "cool", "vent", "envelope", "gain")


def air_run(p: dict[str, np.ndarray], hours: dict[str, np.ndarray], thermostat: bool, t_init: float = 18.0) -> dict[str, np.ndarray]:
    """States of many air nodes after all hours (t_ext, g_vent, gains), each as ``air_step`` has it."""
    per_step = p["c"] / STEP_S
    s = {c: np.zeros(len(per_step)) for c in AIR_STATE}
    t = s["t"] + t_init
    for t_ext, g_vent, gains in zip(hours["t_ext"], hours["g_vent"], hours["gains"]):
        g = p["ua"] + g_vent
        a = per_step + g
        b = per_step * t + g * t_ext + gains
        t = free = b / a
        if thermostat:
            t = np.where(free < p["t_min"], p["t_min"], np.where(free > p["t_max"], p["t_max"], free))
        hvac = a * t - b if thermostat else np.zeros(len(a))
        s["t_sum"] += t
        s["heat"] += np.where(hvac > 0, hvac, 0.0) * STEP_S
        s["cool"] += np.where(hvac > 0, 0.0, -hvac) * STEP_S
        s["vent"] += g_vent * (t_ext - t) * STEP_S
        s["envelope"] += p["ua"] * (t_ext - t) * STEP_S
        s["gain"] += gains * STEP_S
    return s | {"t": t}


class WallClass:
    """A meshed wall per square metre: conductances between nodes, capacities, solar shares."""

    def __init__(self, layers: list[tuple[float, ...]], dx: float):
        links, caps, starts = [], [0.0], []
        for e, lam, rho, c, *_ in layers:
            n = max(1, int(np.ceil(e / dx)))
            starts.append(len(links))
            for _ in range(n):
                links.append(lam * n / e)
                caps[-1] += rho * c * e / n / 2
                caps.append(rho * c * e / n / 2)
        self.links, self.caps, self.n = np.array(links), np.array(caps), len(caps)
        if self.n > MAX_NODES:
            raise ValueError(f"a wall has {self.n} nodes, more than {MAX_NODES}")
        #: the first node of every layer and the last node
        self.borders = [*starts, self.n - 1]
        #: node loads and interior gain for one W/m2 of incident sun
        self.sun, self.inside, beam = np.zeros(self.n), 0.0, 1.0
        for (e, _, _, _, tau, _, alpha), a, b in zip(layers, starts, [*starts[1:], len(links)]):
            if beam <= 1e-9:
                break
            if tau <= 1e-9:
                self.sun[a] += alpha * beam
                beam = 0.0
                break
            share = alpha * beam / (b - a) / 2
            self.sun[a:b] += share
            self.sun[a + 1 : b + 1] += share
            beam *= tau
        self.inside = beam if beam > 1e-9 else 0.0


class Walls:
    """Many walls side by side: a row each, nodes aligned at the inner surface (the last column)."""

    def __init__(self, walls: list[WallClass]):
        self.walls, n = walls, max(w.n for w in walls)
        rows = len(walls)
        self.caps, self.sun, self.links = (np.zeros((rows, k), order="F") for k in (n, n, n - 1))  # sweeps go by columns
        for i, w in enumerate(walls):
            self.caps[i, n - w.n :], self.sun[i, n - w.n :], self.links[i, n - w.n :] = w.caps, w.sun, w.links
        self.outer = np.array([n - w.n for w in walls])
        self.inside = np.array([w.inside for w in walls])
        self.n, self.rows = n, np.arange(rows)
        self.per_step = self.caps / STEP_S
        base = self.per_step.copy(order="K")
        base[:, :-1] += self.links
        base[:, 1:] += self.links
        base[self.caps == 0] = 1.0  # columns before a wall's outer node
        self.diagonal = base

    def factored(self, h_e: np.ndarray, h_i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Multipliers, pivots and w of a step with these films; they hold for all steps that have the same."""
        d, m, w = self.diagonal.copy(order="K"), np.zeros_like(self.links), np.zeros_like(self.caps)
        d[self.rows, self.outer] += h_e
        d[:, -1] += h_i
        for k in range(1, self.n):
            m[:, k - 1] = self.links[:, k - 1] / d[:, k - 1]
            d[:, k] -= m[:, k - 1] * self.links[:, k - 1]
        w[:, -1] = h_i / d[:, -1]  # only the last entry of w is not zero before the sweep back
        for k in range(self.n - 2, -1, -1):
            w[:, k] = self.links[:, k] * w[:, k + 1] / d[:, k]
        return m, d, w

    def solved(self, t: np.ndarray, load: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
        """u of T = u + w * T_air after one step: a tridiagonal sweep over all walls at once."""
        b = self.per_step * t + load
        for k in range(1, self.n):
            b[:, k] += m[:, k - 1] * b[:, k - 1]
        b[:, -1] /= d[:, -1]
        for k in range(self.n - 2, -1, -1):
            b[:, k] = (b[:, k] + self.links[:, k] * b[:, k + 1]) / d[:, k]
        return b

    def eliminate(self, t: np.ndarray, load: np.ndarray, h_e: np.ndarray, h_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """u and w of T = u + w * T_air after one step."""
        m, d, w = self.factored(h_e, h_i)
        return self.solved(t, load, m, d), w


def sun_of(lat: np.ndarray, lon: np.ndarray, offset: np.ndarray, declination: np.ndarray, solar_minutes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Local sun vector (x, y, z) and azimuth, a row per site and a column per hour; degrees except the vector."""
    phi, dec = np.radians(lat)[:, None], np.radians(declination)[None]
    h = np.radians((solar_minutes[None] + 4.0 * lon[:, None]) / 4.0 - 180.0)
    up = np.clip(np.sin(phi) * np.sin(dec) + np.cos(phi) * np.cos(dec) * np.cos(h), -1.0, 1.0)
    east, north = -np.cos(dec) * np.sin(h), np.sin(dec) * np.cos(phi) - np.cos(dec) * np.sin(phi) * np.cos(h)
    a = np.arctan2(east, north) - np.radians(offset)[:, None]
    flat = np.sqrt(1.0 - up * up)
    return np.sin(a) * flat, np.cos(a) * flat, up, np.degrees(a) % 360.0


def cell_of(azimuth: np.ndarray, elevation: np.ndarray) -> np.ndarray:
    """Cell of the sun grid: the azimuth wraps, the elevation is clamped and ties go to the lower one."""
    az = np.round(azimuth / GRID_STEP).astype(int) % GRID_AZ
    return az * GRID_EL + np.ceil(np.clip(elevation, 0, 90) / GRID_STEP - 0.5).astype(int)


def run_buildings(buildings: list[dict], hours: dict[str, np.ndarray], dx: float) -> list[dict]:
    """Results of some buildings over the same hours, as ``simulate`` describes them."""
    n_hours, n_b = len(hours["t_ext"]), len(buildings)
    surfaces = [(i, s) for i, b in enumerate(buildings) for s in b["surfaces"]]
    memo: dict[tuple, WallClass] = {}
    made = []
    for _, s in surfaces:
        layers = tuple(tuple(x.values()) for x in s["layers"])
        if layers not in memo:
            memo[layers] = WallClass(layers, dx)
        made.append(memo[layers])
    walls, of = Walls(made), np.array([i for i, _ in surfaces])
    unknowns = np.bincount(of, [w.n for w in made], n_b)
    if (unknowns > MAX_UNKNOWNS).any():
        raise ValueError(f"a building has {unknowns.max():.0f} unknowns, more than {MAX_UNKNOWNS}")
    field = lambda name, default=0.0: np.array([default if s.get(name) is None else s[name] for _, s in surfaces], float)
    area, h_i, ground, g_frame = field("area"), field("h_i", 7.7), field("ground").astype(bool), field("g_frame")
    shade = np.array([SHADING.get(s.get("shading"), (0.0, 1.0, 1.0)) for _, s in surfaces])
    own = lambda name: np.array([DEFAULTS[name] if b.get(name) is None else b[name] for b in buildings])
    mode, c_air, t_init, t_int = own("mode"), own("c_air"), own("t_init"), own("t_int")
    low, high, t_ground, r_ground = own("t_min"), own("t_max"), own("t_ground"), own("r_ground")
    imposed, thermostat = mode == "imposed", mode == "thermostat"
    # Incident sun of every surface and hour: direct by cosine and visibility, diffuse by the sky's share, both behind closed shading.
    x, y, z, azimuth = sun_of(own("lat"), own("lon"), own("north_offset_deg"), hours["declination"], hours["solar_minutes"])
    elevation, up = np.degrees(np.arcsin(z)), z > 0
    cosine = np.maximum(field("nx")[:, None] * x[of] + field("ny")[:, None] * y[of] + field("nz")[:, None] * z[of], 0) * up[of]
    cells = cell_of(azimuth, elevation)
    for k, (i, s) in enumerate(surfaces):
        if s.get("vis"):
            cosine[k] *= np.array(s["vis"], float)
        elif s.get("cube"):
            cosine[k] *= np.array(s["cube"], float)[cells[i]]
    closed = hours["closed"].astype(bool)
    sky = field("f_sky")[:, None]
    sun = hours["e_dir"] * cosine * np.where(closed, shade[:, 1:2], 1.0) + hours["e_dif"] * sky * np.where(closed, shade[:, 2:3], 1.0)
    del cosine
    t, t_air = np.asfortranarray(np.repeat(t_init[of, None], walls.n, 1)), np.where(imposed, t_int, t_init).astype(float)
    to_air, cap = area * h_i, c_air / STEP_S
    total = lambda v: np.bincount(of, v, n_b)
    frames_g = total(g_frame)
    air, flux, hvac = (np.zeros((n_b, n_hours + k)) for k in (1, 0, 0))
    air[:, 0] = t_air
    sums = {k: np.zeros(n_b) for k in ("envelope_in", "envelope_out", "solar", "gains", "ventilation", "frames", "heating", "cooling")}
    for n in range(n_hours):
        t_ext, g_vent = hours["t_ext"][n], hours["g_vent"][n]
        film = 1.0 / (1.0 / hours["h_e"][n] + shade[:, 0]) if closed[n] else np.full(len(surfaces), hours["h_e"][n])
        h_e, t_b = np.where(ground, 1.0 / np.maximum(r_ground, 1e-6)[of], film), np.where(ground, t_ground[of], t_ext)
        load = walls.sun * sun[:, n, None]
        load[walls.rows, walls.outer] += h_e * t_b
        u, w = walls.eliminate(t, load, h_e, h_i)
        interior, framed = total(area * walls.inside * sun[:, n]), total(g_frame * t_b)
        den = cap + g_vent + frames_g + total(to_air * (1 - w[:, -1]))
        num = cap * t_air + g_vent * t_ext + framed + hours["gains"][n] + interior + total(to_air * u[:, -1])
        free = num / den
        floor_, top = (np.where(np.isnan(hours[k][n]), bound, hours[k][n]) for k, bound in (("t_min", low), ("t_max", high)))
        if (thermostat & (floor_ >= top)).any():
            raise ValueError(f"hour {n}: t_min is not below t_max")
        new = np.where(imposed, t_int, np.where(thermostat, np.clip(free, floor_, top), free))
        power = np.where(thermostat & (new != free), den * new - num, 0.0)
        t = u + w * new[of, None]
        into = total(to_air * (t[:, -1] - new[of]))
        for name, value in (
            ("envelope_in", np.maximum(into, 0)), ("envelope_out", np.minimum(into, 0)), ("solar", interior), ("gains", np.full(n_b, hours["gains"][n])),
            ("ventilation", g_vent * (t_ext - new)), ("frames", framed - frames_g * new), ("heating", np.maximum(power, 0)), ("cooling", np.maximum(-power, 0)),
        ):
            sums[name] += value * STEP_S / 3.6e6
        air[:, n + 1], flux[:, n], hvac[:, n], t_air = new, into, power, new
    out = []
    for i, b in enumerate(buildings):
        mine = np.flatnonzero(of == i)
        energy = {k: float(v[i]) for k, v in sums.items()}
        stored = float(c_air[i] * (air[i, -1] - air[i, 0]) / 3.6e6)
        channels = energy["envelope_in"] + energy["envelope_out"] + energy["solar"] + energy["gains"] + energy["ventilation"] + energy["frames"] + energy["heating"] - energy["cooling"]
        balance = None if imposed[i] else {k: energy[k] for k in ("solar", "gains", "ventilation", "frames")} | {"envelope": energy["envelope_in"] + energy["envelope_out"], "stored": stored, "closure": channels - stored}
        final = [{"class_id": surfaces[k][1]["class_id"], "t_outer": float(t[k, walls.outer[k]]), "t_inner": float(t[k, -1])} for k in mine]
        out.append({
            "building_id": b["building_id"], "t_air": air[i], "flux": flux[i], "hvac": hvac[i], "t_mean": float(air[i, 1:].mean()) if n_hours else None,
            **{k: energy[k] for k in ("heating", "cooling", "envelope_in", "envelope_out")}, "balance": balance, "surfaces": final,
        })
    return out


BALANCE = pa.struct([(k, pa.float64()) for k in ("solar", "gains", "ventilation", "frames", "envelope", "stored", "closure")])
RESULT = pa.schema([
    ("building_id", pa.int64()), *[(k, pa.list_(pa.float64())) for k in ("t_air", "flux", "hvac")], *[(k, pa.float64()) for k in ("t_mean", "heating", "cooling", "envelope_in", "envelope_out")],
    ("balance", BALANCE), ("surfaces", pa.list_(pa.struct([("class_id", pa.int64()), ("t_outer", pa.float64()), ("t_inner", pa.float64())]))),
])
RESULT_DDL = (
    "building_id long, t_air array<double>, flux array<double>, hvac array<double>, t_mean double, heating double, cooling double, envelope_in double, envelope_out double, "
    "balance struct<solar:double,gains:double,ventilation:double,frames:double,envelope:double,stored:double,closure:double>, surfaces array<struct<class_id:bigint,t_outer:double,t_inner:double>>"
)


def hours_of(series: DataFrame, order: str = "seq") -> dict[str, np.ndarray]:
    """The hours of one series as arrays; more than a leap year's, or none, are an error."""
    have = [c for c in HOUR_FIELDS if c in series.columns]
    rows = series.select(order, *[F.col(c).cast("double") for c in have]).limit(MAX_HOURS + 1).toArrow().sort_by(order)
    if not 0 < rows.num_rows <= MAX_HOURS:
        raise ValueError("no hour, or more hours than a leap year")
    blank = {"t_min": np.nan, "t_max": np.nan}
    return {c: rows[c].to_numpy() if c in have else np.full(rows.num_rows, blank.get(c, 0.0)) for c in HOUR_FIELDS}


def spread_out(rows: DataFrame, key: str) -> DataFrame:
    """Few small rows of much work each, dealt to all tasks: as many partitions as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def simulate(surfaces: DataFrame, buildings: DataFrame, hours: DataFrame, dx: float = 0.05) -> DataFrame:
    """Results of every building over one series of hours, one row each.

    surfaces: (building_id, class_id, area, h_i, ground, layers) and, where known,
    g_frame, nx, ny, nz, f_sky, shading and either vis (visible fraction by hour)
    or cube (by cell of the sun grid, azimuth first); layers are arrays of (e, lam,
    rho, c, tau, r, alpha) from outside to inside.  buildings: building_id and any
    of the names in DEFAULTS; a missing or null one takes the default.  hours: seq,
    t_ext, h_e, g_vent, gains and, where known, e_dir, e_dif, declination,
    solar_minutes (see ``solar.hour_terms``), closed, t_min, t_max; a year at most.

    Returns t_air (one more than hours: the start first), flux and hvac by hour,
    the mean of t_air without the start, energies in kWh, the balance (null if the
    air is imposed) and the last surface temperatures.
    """
    spread = surfaces.sparkSession.sparkContext.broadcast(hours_of(hours))  # at most MAX_HOURS rows
    fields = [c for c in surfaces.columns if c != "building_id"]
    each = surfaces.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("class_id", *[c for c in fields if c != "class_id"]))).alias("surfaces"))
    own = [c for c in buildings.columns if c in DEFAULTS]
    rows = buildings.select("building_id", *own).join(each, "building_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(run_buildings(some, spread.value, dx), RESULT)

        waiting, walls = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if waiting and (len(waiting) >= BUILDINGS_AT_ONCE or walls + len(row["surfaces"]) > WALLS_AT_ONCE):
                    yield flush(waiting)
                    waiting, walls = [], 0
                waiting.append(row)
                walls += len(row["surfaces"])
        if waiting:
            yield flush(waiting)

    return spread_out(rows, "building_id").mapInArrow(run, RESULT_DDL)


def wall_run(walls: DataFrame, hours: DataFrame, mode: str = "imposed", dx: float = 0.02, settings: dict[str, float] | None = None, last: bool = False) -> DataFrame:
    """Temperatures of walls of any layers over one series: wall_id, t_air and nodes (at layer borders) after every hour, the start first; ``last`` leaves out all but the last.

    walls: (wall_id, layers); hours: seq, t_ext, incident and, if the air floats,
    g_vent; modes: imposed (the air at t_int) and free (an air node of c_air joules
    per kelvin and square metre).  settings: h_e, h_i, t_int, t_init, c_air.
    """
    p = {"h_e": 25.0, "h_i": 7.7, "t_int": 20.0, "t_init": 15.0, "c_air": 50_000.0} | (settings or {})
    if mode not in ("imposed", "free"):
        raise ValueError(f"no such mode: {mode}")
    have = [c for c in ("t_ext", "incident", "g_vent") if c in hours.columns]
    rows = hours.select("seq", *[F.col(c).cast("double") for c in have]).limit(MAX_HOURS + 1).toArrow().sort_by("seq")
    if not 0 < rows.num_rows <= MAX_HOURS:
        raise ValueError("no hour, or more hours than a leap year")
    series = {c: rows[c].to_numpy() if c in have else np.zeros(rows.num_rows) for c in ("t_ext", "incident", "g_vent")}
    spread = walls.sparkSession.sparkContext.broadcast(series)  # at most MAX_HOURS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = spread.value
        for batch in batches:
            at_once = LAST_AT_ONCE if last else RUNS_AT_ONCE
            for start in range(0, batch.num_rows, at_once):
                some = batch.slice(start, at_once).to_pylist()
                made = [WallClass([tuple(x.values()) for x in r["layers"]], dx) for r in some]
                own, n = Walls(made), len(some)
                t, t_air = np.full((n, own.n), p["t_init"], order="F"), np.full(n, p["t_int"] if mode == "imposed" else p["t_init"])
                h_e, h_i = np.full(n, p["h_e"]), np.full(n, p["h_i"])
                # Only nodes at layer borders are kept of every hour.
                wall = np.repeat(own.rows, [len(w.borders) for w in made])
                node = np.concatenate([own.outer[i] + np.array(w.borders) for i, w in enumerate(made)])
                m, d, w = own.factored(h_e, h_i)
                outside = np.zeros_like(own.sun)
                outside[own.rows, own.outer] = h_e
                states, airs = [t[wall, node]], [t_air]
                for k in range(len(s["t_ext"])):
                    u = own.solved(t, own.sun * s["incident"][k] + outside * s["t_ext"][k], m, d)
                    if mode == "free":
                        cap, g = p["c_air"] / STEP_S, s["g_vent"][k]
                        t_air = (cap * t_air + g * s["t_ext"][k] + own.inside * s["incident"][k] + h_i * u[:, -1]) / (cap + g + h_i * (1 - w[:, -1]))
                    t = u + w * t_air[:, None]
                    if last:
                        states.clear()
                        airs.clear()
                    states.append(t[wall, node])
                    airs.append(t_air)
                states, airs, steps = np.array(states), np.array(airs), len(airs)
                per_wall = np.bincount(wall, minlength=n)
                edges = np.append(0, np.cumsum(per_wall))
                flat = np.concatenate([states[:, a:b].ravel() for a, b in zip(edges, edges[1:])])
                inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.repeat(per_wall, steps))), pa.int32()), pa.array(flat))
                by_hour = pa.array(np.arange(n + 1) * steps, pa.int32())
                columns = [batch.column(0).slice(start, n), pa.ListArray.from_arrays(by_hour, pa.array(airs.T.ravel())), pa.ListArray.from_arrays(by_hour, inner)]
                yield pa.RecordBatch.from_arrays(columns, ["wall_id", "t_air", "nodes"])

    return spread_out(walls.select("wall_id", "layers"), "wall_id").mapInArrow(run, "wall_id long, t_air array<double>, nodes array<array<double>>")
