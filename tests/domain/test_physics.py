"""Closed forms, conservation and equivalences of the simulation, independent of its code."""

import functools
import numpy as np
import pytest
from pyspark.sql import functions as F

from calorix.functions import geometry, physics, solar
from calorix.operators import meshes, simulate, visibility, walls

BRICK = (0.1, 1.0, 1400.0, 1000.0, 0.0, 0.9, 0.1)
WOOL = (0.08, 0.035, 25.0, 1030.0, 0.0, 0.9, 0.1)
GLASS = (0.004, 1.0, 2500.0, 750.0, 0.87, 0.07, 0.06)
BASE = {"mode": "free", "c_air": 3e5, "t_init": 15.0, "t_int": 20.0, "t_min": 19.0, "t_max": 26.0, "t_ground": 12.0, "r_ground": 0.5}
DX = 0.02


def hours(n, **given):
    blank = dict.fromkeys(simulate.HOUR_FIELDS, 0.0) | {"h_e": 25.0, "t_min": np.nan, "t_max": np.nan}
    return {k: np.broadcast_to(np.asarray(given.get(k, v), float), n).copy() for k, v in blank.items()}


def wall(layers, area=1.0, **given):
    names = ("e", "lam", "rho", "c", "tau", "r", "alpha")
    return {"class_id": 0, "layers": [dict(zip(names, x)) for x in layers], "area": area, "h_i": 7.7, "ground": False} | given


def run(surfaces, series, **settings):
    return simulate.run_buildings([{"building_id": 1, "surfaces": surfaces} | BASE | settings], series, DX)[0]


def inverse(w, h_e, h_i):
    m = np.diag(w.caps / 3600)
    for i, g in enumerate(w.links):
        m[i : i + 2, i : i + 2] += g * np.array([[1, -1], [-1, 1]])
    m[0, 0] += h_e
    m[-1, -1] += h_i
    return np.linalg.inv(m)


@pytest.mark.parametrize("layers", [[BRICK], [BRICK, WOOL], [GLASS]])
def test_steady_flux_is_u_times_difference(layers):
    out = run([wall(layers)], hours(2000), mode="imposed")
    u = 1 / (1 / 25 + sum(x[0] / x[1] for x in layers) + 1 / 7.7)
    assert out["flux"][-1] == pytest.approx(-20 * u, rel=1e-3)
    assert out["balance"] is None and len(out["t_air"]) == 2001


def sunny(n):
    k = np.arange(n)
    return hours(n, t_ext=2 + 10 * np.sin(k / 6), h_e=5.8 + k % 5, g_vent=20.0, gains=50.0, e_dir=600.0, e_dif=90.0, declination=10.0, solar_minutes=(k % 24) * 60.0, closed=k % 24 < 7)


@pytest.mark.parametrize("mode", ["free", "thermostat"])
def test_channels_close_with_stored_energy(mode):
    surfaces = [wall([BRICK, WOOL], 30, ny=-1.0, f_sky=0.5), wall([GLASS], 5, nz=1.0, f_sky=1.0, shading="volet-roulant", g_frame=3.0), wall([BRICK], 40, ground=True)]
    out = run(surfaces, sunny(200), mode=mode, lat=45.0)
    assert abs(out["balance"]["closure"]) < 1e-9 and out["balance"]["solar"] > 1
    assert out["heating"] - out["cooling"] == pytest.approx(out["hvac"].sum() * 3600 / 3.6e6)
    assert out["envelope_in"] + out["envelope_out"] == pytest.approx(out["flux"].sum() * 3600 / 3.6e6)


def test_elimination_equals_one_dense_system():
    n, areas, layers = 120, (12.0, 7.0, 3.0), ([BRICK, WOOL], [BRICK], [GLASS, GLASS])
    series = sunny(n)
    normals, shading = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (None, None, "store-exterieur")
    surfaces = [wall(x, a, nx=v[0], ny=v[1], nz=v[2], f_sky=0.4, shading=s, g_frame=1.5, ground=i == 1) for i, (x, a, v, s) in enumerate(zip(layers, areas, normals, shading))]
    out = run(surfaces, series, lat=40.0, lon=5.0, north_offset_deg=20.0)
    ws = [simulate.WallClass(x, DX) for x in layers]
    size = sum(w.n for w in ws) + 1
    cap, starts = np.zeros(size), np.cumsum([0, *(w.n for w in ws)])[:-1]
    cap[-1] = BASE["c_air"]
    for w, a, at in zip(ws, areas, starts):
        cap[at : at + w.n] = w.caps * a
    state = np.full(size, BASE["t_init"])
    for i in range(n):
        # The sun by its textbook vector.
        phi, dec, h = np.radians(40.0), np.radians(10.0), np.radians((series["solar_minutes"][i] + 20.0) / 4 - 180)
        up = np.sin(phi) * np.sin(dec) + np.cos(phi) * np.cos(dec) * np.cos(h)
        az = np.arctan2(-np.cos(dec) * np.sin(h), np.sin(dec) * np.cos(phi) - np.cos(dec) * np.sin(phi) * np.cos(h)) - np.radians(20.0)
        sun = np.array([np.sin(az), np.cos(az)]) * np.sqrt(1 - up * up)
        k, load = np.zeros((size, size)), cap / 3600 * state
        t_ext, closed = series["t_ext"][i], series["closed"][i] > 0
        for j, (w, a, at, v) in enumerate(zip(ws, areas, starts, normals)):
            k[at : at + w.n, at : at + w.n] += (np.linalg.inv(inverse(w, 0.0, 7.7)) - np.diag(w.caps / 3600)) * a
            film = series["h_e"][i] if not (closed and j == 2) else 1 / (1 / series["h_e"][i] + 0.08)
            film, t_b = (2.0, 12.0) if j == 1 else (film, t_ext)
            k[at, at] += film * a
            load[at] += film * a * t_b
            cosine = max(0.0, v[0] * sun[0] + v[1] * sun[1] + v[2] * up) if up > 0 else 0.0
            direct, diffuse = (0.15, 0.40) if closed and j == 2 else (1.0, 1.0)
            e = 600 * direct * cosine + 90 * diffuse * 0.4
            load[at : at + w.n] += w.sun * e * a
            load[-1] += w.inside * e * a + 1.5 * t_b
            k[at + w.n - 1, -1] -= 7.7 * a
            k[-1, at + w.n - 1] -= 7.7 * a
            k[-1, -1] += 7.7 * a + 1.5
        k[-1, -1] += 20.0
        load[-1] += 20.0 * t_ext + 50.0
        state = np.linalg.solve(np.diag(cap / 3600) + k, load)
        assert state[-1] == pytest.approx(out["t_air"][i + 1], abs=1e-9)
    last = [(s["t_outer"], s["t_inner"]) for s in out["surfaces"]]
    assert np.allclose(last, [(state[at], state[at + w.n - 1]) for w, at in zip(ws, starts)], atol=1e-9)


def test_visibility_scales_direct_sun():
    series = sunny(48)
    series["e_dif"][:] = 0
    free, cut = (run([wall([GLASS], 5, nz=1.0, vis=[v] * 48)], series, lat=45.0)["balance"]["solar"] for v in (1.0, 0.25))
    assert cut == pytest.approx(free / 4) and free > 0
    cube = run([wall([GLASS], 5, nz=1.0, cube=[0.25] * 168)], series, lat=45.0)["balance"]["solar"]
    assert cube == pytest.approx(cut)


def test_thermostat_holds_its_bounds():
    out = run([wall([BRICK], 50)], hours(300, t_ext=15 + 20 * np.sin(np.arange(300) / 6)), mode="thermostat")
    assert (out["t_air"][1:] >= 19 - 1e-9).all() and (out["t_air"][1:] <= 26 + 1e-9).all() and (out["hvac"] > 0).any()
    hourly = run([wall([BRICK], 50)], hours(30, t_min=21.0, t_max=np.where(np.arange(30) < 9, np.nan, 22.0)), mode="thermostat")
    assert hourly["t_air"][1:] == pytest.approx(21.0)
    with pytest.raises(ValueError, match="t_min"):
        run([wall([BRICK])], hours(3, t_min=30.0), mode="thermostat")


def test_ground_equals_outside_with_the_same_film():
    a = run([wall([BRICK], 9, ground=True)], hours(100, t_ext=30.0))
    b = run([wall([BRICK], 9)], hours(100, t_ext=12.0, h_e=2.0))
    assert np.allclose(a["t_air"], b["t_air"], atol=1e-9)


def test_gains_add_up():
    out = run([wall([BRICK], 9)], hours(24, gains=np.where(np.arange(24) < 12, 300.0, 0.0)))
    assert out["balance"]["gains"] == pytest.approx(3.6)


def test_wall_run_equals_a_dense_solution(spark):
    layer = lambda x: "named_struct(" + ", ".join(f"'{n}', {v}D" for n, v in zip(("e", "lam", "rho", "c", "tau", "r", "alpha"), x)) + ")"
    walls_ = spark.sql(f"select 1L as wall_id, array({layer(BRICK)}, {layer(WOOL)}, {layer(GLASS)}) as layers union all select 2L, array({layer(GLASS)})")
    series = spark.range(90).selectExpr("id as seq", "5D + id % 11 as t_ext", "40D * (id % 3) as incident", "0.5D as g_vent")
    for mode in ("imposed", "free"):
        found = {r["wall_id"]: r for r in simulate.wall_run(walls_, series, mode, 0.03).collect()}
        for wall_id, layers in ((1, [BRICK, WOOL, GLASS]), (2, [GLASS])):
            w = simulate.WallClass(layers, 0.03)
            a = np.linalg.inv(inverse(w, 25.0, 7.7))
            n = w.n + 1
            m = np.zeros((n, n))
            m[:-1, :-1] = a
            m[-2, -1] = m[-1, -2] = -7.7
            m[-1, -1] = 50_000 / 3600 + 0.5 + 7.7
            t = np.full(n, 15.0)
            if mode == "imposed":
                m[-1], t[-1] = np.eye(n)[-1], 20.0
            for k in range(90):
                t_ext, e = 5.0 + k % 11, 40.0 * (k % 3)
                load = np.append(w.caps / 3600 * t[:-1] + w.sun * e, 50_000 / 3600 * t[-1] + 0.5 * t_ext + w.inside * e)
                load[0] += 25.0 * t_ext
                if mode == "imposed":
                    load[-1] = 20.0
                t = np.linalg.solve(m, load)
            assert found[wall_id]["t_air"][-1] == pytest.approx(t[-1], abs=1e-9)
            assert found[wall_id]["nodes"][-1] == pytest.approx(list(t[w.borders]), abs=1e-9)
            assert len(found[wall_id]["nodes"]) == 91


def test_glazing_passes_its_transmittance():
    w = simulate.WallClass([(0.004, 1.0, 2500.0, 750.0, 0.88, 0.06, 0.06), (0.016, 0.094, 1.2, 1000.0, 0.97, 0.01, 0.02), (0.004, 1.0, 2500.0, 750.0, 0.88, 0.06, 0.06)], 0.02)
    assert w.inside == pytest.approx(0.88 * 0.97 * 0.88)
    assert simulate.WallClass([(0.004, 1.0, 2500.0, 750.0, 0.9, 0.0, 0.1), BRICK], 0.02).inside == 0


def test_simulate_over_buildings(spark):
    layer = "array(named_struct('e', 0.1D, 'lam', 1.0D, 'rho', 1400D, 'c', 1000D, 'tau', 0D, 'r', 0.9D, 'alpha', 0.1D))"
    surfaces = spark.range(6).selectExpr("id div 2 as building_id", "id % 2 as class_id", "double(10 + id) as area", "7.7D as h_i", "id % 2 = 1 as ground", f"{layer} as layers", "0D as nx", "0D as ny", "1D as nz", "1D as f_sky")
    series = spark.range(48).selectExpr("id as seq", "5D + id % 7 as t_ext", "20D as h_e", "10D as g_vent", "100D as gains", "300D as e_dir", "50D as e_dif", "12D as declination", "60D * (id % 24) as solar_minutes")
    buildings = spark.sql("select id as building_id, if(id = 1, 'imposed', null) as mode, double(40 + id) as lat from range(4)")
    rows = {r["building_id"]: r for r in simulate.simulate(surfaces, buildings, series).collect()}
    assert set(rows) == {0, 1, 2} and rows[1]["balance"] is None and all(abs(rows[i]["balance"]["closure"]) < 1e-9 for i in (0, 2))
    assert all(len(r["t_air"]) == 49 and [s["class_id"] for s in r["surfaces"]] == [0, 1] for r in rows.values())
    with pytest.raises(ValueError, match="hour"):
        simulate.simulate(surfaces, buildings, series.where("false"))


def test_sample_buildings_are_all_there(spark):
    from calorix.plans import energy_queries
    from calorix.sources.tables import Warehouse

    rows = energy_queries.building_sim(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == Warehouse(spark, "/root/testdata/sf0.001").sites().count()
    assert all(r["closes"] for r in rows) and any(r["solar"] > 0 for r in rows)


def test_sun_facts(spark):
    days = spark.sql("select cast(timestamp '2023-03-21 12:00:00' + make_interval(0,0,0,cast(id as int)) as timestamp_ntz) as ts from range(365)")
    out = days.select(solar.declination(solar.day_angle(F.col("ts"))).alias("d"), *[c.alias(n) for c, n in zip(solar.sun_position(F.col("ts"), F.lit(45.0), F.lit(0.0)), ("az", "el"))]).toPandas()
    assert out["d"].abs().max() <= 23.6
    assert (out["el"] - (90 - (45 - out["d"]).abs())).abs().max() < 0.6
    turned = spark.range(1).select(solar.local_azimuth(F.lit(180.0), F.lit(90.0)), solar.local_azimuth(F.lit(0.0), F.lit(90.0))).first()
    assert turned[0] == pytest.approx(90) and turned[1] == pytest.approx(270)


def test_film_and_tilt_buckets(spark):
    r = spark.sql("select 0D a, 5D b, 2.5D c").select(*[physics.film_coefficient(F.col(c)) for c in "abc"], *[physics.inner_film(F.lit(x)) for x in (60.0, 60.001, 119.999, 120.0)]).first()
    assert list(r) == pytest.approx([5.8, 25.5, 5.8 + 3.94 * 2, 10.0, 7.7, 7.7, 5.9])


def test_box_mesh_faces_outward_and_closes(spark):
    box = meshes.with_geometry(meshes.box_mesh(spark, 10.0, 8.0, 3.0)).toPandas()
    assert len(box) == 12 and box["area"].sum() == pytest.approx(2 * (80 + 30 + 24))
    centre = np.array([5.0, 4.0, 1.5])
    for r in box.itertuples():
        mid = np.array([(r.x0 + r.x1 + r.x2) / 3, (r.y0 + r.y1 + r.y2) / 3, (r.z0 + r.z1 + r.z2) / 3])
        assert np.dot(mid - centre, [r.nx, r.ny, r.nz]) > 0


def test_free_sky_is_analytic(spark):
    flat = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0)], "src int, nx double, ny double, nz double, tilt double")
    rays = visibility.facing(flat, visibility.sky_directions(spark), 1e-9).withColumn("frac", F.lit(1.0))
    assert visibility.sky_factors(rays, ("src",)).first()["f_sky"] == pytest.approx(1.0, abs=1e-9)


def test_catalogue_has_fourteen_walls(spark):
    rows = walls.catalogue(spark)
    assert rows.select("name").distinct().count() == 14
    assert rows.where(F.abs(F.col("tau") + F.col("r") + F.col("alpha") - 1) > 1e-9).count() == 0


def test_refinement_keeps_area_and_bounds_edges(spark):
    mesh = meshes.box_mesh(spark, 10.0, 8.0, 3.0).withColumns({"mesh_id": F.lit(1), "piece": F.lit(1)})
    fine = meshes.refined(mesh, 2.0)
    edges = [geometry.norm(geometry.minus(geometry.corner(i), geometry.corner((i + 1) % 3))) for i in range(3)]
    assert fine.select(F.max(F.greatest(*edges))).first()[0] <= 2.0
    assert meshes.with_geometry(fine).agg(F.sum("area")).first()[0] == pytest.approx(268.0)
    assert fine.count() == 12 * 4**3


def test_refinement_cuts_whole_pieces(spark):
    corners = ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz")
    # Triangle 2 is long; 5 shares an edge with it, 6 one with 5; 9 has a corner of 2 only.
    rows = [(1, 2, 0.0, 0.0, 0.0, 7.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0), (1, 6, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 1.0, 0.0), (1, 9, 7.0, 0.0, 0.0, 8.0, 0.0, 0.0, 8.0, 1.0, 0.0), (2, 1, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0)]
    mesh = spark.createDataFrame(rows, f"mesh_id int, tri_id int, {corners}")
    pieces = meshes.with_pieces(mesh)
    assert {(r["mesh_id"], r["tri_id"]): r["piece"] for r in pieces.collect()} == {(1, 2): 2, (1, 5): 2, (1, 6): 2, (1, 9): 9, (2, 1): 1}
    assert {(r[0], r[1]): r[2] for r in meshes.refined(pieces, 4.0).groupBy("mesh_id", "tri_id").count().collect()} == {(1, 2): 4, (1, 5): 4, (1, 6): 4, (1, 9): 1, (2, 1): 1}
    for longest, message in ((1e-6, "rounds"), (0.01, "triangles")):
        with pytest.raises(ValueError, match=message):
            meshes.refined(pieces, longest)
    # The long piece: 3 triangles of 5 vertices and 7 edges are 12 of 12, the other (1, 9) has 2 vertices more.
    counted = meshes.vertices_after(pieces.where("mesh_id = 1").withColumn("rounds", F.expr("int(piece = 2)")))
    assert [r["n"] for r in counted.collect()] == [14.0]
    lone = pieces.where("tri_id = 2").join(spark.range(3400).selectExpr("id * 10.0 as dz"))
    lone = lone.withColumns({f"z{i}": F.col("dz") for i in range(3)} | {"piece": F.col("dz"), "tri_id": F.col("dz")})
    with pytest.raises(ValueError, match="20400 vertices"):
        meshes.refined(lone, 4.0)


def test_nearest_cell_wraps_and_ties_go_down(spark):
    r = spark.sql("select 359D a, 7.5D e").select(*visibility.nearest_cell(F.col("a"), F.col("e"))).first()
    assert (r[0], r[1]) == (0, 0)


def test_batches_of_recurrences_equal_folds(spark):
    """Many rows advanced together have the states that a fold over each row's hours has; a null hour makes null ends."""
    hours = [(k, float(10.0 * np.sin(k)), 50.0 * (k % 3), 20.0 + k % 5, 100.0 * (k % 4)) for k in range(40)]
    series = spark.createDataFrame(hours, "seq int, t_ext double, sun double, g_vent double, gains double")
    known = simulate.series_arrays(series, "seq", ("t_ext", "sun", "g_vent", "gains"))
    nodes = spark.range(30).select("id", (50.0 + F.col("id")).alias("ua"), (2e5 + 1e4 * F.col("id")).alias("c"), F.lit(19.0).alias("t_min"), F.lit(26.0).alias("t_max"))
    folded = nodes.crossJoin(simulate.ordered_hours(series.withColumn("s", F.lit(1)), "seq", ("t_ext", "sun", "g_vent", "gains"), ("s",)))
    for thermostat in (True, False):
        step = lambda s, h: simulate.air_step(s, h, F.struct("ua", "c", "t_min", "t_max"), thermostat)  # noqa: B023, E731
        wanted = {r["id"]: tuple(r["s"]) for r in folded.select("id", simulate.fold_hours(simulate.air_start(F.lit(18.0)), F.col("hours"), step).alias("s")).collect()}
        found = simulate.advanced(nodes, "id", known, ("ua", "c", "t_min", "t_max"), functools.partial(simulate.air_run, thermostat=thermostat), simulate.AIR_STATE)
        assert {r[0]: tuple(r)[1:] for r in found.collect()} == wanted
    blank = simulate.advanced(nodes, "id", known | {"gains": np.full(40, np.nan)}, ("ua", "c", "t_min", "t_max"), functools.partial(simulate.air_run, thermostat=True), simulate.AIR_STATE)
    assert blank.where("t is null and cool is null and heat = 0").count() == 30
    walls_ = spark.range(30).select("id", (0.5 + F.col("id")).alias("g"), (20.0 + F.col("id")).alias("c"), F.lit(25.0).alias("h_e"), F.lit(7.7).alias("h_i"), F.lit(20.0).alias("t_int"))
    start = F.struct(F.lit(15.0).alias("t0"), F.lit(15.0).alias("t1"))
    both = walls_.crossJoin(folded.select("hours").limit(1)).select("id", simulate.fold_hours(start, F.col("hours"), lambda t, h: simulate.two_node_step(t, h, F.struct("g", "c", "h_e", "h_i", "t_int"))).alias("s"))
    found = simulate.advanced(walls_, "id", known, ("g", "c", "h_e", "h_i", "t_int"), simulate.two_node_run, ("t0", "t1"))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {r["id"]: tuple(r["s"]) for r in both.collect()}
    one = spark.createDataFrame([(1, [(0.1, 1.0, 1000.0, 900.0, 0.0, 0.1, 0.9)]), (2, [(0.02, 0.5, 800.0, 900.0, 0.8, 0.1, 0.1)] * 2)], "wall_id long, layers array<struct<e:double,lam:double,rho:double,c:double,tau:double,r:double,alpha:double>>")
    run = series.select("seq", "t_ext", F.col("sun").alias("incident"), "g_vent")
    for mode in ("imposed", "free"):
        every, last = (sorted(simulate.wall_run(one, run, mode, last=x).collect()) for x in (False, True))
        assert [(r["wall_id"], r["t_air"][-1:], r["nodes"][-1:]) for r in every] == [tuple(r) for r in last]
