"""The registered queries against closed-form SQL, and the operators against brute force."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import projection as P
from terravane.functions import raster as R
from terravane.functions import shapes as S
from terravane.operators import airfields, components, mesh, network, offroad, points, reference, settlements, sight, sites, windows
from terravane.plans import questions
from terravane.sources import catalog
from terravane.sources.synthetic import CELL, COVER, Form
from terravane.streaming import batch

SF = "/root/testdata/sf0.001"
#: Their SQL takes ten seconds; the correctness run has them.
LONG = {"viewshed", "approach_spectrum"}


@pytest.fixture(scope="module")
def terrain(spark):
    return catalog.synthetic(spark)


@pytest.fixture(scope="module")
def bare(terrain):
    """The same tables without the closed form."""
    return catalog.stored(terrain.spark, terrain.path, terrain.cells)


@pytest.mark.parametrize("name", sorted(set(questions.SQL) - LONG))
def test_queries_match_the_closed_form(spark, compare, name):
    left, right = compare(spark, questions.QUERIES[name], questions.SQL[name], SF)
    assert left == right
    assert left


# --- tables


def test_another_seed_moves_the_houses_only(spark, terrain):
    other = catalog.synthetic(spark, seed=2)
    houses = lambda t: {(r["n"], r["e"]) for r in t.objects().where("model = 'home1ug_a'").collect()}
    assert len(houses(terrain)) == len(houses(other)) == 24 and not houses(terrain) & houses(other)
    near = lambda t: [r["distance"] for r in points.nearest(t, spark.createDataFrame([(1, 56000.0, 30000.0)], "id long, n double, e double"), "scenery", 3).collect()]
    assert near(terrain) != near(other)
    rows = lambda t: t.table("tiles").where("tile_r = 17").agg(F.bit_xor(F.xxhash64("tile_c", "height", "cover"))).first()[0]
    assert rows(terrain) == rows(other)
    with pytest.raises(ValueError):
        Form(size=60_000)


def test_scans_prune_by_tile_and_pool(terrain):
    plan = terrain.tiles((640, 700), (640, 700))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_r" in plan and "PushedFilters: [IsNotNull(tile_c)" in plan
    plan = terrain.objects()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "pool" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_terrain_without_closed_form_answers_by_its_raster(spark, terrain, bare):
    asked = spark.createDataFrame([(1, 56025.0, 30025.0), (2, 47010.0, 30005.0), (3, 100.0, 100.0)], "id long, n double, e double")
    exact = {r["id"]: r for r in points.ground(terrain, asked).collect()}
    raster = {r["id"]: r for r in points.ground(bare, asked).collect()}
    assert raster[3]["height"] is None and exact[3]["height"] is None
    for i in (1, 2):
        assert abs(raster[i]["height"] - exact[i]["height"]) < 3 and raster[i]["cover"] == exact[i]["cover"]
    pairs = spark.createDataFrame([(1, 42000.0, 30000.0, 2.0, 50000.0, 30000.0, 2.0), (2, 42000.0, 30000.0, 2.0, 50000.0, 30000.0, 5000.0)], "id long, n1 double, e1 double, a1 double, n2 double, e2 double, a2 double")
    for t in (terrain, bare):
        assert {r["id"]: r["visible"] for r in sight.visible(t, pairs).collect()} == {1: False, 2: True}


def test_unknown_layers_and_too_many_points_are_errors(terrain):
    with pytest.raises(ValueError, match="no layer"):
        windows.layers(terrain, ["nope"], (900, 910), (600, 610))
    with pytest.raises(ValueError, match="more than"):
        points.lattice(terrain, S.Box(45000, 30000, 46000, 31000), 10, 100)
    assert points.lattice(terrain, S.Circle(45000, 30000, 100), 100, 100).count() == 5


# --- kernels


def block_of(form, row, col, rows, cols):
    r0, c0 = row // 64, col // 64
    tiles = [(i, j, *form.tile(i, j).values()) for i in range(r0, (row + rows) // 64 + 1) for j in range(c0, (col + cols) // 64 + 1)]
    return R.Block.from_tiles(tiles, row, col, rows, cols, form)


def test_distances_match_brute_force():
    r = np.random.default_rng(1)
    seeds = r.random((30, 40)) < 0.02
    at = np.argwhere(seeds)
    want = np.array([[min(math.hypot(i - a, j - b) for a, b in at) * CELL for j in range(40)] for i in range(30)])
    assert np.allclose(R.distance(seeds, 700), np.minimum(want, 700))
    assert (R.distance(np.zeros((5, 5), bool), 700) == 700).all()


def test_blocking_point_lies_on_the_line_and_the_ground():
    form = Form()
    block = R.Block(0, 0, *(np.zeros((0, 0)),) * 4, form)
    seen, gap, at = R.exact_line(block, (42000.0, 30000.0, 430.0), (50000.0, 30000.0, 480.0))
    assert not seen and gap < 0
    assert abs(430 + (at[0] - 42000) / 8000 * 50 - at[2]) < 0.01 and abs(form.height(np.array(at[0]), np.array(at[1])) - at[2]) < 0.01
    low = R.exact_floor(block, (42000.0, 30000.0, 430.0), (50000.0, 30000.0))
    assert R.exact_line(block, (42000.0, 30000.0, 430.0), (50000.0, 30000.0, low))[0] and not R.exact_line(block, (42000.0, 30000.0, 430.0), (50000.0, 30000.0, low - 0.01))[0]
    assert R.exact_floor(block, (46000.0, 30000.0, 10.0), (50000.0, 30000.0)) == math.inf
    assert R.exact_line(block, (100.0, 100.0, 5.0), (900.0, 100.0, 5.0))[0]


def test_viewshed_is_floor_below_target_and_masks_pack_it(spark, terrain):
    import base64

    site = spark.createDataFrame([(7, 47007.0, 38013.0, 15.0, 1500.0)], "id long, n double, e double, a double, radius double")
    floor = {(r["r"], r["c"]): r["floor_agl"] for r in sight.radar_floor(terrain, site).collect()}
    seen = {(r["r"], r["c"]): r["seen"] for r in sight.viewshed(terrain, site.withColumn("target", F.lit(30.0))).collect()}
    assert seen == {k: round(v, 3) <= 30 for k, v in floor.items()}
    m = sight.mask(terrain, site.withColumn("target", F.lit(30.0)), 0.0).first()
    bits = np.unpackbits(np.frombuffer(base64.b64decode(m["bits"]), np.uint8))[: m["rows"] * m["cols"]].reshape(m["rows"], m["cols"])
    assert {(int(r) + m["row"], int(c) + m["col"]) for r, c in np.argwhere(bits)} == {k for k, v in seen.items() if v}
    assert m["visible_fraction"] == pytest.approx(sum(seen.values()) / len(seen))
    assert {f["geometry"]["type"] for f in json.loads(m["polygons"])["features"]} == {"Polygon"}


def test_blind_arcs_close_over_north(spark):
    flags = [True, True, False, False, True, False, True, True]
    rows = [(1, 30.0, 45.0 * k, None, 0.0, b) for k, b in enumerate(flags)]
    df = spark.createDataFrame(rows, "id long, alt_agl double, bearing_deg double, unmask_dist double, masked_fraction double, blind boolean")
    got = sorted((r["from_deg"], r["to_deg"], r["radials"]) for r in sight.blind_arcs(df).collect())
    assert got == [(180.0, 180.0, 1), (270.0, 45.0, 4)]
    assert sight.spectrum_summary(df).first()["arcs"] == 2


def test_point_floor_agrees_with_visibility(spark, terrain):
    r = random.Random(3)
    rows = [(i, 46000.0 + r.uniform(-4000, 4000), 32000.0 + r.uniform(-4000, 4000), 10.0, 46000.0 + r.uniform(-4000, 4000), 32000.0 + r.uniform(-4000, 4000)) for i in range(20)]
    asks = spark.createDataFrame(rows, "id long, n double, e double, a double, pn double, pe double")
    low = {x["id"]: x["floor_agl"] for x in sight.point_floor(terrain, asks).collect()}
    pairs = spark.createDataFrame([(10 * i + k, n, e, a, pn, pe, max(low[i] + d, 0.0)) for i, n, e, a, pn, pe in rows for k, d in ((0, 0.001), (1, -0.5)) if low[i] + d >= 0], "id long, n1 double, e1 double, a1 double, n2 double, e2 double, a2 double")
    assert all(x["visible"] == (x["id"] % 10 == 0) for x in sight.visible(terrain, pairs).collect())


# --- mesh


def test_routes_are_seen_as_their_samples_are(spark, terrain):
    k = 47018  # its sample at 5500 m grazes the ground, 0.05 to 0.1 mm below it
    n, e = 40000.0 + k * 7919 % 14000 + 7, 25000.0 + k * 104729 % 16000 + 13
    route = [(n - 4000, e + 1500, 20.0), (n + 4500, e - 2500, 60.0)]
    asked = spark.createDataFrame([(1, n, e, 15.0, route), (2, 100.0, 100.0, 15.0, route)], "id long, n double, e double, a double, route array<struct<n:double,e:double,a:double>>")
    runs = sorted(sight.unmask(terrain, asked).collect(), key=lambda r: (r["id"], r["run"]))
    at = sight.samples(route, 100.0)
    lines = spark.createDataFrame([(i, n, e, 15.0, *p[1:]) for i, p in enumerate(at)], "id long, n1 double, e1 double, a1 double, n2 double, e2 double, a2 double")
    want = {r["id"]: r["visible"] for r in sight.visible(terrain, lines).collect()}
    assert [r["visible"] for r in runs if r["id"] == 1 for _ in range(r["samples"])] == [want[i] for i in range(len(at))]
    assert [(r["visible"], r["samples"]) for r in runs if r["id"] == 2] == [(False, len(at))]


def test_mesh_lines_by_sampling(spark):
    """A roof of four triangles with a higher-ranked strip across it, against heights sampled by hand."""
    corners = [(0.0, 0.0, 0.0), (0.0, 300.0, 30.0), (300.0, 300.0, 90.0), (300.0, 0.0, 60.0)]
    top = (150.0, 150.0, 200.0)
    rows = [(i, 0, *corners[i], *corners[(i + 1) % 4], *top) for i in range(4)]
    rows += [(10, 5, 100.0, 0.0, 20.0, 100.0, 300.0, 20.0, 140.0, 300.0, 20.0), (11, 5, 100.0, 0.0, 20.0, 140.0, 300.0, 20.0, 140.0, 0.0, 20.0)]
    tri = spark.createDataFrame(rows, "tri long, rank long, n1 double, e1 double, h1 double, n2 double, e2 double, h2 double, n3 double, e3 double, h3 double")

    def height(n, e):
        best = None
        for t in rows:
            (n1, e1, h1), (n2, e2, h2), (n3, e3, h3) = t[2:5], t[5:8], t[8:11]
            m = np.array([[n1, n2, n3], [e1, e2, e3], [1, 1, 1]])
            w = np.linalg.solve(m, [n, e, 1])
            if w.min() >= -1e-9 and (best is None or t[1] >= best[0]):
                best = (t[1], float(w @ [h1, h2, h3]))
        return None if best is None else best[1]

    r = random.Random(12)
    at = [(i, r.uniform(-20, 320), r.uniform(-20, 320)) for i in range(60)]
    got = {x["id"]: x["height"] for x in mesh.ground(tri, spark.createDataFrame(at, "id long, n double, e double")).collect()}
    assert all((got[i] is None) == (height(n, e) is None) and (got[i] is None or got[i] == pytest.approx(height(n, e))) for i, n, e in at)
    pairs = [(i, r.uniform(-50, 350), r.uniform(-50, 350), r.uniform(20, 250), r.uniform(-50, 350), r.uniform(-50, 350), r.uniform(20, 250)) for i in range(25)]
    df = spark.createDataFrame(pairs, "id long, n1 double, e1 double, alt1 double, n2 double, e2 double, alt2 double")
    seen = {x["id"]: x for x in mesh.visible(tri, df).collect()}
    tops = {x["id"]: x["height"] for x in mesh.highest(tri, df).collect()}
    for i, n1, e1, a1, n2, e2, a2 in pairs:
        t = np.linspace(0, 1, 1201)
        g = [height(n1 + (n2 - n1) * x, e1 + (e2 - e1) * x) for x in t]
        known = [(a1 + (a2 - a1) * x - h, h) for x, h in zip(t, g, strict=True) if h is not None]
        if not known:
            assert seen[i]["visible"] and i not in tops
            continue
        low = min(k[0] for k in known)
        assert seen[i]["clearance"] <= low + 1e-6 and seen[i]["clearance"] > low - 2.5 and tops[i] >= max(k[1] for k in known) - 1e-6
        if abs(low) > 2.5:
            assert seen[i]["visible"] == (low > 0)
        if not seen[i]["visible"]:
            h = height(seen[i]["block_n"], seen[i]["block_e"])
            assert h is None or abs(h - seen[i]["block_h"]) < 190


# --- off road


def touched(a, b):
    """Cells that a segment comes within a hair of, with the metres run in each, by dense sampling."""
    n = 20_001
    t = (np.arange(n) + 0.5) / n
    at = np.stack([a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t], 1)
    size = math.dist(a, b)
    cells = {}
    for c, k in zip(*np.unique(np.floor(at / CELL).astype(int), axis=0, return_counts=True), strict=True):
        cells[tuple(c.tolist())] = k / n * size
    for d in itertools.product((-0.01, 0.01), repeat=2):
        for c in np.unique(np.floor((at + d) / CELL).astype(int), axis=0):
            cells.setdefault(tuple(c.tolist()), 0.0)
    return cells


def test_moves_cross_the_cells_that_sampling_finds():
    for (a, b), cells in zip(offroad.MOVES, offroad.crossings(), strict=True):
        want = touched((25.0, 25.0), (25.0 + a * CELL, 25.0 + b * CELL))
        got = {(r, c): m for r, c, m in cells}
        assert set(got) == set(want)
        assert all(abs(got[c] - want[c]) < 0.1 for c in got)


def test_ways_match_relaxation_and_never_leap_walls():
    rng = np.random.default_rng(3)
    moves = [((a, b), touched((25.0, 25.0), (25.0 + a * CELL, 25.0 + b * CELL))) for a, b in offroad.MOVES]
    for _ in range(8):
        cost = rng.uniform(1, 3, (9, 9))
        cost[rng.random((9, 9)) < 0.2] = np.inf
        cost[4, 4], road = 1, rng.random((9, 9)) < 0.08
        road[4, 4] = False
        passage = np.where(road & np.isinf(cost), 1.0, cost)
        best = np.full((9, 9), np.inf)
        best[4, 4] = 0
        for _ in range(40):
            for r, c in itertools.product(range(9), repeat=2):
                if np.isinf(best[r, c]) or road[r, c]:
                    continue
                for (a, b), cells in moves:
                    if not (0 <= r + a < 9 and 0 <= c + b < 9):
                        continue
                    if any(np.isinf(passage[r + i, c + j]) or (m > 0.1 and road[r + i, c + j] and (i, j) != (a, b)) for (i, j), m in cells.items()):
                        continue
                    best[r + a, c + b] = min(best[r + a, c + b], best[r, c] + sum(m * passage[r + i, c + j] for (i, j), m in cells.items()))
        want = best[road].min() if road.any() else np.inf
        assert offroad.search(offroad.Ground(cost, road), 4, 4)[0] == pytest.approx(want, rel=1e-3)

    cost, road = np.ones((9, 9)), np.zeros((9, 9), bool)
    cost[:, 5], road[4, 8] = np.inf, True
    assert offroad.search(offroad.Ground(cost, road), 4, 4)[0] == math.inf


def test_ways_leave_the_first_disk_and_straighten():
    cost, road = np.ones((401, 401)), np.zeros((401, 401), bool)
    cost[140:261, 203:205] = np.inf
    road[200, 210] = True
    total, turns, reach = offroad.way(cost, road, 10_025.0, 10_025.0, 20_000.0)
    plain, cells, _ = offroad.search(offroad.Ground(cost, road), 200, 200)
    assert reach > offroad.FIRST_REACH and 5000 < total <= plain and len(turns) < len(cells)
    ground = offroad.Ground(cost, road)
    assert sum(ground.line(a, b, (int(b[0] // CELL), int(b[1] // CELL))) for a, b in itertools.pairwise(turns)) == pytest.approx(total)
    assert offroad.way(cost, road, 10_025.0, 10_025.0, 1500.0)[0] == math.inf


def test_costs_are_the_inverse_of_speed():
    form = Form()
    block = block_of(form, 380, 1190, 60, 60)  # the field's north edge
    cost = offroad.cost_field(block, 20.0)
    slope = R.slope_layers(block.h)["slope"]
    flat = cost * (1 - 0.75 * (slope / 20) ** 2)
    field, plain = (block.cover == COVER["field"]) & ~np.isnan(slope), (block.cover == COVER["plain"]) & ~np.isnan(slope)
    assert field.any() and plain.any() and np.allclose(flat[field], 1.25) and np.allclose(flat[plain], 1.0)
    steep = R.Block(0, 0, np.add.outer(np.zeros(5), np.arange(5) * CELL * math.tan(math.radians(20))), np.zeros((5, 5), int), np.ones((5, 5), int), np.full((5, 5), COVER["forest"]))
    exact = R.slope_layers(steep.h)["slope"][2, 2]
    assert offroad.cost_field(steep, exact)[2, 2] == pytest.approx(16.0) and np.isinf(offroad.cost_field(steep, exact - 1e-6)[2, 2])


def test_trafficability_reports_ways_and_reasons(spark, terrain):
    asked = spark.createDataFrame([(1, 56000.0, 20000.0), (2, 13000.0, 52000.0), (3, 30000.0, 10000.0), (4, 500.0, 500.0)], "id long, n double, e double")
    got = {r["id"]: r for r in offroad.trafficability(terrain, asked).collect()}
    assert got[1]["reachable"] and got[1]["road_n"] == 55025.0 and got[1]["cost"] >= got[1]["straight_distance"] - 1e-6
    assert [got[i]["reason"] for i in (2, 3, 4)] == ["the start lies in a lake", "the start lies in the sea", "the start lies in no ground"]
    with pytest.raises(ValueError):
        offroad.trafficability(terrain, asked, max_slope=0)


# --- networks


def random_network(seed, nodes=14):
    r = random.Random(seed)
    at = [(r.uniform(0, 9000), r.uniform(0, 9000)) for _ in range(nodes)]
    pairs = {(i, i + 1) for i in range(nodes - 1)} | {tuple(sorted(r.sample(range(nodes), 2))) for _ in range(nodes)}
    edges = {k: network.Edge(k, a, b, math.dist(at[a], at[b]), [(*at[a], 0.0), (*at[b], 10.0)]) for k, (a, b) in enumerate(sorted(pairs))}
    net = network.Network(edges)
    net.passes = {(n, e): [f for f in mine if f != e] for n, mine in net.at.items() for e in mine}
    return net


def test_routes_match_floyd_and_warshall():
    for seed in range(6):
        net = random_network(seed)
        n = max(max(e.a, e.b) for e in net.edges.values()) + 1
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0)
        for e in net.edges.values():
            d[e.a, e.b] = d[e.b, e.a] = min(d[e.a, e.b], e.length)
        for k in range(n):
            d = np.minimum(d, d[:, k, None] + d[None, k])
        r = random.Random(seed)
        for _ in range(30):
            (e, s), (f, t) = ((r.choice(list(net.edges)), r.random()) for _ in range(2))
            a, b = net.edges[e], net.edges[f]
            ends = [(a.a, s * a.length), (a.b, (1 - s) * a.length)], [(b.a, t * b.length), (b.b, (1 - t) * b.length)]
            want = min(x + d[u, v] + y for u, x in ends[0] for v, y in ends[1])
            if e == f:
                want = min(want, abs(s - t) * a.length)
            found = net.search((e, s), (f, t), lambda _: 1.0)
            assert found.cost == pytest.approx(want) and net.length(found) == pytest.approx(want)
            line = [p for part in net.lines(found) for p in part]
            assert all(math.dist(p[:2], q[:2]) < 9000 for p, q in itertools.pairwise(line))


def test_turns_that_are_not_listed_are_not_taken():
    line = lambda a, b: [(*a, 0.0), (*b, 0.0)]
    at = {1: (0.0, 0.0), 2: (100.0, 0.0), 3: (100.0, 100.0), 4: (200.0, 0.0), 5: (200.0, 100.0)}
    ends = [(1, 2), (2, 3), (2, 4), (4, 5), (5, 3)]
    net = network.Network({k: network.Edge(k, a, b, 100.0, line(at[a], at[b])) for k, (a, b) in enumerate(ends)})
    net.passes = {(n, e): [f for f in mine if f != e] for n, mine in net.at.items() for e in mine}
    assert net.search((0, 0.0), (1, 1.0), lambda _: 1.0).cost == 200
    net.passes[2, 0] = [2]  # no turn from the first edge into the second
    found = net.search((0, 0.0), (1, 1.0), lambda _: 1.0)
    assert found.cost == 400 and [e for e, _, _ in found.pieces] == [0, 2, 3, 4]
    assert net.search((0, 0.0), (1, 1.0), lambda _: 1.0, lambda e, a, b: e != 3) is None


def test_alternatives_keep_their_promises():
    for seed in range(4):
        net = random_network(seed, 20)
        kept = network.alternatives(net, (0, 0.0), (max(net.edges), 1.0), lambda _: 1.0, 4, 1.8, 0.6)
        sizes = [net.length(f) for f in kept]
        assert sizes[0] == min(sizes) and all(s <= 1.8 * sizes[0] + 1e-9 for s in sizes)
        for x, y in itertools.combinations(kept, 2):
            assert net.shared(x, y) <= 0.6 * min(net.length(x), net.length(y)) + 1e-9


def test_betweenness_counts_every_shortest_path():
    net = random_network(9, 9)
    for e in net.edges.values():
        e.length = float(round(e.length / 3000) + 1)  # many ties
    nodes = network.largest(net)
    want = dict.fromkeys(net.edges, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, best = [], math.inf
        stack = [(s, 0.0, (), (s,))]
        while stack:
            v, d, used, seen = stack.pop()
            if v == t:
                if d < best - 1e-9:
                    paths, best = [], d
                if abs(d - best) < 1e-9:
                    paths.append(used)
                continue
            for e in net.at[v]:
                w = net.edges[e].b if net.edges[e].a == v else net.edges[e].a
                if w not in seen and d + net.edges[e].length <= best + 1e-9:
                    stack.append((w, d + net.edges[e].length, (*used, e), (*seen, w)))
        for p in paths:
            for e in p:
                want[e] += 1 / len(paths)
    got = dict.fromkeys(net.edges, 0.0)
    for s in nodes:
        for e, v in network.brandes(net, s).items():
            got[e] += v
    assert got == pytest.approx(want)


def test_profiles_and_waypoints():
    at = [(0.0, 100.0), (25.0, 101.0), (50.0, 105.0), (75.0, 104.0), (100.0, 104.0), (125.0, 114.0)]
    assert network.climb(at) == (15.0, 1.0)
    assert network.steepest(at) == pytest.approx(13.0) and network.steepest([(0.0, 0.0), (50.0, 5.0)]) == pytest.approx(10.0)
    line = [[(0.0, 0.0, 0.0), (300.0, 0.0, 0.0), (700.0, 0.0, 0.0), (900.0, 0.0, 0.0)], [(900.0, 0.0, 0.0), (900.0, 50.0, 0.0)]]
    assert network.waypoints(line) == [(0.0, 0.0), (700.0, 0.0), (900.0, 0.0), (900.0, 50.0)]
    assert [d for d, _ in network.profile([[(0.0, 0.0, 0.0), (60.0, 0.0, 6.0)]], None)] == [0.0, 25.0, 50.0, 60.0]
    edge = network.Edge(1, 1, 2, 100.0, [(0.0, 0.0, 0.0), (50.0, 0.0, 0.0), (50.0, 50.0, 0.0)])
    assert [p[:2] for p in edge.piece(0.75, 0.25)] == [(50.0, 25.0), (50.0, 0.0), (25.0, 0.0)]


def test_avoided_regions_and_the_bridge(spark, terrain):
    asked = spark.createDataFrame([(1, 55025.0, 30000.0, 55025.0, 50000.0)], "id long, n1 double, e1 double, n2 double, e2 double")
    free = network.route(terrain, asked).first()
    assert free["length"] == pytest.approx(20_000) and free["edges"][0] == 0 and free["max_grade"] >= 0 and free["ascent"] >= 0
    round_ = network.route(terrain, asked, avoid=(S.Box(54000, 35000, 55500, 36000),)).first()
    assert round_["length"] == pytest.approx(24_000) and 11 in round_["edges"]
    assert network.route(terrain, asked, avoid=(S.Circle(55025, 45000, 50),)).first()["reason"] == "no route"
    kept = network.route_alternatives(terrain, asked, max_overlap=0.9).orderBy("rank").collect()
    assert [r["rank"] for r in kept] == [1, 2] and kept[1]["stretch"] == pytest.approx(1.2) and 3 in kept[0]["shared_edges"]
    west = network.chokepoints(terrain, region=S.Box(54000, 4000, 56000, 20000)).collect()
    assert [r["edge_id"] for r in west] == [0]


def test_chains_of_straight_pieces_contract(terrain):
    got = {tuple(r["pieces"]): (r["a"], r["b"], r["length"]) for r in network.contracted(terrain).collect()}
    assert got[(2, 3, 4)] == (10, 13, 14_500.0) and len(got) == 11


def test_exposure_of_edges(spark, terrain):
    share = lambda height: {r["edge_id"]: r["exposure"] for r in network.exposure_by_edge(terrain, "road", spark.createDataFrame([(47000.0, 32525.0, height)], "n double, e double, a double")).collect()}
    low, high = share(5.0), share(9000.0)
    assert len(low) == 13 and all(0 <= v <= 1 for v in low.values()) and min(low.values()) < 1 and set(high.values()) == {1.0}
    asked = spark.createDataFrame([(1, 55025.0, 30000.0, 57025.0, 40525.0)], "id long, n1 double, e1 double, n2 double, e2 double")
    assert network.route(terrain, asked, exposure={7: 1.0, 11: 1.0}, exposure_weight=5.0).first()["edges"] == [0, 1, 12]


# --- geometry


def test_regions_agree_with_sampling(spark):
    r = random.Random(5)
    star = S.Polygon(((0.0, 0.0), (10.0, 4.0), (0.0, 9.0), (7.0, -2.0), (6.0, 11.0)))
    regions = [S.Box(2, 2, 8, 7), S.Circle(5, 5, 3), S.Ring(5, 5, 2, 4), star]
    at = np.array([(r.uniform(-1, 11), r.uniform(-3, 12)) for _ in range(400)])
    df = spark.createDataFrame([(float(n), float(e)) for n, e in at], "n double, e double")
    for g in regions:
        held = g.contains(at[:, 0], at[:, 1])
        assert held.sum() == df.where(g.condition(F.col("n"), F.col("e"))).count() > 0
        for a, b in zip(at[:60], at[60:120], strict=True):
            t = np.linspace(0, 1, 2001)
            line = g.contains(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            assert line.any() <= g.meets(tuple(a), tuple(b))
            if g.meets(tuple(a), tuple(b)):
                grown = [np.abs(line).any()] + [g.contains(a[0] + t * (b[0] - a[0]) + x, a[1] + t * (b[1] - a[1]) + y).any() for x, y in itertools.product((-0.02, 0.02), repeat=2)]
                assert any(grown)
    # the crossing number by an independent rule: the winding of a dense walk about the point
    for n, e in at[:80]:
        inside = False
        pts = list(star.points)
        for i in range(len(pts)):
            (n0, e0), (n1, e1) = pts[i], pts[i - 1]
            if min(n0, n1) < n <= max(n0, n1) and e0 + (n - n0) / (n1 - n0) * (e1 - e0) < e:
                inside = not inside
        assert inside == star.contains(np.array([n]), np.array([e]))[0]


def test_shapes_meet_by_distance():
    a = S.turned_box(0, 0, 10, 4, math.radians(30))
    assert a.distance(a) == 0 and a.meets(S.Shape(((0.0, 0.0),)))
    b = S.turned_box(20, 0, 10, 4, 0)
    r = random.Random(2)
    inside = lambda s: [(sum(w * c[0] for w, c in zip(ws, s.corners, strict=True)) / sum(ws), sum(w * c[1] for w, c in zip(ws, s.corners, strict=True)) / sum(ws)) for ws in [[r.expovariate(1) for _ in s.corners] for _ in range(3000)]]
    assert a.distance(b) <= min(math.dist(p, q) for p, q in zip(inside(a), inside(b), strict=True))
    assert S.Shape(((0.0, 0.0),), 5.0).distance(S.Shape(((8.0, 0.0),), 2.0)) == pytest.approx(1.0)
    assert S.Shape(((0.0, 0.0),), 5.0).meets(S.Shape(((7.0, 0.0),), 2.0)) and not S.Shape(((0.0, 0.0),), 5.0).meets(S.Shape(((7.1, 0.0),), 2.0))
    assert S.covered_cells(S.turned_box(50, 50, 20, 20, 0)) == [(0, 0), (0, 1), (1, 0), (1, 1)] and S.covered_cells(S.turned_box(25, 25, 50, 50, 0)) == [(0, 0)]


def test_outlines_hold_their_cells():
    r = random.Random(4)
    for _ in range(20):
        cells = {(r.randrange(8), r.randrange(8)) for _ in range(30)}
        drawn = S.outlines(cells)
        assert sum(S.ring_area(ring) for p in drawn for ring in p) == len(cells) * CELL * CELL
        for i, j in itertools.product(range(8), repeat=2):
            at = np.array([(i + 0.5) * CELL]), np.array([(j + 0.5) * CELL])
            held = any(S.Polygon(tuple(p[0])).contains(*at)[0] and not any(S.Polygon(tuple(h)).contains(*at)[0] for h in p[1:]) for p in drawn)
            assert held == ((i, j) in cells)
    ring = S.ring_of(0, 0, 1000, 200)
    thin = S.simplified(ring, 20)
    assert 4 < len(thin) < 40 and all(min(S.point_segment(p, a, b) for a, b in zip(thin, thin[1:] + thin[:1], strict=True)) <= 20 for p in ring)
    assert len(S.wedge(0, 0, 10, 350, 10)) == 12


def test_grid_references_and_bearings(spark):
    rows = [(0.0, 0.0), (45.40281018, 33.9521594), (-33.5, 151.2), (60.5, 5.5), (78.0, 15.0), (84.5, 10.0), (-81.0, 10.0), (83.9, -179.99)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    m = P.Staged(df)
    got = [r["g"] for r in m.done(g=P.mgrs(F.col("lat"), F.col("lon"), m)).collect()]
    assert got[0] == "31N AA 66021 00000" and got[5] is None and got[6] is None and got[3].startswith("32V") and got[4].startswith("33X")
    for (lat, lon), text in zip(rows, got, strict=True):
        if text:
            a, b, side = P.parse_mgrs(text)
            assert side == 1 and abs(a - lat) < 2e-5 and abs(b - lon) * math.cos(math.radians(lat)) < 2e-5
            assert P.parse_mgrs(text.replace(" ", "").lower())[:2] == (a, b)
    for bad in ("", "61N AA 1 1", "31N AA 123", "31N ZZ 1 1", "31I AA 1 1"):
        with pytest.raises(ValueError):
            P.parse_mgrs(bad)
    b = lambda *a: float(P.true_bearing(*(np.float64(x) for x in a), P.ARRAYS))
    assert b(0, 0, 1, 0) == pytest.approx(0, abs=1e-9) and b(0, 0, 0, 1) == pytest.approx(90) and b(45, 10, 44, 10) == pytest.approx(180) and 89 < b(45, 10, 45, 11) < 90


# --- sites


def terms(spark, terrain, n, e, *criteria, **options):
    row = sites.score_sites(terrain, spark.createDataFrame([(1, n, e)], "id long, n double, e double"), list(criteria), **options).first()
    return [(v, p, round(s, 6)) for v, p, s in zip(row["values"], row["passes"], row["scores"], strict=True)][1:]


def test_every_criterion(spark, terrain):
    n, e = 56025.0, 30025.0  # in the town
    got = terms(
        spark, terrain, n, e,
        {"name": "surface_in", "classes": ["land"]}, {"name": "surface_enum_in", "values": [1, 4]}, {"name": "cover_in", "classes": ["plain", "field"]}, {"name": "cover_fraction_min", "class": "town", "radius": 300.0, "min": 0.9},
        {"name": "dist_road_band", "min": 0.0, "max": 2000.0}, {"name": "dist_rail_band", "min": 3000.0, "max": 5000.0}, {"name": "dist_cover_band", "class": "town", "min": 0.0, "max": 100.0}, {"name": "dist_water_min", "m": 1000.0},
        {"name": "dist_airdrome_band", "min": 0.0, "max": 20000.0}, {"name": "dist_airdrome_band", "min": 0.0, "max": 20000.0, "airdrome": "nowhere"}, {"name": "scenery_max", "class": "building", "radius": 2000.0, "max": 30}, {"name": "clearing_max", "radius": 2000.0, "max": 10},
        {"name": "scenery_in_footprint_max", "max": 0}, {"name": "span_max", "m": 5.0}, {"name": "slope_band", "min": 0.0, "max": 2.0}, {"name": "tpi_class_in", "classes": ["flat"]},
    )
    assert got[0][1:] == (True, 1) and got[1][1:] == (True, 1) and got[2] == (0, False, 0) and got[3] == (1, True, 1)
    assert got[4] == (1000, True, 0.5) and got[5] == (4000, True, 0.5) and got[6] == (0, True, 1) and got[7][1:] == (True, 1)
    assert got[8][0] == pytest.approx(math.hypot(4000, 10025)) and got[8][1] and got[9][0] == math.inf and got[9][1:] == (False, 0)
    assert got[10] == (24, True, 0.2) and got[11][0] >= 24 and not got[11][1] and got[11][2] == 0
    assert got[13][0] >= 0 and got[14][0] < 1.5 and got[15] == (5, True, 1)
    with pytest.raises(ValueError, match="no criterion"):
        sites.checked([{"name": "nope"}])


def test_footprints_turn_and_meet_objects(spark, terrain):
    house = terrain.objects().where("model = 'home1ug_a'").orderBy("id").first()
    near = dict(n=house["n"], e=house["e"] + 40)
    inside = {"name": "scenery_in_footprint_max", "max": 0}
    flat, turned = (terms(spark, terrain, near["n"], near["e"], inside, footprint=(100.0, 10.0), orientations=(deg,))[0] for deg in (0.0, 90.0))
    assert flat[0] >= 1 and not flat[1] and turned[0] < flat[0]
    water = sites.score_sites(terrain, spark.createDataFrame([(1, 13000.0, 52000.0), (2, 30000.0, 10000.0)], "id long, n double, e double"), []).orderBy("id").collect()
    assert [r["pass"] for r in water] == [True, False]


def test_sightlines_and_horizons_as_criteria(spark, terrain):
    behind, before = (50_000.0, 30_000.0, 2.0), (42_000.0, 30_000.0, 2.0)
    got = terms(spark, terrain, 42_500.0, 30_000.0, {"name": "not_visible_from", "observers": [behind, before], "max_fraction": 0.5}, {"name": "visible_to", "targets": [behind], "min_fraction": 0.5}, {"name": "masked_from", "bearing_deg": 0.0, "half_width_deg": 10.0, "min_elev_deg": 2.0}, {"name": "enclosure_min", "deg": 20.0})
    assert got[0] == (0.5, True, 0.5) and got[1] == (0, False, 0) and got[2][0] > 2 and got[2][1] and not got[3][1]
    assert sites.sector(0, 1) == [0] and sites.sector(358, 12) == [0, 31] and sites.sector(5, 1) == [0]
    assert [sites.landform(*x, 10) for x in ((11, 0, 0), (-11, 0, 0), (0, 11, 0), (0, -11, 0), (0, 0, 6), (0, 0, 5), (math.nan, 0, 0))] == [*sites.LANDFORMS, None]


def test_suppression_matches_brute_force(spark):
    r = random.Random(7)
    rows = [(i, float(r.randrange(40) * 50), float(r.randrange(40) * 50), round(r.random(), 2)) for i in range(300)]
    got = [(x["n"], x["e"]) for x in sites.spaced(spark.createDataFrame(rows, "id long, n double, e double, score double"), 300, 15).orderBy("rnk").collect()]
    want = []
    for _, n, e, _ in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if all(math.dist((n, e), k) >= 300 for k in want):
            want.append((n, e))
    assert got == want[:15]


def test_placements_of_every_kind(spark, terrain):
    schema = "id long, kind string, n double, e double, radius double, w double, d double, rotation double, points array<struct<n:double,e:double>>, afloat boolean, max_slope double, min_depth double, allow_forest boolean"
    rows = [
        (1, "disc", 42000.0, 56000.0, 60.0, None, None, None, None, False, None, None, False),
        (2, "disc", 42000.0, 56000.0, 60.0, None, None, None, None, False, None, None, True),
        (3, "box", 60025.0, 20000.0, None, 40.0, 40.0, 45.0, None, False, None, None, False),
        (4, "point", 13000.0, 52000.0, None, None, None, None, None, True, None, 20.0, False),
        (5, "polygon", 46000.0, 31000.0, None, None, None, None, [(45900.0, 30900.0), (46100.0, 30900.0), (46000.0, 31200.0)], False, 5.0, None, False),
        (6, "point", 50025.0, 20025.0, None, None, None, None, None, False, None, None, False),
        (7, "disc", 1990.0, 30000.0, 30.0, None, None, None, None, False, None, None, False),
        (8, "point", 30025.0, 25025.0, None, None, None, None, None, True, None, None, False),
    ]
    got = {r["id"]: r for r in sites.validate_placements(terrain, spark.createDataFrame(rows, schema)).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "forest", 2: "objects", 3: "pavement", 4: "shallow", 5: "slope", 6: "objects", 7: "no_ground", 8: "land"}
    assert got[2]["objects_met"] % 3 == 0 and got[2]["objects_met"] > 0 and got[4]["min_depth"] == pytest.approx(12.0) and got[5]["max_slope"] > 5


# --- places


def test_sizes_forms_and_roles(spark):
    rows = [(49, 1e9), (199, 1e9), (200, 4e5), (200, 5e5), (200, 3e6), (200, 2e7)]
    df = spark.createDataFrame(rows, "b long, f double").select(settlements.size_class(F.col("b"), F.col("f")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["hamlet", "village", "large_village", "town", "city", "large_city"]
    forms = spark.createDataFrame([(2, 10, 9e9), (1, 1000, 2499.0), (0, 999, 1.0)], "k long, b long, f double").select(settlements.form_of(F.col("k"), F.col("b"), F.col("f")).alias("x"))
    assert [r["x"] for r in forms.collect()] == ["agglomeration", "dispersed", "compact"]
    objects = [(1, "building", "house", 10.0, 10.0, 3.0), (2, "building", "farm", 10.0, 10.0, 3.0), (3, "industrial", "industrial", 400.0, 10.0, 9.0), (4, "building", "house", 7.0, 8.0, 3.0), (5, "building", "house", 10.0, 10.0, 1.9), (6, "misc", None, 10.0, 10.0, 3.0)]
    built = settlements.buildings(spark.createDataFrame([(i, c, f, 0.0, 0.0, w, d, t) for i, c, f, w, d, t in objects], "id long, class string, family string, n double, e double, w double, d double, tall double"))
    assert {r["id"]: (r["radius"], r["counts"], r["floor"]) for r in built.collect()} == {1: (5.0, True, 100.0), 3: (60.0, False, 12000.0)}


def test_links_and_places_match_brute_force(spark, terrain):
    r = random.Random(6)
    rows = [(i, r.uniform(0, 6000), r.uniform(0, 6000), r.uniform(5, 60), i % 7 != 0, 100.0) for i in range(150)]
    built = spark.createDataFrame(rows, "id long, n double, e double, radius double, counts boolean, floor double")
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if math.dist(a[1:3], b[1:3]) <= 200 + a[3] + b[3]}
    got = settlements.links(built)
    assert {(x["a"], x["b"]) for x in got.collect()} == want
    few = {x["node"]: x["component"] for x in components.connected_components(got).collect()}
    components.FEW, kept = 0, components.FEW
    many = {x["node"]: x["component"] for x in components.connected_components(got).collect()}
    components.FEW = kept
    assert few == many and few
    mine = settlements.members(terrain).cache()
    cells = {(x["place"], x["r"], x["c"]) for x in settlements.ground_cells(mine).collect()}
    houses = [x for x in mine.collect() if x["counts"]]
    want = {(h["place"], i, j) for h in houses for i in range(int(h["n"] // 50) - 5, int(h["n"] // 50) + 6) for j in range(int(h["e"] // 50) - 5, int(h["e"] // 50) + 6) if math.hypot((i + 0.5) * 50 - h["n"], (j + 0.5) * 50 - h["e"]) <= 100 + h["radius"]}
    assert cells == want
    drawn = settlements.outlines(mine, 0.0).collect()
    assert {x["place"]: x["area"] for x in drawn} == {p: 2500.0 * sum(c[0] == p for c in cells) for p in {c[0] for c in cells}}
    at = settlements.place_at(mine, spark.createDataFrame([(1, houses[0]["n"], houses[0]["e"]), (2, 9000.0, 9000.0)], "id long, n double, e double"))
    assert {x["id"]: x["place"] for x in at.collect()} == {1: houses[0]["place"], 2: None}


def test_towns_name_their_place(spark, terrain):
    houses = [(i, 100.0 * i, 0.0, 10.0, True, 100.0, 1 if i < 6 else 7) for i in range(10)]
    of = spark.createDataFrame(houses, "id long, n double, e double, radius double, counts boolean, floor double, place long")

    class Named:
        def table(self, name):
            return spark.createDataFrame([(0, "old", 100.0, 50.0), (1, "new", 200.0, 50.0), (2, "far", 9000.0, 0.0)], "ord long, name string, n double, e double")

    assert {r["place"]: r["names"] for r in settlements.names(Named(), of).collect()} == {1: ["old", "new"]}


def test_airfields_are_found_by_any_name(spark, terrain):
    for name in (1, "SYNTH", "synth field", "1"):
        assert airfields.find(terrain, name).first()["airdrome_id"] == 1
    assert airfields.find(terrain, "nowhere").count() == 0
    none = spark.createDataFrame([(None, 40.0), (40.0, None), (30.0, None)], "width double, length double").select(airfields.fits(35.0, 35.0).alias("x"))
    assert [r["x"] for r in none.collect()] == [None, None, False]
    assert airfields.stand_sizes(terrain).first()["stands"] == 4


def test_nearest_by_rings_equals_the_whole_table(spark, terrain, monkeypatch):
    r = random.Random(8)
    asked = spark.createDataFrame([(i, r.uniform(2000, 68000), r.uniform(2000, 68000)) for i in range(40)], "id long, n double, e double")
    for kind, n in (("scenery", 3), ("road", 2), ("town", 2)):
        whole = sorted((x["id"], x["rnk"], x["what"], round(x["distance"], 6)) for x in points.nearest(terrain, asked, kind, n).collect())
        monkeypatch.setattr(points, "FEW", 0)
        rings = sorted((x["id"], x["rnk"], x["what"], round(x["distance"], 6)) for x in points.nearest(terrain, asked, kind, n).collect())
        monkeypatch.undo()
        assert whole == rings
    places = settlements.places(terrain)
    assert points.nearest(terrain, asked, "place", 1, places=places).count() == 40
    with pytest.raises(ValueError):
        points.nearest(terrain, asked, "star")


# --- reference data


def test_a_projection_is_fitted(spark):
    crs = P.Mercator(33.0, 99517.0, 4998115.0)
    r = random.Random(3)
    rows = []
    for k in range(8):
        lat, lon = 44 + r.random(), 34 + 2 * r.random()
        x, z = (float(v) for v in crs.forward(np.float64(lat), np.float64(lon), P.ARRAYS))
        rows.append((x + (50 if k == 7 else 0), z, lat, lon))
    df = spark.createDataFrame(rows, "x double, z double, lat double, lon double")
    got = reference.fit_projection(df).first()
    assert (got["lon0"], got["n"]) == (33.0, 7) and got["easting"] == pytest.approx(99517, abs=1e-3) and got["northing"] == pytest.approx(4998115, abs=1e-3) and got["rms"] < 1e-3
    assert reference.fit_projection(df.limit(2)).count() == 0


def test_names_places_and_shares(spark, terrain):
    assert [x["name"] for x in reference.alike(terrain, "Tòwn 2").collect()][0] == "town_2" and reference.alike(terrain, "zzz").count() == 0
    at = spark.createDataFrame([(1, 60025.0, 20000.0), (2, 60025.0, 40000.0)], "id long, n double, e double")
    assert {x["id"]: x["airdrome_id"] for x in reference.airdrome_at(terrain, at).collect()} == {1: 1, 2: None}
    low, high = reference.wilson(F.col("h"), F.col("n"))
    w = spark.createDataFrame([(8, 10)], "h int, n int").select(low.alias("a"), high.alias("b")).first()
    assert w["a"] == pytest.approx(0.4901, abs=1e-3) and w["b"] == pytest.approx(0.9433, abs=1e-3)
    assert terrain.path in [p.removeprefix("file:") for p, _ in reference.terrains(spark)] or terrain.path.removeprefix("file:") in [p.removeprefix("file:") for p, _ in reference.terrains(spark)]


def test_zones_deciles_and_common_stretches(spark, terrain):
    zones = windows.zone_map(terrain, ["height"], (900, 1000), (600, 700)).collect()
    cells = terrain.grid((900, 1000), (600, 700)).collect()
    for z in zones:
        mine = [c["h"] for c in cells if c["r"] // 64 == z["tile_r"] and c["c"] // 64 == z["tile_c"]]
        assert (z["height_min"], z["height_max"]) == (min(mine), max(mine))
    top = network.top_decile(terrain).collect()
    assert {x["edge_id"] for x in top} <= {2, 3, 4} and top
    a, b = network.Found([(1, 0.2, 1.0), (2, 0.0, 1.0)]), network.Found([(1, 0.9, 0.0), (3, 0.0, 1.0)])
    assert network.shared_by_all([a, b]) == [(1, 0.2, 0.9)] and network.shared_by_all([]) == []


# --- batches


def test_lines_are_answered_in_isolation(spark, terrain, tmp_path):
    site = {"n": 47007, "e": 38013, "a": 15, "radius": 600}
    pair = {"n1": 55025, "e1": 30000, "n2": 55025, "e2": 50000}
    asked = [
        {"op": "sample", "n": 47000, "e": 30000, "layers": ["height", "slope"]}, {"op": "geo", "n": 47000, "e": 30000}, {"op": "to_grid", "lat": 45.4, "lon": 33.9}, {"op": "describe"},
        {"op": "nearest", "n": 56000, "e": 30000, "count": 2}, {"op": "nearest", "n": 56000, "e": 30000, "kind": "place"}, {"op": "point_info", "n": 56000, "e": 30000}, {"op": "visible", **pair, "a1": 5, "a2": 5},
        {"op": "viewshed", **site}, {"op": "radar_floor", **site}, {"op": "coverage", **site}, {"op": "approach_spectrum", **site, "bands": [30]}, {"op": "unmask_profile", "n": 47000, "e": 38000, "a": 5, "route": [{"n": 46000, "e": 36000, "a": 5}, {"n": 48000, "e": 37000, "a": 5}]},
        {"op": "exposure", "sites": [site], "target": 30}, {"op": "score_site", "n": 56000, "e": 30000, "criteria": [{"name": "slope_max", "deg": 8}]},
        {"op": "find_sites", "region": {"kind": "box", "south": 55000, "west": 30000, "north": 55400, "east": 30400}, "criteria": [{"name": "slope_max", "deg": 8}]},
        {"op": "route", **pair}, {"op": "route_alternatives", **pair}, {"op": "chokepoints", "limit": 3}, {"op": "trafficability", "n": 56000, "e": 20000}, {"op": "scenery_in", "n": 56000, "e": 30000, "radius": 900},
        {"op": "validate_placements", "n": 50025, "e": 20025}, {"op": "airfield_info", "width": 30}, {"op": "towns"}, {"op": "sample_region", "region": {"kind": "circle", "n": 47000, "e": 30000, "radius": 100}},
    ]
    bad = ["not json", '{"op":"nope"}', '{"op":"geo"}', '{"op":"geo","n":1,"e":2,"x":3}', "[]", '{"op":"nearest","n":1,"e":2,"kind":"star"}', '{"op":"sample","n":1,"e":2,"layers":["nope"]}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*map(json.dumps, asked), *bad]))
    batch.run_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), terrain)
    got = [json.loads(r["answer"]) for r in spark.read.json(str(tmp_path / "out")).orderBy("line").collect()]
    assert [g.get("op") for g in got] == [a["op"] for a in asked] + [None] * len(bad)
    assert all(g["result"] for g in got[: len(asked)])
    assert [g["issues"][0]["code"] for g in got[len(asked) :]] == ["invalid_json", "unknown_operation", "invalid_point", "unknown_field", "invalid_request", "invalid_request", "invalid_request"]
    assert {a["op"] for a in asked} == set(batch.OPERATIONS)


def test_a_stream_answers_files_once(spark, terrain, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"op":"geo","n":47000,"e":30000}\n{"op":"geo"}')
    for _ in range(2):
        batch.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "ck"), terrain).awaitTermination()
    assert spark.read.json(str(tmp_path / "stream")).count() == 2
