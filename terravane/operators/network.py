"""The road and rail graph: snapping, routes over listed passages, alternatives, betweenness.

Graph searches are sequential, so they run in Python, one request at a time.
Requests are dealt out by a salt and every share meets the whole network in one
cogrouped task, so nothing is gathered on the driver and requests scale out;
the network, a few hundred thousand edges at most, is what a task must hold.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R
from ..functions.shapes import Region
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL, RAIL, ROAD, Form
from .components import connected_components
from .windows import arrow_type, on_blocks

# Metres between samples of a profile, of the window of the steepest grade, between waypoints.
SAMPLE, GRADE_WINDOW, WAYPOINT = 25.0, 100.0, 500.0
#: Shares of requests that meet the network apart.
SHARES = 16
#: Height of a vehicle above ground, metres.
VEHICLE = 2.0
BETWEENNESS_SOURCES = 2000
KIND = {"road": ROAD, "rail": RAIL}


@dataclass
class Edge:
    id: int
    a: int
    b: int
    length: float
    line: list[tuple[float, float, float]]
    klass: str = ""

    def at(self, share: float) -> tuple[float, float, float]:
        return self.piece(0.0, share)[-1]

    def piece(self, start: float, stop: float) -> list[tuple[float, float, float]]:
        """The line between two shares of its length, backwards if ``stop`` is less."""
        if stop < start:
            return self.piece(stop, start)[::-1]
        sizes = [math.dist(p[:2], q[:2]) for p, q in zip(self.line, self.line[1:], strict=False)]
        total, done, out = sum(sizes) or 1.0, 0.0, []
        lo, hi = start * total, stop * total
        for p, q, size in zip(self.line, self.line[1:], sizes, strict=False):
            if size and done + size >= lo - 1e-9 and done <= hi + 1e-9:
                for at in (max(lo, done), min(hi, done + size)):
                    u = min(1.0, max(0.0, (at - done) / size))
                    here = tuple(x + u * (y - x) for x, y in zip(p, q, strict=True))
                    if not out or math.dist(out[-1][:2], here[:2]) > 1e-9:
                        out.append(here)
            done += size
        return out or [self.line[0]]


@dataclass
class Found:
    """A route: pieces as (edge, from share, to share), its cost."""

    pieces: list[tuple[int, float, float]]
    cost: float = 0.0


@dataclass
class Network:
    edges: dict[int, Edge]
    #: edge -> edges that may be taken from it at a node
    passes: dict[tuple[int, int], list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._segments: np.ndarray | None = None
        self.at: dict[int, list[int]] = defaultdict(list)
        for e in self.edges.values():
            self.at[e.a].append(e.id)
            if e.b != e.a:
                self.at[e.b].append(e.id)

    def snap(self, n: float, e: float) -> tuple[int, float, float]:
        """(edge, share along it, distance) of the nearest point of the network; ties go to the first edge."""
        if self._segments is None:
            rows = []
            for edge in self.edges.values():
                done = 0.0
                for p, q in zip(edge.line, edge.line[1:], strict=False):
                    size = math.dist(p[:2], q[:2])
                    rows.append((edge.id, p[0], p[1], q[0] - p[0], q[1] - p[1], size, done, edge.length or 1.0))
                    done += size
            self._segments = np.array(rows).T
        edge, pn, pe, dn, de, size, before, total = self._segments
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(size > 0, np.clip(((n - pn) * dn + (e - pe) * de) / (size * size), 0.0, 1.0), 0.0)
        gap = np.hypot(n - pn - t * dn, e - pe - t * de)
        k = int(gap.argmin())
        return int(edge[k]), min(1.0, float((before[k] + t[k] * size[k]) / total[k])), float(gap[k])

    def search(self, start: tuple[int, float], goal: tuple[int, float], price: Callable[[int], float], free: Callable[[int, float, float], bool] = lambda *_: True, bound: float = math.inf) -> Found | None:
        """The least-cost route between two places (edge, share), leaving a node only by a listed passage.

        ``price`` multiplies an edge's metres; ``free`` says whether a stretch of an
        edge may be used.  States are an edge with the end that it was left at; ties
        go to the lower edge.
        """
        (e0, s0), (e1, s1) = start, goal
        best: list[tuple[float, list[tuple[int, float, float]]]] = []
        if e0 == e1 and free(e0, s0, s1):
            best.append((abs(s1 - s0) * self.edges[e0].length * price(e0), [(e0, s0, s1)] if s0 != s1 else []))
        heap: list[tuple[float, int, int]] = []
        cost: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[int, int] | None] = {}
        for end, share in ((0, 0.0), (1, 1.0)):
            if free(e0, s0, share):
                d = abs(share - s0) * self.edges[e0].length * price(e0)
                if d < cost.get((e0, end), math.inf):
                    cost[e0, end], came[e0, end] = d, None
                    heapq.heappush(heap, (d, e0, end))
        done = set()
        limit = best[0][0] if best else math.inf
        last = None
        while heap:
            d, e, end = heapq.heappop(heap)
            if (e, end) in done:
                continue
            done.add((e, end))
            if d >= min(limit, bound):
                break
            node = self.edges[e].b if end else self.edges[e].a
            for f in self.passes.get((node, e), ()):
                if f not in self.edges:
                    continue
                edge = self.edges[f]
                enter = 0.0 if edge.a == node else 1.0
                if f == e1 and free(f, enter, s1):
                    total = d + abs(s1 - enter) * edge.length * price(f)
                    if total < limit:
                        limit, last = total, ((e, end), enter)
                out = 1 if enter == 0.0 else 0
                nd = d + edge.length * price(f)
                if nd < cost.get((f, out), math.inf) and free(f, enter, float(out)):
                    cost[f, out], came[f, out] = nd, (e, end)
                    heapq.heappush(heap, (nd, f, out))
        if last is None:
            return Found(best[0][1], best[0][0]) if best else None
        chain, at = [], last[0]
        while at is not None:
            chain.append(at)
            at = came[at]
        pieces = [(e0, s0, float(chain[-1][1]))] if abs(s0 - chain[-1][1]) > 0 else []
        for e, end in chain[-2::-1]:
            pieces.append((e, 1.0 - end, float(end)))
        if s1 != last[1]:
            pieces.append((e1, last[1], s1))
        return Found(pieces, limit)

    def length(self, found: Found) -> float:
        return sum(abs(b - a) * self.edges[e].length for e, a, b in found.pieces)

    def shared(self, x: Found, y: Found) -> float:
        """Metres of one route that another runs along too."""
        out = 0.0
        for e, a, b in x.pieces:
            for f, c, d in y.pieces:
                if e == f:
                    out += max(0.0, min(max(a, b), max(c, d)) - max(min(a, b), min(c, d))) * self.edges[e].length
        return out

    def lines(self, found: Found) -> list[list[tuple[float, float, float]]]:
        return [self.edges[e].piece(a, b) for e, a, b in found.pieces]


def profile(lines: list[list[tuple[float, float, float]]], form: Form | None) -> list[tuple[float, float]]:
    """(along, height) every ``SAMPLE`` metres and at the end: of the ground where there is a closed form, else between the line's own heights."""
    line = [lines[0][0], *(p for part in lines for p in part[1:])]
    steps = np.array([math.dist(p[:2], q[:2]) for p, q in zip(line, line[1:], strict=False)])
    along = np.concatenate([[0.0], np.cumsum(steps)])
    at = np.arange(0.0, along[-1] - 1e-6, SAMPLE)
    at = np.append(at, along[-1])
    n, e, h = (np.interp(at, along, [p[k] for p in line]) for k in range(3))
    if form is not None:
        h = form.land(n, e)
    return list(zip(at.tolist(), h.tolist(), strict=True))


def climb(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Metres climbed and descended."""
    rises = [b[1] - a[1] for a, b in zip(points, points[1:], strict=False)]
    return sum(r for r in rises if r > 0), -sum(r for r in rises if r < 0)


def steepest(points: list[tuple[float, float]]) -> float:
    """The steepest grade in percent between a sample and the first one at least ``GRADE_WINDOW`` ahead, or the last."""
    best, j = 0.0, 0
    for i, (at, h) in enumerate(points):
        while j < len(points) and points[j][0] - at < GRADE_WINDOW:
            j += 1
        k = min(j, len(points) - 1)
        run = points[k][0] - at
        if run > 0:
            best = max(best, abs(points[k][1] - h) / run * 100)
        if j == len(points):
            break
    return best


def waypoints(lines: list[list[tuple[float, float, float]]]) -> list[tuple[float, float]]:
    """Every node, and between nodes a point of the line each time ``WAYPOINT`` metres have passed."""
    out = [lines[0][0][:2]]
    for line in lines:
        since = 0.0
        for k, (p, q) in enumerate(zip(line, line[1:], strict=False)):
            since += math.dist(p[:2], q[:2])
            if k + 2 == len(line) or since >= WAYPOINT:
                if out[-1] != q[:2]:
                    out.append(q[:2])
                since = 0.0
    return out


def alternatives(net: Network, start: tuple[int, float], goal: tuple[int, float], price: Callable[[int], float], k: int = 3, max_stretch: float = 1.5, max_overlap: float = 0.5, penalty: float = 1.6, free: Callable = lambda *_: True) -> list[Found]:
    """Up to k routes apart from each other, by raising the price of edges used (at most four searches for each)."""
    first = net.search(start, goal, price, free)
    if first is None:
        return []
    kept, last, raised = [first], first, defaultdict(lambda: 1.0)
    reference = net.length(first)
    for _ in range(1, 4 * k):
        if len(kept) == k:
            break
        for e in {e for e, _, _ in last.pieces}:
            raised[e] *= penalty
        found = net.search(start, goal, lambda e: price(e) * raised[e], free)
        if found is None:
            break
        size = net.length(found)
        apart = all((s := net.shared(found, o)) <= max_overlap * size and s <= max_overlap * net.length(o) for o in kept)
        if size <= max_stretch * reference and apart and all(found.pieces != o.pieces for o in kept):
            kept.append(found)
        last = found
    return kept


def _network(rows: list[dict]) -> Network:
    edges = sorted((r for r in rows if r["from_edge"] is None), key=lambda r: r["edge_id"])
    net = Network({r["edge_id"]: Edge(r["edge_id"], r["a"], r["b"], r["length"], [(p["n"], p["e"], p["h"]) for p in r["points"]], r["class"]) for r in edges})
    listed: dict[tuple[int, int], list[int]] = defaultdict(list)
    for r in rows:
        if r["from_edge"] is not None:
            listed[r["node"], r["from_edge"]].append(r["to_edge"])
    net.passes = {k: sorted(v) for k, v in listed.items()}
    return net


def _with_network(terrain: Terrain, kind: str, requests: DataFrame, each: Callable[[Network, dict], list[dict]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of a request and the whole network."""
    k = KIND[kind]
    edges = terrain.table("edges").where(F.col("kind") == k).select("edge_id", "class", "a", "b", "length", "points")
    passes = terrain.table("passes").where(F.col("kind") == k).select("node", "from_edge", "to_edge")
    held = edges.unionByName(passes, allowMissingColumns=True).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    asked = requests.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
    names, plain = [f.split(maxsplit=1)[0] for f in schema.split(", ")], requests.columns
    kinds = pa.schema([(n, arrow_type(t)) for n, t in (f.split(maxsplit=1) for f in schema.split(", "))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in names}
        if left.num_rows and right.num_rows:
            net = _network(right.to_pylist())
            for q in left.select(plain).to_pylist():
                for r in each(net, q):
                    for n in names:
                        out[n].append(r.get(n))
        return pa.table(out, schema=kinds)

    return asked.groupBy("share").cogroup(held.groupBy("share")).applyInArrow(run, schema)


ROUTE = "id long, length double, cost double, ascent double, descent double, max_grade double, edges array<long>, waypoints long, snap_from double, snap_to double, reason string"


def route(terrain: Terrain, requests: DataFrame, network: str = "road", avoid: tuple[Region, ...] = (), exposure: dict[int, float] | None = None, exposure_weight: float = 1.0, max_detour: float = 3.0) -> DataFrame:
    """The least-cost route of each (id, n1, e1, n2, e2), from and to the nearest point of the network.

    A stretch that meets an avoided region is not used.  An edge costs its metres
    times 1 + weight * the share of it that is seen (``exposure``).  No route may
    be longer than ``max_detour`` times the straight line, or it and 5 km.
    """
    form, weights = terrain.form, exposure or {}

    def each(net: Network, q: dict) -> list[dict]:
        a, b = net.snap(q["n1"], q["e1"]), net.snap(q["n2"], q["e2"])
        out = {"id": q["id"], "snap_from": a[2], "snap_to": b[2]}
        straight = math.dist((q["n1"], q["e1"]), (q["n2"], q["e2"]))
        most = max(max_detour * straight, straight + 5000)
        free = _unhindered(net, avoid)
        found = net.search(a[:2], b[:2], lambda e: 1 + exposure_weight * weights.get(e, 0.0), free)
        if found is None or net.length(found) > most:
            return [out | {"reason": "no route" if found is None else f"no route within {most:g} m"}]
        return [out | described(net, found, form)]

    return _with_network(terrain, network, requests.select("id", "n1", "e1", "n2", "e2"), each, ROUTE)


def _unhindered(net: Network, avoid: tuple[Region, ...]) -> Callable[[int, float, float], bool]:
    if not avoid:
        return lambda *_: True
    known: dict[tuple, bool] = {}

    def free(e: int, a: float, b: float) -> bool:
        key = (e, min(a, b), max(a, b))
        if key not in known:
            line = net.edges[e].piece(key[1], key[2])
            known[key] = not any(r.meets(p[:2], q[:2]) for r in avoid for p, q in zip(line, line[1:] or line, strict=False))
        return known[key]

    return free


def described(net: Network, found: Found, form: Form | None) -> dict:
    if not found.pieces:
        return {"length": 0.0, "cost": 0.0, "ascent": 0.0, "descent": 0.0, "max_grade": 0.0, "edges": [], "waypoints": 1}
    lines = net.lines(found)
    heights = profile(lines, form)
    up, down = climb(heights)
    return {"length": net.length(found), "cost": found.cost, "ascent": up, "descent": down, "max_grade": steepest(heights), "edges": [e for e, _, _ in found.pieces], "waypoints": len(waypoints(lines))}


def route_alternatives(terrain: Terrain, requests: DataFrame, network: str = "road", k: int = 3, max_stretch: float = 1.5, max_overlap: float = 0.5, penalty: float = 1.6, avoid: tuple[Region, ...] = ()) -> DataFrame:
    """(id, rank, length, stretch, overlap, edges, shared_edges): up to k routes apart from each other for each request."""
    if not (1 <= k <= 10 and max_stretch >= 1 and 0 <= max_overlap <= 1 and 1 < penalty):
        raise ValueError("k is 1 to 10, the stretch at least 1, the overlap 0 to 1 and the penalty over 1")

    def each(net: Network, q: dict) -> list[dict]:
        a, b = net.snap(q["n1"], q["e1"])[:2], net.snap(q["n2"], q["e2"])[:2]
        kept = alternatives(net, a, b, lambda e: 1.0, k, max_stretch, max_overlap, penalty, _unhindered(net, avoid))
        sizes = [net.length(f) for f in kept]
        common = [e for e, _, _ in shared_by_all(kept)]
        out = []
        for i, f in enumerate(kept):
            overlap = max((net.shared(f, o) / sizes[i] if sizes[i] else 1.0 for j, o in enumerate(kept) if j != i), default=0.0)
            out.append({"id": q["id"], "rank": i + 1, "length": sizes[i], "stretch": sizes[i] / sizes[0] if sizes[0] else 1.0, "overlap": overlap, "edges": [e for e, _, _ in f.pieces], "shared_edges": common})
        return out

    return _with_network(terrain, network, requests.select("id", "n1", "e1", "n2", "e2"), each, "id long, rank long, length double, stretch double, overlap double, edges array<long>, shared_edges array<long>")


def betweenness(terrain: Terrain, network: str = "road", sources: int = BETWEENNESS_SOURCES) -> DataFrame:
    """(edge_id, betweenness) of a network, 1 for its largest: shortest paths from every node, or from evenly spaced ones.

    Only the largest component counts; where shortest paths tie, each has its
    share.  Sources spread over the cluster and their sums meet by edge.
    """
    edges = terrain.table("edges").where(F.col("kind") == KIND[network])
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def each(net: Network, q: dict) -> list[dict]:
        comp = largest(net)
        picked = comp if len(comp) <= sources else [comp[i * len(comp) // sources] for i in range(sources)]
        if q["id"] not in picked:
            return []
        return [{"edge_id": e, "part": v} for e, v in brandes(net, q["id"]).items()]

    parts = _with_network(terrain, network, ends, each, "edge_id long, part double").groupBy("edge_id").agg(F.sum("part").alias("part"))
    most = parts.agg(F.max("part").alias("most"))
    out = edges.select("edge_id", "a", "b", "length").join(parts, "edge_id", "left").join(F.broadcast(most))
    return out.select("edge_id", "a", "b", "length", F.coalesce(F.col("part") / F.col("most"), F.lit(0.0)).alias("betweenness"))


def largest(net: Network) -> list[int]:
    """The nodes of the largest component, sorted; ties go to the one met first."""
    seen: set[int] = set()
    best: list[int] = []
    for start in sorted(net.at):
        if start in seen:
            continue
        seen.add(start)
        comp = [start]
        for v in comp:
            for e in net.at[v]:
                for w in (net.edges[e].a, net.edges[e].b):
                    if w not in seen:
                        seen.add(w)
                        comp.append(w)
        if len(comp) > len(best):
            best = comp
    return sorted(best)


def brandes(net: Network, source: int) -> dict[int, float]:
    """How much of the shortest paths from a node runs over each edge."""
    dist, paths, order, before = {source: 0.0}, defaultdict(float, {source: 1.0}), [], defaultdict(list)
    heap, done = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for e in net.at[v]:
            edge = net.edges[e]
            w = edge.b if edge.a == v else edge.a
            if w == v:
                continue
            nd = d + max(edge.length, 1e-3)
            if nd < dist.get(w, math.inf):
                dist[w], paths[w], before[w] = nd, paths[v], [(v, e)]
                heapq.heappush(heap, (nd, w))
            elif nd == dist[w] and w not in done:
                paths[w] += paths[v]
                before[w].append((v, e))
    out, share = defaultdict(float), defaultdict(float)
    for w in reversed(order):
        for v, e in before[w]:
            part = paths[v] / paths[w] * (1 + share[w])
            out[e] += part
            share[v] += part
    return dict(out)


def chokepoints(terrain: Terrain, network: str = "road", region: Region | None = None, limit: int = 20) -> DataFrame:
    """The edges of a region by betweenness, greatest first, ties in edge order."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    out = betweenness(terrain, network)
    if region is not None:
        out = out.join(edges_meeting(terrain, network, region), "edge_id", "left_semi")
    return out.orderBy(F.desc("betweenness"), "edge_id").limit(limit)


def shared_by_all(routes: list[Found]) -> list[tuple[int, float, float]]:
    """The stretches (edge, from, to) that every route runs along, by edge; of an edge run along twice the longest."""
    out = []
    for e in sorted(set.intersection(*({p[0] for p in r.pieces} for r in routes))) if routes else ():
        common = [(0.0, 1.0)]
        for r in routes:
            own = [(min(a, b), max(a, b)) for f, a, b in r.pieces if f == e]
            common = [(max(a, c), min(b, d)) for a, b in common for c, d in own if min(b, d) > max(a, c)]
        if common:
            out.append((e, *max(common, key=lambda x: x[1] - x[0])))
    return out


def top_decile(terrain: Terrain, network: str = "road") -> DataFrame:
    """The edges of a network whose betweenness is at or over the cut of its top tenth, and over 0."""
    known = betweenness(terrain, network)
    ranked = known.agg(F.sort_array(F.collect_list("betweenness")).alias("all"))  # one number an edge
    cut = ranked.select(F.element_at("all", (F.floor(F.size("all") * 9 / 10) + 1).cast("int")).alias("cut"))
    return known.join(F.broadcast(cut)).where("betweenness >= cut and betweenness > 0").drop("cut")


def edges_meeting(terrain: Terrain, network: str, region: Region) -> DataFrame:
    """(edge_id) of the edges that meet a region."""

    def run(batches):
        for b in batches:
            lines = [[(p["n"], p["e"]) for p in line] for line in b.column(1).to_pylist()]
            hit = [any(region.meets(p, q) for p, q in zip(line, line[1:] or line, strict=False)) for line in lines]
            yield b.select([0]).filter(pa.array(hit))

    return terrain.table("edges").where(F.col("kind") == KIND[network]).select("edge_id", "points").mapInArrow(run, "edge_id long")


def contracted(terrain: Terrain, network: str = "road", within_deg: float = 1.0) -> DataFrame:
    """(edge_id, a, b, length, pieces): chains of edges of one class that run straight through nodes of two edges, as one edge.

    The id is the chain's least; a chain keeps its edges apart where they bend by
    more than ``within_deg``.
    """
    edges = terrain.table("edges").where(F.col("kind") == KIND[network])
    last = F.size("points")
    ends = edges.select("edge_id", "class", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("points")[0].alias("p"), F.col("points")[1].alias("q")), F.struct(F.col("b").alias("node"), F.element_at("points", last).alias("p"), F.element_at("points", last - 1).alias("q")))).alias("x"))
    heading = F.degrees(F.atan2(F.col("x.q.e") - F.col("x.p.e"), F.col("x.q.n") - F.col("x.p.n")))
    ends = ends.select("edge_id", "class", F.col("x.node").alias("node"), heading.alias("heading"))
    pairs = ends.groupBy("node").agg(F.count("*").alias("degree"), F.min(F.struct("edge_id", "class", "heading")).alias("u"), F.max(F.struct("edge_id", "class", "heading")).alias("v"))
    bend = F.abs(F.abs(F.col("u.heading") - F.col("v.heading")) - 180)
    joins = pairs.where((F.col("degree") == 2) & (F.col("u.class") == F.col("v.class")) & (F.col("u.edge_id") != F.col("v.edge_id")) & (bend <= within_deg))
    joins = joins.select("node", F.col("u.edge_id").alias("a"), F.col("v.edge_id").alias("b"))
    joined = connected_components(joins).select(F.col("node").alias("edge_id"), F.col("component").alias("chain"))
    chains = edges.select("edge_id", "a", "b", "length").join(joined, "edge_id", "left").withColumn("chain", F.coalesce("chain", "edge_id"))
    inner = joins.select(F.col("node").alias("inner"))
    outer = chains.select("chain", F.explode(F.array("a", "b")).alias("node")).join(inner, F.col("node") == F.col("inner"), "left_anti").groupBy("chain").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    sums = chains.groupBy("chain").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list("edge_id")).alias("pieces"))
    return sums.join(outer, "chain", "left").select(F.col("chain").alias("edge_id"), "a", "b", "length", "pieces")


def exposure_by_edge(terrain: Terrain, network: str, observers: DataFrame) -> DataFrame:
    """(edge_id, exposure): the share of samples along each edge at which any observer (n, e, a) sees a vehicle, over the raster."""
    k = KIND[network]

    def split(batches):
        for b in batches:
            ids, at = [], []
            for edge, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                points = profile_points([(p["n"], p["e"], p["h"]) for p in line])
                ids.append(edge)
                at.append([{"n": n, "e": e} for n, e in points])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.list_(pa.struct([("n", pa.float64()), ("e", pa.float64())])))], names=["edge_id", "at"])

    samples = terrain.table("edges").where(F.col("kind") == k).select("edge_id", "points").mapInArrow(split, "edge_id long, at array<struct<n:double,e:double>>")
    asks = samples.join(F.broadcast(observers.select(F.col("n").alias("on"), F.col("e").alias("oe"), F.col("a").alias("oa"))))
    asks = asks.withColumn("id", F.monotonically_increasing_id())

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        eye = float(block.ground(np.array([q["on"]]), np.array([q["oe"]]))[0]) + q["oa"]
        out = {"edge_id": [], "k": [], "seen": []}
        for i, p in enumerate(q["at"]):
            g = float(block.bilinear(np.array([p["n"]]), np.array([p["e"]]))[0])
            if not math.isnan(g):
                out["edge_id"].append(q["edge_id"])
                out["k"].append(i)
                out["seen"].append(R.walk(block, (q["on"], q["oe"], eye), (p["n"], p["e"], g + VEHICLE)))
        return out

    n, e = F.transform("at", lambda p: p["n"]), F.transform("at", lambda p: p["e"])
    window = {"row": F.floor(F.least("on", F.array_min(n)) / CELL) - 2, "col": F.floor(F.least("oe", F.array_min(e)) / CELL) - 2, "row_end": F.floor(F.greatest("on", F.array_max(n)) / CELL) + 2, "col_end": F.floor(F.greatest("oe", F.array_max(e)) / CELL) + 2}
    seen = on_blocks(terrain, asks, {c: v.cast("long") for c, v in window.items()}, kernel, "edge_id long, k long, seen boolean")
    return seen.groupBy("edge_id", "k").agg(F.bool_or("seen").alias("seen")).groupBy("edge_id").agg(F.avg(F.col("seen").cast("int")).alias("exposure"))


def profile_points(line: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Points every ``SAMPLE`` metres along a line and at its end."""
    along = np.concatenate([[0.0], np.cumsum([math.dist(p[:2], q[:2]) for p, q in zip(line, line[1:], strict=False)])])
    at = np.append(np.arange(0.0, along[-1] - 1e-6, SAMPLE), along[-1])
    return list(zip(np.interp(at, along, [p[0] for p in line]).tolist(), np.interp(at, along, [p[1] for p in line]).tolist(), strict=True))


