"""Off-road ways: least-cost search over cells from a point to a network.

The search is sequential, so it is a heap over numpy arrays; requests meet the
tiles of their own window and spread over the cluster.  A move goes to one of 16
neighbours and costs, in every cell that it crosses, its metres there times the
cell's cost; a cell that it crosses or only touches at a corner blocks it if it
cannot be crossed.  The disk searched doubles until the way found costs no more
than its radius: a way that leaves the disk costs at least that.
"""

from __future__ import annotations

import heapq
import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R
from ..sources.catalog import Terrain
from ..sources.synthetic import CELL, COVER, RAIL, ROAD
from .windows import around, on_blocks

# The share of open ground's speed that a cover leaves, and what the steepest slope leaves.
COVER_SPEED = {"plain": 1.0, "runway": 1.0, "field": 0.8, "beach": 0.6, "town": 0.5, "forest": 0.25}
STEEP_SPEED = 0.25
#: Metres: how far a way is searched, and the radius of the first disk at least.
MAX_DISTANCE, FIRST_REACH = 20_000.0, 1000.0
MOVES = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if math.gcd(a, b) == 1]
REASONS = {1: "a lake", 2: "the sea", 3: "a river"}


def cost_field(block: R.Block, max_slope: float) -> np.ndarray:
    """Cost per metre of each cell, 1 on open flat ground, infinite where it cannot be crossed."""
    slope = R.slope_layers(block.h)["slope"]
    speed = np.zeros(block.shape)
    for name, share in COVER_SPEED.items():
        speed[block.cover == COVER[name]] = share
    with np.errstate(invalid="ignore", divide="ignore"):
        cost = 1 / (speed * (1 - (1 - STEEP_SPEED) * (slope / max_slope) ** 2))
        cost[(speed == 0) | (block.water != 0) | np.isnan(slope) | (slope > max_slope)] = np.inf
    return cost


@cache
def crossings() -> list[list[tuple[int, int, float]]]:
    """Of each move, the cells crossed or touched at a corner after the first one, with the metres run in each; the first cell's come first."""
    half = CELL / 2
    return [[(r, c, (t - s) * math.hypot(a, b) * CELL) for r, c, s, t in R.crossed((half, half), (half + a * CELL, half + b * CELL))] for a, b in MOVES]


class Ground:
    """What a search runs over: costs, the network's cells and the disk that may be entered."""

    def __init__(self, cost: np.ndarray, road: np.ndarray, inside: np.ndarray | None = None):
        # a road's cell is crossed as open ground by the way that ends in it
        self.passage = np.where(road & ~np.isfinite(cost), 1.0, cost)
        self.road, self.inside = road, np.ones(cost.shape, bool) if inside is None else inside
        self.cols = cost.shape[1]

    def steps(self) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Of each move, its offset among flat cells and its cost out of every cell; and the cells whose moves leave the disk."""
        rows, cols = self.road.shape
        wide = np.pad(self.passage, 2, constant_values=np.inf)
        wall = np.pad(self.road, 2)
        held = np.pad(self.inside, 2)
        at = lambda table, i, j: table[2 + i : 2 + i + rows, 2 + j : 2 + j + cols]
        out, rim = [], np.zeros((rows, cols), bool)
        for (a, b), cells in zip(MOVES, crossings(), strict=True):
            cost = np.zeros((rows, cols))
            blocked = ~at(held, a, b)
            rim |= blocked
            for i, j, metres in cells:
                p = at(wide, i, j)
                blocked = blocked | np.isinf(p)
                if metres > 0:
                    cost += metres * np.where(np.isinf(p), 0.0, p)
                    if (i, j) not in ((0, 0), (a, b)):
                        blocked |= at(wall, i, j)
            cost[blocked] = np.inf
            out.append((a * cols + b, cost.ravel()))
        return out, rim.ravel()

    def line(self, a: tuple[float, float], b: tuple[float, float], end: tuple[int, int]) -> float:
        """The cost of a straight line in metres from the block's corner; infinite where it is blocked or runs through another road's cell."""
        start = math.floor(a[0] / CELL), math.floor(a[1] / CELL)
        total, size = 0.0, math.dist(a, b)
        for r, c, s, t in R.crossed(a, b):
            if not (0 <= r < self.road.shape[0] and 0 <= c < self.cols) or not np.isfinite(self.passage[r, c]):
                return math.inf
            if t > s and self.road[r, c] and (r, c) not in (start, end):
                return math.inf
            total += (t - s) * size * self.passage[r, c]
        return total


def search(ground: Ground, row: int, col: int) -> tuple[float, list[tuple[int, int]], bool]:
    """(cost, cells of the way, whether the edge of the disk was met) to the nearest road's cell; infinite and empty where none is reached.

    Ties go to the lower row, then column.
    """
    cols = ground.cols
    if not (np.isfinite(ground.passage[row, col]) and ground.inside[row, col]):
        return math.inf, [], False
    steps, rim = ground.steps()
    moves = [(k, off, memoryview(cost)) for k, (off, cost) in enumerate(steps)]
    best, came, edge = np.full(ground.road.size, np.inf), np.full(ground.road.size, -1, np.int8), False
    least, from_, road, outer, done = memoryview(best), memoryview(came), ground.road.ravel().tobytes(), rim.tobytes(), bytearray(ground.road.size)
    start = row * cols + col
    least[start] = 0.0
    heap = [(0.0, start)]
    while heap:
        d, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = 1
        if road[i]:
            way = [i]
            while way[-1] != start:
                way.append(way[-1] - moves[from_[way[-1]]][1])
            return d, [divmod(j, cols) for j in way[::-1]], edge
        if outer[i]:
            edge = True
        for k, off, cost in moves:
            new = d + cost[i]
            if new < math.inf and new < least[i + off]:
                least[i + off] = new
                from_[i + off] = k
                heapq.heappush(heap, (new, i + off))
    return math.inf, [], edge


def straightened(ground: Ground, turns: list[tuple[float, float]], end: tuple[int, int]) -> tuple[float, list[tuple[float, float]]]:
    """From each turn on to the farthest later one whose straight line costs no more than the way between them."""
    cells = [(math.floor(n / CELL), math.floor(e / CELL)) for n, e in turns[:-1]] + [end]
    spent = [0.0]
    for k in range(1, len(turns)):
        spent.append(spent[-1] + ground.line(turns[k - 1], turns[k], cells[k]))
    out, cost, i = [turns[0]], 0.0, 0
    while i + 1 < len(turns):
        to, price = i + 1, spent[i + 1] - spent[i]
        for j in range(i + 2, len(turns)):
            straight = ground.line(turns[i], turns[j], cells[j])
            if not straight <= (spent[j] - spent[i]) * (1 + 1e-12) + 1e-9:
                break
            to, price = j, straight
        out.append(turns[to])
        cost += price
        i = to
    return (cost, out) if cost <= spent[-1] else (spent[-1], turns)


def way(cost: np.ndarray, road: np.ndarray, n: float, e: float, max_distance: float) -> tuple[float, list[tuple[float, float]], float]:
    """(cost, turns, reach searched) from a point in metres from the block's corner to a road."""
    row, col = int(n // CELL), int(e // CELL)
    r, c = np.ogrid[0 : road.shape[0], 0 : road.shape[1]]
    far = np.hypot((r + 0.5) * CELL - n, (c + 0.5) * CELL - e)
    far[row, col] = 0
    near = far[road].min() if road.any() else math.inf
    if near > max_distance:
        return math.inf, [], max_distance
    reach = min(max(FIRST_REACH, 2 * near), max_distance)
    while True:
        k = int(reach // CELL) + 2
        top, left = max(0, row - k), max(0, col - k)
        cut = slice(top, row + k + 1), slice(left, col + k + 1)
        total, cells, rim = search(Ground(cost[cut], road[cut], (far <= reach)[cut]), row - top, col - left)
        cells = [(i + top, j + left) for i, j in cells]
        if total <= reach or reach >= max_distance or (total == math.inf and not rim):
            break
        reach = min(2 * reach, max_distance)
    if total == math.inf:
        return total, [], reach
    turns = [(n, e), *(((i + 0.5) * CELL, (j + 0.5) * CELL) for i, j in cells[1:])]
    if len(turns) == 1:
        return 0.0, [(n, e)], reach
    return *straightened(Ground(cost, road), turns, cells[-1]), reach


def trafficability(terrain: Terrain, requests: DataFrame, max_slope: float = 20.0, network: str = "road", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(id, reachable, cost, length, road_n, road_e, turns, straight_distance, reason) of each (id, n, e): the least-cost way to a network.

    ``reason`` says what kind of ground the start has where no way exists.
    """
    if not 0 < max_slope <= 60:
        raise ValueError("the slope limit must lie over 0 and up to 60 degrees")
    kind = {"road": ROAD, "rail": RAIL}[network]
    # bounded like the graph itself: the polylines within reach of a request go with it
    lines = terrain.table("edges").where(F.col("kind") == kind).select(F.posexplode("points").alias("k", "p"), "edge_id")
    lines = lines.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("ps"))
    lines = lines.agg(F.collect_list(F.transform("ps", lambda x: x["p"])).alias("lines"))
    names = ("id", "reachable", "cost", "length", "road_n", "road_e", "turns", "straight_distance", "reason")

    def kernel(q: dict, block: R.Block) -> dict[str, list]:
        base_n, base_e = block.row * float(CELL), block.col * float(CELL)
        road = R.line_cells([np.array([(p["n"], p["e"]) for p in line]) for line in q["lines"] or ()], block.row, block.col, *block.shape)
        cost = cost_field(block, max_slope)
        n, e = q["n"] - base_n, q["e"] - base_e
        total, turns, reach = way(cost, road, n, e, max_distance)
        i, j = int(n // CELL), int(e // CELL)
        if total < math.inf:
            at = [(a + base_n, b + base_e) for a, b in turns]
            row = (q["id"], True, total, sum(map(math.dist, at, at[1:])), at[-1][0], at[-1][1], len(at) - 2 if len(at) > 1 else 0, math.dist(at[0], at[-1]), None)
        else:
            start = "no ground" if math.isnan(block.h[i, j]) else REASONS.get(int(block.water[i, j]))
            reason = f"the start lies in {start}" if start and not np.isfinite(cost[i, j]) else "the start is too steep" if not np.isfinite(cost[i, j]) and not road[i, j] else f"no way reaches the {network} within {reach:g} m"
            row = (q["id"], False, None, None, None, None, None, None, reason)
        return {k: [v] for k, v in zip(names, row, strict=True)}

    asked = requests.select("id", "n", "e").join(F.broadcast(lines))
    return on_blocks(terrain, asked, around(F.col("n"), F.col("e"), F.lit(max_distance)), kernel, "id long, reachable boolean, cost double, length double, road_n double, road_e double, turns long, straight_distance double, reason string")
