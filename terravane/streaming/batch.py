"""Request lines answered in a batch or as a stream.

A line is a JSON object with ``op``, the operation's own fields and options.  Lines of one operation with equal
options are answered by one plan; an answer keeps its line's number.  A bad line,
or a plan that fails, answers with issues and leaves the others alone.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions import shapes as S
from ..operators import airfields, network, offroad, points, settlements, sight, sites
from ..plans.cluster import shared_dir
from ..sources.catalog import Terrain, synthetic

#: Plans for one batch, at most: as many kinds of question, not as many lines.
PLANS = 500


@dataclass(frozen=True)
class Operation:
    """``fields`` vary by line and become columns; ``options`` have defaults and are shared by a plan's lines."""

    run: Callable[[Terrain, DataFrame, dict], DataFrame]
    fields: dict[str, str] = field(default_factory=dict)
    options: dict = field(default_factory=dict)


def region(of: dict | None) -> S.Region | None:
    """A box, circle, ring or polygon from its JSON."""
    if of is None:
        return None
    kind = of.get("kind")
    if kind == "box":
        return S.Box(of["south"], of["west"], of["north"], of["east"])
    if kind == "circle":
        return S.Circle(of["n"], of["e"], of["radius"])
    if kind == "ring":
        return S.Ring(of["n"], of["e"], of["least"], of["most"])
    if kind == "polygon":
        return S.Polygon(tuple((p[0], p[1]) for p in of["points"]))
    raise ValueError("a region is a box, circle, ring or polygon")


def _whole(make: Callable[[Terrain, dict], DataFrame]) -> Callable[[Terrain, DataFrame, dict], DataFrame]:
    """An operation without fields of its own: every line gets all rows."""
    return lambda t, q, o: q.select("id").join(F.broadcast(make(t, o)))


def _to_grid(q: DataFrame) -> DataFrame:
    m = P.Staged(q)
    x, z = P.Mercator().forward(F.col("lat"), F.col("lon"), m)
    return m.done(n=x - P.ORIGIN[0], e=z - P.ORIGIN[1])


def _sample(t: Terrain, q: DataFrame, o: dict) -> DataFrame:
    return points.sample(t, q, o["layers"])


def _placed(t: Terrain, q: DataFrame, o: dict) -> DataFrame:
    none = {"points": F.lit(None).cast("array<struct<n:double,e:double>>"), "kind": F.lit(o["kind"]), "afloat": F.lit(bool(o["afloat"])), "allow_forest": F.lit(bool(o["allow_forest"]))}
    limits = {k: F.lit(o[k]).cast("double") for k in ("max_slope", "min_depth")}
    return sites.validate_placements(t, q.withColumns({**none, **limits}))


_AT, _PAIR = {"n": "double", "e": "double"}, {"n1": "double", "e1": "double", "n2": "double", "e2": "double"}
_SITE = {**_AT, "a": "double", "radius": "double"}
_ROAD = {"network": "road"}
OPERATIONS: dict[str, Operation] = {
    "describe": Operation(_whole(lambda t, o: airfields.describe(t))),
    "sample": Operation(_sample, _AT, {"layers": ["height"]}),
    "sample_region": Operation(_whole(lambda t, o: points.sample_region(t, region(o["region"]), o["step"], o["layers"], o["max_rows"])), {}, {"region": None, "step": 50.0, "layers": ["height"], "max_rows": 10_000}),
    "geo": Operation(lambda t, q, o: points.geo(q), _AT),
    "to_grid": Operation(lambda t, q, o: _to_grid(q), {"lat": "double", "lon": "double"}),
    "point_info": Operation(lambda t, q, o: points.point_info(t, q), _AT),
    "nearest": Operation(lambda t, q, o: points.nearest(t, q, o["kind"], o["count"], o["class"], settlements.places(t) if o["kind"] == "place" else None), _AT, {"kind": "scenery", "count": 1, "class": None}),
    "visible": Operation(lambda t, q, o: sight.visible(t, q), {**_PAIR, "a1": "double", "a2": "double"}),
    "viewshed": Operation(lambda t, q, o: sight.mask(t, q.withColumn("target", F.lit(float(o["target"])))), _SITE, {"target": 2.0}),
    "radar_floor": Operation(lambda t, q, o: sight.radar_floor(t, q), _SITE),
    "coverage": Operation(lambda t, q, o: sight.coverage(t, q, tuple(map(float, o["bands"])), o["min_masked_range"], region(o["asset"])), _SITE, {"bands": list(sight.BANDS), "min_masked_range": 8000.0, "asset": None}),
    "approach_spectrum": Operation(lambda t, q, o: sight.spectrum(t, q, tuple(map(float, o["bands"])), o["azimuth_step"], o["min_masked_range"]), _SITE, {"bands": list(sight.BANDS), "azimuth_step": 5.0, "min_masked_range": 8000.0}),
    "unmask_profile": Operation(lambda t, q, o: sight.unmask(t, q, o["step"]), {**_AT, "a": "double", "route": "array<struct<n:double,e:double,a:double>>"}, {"step": 100.0}),
    "exposure": Operation(_whole(lambda t, o: sight.exposure(t, t.spark.createDataFrame([(i, float(s["n"]), float(s["e"]), float(s["a"]), float(s["radius"])) for i, s in enumerate(o["sites"][:64])], "id long, n double, e double, a double, radius double"), float(o["target"]))), {}, {"sites": [], "target": 2.0}),
    "score_site": Operation(lambda t, q, o: sites.best_orientation(sites.score_sites(t, q, o["criteria"], tuple(o["footprint"]), tuple(o["orientations"]))), _AT, {"criteria": [], "footprint": [0.0, 0.0], "orientations": [0.0]}),
    "find_sites": Operation(_whole(lambda t, o: sites.find_sites(t, region(o["region"]), o["criteria"], o["step"], o["spacing"], o["limit"], footprint=tuple(o["footprint"]), orientations=tuple(o["orientations"]), weights=o["weights"]).drop("id")), {}, {"region": None, "criteria": [], "step": 100.0, "spacing": 0.0, "limit": 20, "footprint": [0.0, 0.0], "orientations": [0.0], "weights": None}),
    "route": Operation(lambda t, q, o: network.route(t, q, o["network"], tuple(map(region, o["avoid"])), None, 1.0, o["max_detour_factor"]), _PAIR, {**_ROAD, "avoid": [], "max_detour_factor": 3.0}),
    "route_alternatives": Operation(lambda t, q, o: network.route_alternatives(t, q, o["network"], o["k"], o["max_stretch"], o["max_overlap"], o["penalty"], tuple(map(region, o["avoid"]))), _PAIR, {**_ROAD, "k": 3, "max_stretch": 1.5, "max_overlap": 0.5, "penalty": 1.6, "avoid": []}),
    "chokepoints": Operation(_whole(lambda t, o: network.chokepoints(t, o["network"], region(o["region"]), o["limit"])), {}, {**_ROAD, "region": None, "limit": 20}),
    "trafficability": Operation(lambda t, q, o: offroad.trafficability(t, q, o["max_slope"], o["network"], o["max_distance"]), _AT, {**_ROAD, "max_slope": 20.0, "max_distance": offroad.MAX_DISTANCE}),
    "scenery_in": Operation(lambda t, q, o: sites.counts_by(sites.scenery_in(t, q, tuple(o["pools"]), tuple(o["classes"]))), {**_AT, "radius": "double"}, {"pools": ["objects"], "classes": []}),
    "validate_placements": Operation(_placed, {**_AT, "radius": "double?", "w": "double?", "d": "double?", "rotation": "double?"}, {"kind": "point", "afloat": False, "allow_forest": False, "max_slope": None, "min_depth": None}),
    "airfield_info": Operation(_whole(lambda t, o: airfields.airfield_info(t, o["width"], o["length"])), {}, {"width": None, "length": None}),
    "towns": Operation(_whole(lambda t, o: settlements.towns(t, region(o["region"]), tuple(o["size"]), tuple(o["form"]), o["min_buildings"], o["sort"], o["limit"])), {}, {"region": None, "size": [], "form": [], "min_buildings": 0, "sort": "buildings", "limit": 50}),
}


def issue(code: str, message: str, path: str = "") -> dict:
    return {"code": code, "message": message, "path": path}


def checked(line: str) -> tuple[str | None, str | None, str | None, str | None]:
    """(op, fields, options, issues) of a line, each as JSON; op is null where there are issues."""
    bad = lambda *issues: (None, None, None, json.dumps(issues))
    try:
        asked = json.loads(line)
    except ValueError as e:
        return bad(issue("invalid_json", str(e)))
    if not isinstance(asked, dict):
        return bad(issue("invalid_request", "a request is an object"))
    op = OPERATIONS.get(asked.get("op"))
    if op is None:
        return bad(issue("unknown_operation", f"the operations are {', '.join(OPERATIONS)}", "op"))
    issues, fields = [], {}
    for name, kind in op.fields.items():
        v = asked.get(name)
        if v is None and kind.endswith("?"):
            fields[name] = None
        elif kind.startswith("double"):
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
                issues.append(issue("invalid_point" if name in _AT else "invalid_request", "must be a finite number", name))
            else:
                fields[name] = float(v)
        elif not isinstance(v, list) or len(v) < 2 or not all(isinstance(p, dict) and all(isinstance(p.get(k), (int, float)) and math.isfinite(p[k]) for k in ("n", "e", "a")) for p in v):
            issues.append(issue("invalid_request", "needs two points or more, each with n, e and a", name))
        else:
            fields[name] = [{k: float(p[k]) for k in ("n", "e", "a")} for p in v]
    known = {"op", *op.fields, *op.options}
    issues += [issue("unknown_field", f"no field {k}", k) for k in asked if k not in known]
    if issues:
        return bad(*issues)
    return asked["op"], json.dumps(fields), json.dumps({k: asked.get(k, v) for k, v in op.options.items()}, sort_keys=True), None


def parsed(lines: DataFrame) -> DataFrame:
    """(id, op, fields, options, issues) of lines (id, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [checked(v or "") for v in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "op", "fields", "options", "issues"])

    return lines.select("id", "value").mapInArrow(run, "id long, op string, fields string, options string, issues string")


def _answered(terrain: Terrain, asked: DataFrame, name: str, options: str) -> DataFrame:
    """(line, answer) of the lines of one operation and one set of options."""
    op = OPERATIONS[name]
    mine = asked.where((F.col("op") == name) & (F.col("options") == options))
    if op.fields:
        schema = ", ".join(f"{k} {v.rstrip('?')}" for k, v in op.fields.items())
        mine = mine.select("id", F.from_json("fields", schema).alias("f")).select("id", "f.*")
    else:
        mine = mine.select("id")
    rows = op.run(terrain, mine, json.loads(options))
    own = [c for c in rows.columns if c != "id"]
    per = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.to_json(F.struct(*own)))).alias("rows"))
    found = mine.select("id").join(per, "id", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<string>")))
    return found.select(F.col("id").alias("line"), F.concat(F.lit('{"op":"' + name + '","result":['), F.array_join("rows", ","), F.lit("]}")).alias("answer"))


def answer(terrain: Terrain, lines: DataFrame) -> DataFrame:
    """(line, answer) for every line (id, value), ordered by line."""
    base = f"{shared_dir(terrain.spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    spark = terrain.spark
    parsed(lines).write.parquet(f"{base}/asked")
    asked = spark.read.parquet(f"{base}/asked")
    kinds = asked.where("op is not null").select("op", "options").distinct().limit(PLANS + 1).collect()
    if len(kinds) > PLANS:
        raise ValueError(f"more than {PLANS} kinds of question in one batch")
    refused = lambda df, *issues: df.select(F.col("id").alias("line"), F.concat(F.lit('{"issues":'), issues[0] if issues else F.col("issues"), F.lit("}")).alias("answer"))
    out = refused(asked.where("op is null"))
    for k, (name, options) in enumerate(sorted(map(tuple, kinds))):
        mine = asked.where((F.col("op") == name) & (F.col("options") == options))
        try:
            _answered(terrain, asked, name, options).write.parquet(f"{base}/{k}")
            out = out.unionByName(spark.read.parquet(f"{base}/{k}"))
        except (ValueError, KeyError, TypeError) as e:
            out = out.unionByName(refused(mine, F.lit(json.dumps([issue("invalid_request", str(e))]))))
        except Exception as e:  # noqa: BLE001  one plan's failure is its own lines' answer
            said = next((x for x in str(e).splitlines() if "ValueError" in x), type(e).__name__)
            out = out.unionByName(refused(mine, F.lit(json.dumps([issue("internal_error", said[:300])]))))
    return out.orderBy("line")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): lines in order of file and place."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    return lines.where("trim(value) <> ''")


def run_batch(spark: SparkSession, source: str, target: str, terrain: Terrain | None = None) -> None:
    answer(terrain or synthetic(spark), numbered(spark, source)).write.mode("overwrite").json(target)


def run_stream(spark: SparkSession, source: str, target: str, checkpoint: str, terrain: Terrain | None = None):
    """A query that answers the files of a folder once each; a batch written again replaces itself."""
    terrain = terrain or synthetic(spark)

    def write(lines: DataFrame, batch: int) -> None:
        held = lines.select("value", F.monotonically_increasing_id().alias("id")).where("trim(value) <> ''")
        answer(terrain, held).write.mode("overwrite").json(f"{target}/batch={batch}")

    return spark.readStream.schema("value string").text(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
