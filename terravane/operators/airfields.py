"""Airfields, and what a terrain holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import projection as P
from ..sources.catalog import Terrain
from ..sources.synthetic import ROAD
from . import points

#: Metres between heights along a centre line.
STEP = 10.0
STATIONS = 9


def find(terrain: Terrain, name: str | int) -> DataFrame:
    """The airdrome of an id, else an exact name, else a name in either case, else an id in digits: the first rule that any row meets."""
    names = F.col("name_id"), F.col("display_name")
    text = F.lit(str(name))
    rank = F.when(F.lit(isinstance(name, int)) & (F.col("airdrome_id") == name if isinstance(name, int) else F.lit(False)), 0)
    rank = rank.when((names[0] == text) | (names[1] == text), 1).when((F.lower(names[0]) == F.lower(text)) | (F.lower(names[1]) == F.lower(text)), 2)
    rank = rank.when(F.col("airdrome_id").cast("string") == text, 3)
    ranked = terrain.table("airdromes").withColumn("rank", rank).where("rank is not null")
    return ranked.orderBy("rank", "airdrome_id").limit(1).drop("rank")


def fits(width: float | None, length: float | None) -> Column:
    """Three-valued: null where a stand does not say its size and nothing else decides."""
    wide = F.lit(True) if width is None else F.col("width") >= width
    long = F.lit(True) if length is None else F.col("length") >= length
    return wide & long


def runways(terrain: Terrain) -> DataFrame:
    """A row for each runway end: coordinates, course, length, painted width (median of nine stations) and highest ground on the line."""
    lines = terrain.table("runways")
    dn, de = F.col("n2") - F.col("n1"), F.col("e2") - F.col("e1")
    size = F.sqrt(dn * dn + de * de)
    lines = lines.withColumn("length", size)
    # painted width: how far the paint's triangles reach across the line at each station
    at = F.explode(F.sequence(F.lit(1), F.lit(STATIONS)))
    stations = lines.select("airdrome_id", "name", "n1", "e1", "n2", "e2", "length", at.alias("k")).withColumn("t", F.col("k") / (STATIONS + 1))
    sides = F.explode(F.array(*(F.struct(F.col(f"p.n{i}").alias("na"), F.col(f"p.e{i}").alias("ea"), F.col(f"p.n{j}").alias("nb"), F.col(f"p.e{j}").alias("eb")) for i, j in ((1, 2), (2, 3), (3, 1)))))
    paint = terrain.table("paint").select("airdrome_id", F.struct("n1", "e1", "n2", "e2", "n3", "e3").alias("p")).select("airdrome_id", sides.alias("s")).select("airdrome_id", "s.*")
    un, ue = dn / F.col("length"), de / F.col("length")
    along = lambda n, e: (F.col(n) - F.col("n1")) * un + (F.col(e) - F.col("e1")) * ue
    across = lambda n, e: (F.col(e) - F.col("e1")) * un - (F.col(n) - F.col("n1")) * ue
    crossed = stations.join(paint, "airdrome_id").withColumns({"sa": along("na", "ea"), "sb": along("nb", "eb"), "xa": across("na", "ea"), "xb": across("nb", "eb")})
    s = F.col("t") * F.col("length")
    crossed = crossed.where((F.least("sa", "sb") <= s) & (F.greatest("sa", "sb") >= s) & (F.abs(F.col("sa") - F.col("sb")) > 1e-9))
    edge = F.col("xa") + (s - F.col("sa")) / (F.col("sb") - F.col("sa")) * (F.col("xb") - F.col("xa"))
    widths = crossed.groupBy("airdrome_id", "name", "k").agg((F.max(edge) - F.min(edge)).alias("w")).groupBy("airdrome_id", "name").agg(F.median("w").alias("width"))
    steps = F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / STEP).cast("int")))
    line = lines.select("airdrome_id", "name", "n1", "e1", "n2", "e2", "length", steps.alias("k")).withColumn("t", F.least(F.col("k") * STEP / F.col("length"), F.lit(1.0)))
    line = line.select(F.monotonically_increasing_id().alias("id"), "airdrome_id", "name", (F.col("n1") + dn * F.col("t")).alias("n"), (F.col("e1") + de * F.col("t")).alias("e"))
    tops = points.ground(terrain, line).groupBy("airdrome_id", "name").agg(F.max("height").alias("elevation"))
    ends = F.explode(F.array(F.struct(F.col("edge1").alias("designator"), F.col("n1").alias("n"), F.col("e1").alias("e"), P.bearing(dn, de).alias("course_deg")), F.struct(F.col("edge2").alias("designator"), F.col("n2").alias("n"), F.col("e2").alias("e"), P.bearing(-dn, -de).alias("course_deg"))))
    out = lines.select("airdrome_id", "name", "length", ends.alias("x")).select("airdrome_id", "name", "length", "x.designator", "x.course_deg", "x.n", "x.e")
    m = P.Staged(out)
    lat, lon = P.latlon(F.col("n"), F.col("e"), m=m)
    out = m.done(lat=lat, lon=lon).drop("n", "e")
    return out.join(widths, ["airdrome_id", "name"], "left").join(tops, ["airdrome_id", "name"], "left")


def airfield_info(terrain: Terrain, width: float | None = None, length: float | None = None) -> DataFrame:
    """Runway ends with the stands that an aircraft of the given size fits, the beacons and the radio of their airfield."""
    stands = terrain.table("stands").groupBy("airdrome_id").agg(F.count("*").alias("stands"), F.count_if(fits(width, length)).alias("stands_fitting"))
    beacons = terrain.table("beacons").groupBy("airdrome_id").agg(F.count("*").alias("beacons"))
    radio = terrain.table("radio").groupBy("airdrome_id").agg(F.min("vhf").alias("vhf"))
    out = runways(terrain)
    for part in (stands, beacons, radio):
        out = out.join(part, "airdrome_id", "left")
    return out.fillna(0, ["stands", "stands_fitting", "beacons"])


def stand_sizes(terrain: Terrain) -> DataFrame:
    """(airdrome_id, width, length, stands): unknown sizes are a group, widest first."""
    return terrain.table("stands").groupBy("airdrome_id", "width", "length").agg(F.count("*").alias("stands")).orderBy("airdrome_id", F.desc_nulls_last("width"), F.desc_nulls_last("length"))


def describe(terrain: Terrain) -> DataFrame:
    """(what, n): counts of what the terrain holds, by kind."""
    cells = terrain.known_cells().where("h is not null")
    parts = [
        cells.groupBy(F.concat(F.lit("cover_"), F.col("cover").cast("string")).alias("what")).agg(F.count("*").alias("n")),
        terrain.objects().groupBy(F.concat(F.lit("scenery_"), F.col("class")).alias("what")).agg(F.count("*").alias("n")),
        terrain.table("edges").where(F.col("kind") == ROAD).agg(F.lit("roads").alias("what"), F.count("*").alias("n")),
    ]
    for name in ("towns", "airdromes", "runways", "stands", "beacons"):
        parts.append(terrain.table(name).agg(F.lit(name).alias("what"), F.count("*").alias("n")))
    out = parts[0].unionByName(parts[0].agg(F.lit("cells").alias("what"), F.sum("n").alias("n")))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
