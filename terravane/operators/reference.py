"""Reference data: fitting a projection, names that nearly match, figures about samples, listings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection as P
from ..plans.cluster import shared_dir
from ..sources.catalog import Terrain
from ..sources.synthetic import Form

#: Metres off the median beyond which a sample does not count in a fit, and how many must be left.
OUTLIER, LEAST_SAMPLES = 5.0, 3
# Fixed values, metres: how far beacons and a tower speak for an airdrome.
BEACON_REACH, TOWER_REACH = 15_000.0, 1000.0
# Fixed value: the quantile of the 95 % interval.
Z95 = 1.959963984540054
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fit_projection(samples: DataFrame) -> DataFrame:
    """(lon0, easting, northing, rms, n) of the whole-degree meridian that fits samples (x, z, lat, lon) best.

    For each meridian the offsets' medians are taken, samples that lie ``OUTLIER``
    metres or more off them are dropped, and the mean offsets and their spread
    remain; fewer than three samples fit nothing.
    """
    lon = samples.agg(F.floor(F.min("lon") - 3).alias("a"), F.ceil(F.max("lon") + 3).alias("b"))
    tried = samples.join(F.broadcast(lon)).withColumn("lon0", F.explode(F.sequence("a", "b")))
    m = P.Staged(tried.select("x", "z", "lat", "lon", F.col("lon0").cast("double").alias("lon0")))
    n, e = P.krueger(F.col("lat"), F.col("lon") - F.col("lon0"), m)
    off = m.done(dn=n - F.col("x"), de=e - F.col("z"))
    middle = off.groupBy("lon0").agg(F.median("dn").alias("mn"), F.median("de").alias("me"))
    gap = lambda a, b, c, d: F.sqrt((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) + (F.col(c) - F.col(d)) * (F.col(c) - F.col(d)))
    near = off.join(middle, "lon0").where(gap("dn", "mn", "de", "me") < OUTLIER)
    fits = near.groupBy("lon0").agg(F.avg("dn").alias("northing"), F.avg("de").alias("easting"), F.sqrt(F.var_pop("dn") + F.var_pop("de")).alias("rms"), F.count("*").alias("n")).where(F.col("n") >= LEAST_SAMPLES)
    # a meridian that keeps more samples fits better than one that keeps few of them closely
    return fits.orderBy(F.desc("n"), "rms", "lon0").limit(1).select("lon0", "easting", "northing", "rms", "n")


def airdrome_at(terrain: Terrain, places: DataFrame) -> DataFrame:
    """The places (id, n, e) with the airdrome that the beacons within 15 km agree on, else the one whose own point lies within 1 km."""
    gap = lambda a, b: F.sqrt((F.col(a) - F.col("n")) * (F.col(a) - F.col("n")) + (F.col(b) - F.col("e")) * (F.col(b) - F.col("e")))
    side = lambda reach, a, b: (F.floor(F.col(a) / reach).cast("long").alias("qr"), F.floor(F.col(b) / reach).cast("long").alias("qc"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))

    def met(table: str, reach: float) -> DataFrame:
        asked = places.select("id", "n", "e", *side(reach, "n", "e"), around.alias("k")).withColumns({"qr": F.col("qr") + F.col("k.i"), "qc": F.col("qc") + F.col("k.j")})
        things = terrain.table(table).select("airdrome_id", F.col("n").alias("tn"), F.col("e").alias("te")).select("airdrome_id", "tn", "te", *side(reach, "tn", "te"))
        return asked.join(things, ["qr", "qc"]).where(gap("tn", "te") <= reach)

    agreed = met("beacons", BEACON_REACH).groupBy("id").agg(F.countDistinct("airdrome_id").alias("kinds"), F.min("airdrome_id").alias("by_beacon")).where("kinds = 1")
    tower = met("airdromes", TOWER_REACH).groupBy("id").agg(F.min(F.struct(gap("tn", "te"), "airdrome_id")).alias("t")).select("id", F.col("t.airdrome_id").alias("by_tower"))
    out = places.join(agreed.select("id", "by_beacon"), "id", "left").join(tower, "id", "left")
    return out.withColumn("airdrome_id", F.coalesce("by_beacon", "by_tower")).drop("by_beacon", "by_tower")


def folded(text: Column) -> Column:
    """Lower case, without accents and without what is neither letter nor digit."""
    return F.regexp_replace(F.translate(F.lower(text), *ACCENTS), "[^a-z0-9]", "")


def alike(terrain: Terrain, name: str, most: int = 3) -> DataFrame:
    """(kind, name, edits) of the towns and airdromes whose folded names take the fewest edits, a third of their length at most."""
    names = terrain.table("towns").select(F.lit("town").alias("kind"), "name").unionByName(terrain.table("airdromes").select(F.lit("airdrome").alias("kind"), F.col("display_name").alias("name")))
    edits = names.withColumn("edits", F.levenshtein(folded(F.col("name")), folded(F.lit(name))))
    return edits.where(F.col("edits") * 3 <= F.length(folded(F.col("name")))).orderBy("edits", "kind", "name").limit(most)


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    p, z2 = hits / n, Z95 * Z95
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return middle - half, middle + half


def terrains(spark: SparkSession) -> list[tuple[str, Form]]:
    """(path, form) of the synthetic terrains written to the shared folder."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    found = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(base, "terrain-*/done/_SUCCESS"))
    paths = sorted(str(s.getPath().getParent().getParent()) for s in found or ())
    return [(p, Form(**json.loads(spark.read.schema("form string").parquet(f"{p}/done").first()[0]))) for p in paths]
