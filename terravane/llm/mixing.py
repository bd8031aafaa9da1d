"""Mixing sources to target weights (native: DataFrame functions only).

Every document gets a hash-random key.  Within a source the keys are cut into
``16 ** KEY_DIGITS`` ranges, the token counts of the ranges are prefix-summed,
and only the one range that straddles the budget is sorted row by row, so no
task ever sees a whole source.  Whole epochs come first; the last, partial
epoch takes the documents up to the cut key.

Defined results: a null or blank text has size 0; a null source is a source of
its own, ordered last; rows alike in id and text share one key and are taken
together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WORD = r"[^\x20\x09-\x0D]+"
KEY_DIGITS = 3
#: Up to this many sources the plan (one short row each) is sent to every task; beyond, it is joined.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _columns(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "__tv_source": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("z")),
        "__tv_key": F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))),
    }


def plan_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """One row per source: source_size, target, whole epochs and the cut key.

    Weights are dealt to the sources in code-point order, repeating.  Targets
    are the water level ``min(most_epochs * size, weight * level)`` whose sum is
    the size of the corpus, which is where repeated resharing of the excess ends.
    """
    light = stash(docs.select(*(c.alias(n) for n, c in _columns(id_col, text_col, source_col).items()), word_count(F.col(text_col)).alias("size")), "mix")
    by_range = light.groupBy("__tv_source", F.substring("__tv_key", 1, KEY_DIGITS).alias("range")).agg(F.sum("size").alias("size"))
    by_range = stash(by_range, "mix-ranges")
    sources = by_range.groupBy("__tv_source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on: windows without a partition see those only
    every = Window.orderBy("__tv_source")
    cap = F.col("source_size") * F.lit(most_epochs)
    deal = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", deal).withColumn("ratio", cap / F.col("weight"))
    up = Window.orderBy("ratio", "__tv_source")
    all_rows = Window.orderBy("ratio", "__tv_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("before", F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("rest", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("level_here", (F.col("total") - F.coalesce("before", F.lit(0))) / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "__tv_source", "level_here"))).over(all_rows)["level_here"])
        .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level")))
    )
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    targets = filled.withColumn("epochs", epochs).select("__tv_source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))
    run = Window.partitionBy("__tv_source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_range = (
        by_range.withColumn("end", F.sum("size").over(run))
        .join(targets.select("__tv_source", "budget"), "__tv_source")
        .where("end > budget and end - size <= budget")
        .groupBy("__tv_source")
        .agg(F.min(F.struct("range", (F.col("budget") - (F.col("end") - F.col("size"))).alias("left"))).alias("cut"))
        .select("__tv_source", "cut.range", "cut.left")
    )
    keyed = Window.partitionBy("__tv_source").orderBy("__tv_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_key = (
        light.withColumn("range", F.substring("__tv_key", 1, KEY_DIGITS))
        .join(cut_range, ["__tv_source", "range"])
        .withColumn("end", F.sum("size").over(keyed))
        .groupBy("__tv_source")
        .agg(F.max(F.when(F.col("end") - F.col("size") / 2 <= F.col("left"), F.col("__tv_key"))).alias("key"), F.min("range").alias("range"))
        .select("__tv_source", F.coalesce("key", "range").alias("cut_key"))
    )
    return targets.join(cut_key, "__tv_source", "left").select("__tv_source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit("")).alias("cut_key"))


def with_times(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_epochs: int = 3) -> DataFrame:
    """The rows with ``__tv_source_size``, ``__tv_target`` and ``__tv_times`` (how often the mix takes them)."""
    plan = stash(plan_sources(docs, id_col, text_col, source_col, weights, most_epochs), "mix-plan")
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    plan = plan.select("__tv_source", F.col("source_size").alias("__tv_source_size"), F.col("target").alias("__tv_target"), F.col("epochs").alias("__tv_epochs"), F.col("cut_key").alias("__tv_cut"))
    times = F.col("__tv_epochs") + (F.col("__tv_key") <= F.col("__tv_cut")).cast("long")
    return docs.withColumns(_columns(id_col, text_col, source_col)).join(plan, "__tv_source").withColumn("__tv_times", times).drop("__tv_source", "__tv_key", "__tv_epochs", "__tv_cut")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, a row for each time it is taken."""
    taken = with_times(docs, **options).where("__tv_times > 0")
    return taken.withColumn("__tv_epoch", F.explode(F.sequence(F.lit(1), F.col("__tv_times").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
