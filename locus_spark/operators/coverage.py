"""Coverage tracks as runs (keys.., st, ed, value) and aggregates of them over intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.operators.intervals import KEYS, TILE, deltas, merge, overlap_join, overlap_pairs, runs
from locus_spark.plans.materialize import materialize, once


def coverage(df: DataFrame, keys: Sequence[str] = KEYS, weight: Column | None = None, scale: float | None = None, digits: int | None = None, tile: int = TILE) -> DataFrame:
    """Depth of the intervals, each counting ``weight``, times ``scale``; no runs of zero."""
    out = runs(deltas(df, keys, weight), keys, digits, tile=tile).filter("value <> 0")
    return out if scale is None else out.withColumn("value", F.col("value") * F.lit(scale))


def threshold(track: DataFrame, least: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Islands of touching runs above ``least``."""
    return merge(track.filter(F.col("value") > least), keys).select(*keys, "st", "ed")


def combine(tracks: Sequence[DataFrame], signs: Sequence[float] | None = None, keys: Sequence[str] = KEYS, scale: float = 1.0, digits: int = 9) -> DataFrame:
    """Weighted sum of tracks."""
    every = None
    for track, sign in zip(tracks, signs or [1.0] * len(tracks)):
        part = deltas(track.withColumn("_v", F.col("value").cast("double") * sign), keys, F.col("_v"))
        every = part if every is None else every.unionByName(part)
    return runs(every, keys, digits).filter("value <> 0").withColumn("value", F.col("value") * F.lit(scale))


def combined_coverage(
    sets: Sequence[DataFrame], signs: Sequence[int] | None = None, keys: Sequence[str] = KEYS, scale: float = 1.0, digits: int = 9, tile: int = TILE
) -> DataFrame:
    """``combine`` of the depths of several sets of intervals, in one sweep: a track of depth changes
    where its intervals begin and end, so their tracks need not be made first."""
    every = None
    for df, sign in zip(sets, signs or [1] * len(sets)):
        part = deltas(df, keys, F.lit(float(sign)))
        every = part if every is None else every.unionByName(part)
    return runs(every, keys, digits, tile=tile).filter("value <> 0").withColumn("value", F.col("value") * F.lit(scale))


def track_stats(track: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key: totbp, covbp and acov of a track."""
    size = F.col("ed") - F.col("st")
    out = track.groupBy(*keys).agg(F.sum(F.col("value") * size).alias("totbp"), F.sum(F.when(F.col("value") > 0, size)).alias("covbp"))
    return out.withColumn("acov", F.try_divide("totbp", "covbp"))


def bin_summary(track: DataFrame, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per bin of ``width``: covered bases, mean over them, least and largest value, sum of squares."""
    cut = track.withColumn("bin", F.explode(F.expr(f"sequence(st div {width}, (ed - 1) div {width})")))
    part = F.least(F.col("ed"), (F.col("bin") + 1) * width) - F.greatest(F.col("st"), F.col("bin") * width)
    cut = cut.withColumn("_n", part)
    out = cut.groupBy(*keys, "bin").agg(
        F.sum("_n").alias("covered"), F.sum(F.col("value") * F.col("_n")).alias("total"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.col("value") * F.col("value") * F.col("_n")).alias("squares"),
    )
    return out.withColumn("mean", F.try_divide("total", "covered"))


def summary_over(df: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Distinct positions with cov (length-weighted mean) and max of the track on them, 0 where it has none.

    Pairs are grouped first, then joined to the positions once.
    """
    at = [*keys, "st", "ed"]
    spots = once(df.select(*at).distinct(), "spots")
    track = track if sorted(track.columns) == sorted([*at, "value"]) else track.select(*at, "value")
    pairs = overlap_pairs(spots, track, keys, width)
    found = pairs.groupBy(*at).agg(F.sum(F.col("b_value") * F.col("ovl")).alias("_t"), F.max("b_value").alias("_m"))
    mean = F.coalesce("_t", F.lit(0)) / (F.col("ed") - F.col("st"))
    return spots.join(found, at, "left").select(*at, mean.alias("cov"), F.coalesce("_m", F.lit(0)).alias("max"))


def mean_over(df: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Distinct positions with cov: the length-weighted mean of the track, 0 where it has none."""
    return summary_over(df, track, keys, width).drop("max")


def max_over(df: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Distinct positions with the largest value of the track on them, 0 where it has none."""
    return summary_over(df, track, keys, width).drop("cov").withColumnRenamed("max", "cov")


def gene_coverage(members: DataFrame, parts: DataFrame, gene: str = "gid") -> DataFrame:
    """Per gene: len, gcov over all its parts and gcov2 over those with coverage.

    ``members`` (gene, chr, st, ed) name the atomic parts of a gene, ``parts`` their cov.
    """
    at = ["chr", "st", "ed"]
    one = members.select(gene, *at).distinct().join(parts, at)
    size = F.col("ed") - F.col("st")
    out = one.groupBy(gene).agg(
        F.sum(size).alias("len"), F.sum(F.col("cov") * size).alias("_v"), F.sum(F.when(F.col("cov") > 0, size)).alias("_l2"),
        F.min("st").alias("st"), F.max("ed").alias("ed"))
    return out.select(gene, "st", "ed", "len", (F.col("_v") / F.col("len")).alias("gcov"), F.coalesce(F.try_divide("_v", "_l2"), F.lit(0.0)).alias("gcov2"))


def gene_length(df: DataFrame, gene: str = "gid", keys: Sequence[str] = KEYS) -> DataFrame:
    """Per gene: bases of the union of its intervals, their log10, and its span."""
    union = merge(df, [gene, *keys])
    out = union.groupBy(gene).agg(F.sum(F.col("ed") - F.col("st")).alias("tlen"), F.min("st").alias("gst"), F.max("ed").alias("ged"))
    return out.withColumns({"glen": F.col("ged") - F.col("gst"), "ltlen": F.log10("tlen")})


def value_at(points: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Distinct points (keys, pos) with the value of the track there, 0 outside it."""
    at = points.select(*keys, F.col("pos").alias("st"), (F.col("pos") + 1).alias("ed")).distinct()
    return overlap_join(at, track, "left", keys, width).select(*keys, F.col("st").alias("pos"), F.coalesce("b_value", F.lit(0)).alias("value"))


def flux(exons: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Distinct exons with the track just outside and inside both ends, and the log2 steps there."""
    at = [*keys, "st", "ed"]
    spots = {"s_out": F.col("st") - 1, "s_in": F.col("st"), "e_in": F.col("ed") - 1, "e_out": F.col("ed")}
    out = exons.select(*at).distinct()
    long = out.select(*at, F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in spots)), F.array(*spots.values()))).alias("spot", "pos"))
    found = long.join(value_at(long, track, keys, width), [*keys, "pos"], "left")
    wide = found.groupBy(*at).pivot("spot", list(spots)).agg(F.first("value"))
    step = {"s_step": F.log2(F.col("s_in") + 1) - F.log2(F.col("s_out") + 1), "e_step": F.log2(F.col("e_in") + 1) - F.log2(F.col("e_out") + 1)}
    return wide.withColumns(step)


def _log2(value: Column) -> Column:
    """log2 as the C library rounds it. Spark's, a quotient of two logarithms, is off by more, so that doublings
    from 5 and 6 came out above 1. Depths repeat, so each value of a batch is worked out once."""

    @F.pandas_udf("double")
    def log2(v: pd.Series) -> pd.Series:
        return v.map({x: math.log2(x) if x > 0 else (-math.inf if x == 0 else math.nan) for x in v.dropna().unique()})

    return log2(value.cast("double"))


def changes(track: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions where the log2 of a track steps, with the step; runs that don't touch fall to 0 between."""
    log = _log2(F.col("value") + 1)
    ends = F.explode(F.array(F.struct(F.col("st").alias("pos"), F.col("_l").alias("d")), F.struct(F.col("ed").alias("pos"), (-F.col("_l")).alias("d")))).alias("x")
    return track.select(*keys, "st", "ed", log.alias("_l")).select(*keys, ends).select(*keys, "x.pos", "x.d").groupBy(*keys, "pos").agg(F.sum("d").alias("step")).filter("abs(step) > 1e-12")


def single_exon_candidates(track: DataFrame, exons: DataFrame, least_size: int, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Covered stretches away from all exons, at least ``least_size`` long, with their mean coverage."""
    size = F.col("ed") - F.col("st")
    # The runs of a stretch are disjoint and fill it: its mean is their area by its length.
    islands = merge(track.filter("value > 0").withColumn("_area", F.col("value") * size), keys, sums=["_area"]).filter(size >= least_size)
    free = overlap_join(islands.select(*keys, "st", "ed", "_area"), exons, "anti", keys, width)
    return free.select(*keys, "st", "ed", (F.col("_area") / size).alias("cov"))


def highest(df: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """The largest value of the rows over each part between neighbouring ends, as disjoint runs; rows may overlap."""
    rows = once(df.select(*keys, "st", "ed", "value"), "rows")
    parts = runs(deltas(rows, keys), keys, keep_flat=True).filter("value > 0").select(*keys, "st", "ed")
    return overlap_pairs(parts, rows, keys, width).groupBy(*keys, "st", "ed").agg(F.max("b_value").alias("value"))


def overlay_max(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """The larger of two tracks at every position, as maximal runs.

    The runs of a track are disjoint, so one sweep knows the value of each from its last
    event: no pairs, and no sums that fractions would blur.
    """
    place, order = [*keys, "_tile"], W.partitionBy(*keys).orderBy("_tile")
    both = a.select(*keys, "st", "ed", "value", F.lit(0).alias("_t")).unionByName(b.select(*keys, "st", "ed", "value", F.lit(1).alias("_t")))
    ends = F.explode(F.array(F.struct(F.col("st").alias("pos"), F.col("value").alias("v")), F.struct(F.col("ed").alias("pos"), F.nullif(F.col("value"), F.col("value")).alias("v")))).alias("x")
    events = both.filter("st < ed").select(*keys, "_t", ends).select(*keys, "_t", "x.pos", "x.v")
    own = [F.when(F.col("_t") == k, F.col("v")) for k in (0, 1)]
    point = events.groupBy(*keys, "pos").agg(*(F.max(own[k]).alias(f"_v{k}") for k in (0, 1)), *(F.count_if(F.col("_t") == k).alias(f"_n{k}") for k in (0, 1)))
    point = point.withColumn("_tile", F.floor(F.col("pos") / F.lit(tile)))
    at = [F.when(F.col(f"_n{k}") > 0, F.col("pos")) for k in (0, 1)]
    tiles = point.groupBy(*place).agg(*(F.max(at[k]).alias(f"_p{k}") for k in (0, 1)), *(F.max_by(f"_v{k}", at[k]).alias(f"_v{k}") for k in (0, 1)))
    held = [F.last(F.when(F.col(f"_p{k}").isNotNull(), F.struct(f"_v{k}")), True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias(f"_c{k}") for k in (0, 1)]
    inside = W.partitionBy(*place).orderBy("pos")
    event = [F.when(F.col(f"_n{k}") > 0, F.struct(f"_v{k}")) for k in (0, 1)]
    last = [F.last(event[k], True).over(inside.rowsBetween(W.unboundedPreceding, n)).alias(f"_{name}{k}") for k in (0, 1) for name, n in (("now", 0), ("was", -1))]
    known = point.select(*place, "pos", *last).join(tiles.select(*place, *held), place)
    value = {name: F.nullif(F.greatest(*(F.coalesce(f"_{name}{k}", f"_c{k}")[f"_v{k}"] for k in (0, 1))), F.lit(0)) for name in ("now", "was")}
    steps = known.select(*place, "pos", value["now"].alias("value"), value["was"].alias("_was")).filter("NOT (value <=> _was)").drop("_was")
    steps = materialize(steps, "steps")
    firsts = steps.groupBy(*place).agg(F.min("pos").alias("_first")).select(*place, F.lead("_first").over(order).alias("_next"))
    out = steps.withColumn("_after", F.lead("pos").over(inside)).join(firsts, place).filter("value IS NOT NULL")
    return out.select(*keys, F.col("pos").alias("st"), F.coalesce("_after", "_next").alias("ed"), "value")


def fill_exon_gaps(track: DataFrame, exons: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """A junction track carried across exons: inside, at least the smaller of the values beside them."""
    track = once(track, "track")
    beside = flux(exons, track, keys, width).select(*keys, "st", "ed", F.least("s_out", "e_out").alias("value")).filter("value > 0")
    return overlay_max(track, highest(beside, keys, width), keys)
