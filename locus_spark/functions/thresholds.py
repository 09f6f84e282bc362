"""Thresholds and curves from histograms; scores over ranked columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins from ``low`` to ``high``; values outside fall into the end bins."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col(column) - low) / width), F.lit(0)), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def false_rate_threshold(real: DataFrame, noise: DataFrame, column: str, low: float, high: float, bins: int = 100, rate: float = 0.01, fdr: bool = False) -> float:
    """The smallest bin edge above which noise makes up at most ``rate``: of all noise, or
    (``fdr``) of what is above. ``high`` if no edge does. Only ``bins`` counts reach the driver."""
    counts = []
    for df in (real, noise):
        n = np.zeros(bins)
        for r in histogram(df, column, low, high, bins).collect():
            n[r["bin"]] = r["n"]
        counts.append(n[::-1].cumsum()[::-1])
    above, wrong = counts
    if fdr:
        share = wrong / np.maximum(above + wrong, 1)
    else:
        share = wrong / max(1.0, wrong[0])
    good = np.flatnonzero(share <= rate)
    return float(low + (high - low) / bins * good[0]) if len(good) else float(high)


def power_law(df: DataFrame, column: str, low: float, high: float, bins: int = 100) -> tuple[float, float]:
    """Slope and intercept of log counts against log values of a histogram."""
    rows = histogram(df.filter(F.col(column) > 0), column, low, high, bins).collect()
    x = np.log10([low + (high - low) / bins * (r["bin"] + 0.5) for r in rows])
    slope, intercept = np.polyfit(x, np.log10([r["n"] for r in rows]), 1) if len(rows) > 1 else (float("nan"), float("nan"))
    return float(slope), float(intercept)


def binned_percentile(df: DataFrame, x: str, y: str, percent: float, least_width: float, least_count: int) -> DataFrame:
    """Percentiles of y in bins of x that are at least so wide and so full, in order of x.

    The cuts come from counts in steps of ``least_width``; the greedy fold runs over those
    steps alone, as many as the range of x has, in one array.
    """
    step = F.floor(F.col(x) / least_width).alias("step")
    steps = df.filter(F.col(x).isNotNull()).groupBy(step).agg(F.count("*").alias("n"))
    folded = steps.agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("s")).select(F.explode(F.expr(f"""aggregate(s,
        named_struct('bin', 0, 'held', 0L, 'out', cast(array() AS ARRAY<STRUCT<step: BIGINT, bin: INT>>)),
        (acc, v) -> named_struct('bin', CASE WHEN acc.held + v.n >= {least_count} THEN acc.bin + 1 ELSE acc.bin END,
            'held', CASE WHEN acc.held + v.n >= {least_count} THEN 0L ELSE acc.held + v.n END,
            'out', concat(acc.out, array(named_struct('step', v.step, 'bin', acc.bin)))), acc -> acc.out)""")).alias("e"))
    cut = df.withColumn("step", step).join(folded.select("e.step", "e.bin"), "step")
    return cut.groupBy("bin").agg(F.min(x).alias("minx"), F.max(x).alias("maxx"), F.count("*").alias("cnt"), F.percentile(y, percent / 100).alias("value"))


def smooth(track: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """Mean of the value over positions within ``half`` of each run's start, from 0 on, weighted by overlap.

    The runs of a track are disjoint, so those within reach of a start are the ones that begin there
    and the last one before. Runs are dealt into tiles of positions, each with what lies in reach of
    it; no pairs are made and no sum is carried on.
    """
    track = track.select(*keys, "st", "ed", F.coalesce("value", F.lit(0)).alias("value"))
    place, tile = [*keys, "_tile"], max(1 << 14, 4 * half + 4)
    dealt = F.explode(F.expr(f"sequence(floor((st - {half}) / {tile}), floor((ed - 1 + {half}) / {tile}))"))
    rows = track.filter("st < ed").withColumns({"_tile": dealt}).withColumn("_own", F.floor(F.col("st") / tile) == F.col("_tile"))
    order = W.partitionBy(*place).orderBy("st")
    near, back = order.rangeBetween(-half, half), order.rangeBetween(W.unboundedPreceding, -half - 1)
    low, high = F.greatest(F.col("st") - half, F.lit(0)), F.col("st") + half + 1
    # Of the runs that begin in reach only the last can be longer than the reach.
    length = lambda run: F.least(F.greatest(run("ed") - F.greatest(run("st"), F.lit(0)), F.lit(0)), F.lit(2 * half + 1))
    last, prev = (lambda c: F.col("_last")[c]), (lambda c: F.col("_prev")[c])
    run = F.struct("st", "ed", "value")
    rows = rows.withColumns({"_sum": F.sum(F.col("value") * length(F.col)).over(near), "_last": F.last(run).over(near), "_prev": F.last(run).over(back)}).filter("_own")
    inside = F.when(length(last) > 0, F.least(length(last), high - F.greatest(last("st"), F.lit(0)))).otherwise(0)
    over = last("value") * (length(last) - inside)
    before = F.coalesce(prev("value") * F.greatest(prev("ed") - low, F.lit(0)), F.lit(0))
    return rows.select(*keys, low.alias("st"), high.alias("ed"), F.try_divide(F.col("_sum") - over + before, high - low).alias("cov"))


def first_gap(track: DataFrame, keys: Sequence[str], least: float, longer: int) -> DataFrame:
    """Per key the first stretch at or below ``least`` that is longer than ``longer``: st, len."""
    from locus_spark.operators.intervals import merge

    low = merge(track.filter(F.col("value") <= least), keys).filter(F.col("ed") - F.col("st") > longer)
    return low.groupBy(*keys).agg(F.min(F.struct("st", (F.col("ed") - F.col("st")).alias("len"))).alias("x")).select(*keys, "x.st", "x.len")


def merge_sort_key(df: DataFrame, key: str, columns: Sequence[str], limit: float) -> DataFrame:
    """Rows with hits (columns beyond ``limit`` in magnitude), side (pos, neg, mix or none), the
    first column that hits and the total strength; sorted ranks are left to the caller."""
    up = [F.when(F.col(c) >= limit, 1).otherwise(0) for c in columns]
    down = [F.when(F.col(c) <= -limit, 1).otherwise(0) for c in columns]
    first = F.coalesce(*(F.when(F.abs(F.col(c)) >= limit, F.lit(k)) for k, c in enumerate(columns)))
    strength = sum((F.when(F.abs(F.col(c)) >= limit, F.abs(F.col(c))).otherwise(0.0) for c in columns), F.lit(0.0))
    out = df.withColumns({"_u": sum(up, F.lit(0)), "_d": sum(down, F.lit(0))})
    side = F.expr("CASE WHEN _u > 0 AND _d > 0 THEN 'mix' WHEN _u > 0 THEN 'pos' WHEN _d > 0 THEN 'neg' ELSE 'none' END")
    return out.select(key, (F.col("_u") + F.col("_d")).alias("hits"), side.alias("side"), first.alias("first_hit"), strength.alias("strength"))


def select_by_lfc_and_q(df: DataFrame, lfc: str, p: str, least_lfc: float, most_q: float, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Rows with a large enough effect whose p, adjusted among those, is below ``most_q``."""
    from locus_spark.functions.stats import p_adjust

    strong = df.filter(F.abs(F.col(lfc)) >= least_lfc)
    return p_adjust(strong, p, "BH", by, "q", order).filter(F.col("q") < most_q)


def ranked_names(df: DataFrame, group: str, order: Sequence[str], name: str = "tname") -> DataFrame:
    """Names ``group.1``, ``group.2``, .. in order within a (bounded) group."""
    return df.withColumn(name, F.concat(F.col(group).cast("string"), F.lit("."), F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("string")))
