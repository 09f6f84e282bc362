"""Ranks and running extremes over any number of rows, by ranges instead of one window."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.plans.materialize import materialize


def number_rows(df: DataFrame, order: Sequence[str], name: str = "_id") -> DataFrame:
    """Dense numbers from 0 in the order of ``order``, and _part, the range a row lies in.

    Rows are dealt into sorted ranges and written; each range is numbered by itself and
    starts where the counts of those before it end (one row per range).
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(counts), "_part").withColumn(name, number + F.col("_before")).drop("_n", "_before")


def _with(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their keys; null keys are equal."""
    other = summary.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return rows.join(other, same, "left").drop(*(f"_key{i}" for i in range(len(keys))))


def rank_in_families(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """_r (from 1 in the order of ``order``) and _n (rows) within the families ``by``; a family may hold all rows."""
    rows = number_rows(df, [*by, *order])
    family = rows.groupBy(*by).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    joined = _with(rows, family, by) if by else rows.crossJoin(F.broadcast(family))  # without families, one row
    return joined.withColumn("_r", F.col("_id") - F.col("_first") + 1).drop("_first")


def running(ranked: DataFrame, by: Sequence[str], value: Column, name: str, least: bool, upwards: bool) -> DataFrame:
    """Running least (or greatest) of ``value`` in rank order, or against it, within families.

    Ranges are summarised and carry into those that follow; the window inside a range is bounded by it.
    """
    pick: Callable = F.min if least else F.max
    ranked = ranked.withColumn("_v", value)
    before = W.partitionBy(*(by or [F.lit(1)])).orderBy("_part" if upwards else F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    parts = ranked.groupBy(*by, "_part").agg(pick("_v").alias("_x")).withColumn("_carry", pick("_x").over(before)).drop("_x")
    inside = W.partitionBy("_part", *by).orderBy("_id" if upwards else F.desc("_id")).rowsBetween(W.unboundedPreceding, 0)
    both = (F.least if least else F.greatest)(pick("_v").over(inside), F.col("_carry"))
    return _with(ranked, parts, [*by, "_part"]).withColumn(name, both).drop("_v", "_carry")
