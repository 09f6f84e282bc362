"""Comparing, annotating and collecting models; sequences in tiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.operators.intervals import KEYS, overlap_join, overlap_pairs


def closest_match(ref: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Per reference interval the overlapping target closest in length (ties: smallest position, id)."""
    pair = overlap_pairs(ref, target, keys, width).withColumn("dlen", F.abs((F.col("b_ed") - F.col("b_st")) - (F.col("ed") - F.col("st"))))
    best = F.min(F.struct("dlen", "b_st", "b_ed", "b_id")).alias("x")
    out = pair.groupBy(*keys, "st", "ed", "id").agg(best)
    return out.select(*keys, "st", "ed", "id", "x.b_st", "x.b_ed", "x.b_id", "x.dlen")


def match_counts(ref: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """How many reference intervals are hit, exactly and at one end at least."""
    pair = overlap_pairs(ref.select(*keys, "st", "ed"), target.select(*keys, "st", "ed"), keys, width)
    flags = pair.groupBy(*keys, "st", "ed").agg(
        F.bool_or((F.col("st") == F.col("b_st")) & (F.col("ed") == F.col("b_ed"))).alias("x"), F.bool_or((F.col("st") == F.col("b_st")) | (F.col("ed") == F.col("b_ed"))).alias("s"))
    found = flags.agg(F.count("*").alias("hit"), F.count_if("x").alias("exact"), F.count_if("s").alias("one_side"))
    return ref.agg(F.count("*").alias("pop")).crossJoin(found).withColumn("rate", F.try_divide("hit", "pop"))  # two rows of one


def completeness(ref: DataFrame, target: DataFrame, gene: str, target_gene: str, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Per reference gene: the most of its elements that one target gene overlaps, over all."""
    pair = overlap_pairs(ref.select(*keys, "st", "ed", gene), target.select(*keys, "st", "ed", target_gene), keys, width)
    # Distinct elements first: counts then need no second distinct shuffle per target.
    per = pair.select(gene, f"b_{target_gene}", *keys, "st", "ed").distinct().groupBy(gene, f"b_{target_gene}").agg(F.count("*").alias("n"))
    best = per.groupBy(gene).agg(F.max("n").alias("best"))
    out = ref.groupBy(gene).agg(F.count("*").alias("total")).join(best, gene, "left")
    return out.withColumn("best", F.coalesce("best", F.lit(0))).withColumn("completeness", F.col("best") / F.col("total"))


def top_overlap(ref: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Per reference id the target id with most overlapping elements (then bases, then smallest id), and all."""
    pair = overlap_pairs(ref, target, keys, width).groupBy("id", "b_id").agg(F.count("*").alias("n"), F.sum("ovl").alias("bases"))
    return pair.groupBy("id").agg(
        F.max(F.struct("n", "bases", (-F.col("b_id")).alias("m"))).alias("x"), F.array_join(F.array_sort(F.collect_set(F.col("b_id").cast("string"))), ",").alias("every")
    ).select("id", (-F.col("x.m")).alias("top"), "x.n", "x.bases", "every")


def annotate(query: DataFrame, known: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Query rows with code (k.me or k.se: a known multi- or single-exon element on the same
    strand; u: none), antisense and intergenic. ``known`` has strand and multi."""
    at = [*keys, "st", "ed"]
    pair = overlap_pairs(query.select(*at, "strand").distinct(), known, keys, width)
    same = F.col("strand") == F.col("b_strand")
    flag = pair.groupBy(*at, "strand").agg(F.bool_or(same & F.col("b_multi")).alias("me"), F.bool_or(same & ~F.col("b_multi")).alias("se"), F.bool_or(~same).alias("anti"))
    out = query.join(flag, [*at, "strand"], "left").fillna(False, ["me", "se", "anti"])
    code = F.when(F.col("me"), "k.me").when(F.col("se"), "k.se").otherwise("u")
    return out.select(*query.columns, code.alias("code"), F.col("anti").alias("antisense"), (~(F.col("me") | F.col("se") | F.col("anti"))).alias("intergenic"))


def overlap_names(at: DataFrame, named: DataFrame, expand: int = 0, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Positions with the sorted names that overlap them, widened by ``expand``; ``.(-1)`` for none."""
    wide = at.select(*keys, F.col("st").alias("_s"), F.col("ed").alias("_e"), F.greatest(F.col("st") - expand, F.lit(0)).alias("st"), (F.col("ed") + expand).alias("ed"))
    out = overlap_join(wide, named, "left", keys, width).groupBy(*keys, "_s", "_e").agg(F.array_join(F.array_sort(F.collect_set("b_name")), ",").alias("n"))
    return out.select(*keys, F.col("_s").alias("st"), F.col("_e").alias("ed"), F.when(F.col("n") == "", ".(-1)").otherwise(F.col("n")).alias("names"))


def lowercase_bases(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Lower-case (soft-masked) letters a-z of a sequence."""
    return df.select(id_column, F.length(F.regexp_replace(text, "[^a-z]", "")).cast("long").alias("repbp"))


def tile_sequence(seq: DataFrame, size: int = 1 << 16, within: tuple[int, int] | None = None) -> DataFrame:
    """Sequences (chr, seq) in tiles (chr, tile, seq) of ``size`` characters; with ``within`` only the tiles
    that meet those positions, where no others are asked for."""
    first, last = 0, "greatest(length(seq) - 1, 0)"
    if within is not None:
        first, last = within[0] // size, f"least(length(seq), {within[1]}) - 1"
        seq = seq.filter(f"length(seq) > {within[0]}")
    tiles = F.explode(F.expr(f"sequence({first}, cast({last} AS INT) div {size})")).alias("tile")
    return seq.select("chr", tiles, "seq").select("chr", "tile", F.expr(f"substring(seq, cast(tile * {size} + 1 AS INT), {size})").alias("seq"))


def fetch_sequence(tiles: DataFrame, at: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Sequences of intervals from tiles, joined by tile and put together in order."""
    want = at.select("chr", "st", "ed", F.explode(F.expr(f"sequence(st div {size}, (ed - 1) div {size})")).alias("tile"))
    cut = F.expr(f"substring(seq, cast(greatest(st - tile * {size}, 0) + 1 AS INT), cast(least(ed, (tile + 1) * {size}) - greatest(st, tile * {size}) AS INT))")
    parts = want.join(tiles, ["chr", "tile"]).select("chr", "st", "ed", "tile", cut.alias("part"))
    out = parts.groupBy("chr", "st", "ed").agg(F.array_sort(F.collect_list(F.struct("tile", "part"))).alias("p"))
    return out.select("chr", "st", "ed", F.expr("array_join(transform(p, x -> x.part), '')").alias("seq"))


def to_matrix(long: DataFrame, keys: Sequence[str], sample: str, value: str, samples: Sequence[str]) -> DataFrame:
    """Long rows to one column per sample; the list of samples spares a job that looks for them."""
    return long.groupBy(*keys).pivot(sample, list(samples)).agg(F.max(value))


def from_matrix(wide: DataFrame, keys: Sequence[str], samples: Sequence[str], sample: str, value: str) -> DataFrame:
    return wide.unpivot(list(keys), list(samples), sample, value)


def scale_to_library(long: DataFrame, sample: str, value: str, size: float) -> DataFrame:
    """Values scaled to ``size`` per sample; totals are aggregated before the join."""
    total = long.groupBy(sample).agg(F.sum(value).alias("_t"))
    return long.join(total, sample).withColumn(value, F.col(value) / F.col("_t") * F.lit(size)).drop("_t")


def outer_concat(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of tables on ``keys``; other columns get the table's name as suffix."""
    named = [t.select(*keys, *(F.col(c).alias(f"{c}_{n}") for c in t.columns if c not in keys)) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "full"), named)
