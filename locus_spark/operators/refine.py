"""Filters and attachments that clean up exons, junctions and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.operators.coverage import mean_over
from locus_spark.operators.intervals import KEYS, merge, overlap_join, overlap_pairs
from locus_spark.plans.materialize import once

AT = ["chr", "st", "ed"]


def drop_inside_covered(sj: DataFrame, track: DataFrame, factor: float, width: int = 64) -> DataFrame:
    """Junctions without those inside one covered island whose count is below ``factor`` times
    the island's mean coverage (an adaptive form of the fixed limits)."""
    track = once(track, "track")
    islands = merge(track.filter("value > 0")).select(*AT)
    islands = mean_over(islands, track, width=width)
    inner = overlap_pairs(sj.select(*AT).distinct(), islands, width=width).filter("ovl = ed - st").groupBy(*AT).agg(F.max("b_cov").alias("_c"))
    return sj.join(inner, AT, "left").filter(F.col("_c").isNull() | (F.col("jcnt") >= F.lit(factor) * F.col("_c"))).drop("_c")


def drop_overlapping_single(single: DataFrame, multi: DataFrame, width: int = 64) -> DataFrame:
    """Single exons without those that overlap exactly one multi-exon exon."""
    hits = overlap_pairs(single.select(*AT).distinct(), multi.select(*AT).distinct(), width=width).groupBy(*AT).agg(F.count("*").alias("_n")).filter("_n = 1")
    return single.join(hits.select(*AT), AT, "left_anti")


def long_enough(genes: DataFrame, p0: float, p1: float, p2: float) -> DataFrame:
    """Genes whose log length reaches p0 + p1 times the log of their span, and p2."""
    return genes.filter((F.col("ltlen") >= F.lit(p0) + F.lit(p1) * F.log10("glen")) & (F.col("ltlen") >= p2))


def drop_shadowed_paths(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Two-exon paths of unknown strand without those whose junction a longer path of a known
    strand has. paths: path, strand, n (junctions); members: path, d, a."""
    both = members.join(paths.select("path", "strand", "n"), "path")
    known = both.filter("strand IN ('+', '-') AND n > 1").select(F.least("d", "a").alias("_l"), F.greatest("d", "a").alias("_h")).distinct()
    lone = both.filter("strand NOT IN ('+', '-') AND n = 1").select("path", F.least("d", "a").alias("_l"), F.greatest("d", "a").alias("_h"))
    return paths.join(lone.join(known, ["_l", "_h"], "left_semi").select("path"), "path", "left_anti")


def drop_spanned(two_exon: DataFrame, multi: DataFrame, width: int = 64) -> DataFrame:
    """Two-exon paths (chr, st, ed, strand of their junction) without those inside a multi-exon path of the other strand."""
    inner = overlap_pairs(two_exon.select(*AT, "strand").distinct(), multi.select(*AT, "strand"), width=width)
    inner = inner.filter("b_st <= st AND ed <= b_ed AND b_strand <> strand").select(*AT, "strand").distinct()
    return two_exon.join(inner, [*AT, "strand"], "left_anti")


def surviving_paths(members: DataFrame, exons: DataFrame, path: str = "path", exon: str = "exon") -> DataFrame:
    """Paths all of whose exons are still there."""
    lost = members.join(exons.select(exon), exon, "left_anti").select(path).distinct()
    return members.select(path).distinct().join(lost, path, "left_anti")


def drop_lone_components(ex: DataFrame, name: str = "gname", component: str = "component") -> DataFrame:
    """Single-exon components of names that have several components go."""
    sizes = ex.groupBy(name, component).agg(F.count("*").alias("_n"))
    spread = sizes.groupBy(name).agg(F.count("*").alias("_k")).filter("_k > 1").select(name)
    return ex.join(sizes.filter("_n = 1").join(spread, name).select(name, component), [name, component], "left_anti")


def path_counts(paths: DataFrame, members: DataFrame, stats: DataFrame, least: dict[str, float]) -> DataFrame:
    """Paths all of whose junctions reach every limit: the least over members counts.

    members: path, sj; stats: sj and the columns of ``least``.
    """
    low = members.join(stats, "sj").groupBy("path").agg(*(F.min(c).alias(c) for c in least))
    for column, limit in least.items():
        low = low.filter(F.col(column) >= limit)
    return paths.join(low, "path")


def attach_single(single: DataFrame, multi: DataFrame) -> DataFrame:
    """Single exons that end where a multi-exon exon begins, or begin where one ends: the joined exon."""
    m = multi.select("chr", F.col("st").alias("_s"), F.col("ed").alias("_e")).distinct()
    left = single.join(m, (single["chr"] == m["chr"]) & (single["ed"] == m["_s"])).select(single["chr"], "st", F.col("_e").alias("ed"))
    right = single.join(m, (single["chr"] == m["chr"]) & (single["st"] == m["_e"])).select(single["chr"], F.col("_s").alias("st"), "ed")
    return left.unionByName(right).distinct()


def intron_retention(sj: DataFrame, ex: DataFrame, ratio: float) -> DataFrame:
    """Hulls (chr, st, ed, cov) of exon, covered intron and exon: twice the intron's coverage
    exceeds ``ratio`` times the sum of both exons'. sj and ex carry cov; junction starts are 1-based."""
    left = ex.select("chr", F.col("st").alias("st0"), (F.col("ed") + 1).alias("st"), F.col("cov").alias("covl"))
    right = ex.select("chr", F.col("st").alias("ed"), F.col("ed").alias("ed0"), F.col("cov").alias("covr"))
    out = sj.join(left, ["chr", "st"]).join(right, ["chr", "ed"]).filter(2 * F.col("cov") > (F.col("covl") + F.col("covr")) * ratio)
    return out.groupBy("chr", F.col("st0").alias("st"), F.col("ed0").alias("ed")).agg(F.max("cov").alias("cov"))


def lonely_exons(ex: DataFrame, sj: DataFrame, most: float = 1.0, width: int = 64) -> DataFrame:
    """Exons that overlap no other exon and share less than ``most`` of their length with junctions."""
    own = overlap_pairs(ex.select(*AT).distinct(), ex.select(*AT).distinct(), width=width).groupBy(*AT).agg(F.count("*").alias("_n")).filter("_n = 1")
    cross = overlap_pairs(ex.select(*AT).distinct(), sj.select(*AT).distinct(), width=width).filter(F.col("ovl") >= F.lit(most) * (F.col("ed") - F.col("st")))
    return ex.join(own.select(*AT), AT, "left_semi").join(cross.select(*AT).distinct(), AT, "left_anti")


def shared_boundary(inner: DataFrame, ends: DataFrame, width: int = 64) -> DataFrame:
    """Internal exons that overlap exactly one end exon, sharing one boundary with it: with that exon's ends."""
    pair = overlap_pairs(inner.select(*AT).distinct(), ends.select(*AT).distinct(), width=width)
    one = pair.groupBy(*AT).agg(F.count("*").alias("_n"), F.min("b_st").alias("b_st"), F.min("b_ed").alias("b_ed")).filter("_n = 1")
    return one.filter("(st = b_st) <> (ed = b_ed)").drop("_n")


def adjacent_gene_gaps(ex: DataFrame, gene: str, width: int = 64) -> DataFrame:
    """Gaps between the last exon of a gene and the first of the next on the same strand that
    hold no other exon: (chr, strand, st, ed)."""
    span = ex.groupBy("chr", "strand", gene).agg(F.min("st").alias("st"), F.max("ed").alias("ed"))
    from locus_spark.operators.junctions import nearest_before

    # The next start at or above an end, found as the nearest below in mirrored positions.
    starts = span.select("chr", "strand", (-F.col("st")).alias("pos"))
    ends = span.select("chr", "strand", (-F.col("ed") + 1).alias("pos"))
    near = nearest_before(ends, starts, ["chr", "strand"], 1 << 20)
    gaps = near.select("chr", "strand", (1 - F.col("pos")).alias("st"), (-F.col("before")).alias("ed")).filter("st < ed")
    return overlap_join(gaps, ex.select("chr", "strand", "st", "ed"), "anti", ["chr", "strand"], width)


def weak_links(sj: DataFrame, by: Sequence[str], count: str, factor: float) -> DataFrame:
    """Junctions below ``factor`` times the largest at their site."""
    most = sj.groupBy(*by).agg(F.max(count).alias("_m"))
    return sj.join(most, list(by)).filter(F.col(count) < F.lit(factor) * F.col("_m")).drop("_m")


def retag_strand(df: DataFrame, stranded: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Rows with the strand of the stranded rows they overlap: ``.`` where those disagree or there are none."""
    pair = overlap_pairs(df.select(*keys, "st", "ed").distinct(), stranded.select(*keys, "st", "ed", "strand"), keys, width)
    tag = pair.filter("b_strand IN ('+', '-')").groupBy(*keys, "st", "ed").agg(F.min("b_strand").alias("_a"), F.max("b_strand").alias("_b"))
    out = df.drop("strand").join(tag, [*keys, "st", "ed"], "left")
    return out.withColumn("strand", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(".")).drop("_a", "_b")
