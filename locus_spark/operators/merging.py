"""Merging assemblies of several samples or strands, and rolling their counts and coverages up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus_spark.operators.coverage import threshold
from locus_spark.operators.intervals import KEYS, merge, overlap_join
from locus_spark.plans.materialize import broadcast_if_small, dealt, once
from locus_spark.plans.ranking import number_rows, rank_in_families


def split_strands(df: DataFrame, strand: str = "strand") -> DataFrame:
    """Rows with side ``+`` or ``-``; a row without a strand counts on both."""
    sides = F.when(F.col(strand).isin("+", "-"), F.array(strand)).otherwise(F.array(F.lit("+"), F.lit("-")))
    return df.withColumn("side", F.explode(sides))


def reversed_path(name: Column) -> Column:
    """A path of ``a|b`` steps, joined by commas, read from its other end."""
    return F.array_join(F.reverse(F.transform(F.split(name, ","), lambda x: F.array_join(F.reverse(F.split(x, r"\|")), "|"))), ",")


def adopt_strands(paths: DataFrame, name: str = "name") -> DataFrame:
    """Paths (chr, tst, ted, strand, name ..) with a strand each.

    A path without one takes that of a path with the same end, else with the same start
    (of both strands ``+``); without such a path it is doubled as ``.+`` and ``.-``. Names
    of those that lie on the minus strand are reversed.
    """
    known = paths.filter("strand <> '.'")
    by = {c: known.groupBy("chr", F.col(c)).agg(F.min("strand").alias(f"_{c}")) for c in ("ted", "tst")}
    open_ = paths.filter("strand = '.'").join(by["ted"], ["chr", "ted"], "left").join(by["tst"], ["chr", "tst"], "left")
    found = F.coalesce("_ted", "_tst")
    open_ = open_.withColumn("strand", F.explode(F.when(found.isNotNull(), F.array(found)).otherwise(F.array(F.lit(".+"), F.lit(".-")))))
    open_ = open_.withColumn(name, F.when(F.col("strand").isin("-", ".-"), reversed_path(F.col(name))).otherwise(F.col(name)))
    return known.unionByName(open_.select(*paths.columns))


def at_junction_ends(positions: DataFrame, sj: DataFrame) -> DataFrame:
    """5' and 3' positions (chr, pos, strand, kind) at which a junction of their strand ends.

    A 5' position lies where a plus junction starts or a minus one ends, a 3' position the
    other way round; junctions of both strands and of none count on both.
    """
    sides = split_strands(sj.select("chr", "st", "ed", F.translate("strand", ".", "").alias("strand")))
    first = F.when(F.col("side") == "+", F.col("st")).otherwise(F.col("ed"))
    last = F.when(F.col("side") == "+", F.col("ed")).otherwise(F.col("st"))
    ends = F.explode(F.array(F.struct(F.lit("5").alias("kind"), first.alias("pos")), F.struct(F.lit("3").alias("kind"), last.alias("pos")))).alias("x")
    spots = sides.select("chr", F.col("side").alias("strand"), ends).select("chr", "strand", "x.kind", "x.pos").distinct()
    return positions.join(spots, ["chr", "pos", "strand", "kind"], "left_semi")


def drop_ambiguous_junctions(sj: DataFrame, span: Sequence[str], most: int = 100, share: float = 0.2) -> DataFrame:
    """Junctions without those of no unique read, in spans of more than ``most`` junctions where such make up less than ``share``."""
    counts = sj.groupBy(*span).agg(F.count("*").alias("_n"), F.count_if(F.col("ucnt") == 0).alias("_m"))
    full = counts.filter((F.col("_n") > most) & (F.col("_m") < F.col("_n") * share)).select(*span, F.lit(True).alias("_full"))
    return sj.join(full, list(span), "left").filter("_full IS NULL OR ucnt > 0").select(*sj.columns)


def junction_totals(paths: DataFrame, count: str, name: str = "name", rows: int | None = None) -> DataFrame:
    """(chr, st, ed, count) of the junctions ``a|b`` named in paths, with the largest count of a path through each.

    ``rows`` is how many junctions the names hold at most; without it they are counted. Junctions
    are dealt out before they are grouped, so that no task holds its paths' groups and theirs too.
    """
    steps = paths.select("chr", count, F.explode(F.split(name, ",")).alias("j")).filter("j LIKE '%|%'")
    a, b = F.split("j", r"\|")[0].cast("long"), F.split("j", r"\|")[1].cast("long")
    steps = steps.select("chr", F.least(a, b).alias("st"), F.greatest(a, b).alias("ed"), count)
    steps = dealt(steps, ["chr", "st", "ed"], steps.count() if rows is None else rows)
    return steps.groupBy("chr", "st", "ed").agg(F.max(count).alias(count))


def counts_onto(sj: DataFrame, counted: DataFrame) -> DataFrame:
    """Junctions with ucnt, mcnt and jcnt (ucnt, or mcnt where that is 0) of another table, 0 where it lacks them."""
    at = ["chr", "st", "ed", "strand"]
    other = counted.groupBy(*at).agg(F.max("ucnt").alias("ucnt"), F.max("mcnt").alias("mcnt"))
    out = sj.drop("ucnt", "mcnt", "jcnt").join(other, at, "left").fillna(0, ["ucnt", "mcnt"])
    return out.withColumn("jcnt", F.when(F.col("ucnt") != 0, F.col("ucnt")).otherwise(F.col("mcnt")))


def combine_strands(plus: DataFrame, minus: DataFrame, order: Sequence[str], gene: str = "gidx", row: str = "_id") -> DataFrame:
    """Both strands' rows: genes of the minus strand count downwards, rows are numbered anew in ``order``."""
    both = plus.unionByName(minus.withColumn(gene, -F.col(gene)))
    return number_rows(both.drop(row), order, "_new").drop("_part").withColumnRenamed("_new", row)


def padded_bundles(df: DataFrame, sizes: DataFrame, each: int = 1000, pad: int = 100) -> DataFrame:
    """Bundles (chr, st, ed) of ``each`` islands of a chromosome in order, widened by ``pad`` within [0, size).

    A bundle reaches to the end of the island after its last one, the last to its own last island.
    """
    ranked = rank_in_families(merge(df.select("chr", "st", "ed"), ["chr"]).select("chr", "st", "ed"), ["chr"], ["st"])
    last = F.least(F.floor((F.col("_r") - 1) / each) * each + each + 1, "_n")
    # The first island of a bundle also closes the bundle before it.
    rows = ranked.withColumn("b", F.floor((F.col("_r") - 1) / each)).withColumn("_end", last)
    closing = rows.filter(f"_r > 1 AND (_r - 1) % {each} = 0").select("chr", (F.col("b") - 1).alias("b"), F.col("ed").alias("_ed"))
    out = rows.groupBy("chr", "b").agg(F.min("st").alias("st"), F.max("ed").alias("ed")).join(closing, ["chr", "b"], "left").join(sizes, "chr")
    return out.select("chr", F.greatest(F.col("st") - pad, F.lit(0)).alias("st"), F.least(F.coalesce("_ed", "ed") + pad, "size").alias("ed"))


def _away(track: DataFrame, exons: DataFrame, least: float, keys: Sequence[str], width: int) -> DataFrame:
    return overlap_join(threshold(track, least, keys), exons.select(*keys, "st", "ed"), "anti", keys, width)


def single_exons_by_max(track: DataFrame, exons: DataFrame, most: float, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Covered stretches away from all exons whose largest value is above ``most``, with max and cov (mean)."""
    size = F.col("ed") - F.col("st")
    runs = track.filter("value > 0").withColumns({"_area": F.col("value") * size, "_low": -F.col("value")})
    islands = merge(runs, keys, sums=["_area"], mins=["_low"]).filter(-F.col("_low") > most)
    free = overlap_join(islands.select(*keys, "st", "ed", "_area", "_low"), exons, "anti", keys, width)
    return free.select(*keys, "st", "ed", (F.col("_area") / size).alias("cov"), (-F.col("_low")).alias("max"))


def single_exons_by_share(track: DataFrame, exons: DataFrame, factor: float, smallest: int, largest: int, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Stretches above the mean depth / ``factor``, away from all exons and longer than ``smallest`` but shorter than ``largest``.

    The mean depth is that of covered bases, averaged over keys.
    """
    track, size = once(track, "track"), F.col("ed") - F.col("st")
    depth = track.filter("value > 0").groupBy(*keys).agg((F.sum(F.col("value") * size) / F.sum(size)).alias("a"))
    least = depth.agg(F.avg("a")).first()[0] or 0.0
    return _away(track, exons, least / factor, keys, width).withColumn("len", size).filter((F.col("len") > smallest) & (F.col("len") < largest))


def group_rollup(paths: DataFrame, value: str, gene: str = "gid", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Values by group of equal ends (chr, tst, ted, strand: that of its first name), and summed over the groups of a gene.

    A group belongs to the gene of its first name.
    """
    group = paths.groupBy("chr", "tst", "ted", "strand").agg(F.min(F.struct(name, gene, value)).alias("x"))
    group = group.select("chr", "tst", "ted", "strand", f"x.{gene}", f"x.{value}")
    return group.drop(gene), group.groupBy(gene).agg(F.sum(value).alias(value))


def with_coverages(exons: DataFrame, ecov: DataFrame, gcov: DataFrame, exon: str = "eid", gene: str = "gid") -> DataFrame:
    """Exons with ecov of their own and gcov of their gene."""
    return exons.join(ecov.select(exon, "ecov"), exon, "left").join(gcov.select(gene, "gcov"), gene, "left")


def utr_shares(ends: DataFrame, group: Sequence[str], cov: str = "cov") -> DataFrame:
    """Shares of a group's start (or end) variants, from the outermost in.

    ends: one row per variant with ``place``, its order from outside, and the mean depth
    up to the next one. A variant adds what the depth rises by, 0 at least; where nothing
    rises the shares are 0, and a lone variant has all.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*group).orderBy("place")
    own = F.greatest(F.col(cov) - F.coalesce(F.lag(cov).over(order), F.lit(0)), F.lit(0))
    rows = ends.withColumn("_own", own)
    total = rows.groupBy(*group).agg(F.sum("_own").alias("_sum"), F.count("*").alias("_n"))
    share = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_own") / F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum")))
    return rows.join(total, list(group)).withColumn("share", share.cast("double")).drop("_own", "_sum", "_n")


def assembly_stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of every table, as num_<name>."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(f"num_{name}"))
        out = one if out is None else out.join(F.broadcast(one))  # one row each
    return out


def with_gene_names(df: DataFrame, genes: DataFrame, key: str, symbol: str = "symbol", fallback: str = "gname") -> DataFrame:
    """Rows with the annotation of their gene; where it lacks a symbol the gene's name stands for it."""
    out = df.join(broadcast_if_small(genes, 200), key, "left")
    return out.withColumn(symbol, F.coalesce(F.when(F.col(symbol) != "", F.col(symbol)), F.col(fallback)))
