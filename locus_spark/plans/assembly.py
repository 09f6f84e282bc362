"""Pipelines over the operators: assembling, merging, evaluating and annotating models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.operators import compare as M
from locus_spark.operators import coverage as C
from locus_spark.operators import graph as G
from locus_spark.operators import intervals as I
from locus_spark.operators import junctions as J
from locus_spark.plans.materialize import materialize

STRANDED = ("chr", "strand")


def select_junctions(sj: DataFrame, unique: float = 0, multi: float = 1, least_ratio: float = 0.01, width: int = 64) -> DataFrame:
    """Junctions with enough reads of their own and among those that overlap them, over both strands."""
    held = sj.filter((F.col("ucnt") > unique) | (F.col("mcnt") > multi)).withColumn("jcnt", J.junction_count().cast("double"))
    ratio = I.self_ratio(held, "jcnt").filter(F.col("ratio") >= least_ratio).select("chr", "st", "ed")
    return held.join(ratio, ["chr", "st", "ed"], "left_semi")


def find_exons(sj: DataFrame, track: DataFrame, longest: int = 20_000, width: int = 64) -> DataFrame:
    """Exon candidates of junctions: between an acceptor and the next donor where covered
    throughout, else from a junction end to the edge of the covered island beyond it.

    Returns chr, strand, st, ed, kind (i, 5 or 3).
    """
    begins = sj.select(*STRANDED, F.col("ed").alias("pos")).distinct()  # exons begin where junctions end
    ends = sj.select(*STRANDED, (F.col("st") - 1).alias("pos")).distinct()
    # Used several times each; nested into one plan their sweeps and as-of joins would multiply.
    islands = materialize(I.merge(track.filter("value > 0"), ["chr"]).select("chr", "st", "ed"), "islands")
    pairs = materialize(J.pair_exons(begins, ends, STRANDED, longest), "pairs")
    inside = I.overlap_pairs(pairs.select("chr", "st", "ed").distinct(), islands, ["chr"], width).filter("ovl = ed - st").select("chr", "st", "ed").distinct()
    inner = pairs.join(inside, ["chr", "st", "ed"], "left_semi").select(*STRANDED, "st", "ed", F.lit("i").alias("kind"))
    inner = materialize(inner, "inner")
    left = begins.join(inner.select(*STRANDED, F.col("st").alias("pos")).distinct(), [*STRANDED, "pos"], "left_anti")
    right = ends.join(inner.select(*STRANDED, F.col("ed").alias("pos")).distinct(), [*STRANDED, "pos"], "left_anti")
    touch = lambda d, s, e: I.overlap_pairs(d.select(*STRANDED, "pos", s.alias("st"), e.alias("ed")), islands, ["chr"], width)
    last = touch(left, F.col("pos"), F.col("pos") + 1).select(*STRANDED, F.col("pos").alias("st"), F.col("b_ed").alias("ed"))
    first = touch(right, F.col("pos") - 1, F.col("pos")).select(*STRANDED, F.col("b_st").alias("st"), F.col("pos").alias("ed"))
    minus = F.col("strand") == "-"
    last = last.withColumn("kind", F.when(minus, "5").otherwise("3"))
    first = first.withColumn("kind", F.when(minus, "3").otherwise("5"))
    return inner.unionByName(last).unionByName(first).filter("st < ed").groupBy(*STRANDED, "st", "ed").agg(F.min(F.when(F.col("kind") == "i", "0").otherwise(F.col("kind"))).alias("k")).select(
        *STRANDED, "st", "ed", F.when(F.col("k") == "0", "i").otherwise(F.col("k")).alias("kind"))


def exon_edges(ex: DataFrame, sj: DataFrame) -> DataFrame:
    """(src, dst, jcnt) exon ids joined by a junction, in the order of transcription."""
    d = ex.filter("d_id > 0").select(F.col("_id").alias("src"), "d_id")
    a = ex.filter("a_id > 0").select(F.col("_id").alias("dst"), "a_id")
    return sj.select("d_id", "a_id", "jcnt").join(d, "d_id").join(a, "a_id").select("src", "dst", "jcnt")


def assemble(sj: DataFrame, track: DataFrame, unique: float = 0, multi: float = 1, least_ratio: float = 0.01, longest: int = 20_000, width: int = 64) -> dict[str, DataFrame]:
    """Exons, junctions and genes from junctions (chr, st, ed, strand, ucnt, mcnt; 1-based
    starts) and a coverage track (chr, st, ed, value)."""
    track = materialize(track.select("chr", "st", "ed", "value"), "track")
    chosen = materialize(select_junctions(sj, unique, multi, least_ratio, width), "chosen")
    supported = materialize(J.flank_support(chosen, track, width=width), "sj")
    exons = materialize(find_exons(supported, track, longest, width), "exons")
    exons = exons.join(C.mean_over(exons, track, width=width), ["chr", "st", "ed"])
    exons = J.row_ids(exons, ["chr", "st", "ed", "strand"])
    sj_ids, ex_ids = J.donor_acceptor(supported, exons)
    ex_ids = materialize(J.exon_category(ex_ids), "ex")
    sj_ids = materialize(J.consistent(sj_ids, ex_ids), "sj-ids")
    edges = exon_edges(ex_ids, sj_ids)
    # Exons without a junction are components of their own.
    loops = ex_ids.select(F.col("_id").alias("src"), F.col("_id").alias("dst"))
    comp = G.connected_components(edges.select("src", "dst").unionByName(loops))
    gidx = G.gene_index(comp, ex_ids.select(F.col("_id").alias("node"), "strand"))
    ex_out = ex_ids.join(gidx.withColumnsRenamed({"node": "_id", "gidx": "_gidx"}), "_id")
    ex_out = ex_out.withColumn("gname", F.concat(F.when(F.col("_gidx") < 0, "JN").otherwise("JP"), F.when(F.col("cat") == "s", "S").otherwise("G"), F.abs("_gidx").cast("string")))
    sj_out = sj_ids.join(ex_out.filter("d_id > 0").groupBy("d_id").agg(F.min("_gidx").alias("_gidx")), "d_id", "left")
    genes = C.gene_length(ex_out.withColumn("gid", F.col("_gidx")))
    return {"ex": ex_out, "sj": sj_out, "genes": genes}


def abundances(ex: DataFrame, sj: DataFrame, least: float = 0.01) -> DataFrame:
    """Paths of exons per gene with their share: products of junction shares among those of an exon."""
    edges = J.shares(exon_edges(ex, sj).withColumnsRenamed({"src": "s", "dst": "d"}), "jcnt", ["s"]).select(F.col("s").alias("src"), F.col("d").alias("dst"), "p")
    starts = ex.filter("a_id = 0 AND d_id > 0").select(F.col("_id").alias("node"))
    return G.path_products(edges, starts, least)


def merge_samples(sj: DataFrame, tracks: Sequence[DataFrame], least_detected: int = 1, least_count: float = 1) -> tuple[DataFrame, DataFrame]:
    """Junctions over samples (sample, chr, st, ed, strand, ucnt, mcnt) and the sum of their tracks."""
    keys = ["chr", "st", "ed", "strand"]
    long = sj.withColumn("jcnt", J.junction_count().cast("double"))
    stats = J.multi_filter(J.detection(long, keys, "jcnt"), {"detected": least_detected, "maxcnt": least_count})
    total = sj.groupBy(*keys).agg(F.sum("ucnt").alias("ucnt"), F.sum("mcnt").alias("mcnt"))
    return total.join(stats, keys), C.combine(tracks)


def evaluate(reference: DataFrame, target: DataFrame, width: int = 64) -> dict[str, DataFrame]:
    """Hits, closest matches and gene completeness of a target model against a reference (id, gene)."""
    r, t = reference.select("chr", "st", "ed", "id", "gene"), target.select("chr", "st", "ed", "id", "gene")
    return {
        "counts": M.match_counts(r, t, width=width),
        "closest": M.closest_match(r.drop("gene"), t.drop("gene"), width=width),
        "completeness": M.completeness(r, t.withColumnRenamed("gene", "tgene"), "gene", "tgene", width=width),
    }


def filter_repeats(exons: DataFrame, sequence_tiles: DataFrame, repeats: DataFrame, gene: str, size: int, share: float = 50.0, most_exons: int = 4) -> DataFrame:
    """Genes without those that are mostly repeats: ``share`` per cent of bases in lower case
    and in repeat annotation, and fewer than ``most_exons`` union exons."""
    union = I.merge(exons, [gene, "chr"])
    seq = M.fetch_sequence(sequence_tiles, union.select("chr", "st", "ed").distinct(), size)
    low = seq.withColumn("low", F.length(F.regexp_replace("seq", "[^a-z]", ""))).select("chr", "st", "ed", "low")
    covered = I.overlap_ratio(union, I.merge(repeats)).select("chr", "st", "ed", "ovl")
    stats = union.join(low, ["chr", "st", "ed"]).join(covered, ["chr", "st", "ed"]).groupBy(gene).agg(
        F.sum("low").alias("low"), F.sum("ovl").alias("ovl"), F.sum(F.col("ed") - F.col("st")).alias("len"), F.count("*").alias("n"))
    bad = stats.filter((F.col("low") * 100 >= share * F.col("len")) & (F.col("ovl") * 100 > share * F.col("len")) & (F.col("n") < most_exons))
    return exons.join(bad.select(gene), gene, "left_anti")


def group_abundance(estimates: Sequence[DataFrame], keys: Sequence[str], value: str = "value") -> DataFrame:
    """One value per group from three estimates of it (span coverage, exon flux and junction
    flux, each from ``kernels.deconvolve``): the middle one; an absent estimate counts as 0."""
    first = estimates[0].select(*keys, F.col(value).alias("_0"))
    for n, other in enumerate(estimates[1:], 1):
        first = first.join(other.select(*keys, F.col(value).alias(f"_{n}")), list(keys), "full")
    middle = F.array_sort(F.array(*(F.coalesce(f"_{n}", F.lit(0.0)) for n in range(len(estimates)))))
    return first.select(*keys, middle[(len(estimates) - 1) // 2].alias(value))


def snap_exons(ex: DataFrame, sj: DataFrame, within: int = 10) -> DataFrame:
    """Exon ends moved to the nearest junction end on the same strand at most ``within`` away."""
    begins = sj.select(*STRANDED, F.col("ed").alias("pos")).distinct()
    ends = sj.select(*STRANDED, (F.col("st") - 1).alias("pos")).distinct()
    for column, sites in (("st", begins), ("ed", ends)):
        # The nearest site at or below and at or above, by two as-of joins: no row per position within reach.
        spots = ex.select(*STRANDED, F.col(column).alias("pos")).distinct()
        sides = []
        for sign in (1, -1):
            turned = lambda d, by=0: d.select(*STRANDED, (F.col("pos") * sign + by).alias("pos"))  # noqa: B023, E731
            near = J.nearest_before(turned(spots, 1), turned(sites), STRANDED, within + 1)
            sides.append(near.select(*STRANDED, ((F.col("pos") - 1) * sign).alias("p"), (F.col("before") * sign).alias("pos")))
        best = sides[0].unionByName(sides[1]).groupBy(*STRANDED, "p").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("p")).alias("d"), "pos")).alias("x"))
        best = best.select(*STRANDED, F.col("p").alias(column), F.col("x.pos").alias("_to"))
        ex = ex.join(best, [*STRANDED, column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
    return ex.filter("st < ed")
