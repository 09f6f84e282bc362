"""Splice junctions and exons: ids, counts, filters and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.operators.intervals import FAN, KEYS, overlap_pairs, overlapped
from locus_spark.plans.materialize import once
from locus_spark.plans.ranking import number_rows


def locus(stranded: bool = False) -> Column:
    """``chr:st-ed`` or ``chr:st-ed:strand``."""
    base = F.concat("chr", F.lit(":"), F.col("st").cast("string"), F.lit("-"), F.col("ed").cast("string"))
    return F.concat(base, F.lit(":"), F.col("strand")) if stranded else base


def junction_locus() -> Column:
    """``chr:st^ed:strand``."""
    return F.format_string("%s:%d^%d:%s", "chr", "st", "ed", "strand")


def parse_locus(column: str) -> list[Column]:
    """chr, st, ed and strand (null where it has none) of a locus."""
    pattern = r"^(.+?):(\d+)[-^](\d+)(?::([+.-]+))?$"
    part = [F.regexp_extract(column, pattern, k) for k in range(1, 5)]
    return [part[0].alias("chr"), part[1].cast("long").alias("st"), part[2].cast("long").alias("ed"), F.nullif(part[3], F.lit("")).alias("strand")]


def row_ids(df: DataFrame, order: Sequence[str], name: str = "_id") -> DataFrame:
    """Dense ids from 0 in the order of ``order``, without a window over all rows."""
    return number_rows(df, order, name).drop("_part")


def end_positions(df: DataFrame, junctions: bool) -> DataFrame:
    """Rows with donor and acceptor position: exons end at a donor, junctions begin at one.

    Junction starts are 1-based: the exon before ends at st - 1.
    """
    start = F.col("st") - 1 if junctions else F.col("st")
    plus = F.col("strand") != "-"
    left, right = (("dpos", "apos") if junctions else ("apos", "dpos"))
    return df.withColumns({left: F.when(plus, start).otherwise(F.col("ed")), right: F.when(plus, F.col("ed")).otherwise(start)})


def donor_acceptor(sj: DataFrame, ex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Junctions and exons with d_id, a_id (dense from 1 over the junctions' ends; 0: none)
    and d_degree, a_degree (junctions there)."""
    sj, ex = end_positions(sj, True), end_positions(ex, False)
    for name, pos in (("d", "dpos"), ("a", "apos")):
        site = sj.groupBy("chr", "strand", pos).agg(F.count("*").alias(f"{name}_degree"))
        site = row_ids(site, ["chr", "strand", pos], f"{name}_id").withColumn(f"{name}_id", F.col(f"{name}_id") + 1)
        sj = sj.join(site, ["chr", "strand", pos], "left")
        ex = ex.join(site, ["chr", "strand", pos], "left").fillna(0, [f"{name}_id", f"{name}_degree"])
    return sj, ex


def exon_category(ex: DataFrame) -> DataFrame:
    """cat: i (internal), 5 (no acceptor), 3 (no donor) or s (single)."""
    return ex.withColumn("cat", F.expr("CASE WHEN a_id <> 0 AND d_id <> 0 THEN 'i' WHEN d_id <> 0 THEN '5' WHEN a_id <> 0 THEN '3' ELSE 's' END"))


def junction_count(unique: str = "ucnt", multi: str = "mcnt") -> Column:
    """The unique count unless it is zero, else the other."""
    return F.when(F.col(unique) != 0, F.col(unique)).otherwise(F.col(multi))


def detection(long: DataFrame, keys: Sequence[str], value: str, overhang: str | None = None) -> DataFrame:
    """Over samples: detected (count above 0), most, total and the largest overhang."""
    more = [F.max(overhang).alias("maxoverhang")] if overhang else []
    return long.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("detected"), F.max(value).alias("maxcnt"), F.sum(value).alias("total"), *more)


def multi_filter(stats: DataFrame, least: dict[str, float], corner: tuple[str, str, float, float] | None = None) -> DataFrame:
    """Rows that reach every limit in ``least``; ``corner`` (x, y, x1, y0) drops those on or
    under the line y = y0 - y0 / x1 * x."""
    test = F.lit(True)
    for column, limit in least.items():
        test = test & (F.col(column) >= limit)
    if corner:
        x, y, x1, y0 = corner
        test = test & (F.col(y) > F.lit(y0) - F.lit(y0 / x1) * F.col(x))
    return stats.filter(test)


def drop_inside_exons(sj: DataFrame, exons: DataFrame, unique: float, multi: float, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Junctions without those that lie wholly inside the union of ``exons`` and have both counts low."""
    from locus_spark.operators.intervals import merge

    islands = merge(exons, keys).select(*keys, "st", "ed")
    inner = overlap_pairs(sj.select(*keys, "st", "ed").distinct(), islands, keys, width).filter("ovl = ed - st").select(*keys, "st", "ed").distinct()
    low = (F.col("ucnt") < unique) & (F.col("mcnt") < multi)
    return sj.join(inner.withColumn("_in", F.lit(True)), [*keys, "st", "ed"], "left").filter(~(F.coalesce("_in", F.lit(False)) & low)).drop("_in")


def flank_support(sj: DataFrame, track: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Junctions whose neighbouring bases on both sides are covered: the last of the exon
    before, at st - 2 as starts are 1-based, and the first of the exon after, at ed."""
    columns, track = sj.columns, once(track, "track")
    for before in (F.col("st") - 1, F.col("ed") + 1):
        sj = overlapped(sj, track, keys, width * FAN, before - 1, before).filter("_hit").select(*columns)
    return sj


def consistent(sj: DataFrame, ex: DataFrame) -> DataFrame:
    """Junctions whose donor and acceptor ids both belong to exons; null and 0 are no ids."""
    for name in ("d_id", "a_id"):
        sj = sj.join(ex.filter(F.col(name) > 0).select(name).distinct(), name, "left_semi")
    return sj


def share(value: str, by: Sequence[str]) -> Column:
    """The row's share of its group's total; 0 where that is 0."""
    total = F.sum(value).over(W.partitionBy(*by))
    return F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0))


def shares(df: DataFrame, value: str, by: Sequence[str], name: str = "p") -> DataFrame:
    """``share`` for groups of any size: totals are aggregated before the join."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    return df.join(total, list(by)).withColumn(name, F.when(F.col("_t") > 0, F.col(value) / F.col("_t")).otherwise(F.lit(0.0))).drop("_t")


def weak_two_exon_genes(ex: DataFrame, sj: DataFrame, gene: str, limit: float, least_length: int) -> DataFrame:
    """Genes of two exons whose junction support is below ``limit``, or equals it in a short gene."""
    two = ex.groupBy(gene).agg(F.count("*").alias("n"), F.sum(F.col("ed") - F.col("st")).alias("len")).filter("n = 2")
    support = sj.groupBy(gene).agg(F.max("cnt").alias("support"))
    joined = two.join(support, gene, "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return joined.filter((F.col("support") < limit) | ((F.col("support") == limit) & (F.col("len") < least_length))).select(gene, "len", "support")


def nearest_before(right: DataFrame, left: DataFrame, keys: Sequence[str], most: int, tile: int = 1 << 17) -> DataFrame:
    """As-of join: for every right position the nearest left position strictly below it, at
    most ``most`` away. Both have keys and pos; returns keys, pos, before.

    A partner lies within ``most``, so tiles at least that wide need only their own rows
    and those of the tile before; no window spans a whole key.
    """
    tile = max(tile, most)
    lefts = left.select(*keys, "pos").distinct().withColumn("_side", F.lit(1))
    lefts = lefts.withColumn("_tile", F.explode(F.array(F.floor(F.col("pos") / tile), F.floor(F.col("pos") / tile) + 1)))
    rights = right.select(*keys, "pos").distinct().withColumn("_side", F.lit(0)).withColumn("_tile", F.floor(F.col("pos") / tile))
    # At one position the right row comes first: "strictly below".
    order = W.partitionBy(*keys, "_tile").orderBy("pos", "_side").rowsBetween(W.unboundedPreceding, -1)
    both = lefts.unionByName(rights).withColumn("before", F.max(F.when(F.col("_side") == 1, F.col("pos"))).over(order))
    return both.filter((F.col("_side") == 0) & (F.col("pos") - F.col("before") <= most)).select(*keys, "pos", "before")


def pair_exons(acceptors: DataFrame, donors: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Exon candidates (keys, st, ed): every donor with the nearest acceptor below, then every
    acceptor that was left over with the nearest donor above, both within ``most``."""
    first = nearest_before(donors, acceptors, keys, most).select(*keys, F.col("before").alias("st"), F.col("pos").alias("ed"))
    left = acceptors.select(*keys, "pos").distinct().join(first.select(*keys, F.col("st").alias("pos")).distinct(), [*keys, "pos"], "left_anti")
    mirror = lambda d: d.select(*keys, (-F.col("pos")).alias("pos"))
    second = nearest_before(mirror(left), mirror(donors), keys, most).select(*keys, (-F.col("pos")).alias("st"), (-F.col("before")).alias("ed"))
    return first.unionByName(second)


def chains(blocks: DataFrame, transcript: Sequence[str]) -> DataFrame:
    """Transcripts with their junction chain ``d|a,d|a,..``, reversed on the minus strand."""
    from locus_spark.operators.intervals import introns

    gaps = introns(blocks, [*transcript, "strand"])
    pairs = gaps.groupBy(*transcript, "strand").agg(F.array_sort(F.collect_list(F.struct("st", "ed"))).alias("_p"))
    plus = F.expr("array_join(transform(_p, x -> concat(x.st, '|', x.ed)), ',')")
    minus = F.expr("array_join(reverse(transform(_p, x -> concat(x.ed, '|', x.st))), ',')")
    return pairs.select(*transcript, "strand", F.when(F.col("strand") == "-", minus).otherwise(plus).alias("chain"))


def chain_members(paths: DataFrame, chain: str = "chain") -> DataFrame:
    """One row per junction of a chain, with d, a and its place."""
    out = paths.select("*", F.posexplode(F.split(chain, ",")).alias("place", "_x"))
    return out.withColumns({"d": F.split("_x", r"\|")[0].cast("long"), "a": F.split("_x", r"\|")[1].cast("long")}).drop("_x")


def extract_model(exons: DataFrame, transcript: str = "tid", gene: str = "gid") -> tuple[DataFrame, DataFrame]:
    """Exons (chr, st, ed, strand, gid, kind) and junctions (chr, st, ed, strand, gid), once per
    locus and gene, from exon rows of transcripts.

    kind: 5 or 3 for the first or last exon of a transcript, s for a lone one, i between;
    of several kinds at a locus the first in the order i, 5, 3, s.
    """
    order = W.partitionBy(transcript).orderBy("st", "ed")
    last = W.partitionBy(transcript).orderBy(F.desc("st"), F.desc("ed"))
    rows = exons.withColumns({"_n": F.row_number().over(order), "_m": F.row_number().over(last), "_next": F.lead("st").over(order)})
    kind = F.expr("CASE WHEN _n = 1 AND _m = 1 THEN 's' WHEN _n > 1 AND _m > 1 THEN 'i' WHEN (_n = 1) = (strand <> '-') THEN '5' ELSE '3' END")
    rank = F.expr("CASE kind WHEN 'i' THEN 0 WHEN '5' THEN 1 WHEN '3' THEN 2 ELSE 3 END")
    at = ["chr", "st", "ed", "strand", gene]
    ex = rows.withColumn("kind", kind).groupBy(*at).agg(F.min_by("kind", rank).alias("kind"))
    sj = rows.filter("_next IS NOT NULL AND ed < _next").select("chr", (F.col("ed") + 1).alias("st"), F.col("_next").alias("ed"), "strand", gene).distinct()
    return ex, sj


def transcript_records(exons: DataFrame, transcript: str = "tid", gene: str = "gid", multi_exon_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Transcript and gene rows: span, strand and number of exons."""
    tx = exons.groupBy(transcript, gene, "chr", "strand").agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.count("*").alias("n_exons"))
    tx = tx.filter("n_exons > 1") if multi_exon_only else tx
    genes = tx.groupBy(gene, "chr", "strand").agg(F.min("st").alias("st"), F.max("ed").alias("ed"), F.count("*").alias("n_tx"))
    return tx, genes
