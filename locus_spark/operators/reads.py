"""Aligned reads in segments to coverage, junctions and their strands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.operators.compare import fetch_sequence
from locus_spark.operators.coverage import coverage

#: Intron ends (donor, acceptor dinucleotides) and the strand they speak for.
SPLICE_STRAND = (("GTAG", "+"), ("GCAG", "+"), ("ATAC", "+"), ("CTAC", "-"), ("CTGC", "-"), ("GTAT", "-"))


def multi_mapped(reads: DataFrame) -> DataFrame:
    """read_id of reads with more than one alignment."""
    return reads.select("read_id", "map_id").distinct().groupBy("read_id").agg(F.count("*").alias("n")).filter("n > 1").select("read_id")


def segments_to_junctions(reads: DataFrame) -> DataFrame:
    """Gaps between segments of an alignment (map_id): chr, st, ed, read_id, map_id.

    An alignment has a few segments, so its window is small.
    """
    before = F.lag("ed").over(W.partitionBy("map_id").orderBy("chr", "st"))
    same = F.lag("chr").over(W.partitionBy("map_id").orderBy("chr", "st")) == F.col("chr")
    out = reads.withColumns({"_b": before, "_s": same}).filter("_s AND _b < st")
    return out.select("chr", F.col("_b").alias("st"), F.col("st").alias("ed"), "read_id", "map_id")


def splice_strand(junctions: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Distinct junctions (chr, st, ed) with the strand their end dinucleotides speak for."""
    one = junctions.select("chr", "st", "ed").distinct().withColumnsRenamed({"st": "s", "ed": "e"})
    ends = one.select("chr", "s", "e", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("s").alias("st"), (F.col("s") + 2).alias("ed")), F.struct(F.lit(1).alias("k"), (F.col("e") - 2).alias("st"), F.col("e").alias("ed")))).alias("x"))
    at = ends.select("chr", "x.st", "x.ed").distinct()
    found = ends.select("chr", "s", "e", "x.k", "x.st", "x.ed").join(fetch_sequence(tiles, at, size), ["chr", "st", "ed"])
    motif = found.groupBy("chr", "s", "e").agg(F.upper(F.concat_ws("", F.max(F.when(F.col("k") == 0, F.col("seq"))), F.max(F.when(F.col("k") == 1, F.col("seq"))))).alias("motif"))
    table = F.create_map(*(F.lit(x) for pair in SPLICE_STRAND for x in pair))
    return motif.select("chr", F.col("s").alias("st"), F.col("e").alias("ed"), F.coalesce(table[F.col("motif")], F.lit(".")).alias("strand"))


def tracks(reads: DataFrame, strands: DataFrame) -> DataFrame:
    """Coverage by kind (ex, sj), strand and reads (all, uniq): the tracks of a library in one table.

    reads: chr, st, ed, read_id, map_id, one row per segment; strands: from ``splice_strand``.
    An alignment takes the strand that most of its junctions have, ``.`` without any.
    """
    sj = segments_to_junctions(reads).join(strands, ["chr", "st", "ed"])
    score = F.sum(F.expr("CASE strand WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END"))
    own = sj.groupBy("map_id").agg(score.alias("_v")).select("map_id", F.expr("CASE WHEN _v > 0 THEN '+' WHEN _v < 0 THEN '-' ELSE '.' END").alias("strand"))
    ex = reads.select("chr", "st", "ed", "read_id", "map_id").join(own, "map_id", "left").withColumns({"strand": F.coalesce("strand", F.lit(".")), "kind": F.lit("ex")})
    gaps = sj.drop("strand").join(own, "map_id").withColumn("kind", F.lit("sj"))
    both = ex.unionByName(gaps)
    unique = both.join(multi_mapped(reads), "read_id", "left_anti").withColumn("reads", F.lit("uniq"))
    every = both.withColumn("reads", F.lit("all")).unionByName(unique)
    return coverage(every, ["kind", "reads", "strand", "chr"])


def junction_paths(reads: DataFrame) -> DataFrame:
    """Chains of junctions of alignments with their counts: chr, chain, st, ed, cnt, ucnt."""
    sj = segments_to_junctions(reads)
    chain = sj.groupBy("map_id", "read_id", "chr").agg(F.array_sort(F.collect_list(F.struct("st", "ed"))).alias("_p"))
    text = F.expr("array_join(transform(_p, x -> concat(x.st, '|', x.ed)), ',')")
    multi = multi_mapped(reads).withColumn("_m", F.lit(1))
    out = chain.join(multi, "read_id", "left").withColumn("chain", text)
    return out.groupBy("chr", "chain").agg(F.min("_p")[0]["st"].alias("st"), F.element_at(F.min("_p"), -1)["ed"].alias("ed"), F.count("*").alias("cnt"), F.count_if(F.col("_m").isNull()).alias("ucnt"))
