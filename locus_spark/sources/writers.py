"""Writers of text formats; each writes a folder of parts, by key where that is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.operators.intervals import build_blocks, drop_null_positions
from locus_spark.sources import schemas as S


def write_tsv(df: DataFrame, path: str, header: bool = True, by: Sequence[str] = (), compression: str = "gzip") -> None:
    """Tab-separated text; ``by`` makes one folder per key."""
    out = df.write.mode("overwrite").options(sep="\t", header=str(header).lower(), quote="", escape="", compression=compression)
    (out.partitionBy(*by) if by else out).csv(path)


def write_bed(df: DataFrame, path: str, columns: int | None = None, by_chromosome: bool = False) -> None:
    """The first BED columns that the frame has."""
    names = [c for c in S.BED.split() if c in df.columns][:columns]
    out = drop_null_positions(df).select(*(F.col(f"`{c}`") for c in names))
    if by_chromosome:
        out = out.withColumn("chromosome", F.col("chr"))
    write_tsv(out, path, header=False, by=["chromosome"] if by_chromosome else [])


def gtf_lines(exons: DataFrame, source: str = ".") -> DataFrame:
    """Half-open exon rows (gid, tid) as GTF rows, 1-based and closed."""
    extra = F.format_string('gene_id "%s"; transcript_id "%s";', F.col("gid").cast("string"), F.col("tid").cast("string"))
    return exons.select("chr", F.lit(source).alias("src"), F.lit("exon").alias("typ"), (F.col("st") + 1).alias("st"), "ed", F.lit(".").alias("sc1"), "strand", F.lit(".").alias("sc2"), extra.alias("extra"))


def write_gtf(exons: DataFrame, path: str, source: str = ".") -> None:
    write_tsv(gtf_lines(exons, source), path, header=False)


def write_gff(df: DataFrame, path: str) -> None:
    write_tsv(df.select(*S.GFF.split()), path, header=False)


def bed12(exons: DataFrame, group: Sequence[str], cmax: float = 9.0, coverage: str | None = None) -> DataFrame:
    """One BED12 row per group of exons, coloured by strand and log2 coverage."""
    out = build_blocks(exons, ["chr", "strand", *group])
    if coverage:
        out = out.join(exons.groupBy(*group).agg(F.max(coverage).alias("_c")), list(group))
    level = F.least(F.lit(1.0), F.log2(F.col("_c") + 1) / F.lit(cmax)) if coverage else F.lit(1.0)
    shade = F.round(F.lit(200) * (1 - level)).cast("int")
    colour = F.when(F.col("strand") == "-", F.format_string("%d,%d,200", shade, shade)).otherwise(F.format_string("200,%d,%d", shade, shade))
    return out.select("chr", "st", "ed", F.concat_ws(".", *group).alias("name"), F.lit(0).alias("sc1"), "strand", F.col("st").alias("tst"), F.col("ed").alias("ted"), colour.alias("sc2"), F.col("n_blocks").alias("#exons"), "esizes", "estarts")


def write_bedgraph(track: DataFrame, path: str) -> None:
    write_tsv(track.select("chr", "st", "ed", F.col("value").cast("float")), path, header=False)
