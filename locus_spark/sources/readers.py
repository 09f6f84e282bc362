"""Readers of text formats. Splitting, attributes and casts are expressions over the lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locus_spark.operators.intervals import drop_null_positions
from locus_spark.sources import schemas as S


def read_tsv(spark: SparkSession, path: str, columns: str | StructType, header: bool = False, comment: str | None = None) -> DataFrame:
    """Tab-separated text, compressed or not, with a fixed schema; empty fields are null."""
    layout = S.schema(columns) if isinstance(columns, str) else columns
    options = {"sep": "\t", "header": str(header).lower(), "quote": "", "nullValue": "", "mode": "PERMISSIVE"}
    if comment:
        options["comment"] = comment
    return spark.read.options(**options).schema(layout).csv(path)


def read_bed(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """BED with 3 to 12 columns; rows without a position are dropped."""
    if columns is None:
        first = spark.read.text(path).filter("value NOT LIKE '#%' AND value NOT LIKE 'track%' AND value <> ''").first()
        columns = len(first["value"].split("\t")) if first else 3
    return drop_null_positions(read_tsv(spark, path, " ".join(S.BED.split()[:columns]), comment="#"))


def read_junctions(spark: SparkSession, path: str, parse_name: bool = False) -> DataFrame:
    """Junction BED: unique and multiple counts; optionally motif and overhang out of the name
    (motif-kA-uU-mM-oO)."""
    out = drop_null_positions(read_tsv(spark, path, S.SJ))
    if parse_name:
        part = F.split("name", "-")
        out = out.withColumns({
            "motif": part[0], "known": F.substring(part[1], 2, 9).cast("long"), "ureads": F.substring(part[2], 2, 12).cast("long"),
            "mreads": F.substring(part[3], 2, 12).cast("long"), "overhang": F.substring(part[4], 2, 12).cast("long"),
        })
    return out


def _lookup(column: str, pairs: Sequence[tuple[int, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))[F.col(column).cast("int")]


def junctions_from_star(spark: SparkSession, path: str, scale: float | None = None) -> DataFrame:
    """Aligner junction tables to junction BED, counts optionally scaled."""
    t = read_tsv(spark, path, S.SJTAB)
    times = F.lit(1.0 if scale is None else float(scale))
    name = F.format_string("%s-k%d-u%d-m%d-o%d", _lookup("motif", S.MOTIFS), "annotated", "ureads", "mreads", "maxoverhang")
    return t.select(
        "chr", "st", "ed", name.alias("name"), (F.col("ureads") * times).alias("ucnt"), _lookup("strand2", S.STRANDS).alias("strand"), (F.col("mreads") * times).alias("mcnt"),
        F.col("maxoverhang"),
    )


def gtf_attribute(name: str, column: str = "extra") -> Column:
    """The value of one attribute ``name "value";``; null if absent or empty."""
    return F.nullif(F.regexp_extract(column, rf'(?:^|;\s*){name} "?([^";]*)"?', 1), F.lit(""))


def gff_attribute(name: str, column: str = "attr") -> Column:
    """The value of one attribute ``name=value``."""
    return F.nullif(F.regexp_extract(column, rf"(?:^|;\s*){name}=([^;]*)", 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, types: Sequence[str] = (), attributes: Sequence[str] = ("gene_id", "transcript_id", "exon_number", "gene_name", "gene_type")) -> DataFrame:
    """GTF with attributes as columns; positions stay 1-based and closed as in the file."""
    out = read_tsv(spark, path, S.GTF, comment="#")
    out = out.filter(F.col("typ").isin(*types)) if types else out
    return out.withColumns({a: gtf_attribute(a) for a in attributes})


def read_gff(spark: SparkSession, path: str, types: Sequence[str] = ()) -> DataFrame:
    """GFF3 with ID, Parent, and gid, tid, eid; exons without an ID are numbered in their transcript."""
    rows = read_tsv(spark, path, S.GFF, comment="#").withColumns({"ID": gff_attribute("ID"), "Parent": gff_attribute("Parent")})
    tx = rows.filter("typ IN ('mRNA', 'transcript')").select(F.col("ID").alias("_t"), F.col("Parent").alias("_g")).distinct()
    out = rows.join(tx, rows["Parent"] == tx["_t"], "left")
    is_tx, is_gene = F.col("typ").isin("mRNA", "transcript"), F.col("typ") == "gene"
    out = out.withColumns({
        "gid": F.when(is_gene, F.col("ID")).when(is_tx, F.col("Parent")).otherwise(F.col("_g")),
        "tid": F.when(is_tx, F.col("ID")).when(is_gene, F.lit(None)).otherwise(F.col("Parent")),
    }).drop("_t", "_g")
    number = F.row_number().over(W.partitionBy("tid", "typ").orderBy("st", "ed"))
    made = F.concat("tid", F.lit(":"), number.cast("string"))
    out = out.withColumn("eid", F.when(F.col("typ") == "exon", F.coalesce("ID", made)))
    return out.filter(F.col("typ").isin(*types)) if types else out


def read_known_genes(spark: SparkSession, path: str, ref_gene: bool = False) -> DataFrame:
    """UCSC gene tables, one row per exon: chr, st, ed, strand, tid, gid."""
    t = read_tsv(spark, path, S.REF_GENE if ref_gene else S.KNOWN_GENE)

    def numbers(c: str) -> str:
        return f"transform(filter(split({c}, ','), x -> x <> ''), x -> cast(x AS BIGINT))"

    out = t.select("chr", "strand", F.col("name").alias("tid"), F.col("name2" if ref_gene else "name").alias("gid"), F.explode(F.expr(f"arrays_zip({numbers('exst')}, {numbers('exed')})")).alias("x"))
    return out.select("chr", F.col("x")["0"].alias("st"), F.col("x")["1"].alias("ed"), "strand", "tid", "gid")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq) of FASTA records, one row each; records split at the header mark."""
    records = spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    return records.select(F.split(lines[0], r"\s+")[0].alias("chr"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (id, name, namespace, def, obsolete, alt_ids) and edges (child, parent, kind) of an OBO ontology."""
    block = spark.read.option("lineSep", "\n\n").text(path).filter(r"value RLIKE '^\\s*\\[Term\\]'")

    def one(tag: str) -> Column:
        return F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: ([^\n\r!]*?)\s*$", 1), F.lit(""))

    terms = block.select(
        one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"),
        F.nullif(F.regexp_extract("value", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("def"),
        F.coalesce(one("is_obsolete") == "true", F.lit(False)).alias("obsolete"),
        F.regexp_extract_all("value", F.lit(r"(?m)^alt_id: (\S+)"), 1).alias("alt_ids"), "value",
    )
    is_a = terms.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), 1)).alias("parent"), F.lit("is_a").alias("kind"))
    part = terms.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^relationship: part_of (\S+)"), 1)).alias("parent"), F.lit("part_of").alias("kind"))
    return terms.drop("value"), is_a.unionAll(part)


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    """Gene-to-term associations (GAF)."""
    return read_tsv(spark, path, S.GAF, comment="!")


def read_grouped_matrix(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """A matrix whose columns are called group_replicate, as (id, sample, grp, value)."""
    wide = spark.read.options(sep="\t", header="true").csv(path)
    samples = [c for c in wide.columns if c != id_column]
    long = wide.unpivot([id_column], samples, "sample", "value").withColumn("value", F.col("value").cast("double"))
    return long.withColumn("grp", F.regexp_replace("sample", "_[^_]*$", ""))


def read_manifest(spark: SparkSession, path: str, required: Sequence[str] = ("name", "sjexpre")) -> DataFrame:
    """A sample table with a header; missing columns are an error."""
    out = spark.read.options(sep="\t", header="true").csv(path)
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return out
