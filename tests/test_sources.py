import struct

import pytest

from locus_spark.operators import compare as M
from locus_spark.sources import bigwig as B
from locus_spark.sources import readers as S
from locus_spark.sources import writers as K
from locus_spark.streaming import windows as ST


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bed_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 1, 5, "x", 0, "+"), ("chr2", 3, 9, "y", 1, "-"), ("chr2", None, 9, "z", 1, "-")], "chr string, st long, ed long, name string, sc1 int, strand string")
    K.write_bed(df, str(tmp_path / "out"))
    got = S.read_bed(spark, str(tmp_path / "out"))
    assert sorted((r["chr"], r["st"], r["ed"], r["name"], r["strand"]) for r in got.collect()) == [("chr1", 1, 5, "x", "+"), ("chr2", 3, 9, "y", "-")]
    K.write_bed(df, str(tmp_path / "by"), by_chromosome=True)
    assert (tmp_path / "by" / "chromosome=chr1").is_dir()


def test_gtf_gff(spark, tmp_path):
    gtf = put(tmp_path, "a.gtf", '#!x\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_number 2; gene_name "";\nchr1\ts\tgene\t11\t90\t.\t+\t.\tgene_id "g1";\n')
    row = S.read_gtf(spark, gtf, ["exon"]).first()
    assert (row["st"], row["gene_id"], row["transcript_id"], row["exon_number"], row["gene_name"]) == (11, "g1", "t1", "2", None)
    gff = put(tmp_path, "a.gff", "##gff\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g\nc\ts\tmRNA\t1\t9\t.\t+\t.\tID=t;Parent=g\nc\ts\texon\t5\t9\t.\t+\t.\tParent=t\nc\ts\texon\t1\t3\t.\t+\t.\tParent=t\n")
    assert sorted((r["st"], r["gid"], r["tid"], r["eid"]) for r in S.read_gff(spark, gff, ["exon"]).collect()) == [(1, "g", "t", "t:1"), (5, "g", "t", "t:2")]
    lines = K.gtf_lines(spark.createDataFrame([("c", 4, 9, "+", "g", "t")], "chr string, st long, ed long, strand string, gid string, tid string")).first()
    assert (lines["st"], lines["ed"], lines["extra"]) == (5, 9, 'gene_id "g"; transcript_id "t";')


def test_junction_tables(spark, tmp_path):
    path = put(tmp_path, "SJ.tab", "chr1\t3121707\t3142317\t2\t2\t0\t3\t0\t46\nchr1\t7\t9\t0\t0\t1\t1\t2\t10\n")
    got = sorted(tuple(r) for r in S.junctions_from_star(spark, path, 2.0).select("st", "name", "ucnt", "strand", "mcnt").collect())
    assert got == [(7, "non-canonical-k1-u1-m2-o10", 2.0, ".", 4.0), (3121707, "CT/AC-k0-u3-m0-o46", 6.0, "-", 0.0)]


def test_fasta_and_tiles(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">chr1 first\nACGTacgt\nTTTT\n>chr2\nGGcc\n")
    seq = S.read_fasta(spark, path)
    assert {r["chr"]: r["seq"] for r in seq.collect()} == {"chr1": "ACGTacgtTTTT", "chr2": "GGcc"}
    at = spark.createDataFrame([("chr1", 2, 9), ("chr2", 0, 4)], "chr string, st long, ed long")
    assert {r["chr"]: r["seq"] for r in M.fetch_sequence(M.tile_sequence(seq, 3), at, 3).collect()} == {"chr1": "GTacgtT", "chr2": "GGcc"}


def test_obo(spark, tmp_path):
    text = 'format-version: 1.2\n\n[Term]\nid: T:1\nname: root\n\n[Term]\nid: T:2\nname: leaf\nalt_id: T:9\ndef: "a \\"b\\"" [x]\nis_a: T:1 ! root\nrelationship: part_of T:3 ! o\n\n[Typedef]\nid: part_of\n'
    terms, edges = S.read_obo(spark, put(tmp_path, "a.obo", text))
    assert sorted((r["id"], r["name"], r["alt_ids"]) for r in terms.collect()) == [("T:1", "root", []), ("T:2", "leaf", ["T:9"])]
    assert sorted(tuple(r) for r in edges.collect()) == [("T:2", "T:1", "is_a"), ("T:2", "T:3", "part_of")]


def test_known_genes_and_matrix(spark, tmp_path):
    path = put(tmp_path, "kg.txt", "t1\tchr1\t+\t1\t90\t1\t90\t2\t1,50,\t9,90,\tp\ta\n")
    assert sorted((r["st"], r["ed"]) for r in S.read_known_genes(spark, path).collect()) == [(1, 9), (50, 90)]
    wide = put(tmp_path, "m.txt", "id\tx_1\tx_2\ty_1\ng\t1\t2\t3\n")
    assert sorted((r["sample"], r["grp"], r["value"]) for r in S.read_grouped_matrix(spark, wide, "id").collect()) == [("x_1", "x", 1.0), ("x_2", "x", 2.0), ("y_1", "y", 3.0)]
    with pytest.raises(ValueError):
        S.read_manifest(spark, wide)


def test_bigwig(spark, tmp_path):
    rows = [("chr1", 10 * k, 10 * k + 4, float(k)) for k in range(2000)] + [("chr2", 5, 9, 2.5)]
    path = str(tmp_path / "a.bw")
    B.write_bigwig(rows, {"chr1": 30000, "chr2": 100}, path)
    spark.dataSource.register(B.BigWigSource)
    df = spark.read.format("bigwig").load(path)
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    assert [tuple(r) for r in spark.read.format("bigwig").option("chr", "chr2").load(path).collect()] == rows[-1:]


def test_fixed_step_uses_step_and_span(tmp_path):
    file = B._File.__new__(B._File)
    file.order, file.buffer = "<", 0
    raw = struct.pack("<IIIIIBBH", 0, 100, 130, 10, 4, 3, 0, 3) + struct.pack("<3f", 1, 2, 3)
    (tmp_path / "b").write_bytes(raw)
    with open(tmp_path / "b", "rb") as file.f:
        assert list(file.runs(0, len(raw))) == [(0, 100, 104, 1.0), (0, 110, 114, 2.0), (0, 120, 124, 3.0)]


def test_streaming_sessions(spark, tmp_path):
    rows = [("u", f"2024-01-01 0{h}:00:00", float(h)) for h in (1, 2, 5, 9)] + [("z", "2024-01-03 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user string, t string, value double").selectExpr("user", "cast(t AS timestamp) AS ts", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = ST.sessions(ST.read_events(spark, str(tmp_path / "in"), df.schema), "user", "90 minutes")
    ST.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("user = 'u'").collect()}
    assert got <= {(2, 3.0), (1, 5.0), (1, 9.0)} and (2, 3.0) in got


def test_tiles_within(spark):
    seq = spark.createDataFrame([("a", "0123456789" * 3), ("b", "0123456"), ("c", "0123"), ("d", ""), ("e", None)], "chr string, seq string")
    tiles = M.tile_sequence(seq, 4, within=(5, 11))
    assert sorted((r["chr"], r["tile"], r["seq"]) for r in tiles.collect()) == [("a", 1, "4567"), ("a", 2, "8901"), ("b", 1, "456")]
    at = spark.createDataFrame([("a", 5, 11), ("b", 5, 7)], "chr string, st long, ed long")
    assert {r["chr"]: r["seq"] for r in M.fetch_sequence(tiles, at, 4).collect()} == {"a": "567890", "b": "56"}
