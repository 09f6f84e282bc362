import random

import pytest
from pyspark.sql import functions as F

from locus_spark.functions import kernels as K
from locus_spark.functions import thresholds as H
from locus_spark.operators import compare as M
from locus_spark.operators import coverage as C
from locus_spark.operators import reads as D
from locus_spark.operators import refine as X
from locus_spark.plans import assembly as A
from locus_spark.sources import writers as W

SJ = "chr string, st long, ed long, strand string, ucnt long, mcnt long"


def test_assembly(spark):
    """Two genes of three and two exons, and one junction too weak to count."""
    exons = [(100, 200), (300, 400), (500, 600), (1000, 1100), (1200, 1300)]
    track = spark.createDataFrame([("c", s, e, 10) for s, e in exons], "chr string, st long, ed long, value long")
    sj = spark.createDataFrame([("c", 201, 300, "+", 5, 0), ("c", 401, 500, "+", 5, 0), ("c", 1101, 1200, "-", 4, 0), ("c", 201, 500, "+", 0, 1)], SJ)
    made = A.assemble(sj, track, longest=1000)
    got = sorted((r["st"], r["ed"], r["kind"], r["cat"], r["_gidx"] > 0, r["cov"]) for r in made["ex"].collect())
    assert got == [(100, 200, "5", "5", True, 10.0), (300, 400, "i", "i", True, 10.0), (500, 600, "3", "3", True, 10.0), (1000, 1100, "3", "3", False, 10.0), (1200, 1300, "5", "5", False, 10.0)]
    assert made["genes"].count() == 2 and made["sj"].count() == 3
    assert sorted(len(r["path"]) for r in A.abundances(made["ex"], made["sj"]).collect()) == [2, 3]


def test_merge_and_snap(spark):
    sj = spark.createDataFrame([("s1", "c", 11, 20, "+", 3, 1), ("s2", "c", 11, 20, "+", 0, 2), ("s2", "c", 50, 60, "-", 0, 0)], "sample string, " + SJ)
    track = spark.createDataFrame([("c", 0, 5, 1.0)], "chr string, st long, ed long, value double")
    total, summed = A.merge_samples(sj, [track, track])
    assert [(r["ucnt"], r["mcnt"], r["detected"], r["total"]) for r in total.collect()] == [(3, 3, 2, 5.0)]
    assert [tuple(r) for r in summed.collect()] == [("c", 0, 5, 2.0)]
    ex = spark.createDataFrame([("c", "+", 23, 40), ("c", "+", 0, 8), ("c", "+", 100, 110)], "chr string, strand string, st long, ed long")
    assert sorted((r["st"], r["ed"]) for r in A.snap_exons(ex, sj.filter("ucnt > 0"), 5).collect()) == [(0, 10), (20, 40), (100, 110)]


def test_evaluation(spark):
    ref = spark.createDataFrame([("c", 0, 10, 1, "g"), ("c", 20, 30, 2, "g"), ("c", 90, 99, 3, "h")], "chr string, st long, ed long, id long, gene string")
    got = A.evaluate(ref, ref.filter("id = 1").withColumn("ed", F.lit(12).cast("long")))
    assert {(r["gene"], r["completeness"]) for r in got["completeness"].collect()} == {("g", 0.5), ("h", 0.0)}
    assert got["counts"].first().asDict() == {"pop": 3, "hit": 1, "exact": 0, "one_side": 1, "rate": 1 / 3}


def test_repeats(spark):
    seq = spark.createDataFrame([("chr1", "A" * 40 + "acgtTcgtag" + "A" * 50), ("chr2", "a" * 100)], "chr string, seq string")
    exons = spark.createDataFrame([("chr1", 40, 50, "a"), ("chr1", 60, 80, "b"), ("chr2", 0, 50, "c")], "chr string, st long, ed long, gname string")
    repeats = spark.createDataFrame([("chr1", 39, 55), ("chr1", 60, 80)], "chr string, st long, ed long")
    left = A.filter_repeats(exons, M.tile_sequence(seq, 7), repeats, "gname", 7)
    assert sorted(r["gname"] for r in left.collect()) == ["b", "c"]


def test_paths_of_unknown_strand(spark):
    paths = spark.createDataFrame([("p", "+", 2), ("q", ".", 1), ("r", ".", 1)], "path string, strand string, n int")
    members = spark.createDataFrame([("p", 10, 20), ("p", 30, 40), ("q", 20, 10), ("r", 50, 60)], "path string, d long, a long")
    assert sorted(r["path"] for r in X.drop_shadowed_paths(paths, members).collect()) == ["p", "r"]
    two = spark.createDataFrame([("c", 10, 20, "+"), ("c", 90, 95, "+")], "chr string, st long, ed long, strand string")
    multi = spark.createDataFrame([("c", 0, 50, "-"), ("c", 80, 99, "+")], "chr string, st long, ed long, strand string")
    assert [r["st"] for r in X.drop_spanned(two, multi).collect()] == [90]


def test_splice_strand_and_tracks(spark):
    tiles = M.tile_sequence(spark.createDataFrame([("c", "AAAAAGTxxxxxAGAAAACTxxxACAA")], "chr string, seq string"), 4)
    reads = spark.createDataFrame([("c", 0, 5, "r1", 1), ("c", 14, 18, "r1", 1), ("c", 14, 18, "r2", 2), ("c", 25, 27, "r2", 2), ("c", 0, 5, "r2", 3)], "chr string, st long, ed long, read_id string, map_id int")
    strands = D.splice_strand(D.segments_to_junctions(reads), tiles, 4)
    assert sorted((r["st"], r["ed"], r["strand"]) for r in strands.collect()) == [(5, 14, "+"), (18, 25, "-")]
    got = {tuple(r) for r in D.tracks(reads, strands).select("kind", "reads", "strand", "st", "ed", "value").collect()}
    assert ("sj", "uniq", "+", 5, 14, 1) in got and ("sj", "all", "-", 18, 25, 1) in got and ("ex", "all", ".", 0, 5, 1) in got and not any(x[1] == "uniq" and x[2] == "-" for x in got)


def test_tracks_across_exons(spark):
    track = spark.createDataFrame([("c", 0, 10, 4), ("c", 20, 30, 6)], "chr string, st long, ed long, value long")
    exons = spark.createDataFrame([("c", 10, 20)], "chr string, st long, ed long")
    assert sorted(tuple(r) for r in C.fill_exon_gaps(track, exons).collect()) == [("c", 0, 20, 4), ("c", 20, 30, 6)]


def test_kernels_by_group(spark):
    parts = spark.createDataFrame([("b", [1], 4.0, 10), ("b", [1, 2], 10.0, 5), ("b", [2], 6.0, 10)], "block string, ids array<int>, cov double, len long")
    assert {r["id"]: round(r["value"], 4) for r in K.deconvolve(parts).collect()} == {1: 4.0, 2: 6.0}
    spread = {r["id"]: (round(r["value"], 4), r["solved"]) for r in K.deconvolve(parts, max_block=1).collect()}
    assert spread == {1: (6.0, False), 2: (7.3333, False)}
    paths = spark.createDataFrame([("g", "x", [1, 2], 5.0), ("g", "y", [1], 4.0), ("g", "z", [3], 1.0)], "gene string, path string, members array<int>, abundance double")
    assert sorted(r["path"] for r in K.cover(paths).collect()) == ["x", "z"]
    three = [spark.createDataFrame([("p", v)], "k string, value double") for v in (1.0, 9.0, 4.0)]
    assert A.group_abundance(three, ["k"]).first()["value"] == 4.0


def test_logistic_and_thresholds(spark):
    rng = random.Random(1)
    rows = [(x := rng.gauss(0, 1), int(rng.random() < 1 / (1 + 2.718281828 ** -(3 * x)))) for _ in range(2000)]
    intercept, weights = K.fit_logistic(spark.createDataFrame(rows, "x double, y int"), "y", ["x"])
    assert weights["x"] == pytest.approx(3, abs=0.4) and abs(intercept) < 0.3
    real = spark.createDataFrame([(x / 10,) for x in range(100)], "v double")
    noise = spark.createDataFrame([(x / 50,) for x in range(100)], "v double")
    assert H.false_rate_threshold(real, noise, "v", 0, 10, 100, rate=0.05) == pytest.approx(2.0, abs=0.1)


def test_bed12_lines(spark):
    ex = spark.createDataFrame([("c", "+", "t", 5, 9), ("c", "+", "t", 20, 30)], "chr string, strand string, tid string, st long, ed long")
    row = W.bed12(ex, ["tid"]).first()
    assert (row["st"], row["ed"], row["name"], row["#exons"], row["esizes"], row["estarts"]) == (5, 30, "t", 2, "4,10,", "0,15,")


def test_materialized_tables_go(spark):
    from pathlib import Path

    from locus_spark.plans import materialize as P

    P.drop_materialized(spark)
    made = P.materialize(spark.range(3), "short-lived")
    folder = Path(P.shared_folder(spark).removeprefix("file:"))
    assert made.count() == 3 and list(folder.glob("short-lived-*"))
    P.drop_materialized(spark)
    assert not list(folder.glob("short-lived-*"))


def test_snaps_without_a_row_per_position(spark):

    rng = random.Random(8)
    ex = {(rng.choice("ab"), rng.choice("+-"), st, st + rng.randrange(1, 40)) for st in (rng.randrange(-50, 500) for _ in range(120))}
    sj = {(rng.choice("ab"), st, st + rng.randrange(5, 60), rng.choice("+-")) for st in (rng.randrange(-50, 500) for _ in range(60))}
    got = A.snap_exons(spark.createDataFrame(sorted(ex), "chr string, strand string, st long, ed long"), spark.createDataFrame(sorted(sj), "chr string, st long, ed long, strand string"), 6)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()

    def to(pos, sites):
        near = [(abs(s - pos), s) for s in sites if abs(s - pos) <= 6]
        return min(near)[1] if near else pos

    want = []
    for c, s, st, ed in ex:
        a = to(st, [e for d, _, e, t in sj if (d, t) == (c, s)])
        b = to(ed, [x - 1 for d, x, _, t in sj if (d, t) == (c, s)])
        want += [(c, s, a, b)] if a < b else []
    assert sorted((r["chr"], r["strand"], r["st"], r["ed"]) for r in got.collect()) == sorted(want)
