import random

import pytest

from locus_spark.operators import coverage as C
from locus_spark.operators import intervals as I

ROWS = [
    ("chr1", 0, 10, "a", 0, "+"), ("chr1", 5, 20, "a", 1, "-"), ("chr1", 25, 30, "a", 1, "+"), ("chr1", 40, 45, "b", 2, "-"), ("chr1", 45, 50, "b", 2, "+"),
    ("chr1", 49, 55, "c", 2, "+"), ("chr2", 55, 60, "d", 3, "-"), ("chr2", 60, 70, "d", 4, "+"), ("chr2", 70, 80, "e", 4, "-"), ("chr2", 80, 90, "e", 5, "+"),
]
SCHEMA = "chr string, st long, ed long, name string, sc1 int, strand string"


def frame(spark, rows, schema="chr string, st long, ed long"):
    return spark.createDataFrame(rows, schema)


def out(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def spread(n, seed, most=120):
    """Nested, equal, touching, one-base and long intervals on two chromosomes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        st = rng.randrange(most)
        rows.append((rng.choice(["a", "b"]), st, st + rng.choice([1, 2, 5, 9, 40])))
        if rng.random() < 0.2:
            rows.append(rows[-1])
        if rng.random() < 0.2:
            rows.append((rows[-1][0], rows[-1][2], rows[-1][2] + 3))
    return rows


def test_union_by_gene(spark):
    df = frame(spark, ROWS, SCHEMA)
    by_name = out(I.merge(df, ["name", "chr"]), "chr", "st", "ed", "name")
    assert len(by_name) == 6 and by_name[0] == ("chr1", 0, 20, "a") and by_name[-1] == ("chr2", 70, 90, "e")
    assert I.merge(df, ["sc1", "chr"]).count() == 7


def test_union_contiguous(spark):
    assert out(I.merge(frame(spark, ROWS, SCHEMA)), "chr", "st", "ed") == [("chr1", 0, 20), ("chr1", 25, 30), ("chr1", 40, 55), ("chr2", 55, 90)]


def test_gap_and_ratio(spark):
    a = frame(spark, [("chr1", 10, 20), ("chr1", 30, 40)])
    b = frame(spark, [("chr1", 15, 20), ("chr1", 38, 48)])
    assert out(I.overlap_ratio(a, b), "st", "ed", "len", "ovl", "ovlratio", "notcovbp") == [(10, 20, 10, 5, 0.5, 5), (30, 40, 10, 2, 0.2, 8)]
    gaps = frame(spark, [("chr1", 10, 20), ("chr1", 30, 40), ("chr1", 100, 110), ("chr1", 120, 150)])
    assert out(I.merge(gaps, gap=50), "st", "ed") == [(10, 40), (100, 150)]


@pytest.mark.parametrize("tile", [7, 1000])
def test_sweeps_match_brute_force(spark, tile):
    rows = spread(60, tile)
    df, depth = frame(spark, rows), {}
    for c, s, e in rows:
        for p in range(s, e):
            depth[c, p] = depth.get((c, p), 0) + 1
    track = out(C.coverage(df, tile=tile), "chr", "st", "ed", "value")
    assert {(c, p): v for c, s, e, v in track for p in range(s, e)} == depth
    assert all(x[2] < y[1] or x[3] != y[3] for x, y in zip(track, track[1:]) if x[0] == y[0])
    merged = out(I.merge(df, tile=tile), "chr", "st", "ed")
    assert {(c, p) for c, s, e in merged for p in range(s, e)} == set(depth)
    assert all(x[2] < y[1] for x, y in zip(merged, merged[1:]) if x[0] == y[0])
    sizes = spark.createDataFrame([("a", 150), ("b", 150), ("empty", 5)], "chr string, size long")
    free = out(I.complement(df, sizes, tile=tile), "chr", "st", "ed")
    assert {(c, p) for c, s, e in free for p in range(s, e)} == {(c, p) for c, n in (("a", 150), ("b", 150), ("empty", 5)) for p in range(n)} - set(depth)


def test_overlaps_match_brute_force(spark):
    a, b = sorted(set(spread(40, 1))), [(*r, k) for k, r in enumerate(spread(40, 2))]
    da, db = frame(spark, a), frame(spark, b, "chr string, st long, ed long, id long")
    want = sorted((c, s, e, k) for c, s, e in a for d, t, f, k in b if c == d and s < f and t < e)
    for width in (1, 8, 1000):  # every bin level comes into use
        assert out(I.overlap_join(da, db, width=width), "chr", "st", "ed", "b_id") == want
    hit = {w[:3] for w in want}
    assert set(out(I.overlap_join(da, db, "semi"), "chr", "st", "ed")) == hit
    assert set(out(I.overlap_join(da, db, "anti"), "chr", "st", "ed")) == set(a) - hit
    assert I.overlap_join(da, db, "left").count() == len(want) + len(set(a) - hit)
    held = {(c, p) for c, s, e, _ in b for p in range(s, e)}
    left = out(I.subtract(da, db), "chr", "st", "ed")
    assert sorted((c, p) for c, s, e in left for p in range(s, e)) == sorted((c, p) for c, s, e in a for p in range(s, e) if (c, p) not in held)


def test_atomic_and_blocks(spark):
    rows = [(*r, k) for k, r in enumerate(spread(30, 3))]
    df = frame(spark, rows, "chr string, st long, ed long, id long")
    atoms = out(I.atomic(df, "id"), "chr", "st", "ed", "ids")
    assert all(ids == sorted(k for c, s, e, k in rows if c == chrom and s <= st and ed <= e) and ids for chrom, st, ed, ids in atoms)
    assert sum(ed - st for _, st, ed, _ in atoms) == I.merge(df).selectExpr("sum(ed - st)").first()[0]
    one = frame(spark, [("chr1", 0, 10, "a"), ("chr1", 15, 20, "a"), ("chr1", 25, 30, "a")], "chr string, st long, ed long, name string")
    built = I.build_blocks(one, ["chr", "name"])
    assert out(built, "st", "ed", "n_blocks", "esizes", "estarts") == [(0, 30, 3, "10,5,5,", "0,15,25,")]
    assert out(I.explode_blocks(built), "st", "ed") == [(0, 10), (15, 20), (25, 30)]


@pytest.mark.parametrize("strand", ["+", "-"])
def test_trimming(spark, strand):
    rows = [(g, strand, s, e) for g, s, e in [("short", 0, 110), ("long", 0, 1634), ("two", 0, 149), ("two", 300, 401), ("big", 0, 194), ("big", 500, 2173)]]
    df = I.trim_3prime(frame(spark, rows, "gid string, strand string, st long, ed long"), "gid", 1000)
    sizes = {r[0]: r[1] for r in df.groupBy("gid").agg({"gid": "count"}).join(df.selectExpr("gid", "ed - st AS n").groupBy("gid").sum("n"), "gid").select("gid", "sum(n)").collect()}
    assert sizes == {"short": 110, "long": 1000, "two": 250, "big": 1000}


def test_empty_and_null_rows(spark):
    empty = frame(spark, [])
    assert I.merge(empty).count() == C.coverage(empty).count() == I.overlap_join(empty, empty).count() == 0
    holes = frame(spark, [("a", None, 3), (None, 1, 2), ("a", 1, 2)])
    assert out(I.drop_null_positions(holes), "chr", "st", "ed") == [("a", 1, 2)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_broadcast(spark):
    """Spark takes an explode for as large as its input, and broadcast binned rows of any number."""
    a = frame(spark, [("a", x, x + 30) for x in range(0, 900, 7)])
    assert "BroadcastHashJoin" not in plan(I.overlap_pairs(a, a))


def test_bins_follow_the_levels_that_occur(spark):
    short = frame(spark, [("a", x * 64, x * 64 + 20) for x in range(200)])
    assert I._binned(short, ["chr"], 64, "", 2, [0]).count() == 200
    assert I._binned(short, ["chr"], 64, "", 2, []).count() == 0
    assert I._binned(short, ["chr"], 64, "", 2, [2]).count() == 200
    # Rows of all levels on either side, on both, and none at all.
    rng = random.Random(5)
    rows = lambda sizes: [(rng.choice("ab"), st, st + rng.choice(sizes)) for st in (rng.randrange(60_000) for _ in range(150))]
    low, high, every = [1, 3, 40], [5_000, 40_000], [1, 90, 300, 2_500, 30_000]
    for left, right in ((low, low), (low, high), (high, low), (every, every), (every, low), (low, None), (None, high)):
        x, y = (rows(sizes) if sizes else [] for sizes in (left, right))
        got = out(I.overlap_pairs(frame(spark, x), frame(spark, y), width=1), "chr", "st", "ed", "b_st", "b_ed", "ovl")
        want = [(c, s, e, t, f, min(e, f) - max(s, t)) for c, s, e in x for d, t, f in y if c == d and s < f and t < e]
        assert got == sorted(want)


def test_steps_of_exact_doublings(spark):
    """A depth that doubles steps by the difference of the C library's logarithms, as in SQL."""
    import math

    track = frame(spark, [("a", 100 * k, 100 * k + 10, k - 1) for k in range(2, 100)] + [("a", 100 * k + 10, 100 * k + 20, 2 * k - 1) for k in range(2, 100)], "chr string, st long, ed long, value long")
    got = {r["pos"]: r["step"] for r in C.changes(track).collect()}
    assert [got[100 * k + 10] for k in range(2, 100)] == [-math.log2(k) + math.log2(2 * k) for k in range(2, 100)]


def _no_pairs(*args, **kwargs):
    raise AssertionError("pairs were made")


def test_overlapped_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(I, "overlap_pairs", _no_pairs)
    rng = random.Random(8)
    a = [(f"c{rng.randrange(3)}", s, s + rng.choice([0, 1, 5, 30, 400]), k) for k, s in enumerate(rng.choices(range(-200, 900), k=150))] + [(None, 1, 9, 900), ("c1", None, 9, 901), ("c1", 1, None, 902)]
    b = [(f"c{rng.randrange(4)}", s, s + rng.choice([0, 1, 9, 60]), None) for s in rng.choices(range(-200, 900), k=40)] + [("c2", 100, 700, None), (None, 1, 9, None), ("c1", None, None, None)]
    hit = {r[3] for r in a if None not in r for x in b if x[0] == r[0] and x[1] is not None and r[1] < x[2] and x[1] < r[2]}
    left, right = (spark.createDataFrame(rows, "chr string, st long, ed long, _low long") for rows in (a, b))
    for how in ("semi", "anti"):
        got = [r["_low"] for r in I.overlap_join(left, right, how, width=1).collect()]
        assert sorted(got) == sorted(k for *_, k in a if (k in hit) == (how == "semi"))


def test_tracks_by_sweep(spark, monkeypatch):
    for module in (I, C):
        monkeypatch.setattr(module, "overlap_pairs", _no_pairs)
    rng, depth, tracks = random.Random(9), [{}, {}], [[], []]
    for k in (0, 1):
        at = 0
        while at < 300:
            end = at + rng.randrange(1, 40)
            value = rng.choice([None, 0.1, 0.2, 0.3, -0.5])
            if value is not None:
                tracks[k].append(("c", at, end, value))
                depth[k] |= dict.fromkeys(range(at, end), value)
            at = end
    most = {p: max(d[p] for d in depth if p in d) for p in set(depth[0]) | set(depth[1])}
    frames = [spark.createDataFrame(t, "chr string, st long, ed long, value double") for t in tracks]
    rows = sorted(tuple(r) for r in C.overlay_max(*frames, tile=16).collect())
    assert {p: v for _, s, e, v in rows for p in range(s, e)} == most
    assert all(x[2] < y[1] or x[3] != y[3] for x, y in zip(rows, rows[1:]))

    exons = spark.createDataFrame([("c", 20, 30), ("c", 150, 151)], "chr string, st long, ed long")
    islands = [(r["st"], r["ed"]) for r in I.merge(frames[0].filter("value > 0")).collect()]
    free = [(s, e) for s, e in islands if e - s >= 10 and not (s < 30 and 20 < e or s < 151 and 150 < e)]
    got = {(r["st"], r["ed"]): r["cov"] for r in C.single_exon_candidates(frames[0], exons, 10).collect()}
    assert got == pytest.approx({(s, e): sum(depth[0][p] for p in range(s, e)) / (e - s) for s, e in free})


def test_combined_coverage(spark):
    rng = random.Random(10)
    sets = [spark.createDataFrame([("c", s, s + rng.randrange(0, 30)) for s in rng.choices(range(200), k=40)], "chr string, st long, ed long") for _ in range(2)]
    expected = C.combine([C.coverage(d) for d in sets], [1.0, -1.0], scale=0.5)
    assert sorted(map(tuple, C.combined_coverage(sets, [1, -1], scale=0.5, tile=32).collect())) == sorted(map(tuple, expected.collect()))
