"""Smoothed tracks and atomic parts, against brute force."""

import random

from pyspark.sql import functions as F

from locus_spark.functions import thresholds as H
from locus_spark.operators import intervals as I


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_smooth(spark):
    random.seed(3)
    track, at = [("b", -70, 9, 4), ("d", -9, -8, 2), ("d", 2, 3, 5)], -90
    for _ in range(300):
        st = at + random.choice([0, 0, 1, 5, 40])
        at = st + random.choice([1, 2, 7, 30, 900, 40_000])
        track.append(("a", st, at, random.randint(1, 9)))
    df = spark.createDataFrame(track, "chr string, st long, ed long, value long")
    out = H.smooth(df, ["chr"], 20)
    assert not joins(out)
    got = {(r["chr"], r["st"], r["ed"]): r["cov"] for r in out.collect()}
    assert len(got) == len({(c, max(st - 20, 0), st + 21) for c, st, *_ in track})
    for (c, lo, hi), cov in got.items():
        total = sum(v * (min(ed, hi) - max(st, lo)) for k, st, ed, v in track if k == c and st < hi and lo < ed)
        assert hi == lo and cov is None or abs(cov - total / (hi - lo)) < 1e-9, (c, lo, hi)
    assert not H.smooth(df.limit(0), ["chr"], 20).collect()


def test_atomic_short_and_long(spark):
    random.seed(5)
    short = [("a", st, st + random.randint(1, 200), random.randint(1, 9)) for st in random.sample(range(-300, 1200), 80)] + [("b", 5, 5, 1), ("b", 1, 9, None)]
    long = short + [("a", -40_000, 30_000, 77), ("c", 0, 100_000, 1), ("c", 0, 100_000, 2)]
    for rows in (short, long):
        out = I.atomic(spark.createDataFrame(rows, "chr string, st long, ed long, id long"), "id", width=16)
        got = {(r["chr"], r["st"], r["ed"]): r["ids"] for r in out.collect()}
        expected = {}
        for c in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == c and r[1] < r[2]]
            cuts = sorted({p for r in own for p in r[1:3]})
            for st, ed in zip(cuts, cuts[1:]):
                over = [r for r in own if r[1] <= st and ed <= r[2]]
                if over:
                    expected[c, st, ed] = sorted({r[3] for r in over} - {None})
        assert got == expected


def test_atomic_parts_gather_in_place(spark):
    # The parts meet their intervals and gather ids in one exchange: none after the join.
    df = spark.range(200).select(F.lit("a").alias("chr"), (F.col("id") * 7).alias("st"), (F.col("id") * 7 + 20).alias("ed"), "id")
    plan = I.atomic(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
