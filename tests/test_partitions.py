"""Partitions of a given number of rows, which Spark's adaptive merging leaves alone."""

import random

import pytest
from pyspark.sql import functions as F

from locus_spark.operators import intervals as I
from locus_spark.operators import merging as M
from locus_spark.plans import materialize


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(materialize, "PART_ROWS", 50)
    monkeypatch.setattr(materialize, "LEAST_ROWS", 50)


def most_rows(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


@pytest.mark.parametrize("told", [True, False])
def test_junction_totals_in_small_partitions(spark, small, told):
    random.seed(7)
    steps = [[tuple(random.sample(range(60), 2)) for _ in range(random.randint(1, 4))] for _ in range(400)]
    paths = [(random.choice("ab"), random.randint(1, 99), ",".join(["7", *(f"{a}|{b}" for a, b in s), "9"])) for s in steps]
    paths += [("a", 5, "3,4"), ("a", 5, None), (None, 8, "1|2")]
    expected = {(None, 1, 2): 8}
    for (c, n, _), s in zip(paths, steps):
        for a, b in s:
            at = c, min(a, b), max(a, b)
            expected[at] = max(n, expected.get(at, 0))
    out = M.junction_totals(spark.createDataFrame(paths, "chr string, n long, name string"), "n", rows=sum(map(len, steps)) + 1 if told else None)
    # What a task groups it has been dealt: nothing is grouped ahead of the exchange.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange") :]
    assert {(r["chr"], r["st"], r["ed"]): r["n"] for r in out.collect()} == expected
    assert most_rows(out) < 150 < len(expected)


@pytest.mark.parametrize("options", [{}, {"gap": 3}, {"touching": False}], ids=str)
def test_merge_deals_a_table_that_is_only_read(spark, small, tmp_path, options):
    random.seed(11)
    rows = [(random.choice("aab"), st, st + random.choice([0, 1, 2, 4, 4, 90]), random.randint(1, 9)) for st in random.choices(range(-9000, 9000), k=3000)]
    spark.createDataFrame(rows + [(None, 1, 2, 3), ("a", None, 4, 5)], "chr string, st long, ed long, v long").coalesce(1).write.parquet(f"{tmp_path}/t")
    expected, at, reach = [], None, None
    for c, st, ed, v in sorted(rows):
        new = c != at or (st > reach + options.get("gap", 0) if options.get("touching", True) else st >= reach)
        if new:
            expected.append([c, st, ed, 0, 0, v])
        x = expected[-1]
        x[2:] = max(x[2], ed), x[3] + 1, x[4] + v, min(x[5], v)
        at, reach = c, ed if c != at else max(reach, ed)
    df = spark.read.parquet(f"{tmp_path}/t").withColumn("low", F.col("v"))
    out = I.merge(df, sums=["v"], mins=["low"], tile=1024, **options)
    assert sorted(map(tuple, out.select("chr", "st", "ed", "n", "v", "low").collect())) == sorted(map(tuple, expected))
    assert most_rows(out) < 200 < len(expected)
    # Only what files know is counted.
    assert materialize.rows_of_scan(df) == len(rows) + 2 and materialize.rows_of_scan(df.filter("v > 1")) is None
