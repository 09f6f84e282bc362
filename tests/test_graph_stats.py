import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locus_spark.functions import kernels as K
from locus_spark.functions import stats as T
from locus_spark.operators import graph as G
from locus_spark.operators import junctions as J


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500)] + [(600, 600 + i) for i in range(30)] + [(None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in spark.createDataFrame(edges, "src long, dst long").transform(G.connected_components).collect()}
    assert got == {x: find(x) for x in root}
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_contract(spark, monkeypatch):
    # Stars and one long path: rounds for the path must not write the stars again, nor may a sorted path take a round a node.
    monkeypatch.setattr(G, "FEW_EDGES", 4, raising=False)
    monkeypatch.setattr(G, "HUB", 5)
    monkeypatch.setattr("locus_spark.plans.materialize.BROADCAST_BYTES", 100)
    written, write = [], G.materialize

    def counted(df, name):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "materialize", counted)
    stars = [(f"p{o}-{k}", f"o{o:05}") for o in range(1500) for k in range(4)]
    path = [(f"z{i:03}", f"z{i + 1:03}") for i in range(200)]
    hub = [("q", f"r{i}") for i in range(40)] + [("r3", "q")]
    found = {r[0]: r[1] for r in G.connected_components(spark.createDataFrame(stars + path + hub, "src string, dst string")).collect()}
    assert found == {n: b for a, b in stars for n in (a, b)} | {f"z{i:03}": "z000" for i in range(201)} | {"q": "q"} | {f"r{i}": "q" for i in range(40)}
    assert sum(written) < 5 * len(stars + path + hub)


def test_closure_of_a_cycle(spark):
    pairs = G.reachable(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string"))
    assert {(r[0], r[1]) for r in pairs.collect()} == {(x, y) for x in "abc" for y in "abcd"}


def test_paths(spark):
    edges = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.1), ("a", "t", 1.0), ("b", "t", 0.5), ("b", "u", 0.5)], "src string, dst string, p double")
    got = {">".join(r[0]): round(r[1], 6) for r in G.path_products(edges, spark.createDataFrame([("s",)], "node string"), 0.04).collect()}
    assert got == {"s>a>t": 0.9, "s>b>t": 0.05, "s>b>u": 0.05}
    assert K.best_paths({"s": [("a", 0.9), ("b", 0.1)], "a": [("t", 1.0)], "b": [("t", 0.5)]}, [("s", 10.0)], 0.5, 9) == [(["s", "a", "t"], 9.0), (["s", "b", "t"], 0.5)]


@pytest.mark.parametrize("method", ["holm", "hochberg", "hommel", "bonferroni", "BH", "BY", "none"])
def test_adjusted_p(spark, method):
    p = [0.01, 0.02, 0.03, 0.04, 0.05, 0.2, 0.2, 0.9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*p, None, math.nan])], "id int, p double")
    got = {r["id"]: r["padj"] for r in T.p_adjust(df, method=method, order=["id"]).collect()}
    assert got.pop(8) is None and got.pop(9) is None
    n, h = len(p), sum(1 / i for i in range(1, len(p) + 1))
    want = {
        "bonferroni": [min(1, n * x) for x in p], "none": p,
        "holm": [min(1, max((n - j) * p[j] for j in range(i + 1))) for i in range(n)],
        "hochberg": [min(1, min((n - j) * p[j] for j in range(i, n))) for i in range(n)],
        "BH": [min(1, min(n * p[j] / (j + 1) for j in range(i, n))) for i in range(n)],
        "BY": [min(1, min(h * n * p[j] / (j + 1) for j in range(i, n))) for i in range(n)],
        # by the definition: the smallest level at which the closed Simes test rejects
        "hommel": [max(min(m * s[j] / (j + 1) for j in range(m)) for m in range(1, n + 1) for s in [sorted([p[i], *(sorted(p[:i] + p[i + 1 :])[-(m - 1) :] if m > 1 else [])])]) for i in range(n)],
    }[method]
    assert [round(got[i], 9) for i in range(n)] == [round(x, 9) for x in want]


def test_tails(spark):
    df = spark.createDataFrame([(13, 149, 581, 12854), (0, 5, 3, 10), (4, 5, 3, 10), (3, 3, 3, 3)], "k long, n long, m long, t long")
    got = [r[0] for r in df.select(T.hypergeometric("k", "n", "m", "t")).collect()]
    exact = sum(math.comb(581, i) * math.comb(12854 - 581, 149 - i) for i in range(13, 150)) / math.comb(12854, 149)
    assert got[0] == pytest.approx(exact, rel=1e-8) and got[1:] == [1.0, 0.0, 1.0]
    p = spark.createDataFrame([(9.487729,)], "x double").select(F.exp(-F.col("x") / 4).alias("p"))
    two = p.unionAll(p).agg(T.fisher_combined(F.col("p"))).first()[0]
    assert two == pytest.approx(0.05, rel=1e-6)


def test_fisher_of_large_groups(spark):
    """Means beyond exp's range; against exact sums of Poisson terms."""
    for n, p in ((3, 0.2), (40, 0.9), (400, 0.01), (2000, 0.36), (2000, 0.38), (20000, 0.3665)):
        h = -math.log(p) * n
        terms = [-h + i * math.log(h) - math.lgamma(i + 1) for i in range(n)]
        top = max(terms)
        want = math.exp(top) * math.fsum(math.exp(t - top) for t in terms)
        got = spark.range(n).select(F.lit(p).alias("p")).agg(T.fisher_combined(F.col("p"))).first()[0]
        assert got == pytest.approx(want, rel=1e-7, abs=1e-300), (n, p)
    assert spark.range(50).select(F.lit(1.0).alias("p")).agg(T.fisher_combined(F.col("p"))).first()[0] == 1.0
    assert spark.range(5).select(F.lit(0.0).alias("p")).agg(T.fisher_combined(F.col("p"))).first()[0] == 0.0


def test_ids_and_pairs(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("a", 2), ("c", 1)], "chr string, st long")
    assert [(r["_id"], r["chr"], r["st"]) for r in J.row_ids(df, ["chr", "st"]).orderBy("_id").collect()] == [(0, "a", 2), (1, "a", 9), (2, "b", 5), (3, "c", 1)]
    left = spark.createDataFrame([("c", x) for x in (3, 10, 17, 40)], "chr string, pos long")
    right = spark.createDataFrame([("c", x) for x in (3, 4, 17, 18, 39, 90)], "chr string, pos long")
    got = sorted((r["pos"], r["before"]) for r in J.nearest_before(right, left, ["chr"], 22, tile=5).collect())
    assert got == [(4, 3), (17, 10), (18, 17), (39, 17)]


def test_kernels():
    rng = np.random.default_rng(1)
    a, x = rng.random((40, 12)), np.maximum(rng.standard_normal(12), 0)
    assert np.allclose(K.nnls(a, a @ x), x, atol=1e-6)
    for _ in range(20):  # the optimum's conditions, also where constraints bind
        a, b = rng.standard_normal((15, 6)), rng.standard_normal(15)
        z = K.nnls(a, b)
        g = a.T @ (a @ z - b)
        assert (z >= 0).all() and (g > -1e-7).all() and abs(g @ z) < 1e-7
    xs = np.linspace(0, 7, 50)
    slope, middle, far = K.fit_sigmoid(xs, 1 / (1 + np.exp(-2.5 * (xs - 3))))
    assert (slope, middle) == pytest.approx((2.5, 3), rel=1e-4) and far == pytest.approx(3 + math.log(99) / 2.5, rel=1e-4)
    dense = np.array([0.0] * 50 + [100.0] * 60 + [0.0] * 50)
    assert [(abs(p - q) <= 1, d > 0) for (p, d), q in zip(K.edges_of(dense, 10, 1.0), (50, 110))] == [(True, True), (True, False)]


def test_edges_of_long_regions(spark):
    rng = random.Random(6)
    dense = np.repeat([rng.choice([0, 1, 3, 7, 40, 900, 2**40]) for _ in range(4000)], [rng.randrange(1, 20) for _ in range(4000)]).astype(float)
    cuts = [0, *(np.flatnonzero(np.diff(dense)) + 1).tolist(), len(dense)]
    rows = [(r, 70, 70 + len(dense), 70 + a, 70 + b, float(dense[a])) for r in ("x", "y") for a, b in zip(cuts, cuts[1:]) if dense[a]]
    runs = spark.createDataFrame(rows, "region string, rst long, red long, st long, ed long, value double")
    whole = [(70 + k, d) for k, d in K.edges_of(dense, 10, 1.0)]
    got = K.slope_edges(runs, "region", window=10, step=1.0, longest=4000).collect()
    assert len(dense) > 30_000 and len(whole) > 100
    assert all(sorted((r["pos"], r["step"]) for r in got if r["region"] == g) == whole for g in ("x", "y"))


def test_edges_of_many_small_regions(spark):
    """Regions of one place and more, taken together, against each by itself; no Python group per region."""
    import random

    rng = random.Random(3)
    rows, want = [], []
    for n in range(300):
        size, st = rng.choice([1, 2, 5, 19, 20, 60, 300]), rng.randrange(1000)
        dense, at = np.zeros(size), 0
        while at < size:
            ed, value = min(size, at + rng.choice([1, 3, 20])), rng.choice([0, 1, 3, 15, 60])
            dense[at:ed] = value
            if value:
                rows.append((f"r{n}", st + at, st + ed, value, st, st + size))
            at = ed
        if dense.any():
            want += [(f"r{n}", st + k, d) for k, d in K.edges_of(dense, min(10, max(1, size // 2)), 1.0)]
    runs = spark.createDataFrame(rows, "region string, st long, ed long, value long, rst long, red long")
    out = K.slope_edges(runs, "region", window=10, step=1.0)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 300
