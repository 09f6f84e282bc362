"""Every registered query with SQL against DuckDB, on the smallest tables."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from locus_spark import catalog
from locus_spark.functions import kernels as K
from locus_spark.operators import coverage as C
from locus_spark.plans import assembly as A
from locus_spark.plans.views import view

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.8g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect()


def test_edges_of_all_islands(spark):
    out = catalog.QUERIES["edge_finder"](spark, SF).collect()
    track = defaultdict(list)
    for r in C.coverage(view(spark, SF, "iv_lineitem")).collect():
        track[r["chr"]].append((r["st"], r["ed"], r["value"]))
    expected, lengths = [], []
    for chr_, runs in track.items():
        islands = []
        for run in sorted(runs):
            if islands and run[0] - islands[-1][-1][1] <= 30:
                islands[-1].append(run)
            else:
                islands.append([run])
        for island in islands:
            start, end = island[0][0], island[-1][1]
            dense = np.zeros(end - start)
            for st, ed, value in island:
                dense[st - start : ed - start] = value
            lengths.append(len(dense))
            expected += [(f"{chr_}:{start}", start + k, d) for k, d in K.edges_of(dense, min(10, max(1, len(dense) // 2)), 1.0)]
    assert min(lengths) < 60 and sorted(map(tuple, out)) == sorted(expected)


def test_all_paths(spark):
    out = catalog.QUERIES["path_generator"](spark, SF).collect()
    one, two = defaultdict(float), defaultdict(float)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity").collect():
        g, a, b, c = r[0] % 20, f"a{r[1] % 3}", f"b{r[2]}", f"c{r[1] % 5}"
        one[g, a, b] += float(r[3])
        two[g, b, c] += float(r[3])
    from_b = defaultdict(float)
    for (g, b, _), q in two.items():
        from_b[g, b] += q
    expected = {(g, f"{a}>{b}>{c}"): q * p / from_b[g, b] for (g, a, b), q in one.items() for (h, d, c), p in two.items() if (g, b) == (h, d)}
    expected = {k: v for k, v in expected.items() if v >= 1}
    assert max(Counter(g for g, _ in expected).values()) > 50 and len(out) == len(expected)
    assert all(abs(r["abundance"] - expected[r["gene"], r["path"]]) < 1e-6 for r in out)


def test_assembles_all_rows(spark, monkeypatch):
    class Seen(Exception):
        pass

    def assemble(sj, track, **options):
        raise Seen(sj, options)

    monkeypatch.setattr(A, "assemble", assemble)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES["assemble_exons"](spark, SF)
    sj, options = seen.value.args
    assert sj.agg(F.sum("ucnt")).first()[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count() and not options


@pytest.mark.parametrize("name", ["gene_cov", "nnls_exon_cov", "overlay_max", "single_exons_by_max"])
def test_shared_tables_are_written_once(spark, name):
    """What a query uses several times comes from files, not from the tables again."""
    assert "lineitem.parquet" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
