"""Interval, junction, graph and expression views of the star-schema tables, for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that a view reads, and its select list for Spark.
_SPARK = {
    "iv_lineitem": (
        "lineitem",
        "concat('s', l_suppkey) AS chr, cast(datediff(l_shipdate, DATE'1995-01-01') * 10 AS BIGINT) AS st,"
        " cast(datediff(l_shipdate, DATE'1995-01-01') * 10 AS BIGINT) + cast(l_quantity AS BIGINT) AS ed,"
        " CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS strand, l_discount AS w, l_partkey AS gid",
    ),
    "iv_orders": (
        "orders",
        "concat('s', o_custkey % {suppliers} + 1) AS chr, cast(datediff(o_orderdate, DATE'1995-01-01') * 10 AS BIGINT) AS st,"
        " cast(datediff(o_orderdate, DATE'1995-01-01') * 10 AS BIGINT) + 30 + o_orderkey % 50 AS ed, o_orderkey AS id, o_orderstatus AS kind",
    ),
    "iv_events": (
        "events",
        "concat('u', user_id) AS chr, cast(floor(timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)) AS BIGINT) AS st,"
        " cast(floor(timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)) AS BIGINT) + 1 + cast(floor(value) AS BIGINT) AS ed,"
        " CASE event_type WHEN 'view' THEN '+' WHEN 'click' THEN '-' ELSE '.' END AS strand, value AS val, event_type AS kind",
    ),
}
_DUCK = {
    "iv_lineitem": (
        "SELECT concat('s', l_suppkey) AS chr, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 10 AS st,"
        " date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 10 + l_quantity::BIGINT AS ed,"
        " CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE '.' END AS strand, l_discount AS w, l_partkey AS gid FROM lineitem"
    ),
    "iv_orders": (
        "SELECT concat('s', o_custkey % (SELECT count(*) FROM supplier) + 1) AS chr, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 10 AS st,"
        " date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 10 + 30 + o_orderkey % 50 AS ed, o_orderkey AS id, o_orderstatus AS kind FROM orders"
    ),
    "iv_events": (
        "SELECT concat('u', user_id) AS chr, floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT AS st,"
        " floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT + 1 + floor(value)::BIGINT AS ed,"
        " CASE event_type WHEN 'view' THEN '+' WHEN 'click' THEN '-' ELSE '.' END AS strand, value AS val, event_type AS kind FROM events"
    ),
    "sj_pairs": (
        "SELECT l_partkey AS d, l_suppkey AS a, count(*) FILTER (WHERE l_returnflag = 'A') AS ucnt,"
        " count(*) FILTER (WHERE l_returnflag <> 'A') AS mcnt FROM lineitem GROUP BY 1, 2"
    ),
    "edges": "SELECT DISTINCT concat('p', l_partkey, '@', l_shipdate::DATE) AS src, concat('o', l_orderkey) AS dst FROM lineitem",
    "dag": (
        "SELECT concat('c', c_custkey) AS child, concat('n', c_nationkey) AS parent FROM customer UNION ALL"
        " SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier UNION ALL"
        " SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation"
    ),
    "expr": (
        "SELECT l_partkey AS gene, concat(l_returnflag, l_linestatus, l_linenumber % 2) AS sample, concat(l_returnflag, l_linestatus) AS grp,"
        " sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3"
    ),
    "pv": (
        "SELECT p_partkey AS id, p_brand AS cond, p_type AS symbol, ((p_partkey * 7919) % 10007 + 1) / 10008.0 AS p,"
        " ((p_partkey * 104729) % 2003 - 1001) / 500.0 AS lfc FROM part"
    ),
    "term": "SELECT c_custkey AS id, c_mktsegment AS term FROM customer",
    "selected": "SELECT o_custkey AS id FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    if name in _SPARK:
        base, columns = _SPARK[name]
        if "{suppliers}" in columns:
            columns = columns.format(suppliers=table(spark, sf_dir, "supplier").count())
        return table(spark, sf_dir, base).selectExpr(*_split(columns))
    line = lambda: table(spark, sf_dir, "lineitem")
    if name == "sj_pairs":
        return line().groupBy(F.col("l_partkey").alias("d"), F.col("l_suppkey").alias("a")).agg(
            F.count_if(F.col("l_returnflag") == "A").alias("ucnt"), F.count_if(F.col("l_returnflag") != "A").alias("mcnt"))
    if name in ("edges", "edge_rows"):
        rows = line().selectExpr("concat('p', l_partkey, '@', cast(l_shipdate AS DATE)) AS src", "concat('o', l_orderkey) AS dst")
        return rows.distinct() if name == "edges" else rows  # graph closure takes repeated edges
    if name == "dag":
        c = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS child", "concat('n', c_nationkey) AS parent")
        s = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS child", "concat('n', s_nationkey) AS parent")
        n = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS child", "concat('r', n_regionkey) AS parent")
        return c.unionAll(s).unionAll(n)
    if name == "expr":
        return line().groupBy(F.col("l_partkey").alias("gene"), F.expr("concat(l_returnflag, l_linestatus, l_linenumber % 2)").alias("sample"),
                              F.expr("concat(l_returnflag, l_linestatus)").alias("grp")).agg(F.sum("l_quantity").alias("value"))
    if name == "pv":
        return table(spark, sf_dir, "part").selectExpr(
            "p_partkey AS id", "p_brand AS cond", "p_type AS symbol", "((p_partkey * 7919) % 10007 + 1) / 10008D AS p", "((p_partkey * 104729) % 2003 - 1001) / 500D AS lfc")
    if name == "term":
        return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS term")
    if name == "selected":
        return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("t")).filter("t > 2000000").select("id")
    raise KeyError(name)


def _split(columns: str) -> list[str]:
    """Split a select list at commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def duck(*names: str) -> str:
    """The views as common table expressions, without WITH."""
    return ",\n".join(f"{n} AS ({_DUCK[n]})" for n in names)
