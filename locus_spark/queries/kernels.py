"""Queries of numeric kernels, pipelines and windows over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus_spark.functions import kernels as K
from locus_spark.operators import coverage as C
from locus_spark.operators import intervals as I
from locus_spark.operators import junctions as J
from locus_spark.plans import assembly as A
from locus_spark.plans.materialize import once
from locus_spark.plans.views import table, view
from locus_spark.queries import Registry
from locus_spark.streaming import windows as S

R = Registry()


def _parts(spark, sf):
    iv = view(spark, sf, "iv_lineitem").withColumn("gid", F.col("gid") % 50)
    atoms = once(I.atomic(iv, "gid"), "atoms")
    values = C.mean_over(atoms, C.coverage(view(spark, sf, "iv_orders")))
    # Elements never reach beyond an island, so islands can be dealt into blocks by their start.
    islands = I.merge(iv).select("chr", "st", "ed")
    block = F.concat("chr", F.lit(":"), F.expr("b_st div 2500").cast("string"))
    named = I.overlap_pairs(atoms, islands).withColumn("block", block)
    ids = F.transform("ids", lambda i: F.concat("block", F.lit("/"), i.cast("string"))).alias("ids")
    return named.join(values, ["chr", "st", "ed"]).select("block", ids, "cov", (F.col("ed") - F.col("st")).alias("len"))


@R.add()
def nnls_exon_cov(spark, sf):
    return K.deconvolve(_parts(spark, sf))


@R.add()
def sigmoid_fit(spark, sf):
    points = view(spark, sf, "pv").withColumn("bin", F.round(F.col("lfc") * 4) / 4).groupBy("cond", "bin").agg(F.avg((F.col("p") + F.col("lfc") > 0.5).cast("double")).alias("y"))
    return K.sigmoid_by_group(points, "cond", "bin", "y")


@R.add()
def edge_finder(spark, sf):
    track = once(C.coverage(view(spark, sf, "iv_lineitem")), "track")
    islands = I.merge(track, gap=30).withColumn("region", F.concat("chr", F.lit(":"), F.col("st").cast("string")))
    cut = I.overlap_pairs(islands.select("chr", "st", "ed", "region"), track).select("region", F.col("st").alias("rst"), F.col("ed").alias("red"), F.col("b_st").alias("st"), F.col("b_ed").alias("ed"), F.col("b_value").alias("value"))
    return K.slope_edges(cut, "region", window=10, step=1.0)


@R.add()
def path_generator(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("gene", F.col("l_suppkey") % 20)
    one = line.groupBy("gene", F.expr("concat('a', l_partkey % 3)").alias("src"), F.expr("concat('b', l_linenumber)").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    two = line.groupBy("gene", F.expr("concat('b', l_linenumber)").alias("src"), F.expr("concat('c', l_partkey % 5)").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    edges = J.shares(one.unionByName(two), "q", ["gene", "src"])
    starts = one.groupBy("gene", F.col("src").alias("node")).agg(F.sum("q").alias("abundance"))
    return K.generate_paths(edges, starts, "gene", least=1.0)


@R.add()
def logistic_fit(spark, sf):
    rows = view(spark, sf, "pv").withColumn("y", (F.col("p") * 2 + F.col("lfc") > 1).cast("int"))
    intercept, weights = K.fit_logistic(rows, "y", ["p", "lfc"])
    return spark.createDataFrame([("intercept", intercept), *weights.items()], "name string, weight double")


@R.add()
def assemble_exons(spark, sf):
    iv = view(spark, sf, "iv_lineitem").withColumn("strand", F.expr("CASE WHEN strand = '-' THEN '-' ELSE '+' END"))
    sj = iv.groupBy("chr", (F.col("st") + 1).alias("st"), "ed", "strand").agg(F.count("*").alias("ucnt"), F.count_if(F.col("w") > 0.05).alias("mcnt"))
    made = A.assemble(sj, C.coverage(view(spark, sf, "iv_orders")))
    return made["ex"].select("chr", "strand", "st", "ed", "kind", "cat", "_gidx", "gname", F.round("cov", 6).alias("cov"))


@R.add("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, value FROM events)
SELECT event_type, start, start + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM w GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.bins(events, "event_type").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.add("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def user_sessions(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.sessions(events, "user_id").withColumn("total", F.round("total", 4))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.add("""WITH w AS (SELECT event_type, unnest(range(0, 4)) AS k, time_bucket(INTERVAL 15 MINUTE, ts) AS b, value FROM events)
SELECT event_type, b - k * INTERVAL 15 MINUTE AS start, b - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean,
min(value) AS least, max(value) AS most FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.bins(events, "event_type", slide="15 minutes").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
