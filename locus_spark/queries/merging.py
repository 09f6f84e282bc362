"""Queries of merging: strands, junction counts, single exons, bundles and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus_spark.operators import coverage as C
from locus_spark.operators import merging as M
from locus_spark.plans import assembly as A
from locus_spark.plans.materialize import dealt
from locus_spark.plans.views import duck, table, view
from locus_spark.queries import Registry
from locus_spark.queries.intervals import islands_sql, sweep_sql

R = Registry()
L, O = duck("iv_lineitem"), duck("iv_orders")


@R.add(f"WITH {L}, s AS (SELECT chr, st, ed, strand, unnest(CASE WHEN strand = '.' THEN ['+', '-'] ELSE [strand] END) AS side FROM iv_lineitem) SELECT *, count(*) AS n FROM s GROUP BY ALL")
def strand_split(spark, sf):
    return M.split_strands(view(spark, sf, "iv_lineitem")).groupBy("chr", "st", "ed", "strand", "side").agg(F.count("*").alias("n"))


_PATHS = f"""{L}, p AS (SELECT DISTINCT chr, st AS tst, ed AS ted, CASE strand WHEN '-' THEN '-' WHEN '+' THEN '+' ELSE '.' END AS strand, concat(st, '|', st + 3, ',', ed - 3, '|', ed) AS name FROM iv_lineitem),
te AS (SELECT chr, ted, min(strand) AS s FROM p WHERE strand <> '.' GROUP BY 1, 2), ts AS (SELECT chr, tst, min(strand) AS s FROM p WHERE strand <> '.' GROUP BY 1, 2),
u AS (SELECT p.chr, p.tst, p.ted, unnest(CASE WHEN te.s IS NOT NULL THEN [te.s] WHEN ts.s IS NOT NULL THEN [ts.s] ELSE ['.+', '.-'] END) AS strand FROM p LEFT JOIN te USING (chr, ted) LEFT JOIN ts USING (chr, tst) WHERE p.strand = '.')"""


def _paths(spark, sf):
    name = F.expr("concat(st, '|', st + 3, ',', ed - 3, '|', ed)")
    return view(spark, sf, "iv_lineitem").select("chr", F.col("st").alias("tst"), F.col("ed").alias("ted"), "strand", name.alias("name")).distinct()


@R.add(f"""WITH {_PATHS} SELECT * FROM p WHERE strand <> '.' UNION ALL
SELECT *, CASE WHEN strand LIKE '%-' THEN concat(ted, '|', ted - 3, ',', tst + 3, '|', tst) ELSE concat(tst, '|', tst + 3, ',', ted - 3, '|', ted) END AS name FROM u""")
def adopted_strands(spark, sf):
    return M.adopt_strands(_paths(spark, sf))


@R.add(f"""WITH {_PATHS}, c AS (SELECT chr, st, ed, count(*) AS n FROM iv_lineitem GROUP BY 1, 2, 3), j AS (SELECT chr, st, st + 3 AS ed, n FROM c UNION ALL SELECT chr, least(ed - 3, ed), ed, n FROM c)
SELECT chr, st, ed, max(n) AS n FROM j GROUP BY 1, 2, 3""")
def junction_totals(spark, sf):
    iv = view(spark, sf, "iv_lineitem").select("chr", "st", "ed")
    rows = iv.count()
    counted = dealt(iv, ["chr", "st", "ed"], rows).groupBy("chr", "st", "ed").agg(F.count("*").alias("n"))
    # A name holds two junctions.
    return M.junction_totals(counted.select("chr", "n", F.expr("concat(st, '|', st + 3, ',', ed, '|', ed - 3)").alias("name")), "n", rows=2 * rows)


@R.add(f"""WITH {L}, {O}, pos AS (SELECT DISTINCT chr, st AS pos, strand, CASE WHEN w < 0.05 THEN '5' ELSE '3' END AS kind FROM iv_lineitem WHERE strand <> '.'),
sj AS (SELECT chr, st, ed - ed % 10 AS ed, CASE kind WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand FROM iv_orders),
e AS (SELECT chr, '+' AS strand, '5' AS kind, st AS pos FROM sj WHERE strand <> '-' UNION SELECT chr, '+', '3', ed FROM sj WHERE strand <> '-' UNION SELECT chr, '-', '5', ed FROM sj WHERE strand <> '+' UNION SELECT chr, '-', '3', st FROM sj WHERE strand <> '+')
SELECT pos.* FROM pos SEMI JOIN e USING (chr, pos, strand, kind)""")
def junction_ends(spark, sf):
    pos = view(spark, sf, "iv_lineitem").filter("strand <> '.'").select("chr", F.col("st").alias("pos"), "strand", F.expr("CASE WHEN w < 0.05 THEN '5' ELSE '3' END").alias("kind")).distinct()
    sj = view(spark, sf, "iv_orders").selectExpr("chr", "st", "ed - ed % 10 AS ed", "CASE kind WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand")
    return M.at_junction_ends(pos, sj)


_UM = "sj AS (SELECT chr, st, ed, count(*) FILTER (WHERE strand <> '.') AS ucnt, count(*) AS mcnt FROM iv_lineitem GROUP BY 1, 2, 3)"


def _um(spark, sf):
    return view(spark, sf, "iv_lineitem").groupBy("chr", "st", "ed").agg(F.count_if(F.col("strand") != ".").alias("ucnt"), F.count("*").alias("mcnt"))


@R.add(f"""WITH {L}, {_UM}, c AS (SELECT chr, count(*) AS n, count(*) FILTER (WHERE ucnt = 0) AS m FROM sj GROUP BY 1)
SELECT sj.* FROM sj JOIN c USING (chr) WHERE ucnt > 0 OR NOT (n > 100 AND m < n * 0.5)""")
def ambiguous_junctions(spark, sf):
    return M.drop_ambiguous_junctions(_um(spark, sf), ["chr"], 100, 0.5)


@R.add(f"""WITH {L}, {O}, c AS (SELECT chr, st, ed, strand, count(*) FILTER (WHERE w > 0.05) AS ucnt, count(*) AS mcnt FROM iv_lineitem GROUP BY 1, 2, 3, 4),
sj AS (SELECT DISTINCT chr, st, ed - ed % 5 AS ed, CASE kind WHEN 'F' THEN '+' ELSE '-' END AS strand FROM iv_orders)
SELECT sj.*, coalesce(ucnt, 0) AS ucnt, coalesce(mcnt, 0) AS mcnt, CASE WHEN coalesce(ucnt, 0) <> 0 THEN ucnt ELSE coalesce(mcnt, 0) END AS jcnt FROM sj LEFT JOIN c USING (chr, st, ed, strand)""")
def counts_onto(spark, sf):
    counted = view(spark, sf, "iv_lineitem").groupBy("chr", "st", "ed", "strand").agg(F.count_if(F.col("w") > 0.05).alias("ucnt"), F.count("*").alias("mcnt"))
    sj = view(spark, sf, "iv_orders").selectExpr("chr", "st", "ed - ed % 5 AS ed", "CASE kind WHEN 'F' THEN '+' ELSE '-' END AS strand").distinct()
    return M.counts_onto(sj, counted)


@R.add(f"""WITH {L}, b AS (SELECT DISTINCT chr, st, ed, gid AS gidx, false AS m FROM iv_lineitem WHERE strand = '+' UNION ALL SELECT DISTINCT chr, st, ed, -gid, true FROM iv_lineitem WHERE strand = '-')
SELECT chr, st, ed, gidx, row_number() OVER (ORDER BY chr, st, ed, gidx) - 1 AS _id FROM b""")
def combined_strands(spark, sf):
    iv = view(spark, sf, "iv_lineitem").withColumnRenamed("gid", "gidx")
    plus, minus = (iv.filter(F.col("strand") == s).select("chr", "st", "ed", "gidx").distinct() for s in "+-")
    return M.combine_strands(plus, minus, ["chr", "st", "ed", "gidx"])


@R.add(f"""WITH {L}, {islands_sql('iv_lineitem')}, s AS (SELECT chr, max(ed) + 50 AS size FROM iv_lineitem GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY st) - 1 AS r, count(*) OVER (PARTITION BY chr) AS total FROM isl), b AS (SELECT chr, r AS f, least(r + 20, total - 1) AS l FROM n WHERE r % 20 = 0)
SELECT b.chr, greatest(x.st - 100, 0) AS st, least(y.ed + 100, size) AS ed FROM b JOIN n x ON x.chr = b.chr AND x.r = f JOIN n y ON y.chr = b.chr AND y.r = l JOIN s ON s.chr = b.chr""")
def padded_bundles(spark, sf):
    iv = view(spark, sf, "iv_lineitem")
    return M.padded_bundles(iv, iv.groupBy("chr").agg((F.max("ed") + 50).alias("size")), each=20)


_FREE = f"""{L}, {O}, {sweep_sql('iv_lineitem')}, v AS (SELECT * FROM swp WHERE value > {{least}}),
h AS (SELECT *, CASE WHEN st > max(ed) OVER (PARTITION BY chr ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR lag(st) OVER (PARTITION BY chr ORDER BY st) IS NULL THEN 1 ELSE 0 END AS new FROM v),
k AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY st) AS k FROM h), i AS (SELECT chr, min(st) AS st, max(ed) AS ed, max(value) AS max, sum(value * (ed - st)) / (max(ed) - min(st)) AS cov FROM k GROUP BY chr, k),
f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM iv_orders o WHERE o.chr = i.chr AND o.st < i.ed AND i.st < o.ed))"""


@R.add(f"WITH {_FREE.format(least='0')} SELECT chr, st, ed, max, cov FROM f WHERE max > 1")
def single_exons_by_max(spark, sf):
    return M.single_exons_by_max(C.coverage(view(spark, sf, "iv_lineitem")), view(spark, sf, "iv_orders"), 1)


@R.add(f"""WITH {_FREE.format(least="(SELECT avg(a) / 0.6 FROM (SELECT sum(value * (ed - st)) / sum(ed - st) AS a FROM swp WHERE value > 0 GROUP BY chr))")}
SELECT chr, st, ed, ed - st AS len FROM f WHERE ed - st > 5 AND ed - st < 60""")
def single_exons_by_share(spark, sf):
    return M.single_exons_by_share(C.coverage(view(spark, sf, "iv_lineitem")), view(spark, sf, "iv_orders"), 0.6, 5, 60)


_GRP = f"""{L}, g AS (SELECT chr, st AS tst, st + 10 * (gid % 2) AS ted, strand, arg_min(struct_pack(gid := gid, v := ed - st), (lpad(gid::VARCHAR, 9, '0'), ed)) AS x FROM iv_lineitem GROUP BY 1, 2, 3, 4)"""


def _groups(spark, sf):
    iv = view(spark, sf, "iv_lineitem").selectExpr("chr", "st AS tst", "st + 10 * (gid % 2) AS ted", "strand", "concat(lpad(cast(gid AS STRING), 9, '0'), ':', lpad(cast(ed + 1000000 AS STRING), 12, '0')) AS name", "gid", "ed - st AS v")
    return M.group_rollup(iv, "v")


@R.add(f"WITH {_GRP} SELECT chr, tst, ted, strand, x.v AS v FROM g")
def group_values(spark, sf):
    return _groups(spark, sf)[0]


@R.add(f"WITH {_GRP} SELECT x.gid AS gid, sum(x.v)::BIGINT AS v FROM g GROUP BY 1")
def gene_rollup(spark, sf):
    return _groups(spark, sf)[1]


@R.add(f"""WITH {L}, e AS (SELECT DISTINCT gid, concat(chr, ':', st) AS eid FROM iv_lineitem), a AS (SELECT concat(chr, ':', st) AS eid, sum(ed - st)::BIGINT AS ecov FROM iv_lineitem GROUP BY 1),
b AS (SELECT gid, count(*) AS gcov FROM iv_lineitem WHERE strand = '+' GROUP BY 1) SELECT gid, eid, ecov, gcov FROM e LEFT JOIN a USING (eid) LEFT JOIN b USING (gid)""")
def merged_coverage(spark, sf):
    iv = view(spark, sf, "iv_lineitem").withColumn("eid", F.concat("chr", F.lit(":"), F.col("st").cast("string")))
    ecov = iv.groupBy("eid").agg(F.sum(F.col("ed") - F.col("st")).alias("ecov"))
    return M.with_coverages(iv.select("gid", "eid").distinct(), ecov, iv.filter("strand = '+'").groupBy("gid").agg(F.count("*").alias("gcov"))).select("gid", "eid", "ecov", "gcov")


@R.add("""WITH e AS (SELECT l_suppkey AS grp, l_linenumber AS place, avg(l_quantity::DOUBLE) AS cov FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, greatest(cov - coalesce(lag(cov) OVER (PARTITION BY grp ORDER BY place), 0), 0) AS own FROM e),
t AS (SELECT *, sum(own) OVER (PARTITION BY grp) AS total, count(*) OVER (PARTITION BY grp) AS n FROM d)
SELECT grp, place, round(CASE WHEN n = 1 THEN 1 ELSE own / CASE WHEN total = 0 THEN 1 ELSE total END END, 9) AS share FROM t""")
def utr_shares(spark, sf):
    ends = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("place")).agg(F.avg(F.col("l_quantity").cast("double")).alias("cov"))
    return M.utr_shares(ends, ["grp"]).select("grp", "place", F.round("share", 9).alias("share"))


@R.add("SELECT (SELECT count(*) FROM lineitem) AS num_exons, (SELECT count(*) FROM orders) AS num_junctions, (SELECT count(*) FROM part) AS num_paths")
def assembly_stats(spark, sf):
    return M.assembly_stats(exons=table(spark, sf, "lineitem"), junctions=table(spark, sf, "orders"), paths=table(spark, sf, "part"))


@R.add("""SELECT l_partkey AS id, n, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_name) AS symbol
FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN part ON p_partkey = l_partkey""")
def gene_names(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    genes = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS symbol", "p_name AS gname")
    return M.with_gene_names(df, genes, "id").drop("gname")


@R.add(f"WITH {L}, s AS (SELECT chr, st, ed, unnest(CASE WHEN strand = '.' THEN ['+', '-'] ELSE [strand] END) AS side FROM iv_lineitem), {sweep_sql('s', keys='chr, side')} SELECT chr, side, st, ed, value FROM swp")
def strand_tracks(spark, sf):
    return C.coverage(M.split_strands(view(spark, sf, "iv_lineitem")), ["chr", "side"])


@R.add(f"""WITH {L}, {O}, {sweep_sql('iv_lineitem')}, x AS (SELECT DISTINCT chr, st, ed FROM iv_orders),
f AS (SELECT chr, x.st, x.ed, least((SELECT value FROM swp t WHERE t.chr = x.chr AND t.st <= x.st - 1 AND x.st - 1 < t.ed), (SELECT value FROM swp t WHERE t.chr = x.chr AND t.st <= x.ed AND x.ed < t.ed)) AS value,
 (SELECT count(*) FROM swp t WHERE t.chr = x.chr AND ((t.st <= x.st - 1 AND x.st - 1 < t.ed) OR (t.st <= x.ed AND x.ed < t.ed))) AS n,
 EXISTS (SELECT 1 FROM swp t WHERE t.chr = x.chr AND t.st <= x.st - 1 AND x.st - 1 < t.ed) AND EXISTS (SELECT 1 FROM swp t WHERE t.chr = x.chr AND t.st <= x.ed AND x.ed < t.ed) AS both_in FROM x),
r AS (SELECT chr, st, ed, value FROM swp UNION ALL SELECT chr, st, ed, value FROM f WHERE both_in),
c AS (SELECT chr, st AS pos FROM r UNION SELECT chr, ed FROM r), p AS (SELECT chr, pos AS st, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS ed FROM c),
m AS (SELECT p.chr, p.st, p.ed, max(r.value) AS value FROM p JOIN r ON r.chr = p.chr AND r.st < p.ed AND p.st < r.ed GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN lag(ed) OVER w = st AND lag(value) OVER w = value THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY chr ORDER BY st)),
k AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY st) AS k FROM g) SELECT chr, min(st) AS st, max(ed) AS ed, any_value(value) AS value FROM k GROUP BY chr, k""")
def filled_gaps(spark, sf):
    return C.fill_exon_gaps(C.coverage(view(spark, sf, "iv_lineitem")), view(spark, sf, "iv_orders"))


_SNAP = f"""{L}, {O}, ex AS (SELECT DISTINCT chr, strand, st + gid % 4 AS st, ed + 12 + gid % 3 AS ed FROM iv_lineitem WHERE strand <> '.'),
sj AS (SELECT chr, st + 1 AS st, ed, CASE kind WHEN 'F' THEN '+' ELSE '-' END AS strand FROM iv_orders)"""


@R.add(f"""WITH {_SNAP}, a AS (SELECT ex.*, (SELECT arg_min(j.ed, (abs(j.ed - ex.st), j.ed)) FROM sj j WHERE j.chr = ex.chr AND j.strand = ex.strand AND abs(j.ed - ex.st) <= 10) AS s,
 (SELECT arg_min(j.st - 1, (abs(j.st - 1 - ex.ed), j.st)) FROM sj j WHERE j.chr = ex.chr AND j.strand = ex.strand AND abs(j.st - 1 - ex.ed) <= 10) AS e FROM ex)
SELECT chr, strand, coalesce(s, st) AS st, coalesce(e, ed) AS ed FROM a WHERE coalesce(s, st) < coalesce(e, ed)""")
def snapped_exons(spark, sf):
    ex = view(spark, sf, "iv_lineitem").filter("strand <> '.'").selectExpr("chr", "strand", "st + gid % 4 AS st", "ed + 12 + gid % 3 AS ed").distinct()
    sj = view(spark, sf, "iv_orders").selectExpr("chr", "st + 1 AS st", "ed", "CASE kind WHEN 'F' THEN '+' ELSE '-' END AS strand")
    return A.snap_exons(ex, sj)


_EST = ", ".join(f"e{n} AS (SELECT l_partkey % 500 AS gene, l_suppkey AS grp, sum(l_quantity)::DOUBLE AS value FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2)" for n, f in enumerate("ANR"))


@R.add(f"""WITH {_EST} SELECT gene, grp, list_sort([coalesce(e0.value, 0), coalesce(e1.value, 0), coalesce(e2.value, 0)])[2] AS value
FROM e0 FULL JOIN e1 USING (gene, grp) FULL JOIN e2 USING (gene, grp)""")
def group_abundance(spark, sf):
    line = table(spark, sf, "lineitem")
    parts = [line.filter(F.col("l_returnflag") == f).groupBy((F.col("l_partkey") % 500).alias("gene"), F.col("l_suppkey").alias("grp")).agg(F.sum("l_quantity").cast("double").alias("value")) for f in "ANR"]
    return A.group_abundance(parts, ["gene", "grp"])
