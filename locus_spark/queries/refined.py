"""Queries of clean-up filters, reads and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus_spark.functions import thresholds as H
from locus_spark.operators import coverage as C
from locus_spark.operators import graph as G

from locus_spark.operators import reads as D
from locus_spark.operators import refine as X
from locus_spark.plans.views import duck, table, view
from locus_spark.queries import Registry
from locus_spark.queries.intervals import islands_sql, sweep_sql

R = Registry()
L, O, P = duck("iv_lineitem"), duck("iv_orders"), duck("pv")
_A = "a AS (SELECT DISTINCT chr, st, ed FROM iv_lineitem), b AS (SELECT DISTINCT chr, st, ed FROM iv_orders)"
_OVL = "a.chr = b.chr AND a.st < b.ed AND b.st < a.ed"


def _ab(spark, sf):
    return view(spark, sf, "iv_lineitem").select("chr", "st", "ed").distinct(), view(spark, sf, "iv_orders").select("chr", "st", "ed").distinct()


@R.add(f"""WITH {L}, {O}, sj AS (SELECT chr, st, ed, count(*) AS jcnt FROM iv_lineitem GROUP BY 1, 2, 3), {sweep_sql('iv_orders')}, {islands_sql('iv_orders')},
m AS (SELECT i.chr, i.st, i.ed, sum(s.value * (s.ed - s.st)) / (i.ed - i.st) AS cov FROM isl i JOIN swp s ON s.chr = i.chr AND s.st >= i.st AND s.ed <= i.ed GROUP BY 1, 2, 3)
SELECT * FROM sj WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chr = sj.chr AND m.st <= sj.st AND m.ed >= sj.ed AND sj.jcnt < 0.7 * m.cov)""")
def jie_adaptive(spark, sf):
    sj = view(spark, sf, "iv_lineitem").groupBy("chr", "st", "ed").agg(F.count("*").alias("jcnt"))
    return X.drop_inside_covered(sj, C.coverage(view(spark, sf, "iv_orders")), 0.7)


@R.add(f"WITH {L}, {O}, {_A} SELECT a.* FROM a WHERE (SELECT count(*) FROM b WHERE {_OVL}) <> 1")
def single_exon_overlaps(spark, sf):
    return X.drop_overlapping_single(*_ab(spark, sf))


@R.add(f"""WITH {L}, {islands_sql('iv_lineitem', keys='gid, chr')}, g AS (SELECT gid, log10(sum(ed - st)) AS ltlen, max(ed) - min(st) AS glen FROM isl GROUP BY gid)
SELECT gid, glen FROM g WHERE ltlen >= 0.5 + 0.55 * log10(glen) AND ltlen >= 2.5""")
def gene_length_filter(spark, sf):
    return X.long_enough(C.gene_length(view(spark, sf, "iv_lineitem")), 0.5, 0.55, 2.5).select("gid", "glen")


@R.add("""WITH m AS (SELECT l_orderkey AS path, l_partkey AS exon FROM lineitem), keep AS (SELECT p_partkey AS exon FROM part WHERE p_size > 10)
SELECT DISTINCT path FROM m WHERE path NOT IN (SELECT path FROM m WHERE exon NOT IN (SELECT exon FROM keep))""")
def surviving_paths(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("exon"))
    return X.surviving_paths(members, table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("exon")))


@R.add("""WITH e AS (SELECT l_partkey % 300 AS gname, l_suppkey AS component, l_orderkey FROM lineitem), s AS (SELECT gname, component, count(*) AS n FROM e GROUP BY 1, 2),
k AS (SELECT gname FROM s GROUP BY gname HAVING count(*) > 1) SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM e WHERE NOT EXISTS (SELECT 1 FROM s JOIN k USING (gname) WHERE s.n = 1 AND s.gname = e.gname AND s.component = e.component)""")
def lone_components(spark, sf):
    e = table(spark, sf, "lineitem").select((F.col("l_partkey") % 300).alias("gname"), F.col("l_suppkey").alias("component"), "l_orderkey")
    return X.drop_lone_components(e).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


@R.add("""WITH m AS (SELECT l_orderkey AS path, l_partkey AS sj FROM lineitem), s AS (SELECT l_partkey AS sj, count(*) AS n, max(l_tax) AS oh FROM lineitem GROUP BY 1)
SELECT path, min(n) AS n, min(oh) AS oh FROM m JOIN s USING (sj) GROUP BY path HAVING min(n) >= 28 AND min(oh) >= 0.08""")
def path_min_filter(spark, sf):
    line = table(spark, sf, "lineitem")
    members = line.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("sj"))
    stats = line.groupBy(F.col("l_partkey").alias("sj")).agg(F.count("*").alias("n"), F.max("l_tax").alias("oh"))
    return X.path_counts(members.select("path").distinct(), members, stats, {"n": 28, "oh": 0.08})


@R.add(f"""WITH {L}, {O}, {_A} SELECT a.chr, a.st, b.ed FROM a JOIN b ON a.chr = b.chr AND a.ed = b.st UNION SELECT a.chr, b.st, a.ed FROM a JOIN b ON a.chr = b.chr AND a.st = b.ed""")
def attach_single(spark, sf):
    return X.attach_single(*_ab(spark, sf))


@R.add(f"""WITH {L}, e AS (SELECT chr, st, ed, (ed - st)::DOUBLE AS cov FROM iv_lineitem GROUP BY 1, 2, 3), j AS (SELECT DISTINCT x.chr, x.ed + 1 AS st, y.st AS ed, 20.0::DOUBLE AS cov FROM e x JOIN e y ON x.chr = y.chr AND y.st > x.ed AND y.st - x.ed < 12)
SELECT j.chr, l.st, r.ed, max(j.cov) AS cov FROM j JOIN e l ON l.chr = j.chr AND l.ed + 1 = j.st JOIN e r ON r.chr = j.chr AND r.st = j.ed WHERE 2 * j.cov > (l.cov + r.cov) * 0.9 GROUP BY 1, 2, 3""")
def intron_retention(spark, sf):
    e = view(spark, sf, "iv_lineitem").select("chr", "st", "ed", (F.col("ed") - F.col("st")).cast("double").alias("cov")).distinct()
    # Gaps of under 12 bases: ends and starts that share a bin of that width or lie in the next.
    left = e.select("chr", F.col("ed").alias("s")).distinct().withColumn("bin", F.explode(F.expr("array(s div 12, s div 12 + 1)")))
    right = e.select("chr", F.col("st").alias("e")).distinct().withColumn("bin", F.expr("e div 12"))
    j = left.join(right, ["chr", "bin"]).filter("e > s AND e - s < 12").select("chr", (F.col("s") + 1).alias("st"), F.col("e").alias("ed"), F.lit(20.0).alias("cov")).distinct()
    return X.intron_retention(j, e, 0.9)


@R.add(f"WITH {L}, {O}, {_A} SELECT a.* FROM a WHERE (SELECT count(*) FROM a c WHERE c.chr = a.chr AND c.st < a.ed AND a.st < c.ed) = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE {_OVL} AND least(a.ed, b.ed) - greatest(a.st, b.st) >= 0.8 * (a.ed - a.st))")
def lonely_exons(spark, sf):
    return X.lonely_exons(*_ab(spark, sf), most=0.8)


@R.add(f"""WITH {L}, {O}, {_A}, p AS (SELECT a.chr, a.st, a.ed, count(*) AS n, min(b.st) AS b_st, min(b.ed) AS b_ed FROM a JOIN b ON {_OVL} GROUP BY 1, 2, 3) SELECT chr, st, ed, b_st, b_ed FROM p WHERE n = 1 AND (st = b_st) <> (ed = b_ed)""")
def shared_boundary(spark, sf):
    return X.shared_boundary(*_ab(spark, sf))


@R.add(f"""WITH {L}, e AS (SELECT DISTINCT chr, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand, st, ed, st // 400 AS gene FROM iv_lineitem),
s AS (SELECT chr, strand, gene, min(st) AS st, max(ed) AS ed FROM e GROUP BY 1, 2, 3), g AS (SELECT DISTINCT a.chr, a.strand, a.ed AS st, (SELECT min(b.st) FROM s b WHERE b.chr = a.chr AND b.strand = a.strand AND b.st >= a.ed) AS ed FROM s a)
SELECT chr, strand, st, ed FROM g WHERE st < ed AND NOT EXISTS (SELECT 1 FROM e WHERE e.chr = g.chr AND e.strand = g.strand AND e.st < g.ed AND g.st < e.ed)""")
def adjacent_gene_gaps(spark, sf):
    e = view(spark, sf, "iv_lineitem").select("chr", F.expr("CASE WHEN strand = '-' THEN '-' ELSE '+' END").alias("strand"), "st", "ed", F.expr("st div 400").alias("gene")).distinct()
    return X.adjacent_gene_gaps(e, "gene")


@R.add("WITH s AS (SELECT l_partkey AS d, l_suppkey AS a, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY d) AS m FROM s) SELECT d, a, n FROM m WHERE n < 0.4 * m")
def weak_links(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("d"), F.col("l_suppkey").alias("a")).agg(F.count("*").alias("n"))
    return X.weak_links(s, ["d"], "n", 0.4)


@R.add(f"""WITH {L}, {O}, b AS (SELECT DISTINCT chr, st, ed FROM iv_orders), t AS (SELECT b.chr, b.st, b.ed, min(i.strand) AS x, max(i.strand) AS y FROM b LEFT JOIN iv_lineitem i ON i.chr = b.chr AND i.st < b.ed AND b.st < i.ed AND i.strand <> '.' GROUP BY 1, 2, 3)
SELECT chr, st, ed, CASE WHEN x = y THEN x ELSE '.' END AS strand FROM t""")
def island_strand(spark, sf):
    return X.retag_strand(view(spark, sf, "iv_orders").select("chr", "st", "ed").distinct(), view(spark, sf, "iv_lineitem"))

_READS = "r AS (SELECT DISTINCT concat('c', l_suppkey % 5) AS chr, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 10 AS st, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) * 10 + 8 AS ed, l_orderkey // 2 AS read_id, l_orderkey AS map_id FROM lineitem)"
_GAPS = "g AS (SELECT * FROM (SELECT chr, lag(ed) OVER (PARTITION BY map_id ORDER BY chr, st) AS st, st AS ed, read_id, map_id, lag(chr) OVER (PARTITION BY map_id ORDER BY chr, st) AS c FROM r) WHERE c = chr AND st < ed)"


def _reads(spark, sf):
    day = "cast(datediff(l_shipdate, DATE'1995-01-01') * 10 AS BIGINT)"
    return table(spark, sf, "lineitem").selectExpr("concat('c', l_suppkey % 5) AS chr", f"{day} AS st", f"{day} + 8 AS ed", "l_orderkey div 2 AS read_id", "l_orderkey AS map_id").distinct()


@R.add(f"WITH {_READS} SELECT read_id FROM r GROUP BY 1 HAVING count(DISTINCT map_id) > 1")
def multi_mapped(spark, sf):
    return D.multi_mapped(_reads(spark, sf))


@R.add(f"WITH {_READS}, {_GAPS} SELECT chr, st, ed, read_id, map_id FROM g")
def read_junctions(spark, sf):
    return D.segments_to_junctions(_reads(spark, sf))


@R.add(f"""WITH {_READS}, {_GAPS}, c AS (SELECT map_id, read_id, chr, string_agg(concat(st, '|', ed), ',' ORDER BY st) AS chain, min(st) AS st, max(ed) AS ed FROM g GROUP BY 1, 2, 3),
m AS (SELECT read_id FROM r GROUP BY 1 HAVING count(DISTINCT map_id) > 1) SELECT chr, chain, min(st) AS st, max(ed) AS ed, count(*) AS cnt, count(*) FILTER (WHERE read_id NOT IN (SELECT read_id FROM m)) AS ucnt FROM c GROUP BY 1, 2""")
def read_chains(spark, sf):
    return D.junction_paths(_reads(spark, sf))


@R.add(f"""WITH {_READS}, {_GAPS}, t AS (SELECT *, CASE WHEN st % 3 = 0 THEN '+' WHEN st % 3 = 1 THEN '-' ELSE '.' END AS strand FROM g),
o AS (SELECT map_id, sum(CASE strand WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END) AS v FROM t GROUP BY 1), w AS (SELECT map_id, CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '-' ELSE '.' END AS strand FROM o),
b AS (SELECT 'ex' AS kind, coalesce(strand, '.') AS strand, chr, st, ed, read_id FROM r LEFT JOIN w USING (map_id) UNION ALL SELECT 'sj', w.strand, chr, st, ed, read_id FROM t JOIN w USING (map_id)),
m AS (SELECT read_id FROM r GROUP BY 1 HAVING count(DISTINCT map_id) > 1), e AS (SELECT 'all' AS reads, * FROM b UNION ALL SELECT 'uniq', * FROM b WHERE read_id NOT IN (SELECT read_id FROM m)),
{sweep_sql('e', keys='kind, reads, strand, chr')} SELECT kind, reads, strand, chr, st, ed, value::BIGINT AS value FROM swp""")
def library_tracks(spark, sf):
    reads = _reads(spark, sf)
    strands = D.segments_to_junctions(reads).select("chr", "st", "ed").distinct().withColumn("strand", F.expr("CASE WHEN st % 3 = 0 THEN '+' WHEN st % 3 = 1 THEN '-' ELSE '.' END"))
    return D.tracks(reads, strands)


@R.add(f"WITH {P} SELECT least(greatest(floor((lfc + 2) / 0.1), 0), 39)::INTEGER AS bin, count(*) AS n FROM pv GROUP BY 1")
def histogram(spark, sf):
    return H.histogram(view(spark, sf, "pv"), "lfc", -2, 2, 40)


@R.add()
def noise_threshold(spark, sf):
    pv = view(spark, sf, "pv")
    found = H.false_rate_threshold(pv.filter("p < 0.5"), pv.filter("p >= 0.5 AND lfc < 1"), "lfc", -2, 2, 40, rate=0.05)
    slope, intercept = H.power_law(pv.withColumn("x", F.abs("lfc")), "x", 0.0, 2.0, 20)
    return spark.createDataFrame([("threshold", found), ("slope", slope), ("intercept", intercept)], "name string, value double")


@R.add(f"""WITH RECURSIVE {P}, s AS (SELECT floor(lfc / 0.25)::BIGINT AS step, count(*) AS n FROM pv GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM s),
f AS (SELECT i, step, 0 AS bin, CASE WHEN n >= 200 THEN 0 ELSE n END AS held, n >= 200 AS cut FROM o WHERE i = 1 UNION ALL
 SELECT o.i, o.step, f.bin + f.cut::INT, CASE WHEN f.held + o.n >= 200 THEN 0 ELSE f.held + o.n END, f.held + o.n >= 200 FROM f JOIN o ON o.i = f.i + 1)
SELECT bin, min(lfc) AS minx, max(lfc) AS maxx, count(*) AS cnt, round(quantile_cont(p, 0.9), 9) AS value FROM pv JOIN f ON f.step = floor(lfc / 0.25) GROUP BY bin""")
def binned_percentile(spark, sf):
    return H.binned_percentile(view(spark, sf, "pv"), "lfc", "p", 90, 0.25, 200).withColumn("value", F.round("value", 9))


@R.add(f"""WITH {L}, {sweep_sql('iv_lineitem')}, a AS (SELECT DISTINCT chr, greatest(st - 20, 0) AS st, st + 21 AS ed FROM swp)
SELECT a.chr, a.st, a.ed, round(coalesce(sum(s.value * (least(a.ed, s.ed) - greatest(a.st, s.st))), 0) / (a.ed - a.st), 6) AS cov FROM a LEFT JOIN swp s ON s.chr = a.chr AND s.st < a.ed AND a.st < s.ed GROUP BY 1, 2, 3""")
def smoothed_track(spark, sf):
    return H.smooth(C.coverage(view(spark, sf, "iv_lineitem")), ["chr"], 20).withColumn("cov", F.round("cov", 6))


@R.add(f"WITH {L}, {sweep_sql('iv_lineitem')}, lo AS (SELECT chr, st, ed FROM swp WHERE value <= 1), {islands_sql('lo')}, g AS (SELECT chr, st, ed - st AS len, row_number() OVER (PARTITION BY chr ORDER BY st) AS r FROM isl WHERE ed - st > 30) SELECT chr, st, len FROM g WHERE r = 1")
def first_gap(spark, sf):
    return H.first_gap(C.coverage(view(spark, sf, "iv_lineitem")), ["chr"], 1, 30)


@R.add("""WITH s AS (SELECT p_partkey AS id, (p_size - 25) / 10.0 AS a, (p_partkey % 41 - 20) / 8.0 AS b FROM part)
SELECT id, ((a >= 1.5)::INT + (b >= 1.5)::INT + (a <= -1.5)::INT + (b <= -1.5)::INT)::INTEGER AS hits,
 CASE WHEN (a >= 1.5 OR b >= 1.5) AND (a <= -1.5 OR b <= -1.5) THEN 'mix' WHEN a >= 1.5 OR b >= 1.5 THEN 'pos' WHEN a <= -1.5 OR b <= -1.5 THEN 'neg' ELSE 'none' END AS side,
 CASE WHEN abs(a) >= 1.5 THEN 0 WHEN abs(b) >= 1.5 THEN 1 END::INTEGER AS first_hit, round((CASE WHEN abs(a) >= 1.5 THEN abs(a) ELSE 0 END + CASE WHEN abs(b) >= 1.5 THEN abs(b) ELSE 0 END)::DOUBLE, 6) AS strength FROM s""")
def merge_sort_key(spark, sf):
    s = table(spark, sf, "part").selectExpr("p_partkey AS id", "(p_size - 25) / 10D AS a", "(p_partkey % 41 - 20) / 8D AS b")
    return H.merge_sort_key(s, "id", ["a", "b"], 1.5).withColumn("strength", F.round("strength", 6))


@R.add(f"""WITH {P}, s AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM pv WHERE abs(lfc) >= 1.0), q AS (SELECT *, min(least(1, p * n / r)) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING) AS q FROM s)
SELECT id, p, lfc, round(q, 9) AS q FROM q WHERE q < 0.9""")
def lfc_and_q(spark, sf):
    return H.select_by_lfc_and_q(view(spark, sf, "pv").select("id", "p", "lfc"), "lfc", "p", 1.0, 0.9, order=["id"]).withColumn("q", F.round("q", 9))


@R.add("SELECT p_partkey AS id, concat(p_brand, '.', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS tname FROM part")
def transcript_names(spark, sf):
    return H.ranked_names(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand", ["id"]).select("id", "tname")


@R.add("""WITH m AS (SELECT concat('n', c_nationkey) AS node, c_mktsegment AS term, c_custkey AS id FROM customer) SELECT term, count(DISTINCT node) AS nodes, string_agg(DISTINCT node, ',' ORDER BY node) AS names FROM m GROUP BY term""")
def slim_terms(spark, sf):
    m = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("term"))
    held = m.groupBy("term").agg(F.array_sort(F.collect_set("node")).alias("x"))
    return held.select("term", F.size("x").cast("long").alias("nodes"), F.array_join("x", ",").alias("names"))


@R.add("SELECT c_custkey AS id FROM customer WHERE regexp_matches(c_mktsegment, '^(AUTO|BUILD)') AND NOT starts_with(c_name, 'ERCC-')")
def find_terms(spark, sf):
    c = table(spark, sf, "customer")
    return c.filter(F.col("c_mktsegment").rlike("^(AUTO|BUILD)") & ~F.col("c_name").startswith("ERCC-")).select(F.col("c_custkey").alias("id"))


@R.add(f"""WITH RECURSIVE {duck('edges')}, w AS (SELECT DISTINCT src AS node FROM edges WHERE src = (SELECT min(src) FROM edges) UNION
SELECT CASE WHEN e.src = w.node THEN e.dst ELSE e.src END FROM w JOIN edges e ON e.src = w.node OR e.dst = w.node) SELECT node FROM w""")
def one_component(spark, sf):
    edges = view(spark, sf, "edge_rows")
    comp = G.connected_components(edges)
    first = edges.agg(F.min("src").alias("node"))
    of_it = comp.join(F.broadcast(first), "node").select("component")  # one row
    return comp.join(F.broadcast(of_it), "component", "left_semi").select("node")


@R.add(f"WITH {L}, x AS (SELECT chr, st, ed, greatest(floor(w / 0.02)::BIGINT + 1, 1) AS k FROM iv_lineitem), {sweep_sql('x', weight='k')} SELECT chr, st, ed, value::BIGINT AS value FROM swp")
def quantized_track(spark, sf):
    level = F.greatest(F.floor(F.col("w") / F.lit(0.02)) + 1, F.lit(1)).cast("long")
    return C.coverage(view(spark, sf, "iv_lineitem"), weight=level)


@R.add(f"""WITH {L}, {O}, {sweep_sql('iv_lineitem', name='sa')}, {sweep_sql('iv_orders', name='sb')}, u AS (SELECT chr, st, ed, value FROM sa UNION ALL SELECT chr, st, ed, value FROM sb),
p AS (SELECT chr, st AS pos FROM u UNION SELECT chr, ed FROM u), s AS (SELECT chr, pos AS st, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS ed FROM p),
m AS (SELECT s.chr, s.st, s.ed, max(u.value) AS v FROM s JOIN u ON u.chr = s.chr AND u.st <= s.st AND u.ed >= s.ed WHERE s.ed IS NOT NULL GROUP BY 1, 2, 3), {sweep_sql('m', weight='v')}
SELECT chr, st, ed, value::BIGINT AS value FROM swp""")
def overlay_max(spark, sf):
    return C.overlay_max(C.coverage(view(spark, sf, "iv_lineitem")), C.coverage(view(spark, sf, "iv_orders")))
