"""Queries of interval algebra and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus_spark.operators import coverage as C
from locus_spark.operators import intervals as I
from locus_spark.plans.materialize import once
from locus_spark.plans.views import duck, table, view
from locus_spark.queries import Registry

R = Registry()
SMALL_TILE = 4096  # the views span some 25,000 positions


def islands_sql(source: str, keys: str = "chr", gap: int = 0, opens: str | None = None, extra: str = "", name: str = "isl") -> str:
    test = opens or f"st > pm + {gap}"
    return f"""{name}_a AS (SELECT *, max(ed) OVER (PARTITION BY {keys} ORDER BY st, ed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN pm IS NULL OR {test} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY st, ed ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT {keys}, min(st) AS st, max(ed) AS ed, count(*) AS n{extra} FROM {name}_b GROUP BY {keys}, g)"""


def sweep_sql(source: str, keys: str = "chr", weight: str = "1", digits: int | None = None, name: str = "swp", flat: bool = False) -> str:
    total = f"sum(d) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    total = total if digits is None else f"round({total}, {digits})"
    d = "sum(d)" if digits is None else f"round(sum(d), {digits})"
    return f"""{name}_d AS (SELECT {keys}, pos, {d} AS d FROM (SELECT {keys}, st AS pos, {weight} AS d FROM {source} WHERE st < ed UNION ALL
  SELECT {keys}, ed, -({weight}) FROM {source} WHERE st < ed) GROUP BY {keys}, pos{'' if flat else ' HAVING ' + d + ' <> 0'}),
{name} AS (SELECT * FROM (SELECT {keys}, pos AS st, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS ed, {total} AS value FROM {name}_d) WHERE ed IS NOT NULL AND value <> 0)"""


L, O, E = duck("iv_lineitem"), duck("iv_orders"), duck("iv_events")
ISL, SWP = islands_sql("iv_lineitem"), sweep_sql("iv_lineitem")


@R.add(f"WITH {L}, {ISL} SELECT chr, st, ed, n FROM isl")
def iv_union(spark, sf):
    return I.merge(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE)


@R.add(f"WITH {L}, {islands_sql('iv_lineitem', gap=15, extra=', avg(w) AS w')} SELECT chr, st, ed, n, round(w, 6) AS w FROM isl")
def iv_merge_gap(spark, sf):
    out = I.merge(view(spark, sf, "iv_lineitem"), gap=15, sums=["w"], tile=SMALL_TILE)
    return out.withColumn("w", F.round(F.col("w") / F.col("n"), 6))


@R.add(f"WITH {L}, {islands_sql('iv_lineitem', keys='gid, chr')} SELECT gid, chr, st, ed, n FROM isl")
def iv_union_by_gene(spark, sf):
    return I.merge(view(spark, sf, "iv_lineitem"), ["gid", "chr"], tile=SMALL_TILE)


@R.add(f"WITH {L}, {islands_sql('iv_lineitem', opens='st >= pm', keys='chr, strand')} SELECT chr, strand, st, ed, n FROM isl")
def iv_head_groups(spark, sf):
    return I.merge(view(spark, sf, "iv_lineitem"), ["chr", "strand"], touching=False, tile=SMALL_TILE)


@R.add(
    f"WITH {L}, {ISL}, e AS (SELECT chr, ed AS st, lead(st) OVER (PARTITION BY chr ORDER BY st) AS ed FROM isl UNION ALL"
    " SELECT chr, 0, min(st) FROM isl GROUP BY chr), f AS (SELECT chr, st, coalesce(ed, 30000) AS ed FROM e) SELECT chr, st, ed FROM f WHERE st < ed"
)
def iv_complement(spark, sf):
    iv = view(spark, sf, "iv_lineitem")
    return I.complement(iv, iv.select("chr").distinct().withColumn("size", F.lit(30000)), tile=SMALL_TILE)


@R.add(f"WITH {L}, {ISL}, t AS (SELECT chr, sum(ed - st) AS totbp FROM iv_lineitem GROUP BY chr), u AS (SELECT chr, sum(ed - st) AS covbp FROM isl GROUP BY chr)"
       " SELECT chr, totbp::BIGINT AS totbp, covbp::BIGINT AS covbp, totbp / covbp AS acov FROM t JOIN u USING (chr)")  # fmt: skip
def iv_total_covered(spark, sf):
    return I.total_bases(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE)


@R.add(f"""WITH {L}, q AS (SELECT *, lag(gid) OVER (PARTITION BY chr ORDER BY gid, st, ed) AS before FROM iv_lineitem)
SELECT chr, sum(ed - st)::BIGINT AS totbp, count(*) AS n FROM q WHERE before IS NULL OR gid > before GROUP BY chr""")
def iv_total_unique(spark, sf):
    # A read counts once: rows of the same id as the one before drop out.
    one = view(spark, sf, "iv_lineitem").groupBy("chr", "gid").agg(F.min(F.struct("st", "ed")).alias("x"))
    return one.groupBy("chr").agg(F.sum(F.col("x.ed") - F.col("x.st")).alias("totbp"), F.count("*").alias("n"))


@R.add(f"WITH {L}, {SWP} SELECT chr, st, ed, value::BIGINT AS value FROM swp")
def iv_coverage(spark, sf):
    return C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE)


@R.add(f"WITH {L}, {sweep_sql('iv_lineitem', weight='w', digits=9)} SELECT chr, st, ed, round(value * 2.5, 6) AS value FROM swp")
def iv_coverage_scaled(spark, sf):
    return C.coverage(view(spark, sf, "iv_lineitem"), weight=F.col("w"), scale=2.5, digits=9, tile=SMALL_TILE).withColumn("value", F.round("value", 6))


@R.add(f"WITH {L}, {sweep_sql('iv_lineitem', keys='chr, strand')} SELECT chr, strand, st, ed, value::BIGINT AS value FROM swp")
def iv_coverage_stranded(spark, sf):
    return C.coverage(view(spark, sf, "iv_lineitem"), ["chr", "strand"], tile=SMALL_TILE)


@R.add(f"WITH {L}, {SWP}, hi AS (SELECT chr, st, ed FROM swp WHERE value > 1), {islands_sql('hi')} SELECT chr, st, ed FROM isl")
def cov_threshold(spark, sf):
    return C.threshold(C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE), 1)


_BOTH = f"{L}, {O}, {SWP}, {sweep_sql('iv_orders', name='swo')}, u AS (SELECT chr, st, ed, value::DOUBLE AS value FROM swp UNION ALL SELECT chr, st, ed, {{sign}}value::DOUBLE FROM swo)"


@R.add(f"WITH {_BOTH.format(sign='')}, {sweep_sql('u', weight='value', name='out')} SELECT chr, st, ed, round(value, 6) AS value FROM out")
def cov_track_sum(spark, sf):
    sets = [view(spark, sf, v) for v in ("iv_lineitem", "iv_orders")]
    return C.combined_coverage(sets, tile=SMALL_TILE).withColumn("value", F.round("value", 6))


@R.add(f"WITH {_BOTH.format(sign='-')}, {sweep_sql('u', weight='value', name='out')} SELECT chr, st, ed, round(value, 6) AS value FROM out")
def cov_track_diff(spark, sf):
    sets = [view(spark, sf, v) for v in ("iv_lineitem", "iv_orders")]
    return C.combined_coverage(sets, [1, -1], tile=SMALL_TILE).withColumn("value", F.round("value", 6))


@R.add(f"WITH {L}, {SWP} SELECT chr, sum(value * (ed - st))::BIGINT AS totbp, sum(ed - st)::BIGINT AS covbp, sum(value * (ed - st)) / sum(ed - st) AS acov FROM swp GROUP BY chr")
def cov_stats(spark, sf):
    return C.track_stats(C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE))


@R.add(f"""WITH {L}, {SWP}, b AS (SELECT chr, unnest(range(st // 500, (ed - 1) // 500 + 1)) AS bin, st, ed, value FROM swp),
p AS (SELECT chr, bin, value, least(ed, (bin + 1) * 500) - greatest(st, bin * 500) AS n FROM b)
SELECT chr, bin, sum(n)::BIGINT AS covered, sum(value * n)::BIGINT AS total, min(value)::BIGINT AS least, max(value)::BIGINT AS most,
 sum(value * value * n)::BIGINT AS squares, sum(value * n) / sum(n) AS mean FROM p GROUP BY chr, bin""")
def cov_bins_summary(spark, sf):
    return C.bin_summary(C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE), 500)


_ATOM = sweep_sql("one", name="atm", flat=True)


@R.add(f"""WITH {L}, one AS (SELECT DISTINCT chr, st, ed FROM iv_lineitem), {_ATOM}, m AS (SELECT atm.chr, atm.st, atm.ed, gid FROM atm JOIN iv_lineitem i
 ON i.chr = atm.chr AND i.st <= atm.st AND i.ed >= atm.ed) SELECT chr, st, ed, array_to_string(list_sort(list_distinct(list(gid))), ',') AS ids FROM m GROUP BY chr, st, ed""")
def iv_atomic(spark, sf):
    return I.atomic(view(spark, sf, "iv_lineitem"), "gid", tile=SMALL_TILE).withColumn("ids", F.array_join("ids", ","))


_OVL = "a.chr = b.chr AND a.st < b.ed AND b.st < a.ed"
_AB = "a AS (SELECT chr, st, ed, gid FROM iv_lineitem), b AS (SELECT chr, st, ed, id FROM iv_orders)"


def _ab(spark, sf):
    return view(spark, sf, "iv_lineitem").select("chr", "st", "ed", "gid"), view(spark, sf, "iv_orders").select("chr", "st", "ed", "id")


@R.add(f"WITH {L}, {O}, {_AB} SELECT a.chr, a.st, a.ed, a.gid, b.st AS b_st, b.ed AS b_ed, b.id AS b_id, least(a.ed, b.ed) - greatest(a.st, b.st) AS ovl FROM a JOIN b ON {_OVL}")
def iv_overlap_inner(spark, sf):
    return I.overlap_join(*_ab(spark, sf))


@R.add(f"WITH {L}, {O}, {_AB} SELECT a.chr, a.st, a.ed, a.gid, b.st AS b_st, b.ed AS b_ed, b.id AS b_id,"
       f" coalesce(least(a.ed, b.ed) - greatest(a.st, b.st), 0) * (CASE WHEN b.id IS NULL THEN 0 ELSE 1 END) AS ovl FROM a LEFT JOIN b ON {_OVL}")  # fmt: skip
def iv_overlap_wao(spark, sf):
    return I.overlap_join(*_ab(spark, sf), "left")


@R.add(f"WITH {L}, {O}, {_AB} SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_OVL})")
def iv_overlap_semi(spark, sf):
    return I.overlap_join(*_ab(spark, sf), "semi")


@R.add(f"WITH {L}, {O}, {_AB} SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_OVL})")
def iv_overlap_anti(spark, sf):
    return I.overlap_join(*_ab(spark, sf), "anti")


@R.add(f"WITH {L}, {O}, {_AB} SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_OVL} AND least(a.ed, b.ed) - greatest(a.st, b.st) >= 0.5 * (a.ed - a.st))")
def iv_overlap_fraction(spark, sf):
    return I.overlap_join(*_ab(spark, sf), "semi", fraction=0.5)


@R.add(f"""WITH {L}, {O}, {_AB}, {islands_sql('b')},
c AS (SELECT a.chr, a.st, a.ed, a.gid, a.rn, i.st AS s, i.ed AS e FROM (SELECT *, row_number() OVER () AS rn FROM a) a LEFT JOIN isl i ON i.chr = a.chr AND i.st < a.ed AND a.st < i.ed),
h AS (SELECT chr, gid, coalesce(lag(e) OVER (PARTITION BY rn ORDER BY s), st) AS st, coalesce(s, ed) AS ed FROM c UNION ALL
 SELECT chr, gid, max(e), any_value(ed) FROM c WHERE e IS NOT NULL GROUP BY chr, gid, rn)
SELECT chr, st, ed, gid FROM h WHERE st < ed""")
def iv_subtract(spark, sf):
    return I.subtract(*_ab(spark, sf), tile=SMALL_TILE)


@R.add(f"""WITH {L}, {O}, {_AB}, d AS (SELECT DISTINCT chr, st, ed FROM a),
o AS (SELECT a.chr, a.st, a.ed, coalesce(sum(CASE WHEN b.id IS NULL THEN 0 ELSE least(a.ed, b.ed) - greatest(a.st, b.st) END), 0)::BIGINT AS ovl FROM d a LEFT JOIN b ON {_OVL} GROUP BY 1, 2, 3)
SELECT chr, st, ed, ovl, ed - st AS len, ovl / (ed - st) AS ovlratio, (ed - st) - ovl AS notcovbp FROM o""")
def iv_ovlratio(spark, sf):
    return I.overlap_ratio(*_ab(spark, sf))


@R.add(f"""WITH {L}, d AS (SELECT chr, st, ed, count(*) AS c FROM iv_lineitem GROUP BY 1, 2, 3),
t AS (SELECT a.chr, a.st, a.ed, any_value(a.c) AS c, sum(b.c)::BIGINT AS total FROM d a JOIN d b ON {_OVL} GROUP BY 1, 2, 3) SELECT chr, st, ed, c, total, c / total AS ratio FROM t""")
def iv_self_ratio(spark, sf):
    return I.self_ratio(view(spark, sf, "iv_lineitem").withColumn("c", F.lit(1).cast("long")), "c")


@R.add(f"""WITH {L}, d AS (SELECT DISTINCT chr, st, ed FROM iv_lineitem), p AS (SELECT a.chr, a.st, a.ed, b.st AS bs, b.ed AS be FROM d a JOIN d b ON a.chr = b.chr AND a.st < b.st AND b.st < a.ed AND a.ed < b.ed)
SELECT chr, bs AS st, ed FROM p UNION SELECT chr, st, be FROM p""")
def iv_pair_merge(spark, sf):
    return I.merge_pairs(view(spark, sf, "iv_lineitem"))


_D = "d AS (SELECT DISTINCT chr, st, ed FROM iv_orders)"
_OV = "a.chr = s.chr AND a.st < s.ed AND s.st < a.ed"


@R.add(f"""WITH {L}, {ISL}, {SWP} SELECT a.chr, a.st, a.ed, round(coalesce(sum(s.value * (least(a.ed, s.ed) - greatest(a.st, s.st))), 0) / (a.ed - a.st), 6) AS cov
FROM isl a LEFT JOIN swp s ON {_OV} GROUP BY 1, 2, 3""")
def cov_mean_interval(spark, sf):
    iv = view(spark, sf, "iv_lineitem")
    return C.mean_over(I.merge(iv, tile=SMALL_TILE), C.coverage(iv, tile=SMALL_TILE)).withColumn("cov", F.round("cov", 6))


@R.add(f"WITH {L}, {O}, {_D}, {SWP} SELECT a.chr, a.st, a.ed, coalesce(max(s.value), 0)::BIGINT AS cov FROM d a LEFT JOIN swp s ON {_OV} GROUP BY 1, 2, 3")
def cov_max_interval(spark, sf):
    return C.max_over(view(spark, sf, "iv_orders"), C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE))


_GENE = f"""{L}, {O}, one AS (SELECT DISTINCT chr, st, ed FROM iv_lineitem), {_ATOM}, {sweep_sql('iv_orders')},
p AS (SELECT a.chr, a.st, a.ed, coalesce(sum(s.value * (least(a.ed, s.ed) - greatest(a.st, s.st))), 0) / (a.ed - a.st) AS cov FROM atm a LEFT JOIN swp s ON {_OV} GROUP BY 1, 2, 3),
m AS (SELECT DISTINCT i.gid, p.* FROM p JOIN iv_lineitem i ON i.chr = p.chr AND i.st <= p.st AND i.ed >= p.ed)"""


@R.add(f"""WITH {_GENE} SELECT gid, min(st) AS st, max(ed) AS ed, sum(ed - st)::BIGINT AS len, round(sum(cov * (ed - st)) / sum(ed - st), 6) AS gcov,
round(coalesce(sum(cov * (ed - st)) / sum(CASE WHEN cov > 0 THEN ed - st END), 0), 6) AS gcov2 FROM m GROUP BY gid""")
def gene_cov(spark, sf):
    iv = view(spark, sf, "iv_lineitem")
    atoms = once(I.atomic(iv, "gid", tile=SMALL_TILE), "atoms")
    parts = C.mean_over(atoms, C.coverage(view(spark, sf, "iv_orders"), tile=SMALL_TILE))
    out = C.gene_coverage(atoms.select(F.explode("ids").alias("gid"), "chr", "st", "ed"), parts)
    return out.withColumns({c: F.round(c, 6) for c in ("gcov", "gcov2")})


@R.add(f"""WITH {L}, {islands_sql('iv_lineitem', keys='gid, chr')} SELECT gid, sum(ed - st)::BIGINT AS tlen, min(st) AS gst, max(ed) AS ged, max(ed) - min(st) AS glen, log10(sum(ed - st)) AS ltlen FROM isl GROUP BY gid""")
def gene_len(spark, sf):
    return C.gene_length(view(spark, sf, "iv_lineitem"))


@R.add(f"""WITH {L}, {O}, {_D}, {SWP}, q AS (SELECT chr, st, ed, unnest([st - 1, st, ed - 1, ed]) AS pos, unnest(['s_out', 's_in', 'e_in', 'e_out']) AS spot FROM d),
v AS (SELECT q.*, coalesce(s.value, 0)::BIGINT AS value FROM q LEFT JOIN swp s ON s.chr = q.chr AND s.st <= q.pos AND q.pos < s.ed),
w AS (SELECT chr, st, ed, max(CASE WHEN spot = 's_out' THEN value END) AS s_out, max(CASE WHEN spot = 's_in' THEN value END) AS s_in,
 max(CASE WHEN spot = 'e_in' THEN value END) AS e_in, max(CASE WHEN spot = 'e_out' THEN value END) AS e_out FROM v GROUP BY 1, 2, 3)
SELECT *, round(log2(s_in + 1) - log2(s_out + 1), 6) AS s_step, round(log2(e_in + 1) - log2(e_out + 1), 6) AS e_step FROM w""")
def exon_flux(spark, sf):
    out = C.flux(view(spark, sf, "iv_orders"), C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE))
    return out.withColumns({c: F.round(c, 6) for c in ("s_step", "e_step")})


@R.add(f"""WITH {L}, {SWP}, c AS (SELECT chr, st AS pos, log2(value + 1) AS d FROM swp UNION ALL SELECT chr, ed, -log2(value + 1) FROM swp),
s AS (SELECT chr, pos, sum(d) AS step FROM c GROUP BY 1, 2) SELECT chr, pos, round(step, 6) AS step FROM s WHERE abs(step) > 1""")
def edge_steps(spark, sf):
    track = C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE)
    return C.changes(track).filter("abs(step) > 1").withColumn("step", F.round("step", 6))


@R.add(f"""WITH {L}, {O}, {SWP}, {islands_sql('swp')}, f AS (SELECT * FROM isl a WHERE ed - st >= 40 AND NOT EXISTS (SELECT 1 FROM iv_orders b WHERE {_OVL}))
SELECT a.chr, a.st, a.ed, round(coalesce(sum(s.value * (least(a.ed, s.ed) - greatest(a.st, s.st))), 0) / (a.ed - a.st), 6) AS cov FROM f a LEFT JOIN swp s ON {_OV} GROUP BY 1, 2, 3""")
def single_exons(spark, sf):
    track = C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE)
    return C.single_exon_candidates(track, view(spark, sf, "iv_orders"), 40).withColumn("cov", F.round("cov", 6))


@R.add(f"""WITH {L}, e AS (SELECT gid, chr, strand, st, ed, ed - st AS size, coalesce(sum(ed - st) OVER (PARTITION BY gid ORDER BY CASE WHEN strand <> '-' THEN -ed ELSE st END, st, ed, chr, strand
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT DISTINCT gid, 'c' AS chr, '+' AS strand, st, ed FROM iv_lineitem)),
k AS (SELECT *, 100 - before AS room FROM e WHERE 100 - before > 0)
SELECT gid, chr, strand, (CASE WHEN room < size AND strand <> '-' THEN ed - room ELSE st END)::BIGINT AS st, (CASE WHEN room < size AND strand = '-' THEN st + room ELSE ed END)::BIGINT AS ed FROM k""")
def iv_trim3(spark, sf):
    one = view(spark, sf, "iv_lineitem").select("gid", F.lit("c").alias("chr"), F.lit("+").alias("strand"), "st", "ed").distinct()
    return I.trim_3prime(one, "gid", 100)


_U = f"{L}, {islands_sql('iv_lineitem', keys='gid, chr')}"


@R.add(f"""WITH {_U} SELECT gid, chr, min(st) AS st, max(ed) AS ed, count(*)::INTEGER AS n_blocks, string_agg((ed - st)::VARCHAR, ',' ORDER BY st) || ',' AS esizes,
string_agg((st - m)::VARCHAR, ',' ORDER BY st) || ',' AS estarts FROM (SELECT *, min(st) OVER (PARTITION BY gid, chr) AS m FROM isl) GROUP BY gid, chr""")
def blocks_build(spark, sf):
    return I.build_blocks(I.merge(view(spark, sf, "iv_lineitem"), ["gid", "chr"]), ["gid", "chr"])


@R.add(f"WITH {_U} SELECT gid, chr, st, ed FROM isl")
def blocks_explode(spark, sf):
    built = I.build_blocks(I.merge(view(spark, sf, "iv_lineitem"), ["gid", "chr"]), ["gid", "chr"])
    return I.explode_blocks(built).select("gid", "chr", "st", "ed")


@R.add(f"WITH {_U}, n AS (SELECT gid, chr, ed AS st, lead(st) OVER (PARTITION BY gid, chr ORDER BY st) AS ed FROM isl) SELECT gid, chr, st, ed FROM n WHERE ed IS NOT NULL")
def intron_from_blocks(spark, sf):
    built = I.build_blocks(I.merge(view(spark, sf, "iv_lineitem"), ["gid", "chr"]), ["gid", "chr"])
    return I.introns(I.explode_blocks(built), ["gid", "chr"])


@R.add(f"WITH {L}, {SWP}, lo AS (SELECT chr, st, ed FROM swp WHERE value <= 1), {islands_sql('lo')} SELECT chr, max(ed - st) AS gap FROM isl GROUP BY chr")
def longest_gap(spark, sf):
    return I.longest_gap(C.coverage(view(spark, sf, "iv_lineitem"), tile=SMALL_TILE), ["chr"], 1)


@R.add(f"WITH {E}, {islands_sql('iv_events', gap=1800, extra=', sum(val) AS val')} SELECT chr, st, ed, n, round(val, 4) AS val FROM isl")
def session_windows(spark, sf):
    out = I.merge(view(spark, sf, "iv_events"), gap=1800, sums=["val"])
    return out.withColumn("val", F.round("val", 4))


@R.add(f"""WITH {L}, g AS (SELECT chr, max(ed) AS size FROM iv_lineitem GROUP BY chr), {ISL}, h AS (SELECT chr, ed AS st, lead(st) OVER (PARTITION BY chr ORDER BY st) AS ed FROM isl),
c AS (SELECT chr, (st + ed) // 2 AS m FROM h WHERE ed - st >= 20), r AS (SELECT chr, m, row_number() OVER (PARTITION BY chr ORDER BY m) AS i FROM c)
SELECT count(*)::BIGINT AS cuts, sum(m)::BIGINT AS total FROM r""")
def bundle_gaps(spark, sf):
    iv = view(spark, sf, "iv_lineitem")
    islands = I.merge(iv, tile=SMALL_TILE)
    gaps = I.introns(islands, ["chr"]).filter("ed - st >= 20")
    return gaps.select(F.expr("(st + ed) div 2").alias("m")).agg(F.count("*").alias("cuts"), F.sum("m").alias("total"))


@R.add()
def bundles(spark, sf):
    iv = view(spark, sf, "iv_lineitem")
    sizes = iv.groupBy("chr").agg(F.max("ed").alias("size"))
    return I.bundles(I.introns(I.merge(iv, tile=SMALL_TILE), ["chr"]), sizes, least=5000)


@R.add("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_regionkey IS NOT NULL")
def dropped_nulls(spark, sf):
    n = table(spark, sf, "nation").selectExpr("n_name AS chr", "n_nationkey AS st", "n_regionkey AS ed")
    return I.drop_null_positions(n).select(F.col("st").alias("id"), F.col("chr").alias("name"))
