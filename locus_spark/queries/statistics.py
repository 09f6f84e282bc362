"""Queries of statistics, expression tables, model comparison and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from locus_spark.functions import stats as T
from locus_spark.operators import compare as M
from locus_spark.operators import intervals as I
from locus_spark.plans.views import duck, table, view
from locus_spark.queries import Registry
from locus_spark.queries.intervals import islands_sql

R = Registry()
L, O, X, P = (duck(n) for n in ("iv_lineitem", "iv_orders", "expr", "pv"))


def _padj(method: str):
    return lambda spark, sf: T.p_adjust(view(spark, sf, "pv").select("id", "cond", "p"), "p", method, ["cond"], order=["id"]).withColumn("padj", F.round("padj", 9))


_RANK = f"""{P}, r AS (SELECT id, cond, p, row_number() OVER (PARTITION BY cond ORDER BY p, id) AS r, count(*) OVER (PARTITION BY cond) AS n FROM pv),
h AS (SELECT *, (SELECT sum(1.0 / i) FROM range(1, n + 1) t(i)) AS f FROM r)"""
_UP, _DOWN = "(PARTITION BY cond ORDER BY p, id ROWS UNBOUNDED PRECEDING)", "(PARTITION BY cond ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)"
for _name, _value in {
    "bh": f"min(least(1, p * n / r)) OVER {_DOWN}",
    "by": f"min(least(1, p * n * f / r)) OVER {_DOWN}",
    "holm": f"max(least(1, (n - r + 1) * p)) OVER {_UP}",
    "hochberg": f"min(least(1, (n - r + 1) * p)) OVER {_DOWN}",
    "bonferroni": "least(1, p * n)",
    "none": "p",
}.items():
    _q = _padj({"bh": "BH", "by": "BY"}.get(_name, _name))
    _q.__name__ = f"padjust_{_name}"
    R.add(f"WITH {_RANK} SELECT id, cond, p, round({_value}, 9) AS padj FROM {'h' if _name == 'by' else 'r'}")(_q)

_q = _padj("hommel")
_q.__name__ = "padjust_hommel"
R.add()(_q)


@R.add(f"""WITH {P}, g AS (SELECT symbol, -sum(ln(p)) AS h, count(*) AS n FROM pv GROUP BY symbol),
k AS (SELECT symbol, h, n, unnest(range(0, n)) AS i FROM g), l AS (SELECT symbol, h, i, exp(-h + i * ln(h) - coalesce((SELECT sum(ln(j)) FROM range(1, i + 1) t(j)), 0)) AS term FROM k)
SELECT symbol, round(least(1, sum(term)), 9) AS p FROM l GROUP BY symbol""")
def fisher(spark, sf):
    return view(spark, sf, "pv").groupBy("symbol").agg(F.round(T.fisher_combined(F.col("p")), 9).alias("p"))


_TERM = f"""{duck('term', 'selected')}, s AS (SELECT term, count(*) AS n1, count(selected.id) AS n0 FROM term LEFT JOIN selected ON selected.id = term.id GROUP BY term),
t AS (SELECT count(*) AS tot, count(selected.id) AS num FROM (SELECT DISTINCT id FROM term) u LEFT JOIN selected ON selected.id = u.id),
c AS (SELECT * FROM s, t)"""


@R.add(f"""WITH {_TERM}, lf AS (SELECT i AS k, coalesce(sum(ln(CASE WHEN i > 0 THEN i ELSE 1 END)) OVER (ORDER BY i), 0) AS v FROM range(0, 200001) r(i)),
k AS (SELECT *, unnest(range(n0, least(num, n1) + 1)) AS k FROM c),
pr AS (SELECT term, n0, n1, num, tot, exp(a.v - b.v - d.v + e.v - f.v - g.v - h.v + i.v + j.v) AS pr FROM k
 JOIN lf a ON a.k = n1 JOIN lf b ON b.k = k.k JOIN lf d ON d.k = n1 - k.k JOIN lf e ON e.k = tot - n1 JOIN lf f ON f.k = num - k.k JOIN lf g ON g.k = tot - n1 - num + k.k
 JOIN lf h ON h.k = tot JOIN lf i ON i.k = num JOIN lf j ON j.k = tot - num)
SELECT term, n0, n1, tot, num, round(least(1, sum(pr)), 6) AS p, round(n0 * tot / (n1::DOUBLE * num), 6) AS odds FROM pr GROUP BY term, n0, n1, tot, num""")
def hypergeom(spark, sf):
    out = T.enrichment(view(spark, sf, "term"), view(spark, sf, "selected"))
    return out.withColumns({"p": F.round("p", 6), "odds": F.round("odds", 6)})


@R.add(f"""WITH {X}, m AS (SELECT gene, grp, avg(log2(value + 1)) AS m FROM expr GROUP BY 1, 2), k AS (SELECT gene FROM m GROUP BY gene HAVING max(m) > log2(2.0)),
d AS (SELECT a.gene, a.grp AS g1, b.grp AS g2, abs(a.m - b.m) AS d FROM m a JOIN m b USING (gene) JOIN k USING (gene)),
s AS (SELECT gene, max(d) AS mx, sum(CASE WHEN starts_with(g1, 'A') AND NOT starts_with(g2, 'A') THEN d END) AS b, count(CASE WHEN starts_with(g1, 'A') AND NOT starts_with(g2, 'A') THEN 1 END) AS nb,
 sum(CASE WHEN starts_with(g1, 'A') AND starts_with(g2, 'A') THEN d END) AS w, count(DISTINCT CASE WHEN starts_with(g1, 'A') THEN g1 END) AS t FROM d GROUP BY gene),
o AS (SELECT gene, CASE WHEN nb * mx > 0 THEN b / (nb * mx) ELSE 0 END AS between_, CASE WHEN t * (t - 1) * mx > 0 THEN w / (t * (t - 1) * mx) ELSE 0 END AS within_ FROM s)
SELECT gene, round(between_, 6) AS "between", round(within_, 6) AS within, round(between_ - within_, 6) AS score FROM o""")
def specificity(spark, sf):
    out = T.specificity(view(spark, sf, "expr"), "gene", "grp", "value", ["AF", "AO"])
    return out.select("gene", *(F.round(c, 6).alias(c) for c in ("between", "within", "score")))


@R.add(f"WITH {X}, s AS (SELECT gene, grp, avg(value) AS m, stddev_samp(value) AS s FROM expr GROUP BY 1, 2) SELECT gene, bool_or(coalesce(CASE WHEN m <> 0 THEN s / m END <= 0.3 AND m > 3, false)) AS signal FROM s GROUP BY gene")
def cv_noise(spark, sf):
    return T.cv_noise(view(spark, sf, "expr"), "gene", "grp", "value", cv=0.3)


@R.add(f"WITH {P} SELECT symbol, arg_max(lfc, (abs(lfc), lfc)) AS lfc FROM pv GROUP BY symbol")
def absmax(spark, sf):
    return view(spark, sf, "pv").groupBy("symbol").agg(T.absmax("lfc").alias("lfc"))


@R.add(f"""WITH {P} SELECT symbol, arg_max(lfc, (abs(lfc), lfc)) AS lfc, arg_min(id, (p, id)) AS best, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, count(*) AS size FROM pv GROUP BY symbol""")
def removedup(spark, sf):
    return T.remove_duplicates(view(spark, sf, "pv"), "symbol", "p", "lfc", "id").drop("p")


@R.add(f"WITH {P}, b AS (SELECT *, (row_number() OVER (ORDER BY lfc DESC, id DESC) - 1) // 100 AS bin FROM pv) SELECT bin, round(avg(lfc), 6) AS avgx, round(avg(p), 6) AS avgy, min(lfc) AS minx, max(lfc) AS maxx, count(*) AS cnt FROM b GROUP BY bin")
def binned_mean(spark, sf):
    out = T.binned_mean(view(spark, sf, "pv"), "lfc", "p", 100, order=["id"])
    return out.withColumns({"avgx": F.round("avgx", 6), "avgy": F.round("avgy", 6)})


@R.add(f"""WITH {P}, b AS (SELECT *, (row_number() OVER (ORDER BY lfc DESC, id DESC) - 1) // 100 AS bin FROM pv), c AS (SELECT bin, avg(p) AS y, min(lfc) AS a, max(lfc) AS b FROM b GROUP BY bin),
d AS (SELECT *, coalesce(lead(y) OVER (ORDER BY bin), 0) AS z FROM c) SELECT round(sum((b - a) * (y + z) / 2) / (max(b) - min(a)), 6) AS auc FROM d""")
def auc(spark, sf):
    return T.auc(T.binned_mean(view(spark, sf, "pv"), "lfc", "p", 100, order=["id"])).withColumn("auc", F.round("auc", 6))


@R.add(f"""WITH {X}, t AS (SELECT gene::VARCHAR AS gene, sum(value) AS value FROM expr GROUP BY gene), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, gene) AS r FROM t)
SELECT gene, value FROM r WHERE r <= 10 UNION ALL SELECT 'other', sum(value) FROM r WHERE r > 10""")
def topn_other(spark, sf):
    return T.top_n_other(view(spark, sf, "expr").withColumn("gene", F.col("gene").cast("string")), "gene", "value", 10)


@R.add(f"WITH {P} SELECT id, round(1 / (1 + exp(-(-0.5 + 2.0 * p - 0.25 * lfc))), 9) AS prob, (-0.5 + 2.0 * p - 0.25 * lfc) > 0 AS hit FROM pv")
def logistic_score(spark, sf):
    prob = T.logistic(-0.5, {"p": 2.0, "lfc": -0.25})
    return view(spark, sf, "pv").select("id", F.round(prob, 9).alias("prob"), (prob > 0.5).alias("hit"))


@R.add(f"""WITH {P}, c AS (SELECT (p > 0.5) AS t, (lfc > 0) AS g FROM pv), n AS (SELECT count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp,
count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM c) SELECT *, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity FROM n""")
def confusion(spark, sf):
    return T.confusion(view(spark, sf, "pv").select((F.col("p") > 0.5).alias("t"), (F.col("lfc") > 0).alias("g")), "t", "g")


@R.add(f"WITH {X} SELECT gene, sample, round(value / sum(value) OVER (PARTITION BY sample) * 1000000, 6) AS value FROM expr")
def library_scaled(spark, sf):
    return M.scale_to_library(view(spark, sf, "expr"), "sample", "value", 1e6).select("gene", "sample", F.round("value", 6).alias("value"))


_WIDE = ", ".join(f"max(CASE WHEN grp = '{g}' THEN v END) AS {g}" for g in ("AF", "AO", "NF", "NO", "RF", "RO"))


@R.add(f"WITH {X}, g AS (SELECT gene, grp, sum(value) AS v FROM expr GROUP BY 1, 2) SELECT gene, {_WIDE} FROM g GROUP BY gene")
def pivot_collect(spark, sf):
    long = view(spark, sf, "expr").groupBy("gene", "grp").agg(F.sum("value").alias("v"))
    return M.to_matrix(long, ["gene"], "grp", "v", ["AF", "AO", "NF", "NO", "RF", "RO"])


@R.add(f"WITH {X}, g AS (SELECT gene, grp, sum(value) AS v FROM expr GROUP BY 1, 2) SELECT gene, grp, v FROM g")
def unpivot_collect(spark, sf):
    long = view(spark, sf, "expr").groupBy("gene", "grp").agg(F.sum("value").alias("v"))
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    return M.from_matrix(M.to_matrix(long, ["gene"], "grp", "v", names), ["gene"], names, "grp", "v").filter("v IS NOT NULL")


@R.add("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS n_c, b.n AS n_s FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_concat(spark, sf):
    a = table(spark, sf, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return M.outer_concat({"c": a, "s": b}, ["k"])


_PAIRS = f"""{L}, {O}, ref AS (SELECT chr, st, ed, min(gid) AS id FROM iv_lineitem GROUP BY 1, 2, 3), tgt AS (SELECT chr, st, ed, min(id) AS id FROM iv_orders GROUP BY 1, 2, 3),
pr AS (SELECT a.chr, a.st, a.ed, a.id, b.st AS b_st, b.ed AS b_ed, b.id AS b_id, least(a.ed, b.ed) - greatest(a.st, b.st) AS ovl FROM ref a JOIN tgt b ON a.chr = b.chr AND a.st < b.ed AND b.st < a.ed)"""


def _models(spark, sf):
    ref = view(spark, sf, "iv_lineitem").groupBy("chr", "st", "ed").agg(F.min("gid").alias("id"))
    return ref, view(spark, sf, "iv_orders").groupBy("chr", "st", "ed").agg(F.min("id").alias("id"))


@R.add(f"""WITH {_PAIRS}, r AS (SELECT *, abs((b_ed - b_st) - (ed - st)) AS dlen, row_number() OVER (PARTITION BY chr, st, ed ORDER BY abs((b_ed - b_st) - (ed - st)), b_st, b_ed, b_id) AS r FROM pr)
SELECT chr, st, ed, id, b_st, b_ed, b_id, dlen FROM r WHERE r = 1""")
def match_closest(spark, sf):
    return M.closest_match(*_models(spark, sf))


@R.add(f"""WITH {_PAIRS}, h AS (SELECT chr, st, ed, max(CASE WHEN st = b_st AND ed = b_ed THEN 1 ELSE 0 END) AS exact, max(CASE WHEN st = b_st OR ed = b_ed THEN 1 ELSE 0 END) AS side FROM pr GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM ref) AS pop, count(*) AS hit, sum(exact)::BIGINT AS exact, sum(side)::BIGINT AS one_side, count(*) / (SELECT count(*) FROM ref) AS rate FROM h""")
def match_counts(spark, sf):
    return M.match_counts(*_models(spark, sf))


@R.add(f"""WITH {_PAIRS}, rg AS (SELECT *, id % 500 AS g FROM pr), c AS (SELECT g, b_id % 100 AS t, count(DISTINCT (chr, st, ed)) AS n FROM rg GROUP BY 1, 2), m AS (SELECT g, max(n) AS n FROM c GROUP BY g),
t AS (SELECT id % 500 AS g, count(*) AS total FROM ref GROUP BY 1) SELECT g, total, coalesce(n, 0) AS best, coalesce(n, 0) / total AS completeness FROM t LEFT JOIN m USING (g)""")
def completeness(spark, sf):
    ref, tgt = _models(spark, sf)
    return M.completeness(ref.withColumn("g", F.col("id") % 500), tgt.withColumn("t", F.col("id") % 100), "g", "t")


@R.add(f"""WITH {_PAIRS}, n AS (SELECT id, b_id, count(*) AS n, sum(ovl)::BIGINT AS bases FROM pr GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, bases DESC, b_id) AS r,
 string_agg(b_id::VARCHAR, ',') OVER () AS z FROM n), l AS (SELECT id, string_agg(DISTINCT b_id::VARCHAR, ',' ORDER BY b_id::VARCHAR) AS every FROM n GROUP BY id)
SELECT r.id, b_id AS top, n, bases, every FROM r JOIN l USING (id) WHERE r = 1""")
def top_overlap(spark, sf):
    return M.top_overlap(*_models(spark, sf))


_ANN = f"""{L}, {O}, q AS (SELECT DISTINCT gid AS id, chr, st, ed, strand FROM iv_lineitem WHERE strand <> '.'), k AS (SELECT chr, st, ed, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand, kind FROM iv_orders),
f AS (SELECT q.*, (SELECT count(*) FROM k WHERE k.chr = q.chr AND k.st < q.ed AND q.st < k.ed AND k.strand = q.strand AND k.kind = 'O') AS me,
 (SELECT count(*) FROM k WHERE k.chr = q.chr AND k.st < q.ed AND q.st < k.ed AND k.strand = q.strand AND k.kind <> 'O') AS se,
 (SELECT count(*) FROM k WHERE k.chr = q.chr AND k.st < q.ed AND q.st < k.ed AND k.strand <> q.strand) AS opposite FROM q)"""


def _annotated(spark, sf):
    q = view(spark, sf, "iv_lineitem").filter("strand <> '.'").select(F.col("gid").alias("id"), "chr", "st", "ed", "strand").distinct()
    k = view(spark, sf, "iv_orders").select("chr", "st", "ed", F.expr("CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END").alias("strand"), (F.col("kind") == "O").alias("multi"))
    return M.annotate(q, k)


@R.add(f"WITH {_ANN} SELECT CASE WHEN me > 0 THEN 'k.me' WHEN se > 0 THEN 'k.se' ELSE 'u' END AS code, opposite > 0 AS antisense, count(*) AS n FROM f GROUP BY 1, 2")
def annotate_codes(spark, sf):
    return _annotated(spark, sf).groupBy("code", "antisense").agg(F.count("*").alias("n"))


@R.add(f"WITH {_ANN} SELECT id, bool_or(opposite > 0) AS antisense, bool_and(me + se + opposite = 0) AS intergenic FROM f GROUP BY id")
def antisense(spark, sf):
    return _annotated(spark, sf).groupBy("id").agg(F.bool_or("antisense").alias("antisense"), F.bool_and("intergenic").alias("intergenic"))


@R.add(f"""WITH {L}, {O}, p AS (SELECT DISTINCT a.chr, a.st, a.ed, b.kind AS k FROM (SELECT DISTINCT chr, st, ed FROM iv_lineitem) a LEFT JOIN iv_orders b ON a.chr = b.chr AND greatest(a.st - 10, 0) < b.ed AND b.st < a.ed + 10)
SELECT chr, st, ed, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '.(-1)') AS names FROM p GROUP BY 1, 2, 3""")
def overlap_names(spark, sf):
    at = view(spark, sf, "iv_lineitem").select("chr", "st", "ed").distinct()
    return M.overlap_names(at, view(spark, sf, "iv_orders").select("chr", "st", "ed", F.col("kind").alias("name")), expand=10)


@R.add(r"SELECT doc_id, len(regexp_extract_all(text, '[a-z]')) AS repbp FROM documents")
def lowercase_count(spark, sf):
    return M.lowercase_bases(table(spark, sf, "documents"), "doc_id", "text")


@R.add("SELECT doc_id, substr(text, 6, 20) AS seq FROM documents WHERE length(text) >= 25")
def sequence_slice(spark, sf):
    seq = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chr"), F.col("text").alias("seq"))
    at = seq.filter("length(seq) >= 25").select("chr", F.lit(5).cast("long").alias("st"), F.lit(25).cast("long").alias("ed"))
    return M.fetch_sequence(M.tile_sequence(seq, 8, within=(5, 25)), at, 8).select(F.col("chr").cast("long").alias("doc_id"), "seq")


@R.add(f"WITH {L}, {islands_sql('iv_lineitem', keys='gid')} SELECT gid, st, ed FROM isl WHERE n > 1")
def repeat_filter(spark, sf):
    return I.merge(view(spark, sf, "iv_lineitem"), ["gid"]).filter("n > 1").select("gid", "st", "ed")
