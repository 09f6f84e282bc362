"""Statistics as column expressions and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.plans.ranking import rank_in_families, running


def p_adjust(df: DataFrame, p: str = "p", method: str = "BH", by: Sequence[str] = (), name: str = "padj", order: Sequence[str] = ()) -> DataFrame:
    """Adjusted p-values per group ``by``: holm, hochberg, hommel, bonferroni, BH, BY or none.

    Null and NaN are left out of the count and stay null. ``order`` breaks ties. Ranks and
    running extremes go by ranges, so one family may hold all rows (but for hommel, whose
    family is one task).
    """
    sound = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    other = df.filter(F.col(p).isNull() | F.isnan(p)).withColumn(name, F.lit(None).cast("double"))
    if method == "none":
        return sound.withColumn(name, F.col(p)).unionByName(other)
    if method == "hommel":
        return _hommel(sound, p, list(by), name).unionByName(other)
    ranked = rank_in_families(sound, by, [p, *order])
    x, n, r = F.col(p), F.col("_n"), F.col("_r")
    harmonic = F.expr("aggregate(sequence(1, cast(_n AS INT)), 0D, (acc, i) -> acc + 1D / i)")
    # (value, running least instead of greatest, upwards in p)
    steps = {
        "BH": (x * n / r, True, False), "fdr": (x * n / r, True, False), "BY": (x * n * F.col("_f") / r, True, False),
        "holm": ((n - r + 1) * x, False, True), "hochberg": ((n - r + 1) * x, True, False), "bonferroni": (x * n, None, None),
    }
    if method not in steps:
        raise ValueError(method)
    if method == "BY":
        ranked = ranked.join(ranked.select("_n").distinct().withColumn("_f", harmonic), "_n")
    value, least, upwards = steps[method]
    value = F.least(F.lit(1.0), value)
    out = ranked.withColumn(name, value) if least is None else running(ranked, by, value, name, least, upwards)
    return out.select(*df.columns, name).unionByName(other)


def hommel(p: Sequence[float]) -> list[float]:
    """Hommel's adjusted values of one family."""
    import numpy as np

    x = np.asarray(p, float)
    n = len(x)
    order = np.argsort(x, kind="stable")
    s, rank = x[order], np.empty(n, int)
    rank[order] = np.arange(n)
    best = np.full(n, np.min(n * s / np.arange(1, n + 1)) if n else 1.0)
    now = best.copy()
    for m in range(n - 1, 1, -1):
        cut = n - m + 1
        tail = np.min(m * s[cut:] / np.arange(2, m + 1))
        now[:cut] = np.minimum(m * s[:cut], tail)
        now[cut:] = now[n - m]
        best = np.maximum(best, now)
    return np.minimum(np.maximum(best, s), 1.0)[rank].tolist()


def _hommel(ranked: DataFrame, p: str, by: list[str], name: str) -> DataFrame:
    columns = ranked.columns

    def one(pdf):
        return pdf[columns].assign(**{name: hommel(pdf[p])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*columns).schema.fields) + f", `{name}` double"
    return ranked.withColumn("_family", F.lit(1)).groupBy(*(by or ["_family"])).applyInPandas(one, schema)


def fisher_combined(p: Column, two_tailed: bool = False) -> Column:
    """Aggregate: Fisher's combined p of a group, by the closed form for even degrees of freedom.

    A sum of Poisson terms by their logarithms: exp(-half) and the powers of half leave the
    range of doubles in groups of some hundred values.
    """
    q = p / 2 if two_tailed else p
    half, n = -F.sum(F.log(q)), F.count(p)
    log_half = F.log(half)
    total = F.aggregate(
        F.sequence(F.lit(1), n.cast("int") - 1), F.struct(F.lit(0.0).alias("f"), F.exp(-half).alias("s")),
        lambda acc, i: F.struct((acc["f"] + F.log(i.cast("double"))).alias("f"), (acc["s"] + F.exp(-half + i * log_half - (acc["f"] + F.log(i.cast("double"))))).alias("s")), lambda acc: acc["s"],
    )
    total = F.when((n == 1) | (half == 0), F.exp(-half)).otherwise(total)
    total = F.when(F.min(q) == 0, F.lit(0.0)).otherwise(total)  # log(0) is null, which a sum leaves out
    return F.when(n > 0, F.least(F.lit(1.0), total * 2 if two_tailed else total))


def log_factorials(spark, most: int) -> DataFrame:
    """(k, lf): the logarithms of 0! .. most!, by a running sum over ``most`` + 1 rows."""
    ks = spark.range(most + 1).withColumnRenamed("id", "k")
    return ks.withColumn("lf", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)))


def hypergeometric(hits: str, draws: str, marked: str, total: str) -> Column:
    """Upper tail P(X >= hits) of ``draws`` from ``total`` with ``marked``, as a column.

    The first term's logarithm comes from sums of logs; later terms from ratios.
    """
    first = f"""aggregate(sequence(1, cast({hits} AS INT)), 0D, (acc, i) -> CASE WHEN {hits} = 0 THEN 0D ELSE
        acc + ln({marked} - {hits} + i) - ln(i) END)
      + aggregate(sequence(1, cast(greatest({draws} - {hits}, 1) AS INT)), 0D, (acc, i) -> CASE WHEN {draws} = {hits} THEN 0D ELSE
        acc + ln({total} - {marked} - ({draws} - {hits}) + i) - ln(i) END)
      - aggregate(sequence(1, cast({draws} AS INT)), 0D, (acc, i) -> acc + ln({total} - {draws} + i) - ln(i))"""
    tail = f"""aggregate(sequence(cast({hits} AS INT), cast(least({draws}, {marked}) AS INT)), named_struct('t', 1D, 's', 0D), (acc, k) -> named_struct(
        't', acc.t * ({marked} - k) * ({draws} - k) / ((k + 1D) * ({total} - {marked} - {draws} + k + 1)), 's', acc.s + acc.t), acc -> acc.s)"""
    return F.expr(f"CASE WHEN {hits} = 0 THEN 1D WHEN {hits} > least({draws}, {marked}) THEN 0D ELSE least(1D, exp({first}) * {tail}) END")


def enrichment(terms: DataFrame, selected: DataFrame, term: str = "term", member: str = "id") -> DataFrame:
    """Per term: n0 selected members of n1, of ``num`` selected among ``tot``, tail p and odds."""
    pairs = terms.select(member, term).distinct()
    chosen = selected.select(member).distinct().withColumn("_s", F.lit(1))
    tot = pairs.select(member).distinct().join(chosen, member, "left").agg(F.count("*").alias("tot"), F.count("_s").alias("num"))
    out = pairs.join(chosen, member, "left").groupBy(term).agg(F.count("_s").alias("n0"), F.count("*").alias("n1")).join(F.broadcast(tot))
    out = out.withColumn("p", hypergeometric("n0", "num", "n1", "tot"))
    return out.withColumn("odds", F.expr("try_divide(n0 * tot, cast(n1 AS DOUBLE) * num)"))


def binned_mean(df: DataFrame, x: str, y: str, size: int, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Means of bins of ``size`` rows, from the largest x down: bin, avgx, avgy, minx, maxx, cnt."""
    ranked = rank_in_families(df, by, [x, *order])
    out = ranked.withColumn("bin", F.expr(f"(_n - _r) div {size}"))
    return out.groupBy(*by, "bin").agg(F.avg(x).alias("avgx"), F.avg(y).alias("avgy"), F.min(x).alias("minx"), F.max(x).alias("maxx"), F.count("*").alias("cnt"))


def auc(binned: DataFrame) -> DataFrame:
    """Trapezoid area under a binned curve over its range of x; the last bin falls to 0."""
    after = F.coalesce(F.lead("avgy").over(W.orderBy("bin")), F.lit(0.0))
    area = binned.withColumn("_a", (F.col("maxx") - F.col("minx")) * (F.col("avgy") + after) / 2)
    return area.agg(F.try_divide(F.sum("_a"), F.max("maxx") - F.min("minx")).alias("auc"))


def cv_noise(df: DataFrame, gene: str, group: str, value: str, cv: float = 0.9, mean: float = 3) -> DataFrame:
    """Per gene whether any group has a coefficient of variation up to ``cv`` and a mean above ``mean``."""
    stats = df.groupBy(gene, group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    ok = F.coalesce((F.try_divide("_s", "_m") <= cv) & (F.col("_m") > mean), F.lit(False))
    return stats.groupBy(gene).agg(F.bool_or(ok).alias("signal"))


def specificity(df: DataFrame, gene: str, group: str, value: str, targets: Sequence[str], least: float = 1.0) -> DataFrame:
    """Per gene: mean difference of log2 group means between target and other groups, minus the
    mean difference among targets, both over the largest difference of the gene."""
    mean = df.groupBy(gene, group).agg(F.avg(F.log2(F.col(value) + 1)).alias("m"))
    held = mean.groupBy(gene).agg(F.array_sort(F.collect_list(F.struct(group, "m"))).alias("g"), F.max("m").alias("_x")).filter(F.col("_x") > F.log2(F.lit(least + 1)))
    inside = " OR ".join(f"x.{group} = '{t}'" for t in targets)
    held = held.withColumn("_in", F.expr(f"filter(g, x -> {inside})")).withColumn("_out", F.expr(f"filter(g, x -> NOT ({inside}))"))
    total = "aggregate(flatten(transform({a}, x -> transform({b}, y -> abs(x.m - y.m)))), 0D, (acc, v) -> acc + v)"
    most = F.expr("array_max(flatten(transform(g, x -> transform(g, y -> abs(x.m - y.m)))))")
    held = held.withColumns({"_d": most, "_b": F.expr(total.format(a="_in", b="_out")), "_w": F.expr(total.format(a="_in", b="_in")), "_p": F.size("_in"), "_q": F.size("_out")})
    between = F.try_divide(F.col("_b"), F.col("_p") * F.col("_q") * F.col("_d"))
    within = F.coalesce(F.try_divide(F.col("_w"), F.col("_p") * (F.col("_p") - 1) * F.col("_d")), F.lit(0.0))
    return held.select(gene, F.coalesce(between, F.lit(0.0)).alias("between"), within.alias("within"), (F.coalesce(between, F.lit(0.0)) - within).alias("score"))


def absmax(value: str) -> Column:
    """Aggregate: the value of largest magnitude; of equal ones the larger."""
    return F.max_by(value, F.struct(F.abs(value), F.col(value)))


def remove_duplicates(df: DataFrame, symbol: str, p: str, lfc: str, member: str) -> DataFrame:
    """One row per symbol: combined p, lfc of largest magnitude, member of the smallest p, all members, size."""
    return df.groupBy(symbol).agg(
        fisher_combined(F.col(p)).alias("p"), absmax(lfc).alias("lfc"), F.min_by(member, F.struct(p, member)).alias("best"),
        F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"), F.count("*").alias("size"))


def top_n_other(df: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The n labels of largest value, and the rest summed as ``other``."""
    total = df.groupBy(label).agg(F.sum(value).alias(value))
    top = total.orderBy(F.desc(value), label).limit(n)
    rest = total.join(F.broadcast(top.select(label)), label, "left_anti").agg(F.lit("other").alias(label), F.sum(value).alias(value))
    return top.unionByName(rest)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """tp, fp, fn, tn, sensitivity and specificity."""
    t, g = F.col(truth), F.col(guess)
    out = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    return out.withColumns({"sensitivity": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))})


def logistic(intercept: float, weights: dict[str, float]) -> Column:
    """Probability of a logistic model with fixed weights."""
    z = F.lit(intercept)
    for column, w in weights.items():
        z = z + F.lit(w) * F.col(column)
    return 1 / (1 + F.exp(-z))
