"""Mixing sources to target weights by Poisson replication (operator 3).

A source with n documents and target weight w out of a total W gets the mean repetition
rate ``size * w / (W * n)``. A document's uniform number comes from a hash of seed and
id; inverting the Poisson distribution of its source at that number gives its count. The
document is exploded by its count and all copies are shuffled globally by a hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.llm.common import materialize
from locus_spark.plans.materialize import broadcast_if_small


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = 0.5,
    size: int | None = None,
    seed: int = 17,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with copy_no (from 1) and shuffle_key, each row repeated by its Poisson count.

    weights: a table (source, weight) with non-negative weights; a source that it lacks
    weighs nothing. Without it, a source weighs its document count to the power
    ``temperature``. ``size`` is the expected number of documents; by default as many as
    there are. Rows are in the order of shuffle_key.

    A null source is a source of its own, called by null. A row's number hangs on seed and
    id alone, so rows that share an id are repeated equally; a row without an id draws by
    its text. Rows of one shuffle_key are ordered by source and text. An empty table gives
    no rows. A column of the input called copy_no or shuffle_key is replaced; others may
    have any names.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")) if text_column in docs.columns else F.lit("")
    key = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit(":"), text))
    # Columns are numbered for a while, so that no name clashes.
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select("*", F.col(source_column).cast("string").alias("s"), key.alias("key"), F.xxhash64(text).alias("tie")).toDF(*names, "s", "key", "tie")
    counts = rows.groupBy("s").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").cast("string").alias("given")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
        weighed = counts.join(given, F.expr("s <=> given"), "left").select("s", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = materialize(weighed, "source-weights")
    total = weighed.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    wanted = float(size if size is not None else total["n"] or 0)
    rated = weighed.withColumn("rate", F.col("w") * F.lit(wanted) / (F.lit(float(total["w"] or 1)) * F.col("n"))).filter("rate > 0")
    # The distribution function of a source up to where no number in (0, 1) lies above it.
    steps = rated.withColumn("k", F.explode(F.expr("sequence(0, cast(ceil(rate + 12 * sqrt(rate) + 40) AS INT))")))
    so_far = W.partitionBy("s").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    log = F.sum(F.when(F.col("k") > 0, F.log("rate") - F.log(F.col("k").cast("double"))).otherwise(0.0)).over(so_far)
    summed = steps.withColumn("p", F.exp(log - F.col("rate"))).withColumn("c", F.sum("p").over(so_far))
    table = summed.groupBy(F.col("s").alias("source")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))
    table = materialize(table, "source-counts")
    width = table.agg(F.sum(F.size("cdf") * 8 + 64)).first()[0] or 0
    drawn = rows.join(broadcast_if_small(table, 1, width), F.expr("source <=> s"))
    drawn = drawn.withColumn("u", uniform(seed, F.col("key")))
    out = drawn.withColumn("times", F.expr("cast(size(filter(cdf, c -> c < u)) AS INT)")).filter("times > 0").withColumn("copy_no", F.explode(F.expr("sequence(1, times)")))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"shuffle-{seed}"), "key", F.col("copy_no").cast("string"))))
    return out.orderBy("shuffle_key", "s", "tie").select(*(F.col(n).alias(c) for n, c in names.items()), "copy_no", "shuffle_key")


def mix_sql(temperature: float = 0.5, seed: int = 17) -> str:
    """DuckDB SQL of ``mix_sources(documents)``, without the order."""
    return f"""
WITH n AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT s, pow(n::DOUBLE, {temperature}) * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT sum(pow(n::DOUBLE, {temperature})) FROM n) * n) AS rate FROM n),
k AS (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r),
l AS (SELECT s, k, exp(sum(CASE WHEN k > 0 THEN ln(rate) - ln(k::DOUBLE) ELSE 0 END) OVER (PARTITION BY s ORDER BY k) - rate) AS p FROM k),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM l),
u AS (SELECT *, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, ':' || coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
t AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM c WHERE c.s IS NOT DISTINCT FROM u.source AND c.cdf < u.u) AS times FROM u),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INTEGER AS copy_no FROM t)
SELECT *, md5('shuffle-{seed}:' || coalesce(doc_id::VARCHAR, ':' || coalesce(text, '')) || ':' || copy_no::VARCHAR) AS shuffle_key FROM e"""
