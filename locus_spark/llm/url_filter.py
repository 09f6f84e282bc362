"""URL filters: rules, and logistic regression on hashed character n-grams (operator 8).

Rules of host and path decide first, the longest that fits. For all other URLs a logistic
regression on the hashed 3- to 5-grams of host and path gives the probability that the
URL is to be blocked; it is trained from a small labelled URL table. Host, path and rule
are built-in expressions; only the regression runs in Python, on whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus_spark.llm.common import blocks, buffers, mix64
from locus_spark.llm.url_labels import labelled_urls

FEATURES = 1 << 14
GRAMS = (3, 4, 5)
MAX_RULES = 10_000  # rules travel with the plan; larger lists are refused

#: Fixed values: (action, host, path) rules, and the pattern of host and path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
PARTS = "://([^/?#]*)([^?#]*)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, A-Z lower-cased; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, action) of the longest rule that fits, of equal ones the first listed; else null."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, action: string>")
    listed = F.array(*(
        F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(-k).alias("turn"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action"))
        for k, (a, h, p) in enumerate(rules)
    ))
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    best = F.array_max(F.filter(listed, fits))
    return F.when((host != "") & best.isNotNull(), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["action"].alias("action")))


def shown(host: Column, path: Column) -> tuple[Column, Column]:
    """The texts whose n-grams count: the host with its ends marked, and the path, each run of digits as one."""
    return F.concat(F.lit("^"), host, F.lit("$")), F.regexp_replace(path, "[0-9]+", "0")


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed n-grams (bytes) of all rows, and their count per row."""
    n, keys = len(hosts), []
    for mark, texts in enumerate((hosts, paths)):
        raw, offsets = buffers(texts)
        row = np.repeat(np.arange(n), np.diff(offsets))
        h = np.full(len(raw), np.uint64(mark + 1))
        for k in range(max(GRAMS)):
            if k:
                h = h[:-1]
            if not len(h):
                break
            h = mix64(h * np.uint64(257) + raw[k:].astype(np.uint64))
            if k + 1 in GRAMS:
                inside = row[: len(h)] == row[k:]
                keys.append(row[: len(h)][inside] * FEATURES + (h[inside] % np.uint64(FEATURES)).astype(np.int64))
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys // FEATURES, keys % FEATURES, np.bincount(keys // FEATURES, minlength=n)


def probabilities(hosts: pa.Array, paths: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, on, count = features(hosts, paths)
    total = np.bincount(row, weights[on], len(hosts)) / np.sqrt(np.maximum(count, 1))
    return 1 / (1 + np.exp(-(total + bias)))


def fit(hosts: pa.Array, paths: pa.Array, labels: np.ndarray, penalty: float = 0.001, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the penalised log loss."""
    row, on, count = features(hosts, paths)
    used, column = np.unique(on, return_inverse=True)
    x = np.zeros((len(labels), len(used)))
    x[row, column] = 1 / np.sqrt(count[row])
    w, bias, speed, bias_speed = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(rounds if len(labels) else 0):
        ahead, bias_ahead = w + 0.9 * speed, bias + 0.9 * bias_speed
        gap = 1 / (1 + np.exp(-(x @ ahead + bias_ahead))) - labels
        speed = 0.9 * speed - 2.0 * (x.T @ gap / len(labels) + penalty / 10 * ahead)
        bias_speed = 0.9 * bias_speed - 2.0 * gap.mean()
        w, bias = w + speed, bias + bias_speed
    out = np.zeros(FEATURES)
    out[used] = w
    return out, float(bias)


def train(spark, labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """The regression of a labelled table, whose URLs are split like all others."""
    if not labelled:
        return np.zeros(FEATURES), 0.0
    table = spark.createDataFrame(labelled, "url string, label int")
    host, path = shown(host_of(F.col("url")), path_of(F.col("url")))
    got = table.select(host.alias("h"), path.alias("p"), "label").toArrow()  # as many rows as ``labelled``
    return fit(got.column("h").combine_chunks(), got.column("p").combine_chunks(), got.column("label").to_numpy().astype(float))


def _judge(keep: list[str], weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "_path"):
                p = probabilities(part.column("_host"), part.column("_path"), weights, bias)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p)], names=[*keep, "p_block"])

    return run


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    labelled: list[tuple[str, int]] | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Allow or block every URL, one row per row.

    Returns id_column, host, path, rule (host and path of the rule that decided, or
    null), verdict (``allow`` or ``block``), p_block (the regression's probability).
    ``labelled`` holds (url, 1 to block); it is small and stays on the driver; by default
    the table in ``url_labels``. Without any labelled URL every probability is 0.5.

    A null or empty URL, or one without ``://``, has an empty host and path, no rule and
    the regression's verdict on those. Repeated rows and null ids are judged like any
    row; other columns are ignored; an empty table gives no rows.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    weights, bias = train(pages.sparkSession, labelled_urls() if labelled is None else labelled)
    url = F.col(url_column).cast("string")
    rows = pages.select(F.col(id_column).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    host, path = shown(F.col("host"), F.col("path"))
    ruled = ruled.withColumns({"rule": F.col("_rule.rule"), "action": F.col("_rule.action"), "_host": host, "_path": path}).drop("_rule")
    keep = ["_id", "host", "path", "rule", "action"]
    kinds = ", ".join(f"`{c}` {ruled.schema[c].dataType.simpleString()}" for c in keep)
    judged = ruled.mapInArrow(_judge(keep, weights, bias), f"{kinds}, p_block double")
    verdict = F.coalesce("action", F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("_id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), "p_block")
