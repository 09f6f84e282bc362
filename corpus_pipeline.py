"""A corpus pipeline of five stages over ``documents``; each is written and read again.

Every stage takes texts, languages and sources that are null, empty or repeated, and
tables without rows; ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus_spark.llm.common import crc_mod, materialize
from locus_spark.llm.language_id import identify
from locus_spark.llm.ngram_join import drop_near_duplicates
from locus_spark.llm.packing import pack
from locus_spark.llm.secret_scan import redact_secrets
from locus_spark.llm.source_mixing import mix_sources
from locus_spark.plans.materialize import scratch

#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a missing ``lang`` becomes the predicted one.

    Documents without a letter, null texts among them, go. Columns called lang_pred,
    score or any other name play no part in the decision.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    own = {f"{c}_column": names[n] for c, n in (("id", "doc_id"), ("text", "text"), ("lang", "lang"))}
    found = identify(plain, train_rows=crc_mod(names["doc_id"], 4) != 2, keep=tuple(names.values()), **own)
    found = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred")).select(*(F.col(new).alias(c) for c, new in names.items()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows of other texts stay, whatever their id."""
    return drop_near_duplicates(docs, threshold=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global shuffle."""
    return mix_sources(docs, temperature=0.5, seed=17).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, window=2048, end_id=1)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express language ID, secret structure and tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; only the last stage's table stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for name, stage in STAGES:
            with scratch(spark) as keep_stage:
                out = keep_stage(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
            docs = out
        return keep(docs)
