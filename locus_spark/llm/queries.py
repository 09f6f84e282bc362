"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus_spark.llm.common import crc_mod
from locus_spark.llm.embedding_dedup import near_vectors
from locus_spark.llm.language_id import identify
from locus_spark.llm.license_scan import scan_licenses
from locus_spark.llm.ngram_join import near_duplicates
from locus_spark.llm.packing import pack
from locus_spark.llm.quality_vote import score_quality
from locus_spark.llm.secret_scan import find_secrets
from locus_spark.llm.source_mixing import mix_sources, mix_sql
from locus_spark.llm.topk_search import top_k
from locus_spark.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024.0)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), temperature=0.5, seed=17)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod("doc_id", 4)
    found = identify(_table(spark, sf_dir, "documents"), train_rows=part != 2)
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), window=2048, end_id=1)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op7_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod("doc_id", 5)
    labels = _table(spark, sf_dir, "labels").filter(part != 0)
    found = score_quality(_table(spark, sf_dir, "documents"), labels, threshold=0.3)
    return found.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_topk_search, op3_source_mixing, op4_language_id, op5_packing,
        op6_secret_scan, op7_quality_vote, op8_url_filter, op9_ngram_join, op10_license_scan,
    )
}

_REACH = """
reach AS (SELECT DISTINCT x, x AS y FROM pair UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x),
found AS (SELECT x, min(y) AS component FROM reach GROUP BY x),
linked AS (SELECT x, count(*) AS n FROM pair GROUP BY x)
SELECT t.{id}, coalesce(linked.n, 0)::BIGINT AS n_links, coalesce(found.component, t.{id}) AS component_id,
       coalesce(found.component, t.{id}) = t.{id} AS kept
FROM {table} t LEFT JOIN found ON found.x = t.{id} LEFT JOIN linked ON linked.x = t.{id}"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
""" + _REACH.format(id="vec_id", table="embeddings"),
    "op2_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_source_mixing": mix_sql(temperature=0.5, seed=17),
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pair AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c / (p.n + q.n - c)::DOUBLE >= 0.8),
""" + _REACH.format(id="doc_id", table="documents"),
}
