"""Exact top-k search by a three-phase uniform threshold (operator 2).

The score, an integer inner product, is a sum over blocks of dimensions; each block of
each partition of the rows is a node with its own list of partial scores per query.
Queries go out in blocks of bounded bytes, rows stay where they are.

1. Every node names its best entries by partial score. The whole scores of named entries
   alone are looked up; the k-th best of them over all nodes is a score that the answer
   can't fall below: the cutoff.
2. The cutoffs are broadcast with the queries. If all partial scores of an entry were
   below cutoff / blocks, their sum would be below the cutoff: every node collects its
   entries at or above that share. Rows whose length in a block can't reach the share for
   any query are left out before the product.
3. Collected entries that can still reach the cutoff, given their partial score and the
   lengths of the rest, are resolved exactly; those at or above the cutoff are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.llm.common import bound_batches, materialize
from locus_spark.plans.materialize import scratch

BLOCKS = 2
QUERY_BYTES = 16 << 20  # query vectors that are broadcast at once
STRIP = 64  # queries compared at once with a batch of rows
PAIRS = 1 << 15  # pairs resolved at once
HELD = 1 << 20  # hits that a task holds before it cuts them to the best k of each query
EXACT = 2.0**52  # sums of products below this don't round in doubles
ROUNDING = 2.0**-40  # of the product of two lengths: more than the rounding of a partial score

_HITS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, held at the bounds of 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(p, r)) for p, r in zip(q.tolist(), x.tolist())]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in sums], np.int64)


def parts(n: int) -> list[slice]:
    """The blocks of n dimensions."""
    edges = np.linspace(0, n, min(BLOCKS, max(1, n)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


class Asked:
    """A block of queries of one length, with their cutoffs (-inf: none)."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, v: np.ndarray, cutoff: np.ndarray):
        # Queries of like cutoffs share a strip.
        order = np.argsort(-cutoff, kind="stable")
        self.number, self.ids, self.v, self.cutoff = number[order], ids[order], v[order], cutoff[order]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))
    own = query[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def _name(asked: Asked, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phase 1: (query, row, whole score) of the entries that the nodes of a batch name."""
    for s in range(0, len(asked.v), STRIP):
        q, named = asked.v[s : s + STRIP], []
        for p in parts(x.shape[1]):
            local = q[:, p] @ x[:, p].T
            local[asked.ids[s : s + STRIP, None] == ids] = -np.inf
            most = min(k, len(x))
            named.append(np.argpartition(-local, most - 1, axis=1)[:, :most] if most else np.zeros((len(q), 0), int))
        i = np.repeat(np.arange(len(q)), sum(n.shape[1] for n in named))
        pairs = np.unique(np.stack([i, np.concatenate(named, 1).ravel()]), axis=1)
        i, j = pairs[:, ids[pairs[1]] != asked.ids[s + pairs[0]]]
        yield i + s, j, _resolve(q, x, i, j)


def _resolve(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = [dot(q[i[at : at + PAIRS]], x[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _collect(asked: Asked, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phases 2 and 3: (query, row, whole score) of all entries at or above the cutoffs."""
    cuts = parts(x.shape[1])
    long = np.stack([np.linalg.norm(x[:, p], axis=1) for p in cuts])
    wide = np.linalg.norm(x, axis=1)
    for s in range(0, len(asked.v), STRIP):
        q, cutoff = asked.v[s : s + STRIP], asked.cutoff[s : s + STRIP]
        share, size = cutoff / len(cuts), np.linalg.norm(q, axis=1)
        found = []
        for b, p in enumerate(cuts):
            own = np.linalg.norm(q[:, p], axis=1)
            slack = ROUNDING * size.max(initial=0) * wide
            # Rows too short in this block for every query of the strip are left out.
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(own > 0, share / own, np.where(share <= 0, -np.inf, np.inf)).min(initial=np.inf)
            rows = np.flatnonzero(long[b] * (1 + ROUNDING) + slack >= reach) if np.isfinite(reach) and reach > 0 else np.arange(len(x) if reach < np.inf else 0)
            local = q[:, p] @ x[rows][:, p].T
            i, at = np.nonzero(local + slack[rows] >= share[:, None])
            j, rest = rows[at], np.sqrt(np.maximum(size**2 - own**2, 0))
            left = np.sqrt(np.maximum(wide[j] ** 2 - long[b][j] ** 2, 0))
            near = local[i, at] + rest[i] * left + 2.0**-20 * size[i] * wide[j] + 1 >= cutoff[i]
            found.append(np.stack([i[near], j[near]]))
        i, j = np.unique(np.concatenate(found, 1), axis=1)
        other = ids[j] != asked.ids[s + i]
        i, j = i[other], j[other]
        score = _resolve(q, x, i, j)
        enough = score >= cutoff[i]
        yield i[enough] + s, j[enough], score[enough]


def _phase(asked: dict[int, Asked], k: int, second: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def best() -> list[np.ndarray]:
            query, ids, score, query_id = (np.concatenate(c) for c in zip(*held))
            take = _best(query, ids, score, k)
            return [query[take], ids[take], score[take], query_id[take]]

        for batch in batches:
            dims, ids = batch.column("dims").to_numpy(), batch.column("vec_id").to_numpy()
            for n in np.unique(dims).tolist():
                if n not in asked:
                    continue
                use, some = np.flatnonzero(dims == n), asked[n]
                x = np.asarray(batch.column("v").take(pa.array(use)).flatten(), float).reshape(len(use), n)
                for i, j, score in _collect(some, ids[use], x) if second else _name(some, ids[use], x, k):
                    held.append([some.number[i], ids[use][j], score, some.ids[i]])
                    size += len(i)
                    if size > HELD:
                        held[:] = [best()]
                        size = len(held[0][0])
                        if size > HELD // 2:  # many queries: the best of this much go on as they are
                            yield pa.RecordBatch.from_arrays([pa.array(held[0][c]) for c in (0, 3, 1, 2)], schema=_HITS)
                            held.clear()
                            size = 0
        if held:
            out = best()
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in (0, 3, 1, 2)], schema=_HITS)

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The k highest inner products of every query with all other rows.

    Components become floor(scale * x), x as double, held at the bounds of 64 bits.
    Returns (query_id long, rank int from 1, vec_id long, score long); ties go to the
    smaller vec_id; a query with fewer than k candidates has them all.

    Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part. Only vectors as long as the query are its candidates (empty ones score
    0). Every row is a candidate of its own, also if it repeats an id or a whole row; rows
    with the query's id are not its candidates. Every query row is answered by itself, so
    an id that is asked twice has its ranks twice. Scores beyond 64 bits are held at the
    nearest long. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(vectors)

    def ready(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
        df = df.filter("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
        return df.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double"))).withColumn("dims", F.size("v"))

    schema = "query long, query_id long, vec_id long, score long"
    by_query = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = None
    with scratch(spark) as keep:
        data = materialize(ready(vectors), "search-rows")
        asked = materialize(ready(queries).withColumn("number", F.monotonically_increasing_id()), "search-queries")
        size = asked.agg(F.sum(F.lit(8) * F.col("dims") + 64)).first()[0] or 0
        rounds = -(-size // QUERY_BYTES)
        for r in range(rounds):
            # About QUERY_BYTES of queries, by a hash of their numbers.
            block = asked.filter(F.pmod(F.xxhash64("number"), F.lit(rounds)) == r).toArrow()
            number, ids, dims = (block.column(c).to_numpy() for c in ("number", "vec_id", "dims"))
            cutoff = np.full(len(number), -np.inf)

            def broadcast() -> dict[int, Asked]:
                out = {}
                for n in np.unique(dims).tolist():
                    use = np.flatnonzero(dims == n)
                    v = np.asarray(block.column("v").combine_chunks().take(pa.array(use)).flatten(), float).reshape(len(use), n)
                    out[n] = Asked(number[use], ids[use], v, cutoff[use])
                return out

            first = data.mapInArrow(_phase(broadcast(), k, second=False), schema)
            kth = first.withColumn("rank", F.row_number().over(by_query)).filter(f"rank = {k}").select("query", "score").toArrow()
            # With fewer than k entries named there is no safe cutoff: everything is collected.
            at = {q: i for i, q in enumerate(number.tolist())}
            for q, score in zip(kth.column("query").to_pylist(), kth.column("score").to_pylist()):
                cutoff[at[q]] = np.nextafter(float(score), -np.inf) if abs(score) >= EXACT else score
                if score == -(1 << 63):
                    cutoff[at[q]] = -np.inf
            second = data.mapInArrow(_phase(broadcast(), k, second=True), schema)
            ranked = second.withColumn("rank", F.row_number().over(by_query).cast("int")).filter(f"rank <= {k}")
            ranked = keep(materialize(ranked.select("query_id", "rank", "vec_id", "score"), "search-answers"))
            answers = ranked if answers is None else answers.unionByName(ranked)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if answers is None else answers
