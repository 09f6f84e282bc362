"""Quality classifier by nearest-neighbour voting (operator 7).

A text's terms are hashed words, hashed trigrams of byte classes (letter kinds, digits,
white space and every ASCII mark of its own) and the shares of words that repeat the word
before. Latent semantic vectors are the leading singular directions of the weighted terms of a bounded
sample of labelled texts. The sample's vectors and labels go to every task; each document
takes the exact cosine with all of them, in blocks, and its ``neighbours`` nearest vote
with their label, weighted by similarity. Similarities are taken to five decimals; of
equal ones the text that comes first by id is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.llm.common import blocks, bound_batches, buffers, mix64
from locus_spark.plans.materialize import broadcast_if_small

TERMS = 1024  # hashed trigrams
EXTRA = 8  # terms for repeated words
LEXICON = 1024  # hashed words
WIDTH = TERMS + EXTRA + LEXICON
RANK = 32
MAX_LABELS = 4096  # labelled texts in the sample; their vectors take 0.5 MB
NEIGHBOURS = 25
SHARPNESS = 8  # similarity counts to this power

_CLASS = np.zeros(256, np.int64)
_CLASS[[9, 10, 11, 12, 13]], _CLASS[32] = 1, 2
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 3, 4, 5, 6
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_MARKS] = np.arange(7, 7 + len(_MARKS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x terms; all bytes of every text count."""
    docs, width = len(offsets) - 1, WIDTH
    out = np.zeros(docs * width)
    n = len(raw)
    if n >= 3:
        kinds = _CLASS[raw]
        gram = (kinds[:-2] * 64 + kinds[1:-1]) * 64 + kinds[2:]
        bucket = (mix64(gram.astype(np.uint64)) % np.uint64(TERMS)).astype(np.int64)
        doc = np.repeat(np.arange(docs), np.diff(offsets))
        inside = doc[:-2] == doc[2:]
        out += np.bincount(doc[:-2][inside] * width + bucket[inside], minlength=docs * width)
    counts = out.reshape(docs, width)
    # Words by a sum of mixed bytes and places, equal for equal words; repeats of the one or two before.
    if n:
        solid = ~_WHITE[raw]
        before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
        cuts = offsets[:-1][offsets[:-1] < n]
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
        first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        if len(first):
            place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))[: n] if first[0] == 0 else None
            if place is None:
                place = np.arange(n) - np.concatenate([np.zeros(first[0], np.int64), np.repeat(first, np.diff(np.append(first, n)))])
            value = mix64((_LOWER[raw].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
            value[~solid] = 0
            sums = np.concatenate([[0], np.cumsum(value)]).astype(np.uint64)
            word, home = sums[last] - sums[first], np.searchsorted(offsets, first, "right") - 1
            total = np.bincount(home, minlength=docs)
            slot = home * LEXICON + (mix64(word) % np.uint64(LEXICON)).astype(np.int64)
            counts[:, TERMS + EXTRA :] = np.bincount(slot, minlength=docs * LEXICON).reshape(docs, LEXICON)
            for lag in (1, 2):
                same = (word[lag:] == word[:-lag]) & (home[lag:] == home[:-lag])
                repeated = np.bincount(home[lag:][same], minlength=docs)
                share = repeated / np.maximum(total, 1)
                for k, level in enumerate((0.02, 0.1, 0.3, 0.6)):
                    counts[:, TERMS + 4 * (lag - 1) + k] = np.where(share > level, total, 0)
    return counts


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    size = np.maximum(counts[:, :TERMS].sum(1, keepdims=True), 1)
    x = np.log1p(1000 * counts / size) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Voters:
    """Labelled latent vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.idf = (np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1)) + 0.2).astype(np.float32)
        x = _weighted(counts, self.idf)
        # Leading right singular directions of the sample, by subspace iteration.
        rng = np.random.default_rng(5)
        basis = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + 8, x.shape[1]))))[0].astype(np.float32)
        for _ in range(6):
            basis = np.linalg.qr(x.T @ (x @ basis))[0].astype(np.float32)
        u, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
        del u
        self.basis = (basis @ vt.T)[:, :rank].astype(np.float32)
        self.vectors, self.labels = self.project(counts), labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = _weighted(counts, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        z, out = self.project(counts), np.full(len(counts), self.prior)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(z), 512):
            near = z[at : at + 512] @ self.vectors.T
            close = np.rint(near.astype(float) * 1e5)
            order = np.arange(len(self.labels)) - close * len(self.labels)  # by similarity, then id
            best = np.argpartition(order, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(close, best, 1) / 1e5, 0) ** SHARPNESS
            total = weight.sum(1)
            got = (weight * self.labels[best]).sum(1) / np.maximum(total, 1e-300)
            out[at : at + 512] = np.where(total > 0, np.minimum(got, 1.0), self.prior)
        out[counts.sum(1) == 0] = self.prior
        return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            counts = term_counts(*buffers(part.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([c.tobytes() for c in counts], pa.binary())], names=["id", "label", "counts"]
            )


def _vote(voters: Voters | None, keep: list[str], neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "_text", 2 << 20):
                score = np.concatenate([
                    np.full(n.num_rows, 0.5) if voters is None else voters.score(term_counts(*buffers(n.column("_text"))), neighbours)
                    for n in (part.slice(at, 500) for at in range(0, part.num_rows, 500))
                ])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, max_labels: int = MAX_LABELS) -> Voters | None:
    """Voters from at most ``max_labels`` labelled documents, those of the smallest id hashes."""
    rows = labels.filter(f"`{id_column}` IS NOT NULL AND `{label_column}` IN (0, 1)").groupBy(F.col(id_column).alias("i")).agg(F.min(label_column).cast("int").alias("label"))
    chosen = rows.orderBy(F.xxhash64("i"), "i").limit(max_labels)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter("text IS NOT NULL")
    # One text of an id: of several the one with the smallest digest.
    found = texts.join(broadcast_if_small(chosen, 16, max_labels), F.expr("id = i"))
    found = found.groupBy("id").agg(F.min("label").alias("label"), F.min(F.struct(F.md5("text").alias("d"), "text"))["text"].alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    got = found.mapInArrow(_features, f"id {kind}, label int, counts binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("id")
    counts = np.frombuffer(b"".join(got["counts"]), np.float32).reshape(len(got), WIDTH).astype(float)
    return Voters(counts, got["label"].to_numpy())


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    threshold: float = 0.3,
    max_labels: int = MAX_LABELS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """Score every whole text by the labels of its nearest labelled texts, one row per row.

    Returns id_column, score (0 to 1, the weighted share of label 1), predicted int (1 if
    the score reaches ``threshold``). Labels other than 0 and 1 and null ids are not
    learned from; of several labels of an id the smallest counts, of several texts the one
    with the smallest digest.

    A null text is empty; an empty text, or one unlike all labelled ones, has the share
    of label 1 in the sample. Without any labelled text every score is 0.5. Repeated rows
    and null ids are scored like any row; other columns are ignored; an empty table gives
    no rows.
    """
    bound_batches(docs)
    voters = train(docs, labels, id_column, text_column, label_column, max_labels)
    rows = docs.select(id_column, F.col(text_column).cast("string").alias("_text"))
    kind = rows.schema[id_column].dataType.simpleString()
    scored = rows.mapInArrow(_vote(voters, [id_column], neighbours), f"`{id_column}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


