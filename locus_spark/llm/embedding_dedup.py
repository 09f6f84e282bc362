"""Embedding near-dedup by a subspace pigeonhole join (operator 1).

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks of eight
dimensions. A pair within squared distance D = 2 - 2t (cosine t) is within its share
D * (dimensions of the block) / (dimensions) in at least one block, or the shares would
not add up. Every block is joined on its own: space is cut into slabs along the block's
first coordinate, a vector is at home in one slab and visits those that its radius
touches, and the pairs of a slab are tested on the block's eight coordinates. Pairs
within the share are verified on the whole original vectors, in double precision.

Equal vectors of a label are one class. A slab of many rows is dealt out in tiles. A
tile returns link counts and a spanning forest of its links, not pairs; a pair that
qualifies in several blocks counts in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.llm.common import forest, link_report, materialize, tiled, whole_groups
from locus_spark.plans.materialize import broadcast_if_small, scratch

BLOCK = 8  # dimensions of a block
TILE = 8192  # rows of a chunk of a slab
SLACK = 1e-5  # added to every radius: candidates are found in single precision, and decided with half of it
TURN = 256  # rows rotated at once


def rotation(n: int) -> np.ndarray:
    """A fixed random rotation of n dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def spans(n: int) -> list[tuple[int, int]]:
    return [(k, min(n, k + BLOCK)) for k in range(0, n, BLOCK)]


def shares(n: int, threshold: float) -> np.ndarray:
    """Squared distance that each block may use, in proportion to its dimensions."""
    return (2 - 2 * threshold) * np.array([(b - a) / n for a, b in spans(n)]) + SLACK


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _turn(x: np.ndarray) -> np.ndarray:
    """Unit rows, rotated in blocks of one shape, so that a row's values do not depend on the rows beside it."""
    padded = np.zeros((-(-len(x) // TURN) * TURN, x.shape[1]))
    padded[: len(x)] = x
    turn = rotation(x.shape[1])
    return np.concatenate([padded[s : s + TURN] @ turn for s in range(0, len(padded), TURN)])[: len(x)]


def _within(turned: np.ndarray, p: np.ndarray, q: np.ndarray, part: tuple[int, int], most: float) -> np.ndarray:
    """Whether pairs are in a block's budget: every block decides this alike, in double precision."""
    away = turned[p, part[0] : part[1]] - turned[q, part[0] : part[1]]
    away *= away
    return sum(away[:, c] for c in range(away.shape[1])) <= most - SLACK / 2


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in single precision where that loses nothing."""
    short = x.astype(np.float32)
    return [(s if (s == row).all() else row).tobytes() for s, row in zip(short, x)]


def _unpack(rows: list[bytes], n: int) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * n else np.float64) for r in rows], float).reshape(-1, n)


def _places(threshold: float, carry: bool):
    """(class, label, copies, dims, v) to the slabs a vector is compared in: label, dims,
    block, slab, and with ``carry`` also class, copies, home and the packed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for n in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == n))
                x = np.asarray(part.column("v").flatten()).reshape(-1, n)
                turned, every = _unit(x) @ rotation(n), np.arange(len(x))
                rows, block, slab, home = [], [], [], []
                for k, ((at, _), share) in enumerate(zip(spans(n), shares(n, threshold))):
                    r = np.sqrt(share)
                    own, low = np.floor(turned[:, at] / (2 * r)).astype(np.int64), np.floor((turned[:, at] - r) / (2 * r)).astype(np.int64)
                    # A pair meets in the slab of its lower coordinate: the other only visits downwards.
                    for place, at_home, use in ((own, 1, every), (low, 0, np.flatnonzero(low < own))):
                        rows.append(use)
                        slab.append(place[use])
                        block.append(np.full(len(use), k))
                        home.append(np.full(len(use), at_home))
                take = pa.array(np.concatenate(rows))
                columns = [part.column("label").take(take), part.column("dims").take(take), pa.array(np.concatenate(block), pa.int32()), pa.array(np.concatenate(slab))]
                names = ["label", "dims", "block", "slab"]
                if carry:
                    columns += [part.column("class").take(take), part.column("copies").take(take), pa.array(np.concatenate(home), pa.int32()), pa.array(_pack(x), pa.binary()).take(take)]
                    names += ["class", "copies", "home", "v"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _join(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["label", "dims", "block", "slab", "one", "two"], 4 << 20):
            all_ids, all_copies, all_sides, all_home, block, dims = (table.column(c).to_numpy() for c in ("class", "copies", "side", "home", "block", "dims"))
            vectors = table.column("v")
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                n, k = int(dims[lo]), int(block[lo])
                ids, copies, side, home = all_ids[lo:hi], all_copies[lo:hi], all_sides[lo:hi], all_home[lo:hi]
                x = _unit(_unpack(vectors.slice(lo, hi - lo).to_pylist(), n))
                turned = _turn(x)
                parts, most = spans(n), shares(n, threshold)
                a, b = parts[k]
                own = turned[:, a:b].astype(np.float32)
                square = (own * own).sum(1)
                one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                if not len(one) or not len(two):
                    continue
                links, root = np.zeros(len(ids)), np.arange(len(ids))
                strip = max(1, (1 << 20) // len(two))  # a million pairs at most are held at once
                for s in range(0, len(one), strip):
                    rows = one[s : s + strip]
                    i, j = np.nonzero(square[rows, None] + square[two] - 2 * (own[rows] @ own[two].T) <= most[k] + SLACK)
                    i, j = rows[i], two[j]
                    # Visitors meet each other at home, not here; in one chunk each pair shows up twice.
                    use = ((home[i] | home[j]) > 0) & ((i < j) | (side[i] != 2) | (side[j] != 2))
                    i, j = i[use], j[use]
                    good = np.zeros(len(i), bool)
                    for at in range(0, len(i), 1 << 15):
                        p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                        first = _within(turned, p, q, parts[k], most[k])
                        for e in range(k):  # an earlier block has this pair already
                            first &= ~_within(turned, p, q, parts[e], most[e])
                        good[at : at + (1 << 15)] = first & (np.einsum("ij,ij->i", x[p], x[q]) >= threshold)
                    i, j = i[good], j[good]
                    if len(i):
                        links += np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
                        root = forest(len(ids), i, j, root)
                hit = np.flatnonzero(links)
                if not len(hit):
                    continue
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, root, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(least[root[hit]])], schema=_LINKS)

    return run


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = 0.98
) -> DataFrame:
    """Link vectors of equal label whose cosine is at least ``threshold``; one row per input row.

    Returns (id_column, n_links long, component_id long, kept boolean).

    A vector that is null, empty, zero or holds null or non-finite components, and one
    whose label is null, links with nothing; so do vectors of different lengths. A row
    with a null id links with nothing and has a null component. Repeated rows link with
    each other like any equal vectors; those with the smallest id are all kept. If
    different vectors share an id, each is compared, their links add up under the id. An
    empty table gives an empty result; other columns are ignored.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.col(label_column).alias("label"))
    sound = F.expr(
        "id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND exists(v, x -> x <> 0)"
        " AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    # Rows find their class by label and 128 bits of hashes, so that vectors are shuffled once.
    rows = rows.withColumn("label", F.when(sound, F.col("label"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(17), "v")})
    keys = ["label", "h1", "h2"]
    place = ["label", "dims", "block", "slab"]
    kind = vectors.schema[label_column].dataType.simpleString()
    places = f"label {kind}, dims int, block int, slab long"
    with scratch(vectors.sparkSession) as keep:
        classes = rows.filter("label IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
        classes = materialize(classes.withColumns({"dims": F.size("v"), "class": F.monotonically_increasing_id()}), "vector-classes")
        carried = classes.select("class", "label", "copies", "dims", "v")
        # The keys of large slabs first, without vectors; then one shuffle brings the vectors to their tiles.
        counts = carried.mapInArrow(_places(threshold, carry=False), places).groupBy(*place).agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
        large = materialize(counts.filter("chunks > 1"), "large-slabs")
        placed = carried.mapInArrow(_places(threshold, carry=True), f"{places}, class long, copies long, home int, v binary")
        dealt = placed.join(broadcast_if_small(large, 64), place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        tile = [*place, "one", "two"]
        dealt = tiled(dealt, "chunks", "class").select(*tile, "side", "class", "copies", "home", "v").repartition(*tile).sortWithinPartitions(*tile)
        found = materialize(dealt.mapInArrow(_join(threshold), "id long, links long, root long"), "vector-links")

        counted = found.groupBy("id").agg(F.sum("links").alias("links"))
        known = classes.join(counted, classes["class"] == counted["id"], "left").select(*keys, "class", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"))
        stars = found.select(F.col("id").alias("src"), F.col("root").alias("dst"))
        return keep(materialize(link_report(rows.select("id", *keys), known, stars, keys, id_column), "linked-vectors"))
