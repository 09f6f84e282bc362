"""What several of the operators share: text buffers, hashes, row keys and links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus_spark.operators.graph import connected_components
from locus_spark.plans.materialize import broadcast_if_small, materialize

#: Python works through a batch in blocks of about so many bytes of text.
BLOCK_BYTES = 1 << 20

#: Rows of text that go to Python at once, at most.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows: whole texts fill larger ones with
    tens of MB, in the executor and in Python. Results don't hang on it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``most`` bytes of text each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield batch.slice(first)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.expr(f"crc32(cast({doc_id} AS STRING)) % {n}")


def forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The root (smallest index) of each of n nodes under the links i - j, and those behind ``root``."""
    root = np.arange(n) if root is None else root.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 8 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by ``keys``, and the cuts between groups.

    About ``most`` bytes are held, or one group if it is larger. Keys are compared as they
    are, not by a hash.
    """
    held: list = []
    size, enough = 0, most

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table) - 1, bool)
        for key in keys:
            column = table.column(key).combine_chunks()
            new |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= enough:
            table = pa.concat_tables(held).combine_chunks()
            cuts = cut(table)
            if cuts[-2]:
                yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
                table = table.slice(cuts[-2]).combine_chunks()
            held, size = [table], table.nbytes
            enough = max(most, 2 * size)
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield table, cut(table)


def tiled(df: DataFrame, chunks: str, salt: str) -> DataFrame:
    """Deal a group of several chunks out to all pairs of chunks.

    (one, two) names the pair within the group; side is 0 or 1 for the first or second
    chunk, 2 if both are one.
    """
    own = F.pmod(F.xxhash64(salt), F.col(chunks)).cast("int")
    df = df.withColumn("_own", own).withColumn("_other", F.explode(F.expr(f"sequence(0, cast({chunks} AS INT) - 1)")))
    return df.select(
        "*",
        F.least("_own", "_other").alias("one"),
        F.greatest("_own", "_other").alias("two"),
        F.expr("CASE WHEN _own = _other THEN 2 WHEN _own < _other THEN 0 ELSE 1 END").alias("side"),
    ).drop("_own", "_other")


def component_ids(members: DataFrame, stars: DataFrame) -> DataFrame:
    """``members`` (class, least, ...) with component, the class that stands for all that are
    linked, and component_id, the smallest ``least`` among them.

    stars: (src, dst) edges between classes that join every linked pair.
    """
    found = connected_components(stars, "src", "dst")
    linked = members.join(found, members["class"] == found["node"], "left").withColumn("component", F.coalesce("component", "class")).drop("node")
    several = found.join(members, members["class"] == found["node"]).groupBy("component").agg(F.min("least").alias("component_id"))
    several = broadcast_if_small(materialize(several, "component-ids"), 24)
    return linked.join(several, "component", "left").withColumn("component_id", F.coalesce("component_id", "least"))


def link_report(rows: DataFrame, members: DataFrame, stars: DataFrame, keys: list[str], id_name: str) -> DataFrame:
    """Rows with link counts and components.

    rows: (id, keys); members: (keys, class, least, copies, links), links counting rows of
    other classes, least being the smallest id of the class. A row whose keys are null
    links with nothing; one whose id is null has a null component.
    """
    known = component_ids(members, stars).select(*keys, "links", "copies", "component_id")
    out = rows.join(known, keys, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_name),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
