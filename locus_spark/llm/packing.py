"""Packing token sequences by non-negative least squares (operator 5).

Documents are tokenized, ended by a separator and cut into pieces of at most the window.
Piece lengths, rounded up to units, give a histogram of at most ``units`` bins whatever
the number of documents. All combinations of up to ``depth`` lengths that fill the window
exactly are enumerated, the repeat counts that best explain the histogram are found by
non-negative least squares and rounded down to what the histogram holds, and what is
left is packed greedily, longest first into the fullest pattern with room. Pieces take
the slots of their length in the order of a hash rank, so no task sees more than a
bounded group and nothing but the histogram reaches the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.functions.kernels import nnls
from locus_spark.llm.common import blocks, bound_batches, materialize

WINDOW = 2048
END = 1  # the id that ends a document
UNITS = 128  # bins of the histogram
DEPTH = 3  # lengths in a combination
GROUP = 50_000  # pieces that one task ranks

#: Both libraries cut texts of these characters alike; others go to the reference tokenizer.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7e¡-ſ]*")
#: The faster library's pattern recurses along a run of one kind; texts with a longer one go to the reference too.
RUN = 20_000
_LONG_RUN = re.compile(rf"\s{{{RUN},}}+|\S{{{RUN},}}+")
_tokenizers: dict[tuple, object] = {}


def _file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def _slow(path: str | None):
    """The tokenizer of a file."""
    if ("slow", path) not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers["slow", path] = Tokenizer.from_file(_file(path))
    return _tokenizers["slow", path]


def _fast(path: str | None):
    """A faster encoder with the vocabulary of a byte-level file, and a pattern of the file's added
    tokens: texts that hold one are left to the tokenizer itself."""
    if ("fast", path) not in _tokenizers:
        import public_tokenizers
        import tiktoken

        # Byte-level vocabularies write bytes as printable characters: those as they are,
        # the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        with open(_file(path), encoding="utf-8") as f:
            parsed = json.load(f)
        added = [t["content"] for t in parsed["added_tokens"]]
        ranks = {bytes(byte[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in added}
        made = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _tokenizers["fast", path] = made, re.compile("|".join(map(re.escape, added)) or "(?!)")
    return _tokenizers["fast", path]


def encode(texts: list[str], path: str | None = None) -> list[np.ndarray]:
    """Ids of whole texts as the tokenizer file gives them; it adds none, but finds its own added tokens."""
    out: list = [None] * len(texts)
    fast, added = _fast(path)
    for k, text in enumerate(texts):
        if _PLAIN.fullmatch(text) and not added.search(text) and (len(text) <= RUN or not _LONG_RUN.search(text)):
            out[k] = np.array(fast.encode_ordinary(text), np.uint32)
    for k, ids in enumerate(out):
        if ids is None:
            out[k] = np.array(_slow(path).encode(texts[k], add_special_tokens=False).ids, np.uint32)
    return out


_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row")])


def _cut(path: str | None, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, row, ids in zip(part.column("id").to_pylist(), part.column("row").to_pylist(), encode(texts, path)):
                    data = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(data), window):
                        piece = data[at : at + window]
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(data), row))
                columns = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_PIECES)

    return run


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of 1 to ``depth`` lengths with the sum ``units``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for n in range(min(most, left), 0, -1):
                if n * (depth - len(head)) < left:
                    break
                grow((*head, n), left - n, n)

    grow((), units, units)
    return out


def plan(histogram: dict[int, int], units: int = UNITS, depth: int = DEPTH) -> list[tuple[Counter, int]]:
    """Patterns (lengths in units and how often each) and their repeat counts, using up the histogram."""
    left = np.zeros(units + 1, np.int64)
    for n, times in histogram.items():
        left[n] = times
    combos = [Counter(c) for c in combinations(units, depth)]
    a = np.zeros((units + 1, len(combos)))
    for k, c in enumerate(combos):
        for n, times in c.items():
            a[n, k] = times
    x = nnls(a, left.astype(float)) if left.any() else np.zeros(len(combos))
    out: list[tuple[Counter, int]] = []
    for k in np.argsort(-x, kind="stable").tolist():
        times = min([int(x[k] + 1e-6), *(int(left[n]) // m for n, m in combos[k].items())])
        if times > 0:
            out.append((combos[k], times))
            for n, m in combos[k].items():
                left[n] -= times * m
    # What is left, longest first: a pattern takes the longest length that still fits.
    while left.any():
        pattern, room = Counter(), units
        take = left.copy()
        for n in range(units, 0, -1):
            m = min(room // n, int(take[n]))
            if m:
                pattern[n], room = m, room - m * n
        times = min(int(left[n]) // m for n, m in pattern.items())
        out.append((pattern, times))
        for n, m in pattern.items():
            left[n] -= times * m
    return out


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    end_id: int = END,
    units: int = UNITS,
    depth: int = DEPTH,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (longs):
    the ids of the document before the piece, those in it, the crc32 of them as unsigned
    little-endian 32-bit numbers, the ids of the document with its end, the sequence, and
    the ids before the piece there.

    A null text is empty, and an empty document is its end alone. Repeated rows are
    documents of their own, also with a null id. Texts are whole at any length; other
    columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs)
    if units < 1 or window % units:
        raise ValueError("units must divide the window")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = ", ".join(f"{f.name} long" for f in _PIECES)
    pieces = rows.mapInArrow(_cut(tokenizer_path, window, end_id), kinds).withColumn("units", F.expr(f"cast(ceil(length / {window // units}) AS INT)"))
    pieces = materialize(pieces, "pieces")
    bins = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count("*").alias("n")).collect()}  # at most ``units`` rows
    slots, sequence, used = [], 0, Counter()
    for pattern, times in plan(bins, units, depth):
        for n, m in pattern.items():
            slots.append((n, used[n], used[n] + times * m, m, sequence))
            used[n] += times * m
        sequence += times
    spark = docs.sparkSession
    table = spark.createDataFrame(slots, "u int, first long, past long, each long, sequence long")

    # Rank within a length: groups by hash, numbered inside, plus what the groups before hold.
    groups = max(1, -(-max(bins.values(), default=1) // GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    held = salted.groupBy("units", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("units").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    held = held.select(F.col("units").alias("u1"), F.col("salt").alias("s1"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("units", "salt").orderBy("row", "start")) - 1
    ranked = salted.withColumn("inside", inside).join(F.broadcast(held) if groups <= 1000 else held, F.expr("units = u1 AND salt = s1"))
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("before"))
    # The slot table has some hundred rows, bounded by ``units`` and ``depth`` alone.
    placed = ranked.join(F.broadcast(table), F.expr("units = u AND rank >= first AND rank < past"))
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - first) div each"))
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), "offset")
