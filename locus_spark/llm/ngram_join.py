"""N-gram Jaccard join with Bayesian candidate pruning (operator 9).

Words are maximal runs of characters other than ASCII white space; a document is the
set of its five-word shingles (all its words, if it has one to four). Two documents
link if the Jaccard similarity of their sets is at least the threshold.

1. One pass over the texts gives each row a digest, 240 MinHash values folded into 40
   band keys of six, and 64 one-byte MinHash values. Exact copies become one class.
2. Classes that share a band key are candidates. Within a key the short signatures are
   compared 16 values at a time; a pair goes once the posterior probability that its
   similarity reaches the threshold falls below ``tolerance``. Survivors are reported as
   a spanning forest, so a key with n classes gives fewer than n edges. A key of more
   than BUCKET classes is a star: all of them are left to the next step.
3. Components of those edges are families. Each member is read once more and written as
   its difference to the family's first text: the shingles it lacks and those it adds.
   Differences and short signatures are dealt out by family (in tiles, if one is large),
   pairs that survive the posterior as before are verified exactly: the shingles that two
   members share follow from what their differences share. A tile returns counts and a
   forest, never its pairs.

A pair at exactly 0.8 shares no band with probability 5e-6; higher similarities less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.llm.common import BLOCK_BYTES, blocks, bound_batches, buffers, component_ids, connected_components, forest, link_report, materialize, mix64, tiled, whole_groups
from locus_spark.plans.materialize import broadcast_if_small, scratch

WORDS, BANDS, ROWS = 5, 40, 6
SHORT = 64  # one-byte MinHash values carried to the buckets
STEP = 16  # values compared between two looks at the posterior
TILE, TILE_BYTES = 4096, 4 << 20  # documents and bytes of a chunk of a large family
BUCKET = 4096  # classes of a key that are compared in one task
AGAINST = 512  # members of a family that one task sets against its first text
STRIP, COLUMNS = 512, 1024  # members and shingles of a block of the product that counts shared ones
PART = 1 << 19  # bytes hashed at once

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RNG = np.random.default_rng(20240917)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PICK = np.linspace(0, BANDS * ROWS - 1, SHORT).astype(int)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        table = []
        for base in (_BASE, _BACK):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            table.append(np.cumprod(steps))
        _powers[size] = (table[0], table[1])
    return _powers[size]


def _word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words raw[first:last], worked through in stretches of about PART bytes."""
    out = np.zeros(len(first), np.uint64)
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(raw) + PART, PART)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        base = first[a]
        part = raw[base : last[b - 1]].astype(np.uint64) + np.uint64(1)
        power, back = _power_tables(len(part))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)], dtype=np.uint64)])
        out[a:b] = mix64((sums[last[a:b] - base] - sums[first[a:b] - base]) * back[first[a:b] - base])
    return out


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, in order, and the n + 1 offsets into them."""
    docs, n = len(offsets) - 1, len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    solid = ~_SPACE[raw]
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    word = _word_hashes(raw, first, last)
    doc = np.searchsorted(offsets, first, "right") - 1
    counts = np.bincount(doc, minlength=docs)
    starts = np.concatenate([[0], np.cumsum(counts)])
    sets = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(sets)])
    place = np.repeat(starts[:-1], sets) + np.arange(ends[-1]) - np.repeat(ends[:-1], sets)
    long = np.repeat(counts >= WORDS, sets)
    out = np.repeat(np.minimum(counts, WORDS).astype(np.uint64), sets)
    for k in range(WORDS):
        use = long | (np.repeat(counts, sets) > k)
        at = np.minimum(place + k, len(word) - 1)
        out = np.where(use, mix64(out * _BASE + word[at]), out)
    return out, ends


def minhashes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash values, documents x 240; documents without shingles have the largest value."""
    out = np.full((len(ends) - 1, BANDS * ROWS), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[full, k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], ends[:-1][full])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE
    for k in range(ROWS):
        keys = mix64(keys * _BASE + signature[:, k::ROWS].astype(np.uint64))
    return keys


def least_matches(threshold: float, tolerance: float, total: int, chance: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that stay) for every look at the posterior.

    The similarity has a uniform prior; a value of different shingles agrees with
    probability ``chance``.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) * chance
    looks = []
    for n in range(STEP, total + 1, STEP):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
        like = np.exp(like - like.max(1, keepdims=True))
        reach = (like * (s >= threshold)).sum(1) / like.sum(1)
        looks.append((n, int(np.argmax(reach >= tolerance))))
    return looks


def survivors(a: np.ndarray, b: np.ndarray, looks: list[tuple[int, int]], upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b that no look drops; ``upper``: a is b, pairs i < j only."""
    left, right, step = [], [], max(1, (1 << 22) // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        same = np.zeros((len(part), len(b)), np.uint16)
        for k in range(looks[0][0]):
            same += part[:, k, None] == b[None, :, k]
        i, j = np.nonzero(same >= looks[0][1])
        keep = (i + at < j) if upper else slice(None)
        i, j, got = i[keep], j[keep], same[i, j][keep].astype(np.int64)
        for (n0, _), (n1, least) in zip(looks, looks[1:]):
            if not len(i):
                break
            for lo in range(0, len(i), 1 << 16):
                hi = lo + (1 << 16)
                got[lo:hi] += (part[i[lo:hi], n0:n1] == b[j[lo:hi], n0:n1]).sum(1)
            keep = got >= least
            i, j, got = i[keep], j[keep], got[keep]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


_SIGNED = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64())), ("short", pa.binary())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            hashes, ends = shingles(*buffers(part.column("text")))
            signature = minhashes(hashes, ends)
            keys = band_keys(signature).astype(np.int64).ravel()
            short = signature[:, _PICK].astype(np.uint8).tobytes()
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("digest"), pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys)),
                pa.array([short[k * SHORT : (k + 1) * SHORT] for k in range(n)], pa.binary()),
            ], schema=_SIGNED)


_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _bucket_edges(looks: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["key"]):
            ids = table.column("id").to_numpy()
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(len(ids), SHORT)
            count = np.diff(cuts)
            first = np.repeat(cuts[:-1], count)
            near, same = np.ones(len(ids), bool), np.zeros(len(ids), np.int64)
            for (lo, _), (hi, least) in zip([(0, 0), *looks], looks):
                same += (short[:, lo:hi] == short[first, lo:hi]).sum(1)
                near &= same >= least
            # If all of a bucket agree with its first row, that star joins it.
            star = np.logical_and.reduceat(near, cuts[:-1]) | (count == 2)
            use = np.repeat(star, count) & near & (first != np.arange(len(ids)))
            src, dst = [ids[use]], [ids[first[use]]]
            for g in np.flatnonzero(~star).tolist():
                own = slice(cuts[g], cuts[g + 1])
                i, j = survivors(short[own], short[own], looks, upper=True)
                root = forest(count[g], i, j)
                moved = np.flatnonzero(root != np.arange(count[g]))
                src.append(ids[own][moved])
                dst.append(ids[own][root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], schema=_EDGES)

    return run


_DIFFERENCE = pa.schema([(c, pa.int64()) for c in ("component", "class", "copies", "first", "size")] + [("short", pa.binary()), ("lacks", pa.binary()), ("adds", pa.binary())])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members as differences to the text that leads their group."""
    lead = np.zeros(0, np.uint64)
    for batch in batches:
        for part in blocks(batch):
            hashes, ends = shingles(*buffers(part.column("text")))
            out = []
            rows = zip(*(part.column(c).to_pylist() for c in ("component", "class", "copies", "leads", "short")), ends[:-1].tolist(), ends[1:].tolist())
            for component, own, copies, leads, short, lo, hi in rows:
                mine = np.unique(hashes[lo:hi])
                if leads:
                    lead = mine
                    continue
                at = np.minimum(np.searchsorted(lead, mine), len(lead) - 1)
                both = lead[at] == mine
                lacks = np.ones(len(lead), bool)
                lacks[at[both]] = False
                out.append((component, own, copies, len(lead), len(mine), short, np.flatnonzero(lacks).astype(np.uint32).tobytes(), mine[~both].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_DIFFERENCE), _DIFFERENCE)], schema=_DIFFERENCE)


def shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the sets left[i] and right[j] share, for every pair.

    Few pairs are intersected one by one. For many, values that only one set holds can't
    be shared; the others become columns of 0/1 matrices whose blocked product counts exactly.
    """
    if len(i) < 8 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    both = [*left, *right]
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, held = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    rank, several = np.cumsum(held > 1) - 1, held[column] > 1
    row, column = row[several], rank[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(both), COLUMNS), np.float32)
        block[row[s:e], column[s:e] - lo] = 1
        total += block[: len(left)] @ block[len(left) :].T
    return total[i, j].astype(np.int64)


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verify(looks: list[tuple[int, int]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ["component", "one", "two"], BLOCK_BYTES):
            numbers = {c: table.column(c).to_numpy() for c in ("class", "copies", "side", "first", "size")}
            signature = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, SHORT)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids, copies, side, first, size = (numbers[c][lo:hi] for c in ("class", "copies", "side", "first", "size"))
                lacks = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in table.column("lacks").slice(lo, hi - lo).to_pylist()]
                adds = [np.frombuffer(x, np.uint64) for x in table.column("adds").slice(lo, hi - lo).to_pylist()]
                missing, short = np.array([len(x) for x in lacks]), signature[lo:hi]
                one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                links, root = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
                for s in range(0, len(one), STRIP):
                    rows = one[s : s + STRIP]
                    i, j = survivors(short[rows], short[two], looks, upper=False)
                    # In one chunk each pair shows up twice.
                    use = (rows[i] < two[j]) | (side[rows[i]] != 2)
                    i, j = i[use], j[use]
                    if not len(i):
                        continue
                    p, q = rows[i], two[j]
                    both = first[p] - missing[p] - missing[q]
                    for sets in (lacks, adds):
                        both = both + shared([sets[x] for x in rows.tolist()], [sets[x] for x in two.tolist()], i, j)
                    good = (both > 0) & (both / np.maximum(size[p] + size[q] - both, 1) >= threshold)
                    p, q = p[good], q[good]
                    links += np.bincount(p, copies[q], hi - lo).astype(np.int64) + np.bincount(q, copies[p], hi - lo).astype(np.int64)
                    root = forest(hi - lo, p, q, root)
                least = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(least, root, ids)  # the smallest class of a tree stands for it
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(least[root[hit]])], schema=_LINKS)

    return run


def _classes(rows: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Classes (digest, class, least, copies, links) of rows (id, text, digest) with words, and the stars between them."""
    signed = rows.mapInArrow(_sign, "id long, digest string, n_words long, bands array<bigint>, short binary").filter("n_words > 0")
    classes = signed.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first(F.struct("bands", "short")).alias("s"))
    # Classes have numbers of their own: ids may repeat.
    classes = materialize(classes.select("digest", F.monotonically_increasing_id().alias("class"), "least", "copies", "s.bands", "s.short"), "classes")

    keyed = classes.select(F.explode("bands").alias("key"), "class")
    busy = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("first")).filter("n > 1")
    members = materialize(keyed.join(busy, "key"), "shared-bands")
    crowd = members.filter(f"n > {BUCKET}").select(F.col("class").alias("src"), F.col("first").alias("dst"))
    dealt = members.filter(f"n <= {BUCKET}").join(classes.select("class", "short"), "class").select("key", F.col("class").alias("id"), "short")
    looks = least_matches(threshold, tolerance, SHORT, 1 / 256)
    near = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges(looks), "src long, dst long")
    family = connected_components(near.unionAll(crowd)).withColumnRenamed("node", "class")
    family = materialize(family.join(classes.select("class", "copies", "digest", "short"), "class"), "families")

    texts = rows.select("digest", "text").join(broadcast_if_small(family, 160), "digest").select("component", "class", "copies", "short", "text")
    texts = materialize(texts.dropDuplicates(["class"]), "family-texts")
    groups = family.groupBy("component").agg(F.ceil(F.count("*") / AGAINST).cast("int").alias("groups"))
    own = texts.join(broadcast_if_small(groups, 16), "component").withColumns({"part": F.expr("cast(pmod(xxhash64(class), groups) AS INT)"), "leads": F.lit(False)})
    lead = texts.filter("component = class").join(broadcast_if_small(groups, 16), "component")
    lead = lead.withColumns({"part": F.explode(F.expr("sequence(0, groups - 1)")), "leads": F.lit(True)})
    order = own.unionByName(lead).repartition("component", "part").sortWithinPartitions("component", "part", F.desc("leads"))
    kinds = "component long, class long, copies long, first long, size long, short binary, lacks binary, adds binary"
    differences = materialize(order.select("component", "class", "copies", "leads", "short", "text").mapInArrow(_against, kinds), "family-differences")

    weight = F.sum(F.octet_length("lacks") + F.octet_length("adds"))
    sizes = differences.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(weight / TILE_BYTES), F.lit(1)).cast("int").alias("chunks"))
    tile = ["component", "one", "two"]
    dealt = tiled(differences.join(broadcast_if_small(sizes, 16), "component"), "chunks", "class").drop("chunks")
    found = materialize(dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_verify(looks, threshold), "id long, links long, root long"), "links")

    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(counted, classes["class"] == counted["id"], "left").select("digest", "class", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return known, found.select(F.col("id").alias("src"), F.col("root").alias("dst"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, tolerance: float = 1e-9
) -> DataFrame:
    """Link near copies; one row per input row.

    Returns (id_column, n_links long, component_id long, kept boolean): the other rows
    linked directly, the smallest id reachable by links (its own included), and whether
    the row carries that id.

    Links join texts, not ids: rows that share an id but not a text each have links of
    their own. Null and empty texts and texts of white space alone link with nothing. A
    row with a null id links with nothing and has a null component. Repeated rows link
    with each other like any copies, and those with the smallest id are all kept. Texts
    are whole at any length. Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("digest", F.when(F.col("id").isNotNull(), F.md5("text")))
    with scratch(docs.sparkSession) as keep:
        known, stars = _classes(rows.filter("digest IS NOT NULL"), threshold, tolerance)
        return keep(materialize(link_report(rows.select("id", "digest"), known, stars, ["digest"], id_column), "near-duplicates"))


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, tolerance: float = 1e-9
) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, then digest of the text.

    Groups are made of texts, so that rows of other texts stay whatever their id. A null
    id comes after all others. Of rows equal in id and text the smallest in all columns
    stays. Null texts and those without a word are copies of nothing: all stay. Columns
    may have any names; an empty table stays empty.
    """
    bound_batches(docs)
    last = F.lit((1 << 63) - 1)
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_column).cast("long"), last).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = whole.select("id", "text", F.md5("text").alias("digest"))
    with scratch(docs.sparkSession) as keep:
        known, stars = _classes(rows, threshold, tolerance)
        linked = materialize(component_ids(known, stars), "components")
        first = linked.filter("least = component_id").groupBy("component").agg(F.min("digest").alias("chosen"))
        several = linked.filter("links > 0 OR copies > 1").join(first, "component")
        action = several.select("digest", "least", (F.col("digest") == F.col("chosen")).alias("stays"))
        action = keep(materialize(action, "duplicates"))
    dealt = whole.withColumn("digest", F.md5("text")).join(broadcast_if_small(action, 60), "digest", "left")
    single = dealt.filter("stays IS NULL").select("row.*")
    one = dealt.filter("stays AND id = least").groupBy("digest").agg(F.min("row").alias("row")).select("row.*")
    return single.unionAll(one)
