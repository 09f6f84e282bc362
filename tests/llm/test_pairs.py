"""Near copies, vectors and top-k against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from locus_spark.llm import embedding_dedup as E
from locus_spark.llm import ngram_join as N
from locus_spark.llm import topk_search as S
from locus_spark.llm.common import forest


def links(n, pairs, ids):
    """(n_links, smallest id reachable) by union-find."""
    root, count = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        count[a] += 1
        count[b] += 1
        x, y = sorted((find(a), find(b)), key=lambda k: ids[k])
        root[y] = x
    return [(count[k], ids[find(k)]) for k in range(n)]


def shingle_set(text):
    words = [w for w in __import__("re").split("[ \t\n\r\f\v]+", text or "") if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 3, 4, 5, 6, 40, 80, 200, 3000)]
    for base in texts[4:]:
        words = base.split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = word()
            texts.append("  ".join(copy) + "\n")
    texts += [texts[5]] * 5 + ["", " \n", None, "x", "x", "a b c d", "a b c d e", "a b  c d"]
    rng.shuffle(texts)
    return texts


def test_shingles_match_sets():
    import pyarrow as pa

    from locus_spark.llm.common import buffers

    texts = corpus()
    hashes, ends = N.shingles(*buffers(pa.array(texts)))
    seen = {}
    for k, text in enumerate(texts):
        got, want = set(hashes[ends[k] : ends[k + 1]].tolist()), shingle_set(text)
        assert len(got) == len(want)
        seen.setdefault(frozenset(want), got)
        assert seen[frozenset(want)] == got


def test_near_duplicates(spark):
    texts = corpus()
    rows = [(k * 3 + 1, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string, links int")
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = {rows[k][0]: w for k, w in enumerate(links(len(texts), pairs, [r[0] for r in rows]))}
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in N.near_duplicates(df).collect()} == want


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, "p q r s t"), (3, "u v w x y z")]
    got = sorted(tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] is not None)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True), (3, 0, 3, True)]
    empty = N.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_links", "component_id", "kept"]


def test_links_of_repeated_ids(spark):
    """Rows that share an id but not a text keep the links of their texts."""
    words = [" ".join(f"{x}{k}" for k in range(60)) for x in "ac"]
    a, c = words
    rows = [(1, a), (2, a + " end"), (1, c), (3, c + " end")]
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_drop_near_duplicates(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a, 5), (2, a, 5), (2, b, 5), (3, c, 5), (3, d, 5), (9, d + " end", 5), (None, b + " end", 5), (None, None, 5), (7, "", 5), (8, "", 5), (3, c, 4), (3, c, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = N.drop_near_duplicates(df)
    assert got.columns == df.columns
    want = [(1, a, 5), (2, b, 5), (3, c, 4), (3, d, 5), (None, None, 5), (7, "", 5), (8, "", 5)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert N.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [dict(TILE=8, BUCKET=8, STRIP=3, AGAINST=4), dict(TILE=8, BUCKET=100, COLUMNS=7), dict(TILE_BYTES=2000)])
def test_large_families_and_buckets_are_tiled(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(N, name, value)
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(300)]
    texts = []
    for k in range(60):
        copy = list(base)
        for _ in range(1 if k < 40 else 5):
            copy[rng.randrange(300)] = f"w{rng.randrange(50)}"
        texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(60) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    got = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert 1000 < len(pairs) < 1770 and {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == dict(enumerate(links(60, pairs, range(60))))


def test_posterior_and_forest():
    looks = N.least_matches(0.8, 1e-9, 64, 1 / 256)
    assert [n for n, _ in looks] == [16, 32, 48, 64] and all(0 < m < 0.7 * n for n, m in looks[1:])
    assert forest(6, np.array([5, 1, 4]), np.array([4, 2, 2])).tolist() == [0, 1, 1, 3, 1, 1]
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, (50, 64)).astype(np.uint8)
    i, j = N.survivors(a, a, looks, upper=True)
    want = {(x, y) for x in range(50) for y in range(x + 1, 50) if all((a[x, :n] == a[y, :n]).sum() >= m for n, m in looks)}
    assert set(zip(i.tolist(), j.tolist())) == want


def vectors():
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(64)
            for noise in (0, 0, 0.01, 0.05, 0.12, 0.14, 0.2, 0.5):
                v = base + noise * rng.standard_normal(64)
                rows.append((k := k + 1, [float(np.float32(x)) for x in v * rng.choice([1, 3])], label))
    nan, inf = float("nan"), float("inf")
    rows += [(k + 1, None, 0), (k + 2, [0.0] * 64, 0), (k + 3, [nan] * 64, 0), (k + 4, [inf] * 64, 0), (k + 5, [None] + [1.0] * 63, 0), (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0), (k + 8, [], 0)]
    return rows


@pytest.mark.parametrize("tile", [4, 2048])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rows = vectors()
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, class string")
    x = [np.array(v, float) if v and None not in v else None for _, v, _ in rows]
    sound = [k for k, v in enumerate(x) if v is not None and len(v) and np.isfinite(v).all() and v.any() and rows[k][2] is not None]
    cos = lambda a, b: (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) if len(a) == len(b) else 0
    pairs = [(a, b) for a in sound for b in sound if b < a and rows[a][2] == rows[b][2] and cos(x[a], x[b]) >= 0.98]
    want = {rows[k][0]: w for k, w in enumerate(links(len(rows), pairs, [r[0] for r in rows]))}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()}
    assert got == want and len(pairs) > 100


def test_near_vectors_repeats_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(5, v, 1), (5, v, 1), (None, v, 1), (7, v, 1), (9, v, None)], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in E.near_vectors(df).collect() if r["vec_id"] is not None)
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 0, 9, True)]
    assert E.near_vectors(df.limit(0)).count() == 0


def brute_top(rows, queries, k):
    good = {i: np.floor(1024 * np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    out = set()
    for q in queries:
        if q in good:
            scores = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("bytes_at_once", [900, 16 << 20])
def test_top_k(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(S, "QUERY_BYTES", bytes_at_once)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.float32(rng.integers(-2, 3, 9) / 4)]) for k in range(60)]  # many ties
    rows += [(100, None), (200, [None] * 9), (300, [float("nan")] * 9), (400, [0.0] * 9), (500, [1.0, 2.0]), (501, [3.0, 1.0]), (510, []), (511, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in S.top_k(df, df.filter("vec_id % 10 = 0"), k=10).collect()}
    assert got == brute_top(rows, [r[0] for r in rows if r[0] % 10 == 0], 10)


def test_top_k_of_near_copies(spark, monkeypatch):
    """Cutoffs prune: most rows are far from every query."""
    monkeypatch.setattr(S, "STRIP", 3)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 32))
    rows = [(k, [float(x) for x in (base[k % 12] + 0.1 * rng.standard_normal(32)) * rng.choice([0.1, 1, 2])]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {tuple(r) for r in S.top_k(df, df.filter("vec_id % 7 = 0"), k=4).collect()}
    assert got == brute_top(rows, [r[0] for r in rows if r[0] % 7 == 0], 4)


def test_top_k_repeated_ids(spark):
    rows = [(1, [1.0, 1.0]), (1, [5.0, 0.0]), (1, [0.0, 9.0]), (1, [0.0, 9.0]), (2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in S.top_k(df, df.filter("vec_id = 2"), k=3).collect())
    assert got == [(2, 1, 1, 18 << 20), (2, 2, 1, 18 << 20), (2, 3, 1, 5 << 20)]
    twice = S.top_k(df, df.filter("vec_id = 1"), k=3).collect()
    assert sorted(r["score"] >> 20 for r in twice) == [3, 5, 18, 18] and {r["vec_id"] for r in twice} == {2}


def test_top_k_wide_numbers_and_empty(spark):
    rows = [(0, [3e7, 2e7]), (1, [3e7, 2e7]), (2, [-3e7, 1e7]), (3, [1e30, 1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"]): r["score"] for r in S.top_k(df, df.filter("vec_id = 0"), k=10).collect()}
    a = [30_000_000 * 1024, 20_000_000 * 1024]
    assert got == {1: min(a[0] ** 2 + a[1] ** 2, 2**63 - 1), 2: max(-(a[0] ** 2) + a[1] * 10_000_000 * 1024, -(2**63)), 3: 2**63 - 1}
    assert S.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pairs_at_a_budget():
    rng, n, threshold = np.random.default_rng(8), 16, 0.98
    turn, share = E.rotation(n), E.shares(n, threshold)[0]
    vectors = []
    for k in range(2000):
        d, c = rng.standard_normal(n), rng.standard_normal(n)
        d[:8] *= np.sqrt((share - (k % 2) * E.SLACK / 2) * (1 + rng.uniform(-1, 1) * 1e-6)) / np.linalg.norm(d[:8])
        d[8:] *= np.sqrt(0.005) / np.linalg.norm(d[8:])
        c -= d * (c @ d) / (d @ d)
        c *= np.sqrt(1 - d @ d / 4) / np.linalg.norm(c)
        vectors += [(c + d / 2) @ turn.T, (c - d / 2) @ turn.T]
    rows = len(vectors)
    counts = np.zeros(rows)
    for block in range(2):
        tile = {"label": np.zeros(rows, int), "slab": np.arange(rows) // 2, "one": np.zeros(rows, int), "two": np.zeros(rows, int), "side": np.full(rows, 2), "class": np.arange(rows), "copies": np.ones(rows, int), "home": np.ones(rows, int)}
        tile |= {"block": np.full(rows, block), "dims": np.full(rows, n)}
        batch = pa.RecordBatch.from_pydict({**{c: pa.array(v) for c, v in tile.items()}, "v": pa.array(E._pack(np.array(vectors)), pa.binary())})
        for out in E._join(threshold)(iter([batch])):
            np.add.at(counts, out["id"].to_numpy(), out["links"].to_numpy())
    assert (counts == 1).all()
