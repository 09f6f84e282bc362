"""Numeric kernels that run per bounded group in Python: deconvolution, fits, edges, paths."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus_spark.plans.materialize import materialize

MAX_BLOCK = 500  # unknowns of one system; larger blocks take length-weighted means


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b, or the shortest best one where that is no good."""
    try:
        x = np.linalg.solve(a, b)
        if np.abs(a @ x - b).max() <= 1e-9 * max(1.0, float(np.abs(b).max())):
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by the active-set method on normal equations."""
    gram, right = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = right.copy()
    scale = max(1e-12, float(np.abs(right).max(initial=0))) * 1e-9
    for _ in range(rounds or 3 * a.shape[1]):
        free = np.where(active, -np.inf, slope)
        k = int(free.argmax())
        if free[k] <= scale:
            break
        active[k] = True
        while True:
            on = np.flatnonzero(active)
            z = _solve(gram[np.ix_(on, on)], right[on])
            if (z > 0).all():
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            off = on[low & (x[on] <= 1e-9 * max(1.0, x.max()))]
            if not len(off):
                off = on[low][:1]
            x[off], active[off] = 0, False
        slope = right - gram @ x
    return x


def poisson_nnls(a: np.ndarray, b: np.ndarray, consistent: bool = False) -> np.ndarray:
    """Rows weighted by 1 / (sqrt(b) + 1); the right side is sqrt(b), or b with the same weight."""
    w = 1 / (np.sqrt(b) + 1)
    return nnls(a * w[:, None], b * w if consistent else np.sqrt(b))


def deconvolve(parts: DataFrame, block: str = "block", ids: str = "ids", value: str = "cov", size: str = "len", max_block: int = MAX_BLOCK) -> DataFrame:
    """Element values whose sums over covering elements best explain the parts: (block, id, value, solved).

    parts: one row per atomic interval with the ids that cover it, its mean and length.
    Blocks share no element. One of more than ``max_block`` elements is not solved: its
    elements take the length-weighted means of their parts, without Python.
    """
    parts = materialize(parts.select(block, ids, value, size), "parts")  # read three times
    big = parts.select(block, F.explode(ids).alias("id")).groupBy(block).agg(F.countDistinct("id").alias("n")).filter(F.col("n") > max_block).select(block)
    spread = parts.join(big, block, "left_semi").select(block, F.explode(ids).alias("id"), value, size)
    means = spread.groupBy(block, "id").agg((F.sum(F.col(value) * F.col(size)) / F.sum(size)).alias("value")).withColumn("solved", F.lit(False))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({i for row in pdf[ids] for i in row})
        at = {i: k for k, i in enumerate(names)}
        a = np.zeros((len(pdf), len(names)))
        for r, row in enumerate(pdf[ids]):
            a[r, [at[i] for i in row]] = 1
        weight = np.sqrt(pdf[size].to_numpy(float))
        x = poisson_nnls(a * weight[:, None], pdf[value].to_numpy(float) * weight, consistent=True)
        return pd.DataFrame({block: pdf[block].iloc[0], "id": names, "value": x, "solved": True})

    kind, element = parts.schema[block].dataType.simpleString(), parts.schema[ids].dataType.elementType.simpleString()
    small = parts.join(big, block, "left_anti").select(block, ids, value, size)
    solved = small.groupBy(block).applyInPandas(solve, f"`{block}` {kind}, id {element}, value double, solved boolean")
    return solved.unionByName(means)


def fit_sigmoid(x: Sequence[float], y: Sequence[float], level: float = 0.99, rounds: int = 200) -> tuple[float, float, float]:
    """(slope, middle, x at ``level``) of 1 / (1 + exp(-slope (x - middle))), by damped least squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p, damp = np.array([1.0, float(np.mean(x))]), 1e-2

    def curve(q: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(q[0] * (x - q[1]), -500, 500)))

    error = ((curve(p) - y) ** 2).sum()
    for _ in range(rounds):
        s = curve(p)
        d = s * (1 - s)
        j = np.stack([d * (x - p[1]), -d * p[0]], 1)
        h = j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (y - s), rcond=None)[0]
        now = ((curve(p + step) - y) ** 2).sum()
        if now < error:
            p, damp, gain, error = p + step, damp / 3, error - now, now
            if gain < 1e-15:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    far = p[1] + np.log(level / (1 - level)) / p[0] if p[0] else np.nan
    return float(p[0]), float(p[1]), float(far)


def sigmoid_by_group(df: DataFrame, group: str, x: str, y: str, level: float = 0.99) -> DataFrame:
    """Sigmoid fits per bounded group (bins of a curve): group, slope, middle, far."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf[group].iloc[0], *fit_sigmoid(pdf[x], pdf[y], level))], columns=[group, "slope", "middle", "far"])

    return df.select(group, x, y).groupBy(group).applyInPandas(one, f"`{group}` {df.schema[group].dataType.simpleString()}, slope double, middle double, far double")


def edges_of(values: np.ndarray, window: int, step: float) -> list[tuple[int, float]]:
    """Places where the smoothed log2 of a dense track steps by ``step`` or more within a
    window: the steepest of each run of such places, with its step."""
    return [(k, d) for _, k, d in _steps(values, window, step)]


def _steps(values: np.ndarray, window: int, step: float) -> list[tuple[int, int, float]]:
    """The edges, each after the first place of its run."""
    first, best, change = _runs_of(values, np.array([0]), np.array([len(values)]), window, step)
    return list(zip(first.tolist(), best.tolist(), change.tolist()))


def _runs_of(values: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, steepest, step) of all runs in dense tracks that lie one after the other in ``values``.

    Places of a track count on from its ``begin`` plus its number, as each has one place more than values.
    """
    count = len(begin)
    # Every track with its first and last value repeated on either side.
    place = np.arange(int((size + 2 * window).sum())) - np.repeat(np.cumsum(size + 2 * window) - (size + 2 * window), size + 2 * window) - window
    track = np.repeat(np.arange(count), size + 2 * window)
    padded = np.log2(values + 1)[np.clip(place, 0, size[track] - 1) + begin[track]]
    # Added up per window, not as differences of running sums: a tile gets the same values as its whole region.
    mean = sum(padded[k : len(padded) - window + 1 + k] for k in range(window)) / window
    change = mean[window:] - mean[:-window]  # of the window after a place less the one before
    kept = np.flatnonzero((place >= -window) & (place <= size[track] - window))  # windows that lie in one track
    change, at = change[kept], track[kept]
    strong = np.flatnonzero(np.abs(change) >= step)
    if not len(strong):
        return strong, strong, change[:0]
    sign = np.sign(change[strong])
    opens = np.concatenate([[True], (np.diff(strong) > 1) | (sign[1:] != sign[:-1]) | (at[strong[1:]] != at[strong[:-1]])])
    run = np.cumsum(opens) - 1
    most = np.maximum.reduceat(np.abs(change[strong]), np.flatnonzero(opens))
    top = np.flatnonzero(np.abs(change[strong]) == most[run])
    best = strong[top[np.unique(run[top], return_index=True)[1]]]
    return strong[opens], best, change[best]


def slope_edges(runs: DataFrame, region: str, window: int = 15, step: float = 1.0, longest: int = 200_000) -> DataFrame:
    """Edges in regions of any length: (region, pos, step).

    ``runs`` holds st, ed, value clipped to the region, rst and red its bounds. At most some
    tiles of ``longest`` places are dense at a time, with a halo on both sides; small regions
    are taken together. A run of steps counts in the tile of its first place. As log2(value + 1) is
    below 1024 and changes by ``step`` a window along a run, no run reaches beyond the halo.
    """
    halo = window * (math.ceil(1024 / step) + 3)
    last = f"greatest(red - rst - 1, 0) div {longest}"
    low, high = f"greatest((st - rst - {halo}) div {longest}, 0)", f"least((ed - 1 - rst + {halo}) div {longest}, {last})"
    tiled = runs.select(region, "st", "ed", "value", "rst", "red", F.explode(F.expr(f"sequence({low}, {high})")).alias("_tile"))
    dealt = tiled.repartition(region, "_tile").sortWithinPartitions(region, "_tile", "st")

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        """Of whole tiles, sorted."""
        name, (rst, red, tile, st, ed) = rows[region].to_numpy(), (rows[c].to_numpy(np.int64) for c in ("rst", "red", "_tile", "st", "ed"))
        heads = np.flatnonzero(_new_tiles(rows, region))
        of = np.repeat(np.arange(len(heads)), np.diff([*heads, len(rows)]))
        rst, red, tile, name = rst[heads], red[heads], tile[heads], name[heads]
        first = rst + tile * longest
        after = np.where(first + longest < red, first + longest, red + 1)  # the place at the region's end belongs to its last tile
        start = np.maximum(rst, first - halo)
        size = np.minimum(red, after + halo) - start
        begin = np.cumsum(size) - size
        dense = np.zeros(int(size.sum()))
        lo, hi = np.clip(st - start[of], 0, size[of]), np.clip(ed - start[of], 0, size[of])
        held = np.flatnonzero(hi > lo)
        length = (hi - lo)[held]
        at = np.arange(int(length.sum())) + np.repeat((begin[of] + lo)[held] - (np.cumsum(length) - length), length)
        dense[at] = np.repeat(rows["value"].to_numpy(float)[held], length)
        windows = np.minimum(window, np.maximum(1, (red - rst) // 2))
        out = []
        for w in np.unique(windows):
            own = np.flatnonzero(windows == w)
            i, k, d = _runs_of(dense, begin[own], size[own], int(w), step)
            base = np.cumsum(size[own] + 1) - (size[own] + 1)
            track = np.searchsorted(base, i, side="right") - 1
            which = own[track]
            i, k = start[which] + i - base[track], start[which] + k - base[track]
            keep = (first[which] <= i) & (i < after[which])
            out.append(pd.DataFrame({region: name[which[keep]], "pos": k[keep], "step": d[keep]}))
        return pd.concat(out, ignore_index=True)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of whole tiles and of one that may go on
        for part in parts:
            if not len(part):
                continue
            held.append(part)
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else part
            cut = int(np.flatnonzero(_new_tiles(rows, region))[-1])
            if cut:
                yield from _in_portions(rows.iloc[:cut], region, longest + 2 * halo, edges)
                rows = rows.iloc[cut:]
            held = [rows]
        if held:
            yield from _in_portions(held[0], region, longest + 2 * halo, edges)

    return dealt.mapInPandas(batches, f"`{region}` {runs.schema[region].dataType.simpleString()}, pos bigint, step double")


def _new_tiles(rows: pd.DataFrame, region: str) -> np.ndarray:
    """Whether a row begins a tile of a region."""
    name, tile = rows[region].to_numpy(), rows["_tile"].to_numpy()
    return np.concatenate([[True], (name[1:] != name[:-1]) | (tile[1:] != tile[:-1])])


def _in_portions(rows: pd.DataFrame, region: str, most: int, work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``work`` on whole tiles of about ``most`` places at a time."""
    heads = np.flatnonzero(_new_tiles(rows, region))
    places = np.cumsum(np.minimum(rows["red"].to_numpy()[heads] - rows["rst"].to_numpy()[heads], most))
    portion = places // most
    cuts = [0, *heads[1:][portion[1:] != portion[:-1]].tolist(), len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        yield work(rows.iloc[a:b])


def best_paths(edges: dict[str, list[tuple[str, float]]], starts: list[tuple[str, float]], least: float, most: int) -> list[tuple[list[str], float]]:
    """Paths to dead ends in falling order of abundance, down to ``least``, ``most`` at most.

    Best first: a path's abundance only falls as it grows, so a finished path that comes
    out of the queue beats all that are still in it.
    """
    queue = [(-a, [s]) for s, a in starts]
    heapq.heapify(queue)
    out = []
    while queue and len(out) < most:
        a, path = heapq.heappop(queue)
        if -a < least:
            break
        ahead = [(b, p) for b, p in edges.get(path[-1], ()) if b not in path]
        if not ahead:
            out.append((path, -a))
        for b, p in ahead:
            heapq.heappush(queue, (a * p, [*path, b]))
    return out


def generate_paths(edges: DataFrame, starts: DataFrame, gene: str = "gene", least: float = 0.01, most: int = 1000) -> DataFrame:
    """Per gene its most abundant paths: (gene, path, abundance).

    edges: gene, src, dst, p; starts: gene, node, abundance. ``most`` guards against the
    explosion of splice variants of one gene and is a feature of the operator.
    """
    both = edges.select(gene, "src", "dst", F.col("p").cast("double").alias("p")).unionByName(starts.select(gene, F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("abundance").cast("double").alias("p")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict[str, list[tuple[str, float]]] = {}
        heads = []
        for s, d, p in sorted(zip(pdf["src"], pdf["dst"].fillna(""), pdf["p"])):
            ways.setdefault(s, []).append((d, p)) if d else heads.append((s, p))
        rows = [(pdf[gene].iloc[0], ">".join(path), a) for path, a in best_paths(ways, heads, least, most)]
        return pd.DataFrame(rows, columns=[gene, "path", "abundance"])

    return both.groupBy(gene).applyInPandas(one, f"`{gene}` {edges.schema[gene].dataType.simpleString()}, path string, abundance double")


def fit_logistic(df: DataFrame, label: str, features: Sequence[str], c: float = 1.0) -> tuple[float, dict[str, float]]:
    """Intercept and weights of a logistic model with an L2 penalty of 1 / (2 c) on the weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df.withColumn("_y", F.col(label).cast("double"))).select("_x", "_y")
    n = rows.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False).fit(rows)
    return float(model.intercept), dict(zip(features, map(float, model.coefficients)))


def cover(paths: DataFrame, gene: str = "gene", path: str = "path", members: str = "members", abundance: str = "abundance") -> DataFrame:
    """Per gene the paths that a greedy cover takes: from the most abundant down, those with a
    member that none before has. Returns the chosen rows (gene, path, abundance).

    A path left out has only members of paths before it, so the members seen so far are those
    of all paths before; a path is taken if it is the first one of any of its members.
    Paths without an abundance come last, equal ones in the order of their names.
    """
    value = F.col(abundance).cast("double")
    place = F.struct(value.isNull().alias("n"), (-value).alias("a"), F.col(path).alias("p"))
    first = paths.select(gene, F.explode(members).alias("_m"), place.alias("_x")).groupBy(gene, "_m").agg(F.min("_x").alias("_x"))
    return first.select(gene, F.col("_x.p").alias(path), (-F.col("_x.a")).alias(abundance)).distinct()
