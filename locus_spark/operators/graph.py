"""Graph closure on edge tables: connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from locus_spark.plans.materialize import BROADCAST_BYTES, broadcast_if_small, materialize, scratch
from locus_spark.plans.ranking import number_rows


#: A node of more edges than this is a hub; its edges meet its neighbour by a broadcast.
HUB = 100_000

#: So few edges are joined on the driver, which ends the rounds.
FEW_EDGES = 50_000


def _with_chosen(rows: DataFrame, chosen: DataFrame, nodes: int, row_bytes: int, hubs: int) -> DataFrame:
    """Rows with the neighbour m that their node u has chosen, without gathering a hub's rows in one task."""
    small = broadcast_if_small(chosen, row_bytes, nodes)
    if small is not chosen:
        return rows.join(small.drop("n"), "u")
    if not hubs:
        return rows.join(chosen.drop("n"), "u")
    few = broadcast_if_small(chosen.filter(f"n > {HUB}"), row_bytes, hubs)
    rest = rows.join(few.select("u"), "u", "left_anti").join(chosen.drop("n"), "u")
    return rest.unionByName(rows.join(few.drop("n"), "u"))


def _joined(links: list[tuple]) -> dict:
    """The least node of every node's component, for a list of edges."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: one row (node, component) per node with an edge.

    ``component`` is the smallest node of the component. Every round contracts: each node
    goes over to one node among itself and its neighbours, and edges between nodes that
    went over to the same one are gone. The first round takes the smallest; later ones take, by
    turns, the first in the order of a hash, which halves even a sorted path in expectation.
    So rounds work on ever smaller graphs, and their sum is in proportion to the first. The
    last few edges are joined on the driver. Self loops keep their node; edges with a null end
    are dropped, and repeated edges do no harm.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    row_bytes, kind = 80 if pairs.schema["a"].dataType.simpleString() == "string" else 24, pairs.schema["a"].dataType
    with scratch(spark) as keep:
        now, went, ends = materialize(pairs, "edges"), [], None
        for n in range(max_rounds):
            both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
            if n % 2:
                rank = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("m"))  # noqa: B023, E731
                m = F.least(F.min(rank("v")), F.first(rank("u")))["m"]
            else:
                m = F.least(F.min("v"), F.first("u"))
            chosen = materialize(both.groupBy("u").agg(m.alias("m"), F.count("*").alias("n")), "chosen")
            nodes, hubs = chosen.agg(F.count("*"), F.count_if(F.col("n") > HUB)).first()
            went.append(chosen.select("u", "m"))
            moved = _with_chosen(now.select(F.col("a").alias("u"), "b"), chosen, nodes, row_bytes, hubs).select(F.col("b").alias("u"), F.col("m").alias("a"))
            moved = _with_chosen(moved, chosen, nodes, row_bytes, hubs).filter("a <> m").select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b"))
            now = materialize(moved.distinct(), "edges")
            left = now.count()
            if left <= FEW_EDGES:
                ends = _joined([tuple(r) for r in now.collect()])
                break
        else:
            raise RuntimeError("components did not converge")
        # From the last round back: where a node went, and where that one ends.
        schema = StructType([StructField("m", kind), StructField("end", kind)])
        last = F.broadcast(spark.createDataFrame(list(ends.items()), schema))
        for step in reversed(went[1:]):
            last = step.join(last, "m", "left").select(F.col("u").alias("m"), F.coalesce("end", "m").alias("end"))
        if len(went) > 1:
            # Hashed rounds end at any node: name the least.
            last = materialize(last, "ends")
            least = last.groupBy("end").agg(F.min("m").alias("least"))
            last = materialize(last.join(least, "end").select("m", F.col("least").alias("end")), "ends")
            last = broadcast_if_small(last, row_bytes)
        out = went[0].join(last, "m", "left").select(F.col("u").alias("node"), F.coalesce("end", "m").alias("component"))
        return keep(materialize(out, "components"))


def reachable(edges: DataFrame, start: DataFrame | None = None, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Pairs (src, dst, steps) of all nodes reached from every node, or from those of ``start`` (node).

    Semi-naive: each round follows edges from the pairs found in the last one alone.
    ``steps`` is the fewest edges. Cycles end when a round finds nothing new.
    """
    step = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna().distinct(), "steps")
    first = step if start is None else step.join(start.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    found = last = materialize(first.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("steps")), "reach")
    for n in range(2, max_rounds + 1):
        new = last.join(step, last["dst"] == step["a"]).select("src", F.col("b").alias("dst")).distinct()
        last = materialize(new.join(found, ["src", "dst"], "left_anti").withColumn("steps", F.lit(n)), "reach")
        if last.isEmpty():
            return found
        found = found.unionByName(last)
    raise RuntimeError("paths longer than max_rounds")


def levels(edges: DataFrame, child: str = "child", parent: str = "parent", max_rounds: int = 60) -> DataFrame:
    """(node, minlevel, maxlevel): the fewest and most edges from a root of a DAG."""
    step = materialize(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).dropna().distinct(), "dag")
    now = step.select(F.col("p").alias("node")).distinct().join(step.select(F.col("c").alias("node")), "node", "left_anti").withColumn("level", F.lit(0))
    now = found = materialize(now, "level")
    for n in range(1, max_rounds + 1):
        now = materialize(now.join(step, now["node"] == step["p"]).select(F.col("c").alias("node")).distinct().withColumn("level", F.lit(n)), "level")
        if now.isEmpty():
            return found.groupBy("node").agg(F.min("level").alias("minlevel"), F.max("level").alias("maxlevel"))
        found = found.unionByName(now)
    raise RuntimeError("a cycle, or more levels than max_rounds")


def spanning_parents(edges: DataFrame, depth: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """One parent per node of a DAG, the smallest of those one minimal level up."""
    up = depth.select(F.col("node").alias(parent), F.col("minlevel").alias("_up"))
    own = depth.select(F.col("node").alias(child), F.col("minlevel").alias("_own"))
    return edges.join(up, parent).join(own, child).filter("_up = _own - 1").groupBy(child).agg(F.min(parent).alias(parent))


def subtree_members(edges: DataFrame, members: DataFrame, child: str = "child", parent: str = "parent", node: str = "node", member: str = "id") -> DataFrame:
    """(node, member) for a node and everything below it."""
    below = reachable(edges, src=parent, dst=child).select(F.col("src").alias(node), F.col("dst").alias("_below"))
    inner = below.join(members.select(F.col(node).alias("_below"), member), "_below").select(node, member)
    return inner.unionByName(members.select(node, member)).distinct()


def path_products(edges: DataFrame, starts: DataFrame, least: float, src: str = "src", dst: str = "dst", p: str = "p", max_steps: int = 100) -> DataFrame:
    """All simple paths from ``starts`` (node) to nodes without a way on, with the product of
    the edges' ``p``; a path is dropped once its product is at or below ``least``.

    Returns (path array, prob). Paths leave the frontier when they end, so each is written once.
    """
    step = materialize(edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b"), F.col(p).cast("double").alias("_p")), "path-edges")
    now = starts.select(F.array("node").alias("path"), F.lit(1.0).alias("prob"))
    done = None
    for _ in range(max_steps):
        now = materialize(now.withColumn("_end", F.element_at("path", -1)), "paths")
        ended = now.join(step, now["_end"] == step["_a"], "left_anti").select("path", "prob")
        done = ended if done is None else done.unionByName(ended)
        ahead = now.join(step, now["_end"] == step["_a"]).filter("NOT array_contains(path, _b)")
        now = ahead.select(F.array_append("path", F.col("_b")).alias("path"), (F.col("prob") * F.col("_p")).alias("prob")).filter(F.col("prob") > least)
        if now.isEmpty():
            return done
    raise RuntimeError("paths longer than max_steps")


def gene_index(components: DataFrame, strand: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, gidx): components numbered from 1 by their smallest node, negative where most
    members lie on the minus strand (ties: plus).

    ``components`` may have the column strand itself; else ``strand`` (node, strand) is joined,
    and without either no number is negative. One row per component is numbered.
    """
    if strand is not None:
        components = components.join(strand, node, "left")
    minus = F.expr("CASE strand WHEN '-' THEN 1 WHEN '+' THEN -1 ELSE 0 END") if "strand" in components.columns else F.lit(0)
    labels = components.groupBy("component").agg(F.sum(minus).alias("_m"))
    ordered = number_rows(labels, ["component"]).select("component", F.expr("CASE WHEN _m > 0 THEN -(_id + 1) ELSE _id + 1 END").alias("gidx"))
    return components.join(ordered, "component").select(node, "gidx")
