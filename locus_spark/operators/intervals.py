"""Interval algebra on half-open intervals (keys.., st, ed).

Windows never span a whole chromosome: rows are cut into tiles of positions, each tile is
summarised, and the summaries carry what comes before. A chromosome that holds a third of
all rows is so spread over as many tasks as it has tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus_spark.plans.materialize import dealt, materialize, once, rows_of_scan

TILE = 1 << 17  # positions of a tile
LEVELS, FAN = 4, 64  # bin sizes of the overlap join: width * FAN ** level
KEYS = ("chr",)


def drop_null_positions(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows with a key and both ends, positions as longs."""
    return df.dropna(subset=[*keys, "st", "ed"]).withColumns({"st": F.col("st").cast("long"), "ed": F.col("ed").cast("long")})


def _tiled(df: DataFrame, column: str, tile: int) -> DataFrame:
    return df.withColumn("_tile", F.floor(F.col(column) / F.lit(tile)))


def merge(
    df: DataFrame, keys: Sequence[str] = KEYS, gap: int = 0, touching: bool = True, sums: Sequence[str] = (), mins: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Union of intervals per key; those at most ``gap`` apart merge.

    Returns keys, st, ed, n (members), the sums of ``sums`` and least values of ``mins``.
    Without ``touching``, intervals that only touch stay apart (gap 0). The rows of a table
    that is only read are dealt into partitions of a given number; those of other plans go
    into partitions that Spark sizes.
    """
    # A row without a start belongs nowhere, and its end must not count as reached before the first tile.
    rows, known = _tiled(df.select(*keys, "st", "ed", *sums, *mins).filter("st IS NOT NULL"), "st", tile), rows_of_scan(df)
    place = [*keys, "_tile"]
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = rows.groupBy(*place).agg(F.max("ed").alias("_most"), F.max("st").alias("_top")).select(*place, "_top", F.max("_most").over(before).alias("_before"))
    inside = W.partitionBy(*place).orderBy("st", "ed")

    def apart(reach: Column) -> Column:
        return reach.isNull() | ((F.col("st") > reach + gap) if touching else (F.col("st") >= reach))

    def gather(d: DataFrame, by: list[str], count: Column, *more: Column) -> DataFrame:
        return d.groupBy(*by).agg(
            F.min("st").alias("st"), F.max("ed").alias("ed"), count.alias("n"), *(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in mins), *more
        )

    # Islands of a tile alone: rows are sorted once, and only islands meet what comes before.
    rows = rows if known is None else dealt(rows, place, known)
    rows = rows.withColumn("_new", F.when(apart(F.max("ed").over(inside.rowsBetween(W.unboundedPreceding, -1))), 1).otherwise(0))
    rows = rows.withColumn("_k", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    parts = gather(rows, [*place, "_k"], F.count("*"), F.max("st").alias("_end")).join(tiles, place).withColumn("_new", apart(F.col("_before")))
    # Those that earlier tiles reach are the first ones of a tile; only they and the last can go on beyond it.
    edge = parts.filter("NOT _new OR _end = _top")
    group = F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(W.partitionBy(*keys).orderBy("_tile", "_k").rowsBetween(W.unboundedPreceding, 0))
    joined = gather(edge.withColumn("_g", group), [*keys, "_g"], F.sum("n")).drop("_g")
    whole = parts.filter("_new AND _end < _top").select(*joined.columns)
    return joined.unionByName(whole)


def complement(df: DataFrame, sizes: DataFrame, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """What the intervals leave of [0, size) per key; ``sizes`` has the keys and size.

    A gap runs from an island to the next one, found in its tile or as the first of a later tile.
    """
    held = df.select(*keys, "st", "ed").join(sizes, list(keys)).filter("st < size AND ed > 0 AND st < ed")
    held = held.select(*keys, F.greatest("st", F.lit(0)).cast("long").alias("st"), F.least("ed", "size").cast("long").alias("ed"))
    islands, place = _tiled(merge(held, keys, tile=tile).select(*keys, "st", "ed"), "st", tile), [*keys, "_tile"]
    order = W.partitionBy(*keys).orderBy("_tile")
    tiles = islands.groupBy(*place).agg(F.min("st").alias("_first")).withColumn("_next", F.lead("_first").over(order))
    heads = sizes.join(tiles.groupBy(*keys).agg(F.min("_first").alias("ed")), list(keys), "left")
    heads = heads.select(*keys, F.lit(0).cast("long").alias("st"), F.coalesce("ed", F.col("size").cast("long")).alias("ed"))
    inner = islands.join(tiles.drop("_first"), place).withColumn("_after", F.coalesce(F.lead("st").over(W.partitionBy(*place).orderBy("st")), "_next"))
    inner = inner.join(sizes, list(keys)).select(*keys, F.col("ed").alias("st"), F.coalesce("_after", F.col("size").cast("long")).alias("ed"))
    return inner.unionByName(heads).filter("st < ed")


def runs(deltas: DataFrame, keys: Sequence[str] = KEYS, digits: int | None = None, keep_flat: bool = False, tile: int = TILE) -> DataFrame:
    """Runs (keys, st, ed, value) of the running sum of ``d`` over ``pos``.

    Positions whose changes cancel begin no run, unless ``keep_flat``. ``digits`` rounds
    sums of fractions, so that a return to zero is one.
    """
    point = deltas.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    if digits is not None:
        point = point.withColumn("d", F.round("d", digits))
    if not keep_flat:
        point = point.filter("d <> 0")
    point, place = _tiled(point, "pos", tile), [*keys, "_tile"]
    order = W.partitionBy(*keys).orderBy("_tile")
    tiles = point.groupBy(*place).agg(F.sum("d").alias("_d"), F.min("pos").alias("_first"))
    tiles = tiles.withColumns({"_before": F.sum("_d").over(order.rowsBetween(W.unboundedPreceding, -1)), "_next": F.lead("_first").over(order)}).drop("_d", "_first")
    # The window comes before the join: its order serves both, and rows are sorted once.
    inside = W.partitionBy(*place).orderBy("pos")
    point = point.select(*place, "pos", F.sum("d").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("_sum"), F.lead("pos").over(inside).alias("_after"))
    value = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_sum")
    value = value if digits is None else F.round(value, digits)
    out = point.join(tiles, place).withColumns({"value": value, "ed": F.coalesce("_after", "_next")})
    return out.filter("ed IS NOT NULL").select(*keys, F.col("pos").alias("st"), "ed", "value")


def deltas(df: DataFrame, keys: Sequence[str] = KEYS, weight: Column | None = None) -> DataFrame:
    """+weight at every start, -weight at every end."""
    w = F.lit(1).cast("long") if weight is None else weight
    both = F.explode(F.array(F.struct(F.col("st").alias("pos"), w.alias("d")), F.struct(F.col("ed").alias("pos"), (-w).alias("d")))).alias("x")
    return df.filter("st < ed").select(*keys, both).select(*keys, "x.pos", "x.d")


def _own_level(width: int) -> Column:
    """The bin size of a row's own length."""
    return F.expr(f"CASE {' '.join(f'WHEN (ed - st) div {width * FAN**n} <= {FAN} THEN {n}' for n in range(LEVELS - 1))} ELSE {LEVELS - 1} END")


def _binned(df: DataFrame, keys: Sequence[str], width: int, prefix: str, visits: int, others: Sequence[int]) -> DataFrame:
    """Rows in all bins they touch, at the level of their own length and all coarser ones that the other side has.

    At its own level a row meets rows at their own level (meet 0) and visitors of the
    other side (meet 3 - visits); at coarser ones it visits (meet ``visits``). Visitors
    of both sides never meet, so short intervals don't pile up in coarse bins. ``others``
    are the other side's own levels; places where it has no rows to meet are left out.
    """
    places = ["WHEN -1 THEN array(named_struct('slot', 0, 'size', 1L))"]  # never taken; holds the type where nothing can meet
    for own in range(LEVELS):
        meets = [(own, 0)] * (own in others) + [(own, 3 - visits)] * any(n < own for n in others) + [(n, visits) for n in others if n > own]
        array = ", ".join(f"named_struct('slot', {3 * n + meet}, 'size', {width * FAN**n}L)" for n, meet in meets)
        places.append(f"WHEN {own} THEN array({array})" if array else "")
    d = df.withColumn("_own", _own_level(width)).withColumn("_p", F.explode(F.expr(f"CASE _own {' '.join(places)} END")))
    d = d.withColumns({"_slot": F.col("_p.slot"), "_bin": F.explode(F.expr("sequence(floor(st / _p.size), floor(greatest(ed - 1, st) / _p.size))"))})
    return d.select(*keys, "_slot", "_bin", *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys))


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """All overlapping pairs: keys, the other columns of a, those of b as b_*, ovl.

    A binned equi-join; every pair comes out once, in the later of the two first bins, at
    the coarser of the two levels. ``width`` is about the median length. Both sides are
    written once, so that the levels they have are known before they are dealt into bins.
    """
    columns = [c for c in a.columns if c not in keys], [c for c in b.columns if c not in keys]
    sides = [once(d, "overlap").filter("st IS NOT NULL AND ed IS NOT NULL") for d in (a, b)]
    levels = [sorted(d.select(_own_level(width).alias("n")).distinct().toPandas()["n"]) for d in sides]
    left, right = _binned(sides[0], keys, width, "_a", 2, levels[1]), _binned(sides[1], keys, width, "b_", 1, levels[0])
    # Spark doesn't count what an explode adds and would broadcast binned rows of any number.
    out = left.hint("merge").join(right.hint("merge"), [*keys, "_slot", "_bin"])
    size = f"element_at(array({', '.join(f'{width * FAN**n}L' for n in range(LEVELS))}), cast(_slot div 3 + 1 AS INT))"
    out = out.filter(f"_ast < b_ed AND b_st < _aed AND greatest(floor(_ast / {size}), floor(b_st / {size})) = _bin")
    own = [F.col(f"_a{c}").alias(c) for c in columns[0]]
    other = [F.col(f"b_{c}") for c in columns[1]]
    return out.select(*keys, *own, *other, (F.least("_aed", "b_ed") - F.greatest("_ast", "b_st")).alias("ovl"))


def overlapped(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, tile: int = 64 * FAN, st: Column | None = None, ed: Column | None = None
) -> DataFrame:
    """Rows of a with _hit: whether a row of b overlaps them, at their own positions or those of ``st`` and ``ed``.

    [st, ed) meets b if the furthest end of the rows of b that begin before ed lies beyond
    st: a running maximum, carried from tile to tile. No pair is made. Rows without a key
    or a position meet nothing.
    """
    place, st, ed = [*keys, "_tile"], F.col("st") if st is None else st, F.col("ed") if ed is None else ed
    rows = once(a, "overlapped").withColumns({"_o_low": st, "_o_at": ed.cast("long"), "_o_side": F.lit(0)})
    starts = b.select(*keys, "st", "ed").dropna().groupBy(*keys, F.col("st").cast("long").alias("_o_at")).agg(F.max(F.col("ed").cast("long")).alias("_o_far"))
    starts = materialize(starts.withColumn("_o_side", F.lit(1)), "starts")
    places = rows.select(*keys, "_o_at", F.lit(None).cast("long").alias("_o_far")).unionByName(starts.drop("_o_side"))
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = _tiled(places, "_o_at", tile).groupBy(*place).agg(F.max("_o_far").alias("_o_far")).select(*place, F.max("_o_far").over(before).alias("_o_before"))
    # At one position rows of a come first: what begins at their end doesn't overlap them.
    earlier = W.partitionBy(*place).orderBy("_o_at", "_o_side").rowsBetween(W.unboundedPreceding, -1)
    both = _tiled(rows.unionByName(starts, allowMissingColumns=True), "_o_at", tile).withColumn("_o_in", F.max("_o_far").over(earlier)).filter("_o_side = 0")
    return both.join(tiles, place, "left").select(*a.columns, F.coalesce(F.greatest("_o_in", "_o_before") > F.col("_o_low"), F.lit(False)).alias("_hit"))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner", keys: Sequence[str] = KEYS, width: int = 64, fraction: float = 0.0) -> DataFrame:
    """Overlap join: ``inner``, ``left`` (ovl 0 without a partner), ``semi`` or ``anti``.

    An overlap depends on positions alone, so partners are found for the distinct
    positions of a and joined back by them; ``fraction`` is the least share of a's length.
    Without a fraction semi and anti need no pairs (``overlapped``).
    """
    if how in ("semi", "anti") and not fraction:
        found = overlapped(a, b, keys, tile=width * FAN)
        return found.filter("_hit" if how == "semi" else "NOT _hit").select(*a.columns)
    at = [*keys, "st", "ed"]
    pairs = overlap_pairs(a.select(*at).distinct(), b, keys, width)
    if fraction:
        pairs = pairs.filter(F.col("ovl") >= F.lit(fraction) * (F.col("ed") - F.col("st")))
    if how in ("semi", "anti"):
        return a.join(pairs.select(*at).distinct(), at, f"left_{how}")
    out = a.join(pairs, at, "inner" if how == "inner" else "left")
    return out.withColumn("ovl", F.coalesce("ovl", F.lit(0).cast("long"))).select(*a.columns, *(c for c in pairs.columns if c not in at))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, width: int = 64, tile: int = TILE) -> DataFrame:
    """The parts of every row of a outside all of b; a row may fall into several."""
    at = [*keys, "st", "ed"]
    hits = overlap_pairs(a.select(*at).distinct(), merge(b, keys, tile=tile).select(*at), keys, width)
    # The islands within one interval are disjoint: its gaps lie between neighbours.
    cut = hits.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(F.col("b_st").alias("s"), F.col("b_ed").alias("e")))).alias("_c"))
    starts = "concat(array(st), transform(_c, x -> x.e))"
    ends = "concat(transform(_c, x -> x.s), array(ed))"
    pieces = F.expr(f"filter(arrays_zip({starts}, {ends}), x -> x['0'] < x['1'])")
    cut = cut.select(*at, pieces.alias("_p"))
    out = a.join(cut, at, "left").withColumn("_x", F.explode_outer(F.expr("coalesce(_p, array(named_struct('0', st, '1', ed)))")))
    out = out.filter("_x IS NOT NULL")
    return out.select(*(F.col("_x")["0"].alias(c) if c == "st" else F.col("_x")["1"].alias(c) if c == "ed" else F.col(c) for c in a.columns))


def overlap_ratio(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """Distinct positions of a with len, ovl (bases shared with b), ovlratio and notcovbp."""
    at = [*keys, "st", "ed"]
    hits = overlap_join(a.select(*at).distinct(), b, "left", keys, width).groupBy(*at).agg(F.sum("ovl").alias("ovl"))
    return hits.withColumns({"len": F.col("ed") - F.col("st"), "ovlratio": F.col("ovl") / (F.col("ed") - F.col("st"))}).withColumn("notcovbp", F.col("len") - F.col("ovl"))


def self_ratio(df: DataFrame, count: str, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """Every distinct position with its own count over the counts of all that overlap it (itself included).

    What overlaps [st, ed) is what begins before ed less what has ended by st: two running
    sums, no pairs. Empty intervals overlap nothing and are left out.
    """
    at = [*keys, "st", "ed"]
    one = df.filter("st < ed").groupBy(*at).agg(F.sum(count).alias(count))
    ends = F.explode(F.array(
        F.struct(F.col("st").alias("pos"), F.col(count).alias("up"), (F.col(count) * 0).alias("down")), F.struct(F.col("ed").alias("pos"), (F.col(count) * 0).alias("up"), F.col(count).alias("down")))).alias("x")
    point = _tiled(one.select(*keys, ends).groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum("x.up").alias("up"), F.sum("x.down").alias("down")), "pos", tile)
    place = [*keys, "_tile"]
    earlier = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = point.groupBy(*place).agg(F.sum("up").alias("_u"), F.sum("down").alias("_d"))
    tiles = tiles.select(*place, F.coalesce(F.sum("_u").over(earlier), F.lit(0)).alias("_u"), F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_d"))
    inside = W.partitionBy(*place).orderBy("pos")
    begun = F.col("_u") + F.coalesce(F.sum("up").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ended = F.col("_d") + F.sum("down").over(inside.rowsBetween(W.unboundedPreceding, 0))
    sums = point.join(tiles, place).select(*keys, "pos", begun.alias("_begun"), ended.alias("_ended"))
    out = one.join(sums.select(*keys, F.col("pos").alias("ed"), "_begun"), [*keys, "ed"]).join(sums.select(*keys, F.col("pos").alias("st"), "_ended"), [*keys, "st"])
    total = F.col("_begun") - F.col("_ended")
    return out.select(*at, count, total.alias("total"), F.try_divide(F.col(count), total).alias("ratio"))


def atomic(df: DataFrame, member: str, keys: Sequence[str] = KEYS, width: int = 64, tile: int = TILE) -> DataFrame:
    """Intervals chopped at every boundary: keys, st, ed and the sorted ids that cover each part.

    Short intervals are dealt once into bins of positions, together with the parts that begin
    there, so that parts meet intervals and gather ids where the bin lies, without another shuffle.
    Longer ones, of over FAN bins, go by the overlap join.
    """
    place, size = [*keys, "_bin"], width * FAN
    rows = df.filter("st < ed").select(*keys, "st", "ed", F.col(member).alias("_id"))
    parts = runs(deltas(rows.select(*keys, "st", "ed"), keys), keys, keep_flat=True, tile=tile).filter("value > 0").select(*keys, "st", "ed")
    span = F.expr(f"sequence(floor(st / {width}), floor((ed - 1) / {width}))")
    short = rows.filter(F.col("ed") - F.col("st") <= size).withColumn("_bin", F.explode(span)).select(*place, F.col("st").alias("_from"), F.col("ed").alias("_to"), "_id")
    if rows.filter(F.col("ed") - F.col("st") > size).isEmpty():
        at = parts.withColumn("_bin", F.floor(F.col("st") / width))
        met = at.hint("merge").join(short.hint("merge"), place).filter("_from <= st AND ed <= _to")
        return met.groupBy(*place, "st", "ed").agg(F.array_sort(F.collect_set("_id")).alias("ids")).drop("_bin")
    parts = materialize(parts, "parts")
    at = parts.withColumn("_bin", F.floor(F.col("st") / width))
    met = at.hint("merge").join(short.hint("merge"), place).filter("_from <= st AND ed <= _to").select(*keys, "st", "ed", "_id")
    long = rows.filter(F.col("ed") - F.col("st") > size).groupBy(*keys, "st", "ed").agg(F.collect_set("_id").alias("_ids"))
    over = overlap_pairs(parts, long, keys, width).select(*keys, "st", "ed", F.explode("b__ids").alias("_id"))
    return met.unionByName(over).groupBy(*keys, "st", "ed").agg(F.array_sort(F.collect_set("_id")).alias("ids"))


def merge_pairs(df: DataFrame, keys: Sequence[str] = KEYS, width: int = 64) -> DataFrame:
    """For every overlapping pair st < b_st < ed < b_ed, the inner part and the hull, once each."""
    at = [*keys, "st", "ed"]
    one = df.select(*at).distinct()
    pair = overlap_pairs(one, one, keys, width).filter("st < b_st AND ed < b_ed")
    both = F.explode(F.array(F.struct(F.col("b_st").alias("st"), F.col("ed").alias("ed")), F.struct(F.col("st").alias("st"), F.col("b_ed").alias("ed")))).alias("x")
    return pair.select(*keys, both).select(*keys, "x.st", "x.ed").distinct()


def total_bases(df: DataFrame, keys: Sequence[str] = KEYS, tile: int = TILE) -> DataFrame:
    """Per key: totbp (all rows), covbp (their union) and acov (depth where covered)."""
    total = df.groupBy(*keys).agg(F.sum(F.col("ed") - F.col("st")).alias("totbp"))
    union = merge(df.select(*keys, "st", "ed").distinct(), keys, tile=tile).groupBy(*keys).agg(F.sum(F.col("ed") - F.col("st")).alias("covbp"))
    return total.join(union, list(keys)).withColumn("acov", F.try_divide("totbp", "covbp"))


def longest_gap(values: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Per key the longest stretch of touching rows (keys, st, ed, value) at or below ``threshold``."""
    low = merge(values.filter(F.col("value") <= threshold), keys)
    return low.groupBy(*keys).agg(F.max(F.col("ed") - F.col("st")).alias("gap"))


def trim_3prime(exons: DataFrame, gene: str, length: int) -> DataFrame:
    """Exons cut to the last ``length`` bases of every gene, counted from its 3' end.

    Genes are bounded groups, so a window per gene is safe.
    """
    forward = F.col("strand") != "-"
    order = W.partitionBy(gene).orderBy(F.when(forward, -F.col("ed")).otherwise(F.col("st")), "st", "ed")
    size = F.col("ed") - F.col("st")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = exons.withColumn("_left", F.lit(length) - before).filter("_left > 0")
    short = F.col("_left") < size
    start = F.when(short & forward, F.col("ed") - F.col("_left")).otherwise(F.col("st"))
    end = F.when(short & ~forward, F.col("st") + F.col("_left")).otherwise(F.col("ed"))
    return out.withColumns({"_s": start, "_e": end}).select(*(F.col({"st": "_s", "ed": "_e"}.get(c, c)).alias(c) for c in exons.columns))


def explode_blocks(df: DataFrame, sizes: str = "esizes", starts: str = "estarts") -> DataFrame:
    """Blocked rows (comma lists relative to st) to one row per block."""

    def numbers(c: str) -> str:
        return f"transform(filter(split({c}, ','), x -> x <> ''), x -> cast(x AS BIGINT))"

    zipped = F.explode(F.expr(f"arrays_zip({numbers(starts)}, {numbers(sizes)})")).alias("_b")
    out = df.select("*", zipped)
    start = F.col("st") + F.col("_b")["0"]
    rest = [c for c in df.columns if c not in ("st", "ed", sizes, starts)]
    return out.select(start.alias("st"), (start + F.col("_b")["1"]).alias("ed"), *rest)


def build_blocks(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Blocks of a group to one blocked row: st, ed, n_blocks, esizes, estarts (comma lists)."""
    out = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("st", "ed"))).alias("_b"), F.min("st").alias("st"), F.max("ed").alias("ed"))
    return out.select(
        *group, "st", "ed", F.size("_b").alias("n_blocks"),
        F.expr("concat(array_join(transform(_b, x -> x.ed - x.st), ','), ',')").alias("esizes"),
        F.expr("concat(array_join(transform(_b, x -> x.st - st), ','), ',')").alias("estarts"),
    )


def introns(exons: DataFrame, transcript: Sequence[str]) -> DataFrame:
    """Gaps between consecutive exons of a transcript."""
    order = W.partitionBy(*transcript).orderBy("st", "ed")
    out = exons.select(*transcript, F.col("ed").alias("_s"), F.lead("st").over(order).alias("_e")).filter("_e IS NOT NULL AND _s < _e")
    return out.select(*transcript, F.col("_s").alias("st"), F.col("_e").alias("ed"))


def bundles(gaps: DataFrame, sizes: DataFrame, keys: Sequence[str] = KEYS, least: int = 10_000_000) -> DataFrame:
    """Cut keys into bundles of at least ``least`` positions at the middles of gaps, in order."""
    key = keys[0]
    cuts = gaps.groupBy(key).agg(F.array_sort(F.collect_list(F.expr("(st + ed) div 2"))).alias("_m"))
    step = f"(acc, m) -> CASE WHEN m - coalesce(try_element_at(acc, -1), 0L) >= {least} THEN concat(acc, array(m)) ELSE acc END"
    out = sizes.join(cuts, key, "left").withColumn("_c", F.expr(f"aggregate(coalesce(_m, cast(array() AS ARRAY<BIGINT>)), cast(array() AS ARRAY<BIGINT>), {step})"))
    out = out.withColumn("_x", F.explode(F.expr("arrays_zip(concat(array(0L), _c), concat(_c, array(cast(size AS BIGINT))))")))
    return out.select(key, F.col("_x")["0"].alias("st"), F.col("_x")["1"].alias("ed"))
