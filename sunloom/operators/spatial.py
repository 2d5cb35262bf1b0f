"""Spatial operators on location tables (id, lat, lon): distances, nearest, inverse distance, knots and basis, pixels.

Inverse distance weighs every source for every target, by definition. Sources and targets of equal position are one, and
sources are dealt into blocks that are one row of arrays each: a target meets blocks, not sources, and weighs a block's
sources within the row. Weights that are used for many instants meet them as a matrix product: one array of values an
instant, one array of weights a target, no row for a target, a source and an instant. The nearest source is looked for in
a tree of cells, split where they hold many sources, down from cells that can hold nearer ones. The basis has compact
support: targets and knots meet in cells as wide as the support.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KM_PER_LAT, KM_PER_LON, km_apart, num, snap_index, wendland
from ..sources.staging import durable
from .ordered import dense_index

#: Sources that are met as one table at most, blocks that are broadcast at most, and sources of a block.
MAX_SOURCES, MAX_BLOCKS, BLOCK = 100_000, 2_000, 512
#: Sources of a leaf cell; a cell is split into SPLIT times SPLIT, at most DEPTH times.
LEAF, SPLIT, DEPTH = 128, 4, 15
# Spacing of the knot levels in kilometres; a basis function reaches 2.5 spacings.
LEVELS = (10.0, 5.0, 2.5, 1.5)
REACH = 2.5
PIXEL_LAT, PIXEL_LON = 2.0 / KM_PER_LAT, 2.0 / KM_PER_LON


def _sides(targets: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = targets.select(F.col("id").alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    return t, sources.select(F.col("id").alias("source"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))


_KM = lambda: km_apart(F.col("tlat"), F.col("tlon"), F.col("slat"), F.col("slon"))


def pairs(targets: DataFrame, sources: DataFrame, exclude_self: bool = False, most: int = MAX_SOURCES, parts: int = 64) -> DataFrame:
    """target, source, km of every target with every source.

    Up to ``most`` sources are broadcast; more are dealt as blocks of that size, the targets as ``parts`` parts, and every
    part meets every block by an equi join.
    """
    t, s = _sides(targets, sources)
    n = sources.count()
    if n <= most:
        met = t.crossJoin(F.broadcast(s))
    else:
        blocks = -(-n // most)
        t = t.withColumns({"part": F.pmod(F.xxhash64("target"), parts), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))})
        s = s.withColumns({"block": F.pmod(F.xxhash64("source"), blocks), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))})
        met = t.join(s, ["part", "block"])
    met = met.filter(F.col("target") != F.col("source")) if exclude_self else met
    return met.select("target", "source", _KM().alias("km"))


def _cell(level: int, side: float, y0: float, x0: float, lat: str, lon: str) -> tuple[Column, Column]:
    """Numbers of the cell of a level that a place lies in; the whole square is the cell of level 0."""
    n = SPLIT**level
    at = lambda c, per, lo: F.least(F.greatest(F.floor((F.col(c) * num(per) - num(lo)) / num(side / n)), F.lit(0)), F.lit(n - 1))
    return at(lat, KM_PER_LAT, y0), at(lon, KM_PER_LON, x0)


def _tree(s: DataFrame, side: float, y0: float, x0: float) -> tuple[dict[int, DataFrame], DataFrame]:
    """Cells by level (cy, cx, py, px of the cell above, leaf, and one of its sources), and sources by leaf.

    s: slat, slon, ids. Levels begin with the last one of a handful of cells, as those of a cluster and places far from it
    are many. Only cells with more than LEAF sources are split, so each source is handled once a level of its own branch,
    and a level's cells are counted before the shuffle.
    """
    levels, leaves, rest = {}, None, s
    about = s.agg(*[F.approx_count_distinct(F.struct(*_cell(k, side, y0, x0, "slat", "slon"))).alias(str(k)) for k in range(DEPTH + 1)]).first()
    for k in range(max(k for k in range(DEPTH + 1) if not k or about[str(k)] <= 4), DEPTH + 1):
        cy, cx = _cell(k, side, y0, x0, "slat", "slon")
        rest = rest.withColumns({"cy": cy, "cx": cx})
        cells = rest.groupBy("cy", "cx").agg(F.count("*").alias("n"), F.min(F.struct("slat", "slon", "ids")).alias("some"))
        cells = cells.withColumn("leaf", F.lit(True) if k == DEPTH else F.col("n") <= LEAF)
        above = {"py": F.floor(F.col("cy") / SPLIT), "px": F.floor(F.col("cx") / SPLIT)}
        cells = durable(cells.withColumns(above).select("cy", "cx", "py", "px", "leaf", "some"))
        levels[k] = cells
        met = rest.join(cells.select("cy", "cx", "leaf"), ["cy", "cx"])
        own = met.filter("leaf").select(F.lit(k).alias("level"), "cy", "cx", "slat", "slon", "ids")
        leaves = own if leaves is None else leaves.unionByName(own)
        if cells.filter("NOT leaf").isEmpty():
            return levels, durable(leaves)
        rest = durable(met.filter("NOT leaf").drop("leaf", "cy", "cx"))
    return levels, durable(leaves)


def _two_nearest(t: DataFrame, s: DataFrame) -> DataFrame:
    """tlat, tlon, best: the two nearest of s (slat, slon, ids: its smallest two ids) to each of t, nearest first.

    Down the tree, level by level: a target keeps the cells that may hold a source as near as the second nearest it knows
    of, where every cell tells one of its sources. At the leaves it meets their sources.
    """
    box = s.agg(*[f(c).alias(k) for k, f, c in (("y0", F.min, "slat"), ("y1", F.max, "slat"), ("x0", F.min, "slon"), ("x1", F.max, "slon"))]).first()
    y0, x0 = box["y0"] * KM_PER_LAT, box["x0"] * KM_PER_LON
    side = max(box["y1"] * KM_PER_LAT - y0, box["x1"] * KM_PER_LON - x0, 1e-6) * (1 + 1e-9)
    levels, leaves = _tree(s, side, y0, x0)

    def two_of(spots: str) -> Column:
        """The two nearest of an array of positions, as (km, source)."""
        km = lambda p: km_apart(F.col("tlat"), F.col("tlon"), p["slat"], p["slon"])
        each = F.flatten(F.transform(spots, lambda p: F.transform(p["ids"], lambda i: F.struct(km(p).alias("km"), i.alias("source")))))
        return F.aggregate(
            each, F.array().cast(f"array<struct<km:double,source:{kind}>>"),
            lambda best, x: F.when(F.size(best) < 2, F.sort_array(F.array_append(best, x))).when(x < best[1], F.sort_array(F.array(best[0], x))).otherwise(best),
        )

    kind = s.schema["ids"].dataType.elementType.simpleString()
    at = lambda c: F.col(c).cast("double")
    searching, found = None, None
    for k, cells in levels.items():
        met = searching.join(cells, ["py", "px"]) if searching is not None else t.select("tlat", "tlon", F.lit(None).cast("double").alias("bound")).crossJoin(F.broadcast(cells))  # a handful of cells
        width = side / SPLIT**k
        out = lambda c, per, lo, n, w=width: F.greatest(num(lo) + at(n) * num(w) - F.col(c) * num(per), F.col(c) * num(per) - num(lo) - (at(n) + 1) * num(w), num(0))
        dy, dx = out("tlat", KM_PER_LAT, y0, "cy"), out("tlon", KM_PER_LON, x0, "cx")
        km = km_apart(F.col("tlat"), F.col("tlon"), F.col("some.slat"), F.col("some.slon"))
        reach = lambda least, bound: bound.isNull() | (least * num(1 - 1e-9) <= bound)
        new = met.withColumn("least", F.sqrt(dy * dy + dx * dx)).filter(reach(F.col("least"), F.col("bound")))
        new = new.select("tlat", "tlon", F.lit(k).alias("level"), "cy", "cx", "leaf", "least", F.transform(F.col("some.ids"), lambda _: km).alias("km"))
        every = new if found is None else found.unionByName(new)
        # as many entries as cells are kept, which is few: what lies within a cell's width of the nearest ones
        kept = every.groupBy("tlat", "tlon").agg(F.collect_list(F.struct("level", "cy", "cx", "leaf", "least", "km")).alias("c"))
        second = F.get(F.sort_array(F.flatten("c.km")), F.lit(1))
        near = F.filter("c", lambda c: reach(c["least"], F.col("bound")))
        kept = durable(kept.withColumn("bound", second).select("tlat", "tlon", "bound", F.explode(near).alias("c")).select("tlat", "tlon", "bound", "c.*"))
        found = kept.filter("leaf").drop("bound")
        searching = kept.filter("NOT leaf").select("tlat", "tlon", "bound", F.col("cy").alias("py"), F.col("cx").alias("px"))
    # a leaf is one row of its sources, at most LEAF of them: what a target takes from it are the two nearest
    packed = leaves.groupBy("level", "cy", "cx").agg(F.collect_list(F.struct("slat", "slon", "ids")).alias("spots"))
    met = found.select("tlat", "tlon", "level", "cy", "cx").join(packed, ["level", "cy", "cx"]).withColumn("two", two_of("spots"))
    return met.groupBy("tlat", "tlon").agg(F.slice(F.sort_array(F.flatten(F.collect_list("two"))), 1, 2).alias("best"))


def nearest(targets: DataFrame, sources: DataFrame, exclude_self: bool = False) -> DataFrame:
    """target, source, km: the nearest source of each target, the smallest id of several; no row where there is none.

    Positions are looked up, not ids: sources of one position are one with their smallest two ids, targets of one position
    search once. Two nearest are found, of which a target that may not be its own source takes the one that it is not.
    Places without coordinates are left out.
    """
    t, s = _sides(targets.dropna(subset=["lat", "lon"]), sources.dropna(subset=["lat", "lon"]))
    spots = durable(_spots(s.dropDuplicates(["slat", "slon", "source"])))
    wanted = t.select("tlat", "tlon").distinct()
    n = spots.limit(LEAF + 1).count()
    if n == 0:
        return t.join(s, F.lit(False)).select("target", "source", F.lit(None).cast("double").alias("km"))
    if n <= LEAF:
        near = wanted.crossJoin(F.broadcast(spots)).select("tlat", "tlon", F.transform("ids", lambda i: F.struct(_KM().alias("km"), i.alias("source"))).alias("near"))
        best = near.groupBy("tlat", "tlon").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, 2).alias("best"))
    else:
        best = _two_nearest(wanted, spots)
    met = t.join(best, ["tlat", "tlon"])
    first = F.get("best", F.lit(0))
    chosen = F.when(first["source"] != F.col("target"), first).otherwise(F.get("best", F.lit(1))) if exclude_self else first
    return met.withColumn("__n", chosen).filter("__n IS NOT NULL").select("target", "__n.source", "__n.km")


def _spots(s: DataFrame) -> DataFrame:
    """slat, slon, ids: distinct positions with the smallest two ids of each, by two smallest values, not by a list of all."""
    first = s.groupBy("slat", "slon").agg(F.min("source").alias("i"))
    second = s.join(first, ["slat", "slon"]).filter("source > i").groupBy("slat", "slon").agg(F.min("source").alias("j"))
    return first.join(second, ["slat", "slon"], "left").select("slat", "slon", F.array_compact(F.array("i", "j")).alias("ids"))


def inverse_distance(targets: DataFrame, sources: DataFrame, values: DataFrame, power: float = 2.0, coincident_km: float | None = 0.001, exclude_self: bool = False, value: str = "value") -> DataFrame:
    """target, value: the mean of the sources' values (source, value) weighed by km^-power.

    A source within coincident_km gives the value alone, the nearest of several, the smallest id of those. Values of one
    position are summed first, and BLOCK positions are one row of arrays: a target meets blocks, and what it takes from a
    block are three numbers and its nearest source. Up to MAX_BLOCKS blocks are broadcast, more are met part by part. With
    exclude_self a target does not count the source of its own id: positions are targets' then, and what is left out is
    taken off again.
    """
    t, s = _sides(targets, sources)
    rows = s.join(values.select("source", F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL"), "source")
    spots = rows.groupBy("slat", "slon").agg(F.sum("__v").alias("v"), F.count("*").cast("double").alias("n"), F.min(F.struct("source", "__v")).alias("first"))
    blocks = max(1, -(-spots.count() // BLOCK))
    spots = spots.withColumn("block", F.pmod(F.xxhash64("slat", "slon"), F.lit(blocks)).cast("int"))
    # about BLOCK positions a row
    packed = spots.groupBy("block").agg(F.collect_list(F.struct("slat", "slon", "v", "n", "first")).alias("spots"))
    wanted = t.select("tlat", "tlon").distinct()
    if blocks <= MAX_BLOCKS:
        met = wanted.crossJoin(F.broadcast(packed))
    else:
        parts = 256
        wanted = wanted.withColumns({"part": F.pmod(F.xxhash64("tlat", "tlon"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        met = wanted.join(packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))), ["part", "block"])
    raw = lambda km: F.pow(km, num(-power)) if power not in (1.0, 2.0) else num(1) / (km if power == 1.0 else km * km)
    # a source that coincides weighs nothing among the others: with a bound it is the value itself, and without one the target's own
    floor = num(coincident_km) if coincident_km is not None else num(0)

    far = F.transform("spots", lambda p: km_apart(F.col("tlat"), F.col("tlon"), p["slat"], p["slon"]))
    met = met.withColumn("far", far).withColumn("w", F.transform("far", lambda km: F.when((km >= floor) & (km > 0), raw(km)).otherwise(num(0))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0), lambda acc, x: acc + x)
    close = F.array_min(F.zip_with("far", "spots", lambda km, p: F.when(km < floor if coincident_km is not None else km == 0, F.struct(km.alias("km"), p["first"].alias("first"), p["n"].alias("n"), p["v"].alias("v")))))
    sums = met.select("tlat", "tlon", dot("w", F.col("spots.v")).alias("wv"), dot("w", F.col("spots.n")).alias("wn"), close.alias("close"))
    sums = sums.groupBy("tlat", "tlon").agg(F.sum("wv").alias("wv"), F.sum("wn").alias("wn"), F.min("close").alias("close"))
    at = F.col("close.first.__v") if coincident_km is not None else F.lit(None).cast("double")
    if not exclude_self:
        if coincident_km is None:  # dividing by a distance of nothing gives no number
            at = F.when(F.col("close").isNotNull(), F.lit(float("nan")))
        found = sums.select("tlat", "tlon", F.coalesce(at, F.try_divide("wv", "wn")).alias(value))
        return t.join(found, ["tlat", "tlon"]).select("target", value)
    if coincident_km is not None:
        raise ValueError("exclude_self is for weights without a coincident source")
    # of its own position only the target's own source may stand there, and it weighs nothing
    alone = t.join(rows.select(F.col("source").alias("target"), F.col("slat").alias("tlat"), F.col("slon").alias("tlon"), F.lit(1.0).alias("own")), ["target", "tlat", "tlon"], "left")
    others = F.coalesce("close.n", num(0)) - F.coalesce("own", num(0))
    return alone.join(sums, ["tlat", "tlon"]).select("target", F.when(others > 0, F.lit(float("nan"))).otherwise(F.try_divide("wv", "wn")).alias(value))


def idw_weights(met: DataFrame, power: float = 2.0, coincident_km: float | None = 0.001) -> DataFrame:
    """target, source, weight: km^-power, summing to 1; a source within coincident_km takes all, the nearest of several.

    For few sources (stations), whose weights are used for many instants; inverse_distance needs no weights.
    """
    w = Window.partitionBy("target")
    raw = F.pow("km", num(-power)) if power not in (1.0, 2.0) else num(1) / (F.col("km") if power == 1.0 else F.col("km") * F.col("km"))
    if coincident_km is None:
        return met.withColumn("raw", raw).select("target", "source", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))
    best = F.min(F.struct("km", "source")).over(w)
    hit = best["km"] < num(coincident_km)
    weighed = met.withColumns({"hit": hit, "best": best}).withColumn("raw", F.when(F.col("hit"), F.when(F.col("source") == F.col("best.source"), num(1)).otherwise(num(0))).otherwise(raw))
    return weighed.select("target", "source", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def apply_weights(weights: DataFrame, values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """target, by, weighted sum of the sources' values: a matrix product.

    Sources are numbered. An instant is one row of its sources' numbers and values, a target one row of weights in the
    order of the numbers, BLOCK targets a block: instants meet blocks, and a target's sum is a dot product within the row.
    Rows shuffled are instants and targets; a source that an instant lacks, or whose value is null, counts nothing, and an
    instant without any value of a target's sources has no row.
    """
    sources = dense_index(weights.select("source").distinct(), ["source"], "__k")
    wide = weights.join(sources, "source").groupBy("target").agg(F.sort_array(F.collect_list(F.struct("__k", "weight"))).alias("w"))
    n = sources.count()
    # a target that has no weight for some source takes none of it
    full = F.when(F.size("w") == n, F.col("w.weight")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0)).cast("int")), lambda k: F.get(F.filter("w", lambda e: e["__k"] == k), F.lit(0))["weight"]))
    wide = wide.select("target", full.alias("w"))
    blocks = max(1, -(-wide.count() // BLOCK))
    packed = wide.withColumn("block", F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("target", "w")).alias("__ts"))
    instants = values.filter(F.col(value).isNotNull()).join(sources, "source").groupBy(*by).agg(F.collect_list(F.struct(F.col("__k").cast("int").alias("k"), F.col(value).cast("double").alias("v"))).alias("__vs"))
    if blocks * n <= MAX_SOURCES:  # of BLOCK weights each
        met = instants.crossJoin(F.broadcast(packed))
    else:
        met = instants.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")
    each = met.select(*by, "__vs", F.explode("__ts").alias("__t"))
    terms = F.filter(F.transform("__vs", lambda e: F.get(F.col("__t.w"), e["k"]) * e["v"]), lambda x: x.isNotNull())
    return each.select("__t.target", *by, terms.alias("__x")).filter(F.size("__x") > 0).select("target", *by, F.aggregate("__x", num(0), lambda a, x: a + x).alias(value))


def knot_count(lo: float, hi: float, step: float) -> int:
    """Points from lo in steps, up to half a step past hi."""
    return int(-(-(hi - lo + step / 2) // step))


def knots(spark, lat: tuple[float, float], lon: tuple[float, float], levels: Sequence[float] = LEVELS) -> DataFrame:
    """level, knot, lat, lon, support: a grid per level over the box."""
    found = None
    for k, spacing in enumerate(levels):
        sy, sx = spacing / KM_PER_LAT, spacing / KM_PER_LON
        ny, nx = knot_count(*lat, sy), knot_count(*lon, sx)
        level = spark.range(ny * nx).select(
            F.lit(k).alias("level"), F.col("id").alias("knot"), (num(lat[0]) + F.floor(F.col("id") / nx).cast("double") * num(sy)).alias("lat"),
            (num(lon[0]) + (F.col("id") % nx).cast("double") * num(sx)).alias("lon"), num(REACH * spacing).alias("support"),
        )
        found = level if found is None else found.unionByName(level)
    return found


def basis(targets: DataFrame, knot_table: DataFrame) -> DataFrame:
    """target, level, knot, phi where phi > 0.

    Knots and targets meet in square cells as wide as the level's support, a target in its own cell and its neighbours.
    """
    cell = lambda c, per, support: F.floor(c * num(per) / support)
    supports = knot_table.select("level", "support").distinct()
    t = targets.select(F.col("id").alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon")).crossJoin(F.broadcast(supports))
    for name, at, per in (("cy", "tlat", KM_PER_LAT), ("cx", "tlon", KM_PER_LON)):
        t = t.withColumn(name, F.explode(F.array(*[cell(F.col(at), per, F.col("support")) + k for k in (-1, 0, 1)])))
    k = knot_table.withColumns({"cy": cell(F.col("lat"), KM_PER_LAT, F.col("support")), "cx": cell(F.col("lon"), KM_PER_LON, F.col("support"))}).drop("support")
    met = t.join(k, ["level", "cy", "cx"])
    km = km_apart(F.col("tlat"), F.col("tlon"), F.col("lat"), F.col("lon"))
    return met.select("target", "level", "knot", wendland(km, F.col("support")).alias("phi")).filter("phi > 0")


def level_starts(lat: tuple[float, float], lon: tuple[float, float], levels: Sequence[float] = LEVELS) -> list[int]:
    """Where each level's knots begin in one numbering of all, and at the end how many there are."""
    sizes = [knot_count(*lat, s / KM_PER_LAT) * knot_count(*lon, s / KM_PER_LON) for s in levels]
    return [sum(sizes[:k]) for k in range(len(sizes) + 1)]


def basis_rows(phi: DataFrame, starts: Sequence[int]) -> DataFrame:
    """target, at, phi: of each target the places (in the numbering of level_starts) and values that are not zero, by place.

    As many entries as knots reach a target, which their number bounds.
    """
    place = F.element_at(F.array(*map(F.lit, starts)), F.col("level") + 1) + F.col("knot")
    rows = phi.groupBy("target").agg(F.sort_array(F.collect_list(F.struct(place.cast("int").alias("at"), "phi"))).alias("r"))
    return rows.select("target", F.col("r.at").alias("at"), F.col("r.phi").alias("phi"))


def active(phi: DataFrame, least: float = 1e-6) -> DataFrame:
    """level, knot of the basis columns that any target moves."""
    return phi.groupBy("level", "knot").agg(F.max(F.abs("phi")).alias("top")).filter(F.col("top") > num(least)).select("level", "knot")


def masked(phi: DataFrame, mask: DataFrame) -> DataFrame:
    return phi.join(mask, ["level", "knot"], "left_semi")


def pixels(places: DataFrame) -> DataFrame:
    """places with py, px: integer indices of the pixel they snap to."""
    return places.withColumns({"py": snap_index(F.col("lat"), PIXEL_LAT), "px": snap_index(F.col("lon"), PIXEL_LON)})


def neighbours(pixel_table: DataFrame) -> DataFrame:
    """py, px, side, ny, nx: the four pixels beside each."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for s, dy, dx in (("n", 1, 0), ("s", -1, 0), ("e", 0, 1), ("w", 0, -1))])
    return pixel_table.select("py", "px", F.explode(sides).alias("s")).select("py", "px", "s.side", (F.col("py") + F.col("s.dy")).alias("ny"), (F.col("px") + F.col("s.dx")).alias("nx"))


def _toward(size: int, k: int) -> Column:
    """A fixed unit vector of no particular direction, as an array literal."""
    v = [math.sin(1.0 + (k + 2) * math.sqrt(2.0) * (i + 1) * (i + 3)) for i in range(size)]
    norm = math.sqrt(sum(x * x for x in v))
    return F.array(*[num(x / norm) for x in v])


def near_duplicate_vectors(vectors: DataFrame, within: float, cell: float) -> DataFrame:
    """a, b, distance: pairs of vectors (id, v), all of one length, closer than within.

    Equal vectors are one: each is linked to the one with the smallest id, which meets other vectors for all. Vectors are
    dealt by their shadows on two fixed directions to cells at least as wide as within; two that are closer share a cell
    or stand in neighbouring ones. Ids alone are dealt, vectors join the pairs that are found.
    """
    if cell < within:
        raise ValueError("a cell is at least as wide as the distance")
    size = vectors.agg(F.max(F.size("v"))).first()[0]
    if not size or size < 0:
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b"), num(0).alias("distance")).limit(0)
    own = vectors.select("id", F.col("v").cast("array<double>").alias("v"))
    firsts = own.groupBy("v").agg(F.min("id").alias("id"))
    equal = own.join(firsts.select("v", F.col("id").alias("a")), "v").filter("a < id").select("a", F.col("id").alias("b"), num(0).alias("distance"))
    shadow = lambda k: F.floor(F.aggregate(F.zip_with("v", _toward(size, k), lambda x, y: x * y), num(0), lambda s, x: s + x) / num(cell))
    cells = firsts.select("id", shadow(0).alias("c0"), shadow(1).alias("c1"))
    # the eight neighbours are met from one side only: five of nine cells
    beside = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    dealt = cells.select("id", F.explode(beside).alias("d"), "c0", "c1").select(F.col("id").alias("i"), (F.col("c0") + F.col("d.y")).alias("c0"), (F.col("c1") + F.col("d.x")).alias("c1"), (F.col("d.y") == 0) & (F.col("d.x") == 0))
    dealt = dealt.toDF("i", "c0", "c1", "same")
    met = dealt.join(cells.withColumnRenamed("id", "j"), ["c0", "c1"]).filter("i < j OR NOT same").filter("i <> j")
    met = met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    met = met.join(firsts.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(firsts.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    far = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), num(0), lambda s, x: s + x))
    return met.select("a", "b", far.alias("distance")).filter(F.col("distance") < num(within)).unionByName(equal)
