"""Exact nearest neighbours in degrees by cells of many sizes, and what is nearest to clicked points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import degree_distance2, haversine, mercator_x, mercator_y
from ..plans.tables import settled
from .areas import boxes, containing, level_extents

#: Targets in a cell of the finest level on average, were they spread evenly, and those that its fullest cell may hold.
WANTED, FULLEST = 2, 8
#: Targets of a cell that are compared one by one; the level up to which cells are few enough to be broadcast (4 ** level).
LISTED, COARSE, FINEST = 32, 7, 30
#: Targets that are broadcast whole, with their cells.
SMALL = 50_000
#: Pairs of points and targets for each core that are compared without going through quarters: a matter of the plan, not
#: of the result.
FEW = 4_000_000


def cells(df: DataFrame, size: float) -> DataFrame:
    """df with the grid cell (cx, cy) of each lat and lon."""
    return df.withColumns({"cx": F.floor(F.col("lat") / size).cast("long"), "cy": F.floor(F.col("lon") / size).cast("long")})


class Grid:
    """Square cells over both tables: one at level 0, four times as many at each further level, up to `finest`."""

    def __init__(self, points: DataFrame, targets: DataFrame):
        sides = [F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")]
        n, *own = targets.agg(F.count("*"), *sides).first()
        reach = points.agg(*sides).first()
        self.empty = not n or reach[0] is None
        if self.empty:
            return
        a, b, c, d = (f(x, y) for f, x, y in zip((min, max, min, max), own, reach, strict=True))
        self.lat0, self.lon0 = a, c
        self.extent = max(b - a, d - c, 1e-9) * (1 + 1e-9)
        self.pad = 1e-12 * (self.extent + abs(a) + abs(c))  # more than the rounding of cell edges
        area = max(own[1] - own[0], 1e-9) * max(own[3] - own[2], 1e-9)
        even = max(0, math.ceil(math.log2(self.extent / math.sqrt(area * WANTED / n))))
        self.finest, self.small = FINEST, n <= SMALL
        tried = sorted({min(FINEST, even + k) for k in (0, 2, 4, 6, 8, 12)} | {FINEST})
        full = self.at_levels(targets, tried).groupBy("level", "cx", "cy").count().groupBy("level").agg(F.max("count").alias("n")).collect()
        self.finest = min((r.level for r in full if r.n <= FULLEST), default=FINEST)  # places are distinct

    def size(self, level) -> Column:
        return F.lit(self.extent) / F.pow(F.lit(2.0), level)

    def placed(self, df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """df with its cell (cx, cy) of the finest level."""
        size = self.extent / 2**self.finest
        at = lambda c, zero: F.floor((F.col(c) - zero) / size).cast("long")
        return df.withColumns({"cx": at(lat, self.lat0), "cy": at(lon, self.lon0)})

    def at_levels(self, df: DataFrame, levels: list[int], lat: str = "lat", lon: str = "lon") -> DataFrame:
        """A row of df for each level, with the cell of that level."""
        each = self.placed(df, lat, lon).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        return each.withColumns({c: F.expr(f"shiftright({c}, {self.finest} - level)") for c in ("cx", "cy")})

    def cell_distance2(self) -> Column:
        """Squared distance that a place in the row's cell has at least."""
        size = self.size(F.col("level"))

        def away(c, zero, i):
            low = F.col(i) * size + zero
            return F.greatest(F.lit(0.0), low - F.col(c) - self.pad, F.col(c) - low - size - self.pad)

        x, y = away("lat", self.lat0, "cx"), away("lon", self.lon0, "cy")
        return x * x + y * y


def _in(asked: DataFrame, cell: DataFrame, small: bool) -> DataFrame:
    """asked joined to cell on level, cx and cy. A small table of cells is broadcast. Of others the coarse cells are, as
    they are few and hold many rows; the rest shuffles."""
    on = ["level", "cx", "cy"]
    if small:
        return asked.join(F.broadcast(cell), on)
    coarse = asked.where(F.col("level") <= COARSE).join(F.broadcast(cell.where(F.col("level") <= COARSE)), on)
    return coarse.unionByName(asked.where(F.col("level") > COARSE).join(cell.where(F.col("level") > COARSE), on))


def _tree(grid: Grid, located: DataFrame) -> DataFrame:
    """(level, cx, cy, n, rlat, rlon) of every cell that holds targets: their number and the place of one of them."""
    rows = grid.at_levels(located.withColumnsRenamed({"target_id": "rid", "lat": "rlat", "lon": "rlon"}), list(range(grid.finest + 1)), "rlat", "rlon")
    one = [F.max_by(c, "rid").alias(c) for c in ("rlat", "rlon")]
    return settled(rows.groupBy("level", "cx", "cy").agg(F.count("*").alias("n"), *one))


def find_nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(point_id, target_id, d2): the nearest target (target_id, lat, lon) of each point (point_id, lat, lon) by squared
    degrees, ties to the smaller id. Without targets there are no rows; null coordinates take no part.

    A point's own cells of many sizes give it a first target, whose distance bounds the search. The cells of about that
    size that the bound reaches are looked through: those with few targets one by one, the others by their quarters,
    with one target of each as a new bound, until none is left."""
    valid = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"
    located = settled(targets.where(valid).groupBy("lat", "lon").agg(F.min("target_id").alias("target_id")))
    # by point from the start, which all that is summed by point can use, also where the points come in one file
    cores = points.sparkSession.sparkContext.defaultParallelism
    many = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = points.where(valid).select("point_id", "lat", "lon").repartition(many, "point_id")
    grid = Grid(live, located)
    if grid.empty:
        return live.limit(0).select("point_id", F.lit(None).cast("long").alias("target_id"), F.lit(None).cast("double").alias("d2"))
    tree = _tree(grid, located)
    d2 = degree_distance2(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    own = ["point_id", "lat", "lon"]
    first = _in(grid.at_levels(live, list(range(grid.finest + 1))), tree, grid.small).groupBy(*own).agg(F.min(d2).alias("most"))
    reach = F.sqrt("most") * (1 + 1e-9) + grid.pad
    level = F.least(F.lit(grid.finest), F.greatest(F.lit(0), F.floor(F.log2(F.lit(grid.extent) / reach)))).cast("int")
    size = grid.size(F.col("level"))
    cover = lambda c, zero: F.explode(F.sequence(*(
        F.greatest(F.lit(0), F.least(F.floor((F.col(c) + by - zero) / size), F.pow(F.lit(2.0), F.col("level")) - 1)).cast("long")
        for by in (-F.col("reach"), F.col("reach"))
    )))
    front = first.select("*", reach.alias("reach"), level.alias("level")).select("*", cover("lat", grid.lat0).alias("cx"))
    front = front.select("*", cover("lon", grid.lon0).alias("cy")).drop("reach").where(grid.cell_distance2() <= F.col("most"))
    found = None
    while True:
        front = settled(_in(front, tree.select("level", "cx", "cy", "n"), grid.small))
        pairs = {r.level: r for r in front.groupBy("level").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}  # FINEST rows at most
        few = sum(r.n for r in pairs.values()) <= FEW * cores
        listed = F.lit(True) if few else (F.col("n") <= LISTED) | (F.col("level") == grid.finest)
        there = grid.at_levels(located, sorted(pairs) or [0]).withColumnsRenamed({"lat": "rlat", "lon": "rlon"})
        near = _in(front.where(listed).drop("n"), there, grid.small).withColumn("d2", d2).where("d2 <= most").select("point_id", "target_id", "d2")
        found = near if found is None else found.unionByName(near)
        if few or all(r.most <= LISTED or level == grid.finest for level, r in pairs.items()):
            break
        deep = front.where(~listed)
        quarters = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
        parts = deep.select(*own, "most", (F.col("level") + 1).alias("level"), "cx", "cy", quarters.alias("q"))
        parts = parts.select(*own, "most", "level", (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"))
        parts = settled(_in(parts, tree.select("level", "cx", "cy", "rlat", "rlon"), grid.small))
        least = parts.groupBy(*own).agg(F.min(d2).alias("least"))
        front = parts.join(least, own).withColumn("most", F.least("most", "least")).where(grid.cell_distance2() <= F.col("most")).select(*own, "most", "level", "cx", "cy")
    found = settled(found)
    best = found.groupBy("point_id").agg(F.min("d2").alias("d2"))
    return found.join(best, ["point_id", "d2"]).groupBy("point_id", "d2").agg(F.min("target_id").alias("target_id")).select("point_id", "target_id", "d2")


def nearest_building(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """The nearest building of each point by degrees, with the distance in metres."""
    targets = buildings.select(F.col("building_id").alias("target_id"), "lat", "lon")
    found = find_nearest(points, targets).withColumnRenamed("target_id", "building_id")
    at = points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    joined = found.join(at, "point_id").join(buildings, "building_id")
    return joined.withColumn("distance", haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))).drop("d2", "plat", "plon")


def nearest_street(points: DataFrame, street_points: DataFrame) -> DataFrame:
    """(point_id, street_id, name, distance): the street that owns the nearest vertex by degrees; the distance is the
    least in metres to any vertex of that street."""
    targets = street_points.select(F.col("street_id").alias("target_id"), "lat", "lon")
    found = find_nearest(points, targets).select("point_id", F.col("target_id").alias("street_id"))
    at = points.select("point_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    joined = found.join(at, "point_id").join(street_points, "street_id")
    away = haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return joined.groupBy("point_id", "street_id", "name").agg(F.min(away).alias("distance"))


def nearest_admin_area(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(point_id, level, area_id, name, distance) for points (point_id, lat, lon, filter, expected_level).

    The area of the highest level that contains the point, at distance 0; else, of the areas whose box centre is within
    the level's largest half extents of the point, the one with the nearest vertex in metres (ties: higher level, then
    smaller id). With filter other than 0 only expected_level counts. No candidates: no row."""
    asked = (F.col("filter") == 0) | (F.col("level") == F.col("expected_level"))
    wanted = points.select("point_id", "filter", "expected_level")
    hits = containing(points, vertices).join(wanted, "point_id").where(asked)
    inside = hits.groupBy("point_id").agg(F.max(F.struct("level", (-F.col("area_id")).alias("at"), "name")).alias("a"))
    inside = inside.select("point_id", F.col("a.level").alias("level"), (-F.col("a.at")).alias("area_id"), F.col("a.name").alias("name"), F.lit(0.0).alias("distance"))
    left = points.join(inside.select("point_id"), "point_id", "left_anti")
    candidates = centred(
        left.select("point_id", "lat", "lon", "filter", "expected_level", mercator_x(F.col("lon")).alias("x0"), mercator_y(F.col("lat")).alias("y0"))
        .withColumns({"x1": F.col("x0"), "y1": F.col("y0")}), boxes(vertices),
    ).where(asked)
    ends = vertices.select("level", "area_id", F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
    near = candidates.join(ends, ["level", "area_id"])
    away = near.groupBy("point_id", "level", "area_id", "name").agg(
        F.min(haversine(F.col("lat"), F.col("lon"), F.col("vlat"), F.col("vlon"))).alias("distance")
    )
    best = away.groupBy("point_id").agg(F.min(F.struct("distance", (-F.col("level")).alias("up"), "area_id", "name")).alias("a"))
    best = best.select("point_id", (-F.col("a.up")).alias("level"), F.col("a.area_id").alias("area_id"), F.col("a.name").alias("name"), F.col("a.distance").alias("distance"))
    return inside.unionByName(best)


#: Sizes of cells, each twice the one before, in which frames meet areas: from a level's extents to the whole map.
SIZES = 24


def centred(frames: DataFrame, box: DataFrame) -> DataFrame:
    """frames (with a Mercator box x0, y0, x1, y1) joined to the areas whose box centre lies in the frame widened by the
    level's largest half extents. A frame meets the areas in cells of its own widened size, so it covers four at most
    and the join has equal keys; an area has a cell of each size."""
    extents = [(r.level, r.max_hw, r.max_hh) for r in level_extents(box).collect()]  # one row a level
    if not extents:
        return frames.crossJoin(box.limit(0))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(hw).alias("hw"), F.lit(hh).alias("hh")) for n, hw, hh in extents)))
    side = lambda half: F.greatest(2 * F.col(f"e.{half}"), F.lit(1.0))
    keyed = lambda df: df.withColumn("e", each).select(*df.columns, F.col("e.n").alias("__level"), "e.hw", "e.hh", side("hw").alias("w"), side("hh").alias("h"))
    twice = F.pow(F.lit(2.0), F.col("k"))
    at = lambda c, by, s: F.floor((c + by) / (F.col(s) * twice)).cast("long")
    wide = keyed(frames)
    ratio = F.greatest((F.col("x1") - F.col("x0")) / F.col("w"), (F.col("y1") - F.col("y0")) / F.col("h")) + 1
    wide = wide.withColumn("k", F.least(F.ceil(F.log2(F.greatest(ratio, F.lit(1.0)))), F.lit(SIZES)).cast("int"))
    for cell, lo, hi, half, s in (("cx", "x0", "x1", "hw", "w"), ("cy", "y0", "y1", "hh", "h")):
        wide = wide.withColumn(cell, F.explode(F.sequence(at(F.col(lo), -F.col(half), s), at(F.col(hi), F.col(half), s))))
    own = keyed(box).where(F.col("__level") == F.col("level")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SIZES))))
    own = own.withColumns({"cx": at(F.col("center_x"), F.lit(0.0), "w"), "cy": at(F.col("center_y"), F.lit(0.0), "h")}).drop("w", "h", "hw", "hh", "__level")
    near = F.col("center_x").between(F.col("x0") - F.col("hw"), F.col("x1") + F.col("hw"))
    near &= F.col("center_y").between(F.col("y0") - F.col("hh"), F.col("y1") + F.col("hh"))
    met = wide.withColumnRenamed("__level", "level").join(own, ["level", "k", "cx", "cy"]).where(near)
    return met.select(*frames.columns, *(c for c in box.columns))


def nearest_object(distances: DataFrame) -> DataFrame:
    """distances (point_id, building, street, area; null: not visible) with kind: which of them is shown."""
    b, s, a = F.col("building"), F.col("street"), F.col("area")
    area_first = F.when(b < s, F.when(a < b, "area").otherwise("building")).otherwise(F.when(a < s, "area").otherwise("street"))
    kind = (
        F.when(b.isNotNull() & s.isNotNull() & a.isNotNull(), area_first)
        .when(b.isNotNull() & s.isNotNull(), F.when(b < s, "building").otherwise("street"))
        .when(b.isNotNull() & a.isNotNull(), F.when(b < a, "building").otherwise("area"))
        .when(s.isNotNull() & a.isNotNull(), F.when(s < a, "street").otherwise("area"))
        .when(b.isNotNull(), "building").when(s.isNotNull(), "street").when(a.isNotNull(), "area")
    )
    return distances.withColumn("kind", kind)
