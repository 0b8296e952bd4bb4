"""Administrative areas: boxes, edges, containment, and the addresses made from them.

areas come as vertices: level, area_id, name, ring, pos, lat, lon. (level, area_id) is an area; rings need not be closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import mercator_x, mercator_y

BINS = 32


def _ring():
    return Window.partitionBy("level", "area_id", "ring")


def projected(vertices: DataFrame) -> DataFrame:
    return vertices.withColumns({"mx": mercator_x(F.col("lon")), "my": mercator_y(F.col("lat"))})


def boxes(vertices: DataFrame) -> DataFrame:
    """Mercator box of each area over its rings of three or more vertices, and the box's centre."""
    rings = projected(vertices).withColumn("n", F.count("*").over(_ring())).where("n >= 3")
    box = rings.groupBy("level", "area_id", "name").agg(
        F.min("mx").alias("bl_x"), F.min("my").alias("bl_y"), F.max("mx").alias("tr_x"), F.max("my").alias("tr_y")
    )
    return box.selectExpr("*", "0.5D * (bl_x + tr_x) as center_x", "0.5D * (bl_y + tr_y) as center_y")


def level_extents(box: DataFrame) -> DataFrame:
    return box.groupBy("level").agg(
        F.max((F.col("tr_x") - F.col("bl_x")) / 2).alias("max_hw"), F.max((F.col("tr_y") - F.col("bl_y")) / 2).alias("max_hh")
    )


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Edges between consecutive vertices (the last joins the first), upwards; horizontal ones are left out."""
    order = _ring().orderBy("pos")
    ends = projected(vertices).select(
        "level", "area_id", "ring", "mx", "my",
        F.coalesce(F.lead("mx").over(order), F.first("mx").over(order)).alias("nx"),
        F.coalesce(F.lead("my").over(order), F.first("my").over(order)).alias("ny"),
    )
    up = F.col("my") < F.col("ny")
    edges = ends.where("my <> ny").select(
        "level", "area_id", "ring", F.least("my", "ny").alias("y_min"), F.greatest("my", "ny").alias("y_max"),
        F.when(up, F.col("mx")).otherwise(F.col("nx")).alias("x_at_y_min"),
        ((F.col("nx") - F.col("mx")) / F.nullif(F.col("ny") - F.col("my"), F.lit(0.0))).alias("inv_slope"),
    )
    return edges


def bin_of(y: Column, bl_y: Column, tr_y: Column) -> Column:
    """Which of the box's horizontal strips y is in."""
    height = (tr_y - bl_y) / BINS
    height = F.when(height < 1e-12, F.lit(1.0)).otherwise(height)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((y - bl_y) / height).cast("int")))


def edge_bins(vertices: DataFrame) -> DataFrame:
    """An edge's row for each strip of its area's box that it spans."""
    edges = ring_edges(vertices).join(boxes(vertices).select("level", "area_id", "bl_y", "tr_y"), ["level", "area_id"])
    low, high = (bin_of(F.col(c), F.col("bl_y"), F.col("tr_y")) for c in ("y_min", "y_max"))
    return edges.withColumn("bin", F.explode(F.sequence(low, high))).drop("bl_y", "tr_y")


def area_index(vertices: DataFrame) -> DataFrame:
    """Boxes with the edges of each ring by strip (strips: array of bins, each an array of rings of edges) and the size
    class k: cells of 2 ** k metres are at least as large as the box, which so meets four cells at most."""
    edge = F.struct("y_min", "y_max", "x_at_y_min", "inv_slope")
    rings = edge_bins(vertices).groupBy("level", "area_id", "bin", "ring").agg(F.collect_list(edge).alias("edges"))
    strips = rings.groupBy("level", "area_id", "bin").agg(F.collect_list("edges").alias("rings"))
    by_bin = strips.groupBy("level", "area_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "rings"))).alias("strips"))
    size = F.greatest(F.col("tr_x") - F.col("bl_x"), F.col("tr_y") - F.col("bl_y"), F.lit(1.0))
    return boxes(vertices).join(by_bin, ["level", "area_id"], "left").withColumn("k", F.ceil(F.log2(size)).cast("int"))


def in_area(mx: Column, my: Column, strips: Column, bl_y: Column, tr_y: Column) -> Column:
    """Even-odd ray casting: true inside any ring."""

    def crossed(e):
        return (my >= e["y_min"]) & (my < e["y_max"]) & (mx < e["x_at_y_min"] + (my - e["y_min"]) * e["inv_slope"])

    rings = strips[bin_of(my, bl_y, tr_y)]
    return F.coalesce(F.exists(rings, lambda ring: F.size(F.filter(ring, crossed)) % 2 == 1), F.lit(False))


def containing(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(point_id, level, area_id, name): every area that contains a point (point_id, lat, lon).

    Areas meet points in cells whose size follows the area's own, so the join has equal keys whatever the mix of sizes."""
    index = area_index(vertices)
    sizes = sorted(r.k for r in index.select("k").distinct().collect())  # powers of two: 30 or so
    if not sizes:
        sizes = [0]

    def cell(v, k):
        return F.floor(v / F.pow(F.lit(2.0), k)).cast("long")

    k = F.col("k")
    covered = index.select(
        "*", F.explode(F.sequence(cell(F.col("bl_x"), k), cell(F.col("tr_x"), k))).alias("cx")
    ).select("*", F.explode(F.sequence(cell(F.col("bl_y"), k), cell(F.col("tr_y"), k))).alias("cy"))
    placed = points.select("point_id", mercator_x(F.col("lon")).alias("px"), mercator_y(F.col("lat")).alias("py"))
    placed = placed.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("k"))
    placed = placed.select("*", cell(F.col("px"), k).alias("cx"), cell(F.col("py"), k).alias("cy"))
    a, p = covered.alias("a"), placed.alias("p")
    same = (F.col("a.k") == F.col("p.k")) & (F.col("a.cx") == F.col("p.cx")) & (F.col("a.cy") == F.col("p.cy"))
    box = F.col("px").between(F.col("bl_x"), F.col("tr_x")) & F.col("py").between(F.col("bl_y"), F.col("tr_y"))
    inside = in_area(F.col("px"), F.col("py"), F.col("strips"), F.col("bl_y"), F.col("tr_y"))
    return p.join(a, same & box & inside).select("point_id", "level", "area_id", "name")


def assign_admin_areas(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """The containing area of each point and level; of several the one with the smallest id."""
    hits = containing(points, vertices)
    best = hits.groupBy("point_id", "level").agg(F.min(F.struct("area_id", "name")).alias("a"))
    return best.select("point_id", "level", F.col("a.area_id").alias("area_id"), F.col("a.name").alias("name"))


def build_address(assigned: DataFrame) -> DataFrame:
    """(point_id, address): the areas' names from the lowest level up, each followed by a comma and a space."""
    names = assigned.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("level", "name"))).alias("names"))
    return names.select("point_id", F.array_join(F.transform("names", lambda n: F.concat(n["name"], F.lit(", "))), "").alias("address"))
