"""Triangle meshes: (tri_id, v0, v1, v2[, cnt]) and element tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.operators import pairs
from ionframe.storage import materialise


def with_shape(triangles: DataFrame) -> DataFrame:
    """Adds centroid and area."""
    v = [F.col(c) for c in ("v0", "v1", "v2")]
    return triangles.withColumn("centroid", V.centroid(*v)).withColumn("area", V.triangle_area(*v))


def joined_corners(elements: DataFrame, nodes: DataFrame, corners: int) -> DataFrame:
    """(element_id, v0..): the points of elements given as (element_id, nodes ARRAY); one equi-join, then a pivot."""
    each = elements.select("element_id", F.posexplode("nodes").alias("pos", "node_id"))
    point = F.struct("x", "y", "z")
    placed = each.join(nodes, "node_id").groupBy("element_id").agg(*[F.max(F.when(F.col("pos") == i, point)).alias(f"v{i}") for i in range(corners)])
    return placed


def left_share(xs: list[Column], c: float) -> Column:
    """Which share of a triangle's area lies left of x = c: quadratic between its sorted corners."""
    s = F.array_sort(F.array(*xs))
    a, b, d = s[0], s[1], s[2]
    rising = (c - a) * (c - a) / F.nullif((b - a) * (d - a), F.lit(0.0))
    falling = 1 - (d - c) * (d - c) / F.nullif((d - b) * (d - a), F.lit(0.0))
    return F.when(F.lit(c) <= a, 0.0).when(F.lit(c) >= d, 1.0).when(F.lit(c) <= b, rising).otherwise(falling)


def overlap_ratio(low: float, high: float) -> Column:
    """The share of a triangle's XY area in low <= x <= high; 0 for no area."""
    v = [F.col(c) for c in ("v0", "v1", "v2")]
    xs = [p["x"] for p in v]
    return F.when(V.area_xy(*v) == 0, 0.0).otherwise(left_share(xs, high) - left_share(xs, low))


def edges(triangles: DataFrame) -> DataFrame:
    """(tri_id, p, q): the edges of triangles given by node ids n0, n1, n2, smaller end first."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    return triangles.select("tri_id", F.explode(F.array(pair("n0", "n1"), pair("n1", "n2"), pair("n0", "n2"))).alias("e")).select("tri_id", "e.p", "e.q").distinct()


def classes(triangles: DataFrame) -> DataFrame:
    """(tri_id, cls): triangles with the same edges are one class, named by its smallest tri_id; one without edges is alone."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    each = triangles.where("tri_id IS NOT NULL").select("tri_id", F.explode(F.array(pair("n0", "n1"), pair("n1", "n2"), pair("n0", "n2"))).alias("e"))
    sides = each.groupBy("tri_id").agg(F.array_sort(F.collect_set(F.when(F.col("e.p").isNotNull(), F.col("e")))).alias("sides"))
    named = sides.withColumn("own", F.when(F.size("sides") == 0, F.col("tri_id")))
    least = named.groupBy("sides", F.coalesce("own", F.lit(-1)).alias("own")).agg(F.min("tri_id").alias("cls"))
    return materialise(named.withColumn("own", F.coalesce("own", F.lit(-1))).join(least, ["sides", "own"]).select("tri_id", "cls", "sides"), "classes")


def class_links(members: DataFrame) -> DataFrame:
    """(tri_id, neighbour): classes that share an edge, by their names; a class shares its own with itself."""
    e = members.where("tri_id = cls").select("tri_id", F.explode("sides").alias("e")).select("tri_id", "e.p", "e.q")
    other = e.select(F.col("tri_id").alias("neighbour"), "p", "q")
    return e.join(other, ["p", "q"]).select("tri_id", "neighbour").distinct()


def expanded(links: DataFrame, members: DataFrame, *kept: str) -> DataFrame:
    """(kept.., source, target): the triangles of both ends of (cls, other, kept..), a pair of classes once."""
    left = pairs.chunks(members.select("cls", "tri_id"), ["cls"], "source").withColumn("source", F.col("source.tri_id"))
    right = pairs.chunks(members.select(F.col("cls").alias("other"), "tri_id"), ["other"], "target").withColumn("target", F.col("target.tri_id"))
    return pairs.dealt(links.join(left, "cls").join(right, "other"), "source", "target", *kept)


def adjacency(triangles: DataFrame) -> DataFrame:
    """(tri_id, neighbour): triangles that share an edge.

    Found between classes of triangles with the same edges, so that the pairs of triangles are made once, by the task that
    returns them, and none is shuffled.
    """
    members = classes(triangles)
    links = class_links(members).select(F.col("tri_id").alias("cls"), F.col("neighbour").alias("other"))
    return expanded(links, members).where("source <> target").select(F.col("source").alias("tri_id"), F.col("target").alias("neighbour"))


def class_levels(members: DataFrame, levels: int = 4) -> DataFrame:
    """(cls, other, level): what each class reaches over shared edges, itself at level 0."""
    found = neighbour_levels(members.select(F.col("cls").alias("tri_id")).distinct(), materialise(class_links(members), "class-links"), levels)
    return found.select(F.col("source").alias("cls"), F.col("tri_id").alias("other"), "level")


def triangle_levels(triangles: DataFrame, levels: int = 4) -> DataFrame:
    """(source, tri_id, level): ``neighbour_levels`` of all triangles over ``adjacency``, found between classes."""
    members = classes(triangles)
    unnamed = triangles.where("tri_id IS NULL").select(F.col("tri_id").alias("source"), "tri_id", F.lit(0).alias("level")).distinct()
    if levels < 1:
        return members.select(F.col("tri_id").alias("source"), "tri_id", F.lit(0).alias("level")).unionByName(unnamed)
    found = expanded(class_levels(members, levels), members, "level")  # level 0 is between members of one class, which are a step apart
    level = F.when((F.col("level") == 0) & (F.col("source") != F.col("target")), 1).otherwise(F.col("level"))
    return found.select("source", F.col("target").alias("tri_id"), level.alias("level")).unionByName(unnamed)


def neighbour_levels(sources: DataFrame, links: DataFrame, levels: int = 4) -> DataFrame:
    """(source, tri_id, level): what each source reaches over (tri_id, neighbour) in at most ``levels`` steps; level 0 is itself."""
    reached = materialise(sources.select(F.col("tri_id").alias("source"), "tri_id", F.lit(0).alias("level")), "reached")
    front = reached
    for level in range(1, levels + 1):
        step = front.join(links, "tri_id").select("source", F.col("neighbour").alias("tri_id")).distinct()
        front = materialise(step.join(reached, ["source", "tri_id"], "left_anti").withColumn("level", F.lit(level)), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def group_cells(triangles: DataFrame, group_nodes: DataFrame) -> DataFrame:
    """tri_id of the triangles whose three nodes all are in (node_id)."""
    each = triangles.select("tri_id", F.explode(F.array("n0", "n1", "n2")).alias("node_id"))
    return each.join(group_nodes.select("node_id").distinct(), "node_id", "left_semi").groupBy("tri_id").count().where("count = 3").select("tri_id")


def bounding_box(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One row: least and greatest value of each column."""
    return points.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])


def within(df: DataFrame, box: DataFrame, factor: float, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Rows inside the one-row ``box`` widened around its centre by ``factor``, ends included."""
    row = box.first().asDict()
    cond = F.lit(True)
    for c in columns:
        middle, half = (row[f"{c}_min"] + row[f"{c}_max"]) / 2, (row[f"{c}_max"] - row[f"{c}_min"]) / 2 * factor
        cond = cond & F.col(c).between(middle - half, middle + half)
    return df.where(cond)


def extremes(triangles: DataFrame) -> DataFrame:
    """One row (min_id, max_cnt)."""
    return triangles.agg(F.min("tri_id").alias("min_id"), F.max("cnt").alias("max_cnt"))
