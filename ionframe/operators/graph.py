"""Graphs over tables of links: connected components, ranks, welding, orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.operators.spatial import CELL, at_cell, cell
from ionframe.storage import Scratch

#: ``monotonically_increasing_id`` counts a partition's rows in so many low bits.
ROW_BITS = 33


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for each node of a link.

    Every node points at the smallest node that it knows. In a round each link tells both ends' pointers the smaller of
    the two, minima are taken before and after the shuffle, and every node then takes its pointer's pointer; so chains
    halve, and the rounds end when no pointer falls.
    """
    scratch = Scratch(links.sparkSession)
    ends = [F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")]
    both = links.select(*ends).unionByName(links.select(ends[1].alias("a"), ends[0].alias("b"))).distinct()
    both = scratch.table(both, "links")
    low = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("low")), "pointers")
    known = None
    while True:
        total = low.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0]
        if total == known:
            scratch.drop("links")
            return low.select("node", F.col("low").alias("component"))
        known = total
        seen = both.join(low.withColumnsRenamed({"node": "b", "low": "told"}), "b").join(low.withColumnsRenamed({"node": "a", "low": "at"}), "a")
        told = seen.where("told < at").select(F.explode(F.array("a", "at")).alias("node"), "told").groupBy("node").agg(F.min("told").alias("told"))
        hooked = scratch.table(low.join(told, "node", "left").select("node", F.least("low", "told").alias("low")), "hooked")
        up = hooked.select(F.col("node").alias("low"), F.col("low").alias("up"))
        low = scratch.table(hooked.join(up, "low").select("node", F.least("low", "up").alias("low")), "pointers")


def numbered(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """The rows with ``name``, their place from 0 in an order: sorted by ranges, counted by range, and each range's rows counted on.

    One task sees a row for each range, none sees all rows.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table(placed, f"numbered-{name}").withColumn("_range", F.shiftright("_at", ROW_BITS))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(offsets, "_range").select(*rows.columns, place.alias(name))


def welded(points: DataFrame, reach: float) -> DataFrame:
    """(id, merged, node): points (id, pos) no farther than ``reach`` from each other, or from points between, become one.

    ``merged`` is the smallest id of those that meet, ``node`` counts the merged points from 0 in the order of ``merged``.
    Points look for partners in the cells around them only.
    """
    scratch = Scratch(points.sparkSession)
    near = scratch.table(points.select(F.col("id").cast("long").alias("id"), "pos"), "weld-points")
    left = at_cell(near, "pos", reach)
    right = near.select(F.col("id").alias("id2"), F.col("pos").alias("pos2"))
    for axis in "xyz":
        c = cell(F.col("pos2")[axis], reach)
        right = right.withColumn(f"g{axis}", F.explode(F.sequence(c - 1, c + 1)))
    links = left.join(right, CELL).where((F.col("id") < F.col("id2")) & (V.distance(F.col("pos"), F.col("pos2")) <= reach)).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    met = near.select("id").join(components(links), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("merged"))
    met = scratch.table(met, "welded")
    numbers = numbered(met.where("id = merged").select("merged").distinct(), ["merged"], "node", scratch)
    return met.join(numbers, "merged").select("id", "merged", "node")


def appended(meshes: list[tuple[DataFrame, DataFrame]], reach: float) -> tuple[DataFrame, DataFrame]:
    """(points, triangles) of several meshes (points (node_id, pos), triangles (tri_id, n0, n1, n2)) as one.

    Points of all meshes within ``reach`` are welded, nodes and triangles are numbered anew from 0, and triangles that lose
    a corner by welding are left out.
    """
    if not meshes:
        raise ValueError("no mesh to append")
    points = triangles = None
    for k, (p, t) in enumerate(meshes):
        p, t = p.select(F.lit(k).alias("mesh"), "node_id", "pos"), t.select(F.lit(k).alias("mesh"), "tri_id", "n0", "n1", "n2")
        points, triangles = (p, t) if points is None else (points.unionByName(p), triangles.unionByName(t))
    scratch = Scratch(points.sparkSession)
    points = scratch.table(numbered(points, ["mesh", "node_id"], "id", scratch), "points")
    met = scratch.table(welded(points, reach), "welded-points")
    kept = met.where("id = merged").join(points, "id").select(F.col("node").alias("node_id"), "pos")
    to = points.join(met, "id").select("mesh", "node_id", "node")
    for i in range(3):
        triangles = triangles.join(to.withColumnsRenamed({"node_id": f"n{i}", "node": f"m{i}"}), ["mesh", f"n{i}"])
    triangles = triangles.where("m0 <> m1 AND m1 <> m2 AND m2 <> m0")
    triangles = numbered(triangles, ["mesh", "tri_id"], "number", scratch)
    return kept, triangles.select(F.col("number").alias("tri_id"), *[F.col(f"m{i}").alias(f"n{i}") for i in range(3)])


def oriented(triangles: DataFrame) -> DataFrame:
    """(tri_id, component, turned, orientable) of triangles (tri_id, n0, n1, n2).

    Two triangles that run along their common edge in one direction face different sides. Each triangle stands twice in a
    graph, as it is and turned; an edge of exactly two triangles links the sides that agree. ``component`` is the smallest
    triangle that shared edges reach; ``turned`` says whether a triangle must be turned to face as that one does. On a
    surface with one side only (or a twisted band) both sides meet: ``orientable`` is false there and nothing is turned.
    """
    scratch = Scratch(triangles.sparkSession)
    sides = [F.struct(F.least(p, q).alias("low"), F.greatest(p, q).alias("high"), (F.col(p) < F.col(q)).alias("up")) for p, q in (("n0", "n1"), ("n1", "n2"), ("n2", "n0"))]
    edges = triangles.select(F.col("tri_id").cast("long").alias("t"), F.explode(F.array(*sides)).alias("e")).select("t", "e.*").where("low <> high")
    pairs = edges.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("s"), F.max("t").alias("t"), F.countDistinct("up").alias("ways")).where("n = 2 AND s <> t")
    same = F.when(F.col("ways") == 2, F.lit(0)).otherwise(F.lit(1))
    links = pairs.select(F.explode(F.array(*[F.struct((F.col("s") * 2 + k).alias("a"), (F.col("t") * 2 + F.abs(F.lit(k) - same)).alias("b")) for k in (0, 1)])).alias("l")).select("l.*")
    found = scratch.table(components(links), "sides")
    each = triangles.select("tri_id", (F.col("tri_id").cast("long") * 2).alias("as_is"), (F.col("tri_id").cast("long") * 2 + 1).alias("other"))
    a, b = (found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_low")) for side in ("as_is", "other"))
    low, high = F.coalesce("as_is_low", "as_is"), F.coalesce("other_low", "other")
    both = each.join(a, "as_is", "left").join(b, "other", "left")
    component = F.floor(F.least(low, high) / 2).cast("long")
    return both.select("tri_id", component.alias("component"), (low > high).alias("turned"), (low != high).alias("orientable"))


def cell_normals(triangles: DataFrame) -> DataFrame:
    """(tri_id, centre, normal, component, orientable) of triangles (tri_id, v0..v2, n0..n2): unit normals that agree within a
    component with its smallest triangle; flat triangles have a null normal."""
    v = [F.col(f"v{i}") for i in range(3)]
    whole = V.cross(V.sub(v[1], v[0]), V.sub(v[2], v[0]))
    shaped = triangles.select("tri_id", V.centroid(*v).alias("centre"), whole.alias("n")).join(oriented(triangles), "tri_id")
    size = F.sqrt(V.dot(F.col("n"), F.col("n")))
    sign = F.when(F.col("turned"), F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = F.when(size > 0, V.scale(F.col("n"), sign / F.nullif(size, F.lit(0.0))))
    return shaped.select("tri_id", "centre", normal.alias("normal"), "component", "orientable")


def spaced(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(pos, value): ``n`` evenly spaced of the sorted distinct values, places rounded half to even; nulls are left out."""
    scratch = Scratch(rows.sparkSession)
    places = numbered(rows.select(value).where(F.col(value).isNotNull()).distinct(), [value], "_place", scratch)
    last = max(places.count() - 1, 0)
    wanted = rows.sparkSession.range(n).select(F.col("id").alias("pos"), F.bround(F.col("id") * float(last) / max(n - 1, 1), 0).cast("long").alias("_place"))
    return places.join(F.broadcast(wanted), "_place").select("pos", value)
