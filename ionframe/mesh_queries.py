"""Mesh files, sinks and mesh graphs bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.operators import fem, graph
from ionframe.queries import _K, _P, _T, _det, bound_particles, bound_tetras, bound_triangles, query, r
from ionframe.sources import msh, text
from ionframe.storage import Scratch, new_path, table


@query(f"WITH {_K} SELECT tetra_id + 1 AS tetra_id, round(abs({_det('a', 'b', 'c', 'd')}) / 6, 4) AS volume, tetra_id * 4 + 1 AS n0, tetra_id * 4 + 4 AS n3 FROM k")
def msh_tetra_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Every tetrahedron with four nodes of its own, written as one .msh file and read back by ranges."""
    tetras = bound_tetras(spark, d)
    corners = tetras.select(F.posexplode(F.array(*[F.struct((F.col("tetra_id") * 4 + i + 1).alias("node_id"), F.col(f"v{i}").alias("v")) for i in range(4)])).alias("i", "c"))
    path = new_path(spark, "mesh") + ".msh"
    msh.write_msh(corners.select("c.node_id", "c.v.x", "c.v.y", "c.v.z"), tetras.select((F.col("tetra_id") + 1).alias("tetra_id"), *[(F.col("tetra_id") * 4 + i + 1).alias(f"n{i}") for i in range(4)]), path)
    found = msh.tetras(msh.read_msh(spark, path))
    return fem.with_centre(found).select("tetra_id", r("volume", 4).alias("volume"), "n0", "n3")


@query(f"WITH {_P} SELECT round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz FROM p")
def pos_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every particle's place and velocity as one .pos view and back."""
    rows = bound_particles(spark, d).select("pos.x", "pos.y", "pos.z", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.col("v.z").alias("vz"))
    path = new_path(spark, "view") + ".pos"
    text.write_pos_vectors(rows, path, 0.25)
    return text.read_pos(spark, path).select(*[r(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


_STRIP = 50


@query(f"""WITH {_T}, s AS (SELECT t.*, tri_id // {_STRIP} * {_STRIP} AS root, (tri_id * 7) % 3 = 0 AS swapped, (tri_id // {_STRIP} * {_STRIP} * 7) % 3 = 0 AS root_swapped,
 (t.by - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (t.by - ay) * (cx - ax) AS nz FROM t),
g AS (SELECT *, CASE WHEN (swapped <> root_swapped) <> ((tri_id - root) % 2 = 1) THEN -1.0 ELSE 1.0 END / sqrt(nx * nx + ny * ny + nz * nz) AS k FROM s)
SELECT tri_id, root AS component, true AS orientable, round((ax + bx + cx) / 3, 6) AS x, round(nx * k, 6) AS nx, round(ny * k, 6) AS ny, round(nz * k, 6) AS nz FROM g""")
def oriented_normals(spark: SparkSession, d: str) -> DataFrame:
    """Strips of triangles that share edges, some of them given the other way round; each strip faces as its first triangle."""
    first = F.col("tri_id") + F.floor(F.col("tri_id") / _STRIP) * 2
    swapped = F.col("tri_id") * 7 % 3 == 0
    nodes = {"n0": first, "n1": F.when(swapped, first + 2).otherwise(first + 1), "n2": F.when(swapped, first + 1).otherwise(first + 2)}
    found = graph.cell_normals(bound_triangles(spark, d).withColumns(nodes))
    return found.select("tri_id", "component", "orientable", r("centre.x").alias("x"), r("normal.x").alias("nx"), r("normal.y").alias("ny"), r("normal.z").alias("nz"))


@query(f"""WITH RECURSIVE {_P}, l AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) <= 2.5),
w AS (SELECT id AS source, id AS reached FROM p UNION SELECT w.source, l.b FROM w JOIN l ON l.a = w.reached), m AS (SELECT source AS id, min(reached) AS merged FROM w GROUP BY 1)
SELECT id, merged, dense_rank() OVER (ORDER BY merged) - 1 AS node FROM m""")
def welded_points(spark: SparkSession, d: str) -> DataFrame:
    """Particles no farther apart than 2.5, in chains of any length, as one node each."""
    return graph.welded(bound_particles(spark, d).select("id", "pos"), 2.5)


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY value NULLS FIRST, event_id) - 1 AS BIGINT) AS place FROM events")
def event_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each event's place in the order of values, without one task that sees all events."""
    return graph.numbered(table(spark, d, "events").select("value", "event_id"), ["value", "event_id"], "place", Scratch(spark)).select("event_id", "place")

