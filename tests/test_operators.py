"""Geometry, gather, finite elements, tracks, sources and sinks, and the time loop on small inputs."""

import json
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.operators import deposition, distribute, fem, gather, mesh, spatial, tracks
from ionframe.plans import simulation
from ionframe.sources import config, msh, particles, text
from ionframe.streaming import emission


def points(spark, rows, names):
    fields = ", ".join(f"{n} struct<x:double,y:double,z:double>" if n[0] in "vp" and n != "particle_id" else f"{n} long" for n in names)
    return spark.createDataFrame(rows, fields)


HITS = [
    ((0, 0, 0), (0, 0, 1), (-1, 1, 0.5), (1, 1, 0.5), (0, -1, 0.5), (0, 0, 0.5)),
    ((1, 0, 0), (1, 0, 1), (-1, 1, 0.5), (1, 1, 0.5), (0, -1, 0.5), None),
    ((-1, 0, 0), (-1, 0, 1), (-1, 1, 0.5), (1, 1, 0.5), (0, -1, 0.5), None),
    ((0, 0, 0), (1, 0, 0), (0.5, 1, 1), (0.5, -1, 1), (0.5, 0, -1), (0.5, 0, 0)),
    ((-1, 0, 0), (1, -1, 0), (0.5, 1, 1), (0.5, -1, 1), (0.5, 0, -1), None),
    ((0, 0, 0), (0, 0, 0), (-1, 1, 0), (1, 1, 0), (0, -1, 0), None),
]


@pytest.mark.parametrize("case", HITS)
@pytest.mark.parametrize("edge", [0.3, 5.0])
def test_segment_hits(spark, case, edge):
    p0, p1, a, b, c, at = case
    f = lambda p: tuple(map(float, p))
    found = spatial.first_hits(points(spark, [(1, f(p0), f(p1))], ["id", "p0", "p1"]), points(spark, [(7, f(a), f(b), f(c))], ["tri_id", "v0", "v1", "v2"]), edge).collect()
    assert (found == []) if at is None else tuple(found[0]["point"]) == pytest.approx(at, abs=1e-5)


@pytest.mark.parametrize("edge", [0.7, 3.0, 50.0])
def test_traversal_finds_what_all_pairs_find(spark, edge):
    """Long segments, large and flat triangles, and coordinates on the planes between cells, against every pair."""
    rng = np.random.default_rng(int(edge * 10))
    place = lambda size: rng.normal(0, size, 3) if rng.random() < 0.6 else np.round(rng.normal(0, size, 3) / edge) * edge
    segments = [(i, tuple(map(float, place(6))), tuple(map(float, place(6)))) for i in range(60)]
    segments += [(100, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)), (101, (-20.0, 0.0, 0.0), (20.0, 0.0, 0.0)), (102, (0.0, 0.0, 15.0), (0.0, 0.0, -15.0))]
    triangles = [(i, *[tuple(map(float, place(4))) for _ in range(3)]) for i in range(60)]
    triangles += [(200, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0)), (201, (0.0, -9.0, -9.0), (0.0, 9.0, -9.0), (0.0, 0.0, 9.0)), (202, (-5.0, -5.0, 0.0), (5.0, -5.0, 0.0), (0.0, 5.0, 0.0))]
    want, touched = set(), set()
    for i, p0, p1 in segments:
        d = np.subtract(p1, p0)
        for t, a, b, c in triangles:
            e1, e2, s = np.subtract(b, a), np.subtract(c, a), np.subtract(p0, a)
            det = e1 @ np.cross(d, e2)
            if det:
                u, w, share = s @ np.cross(d, e2) / det, d @ np.cross(s, e1) / det, e2 @ np.cross(s, e1) / det
                margin = min(u, w, 1 - u - w, share, 1 - share)
                if margin > -1e-9:
                    (want if margin > 1e-9 else touched).add((i, t, round(float(share), 7)))
    frames = points(spark, segments, ["id", "p0", "p1"]), points(spark, triangles, ["tri_id", "v0", "v1", "v2"])
    found = [(r.id, r.tri_id, round(r.share, 7)) for r in spatial.segment_hits(*frames, edge).collect()]
    assert len(found) == len(set(found)) and want <= set(found) <= want | touched
    nearest = {}
    for i, t, share in found:
        nearest[i] = min(nearest.get(i, (2, 0)), (share, t))
    assert {(r.id, round(r.share, 7)) for r in spatial.first_hits(*frames, edge).collect()} == {(i, s) for i, (s, _) in nearest.items()}


def cube(spark):
    """A 100-cube in six tetrahedra around its diagonal."""
    corner = {n: tuple(100.0 * ((n >> k) & 1) for k in range(3)) for n in range(8)}
    cells = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]
    rows = [(i, *[corner[n] for n in c], *[n + 1 for n in c]) for i, c in enumerate(cells)]
    return points(spark, rows, ["tetra_id", "v0", "v1", "v2", "v3", "n0", "n1", "n2", "n3"])


def test_containment_and_gather(spark):
    tetras = cube(spark)
    inside = points(spark, [(1, (60.0, 30.0, 10.0)), (2, (10.0, 60.0, 30.0)), (3, (500.0, 0.0, 0.0)), (4, (50.0, 50.0, 50.0))], ["id", "pos"])
    found = spatial.containing_tetras(inside, tetras, 25.0)
    n = {r["id"]: r["count"] for r in found.groupBy("id").count().collect()}
    assert n == {1: 1, 2: 1, 4: 6}  # the centre lies on the diagonal of all six
    one = found.where("id < 3").withColumn("charge_c", F.lit(2.0))
    cells = gather.tetra_charge(one, fem.with_gradients(tetras))
    total = cells.agg(F.sum(F.col("density") * F.col("volume"))).first()[0]
    assert total == pytest.approx(4.0)
    density = {r.node_id: r.value for r in gather.node_density(cells, fem.tetra_nodes(tetras)).collect()}
    assert density[1] == pytest.approx(4.0 / (2e6 / 6)) and 5 not in density


def test_stiffness_and_solve(spark):
    tetras = cube(spark)
    k = fem.stiffness(tetras)
    sums = k.groupBy("row").agg(F.sum("value").alias("s")).collect()
    assert max(abs(r.s) for r in sums) < 1e-9
    matrix = k.select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "value")
    rhs = spark.range(8).select(F.col("id").alias("idx"), F.lit(0.0).alias("value"))
    # potential z on the faces z = 0 and z = 100: nodes 1-4 and 5-8 by their third bit
    bc = spark.createDataFrame([(n + 1, 100.0 if n & 4 else 0.0) for n in (0, 1, 2, 4, 5, 6, 7)], "node_id long, value double")
    got = {r.idx: r.value for r in fem.solve(matrix, rhs, bc).collect()}
    assert got[3] == pytest.approx(0.0, abs=1e-6) or got[3] < 100
    dense = np.zeros((8, 8))
    for r in fem.dirichlet_matrix(matrix, bc).collect():
        dense[r.row, r.col] += r.value
    b = np.zeros(8)
    for r in fem.dirichlet_rhs(rhs, bc).collect():
        b[r.idx] = r.value
    assert np.allclose(np.linalg.solve(dense, b), [got[i] for i in range(8)], atol=1e-6)
    phi = spark.createDataFrame([(n + 1, 100.0 if n & 4 else 0.0) for n in range(8)], "node_id long, phi double")
    for r in fem.field(tetras, phi).collect():
        assert (r.ex, r.ey, r.ez) == pytest.approx((0, 0, -1))


def test_matrix_access(spark):
    m = spark.createDataFrame([(0, 1, 2.5), (1, 0, 3.0), (1, 1, 4.0)], "row long, col long, value double")
    assert fem.at(m, 0, 1) == 2.5 and fem.at(m, 1, 1) == 4
    with pytest.raises(IndexError):
        fem.at(m, 0, 0)
    ones = spark.range(5).crossJoin(spark.range(5).withColumnRenamed("id", "c")).select(F.col("id").alias("row"), F.col("c").alias("col"), F.lit(1.0).alias("value"))
    bc = spark.createDataFrame([(1, 1.0), (2, 0.0)], "node_id long, value double")
    rows = {r.row: sorted((x["col"], x["value"]) for x in r.cells) for r in fem.dirichlet_matrix(ones, bc).groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("cells")).collect()}
    assert rows[0] == [(0, 1.0)] and rows[1] == [(1, 1.0)] and len(rows[2]) == 5
    with pytest.raises(IndexError):
        fem.check_nodes(bc, 1)
    with pytest.raises(ValueError):
        fem.check_accuracy(21)
    with pytest.raises(ValueError):
        fem.solve(m, m, bc, "XY")
    assert fem.check_accuracy(20) == 1001


def test_band_histogram(spark):
    rows = [(1, (49.0, 0.2, 0.0), (51.0, 0.2, 0.0), (50.0, 0.8, 0.0), 10), (2, (51.0, 5.0, 0.0), (53.0, 5.0, 0.0), (51.0, 7.0, 0.0), 8), (3, (50.0, 3.0, 0.0), (50.0, 4.0, 0.0), (50.0, 5.0, 0.0), 5), (4, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), 3)]
    cells = points(spark, rows, ["tri_id", "v0", "v1", "v2", "cnt"])
    assert [tuple(r) for r in deposition.band_histogram(cells).orderBy("y_bin").collect()] == [(0, 10.0), (5, 8 * 0.75)]
    assert [r.tri_id for r in deposition.band_listing(cells).collect()] == [1]


def test_envelope_edges(spark):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 5, 2, 0, 0, 0])], "g int, i int, v double")
    got = [(r.envelope, r.smooth) for r in deposition.envelope(rows, "v", ["i"], ["g"]).orderBy("i").collect()]
    env = [5, 5, 5, 5, 2, 0]
    assert [g[0] for g in got] == env
    assert [g[1] for g in got] == pytest.approx(list(np.convolve(env, np.ones(5) / 5, mode="same")))


def strip(spark, n=6):
    rows = [(i, (float(i), 0.0, 0.0), (i + 1.0, 0.0, 0.0), (float(i), 1.0, 0.0), i, i + 1, i + 2, 50 if i == 2 else 0) for i in range(n)]
    return points(spark, rows, ["tri_id", "v0", "v1", "v2", "n0", "n1", "n2", "cnt"])


def test_neighbours_and_distribution(spark):
    cells = strip(spark)
    links = mesh.adjacency(cells)
    assert {tuple(r) for r in links.collect()} == {(i, j) for i in range(6) for j in range(6) if abs(i - j) == 1}
    reached = mesh.neighbour_levels(cells.select("tri_id"), links, 2)
    assert {(r.source, r.tri_id, r.level) for r in reached.collect()} == {(i, j, abs(i - j)) for i in range(6) for j in range(6) if abs(i - j) <= 2}
    shares = distribute.shares(cells, reached, 1)
    nums = {r.target: r.num for r in shares.collect()}
    assert set(nums) == {0, 1, 2, 3, 4} and nums[2] == max(nums.values()) and nums[1] == nums[3]
    spread = {r.tri_id: r.cnt for r in distribute.distributed(cells, reached, 1).collect()}
    assert spread[5] == 0 and 490 <= sum(spread.values()) <= 500
    at = distribute.positions(shares, cells, 3).collect()
    assert len(at) == 5 and all(abs(r.pos.z) <= 0.05 for r in at)
    assert mesh.group_cells(cells, spark.range(4).select(F.col("id").alias("node_id"))).count() == 2


def test_tracks(spark):
    rows = spark.createDataFrame([(p, s, float(s), 0.0, float(p)) for p, n in ((1, 3), (2, 5), (3, 1), (4, 3)) for s in range(n)], "particle_id long, seq int, x double, y double, z double")
    assert tracks.segments(rows).count() == 8
    last = {(r.particle_id, r.seq): r.ix for r in tracks.interpolated(rows, 0.5).collect()}
    assert last[2, 0] == 0.5 and last[2, 4] == 4.0
    assert [tuple(r) for r in tracks.spawn_groups(rows, 2, 1).orderBy("spawn", "particle_id").collect()] == [(1, 3, 0), (2, 5, 0)]
    assert {r.particle_id for r in tracks.nested(rows).collect()} == {1, 2, 4}
    assert tracks.recorded(rows, 2).select("particle_id").distinct().count() == 2
    assert [r.x for r in tracks.spaced_values(rows, "x", 3).orderBy("pos").collect()] == [0, 2, 4]


CONFIG = {"Mesh File": "a.msh", "Threads": 4, "Time Step": 0.01, "Simulation Time": 1.0, "T": 300.0, "P": 1.0, "Gas": "He", "Model": "VSS", "EdgeSize": "1.0", "DesiredAccuracy": "2",
          "ParticleSourcePoint": {"1": {"Type": "Ar", "Count": 50, "Energy": 10, "phi": 0, "theta": 0.5, "expansionAngle": 0.1, "BaseCoordinates": [0, 0, 0]}, "2": {"Type": "He", "Count": 30, "Energy": 20, "phi": 0, "theta": 0, "expansionAngle": 0, "BaseCoordinates": [10, 10, 10]}},
          "ParticleSourceSurface": {"1": {"Type": "Ti", "Count": 50, "Energy": 10, "BaseCoordinates": {"0, 0, 0": [0, 0, 1], "1, 1, 1": [0, 1, 0], "2, 2, 2": [1, 0, 0]}}},
          "Boundary Conditions": {"1, 2,3": 0.5, "7": 1.0}, "Extra": 1}


def written(tmp_path, data):
    file = tmp_path / "config.json"
    file.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(file)


def test_config(spark, tmp_path):
    found = config.read_config(spark, written(tmp_path, CONFIG))
    row = found.first()
    assert row["EdgeSize"] == 1.0 and row["DesiredAccuracy"] == 2 and row["Gas"] == "He"
    assert {r.node_id: r.value for r in config.config_conditions(found).collect()} == {1: 0.5, 2: 0.5, 3: 0.5, 7: 1.0}
    made = particles.all_particles(particles.from_points(config.point_sources(found)), particles.from_surfaces(config.surface_sources(found), first_id=80))
    assert made.count() == 130 and made.select("id").distinct().count() == 130
    counts = {r.source: r["count"] for r in made.where("species = 'Ti'").groupBy("source").count().collect()}
    assert counts == {"1:0, 0, 0": 17, "1:1, 1, 1": 17, "1:2, 2, 2": 16}
    up = made.where("source = '1:0, 0, 0'").first()
    assert up.v.x == pytest.approx(0, abs=1e-9) and up.v.z > 0
    moves = spark.createDataFrame([("2", (0.0, -4.0, 2.0))], "source string, direction struct<x:double,y:double,z:double>")
    assert tuple(particles.displaced(made.where("source = '2'"), moves).first().pos) == pytest.approx((10, 9.95, 10.025))


@pytest.mark.parametrize("change", ["", "{", "{}", {k: v for k, v in CONFIG.items() if k != "P"}, CONFIG | {"Threads": "many"}])
def test_bad_configs(spark, tmp_path, change):
    with pytest.raises(ValueError):
        config.read_config(spark, written(tmp_path, change))


def test_bad_sources_and_conditions(spark):
    cols = "name string, type string, count long, energy_ev double, phi double, theta double, expansion double"
    for row in (("a", "Xx", 1, 1.0), ("a", "Ar", 0, 1.0), ("a", "Ar", 1, 0.0)):
        with pytest.raises(ValueError):
            particles.from_points(spark.createDataFrame([(*row, 0.0, 0.0, 0.0)], cols).withColumn("pos", V.vec(0, 0, 0)))
    for ids in ("1,x", "1,2,1", "99999999999999999999"):
        with pytest.raises(ValueError):
            config.boundary_conditions(spark.createDataFrame([(ids, 1.0)], "node_ids string, value double"))
    with pytest.raises(ValueError):
        config.check_run(0.0, 1)
    with pytest.raises(ValueError):
        config.read_config(spark, "")


MSH = """$MeshFormat
4.1 0 8
$EndMeshFormat
$PhysicalNames
1
2 5 "Target side"
$EndPhysicalNames
$Entities
1 0 1 1
1 0 0 0 0
1 0 0 0 1 1 1 1 5 2 -1 2
1 0 0 0 1 1 1 0 2 1 -2
$EndEntities
$Nodes
2 5 1 5
2 1 0 3
1
2
3
0 0 0
1 0 0
0 1 0
3 1 0 2
4
5
0 0 1
1 1 1
$EndNodes
$Elements
2 4 1 4
2 1 2 2
1 1 2 3
2 1 2 4
3 1 4 2
3 1 2 3 4
4 2 3 4 5
$EndElements
"""


def test_msh(spark, tmp_path):
    file = tmp_path / "a.msh"
    file.write_text(MSH)
    found = msh.read_msh(spark, str(file))
    assert msh.nodes(found).count() == 5 and msh.physical_groups(found).first()["name"] == "Target side"
    assert {tuple(r) for r in msh.boundary_tags(found).collect()} == {(1, 1), (1, 2)}
    tri = mesh.with_shape(msh.triangles(found)).orderBy("tri_id").collect()
    assert [r.area for r in tri] == [0.5, 0.5] and tri[0].cnt == 0
    assert fem.with_gradients(msh.tetras(found)).agg(F.sum("volume")).first()[0] == pytest.approx(1 / 6 + 1 / 3)
    assert {(r.entity_dim, tuple(r.element_ids)) for r in msh.tree(found).collect()} == {(2, (1, 2)), (3, (3, 4))}
    (tmp_path / "b.txt").write_text("x")
    with pytest.raises(ValueError):
        msh.read_msh(spark, str(tmp_path / "b.txt"))
    (tmp_path / "c.msh").write_text("")
    (tmp_path / "d.msh").mkdir()
    for name, error in (("c", ValueError), ("d", IsADirectoryError), ("e", FileNotFoundError)):
        with pytest.raises(error):
            msh.read_msh(spark, str(tmp_path / f"{name}.msh"))
    (tmp_path / "f.msh").write_text("$MeshFormat\n4.1 0 8\n$EndMeshFormat\n")
    with pytest.raises(Exception, match="no mesh"):
        msh.nodes(msh.read_msh(spark, str(tmp_path / "f.msh"))).count()
    assert msh.group_tag(found, "Target side") == msh.physical_groups(found).first()["tag"]
    assert msh.has_group(found, "Target side") and not msh.has_group(found, "other")
    with pytest.raises(KeyError):
        msh.group_tag(found, "other")


def test_msh_index_finds_every_line(monkeypatch, tmp_path):
    """Chunks that cut lines and section names anywhere, and partitions of two lines."""
    file = tmp_path / "a.msh"
    file.write_text(MSH)
    want = [len(x) for x in MSH.splitlines(keepends=True)]
    for chunk in (1, 2, 7, 64, 4096):
        monkeypatch.setattr(msh, "CHUNK", chunk)
        monkeypatch.setattr(msh, "ROWS_EACH", 2)
        with open(file, "rb") as f:
            lines = msh.Lines(pa.PythonFile(f))
            assert [lines.place(k) for k in range(len(want) + 1)] == [sum(want[:k]) for k in range(len(want) + 1)]
            assert {"Nodes", "EndNodes", "Elements", "EndElements"} <= set(lines.sections)
            parts = list(msh.blocks(str(file), lines))
        rows = [r for reader in [msh.MshReader(str(file), set(msh.SECTIONS.values()))] for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(r["id"] for r in rows if r["section"] == "node") == [1, 2, 3, 4, 5]
        assert sum(r["section"] == "node" for r in rows) == 5 and max(len(p.section) for p in parts) and sum(p.section == "node" for p in parts) >= 3


def test_large_msh_is_read_by_several_tasks(spark, tmp_path):
    """A million elements through the sink and back; filters choose partitions before tasks run."""
    points = spark.range(1, 250_001).select(F.col("id").alias("node_id"), (F.col("id") / 7).alias("x"), (-F.col("id") / 3).alias("y"), F.lit(0.5).alias("z"))
    cells = spark.range(1, 1_000_001).select(F.col("id").alias("tetra_id"), *[((F.col("id") * k) % 250_000 + 1).alias(f"n{i}") for i, k in enumerate((1, 3, 7, 11))])
    path = f"{tmp_path}/big.msh"
    msh.write_msh(points, cells, path)
    assert [p.name for p in tmp_path.iterdir()] == ["big.msh"]
    found = msh.read_msh(spark, path)
    solid = msh.elements(found, 4)
    assert solid.rdd.getNumPartitions() == 10 and msh.nodes(found).rdd.getNumPartitions() == 3
    assert msh.elements(found, 2).rdd.getNumPartitions() == 1 and msh.elements(found, 2).count() == 0
    assert spark.read.format("msh").load(path).groupBy("section").count().count() == 2
    read = solid.select(F.col("element_id").alias("tetra_id"), *[F.col("nodes")[i].alias(f"n{i}") for i in range(4)])
    assert read.exceptAll(cells).isEmpty() and read.count() == 1_000_000
    assert msh.nodes(found).exceptAll(points).isEmpty()


def test_framed_text_leaves_no_trace_of_a_failed_job(spark, tmp_path):
    from ionframe.sources import framed

    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("lost"))).alias("line"))
    with pytest.raises(Exception, match="lost"):
        framed.write_framed(bad, f"{tmp_path}/x.txt", "begin", "end")
    assert list(tmp_path.iterdir()) == []
    framed.write_framed(spark.range(0, 1000, 1, 7).orderBy(F.col("id").desc()).select(F.col("id").cast("string")), f"{tmp_path}/x.txt", "begin", "end")
    assert (tmp_path / "x.txt").read_text().splitlines() == ["begin", *map(str, range(999, -1, -1)), "end"]
    assert [p.name for p in tmp_path.iterdir()] == ["x.txt"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0, -4.0, 5.5)], "x double, y double, z double, vx double, vy double, vz double")
    text.write_pos_vectors(rows, f"{tmp_path}/v.pos", 0.5)
    assert tuple(text.read_pos(spark, f"{tmp_path}/v.pos").first()) == (0, 1, 2, 3, -4, 5.5)
    text.write_pos_scalars(rows.withColumn("value", F.lit(None).cast("double")), f"{tmp_path}/s.pos", 0.0)
    with pytest.raises(ValueError):
        text.read_pos(spark, f"{tmp_path}/s.pos")
    with pytest.raises(ValueError):
        text.write_pos_vectors(rows, f"{tmp_path}/x.pos", -1.0)
    path = spark.createDataFrame([(5, s, s * 1.0, 0.0, 0.0) for s in range(3)] + [(6, 0, 0.0, 0.0, 0.0)], "particle_id long, seq int, x double, y double, z double")
    assert text.write_tracks(tracks.nested(path), f"{tmp_path}/t")
    assert text.read_tracks(spark, f"{tmp_path}/t").count() == 3 and text.read_tracks(spark, f"{tmp_path}/t", 6).count() == 0
    assert not text.write_tracks(tracks.nested(path.limit(0)), f"{tmp_path}/u")
    cells = mesh.with_shape(strip(spark)).select("tri_id", "v0", "v1", "v2", "area", "cnt")
    assert text.write_mesh(cells, f"{tmp_path}/m") and text.read_mesh(spark, f"{tmp_path}/m").where("tri_id = 2").first().cnt == 50
    assert not text.write_mesh(cells.limit(0), f"{tmp_path}/n")
    (tmp_path / "n.dat").write_text("# c\n1 2\n3 4\n")
    assert text.read_numbers(spark, str(tmp_path / "n.dat"), ["y", "n"]).agg(F.sum("n")).first()[0] == 6
    assert spark.range(1).select(text.mesh_id(F.lit("Triangle_17"))).first()[0] == 17


def test_simulation_settles_on_the_wall(spark):
    wall = points(spark, [(1, (-10.0, -10.0, 5.0), (10.0, -10.0, 5.0), (0.0, 20.0, 5.0))], ["tri_id", "v0", "v1", "v2"])
    fresh = spark.createDataFrame([(i, "Ti") for i in range(6)], "id long, species string").withColumn("pos", V.vec(0, 0, 0)).withColumn("v", V.vec(0, 0, F.when(F.col("id") == 5, 1.0).otherwise(100.0 + F.col("id")))).withColumn("energy_j", F.lit(1.0))
    box = {f"{a}_{m}": s * 20.0 for a in "xyz" for m, s in (("min", -1), ("max", 1))}
    run = simulation.Run(dt=0.02, duration=0.2, gas="Ar", model="HS", concentration=1.0, edge=5.0, sputtering=True)
    state = simulation.simulate(fresh, wall, box, run)
    assert {r.particle_id for r in state.settled.collect()} == {0, 1, 2, 3, 4}  # particle 5 is too slow to move
    assert gather.settled_counts(state.settled).first().cnt == 5
    assert run.steps() in (10, 11) and state.tracks.where("particle_id = 5").count() == 0
    with_field = simulation.Run(dt=0.02, duration=0.02, gas="Ar", model="HS", concentration=1.0, edge=50.0)
    bc = spark.createDataFrame([(1, 0.0), (8, 1.0)], "node_id long, value double")
    inside = fresh.withColumn("pos", V.vec(60, 30, 10))
    box = {f"{a}_{m}": v for a in "xyz" for m, v in (("min", 0.0), ("max", 100.0))}
    assert simulation.simulate(inside, wall, box, with_field, cube(spark), bc).particles.count() == 6


def test_streams(spark, tmp_path):
    assert emission.emission(spark, 10, "Ti").isStreaming
    rows = [(1, 7, 0), (1, 7, 1), (2, 7, 2), (3, 8, 3)]
    spark.createDataFrame(rows, "particle_id long, tri_id long, s long").select("particle_id", "tri_id", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/hits")
    hits = spark.readStream.schema("particle_id long, tri_id long, ts timestamp").parquet(f"{tmp_path}/hits")
    q = emission.settled_stream(hits).writeStream.outputMode("complete").format("memory").queryName("settled_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("settled_counts").collect()} == {(7, 2), (8, 1)}


def test_kde_is_a_density(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 2.0, 2.0), (3.0, 1.0, 1.0), (3.0, 1.0, 0.0)], "x double, y double, w double")
    got = {(r.gx, r.gy): r.density for r in deposition.kde(pts, 5).collect()}
    w = np.array([1, 2, 1.0])
    x = np.array([[0, 1, 3.0], [0, 2, 1]])
    n = w.sum() ** 2 / (w**2).sum()
    c = np.cov(x, aweights=w) * n ** (-1 / 3)
    g = np.array([1.5, 1.0])
    d = x.T - g
    want = (w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))).sum() / w.sum() / (2 * math.pi * math.sqrt(np.linalg.det(c)))
    assert got[2, 2] == pytest.approx(want)


def test_queries_at_the_reference_parameters(spark, tmp_path):
    from ionframe.queries import QUERIES

    d, rng = f"file://{tmp_path}", np.random.default_rng(5)
    rows = [(v, [float(x) for x in rng.normal(size=48)]) for v in range(1, 20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, i % 70, i, 1.0) for i in range(210)], "event_id long, user_id long, ts long, value double").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(1000.0 * i, float(i * i % 7)) for i in range(1, 12)], "l_extendedprice double, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    assert QUERIES["recorded_tracks_reference"](spark, d).select("particle_id").distinct().count() == 70
    assert QUERIES["kde_grid_reference"](spark, d).count() == 100 * 100
    nodes = {v: [(v + 3) % 40, (v * 7 + 21) % 40, (v * 11 + 33) % 40] for v, _ in rows}
    sides = {v: {tuple(sorted((n[i], n[j]))) for i, j in ((0, 1), (1, 2), (0, 2))} for v, n in nodes.items()}
    want = {}
    for v in nodes:
        seen, front = {v: 0}, [v]
        for level in range(1, 5):
            front = sorted({b for a in front for b in nodes if sides[a] & sides[b]} - set(seen))
            seen |= dict.fromkeys(front, level)
        want |= {(v, b): n for b, n in seen.items()}
    assert {(r.source, r.tri_id): r.level for r in QUERIES["neighbour_levels_reference"](spark, d).collect()} == want
    assert {(r.source, r.target) for r in QUERIES["distribution_shares_reference"](spark, d).collect()} == set(want)


def test_lookups_and_fixed_nodes(spark):
    tetras = cube(spark)
    assert fem.total_volume(tetras).first()["volume"] == pytest.approx(1e6)
    assert fem.with_centre(tetras).where("tetra_id = 0").first()["centre"] == pytest.approx((75.0, 50.0, 25.0))
    inside = points(spark, [(1, (60.0, 30.0, 10.0)), (3, (500.0, 0.0, 0.0)), (4, (50.0, 50.0, 50.0))], ["id", "pos"])
    assert sorted(r["id"] for r in spatial.inside_mesh(inside, tetras, 25.0).collect()) == [1, 4]
    tracked = spark.createDataFrame([(0, 7, 1), (1, 9, 1)], "step int, tetra_id long, particle_id long")
    asked = spark.createDataFrame([(1, 1), (2, 1)], "step int, particle_id long")
    assert sorted(map(tuple, gather.tracked_cells(tracked, asked).collect())) == [(1, 1, 9), (2, 1, None)]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    assert sorted(r["node_id"] for r in fem.free_nodes(nodes, nodes.where("node_id = 2")).collect()) == [1, 3]


def test_matrix_and_vector_tables(spark):
    m = spark.createDataFrame([(0, 1, 2.5), (1, 0, 3.0), (1, 1, 4.0)], "row long, col long, value double")
    assert tuple(fem.shape(m).first()) == (2, 2, 3, False) and fem.shape(m.limit(0)).first()["empty"]
    v = spark.createDataFrame([(0, 1.5), (1, 2.5)], "idx long, value double")
    assert fem.vector_size(v) == 2 and fem.vector_at(v, 1) == 2.5 and fem.cleared(v).agg(F.sum("value")).first()[0] == 0
    assert fem.randomised(v, 1).collect() == fem.randomised(v.repartition(2), 1).orderBy("idx").collect()
    with pytest.raises(IndexError):
        fem.vector_at(v, -1)
    fem.check_cell("Tetrahedron")
    fem.check_cell("tetrahedron", 2)
    with pytest.raises(NotImplementedError):
        fem.check_cell("wedge")
    with pytest.raises(ValueError):
        fem.check_cell("sphere")


def test_settings(tmp_path):
    assert config.solver_settings({"maxIterations": "200", "convergenceTolerance": "1e-9", "numBlocks": ""}) == {"maxIterations": 200, "convergenceTolerance": 1e-9}
    for bad in ({"maxIterations": "0"}, {"EdgeSize": "0.01"}, {"DesiredAccuracy": "21"}, {"blockSize": "many"}):
        with pytest.raises(ValueError):
            config.solver_settings(bad)
    config.save(config.renamed_key({"a": 1, "numBlocks": "3"}, "a", "b"), f"{tmp_path}/x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"b": 1, "numBlocks": "3"} and config.read_solver_settings(f"{tmp_path}/x.json") == {"numBlocks": 3}
    with pytest.raises(ValueError):
        config.read_solver_settings(f"{tmp_path}/x.txt")
    assert config.check_threads(2, 8) == 2
    with pytest.warns(UserWarning):
        config.check_threads(8, 8)
    with pytest.raises(ValueError):
        config.check_threads(0, 8)


def test_settled_and_track_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, s, float(i), float(s), 0.0) for i in range(20) for s in range(5)], "particle_id long, seq int, x double, y double, z double")
    assert text.write_track_table(rows, f"{tmp_path}/t") and not text.write_track_table(rows.limit(0), f"{tmp_path}/u")
    assert sorted(map(tuple, text.read_track_table(spark, f"{tmp_path}/t", 7).collect())) == [(7, s, 7.0, float(s), 0.0) for s in range(5)]
    assert text.read_track_table(spark, f"{tmp_path}/t").count() == 100
    assert text.write_settled(rows.where("seq = 0"), f"{tmp_path}/s") and text.read_settled(spark, f"{tmp_path}/s").count() == 20
    with pytest.warns(UserWarning):
        assert not text.write_settled(rows.limit(0), f"{tmp_path}/v")
    text.write_density(spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, 1.0, 0.0)], "x double, y double, cnt double"), f"{tmp_path}/d")
    assert [tuple(r) for r in text.read_numbers(spark, f"{tmp_path}/d", ["x", "y", "c"]).collect()] == [(1.0, 2.0, 3.0)]


def test_levels_and_shares_of_classes_are_those_of_pairs(spark):
    """Copies of a triangle are one class: shuffled are classes, and the rows those of all pairs, in chunks of any size."""
    from ionframe.operators import pairs

    fields = "tri_id long, v0 struct<x:double,y:double,z:double>, v1 struct<x:double,y:double,z:double>, v2 struct<x:double,y:double,z:double>, n0 long, n1 long, n2 long, cnt long"
    rng = np.random.default_rng(3)
    nodes = [(1, 2, 3)] * 9 + [(3, 2, 1)] * 2 + [(2, 3, 4), (4, 5, 6), (7, 8, 9), (7, 7, 7), (None, None, None), (None, None, None), (None, 9, 8)]
    rows = [(i - 1, *[tuple(map(float, rng.normal(size=3))) for _ in range(3)], *n, i % 4) for i, n in enumerate(nodes)]
    cells = spark.createDataFrame(rows, fields)
    e = mesh.edges(cells)
    links = e.join(e.withColumnRenamed("tri_id", "neighbour"), ["p", "q"]).where("tri_id <> neighbour").select("tri_id", "neighbour").distinct()
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(mesh.adjacency(cells)) == as_rows(links)
    for levels in (0, 1, 3):
        want = mesh.neighbour_levels(cells.select("tri_id"), links, levels)
        assert as_rows(mesh.triangle_levels(cells, levels)) == as_rows(want)
        members = mesh.classes(cells)
        if levels:
            assert as_rows(distribute.class_shares(cells, members, mesh.class_levels(members, levels), 2)) == as_rows(distribute.shares(cells, want, 2))
    members = mesh.classes(cells)
    assert mesh.class_links(members).count() < 20 < links.count()
    keyed = cells.select((F.col("tri_id") % 3).alias("k"), "tri_id")
    met = pairs.met(keyed, keyed.select("k", F.col("tri_id").alias("other")), ["k"], 2).select("_l.tri_id", "_r.other")
    assert as_rows(met) == as_rows(keyed.join(keyed.select("k", F.col("tri_id").alias("other")), "k").select("tri_id", "other"))


def test_hits_in_a_crowded_cell_come_from_pairs_of_chunks(spark, monkeypatch):
    """One cell that holds all: its pairs are dealt over many tasks, ties within a chunk and between chunks go to the smallest tri_id."""
    from ionframe.operators import pairs

    monkeypatch.setattr(pairs.chunks, "__defaults__", (7,))
    monkeypatch.setattr(pairs.chunk_pairs, "__defaults__", (7,))
    rng = np.random.default_rng(8)
    place = lambda: tuple(map(float, rng.uniform(0, 4, 3)))
    segments = points(spark, [(i, place(), place()) for i in range(60)], ["id", "p0", "p1"])
    corners = [(place(), place(), place()) for _ in range(20)]
    triangles = points(spark, [(i, *corners[i % 20]) for i in range(60)], ["tri_id", "v0", "v1", "v2"])
    hits = [(r.id, r.share, r.tri_id) for r in spatial.segment_hits(segments, triangles, 4.0).collect()]
    assert len(hits) == len(set(hits)) and {(i, t % 20 + 20 * k) for i, _, t in hits for k in range(3)} == {(i, t) for i, _, t in hits}
    nearest = {i: min((s, t) for j, s, t in hits if j == i) for i, _, _ in hits}
    assert {r.id: (r.share, r.tri_id) for r in spatial.first_hits(segments, triangles, 4.0).collect()} == nearest
    crowd = pairs.chunk_pairs(spatial.legs(segments, 4.0), spatial.triangle_cells(triangles, 4.0), spatial.CELL).select(F.size("_l").alias("a"), F.size("_r").alias("b"), F.spark_partition_id().alias("p")).collect()
    assert max(r.a for r in crowd) < 30 and max(r.b for r in crowd) < 30 and len({r.p for r in crowd}) > 8


def test_points_of_a_full_cell_are_the_work_of_many(spark):
    """All in one cell, corners and faces included, against every pair; the pairs found come from several tasks."""
    rng = np.random.default_rng(5)
    v = rng.integers(0, 8, (60, 4, 3)).astype(float)  # many flat ones, many points on faces
    p = np.concatenate([rng.integers(0, 8, (4000, 3)).astype(float), rng.random((2000, 3)) * 8])
    near = lambda a, b, c: np.cross(v[:, b] - v[:, a], v[:, c] - v[:, a])
    turn = np.sign(np.einsum("ij,ij->i", v[:, 3] - v[:, 0], near(0, 1, 2)))
    want = np.repeat(turn[None] != 0, len(p), axis=0)
    for a, b, c in ((1, 3, 2), (0, 2, 3), (0, 3, 1), (0, 1, 2)):
        want &= ((p[:, None] - v[None, :, a]) * near(a, b, c) * turn[:, None]).sum(axis=2) >= 0
    particles = points(spark, [(i, tuple(map(float, x))) for i, x in enumerate(p)] + [(-1, (float("nan"), 1.0, 1.0))], ["id", "pos"])
    tetras = points(spark, [(i, *[tuple(map(float, c)) for c in x]) for i, x in enumerate(v)], ["tetra_id", "v0", "v1", "v2", "v3"])
    found = spatial.containing_tetras(particles, tetras, 1000.0).select("id", "tetra_id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.id, r.tetra_id) for r in found) == sorted(map(tuple, np.argwhere(want).tolist()))
    assert len({r.task for r in found}) > 1


def test_chunks_of_a_key_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    """Pairs of chunks do not grow with the pairs of rows; the pairs of rows are all there."""
    from ionframe.operators import pairs

    monkeypatch.setattr(pairs.chunk_pairs, "__defaults__", (3,))
    rows = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    met = pairs.chunk_pairs(rows, rows.select("k", F.col("a").alias("b")), ["k"])
    assert 8 * 8 < met.count() <= pairs.ENOUGH**2
    each = met.select(F.explode("_l.a").alias("a"), "_r").select("a", F.explode("_r.b").alias("b"))
    assert each.distinct().count() == each.count() == 400 * 400
    monkeypatch.setattr(pairs, "LARGEST", 10)
    assert pairs.chunks(rows, ["k"], "_l", 3, enough=2).agg(F.max(F.size("_l"))).first()[0] < 40


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e30])
def test_hits_on_edges_and_corners_are_decided_in_double_precision(spark, monkeypatch, scale):
    """Whole numbers, so that many legs end on a triangle or pass through its edges and corners, against every pair; in several steps."""
    monkeypatch.setattr(spatial, "COLUMNS", 50)
    rng = np.random.default_rng(12)
    p0, p1 = (rng.integers(1, 7, (80, 3)) * scale for _ in range(2))
    a, b, c = (rng.integers(1, 7, (120, 3)) * scale for _ in range(3))
    each = lambda x: [tuple(map(float, r)) for r in x]
    segments = points(spark, list(zip(range(80), each(p0), each(p1), strict=True)), ["id", "p0", "p1"])
    triangles = points(spark, list(zip(range(120), each(a), each(b), each(c), strict=True)), ["tri_id", "v0", "v1", "v2"])
    d, s, b, c = (p1 - p0)[:, None], p0[:, None] - a[None], (b - a)[None], (c - a)[None]
    n = np.cross(b, c)
    with np.errstate(all="ignore"):
        turn = -(d * n).sum(axis=2)
        share, u, w = (s * n).sum(axis=2) / turn, (c * np.cross(s, d)).sum(axis=2) / turn, -(b * np.cross(s, d)).sum(axis=2) / turn
    want = {(i, j): share[i, j] for i, j in np.argwhere((share >= 0) & (share <= 1) & (u >= 0) & (w >= 0) & (u + w <= 1)).tolist()}
    assert sum(x in (0, 1) for x in want.values()) > 20
    assert {(r.id, r.tri_id): r.share for r in spatial.segment_hits(segments, triangles, 100 * scale, points=False).collect()} == pytest.approx(want)


def test_a_stage_holds_the_pairs_of_a_step(spark):
    """Between the explodes the stage ends, so that the pairs of whole chunks are never held; steps lose no row."""
    from ionframe.operators import pairs

    ends = lambda n, name: spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias(name))
    for n, m in ((1, 1), (pairs.STEP, 3), (2 * pairs.STEP + 1, 5)):
        left, right = pairs.chunks(ends(n, "a"), ["k"], "l", 1000), pairs.chunks(ends(m, "b"), ["k"], "r", 1000)
        met = pairs.dealt(left.join(right, "k"), "l", "r").select("l.a", "r.b")
        assert sorted(map(tuple, met.collect())) == [(a, b) for a in range(n) for b in range(m)]
        plan = met._jdf.queryExecution().sparkPlan().toString()
        assert re.findall("Generate explode|Coalesce", plan) == ["Generate explode", "Generate explode", "Coalesce", "Generate explode"]


def test_shares_of_cells_without_place_or_area(spark, monkeypatch):
    """Weights that are null or sum to nothing give 1, as in SQL; sources and targets in several steps."""
    monkeypatch.setattr(distribute, "ROWS", 2)
    monkeypatch.setattr(distribute, "COLUMNS", 3)
    fields = "tri_id long, v0 struct<x:double,y:double,z:double>, v1 struct<x:double,y:double,z:double>, v2 struct<x:double,y:double,z:double>, n0 long, n1 long, n2 long, cnt long"
    rng = np.random.default_rng(4)
    place = lambda: tuple(map(float, rng.normal(size=3)))
    flat = ((1.0, 1.0, 1.0),) * 3
    rows = [(i, *(flat if i % 4 == 1 else (place(), place(), place())), 1, 2, 3, 7 * i) for i in range(11)]
    rows += [(11, (None, 0.0, 0.0), place(), place(), 1, 2, 3, 5), (12, None, None, None, 1, 2, 3, None)]
    rows += [(20, *flat, 7, 8, 9, 4), (21, *flat, 7, 8, 9, 0), (30, None, None, None, 10, 11, 12, 4)]
    cells = spark.createDataFrame(rows, fields)
    members = mesh.classes(cells)
    got = {(r.source, r.target): r.num for r in distribute.class_shares(cells, members, mesh.class_levels(members, 1), 2).collect()}
    assert got[20, 20] == got[20, 21] == got[30, 30] == got[11, 3] == got[3, 11] == got[3, 12] == got[3, 1] == 1
    reached = mesh.triangle_levels(cells, 1)
    assert got == {(r.source, r.target): r.num for r in distribute.shares(cells, reached, 2).collect()}
    area, middle = {}, {}
    for i, *v, _, _, _, _ in rows[:11]:
        a, b, c = map(np.array, v)
        area[i], middle[i] = np.linalg.norm(np.cross(b - a, c - a)) / 2, (a + b + c) / 3
    sigma = max(0.5, 2 * np.sqrt(np.mean(list(area.values()))))
    w = {t: area[t] * np.exp(-((middle[2] - middle[t]) ** 2).sum() / (2 * sigma**2)) for t in area}
    assert {t: got[2, t] for t in w} == {t: max(1, int(np.floor(1400 * x / sum(w.values()) + 0.5))) for t, x in w.items()}
