"""Components, ranks, welding and orientation against plain Python."""

import math
import random

import numpy as np
import pytest

from ionframe.operators import graph
from ionframe.storage import Scratch

POINT = "id long, pos struct<x:double,y:double,z:double>"
TRI = "tri_id long, n0 long, n1 long, n2 long"


def roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


@pytest.mark.parametrize("links", [[], [(4, 4)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 60)], [(random.Random(i).randrange(200), random.Random(-i).randrange(200)) for i in range(90)]], ids=["none", "loop", "chain", "hub", "random"])
def test_components(spark, links):
    found = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, found.collect())) == roots({x for e in links for x in e}, links)


def test_numbered_and_spaced(spark):
    values = [random.Random(3).randrange(50) / 4 for _ in range(300)] + [None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value double").repartition(5)
    found = graph.numbered(rows, ["value", "id"], "place", Scratch(spark)).collect()
    order = sorted(range(301), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert {r.id: r.place for r in found} == {i: k for k, i in enumerate(order)}
    distinct = sorted({v for v in values if v is not None})
    for n in (1, 4, 9):
        want = [(k, distinct[round(k * (len(distinct) - 1) / max(n - 1, 1))]) for k in range(n)]
        assert sorted(map(tuple, graph.spaced(rows, "value", n).collect())) == want
    assert graph.spaced(rows.where("id < 0"), "value", 5).count() == 0


def test_welded(spark):
    rng = np.random.default_rng(4)
    pos = np.round(rng.normal(0, 3, (120, 3)), 1)
    pos[100:] = pos[:20]
    links = [(a, b) for a in range(120) for b in range(a) if math.dist(pos[a], pos[b]) <= 0.75]
    root = roots(range(120), links)
    node = {m: k for k, m in enumerate(sorted(set(root.values())))}
    found = graph.welded(spark.createDataFrame([(i, tuple(map(float, p))) for i, p in enumerate(pos)], POINT), 0.75)
    assert {r.id: (r.merged, r.node) for r in found.collect()} == {i: (m, node[m]) for i, m in root.items()}


def test_appended_meshes_share_their_seam(spark):
    """Two unit squares side by side: six points are left of eight, and a sliver along the seam goes."""
    schema = "node_id long, pos struct<x:double,y:double,z:double>"
    square = lambda x, eps: spark.createDataFrame([(10, (x, 0.0, 0.0)), (20, (x + 1, eps, 0.0)), (30, (x + 1, 1.0, 0.0)), (40, (x, 1.0, eps))], schema)
    faces = spark.createDataFrame([(7, 10, 20, 30), (8, 10, 30, 40)], TRI)
    sliver = spark.createDataFrame([(7, 10, 20, 30), (8, 10, 30, 40), (9, 20, 50, 30)], TRI)
    more = square(0.0, 0.0).unionByName(spark.createDataFrame([(50, (1.0, 1e-7, 0.0))], schema))
    points, triangles = graph.appended([(more, sliver), (square(1.0, 1e-6), faces)], 1e-5)
    assert sorted(r.node_id for r in points.collect()) == list(range(6))
    assert sorted(r.tri_id for r in triangles.collect()) == [0, 1, 2, 3]
    at = {r.node_id: np.array(r.pos) for r in points.collect()}
    area = sum(np.linalg.norm(np.cross(at[r.n1] - at[r.n0], at[r.n2] - at[r.n0])) / 2 for r in triangles.collect())
    assert area == pytest.approx(2.0, abs=1e-4)
    with pytest.raises(ValueError):
        graph.appended([], 1.0)


def sphere(n):
    """A closed surface of 4 n triangles: rings between two poles."""
    ring = [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    at = [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0)] + [(0.8 * x, 0.8 * y, 0.6) for x, y in ring] + [(0.8 * x, 0.8 * y, -0.6) for x, y in ring]
    faces = []
    for k in range(n):
        a, b, c, d = 2 + k, 2 + (k + 1) % n, 2 + n + k, 2 + n + (k + 1) % n
        faces += [(0, a, b), (a, c, b), (b, c, d), (1, d, c)]
    return at, faces


def test_normals_of_a_flipped_sphere_agree(spark):
    at, faces = sphere(12)
    rng = random.Random(5)
    mixed = [f if rng.random() < 0.5 else (f[0], f[2], f[1]) for f in faces]
    other = [tuple(n + 100 for n in f) for f in mixed[:2]]  # a second component
    where = {i: p for i, p in enumerate(at)} | {i + 100: p for i, p in enumerate(at)}
    rows = [(i, *f, *[where[n] for n in f]) for i, f in enumerate([*mixed, *other])]
    corner = "struct<x:double,y:double,z:double>"
    found = graph.cell_normals(spark.createDataFrame(rows, f"{TRI}, v0 {corner}, v1 {corner}, v2 {corner}")).collect()
    assert {r.component for r in found} == {0, len(mixed)} and all(r.orientable for r in found)
    outward = [sum(a * b for a, b in zip(r.centre, r.normal, strict=True)) > 0 for r in found if r.component == 0]
    assert len(set(outward)) == 1 and len(outward) == len(faces)


def test_one_sided_band(spark):
    """A Moebius band of ten triangles: no choice of sides agrees."""
    top, n = [0, 1, 2, 3, 4], 5
    faces = []
    for k in range(n):
        a, b = top[k], top[k] + 5
        c, d = (top[k + 1], top[k + 1] + 5) if k + 1 < n else (5, 0)
        faces += [(2 * k, a, c, b), (2 * k + 1, b, c, d)]
    found = graph.oriented(spark.createDataFrame(faces, TRI)).collect()
    assert {(r.component, r.turned, r.orientable) for r in found} == {(0, False, False)}
