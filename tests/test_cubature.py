"""Rules against the exact integrals of monomials; quadratic elements against exact solutions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.operators import cubature, fem

POS = "struct<x:double,y:double,z:double>"
TETRA = f"tetra_id long, n0 long, n1 long, n2 long, n3 long, v0 {POS}, v1 {POS}, v2 {POS}, v3 {POS}"
UNIT = (1, 1, 2, 3, 4, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))


@pytest.mark.parametrize("degree", range(21))
def test_rules_are_exact(degree):
    points = np.array(cubature.rule(degree))
    assert len(points) == math.ceil((degree + 1) / 2) ** 3 and (points > 0).all() and np.allclose(points[:, :4].sum(axis=1), 1)
    for i, j in itertools.product(range(degree + 1), repeat=2):
        if i + j <= degree:
            k = degree - i - j
            exact = 6 * math.factorial(i) * math.factorial(j) * math.factorial(k) / math.factorial(degree + 3)
            assert math.isclose((points[:, 4] * points[:, 1] ** i * points[:, 2] ** j * points[:, 3] ** k).sum(), exact, rel_tol=1e-10)


def test_degrees_out_of_range():
    for degree in (-1, 21):
        with pytest.raises(ValueError):
            cubature.rule(degree)


def test_integrals_of_odd_tetrahedra(spark):
    flat = (2, 5, 6, 7, 8, *[(float(i), float(i * i), 0.0) for i in range(4)])
    turned = (3, 1, 3, 2, 4, UNIT[5], UNIT[7], UNIT[6], UNIT[8])
    frame = spark.createDataFrame([UNIT, flat, turned, (4, 1, 2, 3, 4, None, *UNIT[6:])], TETRA)
    found = {r.tetra_id: r.integral for r in cubature.with_integral(frame, lambda p: F.when(p["x"] < 2, p["x"] * p["y"]), 2).collect()}
    assert math.isclose(found[1], 1 / 120) and math.isclose(found[3], 1 / 120) and found[4] is None
    at = cubature.with_points(frame, 3).groupBy("tetra_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
    assert {(r.tetra_id, r.n) for r in at} == {(i, 8) for i in (1, 2, 3, 4)}
    assert all(r.w is None if r.tetra_id == 4 else math.isclose(r.w, {1: 1 / 6, 2: 0.0, 3: 1 / 6}[r.tetra_id], abs_tol=1e-15) for r in at)
    assert cubature.with_integral(frame.limit(0), lambda p: p["x"], 20).count() == 0


def cube(spark, n):
    """The unit cube as n^3 smaller ones of six tetrahedra each."""
    at = lambda p: p[0] + (n + 1) * (p[1] + (n + 1) * p[2])
    rows = []
    for corner in itertools.product(range(n), repeat=3):
        for axes in itertools.permutations(range(3)):
            path = [list(corner)]
            for axis in axes:
                path.append([c + (i == axis) for i, c in enumerate(path[-1])])
            rows.append((len(rows), *map(at, path), *[tuple(c / n for c in p) for p in path]))
    return spark.createDataFrame(rows, TETRA)


def solved(tetras, exact, source, coefficient=None, degree=2):
    """The root of the squared error's integral, under the exact values on the cube's faces."""
    places = {r.node_id: tuple(r.pos) for r in cubature.node_positions(tetras).collect()}
    code = {node: i for i, node in enumerate(sorted(places))}
    a, b = np.zeros((len(code), len(code))), np.zeros(len(code))
    for r in cubature.stiffness(tetras, coefficient, degree).collect():
        a[code[r.row], code[r.col]] = r.value
    for r in cubature.load(tetras, source).collect():
        b[code[r.idx]] = r.value
    assert np.allclose(a, a.T) and np.allclose(a.sum(axis=1), 0)
    u = np.array([exact(*places[node]) for node in sorted(places)])
    inner = np.array([all(1e-9 < x < 1 - 1e-9 for x in places[node]) for node in sorted(places)])
    found = np.linalg.solve(a[np.ix_(inner, inner)], b[inner] - a[np.ix_(inner, ~inner)] @ u[~inner])
    u[inner] = found
    order, total = 2 if "n9" in tetras.columns else 1, 0.0
    for r in tetras.collect():
        v = np.array([r[f"v{i}"] for i in range(4)])
        own = u[[code[r[f"n{i}"]] for i in range(10 if order == 2 else 4)]]
        for *at, w in cubature.rule(4):
            here = sum(value * cubature._basis(i, order, at) for i, value in enumerate(own))
            total += w * abs(np.linalg.det(v[1:] - v[0])) / 6 * (here - exact(*(np.array(at) @ v))) ** 2
    return math.sqrt(total)


def quadratic(tetras):
    return cubature.quadratic(tetras, cubature.edge_nodes(tetras))


def test_quadratic_elements_hold_quadratic_solutions(spark):
    """u = x^2 + y z solves -div(grad u) = -2, and under the coefficient 1 + x also -(2 (1 + x) + 2 x)."""
    tetras = quadratic(cube(spark, 2))
    exact = lambda x, y, z: x * x + y * z
    assert solved(tetras, exact, lambda p: F.lit(-2.0)) < 1e-12
    assert solved(tetras, exact, lambda p: -2 - 4 * p["x"], lambda p: 1 + p["x"], 3) < 1e-12


def test_quadratic_elements_converge_faster(spark):
    exact = lambda x, y, z: math.sin(2 * x + y) * math.exp(z)
    source = lambda p: 4 * F.sin(2 * p["x"] + p["y"]) * F.exp(p["z"])
    linear = [solved(cube(spark, n), exact, source) for n in (2, 4)]
    second = [solved(quadratic(cube(spark, n)), exact, source) for n in (2, 4)]
    assert second[0] < linear[0] / 4 and 3 < linear[0] / linear[1] < 5 and second[0] / second[1] > 6.5


def test_linear_matrix_is_the_same(spark):
    tetras = cube(spark, 2)
    one, other = ({(r.row, r.col): r.value for r in m.collect()} for m in (fem.stiffness(tetras), cubature.stiffness(tetras)))
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], abs_tol=1e-14) for k in one)


def test_edges_without_gaps(spark):
    tetras = cube(spark, 2).repartition(3)
    edges = sorted(map(tuple, cubature.edge_nodes(tetras).collect()))
    pairs = {tuple(sorted((r[f"n{i}"], r[f"n{j}"]))) for r in tetras.collect() for i, j in cubature.EDGES}
    assert edges == [(a, b, 27 + k) for k, (a, b) in enumerate(sorted(pairs))]
    extra = tetras.unionByName(spark.createDataFrame([(99, None, *UNIT[2:])], TETRA))
    assert cubature.quadratic(extra, cubature.edge_nodes(tetras)).count() == 48
    none = tetras.limit(0)
    assert cubature.edge_nodes(none).count() == 0 and cubature.stiffness(quadratic(none)).count() == 0
