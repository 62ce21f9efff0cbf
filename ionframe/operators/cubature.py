"""Cubature of a stated degree over tetrahedra, and quadratic elements assembled by its points.

A rule is a small table of constants that is made anew for each degree; it travels in the plan, so integrals and local
matrices are row-wise expressions and only the sums over equal nodes shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.operators import fem, graph
from ionframe.storage import Scratch

#: The corners that the nodes 4 to 9 of a quadratic tetrahedron lie between.
EDGES = tuple((i, j) for i in range(4) for j in range(i + 1, 4))
MAX_DEGREE = 20


def _gauss_jacobi(n: int, alpha: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in (0, 1) and weights of sum 1 that integrate polynomials to degree 2n - 1 against (1 - x)^alpha.

    They are the eigenvalues, and the squares of the eigenvectors' first components, of the recurrence's matrix.
    """
    k = np.arange(n, dtype=float)
    s = 2 * k + alpha
    diagonal = np.where(k == 0, -alpha / (alpha + 2.0), -(alpha**2) / np.where(k == 0, 1.0, s * (s + 2)))
    k, s = k[1:], s[1:]
    beside = np.sqrt(4 * k**2 * (k + alpha) ** 2 / (s**2 * (s + 1) * (s - 1)))
    points, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
    return (points + 1) / 2, vectors[0] ** 2


def rule(degree: int) -> list[tuple[float, float, float, float, float]]:
    """(l0, l1, l2, l3, weight): barycentric points inside a tetrahedron whose weights, of sum 1, integrate every polynomial
    of ``degree`` exactly. It is the cube's product rule drawn together to a corner: ceil((degree + 1) / 2)^3 points."""
    if not 0 <= degree <= MAX_DEGREE:
        raise ValueError(f"degree {degree} is not in 0..{MAX_DEGREE}")
    n = degree // 2 + 1
    (xs, u), (ys, v), (zs, w) = (_gauss_jacobi(n, alpha) for alpha in (2, 1, 0))
    found = []
    for x, a in zip(xs, u, strict=True):
        for y, b in zip(ys, v, strict=True):
            for z, c in zip(zs, w, strict=True):
                l1, l2, l3 = x, y * (1 - x), z * (1 - x) * (1 - y)
                found.append(tuple(map(float, (1 - l1 - l2 - l3, l1, l2, l3, a * b * c))))
    return found


def _numbers(values) -> str:
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def _sum(weights: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda w, v: w * v), F.lit(0.0), lambda total, v: total + v)


def _positions(points: list) -> Column:
    """The places of a rule's points in the tetrahedron v0..v3, as an array of vectors."""
    corners = [F.col(f"v{i}") for i in range(4)]
    bary = F.expr(f"array({', '.join(_numbers(p[:4]) for p in points)})")
    return F.transform(bary, lambda l: V.vec(*[sum((l[i] * corners[i][a] for i in range(1, 4)), l[0] * corners[0][a]) for a in "xyz"]))


def _values(points: list, function: Callable[[Column], Column]) -> Column:
    return F.transform(_positions(points), lambda p: function(p).cast("double"))


def with_points(tetras: DataFrame, degree: int) -> DataFrame:
    """A row for each tetrahedron and point, with ``point`` (from 0), ``pos`` and ``weight``; a tetrahedron's weights have its
    volume as sum, so a flat one's are 0."""
    points = rule(degree)
    weighted = F.arrays_zip(_positions(points).alias("pos"), F.expr(_numbers(p[4] for p in points)).alias("weight"))
    out = tetras.withColumn("_volume", F.abs(V.signed_volume(*[F.col(f"v{i}") for i in range(4)])))
    out = out.select(*out.columns, F.posexplode(weighted).alias("point", "_at"))
    return out.select(*tetras.columns, "point", F.col("_at.pos").alias("pos"), (F.col("_at.weight") * F.col("_volume")).alias("weight"))


def with_integral(tetras: DataFrame, function: Callable[[Column], Column], degree: int, name: str = "integral") -> DataFrame:
    """Adds the integral of ``function``, which takes a place and gives a number, over each tetrahedron; exact for polynomials
    of ``degree``. A null at any point makes it null."""
    points = rule(degree)
    out = tetras.withColumn("_values", _values(points, function))
    total = _sum(F.expr(_numbers(p[4] for p in points)), F.col("_values"))
    return out.withColumn(name, total * F.abs(V.signed_volume(*[F.col(f"v{i}") for i in range(4)]))).drop("_values")


def _corner_pairs(tetras: DataFrame) -> Column:
    return F.array(*[F.struct(F.lit(4 + k).alias("local"), F.least(f"n{i}", f"n{j}").alias("a"), F.greatest(f"n{i}", f"n{j}").alias("b")) for k, (i, j) in enumerate(EDGES)])


def edge_nodes(tetras: DataFrame) -> DataFrame:
    """(a, b, node_id): a node for each distinct edge a <= b of the tetrahedra, numbered without gaps after the largest corner in
    the order of the edges, by ranges."""
    pairs = tetras.select(F.explode(_corner_pairs(tetras)).alias("e")).select("e.a", "e.b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    last = tetras.agg(F.max(F.greatest("n0", "n1", "n2", "n3"))).first()[0] or 0
    places = graph.numbered(pairs, ["a", "b"], "place", Scratch(tetras.sparkSession))
    return places.select("a", "b", (F.col("place") + F.lit(last + 1).cast("long")).alias("node_id"))


def quadratic(tetras: DataFrame, edges: DataFrame) -> DataFrame:
    """The tetrahedra (tetra_id unique) with the nodes n4..n9 on their edges; those without six edges in ``edges`` are left out."""
    each = tetras.select("tetra_id", F.explode(_corner_pairs(tetras)).alias("e")).select("tetra_id", "e.*")
    nodes = each.join(edges, ["a", "b"]).groupBy("tetra_id").agg(*[F.max(F.when(F.col("local") == k, F.col("node_id"))).alias(f"n{k}") for k in range(4, 10)])
    return tetras.join(nodes, "tetra_id").where(" AND ".join(f"n{k} IS NOT NULL" for k in range(4, 10)))


def node_positions(tetras: DataFrame) -> DataFrame:
    """(node_id, pos) of linear or quadratic tetrahedra, edges' nodes midway; of a node's differing places the least."""
    v = [F.col(f"v{i}") for i in range(4)]
    own = [F.struct(F.col(f"n{i}").alias("node_id"), v[i].alias("pos")) for i in range(4)]
    if "n9" in tetras.columns:
        own += [F.struct(F.col(f"n{4 + k}").alias("node_id"), V.centroid(v[i], v[j]).alias("pos")) for k, (i, j) in enumerate(EDGES)]
    return tetras.select(F.explode(F.array(*own)).alias("p")).select("p.*").groupBy("node_id").agg(F.min("pos").alias("pos"))


def _slopes(node: int, order: int) -> list[tuple[int, int, float]]:
    """(p, r, c): the basis function's gradient is the sum of c l_r grad l_p over barycentric coordinates l."""
    if order == 1:
        return [(node, r, 1.0) for r in range(4)]
    if node < 4:
        return [(node, r, 3.0 if r == node else -1.0) for r in range(4)]
    i, j = EDGES[node - 4]
    return [(j, i, 4.0), (i, j, 4.0)]


def _basis(node: int, order: int, l) -> float:
    if order == 1:
        return l[node]
    if node < 4:
        return l[node] * (2 * l[node] - 1)
    i, j = EDGES[node - 4]
    return 4 * l[i] * l[j]


def _order(tetras: DataFrame) -> int:
    return 2 if "n9" in tetras.columns else 1


def _nodes(order: int) -> Column:
    return F.array(*[F.col(f"n{i}").cast("long") for i in range(10 if order == 2 else 4)])


def stiffness(tetras: DataFrame, coefficient: Callable[[Column], Column] | None = None, degree: int = 2) -> DataFrame:
    """The assembled matrix (row, col, value) of -div(coefficient grad) over linear tetrahedra, or quadratic ones where n4..n9 are.

    Gradients are linear in barycentric coordinates, so a local matrix needs the sixteen products of coordinates'
    gradients and the sixteen moments of the coefficient, which a rule of ``degree`` integrates: 2 suffices for a constant,
    2 more than its degree for a polynomial. Flat tetrahedra give nothing; equal places are summed, partly before the shuffle.
    """
    order, points = _order(tetras), rule(degree)
    size = 10 if order == 2 else 4
    g = fem.with_gradients(tetras).where("volume > 0")
    g = g.withColumn("_slopes", F.array(*[V.dot(F.col(f"g{p}"), F.col(f"g{q}")) for p in range(4) for q in range(4)]))
    moments = [[p[4] * p[r] * p[s] for p in points] for r in range(4) for s in range(4)]
    if coefficient is None:
        g = g.withColumn("_moments", F.expr(_numbers(sum(m) for m in moments)))
    else:
        g = g.withColumn("_values", _values(points, coefficient)).withColumn("_moments", F.transform(F.expr(f"array({', '.join(map(_numbers, moments))})"), lambda m: _sum(m, F.col("_values"))))
    local = []
    for a in range(size):
        for b in range(size):
            terms = [(4 * p + q, 4 * r + s, c * d) for p, r, c in _slopes(a, order) for q, s, d in _slopes(b, order)]
            local.append(f"struct({a} AS a, {b} AS b, array({', '.join(f'struct({i} AS g, {m} AS m, {w!r}D AS w)' for i, m, w in terms)}) AS terms)")
    each = g.select("volume", "_slopes", "_moments", _nodes(order).alias("_nodes"), F.explode(F.expr(f"array({', '.join(local)})")).alias("k"))
    value = F.aggregate("k.terms", F.lit(0.0), lambda total, t: total + t["w"] * F.col("_slopes")[t["g"]] * F.col("_moments")[t["m"]])
    cells = each.select(F.col("_nodes")[F.col("k.a")].alias("row"), F.col("_nodes")[F.col("k.b")].alias("col"), (F.col("volume") * value).alias("value"))
    return cells.groupBy("row", "col").agg(F.sum("value").alias("value"))


def load(tetras: DataFrame, source: Callable[[Column], Column], degree: int = 4) -> DataFrame:
    """The right side (idx, value): integrals of ``source`` times each node's basis function; ``degree`` covers their product."""
    order, points = _order(tetras), rule(degree)
    size = 10 if order == 2 else 4
    shares = [[p[4] * _basis(a, order, p) for p in points] for a in range(size)]
    g = tetras.select(F.abs(V.signed_volume(*[F.col(f"v{i}") for i in range(4)])).alias("volume"), _values(points, source).alias("_values"), _nodes(order).alias("_nodes"))
    each = g.select("volume", "_values", "_nodes", F.posexplode(F.expr(f"array({', '.join(map(_numbers, shares))})")).alias("a", "w"))
    return each.select(F.col("_nodes")[F.col("a")].alias("idx"), (F.col("volume") * _sum(F.col("w"), F.col("_values"))).alias("value")).groupBy("idx").agg(F.sum("value").alias("value"))
