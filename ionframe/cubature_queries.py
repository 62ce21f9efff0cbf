"""Cubature and quadratic elements bound to the test tables; the SQL has closed forms instead of points.

The mesh has a tetrahedron for each embedding, on nodes near its number, so nodes and edges grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.operators import cubature
from ionframe.queries import _cross_sql, _det, _sql3, _vec, query, r
from ionframe.storage import table


def chained_tetras(spark: SparkSession, d: str) -> DataFrame:
    corners = [_vec(16 + 3 * i, 10.0).alias(f"v{i}") for i in range(4)]
    nodes = [(F.col("vec_id") + i).alias(f"n{i}") for i in range(4)]
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("tetra_id"), *corners, *nodes)


_C = f"k AS (SELECT vec_id AS tetra_id, {', '.join(f'vec_id + {i} AS n{i}' for i in range(4))}, {', '.join(_sql3(p, 16 + 3 * i, 10.0) for i, p in enumerate('abcd'))} FROM embeddings)"
_VOLUME = f"abs({_det('a', 'b', 'c', 'd')}) / 6"


def _complete(values: list[str], power: int) -> str:
    """SQL of the sum of all products of ``power`` of the values, repeats included."""
    if power == 0:
        return "1.0"
    if len(values) == 1:
        return "(" + " * ".join(values * power) + ")"
    return f"({_complete(values[:-1], power)} + {values[-1]} * {_complete(values, power - 1)})"


_X, _Y, _Z = ([f"{p}{x}" for p in "abcd"] for x in "xyz")
_XY = f"(({' + '.join(_X)}) * ({' + '.join(_Y)}) + {' + '.join(f'{x} * {y}' for x, y in zip(_X, _Y, strict=True))}) / 20"
_MESH = f"""WITH {_C}, e AS (SELECT a, b, (SELECT max(vec_id) + 3 FROM embeddings) + row_number() OVER (ORDER BY a, b) AS node_id
  FROM (SELECT DISTINCT x.a, x.b FROM (SELECT unnest([{', '.join(f'{{a: n{i}, b: n{j}}}' for i, j in cubature.EDGES)}]) AS x FROM k)))"""
_NODES = f"q AS (SELECT k.*, {', '.join(f'e{k}.node_id AS n{k}' for k in range(4, 10))} FROM k {' '.join(f'JOIN e e{4 + k} ON e{4 + k}.a = n{i} AND e{4 + k}.b = n{j}' for k, (i, j) in enumerate(cubature.EDGES))})"


def _products_sql() -> str:
    """SQL of s00 to s33, the products of the corners' gradients, and the volume."""
    e = {i: [f"({q}{x} - a{x})" for x in "xyz"] for i, q in ((1, "b"), (2, "c"), (3, "d"))}
    g = {1: _cross_sql(e[2], e[3]), 2: _cross_sql(e[3], e[1]), 3: _cross_sql(e[1], e[2])}
    grads = ", ".join(f"{g[i][j]} / det AS g{i}{x}" for i in (1, 2, 3) for j, x in enumerate("xyz"))
    zero = ", ".join(f"-(g1{x} + g2{x} + g3{x}) AS g0{x}" for x in "xyz")
    products = ", ".join(f"{' + '.join(f'g{i}{x} * g{j}{x}' for x in 'xyz')} AS s{i}{j}" for i in range(4) for j in range(4))
    return f"q1 AS (SELECT *, {_det('a', 'b', 'c', 'd')} AS det FROM q), q2 AS (SELECT *, abs(det) / 6 AS volume, {grads} FROM q1 WHERE det <> 0), q3 AS (SELECT *, {zero} FROM q2), q4 AS (SELECT *, {products} FROM q3)"


def _entry(a: int, b: int) -> str:
    """SQL of the exact integral of two quadratic basis functions' gradients, divided by the volume."""
    if a > b:
        a, b = b, a
    if b < 4:
        return f"{0.6 if a == b else -0.2} * s{a}{b}"
    i, j = cubature.EDGES[b - 4]
    if a < 4:
        return f"{0.6 if a == i else -0.2} * s{a}{j} + {0.6 if a == j else -0.2} * s{a}{i}"
    k, m = cubature.EDGES[a - 4]
    return " + ".join(f"{1.6 if u == w else 0.8} * s{x}{y}" for u, x in ((i, j), (j, i)) for w, y in ((k, m), (m, k)))


_ENTRIES = ", ".join(f"{{row: n{a}, col: n{b}, value: volume * ({_entry(a, b)})}}" for a in range(10) for b in range(10))
_LOADS = ", ".join(
    [f"{{idx: n{i}, value: -volume * ({' + '.join(x for k, x in enumerate(_X) if k != i)}) / 60}}" for i in range(4)]
    + [f"{{idx: n{4 + k}, value: volume * ({' + '.join(_X)} + {_X[i]} + {_X[j]}) / 30}}" for k, (i, j) in enumerate(cubature.EDGES)]
)


@query(f"WITH {_C} SELECT tetra_id, round({_VOLUME} * ({_complete(_X, 4)} / 35 + {_XY} + {_complete(_Z, 3)} / 20), 6) AS integral FROM k")
def cubature_integrals(spark: SparkSession, d: str) -> DataFrame:
    """x^4 + x y + z^3 over each tetrahedron."""
    found = cubature.with_integral(chained_tetras(spark, d), lambda p: p["x"] * p["x"] * p["x"] * p["x"] + p["x"] * p["y"] + p["z"] * p["z"] * p["z"], 4)
    return found.select("tetra_id", r("integral").alias("integral"))


@query(f"WITH {_C} SELECT tetra_id, 27::BIGINT AS points, round({_VOLUME}, 6) AS weight, {', '.join(f'round({_VOLUME} * ({c}) / 4, 6) AS {x}' for x, c in (('mx', ' + '.join(_X)), ('my', ' + '.join(_Y)), ('mz', ' + '.join(_Z))))} FROM k")
def cubature_points(spark: SparkSession, d: str) -> DataFrame:
    """How many points a rule of degree 5 has in each tetrahedron, the sum of their weights, and their first moments."""
    at = cubature.with_points(chained_tetras(spark, d), 5)
    moments = [r(F.sum(F.col("weight") * F.col("pos")[x])).alias(f"m{x}") for x in "xyz"]
    return at.groupBy("tetra_id").agg(F.count(F.lit(1)).alias("points"), r(F.sum("weight")).alias("weight"), *moments)


@query(f"{_MESH} SELECT a, b, node_id FROM e")
def quadratic_edge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return cubature.edge_nodes(chained_tetras(spark, d))


def _quadratic(spark: SparkSession, d: str) -> DataFrame:
    tetras = chained_tetras(spark, d)
    return cubature.quadratic(tetras, cubature.edge_nodes(tetras))


@query(f"{_MESH}, {_NODES}, {_products_sql()}, v AS (SELECT unnest([{_ENTRIES}]) AS x FROM q4) SELECT x.row AS row, x.col AS col, round(sum(x.value), 4) AS value FROM v GROUP BY 1, 2")
def quadratic_stiffness(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of quadratic elements, ten nodes to a tetrahedron."""
    return cubature.stiffness(_quadratic(spark, d)).select("row", "col", r("value", 4).alias("value"))


@query(f"{_MESH}, {_NODES}, q1 AS (SELECT *, {_VOLUME} AS volume FROM q), v AS (SELECT unnest([{_LOADS}]) AS x FROM q1) SELECT x.idx AS idx, round(sum(x.value), 6) AS value FROM v GROUP BY 1")
def quadratic_load(spark: SparkSession, d: str) -> DataFrame:
    """The right side of quadratic elements for a source that equals x."""
    return cubature.load(_quadratic(spark, d), lambda p: p["x"], 3).select("idx", r("value").alias("value"))
