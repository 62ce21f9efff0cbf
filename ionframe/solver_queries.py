"""The solvers bound to the test tables. The SQL solves the same systems another way: fixed-point steps, closed forms.

Systems grow with the tables: every `lineitem` row is an entry, every part, order or supplier an unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.operators import fem, krylov, multigrid
from ionframe.queries import bound_tetras, query, r
from ionframe.storage import table

#: Steps of the SQL's fixed-point iteration, each of which takes the error to less than half.
STEPS = 34


def _off(symmetric: bool = False) -> str:
    one = "SELECT l_partkey AS row, l_suppkey AS col, CAST(l_quantity AS DOUBLE) / 50 * (CAST(l_discount AS DOUBLE) - 0.045) AS value FROM lineitem WHERE l_partkey <> l_suppkey"
    two = f"{one} UNION ALL SELECT l_suppkey, l_partkey, CAST(l_quantity AS DOUBLE) / 50 * (CAST(l_discount AS DOUBLE) - 0.045) FROM lineitem WHERE l_partkey <> l_suppkey"
    return f"m AS MATERIALIZED (SELECT row, col, sum(value) AS value FROM ({two if symmetric else one}) GROUP BY row, col)"


def _fixed_point(sides: str, symmetric: bool = False, known: str = "SELECT NULL::BIGINT AS idx, NULL::DOUBLE AS value WHERE false") -> str:
    """SQL of x_j, the STEPS-th iterate of D x = b - (A - D) x; ``sides`` selects (idx, rhs, b) from part."""
    parts = [
        _off(symmetric),
        f"known AS ({known})",
        f"b AS ({sides})",
        "s AS MATERIALIZED (SELECT b.idx, b.rhs, b.b, 1 + coalesce(g.d, 0) AS d, known.value AS fixed FROM b LEFT JOIN (SELECT row, sum(abs(value)) AS d FROM m GROUP BY row) g ON g.row = b.idx LEFT JOIN known ON known.idx = b.idx)",
        "x0 AS MATERIALIZED (SELECT idx, rhs, coalesce(fixed, b / d) AS x FROM s)",
    ]
    for j in range(1, STEPS + 1):
        parts.append(
            f"x{j} AS MATERIALIZED (SELECT s.idx, s.rhs, coalesce(s.fixed, (s.b - coalesce(p.y, 0)) / s.d) AS x FROM s LEFT JOIN "
            f"(SELECT m.row, x.rhs, sum(m.value * x.x) AS y FROM m JOIN x{j - 1} x ON x.idx = m.col GROUP BY m.row, x.rhs) p ON p.row = s.idx AND p.rhs = s.rhs)"
        )
    return "WITH " + ",\n".join(parts)


def _system(spark: SparkSession, d: str, symmetric: bool = False) -> DataFrame:
    """(row, col, value) over all parts: an entry for each pair of part and supplier numbers in lineitem, and a strong diagonal."""
    weight = F.col("l_quantity").cast("double") / 50 * (F.col("l_discount").cast("double") - 0.045)
    off = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), weight.alias("value"))
    if symmetric:
        off = off.unionByName(off.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    off = off.groupBy("row", "col").agg(F.sum("value").alias("value"))
    strong = off.groupBy("row").agg(F.sum(F.abs("value")).alias("d"))
    every = table(spark, d, "part").select(F.col("p_partkey").alias("row")).join(strong, "row", "left")
    return off.unionByName(every.select("row", F.col("row").alias("col"), (F.lit(1.0) + F.coalesce("d", F.lit(0.0))).alias("value")))


def _price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_retailprice").cast("double") / 1000).alias("value"))


def _two_sides(spark: SparkSession, d: str) -> DataFrame:
    sides = [F.struct(F.lit("price").alias("rhs"), (F.col("p_retailprice").cast("double") / 1000).alias("value")), F.struct(F.lit("size").alias("rhs"), F.col("p_size").cast("double").alias("value"))]
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.explode(F.array(*sides)).alias("s")).select("idx", "s.rhs", "s.value")


_PRICE = "SELECT p_partkey AS idx, 0 AS rhs, CAST(p_retailprice AS DOUBLE) / 1000 AS b FROM part"
_BOTH = "SELECT p_partkey AS idx, 'price' AS rhs, CAST(p_retailprice AS DOUBLE) / 1000 AS b FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part"


@query(_fixed_point(_PRICE, known="SELECT s_suppkey AS idx, CAST(s_acctbal AS DOUBLE) / 1000 AS value FROM supplier WHERE s_nationkey < 5") + f" SELECT idx, round(x, 6) AS value FROM x{STEPS}")
def gmres_dirichlet(spark: SparkSession, d: str) -> DataFrame:
    """An asymmetric system under Dirichlet conditions, with so short a basis that it restarts."""
    fixed = table(spark, d, "supplier").where("s_nationkey < 5").select((F.col("s_suppkey") + 1).alias("node_id"), (F.col("s_acctbal").cast("double") / 1000).alias("value"))
    options = fem.solver_options("GMRES", {"numBlocks": 4, "convergenceTolerance": 1e-11, "maxIterations": 200})
    return fem.solve(_system(spark, d), _price(spark, d), fixed, "GMRES", options).select("idx", r("value").alias("value"))


@query(_fixed_point(_BOTH) + f" SELECT idx, rhs, round(x, 6) AS value FROM x{STEPS}")
def block_gmres(spark: SparkSession, d: str) -> DataFrame:
    """Two right sides of an asymmetric system at once."""
    return krylov.block_gmres(_system(spark, d), _two_sides(spark, d), 1e-11).select("idx", "rhs", r("value").alias("value"))


@query(_fixed_point(_BOTH, symmetric=True) + f" SELECT idx, rhs, round(x, 6) AS value FROM x{STEPS}")
def block_conjugate_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Two right sides of a symmetric positive system at once."""
    return krylov.block_conjugate_gradient(_system(spark, d, symmetric=True), _two_sides(spark, d), 1e-11).select("idx", "rhs", r("value").alias("value"))


_TURNED = "o AS (SELECT o_orderkey AS k, 1 + (o_orderkey % 17) / 170.0 AS a, 0.3 + o_custkey % 10 / 100.0 AS b, CAST(o_totalprice AS DOUBLE) / 1e5 AS f FROM orders)"


@query(f"WITH {_TURNED} SELECT 2 * k AS idx, round((a * f + b * (f - 1)) / (a * a + b * b), 6) AS value FROM o UNION ALL SELECT 2 * k + 1, round((b * f - a * (f - 1)) / (a * a + b * b), 6) FROM o")
def minres_indefinite(spark: SparkSession, d: str) -> DataFrame:
    """For each order the block [[a, b], [b, -a]]: as many negative as positive eigenvalues."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.lit(1.0) + F.col("o_orderkey") % 17 / 170).alias("a"), (F.lit(0.3) + F.col("o_custkey") % 10 / 100).alias("b"), (F.col("o_totalprice").cast("double") / 1e5).alias("f"))
    low, high = F.col("k") * 2, F.col("k") * 2 + 1
    cells = [F.struct(i.alias("row"), j.alias("col"), v.alias("value")) for i, j, v in ((low, low, F.col("a")), (low, high, F.col("b")), (high, low, F.col("b")), (high, high, -F.col("a")))]
    entries = o.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    rhs = o.select(F.explode(F.array(F.struct(low.alias("idx"), F.col("f").alias("value")), F.struct(high.alias("idx"), (F.col("f") - 1).alias("value")))).alias("c")).select("c.*")
    return krylov.minres(entries, rhs, 1e-11).select("idx", r("value").alias("value"))


@query("WITH o AS (SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(sum(l_extendedprice) AS DOUBLE) AS p FROM lineitem GROUP BY 1, 2) SELECT l_suppkey AS idx, round(sum(q * p) / sum(q * q), 4) AS value FROM o GROUP BY 1")
def lsqr_unit_prices(spark: SparkSession, d: str) -> DataFrame:
    """The price a unit that fits a supplier's orders best: a row of a rectangular system for each order and supplier."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10_000_000 + F.col("l_suppkey")).alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").cast("double").alias("value"), F.col("l_extendedprice").cast("double").alias("price"))
    return krylov.lsqr(lines, lines.select(F.col("row").alias("idx"), F.col("price").alias("value")), 1e-12).select("idx", r("value", 4).alias("value"))


def _chain_sql(steps: int = 60) -> str:
    """SQL of the chain's system by fixed-point steps, each of which takes the error to two thirds."""
    parts = ["s AS MATERIALIZED (SELECT c_custkey AS idx, CAST(c_acctbal AS DOUBLE) / 1000 AS b FROM customer)", "x0 AS (SELECT idx, b, b / 3 AS x FROM s)"]
    for j in range(1, steps + 1):
        parts.append(f"x{j} AS MATERIALIZED (SELECT o.idx, o.b, (o.b + coalesce(p.x, 0) + coalesce(q.x, 0)) / 3 AS x FROM x{j - 1} o LEFT JOIN x{j - 1} p ON p.idx = o.idx - 1 LEFT JOIN x{j - 1} q ON q.idx = o.idx + 1)")
    return "WITH " + ",\n".join(parts) + f" SELECT idx, round(x, 4) AS value FROM x{steps}"


@query(_chain_sql())
def multigrid_chain(spark: SparkSession, d: str) -> DataFrame:
    """A chain over all customers, each linked with the next, by conjugate gradients with V-cycles."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_acctbal").cast("double") / 1000).alias("value"))
    beside = c.select("idx", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step")).select(F.col("idx").alias("row"), (F.col("idx") + F.col("step")).alias("col"))
    off = beside.join(c.select(F.col("idx").alias("col")), "col").select("row", "col", F.lit(-1.0).alias("value"))
    entries = off.unionByName(c.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(3.0).alias("value")))
    return multigrid.conjugate_gradient(entries, c, 1e-11).select("idx", r("value", 4).alias("value"))


@query("SELECT DISTINCT unnest([vec_id % 61, (vec_id * 3 + 5) % 61, (vec_id * 7 + 10) % 61, (vec_id * 13 + 15) % 61]) AS idx, true AS solved FROM embeddings")
def potential_residual(spark: SparkSession, d: str) -> DataFrame:
    """Whether the potential of a mesh meets its conditioned equation at each node."""
    tetras = bound_tetras(spark, d)
    matrix = fem.stiffness(tetras).select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"), "value")
    rhs = fem.tetra_nodes(tetras).select((F.col("node_id") - 1).alias("idx")).distinct().withColumn("value", F.lit(1.0))
    fixed = table(spark, d, "nation").where("n_nationkey < 4").select((F.col("n_nationkey") + 1).alias("node_id"), F.col("n_nationkey").cast("double").alias("value"))
    found = fem.solve(matrix, rhs, fixed, "CG", {"tolerance": 1e-12})
    left = fem.residual(fem.dirichlet_matrix(matrix, fixed), fem.dirichlet_rhs(rhs, fixed), found)
    return left.select("idx", (F.abs("value") < 1e-6).alias("solved"))
