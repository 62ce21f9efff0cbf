"""Finite elements on linear tetrahedra over coordinate tables: (row, col, value) matrices and (idx, value) vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.functions.rng import between, draw
from ionframe.operators import krylov, multigrid

#: Cubature points of a tetrahedron by desired accuracy, 1 to 20.
CUBATURE_POINTS = {1: 1, 2: 4, 3: 5, 4: 11, 5: 14, 6: 24, 7: 31, 8: 43, 9: 126, 10: 126, 11: 126, 12: 210, 13: 210, 14: 330, 15: 330, 16: 495, 17: 495, 18: 715, 19: 715, 20: 1001}
SOLVERS = ("CG", "Block CG", "GMRES", "Block GMRES", "LSQR", "MINRES")


def with_gradients(tetras: DataFrame) -> DataFrame:
    """Adds volume and g0..g3, the gradients of the four basis functions."""
    v = [F.col(f"v{i}") for i in range(4)]
    out = tetras.withColumns({f"_e{i}": V.sub(v[i], v[0]) for i in (1, 2, 3)})
    e1, e2, e3 = (F.col(f"_e{i}") for i in (1, 2, 3))
    out = out.withColumn("_det", V.dot(e1, V.cross(e2, e3)))
    det = F.nullif("_det", F.lit(0.0))
    for i, (a, b) in {1: (e2, e3), 2: (e3, e1), 3: (e1, e2)}.items():
        out = out.withColumn(f"g{i}", V.vec(*[p / det for p in V.parts(V.cross(a, b))]))
    out = out.withColumn("g0", V.negate(V.add(V.add(F.col("g1"), F.col("g2")), F.col("g3"))))
    return out.withColumn("volume", F.abs("_det") / 6).drop("_e1", "_e2", "_e3", "_det")


def stiffness(tetras: DataFrame) -> DataFrame:
    """The assembled matrix of (tetra_id, n0..n3, v0..v3): equal (row, col) are summed, partly before the shuffle."""
    g = with_gradients(tetras).where("volume > 0")
    cells = [F.struct(F.col(f"n{i}").alias("row"), F.col(f"n{j}").alias("col"), (F.col("volume") * V.dot(F.col(f"g{i}"), F.col(f"g{j}"))).alias("value")) for i in range(4) for j in range(4)]
    return g.select(F.explode(F.array(*cells)).alias("k")).select("k.*").groupBy("row", "col").agg(F.sum("value").alias("value"))


def graph(matrix: DataFrame) -> DataFrame:
    """(row, nnz): the distinct columns of each row."""
    return matrix.select("row", "col").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))


def at(matrix: DataFrame, row: int, col: int) -> float:
    found = matrix.where((F.col("row") == row) & (F.col("col") == col)).agg(F.sum("value").alias("v")).first()["v"]
    if found is None:
        raise IndexError(f"the matrix has no entry ({row}, {col})")
    return found


def check_nodes(conditions: DataFrame, size: int) -> None:
    bad = conditions.where((F.col("node_id") < 1) | (F.col("node_id") > size)).limit(1).collect()
    if bad:
        raise IndexError(f"boundary condition of node {bad[0]['node_id']} outside 1..{size}")


def dirichlet_matrix(matrix: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rows of conditioned nodes (node_id counts from 1) become rows of the identity."""
    rows = conditions.select((F.col("node_id") - 1).alias("row")).distinct()
    return matrix.join(rows, "row", "left_anti").unionByName(rows.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value")))


def dirichlet_rhs(rhs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Values of conditioned nodes replaced."""
    given = conditions.select((F.col("node_id") - 1).alias("idx"), F.col("value").alias("given"))
    return rhs.join(given, "idx", "left").select("idx", F.coalesce("given", "value").alias("value"))


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(idx, value) of the product."""
    x = vector.select(F.col("idx").alias("col"), F.col("value").alias("x"))
    return matrix.join(x, "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def symmetric(matrix: DataFrame, rhs: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conditioned system with known columns moved to the right-hand side: the same solution, and symmetric."""
    known = conditions.select((F.col("node_id") - 1).alias("idx"), "value")
    shift = spmv(matrix, known).select("idx", F.col("value").alias("s"))
    free = rhs.join(known.select("idx"), "idx", "left_anti").join(shift, "idx", "left").select("idx", (F.col("value") - F.coalesce("s", F.lit(0.0))).alias("value"))
    rows, cols = known.select(F.col("idx").alias("row")), known.select(F.col("idx").alias("col"))
    inner = matrix.join(rows, "row", "left_anti").join(cols, "col", "left_anti").select("row", "col", "value")
    eye = known.select(F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(1.0).alias("value"))
    return inner.unionByName(eye), free.unionByName(known)


#: Names of orthogonalisations; all are done by projecting every direction twice.
ORTHOGONALIZATIONS = ("DGKS", "ICGS", "IMGS")


#: Preconditioners by solver beside its own diagonal one.
PRECONDITIONERS = {"CG": ("AMG",)}


def solver_options(solver: str, settings: dict) -> dict:
    """What a solver takes of settings (names as in configurations); what only says how to report or to deal out is left."""
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver}")
    kind = settings.get("orthogonalization") or ORTHOGONALIZATIONS[0]
    if kind not in ORTHOGONALIZATIONS:
        raise ValueError(f"unknown orthogonalization {kind}")
    names = {"maxIterations": "max_iterations", "convergenceTolerance": "tolerance"}
    if solver.endswith("GMRES"):
        names |= {"numBlocks": "basis", "maxRestarts": "max_restarts"}
    kind = settings.get("preconditioner") or None
    if kind not in (None, *PRECONDITIONERS.get(solver, ())):
        raise ValueError(f"{solver} has no preconditioner {kind}")
    return {names[k]: v for k, v in settings.items() if k in names} | ({"preconditioner": kind} if kind else {})


def solve(matrix: DataFrame, rhs: DataFrame, conditions: DataFrame, solver: str = "CG", options: dict | None = None) -> DataFrame:
    """The potential (idx, value) under Dirichlet conditions by one of ``SOLVERS``, an unknown name raises.

    Symmetric methods get the symmetric form of the conditioned system, the others its rows of the identity.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver}")
    if solver in ("CG", "Block CG", "MINRES"):
        matrix, rhs = symmetric(matrix, rhs, conditions)
    else:
        matrix, rhs = dirichlet_matrix(matrix, conditions), dirichlet_rhs(rhs, conditions)
    options = dict(options or {})
    if options.pop("preconditioner", None):
        return multigrid.conjugate_gradient(matrix, rhs, **options)
    single = {"CG": krylov.conjugate_gradient, "GMRES": krylov.gmres, "MINRES": krylov.minres, "LSQR": krylov.lsqr}
    if solver in single:
        return single[solver](matrix, rhs, **options)
    block = {"Block CG": krylov.block_conjugate_gradient, "Block GMRES": krylov.block_gmres}[solver]
    return block(matrix, rhs.select("idx", F.lit(0).alias("rhs"), "value"), **options).select("idx", "value")


def residual(matrix: DataFrame, rhs: DataFrame, solution: DataFrame) -> DataFrame:
    """(idx, value): the right side minus the product of the matrix and a solution, for each index that either has."""
    parts = rhs.select("idx", "value").unionByName(spmv(matrix, solution).select("idx", (-F.col("value")).alias("value")))
    return parts.groupBy("idx").agg(F.sum("value").alias("value"))


def field(tetras: DataFrame, potential: DataFrame) -> DataFrame:
    """(tetra_id, ex, ey, ez): minus the gradient of the potential (node_id, phi) in each tetrahedron; unknown nodes are left out."""
    g = with_gradients(tetras)
    each = g.select("tetra_id", F.explode(F.array(*[F.struct(F.col(f"n{i}").alias("node_id"), F.col(f"g{i}").alias("g")) for i in range(4)])).alias("k")).select("tetra_id", "k.node_id", "k.g")
    return each.join(potential, "node_id").where("phi IS NOT NULL").groupBy("tetra_id").agg(*[F.sum(-F.col("phi") * F.col("g")[a]).alias(f"e{a}") for a in "xyz"])


def tetra_nodes(tetras: DataFrame) -> DataFrame:
    """(tetra_id, local_idx, node_id)."""
    return tetras.select("tetra_id", F.posexplode(F.array("n0", "n1", "n2", "n3")).alias("local_idx", "node_id"))


def check_accuracy(accuracy: int) -> int:
    if accuracy not in CUBATURE_POINTS:
        raise ValueError(f"accuracy {accuracy} is not in 1..20")
    return CUBATURE_POINTS[accuracy]


def with_centre(tetras: DataFrame) -> DataFrame:
    """Adds centre and volume."""
    v = [F.col(f"v{i}") for i in range(4)]
    return tetras.withColumn("centre", V.centroid(*v)).withColumn("volume", F.abs(V.signed_volume(*v)))


def total_volume(tetras: DataFrame) -> DataFrame:
    """One row (volume)."""
    return with_centre(tetras).agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))


def shape(matrix: DataFrame) -> DataFrame:
    """One row (rows, cols, nnz, empty) of a coordinate matrix."""
    return matrix.agg(F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"), F.count(F.lit(1)).alias("nnz"), (F.count(F.lit(1)) == 0).alias("empty"))


def vector_size(vector: DataFrame) -> int:
    return vector.count()


def vector_at(vector: DataFrame, idx: int) -> float:
    """The value at a place of (idx, value), also of a solution; a place it does not have raises."""
    found = vector.where(F.col("idx") == idx).limit(1).collect()
    if not found:
        raise IndexError(f"the vector has no entry {idx}")
    return found[0]["value"]


def cleared(vector: DataFrame) -> DataFrame:
    return vector.select("idx", F.lit(0.0).alias("value"))


def randomised(vector: DataFrame, seed: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """The vector with drawn values, the same on any retry."""
    return vector.select("idx", between(draw(seed, F.col("idx"), 0, 0), low, high).alias("value"))


def free_nodes(nodes: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows of (node_id, ...) whose node no condition (node_id) holds."""
    return nodes.join(fixed.select("node_id"), "node_id", "left_anti")


#: What an element can be; only tetrahedra are computed.
CELLS, ORDERS = ("triangle", "pyramid", "wedge", "tetrahedron", "hexahedron"), (1, 2)


def check_cell(cell: str, order: int = 1) -> None:
    """Raises for an unknown cell or order, and for those that are known and not computed."""
    if cell.lower() not in CELLS or order not in ORDERS:
        raise ValueError(f"unknown cell {cell} of order {order}")
    if cell.lower() != "tetrahedron":
        raise NotImplementedError(f"only tetrahedra are computed, not {cell} of order {order}")
