"""The solvers against dense ones, and what they say when they cannot solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.operators import fem, krylov


def frame(spark, dense):
    return spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "row long, col long, value double")


def vector(spark, b):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "idx long, value double")


def block(spark, b):
    return spark.createDataFrame([(i, f"side{c}", float(b[i, c])) for i in range(b.shape[0]) for c in range(b.shape[1])], "idx long, rhs string, value double")


def dense(found, n):
    out = np.zeros(n)
    for i, x in found.select("idx", "value").collect():
        out[i] = x
    return out


def dense_block(found, n, k):
    out = np.zeros((n, k))
    for i, c, x in found.collect():
        out[i, int(c[4:])] = x
    return out


def asymmetric(n, seed):
    """A sparse system as a Dirichlet problem with drift gives it: strong diagonal, unlike halves, rows of the identity."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < 0.08, rng.normal(size=(n, n)), 0.0)
    a[np.arange(n), np.arange(n)] = np.abs(a).sum(axis=1) * 0.6 + 1
    a[:3] = np.eye(n)[:3]
    return a


def positive(n, seed):
    a = asymmetric(n, seed)
    return a @ a.T + np.eye(n)


def test_gmres_and_its_restarts(spark):
    a = asymmetric(30, 1)
    b = np.random.default_rng(2).normal(size=30)
    want = np.linalg.solve(a, b)
    for basis in (20, 4):
        assert np.allclose(dense(krylov.gmres(frame(spark, a), vector(spark, b), 1e-7, basis=basis), 30), want, atol=1e-5)


def test_gmres_says_when_it_stops(spark):
    a = asymmetric(40, 3)
    b = np.ones(40)
    with pytest.raises(krylov.NotConverged) as e:
        krylov.gmres(frame(spark, a), vector(spark, b), max_iterations=2)
    assert e.value.iterations == 2 and e.value.residual > 1e-9
    turn = np.roll(np.eye(6), 1, axis=0)  # one direction is orthogonal to its image, so a restart after one finds nothing
    with pytest.raises(krylov.NotConverged, match="does not lower"):
        krylov.gmres(frame(spark, turn), vector(spark, np.eye(6)[0]), basis=1)
    assert np.allclose(dense(krylov.gmres(frame(spark, turn), vector(spark, np.eye(6)[0]), basis=6), 6), np.linalg.solve(turn, np.eye(6)[0]))


def test_block_gmres(spark):
    a = asymmetric(24, 4)
    b = np.random.default_rng(5).normal(size=(24, 3))
    b[:, 2] = b[:, 0] - 2 * b[:, 1]  # depends on the others
    found = dense_block(krylov.block_gmres(frame(spark, a), block(spark, b), 1e-7, basis=3), 24, 3)
    assert np.allclose(found, np.linalg.solve(a, b), atol=1e-5)


def test_minres_of_indefinite_systems(spark):
    rng = np.random.default_rng(6)
    a = np.where(rng.random((12, 12)) < 0.2, rng.normal(size=(12, 12)), 0.0)
    a = a + a.T + np.diag(np.where(np.arange(12) % 2, 4.0, -4.0))
    b = rng.normal(size=12)
    assert np.linalg.eigvalsh(a).min() < 0 < np.linalg.eigvalsh(a).max()
    assert np.allclose(dense(krylov.minres(frame(spark, a), vector(spark, b), tolerance=1e-11), 12), np.linalg.solve(a, b), atol=1e-8)
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert np.allclose(dense(krylov.minres(frame(spark, swap), vector(spark, [2.0, 3.0])), 2), [3.0, 2.0])
    with pytest.raises(krylov.NotConverged):
        krylov.minres(frame(spark, np.diag([1.0, 0.0]) + 0 * swap), vector(spark, [1.0, 1.0]))


def test_lsqr_of_rectangular_systems(spark):
    rng = np.random.default_rng(7)
    tall = rng.normal(size=(14, 6)) * (rng.random((14, 6)) < 0.8)
    b = rng.normal(size=14)
    assert np.allclose(dense(krylov.lsqr(frame(spark, tall), vector(spark, b), tolerance=1e-12), 6), np.linalg.lstsq(tall, b, rcond=None)[0], atol=1e-8)
    wide, c = tall.T, rng.normal(size=6)  # many solutions: the shortest
    assert np.allclose(dense(krylov.lsqr(frame(spark, wide), vector(spark, c), tolerance=1e-12), 14), np.linalg.lstsq(wide, c, rcond=None)[0], atol=1e-8)
    assert not dense(krylov.lsqr(frame(spark, tall), vector(spark, np.zeros(14))), 6).any()


def test_conjugate_gradients(spark):
    a = positive(14, 8)
    b = np.random.default_rng(9).normal(size=(14, 3))
    b[:, 2] = b[:, 0] + b[:, 1]
    want = np.linalg.solve(a, b)
    assert np.allclose(dense(krylov.conjugate_gradient(frame(spark, a), vector(spark, b[:, 0])), 14), want[:, 0], atol=1e-6)
    assert np.allclose(dense_block(krylov.block_conjugate_gradient(frame(spark, a), block(spark, b)), 14, 3), want, atol=1e-6)


def test_conjugate_gradients_say_when_they_stop(spark):
    chain = 2 * np.eye(60) - np.eye(60, k=1) - np.eye(60, k=-1)
    with pytest.raises(krylov.NotConverged) as e:
        krylov.conjugate_gradient(frame(spark, chain), vector(spark, np.ones(60)), max_iterations=4)
    assert e.value.iterations == 4
    swap = frame(spark, np.array([[0.0, 1.0], [1.0, 0.0]]))
    with pytest.raises(krylov.NotConverged, match="not symmetric and positive"):
        krylov.conjugate_gradient(swap, vector(spark, [1.0, -1.0]))
    with pytest.raises(krylov.NotConverged):
        krylov.block_conjugate_gradient(swap, block(spark, np.array([[1.0], [-1.0]])))


def test_solve_by_name_and_settings(spark):
    """All six names, on the conditioned system of a chain; settings reach the solver."""
    chain = frame(spark, 2 * np.eye(6) - np.eye(6, k=1) - np.eye(6, k=-1))
    ends = spark.createDataFrame([(1, 0.0), (6, 5.0)], "node_id long, value double")
    zero = vector(spark, np.zeros(6))
    for name in fem.SOLVERS:
        assert np.allclose(dense(fem.solve(chain, zero, ends, name), 6), np.arange(6.0), atol=1e-6), name
    with pytest.raises(krylov.NotConverged):
        fem.solve(chain, zero, ends, "GMRES", fem.solver_options("GMRES", {"maxIterations": 2, "convergenceTolerance": 1e-12}))
    assert np.allclose(dense(fem.solve(chain, zero, ends, "CG", fem.solver_options("CG", {"preconditioner": "AMG"})), 6), np.arange(6.0), atol=1e-6)
    with pytest.raises(ValueError):
        fem.solver_options("LSQR", {"preconditioner": "AMG"})
    with pytest.raises(ValueError):
        fem.solve(chain, zero, ends, "Jacobi")
    with pytest.raises(ValueError):
        fem.solver_options("CG", {"flexibleGMRES": True, "orthogonalization": "TSQR"})
    assert fem.solver_options("Block GMRES", {"maxIterations": 9, "convergenceTolerance": 1e-3, "numBlocks": 7, "maxRestarts": 2}) == {"max_iterations": 9, "tolerance": 1e-3, "basis": 7, "max_restarts": 2}


def test_vectors_are_not_shuffled(spark):
    """A table of vectors lies in the matrix's buckets: a product and its join with the vectors have one exchange, of partial sums."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    scratch = krylov.Vectors(spark)
    try:
        with krylov.Matrix(frame(spark, np.eye(9) + np.eye(9, k=1))) as matrix:
            state = scratch.table(spark.range(9).select(F.col("id").alias("idx"), F.lit(2.0).alias("x")), "vectors")
            met = krylov._joined(state, matrix.times(state, {"w": F.col("x")}), "w")
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1
            assert {r.idx: r.w for r in met.collect()} == {i: 2.0 if i == 8 else 4.0 for i in range(9)}
            scratch.drop_all_but()
            assert not scratch.names and not scratch.paths
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
