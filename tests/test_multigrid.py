"""Multigrid against dense solves, and its iterations as the mesh grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionframe.operators import krylov, multigrid
from ionframe.storage import Scratch


def poisson(spark, n):
    """The five-point matrix of an n x n grid."""
    cells = spark.range(n * n).select(F.col("id"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    near = [("x > 0", -1), (f"x < {n - 1}", 1), ("y > 0", -n), (f"y < {n - 1}", n)]
    out = cells.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(4.0).alias("value"))
    for cond, step in near:
        out = out.unionByName(cells.where(cond).select(F.col("id").alias("row"), (F.col("id") + step).alias("col"), F.lit(-1.0).alias("value")))
    return out


def test_iterations_hardly_grow(spark):
    """Ten times the nodes, less than 1.5 times the iterations; the small one is compared with a dense solve."""
    seen = []
    for n in (12, 38):
        entries, rhs = poisson(spark, n), spark.range(n * n).select(F.col("id").alias("idx"), (F.col("id") % 7 - 2.5).alias("value"))
        counts = []
        found = multigrid.conjugate_gradient(entries, rhs, 1e-5, coarse=40, counts=counts)
        seen.append(counts)
        if n == 12:
            dense = np.zeros((n * n, n * n))
            for r in entries.collect():
                dense[r.row, r.col] += r.value
            want = np.linalg.solve(dense, np.arange(n * n) % 7 - 2.5)
            assert np.allclose([r.value for r in found.orderBy("idx").collect()], want, atol=1e-2)
    assert len(seen[0][0]) == 2 and len(seen[1][0]) == 3 and seen[1][1] < 1.5 * seen[0][1]


def test_aggregates_are_whole_and_apart(spark):
    links = [(i, i + 1) for i in range(30)] + [(0, i) for i in range(40, 60)]
    nodes = sorted({x for e in links for x in e} | {99})
    frame = spark.createDataFrame([(a, b) for e in links for a, b in (e, e[::-1])], "a long, b long")
    found = {r.idx: r.root for r in multigrid.aggregates(spark.createDataFrame([(i,) for i in nodes], "idx long"), frame, Scratch(spark)).collect()}
    near = {x: {b for e in links for a, b in (e, e[::-1]) if a == x} for x in nodes}
    roots = {i for i, r in found.items() if i == r}
    assert set(found) == set(nodes) and set(found.values()) == roots and 99 in roots
    for a in roots:
        two = near[a] | {c for b in near[a] for c in near[b]}
        assert not (two - {a}) & roots
        assert all(found[b] == a for b in near[a])


def test_what_it_cannot_solve_raises(spark):
    swap = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "row long, col long, value double")
    with pytest.raises(krylov.NotConverged):
        multigrid.conjugate_gradient(swap, spark.createDataFrame([(0, 1.0), (1, -1.0)], "idx long, value double"))


@pytest.mark.parametrize("bucketed", [False, True])
def test_a_dominant_diagonal_needs_no_more_levels(spark, monkeypatch, bucketed):
    """A chain's second level hardly shrinks further and is left to Jacobi; large and small matrices are stored differently."""
    monkeypatch.setattr(krylov, "BUCKETED", 0 if bucketed else 10**9)
    n, counts = 300, []
    nodes = spark.range(n).select(F.col("id").alias("row"))
    cells = nodes.select("row", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"))
    entries = cells.select("row", (F.col("row") + F.col("step")).alias("col"), F.when(F.col("step") == 0, 3.0).otherwise(-1.0).alias("value")).where(f"col BETWEEN 0 AND {n - 1}")
    rhs = nodes.select(F.col("row").alias("idx"), (F.col("row") % 7 - 2.5).alias("value"))
    found = [r.value for r in multigrid.conjugate_gradient(entries, rhs, 1e-11, coarse=10, counts=counts).orderBy("idx").collect()]
    dense = 3 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    assert np.allclose(found, np.linalg.solve(dense, np.arange(n) % 7 - 2.5), atol=1e-9)
    assert len(counts[0]) == 2 and counts[1] < 20
