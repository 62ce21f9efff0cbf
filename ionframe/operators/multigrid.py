"""Algebraic multigrid by smoothed aggregation, as a preconditioner of conjugate gradients; every level is a few tables.

* Strength: i and j are linked if |a_ij| >= ``THETA`` sqrt(a_ii a_jj).
* Aggregates: roots are an independent set at distance two, found in rounds in which the undecided node with the greatest
  hash within two links becomes a root; every other node joins a root next to it, or else an aggregate next to it.
* Prolongation: one column for each aggregate, smoothed by one damped Jacobi step. The coarse matrix is the Galerkin product
  P'AP by joins. Coarsening ends at ``COARSE`` unknowns, which the driver inverts densely, or at a matrix so dominated by its
  diagonal (``DOMINANT``) that two Jacobi steps leave less than a third of any error.
* A V-cycle smooths by damped Jacobi before and after, so it is symmetric. With W = wD^-1 it takes r to Mr + S z, where
  M = 2W - WAW, S = (I - WA)P and z is the coarse cycle of S'r. M and S are tables, so a cycle is three products for two levels and
  two more for each level beyond; with the matrix's product it is one job's work.

The damping comes from the largest row sum of |a_ij| / a_ii, one number for each level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.operators.krylov import ITERATIONS, TOLERANCE, Matrix, NotConverged, Sized, _joined, _unknowns, _sums, _vector
from ionframe.storage import Scratch

THETA, COARSE, LEVELS = 0.08, 600, 20
#: Largest row sum of |a_ij| / a_ii of a matrix that needs no coarser one.
DOMINANT = 1.5


def aggregates(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(idx, root): the aggregate of each node (idx), named by its root.

    Every node is linked with itself too, so a step over the links brings along what a node has of its own, and a round's four
    steps are one plan. The hash takes different numbers to different numbers, so there are no ties.
    """
    loops = nodes.select(F.col("idx").alias("a"), F.col("idx").alias("b"))
    with Sized(links.select("a", "b").unionByName(loops).select(F.col("a").alias("row"), F.col("b").alias("col"), F.lit(1.0).alias("value"))) as near:
        own = F.col("row") == F.col("col")

        def around(rows: DataFrame, *kept: str, **found) -> DataFrame:
            """(idx, kept.., found..): a node's own flags, and aggregates over it and the nodes beside it."""
            met = near.entries().select("row", "col").join(rows.withColumnRenamed("idx", "col"), "col")
            return met.groupBy(F.col("row").alias("idx")).agg(*[F.bool_or(own & F.col(k)).alias(k) for k in kept], *[c.alias(n) for n, c in found.items()])

        state = nodes.select("idx", F.lit(False).alias("root"), F.lit(False).alias("near"))
        left = True
        while left:
            undecided = ~F.col("root") & ~F.col("near")
            best = around(state.withColumn("best", F.when(undecided, F.xxhash64("idx"))), "root", "near", best=F.max("best"))
            best = around(best, "root", "near", best=F.max("best"))
            root = F.col("root") | (undecided & F.coalesce(F.col("best") == F.xxhash64("idx"), F.lit(False)))
            reach = around(best.select("idx", root.alias("root"), root.alias("reach")), "root", reach=F.bool_or("reach"))
            reach = around(reach, "root", reach=F.bool_or("reach"))
            state = scratch.table(reach.select("idx", "root", (F.col("reach") & ~F.col("root")).alias("near")), "independent-set")
            left = not state.where("NOT root AND NOT near").isEmpty()
        group = state.select("idx", F.when(F.col("root"), F.col("idx")).alias("group"))
        for _ in range(2):  # next to a root, then next to those
            group = around(group, group=F.coalesce(F.max(F.when(own, F.col("group"))), F.min("group")))
        return scratch.table(group.select("idx", F.col("group").alias("root")), "aggregates")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of the product of two coordinate matrices."""
    right = b.select(F.col("row").alias("col"), F.col("col").alias("_to"), F.col("value").alias("_w"))
    return a.join(right, "col").groupBy("row", F.col("_to").alias("col")).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


@dataclass
class Level:
    unknowns: int
    smoother: Matrix  # M, at the last level of at most ``coarse`` unknowns the inverse
    transfer: Matrix | None  # S; None at the last level


def _inverse(matrix: Matrix) -> DataFrame:
    """(row, col, value) of the pseudo-inverse of a small symmetric matrix, made by the driver."""
    rows = matrix.entries().toArrow()
    order = np.unique(np.concatenate([rows["row"].to_numpy(), rows["col"].to_numpy()]))
    dense = np.zeros((len(order), len(order)))
    dense[np.searchsorted(order, rows["row"].to_numpy()), np.searchsorted(order, rows["col"].to_numpy())] = rows["value"].to_numpy()
    back = np.linalg.pinv(dense, rcond=1e-12)
    i, j = np.nonzero(back)
    return matrix.spark.createDataFrame(pa.table({"row": order[i], "col": order[j], "value": back[i, j]}))


class Hierarchy:
    """The levels of a symmetric positive matrix; a context that drops their tables."""

    def __init__(self, matrix: Matrix, theta: float = THETA, coarse: int = COARSE):
        self.scratch, self.levels, self.held = Scratch(matrix.spark), [], []
        on = F.col("row") == F.col("col")
        while True:
            sums = matrix.entries().groupBy("row").agg(F.sum(F.abs("value")).alias("s"), F.max(F.when(on & (F.col("value") != 0), F.abs("value"))).alias("d"))
            n, whole, bound = sums.agg(F.count(F.lit(1)), F.count("d"), F.max(F.col("s") / F.col("d"))).first()
            if n <= coarse:
                self.levels.append(Level(n, self._keep(Sized(_inverse(matrix))), None))
                break
            omega = 4 / (3 * max(bound or 1.0, 1.0))
            own = Scratch(matrix.spark)
            d = own.table(matrix.diagonal(), "diagonal")
            scaled = matrix.entries().join(d.withColumnsRenamed({"idx": "row", "d": "d1"}), "row").join(d.withColumnsRenamed({"idx": "col", "d": "d2"}), "col")
            scaled = own.table(scaled, "scaled")
            smoother = self._keep(Sized(scaled.select("row", "col", (F.when(on, 2 * omega / F.col("d1")).otherwise(0.0) - F.col("value") / F.col("d1") / F.col("d2") * omega**2).alias("value"))))
            transfer = None
            if len(self.levels) < LEVELS and not (whole == n and bound <= DOMINANT):
                transfer, coarser, smaller = self._coarser(scaled, omega, theta, own)
            own.drop_all_but()
            if transfer is None or smaller >= n:  # nothing is strong enough to be joined
                self.levels.append(Level(n, smoother, None))
                break
            self.levels.append(Level(n, smoother, transfer))
            matrix = coarser

    def _keep(self, matrix: Matrix) -> Matrix:
        self.held.append(matrix)
        return matrix

    def _coarser(self, scaled: DataFrame, omega: float, theta: float, own: Scratch) -> tuple[Matrix, Matrix, int]:
        """S, P'AP and its number of rows."""
        strong = scaled.where("row <> col").where(F.abs("value") >= theta * F.sqrt(F.abs(F.col("d1") * F.col("d2"))))
        links = strong.select(F.explode(F.array(F.struct(F.col("row").alias("a"), F.col("col").alias("b")), F.struct(F.col("col").alias("a"), F.col("row").alias("b")))).alias("l")).select("l.*")
        groups = aggregates(scaled.where("row = col").select(F.col("row").alias("idx")), links, own)
        smaller = groups.where("idx = root").count()
        jacobi = F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0) - F.col("value") / F.col("d1") * omega
        right = groups.select(F.col("idx").alias("col"), F.col("root").alias("_to"))
        prolongation = scaled.withColumn("value", jacobi).join(right, "col").groupBy("row", F.col("_to").alias("col")).agg(F.sum("value").alias("value"))
        prolongation = own.table(prolongation, "prolongation")
        right = prolongation.select(F.col("row").alias("col"), F.col("col").alias("_to"), F.col("value").alias("_w"))
        both = scaled.withColumn("jacobi", jacobi).join(right, "col").groupBy("row", F.col("_to").alias("col")).agg(F.sum(F.col("value") * F.col("_w")).alias("value"), F.sum(F.col("jacobi") * F.col("_w")).alias("smooth"))
        both = own.table(both, "smoothed")
        transfer = self._keep(Sized(both.select("row", "col", F.col("smooth").alias("value")), transpose=True))
        return transfer, self._keep(Sized(product(transposed(prolongation), both.select("row", "col", "value")))), smaller

    def sizes(self) -> list[int]:
        return [level.unknowns for level in self.levels]

    def cycle(self, rest: DataFrame, at: int = 0) -> DataFrame:
        """(idx, z), yet to be summed by idx: one V-cycle for the residual (idx, r)."""
        level = self.levels[at]
        own = level.smoother.parts(rest, {"z": F.col("r")})
        if level.transfer is None:
            return own
        coarse = level.transfer.times(rest, {"r": F.col("r")}, transposed=True)
        if self.levels[at + 1].transfer is not None:  # it is read twice
            coarse = self.scratch.table(coarse, f"restricted-{at}")
        z = self.cycle(coarse, at + 1).groupBy("idx").agg(F.sum("z").alias("z"))
        return own.unionByName(level.transfer.parts(z, {"z": F.col("z")}))

    def __enter__(self) -> Hierarchy:
        return self

    def __exit__(self, *_) -> None:
        for m in self.held:
            m.__exit__()
        self.scratch.drop_all_but()


def conjugate_gradient(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS, theta: float = THETA, coarse: int = COARSE, counts: list | None = None) -> DataFrame:
    """(idx, value) of the solution of a symmetric positive system, each residual improved by a V-cycle first.

    The form of Chronopoulos and Gear: an iteration is one table (idx, x, r, p, s, u, w), u the cycle's result and w the matrix
    times u, and one job for its three sums. ``counts`` gets the sizes of the levels and the number of iterations.
    """
    scratch = Scratch(entries.sparkSession)
    zero, (x, r, p, s, u, w) = F.lit(0.0), (F.col(n) for n in "xrpsuw")
    loops = entries.select("row", F.col("row").alias("col"), zero.alias("value"))  # a product over them brings u along
    with Sized(entries.select("row", "col", F.col("value").cast("double").alias("value")).unionByName(loops)) as matrix, Hierarchy(matrix, theta, coarse) as levels:

        def with_products(state: DataFrame) -> DataFrame:
            better = levels.cycle(state.select("idx", "r")).groupBy("idx").agg(F.sum("z").alias("u"))
            own = F.col("row") == F.col("col")
            met = matrix.entries().join(better.withColumnRenamed("idx", "col"), "col")
            met = met.groupBy(F.col("row").alias("idx")).agg(F.sum(F.when(own, u)).alias("u"), F.sum(F.col("value") * u).alias("w"))
            return scratch.table(_joined(state, met, "u", "w"), "multigrid-state")

        state = _unknowns(matrix, _vector(rhs), [0]).select("idx", zero.alias("x"), F.col("b0").alias("r"), zero.alias("p"), zero.alias("s"))
        state = with_products(scratch.table(state, "right-side"))
        if counts is not None:
            counts.append(levels.sizes())
        before = step = whole = None
        for n in range(max_iterations + 1):
            rz, wz, rr = _sums(state, r * u, w * u, r * r)
            whole = rr if whole is None else whole
            left = math.sqrt(rr / whole) if whole else 0.0
            if left <= tolerance:
                if counts is not None:
                    counts.append(n)
                scratch.drop("right-side")
                return state.select("idx", x.alias("value"))
            if n == max_iterations:
                raise NotConverged("CG with multigrid", n, left)
            turn = rz / before if before else 0.0
            bottom = wz - turn * rz / step if before else wz
            if rz <= 0 or bottom <= 0:
                raise NotConverged("CG with multigrid", n, left, "the matrix is not symmetric and positive, so the method ends")
            before, step = rz, rz / bottom
            ahead, product_ahead = u + p * turn, w + s * turn
            state = with_products(state.select("idx", (x + ahead * step).alias("x"), (r - product_ahead * step).alias("r"), ahead.alias("p"), product_ahead.alias("s")))
    raise AssertionError
