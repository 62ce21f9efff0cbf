"""Krylov solvers over coordinate matrices (row, col, value) and vectors (idx, value) or blocks (idx, rhs, value).

A matrix is written once, bucketed by column (and by row where its transpose is needed), so that a product shuffles the
partial sums of the result but not the matrix. A solver's vectors are the columns of one table with a row for each index,
bucketed in the same way; an iteration writes that table once, which cuts the lineage, and deletes the one before. Only sums reach the
driver: dot products, Gram matrices of a block, the small Hessenberg matrix.

* ``conjugate_gradient``: symmetric positive systems, one product, one table and one job for sums an iteration
* ``block_conjugate_gradient``: several right sides for one pass over the matrix, k x k Gram matrices
* ``gmres``, ``block_gmres``: any regular system; restarted (block) Arnoldi, every projection twice, all sums of a projection
  in one aggregate
* ``minres``: symmetric systems, indefinite too, by the Lanczos recurrence
* ``lsqr``: rectangular systems and least squares, by the Golub-Kahan recurrence

Every solver looks at the residual before it returns: ``NotConverged`` says the method, the iterations and what is left. Indexes
are longs and need not be dense; indexes that only the right side or only the matrix has belong to the system; entries of
one place are summed.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.storage import Scratch, new_path, partitions, remove

TOLERANCE, ITERATIONS, BASIS = 1e-9, 500, 20
#: Entries of a matrix beyond which ``Sized`` buckets it.
BUCKETED = 2_000_000
#: Below this share of the largest, an eigenvalue of a Gram matrix is a direction that the block does not have.
RANK = 1e-24


class NotConverged(ArithmeticError):
    """The residual is above the tolerance when a solver must stop."""

    def __init__(self, method: str, iterations: int, residual: float, reason: str = "iterations are used up"):
        super().__init__(f"{method}: {reason} after {iterations} iterations, the residual is {residual:.3g} of the right side")
        self.method, self.iterations, self.residual = method, iterations, residual


class Matrix:
    """A coordinate matrix on disk, bucketed by the side that products join on; a context that drops its tables."""

    def __init__(self, entries: DataFrame, transpose: bool = False):
        self.spark = spark = entries.sparkSession
        self.tables: dict[str, tuple[str, str]] = {}
        # dealt by bucket first: the sums of a place and the write find their rows where they are
        own = entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value").repartition(partitions(spark), "col")
        self._write(own.groupBy("row", "col").agg(F.sum("value").cast("double").alias("value")), "col", dealt=True)
        if transpose:
            self._write(spark.table(self.tables["col"][0]), "row")

    def _write(self, entries: DataFrame, side: str, dealt: bool = False) -> None:
        name, path, n = f"matrix_{uuid.uuid4().hex}", new_path(self.spark, "matrix"), partitions(self.spark)
        self.spark.sql(f"CREATE TABLE {name} (row BIGINT, col BIGINT, value DOUBLE) USING parquet CLUSTERED BY ({side}) INTO {n} BUCKETS LOCATION '{path}'")
        self.tables[side] = (name, path)
        rows = entries.select("row", "col", "value")
        (rows if dealt else rows.repartition(n, side)).write.insertInto(name)

    def side(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name][0])

    def entries(self) -> DataFrame:
        return self.side("col")

    def times(self, state: DataFrame, vectors: dict[str, Column], transposed: bool = False) -> DataFrame:
        """(idx, one column for each of ``vectors``): the products with expressions over ``state``."""
        return self.parts(state, vectors, transposed).groupBy("idx").agg(*[F.sum(n).alias(n) for n in vectors])

    def parts(self, state: DataFrame, vectors: dict[str, Column], transposed: bool = False) -> DataFrame:
        """The products that ``times`` sums by idx, a row for each entry of the matrix."""
        inner, outer = ("row", "col") if transposed else ("col", "row")
        given = state.select(F.col("idx").alias(inner), *[c.alias(n) for n, c in vectors.items()])
        met = self.side(inner).join(given, inner)
        return met.select(F.col(outer).alias("idx"), *[(F.col("value") * F.col(n)).alias(n) for n in vectors])

    def diagonal(self) -> DataFrame:
        """(idx, d) of the entries that are not 0."""
        return self.entries().where("row = col AND value <> 0").select(F.col("row").alias("idx"), F.col("value").alias("d"))

    def indexes(self, sides: tuple[str, ...] = ("row", "col")) -> DataFrame:
        found = [self.entries().select(F.col(s).alias("idx")) for s in sides]
        return (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct()

    def __enter__(self) -> Matrix:
        return self

    def __exit__(self, *_) -> None:
        for name, path in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)


class Sized(Matrix):
    """A matrix that stays one plain table while it has at most ``BUCKETED`` entries: a file for each bucket costs more than their shuffle."""

    def __init__(self, entries: DataFrame, transpose: bool = False):
        self.tables, self.scratch = {}, Scratch(entries.sparkSession)
        own = entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
        self.spark, self.plain = own.sparkSession, self.scratch.table(own.groupBy("row", "col").agg(F.sum("value").cast("double").alias("value")), "matrix")
        if self.plain.count() > BUCKETED:
            super().__init__(self.plain, transpose)
            self.plain = self.scratch.drop_all_but()

    def side(self, name: str) -> DataFrame:
        return super().side(name) if self.plain is None else self.plain

    def __exit__(self, *_) -> None:
        super().__exit__()
        self.scratch.drop_all_but()


class Vectors(Scratch):
    """Tables of vectors, bucketed by index as the matrix is: a product shuffles its partial sums only, a join with it nothing else."""

    def __init__(self, spark):
        super().__init__(spark)
        self.names: dict[str, str] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        made, path = f"vectors_{uuid.uuid4().hex}", new_path(self.spark, name)
        df.write.bucketBy(partitions(self.spark), "idx").option("path", path).saveAsTable(made, format="parquet")
        self.drop(name)
        self.paths[name], self.names[name] = path, made
        return self.spark.table(made)

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self.names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(n)}")
        super().drop(*names)


def _joined(state: DataFrame, more: DataFrame, *names: str) -> DataFrame:
    """``state`` with the columns ``names`` of ``more``, 0 where it has no row."""
    return state.join(more, "idx", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})


def _combined(coefficients, columns: list[Column]) -> Column:
    """The sum of the columns times numbers."""
    out = None
    for c, x in zip(coefficients, columns, strict=True):
        if c:
            out = x * float(c) if out is None else out + x * float(c)
    return F.lit(0.0) if out is None else out


def _sums(state: DataFrame, *products: Column) -> np.ndarray:
    """The sums of columns as numbers; an infinite or undefined one raises."""
    row = state.agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(products)]).first()
    found = np.array([x or 0.0 for x in row], dtype=float)
    if not np.isfinite(found).all():
        raise ArithmeticError("a sum of the solver is not finite")
    return found


def _gram(state: DataFrame, a: list[Column], b: list[Column]) -> np.ndarray:
    return _sums(state, *[x * y for x in a for y in b]).reshape(len(a), len(b))


def _vector(rhs: DataFrame) -> DataFrame:
    return rhs.select("idx", F.lit(0).alias("rhs"), "value")


def _single(found: DataFrame) -> DataFrame:
    return found.select("idx", "value")


def _sides(rhs: DataFrame) -> list:
    """The right sides of a block, in order; a solver holds all of them at once."""
    return sorted(r[0] for r in rhs.select("rhs").distinct().collect())


def _unknowns(matrix: Matrix, rhs: DataFrame, sides: list) -> DataFrame:
    """(idx, d, b0, b1, ...): a row for each index of the system, d its diagonal entry, 1 where there is none."""
    wide = rhs.groupBy(F.col("idx").cast("long").alias("idx")).agg(*[F.sum(F.when(F.col("rhs") == s, F.col("value").cast("double")).otherwise(0.0)).alias(f"b{c}") for c, s in enumerate(sides)])
    every = matrix.indexes().unionByName(wide.select("idx")).distinct()
    state = _joined(every, wide, *[f"b{c}" for c in range(len(sides))])
    return state.join(matrix.diagonal(), "idx", "left").withColumn("d", F.coalesce("d", F.lit(1.0)))


def _columns(name: str, k: int) -> list[Column]:
    return [F.col(f"{name}{c}") for c in range(k)]


def _long(state: DataFrame, sides: list) -> DataFrame:
    """(idx, rhs, value) of the columns x0, x1, ..."""
    return state.select("idx", F.explode(F.array(*[F.struct(F.lit(s).alias("rhs"), F.col(f"x{c}").alias("value")) for c, s in enumerate(sides)])).alias("x")).select("idx", "x.rhs", "x.value")


def _worst(residual: np.ndarray, whole: np.ndarray) -> float:
    return float(max((math.sqrt(max(r, 0.0) / w) for r, w in zip(residual, whole, strict=True) if w), default=0.0))


def conjugate_gradient(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS) -> DataFrame:
    """(idx, value) of the solution of a symmetric positive system, diagonally preconditioned.

    The form of Chronopoulos and Gear: an iteration is one product, one table (idx, x, r, p, s, d, w) and one job for its
    three sums.
    """
    scratch = Vectors(entries.sparkSession)
    zero, r, d, w = F.lit(0.0), F.col("r"), F.col("d"), F.col("w")
    with Matrix(entries) as matrix:

        def with_product(state: DataFrame) -> DataFrame:
            """Adds w, the matrix times the preconditioned residual."""
            return scratch.table(_joined(state, matrix.times(state, {"w": r / d}), "w"), "conjugate-gradient")

        state = _unknowns(matrix, _vector(rhs), [0]).select("idx", zero.alias("x"), F.col("b0").alias("r"), zero.alias("p"), zero.alias("s"), "d")
        state = with_product(scratch.table(state, "right-side"))
        before = step = whole = None
        for n in range(max_iterations + 1):
            rz, wz, rr = _sums(state, r * r / d, w * r / d, r * r)
            whole = rr if whole is None else whole
            left = math.sqrt(rr / whole) if whole else 0.0
            if left <= tolerance:
                scratch.drop("right-side")
                return state.select("idx", F.col("x").alias("value"))
            if n == max_iterations:
                raise NotConverged("CG", n, left)
            turn = rz / before if before else 0.0
            bottom = wz - turn * rz / step if before else wz
            if rz <= 0 or bottom <= 0:
                raise NotConverged("CG", n, left, "the matrix is not symmetric and positive, so the method ends")
            before, step = rz, rz / bottom
            p, s = r / d + F.col("p") * turn, w + F.col("s") * turn
            state = with_product(state.select("idx", (F.col("x") + p * step).alias("x"), (r - s * step).alias("r"), p.alias("p"), s.alias("s"), "d"))
    raise AssertionError


def block_conjugate_gradient(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS) -> DataFrame:
    """(idx, rhs, value) of the solutions of a symmetric positive system for several right sides (idx, rhs, value).

    Right sides that depend on each other, or are solved before the others, make Gram matrices singular; these are
    inverted on the directions that they have.
    """
    scratch, sides = Vectors(entries.sparkSession), _sides(rhs)
    k = len(sides)
    if not k:
        return rhs.select(F.col("idx").cast("long").alias("idx"), "rhs", F.col("value").cast("double").alias("value"))
    d = F.col("d")
    with Matrix(entries) as matrix:
        state = scratch.table(_unknowns(matrix, rhs, sides), "right-sides")
        r, p, q = (_columns(n, k) for n in "rpq")
        state = state.select("idx", "d", *[F.lit(0.0).alias(f"x{c}") for c in range(k)], *[F.col(f"b{c}").alias(f"r{c}") for c in range(k)], *[(F.col(f"b{c}") / d).alias(f"p{c}") for c in range(k)])
        whole = None
        for n in range(max_iterations + 1):
            state = scratch.table(_joined(state, matrix.times(state, {f"q{c}": p[c] for c in range(k)}), *[f"q{c}" for c in range(k)]), "block-conjugate-gradient")
            found = _sums(state, *[x * y for x in p for y in q], *[x * y / d for x in r for y in r], *[x * x for x in r])
            pq, zr, rr = found[: k * k].reshape(k, k), found[k * k : 2 * k * k].reshape(k, k), found[2 * k * k :]
            whole = rr if whole is None else whole
            left = _worst(rr, whole)
            if left <= tolerance:
                scratch.drop("right-sides")
                return _long(state, sides)
            if n == max_iterations:
                raise NotConverged("Block CG", n, left)
            if np.linalg.eigvalsh(pq + pq.T).min() < -1e-9 * abs(pq).max() or not pq.any():
                raise NotConverged("Block CG", n, left, "the matrix is not symmetric and positive, so the method ends")
            # p and r of one step: p'r = r'z, as the new directions are conjugate to the old ones
            step = np.linalg.pinv(pq, rcond=1e-13, hermitian=True) @ zr
            moved = state.select("idx", "d", *[(F.col(f"x{c}") + _combined(step[:, c], p)).alias(f"x{c}") for c in range(k)], *[(r[c] - _combined(step[:, c], q)).alias(f"r{c}") for c in range(k)], *[f"p{c}" for c in range(k)])
            after = _gram(moved, [x / d for x in r], r)
            turn = np.linalg.pinv(zr, rcond=1e-13, hermitian=True) @ after
            state = moved.select("idx", "d", *[f"x{c}" for c in range(k)], *[f"r{c}" for c in range(k)], *[(r[c] / d + _combined(turn[:, c], p)).alias(f"p{c}") for c in range(k)])
    raise AssertionError


def _orthonormal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, s) with w t orthonormal and w = (w t) s for a block w of this Gram matrix; a direction it lacks is a column of zeros."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    there = values > max(values.max(initial=0.0) * RANK, 0.0)
    root = np.sqrt(np.where(there, values, 1.0))
    return vectors * np.where(there, 1 / root, 0.0), np.where(there, root, 0.0)[:, None] * vectors.T


def block_gmres(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS, basis: int = BASIS, max_restarts: int | None = None, method: str = "Block GMRES") -> DataFrame:
    """(idx, rhs, value) of the solutions for several right sides (idx, rhs, value), preconditioned by the diagonal from the right.

    A cycle builds a basis of at most ``basis`` blocks, then adds the combination of least residual and starts again from
    the true residual.
    """
    scratch, sides = Vectors(entries.sparkSession), _sides(rhs)
    k = len(sides)
    if not k:
        return rhs.select(F.col("idx").cast("long").alias("idx"), "rhs", F.col("value").cast("double").alias("value"))
    d, w, r = F.col("d"), _columns("w", k), _columns("r", k)
    kept = ["idx", "d", *[f"b{c}" for c in range(k)], *[f"x{c}" for c in range(k)]]
    with Matrix(entries) as matrix:
        state = _unknowns(matrix, rhs, sides).withColumns({f"x{c}": F.lit(0.0) for c in range(k)} | {f"r{c}": F.col(f"b{c}") for c in range(k)})
        state = scratch.table(state, "residual")
        whole = before = None
        n = cycles = 0
        while True:
            gram = _gram(state, r, r)
            whole = gram.diagonal() if whole is None else whole
            left = _worst(gram.diagonal(), whole)
            if left <= tolerance:
                return _long(state, sides)
            if n >= max_iterations or (max_restarts is not None and cycles > max_restarts):
                raise NotConverged(method, n, left)
            if before is not None and left > 0.9999 * before:
                raise NotConverged(method, n, left, f"a cycle of {basis} directions does not lower the residual")
            before, cycles = left, cycles + 1
            turn, first = _orthonormal(gram)
            goal = np.zeros(((basis + 1) * k, k))
            goal[:k] = first
            hessenberg = np.zeros(((basis + 1) * k, basis * k))
            state = state.select(*kept, *[_combined(turn[:, c], r).alias(f"v{c}") for c in range(k)])
            size = 0
            for j in range(basis):
                v = _columns("v", (j + 1) * k)
                newest = {f"w{c}": F.col(f"v{j * k + c}") / d for c in range(k)}
                state = scratch.table(_joined(state, matrix.times(state, newest), *newest), "basis")
                n += 1
                part = _gram(state, v, w)
                rest = [w[c] - _combined(part[:, c], v) for c in range(k)]
                found = _sums(state.select("idx", *[f"v{i}" for i in range((j + 1) * k)], *[x.alias(f"w{c}") for c, x in enumerate(rest)]), *[x * y for x in v for y in w], *[x * y for x in w for y in w])
                again, own = found[: len(v) * k].reshape(len(v), k), found[len(v) * k :].reshape(k, k)
                part = part + again
                turn, bottom = _orthonormal(own - again.T @ again)
                size = (j + 1) * k
                hessenberg[:size, j * k : size], hessenberg[size : size + k, j * k : size] = part, bottom
                y, *_ = np.linalg.lstsq(hessenberg[: size + k, :size], goal[: size + k], rcond=1e-14)
                gap = goal[: size + k] - hessenberg[: size + k, :size] @ y
                if _worst((gap * gap).sum(axis=0), whole) <= tolerance / 2 or n >= max_iterations or not bottom.any():
                    break
                if j + 1 < basis:
                    rest = [w[c] - _combined(part[:, c], v) for c in range(k)]
                    state = state.select(*kept, *[f"v{i}" for i in range(size)], *[_combined(turn[:, c], rest).alias(f"v{size + c}") for c in range(k)])
            state = state.select("idx", "d", *[f"b{c}" for c in range(k)], *[(F.col(f"x{c}") + _combined(y[:, c], _columns("v", size)) / d).alias(f"x{c}") for c in range(k)])
            state = _joined(state, matrix.times(state, {f"w{c}": F.col(f"x{c}") for c in range(k)}), *[f"w{c}" for c in range(k)])
            state = scratch.table(state.select(*kept, *[(F.col(f"b{c}") - F.col(f"w{c}")).alias(f"r{c}") for c in range(k)]), "residual")
            scratch.drop("basis")


def gmres(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS, basis: int = BASIS, max_restarts: int | None = None) -> DataFrame:
    """(idx, value) of the solution of a regular system."""
    return _single(block_gmres(entries, _vector(rhs), tolerance, max_iterations, basis, max_restarts, "GMRES"))


def minres(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS) -> DataFrame:
    """(idx, value) of the solution of a symmetric system, which may be indefinite."""
    scratch = Vectors(entries.sparkSession)
    u, v, p, x, c1, c2 = (F.col(n) for n in ("u", "v", "p", "x", "c1", "c2"))
    with Matrix(entries) as matrix:
        state = scratch.table(_unknowns(matrix, _vector(rhs), [0]), "right-side")
        zero = F.lit(0.0)
        size = whole = math.sqrt(_sums(state, F.col("b0") * F.col("b0"))[0])
        if not whole:
            return state.select("idx", zero.alias("value"))
        state = state.select("idx", "b0", zero.alias("x"), zero.alias("u"), (F.col("b0") / whole).alias("v"), zero.alias("c1"), zero.alias("c2"))
        # the last two rotations, the newest beta, what is left of the right side
        cos, cos2, sin, sin2, beta, left = 1.0, 1.0, 0.0, 0.0, 0.0, whole
        for n in range(1, max_iterations + 1):
            state = scratch.table(_joined(state, matrix.times(state, {"p": v}), "p"), "lanczos")
            alpha = _sums(state, v * p)[0]
            rest = p - v * float(alpha) - u * beta
            size = math.sqrt(_sums(state, rest * rest)[0])
            far, near = sin2 * beta, cos2 * beta
            delta, bar = cos * near + sin * alpha, cos * alpha - sin * near
            gamma = math.hypot(bar, size)
            if gamma <= 1e-14 * max(abs(alpha), beta, size, 1e-300):
                raise NotConverged("MINRES", n, abs(left) / whole, "the matrix is singular on the right side")
            cos2, sin2, cos, sin = cos, sin, bar / gamma, size / gamma
            share, left = cos * left, -sin * left
            new = (v - c1 * float(delta) - c2 * float(far)) / float(gamma)
            following = rest / size if size else zero
            state = state.select("idx", "b0", (x + new * float(share)).alias("x"), v.alias("u"), following.alias("v"), new.alias("c1"), c1.alias("c2"))
            beta = size
            if abs(left) <= tolerance * whole or not size:
                break
        return _checked(scratch, matrix, state, "MINRES", n, tolerance, whole)


def _checked(scratch: Scratch, matrix: Matrix, state: DataFrame, method: str, n: int, tolerance: float, whole: float) -> DataFrame:
    """The solution x of (idx, b0, x), if its true residual is within ten times the tolerance that the recurrence met."""
    state = scratch.table(state.select("idx", "b0", "x"), "solution")
    rest = _joined(state, matrix.times(state, {"w": F.col("x")}), "w")
    gap = F.col("b0") - F.col("w")
    left = math.sqrt(_sums(rest, gap * gap)[0]) / whole
    scratch.drop_all_but("solution")
    if left > 10 * tolerance:
        raise NotConverged(method, n, left)
    return state.select("idx", F.col("x").alias("value"))


def lsqr(entries: DataFrame, rhs: DataFrame, tolerance: float = TOLERANCE, max_iterations: int = ITERATIONS) -> DataFrame:
    """(idx, value) by column: the solution, or the least-squares solution of least length, of a rectangular system.

    It stops when the residual, or what the transpose leaves of it, is below the tolerance.
    """
    scratch = Vectors(entries.sparkSession)
    u, v, w, x, p = (F.col(n) for n in "uvwxp")
    with Matrix(entries, transpose=True) as matrix:
        b = rhs.groupBy(F.col("idx").cast("long").alias("idx")).agg(F.sum("value").cast("double").alias("u"))
        rows = scratch.table(_joined(matrix.indexes(("row",)).unionByName(b.select("idx")).distinct(), b, "u"), "rows")
        cols = matrix.indexes(("col",))
        zero = F.lit(0.0)
        whole = beta = math.sqrt(_sums(rows, u * u)[0])
        if not whole:
            return scratch.table(cols.select("idx", zero.alias("value")), "solution")
        rows = rows.select("idx", (u / beta).alias("u"))
        state = scratch.table(_joined(cols, matrix.times(rows, {"v": u}, transposed=True), "v"), "columns")
        alpha = math.sqrt(_sums(state, v * v)[0])
        if not alpha:
            return scratch.table(state.select("idx", zero.alias("value")), "solution")
        state = state.select("idx", zero.alias("x"), (v / alpha).alias("v"), (v / alpha).alias("w"))
        rho_bar, phi_bar, longest = alpha, beta, alpha
        for n in range(1, max_iterations + 1):
            rows = scratch.table(_joined(rows, matrix.times(state, {"p": v}), "p"), "rows").select("idx", (p - u * float(alpha)).alias("u"))
            beta = math.sqrt(_sums(rows, u * u)[0])
            rows = rows.select("idx", (u / beta if beta else zero).alias("u"))
            state = scratch.table(_joined(state, matrix.times(rows, {"p": u}, transposed=True), "p"), "columns")
            following = p - v * float(beta)
            alpha = math.sqrt(_sums(state, following * following)[0]) if beta else 0.0
            longest = max(longest, alpha, beta)
            rho = math.hypot(rho_bar, beta)
            cos, sin = rho_bar / rho, beta / rho
            theta, rho_bar = sin * alpha, -cos * alpha
            phi, phi_bar = cos * phi_bar, sin * phi_bar
            next_v = following / alpha if alpha else zero
            state = state.select("idx", (x + w * (phi / rho)).alias("x"), next_v.alias("v"), (next_v - w * (theta / rho)).alias("w"))
            if phi_bar <= tolerance * whole or alpha * abs(cos) * phi_bar <= tolerance * whole * longest or not alpha:
                found = scratch.table(state.select("idx", F.col("x").alias("value")), "solution")
                scratch.drop_all_but("solution")
                return found
        raise NotConverged("LSQR", max_iterations, phi_bar / whole)
