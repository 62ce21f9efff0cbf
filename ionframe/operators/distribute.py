"""Spreading a cell's counted particles over its neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.functions.rng import draw, normal
from ionframe.operators import pairs
from ionframe.operators.mesh import with_shape
from ionframe.storage import materialise


def shares(cells: DataFrame, reached: DataFrame, weight_exponent: int) -> DataFrame:
    """(source, target, num): what each source with particles gives to each cell it reaches, itself included.

    Weights are area times a Gaussian of the centroids' distance, of width max(0.5, twice the root of the mean area).
    """
    shape = with_shape(cells).select("tri_id", "cnt", "area", "centroid")
    src = shape.where("cnt > 0").select(F.col("tri_id").alias("source"), F.col("cnt").alias("n"), F.col("centroid").alias("c0"))
    pairs = reached.select("source", F.col("tri_id").alias("target")).join(src, "source").join(shape.select(F.col("tri_id").alias("target"), "area", "centroid"), "target")
    mean = pairs.groupBy("source").agg(F.greatest(F.lit(0.5), 2 * F.sqrt(F.avg("area"))).alias("sigma"))
    d2 = V.dot(V.sub(F.col("c0"), F.col("centroid")), V.sub(F.col("c0"), F.col("centroid")))
    weighed = pairs.join(mean, "source").withColumn("w", F.col("area") * F.exp(-d2 / (2 * F.col("sigma") * F.col("sigma"))))
    total = weighed.groupBy("source").agg(F.sum("w").alias("all_w"))
    num = F.greatest(F.lit(1), F.round(F.try_divide(F.col("n") * float(10**weight_exponent) * F.col("w"), F.col("all_w")))).cast("long")
    return weighed.join(total, "source").select("source", "target", num.alias("num"))


#: Sources and targets that are weighed at once.
ROWS, COLUMNS = 16, 2048


def _weighed(factor: float | None):
    """Of chunks of sources and targets (sigma, s, t): the sum of a source's weights (tri_id, w), or with ``factor`` every pair's
    rounded share (source, target, num). What has no place or area has no weight, and is null as in SQL."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def numbers(held, *names: str) -> list:
            return [held.field(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]

        def known(held, *names: str):
            return np.all([held.field(n).is_valid().to_numpy(zero_copy_only=False) for n in names], axis=0)

        with np.errstate(all="ignore"):
            for batch in batches:
                for place in range(batch.num_rows):
                    sigma, sources, whole = batch.column(0)[place].as_py(), batch.column(1)[place].values, batch.column(2)[place].values
                    place_of, sure = numbers(sources, *"xyz"), known(sources, *"xyz")
                    if factor is not None:
                        (n, total), sure = numbers(sources, "n", "all_w"), sure & known(sources, "all_w")
                        sure &= total != 0
                    sums, weighed = np.zeros(len(sources)), False
                    for start in range(0, len(whole), COLUMNS):
                        targets = whole.slice(start, COLUMNS)
                        *at, area = numbers(targets, *"xyz", "area")
                        weighty = known(targets, *"xyz", "area")
                        weighed |= weighty.any()
                        for first in range(0, len(sources), ROWS):
                            rows = slice(first, first + ROWS)
                            d2 = 0.0
                            for p, q in zip(place_of, at, strict=True):
                                apart = p[rows, None] - q
                                apart *= apart
                                d2 = d2 + apart
                            d2 /= -(2 * sigma * sigma)
                            w = np.exp(d2, out=d2)
                            w *= area
                            if factor is None:
                                sums[rows] += w.sum(axis=1, where=weighty)
                                continue
                            w *= (n * factor)[rows, None]
                            w /= total[rows, None]
                            w += 0.5
                            num = np.floor(w, out=w).ravel()
                            some = (sure[rows, None] & weighty).ravel()
                            of = pa.array(np.repeat(np.arange(first, first + len(w)), len(targets)))
                            columns = [sources.field("tri_id").take(of), pa.concat_arrays([targets.field("tri_id")] * len(w)), pa.array(num, mask=None if some.all() else ~some)]
                            yield pa.RecordBatch.from_arrays(columns, ["source", "target", "num"])
                    if factor is None:
                        yield pa.RecordBatch.from_arrays([sources.field("tri_id"), pa.array(sums, mask=~(sure & weighed))], ["tri_id", "w"])

    return run


def class_shares(cells: DataFrame, members: DataFrame, reach: DataFrame, weight_exponent: int) -> DataFrame:
    """``shares`` of what classes (cls, other, ..) of cells (tri_id, cls) reach; pairs of cells are made, summed and made again.

    All cells of a class reach the same cells, so a mean area comes from sums over classes. What is shuffled is a row for
    each pair of chunks of sources and targets, and no pairs of cells; these are weighed in numpy.
    """
    at = [F.col("centroid")[a].alias(a) for a in "xyz"]
    shape = materialise(with_shape(cells).join(members.select("tri_id", "cls"), "tri_id").select("cls", "tri_id", "cnt", "area", *at), "shapes")
    areas = shape.groupBy(F.col("cls").alias("other")).agg(F.sum("area").alias("a"), F.count("area").alias("m"))
    mean = reach.join(areas, "other").groupBy("cls").agg(F.greatest(F.lit(0.5), 2 * F.sqrt(F.try_divide(F.sum("a"), F.sum("m")))).alias("sigma"))
    links = reach.select("cls", "other").join(mean, "cls")
    targets = pairs.chunks(shape.select(F.col("cls").alias("other"), "tri_id", "area", "x", "y", "z"), ["other"], "t", enough=pairs.ENOUGH)

    def met(sources: DataFrame) -> DataFrame:
        held = pairs.chunks(sources, ["cls"], "s", enough=pairs.ENOUGH)
        return pairs.spread(links.join(held, "cls").join(targets, "other"), "s", "t").select("sigma", "s", "t")

    kind = cells.schema["tri_id"].dataType.simpleString()
    sources = shape.where("cnt > 0").select("cls", "tri_id", F.col("cnt").alias("n"), "x", "y", "z")
    sums = met(sources.drop("n")).mapInArrow(_weighed(None), f"tri_id {kind}, w double")
    total = materialise(sums.groupBy("tri_id").agg(F.sum("w").alias("all_w")), "weights")
    found = met(sources.join(total, "tri_id")).mapInArrow(_weighed(float(10**weight_exponent)), f"source {kind}, target {kind}, num double")
    return found.select("source", "target", F.greatest(F.lit(1), "num").cast("long").alias("num"))


def distributed(cells: DataFrame, reached: DataFrame, weight_exponent: int) -> DataFrame:
    """(tri_id, cnt): counts of the cells after spreading, scaled to the expected total and truncated; other cells keep theirs."""
    given = shares(cells, reached, weight_exponent).groupBy(F.col("target").alias("tri_id")).agg(F.sum("num").alias("got"))
    model = cells.agg(F.sum("cnt")).first()[0] or 0
    real = given.agg(F.sum("got")).first()[0] or 0
    factor = model * float(10**weight_exponent) / real if real else 1.0
    return cells.select("tri_id", "cnt").join(given, "tri_id", "left").select("tri_id", F.coalesce((F.col("got") * factor).cast("long"), "cnt").alias("cnt"))


def positions(pairs: DataFrame, cells: DataFrame, seed: int, gaussian: bool = False) -> DataFrame:
    """(source, target, pos): one random point per pair in the target triangle, with noise of 5 % of its mean edge."""
    at = pairs.join(cells.select(F.col("tri_id").alias("target"), "v0", "v1", "v2"), "target").withColumn("key", F.concat_ws("-", "source", "target"))
    u = lambda n: draw(seed, F.col("key"), 0, n)
    r1, r2 = (F.least(F.abs(normal(u(2 * i), u(2 * i + 1))), F.lit(1.0)) if gaussian else u(i) for i in (0, 1))
    at = at.withColumn("_a", F.sqrt(r1)).withColumn("_r2", r2)
    p, q = 1 - F.col("_a"), F.col("_a") * (1 - F.col("_r2"))
    v = [F.col(f"v{i}") for i in range(3)]
    inside = V.add(V.add(V.scale(v[0], p), V.scale(v[1], q)), V.scale(v[2], 1 - p - q))
    edge = (V.distance(v[0], v[1]) + V.distance(v[1], v[2]) + V.distance(v[2], v[0])) / 3 * 0.05
    noise = V.vec(*[(normal(u(4 + 2 * i), u(5 + 2 * i)) if gaussian else u(4 + i) - 0.5) * edge for i in range(3)])
    return at.select("source", "target", V.add(inside, noise).alias("pos"))
