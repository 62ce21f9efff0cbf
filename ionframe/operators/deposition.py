"""Deposition analytics: band histogram, envelope and smoothing, density estimate, binning and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.functions import vectors as V
from ionframe.operators.mesh import overlap_ratio


def band_cells(triangles: DataFrame, centre: float = 50.0, half: float = 2.0) -> DataFrame:
    """The triangles (tri_id, v0, v1, v2, cnt) whose centroid lies in the band |x - centre| <= half, with centroid and overlap."""
    middle = triangles.withColumn("centroid", V.centroid(F.col("v0"), F.col("v1"), F.col("v2")))
    return middle.where(F.col("centroid.x").between(centre - half, centre + half)).withColumn("overlap", overlap_ratio(centre - half, centre + half))


def band_histogram(triangles: DataFrame, centre: float = 50.0, half: float = 2.0, least: float = 0.75, bin_size: float = 1.0) -> DataFrame:
    """(y_bin, total): counts weighted by overlap, by centroid y."""
    cells = band_cells(triangles, centre, half).where(F.col("overlap") >= least)
    return cells.groupBy((F.floor(F.col("centroid.y") / bin_size) * bin_size).alias("y_bin")).agg(F.sum(F.col("cnt") * F.col("overlap")).alias("total"))


def band_listing(triangles: DataFrame, centre: float = 50.0, half: float = 2.0, least: float = 0.75) -> DataFrame:
    """(tri_id, centroid_x, overlap, cnt) of triangles with more than ``least`` of their area in the band."""
    found = triangles.withColumn("overlap", overlap_ratio(centre - half, centre + half)).where(F.col("overlap") > least)
    return found.select("tri_id", V.centroid(F.col("v0"), F.col("v1"), F.col("v2"))["x"].alias("centroid_x"), "overlap", "cnt")


def weighted_histogram(df: DataFrame, x: Column, low: float, high: float, bin_of: Column, weight: Column) -> DataFrame:
    return df.where(x.between(low, high)).groupBy(bin_of.alias("bin")).agg(F.sum(weight).alias("total"))


def envelope(df: DataFrame, value: str, order: list[str], group: list[str], window: int = 5) -> DataFrame:
    """Adds ``envelope``, the sliding maximum, and ``smooth``, its moving sum over ``window`` (zeros outside) divided by it."""
    half = window // 2
    by = W.partitionBy(*group).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("envelope", F.max(value).over(by)).withColumn("smooth", F.sum("envelope").over(by) / window)


def bins(value: Column, low: float, high: float, count: int) -> Column:
    """Bin 0..count-1 of [low, high); below -1, above ``count``."""
    return (F.width_bucket(value, F.lit(low), F.lit(high), F.lit(count)) - 1).cast("int")


def histogram(df: DataFrame, columns: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Counts over the bins of one or more columns, rows outside dropped."""
    binned = df.select(*[bins(F.col(c), *spec).alias(f"{c}_bin") for c, spec in columns.items()])
    for c, (_, _, n) in columns.items():
        binned = binned.where(F.col(f"{c}_bin").between(0, n - 1))
    return binned.groupBy(*[f"{c}_bin" for c in columns]).agg(F.count(F.lit(1)).alias("cnt"))


def exponential_fit(hist: DataFrame, x: str, y: str) -> DataFrame:
    """One row (a, scale) of y = a exp(-x / scale), by linear regression of ln y."""
    positive = hist.where(F.col(y) > 0)
    slope, intercept = F.regr_slope(F.log(y), F.col(x)), F.regr_intercept(F.log(y), F.col(x))
    return positive.agg(F.exp(intercept).alias("a"), (-1 / slope).alias("scale"))


def kde(points: DataFrame, grid_points: int = 100) -> DataFrame:
    """(gx, gy, density) of weighted points (x, y, w) on a grid that reaches 0.5 beyond them.

    The bandwidth is the weighted covariance times the squared Scott factor n_eff^(-1/6). Equal points are summed first; the
    grid has a fixed size, so it is what is broadcast, and every task sums its own points before the shuffle.
    """
    p = points.where("w > 0").groupBy("x", "y").agg(F.sum("w").alias("w"))
    s = p.agg(F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xy"], *[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))]).first()
    mx, my = s["x"] / s["w"], s["y"] / s["w"]
    dx, dy = F.col("x") - mx, F.col("y") - my
    m = p.agg(F.sum(F.col("w") * dx * dx).alias("xx"), F.sum(F.col("w") * dx * dy).alias("xy"), F.sum(F.col("w") * dy * dy).alias("yy")).first()
    n_eff = s["w"] ** 2 / s["w2"]
    k = n_eff ** (-1 / 3) / (1 - s["w2"] / s["w"] ** 2) / s["w"]
    cxx, cxy, cyy = m["xx"] * k, m["xy"] * k, m["yy"] * k
    det = cxx * cyy - cxy * cxy
    ixx, ixy, iyy = cyy / det, -cxy / det, cxx / det
    norm = 1 / (2 * 3.141592653589793 * det**0.5 * s["w"])
    line = lambda low, high, i: low - 0.5 + i * (high - low + 1.0) / (grid_points - 1)
    ids = points.sparkSession.range(grid_points * grid_points)
    grid = ids.select(F.pmod("id", F.lit(grid_points)).alias("gx"), F.floor(F.col("id") / grid_points).alias("gy"))
    grid = grid.withColumn("px", line(s["xmin"], s["xmax"], F.col("gx"))).withColumn("py", line(s["ymin"], s["ymax"], F.col("gy")))
    ex, ey = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    power = -0.5 * (ixx * ex * ex + 2 * ixy * ex * ey + iyy * ey * ey)
    return p.crossJoin(F.broadcast(grid)).groupBy("gx", "gy").agg((F.sum(F.col("w") * F.exp(power)) * norm).alias("density"))
