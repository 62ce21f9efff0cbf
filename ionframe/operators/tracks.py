"""Trajectories in long form: (particle_id, seq, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.operators import graph


def ordered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``seq``, from 0, within each key."""
    return df.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def segments(tracks: DataFrame) -> DataFrame:
    """(particle_id, seq, p0, p1): each point with the one before it."""
    by = W.partitionBy("particle_id").orderBy("seq")
    point = F.struct("x", "y", "z")
    return tracks.select("particle_id", "seq", F.lag(point).over(by).alias("p0"), point.alias("p1")).where("p0 IS NOT NULL")


def interpolated(tracks: DataFrame, share: float) -> DataFrame:
    """Adds ix, iy, iz: the point at ``share`` of the way to the next one; the last point is held."""
    by = W.partitionBy("particle_id").orderBy("seq")
    step = lambda c: F.col(c) + share * (F.coalesce(F.lead(c).over(by), F.col(c)) - F.col(c))
    return tracks.select("*", *[step(c).alias(f"i{c}") for c in "xyz"])


def spawn_groups(tracks: DataFrame, size: int, groups: int) -> DataFrame:
    """(particle_id, n_points, spawn): particles by descending length (then id) in groups of ``size``, the first ``groups`` only."""
    lengths = tracks.groupBy("particle_id").agg(F.count(F.lit(1)).alias("n_points"))
    place = F.row_number().over(W.orderBy(F.desc("n_points"), "particle_id"))
    top = lengths.orderBy(F.desc("n_points"), "particle_id").limit(size * groups)  # the groups wanted bound what is ranked
    return top.withColumn("spawn", F.floor((place - 1) / size).cast("int"))


def recorded(tracks: DataFrame, most: int = 200_000) -> DataFrame:
    """The tracks of the ``most`` smallest particle ids."""
    ids = tracks.select("particle_id").distinct().orderBy("particle_id").limit(most)
    return tracks.join(ids, "particle_id", "left_semi")


def nested(tracks: DataFrame, least: int = 2) -> DataFrame:
    """(particle_id, points ARRAY) of tracks of ``least`` points or more."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))), lambda p: F.struct(p["x"], p["y"], p["z"]))
    return tracks.groupBy("particle_id").agg(points.alias("points")).where(F.size("points") >= least)


def spaced_values(df: DataFrame, value: str, n: int) -> DataFrame:
    """(pos, value): ``n`` evenly spaced of the sorted distinct values, places rounded half to even."""
    return graph.spaced(df, value, n)


def longest(tracks: DataFrame) -> DataFrame:
    """One row (n_points): the length of the longest track."""
    return tracks.groupBy("particle_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("n_points"))
