"""From particles to cells to nodes: charge densities and the tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tetra_charge(located: DataFrame, tetras: DataFrame) -> DataFrame:
    """(tetra_id, charge, volume, density) of the occupied cells, from (tetra_id, charge_c) per particle and (tetra_id, volume)."""
    sums = located.groupBy("tetra_id").agg(F.sum("charge_c").alias("charge"))
    return sums.join(tetras.select("tetra_id", "volume"), "tetra_id").withColumn("density", F.col("charge") / F.nullif("volume", F.lit(0.0)))


def node_density(cells: DataFrame, tetra_nodes: DataFrame) -> DataFrame:
    """(node_id, value): the volume-weighted mean density of the occupied cells at a node."""
    each = tetra_nodes.select("tetra_id", "node_id").join(cells, "tetra_id")
    return each.groupBy("node_id").agg(F.sum(F.col("density") * F.col("volume")).alias("c"), F.sum("volume").alias("v")).where("v > 0").select("node_id", (F.col("c") / F.col("v")).alias("value"))


def tracker(located: DataFrame, step: int) -> DataFrame:
    """(step, tetra_id, particle_id), one row per particle and cell."""
    return located.select(F.lit(step).alias("step"), "tetra_id", F.col("id").alias("particle_id"))


def particle_lists(tracked: DataFrame) -> DataFrame:
    """The tracker with the ids of a cell in one sorted array, for sinks."""
    return tracked.groupBy("step", "tetra_id").agg(F.array_sort(F.collect_list("particle_id")).alias("particles"))


def unsettled(particles: DataFrame, settled: DataFrame) -> DataFrame:
    return particles.join(settled.select(F.col("particle_id").alias("id")), "id", "left_anti")


def settled_counts(settled: DataFrame) -> DataFrame:
    return settled.groupBy("tri_id").agg(F.count(F.lit(1)).alias("cnt"))


def fast(particles: DataFrame, least: float) -> DataFrame:
    v = F.col("v")
    return particles.where(F.sqrt(v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2) >= least)


def tracked_cells(tracked: DataFrame, asked: DataFrame) -> DataFrame:
    """(step, particle_id, tetra_id) of the asked (step, particle_id); one that the tracker has not at exactly that step has a null cell."""
    return asked.join(tracked, ["step", "particle_id"], "left").select("step", "particle_id", "tetra_id")
