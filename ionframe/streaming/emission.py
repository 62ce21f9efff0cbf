"""Continuous emission as a stream: particles by rate, and settled counts that a stream of hits keeps up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions.rng import between, draw


def emission(spark: SparkSession, per_second: int, species: str, seed: int = 0) -> DataFrame:
    """An endless stream (ts, id, species, spread) of particles with their draw for the expansion angle."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(F.col("timestamp").alias("ts"), F.col("value").alias("id"), F.lit(species).alias("species"), between(draw(seed, F.col("value"), 0, 0), -1.0, 1.0).alias("spread"))


def settled_stream(hits: DataFrame) -> DataFrame:
    """Counts per triangle of a stream (particle_id, tri_id, ts): a particle settles once, however often its hit arrives."""
    return hits.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["particle_id"]).groupBy("tri_id").agg(F.count(F.lit(1)).alias("cnt"))
