"""Particle generators: rows from point and surface sources, random by (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.constants import DISPLACEMENT, EV_TO_J, species_table
from ionframe.functions import vectors as V
from ionframe.functions.physics import displacement, velocity_from_energy
from ionframe.functions.rng import between, draw
from ionframe.storage import partitions

COLUMNS = ["id", "species", "source", "pos", "v", "energy_j"]
CHUNK = 100_000


def check_sources(sources: DataFrame) -> None:
    """Unknown types, counts of 0 and energies of 0 raise."""
    known = [r["species"] for r in species_table(sources.sparkSession).select("species").collect()]
    bad = sources.where(~F.col("type").isin(known) | F.col("type").isNull() | (F.coalesce("count", F.lit(0)) <= 0) | (F.coalesce("energy_ev", F.lit(0.0)) == 0)).limit(1).collect()
    if bad:
        raise ValueError(f"a source of an unknown type, without particles or without energy: {bad[0].asDict()}")


def _rows(each: DataFrame, seed: int, first_id: int) -> DataFrame:
    """Particles of (source, type, n, before, energy_ev, expansion, phi, theta, pos); ids follow the order of the sources."""
    spark = each.sparkSession
    species = F.broadcast(species_table(spark).select("species", "mass"))
    # a source's rows are made in chunks, dealt over all tasks before they are expanded
    chunks = each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition(4 * partitions(spark), "source", "chunk")
    ks = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)
    rows = chunks.withColumn("k", F.explode(ks)).withColumn("id", F.lit(first_id) + F.col("before") + F.col("k"))
    moving = rows.join(species, F.col("type") == F.col("species"))
    spread = between(draw(seed, F.col("id"), 0, 0), -1.0, 1.0)
    v = velocity_from_energy(F.col("energy_ev"), F.col("mass"), F.col("expansion"), F.col("phi"), F.col("theta"), spread)
    return moving.select("id", "species", "source", "pos", v.alias("v"), (F.col("energy_ev") * EV_TO_J).alias("energy_j"))


def from_points(sources: DataFrame, seed: int = 0, first_id: int = 0) -> DataFrame:
    """``count`` particles of each (name, type, count, energy_ev, phi, theta, expansion, pos)."""
    check_sources(sources)
    before = F.coalesce(F.sum("count").over(W.orderBy("name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = sources.select(F.col("name").alias("source"), "type", F.col("count").alias("n"), before.alias("before"), "energy_ev", "expansion", "phi", "theta", "pos")
    return _rows(each, seed, first_id)


def cell_counts(sources: DataFrame) -> DataFrame:
    """The rows of (name, count, cell_key, ...) with ``n``: the source's count over its cells, the remainder to the first by key."""
    of = W.partitionBy("name")
    rank, cells = F.row_number().over(of.orderBy("cell_key")), F.count(F.lit(1)).over(of)
    return sources.withColumn("_r", rank).withColumn("_c", cells).withColumn("n", F.floor(F.col("count") / F.col("_c")) + (F.col("_r") <= F.col("count") % F.col("_c")).cast("long")).drop("_r", "_c")


def from_surfaces(sources: DataFrame, expansion: float = 0.0, seed: int = 0, first_id: int = 0) -> DataFrame:
    """Particles of (name, type, count, energy_ev, cell_key, normal), leaving each cell's centre along its normal."""
    check_sources(sources)
    counted = cell_counts(sources).where("n > 0")
    m = V.module(F.col("normal"))
    before = F.coalesce(F.sum("n").over(W.orderBy("name", "cell_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = counted.select(
        F.concat_ws(":", "name", "cell_key").alias("source"), "type", "n", before.alias("before"), "energy_ev", F.lit(float(expansion)).alias("expansion"),
        F.atan2(F.col("normal.y"), F.col("normal.x")).alias("phi"), F.acos(F.col("normal.z") / m).alias("theta"), V.from_text(F.col("cell_key")).alias("pos"),
    )
    return _rows(each, seed, first_id)


def displaced(particles: DataFrame, directions: DataFrame, factor: float = DISPLACEMENT) -> DataFrame:
    """Particles moved off their source (source, direction), by an equi-join on the source."""
    move = directions.select("source", displacement(F.col("direction"), factor).alias("_d"))
    return particles.join(move, "source", "left").withColumn("pos", F.when(F.col("_d").isNull(), F.col("pos")).otherwise(V.add(F.col("pos"), F.col("_d")))).select(*particles.columns)


def target_source(triangles: DataFrame, count: int, species: str, energy_ev: float) -> DataFrame:
    """A surface source over the centroids of the given cells, all facing down; keys have six decimals."""
    c = V.centroid(F.col("v0"), F.col("v1"), F.col("v2"))
    key = F.format_string("%.6f, %.6f, %.6f", c["x"], c["y"], c["z"])
    return triangles.select(F.lit("target").alias("name"), F.lit(species).alias("type"), F.lit(count).cast("long").alias("count"), F.lit(energy_ev).alias("energy_ev"), key.alias("cell_key"), V.vec(0, 0, -1).alias("normal"))


def all_particles(*tables: DataFrame) -> DataFrame:
    """The union of generated tables; none, or only empty ones, raises."""
    found = None
    for t in tables:
        found = t if found is None else found.unionByName(t)
    if found is None or found.isEmpty():
        raise ValueError("no particles")
    return found


def generated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows made by column expressions."""
    return df.withColumns(columns)
