"""The JSON run configuration: one row of typed columns, sources and boundary conditions as tables."""

from __future__ import annotations

import warnings
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import vectors as V

#: The keys a configuration must have, and the schema of those that are read.
REQUIRED = ["Mesh File", "Threads", "Time Step", "Simulation Time", "T", "P", "Gas", "Model", "EdgeSize", "DesiredAccuracy"]
POINT = "STRUCT<Type: STRING, Count: BIGINT, Energy: DOUBLE, phi: DOUBLE, theta: DOUBLE, expansionAngle: DOUBLE, BaseCoordinates: ARRAY<DOUBLE>>"
SURFACE = "STRUCT<Type: STRING, Count: BIGINT, Energy: DOUBLE, BaseCoordinates: MAP<STRING, ARRAY<DOUBLE>>>"
SOLVER = "solverName maxIterations convergenceTolerance verbosity outputFrequency numBlocks blockSize maxRestarts flexibleGMRES orthogonalization adaptiveBlockSize convergenceTestFrequency".split()
SCHEMA = (
    "`Mesh File` STRING, Threads INT, `Time Step` DOUBLE, `Simulation Time` DOUBLE, T DOUBLE, P DOUBLE, Gas STRING, Model STRING, "
    "EdgeSize STRING, DesiredAccuracy STRING, Sputtering BOOLEAN, "
    + ", ".join(f"{s} STRING" for s in SOLVER)
    + f", ParticleSourcePoint MAP<STRING, {POINT}>, ParticleSourceSurface MAP<STRING, {SURFACE}>, `Boundary Conditions` MAP<STRING, DOUBLE>"
)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per configuration file; empty paths, unreadable files, bad JSON, missing keys and wrong types raise."""
    if not path:
        raise ValueError("the path of the configuration is empty")
    text = spark.read.text(path, wholetext=True)
    names = {k for r in text.select(F.json_object_keys("value").alias("k")).collect() for k in (r["k"] or [])}
    missing = [k for k in REQUIRED if k not in names]
    if missing:
        raise ValueError(f"configuration {path} has no key {', '.join(missing)}")
    config = spark.read.schema(SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    typed = config.withColumn("EdgeSize", F.col("EdgeSize").cast("double")).withColumn("DesiredAccuracy", F.col("DesiredAccuracy").cast("int"))
    try:
        typed.collect()  # a wrong type shows here
    except Exception as e:
        raise ValueError(f"configuration {path} cannot be read: {str(e)[:300]}") from e
    return typed


def point_sources(config: DataFrame) -> DataFrame:
    """(name, type, count, energy_ev, phi, theta, expansion, pos), one row per point source."""
    each = config.select(F.explode("ParticleSourcePoint").alias("name", "s"))
    c = F.col("s.BaseCoordinates")
    return each.select("name", F.col("s.Type").alias("type"), F.col("s.Count").alias("count"), F.col("s.Energy").alias("energy_ev"), "s.phi", "s.theta", F.col("s.expansionAngle").alias("expansion"), V.vec(c[0], c[1], c[2]).alias("pos"))


def surface_sources(config: DataFrame) -> DataFrame:
    """(name, type, count, energy_ev, cell_key, normal), one row per source and cell."""
    each = config.select(F.explode("ParticleSourceSurface").alias("name", "s")).select("name", "s.*")
    cells = each.select("name", F.col("Type").alias("type"), F.col("Count").alias("count"), F.col("Energy").alias("energy_ev"), F.explode("BaseCoordinates").alias("cell_key", "n"))
    return cells.select("name", "type", "count", "energy_ev", "cell_key", V.vec(F.col("n")[0], F.col("n")[1], F.col("n")[2]).alias("normal"))


def boundary_conditions(df: DataFrame, key: str = "node_ids", value: str = "value") -> DataFrame:
    """(node_id, value) of (comma-separated node ids, value); a bad id or a node given twice raises."""
    each = df.select(F.explode(F.split(key, ",")).alias("id"), F.col(value).alias("value"))
    nodes = each.select(F.trim("id").try_cast("bigint").alias("node_id"), "id", "value")
    bad = nodes.where("node_id IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['id']!r} is no node id")
    twice = nodes.groupBy("node_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"node {twice[0]['node_id']} has two boundary conditions")
    return nodes.select("node_id", "value")


def config_conditions(config: DataFrame) -> DataFrame:
    return boundary_conditions(config.select(F.explode("Boundary Conditions").alias("node_ids", "value")))


# A configuration as a dictionary on the driver.


def with_key(config: dict, key: str, value) -> dict:
    return config | {key: value}


def without_key(config: dict, key: str) -> dict:
    return {k: v for k, v in config.items() if k != key}


def check_run(time_step: float, particles: int, most: int = 10_000_000) -> None:
    if time_step <= 0:
        raise ValueError("the time step must be above 0")
    if particles > most:
        raise ValueError(f"{particles} particles are more than {most}")


def is_mesh_name(path: str) -> bool:
    return bool(re.search(r"\.msh$", path))


def renamed_key(config: dict, old: str, new: str) -> dict:
    return {new if k == old else k: v for k, v in config.items()}


def save(config: dict, path: str) -> None:
    """The configuration as JSON on the driver's machine."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f, indent=4, ensure_ascii=False)


#: The least and greatest number of each setting.
RANGES = {
    "maxIterations": (1, 100_000),
    "convergenceTolerance": (1e-50, 1e-1),
    "outputFrequency": (1, 1000),
    "numBlocks": (1, 1000),
    "blockSize": (1, 1000),
    "maxRestarts": (0, 1000),
    "DesiredAccuracy": (1, 20),
    "EdgeSize": (0.1, 1000.0),
}


def solver_settings(config: dict) -> dict:
    """The numbers of RANGES that a configuration holds as text; no number, or one outside its range, raises."""
    found = {}
    for key, (low, high) in RANGES.items():
        if config.get(key) not in (None, ""):
            value = float(config[key])
            if not low <= value <= high:
                raise ValueError(f"{key} {value:g} is not in {low:g}..{high:g}")
            found[key] = int(value) if isinstance(low, int) else value
    return found


def read_solver_settings(path: str) -> dict:
    """The same from a file, which must be named .json."""
    if not path.endswith(".json"):
        raise ValueError(f"{path} is no .json file")
    with open(path, encoding="utf-8") as f:
        return solver_settings(json.load(f))


def check_threads(threads: int, available: int) -> int:
    """At least 1 and at most those available; above 80 % of them warns."""
    if not 1 <= threads <= available:
        raise ValueError(f"{threads} threads are not in 1..{available}")
    if threads > 0.8 * available:
        warnings.warn(f"{threads} threads are more than 80 % of {available}", stacklevel=2)
    return threads
