"""Text formats: .pos views, trajectories as JSON, number tables; and the sinks that write them and Parquet meshes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.sources.framed import write_framed

VECTOR_LINE = r"VP\(([^)]*)\)\{([^}]*)\};"
TRACKS = "map<string,array<struct<x:double,y:double,z:double>>>"


def vector_cells(line: Column) -> list[Column]:
    """x, y, z, vx, vy, vz of a VP(...){...}; line, null for other lines."""
    groups = [F.split(F.regexp_extract(line, VECTOR_LINE, g), r"\s*,\s*") for g in (1, 2)]
    return [F.get(g, F.lit(i)).try_cast("double") for g in groups for i in range(3)]


def read_pos(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, vx, vy, vz) of the vector lines of a .pos file; a file without any raises."""
    cells = [c.alias(n) for c, n in zip(vector_cells(F.col("value")), ("x", "y", "z", "vx", "vy", "vz"), strict=True)]
    rows = spark.read.text(path).select(*cells).where("vz IS NOT NULL")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no vectors")
    return rows


def vector_line(p: list[Column], v: list[Column]) -> Column:
    return F.format_string("VP(%s,%s,%s){%s,%s,%s};", *[c.cast("string") for c in (*p, *v)])


def write_pos_vectors(df: DataFrame, path: str, time: float) -> None:
    """(x, y, z, vx, vy, vz) as a .pos view; a negative time raises."""
    _check_time(time)
    line = vector_line([F.col(c) for c in "xyz"], [F.col(c) for c in ("vx", "vy", "vz")])
    _lines(df.dropna().select(line.alias("value")), f'View "Electric Field" {{ TIME{{{time:g}}};', path)


def write_pos_scalars(df: DataFrame, path: str, time: float) -> None:
    """(x, y, z, value) as a .pos view, null values left out; a negative time raises."""
    _check_time(time)
    line = F.format_string("SP(%s,%s,%s){%s};", *[F.col(c).cast("string") for c in ("x", "y", "z", "value")])
    _lines(df.where("value IS NOT NULL").select(line.alias("value")), f'View "Scalar Field" {{ TIME{{{time:g}}};', path)


def _check_time(time: float) -> None:
    if time < 0:
        raise ValueError(f"time {time} is negative")


def _lines(rows: DataFrame, head: str, path: str) -> None:
    """One file at ``path``: the head, the rows' lines in their order, the end; tasks write parts that the commit joins."""
    write_framed(rows, path, head, "};")


def read_tracks(spark: SparkSession, path: str, particle_id: int | None = None) -> DataFrame:
    """(particle_id, seq, x, y, z) of a JSON file {id: [{x, y, z}, ...]}, of all or one particle."""
    each = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TRACKS)).alias("id", "points"))
    rows = each.select(F.col("id").cast("bigint").alias("particle_id"), F.posexplode("points").alias("seq", "p")).select("particle_id", "seq", "p.*")
    return rows if particle_id is None else rows.where(F.col("particle_id") == particle_id)


def write_tracks(nested: DataFrame, path: str) -> bool:
    """(particle_id, points) as JSON lines {id: [...]}, read back and counted; without rows nothing is written and False returned."""
    if nested.isEmpty():
        return False
    nested.select(F.to_json(F.create_map(F.col("particle_id").cast("string"), F.col("points"))).alias("value")).write.mode("overwrite").text(path)
    found = nested.sparkSession.read.text(path).select(F.explode(F.from_json("value", TRACKS)).alias("id", "points"))
    if found.count() != nested.count():
        raise OSError(f"{path} does not hold what was written")
    return True


def read_numbers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Space-separated numbers, # for comments; a line of another number of values raises."""
    return spark.read.schema(", ".join(f"{c} DOUBLE" for c in columns)).csv(path, sep=" ", comment="#", mode="FAILFAST")


def write_numbers(df: DataFrame, path: str, order: list[str]) -> None:
    """One file of space-separated numbers in the order of some columns: sorted by ranges, joined by the commit."""
    write_framed(df.orderBy(*order).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]).alias("value")), path, "", "")


def write_mesh(triangles: DataFrame, path: str) -> bool:
    """The surface mesh (tri_id, v0, v1, v2, area, cnt) as Parquet; False, and nothing written, without rows."""
    if triangles.isEmpty():
        return False
    triangles.write.mode("overwrite").parquet(path)
    return True


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def mesh_id(group: Column) -> Column:
    """The id in a group name Triangle_<id>."""
    return F.regexp_extract(group, r"^Triangle_(\d+)$", 1).try_cast("bigint")


def write_settled(positions: DataFrame, path: str) -> bool:
    """The settled positions (particle_id, x, y, z) as Parquet; without rows a warning, False, and nothing written."""
    if positions.isEmpty():
        warnings.warn("no settled particles to write", stacklevel=2)
        return False
    positions.select("particle_id", "x", "y", "z").write.mode("overwrite").parquet(path)
    return True


def read_settled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_track_table(tracks: DataFrame, path: str) -> bool:
    """Tracks (particle_id, seq, x, y, z) as Parquet sorted by particle within files, so that a scan by id reads few row groups."""
    if tracks.isEmpty():
        return False
    tracks.select("particle_id", "seq", "x", "y", "z").repartitionByRange("particle_id").sortWithinPartitions("particle_id", "seq").write.mode("overwrite").parquet(path)
    return True


def read_track_table(spark: SparkSession, path: str, particle_id: int | None = None) -> DataFrame:
    """All tracks, or one particle's by a filter that reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if particle_id is None else rows.where(F.col("particle_id") == particle_id)


def write_density(grid: DataFrame, path: str) -> None:
    """x y count lines of the grid cells whose count is above 0."""
    write_numbers(grid.select("x", "y", "cnt").where("cnt > 0"), path, ["x", "y"])
