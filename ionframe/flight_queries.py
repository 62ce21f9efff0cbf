"""The flight as a stream, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.queries import _P, bound_particles, query
from ionframe.storage import new_path
from ionframe.streaming import flights

STEPS, DT_MS, FLOOR = 5, 100, -20.0


@query(f"""WITH {_P}, e AS (SELECT id, id % 3 AS born, pz, vz FROM p),
h AS (SELECT id, born + k.range AS step, row_number() OVER (PARTITION BY id ORDER BY k.range) AS n FROM e, range(1, {STEPS + 1}) k WHERE pz + k.range * vz * 0.1 <= {FLOOR} AND born + k.range <= {STEPS}),
c AS (SELECT step, count(*) AS settled FROM h WHERE n = 1 GROUP BY 1),
s AS (SELECT CAST(r.range AS INTEGER) AS step, coalesce(settled, 0) AS settled, CAST(sum(coalesce(settled, 0)) OVER (ORDER BY r.range) AS BIGINT) AS so_far FROM range(1, {STEPS + 1}) r LEFT JOIN c ON c.step = r.range),
t AS (SELECT count(*) // 2 AS enough FROM e WHERE vz < 0)
SELECT step, settled, so_far, so_far >= enough AS stopped FROM s, t WHERE so_far - settled < enough""")
def streamed_flights(spark: SparkSession, d: str) -> DataFrame:
    """Particles emitted in the first three steps fly until half as many as fall have settled; how many do in each step."""
    own = bound_particles(spark, d).select("id", (F.col("id") % 3).cast("int").alias("step"), "pos.x", "pos.y", "pos.z", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.col("v.z").alias("vz"))
    path = new_path(spark, "emission")
    flights.write_emission(own, path, DT_MS, STEPS)
    enough = own.where("vz < 0").count() // 2
    return flights.settled_by_step(flights.flown(spark, path, DT_MS, STEPS, FLOOR, enough), enough, STEPS)
