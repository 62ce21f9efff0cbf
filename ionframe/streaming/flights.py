"""The time-stepped flight as a stream: each particle is a state of its own, each step a timer of event time.

The input are files of emitted particles (id, step, ts, x, y, z, vx, vy, vz), their time ts being one ``dt`` after their step (time 0
is late from the beginning), and a row with a negative id in each file that only moves the time on. A particle's arrival stores it and sets a timer for its next
step; a timer moves it one step and sets the next one, until it falls to the floor (a row (id, step, x, y) says where, and
the state ends), or until its steps are used up (the state ends without a row). So state is held for flying particles only,
and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ionframe.storage import new_path

INPUT = "id long, step int, ts timestamp, x double, y double, z double, vx double, vy double, vz double"
SETTLED = "id long, step int, x double, y double"
STATE = "x double, y double, z double, vx double, vy double, vz double, step int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Flight(StatefulProcessor):
    def __init__(self, dt_ms: int, steps: int, floor: float):
        self.dt_ms, self.steps, self.floor = dt_ms, steps, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flight", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                if key[0] >= 0:
                    self.state.update((r.x, r.y, r.z, r.vx, r.vy, r.vz, r.step))
                    self.handle.registerTimer((r.step + 2) * self.dt_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        x, y, z, vx, vy, vz, step = self.state.get()
        dt = self.dt_ms / 1000
        x, y, z, step = x + vx * dt, y + vy * dt, z + vz * dt, step + 1
        if z <= self.floor:
            self.state.clear()
            yield pd.DataFrame({"id": [key[0]], "step": [step], "x": [x], "y": [y]})
        elif step >= self.steps:
            self.state.clear()
        else:
            self.state.update((x, y, z, vx, vy, vz, step))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.dt_ms)

    def close(self) -> None:
        pass


def settling(emitted: DataFrame, dt_ms: int, steps: int, floor: float) -> DataFrame:
    """(id, step, x, y) of the particles of a stream ``INPUT`` that fall to the floor, as soon as its time has passed their step."""
    own = emitted.withWatermark("ts", "0 seconds").groupBy("id")
    return own.transformWithStateInPandas(Flight(dt_ms, steps, floor), SETTLED, "Append", "EventTime")


def write_emission(particles: DataFrame, path: str, dt_ms: int, steps: int) -> None:
    """(id, step, x.., vx..) as the stream's files, one for each step in the order of steps, and two more that end the time."""
    spark = particles.sparkSession
    columns = [c.split()[0] for c in INPUT.split(", ")[3:]]
    for k in range(steps + 3):
        when = [F.lit(k).alias("step"), F.timestamp_millis(F.lit((k + 1) * dt_ms)).alias("ts")]
        clock = spark.range(1).select(F.lit(-1).cast("long").alias("id"), *when, *[F.lit(0.0).alias(c) for c in columns])
        own = particles.where(F.col("step") == k).select("id", *when, *columns)
        own.unionByName(clock).coalesce(1).write.mode("append").parquet(path)


def flown(spark: SparkSession, path: str, dt_ms: int, steps: int, floor: float, enough: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The settled particles of the files at ``path``, each file a batch; a run with an earlier one's checkpoint goes on from it.

    A batch is written under its number, so that one done again after a loss replaces itself. The stream is stopped once
    ``enough`` particles have settled.
    """
    out, checkpoint = f"{checkpoint}-out" if checkpoint else new_path(spark, "settled"), checkpoint or new_path(spark, "flights")
    settled = {"n": 0}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        settled["n"] += batch.sparkSession.read.schema(SETTLED).parquet(f"{out}/batch={number}").count()

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(path)
        run = settling(stream, dt_ms, steps, floor).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        while not run.awaitTermination(1):
            if enough is not None and settled["n"] >= enough:
                run.stop()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(SETTLED).parquet(out)


def settled_by_step(settled: DataFrame, enough: int, steps: int) -> DataFrame:
    """(step, settled, so_far, stopped): the counts of each step up to the one in which ``enough`` have settled, where the run stops."""
    counts = settled.groupBy("step").agg(F.count(F.lit(1)).alias("settled"))
    every = settled.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").withColumn("settled", F.coalesce("settled", F.lit(0)).cast("long"))
    before = every.select(F.col("step").alias("until"), F.col("settled").alias("n"))
    summed = every.join(F.broadcast(before), F.col("until") <= F.col("step")).groupBy("step", "settled").agg(F.sum("n").alias("so_far"))
    return summed.where(F.col("so_far") - F.col("settled") < enough).withColumn("stopped", F.col("so_far") >= enough)
