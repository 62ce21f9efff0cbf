"""The flight as a stream: counts, where particles settle, and a run that goes on from a checkpoint."""

import random

from pyspark.sql import functions as F

from ionframe.streaming import flights

SCHEMA = "id long, step int, x double, y double, z double, vx double, vy double, vz double"


def brute(rows, dt, steps, floor):
    out = {}
    for i, born, x, y, z, vx, vy, vz in rows:
        for k in range(born + 1, steps + 1):
            x, y, z = x + vx * dt, y + vy * dt, z + vz * dt
            if z <= floor:
                out[i] = (k, x, y)
                break
    return out


def test_flights_settle_and_go_on(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.random(), rng.random(), rng.random() * 3, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(-4, 4)) for i in range(40)]
    want = brute(rows, 0.25, 4, 0.0)
    path = f"file://{tmp_path}/in"
    flights.write_emission(spark.createDataFrame(rows, SCHEMA), path, 250, 4)
    files = sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
    later = tmp_path / "later"
    later.mkdir()
    for p in files[3:]:  # the first run sees three files only
        p.rename(later / p.name)
    checkpoint = f"file://{tmp_path}/checkpoint"
    first = flights.flown(spark, path, 250, 4, 0.0, checkpoint=checkpoint).count()
    for p in files[3:]:
        (later / p.name).rename(p)
    found = flights.flown(spark, path, 250, 4, 0.0, checkpoint=checkpoint)
    assert first < len(want)
    assert {r.id: (r.step, round(r.x, 9), round(r.y, 9)) for r in found.collect()} == {i: (k, round(x, 9), round(y, 9)) for i, (k, x, y) in want.items()}
    steps = {r.step: r for r in flights.settled_by_step(found, 5, 4).collect()}
    stop = min(k for k in range(1, 5) if sum(s <= k for s, _, _ in want.values()) >= 5)
    assert max(steps) == stop and steps[stop].stopped and steps[stop].so_far == sum(s <= stop for s, _, _ in want.values())


def test_a_stream_without_particles(spark, tmp_path):
    flights.write_emission(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/in", 100, 1)
    found = flights.flown(spark, f"file://{tmp_path}/in", 100, 1, 0.0)
    assert found.count() == 0
    assert [(r.settled, r.stopped) for r in flights.settled_by_step(found, 1, 1).orderBy(F.col("step")).collect()] == [(0, False)]
