"""Vectors, units, physics and randomness by hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from ionframe import constants
from ionframe.functions import physics, rng, units
from ionframe.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def xyz(spark, column):
    return tuple(value(spark, column))


@pytest.fixture(autouse=True)
def two_vectors(spark):
    global A, B
    A, B = V.vec(1, 2, 3), V.vec(-2, 0, 5)


def test_vector_algebra(spark):
    assert xyz(spark, V.add(A, B)) == (-1, 2, 8) and xyz(spark, V.sub(A, B)) == (3, 2, -2)
    assert value(spark, V.dot(A, B)) == 13 and xyz(spark, V.cross(A, B)) == (10, -11, 4)
    assert xyz(spark, V.times(A, B)) == (-2, 0, 15) and xyz(spark, V.negate(A)) == (-1, -2, -3)
    assert value(spark, V.module(V.vec(3, 4, 0))) == 5 and xyz(spark, V.normalised(V.vec(0, 0, 0))) == (0, 0, 0)
    assert value(spark, V.is_parallel(A, V.scale(A, 3))) and value(spark, V.is_orthogonal(V.vec(1, 0, 0), V.vec(0, 1, 0)))
    assert xyz(spark, V.signs(B)) == (-1, 0, 1) and value(spark, V.item(A, 2)) == 3
    with pytest.raises(IndexError):
        V.item(A, 3)
    with pytest.raises(Exception, match="zero"):
        value(spark, V.over(A, F.lit(0.0)))
    assert value(spark, V.area_xy(V.vec(0, 0, 0), V.vec(2, 0, 9), V.vec(0, 2, -9))) == 2
    assert value(spark, V.to_text(A)) == "1.0 2.0 3.0" and xyz(spark, V.from_text(F.lit(" 1, 2.5,-3 "))) == (1, 2.5, -3)
    with pytest.raises(Exception, match="three coordinates"):
        value(spark, V.from_text(F.lit("1, 2")))


def test_rotation_turns_z_to_the_vector(spark):
    beta, gamma = V.beta_gamma(B)
    turned = xyz(spark, V.rotated(V.vec(0, 0, 1), beta, gamma))
    assert turned == pytest.approx([c / math.sqrt(29) for c in (-2, 0, 5)])
    with pytest.raises(Exception, match="null vector"):
        value(spark, V.beta_gamma(V.vec(0, 0, 0))[0])


@pytest.mark.parametrize(
    "text,unit,quantity,expected",
    [("1000", "μs", "time", 1e-3), ("2", "min", "time", 120), ("1", "psi", "pressure", 6894.76), ("5", "mm³", "volume", 5e-9), ("1", "cal", "energy", 4.184), ("x", "s", "time", 0), ("-1", "s", "time", 0), ("1", "h", "time", 0)],
)
def test_units(spark, text, unit, quantity, expected):
    assert value(spark, units.to_si(F.lit(text), F.lit(unit), quantity)) == pytest.approx(expected)


def test_temperature(spark):
    assert value(spark, units.to_kelvin(F.lit("32"), F.lit("F"))) == pytest.approx(273.15)
    assert value(spark, units.to_kelvin(F.lit("0"), F.lit("C"))) == 273.15 and value(spark, units.to_kelvin(F.lit("a"), F.lit("K"))) == 0
    with pytest.raises(Exception, match="unsupported"):
        value(spark, units.to_kelvin(F.lit("1"), F.lit("R")))


def test_scalars(spark):
    assert units.concentration(1.0, 300.0) == pytest.approx(2.4145e20, rel=1e-3)
    with pytest.raises(ValueError):
        units.concentration(-1.0, 300.0)
    with pytest.warns(UserWarning):
        units.concentration(1e-4, 300.0)
    assert units.model_count(12345, 2) == 124 and units.flux(10, 2, 5) == 1
    assert value(spark, units.clamp(F.lit(7), 0, 5)) == 5
    assert constants.BY_NAME["Ar"][3] == 0.8100000023841858


def particle(spark, v=(3.0, 4.0, 0.0), species="Ti"):
    row = next(s for s in constants.species_rows() if s[0] == species)
    return spark.createDataFrame([(i, row[1], row[2], row[6]) for i in range(400)], "id long, mass double, radius double, charge_c double").withColumn("v", V.vec(*v))


@pytest.mark.parametrize("model,gas", [("HS", "Ar"), ("vhs", "Ne"), ("VSS", "He")])
def test_collisions_are_sure_or_never(spark, model, gas):
    before = particle(spark, (3000.0, 4000.0, 100.0))
    sure = physics.collide(before, model, gas, 1e26, 0.01, 1, 0)
    assert sure.where("collided").count() == 400
    never = physics.collide(before, model, gas, 1.0, 1.0, 1, 0)
    assert never.where("collided").count() == 0
    # energy in the centre-of-mass frame is kept: the relative part keeps its length
    m, t = constants.BY_NAME["Ti"][1], constants.BY_NAME[gas][1]
    cm = V.scale(V.vec(3000, 4000, 100), m / (m + t))
    lengths = sure.select(V.module(V.sub(F.col("v"), cm)).alias("l")).agg(F.min("l"), F.max("l")).first()
    assert lengths[0] == pytest.approx(lengths[1]) == pytest.approx(t / (m + t) * math.sqrt(3000**2 + 4000**2 + 100**2))


def test_collision_arguments(spark):
    for model, gas in (("XX", "Ar"), ("HS", "Zz"), ("VSS", "Ti")):
        with pytest.raises(ValueError):
            physics.collide(particle(spark), model, gas, 1.0, 1.0, 0, 0)


def test_boris_push(spark):
    still = particle(spark).limit(1).withColumn("e", V.vec(0, 0, 0)).withColumn("b", V.vec(0, 0, 0))
    assert tuple(physics.boris_push(still, 1e-3).first()["v"]) == (3, 4, 0)
    pushed = still.withColumn("e", V.vec(0, 0, 2))
    row = pushed.first()
    assert physics.boris_push(pushed, 1e-3).first()["v"]["z"] == pytest.approx(2 * row["charge_c"] / row["mass"] * 1e-3)
    assert physics.boris_push(pushed, 0) is pushed


def test_draws_do_not_depend_on_partitions(spark):
    one = spark.range(0, 1000, numPartitions=1).select(rng.draw(1, F.col("id"), 2, 3).alias("u"))
    many = spark.range(0, 1000, numPartitions=9).select(rng.draw(1, F.col("id"), 2, 3).alias("u"))
    assert sorted(r.u for r in one.collect()) == sorted(r.u for r in many.collect())
    s = many.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(s[0] - 0.5) < 0.03 and 0 <= s[1] and s[2] < 1
