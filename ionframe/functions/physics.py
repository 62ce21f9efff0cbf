"""Per-particle physics as column expressions: energy, motion, the Boris push and gas collisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.constants import BY_NAME, EV_TO_J, KT_REFERENCE
from ionframe.functions import vectors as V
from ionframe.functions.rng import between, draw


def velocity_from_energy(energy_ev: Column, mass: Column, expansion: Column, phi: Column, theta: Column, spread: Column) -> Column:
    """Spherical to Cartesian; ``spread`` in [-1, 1) widens theta unless the expansion angle is 0."""
    t = F.when(expansion != 0, theta + spread * expansion).otherwise(theta)
    v = F.sqrt(2 * energy_ev * EV_TO_J / mass)
    return V.vec(v * F.sin(t) * F.cos(phi), v * F.sin(t) * F.sin(phi), v * F.cos(t))


def kinetic_energy(mass: Column, velocity: Column) -> Column:
    return 0.5 * mass * V.dot(velocity, velocity)


def moved(position: Column, velocity: Column, dt: float) -> Column:
    return V.add(position, V.scale(velocity, dt))


def boris_push(df: DataFrame, dt: float, velocity: str = "v", charge: str = "charge_c", mass: str = "mass", electric: str = "e", magnetic: str = "b") -> DataFrame:
    """Half kick, rotation, half kick; nothing for dt = 0 or without fields. The kick holds v x B as well as the rotation."""
    if dt == 0:
        return df
    v, q, m, e, b = (F.col(c) for c in (velocity, charge, mass, electric, magnetic))
    free = V.is_null(e) & V.is_null(b)
    step = (
        df.withColumn("_a", V.scale(V.add(e, V.cross(v, b)), q / m))
        .withColumn("_minus", V.add(v, V.scale(F.col("_a"), dt / 2)))
        .withColumn("_t", V.scale(b, q * dt / (2 * m)))
        .withColumn("_s", V.scale(F.col("_t"), 2 / (1 + V.dot(F.col("_t"), F.col("_t")))))
        .withColumn("_prime", V.add(F.col("_minus"), V.cross(F.col("_minus"), F.col("_t"))))
        .withColumn("_plus", V.add(F.col("_minus"), V.cross(F.col("_prime"), F.col("_s"))))
        .withColumn(velocity, F.when(free, v).otherwise(V.add(F.col("_plus"), V.scale(F.col("_a"), dt / 2))))
    )
    return step.drop("_a", "_minus", "_t", "_s", "_prime", "_plus")


# Collision models: a cross-section by relative speed, and the cosine of the scattering angle from a draw.


def _hs_section(radius: Column, mass: Column, speed: Column, gas: tuple) -> Column:
    return math.pi * (radius + gas[2]) * (radius + gas[2])


def _vhs_section(radius: Column, mass: Column, speed: Column, gas: tuple) -> Column:
    omega = gas[3]
    reduced = mass * gas[1] / (mass + gas[1])
    d = radius + gas[2]
    return math.pi * (d * d / math.gamma(2.5 - omega)) * F.pow(2 * KT_REFERENCE / (reduced * speed * speed), F.lit(omega - 0.5))


MODELS = {
    "HS": (_hs_section, lambda u, gas: between(u, -1.0, 1.0), False),
    "VHS": (_vhs_section, lambda u, gas: u, False),
    "VSS": (_vhs_section, lambda u, gas: 2 * F.pow(u, F.lit(1.0 / gas[4])) - 1, True),
}


def collide(df: DataFrame, model: str, gas: str, concentration: float, dt: float, seed: int, step) -> DataFrame:
    """Gas collisions of (id, v, mass, radius): adds ``collided`` and replaces v. Unknown models and gases raise."""
    name = model.upper()
    if name not in MODELS:
        raise ValueError(f"unknown collision model {model}")
    if gas not in BY_NAME:
        raise ValueError(f"unknown gas {gas}")
    target = BY_NAME[gas]
    section, cosine, turns = MODELS[name]
    if name != "HS" and not target[3] or name == "VSS" and not target[4]:
        raise ValueError(f"{name} needs a gas with known indices, not {gas}")
    u = lambda n: draw(seed, F.col("id"), step, n)
    v = F.col("v")
    share = F.col("mass") / (target[1] + F.col("mass"))
    out = (
        df.withColumn("_speed", V.module(v))
        .withColumn("_p", section(F.col("radius"), F.col("mass"), F.col("_speed"), target) * F.col("_speed") * concentration * dt)
        .withColumn("collided", F.coalesce(u(0) < F.col("_p"), F.lit(False)))
        .withColumn("_cos", cosine(u(1), target))
        .withColumn("_sin", F.sqrt(1 - F.col("_cos") * F.col("_cos")))
        .withColumn("_phi", 2 * math.pi * u(2))
        .withColumn("_length", target[1] / (target[1] + F.col("mass")) * F.col("_speed"))
        .withColumn("_dir", V.scale(V.vec(F.col("_sin") * F.cos("_phi"), F.col("_sin") * F.sin("_phi"), F.col("_cos")), F.col("_length")))
    )
    if turns:
        still = F.when(F.col("_speed") > 0, F.col("_speed"))
        out = out.withColumn("_dir", V.rotated(F.col("_dir"), F.acos(v["z"] / still), F.atan2(v["y"], v["x"])))
    return out.withColumn("v", F.when(F.col("collided"), V.add(F.col("_dir"), V.scale(v, share))).otherwise(v)).drop("_speed", "_p", "_cos", "_sin", "_phi", "_length", "_dir")


def displacement(direction: Column, factor: float) -> Column:
    """``direction`` over its largest component, times ``factor``; the null vector stays."""
    most = F.greatest(*[F.abs(p) for p in V.parts(direction)])
    return F.when(most < 2.220446049250313e-16, V.vec(0, 0, 0)).otherwise(V.vec(*[p / F.when(most != 0, most) * factor for p in V.parts(direction)]))
