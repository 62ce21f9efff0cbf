"""Unit conversion of text values, scalar physics and angles."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionframe.constants import AVOGADRO, EV_TO_J, GAS_CONSTANT, J_TO_EV, MIN_CONCENTRATION

#: Factors to SI units.
FACTORS = {
    "time": {"ns": 1e-9, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0},
    "pressure": {"mPa": 1e-3, "Pa": 1.0, "kPa": 1e3, "psi": 6894.76},
    "volume": {"mm³": 1e-9, "cm³": 1e-6, "m³": 1.0},
    "energy": {"eV": 1.602176634e-19, "keV": 1.602176634e-16, "J": 1.0, "kJ": 1e3, "cal": 4.184},
}


def number(value: Column) -> Column:
    return value.try_cast("double")


def to_kelvin(value: Column, unit: Column) -> Column:
    """Text that is no number gives 0; an unknown unit raises."""
    v = number(value)
    known = F.when(unit == "K", v).when(unit == "F", (v - 32.0) * (5.0 / 9.0) + 273.15).when(unit == "C", v + 273.15)
    return F.when(v.isNull(), 0.0).when(unit.isin("K", "F", "C"), known).otherwise(F.raise_error(F.concat(F.lit("unsupported temperature unit "), unit)).cast("double"))


def to_si(value: Column, unit: Column, quantity: str) -> Column:
    """Text that is no positive number gives 0, and so does an unknown unit."""
    v = number(value)
    factor = F.lit(0.0)
    for name, k in FACTORS[quantity].items():
        factor = F.when(unit == name, F.lit(k)).otherwise(factor)
    return F.when(v > 0, v * factor).otherwise(0.0)


def ev_to_j(energy):
    return energy * EV_TO_J


def j_to_ev(energy):
    return energy * J_TO_EV


def concentration(pressure: float, temperature: float) -> float:
    """Particles in a cubic metre of an ideal gas; below zero raises, a low one warns."""
    n = pressure / (GAS_CONSTANT * temperature) * AVOGADRO
    if n < 0:
        raise ValueError(f"negative gas concentration {n}")
    if n < MIN_CONCENTRATION:
        warnings.warn(f"the gas concentration {n:g} is low; a simulation may take long", stacklevel=2)
    return n


def degrees(angle: Column) -> Column:
    return angle * 180.0 / math.pi


def radians(angle: Column) -> Column:
    return angle * math.pi / 180.0


def theta_phi(direction: Column) -> tuple[Column, Column]:
    """(theta, phi) of a direction vector; the null vector raises."""
    m = F.sqrt(direction["x"] ** 2 + direction["y"] ** 2 + direction["z"] ** 2)
    safe = F.when(m == 0, F.raise_error(F.lit("the direction vector cannot be zero")).cast("double")).otherwise(m)
    return F.acos(direction["z"] / safe), F.atan2(direction["y"], direction["x"])


def target_atoms(density: float, molar_mass: float, radius: float, area: float = 10.0 * 60.0 * 1e-6) -> float:
    """Atoms in the top layer of a sputtering target (kg/m3, kg/mol, m, m2)."""
    return density * AVOGADRO * area * 2 * radius / molar_mass


def model_count(atoms: float, weight_exponent: int) -> int:
    return math.ceil(atoms / 10**weight_exponent)


def flux(count: float, area: float, seconds: float) -> float:
    return count / (area * seconds)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def theta_phi_between(base: Column, tip: Column) -> tuple[Column, Column]:
    """(theta, phi) of the direction from one point to another; equal points raise."""
    return theta_phi(F.struct(*[(tip[a] - base[a]).alias(a) for a in "xyz"]))


def theta_phi_of_turns(turn_x: Column, turn_y: Column, turn_z: Column) -> tuple[Column, Column]:
    """(theta, phi) of an object turned by degrees around the three axes; its direction is (cy cz, sx sz, cx cy)."""
    x, y, z = (radians(a) for a in (turn_x, turn_y, turn_z))
    return theta_phi(F.struct((F.cos(y) * F.cos(z)).alias("x"), (F.sin(x) * F.sin(z)).alias("y"), (F.cos(x) * F.cos(y)).alias("z")))


def colour_index(value: Column, most: Column, entries: int = 256) -> Column:
    """The entry of a table of ``entries`` over 0..most, ends included; no ``most``, or 0, gives the first."""
    share = F.coalesce(value / F.nullif(most, F.lit(0)), F.lit(0.0))
    return clamp(F.floor(share * entries), 0, entries - 1).cast("int")


def colour(index: Column, entries: int = 256) -> Column:
    """(red, green, blue) of an entry, from blue to red."""
    red = index / F.lit(float(entries - 1))
    return F.struct(red.alias("red"), F.lit(0.0).alias("green"), (1 - red).alias("blue"))


def without_last(values: Column, item: Column) -> Column:
    """An array without the last occurrence of an item; unchanged where it has none."""
    last = F.size(values) - F.array_position(F.reverse(values), item) + 1
    found = F.filter(values, lambda _, i: i + 1 != last)
    return F.when(F.array_contains(values, item), found).otherwise(values)
