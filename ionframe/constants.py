"""Physical constants and the species table.

Fixed values, as results depend on them; the two float32 indices are held as the double nearest to the float32 number.
"""

from __future__ import annotations

import struct

GAS_CONSTANT = 8.314
AVOGADRO = 6.02214076e23
KT_REFERENCE = 297.0 * 1.380658e-23
ELEMENTARY_CHARGE = 1.602176565e-19
EV_TO_J = 1.60217733000001e-19
J_TO_EV = 6.241506363094e18
MIN_SPEED = 10.0
BOX_EXPANSION = 1.01
MIN_CONCENTRATION = 1e18
DISPLACEMENT = 0.05
DEPOSIT_NM = 0.14


def float32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


#: Name, mass [kg], radius [m], viscosity-temperature index, VSS deflection parameter, ion charge.
SPECIES = [
    ("O2", 53.1e-27, 2.035e-10, float32(0.77), float32(1.40), -2),
    ("Ar", 6.6335209e-26, 71e-12, float32(0.81), float32(1.40), 0),
    ("Ne", 3.3509177e-26, 160e-12, float32(0.66), float32(1.31), 0),
    ("He", 6.6464731e-27, 120e-12, float32(0.66), float32(1.26), 0),
    ("Ti", 7.9485017e-26, 140e-12, 0.0, 0.0, 2),
    ("Al", 4.4803831e-26, 125e-12, 0.0, 0.0, 3),
    ("Sn", 1.9712258e-25, 145e-12, 0.0, 0.0, 2),
    ("W", 8.4590343e-26, 135e-12, 0.0, 0.0, 6),
    ("Au", 3.2707137e-25, 135e-12, 0.0, 0.0, 3),
    ("Cu", 1.0552061e-25, 135e-12, 0.0, 0.0, 1),
    ("Ni", 9.7462675e-26, 135e-12, 0.0, 0.0, 2),
    ("Ag", 1.7911901e-25, 160e-12, 0.0, 0.0, 1),
]
BY_NAME = {s[0]: s for s in SPECIES}
SPECIES_SCHEMA = "species string, mass double, radius double, vti double, vss_alpha double, charge_ions int, charge_c double"


def species_rows() -> list[tuple]:
    return [(*s, s[5] * ELEMENTARY_CHARGE) for s in SPECIES]


def species_table(spark):
    """One row per species: a dozen, so joins broadcast it."""
    return spark.createDataFrame(species_rows(), SPECIES_SCHEMA)
