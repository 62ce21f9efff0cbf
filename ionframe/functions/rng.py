"""Counter-based randomness: a draw is a function of (seed, id, step, draw), the same in any partitioning and on any retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296.0


def draw(seed: int, key: Column, step, number: int) -> Column:
    """Uniform in [0, 1): the first 8 hex digits of an md5."""
    step = step if isinstance(step, Column) else F.lit(step)
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), step.cast("string"), F.lit(str(number)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / SPAN


def between(u: Column, low: float, high: float) -> Column:
    return u * (high - low) + low


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal of two uniform draws."""
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(2 * math.pi * u2)
