"""Error function, normal distribution and a linear congruential generator as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of formula 7.1.26 of Abramowitz and Stegun, and of the generator.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
FACTOR, INCREMENT, MODULUS = 1664525, 1013904223, 4294967296


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(ERF):
        series = (series + a) * t
    return F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * (1.0 - series * F.exp(-x * x))


def cdf(x: Column, mean: Column, variance: Column) -> Column:
    return 0.5 * (1 + erf((x - mean) / F.sqrt(2 * variance)))


def scattered(seed: Column, rounds: int = 17) -> Column:
    """A number in [0, 1) after some rounds of the generator from a whole seed."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), seed.cast("long"), lambda s, _: (FACTOR * s + INCREMENT) % MODULUS) / MODULUS
