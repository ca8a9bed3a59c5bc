"""Column builders for intervals, rates and tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def byar(observed: Column, expected: Column) -> tuple[Column, Column]:
    """Byar's limits of observed over expected; zeros where nothing is expected."""
    o, e = observed.cast("double"), expected
    cube = lambda x: x * x * x
    upper = (o + 1) * cube(1 - 1 / (9 * (o + 1)) + Z / (3 * F.sqrt(o + 1))) / e
    some = F.greatest(o, F.lit(1.0))
    lower = F.greatest(F.lit(0.0), some * cube(1 - 1 / (9 * some) - Z / (3 * F.sqrt(some))) / e)
    return F.when(e <= 0, 0.0).when(o == 0, 0.0).otherwise(lower), F.when(e <= 0, 0.0).otherwise(upper)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's limits of k of n; null for n 0."""
    p, z2 = k / n, Z * Z
    centre = p + z2 / (2 * n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    some = n > 0
    return F.when(some, (centre - half) / (1 + z2 / n)), F.when(some, (centre + half) / (1 + z2 / n))


#: Counts from which Stirling's series gives ln n! to ten digits; below, a table.
SERIES_FROM = 10


def ln_factorial(n: Column) -> Column:
    """ln n!, in closed form."""
    few = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(SERIES_FROM)))
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < SERIES_FROM, F.get(few, n.cast("int"))).otherwise(series)


def ln_poisson(n: Column, mu: Column) -> Column:
    """ln of the probability of just n events where mu are expected: a floor of the tail's, without its sum."""
    return n * F.ln(mu) - mu - ln_factorial(n)


def log10_poisson_tail(n: Column, mu: Column) -> Column:
    """log10 of the probability of n or more events where mu are expected.

    The first term by its logarithm; the others as running products of mu over the next count, as many as can add to the
    tenth digit: they fall from the greater of n and mu on as a bell of width sqrt(n) does.
    """
    terms = F.ceil(10 + F.greatest(mu - n, F.lit(0.0)) + F.sqrt(60 * F.greatest(n.cast("double"), mu))).cast("int")
    sums = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, k: F.struct(
            (acc["sum"] + acc["term"] * mu / (n + k)).alias("sum"),
            (acc["term"] * mu / (n + k)).alias("term"),
        ),
    )
    return (ln_poisson(n, mu) + F.ln(sums["sum"])) / F.ln(F.lit(10.0))
