"""Tail probabilities of rank and variance tests as Column expressions: no Python worker, one fold per result row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 8, brought down by the recurrence."""
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    below = sum((F.ln(z + i) for i in range(1, 8)), F.ln(z))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def _fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    """The incomplete beta function's continued fraction 1 + d1 / (1 + d2 / ..) by the ratio recurrence."""

    def step(s: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        d = F.when(j % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        up, down = 1 + d / s["up"], 1 / (1 + d * s["down"])
        return F.struct(up.alias("up"), down.alias("down"), (s["f"] * up * down).alias("f"))

    start = F.struct(F.lit(1.0).alias("up"), F.lit(0.0).alias("down"), F.lit(1.0).alias("f"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["f"])


def beta_share(x: Column, y: Column, a: Column, b: Column, steps: int = 400) -> Column:
    """Regularised incomplete beta function at x, with y = 1 - x given apart so that nothing cancels near 1."""
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(y))
    low = front / (a * _fraction(x, a, b, steps))
    high = 1 - front / (b * _fraction(y, b, a, steps))
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided probability of a rank correlation of n pairs (Student's t with n - 2 degrees); null under three pairs."""
    return F.when(n >= 3, beta_share(1 - rho * rho, rho * rho, (n - 2) / 2, F.lit(0.5)))


def variance_p(f: Column, n: Column, k: Column) -> Column:
    """Probability of a ratio of variances this large of n rows in k groups; null without degrees of freedom."""
    within, between = (n - k).cast("double"), (k - 1).cast("double")
    whole = within + between * f
    return F.when((k >= 2) & (n > k), beta_share(within / whole, between * f / whole, within / 2, between / 2))
