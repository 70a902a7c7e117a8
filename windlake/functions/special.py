"""The gamma function as a column expression, by the published Lanczos approximation (g = 7, nine terms), for x > 0.5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published coefficients for g = 7.
G = 7.0
COEFFICIENTS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(x: Column) -> Column:
    z = x - 1.0
    series = F.lit(COEFFICIENTS[0])
    for i, c in enumerate(COEFFICIENTS[1:], 1):
        series = series + F.lit(c) / (z + float(i))
    t = z + (G + 0.5)
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * series
