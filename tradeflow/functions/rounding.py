"""Rounding as the queries' SQL has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int = 0) -> Column:
    """A double to so many digits, halves away from zero: of the product with 10 ** digits, as the SQL's engine does it.

    Spark's round takes the half of the shortest decimal that gives the double. 4.0609375 (a little less in binary) it takes up to 4.060938,
    but its product with a million is 4060937.4999999995, which goes down. Where the product has no bounds, x stays."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.round(x * 10.0**digits) / 10.0**digits
    return F.when(F.isnan(y) | (F.abs(y) == float("inf")), x).otherwise(y)
