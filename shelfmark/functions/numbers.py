"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column, n: int) -> Column:
    """Round to ``n`` digits in binary arithmetic, as reports print scores."""
    scale = float(10**n)
    return F.floor(c * scale + 0.5) / scale
