"""Vector operators on ARRAY<FLOAT> columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def steer(h: Column, v: Column, alpha: float) -> Column:
    """h + alpha v; alpha 0 leaves h as it is."""
    return F.transform(h, lambda x: x.cast("double")) if alpha == 0 else F.zip_with(h, v, lambda x, y: x.cast("double") + F.lit(float(alpha)) * y.cast("double"))
