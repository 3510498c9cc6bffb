"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import bind


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine in double precision, within [-1, 1]; 0 where it has no meaning.

    b_norm is the length of b where that is known, as for a topic of many rows.
    """

    def clipped(value: Column) -> Column:
        return (
            F.when(value.isNull() | F.isnan(value), F.lit(0.0))
            .when(value > 1, F.lit(1.0))
            .when(value < -1, F.lit(-1.0))
            .otherwise(value)
        )

    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    norms = norm(a) * (norm(b) if b_norm is None else b_norm)
    return F.when(usable, bind(F.try_divide(_dot(a, b), norms), clipped)).otherwise(F.lit(0.0))
