"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan() -> Column:
    return F.lit(NAN)


def finite(c: Column | str) -> Column:
    """True for finite numbers; Spark orders NaN above infinity, so one test is enough."""
    return F.abs(col(c)) < F.lit(INF)


def only_finite(c: Column | str) -> Column:
    """The value, or NULL where it is NaN or infinite (aggregates skip NULL)."""
    return F.when(finite(c), col(c))


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def half_up(c: Column | str) -> Column:
    """Nearest integer with halves toward +infinity, as a double."""
    return F.floor(col(c) + F.lit(0.5)).cast("double")


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo) if not isinstance(lo, Column) else lo),
                   F.lit(hi) if not isinstance(hi, Column) else hi)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Presentation rounding; adding zero turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def f32(c: Column | str) -> Column:
    """Pass a value through single precision, the storage type of planes."""
    return col(c).cast("float").cast("double")
