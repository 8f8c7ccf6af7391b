"""Column expressions used across operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_angle(angle: Column) -> Column:
    """Wrap to [-pi, pi). ``pmod`` is needed: ``%`` keeps the dividend's sign."""
    return F.pmod(angle + F.pi(), F.lit(2.0) * F.pi()) - F.pi()


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite(value: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(is_finite(value), value)


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of an ANSI division error when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Direction of a vector; (0, 0) for the zero vector."""
    norm = F.sqrt(dx * dx + dy * dy)
    return (
        F.when(norm > 0, dx / norm).otherwise(F.lit(0.0)),
        F.when(norm > 0, dy / norm).otherwise(F.lit(0.0)),
    )
