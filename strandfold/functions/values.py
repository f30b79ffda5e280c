"""Value functions: expression transforms, mutation calls, burden scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the supported transforms.
TRANSFORMS = ("log1p", "raw", "xena")


def number(text: Column) -> Column:
    """Text to double; whatever does not parse, and NaN, is NULL."""
    return not_nan(F.trim(text).try_cast("double"))


def not_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def transform_expression(value: Column, mode: str = "log1p", offset: float = 1.0) -> Column:
    """Stored ``log2(x + offset)`` to ``log1p(x)``, to ``x`` (raw), or unchanged (xena); NULL stays NULL."""
    if mode not in TRANSFORMS:
        raise ValueError(f"expression transform must be one of: {', '.join(TRANSFORMS)}")
    if mode == "xena":
        return value
    linear = F.greatest(F.pow(F.lit(2.0), value) - F.lit(float(offset)), F.lit(0.0))
    # greatest() skips NULL arguments, so missing cells need their own branch.
    return F.when(value.isNotNull(), F.log1p(linear) if mode == "log1p" else linear)


def is_mutated(value: Column) -> Column:
    """1 for a positive call, 0 for zero, negative or missing."""
    return F.coalesce((not_nan(value.cast("double")) > 0).cast("int"), F.lit(0))


def burden_log2(count: Column) -> Column:
    return F.log2(count.cast("double") + F.lit(1.0))


def burden_from_log2(value: Column, clip: bool = True) -> Column:
    """Inverse of :func:`burden_log2`; predictions are clipped at zero, truths are not."""
    count = F.pow(F.lit(2.0), value) - F.lit(1.0)
    return F.when(value.isNotNull(), F.greatest(count, F.lit(0.0))) if clip else count
