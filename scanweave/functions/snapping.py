"""Design-value snapping and tolerance proposals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanweave.functions.vec import clamp

# Fixed values.
METRIC_STEPS = (5.0, 1.0, 0.5, 0.25, 0.1, 0.05)
INCH_STEPS = (25.4 / 4, 25.4 / 8, 25.4 / 16, 25.4 / 32, 25.4 / 64)
COMMON_ANGLES = (0.0, 15.0, 30.0, 45.0, 60.0, 90.0, 120.0, 135.0, 150.0, 180.0)
TOLERANCE_STEPS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0)
UNCERTAINTY_FACTOR = 3.0
NOISE_FACTOR = 2.5
GROWTH_FACTOR = 4.0
DEFAULT_TOLERANCE = 0.10
MIN_TOLERANCE, MAX_TOLERANCE = 0.001, 10.0
UNIT_SCALE = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4}


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def window(uncertainty: Column, floor: float) -> Column:
    return F.greatest(UNCERTAINTY_FACTOR * F.greatest(uncertainty, F.lit(0.0)), F.lit(floor))


def snap_length(x: Column, uncertainty: Column, preferred: Column | None = None, steps=METRIC_STEPS, floor: float = 0.005) -> Column:
    """`struct(value, step)` of the first candidate in the window: preferred values, then the
    multiples of the coarsest step; NULL when none fits."""
    w = window(uncertainty, floor)
    stepped = F.transform(doubles(steps), lambda s: F.struct((F.rint(x / s) * s).alias("value"), s.alias("step")))
    wished = preferred if preferred is not None else F.array().cast("array<double>")
    ready = F.transform(wished, lambda v: F.struct(v.alias("value"), F.lit(None).cast("double").alias("step")))
    fits = F.filter(F.concat(ready, stepped), lambda c: F.abs(x - c["value"]) <= w)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.get(fits, F.lit(0)))


def snap_angle(x: Column, uncertainty: Column, floor: float = 0.05, candidates=COMMON_ANGLES) -> Column:
    """The nearest common angle (degrees; the first of equals) inside the window, else NULL."""
    ranked = [F.struct(F.abs(x - c).alias("gap"), F.lit(n).alias("n"), F.lit(c).alias("value")) for n, c in enumerate(candidates)]
    best = F.array_min(F.array(*ranked))
    return F.when(best["gap"] <= window(uncertainty, floor), best["value"])


def propose_tolerance(noise: Column) -> Column:
    """The first step at or above 2.5 x noise, the last step beyond, 0.10 without noise."""
    fits = F.filter(doubles(TOLERANCE_STEPS), lambda s: s >= NOISE_FACTOR * noise)
    return F.when(noise.isNull() | F.isnan(noise), DEFAULT_TOLERANCE).otherwise(
        F.coalesce(F.get(fits, F.lit(0)), F.lit(TOLERANCE_STEPS[-1]))
    )


def growth_tolerance(noise: Column) -> Column:
    return GROWTH_FACTOR * noise


def too_tight(tolerance: Column, noise: Column) -> Column:
    return F.coalesce(tolerance < NOISE_FACTOR * noise, F.lit(False))


def clamp_tolerance(value: Column) -> Column:
    return clamp(value, MIN_TOLERANCE, MAX_TOLERANCE)


def unit_scale(unit: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in UNIT_SCALE.items() for v in kv])[unit]


def nice_ceil(x: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten; 0 for values that are not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    fits = F.filter(doubles((1, 2, 5, 10)), lambda s: s * power >= x * (1 - 1e-12))
    return F.when(x > 0, F.coalesce(F.get(fits, F.lit(0)), F.lit(10.0)) * power).otherwise(0.0)


def band_index(value: Column, tolerance: Column, range_: Column) -> Column:
    """Colour band 0-8 from below -range to above range; 9 without a value."""
    third = range_ / 3
    edges = F.array(-range_, -2 * third, -third, -tolerance, tolerance, third, 2 * third, range_)
    passed = F.size(F.filter(edges, lambda e: value >= e))
    return F.when(value.isNull() | F.isnan(value), 9).otherwise(passed)


def automatic_range(p99: Column, tolerance: Column) -> Column:
    """Scale range from the 99th percentile of |d| and the tolerance."""
    base = F.greatest(nice_ceil(p99), nice_ceil(tolerance * 1.5))
    smallest = nice_ceil(3 * tolerance * 1.0001)
    return F.when(p99.isNull(), F.greatest(3 * tolerance, smallest)).otherwise(F.greatest(base, smallest))
