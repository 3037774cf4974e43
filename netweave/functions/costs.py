"""Link cost as Column expressions: whole-stage codegen, no Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decades that a cost may span below the largest double, and the least capacity.
EXPONENT_HEADROOM, MIN_CAPACITY = 250, 1e-9
#: Added before a mean is rounded: means of few six-digit flows often lie right between two roundings.
NUDGE = 1e-9


def clipped(x: str | Column) -> Column:
    """A flow as costing takes it: null and NaN are 0, negative is 0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(F.coalesce(F.nanvl(x, F.lit(None)), F.lit(0.0)), F.lit(0.0))


def ratio_cap(power: str | Column) -> Column:
    """The largest volume ratio whose power still is a finite cost."""
    power = F.col(power) if isinstance(power, str) else power
    return F.pow(F.lit(10.0), EXPONENT_HEADROOM / F.greatest(power, F.lit(1e-12)))


def _ratio(x: Column, capacity: Column) -> Column:
    return F.greatest(x / F.greatest(capacity, F.lit(MIN_CAPACITY)), F.lit(0.0))


def bpr_cost(x: str = "x", fft: str = "fft", capacity: str = "capacity", b: str = "b", power: str = "power") -> Column:
    """fft * (1 + b * ratio ^ power), with the ratio held within its cap."""
    r = F.least(_ratio(clipped(x), F.col(capacity)), ratio_cap(power))
    return F.col(fft) * (1 + F.col(b) * F.pow(r, F.col(power)))


def bpr_prime(x: str = "x", fft: str = "fft", capacity: str = "capacity", b: str = "b", power: str = "power") -> Column:
    """The derivative of the cost by x: 0 at no flow and beyond the cap."""
    r = _ratio(clipped(x), F.col(capacity))
    slope = F.col(fft) * F.col(b) * F.col(power) * F.pow(r, F.col(power) - 1) / F.greatest(F.col(capacity), F.lit(MIN_CAPACITY))
    return F.when((r > 0) & (r < ratio_cap(power)), F.coalesce(F.nanvl(slope, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def exact_sum(c: Column, digits: int = 6) -> Column:
    """A sum that doesn't depend on the order of rows: digits are fixed before adding."""
    return F.sum(F.round(c, digits).cast(f"decimal(28,{digits})")).cast("double")


def decades(c: Column, digits: int = 6) -> Column:
    """The logarithm to base ten, null for zero: how values that span hundreds of decades are compared."""
    return F.round(F.when(c > 0, F.log10(c)), digits)


def scientific(c: Column, digits: int = 1) -> Column:
    """A number as mantissa and power of ten, as reports print it: 9.8e-12; zero as 0."""
    return F.when(c == 0, "0").when(c.isNotNull(), F.format_string(f"%.{digits}e", c))


def spelled(n: Column) -> Column:
    """Small whole numbers in words, as text reports want them; others in digits."""
    # Number words from zero to twelve.
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
    return F.when(n.between(0, 12), F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))).otherwise(n.cast("string"))
