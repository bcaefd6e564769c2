"""Numbers, names and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds(time_ns: Column, zero_ns: Column) -> Column:
    return (time_ns - zero_ns) / F.lit(1e9)


def slug(name: Column) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore; lower case, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def is_slug(name: Column) -> Column:
    return (slug(name) == name) & (name != "")


def magnitude(*axes: Column) -> Column:
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.sqrt(total)


def without_nan(x: Column) -> Column:
    """NaN as null: comparisons with NaN differ between engines, those with null do not."""
    return F.when(~F.isnan(x), x)


def number(x: Column) -> Column:
    """As a double; null where it is none."""
    return without_nan(x.try_cast("double"))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low), high)


def ratio(score: Column, threshold: Column) -> Column:
    """A score over its threshold: an alarm where it is over one."""
    return score / F.greatest(threshold, F.lit(TINY))


def half_even(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.rint(x).cast("long")


def frame_progress(frame: Column, last: Column) -> Column:
    return F.when(last > 0, frame.cast("double") / last).otherwise(0.0)


def stage_of_progress(progress: Column) -> Column:
    """Thirds of the progress as stages 1 to 3 (always three, as the results to match)."""
    return F.least(F.lit(3), F.floor(progress * 3).cast("int") + 1)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return 1 - dot(a, b)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def spread(a: Column) -> Column:
    """Values moved and scaled to lie between 0 and 1."""
    low = F.array_min(a)
    high = F.array_max(a) - low
    return F.transform(a, lambda x: (x - low) / (high + TINY))


def attention_weights(a: Column, b: Column, power: float = 1.5, least: float = 0.15) -> Column:
    """Soft weights from the larger of two attention maps."""
    if power <= 0:
        raise ValueError("power must be over zero")
    if not 0 <= least <= 1:
        raise ValueError("least must be between 0 and 1")
    both = F.zip_with(a, b, lambda x, y: F.greatest(x, y))
    return F.transform(spread(both), lambda x: least + (1 - least) * F.pow(x, F.lit(power)))


def patch_scores(a: Column, b: Column) -> Column:
    """Root mean square difference of each pair of rows of two matrices."""

    def rms(x: Column, y: Column) -> Column:
        squares = F.zip_with(x, y, lambda p, q: (p - q) * (p - q))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v) / F.size(squares))

    return F.zip_with(a, b, rms)


def weighted_mean(values: Column, weights: Column) -> Column:
    total = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x)
    return total / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
