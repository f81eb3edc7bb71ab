"""Sample and score arrays as higher-order column functions; they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))


def rms(x: Column, scale: float = 1.0) -> Column:
    """Root mean square over `scale`, at most 1; 0 for no samples."""
    squares = F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(x) > 0, F.least(F.lit(1.0).cast("double"), F.sqrt(squares / F.size(x)) / F.lit(float(scale)))).otherwise(F.lit(0.0).cast("double"))


def pcm_to_float(x: Column) -> Column:
    """Signed 16-bit samples to [-1, 1)."""
    return F.transform(x, lambda v: v.cast("double") / F.lit(32768.0).cast("double"))


def volume(x: Column, factor: float) -> Column:
    """Samples times a factor, cut to whole numbers."""
    return F.transform(x, lambda v: (v * F.lit(float(factor))).cast("int"))


def pad_or_trim(x: Column, length: int) -> Column:
    """Exactly `length` samples, zeros at the end."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - F.size(x), F.lit(0)))
    return F.slice(F.concat(x.cast("array<float>"), zeros), 1, length)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: what a lambda takes from outside is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def zscores(x: Column) -> Column:
    """Values less their mean over their population deviation (N10); nulls stay, and without deviation all are NaN."""
    kept = F.filter(x, lambda v: v.isNotNull())
    count = F.nullif(F.size(kept), F.lit(0))

    def about(mean: Column) -> Column:
        spread = F.sqrt(F.aggregate(kept, F.lit(0.0).cast("double"), lambda a, v: a + (v - mean) * (v - mean)) / count)
        return bound(spread, lambda s: F.transform(x, lambda v: F.when(s == 0, F.lit(float("nan"))).otherwise((v - mean) / s)))

    return bound(total(kept) / count, about)


def softmax(x: Column) -> Column:
    def over(top: Column) -> Column:
        return bound(F.aggregate(x, F.lit(0.0).cast("double"), lambda a, w: a + F.exp(w.cast("double") - top)), lambda s: F.transform(x, lambda v: F.exp(v.cast("double") - top) / s))

    return bound(F.array_max(x), over)


def logsumexp(x: Column) -> Column:
    return bound(F.array_max(x).cast("double"), lambda top: top + F.log(F.aggregate(x, F.lit(0.0).cast("double"), lambda a, w: a + F.exp(w.cast("double") - top))))


def median_filter(x: Column, width: int) -> Column:
    """Median of each odd window, the edges reflected; unchanged if shorter than half a window."""
    half = width // 2
    padded = F.concat(F.reverse(F.slice(x, 2, half)), x, F.reverse(F.slice(x, -half - 1, half)))
    out = F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.element_at(F.array_sort(F.slice(padded, i, width)), half + 1))
    return F.when(F.size(x) <= half, x).otherwise(out)


def blocks(x: Column, size: int) -> Column:
    """Blocks of `size` samples, the last one padded with zeros (A5)."""
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / size).cast("int") - 1, F.lit(0)))
    return F.transform(at, lambda k: pad_or_trim(F.slice(x, k * size + 1, size), size))


def voiced(level: Column, threshold: float = 0.02) -> Column:
    return level > threshold
