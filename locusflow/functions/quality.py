"""Qualities, display and ordering of positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def geometric_mean(value: Column) -> Column:
    """Aggregate: exp of the mean logarithm."""
    return F.exp(F.avg(F.log(value)))


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean, of sums of whole numbers of 2^-16, 2^-48 and 2^-80, so that no order of rows changes its last digits.

    Where a value is 2^15 or more in size, or not finite, the mean is that of ``avg``.
    """
    small, rest, parts = F.abs(value) < 2.0**15, value, []
    for scale in (2.0**16, 2.0**48, 2.0**80):
        whole = F.rint(rest * scale)
        parts.append(F.sum(F.when(small, whole).cast("bigint")) / scale)
        rest = rest - whole / scale
    return F.when(F.bool_and(small), (parts[0] + parts[1] + parts[2]) / F.count(value)).otherwise(F.avg(value))


def ordered_mean(value: Column, order: Column) -> Column:
    """Aggregate for short groups: the mean of the values that are not null, added up by ``order``."""
    values = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), value.alias("value")))), lambda x: x["value"]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def phred(p: Column, highest: int = 1000) -> Column:
    """Probability as a phred quality: NaN and null give 0, 1 gives ``highest``; halves round to even."""
    value = F.least(F.lit(float(highest)), -10 * F.log10(F.lit(1.0) - p))
    return F.when(p.isNull() | F.isnan(p), 0).when(p >= 1, highest).otherwise(F.bround(value).cast("int"))


def format_bp(n: Column) -> Column:
    """A count of base pairs for reading: plain below 10,000, then Kb, MB and GB with one decimal."""

    def scaled(unit: float, name: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(n / unit, 1)), F.lit(f" {name}"))

    return F.when(n < 10_000, n.cast("string")).when(n < 10**6, scaled(1e3, "Kb")).when(n < 10**9, scaled(1e6, "MB")).otherwise(scaled(1e9, "GB"))


def chrom_value(chrom: Column) -> Column:
    """Sort value of a chromosome: its number, X 50, Y 60, else 100 plus the first letter's code."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")).when(bare == "X", 50).when(bare == "Y", 60).otherwise(100 + F.ascii(bare))
