"""Variant types, allele trimming and record overlap, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def var_type(ref: Column, alt: Column) -> Column:
    """snv, ins, del, mnv or unknown, for alleles without shared padding (null: unknown)."""
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r == 1) & (a == 1), "snv").when((r == 0) & (a > 0), "ins").when((r > 0) & (a == 0), "del").when((r > 0) & (a > 0), "mnv").otherwise("unknown")
    )


def padded_type(ref: Column, alt: Column) -> Column:
    """snv, del or ins, for alleles that keep a shared first base; null where none fits."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "snv").when((r > 1) & (a == 1), "del").when((r == 1) & (a > 1), "ins")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    short = F.least(F.length(a), F.length(b))
    places = F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>"))
    differing = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.try_element_at(differing, F.lit(1)) - 1, short)


def without_prefix(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


def without_suffix(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def trimmed(ref: Column, alt: Column) -> Column:
    """struct(offset, ref, alt): shared suffix, then shared prefix cut off, leaving at least one base of each."""
    suffix = F.least(common_suffix(ref, alt), F.greatest(F.least(F.length(ref), F.length(alt)) - 1, F.lit(0)))
    r, a = without_suffix(ref, suffix), without_suffix(alt, suffix)
    prefix = F.least(common_prefix(r, a), F.greatest(F.least(F.length(r), F.length(a)) - 1, F.lit(0)))
    return F.struct(prefix.cast("int").alias("offset"), without_prefix(r, prefix).alias("ref"), without_prefix(a, prefix).alias("alt"))


def prefix_trimmed(ref: Column, alt: Column) -> Column:
    """struct(offset, ref, alt): the whole shared prefix cut off, so that an allele may become empty."""
    n = common_prefix(ref, alt)
    return F.struct(n.cast("int").alias("offset"), without_prefix(ref, n).alias("ref"), without_prefix(alt, n).alias("alt"))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Closed intervals that share a point."""
    return ~((end_a < start_b) | (end_b < start_a))


def record_end(pos: Column, ref: Column, alt: Column) -> Column:
    """End of a record for overlap tests: an insertion makes it shorter."""
    return pos + F.length(ref) - F.length(alt)
