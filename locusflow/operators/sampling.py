"""Deterministic sampling, batching and quotas.

Random choices take an ``order`` column (a seeded hash of the row's key in real use), so
that a result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def first_n(df: DataFrame, group: list[str], count: int, order: list) -> DataFrame:
    """The first ``count`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")


#: Parts of a group that are ranked before the group.
PARTS = 32


def in_parts(df: DataFrame, group: list[str], order: list, limit: Column) -> DataFrame:
    """The first ``limit`` rows of each group with their ``_place``: first those of each part of it, then of all."""
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    own = df.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return own.where(F.col("_place") <= limit).withColumn("_place", place).where(F.col("_place") <= limit).drop("_part")


def resample_classes(df: DataFrame, quotas: DataFrame, label: str, order: list) -> DataFrame:
    """As many rows of each class as its quota: a sample of a larger class, repeats of a smaller one.

    ``quotas`` has (label, quota); a class without one, or with 0, is dropped.  ``copy``
    numbers the repeats of a row.  Of a large class each of ``PARTS`` parts first keeps its
    first ``quota`` rows, so that no task ranks a whole class.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    known = quotas.where("quota > 0").join(sizes, label)  # one row for each class
    joined = in_parts(df.join(F.broadcast(known), label), [label], order, F.col("quota"))
    # Row r of n is taken for slots r, r + n, r + 2n, ... of the quota.
    copies = F.floor((F.col("quota") - F.col("_place")) / F.col("_n"))
    taken = joined.where(F.col("_place") <= F.col("quota"))
    return taken.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias("copy")).drop("_place", "_n", "quota")


def rebatched(df: DataFrame, size: int, order: list[str], group: str | None = None) -> DataFrame:
    """Rows with ``batch``: their global number in ``order``, by ``size``; the last batch may be short.

    With ``group`` (of few values), numbers begin anew in each of them.  Numbers are places
    in the partitions of a range-partitioned sort, which is written down once, moved on by
    the counts of the partitions before, so that no task sees all rows.
    """
    from ..sources.text import shared_path

    path, order = shared_path(df.sparkSession), [*([group] if group else []), *order]
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    spread.write.parquet(path)  # a range partitioning that is made twice may differ
    rows = df.sparkSession.read.schema(spread.schema).parquet(path).withColumn("_p", F.shiftright("_at", 33))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    placed = rows.join(F.broadcast(starts), "_p").withColumn("_place", F.col("_s") + F.col("_at") - F.shiftleft("_p", 33))
    if group:
        firsts = placed.groupBy(F.col(group).alias("_g")).agg(F.min("_place").alias("_first"))
        placed = placed.join(F.broadcast(firsts), F.col(group).eqNullSafe(F.col("_g"))).withColumn("_place", F.col("_place") - F.col("_first"))
    return placed.select(*df.columns, F.floor(F.col("_place") / size).alias("batch"))


def cumulative(df: DataFrame, order: list, columns: dict[str, str]) -> DataFrame:
    """Rows with running sums in ``order``, {column: name}; rows that tie in ``order`` come in any order.

    Sums are made within the partitions of a sort, which are written down once, and moved on
    by the sums of the partitions before.
    """
    from ..sources.text import shared_path

    path = shared_path(df.sparkSession)
    spread = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    spread.write.parquet(path)  # a range partitioning that is made twice may differ
    rows = df.sparkSession.read.schema(spread.schema).parquet(path)
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({name: F.sum(c).over(inside) for c, name in columns.items()})
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = rows.groupBy("_p").agg(*(F.sum(c).alias(f"_{name}") for c, name in columns.items()))
    moved = totals.select("_p", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in columns.values()))
    joined = sums.join(F.broadcast(moved), "_p")
    return joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in columns.values()}).drop("_p", *(f"_{name}" for name in columns.values()))


def middle_slice(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """Of each group's rows in order, those within ``most`` / 2 of the middle."""
    window = Window.partitionBy(*group)
    rows = df.withColumns({"_i": F.row_number().over(window.orderBy(*order)) - 1, "_n": F.count("*").over(window)})
    middle = F.floor(F.col("_n") / 2)
    return rows.where((F.col("_i") >= middle - most // 2) & (F.col("_i") < middle + most // 2)).drop("_i", "_n")


def capped(df: DataFrame, group: list[str], caps: dict[str, int], kind: str, order: list) -> DataFrame:
    """At most ``caps[kind]`` rows of each kind within each group; other kinds are dropped."""
    limit = F.create_map(*(F.lit(x) for pair in caps.items() for x in pair))[F.col(kind)]
    return in_parts(df.where(F.col(kind).isin(*caps)), [*group, kind], order, limit).drop("_place")


def holdout(df: DataFrame, fraction: float, order: list) -> DataFrame:
    """Rows with ``held_out``: the first ceil(n * fraction) in order, found by a threshold on a global sort's numbers."""
    rows = rebatched(df, 1, order)
    count = df.agg(F.count("*").alias("_n"))
    return rows.join(F.broadcast(count)).withColumn("held_out", F.col("batch") < F.ceil(F.col("_n") * fraction)).drop("batch", "_n")
