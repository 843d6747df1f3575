"""Joins, tiling, clustering and merging of intervals on chromosomes.

Spark plans an interval predicate as a filter over all pairs of a chromosome.  Here both
sides are first placed in bins of fixed width, so pairs meet by an equi-join on
(chromosome, bin); a pair that shares several bins counts in the first one only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024


def bare_name(chrom: Column) -> Column:
    """A chromosome's name without a leading ``chr``: files name the same one either way."""
    return F.regexp_replace(chrom, "^chr", "")


def binned(df: DataFrame, width: int) -> DataFrame:
    last = F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width)
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), last)))


def placed(left: DataFrame, right: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Both sides in their bins, with bare chromosome names (_name, bin; r_name, r_bin)."""
    a = binned(left, width).withColumn("_name", bare_name(F.col("chrom")))
    b = binned(right, width).withColumnsRenamed({c: f"r_{c}" for c in ("chrom", "start", "end", "bin")}).withColumn("r_name", bare_name(F.col("r_chrom")))
    return a, b


def split_bins(a: DataFrame, b: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``placed`` sides with ``part``: in a bin with over ``most`` rows of a side, the larger side is dealt to parts and the other one goes to each."""
    loads = a.groupBy("_name", "bin").agg(F.count("*").alias("l")).join(b.groupBy(F.col("r_name").alias("_name"), F.col("r_bin").alias("bin")).agg(F.count("*").alias("r")), ["_name", "bin"])
    crowded = loads.where(F.greatest("l", "r") > most).select(F.col("_name").alias("_n"), F.col("bin").alias("_b"), F.ceil(F.greatest("l", "r") / most).cast("int").alias("_parts"), (F.col("l") >= F.col("r")).alias("_left"))

    def dealt(side: DataFrame, name: str, number: str, own) -> DataFrame:
        joined = side.join(crowded, (F.col(name) == F.col("_n")) & (F.col(number) == F.col("_b")), "left")
        one = F.array(F.pmod(F.xxhash64(*side.columns), F.col("_parts")).cast("int"))
        parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(own, one).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        return joined.select(*side.columns, F.explode(parts).alias("part"))

    return dealt(a, "_name", "bin", F.col("_left")), dealt(b, "r_name", "r_bin", ~F.col("_left"))


def interval_join(left: DataFrame, right: DataFrame, width: int = BIN, condition: Column | None = None, most: int | None = None) -> DataFrame:
    """Pairs of overlapping half-open intervals (chrom, start, end).

    ``right``'s three columns come back as r_chrom, r_start and r_end; its other names must
    differ from ``left``'s.  ``condition`` narrows the pairs.  Points are [p, p + 1).
    Chromosomes meet with or without a leading ``chr``.  With ``most``, the rows of each bin
    are counted first, and bins with more of them on a side are split, as where reads pile up
    on a few places; the sides are then read twice.
    """
    other = right.withColumnsRenamed({c: f"r_{c}" for c in ("chrom", "start", "end")})
    a, b = placed(left, right, width)
    if most is not None:
        a, b = split_bins(a, b, most)
        b = b.withColumnRenamed("part", "r_part")
    meet = (a["_name"] == b["r_name"]) & (a["bin"] == b["r_bin"]) & (a["start"] < b["r_end"]) & (b["r_start"] < a["end"])
    if most is not None:
        meet &= F.col("part") == F.col("r_part")
    pairs = a.join(b, meet).where(F.col("bin") == F.floor(F.greatest("start", "r_start") / width))
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.select(*left.columns, *other.columns)


def with_former(df: DataFrame, group: str, position: str, order: list[str], columns: dict[str, str], width: int = 1 << 16) -> DataFrame:
    """Rows with the values of the row before in ``order`` (which begins with ``position``) within ``group``; null for the first.

    ``columns`` names them: {column: name}.  Rows are put in order within bins of
    ``width`` positions; a bin's first row gets what the last row of the bin before hands
    on, so that no task sees a whole group.
    """
    rows = df.withColumn("_bin", F.floor(F.col(position) / width))
    inside = Window.partitionBy(group, "_bin").orderBy(*order)
    values = F.struct(*(F.col(c).alias(name) for c, name in columns.items()))
    rows = rows.withColumn("_own", F.lag(values).over(inside))
    ends = df.withColumn("_bin", F.floor(F.col(position) / width)).groupBy(group, "_bin").agg(F.max_by(values, F.struct(*order)).alias("_last"))
    over_bins = Window.partitionBy(group).orderBy("_bin")  # one row for each bin
    before = ends.select(F.col(group).alias("_g"), F.col("_bin").alias("_b"), F.lag("_last").over(over_bins).alias("_last"))
    joined = rows.join(before, rows[group].eqNullSafe(before["_g"]) & (rows["_bin"] == before["_b"]))
    return joined.select(*df.columns, *(F.coalesce(F.col("_own"), F.col("_last"))[name].alias(name) for name in columns.values()))


def with_count(left: DataFrame, key: list[str], pairs: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    """``left`` with the number (or the sum of ``value``) of its ``pairs``, 0 where it has none."""
    counted = pairs.groupBy(*key).agg((F.count("*") if value is None else F.sum(value)).alias(name))
    return left.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def split_regions(regions: DataFrame, size: int) -> DataFrame:
    """Regions cut into parts of at most ``size``, with window_idx within each region."""
    starts = F.posexplode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("long")))
    parts = regions.where("end > start").select("*", starts.alias("window_idx", "part_start"))
    return parts.withColumn("end", F.least("end", F.col("part_start") + size)).withColumn("start", F.col("part_start")).drop("part_start")


def tile_regions(regions: DataFrame, size: int = 150, step: int = 75) -> DataFrame:
    """Tiles of ``size`` every ``step``; a shorter region gets one tile around its middle."""
    middle = F.floor((F.col("start") + F.col("end")) / 2) - size // 2
    short = (F.col("end") - F.col("start")) < size
    last = F.greatest(F.col("end") - step - 1, F.col("start"))
    starts = F.when(short, F.array(middle)).otherwise(F.sequence(F.col("start"), last, F.lit(step).cast("long")))
    tiles = regions.withColumn("tile_start", F.explode(starts))
    return tiles.withColumn("start", F.col("tile_start")).withColumn("end", F.col("tile_start") + size).drop("tile_start")


def sliding_windows(regions: DataFrame, size: int = 150, step: int = 25) -> DataFrame:
    """Windows from 0.7 * ``size`` before a region, every ``step``, that begin at least 30 before its end."""
    first = F.col("start") - int(0.7 * size)
    starts = F.when(first <= F.col("end") - 30, F.sequence(first, F.col("end") - 30, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return regions.select("*", F.posexplode(starts).alias("window_no", "window_start")).withColumn("window_end", F.col("window_start") + size)


def anchored_folds(positions: DataFrame, group: list[str], maxdist: int, position: str = "pos", strict: bool = True) -> DataFrame:
    """``group``, lo, hi of clusters whose positions lie within ``maxdist`` of their first one.

    A gap of ``maxdist`` between neighbours always opens a cluster, so positions are first
    cut there; each island is then folded from left to right.
    """
    order = Window.partitionBy(*group).orderBy(position)
    gap = F.col(position) - F.lag(position).over(order)
    far = (gap >= maxdist) if strict else (gap > maxdist)
    islands = positions.select(*group, position).distinct().withColumn("island", F.sum(F.when(far, 1).otherwise(0)).over(order))
    lists = islands.groupBy(*group, "island").agg(F.array_sort(F.collect_list(position)).alias("places"))
    kind = "array<struct<lo: bigint, hi: bigint>>"

    def add(done, p):
        last = F.try_element_at(done, F.lit(-1))
        near = (p - last["lo"] < maxdist) if strict else (p - last["lo"] <= maxdist)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), p.alias("hi"))))
        return F.when((F.size(done) > 0) & near, grown).otherwise(F.concat(done, F.array(F.struct(p.alias("lo"), p.alias("hi")))))

    clusters = F.aggregate(F.transform("places", lambda p: p.cast("bigint")), F.array().cast(kind), add)
    return lists.select(*group, F.inline(clusters))


def anchored_clusters(positions: DataFrame, group: list[str], maxdist: int = 100, pad: int = 8) -> DataFrame:
    """Padded ranges (start, end) of anchored clusters."""
    return anchored_folds(positions, group, maxdist).select(*group, (F.col("lo") - pad).alias("start"), (F.col("hi") + pad).alias("end"))


def merge_regions(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Ranges of each ``group`` that touch or overlap, merged; in order of start, the first start stays."""
    order = Window.partitionBy(*group).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
