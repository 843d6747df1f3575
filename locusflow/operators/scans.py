"""Merging and clustering over whole chromosomes, by scans over bins.

A group may be a whole chromosome.  Rows are dealt to bins of fixed width; what a bin needs
from those before it (the farthest end, the number of islands, the anchor of the last
cluster) is carried from bin to bin over one short row for each, so that no task holds more
rows than a bin has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 14


def merge_ranges(ranges: DataFrame, group: list[str], width: int = WIDTH) -> DataFrame:
    """``group``, start, end: ranges of each ``group`` that touch or overlap, merged."""
    rows = ranges.select(*group, "start", "end", F.floor(F.col("start") / width).alias("_bin"))
    inside = Window.partitionBy(*group, "_bin").orderBy("start", "end")
    earlier = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bin

    def carried(df: DataFrame, value, name: str) -> DataFrame:
        per_bin = df.groupBy(*group, "_bin").agg(value.alias("_v"))
        over = F.max("_v") if name == "_far" else F.sum("_v")
        return per_bin.withColumn(name, over.over(earlier)).drop("_v").withColumnsRenamed({c: f"_{k}" for k, c in enumerate([*group, "_bin"])})

    def joined(df: DataFrame, other: DataFrame) -> DataFrame:
        keys = [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate([*group, "_bin"])]
        return df.join(other, keys).drop(*(f"_{k}" for k in range(len(keys))))

    rows = joined(rows.withColumn("_near", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))), carried(rows, F.max("end"), "_far"))
    opens = F.when(F.col("start") <= F.greatest("_near", "_far"), 0).otherwise(1)
    rows = rows.withColumn("_opens", opens)
    numbered = rows.withColumn("_in", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = joined(numbered, carried(rows, F.sum("_opens"), "_count"))
    island = (F.col("_in") + F.coalesce("_count", F.lit(0))).alias("_island")
    return numbered.groupBy(*group, island).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def first_at(places: np.ndarray, least: int) -> int:
    """The index of the first place that is ``least`` or more."""
    return int(np.searchsorted(places, least))


def last_anchors(places: np.ndarray, distance: int, asked: int) -> list[int]:
    """The last anchor when clusters start at each of the first ``asked`` places."""
    following = np.searchsorted(places, places + distance).tolist()
    last = list(range(len(places)))
    for i in range(len(places) - 1, -1, -1):
        if following[i] < len(places):
            last[i] = last[following[i]]
    return [int(places[last[i]]) for i in range(asked)]


def anchored_scan(positions: DataFrame, group: list[str], maxdist: int, position: str = "pos", strict: bool = True, width: int = WIDTH) -> DataFrame:
    """``group``, lo, hi of clusters whose positions lie within ``maxdist`` of their first one, over groups of any length.

    What a bin makes of the anchor before it depends on its own first anchor alone, one of
    the places in its first ``maxdist`` positions or the next one.  So each bin says where its
    last anchor is for each of these; the bins of a group are then passed once in order,
    which gives every bin its entry, and bins cut their places into clusters.
    """
    distance = maxdist if strict else maxdist + 1
    if distance < 1:
        raise ValueError("maxdist leaves every position alone")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.select(*group).schema)
    rows = positions.where(F.col(position).isNotNull()).select(*group, F.col(position).cast("long").alias("_pos")).distinct().withColumn("_bin", F.floor(F.col("_pos") / width))
    lists = rows.groupBy(*group, "_bin").agg(F.array_sort(F.collect_list("_pos")).alias("_places"))  # at most ``width`` of a bin

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, lasts = [], []
            for number, listed in zip(batch.column("_bin").to_pylist(), batch.column("_places"), strict=True):
                places = listed.values.to_numpy()
                asked = min(first_at(places, number * width + distance) + 1, len(places))
                firsts.append(places[:asked].tolist())
                lasts.append(last_anchors(places, distance, asked))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in group), batch.column("_bin"), pa.array(firsts, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.int64()))], names=[*group, "_bin", "_first", "_last"])

    offers = lists.mapInArrow(offered, f"{kinds}, _bin long, _first array<long>, _last array<long>")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchor = None, None
        for batch in batches:
            entries = []
            names = zip(*(batch.column(c).to_pylist() for c in group), strict=True) if group else [()] * batch.num_rows
            for name, firsts, lasts in zip(names, batch.column("_first"), batch.column("_last"), strict=True):
                if name != key:
                    key, anchor = name, None
                entries.append(anchor)
                places = firsts.values.to_numpy()
                at = 0 if anchor is None else first_at(places, anchor + distance)
                if at < len(places):
                    anchor = lasts.values[at].as_py()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in group), batch.column("_bin"), pa.array(entries, pa.int64())], names=[*group, "_bin", "_entry"])

    in_order = offers.repartition(*group).sortWithinPartitions(*group, "_bin")  # one row for each bin
    entries = in_order.mapInArrow(passed, f"{kinds}, _bin long, _entry long").withColumnsRenamed({c: f"_{k}" for k, c in enumerate([*group, "_bin"])})
    keys = [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate([*group, "_bin"])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lo, hi = [], [], []
            for k, (listed, entry) in enumerate(zip(batch.column("_places"), batch.column("_entry").to_pylist(), strict=True)):
                places, at = listed.values.to_numpy(), 0
                anchor = int(places[0]) if entry is None else entry
                while at < len(places):
                    end = first_at(places, anchor + distance)
                    if end > at:
                        row.append(k)
                        lo.append(anchor)
                        hi.append(int(places[end - 1]))
                    at = end
                    anchor = int(places[at]) if at < len(places) else anchor
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in group), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[*group, "lo", "hi"])

    parts = lists.join(entries, keys).select(*group, "_places", "_entry").mapInArrow(cut, f"{kinds}, lo long, hi long")
    return parts.groupBy(*group, "lo").agg(F.max("hi").alias("hi"))
