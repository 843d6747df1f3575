"""Site detection, clustering, totals and reordering over streams of coordinate-sorted reads.

A watermark is global, so the event time must grow over all chromosomes: it is
1e9 * (number of the chromosome) + position, in milliseconds.  Append mode holds the last span
of the watermark back, so that a stream ends with a sentinel row on a chromosome of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.quality import chrom_value
from ..operators.pileup import CHUNK, chunk_pieces
from ..sources.text import shared_path

SPAN = 10**9
SENTINEL = "chr99"


def event_time(chrom: Column, pos: Column) -> Column:
    return F.timestamp_millis(chrom_value(chrom).cast("bigint") * SPAN + pos)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes all that is there and returns the stream's output as a table in the shared folder."""
    spark = stream.sparkSession
    path, state = shared_path(spark), shared_path(spark)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", state: str | None = None) -> None:
    """Runs ``each`` on all batches that are there; a ``state`` folder lets a later run go on from here."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", state or shared_path(stream.sparkSession)).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def suspect_sites(reads: DataFrame, ref_chunks: DataFrame, longest_span: int = 1000, size: int = CHUNK) -> DataFrame:
    """(chrom, pos) of suspect sites, handed on once no later read can cover their piece of the reference.

    The state is one row for each open piece of ``size`` bases: the counts of mismatches and of
    indels at its positions.  Reads may come up to ``longest_span`` positions out of order.
    A piece is closed when the watermark has passed its end.
    """

    def counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chrom, chunk, number = key
        counts = np.zeros((2, size), np.int64)
        if state.exists:
            counts += np.frombuffer(state.get[0], np.int64).reshape(2, size)
        if state.hasTimedOut:
            state.remove()
            at = np.flatnonzero((counts[1] > 1) | (counts[0] > 2))
            if len(at):
                yield pd.DataFrame({"chrom": [chrom] * len(at), "pos": int(chunk) * size + at})
            return
        for batch in batches:
            letters, under = batch["letters"].tolist(), batch["under"].tolist()
            long, n = np.array([len(x) for x in letters]), np.array([min(len(x), len(y)) for x, y in zip(letters, under, strict=True)])
            own, ref = (np.frombuffer("".join(x[:k] for x, k in zip(texts, n, strict=True)).encode("utf-32-le"), np.uint32) for texts in (letters, under))
            first = batch["low"].to_numpy(np.int64) - int(chunk) * size
            at = np.arange(len(own)) + np.repeat(first - np.cumsum(n) + n, n)
            counts[0] += np.bincount(at[own != ref], minlength=size)
            counts[1] += np.bincount((first + n - 1)[batch["indel_next"].to_numpy(bool) & (n == long) & (n > 0)], minlength=size)
        state.update((counts.tobytes(),))
        state.setTimeoutTimestamp(int(number) * SPAN + (int(chunk) + 1) * size)

    timed = reads.withColumn("t", event_time(F.col("chrom"), F.col("start"))).withWatermark("t", f"{longest_span} milliseconds")
    pieces = chunk_pieces(timed, ref_chunks, "t", size=size).withColumn("chrom_no", chrom_value(F.col("chrom")))
    return pieces.groupBy("chrom", "chunk", "chrom_no").applyInPandasWithState(counted, "chrom string, pos long", "counts binary", "append", GroupStateTimeout.EventTimeTimeout)


def running_totals(regions: DataFrame) -> DataFrame:
    """(chrom, n, bases) so far, for complete mode."""
    return regions.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def stream_clusters(spots: DataFrame, maxdist: int = 100, pad: int = 8) -> DataFrame:
    """(chrom, start, end) of padded anchored clusters; one is closed by a far position or when the watermark has passed it."""

    def close(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        lo, hi = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            done.append((key[0], lo - pad, hi + pad))
            state.remove()
        else:
            for pos in sorted(p for b in batches for p in b["pos"]):
                if lo is not None and pos - lo < maxdist:
                    hi = max(hi, pos)
                    continue
                if lo is not None:
                    done.append((key[0], lo - pad, hi + pad))
                lo = hi = pos
            lo, hi = int(lo), int(hi)
            state.update((lo, hi))
            passed = int(key[1]) * SPAN + lo + maxdist
            state.setTimeoutTimestamp(max(passed, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({"chrom": [d[0] for d in done], "start": [int(d[1]) for d in done], "end": [int(d[2]) for d in done]})

    rows = spots.withColumn("t", event_time(F.col("chrom"), F.col("pos"))).withWatermark("t", "0 milliseconds").withColumn("chrom_no", chrom_value(F.col("chrom")))
    return rows.groupBy("chrom", "chrom_no").applyInPandasWithState(close, "chrom string, start long, end long", "lo long, hi long", "append", GroupStateTimeout.EventTimeTimeout)


def reordered(stream: DataFrame, path: str, order: list[str], state: str | None = None) -> None:
    """Writes each batch in ``order`` to ``path``/batch=<number>; rows that come before an earlier batch's last one are ``late``.

    The highest row so far is written beside each batch.  A batch that is run again, after
    a failure or a restart from ``state``, reads the mark of the one before and replaces
    its own files, so that nothing is lost or doubled.
    """
    spark = stream.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(*order).schema)

    def each(batch: DataFrame, number: int) -> None:
        top = F.max(F.struct(*order))
        if number:
            mark = spark.read.schema(f"top struct<{kinds.replace('` ', '`: ')}>").parquet(f"{path}/marks/batch={number - 1}")
            rows = batch.join(F.broadcast(mark)).withColumn("late", F.coalesce(F.struct(*order) < F.col("top"), F.lit(False))).drop("top")
            high = batch.agg(top.alias("top")).unionByName(mark).agg(F.max("top").alias("top"))
        else:
            rows, high = batch.withColumn("late", F.lit(False)), batch.agg(top.alias("top"))
        rows.orderBy(*order).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        high.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    run_batches(stream, each, state=state)


def reordered_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``reordered`` has written so far, with ``late`` and ``batch``."""
    return spark.read.schema(f"{schema}, late boolean, batch int").parquet(f"{path}/rows")
