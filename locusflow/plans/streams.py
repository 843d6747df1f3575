"""Queries that run the streaming operators over files made from the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pileup import pileup, suspect_spots
from ..sources.text import shared_path
from ..streaming import sites
from . import tables as T
from .registry import query


#: Bases of a piece of the reference with a state of its own.
PIECE = 1024
#: Micro-batches that a table is streamed in.
BATCHES = 4
FILES = 4


def as_stream(df, order: list[str], batches: int = BATCHES):
    """``df`` read as a stream of ``batches`` micro-batches that follow each other in ``order``.

    All cores write files of rows that follow each other; they are then dated in their order,
    in which a stream takes them.  Where files can't be dated, they are copied one after the other.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    each = spark.sparkContext.defaultParallelism
    df.repartitionByRange(batches * each, *order).sortWithinPartitions(*order).write.parquet(path)
    names = sorted(spark.read.parquet(path).inputFiles())
    places = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)) for name in names]
    files = places[0].getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(files.getFileStatus(place).getModificationTime() for place in places)
    dates = [last - 1000 * (len(names) - 1 - k) for k in range(len(names))]
    for place, date in zip(places, dates, strict=True):
        files.setTimes(place, date, -1)
    if [files.getFileStatus(place).getModificationTime() for place in places] != dates:
        whole, path = path, shared_path(spark)
        for name in names:
            spark.read.schema(df.schema).parquet(name).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-len(names) // batches)).parquet(path)


def with_sentinel(df, **values):
    """``df`` and one row on a chromosome past the last, made from its first row."""
    last = df.limit(1)
    for name, value in {"chrom": F.lit(sites.SENTINEL), **values}.items():
        last = last.withColumn(name, value)
    return df.unionByName(last)


@query("SELECT chrom, pos FROM pileup WHERE indels > 1 OR mismatches > 2")
def stream_suspect_sites(spark, sf):
    reads = with_sentinel(T.reads(spark, sf).select("chrom", "start", "cigar", "bases"))
    return sites.run_available(sites.suspect_sites(as_stream(reads, ["chrom", "start"]), T.ref_chunks(spark, sf, PIECE), size=PIECE))


@query('SELECT chrom, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS bases FROM regions GROUP BY chrom')
def stream_totals(spark, sf):
    path = shared_path(spark)
    totals = sites.running_totals(as_stream(T.regions(spark, sf).select("chrom", "start", "end"), ["chrom", "start"]))
    sites.run_batches(totals, lambda batch, number: batch.write.mode("overwrite").parquet(path), "complete")
    return spark.read.schema(totals.schema).parquet(path)


@query("""WITH RECURSIVE spots AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM pileup WHERE indels > 1 OR mismatches > 2),
walk AS (SELECT chrom, k, pos, pos AS lo FROM spots WHERE k = 1 UNION ALL SELECT s.chrom, s.k, s.pos, CASE WHEN s.pos - w.lo < 100 THEN w.lo ELSE s.pos END FROM walk w JOIN spots s ON s.chrom = w.chrom AND s.k = w.k + 1)
SELECT chrom, lo - 8 AS start, max(pos) + 8 AS "end" FROM walk GROUP BY chrom, lo""")
def stream_anchored_clusters(spark, sf):
    spots = suspect_spots(pileup(T.reads(spark, sf), T.ref_chunks(spark, sf))).select("chrom", "pos")
    out = sites.run_available(sites.stream_clusters(as_stream(with_sentinel(spots), ["chrom", "pos"])))
    return out.where(F.col("chrom") != sites.SENTINEL)


@query("""WITH v AS (SELECT variant_id, chrom, pos, CAST(variant_id % 4 AS INTEGER) AS arrival FROM variants), t AS (SELECT arrival, max({'chrom': chrom, 'pos': pos, 'variant_id': variant_id}) AS top FROM v GROUP BY arrival)
SELECT variant_id, chrom, pos, arrival AS batch, coalesce({'chrom': chrom, 'pos': pos, 'variant_id': variant_id} < (SELECT max(top) FROM t WHERE t.arrival < v.arrival), false) AS late FROM v""")
def stream_reorder(spark, sf):
    """Variants that arrive in four files, each spread over all positions: every batch in order, late rows marked."""
    path = shared_path(spark)
    rows = T.variants(spark, sf).select("chrom", "pos", "variant_id", (F.col("variant_id") % 4).cast("int").alias("arrival"))
    folder = shared_path(spark)
    for k in range(FILES):
        rows.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sites.reordered(stream, path, ["chrom", "pos", "variant_id"])
    return sites.reordered_rows(spark, path, "chrom string, pos long, variant_id long").select("variant_id", "chrom", "pos", "batch", "late")
