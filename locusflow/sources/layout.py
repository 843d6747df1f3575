"""Tables of intervals laid out by chromosome and bin, so that a fetch of few regions reads few files.

Rows lie in folders of their chromosome and the bin of their start.  An index has one row
for each folder, with the span of its rows; a fetch meets the regions with the index first,
and then reads the folders that some region can touch, and no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import bare_name, interval_join

WIDTH = 1 << 16
#: Folders that a fetch names one by one; with more it reads all of them.
MOST_FOLDERS = 4096


def write_layout(rows: DataFrame, path: str, width: int = WIDTH, parts: int = 1) -> None:
    """Writes rows (chrom, start, end, ...) and their index to ``path``.

    ``parts`` deals the rows of a folder to so many files, for tables with much depth.
    Chromosomes lose a leading ``chr`` in the names of folders only.
    """
    placed = rows.withColumns({"_name": bare_name(F.col("chrom")), "_bin": F.floor(F.col("start") / width)})
    salt = F.pmod(F.xxhash64("start", "end"), F.lit(parts))
    placed.repartition("_name", "_bin", salt).sortWithinPartitions("_name", "_bin", "start").write.partitionBy("_name", "_bin").parquet(f"{path}/rows")
    spark = rows.sparkSession
    written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    index = written.groupBy("_name", "_bin").agg(F.min("start").alias("start"), F.max(F.greatest("end", F.col("start") + 1)).alias("end"), F.count("*").alias("rows"))
    index.select(F.col("_name").alias("chrom"), F.col("_bin").alias("folder"), "start", "end", "rows").write.parquet(f"{path}/index")


def asked_folders(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """(chrom, folder) of the folders whose rows some region can touch."""
    index = spark.read.schema("chrom string, folder long, start long, end long, rows long").parquet(f"{path}/index")
    asked = regions.select("chrom", "start", "end").distinct()
    found = interval_join(asked, index, width=WIDTH)
    return found.select(F.col("r_chrom").alias("chrom"), "folder").distinct()


def read_layout(spark: SparkSession, path: str, schema: str, regions: DataFrame | None = None, most: int = MOST_FOLDERS) -> DataFrame:
    """Rows of the folders that ``regions`` (chrom, start, end) can touch, or of all.

    Which folders these are is known from the index alone; their rows still have to meet
    the regions.  With over ``most`` folders all rows are read.
    """
    reader = spark.read.schema(f"{schema}, _name string, _bin long").option("basePath", f"{path}/rows")
    names = None if regions is None else asked_folders(spark, path, regions).limit(most + 1).collect()
    if names is None or len(names) > most:
        rows = reader.parquet(f"{path}/rows")
    elif names:
        rows = reader.parquet(*sorted(f"{path}/rows/_name={r['chrom']}/_bin={r['folder']}" for r in names))
    else:
        rows = spark.createDataFrame([], f"{schema}, _name string, _bin long")
    return rows.drop("_name", "_bin")


def fetch(spark: SparkSession, path: str, schema: str, regions: DataFrame, most: int = MOST_FOLDERS) -> DataFrame:
    """Pairs of ``regions`` and the rows that overlap them, as ``interval_join`` gives them, from the asked folders alone."""
    return interval_join(regions, read_layout(spark, path, schema, regions, most))
