"""Region and variant-record text files, read and written by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import chrom_value

BED = "chrom string, start long, end long, label string"
ALIGNMENT = ("name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "insert_size", "bases", "quals")
RECORD = "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string"


#: Folders of local sessions whose settings name none, by application.
_TEMPORARY: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder inside of ``spark.checkpoint.dir``, which the driver and all executors share.

    It is removed when the driver ends.  Where the setting is missing, a local session gets
    a temporary folder; a cluster must name one.
    """
    folder, application = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if application not in _TEMPORARY:
            _TEMPORARY[application] = tempfile.mkdtemp(prefix="locusflow-")
        folder = _TEMPORARY[application]
    own = f"{folder}/locusflow-{application}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return own


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def read_bed(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(chrom, start, end, label) of a tab-separated file without blank and ``#`` lines.

    A region that does not end after its start is dropped, or is an error if ``strict``.
    """
    rows = spark.read.csv(path, sep="\t", comment="#", schema=BED)
    if strict:
        checked = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.raise_error(F.concat(F.lit("bad region at "), F.col("chrom"))))
        return rows.withColumn("end", checked)
    return rows.where("end > start")


def write_bed(regions: DataFrame, path: str) -> None:
    columns = [c for c in ("chrom", "start", "end", "label") if c in regions.columns]
    regions.select(*columns).write.csv(path, sep="\t")


def label_classes(labels: DataFrame, label: str = "label", order: str = "file_order") -> DataFrame:
    """(label, class_index): classes numbered from 0 in order of first appearance."""
    from pyspark.sql import Window

    first = labels.groupBy(label).agg(F.min(order).alias("first"))
    return first.select(label, (F.row_number().over(Window.orderBy("first")) - 1).alias("class_index"))  # one row for each class


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Variant records of text files: alts as an array and info as a map; flags map to null."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=RECORD)
    return rows.withColumn("alts", F.split("alt", ",")).withColumn("info", F.str_to_map("info", F.lit(";"), F.lit("="))).drop("alt")


def record_lines(records: DataFrame) -> DataFrame:
    """One tab-separated line for each record (chrom, pos, ref, alt, qual, filter, depth, gt, phase_set), with its sort key."""
    quality = F.format_string("%.4f", "qual")
    info = F.concat(F.lit("CALL_COUNT="), F.col("call_count").cast("string"))
    sample = F.concat_ws(":", "gt", F.col("depth").cast("string"), F.coalesce(F.col("phase_set").cast("string"), F.lit(".")))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", quality, "filter", info, F.lit("GT:DP:PS"), sample)
    return records.select(chrom_value(F.col("chrom")).alias("chrom_order"), "chrom", "pos", "ref", "alt", line.alias("line"))


# The header lines of a variant record file with the fields written here.
HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
##FILTER=<ID=LowCov,Description="Low coverage">
##FILTER=<ID=SingleCallHet,Description="Heterozygous variant called in one window only">
##FILTER=<ID=SingleCallHom,Description="Homozygous variant called in one window only">
##INFO=<ID=CALL_COUNT,Number=1,Type=Integer,Description="Number of window calls">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">
##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">
""".splitlines()
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header_lines(spark: SparkSession, contigs: DataFrame | None = None, sample: str = "sample") -> DataFrame:
    """(n, line) of the header; ``contigs`` (chrom, length) adds a line for each chromosome."""
    rows = spark.createDataFrame([(k, line) for k, line in enumerate(HEADER)], "n long, line string")
    if contigs is not None:
        named = contigs.select((1000 + chrom_value(F.col("chrom")).cast("long")).alias("n"), F.concat(F.lit("##contig=<ID="), "chrom", F.lit(",length="), F.col("length").cast("string"), F.lit(">")).alias("line"))
        rows = rows.unionByName(named)
    return rows.unionByName(spark.createDataFrame([(10**9, "#" + "\t".join((*COLUMNS, sample)))], "n long, line string"))


def write_records(records: DataFrame, path: str, contigs: DataFrame | None = None, sample: str = "sample") -> None:
    """A header, then lines in order of chromosome and position; the files in order of name are the whole."""
    head = header_lines(records.sparkSession, contigs, sample).select(F.lit(-1).alias("chrom_order"), F.col("n").alias("pos"), F.lit("").alias("ref"), F.lit("").alias("alt"), "line")
    lines = head.unionByName(record_lines(records).select("chrom_order", "pos", "ref", "alt", "line"))
    lines.orderBy("chrom_order", "pos", "ref", "alt").select("line").write.text(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Reads of alignment text files (SAM): read_id, chrom, start (0-based), cigar, mapq, is_reverse, bases, quals and size.

    Header lines (``@``), optional fields and unmapped reads are left out; ``*`` is a null
    CIGAR or an empty list of qualities.
    """
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '@')").select(*(F.get(fields, F.lit(k)).alias(name) for k, name in enumerate(ALIGNMENT)))
    flag = F.col("flag").cast("int")
    scores = F.when(F.col("quals") == "*", F.array().cast("array<int>")).otherwise(F.transform(F.split("quals", ""), lambda x: F.ascii(x) - 33))
    return rows.where(flag.bitwiseAND(F.lit(4)) == 0).select(
        F.col("name").alias("read_id"), "chrom", (F.col("pos").cast("long") - 1).alias("start"), F.when(F.col("cigar") != "*", F.col("cigar")).alias("cigar"), F.col("mapq").cast("int").alias("mapq"),
        (flag.bitwiseAND(F.lit(16)) != 0).alias("is_reverse"), "bases", scores.alias("quals"), F.length("bases").alias("size"),
    )


def write_alignments(reads: DataFrame, path: str) -> None:
    """Reads as alignment text, in order of chromosome and start."""
    scores = F.when(F.size("quals") > 0, F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")).otherwise("*")
    flag = F.when(F.col("is_reverse"), "16").otherwise("0")
    line = F.concat_ws("\t", F.col("read_id").cast("string"), flag, "chrom", (F.col("start") + 1).cast("string"), F.col("mapq").cast("string"), F.coalesce("cigar", F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"), "bases", scores)
    reads.select(chrom_value(F.col("chrom")).alias("n"), "start", line.alias("line")).orderBy("n", "start").select("line").write.text(path)


def concatenated(spark: SparkSession, paths: list[str], schema: str, path: str, files: int = 1) -> None:
    """Writes the rows of several files with a header line each as one (or a few), with one header each."""
    spark.read.option("header", True).schema(schema).csv(paths).coalesce(files).write.option("header", True).csv(path)


def pair_by_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """(suffix, src, tgt) of ``.../src_X`` and ``.../tgt_X`` for the same X."""
    named = files.select(F.col(path).alias("file"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name"))
    kinds = named.select("file", F.regexp_extract("name", r"^(src|tgt)_", 1).alias("kind"), F.regexp_extract("name", r"([^_]+)$", 1).alias("suffix"))
    src, tgt = (kinds.where(F.col("kind") == k).select("suffix", F.col("file").alias(k)) for k in ("src", "tgt"))
    return src.join(tgt, "suffix")
