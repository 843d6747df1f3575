"""A quality classifier for calls as a Spark ML pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a feature file of calls, in the file's order.
FEATURES = (
    "qual", "ref_len", "alt_len", "min_qual", "max_qual", "var_count", "cis_count", "step_count", "call_count",
    "min_win_offset", "max_win_offset", "dp", "het", "vaf", "vafreads", "altreads",
)


def record_features(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """``FEATURES`` of merged records, which keep record_id and what else they have.

    ``records`` has qual, ref, alt, quals, window_var_count, window_cis_vars, step_count,
    call_count, window_offsets, depth and gt; ``evidence`` (record_id, reads, pos_alt,
    neg_alt, vaf) comes from the reads.  A homozygous record counts each of its window
    calls once as a step and twice as a call.
    """
    support = evidence.select("record_id", "vaf", F.col("reads").alias("vafreads"), (F.col("pos_alt") + F.col("neg_alt")).alias("altreads"))
    own = {
        "ref_len": F.length("ref"), "alt_len": F.length("alt"), "min_qual": F.array_min("quals"), "max_qual": F.array_max("quals"), "var_count": F.col("window_var_count"), "cis_count": F.col("window_cis_vars"),
        "min_win_offset": F.array_min("window_offsets"), "max_win_offset": F.array_max("window_offsets"), "dp": F.col("depth"), "het": F.array_contains(F.split("gt", "/"), "0").cast("int"),
    }
    return records.withColumns(own).join(support, "record_id")


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with ``weight``, so that both classes count the same."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_t"))
    return rows.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn("weight", F.col("_t") / (2.0 * F.col("_n"))).drop("_n", "_t")


def train(rows: DataFrame, trees: int = 100, depth: int = 25, seed: int = 1) -> PipelineModel:
    """A forest over ``FEATURES`` with class-balanced weights; rows with a null feature are skipped."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", labelCol="label", seed=seed),
    ]
    return Pipeline(stages=stages).fit(balanced(rows))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the probability of a true call as ``qual``, and what ``qual`` was as ``raw_qual``."""
    scored = model.transform(rows)
    chance = vector_to_array("probability")[1]
    return scored.withColumn("raw_qual", F.col("qual")).withColumn("qual", chance).select(*rows.columns, "raw_qual")
