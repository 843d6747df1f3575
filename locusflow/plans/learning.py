"""Queries of the quality classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifier, evaluation, forest
from ..sources.text import shared_path
from .registry import query
from .relational import scored_features


def held_out():
    """A tenth of the calls, by key."""
    return F.pmod(F.xxhash64("record_id"), F.lit(10)) == 0


def labelled(spark, sf):
    """All calls with their features, written once: training goes over them many times."""
    path = shared_path(spark)
    rows = scored_features(spark, sf).withColumn("label", (F.col("call") == "TP").cast("int"))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def grown(spark, sf):
    """All calls, and what the trees of a forest trained on nine tenths of them say of the others and of the features."""
    rows = labelled(spark, sf).withColumn("held", held_out())
    return rows, forest.forest(rows, list(classifier.FEATURES))


def scored(spark, sf):
    rows, found = grown(spark, sf)
    return rows.withColumnRenamed("qual", "raw_qual").join(forest.scores(found).withColumnRenamed("chance", "qual"), "record_id").select("record_id", "label", "qual", "raw_qual")


@query()
def train_classifier(spark, sf):
    """Feature importances of a forest trained on nine tenths of the calls."""
    names = spark.createDataFrame(list(enumerate(classifier.FEATURES)), "feature int, name string")
    return names.join(forest.importances(grown(spark, sf)[1]), "feature", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


@query()
def score_calls(spark, sf):
    """Held-out calls with their new quality."""
    return scored(spark, sf)


@query()
def classifier_metrics(spark, sf):
    """Agreement of the classifier with the truth on held-out calls: at a quality of 0.1, and at the best cut."""
    path, rows = shared_path(spark), scored(spark, sf)
    rows.write.parquet(path)  # the forest grows once
    return evaluation.quality_of(spark.read.schema(rows.schema).parquet(path), score="qual")
