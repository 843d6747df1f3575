"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from fractions import Fraction

import pytest

from locusflow import plans
from tests.oracle import SMALL, assert_same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, plans.queries()[name], plans.oracle_sql()[name])


#: Queries over arrays of numbers or long texts, where small tables are not enough.
LARGER = ("tokens_to_bases", "kmer_encode", "crop_pad", "normalized_match", "splice_haplotypes", "stream_reorder", "complex_variants", "resample_classes")


@pytest.mark.parametrize("name", LARGER)
def test_matches_sql_on_larger_tables(spark, name):
    assert_same(spark, plans.queries()[name], plans.oracle_sql()[name], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SMALL).count() > 0


def test_mean_qualities_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    from locusflow.plans import tables

    whole = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{whole}/events.parquet")
    events.orderBy(events.event_id.desc()).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    order = ["record_id", "pos", "ref", "alt"]
    found, expected = (tables.evaluated(spark, d).select(*order, "qual").orderBy(*order).collect() for d in (str(tmp_path), whole))
    assert found == expected


def test_tied_regions_are_taken_by_id(spark, tmp_path):
    ids = [(3 + 6 * 104729 * k, 1) for k in range(9, -1, -1)]
    spark.createDataFrame(ids, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = plans.queries()["resample_classes"](spark, str(tmp_path)).collect()
    assert sorted(r["region_id"] for r in found) == sorted(i for i, _ in ids)[:3]


def test_vector_mean_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    values = [1.0, 2.0**-30, 2.0**-40, 2.0**-53, -(2.0**-53), 0.1, 0.2, 0.3, -1.0, 2.0**-52] * 3
    means = []
    for k, xs in enumerate((values, values[::-1], sorted(values))):
        spark.createDataFrame([(0, [x]) for x in xs], "label int, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        means.append(plans.queries()["vector_mean"](spark, f"{tmp_path}/{k}").first()["mean"])
    assert means == [[float(sum(map(Fraction, values)) / 30)]] * 3
    spark.createDataFrame([(0, [1e300]), (0, [1.0]), (1, [float("nan")]), (2, None), (2, [2.0])], "label int, embedding array<double>").write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    odd = {r["label"]: r["mean"][0] for r in plans.queries()["vector_mean"](spark, f"{tmp_path}/odd").collect()}
    assert odd[0] == 5e299 and odd[1] != odd[1] and odd[2] == 2.0


@pytest.mark.parametrize("name", ["window_reads", "resample_windows", "downsample_reads", "middle_slice"])
def test_reads_are_not_shuffled_by_window(spark, name):
    plan = plans.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(window_id" not in plan and "Broadcast" not in plan


def test_training_windows_are_found_once(spark, monkeypatch):
    from locusflow.plans import relational

    found, lists = [], relational.window_lists
    monkeypatch.setattr(relational, "window_lists", lambda *a: found.append(a) or lists(*a))
    assert relational.training_examples(spark, SMALL).count() > 0 and len(found) == 1


def test_files_of_a_stream_are_written_by_all_cores_and_dated_in_order(spark, monkeypatch):
    import os
    from pathlib import Path

    from locusflow.plans import streams

    paths, shared = [], streams.shared_path
    monkeypatch.setattr(streams, "shared_path", lambda s: paths.append(shared(s)) or paths[-1])
    streams.as_stream(spark.range(1000).selectExpr("id * 7919 % 1000 AS pos"), ["pos"])
    files = sorted(Path(paths[-1]).glob("*.parquet"), key=os.path.getmtime)
    rows = [[r["pos"] for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) > streams.BATCHES and sum(rows, []) == list(range(1000))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
