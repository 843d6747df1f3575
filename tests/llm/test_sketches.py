"""Threshold-scaled sketches against plain sets of shingles."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locusflow.llm import sketches
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def some_words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")


def test_edited_texts_by_hand(spark):
    rows = [(3, "ab cd"), (1, "Ä😀xyz"), (2, None), (9, "one two three four five six")]
    out = {r["doc_id"]: r for r in sketches.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    edited = {1: "Ä😀x", 2: "", 3: "ab one"[:3] + "on", 9: "one two three four five six"[:14] + "Ä😀xyz"}
    assert {i: r["edited_sha256"] for i, r in out.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited.items()}
    assert {i: r["n_chars"] for i, r in out.items()} == {1: 5, 2: 0, 3: 5, 9: 27}
    assert out[2]["fingerprint"] == "" and out[2]["near_edited"] == 1.0 and out[2]["near_next"] == 0.0 and out[1]["near_next"] == 0.0


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_next_document_over_all_buckets(spark, partitions):
    """Ids with gaps, repeats, nulls and clashing columns; each document is followed by the next of the whole table."""
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 400) if rng.random() > 0.1 else None, some_words(rng.randrange(0, 40), k)) for k in range(300)] + [(7, "the same row")] * 60
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "1 AS bucket", "true AS guest", "2 AS key", "'y' AS fingerprint").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = sketches.edited_fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in spark.createDataFrame(rows, SCHEMA).withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    expected = []
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        expected.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    by = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=by) == sorted(expected, key=by)


def test_against_sql(spark, tmp_path):
    rows = [(k, some_words(k * 7 % 90, k % 17)) for k in range(60)] + [(100, None), (101, ""), (102, " \t\n"), (103, "Ünï code wörds, 'x' " * 30), (104, some_words(30_000, 1)), (105, some_words(900, 1))]
    write(spark, tmp_path, rows)
    from locusflow.llm.queries import oracle_sql, queries

    assert_same(spark, queries()["op11_document_fingerprints"], oracle_sql()["op11_document_fingerprints"], str(tmp_path))


def test_estimates_and_equal_texts(spark):
    """Containment of a short text in one forty times as long, within four standard errors of the truth."""
    rows = []
    for k in range(20):
        part, rest = some_words(600, 1000 + k), some_words(24_000, 2000 + k)
        rows += [(2 * k, part + " " + some_words(k * 60, 3000 + k)), (2 * k + 1, rest + " " + part)]
    prints = sketches.fingerprints(spark.createDataFrame(rows, SCHEMA))
    found = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    pairs = spark.createDataFrame([(k, found[2 * k], found[2 * k + 1]) for k in range(20)], "k int, a string, b string")
    for r in pairs.select("k", sketches.containment(F.col("a"), F.col("b")).alias("share")).collect():
        a, b = shingles(rows[2 * r["k"]][1]), shingles(rows[2 * r["k"] + 1][1])
        true = len(a & b) / len(a)
        assert abs(r["share"] - true) <= 4 * (0.25 / (len(a) / sketches.SCALE)) ** 0.5 + 1e-9
    again = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert again == found


def test_sketches_merge(spark):
    """The union of a group's sketches is the sketch of its texts; texts with only a smallest hash too."""
    texts = [some_words(n, 50 + n) for n in (0, 3, 5, 9, 40, 300, 2000)]
    prints = sketches.fingerprints(spark.createDataFrame([(1, t) for t in texts] + [(2, texts[1]), (2, texts[2]), (3, "")], "g int, text string"), keep=("g",))
    out = {}
    for r in sketches.merged(prints, ["g"]).collect():
        out.setdefault(r["g"], set()).add(r["hash"])
    one = sketches.Sketcher()
    for g, group in ((1, texts), (2, texts[1:3])):
        every = {int(h) for t in group for h in one(t)}
        low = {h for h in every if h < 2**48 // sketches.SCALE}
        assert out[g] == {f"{h:012x}" for h in low or {min(every)}}
    assert 3 not in out


def test_empty_table(spark):
    assert sketches.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sketches.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
