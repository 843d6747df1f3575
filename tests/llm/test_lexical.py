"""Ranked search against plain loops."""

from __future__ import annotations

import math
import random
import re

import pytest

from locusflow.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked(docs, items, k=10):
    counted = [(i, words(t)) for i, t in docs]
    n, length = sum(bool(w) for _, w in counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if words(t):
            asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for doc, w in counted:
            m = 100 - 90 + 90 * len(w) * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(i, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return out


def by(row):
    return (row[0] is not None, row[0] or 0, row[1])


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünï", "日本", "a1b2", "x", "É"]
    pick = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 404)] + rng.choice(["", "", ",", ".-", "\t"]) for _ in range(n))
    docs = [(k, pick(rng.randrange(60))) for k in range(size)]
    return docs, [(k, pick(rng.randrange(1, 25))) for k in range(30)]


@pytest.mark.parametrize(("shard", "bundle"), [(lexical.SHARD, lexical.BUNDLE), (7, 4), (50, 1)])
def test_against_plain_loops(spark, shard, bundle):
    docs, items = corpus(1, 220)
    docs += [(500, None), (501, ""), (None, "w1 w2 w3"), (None, "W1,w2;w3"), (502, "w3 " * 3000), (3, docs[3][1]), (3, "w9 w9"), (503, "..!? \n")]
    items += [(100, None), (101, ""), (102, "nowhere found"), (None, "w1 w9"), (5, "w7 w8 É"), (103, "The THE w0 " * 500)]
    a = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS shard", "1 AS item_id", "2 AS term", "3 AS ids").repartition(3)
    b = spark.createDataFrame(items, ITEMS).selectExpr("*", "4 AS doc_id", "5 AS rank")
    out = lexical.ranked_search(a, b, shard=shard, bundle=bundle)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=by) == sorted(ranked(docs, items), key=by)


def test_ties_go_to_the_smaller_id(spark):
    """Many equal documents over several shards."""
    docs = [(k, "same words here") for k in range(100, 0, -1)]
    out = lexical.ranked_search(spark.createDataFrame(docs + [(0, "others")], DOCS).repartition(4), spark.createDataFrame([(1, "words")], ITEMS), shard=8).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(out, key=lambda r: r["rank"])] == [(k, k) for k in range(1, 11)]


def test_long_texts_are_read_in_parts(monkeypatch):
    text = ("aé-b1 c  " * 4000 + "ü" * 3000).encode()
    whole = lexical.term_counts(text)
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(lexical, "READ", size)
        assert lexical.term_counts(text) == whole


def test_a_full_bitmap_lets_all_through(spark):
    """Terms that pass the bitmap by chance do not count."""
    docs, items = corpus(2, 40)
    frame = spark.createDataFrame(docs, DOCS)
    rows = lexical.indexed(frame, b"\xff" * (lexical.BITS // 8)).where("term is not null").collect()
    expected = {}
    for _, t in docs:
        for w in set(words(t)):
            expected[w] = expected.get(w, 0) + 1
    found = {}
    for r in rows:
        found[r["term"]] = found.get(r["term"], 0) + len(r["docs"])
    assert found == expected
    only = lexical.bitmap_of(spark.createDataFrame([(t,) for t in ("w1", "日本")], "term string"))
    asked = lexical.Asked(only)
    assert asked[b"w1"] and asked["日本".encode()] and sum(asked[w.encode()] for w in expected) <= 4


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "?")], [(1, "a")]), ([], [])])
def test_empty_tables(spark, docs, items):
    assert lexical.ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
