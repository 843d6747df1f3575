"""The registered corpus queries and the pipeline, on the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from locusflow.llm import queries
from locusflow.llm.common import table
from tests.llm import brute
from tests.oracle import SMALL, TABLES, assert_same

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_embeddings_with_links_match_sql(spark, tmp_path):
    """The given vectors and, for every third one, near copies at several distances: the SQL row then has links."""
    rows = table(spark, SMALL, "embeddings")
    moved = [rows.where("vec_id % 3 = 0").selectExpr(f"vec_id + {1000 * k} AS vec_id", f"transform(embedding, (x, i) -> cast(x + {0.04 * k} * sin(vec_id + i) AS float)) AS embedding", "label") for k in range(1, 6)]
    for more in moved:
        rows = rows.unionByName(more)
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in TABLES:
        if name != "embeddings":
            spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    out = queries.op8_embedding_near_dedup(spark, str(tmp_path))
    assert out.where("n_links > 0").count() > 100
    assert_same(spark, queries.op8_embedding_near_dedup, queries.oracle_sql()["op8_embedding_near_dedup"], str(tmp_path))


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}


def test_language_id_on_held_out_documents(spark):
    out = queries.op1_language_id(spark, SMALL).join(table(spark, SMALL, "documents"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_language_id_against_plain_loops(spark, docs):
    rows = table(spark, SMALL, "documents")
    model = queries.fitted_language_model(rows)
    out = {r["doc_id"]: r for r in queries.op1_language_id(spark, SMALL).collect()}
    some = sorted(docs, key=lambda i: len(docs[i] or ""))[:120]
    for i in some:
        code, score = brute.language(docs[i], model)
        assert out[i]["lang_pred"] == code and out[i]["score"] == pytest.approx(score, abs=1e-3)


def test_toxicity_against_plain_loops(spark, docs):
    from locusflow.llm.toxicity import HASHER

    model = queries.fitted_toxicity_model(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    out = {r["doc_id"]: r for r in queries.op10_toxicity(spark, SMALL).collect()}
    for i in sorted(docs, key=lambda i: len(docs[i] or ""))[:80]:
        code = brute.language(docs[i], model.language)[0] if docs[i] else "und"
        assert out[i]["score"] == pytest.approx(brute.toxicity(docs[i], model, HASHER, code), abs=1e-3)


def test_toxicity_scores(spark, docs):
    out = queries.op10_toxicity(spark, SMALL).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_suffix_dedup(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    out = {r["doc_id"]: r for r in queries.op7_suffix_dedup(spark, sf).collect()}
    for (doc_id, text), expected in zip(texts.items(), brute.remove_repeats(list(texts.values())), strict=True):
        assert tuple(out[doc_id][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == expected
        assert expected[2] or out[doc_id]["kept_text"] == (text or "")


def test_simhash(spark, docs):
    out = {r["doc_id"]: r for r in queries.op9_simhash_near_dedup(spark, SMALL).collect()}
    prints = [brute.simhash(t) for t in docs.values()]
    assert [out[i]["fingerprint"] for i in docs] == [f"{p:016x}" for p in prints]
    assert [out[i]["component_id"] for i in docs] == brute.simhash_classes(list(docs), prints)


def test_pieces_are_lossless(spark, docs):
    out = queries.op5_sentencepiece(spark, SMALL).collect()
    assert len(out) == len(docs) and all(r["lossless"] for r in out)


def test_pages(spark):
    out = queries.op6_html_extraction(spark, SMALL).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out) and sum(r["n_chars"] > 0 for r in out) >= 0.9 * len(out)


def kept_text(text, length):
    """What is left of each text when repeated strings are removed, without characters that a cut goes through."""
    raw, gone = [(t or "").encode() for t in text], []
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    for r in raw:
        marks = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        gone.append(marks)
    out = []
    for r, g in zip(raw, gone, strict=True):
        at, kept = 0, []
        for c in r.decode():
            size = len(c.encode())
            if not any(g[at : at + size]):
                kept.append(c)
            at += size
        out.append("".join(kept))
    return out


def test_pipeline_stages(spark, docs):
    """Each stage against what it must do with its own input."""
    rows = table(spark, SMALL, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    known = corpus_pipeline.known_language(spark, rows, SMALL)
    assert known.columns == list(corpus_pipeline.COLUMNS) and known.count() >= 0.95 * len(docs)
    single = corpus_pipeline.no_near_copies(spark, known, SMALL).collect()
    ids = [r["doc_id"] for r in known.collect()]
    classes = brute.simhash_classes(ids, [brute.simhash(docs[i]) for i in ids])
    assert sorted(r["doc_id"] for r in single) == sorted(set(classes))
    cut = {r["doc_id"]: r for r in corpus_pipeline.no_repeats(spark, rows, SMALL).collect()}
    assert [cut[i]["text"] for i in docs] == kept_text(docs.values(), corpus_pipeline.PASSAGE)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    packed = corpus_pipeline.packed(spark, rows, SMALL)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    rows = table(spark, MIDDLE, "documents")
    left = {r["doc_id"] for r in corpus_pipeline.not_toxic(spark, rows, MIDDLE).select("doc_id").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, MIDDLE, "labels").where("toxic is not null").collect()}
    toxic, clean = ([i for i, mark in marks.items() if mark == value] for value in (1, 0))
    assert sum(i in left for i in toxic) <= 0.2 * len(toxic) and sum(i in left for i in clean) >= 0.98 * len(clean)


def test_pipeline_with_odd_rows(spark, tmp_path, docs):
    """Null ids, texts and labels, repeated rows, empty and long texts, columns that bear the names of inner ones."""
    rows = table(spark, SMALL, "documents").limit(60)
    odd = [(None, "the same text twice " * 3, None, None, None), (None, "the same text twice " * 3, None, None, None), (900, None, "en", "s", None), (901, "", None, "s", 0), (902, "x y " * 60_000, "en", "s", 240_000), (903, "!? 12", "en", None, 5)]
    every = rows.unionByName(spark.createDataFrame(odd, rows.schema)).unionByName(rows.limit(5))
    clashing = every.selectExpr("*", "1 AS row", "'a' AS spans", "2 AS k1", "3 AS score", "4 AS bits", "5 AS component", "6 AS lang_pred")
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    labels = table(spark, SMALL, "labels")
    labels.unionByName(spark.createDataFrame([(None, None, 1), (900, None, None)], labels.schema)).withColumn("text", labels["doc_id"]).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_sequence: dict[int, list] = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    ids = {r["doc_id"] for r in out}
    assert not ids & {900, 901, 903} and len([r for r in out if r["piece"] == 0]) == len({(r["doc_id"]) for r in out if r["piece"] == 0})


def test_pipeline_on_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
