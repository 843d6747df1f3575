"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language_id, lexical, nn_descent, pieces, prefix_trie, simhash, sketches, suffix_dedup, toxicity
from .common import id_remainder, table
from .html_extraction import extract
from .packing import pack
from .topk import top_k


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with merge-dropout and decoded again: counts, a digest of the ids, and whether the text came back."""
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after removal of every repeated string of 400 bytes, as counts, a digest and what is left of the text."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.octet_length("kept").cast("long")
    return out.select(
        "doc_id",
        (kept + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("whole").alias("kept_text"),
    )


def fitted_language_model(documents: DataFrame, modulus: int = 4, held_out: int = 2) -> language_id.LanguageModel | None:
    return language_id.fit(documents.where(id_remainder(F.col("doc_id"), modulus) != held_out))


def fitted_toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel | None:
    """Learns from rows outside the held-out fifth alone, the language model of its thresholds too."""
    taught = id_remainder(F.col("doc_id"), 5) != 0
    marks = labels.where(taught).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.where(taught)
    return toxicity.fit(rows, marks, language_id.fit(rows))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from documents outside the held-out quarter."""
    documents = table(spark, sf_dir, "documents")
    out = language_id.predict(documents, fitted_language_model(documents))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer products of every fiftieth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations in chat markup."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all embeddings at a cosine of 0.9 or more."""
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: links at four or fewer differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents")
    out = toxicity.score(documents, fitted_toxicity_model(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against that of its edited text and that of the next document."""
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


OP8_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(other) AS component_id, min(other) = vec_id AS kept
FROM reach GROUP BY vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_language_id, op2_exact_topk, op3_chat_formatting, op4_best_fit_packing, op5_sentencepiece, op6_html_extraction,
        op7_suffix_dedup, op8_embedding_near_dedup, op9_simhash_near_dedup, op10_toxicity, op11_document_fingerprints, op12_ranked_search,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op3_chat_formatting": chat.ORACLE_SQL, "op8_embedding_near_dedup": OP8_SQL, "op11_document_fingerprints": sketches.ORACLE_SQL, "op12_ranked_search": lexical.ORACLE_SQL, "op13_conversation_trie": prefix_trie.ORACLE_SQL}
