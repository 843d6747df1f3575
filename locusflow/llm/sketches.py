"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the range.  Because the
threshold does not depend on the document, the sketch of a union is the union of the
sketches, and the share of one sketch that lies in another estimates how much of the one
text the other contains, however unequal their lengths.  A text with no hash below the
threshold keeps its smallest one, so that short texts compare too; a merge drops it as
soon as there is a hash below.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; a shingle is five words
in a row (fewer words: all of them; none: the sketch is empty).  A word's hash is the first
60 bits of its MD5, a shingle's the sum of its words' hashes times odd constants modulo
2**64, of which the upper 48 bits are kept.  SQL can express all of it.

A fingerprint is written as the hashes in ascending order, 12 hex digits each, joined by commas.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_and_text, sliced, texts_of

WORDS = 5
#: One hash in so many is kept.
SCALE = 4
#: Word places in a shingle have the powers of this number.
FACTOR = 0x9E3779B97F4A7C15
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 20
#: Sampled keys for each bound between buckets of documents.
KEYS = 32


class WordHashes(dict):
    """The hash of each word that was asked for."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(md5(word, usedforsecurity=False).digest()[:8], "big") >> 4
        return value


class Sketcher:
    """Sketches of texts within a task: ascending arrays of 48-bit hashes."""

    def __init__(self, words: int = WORDS, scale: int = SCALE):
        self.hashes = WordHashes()
        self.factors = [np.uint64(pow(FACTOR, k + 1, 2**64)) for k in range(words)]
        self.limit = np.uint64(2**48 // scale)

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        w = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        n = max(len(w) - len(self.factors) + 1, 1)
        total = np.zeros(n, np.uint64)
        for k, factor in enumerate(self.factors[: len(w)]):
            total += w[k : k + n] * factor
        total >>= np.uint64(16)
        low = total[total < self.limit]
        return np.unique(low) if len(low) else total.min(keepdims=True)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex(",", 6) if len(sketch) else ""


def contained(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ``a`` in ``b``: an estimate of how much of a's text is in b's (both empty: 1, one: 0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``keep`` (without a column of that name) and the ``fingerprint`` of every text (null: that of an empty one)."""
    rows, names, schema = kept_and_text(docs, keep, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(words, scale)
        for batch in sliced(batches, text):
            made = pa.array([written(sketch(t)) for t in texts_of(batch.column(text))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], names=[*names, "fingerprint"])

    return rows.mapInArrow(task, f"{schema}, fingerprint string")


def hashes_of(fingerprint: Column) -> Column:
    """The hashes of a fingerprint as an array of strings; they are in order as strings too."""
    return F.filter(F.split(F.coalesce(fingerprint, F.lit("")), ","), lambda h: h != "")


def containment(a: Column, b: Column) -> Column:
    """The same as ``contained`` for two written fingerprints."""
    x, y = hashes_of(a), hashes_of(b)
    both = F.size(F.array_intersect(x, y)) / F.size(x)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).otherwise(both)


def merged(prints: DataFrame, group: list[str], fingerprint: str = "fingerprint", scale: int = SCALE) -> DataFrame:
    """The sketch of all texts of each ``group`` together, one row for each hash: ``group``, hash.

    Rows, as the sketch of a large group may be too long for one; hashes above the threshold
    go where there is one below.  Groups of empty texts have no row.
    """
    limit = f"{2**48 // scale:012x}"
    rows = prints.select(*group, F.explode(hashes_of(F.col(fingerprint))).alias("hash")).distinct()
    least = rows.groupBy(*group).agg(F.min("hash").alias("_least")).withColumnsRenamed({c: f"_{c}" for c in group})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    short = rows.where(F.col("hash") >= limit).join(least, on).where(F.col("hash") == F.col("_least"))
    return rows.where(F.col("hash") < limit).unionByName(short.select(*rows.columns))


def in_order(docs: DataFrame, text: str, order: str, buckets: int) -> DataFrame:
    """(id, text, bucket, guest): documents in buckets that follow each other in order of id.

    A bucket also gets the first document of the next one, the last bucket that of the
    first, as a guest.  Bounds between buckets are ids of a bounded sample of the documents.
    Ids that repeat are ordered by their texts' hashes, so that a frequent id spreads; a null
    id comes first.
    """
    rows = docs.select(F.col(order).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash"))
    keyed = rows.withColumn("key", key)
    n, first = keyed.agg(F.count("*"), F.min("key")).first()
    every = max(1, n // (KEYS * buckets))
    sample = sorted({tuple(r["key"]) for r in keyed.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect()} - {tuple(first or ())})
    bounds = [sample[k * len(sample) // buckets] for k in range(1, buckets)] if len(sample) >= buckets else sample
    if not bounds:
        own = keyed.withColumn("bucket", F.lit(0))
    else:
        listed = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("hash")) for i, h in bounds))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))

        def halve(at: Column, step: Column) -> Column:
            return F.when((at + step <= len(bounds)) & (F.try_element_at(listed, at + step) <= F.col("key")), at + step).otherwise(at)

        own = keyed.withColumn("bucket", F.aggregate(steps, F.lit(0), halve))
    firsts = {tuple(first): len(bounds)} | {b: k for k, b in enumerate(bounds)} if first else {}
    visits = F.create_map(*(x for (i, h), k in firsts.items() for x in (F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("hash")), F.lit(k)))) if firsts else F.lit(None).cast("map<struct<id:bigint,hash:bigint>,int>")
    visit = F.try_element_at(visits, F.col("key"))
    places = F.when(visit.isNull(), F.array(F.struct("bucket", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(visit.alias("bucket"), F.lit(True).alias("guest"))))
    spread = own.select("id", "text", "key", F.inline(places))
    return spread.repartitionById(max(len(bounds) + 1, 1), F.col("bucket")).sortWithinPartitions("bucket", "guest", "key").drop("key")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, next_near double"


def edited_fingerprints(docs: DataFrame, text: str = "text", order: str = "doc_id", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first
    ones of the next document (or all it has); after the last document comes the first.
    near_edited and near_next are the share of the document's fingerprint in the other one,
    next_near the share of the next document's in its own.  Every row is a document: of rows
    with one id, those of equal texts are neighbours.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = in_order(docs, text, order, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(words, scale)
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((c, pa.float64()) for c in ("near_edited", "near_next", "next_near"))])
        former: tuple | None = None  # the document that waits for the next one of its bucket
        for batch in sliced(batches, "text"):
            out: list[tuple] = []
            for doc_id, body, bucket, guest in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(), strict=True):
                if guest and former is None:
                    continue  # a second copy of the next bucket's first document
                own = sketch(body)
                if former and former[3] == bucket:
                    before, old, known = former[0], former[1], former[2]
                    half = len(old) // 2
                    edited = old[: len(old) - half] + body[:half]
                    other = sketch(edited)
                    digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(old), digest, written(known), written(other), contained(known, other), contained(known, own), contained(own, known)))
                former = None if guest else (doc_id, body, own, bucket)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return rows.mapInArrow(task, EDITED)


def _sketch_sql(table: str) -> str:
    """(k, sketch): the sorted hashes of each row (k, text) of ``table``."""
    terms = " + ".join(f"coalesce(w[i + {j}], 0) * {pow(FACTOR, j + 1, 2**64)}::HUGEINT % 18446744073709551616::HUGEINT" for j in range(WORDS))
    return f"""(SELECT k, CASE WHEN len(list_filter(h, lambda x: x < {2**48 // SCALE})) > 0 THEN list_sort(list_distinct(list_filter(h, lambda x: x < {2**48 // SCALE}))) WHEN len(h) > 0 THEN [list_min(h)] ELSE h END AS sketch
  FROM (SELECT k, list_transform(range(1, 1 + CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {WORDS - 1}, 1) END), lambda i: ({terms}) % 18446744073709551616::HUGEINT // 65536) AS h
    FROM (SELECT k, list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: CAST(('0x' || left(md5(x), 15)) AS UBIGINT)::HUGEINT) AS w FROM {table})))"""


def _share_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN CAST(len({a}) = len({b}) AS DOUBLE) ELSE len(list_intersect({a}, {b})) / len({a}) END"


def _written_sql(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: printf('%012x', CAST(x AS BIGINT))), ',')"


#: The same in SQL, for ids that do not repeat.
ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, count(*) OVER () AS n FROM documents
), pairs AS (
  SELECT a.k, a.doc_id, a.text, b.k AS next_k, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM docs a JOIN docs b ON b.k = a.k % a.n + 1
), own AS {_sketch_sql('docs')}, other AS {_sketch_sql('(SELECT k, edited AS text FROM pairs)')}
SELECT p.doc_id, CAST(length(p.text) AS BIGINT) AS n_chars, sha256(p.edited) AS edited_sha256, {_written_sql('a.sketch')} AS fingerprint, {_written_sql('e.sketch')} AS edited_fingerprint,
  {_share_sql('a.sketch', 'e.sketch')} AS near_edited, {_share_sql('a.sketch', 'b.sketch')} AS near_next, {_share_sql('b.sketch', 'a.sketch')} AS next_near
FROM pairs p JOIN own a ON a.k = p.k JOIN other e ON e.k = p.k JOIN own b ON b.k = p.next_k
"""
