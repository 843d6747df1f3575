"""Ranked lexical search by pipelined term partitioning.

The inverted index is cut twice: documents into shards, terms among owners by how frequent
they are.  Items travel in bundles: for each shard a bundle carries sparse accumulators,
(item, document) to score so far, from one owner's stage to the next.  A stage cogroups
the bundles with the owner's posting lists of the same shard, adds the integer
contributions, and hands the bundle on; the rarest terms come first, while accumulators
are few.  The last stage selects the best documents of each item in its shard, and the
best of all shards remain.

No task holds more than a shard of documents for a bundle of items.  Documents are read
once: their terms are filtered through a bitmap of the items' terms, whose size is fixed;
what it lets through by chance goes in the join on the terms themselves.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored, string_buffers

#: Documents of a shard, and bytes of text from which a shard is closed earlier.
SHARD, SHARD_BYTES = 4096, 64 << 20
#: Items that share a bundle.
BUNDLE = 256
#: Shares of the documents up to which a term belongs to an owner; the rest belongs to the last one.
OWNERS = (1 / 64, 1 / 8)
#: Bits of the filter of item terms.
BITS = 1 << 23
#: Parts that a term's posting lists are dealt to before they meet the items.
PARTS = 16
#: Terms that a task remembers the filter's answer for, and bytes of a text that are read at once.
REMEMBERED, READ = 1 << 20, 1 << 20

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The terms of a text with repeats, in order (null: none)."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(PATTERN), 0), F.array().cast("array<string>"))


def term_counts(raw: bytes) -> Counter:
    """Occurrences of each term of a lower-cased text; a long one is read in parts that end between terms."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        end = at + READ
        if end < len(raw):
            cut = BETWEEN.search(raw, end)
            end = cut.start() if cut else len(raw)
        counts.update(TERM.findall(raw, at, end))
        at = end
    return counts


class Asked(dict):
    """Whether a term passes the bitmap of the items' terms."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        at = zlib.crc32(term) % BITS
        answer = self[term] = bool(self.bitmap[at >> 3] >> (at & 7) & 1)
        return answer


def bitmap_of(item_terms: DataFrame) -> bytes:
    """``BITS`` bits, with those of the terms set."""
    bit = (F.crc32(F.col("term").cast("binary")) % BITS).cast("long") + 1  # positions are counted from 1
    pieces = item_terms.select(F.bitmap_bucket_number(bit).alias("piece"), F.bitmap_bit_position(bit).alias("bit"))
    out = bytearray(BITS // 8)
    for r in pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # at most BITS / 32768 rows of 4 kB
        at = (r["piece"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return bytes(out)


INDEX = "shard long, term string, docs array<int>, tfs array<int>, ids array<bigint>, lengths array<bigint>"
INDEX_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), *((c, pa.list_(pa.int32())) for c in ("docs", "tfs")), *((c, pa.list_(pa.int64())) for c in ("ids", "lengths"))])


def indexed(documents: DataFrame, bitmap: bytes, text: str = "text", doc_id: str = "doc_id", most: int = SHARD) -> DataFrame:
    """Posting lists (shard, term, docs, tfs) by place in the shard, and a row (shard, ids, lengths) for each shard.

    Only terms that pass the bitmap have lists; ``lengths`` count all terms.  A shard has up
    to ``most`` documents.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(bitmap)
        shard = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        lists: dict[bytes, tuple[array, array]] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            names = [t.decode("utf-8", "surrogatepass") for t in lists]
            rows = [[shard] * (len(names) + 1), [*names, None], [*(d for d, _ in lists.values()), None], [*(f for _, f in lists.values()), None], [*[None] * len(names), ids], [*[None] * len(names), lengths]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)

        for batch in sliced(batches, "text"):
            data, offsets = string_buffers(batch.column("text"))
            whole = data.tobytes()
            for place, doc in enumerate(batch.column("id").to_pylist()):
                counts = term_counts(whole[offsets[place] : offsets[place + 1]].lower())
                for term, tf in counts.items():
                    if asked[term]:
                        docs, tfs = lists.get(term) or lists.setdefault(term, (array("i"), array("i")))
                        docs.append(len(ids))
                        tfs.append(tf)
                ids.append(doc)
                lengths.append(counts.total())
                size += int(offsets[place + 1] - offsets[place])
                if len(ids) >= most or size >= SHARD_BYTES:
                    yield flushed()
                    shard, size = shard + 1, 0
                    ids, lengths, lists = [], [], {}
        if ids:
            yield flushed()

    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(task, INDEX)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """All numbers of a list column, end to end."""
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def accumulated(state: pa.Table, postings: pa.Table) -> np.ndarray:
    """Scores (item of the bundle, document of the shard) after the contributions of the postings."""
    lengths = numbers(state, "m").astype(np.int64)
    item, doc, score = (numbers(state, c) for c in ("items", "docs", "scores"))
    asked_by = postings.column("items").to_pylist()
    size = max((max(x) for x in asked_by), default=-1)
    scores = np.zeros((max(size, int(item.max(initial=-1))) + 1, len(lengths)), np.int64)
    scores[item, doc] = score
    for items, w, docs, tfs in zip(asked_by, postings.column("w").to_pylist(), postings.column("docs"), postings.column("tfs"), strict=True):
        at, tf = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
        scores[np.ix_(items, at)] += w * (1_000_000_000 * tf // (1000 * tf + 8 * lengths[at]))
    return scores


STATE = "bundle int, shard long, ids array<bigint>, m array<bigint>, items array<smallint>, docs array<int>, scores array<bigint>"
STATE_ARROW = pa.schema([("bundle", pa.int32()), ("shard", pa.int64()), *((c, pa.list_(t)) for c, t in (("ids", pa.int64()), ("m", pa.int64()), ("items", pa.int16()), ("docs", pa.int32()), ("scores", pa.int64())))])


def handed_on(state: pa.Table, postings: pa.Table) -> pa.Table:
    """A stage: the bundle with its accumulators after the owner's contributions."""
    if not len(state):
        return STATE_ARROW.empty_table()
    scores = accumulated(state, postings)
    items, docs = np.nonzero(scores)
    fresh = {"items": pa.array([items], pa.list_(pa.int16())), "docs": pa.array([docs], pa.list_(pa.int32())), "scores": pa.array([scores[items, docs]], pa.list_(pa.int64()))}
    return pa.table([fresh.get(f.name, state.column(f.name)) for f in STATE_ARROW], schema=STATE_ARROW)


def selected(k: int):
    """The last stage: the ``k`` best documents of each item in the shard."""
    kinds = pa.schema([("bundle", pa.int32()), ("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def stage(state: pa.Table, postings: pa.Table) -> pa.Table:
        if not len(state):
            return kinds.empty_table()
        scores = accumulated(state, postings)
        ids = state.column("ids").combine_chunks().flatten()
        unknown, known = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        items, best = [], []
        for item, row in enumerate(scores):
            found = np.flatnonzero(row)
            if len(found) > 4 * k:
                found = found[row[found] >= np.partition(row[found], len(found) - k)[len(found) - k]]
            found = found[np.lexsort((known[found], unknown[found], -row[found]))[:k]]
            items.append(np.full(len(found), item))
            best.append(found)
        item, doc = np.concatenate([np.zeros(0, int), *items]), np.concatenate([np.zeros(0, int), *best])
        out = [np.full(len(item), state.column("bundle")[0].as_py()), item, ids.take(pa.array(doc)), scores[item, doc]]
        return pa.table([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(out, kinds, strict=True)], schema=kinds)

    return stage


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", shard: int = SHARD, bundle: int = BUNDLE) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0; ties go to the smaller doc_id.

    Every row of ``documents`` is a document of its own, also where an id repeats; a null id
    comes last among equal scores.  Rows of ``items`` with one id (null is one too) are one
    item with all their terms.  A null text has no terms.  Other columns are ignored.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(terms(F.col(text).cast("string"))).alias("term")).distinct()
    asked = stored(asked)
    index = stored(indexed(documents, bitmap_of(asked), text, doc_id, shard))
    shards, lists = index.where("term is null"), index.where("term is not null")
    total = lambda c, f: F.sum(F.aggregate(c, F.lit(0).cast("long"), f))
    n, length = shards.agg(total("lengths", lambda s, x: s + (x > 0).cast("long")), total("lengths", lambda s, x: s + x)).first()
    if not length:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    bundles = max(1, -(-asked.select("item_id").distinct().count() // bundle))
    named = asked.select("item_id").distinct().withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
    named = named.withColumn("item", (F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1).cast("int"))

    # Weights and owners of the items' terms; each row serves a bundle, and a part of the posting lists.
    df = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.ln((F.lit(2 * n) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    owner = sum((F.col("df") > share * n).cast("int") for share in OWNERS)
    placed = asked.join(named, asked["item_id"].eqNullSafe(named["item_id"])).select("term", "bundle", "item")
    users = placed.groupBy("term", "bundle").agg(F.array_sort(F.collect_list("item")).alias("items"))  # the items of one bundle
    dealt = stored(users.join(df, "term").select("term", "bundle", "items", weight.alias("w"), owner.alias("owner")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumnRenamed("term", "asked")
    lists = lists.select("shard", "term", F.pmod(F.xxhash64("shard"), F.lit(PARTS)).cast("int").alias("p"), "docs", "tfs")

    m = F.expr(f"transform(lengths, x -> 100L - 90L + (90L * x * {n}L) div {length}L)")
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("items", "smallint"), ("docs", "int"), ("scores", "bigint"))]
    state = shards.select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "shard", "ids", m.alias("m"), *none)
    for stage in range(len(OWNERS) + 1):
        mine = dealt.where(F.col("owner") == stage)
        postings = lists.join(mine, (F.col("term") == F.col("asked")) & (F.col("p") == F.col("part"))).select(F.col("bundle").alias("to"), F.col("shard").alias("at"), "items", "w", "docs", "tfs")
        pairs = state.groupBy("bundle", "shard").cogroup(postings.groupBy("to", "at"))
        last = stage == len(OWNERS)
        state = pairs.applyInArrow(selected(k) if last else handed_on, "bundle int, item int, doc_id long, score long" if last else STATE)
    order = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")


#: The same in SQL.
ORACLE_SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}') AS t FROM documents
), sizes AS (SELECT row, doc_id, len(t) AS n FROM words),
whole AS (SELECT count(*) FILTER (n > 0) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term FROM benchmark),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM words) SEMI JOIN asked USING (term) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), whole),
scores AS (
  SELECT a.item_id, p.row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l))))) AS BIGINT) AS score
  FROM asked a JOIN weights USING (term) JOIN postings p USING (term) JOIN sizes s ON s.row = p.row, whole GROUP BY a.item_id, p.row
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores JOIN sizes USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
