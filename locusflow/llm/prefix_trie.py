"""The prefix trie of rebuilt conversations, by collapse of whole sequences.

A conversation is rebuilt from the first turns of the one that opens its block of ids and
its own later turns.  Identical rebuilt conversations become one weighted sequence with
the list of those that end there; sequences that are proper prefixes of others are found by an
anti-join, and what is left are the leaves.  Nodes are the prefixes of the weighted
sequences: each sequence adds its weight to its prefixes, so copies are never expanded.

Texts are not shuffled: a turn is its 128-bit digest (the first half of SHA-256 over role and
text), a node the digest chained over its turns, block by block for long conversations.
Sums over subtrees need no pair of nodes either: the value of a node is handed to the
smallest leaf below it, where the nodes of one leaf are the end of its path.  A node then
has the totals of all leaves below it, but of its own leaf only what lies from it on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turn numbers, turns and depths that are put in order or summed up in one task at most.
SLICE, BLOCK = 64, 1024
#: Conversation ids whose ends are joined in one task at most.
ENDS = 1 << 16
#: Turns that a conversation may take from the one that opens its ids' block of so many.
MOST, IDS = 4, 20
ROOT = b""


def digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): turns by number (null first), those of one number by digest.

    Places are counted in slices of turn numbers first (null numbers: of digests), so that
    a long conversation is not put in order by one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = digest(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    start = F.conv(F.hex(F.substring("digest", 1, 1)), 16, 10).cast("long")
    rows = rows.withColumns({"numbered": F.col("turn").isNotNull(), "slice": F.coalesce(F.floor(F.col("turn") / SLICE), start)})
    keys = ["conv_id", "numbered", "slice"]
    inside = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "digest")))
    before = Window.partitionBy("conv_id").orderBy("numbered", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return inside.join(starts, keys).select("conv_id", (F.col("start") + F.col("place")).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words, n) of all rebuilt turns, and (conv_id, n) of all rebuilt conversations.

    Conversation c has the first h turns of the one numbered c - c % 20 (all if it has
    fewer, none if there is none), then its own after its first h; h is crc32(c) % 4.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("long")
    sizes = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % IDS).alias("opener"), h.alias("h"), "own")
    openers = sizes.where("conv_id = opener").select(F.col("opener"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = sizes.join(openers, "opener", "left").select("conv_id", "opener", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    own = turns.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "n")
    heads = turns.where((F.col("place") < MOST) & (F.col("conv_id") % IDS == 0)).select(F.col("conv_id").alias("head"), "place", "digest", "words")
    lent = convs.where("taken > 0").join(heads, (F.col("opener") == F.col("head")) & (F.col("place") <= F.col("taken")))
    return own.unionByName(lent.select("conv_id", F.col("place").alias("depth"), "digest", "words", "n")), convs.select("conv_id", "n")


def chained(rows: DataFrame, keys: list[str], order: str, value: str, bare_start: bool) -> DataFrame:
    """Rows with ``chain``, the digest over ``value`` so far within ``keys`` in ``order``, and ``former``, that of the row before.

    The first row's chain is its value if ``bare_start``.  Rows stream past; a key of any
    length needs no memory.
    """
    spread = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    names = spread.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, b""
        for batch in batches:
            chain, former = [], []
            for key, part in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(value).to_pylist(), strict=True):
                fresh = key != last
                former.append(None if fresh else at)
                at = part if fresh and bare_start else hashlib.sha256((b"" if fresh else at) + part).digest()[:16]
                chain.append(at)
                last = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chain, pa.binary()), pa.array(former, pa.binary())], names=[*names, "chain", "former"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema)
    return spread.mapInArrow(task, f"{kinds}, chain binary, former binary")


def with_nodes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, words, n, node, parent) of rebuilt turns: digests of the prefixes that end with a turn and before it."""
    rows = turns.withColumn("block", F.floor((F.col("depth") - 1) / block))
    inside = chained(rows, ["conv_id", "block"], "depth", "digest", bare_start=False)
    # What a block starts from is the node at the end of the block before.
    ends = inside.where((F.col("depth") % block == 0) & (F.col("depth") < F.col("n"))).select("conv_id", "block", F.col("chain").alias("end"))
    starts = chained(ends, ["conv_id"], "block", "end", bare_start=True).select("conv_id", (F.col("block") + 1).alias("block"), F.col("chain").alias("start"))
    first = inside.where("block = 0").select("conv_id", "depth", "words", "n", F.col("chain").alias("node"), F.coalesce("former", F.lit(ROOT)).alias("parent"))
    later = inside.where("block > 0").join(starts, ["conv_id", "block"])
    later = later.select("conv_id", "depth", "words", "n", digest("start", "chain").alias("node"), F.when(F.col("former").isNull(), F.col("start")).otherwise(digest("start", "former")).alias("parent"))
    return first.unionByName(later)


def end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids (node, conv_id) of each node, ascending, joined by commas.

    Ids are joined within ranges of ids; the joined parts stream through the hash.
    """
    parts = ends.groupBy("node", F.floor(F.col("conv_id") / ENDS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))  # distinct ids of a range

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == last:
                    running.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((last, running.hexdigest()))
                last, running = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
            done = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part").mapInArrow(task, "node binary, ends_sha256 string")


def from_here_on(rows: DataFrame, group: str, place: str, value: str, block: int = BLOCK) -> DataFrame:
    """Rows with ``rest``, the sum of ``value`` from a row's ``place`` on within ``group``, and ``total``; summed in blocks of places first."""
    rows = rows.withColumn("_block", F.floor(F.col(place) / block))
    inside = rows.withColumn("_in", F.sum(value).over(Window.partitionBy(group, "_block").orderBy(F.desc(place))))
    sums = rows.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(group)
    sums = sums.select(group, "_block", (F.sum("_sum").over(over.orderBy(F.desc("_block"))) - F.col("_sum")).alias("_after"), F.sum("_sum").over(over).alias("total"))
    return inside.join(sums, [group, "_block"]).withColumn("rest", F.col("_in") + F.col("_after")).drop("_block", "_in", "_after")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id and parent_conv_id are the smallest members, depth, n_convs, n_children, n_leaves
    and saved_tokens (over the subtree, (n_convs - 1) times the words of a node's last text)
    are longs, ends_sha256 covers the conversations that end at the node.  A null role or
    text is empty.  Rows without a conv_id belong to no conversation and are left out;
    without any other row there is no root.  Other columns are ignored.
    """
    turns, convs = rebuilt(stored(ordered_turns(conversations)))
    rows = stored(with_nodes(turns, block))
    ends = rows.where("depth = n").select("conv_id", "node").unionByName(convs.where("n = 0").select("conv_id", F.lit(ROOT).alias("node")))
    sequences = ends.groupBy("node").agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    inner = rows.select(F.col("parent").alias("node")).distinct()
    leaves = sequences.join(inner, "node", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    sequences = sequences.select("conv_id", "weight").join(leaves, "conv_id", "left").fillna(0, ["leaf"])

    # Prefixes of the weighted sequences; every sequence starts at the root.
    paths = rows.join(sequences, "conv_id").select("conv_id", "node", "parent", "depth", "words", "weight", "leaf")
    top = sequences.select("conv_id", F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "weight", "leaf")
    paths = stored(paths.unionByName(top))
    nodes = paths.groupBy("node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("conv_id"))).alias("below")
    )
    nodes = stored(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("words")))

    own = stored(from_here_on(nodes.select("node", "below", "depth", "value"), "below", "depth", "value", block).select("node", "below", "rest", "total"))
    totals = own.where("total > 0").select(F.col("below").alias("conv_id"), "total").distinct()
    through = paths.where("leaf = 1").join(totals, "conv_id").groupBy("node").agg(F.sum("total").alias("through"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(own.select("node", "rest", "total"), "node").join(through, "node", "left").join(children, "node", "left").join(end_lists(ends), "node", "left")
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    named = whole.join(parents, whole["parent"] == parents["up"], "left")
    zero = F.lit(0).cast("long")
    saved = F.coalesce("through", zero) - F.col("total") + F.col("rest")
    empty = hashlib.sha256(b"").hexdigest()
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


_CRC = "xor(list_reduce(list_transform(range(1, 1 + length(s)), lambda i: CAST(ord(substr(s, i, 1)) AS BIGINT)), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295)"

#: The same in SQL: prefixes as lists of turns.
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), logs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS log FROM turns GROUP BY conv_id
), keys AS (
  SELECT conv_id, log, conv_id - conv_id % {IDS} AS opener, {_CRC} % {MOST} AS h FROM (SELECT *, CAST(conv_id AS VARCHAR) AS s FROM logs)
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.log[1:a.h], []), a.log[a.h + 1:]) AS log FROM keys a LEFT JOIN logs b ON b.conv_id = a.opener
), prefixes AS (
  SELECT conv_id, d, log[1:d] AS key, d = len(log) AS last FROM (SELECT *, unnest(range(0, len(log) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(key[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words FROM prefixes GROUP BY key, d
), up AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
joined AS (SELECT n.*, coalesce(u.n_children, 0) AS n_children FROM nodes n LEFT JOIN up u ON u.key = n.key),
below AS (
  SELECT key[1:i] AS key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM joined) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM joined n JOIN below b ON b.key = n.key LEFT JOIN nodes p ON n.d > 0 AND p.key = n.key[1:n.d - 1]
"""
