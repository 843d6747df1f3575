"""Exact top-k inner products by norm buckets with local cosine thresholds.

Vectors are grouped by length, so a bucket knows its longest.  A query that already has k
products of at least t needs, within a bucket, only vectors whose cosine with it reaches
t / (|query| * longest): its local threshold.  A threshold over one rules the bucket out; a
high one is answered by coordinate pruning (the coordinates of a unit vector near the query
lie near the query's), a low one by length pruning (too short vectors cannot reach t).  What is
left is verified by its products.

Buckets and blocks of queries are packed into one row each.  A query with k products of at least
t needs no vector shorter than t / |query|.  Queries that need about the same length share a
block, so that a block goes only to the buckets that hold long enough vectors; each bucket is
read once, before all blocks that it meets.  A meeting yields at most k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKET = 4096
#: Vectors of the sample that gives starting thresholds.
SAMPLE = 4096
QUERIES = 1024
BUCKETS_PER_TASK = 64
FOCUS = 3
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE = 0.3
#: Room for rounding in all comparisons of lengths and cosines; it only admits more candidates.
SLACK = 1e-9
#: Up to this bound all sums are exact in double precision.
EXACT = 2**52


def quantized(vectors: DataFrame, vector: str, vec_id: str, scale: int) -> DataFrame:
    """(id, v, copies, dims, norm2, key) of each distinct row, with v = floor(scale * x) as longs.

    Rows without an id, and vectors with a null or non-finite component, are left out.
    ``key`` is a hash of id and v, so that rows that share an id are dealt apart.
    """
    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    whole = rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).groupBy("id", "v").agg(F.count("*").alias("copies"))
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return whole.select("id", "v", "copies", F.size("v").alias("dims"), length.alias("norm2"), F.xxhash64("id", "v").alias("key"))


def pack(rows: DataFrame, group: str) -> DataFrame:
    """One row for each number of dimensions and ``group``: ids, keys, copies and matrix as bytes, the longest vector first."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["norm2", "id", "key"], ascending=[False, True, True], kind="stable")
        matrix = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), -1)
        width = next(t for t in (np.int16, np.int32, np.int64) if not matrix.size or (matrix.min() >= np.iinfo(t).min and matrix.max() <= np.iinfo(t).max))
        first = frame.iloc[0]
        packed = {c: [frame[n].to_numpy(np.int64).tobytes()] for c, n in (("ids", "id"), ("keys", "key"), ("copies", "copies"))}
        return pd.DataFrame({"dims": [int(first["dims"])], group: [int(first[group])], **packed, "matrix": [matrix.astype(width).tobytes()]})

    return rows.groupBy("dims", group).applyInPandas(one, f"dims int, {group} long, ids binary, keys binary, copies binary, matrix binary")


def unpacked(ids: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a packed row; the matrix is as wide as its bytes tell."""
    numbers = np.frombuffer(ids, np.int64)
    width = len(matrix) // max(1, len(numbers) * dims)
    return numbers, np.frombuffer(matrix, f"i{width or 8}").reshape(len(numbers), dims).astype(np.int64)


def dealt(rows: DataFrame, by: str, size: int, name: str) -> tuple[DataFrame, list[tuple]]:
    """``rows`` dealt to groups of about ``size`` with like values of ``by``, and (dims, quantile, first, parts, low, high).

    Up to 64 quantiles for each number of dimensions, in order; one that holds many rows has
    several groups, dealt by key.  Groups are numbered from 0 for each number of dimensions.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.percentile_approx(by, [i / 64 for i in range(1, 64)], 10000).alias("cuts"))
    quantile = F.size(F.filter("cuts", lambda c: c < F.col(by)))
    merged = F.when(F.col("n") <= 64 * size, F.floor(quantile * F.ceil(F.col("n") / size) / 64)).otherwise(quantile)
    placed = rows.join(F.broadcast(sizes), "dims").withColumn("quantile", merged.cast("int")).drop("n", "cuts")
    held = placed.groupBy("dims", "quantile").agg(F.count("*").alias("held"), F.min(by).alias("low"), F.max(by).alias("high")).collect()  # 64 rows for each number of dimensions
    total: dict[int, int] = {}
    groups = []
    for r in sorted(held):
        parts = -(-r["held"] // size)
        groups.append((r["dims"], r["quantile"], total.get(r["dims"], 0), parts, r["low"], r["high"]))
        total[r["dims"]] = total.get(r["dims"], 0) + parts
    places = spark.createDataFrame([g[:4] for g in groups], "dims int, quantile int, first long, parts long")
    return placed.join(F.broadcast(places), ["dims", "quantile"]).withColumn(name, F.col("first") + F.pmod("key", F.col("parts"))).drop("first", "parts"), groups


def reached(blocks: list[tuple], buckets: list[tuple]) -> list[tuple]:
    """(dims, quantile, bucket, last) of the quantiles of needed lengths that meet a bucket: all from ``bucket`` to ``last``.

    Buckets are numbered by rising length, so those that hold a vector of a length are the last ones.
    """
    out = []
    for dims, quantile, _, _, needed, _ in blocks:
        firsts = [first for d, _, first, _, _, norm2 in buckets if d == dims and norm2**0.5 * (1 + SLACK) >= needed]
        if firsts:
            out.append((dims, quantile, min(firsts), max(first + parts - 1 for d, _, first, parts, _, _ in buckets if d == dims)))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, by double precision where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


class Bucket:
    """Vectors ordered by falling length, with every coordinate of the unit vectors in order."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.wide = matrix.astype(np.float64)
        self.norms = np.sqrt((self.wide**2).sum(axis=1))
        unit = self.wide / np.maximum(self.norms, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, query: np.ndarray, threshold: int | None) -> np.ndarray:
        """Places that may reach ``threshold`` (none given: all)."""
        norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        if threshold is None or threshold <= 0 or norm == 0:
            everything = threshold is None or threshold <= 0
            return np.arange(len(self.ids)) if everything else np.zeros(0, np.int64)
        longest = float(self.norms[0])
        local = threshold / (norm * longest) * (1 - SLACK) if longest else 2.0
        if local > 1:
            return np.zeros(0, np.int64)
        reach = int(np.searchsorted(-self.norms, -threshold / norm * (1 - SLACK), "right"))
        if local < COORDINATE:
            return np.arange(reach)
        unit, angle = query / norm, np.arccos(local)
        counts = np.zeros(len(self.ids), np.int8)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for f in focus:
            at = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, at + angle)) - SLACK, np.cos(max(0.0, at - angle)) + SLACK
            a, b = np.searchsorted(self.sorted[:, f], low, "left"), np.searchsorted(self.sorted[:, f], high, "right")
            counts[self.order[a:b, f]] += 1
        return np.flatnonzero(counts[:reach] == len(focus))


def top_k(vectors: DataFrame, is_query, vector: str = "embedding", vec_id: str = "vec_id", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query with the other rows.

    ``is_query`` is a condition on ``vectors``' id column.  Fewer rows come back where fewer
    vectors have the query's number of dimensions.  Ties go to the smaller id.  A query's own
    row is left out by its id, so rows that repeat an id are not found for it.  Rows of equal
    id and vector are one query, but candidates each for itself; rows that share an id and
    differ are queries of their own, each with its k rows under that id.  Vectors that are
    null or hold null or non-finite components take no part.
    """
    spark = vectors.sparkSession
    rows = stored(quantized(vectors, vector, vec_id, scale))
    queries = rows.where(is_query(F.col("id")))
    counts = {r["dims"]: (r["n"], r["all"]) for r in rows.groupBy("dims").agg(F.count(F.when(is_query(F.col("id")), 1)).alias("n"), F.count("*").alias("all")).collect() if r["n"]}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def of_dims(numbers: dict):
        return F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))[F.col("dims")]

    # Starting thresholds come from a bounded sample, copied to each block of queries; they only prune, so that any sample gives exact results.
    numbers = {dims: -(-n // QUERIES) for dims, (n, _) in counts.items()}
    block = F.pmod(F.xxhash64(F.lit(3), "key"), of_dims(numbers))
    first_blocks = pack(queries.withColumn("bucket", block), "bucket").withColumns({"known": F.lit(None).cast("array<long>"), "threshold": F.lit(None).cast("array<long>")})
    share = of_dims({dims: min(1.0, SAMPLE / n) for dims, (_, n) in counts.items()})
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("sample", F.lit(0).cast("long"))
    copied = pack(sample, "sample").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), of_dims(numbers).cast("long") - 1)))
    ranked = meet(copied, first_blocks, sum(numbers.values()), k)
    thresholds = ranked.groupBy("key").agg(F.min("score").alias("threshold"), F.count("*").alias("found")).where(F.col("found") == k).drop("found")
    needed = F.when(F.col("threshold") > 0, F.least(F.lit(1e300), F.coalesce(F.try_divide(F.col("threshold").cast("double"), F.sqrt("norm2")), F.lit(1e300)) * (1 - SLACK))).otherwise(0.0)
    asking = stored(queries.join(thresholds, "key", "left").withColumn("needed", needed))

    placed, buckets = dealt(rows, "norm2", BUCKET, "bucket")
    in_blocks, blocks = dealt(asking, "needed", QUERIES, "block")
    meetings = reached(blocks, buckets)
    if not meetings:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = F.array_sort(F.collect_list(F.struct("key", "threshold")))
    known = in_blocks.groupBy("dims", "block").agg(F.max("quantile").alias("quantile"), F.filter(lists, lambda t: t["threshold"].isNotNull()).alias("t"))
    known = known.select("dims", "block", "quantile", F.col("t.key").alias("known"), F.col("t.threshold").alias("threshold"))
    reach = spark.createDataFrame(meetings, "dims int, quantile int, bucket long, last long")  # 64 rows for each number of dimensions
    sent = pack(in_blocks, "block").join(known, ["dims", "block"]).join(F.broadcast(reach), ["dims", "quantile"])
    sent = sent.withColumn("bucket", F.explode(F.sequence("bucket", "last")))
    return meet(pack(placed, "bucket"), sent, sum(parts for _, _, _, parts, _, _ in buckets), k).select("query_id", "rank", "vec_id", "score")


def meet(buckets: DataFrame, blocks: DataFrame, number: int, k: int) -> DataFrame:
    """(key, query_id, rank, vec_id, score): the k best of each query among the buckets that its block is sent to.

    Each of the ``number`` buckets is read once; the blocks for it follow in the same task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, bytes, bytes, bytes] | None = None
        bucket: Bucket | None = None
        for batch in batches:
            for at in range(batch.num_rows):  # a row holds a whole bucket or block
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                group = row["dims"], row["bucket"]
                if not row["asks"]:
                    held, bucket = (group, row["ids"], row["matrix"], row["copies"]), None
                    continue
                if held is None or held[0] != group:
                    continue  # a part that no row was dealt to
                if bucket is None:
                    bucket, copies = Bucket(*unpacked(held[1], held[2], row["dims"])), np.frombuffer(held[3], np.int64)
                numbers, matrix = unpacked(row["ids"], row["matrix"], row["dims"])
                keys = np.frombuffer(row["keys"], np.int64)
                known = dict(zip(row["known"] or [], row["threshold"] or [], strict=True))
                out: list[list[int]] = [[], [], [], [], []]
                for key, own, query in zip(keys.tolist(), numbers.tolist(), matrix, strict=True):
                    places = bucket.candidates(query, known.get(key))
                    places = places[bucket.ids[places] != own]
                    if not len(places):
                        continue
                    scores = products(query[None], bucket.matrix if len(places) == len(bucket.ids) else bucket.matrix[places])[0]
                    chosen = best(scores, bucket.ids[places], k)
                    for column, values in zip(out, ([key] * len(chosen), [own] * len(chosen), bucket.ids[places[chosen]].tolist(), scores[chosen].tolist(), copies[places[chosen]].tolist()), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "query_id", "vec_id", "score", "copies"])

    tasks = max(int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number // BUCKETS_PER_TASK))
    columns = ["dims", "bucket", "ids", "keys", "copies", "matrix"]
    none = F.lit(None).cast("array<long>")
    rows = buckets.select(*columns, none.alias("known"), none.alias("threshold"), F.lit(False).alias("asks"))
    rows = rows.unionByName(blocks.select(*columns, "known", "threshold", F.lit(True).alias("asks")))
    found = rows.repartition(tasks, "dims", "bucket").sortWithinPartitions("dims", "bucket", "asks").mapInArrow(task, "key long, query_id long, vec_id long, score long, copies long")
    one_by_one = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    order = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    return one_by_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("key", "query_id", "rank", "vec_id", "score")
