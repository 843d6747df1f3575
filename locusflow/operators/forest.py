"""A random forest for two classes that grows in tasks, for tables whose forest would not fit in the driver.

Features are put in at most 32 bins.  Nodes with many rows are split level by level from
counts that all tasks add up; a subtree of at most ``LARGEST`` rows is then grown, and the
rows to be scored sent down in it, in one task.  The driver holds the first splits only, at
most about two for each ``LARGEST`` rows of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
LARGEST = 1 << 16
#: Nodes whose counts are in memory at once.
SLAB = 4096
#: Chances of at most 0, 1, 2, ... copies of a row in a tree's sample with replacement.
COPIES = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def copies(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return np.searchsorted(COPIES, (mixed(keys, seed * 1_000_003 + tree + 1) >> np.uint64(11)) / 2.0**53, "right")


def subsets(nodes: np.ndarray, tree: int, seed: int, width: int) -> np.ndarray:
    """The features that each node may split by: as many as the square root of all."""
    ranks = mixed(nodes[:, None] * np.int64(width) + np.arange(width), (seed + 1) * 7_000_003 + tree)
    return np.argsort(ranks, axis=1, kind="stable")[:, : max(1, int(np.ceil(np.sqrt(width))))]


def counted(at: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Copies by node, its features, bin and class."""
    m, k = features.shape
    out = np.empty((m, k, BINS, 2))
    for s in range(k):
        cell = (at * BINS + x[np.arange(len(at)), features[at, s]]) * 2 + y
        out[:, s] = np.bincount(cell, n, m * BINS * 2).reshape(m, BINS, 2)
    return out


def best(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: the number of the feature, the last bin on the left and the gain in Gini impurity times weight (0: none)."""
    left = np.cumsum(counts * weights, axis=2)
    total = left[:, :, -1:]
    right = total - left

    def impurity(c):  # times weight
        return np.divide(2 * c[..., 0] * c[..., 1], c.sum(-1), out=np.zeros(c.shape[:-1]), where=c.sum(-1) > 0)

    gain = np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), impurity(total) - impurity(left) - impurity(right), 0).reshape(len(counts), -1)
    at = gain.argmax(1)
    found = gain[np.arange(len(at)), at]
    return at // BINS, at % BINS, np.where(found > 1e-12 * total[:, 0].sum((1, 2)), found, 0)


def unpacked(a: pd.Series, b: pd.Series) -> np.ndarray:
    return np.stack([a.to_numpy(np.int64), b.to_numpy(np.int64)], 1).view(np.uint8)


def descended(x: np.ndarray, splits: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node of each row below the sorted ``splits`` (nodes, features, cuts); a feature of -1 is a leaf."""
    ids, features, cuts = splits
    node, moving = np.ones(len(x), np.int64), np.arange(len(x))
    while len(moving) and len(ids):
        at = np.minimum(np.searchsorted(ids, node[moving]), len(ids) - 1)
        go = (ids[at] == node[moving]) & (features[at] >= 0)
        moving, at = moving[go], at[go]
        node[moving] = node[moving] * 2 + (x[moving, features[at]] > cuts[at])
    return node


def grown(x: np.ndarray, y: np.ndarray, n: np.ndarray, tree: int, root: int, weights: np.ndarray, depth: int, seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The chance of class 1 in the leaf of each row, and the gain by feature, of the subtree below ``root``; rows of no copies are only sent down."""
    chance, gains = np.zeros(len(x)), np.zeros(width)
    node, rows = np.full(len(x), root, np.int64), np.arange(len(x))
    for level in range(root.bit_length() - 1, depth + 1):
        ids, at = np.unique(node[rows], return_inverse=True)
        totals = np.bincount(at * 2 + y[rows], n[rows], len(ids) * 2).reshape(-1, 2) * weights
        chance[rows] = (totals[:, 1] / totals.sum(1))[at]
        if level == depth:
            break
        feature, cut = np.full(len(ids), -1), np.zeros(len(ids), int)
        mixed_nodes = np.flatnonzero(totals.min(1) > 0)
        for begin in range(0, len(mixed_nodes), SLAB):
            some = mixed_nodes[begin : begin + SLAB]
            place = np.full(len(ids), -1)
            place[some] = np.arange(len(some))
            here = rows[place[at] >= 0]
            features = subsets(ids[some], tree, seed, width)
            slot, cut[some], gain = best(counted(place[at][place[at] >= 0], x[here], y[here], n[here], features), weights)
            feature[some] = np.where(gain > 0, features[np.arange(len(some)), slot], -1)
            np.add.at(gains, features[np.arange(len(some)), slot], gain)
        go = feature[at] >= 0
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        node[rows] = node[rows] * 2 + (x[rows, feature[at]] > cut[at])
    return chance, gains


def forest(rows: DataFrame, features: list[str], key: str = "record_id", label: str = "label", held: str = "held", trees: int = 100, depth: int = 25, seed: int = 1, largest: int = LARGEST) -> DataFrame:
    """(key, tree, feature, value): the chance of class 1 that each tree gives to a ``held`` row, and the gain of each feature in a tree (key null).

    The rows that are not held are learned from, with weights that make both classes count
    the same; rows with a feature that is null or NaN are left out.  ``rows`` are read several times.
    """
    from ..sources.text import shared_path

    spark, width = rows.sparkSession, len(features)
    if width > 16:
        raise ValueError("at most 16 features")
    numbers = rows.select(key, label, held, *(F.col(f).cast("double").alias(f) for f in features)).dropna(subset=features)
    learned = numbers.where(~F.col(held))
    sizes = {r[0]: r["count"] for r in learned.groupBy(label).count().collect()}  # two rows
    weights = np.array([sum(sizes.values()) / 2 / sizes[c] if c in sizes else 1.0 for c in (0, 1)])
    cuts = [np.unique(q)[: BINS - 1] for q in learned.approxQuantile(features, [k / BINS for k in range(1, BINS)], 0.001)] if sizes else [np.zeros(0)] * width

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), 16), np.uint8)
            for f, name in enumerate(features):
                x[:, f] = np.searchsorted(cuts[f], batch[name].to_numpy())
            both = x.view(np.int64)
            yield pd.DataFrame({"name": batch[key].where(batch[held], None), "hash": batch["hash"], "a": both[:, 0], "b": both[:, 1], "y": batch[label].where(~batch[held], 0).astype("int32"), "held": batch[held]})

    path = shared_path(spark)
    numbers.withColumn("hash", F.xxhash64(key)).mapInPandas(packed, "name string, hash long, a long, b long, y int, held boolean").write.parquet(path)
    table = spark.read.schema("name string, hash long, a long, b long, y int, held boolean").parquet(path)
    splits = {t: (np.zeros(0, np.int64),) * 3 for t in range(trees)}
    leaves: dict[int, dict[int, float]] = {t: {} for t in range(trees)}
    first = []
    open_nodes = {t: [1] for t in range(trees)} if sum(sizes.values()) > largest else {}
    while open_nodes:

        def counts(batches: Iterator[pd.DataFrame], splits=splits, open_nodes=open_nodes) -> Iterator[pd.DataFrame]:
            sums = {}
            for batch in batches:
                x, y, hashes = unpacked(batch["a"], batch["b"]), batch["y"].to_numpy(), batch["hash"].to_numpy()
                for t, ids in open_nodes.items():
                    n, ids = copies(hashes, t, seed), np.array(ids)
                    node = descended(x, splits[t])
                    at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                    use = (ids[at] == node) & (n > 0)
                    sums[t] = sums.get(t, 0) + counted(at[use], x[use], y[use], n[use], subsets(ids, t, seed, width))
            for t, c in sums.items():
                yield pd.DataFrame({"tree": t, "node": open_nodes[t], "counts": [v.ravel().tolist() for v in c]})

        def chosen(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            c = np.sum([np.array(v) for v in parts["counts"]], axis=0).reshape(1, -1, BINS, 2)
            slot, cut, gain = best(c, weights)
            both = c[0, 0].sum(0)
            size = c[0, slot[0], : cut[0] + 1].sum()
            feature = subsets(np.array([key[1]]), int(key[0]), seed, width)[0, slot[0]] if gain[0] > 0 else -1
            return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "feature": [feature], "cut": cut, "gain": gain, "chance": [(both * weights)[1] / (both * weights).sum()], "l": [size], "r": [both.sum() - size]})

        found = table.where("not held").mapInPandas(counts, "tree int, node long, counts array<double>").groupBy("tree", "node").applyInPandas(chosen, "tree int, node long, feature int, cut int, gain double, chance double, l double, r double").collect()
        open_nodes, news = {}, {}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            news.setdefault(r["tree"], []).append((r["node"], r["feature"], r["cut"]))
            if r["feature"] < 0:
                leaves[r["tree"]][r["node"]] = r["chance"]
                continue
            first.append((None, r["tree"], r["feature"], r["gain"]))
            for child, size in ((2 * r["node"], r["l"]), (2 * r["node"] + 1, r["r"])):
                if size > largest and child.bit_length() <= depth:
                    open_nodes.setdefault(r["tree"], []).append(child)
        for t, new in news.items():
            joined = [np.concatenate([old, add]) for old, add in zip(splits[t], np.array(new).T, strict=True)]
            splits[t] = tuple(c[np.argsort(joined[0])] for c in joined)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, is_held = unpacked(batch["a"], batch["b"]), batch["held"].to_numpy()
            for t in range(trees):
                n = np.where(is_held, 0, copies(batch["hash"].to_numpy(), t, seed))
                out = pd.DataFrame({"name": batch["name"], "tree": t, "node": descended(x, splits[t]), "a": batch["a"], "b": batch["b"], "y": batch["y"], "n": n, "chance": np.nan})[is_held | (n > 0)]
                out["chance"] = out["node"].map(leaves[t]).astype(float)
                yield out[out["chance"].isna() | (out["n"] == 0)]

    def subtree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree, root = int(key[0]), int(key[1])
        n = group["n"].to_numpy(np.int64)
        chance, gains = grown(unpacked(group["a"], group["b"]), group["y"].to_numpy(np.int64), n, tree, root, weights, depth, seed, width) if n.any() else (np.full(len(group), 0.5), np.zeros(width))
        chance = np.where(group["chance"].isna(), chance, group["chance"])
        votes = pd.DataFrame({"name": group["name"], "tree": tree, "feature": -1, "value": chance})[n == 0]
        used = np.flatnonzero(gains)
        return pd.concat([votes, pd.DataFrame({"name": None, "tree": tree, "feature": used, "value": gains[used]})]) if len(used) else votes

    kind = "name string, tree int, feature int, value double"
    grown_rows = table.mapInPandas(dealt, "name string, tree int, node long, a long, b long, y int, n int, chance double").groupBy("tree", "node").applyInPandas(subtree, kind)
    return grown_rows.unionByName(spark.createDataFrame(first, kind)).withColumnRenamed("name", key)


def importances(found: DataFrame) -> DataFrame:
    """(feature, importance) of :func:`forest`'s rows: gains as shares of each tree's, then of all trees; features of none are left out."""
    gains = found.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("value").alias("gain"))
    shares = gains.join(gains.groupBy("tree").agg(F.sum("gain").alias("all")), "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("all")).alias("share"))
    return shares.join(F.broadcast(shares.agg(F.sum("share").alias("every")))).select("feature", (F.col("share") / F.col("every")).alias("importance"))


def scores(found: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, chance) of :func:`forest`'s rows: the mean over all trees."""
    return found.where("feature < 0").groupBy(key).agg(F.avg("value").alias("chance"))
