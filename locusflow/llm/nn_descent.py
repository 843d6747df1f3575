"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a short list of its nearest known neighbours.  The first lists
come from cells of vectors on the same sides of random planes: as many tables of cells as a
pair at the threshold needs to meet with near certainty, whatever the number of vectors.
A round then joins each vector's neighbours (and those that list it) with each other: a
neighbour of a neighbour is likely a neighbour.  Lists whose entries all reach the threshold
are saturated and grow.  Rounds end when few list entries are new.  Entries that reach the
threshold are links, whose components are the classes.  Lists stay short, so a list that is
all links may lack some: classes are also compared with each other over their members with
such lists, and those that link are one class.  The links of a class are then counted without
listing its pairs: vectors near its centre all link with each other, the others are compared
in blocks.

The answer is audited in two ways.  Brute force finds the links of a sample of vectors.  Tables
with fresh planes find links independently of the answer; each is weighted by the inverse
of its chance to be found, so that the share of them that the answer has estimates the
share of all links, also where links are too rare for a sample to hold any.  If the target is
missed, the links found and more tables and rounds follow, and if that was not enough, all
vectors are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import components

LIST = 8
LONGEST_LIST = 4 * LIST
#: Vectors of a cell, on average, and of a cell or block that meet in one task.
CELL, PART = 256, 1024
#: Planes beyond those of the cells, by which a crowded cell is cut again.
FINER = 12
#: Chance that a pair at the threshold meets in some table; tables that also make lists of vectors below the threshold.
CHANCE, GRAPH = 0.995, 4
PIECE = 256
AUDITED, ENOUGH = 512, 200
#: Share of new list entries below which rounds end.
SETTLED = 0.05
ATTEMPTS = 2


def matrix_of(column: pa.Array) -> np.ndarray:
    """Unit vectors (float64) of a column of binary double vectors of one length."""
    raw = [x.as_py() for x in column]
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def groups_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one key together, from batches ordered by ``key`` (groups are bounded by their makers)."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = [held.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in key]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(change):
            whole = held.combine_chunks()
            for a, b in zip([0, *change[:-1].tolist()], change.tolist(), strict=True):
                yield whole.slice(a, b - a)
            held = whole.slice(int(change[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def pairs_schema(a: np.ndarray, b: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(cos.astype(np.float64))], names=["node", "near", "cos"])


def planes_of(count: int) -> int:
    return max(1, int(np.ceil(np.log2(max(count / CELL, 2)))))


def met(cos: np.ndarray | float, bits: int, tables: int) -> np.ndarray | float:
    """Chance that two vectors of a cosine share a cell in one of so many tables of so many planes."""
    same = (1 - np.arccos(np.clip(cos, -1, 1)) / np.pi) ** bits
    return 1 - (1 - same) ** tables


def tables_of(count: int, threshold: float, chance: float = CHANCE) -> int:
    """Tables after which a pair at the threshold has met with ``chance``."""
    return max(GRAPH, int(np.ceil(np.log(1 - chance) / np.log1p(-min(met(threshold, planes_of(count), 1), 0.999)))))


def cell_lists(nodes: DataFrame, count: int, threshold: float, first: int, tables: int, graph: int = GRAPH) -> DataFrame:
    """(node, near, cos): nearest neighbours within cells of tables ``first`` and on; after ``graph`` tables only those at the threshold.

    A crowded cell is cut by more planes, and by chance where that does not help: its
    vectors are then so much alike that lists are full of links in any part.
    """
    bits = planes_of(count)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("v"))
            for t in range(first, first + tables):
                planes = np.random.default_rng(100 + t).normal(size=(x.shape[1], bits + FINER))
                cell = ((x @ planes) > 0) @ (1 << np.arange(bits + FINER, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(np.full(len(x), t, np.int32)), pa.array(cell)], names=["id", "v", "t", "cell"])

    cells = nodes.mapInArrow(sides, "id long, v binary, t int, cell long").withColumn("coarse", F.col("cell").bitwiseAND(F.lit((1 << bits) - 1)))
    rows = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).withColumn("coarse", F.col("cell").bitwiseAND(F.lit((1 << bits) - 1)))
    size = rows.groupBy("t", "coarse").agg(F.sum("n").alias("size"))
    # A cell of over PART vectors has so many more planes, up to FINER; what is still crowded has parts.
    more = F.least(F.lit(FINER), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / PART)).cast("int")))
    fine = F.col("cell").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits) + more) - 1)
    named = rows.join(size, ["t", "coarse"]).withColumn("fine", fine)
    parts = named.groupBy("t", "coarse", "fine").agg(F.sum("n").alias("held"))
    sized = named.join(parts, ["t", "coarse", "fine"]).select("t", "cell", "fine", F.ceil(F.col("held") / PART).alias("parts"))
    split = cells.drop("coarse").join(sized, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "t"), "parts")).select("t", F.col("fine").alias("cell"), "part", "id", "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["t", "cell", "part"]):
            ids, x = group.column("id").to_numpy(), matrix_of(group.column("v"))
            if len(ids) < 2:
                continue
            cos = x @ x.T
            np.fill_diagonal(cos, -2)
            near = np.ones(len(ids), bool) if group.column("t")[0].as_py() < first + graph else (cos >= threshold).any(axis=1)
            rows = np.flatnonzero(near)
            if not len(rows):
                continue
            k = min(LIST, len(ids) - 1)
            top = np.argpartition(-cos[rows], k - 1, axis=1)[:, :k].ravel()
            rows = np.repeat(rows, k)
            found = cos[rows, top]
            if group.column("t")[0].as_py() >= first + graph:
                rows, top, found = (z[found >= threshold] for z in (rows, top, found))
            yield pairs_schema(ids[rows], ids[top], found)

    key = ["t", "cell", "part"]
    return split.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(nearest, "node long, near long, cos double")


def best_lists(found: DataFrame, threshold: float) -> DataFrame:
    """The nearest neighbours of each node; a list that is all links may be longer, up to ``LONGEST_LIST``."""
    one = found.groupBy("node", "near").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    order = Window.partitionBy("node").orderBy(F.desc("cos"), "near")
    kept = one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LONGEST_LIST)
    return kept.where((F.col("place") <= LIST) | (F.col("cos") >= threshold)).select("node", "near", "cos", "new")


def descend(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """One round: the neighbours of each node, in both directions, are compared with each other."""
    backward = lists.select(F.col("near").alias("node"), F.col("node").alias("near"), "cos", "new")
    nearest = Window.partitionBy("node").orderBy(F.desc("cos"), "near")
    backward = backward.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= LIST)
    members = lists.select("node", "near", "new").unionByName(backward.select("node", "near", "new")).groupBy("node", "near").agg(F.max("new").alias("new"))
    worst = lists.groupBy("node").agg(F.min("cos").alias("worst")).withColumnRenamed("node", "id")
    placed = members.join(nodes.join(worst, "id"), F.col("near") == F.col("id")).select("node", "near", "new", "v", "worst")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for group in groups_of(batches, ["node"]):
            ids, new = group.column("near").to_numpy(), group.column("new").to_numpy(zero_copy_only=False)
            if len(ids) < 2 or not new.any():
                continue
            x, worst = matrix_of(group.column("v")), group.column("worst").to_numpy()
            cos = x @ x.T
            useful = (new[:, None] | new[None, :]) & ((cos > worst[:, None]) | (cos >= threshold))
            np.fill_diagonal(useful, False)
            a, b = np.nonzero(useful)
            for out, part in zip(held, (ids[a], ids[b], cos[a, b]), strict=True):
                out.append(part)
            if len(held[0]) >= 500:
                yield pairs_schema(*(np.concatenate(x) for x in held))
                held = [[], [], []]
        if held[0]:
            yield pairs_schema(*(np.concatenate(x) for x in held))

    found = placed.repartition("node").sortWithinPartitions("node", "near").mapInArrow(compare, "node long, near long, cos double")
    known = lists.withColumn("new", F.lit(False))
    # A pair that is known is not new again: the minimum of both marks.
    return best_lists(known.unionByName(found.withColumn("new", F.lit(True))), threshold)


def dealt(members: DataFrame) -> DataFrame:
    """Members of each component in parts of about ``PART``, once for each pair (i, j) of parts with their own."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = members.join(sizes, "component").withColumn("parts", parts).withColumn("own", own).drop("size")
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "own").alias("i"), F.greatest(i, "own").alias("j")))
    key = ["component", "i", "j"]
    return placed.select("*", F.inline(blocks)).drop("parts").repartition(*key).sortWithinPartitions(*key, "id")


def pieces_of(members: DataFrame) -> DataFrame:
    """Members of each component in pieces of about ``PIECE``: ids and vectors, with the cone (centre, radius) that holds them."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PIECE))
    placed = members.join(sizes, "component").select("component", part.alias("part"), "id", "v")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["component", "part"]):
            ids, x = group.column("id").to_numpy(), matrix_of(group.column("v"))
            centre = x.sum(axis=0)
            length = np.sqrt((centre**2).sum())
            # Vectors that cancel out have no direction: any cone holds them.
            centre, radius = (centre / length, float(np.arccos(np.clip(x @ (centre / length), -1, 1)).max())) if length > 1e-9 else (x[0], np.pi)
            middle = x[np.argmax(x @ centre)]
            values = [[group.column("component")[0].as_py()], [int(ids.min())], [centre.tobytes()], [radius], [middle.tobytes()], [ids.tolist()], [x.tobytes()]]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["class", "id", "centre", "radius", "middle", "ids", "x"])

    key = ["component", "part"]
    return placed.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(gathered, "class long, id long, centre binary, radius double, middle binary, ids array<long>, x binary")


def bridges(members: DataFrame, threshold: float) -> DataFrame:
    """(node, near): classes that link with each other, by their names, for (component, id, v).

    Two pieces can only link where their cones are near enough.  Classes of which two middle
    vectors link are joined first; pieces of classes that are still apart are compared whole.
    """
    pieces = checkpointed(pieces_of(members))
    cones = pieces.select(F.lit(0).alias("component"), "id", "class", "centre", "radius", "middle")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["component", "i", "j"]):
            own, ids, names, radius = (group.column(c).to_numpy() for c in ("own", "id", "class", "radius"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            centre, middle = matrix_of(group.column("centre")), matrix_of(group.column("middle"))
            apart = np.arccos(np.clip(centre[left] @ centre[right].T, -1, 1))
            reach = np.arccos(np.clip(threshold, -1, 1)) + radius[left][:, None] + radius[right][None, :] + 1e-6
            can = (apart <= reach) & (names[left][:, None] != names[right][None, :])
            if i == j:
                can = np.triu(can)
            a, b = np.nonzero(can)
            a, b, linked = left[a], right[b], (middle[left] @ middle[right].T)[a, b] >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], names[a], names[b], linked)], names=["a", "b", "node", "near", "linked"])

    pairs = checkpointed(dealt(cones).mapInArrow(near, "a long, b long, node long, near long, linked boolean"))
    joined = pairs.where("linked").select("node", "near").distinct()
    names = checkpointed(components(joined, "node", "near"))
    root = [names.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root")) for end in ("node", "near")]
    apart = pairs.where("not linked").join(root[0], "node", "left").join(root[1], "near", "left").where("coalesce(node_root, node) != coalesce(near_root, near)")
    sides = [pieces.select(F.col("id").alias(end), F.col("x").alias(f"x{end}"), F.size("ids").alias(f"n{end}")) for end in "ab"]
    whole = apart.select("a", "b", "node", "near").join(sides[0], "a").join(sides[1], "b")

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for xa, xb, na, nb in zip(*(batch.column(c) for c in ("xa", "xb", "na", "nb")), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.float64).reshape(n.as_py(), -1) for x, n in ((xa, na), (xb, nb)))
                keep.append(bool(((a @ b.T) >= threshold).any()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("near")], names=["node", "near"]).filter(pa.array(keep, pa.bool_()))

    return joined.unionByName(whole.mapInArrow(linking, "node long, near long").distinct())


def centres_of(members: DataFrame) -> DataFrame:
    """(component, centre): the direction of the sum of each component's vectors; each task first adds up its own."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                name, x = batch.column("component").to_numpy(), matrix_of(batch.column("v"))
                by = np.argsort(name, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(name[by]) != 0))
                sums = np.add.reduceat(x[by], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(name[by][first]), pa.array([r.tobytes() for r in sums], pa.binary())], names=["component", "centre"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["component"]):
            total = np.frombuffer(b"".join(x.as_py() for x in group.column("centre")), np.float64).reshape(group.num_rows, -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([group.column("component").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["component", "centre"])

    kind = "component long, centre binary"
    return members.select("component", "v").mapInArrow(summed, kind).repartition("component").sortWithinPartitions("component", "centre").mapInArrow(added, kind)


def with_core(members: DataFrame, threshold: float) -> DataFrame:
    """``members`` with ``core``: so near to the centre of its component that it links with all others that are."""
    half = np.cos((np.arccos(np.clip(threshold, -1, 1)) - 1e-6) / 2)
    joined = members.join(checkpointed(centres_of(members)), "component")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, centre = matrix_of(batch.column("v")), np.frombuffer(b"".join(c.as_py() for c in batch.column("centre")), np.float64).reshape(batch.num_rows, -1)
            length = np.maximum(np.sqrt((centre**2).sum(axis=1)), 1e-300)
            core = (x * centre).sum(axis=1) >= half * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "id", "v", "copies")), pa.array(core)], names=["component", "id", "v", "copies", "core"])

    return joined.select("component", "id", "v", "copies", "centre").mapInArrow(mark, "component long, id long, v binary, copies long, core boolean")


def class_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, n): other vectors of its component that each one links with, copies counted.

    Vectors of a component's core all link with each other, which needs no comparison; the
    others are compared with all of their component in blocks.
    """
    marked = checkpointed(with_core(members, threshold))
    sizes = marked.groupBy("component").agg(F.count_if("core").alias("inner"), F.count_if(~F.col("core")).alias("outer"), F.sum(F.when(F.col("core"), F.col("copies"))).alias("held"))
    inner, outer = (F.ceil(F.col(c) / PART).cast("int") for c in ("inner", "outer"))
    placed = marked.join(checkpointed(sizes), "component").withColumns({"p": inner, "q": outer})
    own = F.when(F.col("core"), F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.col("q"))).cast("int")
    # Core parts come first; one of them meets the parts of the others only.
    others = F.when(F.col("q") > 0, F.sequence(F.when(F.col("core"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(others, lambda i: F.struct(F.least(i, "own").alias("i"), F.greatest(i, "own").alias("j")))
    key = ["component", "i", "j"]
    pairs = placed.withColumn("own", own).select("component", "id", "v", "copies", "own", F.inline(blocks)).repartition(*key).sortWithinPartitions(*key, "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, key):
            own, ids, copies = (group.column(c).to_numpy() for c in ("own", "id", "copies"))
            x, i, j = matrix_of(group.column("v")), group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked = (x[left] @ x[right].T) >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
                yield counts(ids[left], linked @ copies[right])
            else:
                yield counts(np.concatenate([ids[left], ids[right]]), np.concatenate([linked @ copies[right], copies[left] @ linked]))

    def counts(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["id", "n"])

    compared = pairs.mapInArrow(count, "id long, n long")
    known = placed.where("core").select("id", (F.col("held") - F.col("copies")).alias("n"))
    return compared.unionByName(known).groupBy("id").agg(F.sum("n").alias("n"))


def sampled_recall(answer: DataFrame, nodes: DataFrame, count: int, threshold: float) -> tuple[float, int]:
    """Share of the links of a bounded sample of vectors, found by brute force, that ``answer`` (id, component, n) has, and their number.

    ``n`` counts every link inside a class, so it is also the share of linked pairs that are in
    one class.  The lower of the share of all links and the mean share of a vector counts:
    neither large nor small groups hide what the others lack.
    """
    share = min(1.0, AUDITED / max(count, 1))
    sample = nodes.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * AUDITED).select("id", "v").collect()
    if not sample:
        return 1.0, 0
    ids = np.array([r["id"] for r in sample])
    queries = matrix_of(pa.array([bytes(r["v"]) for r in sample], pa.binary()))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = (queries @ matrix_of(batch.column("v")).T) >= threshold
            hits &= ids[:, None] != batch.column("id").to_numpy()[None, :]
            n = hits @ batch.column("copies").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["node", "n"])

    true = nodes.mapInArrow(links, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")
    have = F.least("n", F.coalesce("have", F.lit(0)))
    found = true.join(answer.select(F.col("id").alias("node"), F.col("n").alias("have")), "node", "left")
    row = found.agg(F.sum("n").alias("n"), F.sum(have).alias("have"), F.avg(have / F.col("n")).alias("mean")).first()
    return (min(row["have"] / row["n"], row["mean"]), row["n"]) if row["n"] else (1.0, 0)


def missed_links(answer: DataFrame, found: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, near, cos, weight, missed) of independently found links: the inverse of their chance, and whether ``answer`` has them in two classes."""
    ends = [answer.select(F.col("id").alias(end), F.col("component").alias(f"{end}_class")) for end in ("node", "near")]
    joined = found.join(ends[0], "node", "left").join(ends[1], "near", "left")
    same = F.pow(1 - F.acos(F.least("cos", F.lit(1.0))) / np.pi, F.lit(bits))
    weight = 1 / (1 - F.pow(1 - same, F.lit(tables)))
    missed = ~F.coalesce(F.col("node_class") == F.col("near_class"), F.lit(False))
    return joined.select("node", "near", "cos", weight.alias("weight"), missed.alias("missed"))


def near_duplicates(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = 0.9, recall: float = 0.99, rounds: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link at a cosine (double precision) of ``threshold`` or more.  Vectors that are
    null, zero or hold null or non-finite components link with nothing and are classes of
    their own, as are vectors that no other one has the dimensions of.  Rows of equal
    vectors link with each other.  Ids are taken as unique; a null id names no class.
    """

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("x"))
    usable = F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda c: c != 0) & F.col("vec").isNotNull()
    rows = rows.select("vec", F.when(usable, F.col("x")).alias("x"))
    distinct = rows.where("x is not null").groupBy("x").agg(F.min("vec").alias("id"), F.count("*").alias("copies"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(v.as_py(), np.float64).tobytes() for v in batch.column("x")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), pa.array(x, pa.binary()), batch.column("dims")], names=["id", "copies", "v", "dims"])

    all_nodes = checkpointed(distinct.select("id", "copies", "x", F.size("x").alias("dims")).mapInArrow(packed, "id long, copies long, v binary, dims int"))
    counts = {r["dims"]: r["count"] for r in all_nodes.groupBy("dims").count().collect()}
    found = [search(all_nodes.where(F.col("dims") == dims), n, threshold, recall, rounds) for dims, n in counts.items() if n > 1]
    nodes = all_nodes.select("id", "copies")
    if found:
        classes = found[0]
        for more in found[1:]:
            classes = classes.unionByName(more)
        nodes = nodes.join(classes, "id", "left")
    else:
        nodes = nodes.withColumns({"component": F.lit(None).cast("long"), "n": F.lit(0).cast("long")})
    named = distinct.select("x", "id").join(nodes, "id").select("x", "copies", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    out = rows.join(named, "x", "left")
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias("vec_id"), F.coalesce(F.col("n") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec")).alias("kept"))


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of so few links that they connect all rows and columns that ``linked`` connects."""
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    while rows.any():
        front = np.array([np.argmax(rows)])
        rows[front] = False
        while len(front):
            reached = linked[front] & columns
            at = np.flatnonzero(reached.any(axis=0))
            kept.append((front[reached[:, at].argmax(axis=0)], at))
            columns[at] = False
            back = linked[:, at] & rows[:, None]
            front = np.flatnonzero(back.any(axis=1))
            if len(front):
                kept.append((front, at[back[front].argmax(axis=1)]))
            rows[front] = False
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, near): links that connect each class, from a comparison of all vectors in blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["component", "i", "j"]):
            own, ids, x = group.column("own").to_numpy(), group.column("id").to_numpy(), matrix_of(group.column("v"))
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked = (x[left] @ x[right].T) >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            a, b = forest(linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[a]]), pa.array(ids[right[b]])], names=["node", "near"])

    return dealt(nodes.select(F.lit(0).alias("component"), "id", "v")).mapInArrow(compare, "node long, near long")


def counted_classes(classes: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, component, n) of every vector with a link: its class, and how many vectors of it link with it, copies counted."""
    members = checkpointed(nodes.join(classes, F.col("id") == F.col("node")).select("component", "id", "v", "copies"))
    return checkpointed(members.select("id", "component").join(class_links(members, threshold), "id", "left"))


def classes_of(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of every vector that the lists or a comparison of full lists link."""
    links = lists.where(F.col("cos") >= threshold).select("node", "near")
    classes = checkpointed(components(links, "node", "near"))
    # A link that neither list has is one between two full lists.
    full = lists.groupBy("node").agg(F.min("cos").alias("worst")).where(F.col("worst") >= threshold).select("node")
    saturated = classes.join(full, "node").join(nodes, F.col("node") == F.col("id")).select("component", "id", "v")
    merged = checkpointed(components(bridges(saturated, threshold), "node", "near")).select(F.col("node").alias("component"), F.col("component").alias("root"))
    return classes.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def search(nodes: DataFrame, count: int, threshold: float, recall: float, rounds: int) -> DataFrame:
    """(id, component, n) of the vectors of one length that link with another."""
    nodes = nodes.select("id", "v", "copies")
    vectors = nodes.select("id", "v")
    tables, bits = tables_of(count, threshold), planes_of(count)
    fresh = -(-tables // 2)
    lists = checkpointed(best_lists(cell_lists(vectors, count, threshold, 0, tables).withColumn("new", F.lit(True)), threshold))
    at = tables
    for _ in range(ATTEMPTS):
        for _ in range(rounds):
            lists = checkpointed(descend(lists, vectors, threshold))
            state = lists.agg(F.count("*").alias("entries"), F.count_if("new").alias("new")).first()
            if state["new"] <= SETTLED * state["entries"]:
                break
        answer = counted_classes(classes_of(lists, nodes, threshold), nodes, threshold)
        audit = checkpointed(missed_links(answer, cell_lists(vectors, count, threshold, at, fresh, 0).distinct(), bits, fresh))
        at += fresh
        seen = audit.agg(F.count("*").alias("n"), F.sum("weight").alias("all"), F.sum(F.when(F.col("missed"), F.col("weight"))).alias("missed")).first()
        share = 1 - (seen["missed"] or 0) / seen["all"] if seen["n"] else 1.0
        sampled, n = sampled_recall(answer, nodes, count, threshold)
        lacking = bool(seen["missed"])
        if lacking:  # links that the audit found are links of the answer too
            found = audit.select("node", "near", "cos").withColumn("new", F.lit(True))
            lists = checkpointed(best_lists(lists.withColumn("new", F.lit(False)).unionByName(found), threshold))
        if share >= recall and (n < ENOUGH <= seen["n"] or sampled >= recall):
            return counted_classes(classes_of(lists, nodes, threshold), nodes, threshold) if lacking else answer
        more = cell_lists(vectors, count, threshold, at, tables, 0).withColumn("new", F.lit(True))
        at += tables
        lists = checkpointed(best_lists(lists.unionByName(more), threshold))
    return counted_classes(components(all_links(nodes, threshold), "node", "near"), nodes, threshold)
