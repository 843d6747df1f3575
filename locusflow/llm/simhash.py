"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight bytes, each at its position.  Two fingerprints that differ
in at most d bits differ in at most d bytes, so they share at least 8 - d positional bytes:
the guaranteed minimum of matches.  Sets of two or three positions are chosen such that any
8 - d positions include one of them; an index on those sets of positional bytes
therefore brings together all that can link.  Within a posting list the shared positional
bytes of each two fingerprints are tallied, those below the minimum are dropped, and the
rest are verified by their differing bits.

Only distinct fingerprints are indexed.  A long posting list is split into parts, and each
two parts meet in a task of their own.  A posting list yields no pairs but the links of a
spanning forest, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, kept_and_text, sliced
from .graph import components

#: Fingerprints of a posting list that meet in one task.
PART = 2048
#: Distinct fingerprints from which keys have three bytes: lists of two bytes would grow too long.
MANY = 1 << 20
#: Posting lists up to this size are compared many at a time.
SHORT = 32
SEED = 42


def position_sets(distance: int, size: int = 2) -> list[tuple[int, ...]]:
    """Sets of ``size`` (2 or 3) byte positions such that any 8 - ``distance`` positions hold one of them."""
    kept = 8 - distance
    if kept < size or size not in (2, 3):
        raise ValueError(f"{kept} equal bytes do not make keys of {size}")
    parts = (kept - 1) // (size - 1)  # that many groups, so that some group has ``size`` of the positions
    groups = [list(range(8))[g::parts] for g in range(parts)]
    if size == 3 and kept == 4:
        # Three groups in a circle: three of a group, or two of one and one of the next.
        groups = [list(range(8))[g::3] for g in range(3)]
        turning = [(*pair, one) for g in range(3) for pair in combinations(groups[g], 2) for one in groups[(g + 1) % 3]]
        return [c for g in groups for c in combinations(g, 3)] + turning
    return [c for g in groups for c in combinations(g, size)]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Big-endian XXH64 digests (n, 8) of all shingles of ``words`` words, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(found)
    if len(found) <= words:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        digest = xxhash.xxh64_digest
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = [0, *(ends[: -words] + 1).tolist()]
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])
    return np.frombuffer(digests, np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, words: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: zero."""
    hashes = shingle_hashes(text or "", words)
    total, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)], axis=1)
        rows = len(bits) // 128 * 128  # byte sums of 128 rows at a time stay in small integers
        counts += np.add.reduce(bits[:rows].reshape(-1, 128, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[rows:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def with_fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 4) -> DataFrame:
    """``keep`` and ``bits``, the fingerprint as a signed long (null text: zero)."""
    rows, names, schema = kept_and_text(docs, keep, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            bits = np.array([fingerprint(t.as_py(), words) for t in batch.column(text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(bits)], names=[*names, "bits"])

    return rows.mapInArrow(task, f"{schema}, bits long")


def spanning_links(left: np.ndarray, right: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two parts of a posting list (or within one).

    Each fingerprint is compared with a whole part at once; the tally of shared positional
    bytes is the count filter before the differing bits are counted.
    """
    same = left is right
    label = np.arange(len(left) + (0 if same else len(right)))  # of the nodes: left, then right
    shift = 0 if same else len(left)
    out, step = [], max(1, (1 << 20) // max(len(right), 1))
    for at in range(0, len(left), step):
        block = left[at : at + step]
        close = shared_bytes(block[:, None], right[None, :]) >= 8 - distance
        rows, columns = np.nonzero(close)
        close[rows, columns] = np.bitwise_count(block[rows] ^ right[columns]) <= distance
        for i in np.flatnonzero(close.any(axis=1)):
            linked = np.flatnonzero(close[i]) + shift
            others, where = np.unique(label[linked], return_index=True)
            for other, j in zip(others, linked[where], strict=True):
                if other != label[at + i]:
                    label[label == other] = label[at + i]
                    out.append((int(block[i]), int(right[j - shift])))
    return out


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of the positions at which fingerprints have the same byte."""
    differing = a ^ b
    tally = np.zeros(differing.shape, np.uint8)
    for p in range(8):
        tally += (differing & np.uint64(0xFF << 8 * p)) == 0
    return tally


def short_list_links(bits: np.ndarray, group: np.ndarray, longest: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within many short posting lists (ordered by ``group``) at once."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lag in range(1, longest):
        at = np.flatnonzero(group[lag:] == group[:-lag])
        at = at[shared_bytes(bits[at], bits[at + lag]) >= 8 - distance]
        at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= distance]
        a.append(bits[at])
        b.append(bits[at + lag])
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(prints: DataFrame, distance: int = 4, key_bytes: int = 2) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``bits`` at ``distance`` or fewer differing bits.

    Keys of three bytes make more but far shorter posting lists than keys of two; the links
    connect the same fingerprints.
    """
    sets, key = position_sets(distance, key_bytes), ["list", "value", "i", "j"]

    def byte(p: int):
        return F.shiftrightunsigned("bits", 8 * (7 - p)).bitwiseAND(F.lit(255))

    def value(positions: tuple[int, ...]):
        out = byte(positions[0])
        for p in positions[1:]:
            out = out * 256 + byte(p)
        return out.cast("int").alias("value")

    keys = F.array(*(F.struct(F.lit(n).alias("list"), value(positions)) for n, positions in enumerate(sets)))
    index = prints.select("bits", F.inline(keys))
    sizes = index.groupBy("list", "value").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / PART).cast("int")
    postings = index.join(sizes, ["list", "value"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "own").alias("i"), F.greatest(i, "own").alias("j")))
    dealt = postings.withColumn("own", own).select("list", "value", "own", "bits", F.inline(others))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), np.int64)  # list, value, i, j, own, bits of the last posting list so far
        for batch in batches:
            new = np.array([batch.column(c).to_numpy().astype(np.int64) for c in (*key, "own", "bits")])
            held = np.concatenate([held, new], axis=1)
            change = np.flatnonzero((held[:4, 1:] != held[:4, :-1]).any(axis=0)) + 1
            if len(change):
                yield from links_of(held[:, : change[-1]], change[:-1])
                held = held[:, change[-1] :]
        if held.shape[1]:
            yield from links_of(held, np.flatnonzero((held[:4, 1:] != held[:4, :-1]).any(axis=0)) + 1)

    def links_of(rows: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.append(starts, rows.shape[1]))
        bits = rows[5].copy().view(np.uint64)
        group = np.repeat(np.arange(len(sizes)), sizes)
        short = (sizes <= SHORT)[group]
        if short.any():
            yield links(*short_list_links(bits[short], group[short], int(sizes[sizes <= SHORT].max()), distance))
        for at in np.flatnonzero(sizes > SHORT):
            part = slice(starts[at], starts[at] + sizes[at])
            (i, j), own, own_bits = rows[2:4, starts[at]], rows[4, part], bits[part]
            left = own_bits[own == i]
            found = spanning_links(left, left if i == j else own_bits[own == j], distance)
            yield links([x for x, _ in found], [y for _, y in found])

    def links(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(task, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, ``keep``, bits, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    Texts without words have fingerprint zero and link like others; a null text is such
    a text.  A row with a null id gets the component of its fingerprint, whose name is
    null only if no row of it has an id.  ``keep`` must not hold ``doc_id``, bits or
    component_id; other columns of ``docs`` may have any name.
    """
    prints = checkpointed(with_fingerprints(docs, text, (doc_id, *keep), words))  # used several times
    distinct = prints.groupBy("bits").agg(F.min(doc_id).alias("least"))
    distinct = checkpointed(distinct)
    long_lists = distance < 6 and distinct.count() > MANY
    linked = components(fingerprint_links(distinct, distance, 3 if long_lists else 2))
    # Tables that are kept meet in plain exchanges, so that a large class is split.
    named = checkpointed(distinct.join(linked, distinct["bits"] == linked["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("group")))
    least = checkpointed(named.groupBy("group").agg(F.min("least").alias("component_id")))
    return prints.join(named.select("bits", "group").join(least, "group").select("bits", "group", "component_id"), "bits")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **parameters) -> DataFrame:
    """One row of ``docs`` of each class: the one with the smallest id (rows without an id come last).

    Texts move once: the choice is made on ids and hashes, and equal rows meet at the join.
    """
    columns = docs.columns
    keyed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(1), "text", "id")})
    classes = near_duplicates(keyed.select("id", "text", "k1", "k2"), doc_id="id", keep=("k1", "k2"), **parameters)
    chosen = classes.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first"))
    joined = keyed.join(chosen.select("first.k1", "first.k2").distinct(), ["k1", "k2"])
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    return joined.withColumn("place", first).where("place = 1").select(*(F.col("row")[c].alias(c) for c in columns))
