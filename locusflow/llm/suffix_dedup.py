"""Exact removal of long repeated byte strings through suffix arrays.

A suffix array over a whole corpus cannot be held by one machine, so the bytes are
first cut so that equal strings meet:

1. Every window of ``length`` bytes is named by the smallest hash of the ``gram``-byte
   strings inside it.  Equal windows have equal names, and neighbouring windows mostly
   share one, so a document becomes a few *runs* of at most ``LONGEST_RUN`` windows each
   (name, first window, windows, BLAKE2b digest of the bytes).
2. A run whose name occurs nowhere else, nor twice in itself, holds no repeat.  The bytes
   of every other one go on, each distinct run of a name twice if it occurs twice or more:
   further copies would say no more.
3. The runs of a name are laid end to end and sorted by a two-stage suffix sort
   (``suffix_order``); windows with an adjacent common prefix of ``length`` or more are
   repeats.  A name with more bytes than ``BLOCK`` is split over many blocks.  Each block
   then hands on one window of each kind it has, in groups of up to ``CORE`` neighbours
   named by the bytes they have in common.  Where such a group meets an equal one of
   another block its windows are compared by their SHA-256 digests.
4. The repeated windows go back to the documents, where their union is removed.

Hashes that can be made to collide (names, groups) only bring strings together; sorting
and comparing bytes, or digests that cannot, say what is equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PrefixHash, mixed, row_blocks, sliced, stored, string_buffers

BLOCK = 1 << 19
#: Bytes that one comparing task takes on.
TASK = 64 << 20
LONGEST_RUN = 1 << 12
HASHER = PrefixHash(7)
GRAM = 48
CORE = 32


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, hasher: PrefixHash):
    """Runs of windows with one name: row, first byte in the row, windows, name, and whether
    the naming string occurs more than once in it, so that the run may repeat itself."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, bool))
    if len(data) < length:
        return empty
    prefix = hasher.prefix(data)
    n = len(data)
    grams = mixed((prefix[gram:] - prefix[:-gram]) * hasher.back[: n - gram + 1])
    name = window_minimum(grams, length - gram + 1)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[: n - length + 1]
    valid = np.arange(n - length + 1) + length <= offsets[1:][row]
    change = np.empty(len(name), bool)
    change[0] = True
    np.not_equal(name[1:], name[:-1], out=change[1:])
    change[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return empty
    counted = np.concatenate([[0], np.cumsum(valid)])
    windows = np.diff(np.append(counted[first], counted[-1]))
    width = length - gram + 1
    edge = np.zeros(width - 1, np.uint64)
    highest = ~window_minimum(~np.concatenate([edge, name, edge]), width)
    naming = np.flatnonzero(grams == highest)
    naming = naming[naming + gram <= offsets[1:][np.searchsorted(offsets, naming, "right") - 1]]
    owner = mixed(grams[naming] + np.searchsorted(offsets, naming, "right").astype(np.uint64))
    values, times = np.unique(owner, return_counts=True)
    inner = np.isin(mixed(name[first] + (row[first] + 1).astype(np.uint64)), values[times > 1])
    # Long runs are cut from their start on, so that copies are cut alike.
    parts = -(-windows // LONGEST_RUN)
    whole = np.repeat(np.arange(len(first)), parts)
    part = np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)
    windows = np.minimum(windows[whole] - part * LONGEST_RUN, LONGEST_RUN)
    first, inner, named = first[whole] + part * LONGEST_RUN, inner[whole], name[first[whole]]
    return row[first], first - offsets[row[first]], windows.astype(np.int32), named.view(np.int64), inner


def direct_order(text: np.ndarray, raw: bytes, smaller: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The suffixes that are smaller than their successors, in order.

    They are ordered by eight bytes, and then by doubling among themselves: suffixes that
    share ``depth`` bytes are told apart by the rank of the last such suffix that begins
    inside of what they share, which is at the same place in each of them.  Suffixes
    without one (long runs of one byte) are compared as they are.
    """
    n, direct = len(text), np.flatnonzero(smaller).astype(np.int32)
    if not len(direct):
        return direct
    head = np.ndarray(n, ">u8", raw + bytes(8), strides=(1,))[direct].astype(np.uint64)
    by = np.argsort(head)
    direct, head = direct[by], head[by]
    fresh = np.concatenate([[True], head[1:] != head[:-1]])  # differs from the one before
    rises = np.append(text[:-1] < text[1:], False)
    last = np.maximum.accumulate(np.where(rises, np.arange(n, dtype=np.int32), np.int32(-1)))
    rank, depth = np.zeros(n, np.int32), np.full(n, 8, np.int32)
    reach = (until - np.arange(n)).astype(np.int32)
    while True:
        rank[direct] = np.cumsum(fresh, dtype=np.int32)
        tied = ~fresh
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        own = direct[at]
        shared = depth[own]
        open_ = shared < reach[own]  # what is equal as far as it counts needs no order
        at, own, shared = at[open_], own[open_], shared[open_]
        if not len(at):
            break
        inside = last[np.minimum(own + (shared - 2), n - 1)]
        deeper = depth[inside] + (inside - own)
        groups = np.flatnonzero(fresh[at])
        gains = np.logical_or.reduceat((inside > own) & (deeper > shared), groups)
        if not gains.any():
            break
        if not gains.all():
            more = np.repeat(gains, np.diff(np.append(groups, len(at))))
            at, own, inside, deeper, shared = (x[more] for x in (at, own, inside, deeper, shared))
        depth[own] = np.maximum(shared, deeper)
        key = rank[own].astype(np.int64) << 32 | rank[inside]
        by = np.argsort(key)
        direct[at], key = own[by], key[by]
        fresh[at[1:]] |= key[1:] != key[:-1]
    if len(at):
        keyed = sorted((r, raw[i : until[i]], i) for r, i in zip(rank[direct[at]].tolist(), direct[at].tolist(), strict=True))
        direct[at] = [i for _, _, i in keyed]
    return direct


def suffix_order(text: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (uint8); suffix i is in order as far as ``until[i]`` at least (one past the text: to its end).

    Two-stage sort: only suffixes smaller than their successor are sorted directly.  Each
    other suffix follows, within the bucket of its first value, the order of its
    successor, so it is placed while the buckets are scanned upwards.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # smaller[i]: suffix i is smaller than suffix i + 1; equal neighbours take the next one's type.
    step = np.append(np.sign(np.diff(text.astype(np.int16))), -1)
    known = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    larger = ~smaller
    direct = direct_order(text, text.tobytes(), smaller, until)
    starts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []

    def induce(order: np.ndarray, value: int) -> np.ndarray:
        """Puts the larger predecessors of ``order`` into their buckets; returns those of this bucket."""
        before = order[order > 0] - 1
        before = before[larger[before]]
        values = text[before]
        by = np.argsort(values, kind="stable")
        before, values = before[by], values[by]
        cut = np.flatnonzero(np.diff(values)) + 1
        for part in np.split(before, cut):
            if len(part) and text[part[0]] != value:
                waiting[text[part[0]]].append(part)
        return before[values == value]

    for value in range(256):
        fresh = np.concatenate(waiting[value]) if waiting[value] else np.zeros(0, np.int64)
        while len(fresh):  # runs of one value: each round places the next one to the left
            out.append(fresh)
            fresh = induce(fresh, value)
        own = direct[starts[value] : starts[value + 1]]
        if len(own):
            out.append(own)
            induce(own, value)
    return np.concatenate(out)


def adjacent_common(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, by place in the text, whether it shares ``depth`` values with the one before it in ``order``.

    Where the one before moves along with the suffix, the common prefix only gets shorter by
    one; so bytes are compared at the starts of such stretches alone.
    """
    n = len(text)
    place = np.arange(n)
    before = np.full(n, -2)
    before[order[1:]] = order[:-1]
    words = np.ndarray(n, np.uint64, text.tobytes() + bytes(8), strides=(1,))
    common = np.zeros(n, np.int64)

    def compare(live: np.ndarray, most: int) -> None:
        for at in range(0, most, 8):
            live = live[np.maximum(live, before[live]) + at < n]
            differing = words[live + at] ^ words[before[live] + at]
            # The lowest bit that is set tells how many bytes of eight are equal.
            common[live] = at + np.where(differing == 0, 8, np.bitwise_count((differing & -differing) - np.uint64(1)).astype(np.int64) // 8)
            live = live[differing == 0]
            if not len(live):
                break

    start = (before >= 0) & np.append(True, before[1:] != before[:-1] + 1)
    compare(np.flatnonzero(start), n)
    first = np.maximum.accumulate(np.where(start, place, 0))
    shared = common[first] - (place - first)
    lost = np.flatnonzero((before >= 0) & (shared <= 0) & ~start)  # past the end of what a stretch has in common
    compare(lost, depth)
    shared[lost] = common[lost]
    return (before >= 0) & (shared >= depth)


def repeated_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For pieces end to end with one separator each: which positions start a repeated window,
    and which start the first of each kind of window."""
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    # UTF-8 never uses 0xFF, so that the separator becomes 0.
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)
    ends = np.repeat(starts + sizes + 1, sizes + 1)
    place = np.arange(len(text))
    valid = place + length < ends
    order = suffix_order(text, np.minimum(place + length, ends))
    order = order[valid[order]]
    with_former = adjacent_common(text, order, length)
    flagged, first = with_former.copy(), valid & ~with_former
    flagged[order[:-1]] |= with_former[order[1:]]
    return flagged, first


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def window_cores(piece: bytes, name: int, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the ``chosen`` windows of a run: where groups of up to ``CORE`` neighbours begin, and a hash of the bytes that each group shares.

    Groups are laid out from the naming string of a window, which equal windows have at the
    same place; so equal windows of different runs are in groups of equal bytes.
    """
    data = np.frombuffer(piece, np.uint8)
    prefix = HASHER.prefix(data)
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * HASHER.back[: len(data) - GRAM + 1]).view(np.int64)
    naming = np.flatnonzero(grams == name)
    anchor = naming[np.searchsorted(naming, chosen)]
    group = (anchor - chosen) // CORE
    begins = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1]))[: len(chosen)])
    group = group[begins]
    start = anchor[begins] - group * CORE  # of the last window of a group; its first one starts up to CORE - 1 earlier
    return begins, mixed(HASHER.ranges(prefix, start, start + length - CORE + 1) + group.astype(np.uint64)).view(np.int64)


def find_runs(keyed: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """(k1, k2, start, windows, name, digest, inner) for every run of windows of every document.

    Texts are read in parts of ``BLOCK`` / 2 bytes, which overlap by ``length`` - 1.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            data, offsets = string_buffers(batch.column("text"))
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for a, z in row_blocks(offsets, BLOCK // 2):
                low, high = int(offsets[a]), int(offsets[z])
                for at in range(low, high if z == a + 1 else low + 1, BLOCK // 2):
                    part = data[at : min(high, at + BLOCK // 2 + length - 1) if z == a + 1 else high]
                    row, start, windows, name, inner = runs_of(part, np.array([0, len(part)]) if z == a + 1 else offsets[a : z + 1] - low, length, gram, HASHER)
                    first = start + (0 if z == a + 1 else offsets[a:z][row] - low)
                    raw = part.tobytes()
                    digests = [blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(first.tolist(), (first + windows + length - 1).tolist(), strict=True)]
                    columns = [k1[a:z][row], k2[a:z][row], start + at - low, windows, name]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(digests, pa.binary()), pa.array(inner)], names=["k1", "k2", "start", "windows", "name", "digest", "inner"])

    return keyed.select("k1", "k2", "text").mapInArrow(task, "k1 long, k2 long, start long, windows int, name long, digest binary, inner boolean")


SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
CORES = pa.list_(pa.struct([("core", pa.int64()), ("windows", pa.list_(pa.int32()))]))


def compare_runs(pieces: DataFrame, length: int, tasks: int) -> DataFrame:
    """Repeated windows of distinct runs (name, salt, digest, n, bytes), as spans of window numbers.

    ``salt`` is null where all runs of a name fit one block.  Else ``cores`` has what is to
    be compared over the blocks of the name.
    """

    def block(rows: list[tuple]) -> pa.RecordBatch:
        twice = [(k, r[4]) for k, r in enumerate(rows) for _ in range(min(r[3], 2))]
        flags, first = repeated_windows([piece for _, piece in twice], length)
        at, spans, cores = 0, [None] * len(rows), [None] * len(rows)
        for k, piece in twice:
            windows = len(piece) - length + 1
            low, high = spans_of(flags[at : at + windows])
            found = spans[k] or (low, high)
            spans[k] = found
            if rows[k][1] is not None:
                chosen = np.flatnonzero(first[at : at + windows])
                begins, core = window_cores(piece, rows[k][0], chosen, length)
                groups = list(zip(core.tolist(), np.split(chosen, begins[1:]), strict=True)) if len(chosen) else []
                cores[k] = (cores[k] or []) + [{"core": c, "windows": w} for c, w in groups]
            at += len(piece) + 1
        listed = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(low) for low, _ in spans])]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in spans]).astype(np.int32)) for i in (0, 1)], names=["from", "to"]),
        )
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), listed, pa.array(cores, CORES)], names=["name", "digest", "spans", "cores"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = [], [], 0  # whole groups of a name and salt; the group being read; bytes of both
        for batch in sliced(batches, "bytes"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "salt", "digest", "n", "bytes")), strict=True):
                if group and row[:2] != group[0][:2]:
                    held += group
                    group = []
                    if size >= BLOCK:
                        yield block(held)
                        held, size = [], 0
                group.append(row)
                size += len(row[4]) * min(row[3], 2)
        if held or group:
            yield block(held + group)

    ordered = pieces.repartition(tasks, "name", "salt").sortWithinPartitions("name", "salt", "digest")
    return ordered.select("name", "salt", "digest", "n", "bytes").mapInArrow(task, "name long, digest binary, spans array<struct<from: int, to: int>>, cores array<struct<core: long, windows: array<int>>>")


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 400) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts elsewhere.

    Returns ``keep``, ``spans`` (maximal removed byte ranges, in order), ``kept`` (the
    remaining bytes, binary) and ``whole`` (the same as text, without what is left of
    characters that a cut goes through); ``keep`` must not hold these three names.  Strings are judged on the input; occurrences may overlap
    and may lie in one document.  A null or empty text has no span and empty ``kept``;
    equal rows repeat each other; a text shorter than ``length`` is kept whole.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    if {"spans", "kept", "whole"}.intersection(keep):
        raise ValueError("spans, kept and whole are columns of the result")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), whole.alias("text"))
    keyed = rows.withColumns({"k1": F.xxhash64("text", "row"), "k2": F.xxhash64(F.lit(1), "row", "text")})
    found = stored(find_runs(keyed, length))

    names = found.groupBy("name").agg(F.count("*").alias("total"), F.max("inner").alias("inner"))
    # Stored tables meet in plain exchanges, whose skewed parts are split.
    names = stored(names.where("total > 1 or inner").select("name"))
    repeated = stored(found.drop("inner").join(names, "name"))
    distinct = stored(repeated.groupBy("name", "digest").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("at")))
    size = (F.col("at.windows") + F.lit(length - 1)) * F.least("n", F.lit(2))
    per_name = stored(distinct.groupBy("name").agg(F.sum(size).alias("size")))
    total = per_name.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    blocks = F.ceil(F.col("size") / BLOCK)
    one = distinct.join(per_name, "name").select("name", "digest", "n", "at.*", F.when(blocks > 1, F.pmod(F.xxhash64("digest"), blocks)).alias("salt"))
    cut = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), F.col("windows") + length - 1)
    pieces = stored(keyed.join(one, ["k1", "k2"]).select("name", "salt", "digest", "n", cut.alias("bytes")).dropDuplicates(["name", "digest"]))
    compared = stored(compare_runs(pieces, length, tasks))

    cores = compared.where("cores is not null").select("name", "digest", F.inline("cores"))
    met = cores.groupBy("name", "core").agg(F.count("*").alias("times")).where("times > 1").select("name", "core")
    asked = cores.join(met, ["name", "core"]).select("name", "digest", F.explode("windows").alias("window")).distinct()
    window = F.sha2(F.substring(F.col("bytes"), F.col("window") + 1, F.lit(length)), 256)
    hashed = stored(asked.join(pieces.where("salt is not null").select("name", "digest", "bytes"), ["name", "digest"]).select("name", "digest", "window", window.alias("bytes")))
    common = hashed.groupBy("name", "bytes").agg(F.count("*").alias("times")).where("times > 1").select("name", "bytes")
    over_blocks = hashed.join(common, ["name", "bytes"]).select("name", "digest", F.col("window").alias("from"), (F.col("window") + 1).alias("to"))
    spans = stored(compared.select("name", "digest", F.inline("spans")).unionByName(over_blocks))
    byte_spans = repeated.join(spans, ["name", "digest"]).select("k1", "k2", (F.col("start") + F.col("from")).cast("int").alias("start"), (F.col("start") + F.col("to") + length - 1).cast("int").alias("end"))
    joined = keyed.join(united(byte_spans), ["k1", "k2"], "left")
    none = F.array().cast("array<struct<start: int, end: int>>")
    binary = F.col("text").cast("binary")
    with_edges = joined.withColumn("spans", F.coalesce("spans", none))
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))), F.array(F.octet_length("text")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.struct(F.element_at("edges", 2 * i + 1).alias("from"), F.element_at("edges", 2 * i + 2).alias("to")))
    kept = F.array_join(F.transform(gaps, lambda g: F.substring(binary, g["from"] + 1, g["to"] - g["from"]).cast("string")), "").cast("binary")

    def inside(at: Column) -> Column:
        """Whether the byte at a place goes on with a character that began before it."""
        return F.hex(F.substring(binary, at + 1, F.lit(1))).between("80", "BF")

    def clean(g: Column) -> Column:
        """The characters that lie wholly in a range."""
        first = F.when(~inside(g["from"]), 0).when(~inside(g["from"] + 1), 1).when(~inside(g["from"] + 2), 2).otherwise(3)
        last = F.when(~inside(g["to"]), 0).when(~inside(g["to"] - 1), 1).when(~inside(g["to"] - 2), 2).otherwise(3)
        return F.substring(binary, g["from"] + first + 1, F.greatest(g["to"] - last - g["from"] - first, F.lit(0))).cast("string")

    none_cut = F.size("spans") == 0
    whole_text = F.when(none_cut, F.col("text")).otherwise(F.array_join(F.transform(gaps, clean), ""))
    return with_edges.withColumn("edges", edges).select("row.*", "spans", F.when(none_cut, binary).otherwise(kept).alias("kept"), whole_text.alias("whole"))


def united(byte_spans: DataFrame) -> DataFrame:
    """(k1, k2, spans): the union of each document's byte ranges, as ordered ranges with gaps between them."""
    order = Window.partitionBy("k1", "k2").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = byte_spans.distinct().withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = numbered.groupBy("k1", "k2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ranges.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
