"""Bases, k-mers, CIGAR strings and base-call features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 4
START_TOKEN = 4**K + 3  # four indices are kept free after the k-mers


def base_index(base: Column) -> Column:
    """A, C, G, T as 0 to 3; any other letter is an error."""
    place = F.instr(F.lit("ACGT"), base)
    return F.when((F.length(base) == 1) & (place > 0), (place - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a base: "), F.coalesce(base, F.lit("null")))))


def kmer_indices(seq: Column, k: int = K) -> Column:
    """Indices of the whole k-mers of a sequence, in ACGT order."""
    count = F.floor(F.length(seq) / k).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.conv(F.translate(F.substring(seq, i * k + 1, F.lit(k)), "ACGT", "0123"), 4, 10).cast("int"))


def kmer_string(indices: Column, k: int = K) -> Column:
    """The sequence of k-mer indices."""

    def letters(x):
        return F.concat(*(F.substring(F.lit("ACGT"), F.shiftright(x, 2 * j).bitwiseAND(F.lit(3)) + 1, F.lit(1)) for j in range(k - 1, -1, -1)))

    return F.array_join(F.transform(indices, letters), "")


def expanded(values: Column, k: int = K) -> Column:
    """Every value k times."""
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, k)))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string; null for a null or empty one."""
    pattern = r"(\d+)([MIDNSHP=X])"
    both = F.arrays_zip(F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(cigar, F.lit(pattern), F.lit(2)).alias("o"))
    return F.when(F.length(cigar) > 0, F.transform(both, lambda x: F.struct(x["o"].alias("op"), x["n"].cast("int").alias("len"))))


def cigar_walk(ops: Column, query: Column | int = 0, target: Column | int = 0) -> Column:
    """array<struct<op, len, q, t, n>>: each operation with its offsets in query and target and its number."""

    def consumed(x, operations):
        return F.when(x["op"].isin(*operations), x["len"]).otherwise(0)

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        q = F.coalesce(last["q"] + consumed(last, "MIS=X"), F.lit(query).cast("int"))
        t = F.coalesce(last["t"] + consumed(last, "MDN=X"), F.lit(target).cast("int"))
        return F.concat(done, F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), q.alias("q"), t.alias("t"), F.size(done).alias("n"))))

    return F.aggregate(ops, F.array().cast("array<struct<op: string, len: int, q: int, t: int, n: int>>"), step)


def clip_start(start: Column, ops: Column) -> Column:
    """Start of a read had its first clip been aligned."""
    first = F.try_element_at(ops, F.lit(1))
    return F.when(first["op"].isin("S", "H"), start - first["len"]).otherwise(start)


def clipped_bases(ops: Column) -> Column:
    """Soft- and hard-clipped bases (no CIGAR: 0)."""
    clips = F.filter(ops, lambda x: x["op"].isin("S", "H"))
    return F.coalesce(F.aggregate(clips, F.lit(0), lambda n, x: n + x["len"]), F.lit(0))


def call_features(base: Column, qual: Column, op: Column, reverse: Column, mapq: Column) -> list[Column]:
    """The ten features of a base call: one-hot base (N: all), quality, flags and mapping quality; halves round to even."""
    onehot = [((base == letter) | (base == "N")).cast("int").alias(f"f{i}") for i, letter in enumerate("ACGT")]
    return [
        *onehot,
        F.bround(qual / 10).cast("int").alias("f4"),
        op.isin("M", "D", "S", "H", "=").cast("int").alias("f5"),
        op.isin("M", "I", "N", "S", "=").cast("int").alias("f6"),
        reverse.cast("int").alias("f7"),
        op.isin("S", "H").cast("int").alias("f8"),
        F.bround(mapq / 10).cast("int").alias("f9"),
    ]


def cropped(values: Column, size: int, empty) -> Column:
    """The middle ``size`` values, or all of them followed by ``empty`` up to ``size``."""
    n = F.size(values)
    middle = F.slice(values, F.floor(n / 2).cast("int") - size // 2 + 1, F.lit(size))
    return F.when(n >= size, middle).otherwise(F.concat(values, F.array_repeat(empty, F.greatest(F.lit(size) - n, F.lit(0)))))
