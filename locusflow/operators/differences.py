"""Variants from aligned sequence pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences


#: Letters that are compared at once.
BLOCK = 16


def mismatch_runs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of unequal letters of (query, target, offset, probs): ``keys``, pos, ref, alt, qual, window_offset.

    ``query`` is the reference side.  The quality is the geometric mean of the probabilities.
    Runs are found inside of a pair's row: equal blocks are passed over, and nothing is shuffled.
    """
    size = F.least(F.length("query"), F.length("target"))

    def part(name, at, n):
        return F.substring(name, at, n)

    def unequal(block):
        first = block * BLOCK + 1
        return F.filter(F.sequence(first, F.least(first + BLOCK - 1, F.col("size"))), lambda i: part("query", i, F.lit(1)) != part("target", i, F.lit(1)))

    def differs(block):
        first = block * BLOCK + 1
        n = F.least(F.lit(BLOCK), F.col("size") - first + 1)
        return part("query", first, n) != part("target", first, n)

    rows = pairs.select(*keys, "query", "target", "offset", "probs", size.alias("size")).where("size > 0")
    blocks = F.filter(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int")), differs)
    rows = rows.withColumn("places", F.flatten(F.transform(blocks, unequal)))
    firsts = F.filter("places", lambda i, k: (k == 0) | (F.get("places", k - 1) != i - 1))
    lasts = F.filter("places", lambda i, k: F.coalesce(F.get("places", k + 1) != i + 1, F.lit(True)))

    def run(x):
        n = x["hi"] - x["lo"] + 1
        known = F.filter(F.slice("probs", x["lo"], n), lambda p: p > 0)
        logs = F.aggregate(known, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, p: F.struct((a["s"] + F.log(p)).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, F.exp(a["s"] / a["n"])))
        return F.struct((x["lo"] - 1 + F.col("offset")).alias("pos"), part("query", x["lo"], n).alias("ref"), part("target", x["lo"], n).alias("alt"), logs.alias("qual"), (x["lo"] - 1).alias("window_offset"))

    return rows.select(*keys, F.inline(F.transform(F.arrays_zip(firsts.alias("lo"), lasts.alias("hi")), run)))


def gapless_pairs(alignments: DataFrame, key: str) -> DataFrame:
    """(key, query, target, offset, probs) of the alignments without an insertion, deletion or skip, for ``mismatch_runs``; clips are cut off."""
    walk = sequences.cigar_walk(sequences.cigar_ops(F.col("cigar")), F.col("query_begin"), F.col("target_begin"))
    rows = alignments.withColumn("x", walk).where(~F.exists("x", lambda x: x["op"].isin("I", "D", "N")))
    rows = rows.withColumn("m", F.filter("x", lambda x: x["op"].isin("M", "=", "X"))).where(F.size("m") > 0)
    rows = rows.withColumns({"q": F.col("m")[0]["q"], "t": F.col("m")[0]["t"], "len": F.aggregate("m", F.lit(0), lambda n, x: n + x["len"])})
    return rows.select(
        key, F.expr("substring(refseq, t + 1, len)").alias("query"), F.expr("substring(altseq, q + 1, len)").alias("target"),
        (F.col("offset") + F.col("t")).alias("offset"), F.expr("slice(probs, q + 1, len)").alias("probs"),
    )


def cigar_variants(alignments: DataFrame, key: str) -> DataFrame:
    """Variants of (key, refseq, altseq, probs, cigar, query_begin, target_begin, offset), in order, with var_index and var_count.

    An insertion's position counts matched and deleted bases only; a deletion's quality
    begins one base before it.
    """
    walk = sequences.cigar_walk(sequences.cigar_ops(F.col("cigar")), F.col("query_begin"), F.col("target_begin"))
    parts = alignments.select("*", F.explode(walk).alias("x")).select("*", "x.op", "x.len", "x.q", "x.t", "x.n")
    matches = parts.where("op = 'M'").select(
        key, "n", F.expr("substring(refseq, t + 1, len)").alias("query"), F.expr("substring(altseq, q + 1, len)").alias("target"),
        (F.col("offset") + F.col("t")).alias("offset"), F.expr("slice(probs, q + 1, len)").alias("probs"), "t",
    )
    runs = mismatch_runs(matches, [key, "n", "t"]).withColumn("window_offset", F.col("window_offset") + F.col("t")).drop("t")

    def mean(values):
        logs = F.aggregate(values, F.lit(0.0), lambda s, p: s + F.log(p))
        return F.when(F.size(values) > 0, F.exp(logs / F.size(values)))

    inserted = parts.where("op = 'I'").select(
        key, "n", (F.col("offset") + F.col("t")).alias("pos"), F.lit("").alias("ref"), F.expr("substring(altseq, q + 1, len)").alias("alt"),
        mean(F.expr("slice(probs, q + 1, len)")).alias("qual"), (F.col("t") - F.col("target_begin")).alias("window_offset"),
    )
    around = F.expr("slice(probs, greatest(q, 1), len + if(q > 0, 1, 0))")
    deleted = parts.where("op = 'D'").select(
        key, "n", (F.col("offset") + F.col("t")).alias("pos"), F.expr("substring(refseq, t + 1, len)").alias("ref"), F.lit("").alias("alt"), mean(around).alias("qual"), F.col("t").alias("window_offset")
    )
    found = runs.unionByName(inserted).unionByName(deleted)
    return found.select(
        key, "pos", "ref", "alt", "qual", "window_offset",
        (F.row_number().over(Window.partitionBy(key).orderBy("n", "pos")) - 1).alias("var_index"), F.count("*").over(Window.partitionBy(key)).alias("var_count"),
    )
