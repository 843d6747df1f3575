"""Labelling of regions, comparison with truth, and summary metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles
from .intervals import interval_join
from .sampling import cumulative

VARIANT = ["chrom", "pos", "ref", "alt"]


def exact_matches(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """``calls`` rows (chrom, pos, ref, alts) with the truth_id of the equal record; alts compare as sets."""
    a = calls.withColumn("_set", F.array_sort("alts"))
    b = truth.select("chrom", "pos", "ref", F.array_sort("alts").alias("_set"), "truth_id")
    return a.join(b, ["chrom", "pos", "ref", "_set"]).select(*calls.columns, "truth_id")


def labelled(evaluated: DataFrame, tp_records: DataFrame, fp_records: DataFrame) -> DataFrame:
    """``evaluated`` rows with ``label`` and ``found_id``, the record that an evaluation's row is about.

    ``evaluated`` has chrom, pos, ref, alts, base, call and genotype (allele numbers, null for
    the open half of a half call).  Rows whose base marks hold CA, and rows without a call, are
    skipped.  A true positive is looked up by all its alternatives, a false positive by
    those of its genotype only; what is not found is left out.  The record files have chrom,
    pos, ref, alts and found_id; of equal records the smallest id counts.
    """
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    used = F.transform(F.filter("genotype", lambda a: a.isNotNull() & (a != 0)), lambda a: F.get("alts", a - 1))
    rows = evaluated.where(~F.coalesce(F.contains("base", F.lit("CA")), F.lit(False)))

    def found(kind: str, label: int, alts, records: DataFrame) -> DataFrame:
        known = records.withColumn("_set", as_set("alts")).groupBy("chrom", "pos", "ref", "_set").agg(F.min("found_id").alias("found_id"))
        return rows.where(F.col("call") == kind).withColumn("_set", as_set(alts)).join(known, ["chrom", "pos", "ref", "_set"]).select(*evaluated.columns, F.lit(label).alias("label"), "found_id")

    return found("TP", 1, F.col("alts"), tp_records).unionByName(found("FP", 0, used, fp_records))


def threshold_sweep(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(cut, tp, fp, fn, ppa, ppv, f1) for each distinct score as a cut: what scores at least that much is taken as true.

    Counts run from the highest score down.  They are added up within ranges of scores, then
    moved on by the totals of the ranges above, so that no task sees all scores.
    """
    hit = F.col(label) == 1
    counts = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("cut")).agg(F.count_if(hit).alias("p"), F.count_if(~hit).alias("n"))
    summed = cumulative(counts, [F.desc("cut")], {"p": "tp", "n": "fp"})
    every = counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("all"))
    rows = summed.join(F.broadcast(every)).withColumn("fn", F.col("all") - F.col("tp"))  # one row
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return agreement(rows).select("cut", "tp", "fp", "fn", "ppa", "ppv", f1.alias("f1"))


def quality_of(scored: DataFrame, threshold: float = 0.1, score: str = "score", label: str = "label") -> DataFrame:
    """One row: ppa, ppv and f1 of what scores over ``threshold``, and the cut with the best f1 (ties: the lowest)."""
    over, hit = F.col(score) > threshold, F.col(label) == 1
    counts = scored.agg(F.count_if(over & hit).alias("tp"), F.count_if(over & ~hit).alias("fp"), F.count_if(~over & hit).alias("fn"))
    fixed = agreement(counts).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    best = threshold_sweep(scored, score, label).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col("cut")).alias("cut"))).alias("b"))
    return fixed.join(F.broadcast(best)).select("tp", "fp", "fn", "ppa", "ppv", "f1", (-F.col("b.cut")).alias("best_cut"), F.col("b.f1").alias("best_f1"))


def normalized(records: DataFrame) -> DataFrame:
    """One row for each alt, with trimmed alleles and the position moved along."""
    rows = records.withColumn("alt", F.explode("alts"))
    t = alleles.trimmed(F.col("ref"), F.col("alt"))
    return rows.withColumn("t", t).select("record_id", "chrom", (F.col("pos") + F.col("t.offset")).alias("pos"), F.col("t.ref").alias("ref"), F.col("t.alt").alias("alt"))


def confusion(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """(type, tp, fn, fp) of distinct variant keys."""
    c, t = calls.select(*VARIANT).distinct(), truth.select(*VARIANT).distinct()
    kind = alleles.var_type(F.col("ref"), F.col("alt"))
    tagged = (
        t.join(c, VARIANT, "left_semi").withColumn("o", F.lit("tp")).unionByName(t.join(c, VARIANT, "left_anti").withColumn("o", F.lit("fn"))).unionByName(c.join(t, VARIANT, "left_anti").withColumn("o", F.lit("fp")))
    )
    return tagged.groupBy(kind.alias("type")).agg(*(F.count_if(F.col("o") == o).alias(o) for o in ("tp", "fn", "fp")))


def agreement(counts: DataFrame) -> DataFrame:
    """ppa and ppv of (type, tp, fn, fp); 0 where nothing was asked or called."""
    def share(missed):
        return F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(missed)), F.lit(0.0))

    return counts.select("*", share("fn").alias("ppa"), share("fp").alias("ppv"))


def region_labels(regions: DataFrame, variants: DataFrame, low: DataFrame, mappability: DataFrame) -> DataFrame:
    """(region_id, label): the kinds of variants in a region, with -big, -lc and -map added.

    ``low`` and ``mappability`` are interval sets; -lc needs a variant strictly inside one
    of the former that touches the region.
    """
    kind = alleles.padded_type(F.col("ref"), F.element_at("alts", 1))
    sized = variants.select(
        "chrom", F.col("pos").alias("start"), (F.col("pos") + F.length("ref")).alias("end"), "variant_id", kind.alias("kind"),
        (F.size("alts") > 1).alias("multi"), F.greatest(F.length("ref"), F.array_max(F.transform("alts", F.length))).alias("size"),
    )
    area = regions.select("region_id", "chrom", "start", "end")
    inside = interval_join(area, sized)
    counts = inside.groupBy("region_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("snv", "del", "ins")), F.count_if("multi").alias("multi"), F.max("size").alias("size"))
    touching = interval_join(area, low.select("chrom", "start", "end")).select("region_id", F.col("r_chrom").alias("chrom"), F.col("r_start").alias("low_start"), F.col("r_end").alias("low_end"))
    placed = inside.select(F.col("region_id"), (F.col("r_start") + 1).alias("one_based"))
    found = touching.join(placed, "region_id").where("low_start < one_based and one_based < low_end").select("region_id").distinct().withColumn("found", F.lit(True))
    mapped = interval_join(area, mappability.select("chrom", "start", "end")).select("region_id").distinct().withColumn("mapped", F.lit(True))
    rows = regions.join(counts, "region_id", "left").fillna(0, ["snv", "del", "ins", "multi", "size"]).join(found, "region_id", "left").join(mapped, "region_id", "left")
    indel = (F.col("ins") > 0) | (F.col("del") > 0)
    base = (
        F.when((F.col("del") > 0) & (F.col("ins") > 0), "ins-del").when(indel & (F.col("snv") > 0), "indel-snv").when(F.col("multi") > 0, "multi")
        .when(F.col("del") > 0, "del").when(F.col("ins") > 0, "ins").when(F.col("snv") > 0, "snv").otherwise("tn")
    )
    label = F.concat(base, F.when(F.col("size") > 10, "-big").otherwise(""), F.when(F.col("found"), "-lc").otherwise(""), F.when(F.col("mapped"), "-map").otherwise(""))
    return rows.select("region_id", label.alias("label"))
