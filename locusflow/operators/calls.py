"""Window calls to records: haplotype placement, phase groups, merging, overlap resolution.

A window call has chrom, region_no, window_no, hap, pos (0-based), ref, alt, qual,
window_offset, var_index and var_count.  A region's calls are bounded by its windows, so
orderings run within (chrom, region_no).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alleles
from .intervals import anchored_folds

REGION = ["chrom", "region_no"]
KEY = ["pos", "ref", "alt"]


def first_of_window(calls: DataFrame, count: int = 5) -> DataFrame:
    """The first ``count`` calls of each window and haplotype within the region's closed bounds, then clipped to its half-open ones."""
    inside = calls.where((F.col("region_start") <= F.col("pos")) & (F.col("pos") <= F.col("region_end")))
    order = Window.partitionBy(*REGION, "window_no", "hap").orderBy("var_index")
    return inside.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place").where("pos < region_end")


def with_ordinal(calls: DataFrame) -> DataFrame:
    """``ordinal`` of each call in its region: by position, then first haplotype, window and index."""
    order = Window.partitionBy(*REGION).orderBy("pos", "hap", "window_no", "var_index")
    return calls.withColumn("ordinal", F.row_number().over(order))


def first_occurrences(calls: DataFrame) -> DataFrame:
    """One row for each key of a region: its first call."""
    order = Window.partitionBy(*REGION, *KEY).orderBy("ordinal")
    return with_ordinal(calls).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def zygosity_votes(calls: DataFrame) -> DataFrame:
    """(region, key, homs, hets): windows that have a key on both haplotypes, and on one."""
    per_window = calls.groupBy(*REGION, *KEY, "window_no").agg(F.max((F.col("hap") == 0).cast("int")).alias("a"), F.max((F.col("hap") == 1).cast("int")).alias("b"))
    return per_window.groupBy(*REGION, *KEY).agg(F.count_if((F.col("a") + F.col("b")) == 2).alias("homs"), F.count_if((F.col("a") + F.col("b")) == 1).alias("hets"))


def gathered(calls: DataFrame) -> DataFrame:
    """(region, key, calls, on0, on1, mean_qual, cis, n): the calls of each key, and its windows by haplotype.

    A key is called in the few windows that cover its position, so its lists are short.
    """
    entry = F.struct("hap", "window_no", "var_index", "qual", "window_offset")
    rows = calls.groupBy(*REGION, *KEY).agg(F.array_sort(F.collect_list(entry)).alias("calls"), F.avg("qual").alias("mean_qual"), F.min("var_count").alias("cis"), F.count("*").alias("n"))

    def windows(hap: int):
        return F.array_distinct(F.transform(F.filter("calls", lambda c: c["hap"] == hap), lambda c: c["window_no"]))

    return rows.withColumns({"on0": windows(0), "on1": windows(1)})


def placed_keys(keys: DataFrame) -> DataFrame:
    """``keys`` of :func:`gathered` with ordinal, hom and side, in one pass over each region in order."""
    first = F.element_at("calls", 1)
    order = Window.partitionBy(*REGION).orderBy("pos", first["hap"], first["window_no"], first["var_index"])
    homs = F.size(F.array_intersect("on0", "on1"))
    hets = F.size(F.array_union("on0", "on1")) - homs
    former = F.last(F.when(~F.col("hom"), F.struct("on0", "on1")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = keys.withColumn("hom", homs > hets).withColumns({"ordinal": F.row_number().over(order), "former": former})
    cis = F.array_union(F.array_intersect("on0", "former.on0"), F.array_intersect("on1", "former.on1"))
    shared = F.array_intersect(F.array_union("on0", "on1"), F.array_union("former.on0", "former.on1"))
    changes = ~F.col("hom") & F.col("former").isNotNull() & (F.size(shared) >= 2 * F.size(cis))  # apart at least as often as together
    side = F.sum(F.when(changes, 1).otherwise(0)).over(order) % 2
    return rows.withColumn("side", F.when(F.col("hom"), 0).otherwise(side).cast("int")).drop("former")


def place_haplotypes(calls: DataFrame) -> DataFrame:
    """(region, key, ordinal, hom, side): a heterozygous key lies on ``side``, a homozygous one on both.

    The first heterozygous key is on side 0.  Each next one changes sides unless windows
    show it more often on one haplotype with the previous one than apart from it.  So the
    side is the parity of the changes so far.
    """
    return placed_keys(gathered(calls)).select(*REGION, *KEY, "ordinal", "hom", "side")


def phase_groups(keys: DataFrame, distance: int = 100) -> DataFrame:
    """Keys with ``group_start``: the first position of their group, none farther than ``distance`` from it."""
    folds = anchored_folds(keys, REGION, distance, strict=False).withColumnsRenamed({c: f"f_{c}" for c in REGION})
    meet = [F.col(c) == F.col(f"f_{c}") for c in REGION]
    return keys.join(folds, [*meet, F.col("pos").between(F.col("lo"), F.col("hi"))]).select(*keys.columns, F.col("lo").alias("group_start"))


def merge_calls(calls: DataFrame, depths: DataFrame, anchors: DataFrame, min_depth: int = 30) -> DataFrame:
    """Merged records of all placed keys of a region's phase groups.

    ``depths`` has (chrom, pos, depth), ``anchors`` (chrom, pos, base) of the reference.
    Positions come out 1-based; PS stays 0-based, and is null for a group of one key.
    """
    placed = phase_groups(placed_keys(gathered(calls)).drop("on0", "on1"))
    group = [*REGION, "group_start"]
    # Each placed key has its calls from both haplotypes; a homozygous one has them on both sides.
    inside = Window.partitionBy(*group)
    rows = placed.withColumns({
        "keys": F.count("*").over(inside), "hets": F.count_if(~F.col("hom")).over(inside), "ps": F.min("pos").over(inside),
        "on0": F.count_if(F.col("hom") | (F.col("side") == 0)).over(inside), "on1": F.count_if(F.col("hom") | (F.col("side") == 1)).over(inside),
    })
    rows = rows.join(depths.select("chrom", "pos", "depth"), ["chrom", "pos"], "left").fillna(0, ["depth"])
    anchor = anchors.select("chrom", (F.col("pos") + 1).alias("pos"), F.col("base").alias("anchor"))
    rows = rows.join(anchor, ["chrom", "pos"], "left")
    quals, blank = F.transform("calls", lambda c: c["qual"]), (F.col("ref") == "") | (F.col("alt") == "")
    where = F.transform("calls", lambda c: c["window_offset"])
    count = F.when(F.col("hom"), 2 * F.col("n")).otherwise(F.col("n"))
    flags = F.array(F.when(F.col("depth") < min_depth, "LowCov"), F.when(count < 2, "SingleCallHet").when(F.col("n") < 2, "SingleCallHom"))
    padding = F.when(blank, F.coalesce("anchor", F.lit(""))).otherwise("")
    return rows.select(
        *group,
        (F.col("pos") + F.when(blank, 0).otherwise(1)).alias("pos"),
        F.concat(padding, "ref").alias("ref"),
        F.concat(padding, "alt").alias("alt"),
        F.col("mean_qual").alias("qual"),
        F.when(F.col("hom"), F.concat(quals, quals)).otherwise(quals).alias("quals"),
        F.array_join(F.when(F.size(F.array_compact(flags)) == 0, F.array(F.lit("PASS"))).otherwise(F.array_compact(flags)), ";").alias("filter"),
        F.col("depth").cast("long").alias("depth"),
        (~F.col("hom") & (F.col("hets") > 1)).alias("phased"),
        F.when(F.col("keys") > 1, F.col("ps")).alias("phase_set"),
        F.col("keys").alias("window_var_count"),
        F.col("cis").alias("window_cis_vars"),
        F.when(F.col("hom"), 0).when(F.col("side") == 0, F.col("on1")).otherwise(F.col("on0")).cast("long").alias("window_trans_vars"),
        count.alias("call_count"),
        F.col("n").alias("step_count"),
        F.when(F.col("hom"), "1/1").when(F.col("side") == 0, "0/1").otherwise("1/0").alias("gt"),
        F.when(F.col("hom"), F.array_sort(F.array_distinct(where))).otherwise(where).alias("window_offsets"),
        F.transform("calls", lambda c: c["var_index"]).alias("var_indices"),
    )


def merge_overlaps(records: DataFrame, min_qual: float = 0.01) -> DataFrame:
    """Resolves records that overlap the record before them, within a region in order of position.

    In a chain of several, those of at most ``min_qual`` go; of the rest a single one stays
    as it is, else the best two become half calls, ``./1`` and ``1/.``.
    """
    order = Window.partitionBy(*REGION).orderBy("pos", "ref", "alt")
    end = alleles.record_end(F.col("pos"), F.col("ref"), F.col("alt"))
    rows = records.withColumn("stop", end)
    linked = alleles.overlaps(F.lag("pos").over(order), F.lag("stop").over(order), F.col("pos"), F.col("stop"))
    rows = rows.withColumn("opens", F.when(linked, 0).otherwise(1)).withColumn("ordinal", F.row_number().over(order))
    rows = rows.withColumn("chain", F.sum("opens").over(order))
    chain = Window.partitionBy(*REGION, "chain")
    rows = rows.withColumn("size", F.count("*").over(chain)).where((F.col("size") == 1) | (F.col("qual") > min_qual))
    rows = rows.withColumn("left", F.count("*").over(chain)).withColumn("place", F.row_number().over(chain.orderBy(F.desc("qual"), "ordinal")))
    several = (F.col("size") > 1) & (F.col("left") > 1)
    gt = F.when(several & (F.col("place") == 1), "./1").when(several, "1/.").otherwise(F.col("gt"))
    return rows.where(~several | (F.col("place") <= 2)).withColumn("gt", gt).drop("stop", "opens", "ordinal", "chain", "size", "left", "place")
