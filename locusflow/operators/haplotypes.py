"""Genotype combinations of a region's variants, their support by reads, and spliced sequences.

``members`` has region_id, place (1 and up, in order of start), start, ref, alts and gt
(array of two allele numbers, null for a half call).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alleles


#: Heterozygous variants of a region that lie farther apart than this are not phased together.
LONGEST_SPAN = 100
#: Ways to phase a region that are followed; a region with more is not phased.
MOST_WAYS = 4096


def heterozygous(gt: Column) -> Column:
    """Whether the two alleles differ; a half call does."""
    return F.size(F.array_distinct(F.transform(gt, lambda g: F.coalesce(g, F.lit(-1))))) > 1


def with_used_bases(members: DataFrame) -> DataFrame:
    """``members`` with, for each of the two alleles k, gk (null: 0) and xk, the reference bases (s, e) it takes the place of.

    s = e is an insertion point; the reference allele has none.
    """
    rows = members
    for k in "01":
        rows = rows.withColumn(f"g{k}", F.coalesce(F.col("gt")[int(k)], F.lit(0)))
        rows = rows.withColumn(f"a{k}", F.when(F.col(f"g{k}") > 0, F.try_element_at("alts", F.greatest(F.col(f"g{k}"), F.lit(1)))))
        # Step by step: each result is used several times.
        rows = rows.withColumn(f"n{k}", alleles.common_suffix(F.col("ref"), F.col(f"a{k}")))
        rows = rows.withColumns({f"r{k}": alleles.without_suffix(F.col("ref"), F.col(f"n{k}")), f"a{k}": alleles.without_suffix(F.col(f"a{k}"), F.col(f"n{k}"))})
        rows = rows.withColumn(f"p{k}", alleles.common_prefix(F.col(f"r{k}"), F.col(f"a{k}")).cast("int"))
        rows = rows.withColumn(f"x{k}", F.when(F.col(f"a{k}").isNotNull(), F.struct((F.col("start") + F.col(f"p{k}")).alias("s"), (F.col("start") + F.length(f"r{k}")).alias("e"))))
    return rows.select(*members.columns, *(f"{c}{k}" for k in "01" for c in "gx"))


def clash(x: Column, y: Column) -> Column:
    """Two alleles of a haplotype on the same bases, or at the same insertion point."""
    points = (x["s"] == x["e"]) & (y["s"] == y["e"]) & (x["s"] == y["s"])
    return points | ((x["s"] < x["e"]) & (y["s"] < y["e"]) & (x["s"] < y["e"]) & (y["s"] < x["e"]))


def phased(members: DataFrame, tested: bool = True, longest: int = LONGEST_SPAN, most: int = MOST_WAYS) -> DataFrame:
    """(region_id, span, ways, reason): the unordered pairs (h0, h1) of allele lists of each region, in order.

    Pairs grow from variant to variant: a homozygous one goes on both haplotypes, the first
    heterozygous one is fixed (so that pairs are unordered), each later one goes on either
    way round.  If ``tested``, a pair ends where a haplotype would have two alleles on the
    same reference bases or insertion point.  A null allele counts as 0.  A region is given
    up, with the reason and no ways, if its heterozygous variants span over ``longest``
    bases or if over ``most`` pairs are alive at once.
    """
    het, end = heterozygous(F.col("gt")), F.col("start") + F.length("ref")
    part = F.struct("place", "g0", "g1", "x0", "x1")
    lists = with_used_bases(members).groupBy("region_id").agg(
        F.array_sort(F.collect_list(part)).alias("m"), F.count_if(het).alias("hets"), (F.max(F.when(het, end)) - F.min(F.when(het, F.col("start")))).alias("far")
    )
    span = F.when(F.col("hets") > 1, F.col("far")).otherwise(0).cast("long")
    kind = "array<struct<h0:array<int>,h1:array<int>,u0:array<struct<s:bigint,e:bigint>>,u1:array<struct<s:bigint,e:bigint>>>>"

    def free(taken: Column, x: Column) -> Column:
        return x.isNull() | ~F.exists(taken, lambda u: F.coalesce(clash(u, x), F.lit(False))) if tested else F.lit(True)

    def extended(ways: Column, m: Column, a: str, b: str) -> Column:
        alive = F.filter(ways, lambda w: free(w["u0"], m[f"x{a}"]) & free(w["u1"], m[f"x{b}"]))

        def longer(w: Column) -> Column:
            def more(taken: Column, x: Column) -> Column:
                return F.when(x.isNull(), taken).otherwise(F.concat(taken, F.array(x)))

            return F.struct(
                F.concat(w["h0"], F.array(m[f"g{a}"])).alias("h0"), F.concat(w["h1"], F.array(m[f"g{b}"])).alias("h1"),
                more(w["u0"], m[f"x{a}"]).alias("u0"), more(w["u1"], m[f"x{b}"]).alias("u1"),
            )

        return F.transform(alive, longer)

    def grow(done: Column, m: Column) -> Column:
        both = (m["g0"] != m["g1"]) & done["branched"]
        ways = F.concat(extended(done["ways"], m, "0", "1"), F.when(both, extended(done["ways"], m, "1", "0")).otherwise(F.array().cast(kind)))
        over = done["over"] | (F.size(ways) > most)
        return F.struct(F.when(over, F.array().cast(kind)).otherwise(ways).alias("ways"), (done["branched"] | (m["g0"] != m["g1"])).alias("branched"), over.alias("over"))

    nothing = F.array().cast("array<int>").alias("h0"), F.array().cast("array<int>").alias("h1"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("u0"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("u1")
    start = F.struct(F.array(F.struct(*nothing)).cast(kind).alias("ways"), F.lit(False).alias("branched"), F.lit(False).alias("over"))
    near = F.when(span <= longest, F.col("m")).otherwise(F.slice("m", 1, 0))
    rows = lists.select("region_id", span.alias("span"), F.aggregate(near, start, grow).alias("grown"))
    pairs = F.transform("grown.ways", lambda w: F.array_sort(F.array(w["h0"], w["h1"])))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p[0].alias("h0"), p[1].alias("h1"))))
    reason = F.when(F.col("span") > longest, f"span over {longest}").when(F.col("grown.over"), f"over {most} ways")
    return rows.select("region_id", "span", F.when(reason.isNull(), ordered).otherwise(F.slice(ordered, 1, 0)).alias("ways"), reason.alias("reason"))


def listed(rows: DataFrame) -> DataFrame:
    """(region_id, combo, h0, h1) of ``phased`` rows, numbered in order."""
    return rows.select("region_id", F.posexplode("ways").alias("i", "w")).select("region_id", (F.col("i") + 1).alias("combo"), "w.h0", "w.h1")


def genotype_combos(members: DataFrame, longest: int = LONGEST_SPAN, most: int = MOST_WAYS) -> DataFrame:
    """(region_id, combo, h0, h1): one row for each way to phase the variants of a region."""
    return listed(phased(members, False, longest, most))


def possible_genotypes(members: DataFrame, longest: int = LONGEST_SPAN, most: int = MOST_WAYS) -> DataFrame:
    """The same of the ways in which no haplotype has two alleles on the same reference bases or insertion point."""
    return listed(phased(members, True, longest, most))


def unphased(members: DataFrame, longest: int = LONGEST_SPAN, most: int = MOST_WAYS) -> DataFrame:
    """(region_id, span, reason) of the regions that ``possible_genotypes`` gives up."""
    return phased(members, True, longest, most).where("reason is not null").select("region_id", "span", "reason")


def spliced(members: DataFrame, regions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(region_id, ..., seq): each list of ``alleles`` in ``chosen`` put into the region's reference sequence.

    Variants go in from left to right, moved by what the ones before have added; a place
    that falls before the region's start counts as its start.
    """
    every = F.concat(F.array("ref"), "alts")  # by allele number
    parts = F.struct("place", "start", F.transform(every, lambda alt: alleles.prefix_trimmed(F.col("ref"), alt)).alias("trims"))
    lists = members.groupBy("region_id").agg(F.array_sort(F.collect_list(parts)).alias("m"))
    rows = chosen.join(lists, "region_id").join(regions.select("region_id", F.col("start").alias("region_start"), "seq"), "region_id")

    def step(state, x):
        t = F.try_element_at(x["trims"], F.element_at("alleles", x["place"]) + 1)
        at = (x["start"] - F.col("region_start")).cast("int") + state["moved"] + t["offset"]
        before, after = F.greatest(at, F.lit(0)), F.greatest(at + F.length(t["ref"]) + 1, F.lit(1))
        text = F.concat(F.substring(state["seq"], F.lit(1), before), t["alt"], F.substring(state["seq"], after, F.length(state["seq"])))
        return F.struct(text.alias("seq"), (state["moved"] + F.length(t["alt"]) - F.length(t["ref"])).alias("moved"))

    made = F.aggregate("m", F.struct(F.col("seq").alias("seq"), F.lit(0).alias("moved")), step, lambda s: s["seq"])
    return rows.select(*chosen.columns, made.alias("seq"))


def haplotype_support(haplotypes: DataFrame, spanning: DataFrame) -> DataFrame:
    """Support of each (region_id, combo, hap, seq) by reads (region_id, read_id, bases), normalised within the region.

    A read is worth one, shared by the haplotypes it is nearest to in edit distance.  It is
    held against each distinct sequence of its region once, each time only up to the best
    distance so far; where a region has a single sequence there is nothing to compare.
    Regions without a read have no score and no row.
    """
    sequences = haplotypes.where("seq is not null").groupBy("region_id", "seq").agg(F.array_sort(F.collect_list(F.struct("combo", "hap"))).alias("users"))
    lists = sequences.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("seq", "users"))).alias("known"))  # at most two for each way
    pairs = spanning.where("bases is not null").join(lists, "region_id")
    start = F.struct(F.lit(None).cast("int").alias("best"), F.array().cast("array<string>").alias("near"))

    def nearer(done: Column, x: Column) -> Column:
        first, bounded = F.levenshtein("bases", x["seq"]), F.call_function("levenshtein", F.col("bases"), x["seq"], F.coalesce(done["best"], F.lit(0)))

        def after(d: Column) -> Column:
            kept = F.when(d == done["best"], F.concat(done["near"], F.array(x["seq"]))).otherwise(F.array(x["seq"]))
            return F.when(d < 0, done).otherwise(F.struct(d.alias("best"), kept.alias("near")))

        # One element: the distance is worked out once, and used several times.
        return F.get(F.transform(F.array(F.when(done["best"].isNull(), first).otherwise(bounded)), after), F.lit(0))

    def shares(near: Column) -> Column:
        """Every known sequence with its users and what each of them gets of the read."""
        users = F.aggregate("known", F.lit(0), lambda n, x: n + F.when(F.array_contains(near, x["seq"]), F.size(x["users"])).otherwise(0))
        part = lambda x: F.when(F.array_contains(near, x["seq"]), 1.0 / users).otherwise(0.0)
        return F.transform("known", lambda x: F.struct(x["seq"].alias("seq"), x["users"].alias("users"), part(x).alias("share")))

    near = F.when(F.size("known") == 1, shares(F.transform("known", lambda x: x["seq"]))).otherwise(F.aggregate("known", start, nearer, lambda s: shares(s["near"])))
    # Edit distances are slow and their rows short: a fixed number of tasks, which are not coalesced.
    tasks = int(spanning.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.select("region_id", "bases", "known", "read_id").repartition(tasks, "region_id", "read_id")
    shared = spread.select("region_id", F.explode_outer(near).alias("x"))  # outer: else the list is made once more to see whether it is empty
    summed = shared.groupBy("region_id", F.col("x.seq").alias("seq"), F.col("x.users").alias("users")).agg(F.sum("x.share").alias("support"))
    total = F.sum(F.col("support") * F.size("users")).over(Window.partitionBy("region_id"))
    scored = summed.withColumn("score", F.try_divide("support", total)).where("score is not null")
    return scored.select("region_id", F.explode("users").alias("u"), "seq", "support", "score").select("region_id", "u.combo", "u.hap", "seq", "support", "score")


def best_genotypes(support: DataFrame) -> DataFrame:
    """The combination with the highest sum of scores in each region (ties: the first one)."""
    sums = support.groupBy("region_id", "combo").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("region_id").orderBy(F.desc(F.round("score", 9)), "combo")
    return sums.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
