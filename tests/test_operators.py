"""Literal cases, nulls and empty inputs of the operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from locusflow.functions import alleles, quality, sequences
from locusflow.operators import calls, differences, evaluation, haplotypes, intervals, pileup, sampling, scans


def positions(spark, values, chrom="chr1"):
    return spark.createDataFrame([(chrom, 0, v) for v in values], "chrom string, window_idx int, pos long")


def ranges(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize(
    ("values", "maxdist", "pad", "expected"),
    [
        ([10, 50, 55, 160], 50, 8, [(2, 63), (152, 168)]),
        ([20], 50, 8, [(12, 28)]),
        ([10, 120, 230, 340], 50, 8, [(2, 18), (112, 128), (222, 238), (332, 348)]),
        ([100, 110, 115, 220, 225], 15, 10, [(90, 120), (105, 125), (210, 235)]),
        ([], 50, 8, []),
    ],
)
def test_anchored_clusters(spark, values, maxdist, pad, expected):
    found = intervals.anchored_clusters(positions(spark, values), ["chrom", "window_idx"], maxdist, pad)
    assert ranges(found) == expected


def test_merge_regions_after_clusters(spark):
    found = intervals.anchored_clusters(positions(spark, [100, 110, 115, 220, 225]), ["chrom", "window_idx"], 15, 10)
    assert ranges(intervals.merge_regions(found, ["chrom", "window_idx"])) == [(90, 125), (210, 235)]


def test_merge_regions_touching_and_apart(spark):
    rows = [("chr1", 0, 10, 20), ("chr1", 0, 20, 30), ("chr1", 0, 31, 40), ("chr2", 0, 5, 50), ("chr1", 1, 15, 25)]
    found = intervals.merge_regions(spark.createDataFrame(rows, "chrom string, window_idx int, start long, end long"), ["chrom", "window_idx"])
    assert sorted(map(tuple, found.collect())) == [("chr1", 0, 10, 30), ("chr1", 0, 31, 40), ("chr1", 1, 15, 25), ("chr2", 0, 5, 50)]


@pytest.mark.parametrize(("start", "end", "expected"), [(100, 300, [(100, 250), (250, 300)]), (5, 10, [(5, 10)]), (0, 150, [(0, 150)])])
def test_split_regions(spark, start, end, expected):
    df = spark.createDataFrame([(start, end)], "start long, end long")
    assert ranges(intervals.split_regions(df, 150)) == expected


def test_tile_regions(spark):
    df = spark.createDataFrame([(100, 180), (0, 300)], "start long, end long")
    assert ranges(intervals.tile_regions(df)) == [(0, 150), (65, 215), (75, 225), (150, 300)]


def test_interval_join_counts_each_pair_once(spark):
    a = spark.createDataFrame([(1, "chr1", 0, 5000), (2, "chr1", 10, 11), (3, "chr2", 0, 10), (4, None, 0, 10)], "a long, chrom string, start long, end long")
    b = spark.createDataFrame([(1, "chr1", 100, 4000), (2, "chr1", 5000, 6000), (3, "chr2", 9, 10)], "b long, chrom string, start long, end long")
    assert sorted((r["a"], r["b"]) for r in intervals.interval_join(a, b).collect()) == [(1, 1), (3, 3)]
    assert intervals.interval_join(a.limit(0), b).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_variant_types(spark):
    pairs = {("A", "C"): "snv", ("", "AC"): "ins", ("AC", ""): "del", ("AC", "GT"): "mnv", ("", ""): "unknown"}
    for (ref, alt), kind in pairs.items():
        assert one(spark, alleles.var_type(F.lit(ref), F.lit(alt))) == kind
    assert one(spark, alleles.var_type(F.lit(None).cast("string"), F.lit("A"))) == "unknown"


@pytest.mark.parametrize(
    ("ref", "alt", "expected"),
    [("CAAG", "CATG", (2, "A", "T")), ("ACC", "AC", (0, "AC", "A")), ("A", "A", (0, "A", "A")), ("AC", "GC", (0, "A", "G")), ("", "A", (0, "", "A"))],
)
def test_trimmed(spark, ref, alt, expected):
    assert tuple(one(spark, alleles.trimmed(F.lit(ref), F.lit(alt)))) == expected


def test_kmers_round_trip(spark):
    seq = "ACGTTGCAAAAATTTTCCCCGGGGACGTACGTTGCATGCAACGTAAAA"
    indices = one(spark, sequences.kmer_indices(F.lit(seq)))
    assert len(indices) == 12 and indices[2] == 0 and indices[3] == 255
    assert one(spark, sequences.kmer_string(sequences.kmer_indices(F.lit(seq)))) == seq
    assert one(spark, sequences.kmer_indices(F.lit(""))) == []
    assert one(spark, sequences.expanded(F.array(F.lit("A"), F.lit("B")), 3)) == ["A", "A", "A", "B", "B", "B"]


def test_base_index_rejects_other_letters(spark):
    assert [one(spark, sequences.base_index(F.lit(b))) for b in "ACGT"] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="not a base"):
        spark.createDataFrame([("N",)], "b string").select(sequences.base_index(F.col("b"))).collect()


def test_phred_and_bp(spark):
    values = [(0.0, 0), (0.9, 10), (1.0, 1000), (float("nan"), 0), (None, 0)]
    for p, expected in values:
        assert one(spark, quality.phred(F.lit(p).cast("double"))) == expected
    shown = [one(spark, quality.format_bp(F.lit(n))) for n in (123, 123_000, 123_456_000, 123_456_000_000)]
    assert shown == ["123", "123.0 Kb", "123.5 MB", "123.5 GB"]


def test_chrom_value(spark):
    assert [one(spark, quality.chrom_value(F.lit(c))) for c in ("chr2", "17", "chrX", "Y", "MT")] == [2, 17, 50, 60, 100 + ord("M")]


def test_mismatch_runs(spark):
    df = spark.createDataFrame([(1, "AAAAAAAA", "TAACGAAC", 17, [1.0, 1.0, 1.0, 0.25, 1.0, 1.0, 1.0, 1.0]), (2, "", "", 0, None)], "k int, query string, target string, offset int, probs array<double>")
    found = sorted((r["pos"], r["ref"], r["alt"], r["qual"]) for r in differences.mismatch_runs(df, ["k"]).collect())
    assert found == [(17, "A", "T", 1.0), (20, "AA", "CG", 0.5), (24, "A", "C", 1.0)]


def test_mismatch_runs_are_found_inside_of_a_row(spark):
    rows = [(1, "A" * 40, "A" * 15 + "CC" + "A" * 20 + "CGT", 0, [0.5] * 15 + [0.25, 1.0] + [0.5] * 21 + [None, 0.0]), (1, "AC", "GC", 5, [0.1, 0.1]), (2, "ACGTA", "ACGT", 0, [1.0] * 5), (3, None, "A", 0, [1.0])]
    df = spark.createDataFrame(rows, "k int, query string, target string, offset int, probs array<double>")
    found = differences.mismatch_runs(df, ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, 5, "A", "G", pytest.approx(0.1), 0), (1, 15, "AA", "CC", 0.5, 15), (1, 37, "AAA", "CGT", 0.5, 37)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_gapless_pairs_are_cut_at_clips(spark):
    kinds = "k int, refseq string, altseq string, probs array<double>, cigar string, query_begin int, target_begin int, offset int"
    rows = [(1, "ACGTAC", "TTACCT", [0.5] * 6, "2S1=1M1X1M1H", 0, 1, 10), (2, "ACGT", "ACGT", [0.5] * 4, "2M1D2M", 0, 0, 0), (3, "AC", "AC", [0.5] * 2, "2S", 0, 0, 0), (4, "AC", "AC", [0.5] * 2, None, 0, 0, 0)]
    found = differences.gapless_pairs(spark.createDataFrame(rows, kinds), "k").collect()
    assert [(r["k"], r["query"], r["target"], r["offset"], r["probs"]) for r in found] == [(1, "CGTA", "ACCT", 11, [0.5] * 4)]


def test_cigar_variants_with_insertion_and_deletion(spark):
    df = spark.createDataFrame([(1, "AACTTT", "AAGGCT", [0.5] * 6, "2M2I1M2D1M", 0, 0, 100)], "k int, refseq string, altseq string, probs array<double>, cigar string, query_begin int, target_begin int, offset int")
    rows = [(r["pos"], r["ref"], r["alt"], r["var_index"], r["var_count"]) for r in differences.cigar_variants(df, "k").orderBy("var_index").collect()]
    assert rows == [(102, "", "GG", 0, 2), (103, "TT", "", 1, 2)]


CALLS = "chrom string, region_no long, region_start long, region_end long, window_no long, hap int, pos long, ref string, alt string, qual double, window_offset long, var_index long, var_count long"


def window_calls(spark, windows):
    """``windows``: for each window, the positions on haplotype 0 and on haplotype 1."""
    rows = [("chr1", 0, 0, 600, w, h, p, "A", "C", 0.5, p, i, len(haps[h])) for w, haps in enumerate(windows) for h in (0, 1) for i, p in enumerate(haps[h])]
    return spark.createDataFrame(rows, CALLS)


def sides(spark, windows):
    rows = calls.place_haplotypes(window_calls(spark, windows)).collect()
    return {r["pos"]: "hom" if r["hom"] else r["side"] for r in rows}


def test_haplotype_placement(spark):
    assert sides(spark, [([10, 20], [])]) == {10: 0, 20: 0}  # together
    assert sides(spark, [([10], [20])]) == {10: 0, 20: 1}  # apart
    assert sides(spark, [([10], []), ([20], [])]) == {10: 0, 20: 1}  # never in one window
    assert sides(spark, [([10], [10]), ([10], [10]), ([10], [])]) == {10: "hom"}
    assert sides(spark, [([10, 20], []), ([10], [20])]) == {10: 0, 20: 1}  # a tie
    assert sides(spark, [([10, 20], []), ([20, 30], [])]) == {10: 0, 20: 0, 30: 0}  # by way of a third


def test_merge_calls_and_overlaps(spark):
    rows = window_calls(spark, [([10, 50], [10]), ([10, 50], [10])])
    depths = spark.createDataFrame([("chr1", 10, 40)], "chrom string, pos long, depth long")
    ref = spark.createDataFrame([("chr1", 9, "G")], "chrom string, pos long, base string")
    found = {r["pos"]: r for r in calls.merge_calls(rows, depths, ref).collect()}
    assert (found[11]["gt"], found[11]["call_count"], found[11]["filter"], found[11]["phase_set"]) == ("1/1", 8, "PASS", 10)
    assert (found[51]["gt"], found[51]["depth"], found[51]["filter"], found[51]["phased"]) == ("0/1", 0, "LowCov", False)
    records = spark.createDataFrame(
        [("chr1", 0, 10, "AC", "A", 0.9, "0/1"), ("chr1", 0, 11, "C", "T", 0.8, "0/1"), ("chr1", 0, 30, "A", "T", 0.001, "1/1"), ("chr1", 0, 50, "A", "T", 0.5, "1/1"), ("chr1", 0, 50, "A", "G", 0.005, "0/1")],
        "chrom string, region_no long, pos long, ref string, alt string, qual double, gt string",
    )
    merged = sorted((r["pos"], r["alt"], r["gt"]) for r in calls.merge_overlaps(records).collect())
    assert merged == [(10, "A", "./1"), (11, "T", "1/."), (30, "T", "1/1"), (50, "T", "1/1")]
    assert calls.merge_overlaps(records.limit(0)).count() == 0


READS = "read_id long, chrom string, start long, cigar string, mapq int, is_reverse boolean, bases string, quals array<int>"


def test_pileup_with_indel_and_null_cigar(spark):
    reads = spark.createDataFrame(
        [(1, "chr1", 0, "2M1D2M", 60, False, "ACGT", [30] * 4), (2, "chr1", 1, None, 60, True, "cc", [30] * 2), (3, "chr1", 0, "1S1M", 0, False, "TA", [30] * 2)], READS
    )
    for size in (256, 2):  # in one chunk, and over several
        ref = spark.createDataFrame([("chr1", k, "ACTGT"[k * size : (k + 1) * size]) for k in range(-(-5 // size))], "chrom string, chunk long, seq string")
        found = {r["pos"]: (r["depth"], r["mismatches"], r["indels"]) for r in pileup.pileup(reads, ref, size).collect()}
        assert found == {0: (2, 0, 0), 1: (2, 0, 1), 2: (1, 1, 0), 3: (1, 0, 0), 4: (1, 0, 0)}
    assert pileup.pileup(reads.limit(0), ref).count() == 0


def test_windows_with_few_reads_are_left_out(spark):
    reads = spark.createDataFrame([(i, "chr1", 100, "10M", 60, False, "A" * 10, [30] * 10) for i in range(4)], READS)
    asked = spark.createDataFrame([(1, "chr1", 90, 240)], "window_id long, chrom string, window_start long, window_end long")
    assert pileup.window_reads(asked, reads).count() == 0
    assert pileup.window_reads(asked, reads, least=4).count() == 4


@pytest.mark.parametrize("sizes", [(40,), (40, 7, 300)])
def test_window_lists_equal_plain_loops(spark, sizes):
    reads = [(i, "chr1" if i % 5 else "2", i * 37 % 1500, None if i % 3 else "4S6M", sizes[i % len(sizes)]) for i in range(400)]
    asked = [(1000 + k, "1" if k % 4 else "chr2", k * 23 - 200, k * 23 - 200 + 50 + k % 3) for k in range(80)]
    rows = spark.createDataFrame(reads, "read_id long, chrom string, start long, cigar string, size int")
    windows = spark.createDataFrame(asked, "window_id long, chrom string, window_start long, window_end long")
    orders = [[F.col("read_id") * 7 % 31, F.col("read_id")], [F.col("size"), -F.col("read_id")]]
    keys = [lambda r: (r[0] * 7 % 31, r[0]), lambda r: (r[4], -r[0])]
    expected, firsts = {}, {}
    for w, chrom, lo, hi in asked:
        own = [(r[2] if r[3] is None else r[2] - 4, r) for r in reads if r[1].removeprefix("chr") == chrom.removeprefix("chr")]
        own = sorted((at, r[0], r) for at, r in own if lo - 30 <= at < hi and at + r[4] >= lo)
        if len(own) >= 3:
            expected[w] = (len(own), [(at, i) for at, i, _ in own])
            firsts[w] = [[x[0] for x in sorted((r for *_, r in own), key=key)[:4]] for key in keys]
    found = pileup.window_lists(windows, rows, margin=30, least=3).collect()
    assert {r["window_id"]: (r["n"], [(x["read_start"], x["read_id"]) for x in r["reads"]]) for r in found} == expected and len(found) == len(expected) > 40
    found = pileup.window_lists(windows, rows, orders, 4, margin=30, least=3).collect()
    assert {r["window_id"]: [[x["read_id"] for x in r[f"first_{k}"]] for k in (0, 1)] for r in found} == firsts
    assert all(r["n"] == expected[r["window_id"]][0] for r in found)
    assert pileup.window_lists(windows.limit(0), rows).count() == pileup.window_lists(windows, rows.limit(0)).count() == 0


def members(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "region_id long, place int, start long, ref string, alts array<string>, gt array<int>")


def test_genotypes_and_splicing(spark):
    two = members(spark, [(3, "A", ["T"], [0, 1]), (5, "AC", ["A"], [None, 1])])
    combos = sorted((r["h0"], r["h1"]) for r in haplotypes.genotype_combos(two).collect())
    assert combos == [([0, 0], [1, 1]), ([0, 1], [1, 0])]
    same_base = members(spark, [(3, "A", ["T"], [0, 1]), (3, "A", ["G"], [0, 1])])
    good = haplotypes.possible_genotypes(same_base).collect()
    assert [(r["h0"], r["h1"]) for r in good] == [([0, 1], [1, 0])]
    region = spark.createDataFrame([(1, 1, "AAAAAAAAA")], "region_id long, start long, seq string")
    het = members(spark, [(4, "A", ["T"], [1, 0])])
    chosen = spark.createDataFrame([(1, 0, 0, [1]), (1, 0, 1, [0])], "region_id long, combo int, hap int, alleles array<int>")
    assert [r["seq"] for r in haplotypes.spliced(het, region, chosen).orderBy("hap").collect()] == ["AAATAAAAA", "AAAAAAAAA"]


def test_sampling(spark):
    df = spark.range(10).withColumn("label", F.when(F.col("id") < 3, "a").otherwise("b"))
    quotas = spark.createDataFrame([("a", 7), ("b", 2)], "label string, quota int")
    found = sampling.resample_classes(df, quotas, "label", ["id"])
    assert sorted(r["id"] for r in found.collect()) == [0, 0, 0, 1, 1, 2, 2, 3, 4]
    batches = sampling.rebatched(df.repartition(7), 4, ["id"]).orderBy("id").collect()
    assert [r["batch"] for r in batches] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert sum(r["held_out"] for r in sampling.holdout(df, 0.25, ["id"]).collect()) == 3


def test_numbers_of_many_rows_have_no_gap(spark):
    df = spark.range(0, 300_000, 1, 7).select(F.xxhash64("id").alias("key"), F.col("id").alias("kept"))
    found = sampling.rebatched(df, 1, ["key"]).orderBy("batch")
    row = found.withColumn("next", F.lead("key").over(sampling.Window.orderBy("batch"))).agg(F.min("batch"), F.max("batch"), F.countDistinct("batch"), F.count("*"), F.count_if(F.col("next") <= F.col("key")), F.sum("kept")).first()
    assert tuple(row) == (0, 299_999, 300_000, 300_000, 0, 299_999 * 150_000)


def test_numbers_begin_anew_in_each_group(spark):
    df = spark.range(10).select("id", F.when(F.col("id") != 4, F.col("id") % 3).alias("g"))
    found = {r["id"]: (r["g"], r["batch"]) for r in sampling.rebatched(df.repartition(5), 2, ["id"], "g").collect()}
    assert found == {0: (0, 0), 3: (0, 0), 6: (0, 1), 9: (0, 1), 1: (1, 0), 7: (1, 0), 2: (2, 0), 5: (2, 0), 8: (2, 1), 4: (None, 0)}


def test_confusion_without_truth(spark):
    kind = "chrom string, pos long, ref string, alt string"
    found = evaluation.agreement(evaluation.confusion(spark.createDataFrame([("chr1", 1, "A", "C")], kind), spark.createDataFrame([], kind))).collect()
    assert [(r["type"], r["tp"], r["fn"], r["fp"], r["ppa"], r["ppv"]) for r in found] == [("snv", 0, 0, 1, 0.0, 0.0)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_merge_calls_does_not_depend_on_partitions(spark, partitions):
    from locusflow.plans import relational
    from locusflow.plans import tables as T
    from tests.oracle import SMALL

    rows = T.calls(spark, SMALL).orderBy(F.xxhash64("event_id")).repartition(partitions)
    order = ["chrom", "region_no", "pos", "ref", "alt"]
    found = calls.place_haplotypes(rows).drop("ordinal").orderBy(*order).collect()
    assert found == relational.resolve_haplotypes(spark, SMALL).orderBy(*order).collect()


def test_classifier_saves_and_loads(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from locusflow.operators import classifier

    rows = spark.createDataFrame([(float(i % 2), *[float(i % 2)] * 15, i % 2) for i in range(40)], [*classifier.FEATURES, "label"])
    model = classifier.train(rows, 3, 2)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [r["qual"] for r in classifier.score(again, rows).collect()] == [r["qual"] for r in classifier.score(model, rows).collect()]


def test_forest_is_the_same_however_its_trees_are_cut(spark):
    from locusflow.operators import forest

    rows = spark.range(600).selectExpr("cast(id as string) AS record_id", "id % 37 AS a", "if(id % 50 = 7, NULL, id % 11 / 2.0D) AS b", "id % 3 AS c", "0.5D AS d", "id % 5 = 0 AS held", "cast((id % 37 > 20 AND id % 11 < 8) OR id % 29 = 0 AS int) AS label")
    whole, cut = (sorted(map(str, forest.forest(rows.repartition(k), list("abcd"), trees=6, depth=8, largest=n).collect())) for k, n in ((1, 10**6), (5, 40)))
    found = forest.forest(rows, list("abcd"), trees=6, depth=8)
    scored = {r["record_id"]: r["chance"] for r in forest.scores(found).collect()}
    truth = {r["record_id"]: r["label"] for r in rows.where("held and b is not null").collect()}
    assert [x for x in whole if "feature=-1" in x] == [x for x in cut if "feature=-1" in x]
    assert scored.keys() == truth.keys() and sum((scored[i] > 0.5) == bool(truth[i]) for i in truth) > 0.9 * len(truth)
    shares = {r["feature"]: r["importance"] for r in forest.importances(found).collect()}
    assert 3 not in shares and sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == 0
    assert forest.forest(rows.where("held"), list("abcd"), trees=2).where("value = 0.5").count() == 2 * len(truth)


def test_joins_meet_with_and_without_chr(spark):
    a = spark.createDataFrame([(1, "1", 0, 10), (2, "chrX", 0, 10)], "a long, chrom string, start long, end long")
    b = spark.createDataFrame([(1, "chr1", 5, 6), (2, "X", 9, 12)], "b long, chrom string, start long, end long")
    assert sorted((r["a"], r["b"], r["chrom"], r["r_chrom"]) for r in intervals.interval_join(a, b).collect()) == [(1, 1, "1", "chr1"), (2, 2, "chrX", "X")]


def test_with_former_over_bins(spark):
    rows = [("chr1", p, i) for i, p in enumerate([3, 3, 9, 25, 26, 90])] + [("chr2", 4, 9), (None, 1, 10), (None, 50, 11)]
    df = spark.createDataFrame(rows, "chrom string, pos long, id long")
    found = {r["id"]: (r["before"], r["p"]) for r in intervals.with_former(df, "chrom", "pos", ["pos", "id"], {"id": "before", "pos": "p"}, width=10).collect()}
    assert found == {0: (None, None), 1: (0, 3), 2: (1, 3), 3: (2, 9), 4: (3, 25), 5: (4, 26), 9: (None, None), 10: (None, None), 11: (10, 1)}


def test_large_groups_are_ranked_in_parts(spark):
    df = spark.range(5000).withColumn("label", F.when(F.col("id") % 100 == 0, "b").otherwise("a"))
    kept = sampling.in_parts(df, ["label"], ["id"], F.lit(70)).collect()
    assert sorted((r["label"], r["_place"], r["id"]) for r in kept) == [("a", k + 1, i) for k, i in enumerate([i for i in range(100) if i % 100][:70])] + [("b", k + 1, 100 * k) for k in range(50)]


def test_regions_that_span_too_far(spark):
    wide = members(spark, [(3, "A", ["T"], [0, 1]), (104, "AC", ["A"], [0, 1])])
    assert haplotypes.genotype_combos(wide).count() == 0
    assert haplotypes.possible_genotypes(wide).count() == 0
    assert [tuple(r) for r in haplotypes.unphased(wide).collect()] == [(1, 103, "span over 100")]
    homozygous = members(spark, [(3, "A", ["T"], [0, 1]), (104, "AC", ["A"], [1, 1])])
    assert [(r["h0"], r["h1"]) for r in haplotypes.possible_genotypes(homozygous).collect()] == [([0, 1], [1, 1])]
    eight = members(spark, [(3 + k, "A", ["T"], [0, 1]) for k in range(8)])
    assert haplotypes.genotype_combos(eight).count() == 2**7 and haplotypes.unphased(eight).count() == 0
    assert haplotypes.genotype_combos(eight, most=100).count() == 0
    assert [tuple(r) for r in haplotypes.unphased(eight, most=100).collect()] == [(1, 8, "over 100 ways")]


def pairs_by_product(rows):
    """Unordered pairs of allele lists by plain enumeration, without those with overlapping alleles."""
    from itertools import product

    def cut(start, ref, alt):
        while ref and alt and ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        while ref and alt and ref[0] == alt[0]:
            start, ref, alt = start + 1, ref[1:], alt[1:]
        return start, start + len(ref)

    def fits(h):
        used = [cut(start, ref, alts[k - 1]) for (start, ref, alts, _), k in zip(rows, h, strict=True) if k]
        return not any((a == c if a == b and c == d else a < b and c < d and a < d and c < b) for i, (a, b) in enumerate(used) for c, d in used[:i])

    every, possible = set(), set()
    for ways in product(*(((g[0] or 0, g[1] or 0), (g[1] or 0, g[0] or 0)) for *_, g in rows)):
        pair = tuple(sorted(zip(*ways, strict=True)))
        every.add(pair)
        if all(map(fits, pair)):
            possible.add(pair)
    return sorted(every), sorted(possible)


def test_genotypes_by_enumeration(spark):
    import random

    rng = random.Random(3)
    regions = {}
    for k in range(30):
        rows = []
        for _ in range(rng.randrange(1, 7)):
            ref = "".join(rng.choice("AC") for _ in range(rng.randrange(1, 4)))
            alts = [ref[0] + "".join(rng.choice("ACG") for _ in range(rng.randrange(0, 3))) + rng.choice("GT") for _ in range(3)]
            rows.append((rng.randrange(20), ref, alts, [rng.choice([None, 0, 1, 2, 3]) for _ in range(2)]))
        regions[k] = sorted(rows, key=lambda r: r[0])
    frame = spark.createDataFrame([(k, i + 1, *r) for k, rows in regions.items() for i, r in enumerate(rows)], "region_id long, place int, start long, ref string, alts array<string>, gt array<int>")
    for found, which in ((haplotypes.genotype_combos(frame), 0), (haplotypes.possible_genotypes(frame), 1)):
        by_region = {}
        for r in sorted(found.collect(), key=lambda r: (r["region_id"], r["combo"])):
            by_region.setdefault(r["region_id"], []).append((tuple(r["h0"]), tuple(r["h1"])))
        assert all(by_region.get(k, []) == pairs_by_product(rows)[which] for k, rows in regions.items())


def test_many_variants_in_a_stretch(spark):
    """Sixty variants, forty of them homozygous; overlapping alternatives leave few of the 2**19 ways."""
    rows = [(k, "A", ["T"], [1, 1]) for k in range(40)] + [(40 + k // 5, "A", ["C", "G", "T"], [0, 1 + k % 3]) for k in range(20)]
    assert haplotypes.possible_genotypes(members(spark, rows)).count() == 0  # five alternatives on one base fit on no two haplotypes
    rows = [(k, "A", ["T"], [1, 1]) for k in range(40)] + [(40 + k // 2, "A", ["C", "G", "T"], [0, 1 + k % 3]) for k in range(20)]
    out = haplotypes.possible_genotypes(members(spark, rows)).collect()
    assert len(out) == 2**9 and all(r["h0"][:40] == r["h1"][:40] == [1] * 40 and all((r["h0"][i] > 0) != (r["h0"][i + 1] > 0) for i in range(40, 60, 2)) for r in out)
    assert haplotypes.genotype_combos(members(spark, rows)).count() == 0  # 2**19 ways where overlaps are let through


def test_third_alternatives_and_shared_sequences(spark):
    region = spark.createDataFrame([(1, 0, "AAAAAAAAA")], "region_id long, start long, seq string")
    var = members(spark, [(4, "A", ["C", "G", "TT"], [3, 2])])
    chosen = spark.createDataFrame([(1, 1, 0, [3]), (1, 1, 1, [2])], "region_id long, combo int, hap int, alleles array<int>")
    made = haplotypes.spliced(var, region, chosen)
    assert [r["seq"] for r in made.orderBy("hap").collect()] == ["AAAATTAAAA", "AAAAGAAAA"]
    haps = spark.createDataFrame([(1, 1, 0, "ACGT"), (1, 1, 1, "AAAA"), (1, 2, 0, "ACGT"), (1, 2, 1, "ACCT"), (2, 1, 0, "GG"), (2, 1, 1, "GG"), (3, 1, 0, "A"), (3, 1, 1, "C")], "region_id long, combo int, hap int, seq string")
    reads = spark.createDataFrame([(1, 1, "ACGT"), (1, 2, "ACAT"), (2, 3, "TTTTTT"), (1, 4, "AAAT")], "region_id long, read_id long, bases string")
    out = {(r["region_id"], r["combo"], r["hap"]): r["support"] for r in haplotypes.haplotype_support(haps, reads).collect()}
    # The second read is one step from ACGT (two haplotypes) and ACCT; the fourth one from AAAA alone.
    assert out == {(1, 1, 0): pytest.approx(0.5 + 1 / 3), (1, 2, 0): pytest.approx(0.5 + 1 / 3), (1, 2, 1): pytest.approx(1 / 3), (1, 1, 1): pytest.approx(1.0), (2, 1, 0): 0.5, (2, 1, 1): 0.5}


def test_several_heterozygous_variants_take_the_best_genotype(spark):
    from locusflow.plans.relational import chosen_haplotypes

    two = members(spark, [(3, "A", ["T"], [0, 1]), (5, "C", ["A"], [0, 1])])
    good = haplotypes.genotype_combos(two)
    best = good.where("h0 = array(0, 1)").select("region_id", "combo")
    assert sorted(tuple(r["alleles"]) for r in chosen_haplotypes(two, good, best).collect()) == [(0, 1), (1, 0)]
    assert sorted(tuple(r["alleles"]) for r in chosen_haplotypes(two, good, best.limit(0)).collect()) == [(0, 0), (1, 1)]  # no read: the first


def test_alignment_text(spark, tmp_path):
    from locusflow.sources import text

    lines = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:99", "r1\t16\tchr1\t5\t60\t2M1I\t*\t0\t0\tACG\tI\"!\tNM:i:1", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI", "r3\t0\tchr1\t7\t0\t*\t*\t0\t0\tAC\t*", ""]
    (tmp_path / "a.sam").write_text("\n".join(lines))
    rows = {r["read_id"]: r for r in text.read_alignments(spark, str(tmp_path / "a.sam")).collect()}
    assert rows.keys() == {"r1", "r3"}
    assert (rows["r1"]["start"], rows["r1"]["is_reverse"], rows["r1"]["quals"], rows["r1"]["cigar"]) == (4, True, [40, 1, 0], "2M1I")
    assert (rows["r3"]["cigar"], rows["r3"]["quals"], rows["r3"]["size"]) == (None, [], 2)


def test_record_files_begin_with_a_header(spark, tmp_path):
    from locusflow.sources import text

    rows = spark.createDataFrame([("chr2", 5, "A", "T", 0.5, "PASS", 9, 3, "0/1", None)], "chrom string, pos long, ref string, alt string, qual double, filter string, depth long, call_count long, gt string, phase_set long")
    contigs = spark.createDataFrame([("chr2", 99)], "chrom string, length long")
    text.write_records(rows.repartition(3), str(tmp_path / "v"), contigs, "s1")
    lines = [x for f in sorted((tmp_path / "v").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-2].endswith("FORMAT\ts1") and "##contig=<ID=chr2,length=99>" in lines
    assert lines[-1] == "chr2\t5\t.\tA\tT\t0.5000\tPASS\tCALL_COUNT=3\tGT:DP:PS\t0/1:9:."
    assert text.read_records(spark, str(tmp_path / "v")).count() == 1


def test_reordering_over_batches_restarts_and_retries(spark, tmp_path):
    from locusflow.streaming import sites

    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), "pos long, id long").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("pos long, id long").option("maxFilesPerTrigger", 1).parquet(source)
        sites.reordered(stream, path, ["pos", "id"], state)
        return sorted((r["batch"], r["pos"], r["id"], r["late"]) for r in sites.reordered_rows(spark, path, "pos long, id long").collect())

    arrive((5, 1), (3, 2))
    arrive((9, 3), (4, 4))
    first = [(0, 3, 2, False), (0, 5, 1, False), (1, 4, 4, True), (1, 9, 3, False)]
    assert run() == first
    arrive((8, 5), (10, 6))  # after a restart from the state
    assert run() == [*first, (2, 8, 5, True), (2, 10, 6, False)]
    (tmp_path / "state" / "commits" / "2").unlink()  # as if the last batch had failed before its end
    (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert run() == [*first, (2, 8, 5, True), (2, 10, 6, False)]


def test_late_reads_do_not_count_for_sites_that_were_handed_on(spark, tmp_path):
    """Several micro-batches: state is kept between them, the watermark drops what comes too late."""
    from locusflow.streaming import sites

    schema, source = "read_id long, chrom string, start long, cigar string, bases string, quals array<int>", str(tmp_path / "in")
    ref = spark.createDataFrame([("chr1", k, "A" * 20) for k in range(5)], "chrom string, chunk long, seq string")

    def arrive(*rows):
        spark.createDataFrame([(i, c, s, f"{len(b)}M", b, [30] * len(b)) for i, c, s, b in rows], schema).coalesce(1).write.mode("append").parquet(source)

    arrive((1, "chr1", 10, "AC"), (2, "chr1", 10, "AC"))
    arrive((3, "chr1", 11, "CA"))  # the third mismatch at 11 comes in a later batch
    arrive((4, "chr1", 50, "CC"), (5, "chr1", 50, "CA"))
    arrive((6, "chr1", 90, "A"))
    arrive((6, "chr1", 91, "A"))  # rows are late by the watermark of the batch before
    arrive((7, "chr1", 50, "C"))  # too late for 50, where two mismatches are not enough
    arrive((8, "chr99", 0, "A"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = sites.run_available(sites.suspect_sites(stream, ref, longest_span=5, size=20)).collect()
    assert [tuple(r) for r in found] == [("chr1", 11)]


def test_shared_folder_is_the_sessions_own(spark):
    from pathlib import Path

    from locusflow.sources import text

    folder = text.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and Path(folder).is_dir() and text.shared_folder(spark) == folder
    assert text.shared_path(spark) != text.shared_path(spark)


@pytest.mark.parametrize("master", ["local", "local[3]", "local[*]"])
def test_a_local_session_gets_one_folder_and_keeps_its_settings(spark, master):
    from types import SimpleNamespace

    from locusflow.sources import text

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"), _jvm=spark._jvm, _jsc=spark._jsc)
    first = text.shared_folder(session)
    assert text.shared_folder(session) == first and session.conf == {}


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from locusflow.sources import text

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        text.shared_folder(session)


def test_labelling_rules(spark):
    """Base marks with CA and rows without a call are skipped; alternatives of a false positive go by its genotype."""
    kind = "record_id long, chrom string, pos long, ref string, alts array<string>, base string, call string, genotype array<int>"
    rows = [
        (1, "chr1", 5, "A", ["C", "G"], None, "TP", [1, 2]), (2, "chr1", 6, "A", ["C"], "T;CA", "TP", [0, 1]), (3, "chr1", 7, "A", ["C"], "", None, [0, 1]), (4, "chr1", 8, "A", ["C", "G", "T"], "N", "FP", [0, 3]),
        (5, "chr1", 9, "A", ["C", "G"], None, "FP", [None, 2]), (6, "chr1", 10, "A", ["C", "G"], None, "FP", [2, 1]), (7, "chr1", 11, "A", ["C"], None, "FP", [0, None]), (8, "chr1", 12, "A", ["C"], None, "UNK", [0, 1]),
        (9, "chr1", 13, "A", ["C"], None, "FP", [1, 1]), (10, "chr2", 5, "A", ["C", "G"], None, "TP", [1, 2]),
    ]
    files = "chrom string, pos long, ref string, alts array<string>, found_id long"
    tp = spark.createDataFrame([("chr1", 5, "A", ["G", "C"], 70), ("chr1", 5, "A", ["G", "C"], 71), ("chr1", 6, "A", ["C"], 72), ("chr1", 7, "A", ["C"], 73), ("chr2", 5, "A", ["C"], 74)], files)
    fp = spark.createDataFrame([("chr1", 8, "A", ["T"], 80), ("chr1", 9, "A", ["G"], 81), ("chr1", 10, "A", ["C", "G"], 82), ("chr1", 13, "A", ["C"], 83), ("chr1", 12, "A", ["C"], 84)], files)
    out = evaluation.labelled(spark.createDataFrame(rows, kind), tp, fp).collect()
    assert sorted((r["record_id"], r["label"], r["found_id"]) for r in out) == [(1, 1, 70), (4, 0, 80), (5, 0, 81), (6, 0, 82), (9, 0, 83)]


def test_cuts_over_ranges_of_scores(spark):
    import random

    rng = random.Random(5)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(500)] + [(None, 1), (0.5, None)]
    frame = spark.createDataFrame(rows, "score double, label int").repartition(6)
    kept = [(s, y) for s, y in rows if s is not None and y is not None]
    every = sum(y for _, y in kept)
    out = {r["cut"]: r for r in evaluation.threshold_sweep(frame).collect()}
    assert sorted(out) == sorted({s for s, _ in kept})
    for cut, r in out.items():
        tp, fp = sum(y for s, y in kept if s >= cut), sum(1 - y for s, y in kept if s >= cut)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, every - tp)
        assert r["f1"] == pytest.approx(2 * tp / (tp + fp + every)) and r["ppa"] == pytest.approx(tp / every) and r["ppv"] == pytest.approx(tp / (tp + fp))
    best = evaluation.quality_of(frame.where("score is not null and label is not null"), 0.25).first()
    assert (best["tp"], best["fp"]) == (sum(y for s, y in kept if s > 0.25), sum(1 - y for s, y in kept if s > 0.25))
    assert best["best_f1"] == pytest.approx(max(r["f1"] for r in out.values()))
    assert evaluation.threshold_sweep(frame.limit(0)).count() == 0


def test_features_of_homozygous_records(spark):
    from locusflow.operators import classifier

    kind = "record_id string, qual double, ref string, alt string, quals array<double>, window_var_count long, window_cis_vars long, step_count long, call_count long, window_offsets array<long>, depth long, gt string"
    rows = [("a", 0.5, "AC", "A", [0.4, 0.6], 2, 1, 1, 2, [9], 30, "1/1"), ("b", 0.2, "A", "CGT", [0.2], 1, 3, 1, 1, [7, 3], 0, "0/1"), ("c", 0.2, "A", "C", [0.2], 1, 3, 1, 1, [7], 0, "./1")]
    evidence = spark.createDataFrame([("a", 10, 2, 3, 0.5), ("b", 0, 0, 0, -1.0), ("c", 1, 0, 0, 0.0)], "record_id string, reads long, pos_alt long, neg_alt long, vaf double")
    out = {r["record_id"]: [r[f] for f in classifier.FEATURES] for r in classifier.record_features(spark.createDataFrame(rows, kind), evidence).collect()}
    assert out == {"a": [0.5, 2, 1, 0.4, 0.6, 2, 1, 1, 2, 9, 9, 30, 0, 0.5, 10, 5], "b": [0.2, 1, 3, 0.2, 0.2, 1, 3, 1, 1, 3, 7, 0, 1, -1.0, 0, 0], "c": [0.2, 1, 1, 0.2, 0.2, 1, 3, 1, 1, 7, 7, 0, 0, 0.0, 1, 0]}


@pytest.mark.parametrize(("width", "strict"), [(scans.WIDTH, True), (64, True), (7, False), (100, False)])
def test_scans_over_bins(spark, width, strict):
    """Groups of many bins, without gaps, against a pass from left to right."""
    import random

    rng = random.Random(width)
    places = {c: sorted(rng.sample(range(-300, 4000), n)) for c, n in (("a", 1), ("b", 2500), ("c", 150), (None, 60))}
    rows = [(c, p) for c, group in places.items() for p in group] * 2 + [("a", None)]
    rng.shuffle(rows)
    out = scans.anchored_scan(spark.createDataFrame(rows, "chrom string, pos long").repartition(5), ["chrom"], 30, strict=strict, width=width)
    expected = []
    for c, group in places.items():
        done = []
        for p in group:
            if done and (p - done[-1][0] < 30 or (not strict and p - done[-1][0] == 30)):
                done[-1][1] = p
            else:
                done.append([p, p])
        expected += [(c, *d) for d in done]
    assert sorted(map(tuple, out.select("chrom", "lo", "hi").collect()), key=repr) == sorted(expected, key=repr)

    ranges = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 3, 20, 400])) for s in rng.sample(range(-500, 9000), 400)]
    merged = scans.merge_ranges(spark.createDataFrame(ranges + ranges[:20], "chrom string, start long, end long").repartition(3), ["chrom"], width)
    expected = []
    for c in ("a", "b", None):
        done = []
        for _, s, e in sorted(r for r in ranges if r[0] == c) if c else sorted((r for r in ranges if r[0] is None), key=lambda r: r[1:]):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        expected += [(c, *d) for d in done]
    assert sorted(map(tuple, merged.select("chrom", "start", "end").collect()), key=repr) == sorted(expected, key=repr)
    assert scans.anchored_scan(spark.createDataFrame([], "chrom string, pos long"), ["chrom"], 30).count() == scans.merge_ranges(spark.createDataFrame([], "chrom string, start long, end long"), ["chrom"]).count() == 0


def test_a_fetch_reads_the_asked_folders_alone(spark, tmp_path):
    from locusflow.sources import layout

    rows = [(k, f"chr{k % 3 + 1}", k * 10, k * 10 + (5000 if k == 30 else 25)) for k in range(900)] + [(900, "chr9", 5, 6)]
    schema = "row_id long, chrom string, start long, end long"
    frame = spark.createDataFrame(rows, schema)
    path = f"{tmp_path}/layout"
    layout.write_layout(frame, path, width=1000, parts=2)
    regions = spark.createDataFrame([(1, "chr1", 4200, 4300), (2, "1", 8005, 8011), (3, "chr7", 0, 9999), (4, "chr9", 5, 6)], "region_id long, chrom string, start long, end long")
    found = layout.read_layout(spark, path, schema, regions)
    folders = {"/".join(f.split("/")[-3:-1]) for f in found.inputFiles()}
    assert folders == {"_name=1/_bin=0", "_name=1/_bin=4", "_name=1/_bin=8", "_name=9/_bin=0"}  # the long row of the first one reaches the others
    every = layout.read_layout(spark, path, schema)
    assert sorted(map(tuple, every.select("row_id", "chrom", "start", "end").collect())) == rows and len(every.inputFiles()) > len(found.inputFiles())
    expected = sorted(map(tuple, intervals.interval_join(regions, frame).select("region_id", "row_id").collect()))
    for most in (layout.MOST_FOLDERS, 1):  # one by one, or all
        assert sorted(map(tuple, layout.fetch(spark, path, schema, regions, most).select("region_id", "row_id").collect())) == expected
    assert layout.fetch(spark, path, schema, regions.where("region_id = 3")).count() == 0 and (4, 900) in expected and any(r == 30 for _, r in expected)


def test_crowded_bins_are_split(spark):
    """A bin with a thousand times the usual load: pairs as without splitting, and no part with more than the bound."""
    import random

    rng = random.Random(8)
    usual = [(k, "chr1", k * 40, k * 40 + 30) for k in range(400)]
    crowd = [(1000 + k, "1", 5000 + rng.randrange(40), 5100 + rng.randrange(40)) for k in range(10_000)]
    reads = spark.createDataFrame(usual + crowd, "read_id long, chrom string, start long, end long").repartition(4)
    sites = spark.createDataFrame([(k, "chr1", k * 97, k * 97 + 2) for k in range(160)], "site long, chrom string, start long, end long")
    expected = sorted(map(tuple, intervals.interval_join(sites, reads, width=128).select("site", "read_id").collect()))
    for left, right in ((sites, reads), (reads, sites)):
        out = intervals.interval_join(left, right, width=128, most=500)
        assert sorted(map(tuple, out.select("site", "read_id").collect())) == expected
        a, b = intervals.split_bins(*intervals.placed(left, right, 128), 500)
        for side, name, number in ((a, "_name", "bin"), (b, "r_name", "r_bin")):
            assert side.groupBy(name, number, "part").count().agg(F.max("count")).first()[0] <= 650
    assert intervals.interval_join(sites, reads, width=128, most=500, condition=F.col("read_id") < 1000).count() == len([p for p in expected if p[1] < 1000])


def test_stream_state_is_one_row_for_each_open_piece(spark, tmp_path):
    """Four micro-batches: the sites are those of the batch form, and only pieces near the last reads are held."""
    from locusflow.plans import tables
    from locusflow.plans.streams import as_stream
    from locusflow.streaming import sites
    from tests.oracle import SMALL

    reads, chunks = tables.reads(spark, SMALL), tables.ref_chunks(spark, SMALL)
    stream = sites.suspect_sites(as_stream(reads, ["chrom", "start"]), chunks)
    running = stream.writeStream.format("memory").queryName("found_sites").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    held = running.lastProgress["stateOperators"][0]["numRowsTotal"]
    last = reads.agg(F.max("chrom").alias("chrom")).first()["chrom"]
    expected = pileup.suspect_spots(pileup.pileup(reads, chunks)).select("chrom", "pos")
    found = spark.table("found_sites")
    assert found.count() == found.distinct().count() > 0 and found.join(expected, ["chrom", "pos"], "left_anti").count() == 0
    missing = expected.join(found, ["chrom", "pos"], "left_anti").groupBy("chrom").agg(F.min("pos").alias("pos")).collect()
    top = reads.where(F.col("chrom") == last).agg(F.max("start")).first()[0]
    # No sentinel row: what lies within the watermark's delay of the last read is still open.
    assert all(r["chrom"] == last and r["pos"] >= top - 1000 - pileup.CHUNK for r in missing) and 0 < held <= (1000 + 200) // pileup.CHUNK + 2


def test_depths_at_sites_equal_the_pileup(spark):
    """Deletions, insertions, clips, chunk borders, reads beyond the reference, and one chunk of great depth."""
    letters = "ACGT" * 160  # 640 bases: two and a half chunks
    ref = spark.createDataFrame([("chr1", k, letters[256 * k : 256 * k + 256]) for k in range(3)], "chrom string, chunk long, seq string")
    cigars = ["20M", "5S10M2D5M", "8M4I8M", None, "3M300N17M"]
    reads = spark.createDataFrame([(k, "chr1", (k * 37) % 660, cigars[k % 5], "A" * 20) for k in range(120)] + [(200 + k, "chr1", 250, "20M", "C" * 20) for k in range(500)], "read_id long, chrom string, start long, cigar string, bases string")
    sites = spark.createDataFrame([("chr1", p) for p in range(-3, 700, 3)] + [("chr2", 5), (None, 5), ("chr1", None)], "chrom string, pos long")
    expected = {r["pos"]: r["depth"] for r in pileup.pileup(reads, ref).collect()}
    found = {r["pos"]: r["depth"] for r in pileup.depths_at(sites, reads, ref).collect()}
    assert found == {p: d for p, d in expected.items() if p % 3 == 0} and max(found.values()) > 500
    assert {r["pos"]: r["base"] for r in pileup.bases_at(sites, ref).collect()} == {p: letters[p] for p in range(0, 640, 3)}


def test_placed_keys_against_plain_loops(spark):
    """Sides of random keys, each held against the heterozygous key before it; without a join in the plan."""
    import random

    rng = random.Random(3)
    rows = []
    for region in range(12):
        for window in range(6):
            for hap in (0, 1):
                for place, pos in enumerate(sorted(rng.sample(range(30), rng.randint(0, 8)))):
                    rows.append(("chr1", region, 0, 1000, window, hap, pos, "A", rng.choice("CG"), 0.9, pos, place, 8))
    df = spark.createDataFrame(rows, CALLS)
    expected = {}
    for region in range(12):
        keys = {}
        for r in rows:
            if r[1] == region:
                keys.setdefault(r[6:9], []).append((r[5], r[4], r[11]))
        former, side = None, 0
        for key in sorted(keys, key=lambda k: (k[0], min(keys[k]))):
            on = [{w for h, w, _ in keys[key] if h == hap} for hap in (0, 1)]
            both = len(on[0] & on[1])
            if both > len(on[0] | on[1]) - both:
                expected[(region, *key)] = (True, 0)
                continue
            if former:
                shared = (on[0] | on[1]) & (former[0] | former[1])
                cis = sum(any(w in on[h] and w in former[h] for h in (0, 1)) for w in shared)
                side ^= len(shared) - cis >= cis
            expected[(region, *key)] = (False, int(side))
            former = on
    placed = calls.place_haplotypes(df)
    assert {(r["region_no"], r["pos"], r["ref"], r["alt"]): (r["hom"], r["side"]) for r in placed.collect()} == expected
    assert "Join" not in placed._jdf.queryExecution().toString()
