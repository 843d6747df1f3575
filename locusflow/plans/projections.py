"""Queries of single-row functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles, quality, sequences
from ..operators import sampling
from ..sources import text
from . import tables as T
from .registry import query

SEED = 7


@query("SELECT CAST(read_id AS VARCHAR) AS read_id, chrom, start, cigar, mapq, is_reverse, bases, list_sum(quals) AS qual_sum, len(quals) AS n_quals FROM reads")
def alignment_source(spark, sf):
    """Reads written as alignment text and read back."""
    path = text.shared_path(spark)
    text.write_alignments(T.reads(spark, sf), path)
    total = F.aggregate("quals", F.lit(0).cast("long"), lambda s, q: s + q)
    return text.read_alignments(spark, path).select("read_id", "chrom", "start", "cigar", "mapq", "is_reverse", "bases", total.alias("qual_sum"), F.size("quals").cast("long").alias("n_quals"))


@query("SELECT region_id, chrom, label FROM regions")
def concat_metadata(spark, sf):
    """Files of two samples as one."""
    rows, schema = T.regions(spark, sf).select("region_id", "chrom", "label"), "region_id long, chrom string, label string"
    paths = [text.shared_path(spark) for _ in range(3)]
    for k in (0, 1):
        rows.where(F.col("region_id") % 2 == k).write.option("header", True).csv(paths[k])
    text.concatenated(spark, paths[:2], schema, paths[2])
    return spark.read.option("header", True).schema(schema).csv(paths[2])


@query("""SELECT n, line FROM (SELECT row_number() OVER (ORDER BY a, b, ref, alt) - 1 AS n, line FROM (SELECT 0 AS a, chrom_value AS b, '' AS ref, '' AS alt, '##contig=<ID=' || chrom || ',length=' || length || '>' AS line FROM (SELECT chrom, CAST(substr(chrom, 4) AS INTEGER) AS chrom_value, max(pos) + 1 AS length FROM ref_bases GROUP BY chrom)
  UNION ALL SELECT CAST(substr(chrom, 4) AS INTEGER) AS a, pos, ref, alts[1], chrom || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref || chr(9) || alts[1] || chr(9) || '12.3400' || chr(9) || 'PASS' || chr(9) || 'CALL_COUNT=3' || chr(9) || 'GT:DP:PS' || chr(9) || '0/1:30:.' FROM variants))""")
def vcf_sink(spark, sf):
    """The contig lines of the header and all records of a written file, numbered as they stand in it."""
    rows = T.variants(spark, sf).selectExpr("chrom", "pos + 1 AS pos", "ref", "alts[0] AS alt", "12.34D AS qual", "'PASS' AS filter", "30L AS depth", "3L AS call_count", "'0/1' AS gt", "cast(null AS long) AS phase_set")
    path = text.shared_path(spark)
    text.write_records(rows, path, T.ref_bases(spark, sf).groupBy("chrom").agg((F.max("pos") + 1).alias("length")))
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"))
    kept = lines.where("not startswith(line, '#') or startswith(line, '##contig')")
    return sampling.rebatched(kept, 1, ["file", "block", "at"]).select(F.col("batch").alias("n"), "line")


@query("SELECT chrom, start, \"end\", label FROM regions")
def bed_source(spark, sf):
    path = text.shared_path(spark)
    text.write_bed(T.regions(spark, sf), path)
    return text.read_bed(spark, path)


@query("SELECT label, row_number() OVER (ORDER BY min(file_order)) - 1 AS class_index FROM regions GROUP BY label")
def label_class_index(spark, sf):
    return text.label_classes(T.regions(spark, sf))


@query("""SELECT chrom, pos + 1 AS pos, CASE WHEN ref = '' THEN 'N' ELSE ref END AS ref, [CASE WHEN alt = '' THEN 'N' ELSE alt END] AS alts, record_id % 1000 / 1000.0 AS qual, 'PASS' AS filter, n AS call_count FROM evaluated""")
def vcf_source(spark, sf):
    """Records written as text and read back, with parsed alts and info."""
    records = T.evaluated(spark, sf).selectExpr("chrom", "pos + 1 AS pos", "if(ref = '', 'N', ref) AS ref", "if(alt = '', 'N', alt) AS alt", "record_id % 1000 / 1000.0D AS qual", "'PASS' AS filter", "10L AS depth", "n AS call_count", "'0/1' AS gt", "cast(null AS long) AS phase_set")
    path = text.shared_path(spark)
    text.write_records(records, path)
    rows = text.read_records(spark, path)
    return rows.select("chrom", "pos", "ref", "alts", "qual", "filter", F.col("info")["CALL_COUNT"].cast("long").alias("call_count"))


RENDER = """SELECT chrom, pos + 1 AS pos, chrom || chr(9) || (pos + 1) || chr(9) || '.' || chr(9) || ref[1] || chr(9) || alts[1] || chr(9) || '12.3400' || chr(9) || 'PASS' || chr(9) || 'CALL_COUNT=3' || chr(9) || 'GT:DP:PS'
  || chr(9) || '0/1:30:' || coalesce(CAST(CASE WHEN variant_id % 2 = 0 THEN pos END AS VARCHAR), '.') AS line, CAST(substr(chrom, 4) AS INTEGER) AS chrom_order FROM variants"""


@query(RENDER.replace("ref[1]", "ref"))
def vcf_render(spark, sf):
    rows = T.variants(spark, sf).selectExpr("chrom", "pos + 1 AS pos", "ref", "alts[0] AS alt", "12.34D AS qual", "'PASS' AS filter", "30L AS depth", "3L AS call_count", "'0/1' AS gt", "if(variant_id % 2 = 0, pos, null) AS phase_set")
    return text.record_lines(rows).select("chrom", "pos", "line", "chrom_order")


@query("SELECT region_id, string_agg(base, '' ORDER BY pos) AS seq FROM regions JOIN ref_bases ON regions.chrom = ref_bases.chrom AND pos >= start AND pos < \"end\" GROUP BY region_id")
def ref_slice(spark, sf):
    return reference_slices(T.regions(spark, sf), T.ref_chunks(spark, sf))


def reference_slices(regions, chunks, size: int = 256):
    """(region_id, seq): each region's bases, cut from the chunks that it touches."""
    numbered = regions.select("region_id", "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"))
    rows = numbered.join(chunks, ["chrom", "chunk"]).withColumn("low", F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0)).cast("int"))
    part = F.substring("seq", F.col("low") + 1, F.least(F.col("end") - F.col("chunk") * size, F.lit(size)).cast("int") - F.col("low"))
    lists = rows.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))).alias("x"))
    return lists.select("region_id", F.array_join(F.transform("x", lambda y: y["part"]), "").alias("seq"))


@query("SELECT concat_ws('-', chrom, pos, ref, alt) AS variant, qual, length(ref) AS ref_len, length(alt) AS alt_len, n AS call_count, CASE WHEN call = 'TP' THEN 1 ELSE 0 END AS label FROM evaluated")
def feature_dump(spark, sf):
    rows = T.evaluated(spark, sf).select(
        F.concat_ws("-", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("variant"), "qual", F.length("ref").cast("long").alias("ref_len"), F.length("alt").cast("long").alias("alt_len"),
        F.col("n").alias("call_count"), (F.col("call") == "TP").cast("int").alias("label"),
    )
    path = text.shared_path(spark)
    rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


FILES = "SELECT 'run/' || CASE event_id % 2 WHEN 0 THEN 'src_' ELSE 'tgt_' END || event_type || '_' || (event_id // 3) AS path FROM events"


@query(f"""WITH files AS (SELECT DISTINCT path FROM ({FILES}))
SELECT regexp_extract(a.path, '([^_]+)$', 1) AS suffix, a.path AS src, b.path AS tgt FROM files a JOIN files b ON regexp_extract(a.path, '([^_]+)$', 1) = regexp_extract(b.path, '([^_]+)$', 1)
WHERE regexp_extract(a.path, '([^/]+)$', 1) LIKE 'src\\_%' ESCAPE '\\' AND regexp_extract(b.path, '([^/]+)$', 1) LIKE 'tgt\\_%' ESCAPE '\\'""")
def pair_by_suffix(spark, sf):
    files = T.source(spark, sf, "events").selectExpr("concat('run/', CASE event_id % 2 WHEN 0 THEN 'src_' ELSE 'tgt_' END, event_type, '_', event_id div 3) AS path").distinct()
    return text.pair_by_suffix(files)


@query("SELECT concat('s', site % 2) AS sample, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total_pos FROM calls GROUP BY 1")
def multi_sample_union(spark, sf):
    rows = T.calls(spark, sf).select("site", "pos")
    samples = [rows.where(F.col("site") % 2 == k).withColumn("sample", F.lit(f"s{k}")) for k in (0, 1)]
    return samples[0].unionByName(samples[1]).groupBy("sample").agg(F.count("*").alias("n"), F.sum("pos").alias("total_pos"))


@query("SELECT region_id, chrom, CASE WHEN chrom IN ('chr1', 'chr2') THEN '1-2' WHEN chrom = 'chr3' THEN '3' ELSE 'rest' END AS chrom_group FROM regions")
def chrom_groups(spark, sf):
    group = F.when(F.col("chrom").isin("chr1", "chr2"), "1-2").when(F.col("chrom") == "chr3", "3").otherwise("rest")
    rows = T.regions(spark, sf).select("region_id", "chrom", group.alias("chrom_group"))
    path = text.shared_path(spark)
    rows.write.partitionBy("chrom_group").parquet(path)
    return spark.read.schema("region_id long, chrom string, chrom_group string").parquet(path)


KMER = "list_transform(range(0, length(seq) // 4), lambda i: CAST(list_sum(list_transform(range(0, 4), lambda j: (strpos('ACGT', substr(seq, i * 4 + j + 1, 1)) - 1) * CAST(pow(4, 3 - j) AS BIGINT))) AS INTEGER))"


@query(f"SELECT doc_id, list_concat([259], {KMER}) AS tokens FROM (SELECT doc_id, substr(seq, 1, 148) AS seq FROM base_sequences)")
def kmer_targets(spark, sf):
    tokens = F.concat(F.array(F.lit(sequences.START_TOKEN)), sequences.kmer_indices(F.substring("seq", 1, 148)))
    path = text.shared_path(spark)
    T.base_sequences(spark, sf).select("doc_id", tokens.alias("tokens")).write.parquet(path)
    return spark.read.parquet(path)


@query(f"SELECT doc_id, {KMER} AS kmers FROM base_sequences")
def kmer_encode(spark, sf):
    return T.base_sequences(spark, sf).select("doc_id", sequences.kmer_indices(F.col("seq")).alias("kmers"))


@query("SELECT doc_id, seq FROM base_sequences")
def kmer_decode(spark, sf):
    return kmer_encode(spark, sf).select("doc_id", sequences.kmer_string(F.col("kmers")).alias("seq"))


@query("SELECT window_no, flatten(list_transform(list(logp ORDER BY i), lambda x: [x, x, x, x])) AS expanded FROM hap_tokens GROUP BY window_no")
def expand_values(spark, sf):
    lists = T.hap_tokens(spark, sf).groupBy("window_no").agg(F.array_sort(F.collect_list(F.struct("i", "logp"))).alias("x"))
    return lists.select("window_no", sequences.expanded(F.transform("x", lambda y: y["logp"])).alias("expanded"))


TYPE = "CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) = 0 AND length(alt) > 0 THEN 'ins' WHEN length(ref) > 0 AND length(alt) = 0 THEN 'del' WHEN length(ref) > 0 AND length(alt) > 0 THEN 'mnv' ELSE 'unknown' END"
PADDED = "CASE WHEN length(ref) = 1 AND length(alts[1]) = 1 THEN 'snv' WHEN length(ref) > 1 AND length(alts[1]) = 1 THEN 'del' WHEN length(ref) = 1 AND length(alts[1]) > 1 THEN 'ins' END"


@query(f"SELECT {TYPE} AS type, count(*) AS n FROM calls GROUP BY 1")
def var_type_counts(spark, sf):
    return T.calls(spark, sf).groupBy(alleles.var_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count("*").alias("n"))


@query(f"SELECT variant_id, {PADDED} AS type FROM variants")
def var_type_padded(spark, sf):
    return T.variants(spark, sf).select("variant_id", alleles.padded_type(F.col("ref"), F.element_at("alts", 1)).alias("type"))


#: Pairs of strings with shared ends, from neighbouring documents' bases.
PAIRS = "substr(seq, 1, CAST(1 + doc_id % 9 AS INT)) AS a, concat(substr(seq, 1, CAST(doc_id % 5 AS INT)), substr(seq, CAST(1 + doc_id % 3 AS INT), CAST(1 + doc_id % 7 AS INT))) AS b"


@query(f"""WITH p AS (SELECT doc_id, {PAIRS} FROM base_sequences WHERE length(seq) >= 20),
s AS (SELECT *, (SELECT coalesce(max(k), 0) FROM unnest(range(1, least(length(a), length(b)))) u(k) WHERE right(a, k) = right(b, k)) AS suffix FROM p),
t AS (SELECT *, substr(a, 1, length(a) - suffix) AS a1, substr(b, 1, length(b) - suffix) AS b1 FROM s),
u AS (SELECT *, (SELECT coalesce(max(k), 0) FROM unnest(range(1, least(length(a1), length(b1)))) u(k) WHERE left(a1, k) = left(b1, k)) AS prefix FROM t)
SELECT doc_id, CAST(prefix AS INTEGER) AS offset, substr(a1, prefix + 1) AS ref, substr(b1, prefix + 1) AS alt FROM u""".replace("unnest(range(1, least(length(a), length(b))))", "range(1, least(length(a), length(b)))").replace("unnest(range(1, least(length(a1), length(b1))))", "range(1, least(length(a1), length(b1)))"))
def allele_trim(spark, sf):
    rows = T.base_sequences(spark, sf).where("length(seq) >= 20").selectExpr("doc_id", *PAIRS.split(", concat")[:1], "concat" + PAIRS.split(", concat")[1])
    return rows.select("doc_id", alleles.trimmed(F.col("a"), F.col("b")).alias("t")).select("doc_id", "t.*")


@query("SELECT chrom, hap, exp(avg(ln(qual + 0.001))) AS geomean FROM calls GROUP BY chrom, hap")
def geomean(spark, sf):
    return T.calls(spark, sf).groupBy("chrom", "hap").agg(quality.geometric_mean(F.col("qual") + 0.001).alias("geomean"))


@query("SELECT event_id, CASE WHEN qual >= 1 THEN 1000 ELSE CAST(round_even(least(1000.0, -10 * log10(1.0 - qual)), 0) AS INTEGER) END AS phred FROM calls")
def phred(spark, sf):
    return T.calls(spark, sf).select("event_id", quality.phred(F.col("qual")).alias("phred"))


@query("""WITH n AS (SELECT region_id, ("end" - start) * (region_id * 977 + 1) AS n FROM regions)
SELECT region_id, CASE WHEN n < 10000 THEN CAST(n AS VARCHAR) WHEN n < 1000000 THEN printf('%.1f Kb', round_even(n / 1000.0, 1)) WHEN n < 1000000000 THEN printf('%.1f MB', round_even(n / 1000000.0, 1)) ELSE printf('%.1f GB', round_even(n / 1000000000.0, 1)) END AS size FROM n""")
def format_bp(spark, sf):
    return T.regions(spark, sf).select("region_id", quality.format_bp((F.col("end") - F.col("start")) * (F.col("region_id") * 977 + 1)).alias("size"))


@query("SELECT region_id, 1000000000 * (rank_no - 1) + start AS priority FROM regions JOIN (SELECT chrom, row_number() OVER (ORDER BY min(file_order)) AS rank_no FROM regions GROUP BY chrom) USING (chrom)")
def region_priority(spark, sf):
    rows = T.regions(spark, sf)
    order = text.label_classes(rows, "chrom")
    return rows.join(F.broadcast(order), "chrom").select("region_id", (F.col("class_index").cast("bigint") * 1_000_000_000 + F.col("start")).alias("priority")).orderBy("priority")


@query("SELECT chrom, min(file_order) AS first_row FROM regions GROUP BY chrom")
def chrom_order(spark, sf):
    return T.regions(spark, sf).groupBy("chrom").agg(F.min("file_order").alias("first_row")).orderBy("first_row")


@query("SELECT count(*) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS bases FROM regions")
def bed_totals(spark, sf):
    return T.regions(spark, sf).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"))


FEATURES = """CAST(base = 'A' AS INTEGER) AS f0, CAST(base = 'C' AS INTEGER) AS f1, CAST(base = 'G' AS INTEGER) AS f2, CAST(base = 'T' AS INTEGER) AS f3, CAST(round_even(qual / 10.0, 0) AS INTEGER) AS f4,
  CAST(op IN ('M', 'D', 'S') AS INTEGER) AS f5, CAST(op IN ('M', 'I', 'S') AS INTEGER) AS f6, CAST(is_reverse AS INTEGER) AS f7, CAST(op = 'S' AS INTEGER) AS f8, CAST(round_even(mapq / 10.0, 0) AS INTEGER) AS f9"""


@query(f"SELECT read_id, i AS q, {FEATURES} FROM (SELECT *, 'M' AS op FROM read_bases)")
def encode_bases(spark, sf):
    both = F.arrays_zip(F.split("bases", "").alias("base"), F.col("quals").alias("qual"))
    rows = T.reads(spark, sf).select("read_id", "mapq", "is_reverse", F.posexplode(both).alias("i", "x"))
    calls = sequences.call_features(F.col("x.base"), F.col("x.qual"), F.lit("M"), F.col("is_reverse"), F.col("mapq"))
    return rows.select("read_id", F.col("i").cast("long").alias("q"), *calls)


def encoded_reads(reads):
    """Features of every base; each operation's length counts off read bases, a deletion's too."""
    ops = F.coalesce(sequences.cigar_ops(F.col("cigar")), F.array(F.struct(F.lit("M").alias("op"), F.length("bases").alias("len"))))
    labels = F.flatten(F.transform(ops, lambda x: F.array_repeat(x["op"], x["len"])))
    rows = reads.select("read_id", "mapq", "is_reverse", "quals", F.posexplode(F.arrays_zip(F.slice(labels, 1, F.length("bases")).alias("op"), F.split("bases", "").alias("base"), F.col("quals").alias("qual"))).alias("i", "x"))
    features = sequences.call_features(F.col("x.base"), F.col("x.qual"), F.col("x.op"), F.col("is_reverse"), F.col("mapq"))
    return rows.where("x.op is not null and x.base is not null").select("read_id", F.col("i").cast("long").alias("q"), *features)


@query(f"""SELECT read_id, q, {FEATURES} FROM (SELECT *, i AS q, CASE cigar WHEN '40M2D60M' THEN CASE WHEN i BETWEEN 40 AND 41 THEN 'D' ELSE 'M' END WHEN '50M3I47M' THEN CASE WHEN i BETWEEN 50 AND 52 THEN 'I' ELSE 'M' END
  WHEN '10S90M' THEN CASE WHEN i < 10 THEN 'S' ELSE 'M' END ELSE 'M' END AS op FROM read_bases)""")
def encode_reads(spark, sf):
    return encoded_reads(T.reads(spark, sf))


@query("SELECT read_id, CASE WHEN cigar LIKE '10S%' THEN start - 10 ELSE start END AS clip_start FROM read_rows")
def clip_start(spark, sf):
    return T.reads(spark, sf).select("read_id", sequences.clip_start(F.col("start"), sequences.cigar_ops(F.col("cigar"))).alias("clip_start"))


@query("SELECT read_id, n - 1 AS n, op, CAST(len AS INTEGER) AS len FROM (SELECT read_id, unnest(regexp_extract_all(cigar, '(\\d+)([MIDS])', 2)) AS op, unnest(regexp_extract_all(cigar, '(\\d+)([MIDS])', 1)) AS len, unnest(range(1, 1 + len(regexp_extract_all(cigar, '(\\d+)([MIDS])', 1)))) AS n FROM read_rows)")
def cigar_ops(spark, sf):
    return T.reads(spark, sf).select("read_id", F.posexplode(sequences.cigar_ops(F.col("cigar"))).alias("n", "x")).select("read_id", F.col("n").cast("long").alias("n"), "x.op", "x.len")


@query("SELECT chrom, pos, CAST(strpos('ACGT', base) - 1 AS INTEGER) AS base_index FROM ref_bases")
def base_index(spark, sf):
    return T.ref_bases(spark, sf).select("chrom", "pos", sequences.base_index(F.col("base")).alias("base_index"))


@query("""SELECT read_id, repeat('.', CAST(read_id % 50 AS INTEGER)) || string_agg(CASE WHEN cigar = '10S90M' AND i < 10 THEN lower(base) ELSE base END, '' ORDER BY i) AS line FROM read_bases GROUP BY read_id""")
def pileup_text(spark, sf):
    """Reads as lines of a tile of 50 positions: dots before the start, clipped bases in lower case."""
    ops = sequences.cigar_ops(F.col("cigar"))
    first = F.when(ops[0]["op"] == "S", ops[0]["len"]).otherwise(0)
    shown = F.concat(F.lower(F.substring("bases", F.lit(1), first)), F.substring("bases", first + 1, F.length("bases")))
    return T.reads(spark, sf).select("read_id", F.concat(F.expr("repeat('.', cast(read_id % 50 as int))"), shown).alias("line"))


@query("SELECT doc_id, CASE WHEN length(seq) >= 40 THEN str_split(substr(seq, length(seq) // 2 - 20 + 1, 40), '') ELSE list_concat(CASE WHEN seq = '' THEN CAST([] AS VARCHAR[]) ELSE str_split(seq, '') END, list_transform(range(0, 40 - length(seq)), lambda i: '-')) END AS cells FROM base_sequences")
def crop_pad(spark, sf):
    letters = F.when(F.col("seq") == "", F.array().cast("array<string>")).otherwise(F.split("seq", ""))
    return T.base_sequences(spark, sf).select("doc_id", sequences.cropped(letters, 40, F.lit("-")).alias("cells"))


@query("SELECT region_id, start + (region_id * 7919) % 20 - 10 AS start, \"end\" + (region_id * 7919) % 20 - 10 AS \"end\" FROM regions")
def jitter(spark, sf):
    return jittered(T.regions(spark, sf), 20, F.col("region_id") * 7919).select("region_id", "start", "end")


def jittered(regions, most: int, key):
    """Regions moved by a number from -most / 2 up to most / 2, from a key (a seeded hash in real use)."""
    move = F.pmod(key, F.lit(most)) - most // 2
    return regions.withColumns({"start": F.col("start") + move, "end": F.col("end") + move})


@query("SELECT event_id, CASE WHEN event_type LIKE '%click%' THEN 'S1' WHEN event_type LIKE '%view%' THEN 'S2' WHEN event_type LIKE '%pur%' THEN 'S3' END AS sample FROM events")
def sample_alias(spark, sf):
    return T.source(spark, sf, "events").select("event_id", sample_of(F.col("event_type"), {"click": "S1", "view": "S2", "pur": "S3"}).alias("sample"))


def sample_of(name, aliases: dict[str, str]):
    """The first alias whose pattern is in a file name; null if none is."""
    out = F.lit(None).cast("string")
    for pattern, sample in reversed(aliases.items()):
        out = F.when(name.contains(pattern), sample).otherwise(out)
    return out


@query("SELECT region_id, label FROM regions WHERE NOT (label = 'tn' AND region_id // 6 % 2 = 0)")
def thin_label(spark, sf):
    return T.regions(spark, sf).where(~((F.col("label") == "tn") & (F.floor(F.col("region_id") / 6) % 2 == 0))).select("region_id", "label")


@query("""SELECT record_id, chrom, pos - k AS start, pos - k + 150 AS "end", CASE call WHEN 'FP' THEN 'tn-fp' ELSE 'fn' END AS label FROM (SELECT *, unnest([60 + record_id * 31 % 61, 10 + record_id * 17 % 61]) AS k FROM evaluated)""")
def error_regions(spark, sf):
    key = F.col("record_id")
    offsets = F.explode(F.array(60 + key * 31 % 61, 10 + key * 17 % 61)).alias("k")
    rows = T.evaluated(spark, sf).select("record_id", "chrom", "pos", "call", offsets)
    return rows.select("record_id", "chrom", (F.col("pos") - F.col("k")).alias("start"), (F.col("pos") - F.col("k") + 150).alias("end"), F.when(F.col("call") == "FP", "tn-fp").otherwise("fn").alias("label"))


@query("""WITH r AS (SELECT variant_id, chrom, variant_id // 40 AS pos, ref, alts[1] AS alt, (variant_id % 10) / 10.0 AS qual FROM variants)
SELECT a.variant_id AS id0, b.variant_id AS id1, a.chrom, a.pos, CASE WHEN length(a.ref) >= length(b.ref) THEN a.ref ELSE b.ref END AS ref,
  a.alt || substr(CASE WHEN length(a.ref) >= length(b.ref) THEN a.ref ELSE b.ref END, length(a.ref) + 1) AS alt0, b.alt || substr(CASE WHEN length(a.ref) >= length(b.ref) THEN a.ref ELSE b.ref END, length(b.ref) + 1) AS alt1,
  (a.qual + b.qual) / 2 AS qual FROM r a JOIN r b ON a.chrom = b.chrom AND a.pos = b.pos AND a.variant_id < b.variant_id""")
def multialt_merge(spark, sf):
    """Two alternatives at one position as one record over the longer reference allele."""
    rows = T.variants(spark, sf).selectExpr("variant_id", "chrom", "variant_id div 40 AS pos", "ref", "alts[0] AS alt", "(variant_id % 10) / 10.0D AS qual")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.variant_id") < F.col("b.variant_id")))
    longer = F.when(F.length("a.ref") >= F.length("b.ref"), F.col("a.ref")).otherwise(F.col("b.ref"))

    def widened(side: str):
        return F.concat(F.col(f"{side}.alt"), F.substring(longer, F.length(f"{side}.ref") + 1, F.length(longer)))

    return pairs.select(F.col("a.variant_id").alias("id0"), F.col("b.variant_id").alias("id1"), "a.chrom", "a.pos", longer.alias("ref"), widened("a").alias("alt0"), widened("b").alias("alt1"), ((F.col("a.qual") + F.col("b.qual")) / 2).alias("qual"))


@query("SELECT chrom, start // 8 AS start, cigar, is_reverse, min(read_id) AS read_id, count(*) AS copies FROM read_rows GROUP BY ALL")
def read_dedup(spark, sf):
    """Reads of equal identity (place, CIGAR, strand) as one."""
    rows = T.reads(spark, sf).withColumn("start", F.floor(F.col("start") / 8))
    return rows.groupBy("chrom", "start", "cigar", "is_reverse").agg(F.min("read_id").alias("read_id"), F.count("*").alias("copies"))


@query("SELECT label, list_transform(range(1, 65), lambda i: v[i]) AS mean FROM (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)")
def vector_mean(spark, sf):
    rows = T.source(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(quality.exact_mean(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("label", F.transform("v", lambda y: y["m"]).alias("mean"))


@query("SELECT window_no, string_agg((list_transform([k // 64, k // 16 % 4, k // 4 % 4, k % 4], lambda c: substr('ACGT', c + 1, 1))).list_aggr('string_agg', ''), '' ORDER BY i) AS seq, flatten(list_transform(list(logp ORDER BY i), lambda x: [round(exp(x), 8), round(exp(x), 8), round(exp(x), 8), round(exp(x), 8)])) AS probs FROM (SELECT *, CAST(token AS BIGINT) AS k FROM hap_tokens WHERE i < least(36, 100 // 4 + 1)) GROUP BY window_no")
def tokens_to_bases(spark, sf):
    """Tokens as bases with a probability each, to eight digits; as many tokens as reach a distance of 100."""
    wanted = min(36, 100 // sequences.K + 1)
    lists = T.hap_tokens(spark, sf).where(F.col("i") < wanted).groupBy("window_no").agg(F.array_sort(F.collect_list(F.struct("i", "token", "logp"))).alias("x"))
    return lists.select("window_no", sequences.kmer_string(F.transform("x", lambda y: y["token"])).alias("seq"), sequences.expanded(F.transform("x", lambda y: F.round(F.exp(y["logp"]), 8))).alias("probs"))


@query()
def seeded_shuffle(spark, sf):
    return T.regions(spark, sf).orderBy(sampling.seeded(F.col("region_id"), SEED)).select("region_id", "label")


@query("SELECT read_id, chrom, start FROM read_rows ORDER BY chrom, start, read_id LIMIT 50 OFFSET 20")
def limit_offset(spark, sf):
    return T.reads(spark, sf).select("read_id", "chrom", "start").orderBy("chrom", "start", "read_id").offset(20).limit(50)


@query("SELECT variant_id, chrom, pos, ref, alts[1] AS alt, CAST(substr(chrom, 4) AS INTEGER) AS chrom_order FROM variants")
def sorted_records(spark, sf):
    rows = T.variants(spark, sf).select("variant_id", "chrom", "pos", "ref", F.element_at("alts", 1).alias("alt"), quality.chrom_value(F.col("chrom")).alias("chrom_order"))
    return rows.orderBy("chrom_order", "pos", "ref", "alt")
