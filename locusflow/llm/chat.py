"""Chat formatting of logged conversations, with their cumulative snapshots collapsed.

A conversation that is logged after every turn appears many times, each log a prefix of
the next.  Rolling hashes of turn prefixes find the logs that prefix a longer one; an
anti-join keeps the others, which are then rendered.  DataFrame functions only.

Texts move twice: once to put turns in order, and once, those of the kept conversations
alone, to be rendered.  All between works on the SHA-256 digest of each turn.  The rolling hash of a
prefix is the xor of a 64-bit hash of each (position, digest), taken twice with different
seeds.  It can be computed over parts of a conversation, so a very long one is not held by
one task.  Hashes are not believed: all prefixes of one length and hash must have one last
turn, which, from turn to turn, makes them equal as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turn numbers that share a slice of a conversation while turns are put in order.
SLICE = 64
#: Leading characters of a text by which turns without a number are dealt to slices.
HEAD = 16
#: Turns that are rendered into one row, and whose prefix hashes are made together.
PART = 256
START, END = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, part, position, role, text, digest): turns in order, numbered from 1 in each conversation.

    ``conv`` holds the id inside of a structure, so that null ids are equal in plain joins.
    Slices follow each other in the order of turns; those without a number, which may be
    many, are dealt by role and the head of the text, which is the order among them.
    """
    number, role, text = F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    unnumbered = number.isNull()
    piece = F.struct(F.floor(number / SLICE).alias("turns"), F.when(unnumbered, role).alias("role"), F.when(unnumbered, F.substring(text, 1, HEAD)).alias("head"))
    rows = turns.select(F.struct("conv_id").alias("conv"), piece.alias("slice"), number.alias("turn"), role.alias("role"), text.alias("text"))
    sizes = rows.groupBy("conv", "slice").agg(F.count("*").alias("turns"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "slice", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv", "slice").orderBy("turn", "role", "text"))
    placed = rows.withColumn("place", place).join(starts, ["conv", "slice"]).withColumn("position", F.col("start") + F.col("place"))
    # A null and an empty string differ, and no role runs into a text, so that only equal turns have equal digests.
    named = F.when(F.col("role").isNull(), "-").otherwise(F.concat(F.length("role").cast("string"), F.lit(":"), "role"))
    said = F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.lit("+"), "text"))
    digest = F.unhex(F.sha2(F.concat(named, said), 256))
    return placed.select("conv", F.floor((F.col("position") - 1) / PART).cast("int").alias("part"), "position", "role", "text", digest.alias("digest"))


def prefix_hashes(turns: DataFrame, seed: int) -> DataFrame:
    """(conv, position, digest, h1, h2, is_last) of each prefix, from (conv, part, position, digest)."""
    rows = turns.select("conv", "part", "position", "digest").withColumns({f"t{k}": F.xxhash64(F.lit(2 * seed + k), "position", "digest") for k in (1, 2)})
    totals = rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    order = Window.partitionBy("conv").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    moved = {f"m{k}": F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0).cast("long")) for k in (1, 2)}
    end = F.when(F.lead("part").over(order).isNull(), F.col("part") * PART + F.col("n"))
    carried = totals.withColumns({**moved, "end": end}).select("conv", "part", "m1", "m2", "end")
    so_far = Window.partitionBy("conv", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"x{k}": F.bit_xor(f"t{k}").over(so_far) for k in (1, 2)})
    hashes = (F.col(f"x{k}").bitwiseXOR(F.col(f"m{k}")).alias(f"h{k}") for k in (1, 2))
    return inside.join(carried, ["conv", "part"]).select("conv", "position", "digest", *hashes, F.col("position").eqNullSafe(F.col("end")).alias("is_last"))


def maximal_conversations(turns: DataFrame, seed: int = 0) -> DataFrame:
    """(conv, turns) of the conversations that no longer one starts with; of equal ones the smallest id stays.

    Two different prefixes of one hash end the job with an error; another ``seed`` tells them apart.
    """
    prefixes = prefix_hashes(turns, seed)
    found = prefixes.groupBy("position", "h1", "h2").agg(
        F.min("digest").alias("least"), F.max("digest").alias("most"),
        F.max(~F.col("is_last")).alias("goes_on"), F.min(F.when(F.col("is_last"), F.col("conv"))).alias("conv"),
    )
    sure = F.when(F.col("least") == F.col("most"), F.col("position")).otherwise(F.raise_error(F.lit("different prefixes have one hash: choose another seed")))
    found = found.select(sure.alias("turns"), "h1", "h2", "goes_on", "conv")
    inner = found.where("goes_on").select("turns", "h1", "h2")
    return found.where("conv is not null").join(inner, ["turns", "h1", "h2"], "left_anti").select("conv", "turns")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered): turns (conv, part, position, role, text) in chat markup, those of a part in a row.

    The parts of a conversation in order, end to end, are its whole rendering.  The markup's
    own marks in a text are broken by a space; a null role is ``unknown``, a null text empty.
    """

    def plain(column: str, otherwise: str):
        value = F.coalesce(F.col(column), F.lit(otherwise))
        return F.replace(F.replace(value, F.lit(START), F.lit("< |im_start|>")), F.lit(END), F.lit("< |im_end|>"))

    line = F.concat(F.lit(START), plain("role", "unknown"), F.lit("\n"), plain("text", ""), F.lit(END + "\n"))
    lines = turns.select("conv", "part", F.struct("position", line.alias("line")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"]), "")
    return lines.groupBy("conv", "part").agg(F.count("*").alias("n_turns"), joined.alias("rendered")).select("conv.conv_id", "part", "n_turns", "rendered")


def format_conversations(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """Renders the maximal conversations among rows of (conv_id, turn, role, text).

    Turns are ordered by turn (null first), then role and text; repeated rows are turns of
    their own.  Rows with a null ``conv_id`` are one conversation.  Other columns are ignored.
    """
    turns = stored(numbered_turns(conversations))
    chosen = maximal_conversations(turns, seed)
    parts = chosen.select("conv", F.explode(F.sequence(F.lit(0), F.floor((F.col("turns") - 1) / PART).cast("int"))).alias("part"))
    return render(turns.join(parts, ["conv", "part"]))


#: The same in SQL: conversations as lists of turns, compared as whole lists.
ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
  FROM conversations
), logs AS (
  SELECT conv_id, count(*) AS n, list({{'role': role, 'text': text}} ORDER BY position) AS log FROM turns GROUP BY conv_id
), firsts AS (
  SELECT log, n, min(conv_id) AS conv_id FROM logs GROUP BY log, n
), maximal AS (
  SELECT conv_id FROM firsts a WHERE NOT EXISTS (
    SELECT 1 FROM firsts b WHERE b.log[1] IS NOT DISTINCT FROM a.log[1] AND b.n > a.n AND b.log[1:a.n] = a.log)
), lines AS (
  SELECT conv_id, position, CAST((position - 1) // {PART} AS INTEGER) AS part,
    '{START}' || replace(replace(coalesce(role, 'unknown'), '{START}', '< |im_start|>'), '{END}', '< |im_end|>') || chr(10)
    || replace(replace(coalesce(text, ''), '{START}', '< |im_start|>'), '{END}', '< |im_end|>') || '{END}' || chr(10) AS line
  FROM turns SEMI JOIN maximal USING (conv_id)
)
SELECT conv_id, part, count(*) AS n_turns, string_agg(line, '' ORDER BY position) AS rendered FROM lines GROUP BY conv_id, part
"""
