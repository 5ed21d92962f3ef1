"""Chat formatting after collapsing cumulative snapshots.

Logs often hold one conversation many times, each copy a turn longer. Every
turn gets the hash of the conversation up to it: an exclusive-or of the hashes
of (position, role, text), so that it can be combined in any order. A
conversation whose hash equals the hash of a proper prefix of a longer one, or
of an equal one with a smaller id, is left out by anti-joins; the maximal ones
are rendered.

Positions are counted by (turn, role, text). No task needs a whole
conversation: turns are dealt into blocks by ranges of that order, hashes and
counts are added up within a block, and block bases come from a prefix scan over
the few blocks. Rendered text comes in rows of at most CHUNK turns for the same
reason; `chunk` numbers them.

Cases: turns without a conversation id are left out (they cannot be told
apart). A null turn number sorts first; null role and text count as values of
their own and render as nothing. Repeated rows count as repeated turns. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loginlens.llm.common import running_total
from loginlens.session import durable

CHUNK = 256
START, END = "<|{role}|>\n", "<|end|>\n"


def positions(turns: DataFrame) -> DataFrame:
    """Turns with `pos` (from 0) and the hash `prefix` of the conversation up to and with each turn."""
    rows = (turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.lit(1).cast("long").alias("one")))
    counted = durable(running_total(rows, "conv_id", ["turn", "role", "text"], "one", "pos").drop("one"))
    seen = [F.col("pos"), F.col("role").isNull(), F.col("text").isNull(), "role", "text"]
    hashed = counted.withColumn("block", F.floor(F.col("pos") / CHUNK)).withColumn(
        "h", F.struct(F.xxhash64(*seen).alias("a"), F.xxhash64(F.lit(7), *seen).alias("b")))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv_id", "block", "pos", "turn", "role", "text",
                        *[F.expr(f"bit_xor(h.{x})").over(inside).alias(f"in_{x}") for x in "ab"])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (hashed.groupBy("conv_id", "block").agg(*[F.expr(f"bit_xor(h.{x})").alias(x) for x in "ab"])
             .select("conv_id", "block", *[F.coalesce(F.expr(f"bit_xor({x})").over(before), F.lit(0)).alias(f"to_{x}")
                                           for x in "ab"]))
    joined = run.join(bases, ["conv_id", "block"])
    return joined.select("conv_id", "block", "pos", "turn", "role", "text",
                         F.struct(*[F.col(f"in_{x}").bitwiseXOR(F.col(f"to_{x}")).alias(x) for x in "ab"]).alias("prefix"))


def maximal(turns: DataFrame) -> DataFrame:
    """The positioned turns of the conversations that no other one extends or repeats."""
    placed = durable(positions(turns))
    last = placed.groupBy("conv_id").agg(F.max("pos").alias("last"))
    ends = durable(placed.select("conv_id", "pos", "prefix")
                   .join(last, (last.conv_id == placed.conv_id) & (last["last"] == placed.pos), "left_semi")
                   .select("conv_id", "pos", F.col("prefix").alias("whole")))
    # A hash is of one length only, as every position is hashed in.
    longer = (placed.join(ends.select(F.col("conv_id").alias("c"), F.col("pos").alias("p")),
                          (F.col("c") == F.col("conv_id")) & (F.col("p") > F.col("pos")), "left_semi")
              .select(F.col("prefix").alias("whole")).distinct())
    firsts = ends.groupBy("whole").agg(F.min("conv_id").alias("conv_id"))
    kept = firsts.join(longer, "whole", "left_anti").select("conv_id")
    return placed.join(kept, "conv_id", "left_semi")


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows `conv_id, chunk, n_turns, rendered` of the maximal conversations."""
    before, after = START.split("{role}")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after), F.coalesce("text", F.lit("")),
                    F.lit("\n" + END))
    piece = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return (maximal(turns).groupBy("conv_id", F.col("block").cast("long").alias("chunk"))
            .agg(F.count("*").alias("n_turns"), F.array_join(F.transform(piece, lambda x: x["line"]), "").alias("rendered")))


ORACLE = """
with ordered as (
  select conv_id, role, text,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) - 1 as pos
  from conversations where conv_id is not null),
turns as (
  select *, to_json([role, text]) as item, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '')
            || chr(10) || '<|end|>' || chr(10) as line
  from ordered),
prefixes as (
  select conv_id, pos, md5(string_agg(item, chr(30)) over (partition by conv_id order by pos)) as prefix from turns),
ends as (select conv_id, max(pos) as pos, arg_max(prefix, pos) as whole from prefixes group by conv_id),
longer as (select p.prefix from prefixes p join ends e on p.conv_id = e.conv_id and p.pos < e.pos),
kept as (select whole, min(conv_id) as conv_id from ends where whole not in (select prefix from longer) group by whole)
select conv_id, pos // 256 as chunk, count(*) as n_turns, string_agg(line, '' order by pos) as rendered
from turns where conv_id in (select conv_id from kept) group by conv_id, pos // 256
"""
