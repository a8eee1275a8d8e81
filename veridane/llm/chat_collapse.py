"""Chat formatting with cumulative-snapshot collapse.

A chat logged after every turn leaves many conversations of which each is a
prefix of the next. Each turn gets a rolling hash of all turns up to it: the xor
of hashes (two of 64 bits) of (turn since the first, role, text). A conversation
is dropped if its whole hash is the prefix hash of a longer one; of identical
ones the one with the smallest id stays. What remains is rendered.

Scale: texts are hashed at the scan, so only hashes are shuffled until rendering.
Rows of one turn are combined into one hash before rolling hashes are made, in
blocks of ``BLOCK`` turns plus a prefix over blocks, so one endless conversation
spreads over many tasks. Prefixes that many conversations share are combined
before their shuffle; the anti-join is between distinct keys. To render, the
scan is joined with the kept conversations first: up to ``BROADCAST`` of them,
which are counted, go to every task, so texts of dropped conversations are never
shuffled; beyond that it is a join by conversation that Spark can split. A
conversation is rendered in parts of ``BLOCK`` turns, in their order, however many
they are; only a part in which more than ``CROWD`` rows lie, so some turn has very many,
is cut further, by a hash of its rows, so no list is unbounded.

Edge cases: rows that repeat count once; several rows of one turn stay in the
order of role and text, and a prefix ends behind all of them; a row without a
conversation's id can't be tied to others and is a conversation of its one turn;
a null turn counts as turn -1; null roles and texts differ from empty ones when
compared and are rendered as empty; texts of any length are one string; ties
between identical conversations go to the smallest id, a null one first; an empty
table gives an empty result; further columns, whatever their names, are left out.
The further cuts of a crowded part have its number plus 2**32 for each cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridane.llm.shared import release, written

BLOCK, CROWD, BROADCAST = 1024, 1 << 16, 1 << 20
NO_ID = -(1 << 63)
CHAT = ["conv", "lone"]


def turns(chats: DataFrame) -> DataFrame:
    """(conv, lone, turn, h1, h2, role, text) with nulls in conv and turn replaced; lone tells rows without an id apart."""
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    h1, turn = F.xxhash64(*said), F.coalesce("turn", F.lit(-1)).cast("long")
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64(turn, h1)).otherwise(F.lit(0).cast("long"))
    return chats.select(F.coalesce("conv_id", F.lit(NO_ID)).cast("long").alias("conv"), lone.alias("lone"), turn.alias("turn"), h1.alias("h1"), F.xxhash64(F.lit("second"), *said).alias("h2"), "role", "text")


def rolling(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, lone, r, p1, p2, last, first): the hash of each conversation's turns up to r turns after its first, and its first turn; and (conv, lone, block, rows) of blocks of turns with more than CROWD rows."""
    hashed = written(turns(chats).select(*CHAT, "turn", "h1", "h2").distinct(), "turns")
    span = hashed.groupBy(*CHAT).agg(F.min("turn").alias("first"), F.max("turn").alias("final"))
    placed = hashed.join(span, CHAT).withColumn("r", F.col("turn") - F.col("first"))
    # All rows of a turn as one, so a turn of many rows is no hot group.
    placed = placed.groupBy(*CHAT, "r").agg(F.bit_xor(F.xxhash64("r", "h1")).alias("e1"), F.bit_xor(F.xxhash64("r", "h2", F.lit(1))).alias("e2"), F.max(F.struct((F.col("final") - F.col("first")).alias("last"), "first")).alias("of"), F.count("*").alias("rows"))
    placed = written(placed.withColumn("block", F.floor(F.col("r") / BLOCK)), "placed")
    totals = placed.groupBy(*CHAT, "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"), F.sum("rows").alias("rows"))
    crowded = written(totals.filter(F.col("rows") > CROWD).select(*CHAT, "block", "rows"), "crowded")
    earlier = Window.partitionBy(*CHAT).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*CHAT, "block", F.bit_xor("t1").over(earlier).alias("b1"), F.bit_xor("t2").over(earlier).alias("b2"))
    within = Window.partitionBy(*CHAT, "block").orderBy("r")
    inner = placed.select(*CHAT, "block", "r", "of", F.bit_xor("e1").over(within).alias("w1"), F.bit_xor("e2").over(within).alias("w2"))
    out = inner.join(before, [*CHAT, "block"]).select(*CHAT, "r", F.expr("w1 ^ coalesce(b1, 0)").alias("p1"), F.expr("w2 ^ coalesce(b2, 0)").alias("p2"), "of.last", "of.first")
    out = written(out, "prefixes")
    release(hashed, placed)
    return out, crowded


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, lone, copies, first) from rolling(): conversations that are no proper prefix of another, one for each set of identical ones."""
    key = ["r", "p1", "p2"]
    whole = prefixes.filter("r = last").groupBy(*key).agg(F.min(F.struct(*CHAT, "first")).alias("c"), F.count("*").alias("copies"))
    proper = prefixes.filter("r < last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("c.conv", "c.lone", "copies", "c.first")


def render(chats: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, rendered) of each maximal conversation, in parts of BLOCK turns."""
    prefixes, crowded = rolling(chats)
    kept = written(maximal(prefixes), "maximal")
    sent = lambda df: F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df
    block = F.floor((F.col("turn") - F.col("first")) / BLOCK)
    rows = turns(chats).join(sent(kept), CHAT).withColumn("block", block).join(sent(crowded), [*CHAT, "block"], "left")
    cut = F.when(F.col("rows").isNotNull(), F.pmod(F.col("h1"), F.ceil(F.col("rows") / CROWD))).otherwise(0)
    part = F.col("block") + F.shiftleft(cut.cast("long"), 32)
    parts = rows.withColumn("part", part).groupBy(*CHAT, "part", "copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("all"))
    line = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return parts.select(F.expr(f"nullif(conv, {NO_ID + 1} - 1)").alias("conv_id"), "part", F.size("all").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("all", line), "").alias("rendered"))


ORACLE = """WITH t AS (SELECT DISTINCT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS r, role, text FROM conversations),
    u AS (SELECT conv_id, r, max(r) OVER (PARTITION BY conv_id) AS last, string_agg(r || chr(1) || role || chr(2) || text, chr(3)) OVER (PARTITION BY conv_id ORDER BY r, role, text ROWS UNBOUNDED PRECEDING) AS body,
      count(*) OVER (PARTITION BY conv_id ORDER BY r, role, text ROWS UNBOUNDED PRECEDING) AS k, count(*) OVER (PARTITION BY conv_id, r) AS of_turn, row_number() OVER (PARTITION BY conv_id, r ORDER BY role, text) AS in_turn FROM t),
    p AS (SELECT conv_id, r, last, md5(body) AS body FROM u WHERE of_turn = in_turn),
    whole AS (SELECT r, body, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE r = last GROUP BY r, body),
    kept AS (SELECT conv_id, copies FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r = w.r AND p.body = w.body AND p.r < p.last))
    SELECT t.conv_id, t.r // 1024 AS part, count(*) AS n_turns, copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY r, role, text) AS rendered
    FROM t JOIN kept USING (conv_id) GROUP BY t.conv_id, part, copies"""
