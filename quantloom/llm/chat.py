"""Chat formatting with every participant in turn as the assistant.

A conversation is a sequence of turns by speakers. For each participant the dialogue is
rendered with that speaker's turns as the assistant's, all others as named users, and a
loss mask over the assistant's words alone. System turns are nobody's and keep their role.
Conversations of any length are rendered in parts of ``PART`` turns, so the longest one
takes no more memory than a short one; parts joined in order are the whole rendering.

Turns are gathered into parts once and rotated inside the row: a text travels as often for
ten participants as for two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm._common import global_rank

PART = 256
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"
#: A mark inside a text, with the backslashes that tell it from a real one.
MARK = r"<(\\*)\|(im_start|im_end)\|>"


def escaped(text: Column) -> Column:
    """text with a backslash more in everything that looks like a mark; taking one off again restores it."""
    return F.regexp_replace(text, MARK, r"<\\$1|$2|>")


def _named(who: Column) -> Column:
    """A speaker's name for a header: marks escaped, and line breaks, which end a header, as spaces."""
    return F.regexp_replace(escaped(F.coalesce(who, F.lit("unknown"))), r"[\r\n]", " ")


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", part_turns: int = PART) -> DataFrame:
    """One row for each conversation, participant and part of part_turns turns.

    Columns: conv_id, perspective, part (from 0), n_turns, start (characters of the parts
    before), text, and mask, an array of (s, e): the characters of text that count in
    the loss, the end mark included. Turns stand by turn number, nulls first, then speaker
    and text; repeated rows are turns of their own. A null conv_id is a conversation. A null
    speaker is no participant and speaks as user "unknown"; null texts are empty; a
    conversation of system turns alone has no perspective and no row. Marks inside texts and
    names are escaped. Very long texts stay whole. Other columns play no part, whatever
    their names. Empty in, empty out.
    """
    rows = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{speaker}`").alias("who"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("said"))
    ranked = global_rank(rows, [F.col(c) for c in ("conv_id", "turn", "who", "said")], "turns", "rank")
    people = F.array_sort(F.collect_set(F.when(F.col("who") != SYSTEM, F.col("who"))))
    # A struct with a null in it equals another: null conversations join like any other.
    key = F.struct("conv_id")
    convs = ranked.groupBy(key.alias("c")).agg(F.min("rank").alias("low"), people.alias("people"), F.count("*").alias("n"))
    placed = ranked.withColumn("k", key).join(convs, F.col("k") == F.col("c"))
    seq = F.col("rank") - F.col("low")
    part = F.floor(seq / part_turns).cast("long")
    gathered = placed.groupBy("c", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "who", "said"))).alias("xs"), F.first("people").alias("people"))
    each = gathered.join(_starts(ranked, convs, part_turns), ["c", "part"], "left").select("c", "part", "xs", "starts", F.posexplode("people").alias("i", "perspective"))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def turn_of(x: Column) -> Column:
        mine = F.coalesce(x["who"] == F.col("perspective"), F.lit(False))
        return F.struct(F.concat(F.lit(START), _role(x["who"], mine), F.lit("\n")).alias("head"), F.concat(escaped(x["said"]), F.lit(END)).alias("body"), mine.alias("mine"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["head"])
        e = s + F.length(x["body"])
        return F.struct((e + 1).alias("at"), F.when(x["mine"], F.concat(acc["mask"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["mask"]).alias("mask"))

    each = each.withColumn("xs", F.transform("xs", turn_of))
    return each.select(
        F.col("c.conv_id").alias("conv_id"),
        "perspective",
        "part",
        F.size("xs").cast("long").alias("n_turns"),
        F.coalesce(F.get("starts", F.col("i"))["start"], F.lit(0)).cast("long").alias("start"),
        F.array_join(F.transform("xs", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("xs", F.struct(F.lit(0).alias("at"), none.alias("mask")), step, lambda acc: acc["mask"]).alias("mask"),
    )


def _role(who: Column, mine: Column | bool) -> Column:
    user = F.when(who == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), _named(who)))
    return user if mine is False else F.when(mine, F.lit("assistant")).otherwise(user)


def _starts(ranked: DataFrame, convs: DataFrame, part_turns: int) -> DataFrame:
    """(c, part, starts): where a part begins in each participant's rendering, in the order of people; of conversations of several parts alone.

    From lengths, not texts: a part is as long as with users only, and each of the
    participant's own turns differs by the length of its role.
    """
    more = convs.where(F.col("n") > part_turns)
    as_user = _role(F.col("who"), False)
    size = F.lit(len(START) + len(END) + 2) + F.length(as_user) + F.length(escaped(F.col("said")))
    sized = ranked.select(F.struct("conv_id").alias("k"), "rank", "who", size.cast("long").alias("size"))
    sized = sized.join(more, F.col("k") == F.col("c"))
    part = F.floor((F.col("rank") - F.col("low")) / part_turns).cast("long")
    own = sized.groupBy("c", part.alias("part"), "who").agg(F.count("*").alias("turns"), F.sum("size").alias("size"))
    parts = own.groupBy("c", "part").agg(F.sum("size").alias("size"))
    asked = more.select("c", F.explode("people").alias("perspective")).join(parts, "c")
    own = own.where("who is not null").select("c", "part", F.col("who").alias("perspective"), (F.col("turns") * (len("assistant") - F.length(as_user))).alias("change"))
    lengths = asked.join(own, ["c", "part", "perspective"], "left").withColumn("n", F.col("size") + F.coalesce("change", F.lit(0)))
    before = Window.partitionBy("c", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = lengths.select("c", "part", "perspective", F.sum("n").over(before).alias("start"))
    return begun.groupBy("c", "part").agg(F.array_sort(F.collect_list(F.struct("perspective", "start"))).alias("starts"))


def digest(turns: DataFrame) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return perspectives(turns).withColumn("mask", mask)


_ESC = r"regexp_replace(@, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g')"
#: The same for DuckDB.
SQL = f"""
WITH t AS (
  SELECT conv_id, role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS seq
  FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
e AS (
  SELECT t.conv_id, p.perspective, t.seq, t.seq // {PART} AS part, coalesce(t.role = p.perspective, false) AS mine,
         '{START}' || CASE WHEN coalesce(t.role = p.perspective, false) THEN 'assistant' WHEN t.role = 'system' THEN 'system'
                           ELSE 'user name=' || regexp_replace({_ESC.replace("@", "coalesce(t.role, 'unknown')")}, '[\\r\\n]', ' ', 'g') END || chr(10) AS head,
         {_ESC.replace("@", "t.said")} || '{END}' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s
  FROM e
), g AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY seq) AS text,
         coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY seq), '') AS mask
  FROM o GROUP BY conv_id, perspective, part
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       text, mask
FROM g
"""
