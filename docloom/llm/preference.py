"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Turns stay rows from end to end: a pair's shared prefix is found by counting, not by gathering a
conversation into one array, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

PART_ORDER = {"prompt": 0, "chosen": 1, "rejected": 2}


def _same(side: str) -> Column:
    """What a side says at a turn: number of rows and an order-free 2 x 64-bit digest of role and text."""
    on = F.col("side") == side
    one, two = (F.xxhash64(F.lit(salt), "role", "text").cast("decimal(20,0)") for salt in (11, 29))
    return F.struct(
        F.count(F.when(on, 1)), F.coalesce(F.sum(F.when(on, one)), F.lit(0)), F.coalesce(F.sum(F.when(on, two)), F.lit(0))
    )


def format_preferences(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Rendered segments from turns(pair_id, side, turn, role, text), side being 'chosen' or 'rejected'.

    Returns one row per rendered turn: pair_id, part ('prompt', 'chosen', 'rejected'), turn, role,
    header, content, trainable. A part's text is header || content of its rows in the order of (turn, role,
    text); the loss mask covers the content of rows with trainable = true and nothing else: prompts
    and headers are never trained, and in completions only turns of train_role.

    The prompt is the longest common prefix of turns: all turns before the first one at which the
    sides differ in role, text or number of rows. It is rendered once, from the chosen side.

    Nulls: a null role or text counts as ''; rows with a null pair_id, side or turn name no place and
    give no segment. Several rows at one turn of a side are all rendered and compared as a bag. Equal
    sides give only a prompt; sides that differ at once give no prompt. A pair with one side keeps it
    as a completion. Columns beyond the five are ignored; no rows in, no rows out.
    """
    rows = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL AND side IN ('chosen', 'rejected')").select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    by_turn = rows.groupBy("pair_id", "turn").agg(_same("chosen").alias("a"), _same("rejected").alias("b"))
    splits = by_turn.groupBy("pair_id").agg(
        F.min(F.when(F.col("a") != F.col("b"), F.col("turn"))).alias("first_difference"),
    )
    shared = (F.col("first_difference").isNull()) | (F.col("turn") < F.col("first_difference"))
    return (
        rows.join(splits, "pair_id")
        .withColumn("part", F.when(shared, F.lit("prompt")).otherwise(F.col("side")))
        .where((F.col("part") != "prompt") | (F.col("side") == "chosen"))
        .select(
            "pair_id", "part", "turn", "role",
            F.concat(F.lit("<|"), "role", F.lit("|>\n")).alias("header"),
            F.concat("text", F.lit("<|end|>\n")).alias("content"),
            ((F.col("part") != "prompt") & (F.col("role") == train_role)).alias("trainable"),
        )
    )


def _followed(last: DataFrame) -> DataFrame:
    """last(conv_id, last) with the conv_id that comes next in it, whatever the gaps; the first one follows the last one.

    Rows lie in ranges of conv_id, one a task; only each range's first conv_id meets those of other ranges.
    """
    ranged = common.written(last.repartitionByRange("conv_id").withColumn("range", F.spark_partition_id()), "answered")
    starts = ranged.groupBy("range").agg(F.min("conv_id").alias("start"))
    whole = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = starts.select("range", F.coalesce(F.lead("start").over(W.orderBy("range")), F.first("start").over(whole)).alias("after"))
    inside = F.lead("conv_id").over(W.partitionBy("range").orderBy("conv_id"))
    return ranged.withColumn("inside", inside).join(F.broadcast(after), "range").select("conv_id", "last", F.coalesce("inside", "after").alias("next"))


def answer_pairs(conversations: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Preference turns from plain conversations(conv_id, turn, role, text): pair_id = conv_id.

    Chosen is the conversation as it is. Rejected has the same turns up to its last assistant turn,
    whose text is replaced by that of the next answered conversation's last assistant turn: a fluent
    answer to another question. Next is by the order of conv_id among conversations with an assistant
    turn, and the first one follows the last one; a conversation that is alone has only its chosen side.
    Conversations without an assistant turn make no pair. Of several rows at the last assistant turn
    the greatest text counts.
    """
    c = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    last = c.where(F.col("role") == train_role).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    last = _followed(last)
    swap = last.select(F.col("conv_id").alias("pair_id"), F.col("last.turn").alias("at"), "next").join(
        last.select(F.col("conv_id").alias("next"), F.col("last.text").alias("other")), "next"
    )
    both = c.withColumnRenamed("conv_id", "pair_id").join(swap, "pair_id")
    chosen = both.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = both.where("turn < at AND next <> pair_id").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    swapped = swap.where("next <> pair_id").select("pair_id", F.lit("rejected").alias("side"), F.col("at").alias("turn"), F.lit(train_role).alias("role"), F.col("other").alias("text"))
    return chosen.unionByName(rejected).unionByName(swapped)


def assembled(segments: DataFrame) -> DataFrame:
    """pair_id, part, text, and the trained character spans [start, end): for parts that fit one row."""
    parts = segments.groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "header", "trainable"))).alias("s"))
    start = lambda s: F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))  # noqa: E731, ARG005
    add = lambda acc, x: F.struct(
        F.concat(acc["text"], x["header"], x["content"]).alias("text"),
        F.when(
            x["trainable"],
            F.concat(acc["spans"], F.array(F.struct((F.length(acc["text"]) + F.length(x["header"])).alias("start"), (F.length(acc["text"]) + F.length(x["header"]) + F.length(x["content"])).alias("end")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    return parts.withColumn("r", F.aggregate("s", start(None), add)).select("pair_id", "part", "r.text", "r.spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer."""
    return format_preferences(answer_pairs(common.table(spark, sf_dir, "conversations")))


query_all = query

ORACLE_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, max((turn, text)) AS l FROM (SELECT conv_id, turn, text FROM c WHERE role = 'assistant') GROUP BY conv_id),
following AS (SELECT conv_id, l, coalesce(lead(conv_id) OVER (ORDER BY conv_id), first_value(conv_id) OVER (ORDER BY conv_id)) AS next FROM last),
swap AS (SELECT a.conv_id AS pair_id, a.next, struct_extract(a.l, 1) AS cut, struct_extract(b.l, 2) AS other FROM following a JOIN last b ON b.conv_id = a.next),
t AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM c JOIN swap ON conv_id = pair_id
  UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM c JOIN swap ON conv_id = pair_id WHERE turn < cut AND next <> pair_id
  UNION ALL SELECT pair_id, 'rejected', cut, 'assistant', other FROM swap WHERE next <> pair_id),
d AS (
  SELECT pair_id, min(turn) AS first_difference FROM (
    SELECT pair_id, turn, list_sort(list((role, text)) FILTER (side = 'chosen')) AS a, list_sort(list((role, text)) FILTER (side = 'rejected')) AS b
    FROM t GROUP BY pair_id, turn) WHERE a IS DISTINCT FROM b GROUP BY pair_id),
p AS (
  SELECT t.*, CASE WHEN first_difference IS NULL OR turn < first_difference THEN 'prompt' ELSE side END AS part
  FROM t LEFT JOIN d USING (pair_id))
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) AS header, text || '<|end|>' || chr(10) AS content,
  part <> 'prompt' AND role = 'assistant' AS trainable
FROM p WHERE part <> 'prompt' OR side = 'chosen'
"""
