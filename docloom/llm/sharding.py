"""Sharding by jump consistent hashing (Lamping and Veach), in column expressions only.

The key's linear congruential sequence does not depend on the shard count, so one fold gives
the shard for n and for n + 1: a row moves only if its next jump lands exactly on shard n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

# Fixed value: multiplier of the 64-bit generator that jump hashing is defined with.
MULTIPLIER = 2862933555777941757

_MASK22, _MASK20 = (1 << 22) - 1, (1 << 20) - 1
_C0, _C1, _C2 = MULTIPLIER & _MASK22, (MULTIPLIER >> 22) & _MASK22, MULTIPLIER >> 44


def _step(state: Column) -> Column:
    """One jump. The 64-bit key is three limbs (22, 22, 20 bits), so no product overflows a long."""
    k0, k1, k2 = state["k0"], state["k1"], state["k2"]
    low = k0 * F.lit(_C0) + F.lit(1)
    mid = k0 * F.lit(_C1) + k1 * F.lit(_C0) + F.shiftright(low, 22)
    high = k0 * F.lit(_C2) + k1 * F.lit(_C1) + k2 * F.lit(_C0) + F.shiftright(mid, 22)
    n1, n2 = mid.bitwiseAND(F.lit(_MASK22)), high.bitwiseAND(F.lit(_MASK20))
    top31 = F.shiftleft(n2, 11).bitwiseOR(F.shiftright(n1, 11))  # the key shifted right by 33
    jump = F.floor((state["j"] + 1) * (F.lit(float(1 << 31)) / (top31 + 1).cast("double"))).cast("long")
    return F.struct(
        low.bitwiseAND(F.lit(_MASK22)).alias("k0"), n1.alias("k1"), n2.alias("k2"),
        state["j"].alias("b"), jump.alias("j"),
    )


def jump_landing(key: Column, shards: int) -> Column:
    """struct(b, j): the last jump target below `shards` and the first one not below it.

    Each jump goes at least one shard on, so `shards` steps always suffice; hardly any key needs
    more than a few, and a finished state stays as it is.
    """
    start = F.struct(
        key.bitwiseAND(F.lit(_MASK22)).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_MASK22)).alias("k1"),
        F.shiftrightunsigned(key, 44).bitwiseAND(F.lit(_MASK20)).alias("k2"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )
    steps = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: F.when(s["j"] >= shards, s).otherwise(_step(s)))
    few = min(shards, 64)
    done = steps(start, few)
    if shards > few:
        done = F.transform(F.array(done), lambda s: F.when(s["j"] >= shards, s).otherwise(steps(s, shards - few)))[0]
    return done


def jump_shard(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a long key; a null key goes to shard 0."""
    return F.coalesce(jump_landing(key, shards)["b"], F.lit(0)).cast("int")


def shard_rows(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the UTF-8 length of the text plus 8; slot numbers a shard's rows from 0 in the order of
    (key, text_crc32, size), nulls first. Rows that agree in all three are counted before any shuffle.
    Counts are then dealt to `ranges` (the session's shuffle partitions, if None) of (shard, key, text_crc32,
    size) by sampled bounds, so the keys' spread plays no part, and numbered inside their range; what is
    numbered in one window per shard is its ranges. No task sees a whole shard's rows unless they fit a range.

    Null key: shard 0, grown_shard 0. Null text: size 8, crc32 of no bytes (0). Repeated rows get
    one slot each. An empty table gives an empty result. Columns other than the two named are unused.
    """
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")
    alike = (
        df.select(F.col(key).cast("long").alias("doc_id"), size, crc)
        .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("landing", jump_landing(F.col("doc_id"), shards))
        .select(
            "doc_id", "size", "text_crc32", "n",
            F.coalesce(F.col("landing.b"), F.lit(0)).cast("int").alias("shard"),
            F.when(F.col("landing.j") == shards, F.lit(shards)).otherwise(F.coalesce(F.col("landing.b"), F.lit(0))).cast("int").alias("grown_shard"),
        )
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    dealt = alike.repartitionByRange(ranges, *order) if ranges else alike.repartitionByRange(*order)
    ranged = common.written(dealt.withColumn("range", F.spark_partition_id()), "shard-ranges")
    earlier = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
        .select("shard", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    )
    inside = W.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("start") + F.col("before")
    return (
        ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, row_number() OVER () AS row_no FROM documents
), jumps AS (
  SELECT row_no, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END) AS k, -1::BIGINT AS b, 0::BIGINT AS j
  FROM base WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT row_no, nk, j, floor((j + 1) * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT row_no, j, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM jumps WHERE j < 24)
), landed AS (
  SELECT row_no, b, j FROM jumps WHERE j >= 24
), crcs AS (
  SELECT row_no, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) AS crc
  FROM base
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, coalesce(b, 0)::INT AS shard,
  (row_number() OVER (PARTITION BY coalesce(b, 0) ORDER BY doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot,
  (CASE WHEN j = 24 THEN 24 ELSE coalesce(b, 0) END)::INT AS grown_shard
FROM base JOIN crcs USING (row_no) LEFT JOIN landed USING (row_no)
"""
