"""Results of costly plug-ins (models), stored by content: each distinct input is worked out once, and a run that was killed
goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path
from .stored import _files

#: Parts in which what is pending is worked out: a killed run loses one at most.
PARTS = 16


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All results stored so far; no rows where there are none yet. Only parts that were written whole are there."""
    folder, fs = _files(spark, path)
    done = [s.getPath().toString() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    whole = [p for p in done if fs.exists(_files(spark, f"{p}/_SUCCESS")[0])]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def worked_out(inputs: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], path: str, schema: str, parts: int = PARTS) -> DataFrame:
    """The stored results of all inputs: those whose `key`, a hash of the content, isn't stored yet go through `run`, which
    returns key and result (schema), in parts by their key, each stored by itself in a new folder.

    inputs are cut to one row of a key first, inside tasks before the shuffle, and what is pending is read once. Inputs that `run`
    returns no row for stay pending for the next call."""
    spark = inputs.sparkSession
    one = inputs.groupBy(key).agg(*(F.any_value(c).alias(c) for c in inputs.columns if c != key))
    pending = one.join(stored(spark, path, schema).select(key), key, "left_anti").withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    waiting = scratch_path(spark, "pending")
    pending.write.partitionBy("_part").parquet(waiting)
    held = spark.read.schema(pending.schema).parquet(waiting)
    for part in range(parts):
        run(held.where(F.col("_part") == part).drop("_part")).write.parquet(f"{path}/{uuid.uuid4().hex}")
    return stored(spark, path, schema)
