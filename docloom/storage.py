"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and driver and tasks are one process (tests) a local
    folder is made and set; on a cluster, where each machine would write to its own disk, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the scratch tables made since the last call, once what was built on them is stored; returns how many."""
    hadoop, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(hadoop).delete(path, True)
    return gone


#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, by one bound for all operators: rows here are anything from a few numbers to a shard."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and outlives lost executors. compression: Spark's own choice if None."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
