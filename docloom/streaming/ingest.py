"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import chunk_parent_child
from ..operators.cleaning import clean_markdown
from ..operators.identity import content_hash, drop_ingested
from ..operators.stored import _files

SCHEMA = "id BIGINT, file_name STRING, text STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _least_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with one hash, those whose id is smaller than all ids seen in this task before: a hash that a third of the batch
    shares costs a few rows a task in the shuffle."""
    seen: dict[str | None, int] = {}
    for batch in batches:
        keep = []
        for hash_, id_ in zip(batch.column("file_hash").to_pylist(), batch.column("id").to_pylist(), strict=True):
            at = id_ if id_ is not None else 1 << 63  # a null id comes last
            new = hash_ not in seen or at < seen[hash_]
            keep.append(new)
            if new:
                seen[hash_] = at
        yield batch.filter(pa.array(keep, pa.bool_()))


def _first_of_hash(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row with the smallest id, if no earlier batch had this hash."""
    if state.exists:
        return
    best = None
    for part in parts:
        row = part.sort_values("id", kind="stable").head(1)
        if best is None or pd.isna(best["id"].iloc[0]) or row["id"].iloc[0] < best["id"].iloc[0]:
            best = row
    state.update((True,))
    yield best


def new_texts(stream: DataFrame) -> DataFrame:
    """D1, D3 and D4 on a stream: each text once, for all batches: of a batch's copies that with the smallest id. What earlier
    batches had is the stream's state, kept by hash: a batch looks up its own hashes and reads nothing of the history."""
    hashed = content_hash(stream, "text")
    least = hashed.mapInArrow(_least_of_task, hashed.schema)
    return least.groupBy("file_hash").applyInPandasWithState(_first_of_hash, hashed.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def incremental_ingest(spark: SparkSession, source: str, kb: str, checkpoint: str, schema: str = SCHEMA, state_store: str = ROCKSDB) -> StreamingQuery:
    """Every micro-batch of new files under source: hash, drop repeats and what kb holds, clean, chunk, append.

    Rows are documents(id, file_name, text) as Parquet. Each batch writes to folders named by the stream and its own number,
    overwriting what a failed try left there; a batch that is tried again starts from the state it started from before, so it
    writes the same rows. Run again over the same files it adds nothing. State is kept in RocksDB with the checkpoint: what an
    executor holds in memory doesn't grow with the history. Only where kb holds documents of other streams, as after a
    checkpoint was lost, batches are compared with those documents' hashes, too.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    name = _stream_name(spark, checkpoint)
    others = [s for s in _streams(spark, kb) if s != name]

    def ingest(batch: DataFrame, batch_id: int) -> None:
        at = f"stream={name}/batch={batch_id}"
        if others:
            held = spark.read.schema("file_hash STRING").parquet(*(f"{kb}/documents/stream={s}/*" for s in others))
            batch = drop_ingested(batch, held)
        batch.write.mode("overwrite").parquet(f"{kb}/documents/{at}")
        stored = spark.read.schema(batch.schema).parquet(f"{kb}/documents/{at}")
        cleaned = clean_markdown(stored.select(F.col("id").alias("document_id"), "text"))
        chunk_parent_child(cleaned).write.mode("overwrite").parquet(f"{kb}/document_chunks/{at}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state_store)  # a query keeps the settings that it started with
    try:
        return new_texts(stream).writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that stays with a checkpoint."""
    folder, fs = _files(spark, f"{checkpoint}-name")
    if not fs.exists(folder):
        fs.mkdirs(_files(spark, f"{checkpoint}-name/{uuid.uuid4().hex}")[0])
    return sorted(s.getPath().getName() for s in fs.listStatus(folder))[0]


def _streams(spark: SparkSession, kb: str) -> list[str]:
    """Names of the streams that have stored documents under kb."""
    folder, fs = _files(spark, f"{kb}/documents")
    return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(folder)) if fs.exists(folder) else []


def held_documents(spark: SparkSession, kb: str) -> DataFrame | None:
    """The documents that batches have stored; None where there are none yet."""
    return spark.read.parquet(f"{kb}/documents") if _streams(spark, kb) else None
