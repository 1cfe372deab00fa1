"""Content identity, de-duplication and ingest accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, col: str = "content", out: str = "file_hash") -> DataFrame:
    """SHA-256 hex of a text or binary column; null stays null."""
    return df.withColumn(out, F.sha2(F.col(col).cast("binary"), 256))


def url_hash(df: DataFrame, col: str = "url", out: str = "file_hash") -> DataFrame:
    """SHA-256 hex of the URL as it stands; source_type and file_name where it is an http(s) URL."""
    web = F.col(col).startswith("http://") | F.col(col).startswith("https://")
    return df.withColumn(out, F.sha2(F.col(col).cast("binary"), 256)).withColumn("source_type", F.when(web, "url")).withColumn("file_name", F.when(web, F.col(col)))


def drop_ingested(new: DataFrame, documents: DataFrame) -> DataFrame:
    """D3: rows whose file_hash the documents don't hold. Only hashes of the history are shuffled."""
    return new.join(documents.select("file_hash").distinct(), "file_hash", "left_anti")


def drop_batch_duplicates(new: DataFrame, order: list) -> DataFrame:
    """Of equal file_hash the first by order. Rows are cut to one a hash and task before the shuffle,
    so a hash that a third of the batch shares costs one row a task. A null hash is a hash like others."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in new.columns if c != "file_hash"]
    best = new.groupBy("file_hash").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*keys)).alias("r"))
    return best.select("file_hash", *(F.col(f"r.`{c}`").alias(c) for c in rest)).select(*new.columns)


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """D5 on outcomes(target, status): counts per target, and in total where target is null and is_total 1."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.rollup("target").agg(F.grouping("target").cast("int").alias("is_total"), F.count(F.lit(1)).alias("discovered"), count("new"), count("skipped"), count("failed"))
