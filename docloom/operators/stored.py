"""Tables that change: rows in buckets of their key, and a version for every change.

A table is a folder with one sub-folder for each rewritten bucket and a list of versions; a version names the folders that it
consists of. A change reads and writes only the buckets that its keys fall into and then adds one version file, which a
rename puts in place as a whole: a run that dies before leaves the version before, and of two changes made at once the
second fails instead of undoing the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that the table has, ascending; none if there is no table."""
    folder, fs = _files(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _version(spark: SparkSession, path: str, number: int) -> dict:
    file, fs = _files(spark, f"{path}/versions/{number}.json")
    scanner = spark.sparkContext._jvm.java.util.Scanner(fs.open(file), "UTF-8").useDelimiter("\\A")
    try:
        return json.loads(scanner.next())
    finally:
        scanner.close()


def _commit(spark: SparkSession, path: str, number: int, version: dict) -> None:
    """Puts a version in place, or fails if another change has taken its number."""
    draft, fs = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    final, _ = _files(spark, f"{path}/versions/{number}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {path} was made by another change; read the table and try again")


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict[int, str]:
    """Writes rows to a new folder by buckets; bucket -> folder of those that have rows. A bucket is one file."""
    name = f"data/{uuid.uuid4().hex}"
    numbered = rows.withColumn("_bucket", bucket_of(f"`{key}`", buckets))
    numbered.repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    folder, fs = _files(rows.sparkSession, f"{path}/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(f.partition("=")[2]): f"{name}/{f}" for f in found if f.startswith("_bucket=")}


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """A new table of the rows, as version 1. Null keys are a key like others. Fails where there is a table."""
    spark = rows.sparkSession
    if versions(spark, path):
        raise RuntimeError(f"{path} is a table already")
    folders = _write(rows, path, key, buckets)
    _commit(spark, path, 1, {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": folders})
    return 1


def _rows(spark: SparkSession, path: str, version: dict, only: set[int] | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(version["schema"])
    folders = [f"{path}/{f}" for b, f in version["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's rows, of the latest version or of an earlier one."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no such table or version: {path}, {version}")
    return _rows(spark, path, _version(spark, path, version or known[-1]))


def change(spark: SparkSession, path: str, keys: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> list[int]:
    """One change: `rewrite` gets the rows of all buckets that keys (one column) fall into and returns what they become, of
    the same columns; rows must stay in those buckets. Returns the buckets rewritten; with none there is no new version."""
    number = versions(spark, path)[-1]
    version = _version(spark, path, number)
    touched = {r[0] for r in keys.select(bucket_of(f"`{keys.columns[0]}`", version["buckets"])).distinct().collect()}  # at most the number of buckets
    if not touched:
        return []
    old = _rows(spark, path, version, touched)
    new = _write(rewrite(old).select(*(f"`{c}`" for c in old.columns)), path, version["key"], version["buckets"])
    if not set(new) <= touched:
        raise ValueError("a rewritten row left its bucket")
    kept = {b: f for b, f in version["folders"].items() if int(b) not in touched}
    _commit(spark, path, number + 1, version | {"folders": kept | {str(b): f for b, f in new.items()}})
    return sorted(touched)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> list[int]:
    """Rows replace those of their key, or join them. rows are read twice."""
    return change(spark, path, rows.select(key), lambda old: old.join(rows.select(key), key, "left_anti").unionByName(rows))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions but the last `keep`, and folders that none of those names; returns how many folders. Not while a
    change is being made: its folders have no version yet."""
    known = versions(spark, path)
    kept = {f for n in known[-keep:] for f in _version(spark, path, n)["folders"].values()}
    for n in known[:-keep]:
        file, fs = _files(spark, f"{path}/versions/{n}.json")
        fs.delete(file, False)
    gone, (data, fs) = 0, _files(spark, f"{path}/data")
    for run in fs.listStatus(data) if fs.exists(data) else []:
        for part in fs.listStatus(run.getPath()):
            name = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in kept:
                gone += fs.delete(part.getPath(), True)
    return gone


# ---------------------------------------------------------------- the catalogue's changes


def delete_documents(spark: SparkSession, docs: str, chunks: str, ids: DataFrame) -> tuple[list[int], list[int]]:
    """G15 on stored tables, documents by id and chunks by document_id: chunks go with their document and children with their
    parent, also a parent of another document. Chunks are deleted first, so a run that dies between leaves documents without
    chunks, which the same call deletes, never chunks without a document. Returns the buckets rewritten of both."""
    gone = ids.select("id").distinct()
    own = gone.withColumnRenamed("id", "document_id")
    held = read(spark, chunks)
    parents = held.join(own, "document_id", "left_semi").select(F.col("id").alias("parent_chunk_id"))
    orphans = held.select("document_id", "parent_chunk_id").join(parents, "parent_chunk_id", "left_semi").select("document_id")
    keys = own.unionByName(orphans)

    def without(rows: DataFrame) -> DataFrame:
        return rows.join(own, "document_id", "left_anti").join(parents, "parent_chunk_id", "left_anti")

    of_chunks = change(spark, chunks, keys, without)
    return change(spark, docs, gone, lambda rows: rows.join(gone, "id", "left_anti")), of_chunks


def upsert_config(spark: SparkSession, path: str, changes: DataFrame) -> list[int]:
    """G17 on a stored table by key."""
    return change(spark, path, changes.select("key"), lambda rows: catalog.upsert_config(rows, changes))


def insert_terms_if_absent(spark: SparkSession, path: str, new: DataFrame) -> list[int]:
    """G18 on a stored table by term; buckets without a fresh term stay as they are."""
    fresh = new.select("term").distinct().join(read(spark, path).select("term"), "term", "left_anti")
    return change(spark, path, fresh, lambda rows: catalog.insert_terms_if_absent(rows, new.join(fresh, "term", "left_semi")))


def update_documents(spark: SparkSession, path: str, patches: DataFrame) -> list[int]:
    """G19 on a stored table by id; ids that the table lacks add nothing."""
    held = patches.join(read(spark, path).select("id"), "id", "left_semi")
    return change(spark, path, held.select("id"), lambda rows: catalog.update_documents(rows, held)[0])
