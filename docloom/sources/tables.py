"""Reading and writing knowledge-base tables, source files, sitemaps and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..schemas import CHUNKS_PER_DOCUMENT, TABLES

#: Defaults that a stored document gets.
DOCUMENT_DEFAULTS = {"category": "其他", "fiscal_period": "Annual", "language": "zh-TW", "status": "已發布", "confidentiality": "公開"}
#: File types that are taken in.
SOURCE_TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx"}


def read_kb(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every knowledge-base table under path, with its declared schema."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


def identify_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 on files(path, content): (taken, rejected) with file_name, extension, source_type, file_hash."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    kind = F.create_map(*(F.lit(x) for pair in SOURCE_TYPES.items() for x in pair))[F.col("extension")]
    named = files.withColumn("file_name", F.regexp_extract("path", r"([^/\\]+)$", 1)).withColumn("extension", extension)
    made = named.withColumn("source_type", kind).withColumn("file_hash", F.sha2("content", 256))
    return made.where("source_type IS NOT NULL"), made.where("source_type IS NULL")


def read_source_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files below path."""
    return identify_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def keep_urls(urls: DataFrame, exclude: list[str], max_urls: int | None = None) -> DataFrame:
    """S3 on urls(pos, loc): trimmed, non-empty, without excluded keywords, the first max_urls by pos."""
    kept = urls.withColumn("loc", F.trim("loc")).where("loc <> ''")
    for word in exclude:
        kept = kept.where(~F.col("loc").contains(word))
    return kept if max_urls is None else kept.orderBy("pos").limit(max_urls)


def read_sitemap(spark: SparkSession, path: str, exclude: list[str] = (), max_urls: int | None = None) -> DataFrame:
    """S3: <loc> of a sitemap's <url> elements in document order, files by name: pos is (file, start of the split, row)."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc STRING").load(path)
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return keep_urls(rows.select("loc", pos.alias("pos")), list(exclude), max_urls)


_TARGET = (
    "type STRING, category STRING, language STRING, `group` STRING, company STRING, fiscal_year STRING, publish_date STRING, chunk_strategy STRING, "
    "page_offset INT, files ARRAY<STRING>, urls ARRAY<STRING>, url STRING, max_pages INT, max_depth INT, exclude_patterns ARRAY<STRING>"
)
MANIFEST = f"defaults STRUCT<language: STRING, `group`: STRING, company: STRING, chunk_strategy: STRING>, targets ARRAY<STRUCT<{_TARGET.replace(" STRING", ": STRING").replace(" ARRAY", ": ARRAY").replace(" INT", ": INT")}>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def expand_manifest(manifest: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per file, URL, sitemap or crawl root: target_no, item_no, kind, item and the metadata.

    A target's value wins over the default; chunk_strategy falls back to 'parent_child'. keep: columns that tell manifests apart.
    """
    t = manifest.select(*keep, "defaults", F.posexplode("targets").alias("target_no", "t"))
    either = lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"defaults.{c}")).alias(c)
    items = (
        F.when(F.col("t.type") == "pdf_list", F.col("t.files")).when(F.col("t.type") == "url_list", F.col("t.urls"))
        .when(F.col("t.type").isin("sitemap", "crawler"), F.array("t.url"))
    )
    meta = [
        F.col("t.category").alias("category"), either("language"), either("group"), either("company"), F.col("t.fiscal_year").alias("fiscal_year"),
        F.to_date("t.publish_date").alias("publish_date"), F.coalesce("t.chunk_strategy", "defaults.chunk_strategy", F.lit("parent_child")).alias("chunk_strategy"),
        F.coalesce("t.page_offset", F.lit(0)).alias("page_offset"), F.col("t.max_pages").alias("max_pages"), F.col("t.max_depth").alias("max_depth"),
    ]
    return t.select(*keep, "target_no", F.col("t.type").alias("kind"), *meta, F.posexplode(items).alias("item_no", "item"))


def stored_documents(df: DataFrame) -> DataFrame:
    """S5's rows: blanks to null, defaults filled, display_name from the file name without its last extension."""
    out = df
    for c in ("category", "display_name", "report_group", "group", "company", "language", "fiscal_year", "fiscal_period", "status", "confidentiality"):
        if c in out.columns:
            out = out.withColumn(c, blank_to_null(F.col(f"`{c}`")))
    for c, value in DOCUMENT_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in out.columns else F.lit(value))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return out.withColumn("display_name", F.coalesce("display_name", stem) if "display_name" in out.columns else stem)


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """S5"""
    stored_documents(df).write.mode(mode).partitionBy("source_type").parquet(path)


def flat_chunks(df: DataFrame) -> DataFrame:
    """S6's rows: id, and 'standalone' where no chunk type is given."""
    kind = F.coalesce("chunk_type", F.lit("standalone")) if "chunk_type" in df.columns else F.lit("standalone")
    out = df.withColumn("chunk_type", kind).withColumn("id", F.col("document_id") * CHUNKS_PER_DOCUMENT + F.col("chunk_index"))
    return out if "embedding" in out.columns else out.withColumn("embedding", F.lit(None).cast("array<float>"))


def write_flat_chunks(df: DataFrame, path: str, mode: str = "append") -> None:
    """S6"""
    flat_chunks(df).write.mode(mode).parquet(path)


def parent_child_rows(parents: DataFrame, children: DataFrame) -> DataFrame:
    """S7's rows. parents(document_id, chunk_index, text_content, metadata, embedding), children the same with
    parent_index. A parent without children is 'standalone' and keeps its vector; one with children is
    'parent' and has none; children point to their parent's id."""
    key = F.col("document_id") * CHUNKS_PER_DOCUMENT
    has = children.select("document_id", F.col("parent_index").alias("chunk_index")).distinct().withColumn("has", F.lit(True))
    p = parents.join(has, ["document_id", "chunk_index"], "left")
    columns = ["id", "document_id", "chunk_index", "text_content", "embedding", "metadata", "chunk_type", "parent_chunk_id"]
    top = p.withColumns(
        {
            "id": key + F.col("chunk_index"),
            "chunk_type": F.when(F.col("has"), "parent").otherwise("standalone"),
            "embedding": F.when(F.col("has"), F.lit(None)).otherwise(F.col("embedding")),
            "parent_chunk_id": F.lit(None).cast("long"),
        }
    ).select(*columns)
    below = children.withColumns({"id": key + F.col("chunk_index"), "chunk_type": F.lit("child"), "parent_chunk_id": key + F.col("parent_index")}).select(*columns)
    return top.unionByName(below)


def chunk_type_counts(rows: DataFrame) -> DataFrame:
    """S7's report: parents (with and without children) and children."""
    return rows.agg(
        F.count_if(F.col("chunk_type") != "child").alias("parents"), F.count_if(F.col("chunk_type") == "child").alias("children")
    )


def write_parent_child(parents: DataFrame, children: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Writes the rows and returns their counts."""
    rows = parent_child_rows(parents, children)
    rows.write.mode(mode).parquet(path)
    return chunk_type_counts(rows)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
