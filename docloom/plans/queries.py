"""Every operator as a query over the benchmark tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..operators import answers as A
from ..operators import catalog as G
from ..operators import chunking as K
from ..operators import cleaning as C
from ..operators import embedding as E
from ..operators import identity as D
from ..operators import layout as P
from ..operators import scoring as S
from ..operators import search as R
from ..operators import stored
from ..operators import web as WEB
from ..operators.numbering import numbered
from ..sources import tables as T
from ..storage import scratch_path, written
from ..streaming.ingest import incremental_ingest
from ..streaming.usage import usage_stream, usage_totals
from . import derived as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


DOCS, DECO, CHUNKS = X.WITH_DOCS, X.WITH_DECORATED, X.WITH_CHUNKS


# ---------------------------------------------------------------- S, D


_KB = """WITH ids AS (SELECT doc_id AS id FROM documents) SELECT 'documents' AS kb_table, id, CASE id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'url' END AS detail FROM ids
UNION ALL SELECT 'document_chunks', id, CASE WHEN id % 4 = 0 THEN 'parent' ELSE 'child' END FROM ids
UNION ALL SELECT 'terms_dictionary', id, 'T' || id FROM ids UNION ALL SELECT 'rag_config', id, 'v' || id FROM ids UNION ALL SELECT 'qa_feedback', id, CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END FROM ids
UNION ALL SELECT 'usage_log', id, 'api' FROM ids"""


@query("S1_read_kb", _KB)
def s1(spark, sf):
    """Every knowledge-base table, stored in the shared folder and read back by its declared schema."""
    kb, docs = scratch_path(spark, "kb"), X.documents(spark, sf)
    T.write_documents(docs.drop("text"), f"{kb}/documents")
    X.chunks(spark, sf).write.parquet(f"{kb}/document_chunks")
    text = F.col("id").cast("string")
    docs.select("id", F.concat(F.lit("T"), text).alias("term")).write.parquet(f"{kb}/terms_dictionary")
    docs.select(text.alias("key"), F.concat(F.lit("v"), text).alias("value")).write.parquet(f"{kb}/rag_config")
    docs.select("id", F.when(F.col("id") % 2 == 0, "up").otherwise("down").alias("rating")).write.parquet(f"{kb}/qa_feedback")
    docs.select("id", F.lit("api").alias("source")).write.parquet(f"{kb}/usage_log")
    detail = {"documents": "source_type", "document_chunks": "chunk_type", "terms_dictionary": "term", "rag_config": "value", "qa_feedback": "rating", "usage_log": "source"}
    out = None
    for name, df in T.read_kb(spark, kb).items():
        part = df.select(F.lit(name).alias("kb_table"), (F.col("key").cast("long") if name == "rag_config" else F.col("id")).alias("id"), F.col(detail[name]).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@query("S2_read_source_files", """SELECT page_id, 'p' || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' ELSE '.txt' END AS file_name, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'docx' END AS source_type, sha256(html) AS file_hash FROM pages""")
def s2(spark, sf):
    """The pages as files: their HTML is the bytes."""
    ends = F.expr("CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' ELSE '.txt' END")
    files = _read(spark, sf, "pages").select("page_id", F.concat(F.lit("file:/in/a.b/p"), F.col("page_id").cast("string"), ends).alias("path"), F.col("html").cast("binary").alias("content"))
    taken, rejected = T.identify_files(files)
    return taken.unionByName(rejected).select("page_id", "file_name", "source_type", "file_hash")


@query("S3_read_sitemap", "SELECT trim(url) AS loc FROM pages WHERE NOT contains(url, '.org') AND NOT contains(url, '?') AND trim(url) <> ''")
def s3(spark, sf):
    """A sitemap of all pages' URLs, stored as XML in the shared folder and read back."""
    path = scratch_path(spark, "sitemap")
    urls = _read(spark, sf, "pages").where("url IS NOT NULL").select(F.concat(F.lit(" "), "url", F.lit(" ")).alias("loc"))
    urls.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return T.read_sitemap(spark, path, [".org", "?"]).select("loc")


@query("S4_expand_manifest", """SELECT doc_id, 0 AS target_no, i AS item_no, 'pdf_list' AS kind, 'f' || doc_id || '_' || i AS item, 'fr' AS language, 'parent_child' AS chunk_strategy, 'g' AS "group", 3 AS page_offset FROM documents, (VALUES (0), (1)) v(i)
UNION ALL SELECT doc_id, 1, 0, 'url_list', source, lang, 'flat', 'h', 0 FROM documents UNION ALL SELECT doc_id, 2, 0, 'sitemap', 'map' || doc_id, lang, 'parent_child', 'g', 0 FROM documents""")
def s4(spark, sf):
    """A manifest of three targets for each document."""
    d, null = _read(spark, sf, "documents"), "cast(NULL AS string)"
    target = lambda kind, language="NULL", group="NULL", strategy="NULL", offset="NULL", files="NULL", urls="NULL", url="NULL": (
        f"struct('{kind}' AS type, 'c' AS category, cast({language} AS string) AS language, cast({group} AS string) AS `group`, {null} AS company, {null} AS fiscal_year, {null} AS publish_date, cast({strategy} AS string) AS chunk_strategy, "
        f"cast({offset} AS int) AS page_offset, cast({files} AS array<string>) AS files, cast({urls} AS array<string>) AS urls, cast({url} AS string) AS url, cast(NULL AS int) AS max_pages, cast(NULL AS int) AS max_depth)"
    )
    targets = ", ".join([
        target("pdf_list", "'fr'", offset="3", files="array(concat('f', doc_id, '_0'), concat('f', doc_id, '_1'))"),
        target("url_list", group="'h'", strategy="'flat'", urls="array(source)"), target("sitemap", url="concat('map', doc_id)"),
    ])
    manifest = d.selectExpr("doc_id", f"struct(lang AS language, 'g' AS `group`, {null} AS company, {null} AS chunk_strategy) AS defaults", f"array({targets}) AS targets")
    return T.expand_manifest(manifest, ["doc_id"]).select("doc_id", "target_no", "item_no", "kind", "item", "language", "chunk_strategy", "group", "page_offset")


@query("T1_incremental_ingest", """WITH h AS (SELECT doc_id, sha256(text) AS file_hash FROM documents) SELECT coalesce(min(doc_id) FILTER (doc_id % 2 = 0), min(doc_id)) AS id, file_hash, true AS chunked FROM h GROUP BY file_hash""")
def t1(spark, sf):
    """The even documents are ingested, then all of them, then once more without new files: each text is stored once."""
    at = scratch_path(spark, "ingest")
    docs = _read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.lit("f").alias("file_name"), "text")
    for part in (docs.where("id % 2 = 0"), docs, None):
        if part is not None:
            part.write.mode("append").parquet(f"{at}/in")
        incremental_ingest(spark, f"{at}/in", f"{at}/kb", f"{at}/progress").awaitTermination()
    stored, chunks = spark.read.parquet(f"{at}/kb/documents"), spark.read.parquet(f"{at}/kb/document_chunks")
    has = chunks.where("chunk_type <> 'child'").select(F.col("document_id").alias("id")).distinct().withColumn("chunked", F.lit(True))
    return stored.join(has, "id", "left").select("id", "file_hash", F.coalesce("chunked", F.lit(False)).alias("chunked"))


@query("S5_stored_documents", f"""WITH {DOCS} SELECT id, coalesce(category, '其他') AS category, coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, regexp_replace(file_name, '\\.[^.]*$', '')) AS display_name,
  coalesce(nullif(fiscal_period, ''), 'Annual') AS fiscal_period, coalesce(status, '已發布') AS status, coalesce(confidentiality, '公開') AS confidentiality, language FROM docs""")
def s5(spark, sf):
    return T.stored_documents(X.documents(spark, sf)).select("id", "category", "display_name", "fiscal_period", "status", "confidentiality", "language")


@query("S6_flat_chunks", "SELECT doc_id * 1000000 + 1 AS id, doc_id AS document_id, 'standalone' AS chunk_type, text AS text_content FROM documents")
def s6(spark, sf):
    rows = _read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("chunk_index"), F.col("text").alias("text_content"))
    return T.flat_chunks(rows).select("id", "document_id", "chunk_type", "text_content")


@query("S7_parent_child_rows", """WITH p AS (SELECT doc_id AS d FROM documents WHERE doc_id % 4 = 0), k AS (SELECT doc_id, doc_id - doc_id % 4 AS d, doc_id % 4 AS i FROM documents WHERE doc_id % 4 > 0)
SELECT d * 1000000 AS id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.d = p.d) THEN 'parent' ELSE 'standalone' END AS chunk_type, CAST(NULL AS BIGINT) AS parent_chunk_id FROM p
UNION ALL SELECT d * 1000000 + i, 'child', d * 1000000 FROM k""")
def s7(spark, sf):
    c = X.chunks(spark, sf)
    top = c.where("id % 4 = 0").select("document_id", "chunk_index", "text_content", "metadata", "embedding")
    kids = c.where("id % 4 > 0").select("document_id", "chunk_index", F.lit(0).alias("parent_index"), "text_content", "metadata", "embedding")
    return T.parent_child_rows(top, kids).select("id", "chunk_type", "parent_chunk_id")


@query("D1_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def d1(spark, sf):
    return D.content_hash(_read(spark, sf, "documents"), "text").select("doc_id", "file_hash")


@query("D2_url_hash", "SELECT page_id, sha256(url) AS file_hash, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'url' END AS source_type FROM pages")
def d2(spark, sf):
    return D.url_hash(_read(spark, sf, "pages")).select("page_id", "file_hash", "source_type")


@query("D3_drop_ingested", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def d3(spark, sf):
    both = D.content_hash(_read(spark, sf, "documents"), "text").select("doc_id", "file_hash")
    return D.drop_ingested(both.where("doc_id % 2 = 1"), both.where("doc_id % 2 = 0")).select("doc_id")


@query("D4_drop_batch_duplicates", "SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash FROM documents GROUP BY sha256(text)")
def d4(spark, sf):
    return D.drop_batch_duplicates(D.content_hash(_read(spark, sf, "documents"), "text").select("doc_id", "file_hash"), ["doc_id"])


_OUTCOME = "CASE doc_id % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'new' END"


@query("D5_ingest_summary", f"""SELECT source AS target, grouping(source)::INT AS is_total, count(*) AS discovered, count(*) FILTER (s = 'new') AS "new", count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed
FROM (SELECT source, {_OUTCOME} AS s FROM documents) GROUP BY ROLLUP (source)""")
def d5(spark, sf):
    return D.ingest_summary(_read(spark, sf, "documents").selectExpr("source AS target", f"{_OUTCOME} AS status"))


# ---------------------------------------------------------------- G


@query("G1_kb_stats", f"""WITH {DOCS} SELECT 'category' AS kind, category AS name, count(*) AS n FROM docs GROUP BY category UNION ALL SELECT 'source_type', source_type, count(*) FROM docs GROUP BY source_type
UNION ALL SELECT 'documents', NULL, count(*) FROM docs UNION ALL SELECT 'chunks', NULL, count(*) FROM docs""")
def g1(spark, sf):
    return G.kb_stats(X.documents(spark, sf), X.chunks(spark, sf))


@query("G2_filter_facets", f"""WITH {DOCS}, l AS (SELECT 'category' AS facet, category AS value FROM docs UNION SELECT 'fiscal_year', fiscal_year FROM docs UNION SELECT 'language', language FROM docs UNION SELECT 'group', "group" FROM docs UNION SELECT 'company', company FROM docs)
SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN facet = 'fiscal_year' THEN value END DESC, value)::INT AS pos FROM l WHERE value <> ''""")
def g2(spark, sf):
    return G.filter_facets(X.documents(spark, sf))


@query("G3_list_documents", f"WITH {DOCS} SELECT id, created_at::VARCHAR AS at, (SELECT count(*) FROM docs WHERE language = 'en') AS total FROM docs WHERE language = 'en' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def g3(spark, sf):
    page, total = G.list_documents(X.documents(spark, sf), {"language": "en"}, 50, 10)
    return page.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at")).join(F.broadcast(total.select("total")))  # one row


_NAMES = [("%2024%annual%", "Annual 2024"), ("%2023%sustain%6%", "Sustainability 2023")]
_GROUPS = [("%sustain%", "永續報告書"), ("%annual%0.pdf", "年度報告")]


@query("G4_backfill_pdf_metadata", f"""WITH {DOCS} SELECT id, CASE WHEN o THEN CASE WHEN file_name ILIKE '%2024%annual%' THEN 'Annual 2024' WHEN file_name ILIKE '%2023%sustain%6%' THEN 'Sustainability 2023' ELSE file_name END ELSE display_name END AS display_name,
CASE WHEN o THEN CASE WHEN file_name ILIKE '%sustain%' THEN '永續報告書' WHEN file_name ILIKE '%annual%0.pdf' THEN '年度報告' ELSE category END ELSE report_group END AS report_group FROM (SELECT *, source_type = 'pdf' AND display_name IS NULL AS o FROM docs)""")
def g4(spark, sf):
    return G.backfill_pdf_metadata(X.documents(spark, sf), _NAMES, _GROUPS).select("id", "display_name", "report_group")


_URLS = [("%/esg/%", "ESG"), ("%news%4%", "News")]
_PATH = "regexp_replace(regexp_replace(file_name, '^https?://[^/]+/', ''), '[?#].*$', '')"


@query("G5_backfill_url_metadata", f"""WITH {DOCS} SELECT id, CASE WHEN source_type = 'url' AND report_group IS NULL THEN CASE WHEN category <> '其他' THEN category WHEN file_name ILIKE '%/esg/%' THEN 'ESG' WHEN file_name ILIKE '%news%4%' THEN 'News' ELSE 'Site' END ELSE report_group END AS report_group,
CASE WHEN display_name IS NULL THEN CASE WHEN file_name LIKE 'http%' THEN {_PATH} ELSE file_name END ELSE display_name END AS display_name FROM docs""")
def g5(spark, sf):
    return G.backfill_url_metadata(X.documents(spark, sf), _URLS, "Site").select("id", "report_group", "display_name")


@query("G5_second_variant", f"""WITH {DOCS} SELECT id, CASE WHEN source_type = 'url' AND (report_group IS NULL OR report_group = '') THEN category ELSE report_group END AS report_group,
CASE WHEN source_type = 'url' AND (display_name IS NULL OR display_name = '') THEN {_PATH} ELSE display_name END AS display_name FROM docs""")
def g5_second(spark, sf):
    return G.backfill_url_metadata(X.documents(spark, sf), [], blank_is_missing=True, copy_category=True).select("id", "report_group", "display_name")


@query("G6_report_group_summary", f"WITH {DOCS} SELECT report_group, count(*) AS n, min(display_name) AS sample FROM docs GROUP BY report_group")
def g6(spark, sf):
    return G.report_group_summary(X.documents(spark, sf))


_NAMED = "concat(CASE doc_id % 8 WHEN 0 THEN 'A/esg/' WHEN 1 THEN 'News' WHEN 2 THEN 'newsletter' WHEN 3 THEN '電子報' WHEN 4 THEN 'Annual' WHEN 5 THEN '永續' WHEN 6 THEN 'x年報esg' ELSE 'plain' END, doc_id)"


@query("G7_guess_category", f"""SELECT id, CASE WHEN source_type = 'pdf' THEN CASE WHEN f LIKE '%永續%' OR f LIKE '%sustain%' THEN '永續報告書' WHEN f LIKE '%年報%' OR f LIKE '%annual%' THEN '年度報告' ELSE '其他' END
WHEN f LIKE '%esg%' THEN 'ESG專區' WHEN f LIKE '%news%' OR f LIKE '%新聞%' THEN '新聞' WHEN f LIKE '%newsletter%' OR f LIKE '%電子報%' THEN '電子報' ELSE '官網' END AS guessed_category
FROM (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'url' END AS source_type, lower({_NAMED}) AS f FROM documents)""")
def g7(spark, sf):
    named = _read(spark, sf, "documents").selectExpr("doc_id AS id", "CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'url' END AS source_type", f"{_NAMED} AS file_name")
    return G.guess_category(named).select("id", "guessed_category")


@query("G8_fill_document_defaults", f"""WITH {DOCS} SELECT id, coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, file_name) AS display_name, coalesce(category, '') AS category, coalesce(fiscal_year, '') AS fiscal_year,
coalesce(nullif(fiscal_period, ''), 'Annual') AS fiscal_period, coalesce(status, '已發布') AS status, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at FROM docs""")
def g8(spark, sf):
    return G.fill_document_defaults(X.documents(spark, sf)).select("id", "display_name", "category", "fiscal_year", "fiscal_period", "status", "created_at")


@query("G9_browse_documents", f"""WITH {DOCS}, k AS (SELECT * FROM docs WHERE category IS NULL AND ("group" = 'g1' OR company = 'g1')) SELECT id, (SELECT count(*) FROM k) AS shown, (SELECT count(*) FROM docs) AS total FROM k""")
def g9(spark, sf):
    rows, counts = G.browse_documents(X.documents(spark, sf), category=G.UNCATEGORISED, company="g1")
    return rows.select("id").join(F.broadcast(counts))  # one row


@query("G10_category_tree_counts", f"""WITH {DOCS}, g(group_name, category) AS (VALUES ('reports', '永續報告書'), ('reports', '年度報告'), ('web', '網頁')), c AS (SELECT category, count(*) AS n FROM docs GROUP BY category),
p AS (SELECT coalesce(group_name, '其他') AS group_name, c.category, n FROM c LEFT JOIN g ON g.category = c.category)
SELECT group_name, category, false AS category_total, sum(n)::BIGINT AS n FROM p GROUP BY group_name, category UNION ALL SELECT group_name, NULL, true, sum(n)::BIGINT FROM p GROUP BY group_name""")
def g10(spark, sf):
    groups = spark.createDataFrame([("reports", "永續報告書"), ("reports", "年度報告"), ("web", "網頁")], "group_name string, category string")
    return G.category_tree_counts(X.documents(spark, sf), groups)


@query("G11_merge_category_groups", f"""WITH {DOCS} SELECT id, list_sort(list_distinct([coalesce(category, '-'), company])) AS cats FROM docs""")
def g11(spark, sf):
    d = X.documents(spark, sf)
    merged = G.merge_category_groups(F.create_map(F.lit("g"), F.array(F.coalesce("category", F.lit("-")))), F.create_map(F.lit("g"), F.array("company", F.coalesce("category", F.lit("-")))))
    return d.select("id", F.sort_array(merged["g"]).alias("cats"))


@query("G12_companies_of_group", f"""WITH {DOCS} SELECT DISTINCT company FROM docs WHERE "group" IN ('g0', 'g2')""")
def g12(spark, sf):
    return G.companies_of_group(X.documents(spark, sf), ["g0", "g2"])


@query("G13_term_counts", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def g13(spark, sf):
    return G.term_counts(_read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("term"), F.col("lang").alias("category")))


@query("G14_ingested_since", f"WITH {DOCS}, k AS (SELECT id FROM docs WHERE created_at >= TIMESTAMP '2024-01-01 05:00:00') SELECT id, (SELECT count(*) FROM k) AS total FROM k")
def g14(spark, sf):
    rows, total = G.ingested_since(X.documents(spark, sf), "2024-01-01 05:00:00")
    return rows.select("id").join(F.broadcast(total))  # one row


@query("G15_delete_documents", "SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id % 12 <> 0 UNION ALL SELECT 'chunk', doc_id FROM documents WHERE (doc_id - doc_id % 4) % 12 <> 0")
def g15(spark, sf):
    gone = _read(spark, sf, "documents").where("doc_id % 12 = 0").select(F.col("doc_id").alias("id"))
    docs, chunks = G.delete_documents(X.documents(spark, sf).select("id"), X.chunks(spark, sf).select("id", "document_id", "parent_chunk_id"), gone)
    return docs.select(F.lit("document").alias("kind"), "id").unionByName(chunks.select(F.lit("chunk").alias("kind"), "id"))


@query("G15_stored_tables", ORACLE_SQL["G15_delete_documents"])
def g15_stored(spark, sf):
    """Documents and chunks as stored tables, of which the same documents are deleted."""
    at = scratch_path(spark, "stored")
    docs, chunks = f"{at}/documents", f"{at}/chunks"
    stored.create(X.documents(spark, sf), docs, "id")
    stored.create(X.chunks(spark, sf).select("id", "document_id", "parent_chunk_id", "text_content"), chunks, "document_id")
    stored.delete_documents(spark, docs, chunks, _read(spark, sf, "documents").where("doc_id % 12 = 0").select(F.col("doc_id").alias("id")))
    return stored.read(spark, docs).select(F.lit("document").alias("kind"), "id").unionByName(stored.read(spark, chunks).select(F.lit("chunk").alias("kind"), "id"))


@query("G16_document_chunks_of", f"WITH {CHUNKS} SELECT document_id, chunk_index, id, chunk_type, parent_chunk_id FROM chunks")
def g16(spark, sf):
    ids = _read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    return G.document_chunks_of(X.chunks(spark, sf), ids).drop("text_content")


@query("G17_upsert_config", """WITH c AS (SELECT source AS key, min(lang) AS value FROM documents GROUP BY source), n AS (SELECT source AS key, max(lang) AS value FROM documents WHERE doc_id % 3 = 0 GROUP BY source)
SELECT coalesce(c.key, n.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE c.value END AS value FROM c FULL JOIN n ON c.key = n.key""")
def g17(spark, sf):
    return G.upsert_config(*_config(spark, sf))


def _config(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = _read(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("key")).agg(F.min("lang").alias("value")), d.where("doc_id % 3 = 0").groupBy(F.col("source").alias("key")).agg(F.max("lang").alias("value"))


@query("G17_stored_config", ORACLE_SQL["G17_upsert_config"])
def g17_stored(spark, sf):
    config, changes = _config(spark, sf)
    at = scratch_path(spark, "config")
    stored.create(config, at, "key")
    stored.upsert_config(spark, at, changes)
    return stored.read(spark, at)


@query("G17_read_config", """WITH c AS (SELECT source AS key, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN lang END AS set_value, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT key, CASE WHEN try_cast(nullif(set_value, '') AS INT) IS NOT NULL THEN set_value ELSE '7' END AS value, 'int' AS kind FROM c WHERE n = 1""")
def g17_read(spark, sf):
    """Every source has a setting of kind int with the default 7; what its first document sets, counts where it is a number."""
    d = _read(spark, sf, "documents")
    first = d.groupBy(F.col("source").alias("key")).agg(F.min_by(F.expr("CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN cast(doc_id AS string) WHEN 2 THEN lang END"), "doc_id").alias("value"))
    return G.read_config(first.select("key", F.lit("7").alias("value"), F.lit("int").alias("kind")), first)


@query("G18_insert_terms_if_absent", """WITH t AS (SELECT source AS term, 'old' AS full_name FROM documents WHERE doc_id % 4 = 0 GROUP BY source), n AS (SELECT lang || source AS term, min(doc_id::VARCHAR) AS full_name FROM documents GROUP BY 1 UNION ALL SELECT source, 'new' FROM documents GROUP BY source)
SELECT * FROM t UNION ALL SELECT term, min(full_name) FROM n WHERE term NOT IN (SELECT term FROM t) GROUP BY term""")
def g18(spark, sf):
    return G.insert_terms_if_absent(*_terms(spark, sf))


@query("G18_stored_terms", ORACLE_SQL["G18_insert_terms_if_absent"])
def g18_stored(spark, sf):
    old, new = _terms(spark, sf)
    at = scratch_path(spark, "terms")
    stored.create(old, at, "term")
    stored.insert_terms_if_absent(spark, at, new)
    return stored.read(spark, at)


def _terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = _read(spark, sf, "documents")
    old = d.where("doc_id % 4 = 0").select(F.col("source").alias("term")).distinct().withColumn("full_name", F.lit("old"))
    new = d.groupBy(F.concat("lang", "source").alias("term")).agg(F.min(F.col("doc_id").cast("string")).alias("full_name"))
    new = new.unionByName(d.select(F.col("source").alias("term")).distinct().withColumn("full_name", F.lit("new")))
    return old, new


@query("G19_update_documents", f"""WITH {DOCS} SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 6 = 0 THEN 'patched' END ELSE category END AS category, company FROM docs""")
def g19(spark, sf):
    d = X.documents(spark, sf)
    patches = d.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "patched").otherwise(" ").alias("category"))
    return G.update_documents(d, patches)[0].select("id", "category", "company")


@query("G19_stored_documents", ORACLE_SQL["G19_update_documents"])
def g19_stored(spark, sf):
    d = X.documents(spark, sf)
    at = scratch_path(spark, "stored")
    stored.create(d.drop("text"), at, "id")
    stored.update_documents(spark, at, d.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "patched").otherwise(" ").alias("category")))
    return stored.read(spark, at).select("id", "category", "company")


@query("G20_backfill_group_company", f"""WITH {DOCS} SELECT id, coalesce("group", 'main') AS "group", CASE WHEN "group" IS NULL THEN 'head' ELSE company END AS company FROM docs""")
def g20(spark, sf):
    return G.backfill_group_company(X.documents(spark, sf), "main", "head").select("id", "group", "company")


@query("G21_split_feedback", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'up' ELSE 'down' END AS rating, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'web' END, 'api') AS source FROM documents WHERE doc_id % 3 <> 2")
def g21(spark, sf):
    rows = _read(spark, sf, "documents").selectExpr("doc_id AS id", "CASE doc_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS rating", "CASE WHEN doc_id % 2 = 0 THEN 'web' END AS source")
    return G.split_feedback(rows)[0]


@query("G22_usage_rollup", """SELECT strftime(day, '%Y-%m-%d') AS day, source, (2 * grouping(day) + grouping(source))::INT AS level, count(*) AS calls, sum(t)::BIGINT AS tokens
FROM (SELECT ts::DATE AS day, event_type AS source, length(event_type) AS t FROM events) GROUP BY ROLLUP (day, source)""")
def g22(spark, sf):
    usage = _read(spark, sf, "events").select(F.col("ts").alias("created_at"), F.col("event_type").alias("source"), F.length("event_type").alias("total_tokens"))
    return G.usage_rollup(usage).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("G22_usage_stream", ORACLE_SQL["G22_usage_rollup"])
def g22_stream(spark, sf):
    """The earlier half of the records comes first, then the later one."""
    usage = _read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("source"), F.length("event_type").alias("total_tokens"))
    middle = usage.agg(F.avg(F.col("created_at").cast("double")).cast("timestamp").alias("t")).first()["t"]
    at = scratch_path(spark, "usage")
    for part in (usage.where(F.col("created_at") < middle), usage.where(F.col("created_at") >= middle)):
        part.write.mode("append").parquet(f"{at}/in")
        usage_stream(spark, f"{at}/in", f"{at}/table", f"{at}/progress").awaitTermination()
    return usage_totals(stored.read(spark, f"{at}/table")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ---------------------------------------------------------------- C, K, P

_LINES = "list_filter(string_split(text, chr(10)), lambda l: {})"


@query("C2_drop_header_footer", f"""WITH {DECO} SELECT doc_id, array_to_string({_LINES.format("NOT (regexp_matches(trim(l), '^[-—–]\\s*[0-9]+\\s*[-—–]$|^[0-9]+\\s*$|^第\\s*[0-9]+\\s*頁|^Page\\s+[0-9]+') OR regexp_matches(trim(l), '^(?i)(confidential|internal use)'))")}, chr(10)) AS text FROM deco""")
def c2(spark, sf):
    return X.decorated(spark, sf).select("doc_id", F.array_join(C.drop_header_footer(text_functions.lines(F.col("text"))), "\n").alias("text"))


@query("C3_drop_nav_bars", f"""WITH {DECO} SELECT doc_id, array_to_string({_LINES.format("NOT regexp_matches(trim(l), '^(Overview|治理|減碳|增綠|自然|共融|附錄)(\\s+(Overview|治理|減碳|增綠|自然|共融|附錄))+$')")}, chr(10)) AS text FROM deco""")
def c3(spark, sf):
    return X.decorated(spark, sf).select("doc_id", F.array_join(C.drop_nav_bars(text_functions.lines(F.col("text"))), "\n").alias("text"))


@query("C4_drop_garbled", f"""WITH {DECO} SELECT doc_id, array_to_string({_LINES.format("NOT contains(l, chr(65533) || chr(65533))")}, chr(10)) AS text FROM deco""")
def c4(spark, sf):
    return X.decorated(spark, sf).select("doc_id", F.array_join(C.drop_garbled(text_functions.lines(F.col("text"))), "\n").alias("text"))


#: Lines with their heading level; a line goes if a contents heading at or before it is not yet ended by a heading as high.
_CUT = f"""{DECO}, ll AS (SELECT doc_id, i, ls[i] AS l, length(regexp_extract(trim(ls[i]), '^(#{{1,6}})\\s+\\S', 1)) AS level FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM deco))),
toc AS (SELECT doc_id, i, level FROM ll WHERE level > 0 AND (contains(l, '目錄') OR contains(l, '目 錄') OR contains(l, 'Table of Contents') OR contains(l, 'CONTENTS') OR contains(l, 'contents'))),
span AS (SELECT t.doc_id, t.i AS a, coalesce(min(h.i), 1000000000) AS b FROM toc t LEFT JOIN ll h ON h.doc_id = t.doc_id AND h.i > t.i AND h.level BETWEEN 1 AND t.level GROUP BY t.doc_id, t.i, t.level),
cut AS (SELECT ll.doc_id, ll.i, CASE WHEN s.a IS NULL THEN ll.l END AS l FROM ll LEFT JOIN span s ON s.doc_id = ll.doc_id AND ll.i >= s.a AND ll.i < s.b)"""


@query("C1_remove_toc_sections", f"WITH {_CUT} SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS text FROM cut GROUP BY doc_id")
def c1(spark, sf):
    return X.decorated(spark, sf).select("doc_id", F.array_join(C.remove_toc_sections(text_functions.lines(F.col("text"))), "\n").alias("text"))


_TOC = "regexp_matches(trim(l), '^.{{2,60}}[.\\s·…]{{3,}}\\s*[0-9]{{1,4}}\\s*$|^.{{2,60}}\\s{{3,}}[0-9]{{1,4}}\\s*$|^[.\\s·…]{{5,}}$')"


@query("C5_drop_toc_lines", f"""WITH {DECO} SELECT doc_id, array_to_string({_LINES.format(f"NOT {_TOC.format()}")}, chr(10)) AS text FROM deco""")
def c5(spark, sf):
    return X.decorated(spark, sf).select("doc_id", F.array_join(C.drop_toc_lines(text_functions.lines(F.col("text"))), "\n").alias("text"))


@query("C6_normalize_headings", f"""WITH {DECO} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|\\n)\\*\\*\\s*((?:[0-9]+[.-][0-9]*\\s*|[一二三四五六七八九十]+、)\\s*[^\\n]+?)\\*\\*\\s*(\\n)', '\\1## \\2\\3', 'g'), '(^|\\n)\\*\\*([^*\\n]{{3,40}})\\*\\*\\s*(\\n)', '\\1### \\2\\3', 'g'), '(^|\\n)(#{{1,6}})([^\\s#])', '\\1\\2 \\3', 'g') AS text FROM deco""")
def c6(spark, sf):
    return X.decorated(spark, sf).select("doc_id", C.normalize_headings(F.col("text")).alias("text"))


@query("C7_squeeze_blank_lines", f"""WITH {DECO} SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\S\\n]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM deco""")
def c7(spark, sf):
    return X.decorated(spark, sf).select("doc_id", C.squeeze_blank_lines(F.col("text")).alias("text"))


_CLEAN = f"""{_CUT}, kept AS (SELECT doc_id, i, regexp_replace(l, '\\s+$', '') AS l FROM cut WHERE l IS NOT NULL AND NOT (regexp_matches(trim(l), '^[-—–]\\s*[0-9]+\\s*[-—–]$|^[0-9]+\\s*$|^第\\s*[0-9]+\\s*頁|^Page\\s+[0-9]+') OR regexp_matches(trim(l), '^(?i)(confidential|internal use)') OR {_TOC.format()}
  OR regexp_matches(trim(l), '^(Overview|治理|減碳|增綠|自然|共融|附錄)(\\s+(Overview|治理|減碳|增綠|自然|共融|附錄))+$') OR contains(l, chr(65533) || chr(65533)))),
bold AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) || chr(10) AS t FROM kept GROUP BY doc_id),
headed AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(^|\\n)\\*\\*\\s*((?:[0-9]+[.-][0-9]*\\s*|[一二三四五六七八九十]+、)\\s*[^\\n]+?)\\*\\*\\s*(\\n)', '\\1## \\2\\3', 'g'), '(^|\\n)\\*\\*([^*\\n]{{3,40}})\\*\\*\\s*(\\n)', '\\1### \\2\\3', 'g'), '(^|\\n)(#{{1,6}})([^\\s#])', '\\1\\2 \\3', 'g') AS t FROM bold),
clean AS (SELECT doc_id, trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM headed)"""


@query("C8_clean_markdown", f"WITH {_CLEAN} SELECT doc_id, text FROM clean")
def c8(spark, sf):
    return C.clean_markdown(X.decorated(spark, sf))


_TERMS = [("the", "THE"), ("of", "<of>"), ("and", "&"), ("licensed", "under licence"), ("la", "La$1"), ("der", "\\der"), ("email", "mail"), ("one", "1"), ("was", "be"), ("it", "thing")]


@query("C9_apply_terms")
def c9(spark, sf):
    return C.apply_terms(_read(spark, sf, "documents").select("doc_id", "text"), _TERMS)


#: Runs of ASCII letters are matched whole or not at all, and what replaces them holds no letters, so order doesn't matter.
@query("C9_term_table", """WITH dict AS (SELECT word AS term, '<' || min(item_id) || '>' AS full_name FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark) GROUP BY word),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+')) AS run, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), 1) AS pos FROM documents),
made AS (SELECT doc_id, pos, coalesce(full_name, run) AS run, term FROM runs LEFT JOIN dict ON term = lower(run)),
hit AS (SELECT doc_id, string_agg(term, '|' ORDER BY length(term) DESC, term) AS hits FROM (SELECT DISTINCT doc_id, term FROM made WHERE term IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, sha256(string_agg(run, '' ORDER BY pos)) AS text_sha, any_value(coalesce(hits, '')) AS hits FROM made LEFT JOIN hit USING (doc_id) GROUP BY doc_id""")
def c9_table(spark, sf):
    """A dictionary of all words of the test items."""
    words = _read(spark, sf, "benchmark").select("item_id", F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{2,}', 0)")).alias("term"))
    terms = words.groupBy("term").agg(F.concat(F.lit("<"), F.min("item_id").cast("string"), F.lit(">")).alias("full_name"))
    made = C.apply_terms(_read(spark, sf, "documents").select("doc_id", "text"), terms)
    return made.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.array_join("terms_applied", "|").alias("hits"))


@query("C10_split_by_budget")
def c10(spark, sf):
    return C.split_by_budget(X.decorated(spark, sf), 800)


_SECTIONS = f"""{DECO}, hl AS (SELECT doc_id, i, ls[i] AS l, regexp_matches(ls[i], '^#{{1,6}}\\s+.+$') AS h FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM deco))),
no AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM hl),
sec AS (SELECT doc_id, (s - 1)::INT AS pos, trim(regexp_extract(first(l ORDER BY i), '^#{{1,6}}\\s+(.+)$', 1)) AS title, length(regexp_extract(first(l ORDER BY i), '^(#+)', 1))::INT AS level, trim(string_agg(l, chr(10) ORDER BY i), ' ' || chr(10)) AS section_text FROM no GROUP BY doc_id, s)"""


@query("K1_split_by_heading", f"WITH {_SECTIONS} SELECT * FROM sec")
def k1(spark, sf):
    return K.split_by_heading(X.decorated(spark, sf))


@query("K2_merge_short_sections", f"""WITH {_SECTIONS}, g AS (SELECT *, sum((pos = 0 OR length(section_text) >= 50)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM sec)
SELECT doc_id, (g - 1)::INT AS pos, first(title ORDER BY pos) AS title, first(level ORDER BY pos) AS level, string_agg(section_text, chr(10) || chr(10) ORDER BY pos) AS section_text FROM g GROUP BY doc_id, g""")
def k2(spark, sf):
    return K.merge_short_sections(X.decorated(spark, sf))


@query("K3_split_long_sections")
def k3(spark, sf):
    cut = X.decorated(spark, sf).select("doc_id", K.merged_column(K.sections_column(F.col("text"))).alias("s")).select("doc_id", K.split_long_column(F.col("s"), 500).alias("s"))
    return cut.select("doc_id", F.posexplode_outer("s").alias("pos", "s")).select("doc_id", "pos", "s.title", "s.level", "s.text")


@query("K4_chunk")
def k4(spark, sf):
    return K.chunk(C.clean_markdown(X.decorated(spark, sf)).withColumnRenamed("doc_id", "document_id"))


@query("K5_chunk_parent_child")
def k5(spark, sf):
    return K.chunk_parent_child(C.clean_markdown(X.decorated(spark, sf)).withColumnRenamed("doc_id", "document_id"))


@query("K6_embed_targets", f"WITH {CHUNKS} SELECT id, chunk_type FROM chunks WHERE chunk_type IN ('child', 'standalone')")
def k6(spark, sf):
    return K.embed_targets(X.chunks(spark, sf)).select("id", "chunk_type")


_L = "l AS (SELECT doc_id, (i - 1)::INT AS line, trim(ls[i]) AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))


@query("P1_lines_to_markdown", f"""WITH {_L}, m AS (SELECT doc_id, line, CASE WHEN length(t || '!') > 200 THEN t || '!' WHEN line % 25 >= 20 THEN chr(10) || '# ' || t || '!' || chr(10) WHEN line % 25 >= 16 THEN chr(10) || '## ' || t || '!' || chr(10) WHEN line % 25 >= 13 AND line % 2 = 0 THEN chr(10) || '### ' || t || '!' || chr(10) ELSE t || '!' END AS t FROM l)
SELECT doc_id, '<!-- PAGE:1 -->' || chr(10) || string_agg(t, chr(10) ORDER BY line) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '| a' || doc_id || ' |' ELSE '' END || chr(10) || chr(10) || '<!-- PAGE:2 -->' AS markdown FROM m GROUP BY doc_id""")
def p1(spark, sf):
    font = F.when(F.col("line") % 2 == 0, "Sans-Bold").otherwise("Sans")
    ls = _lines(spark, sf).withColumn("t", F.trim("t"))
    span = lambda n, text: ls.select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("block"), "line", F.lit(n).alias("span"), text.alias("text"), (F.col("line") % 25).cast("double").alias("size"), font.alias("font"))
    blank = _read(spark, sf, "documents").select("doc_id", F.lit(2).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.lit(" ").alias("text"), F.lit(9.0).alias("size"), F.lit("Sans").alias("font"))
    tables = _read(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_no"), F.concat(F.lit("| a"), F.col("doc_id").cast("string"), F.lit(" |")).alias("markdown"))
    return P.lines_to_markdown(span(0, F.col("t")).unionByName(span(1, F.lit("!"))).unionByName(blank), tables)


@query("P2_rows_to_markdown_table", f"""WITH {_L}, r AS (SELECT doc_id, line, '| ' || line || ' | ' || length(t) || ' |' || CASE WHEN line = 0 THEN chr(10) || '| --- | ' || repeat('-', greatest(3, length(length(t)::VARCHAR))) || ' |' ELSE '' END AS t FROM l)
SELECT doc_id, 0 AS table_no, string_agg(t, chr(10) ORDER BY line) AS markdown FROM r GROUP BY doc_id""")
def p2(spark, sf):
    ls = _lines(spark, sf)
    cell = lambda n, text: ls.select("doc_id", F.lit(0).alias("table_no"), F.col("line").alias("row"), F.lit(n).alias("col"), text.cast("string").alias("text"))
    return P.rows_to_markdown_table(cell(0, F.concat(F.lit(" "), F.col("line").cast("string"), F.lit("\u3000 "))).unionByName(cell(1, F.length(F.trim("t")))))


@query("P3_route_pages", """WITH p AS (SELECT doc_id - doc_id % 4 AS d, doc_id % 4 AS page, length(trim(text, ' ' || chr(10))) >= 1000 AS rich, trim(text, ' ' || chr(10)) AS t, CASE WHEN doc_id % 3 = 0 THEN 'EMPTY_PAGE' ELSE 'seen ' || doc_id END AS v FROM documents)
SELECT d AS doc_id, coalesce(string_agg('<!-- PAGE:' || page || ' -->' || chr(10) || CASE WHEN rich THEN t ELSE v END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) FILTER (rich OR v <> 'EMPTY_PAGE'), '') AS markdown, count(*) FILTER (rich) AS text_pages, count(*) FILTER (NOT rich AND v <> 'EMPTY_PAGE') AS vision_pages, count(*) FILTER (NOT rich AND v = 'EMPTY_PAGE') AS skipped_pages FROM p GROUP BY d""")
def p3(spark, sf):
    """Pages with the texts of a vision engine as a column."""
    pages = _read(spark, sf, "documents").selectExpr("doc_id - doc_id % 4 AS doc_id", "doc_id % 4 AS page", "text", "CASE WHEN doc_id % 3 = 0 THEN 'EMPTY_PAGE' ELSE concat('seen ', doc_id) END AS vision_text")
    return P.route_pages(pages, threshold=1000)


def _reader() -> Callable[[bytes], str]:
    """Stands for a vision engine: images are their pages' texts here."""
    return lambda image: image.decode()


@query("P3_see_pages", ORACLE_SQL["P3_route_pages"])
def p3_see(spark, sf):
    """The same pages with images, which a vision engine is shown where a page's own text is short."""
    pages = _read(spark, sf, "documents").selectExpr("doc_id - doc_id % 4 AS doc_id", "doc_id % 4 AS page", "text", "encode(CASE WHEN doc_id % 3 = 0 THEN 'EMPTY_PAGE' ELSE concat('seen ', doc_id) END, 'utf-8') AS image")
    return P.route_pages(P.see_pages(pages, _reader, scratch_path(spark, "seen"), threshold=1000, parts=4), threshold=1000)


@query("P4_blocks_to_markdown", f"""WITH {_L} SELECT doc_id, string_agg(CASE WHEN line = 0 THEN '# n' || length(t) ELSE '**n' || length(t) || '**tail' END, chr(10) || chr(10) ORDER BY line) AS markdown FROM l GROUP BY doc_id""")
def p4(spark, sf):
    run = lambda text, bold: F.struct(text.alias("text"), F.lit(bold).alias("bold"), F.lit(False).alias("italic"))
    name = F.concat(F.lit("n"), F.length(F.trim("t")).cast("string"))
    head = F.col("line") == 0
    runs = F.when(head, F.array(run(name, True))).otherwise(F.array(run(name, True), run(F.lit("tail"), False)))
    blocks = _lines(spark, sf).select("doc_id", F.col("line").alias("pos"), F.lit("p").alias("kind"), F.when(head, "Heading 1").otherwise("Normal").alias("style"), runs.alias("runs"), F.lit(None).cast("string").alias("table_markdown"))
    return P.blocks_to_markdown(blocks)


@query("P5_split_pages", f"""WITH {DECO}, s AS (SELECT doc_id, strpos(text, '<!-- PAGE:') AS cut, text FROM deco) SELECT doc_id, 0 AS pos, CAST(NULL AS INT) AS page_no, CASE WHEN cut = 0 THEN text ELSE left(text, cut - 1) END AS page_text FROM s
UNION ALL SELECT doc_id, 1, regexp_extract(text, '<!-- PAGE:([0-9]+) -->', 1)::INT, substr(text, cut) FROM s WHERE cut > 0""")
def p5(spark, sf):
    return P.split_pages(X.decorated(spark, sf))


@query("P6_clean_by_page_batch")
def p6(spark, sf):
    return P.clean_by_page_batch(X.decorated(spark, sf))


@query("P7_apply_page_offset", f"WITH {CHUNKS} SELECT id, page_start + 3 AS page_start, page_end + 3 AS page_end FROM chunks")
def p7(spark, sf):
    return P.apply_page_offset(X.chunks(spark, sf), F.lit(3)).select("id", "metadata.page_start", "metadata.page_end")


# ---------------------------------------------------------------- E, R


@query("E1_embed")
def e1(spark, sf):
    texts = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_content"))
    return E.embed(texts, E.hashing_model).select("id", "embedding")


@query("E1_embed_stored")
def e1_stored(spark, sf):
    """Half of the documents first, then all: copies and what is stored are not sent again."""
    texts = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_content"))
    at = scratch_path(spark, "vectors")
    E.embed_stored(texts.where("id % 2 = 0"), E.hashing_model, at, parts=4)
    return E.embed_stored(texts, E.hashing_model, at, parts=4).select("id", "embedding")


@query("E2_attach_embeddings", "SELECT doc_id AS document_id, vec_id IS NOT NULL AS has, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT), '|') AS vector FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def e2(spark, sf):
    vectors = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    rows = _read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(None).cast("array<float>").alias("embedding"))
    return E.attach_embeddings(rows, vectors).select("document_id", F.col("embedding").isNotNull().alias("has"), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), "|").alias("vector"))


@query("R1_filter_documents", f"""WITH {DOCS} SELECT 'a' AS filter_set, id AS document_id FROM docs WHERE trim(language) = 'en' AND trim(fiscal_year) IN ('2019', '2021') UNION ALL SELECT 'b', id FROM docs WHERE trim("group") = 'g1' AND trim(category) IN ('網頁') UNION ALL SELECT 'c', id FROM docs""")
def r1(spark, sf):
    return R.filter_sets(X.documents(spark, sf), {"a": {"language": "en", "fiscal_years": ["2019", "2021"]}, "b": {"group": "g1", "categories": ["網頁"]}, "c": {}})


_RAW = "CASE doc_id % 5 WHEN 0 THEN '2022-2024' WHEN 1 THEN '2024-2022' WHEN 2 THEN 'a, b' WHEN 3 THEN ' ' ELSE '2024' END"


@query("R2_parse_filter_values", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2022|2023|2024' WHEN 2 THEN 'a|b' WHEN 4 THEN '2024' END AS vals FROM documents")
def r2(spark, sf):
    return _read(spark, sf, "documents").selectExpr("doc_id", f"{_RAW} AS raw").select("doc_id", F.array_join(text_functions.parse_filter_values(F.col("raw")), "|").alias("vals"))


@query("R3_cosine_similarity", "SELECT a.vec_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def r3(spark, sf):
    e = _read(spark, sf, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", F.round(R.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)"


@query("R4_vector_topk", f"WITH {CHUNKS} SELECT query_id, id, round(similarity, 6) AS similarity, r AS vec_rank FROM (SELECT *, {_RANKED}::INT AS r FROM sims WHERE similarity >= 0.3) WHERE r <= 5")
def r4(spark, sf):
    return R.vector_topk(X.chunks(spark, sf), X.vector_queries(spark, sf), 5, 0.3).withColumn("similarity", F.round("similarity", 6))


_R5 = f"""{CHUNKS}, pool AS (SELECT * FROM (SELECT *, {_RANKED} AS r FROM sims WHERE chunk_type IN ('child', 'standalone')) WHERE r <= 100 AND similarity >= 0.3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(parent_chunk_id, id) ORDER BY similarity DESC, id) AS b FROM pool) WHERE b = 1),
top AS (SELECT *, {_RANKED}::INT AS rank FROM best)"""


@query("R5_vector_search", f"WITH {_R5} SELECT query_id, top.id, round(similarity, 6) AS similarity, rank, length(coalesce(p.text_content, c.text_content)) AS n, coalesce(p.section_title, c.section_title) AS section_title FROM top JOIN chunks c ON c.id = top.id LEFT JOIN chunks p ON p.id = top.parent_chunk_id WHERE rank <= 5")
def r5(spark, sf):
    hits = R.vector_search(X.chunks(spark, sf), X.parents(spark, sf), X.vector_queries(spark, sf), 5, 0.3)
    return hits.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank", F.length("text_content").cast("long").alias("n"), "metadata.section_title")


_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_MATCH = f"m AS (SELECT item_id AS query_id, doc_id AS id FROM (SELECT item_id, list_distinct({_WORDS.format('text')}) AS q FROM benchmark) JOIN (SELECT doc_id, list_distinct({_WORDS.format('text')}) AS w FROM documents WHERE doc_id % 4 <> 0) ON list_has_all(w, q))"


@query("R5_filters_of_each_query", f"""WITH {DOCS}, {CHUNKS}, {X.WITH_FILTERS}, s AS (SELECT sims.* FROM sims JOIN docs d ON d.id = sims.document_id JOIN asked q ON q.query_id = sims.query_id WHERE chunk_type IN ('child', 'standalone') AND {X.ALLOWED}),
pool AS (SELECT * FROM (SELECT *, {_RANKED} AS r FROM s) WHERE r <= 100 AND similarity >= 0.1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(parent_chunk_id, id) ORDER BY similarity DESC, id) AS b FROM pool) WHERE b = 1)
SELECT query_id, best.id, rank, status, publish_date::VARCHAR AS publish_date, array_to_string(tags, '|') AS tags FROM (SELECT *, {_RANKED}::INT AS rank FROM best) best JOIN docs ON docs.id = document_id WHERE rank <= 5""")
def r5_filtered(spark, sf):
    hits = R.vector_search(X.chunks(spark, sf), X.parents(spark, sf), X.filtered(X.vector_queries(spark, sf)), 5, 0.1)
    return hits.select("query_id", "id", "rank", "status", F.col("publish_date").cast("string").alias("publish_date"), F.array_join("tags", "|").alias("tags"))


#: Cover density of the matches: at each occurrence of a word of the query, the shortest span that ends there begins at the
#: least of all words' latest places; each beginning counts once, by its first end.
_RANK = f"""{_MATCH}, tok AS (SELECT doc_id AS id, i AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IN (SELECT id FROM m)))),
qw AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format('text')})) AS word FROM benchmark),
occ AS (SELECT m.query_id, m.id, tok.pos, tok.word FROM m JOIN tok ON tok.id = m.id JOIN qw ON qw.query_id = m.query_id AND qw.word = tok.word),
last AS (SELECT o.query_id, o.id, o.pos, qw.word, max(CASE WHEN o.word = qw.word THEN o.pos END) OVER (PARTITION BY o.query_id, o.id, qw.word ORDER BY o.pos) AS latest FROM occ o JOIN qw ON qw.query_id = o.query_id),
spans AS (SELECT query_id, id, pos, min(latest) AS a FROM last GROUP BY query_id, id, pos HAVING count(latest) = count(*)),
dense AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (b - a + 1)), 9) AS rank_cd FROM (SELECT query_id, id, a, min(pos) AS b FROM spans GROUP BY query_id, id, a) GROUP BY query_id, id),
fts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_cd DESC, id)::INT AS fts_rank FROM dense)"""


@query("R6_fts_match", f"WITH {_RANK} SELECT query_id, id, round(rank_cd, 6) AS rank_cd FROM dense")
def r6(spark, sf):
    return R.fts_match(X.texts(spark, sf), X.text_queries(spark, sf), X.parents(spark, sf)).select("query_id", "id", F.round("rank_cd", 6).alias("rank_cd"))


@query("R7_fts_topk", f"WITH {_RANK} SELECT query_id, id, round(rank_cd, 6) AS rank_cd, fts_rank FROM fts WHERE fts_rank <= 100")
def r7(spark, sf):
    return R.fts_topk(X.texts(spark, sf), X.parents(spark, sf), X.text_queries(spark, sf), 100).withColumn("rank_cd", F.round("rank_cd", 6))


@query("R8_rrf_fuse", f"""WITH {CHUNKS}, {_RANK}, v AS (SELECT query_id, id, r FROM (SELECT query_id, id, {_RANKED} AS r FROM sims) WHERE r <= 20), f AS (SELECT query_id, id, fts_rank AS r FROM fts WHERE fts_rank <= 20)
SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.id, f.id) AS id, round(coalesce(1.0 / (60 + v.r), 0) + coalesce(1.0 / (60 + f.r), 0), 6)::DOUBLE AS rrf_score FROM v FULL JOIN f ON v.query_id = f.query_id AND v.id = f.id""")
def r8(spark, sf):
    vec = R.vector_pool(X.chunks(spark, sf), X.vector_queries(spark, sf), 20).select("query_id", "id", "vec_rank")
    fts = R.fts_topk(X.texts(spark, sf), X.parents(spark, sf), X.text_queries(spark, sf), 20).select("query_id", "id", "fts_rank")
    return R.rrf_fuse(vec, fts).select("query_id", "id", F.round("rrf_score", 6).alias("rrf_score"))


#: Both sides of fused search: n best by vector among s, n best by text among the matches of the query's item.
_BOTH = f"""{CHUNKS}, {_RANK}, item AS (SELECT query_id, query_id // 20 % (SELECT count(*) FROM benchmark) AS item FROM queries)"""


@query("R9_hybrid_search", f"""WITH {DOCS}, {_BOTH}, {X.WITH_FILTERS}, s AS (SELECT sims.* FROM sims JOIN docs d ON d.id = sims.document_id JOIN asked q ON q.query_id = sims.query_id WHERE chunk_type IN ('child', 'standalone') AND {X.ALLOWED}),
v AS (SELECT query_id, id, r FROM (SELECT *, {_RANKED} AS r FROM s) WHERE r <= 100),
ff AS (SELECT item.query_id, dense.id, rank_cd FROM item JOIN dense ON dense.query_id = item.item JOIN chunks c ON c.id = dense.id JOIN docs d ON d.id = c.document_id JOIN asked q ON q.query_id = item.query_id WHERE {X.ALLOWED}),
f AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank_cd DESC, id) AS r FROM ff) WHERE r <= 100),
u AS (SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.id, f.id) AS id, coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + f.r), 0) AS similarity FROM v FULL JOIN f ON v.query_id = f.query_id AND v.id = f.id),
b AS (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY query_id, coalesce(parent_chunk_id, u.id) ORDER BY similarity DESC, u.id) AS n FROM u JOIN chunks ON chunks.id = u.id) WHERE n = 1)
SELECT * FROM (SELECT query_id, id, {_RANKED}::INT AS rank, round(similarity, 6) AS similarity, 'hybrid' AS search_type FROM b) WHERE rank <= 5""")
def r9(spark, sf):
    hits = R.hybrid_search(X.chunks(spark, sf), X.parents(spark, sf), X.filtered(X.mixed_queries(spark, sf)), 5, X.texts(spark, sf))
    return hits.select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"), "search_type")


@query("R10_hybrid_search_labeled", f"""WITH {_BOTH}, v AS (SELECT query_id, id, similarity, r FROM (SELECT *, {_RANKED} AS r FROM sims WHERE chunk_type IN ('child', 'standalone') AND similarity >= 0.3) WHERE r <= 10),
f AS (SELECT item.query_id, fts.id, fts_rank AS r FROM item JOIN fts ON fts.query_id = item.item WHERE fts_rank <= 10),
u AS (SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.id, f.id) AS id, coalesce(v.similarity, 0) AS similarity, coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + f.r), 0) AS rrf_score,
  CASE WHEN v.r IS NOT NULL AND f.r IS NOT NULL THEN 'hybrid' WHEN v.r IS NOT NULL THEN 'vector' ELSE 'fulltext' END AS search_type FROM v FULL JOIN f ON v.query_id = f.query_id AND v.id = f.id)
SELECT query_id, id, round(similarity, 6) AS similarity, round(rrf_score, 6) AS rrf_score, search_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id)::INT AS rank FROM u) WHERE rank <= 5""")
def r10(spark, sf):
    hits = R.hybrid_search_labeled(X.chunks(spark, sf), X.parents(spark, sf), X.mixed_queries(spark, sf), 5, 0.3, X.texts(spark, sf))
    return hits.withColumns({"similarity": F.round("similarity", 6), "rrf_score": F.round("rrf_score", 6)})


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    c, q = X.chunks(spark, sf), X.vector_queries(spark, sf)
    one, two = R.vector_topk(c, q, 5, 0.3), R.vector_topk(c, q, 8, 0.2)
    rows = one.withColumn("variant", F.lit(0)).unionByName(two.withColumn("variant", F.lit(1)))
    return rows.withColumnRenamed("vec_rank", "rank")


@query("R11_multi_query", f"""WITH {CHUNKS}, u AS (SELECT query_id, id, 0 AS variant, r AS rank FROM (SELECT *, {_RANKED}::INT AS r FROM sims WHERE similarity >= 0.3) WHERE r <= 5
UNION ALL SELECT query_id, id, 1, r FROM (SELECT *, {_RANKED}::INT AS r FROM sims WHERE similarity >= 0.2) WHERE r <= 8)
SELECT query_id, id, variant, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY variant, rank) AS n FROM u) WHERE n = 1""")
def r11(spark, sf):
    return R.multi_query(_variants(spark, sf)).select("query_id", "id", "variant", "rank")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return R.vector_search(X.chunks(spark, sf), X.parents(spark, sf), X.vector_queries(spark, sf), 5, 0.3)


@query("R12_rerank_scores", f"""WITH {DOCS}, {_R5}, t AS (SELECT query_id, top.id, list_contains(string_split_regex(left(concat_ws(chr(10), display_name, p.text_content), 1024), '\\s+'), p.section_title) AS hit FROM top JOIN chunks p ON p.id = top.parent_chunk_id JOIN docs ON docs.id = top.document_id WHERE rank <= 5),
s AS (SELECT query_id, id, round(1 / (1 + exp(CASE WHEN hit THEN -2.0::DOUBLE ELSE 2.0 END)), 6) AS similarity FROM t)
SELECT * FROM (SELECT query_id, id, {_RANKED}::INT AS rank, similarity FROM s) WHERE rank <= 3""")
def r12(spark, sf):
    results = _results(spark, sf).withColumn("query_text", F.col("metadata.section_title"))
    return S.rerank_scores(results.drop("rank"), S.overlap_scorer, 3).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("R13_rerank_by_order", f"""WITH {_R5}, t AS (SELECT query_id, id, rank FROM top WHERE rank <= 5), o(pos, rank) AS (VALUES (0, 3), (1, 1), (2, 9), (3, 3)),
u AS (SELECT query_id, id, t.rank, 0 AS a, pos AS b FROM t JOIN o ON o.rank = t.rank UNION ALL SELECT query_id, id, rank, 1, rank FROM t WHERE rank NOT IN (SELECT rank FROM o))
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY a, b)::INT AS new_rank FROM u) WHERE new_rank <= 4""")
def r13(spark, sf):
    orders = X.vector_queries(spark, sf).select("query_id", F.array(*map(F.lit, (3, 1, 9, 3))).alias("order"))
    return S.rerank_by_order(_results(spark, sf).select("query_id", "id", "rank"), orders, 4).select("query_id", "id", "new_rank")


_YEAR = "CASE WHEN y < 1911 THEN y + 1911 ELSE y END"


@query("R14_multi_factor_score", f"""WITH {DOCS}, {_R5}, t AS (SELECT query_id, top.id, similarity, category, source_type, {_YEAR} AS y FROM top JOIN (SELECT id AS d, category, source_type, nullif(regexp_extract(fiscal_year, '([0-9]{{3,4}})', 1), '')::INT AS y FROM docs) ON d = document_id WHERE rank <= 5),
a AS (SELECT *, least(max(y) OVER (PARTITION BY query_id), 2026) AS n FROM t)
SELECT query_id, id, round(similarity * 0.6 + (CASE WHEN y IS NULL THEN 0.85 ELSE greatest(0, 1 - greatest(0, n - y) * 0.25) END) * 0.25 + (CASE category WHEN '永續報告書' THEN 1.0 WHEN '網頁' THEN 0.9 WHEN '年度報告' THEN 0.75 ELSE 0.6 END) * 0.15, 6) AS adjusted_score FROM a""")
def r14(spark, sf):
    return S.multi_factor_score(_results(spark, sf), 2026).select("query_id", "id", F.round("adjusted_score", 6).alias("adjusted_score"))


@query("R15_fiscal_year_int", f"WITH {DOCS} SELECT id, {_YEAR} AS year FROM (SELECT id, nullif(regexp_extract(fiscal_year, '([0-9]{{3,4}})', 1), '')::INT AS y FROM docs)")
def r15(spark, sf):
    return X.documents(spark, sf).select("id", text_functions.fiscal_year_int(F.col("fiscal_year")).alias("year"))


@query("R16_neighbour_context", f"""WITH {CHUNKS} SELECT h.id AS query_id, c.id, CASE WHEN c.chunk_index < h.chunk_index THEN 'previous' WHEN c.chunk_index > h.chunk_index THEN 'next' ELSE 'current' END AS place
FROM chunks h JOIN chunks c ON c.document_id = h.document_id AND abs(c.chunk_index - h.chunk_index) <= 1""")
def r16(spark, sf):
    c = X.chunks(spark, sf)
    return S.neighbour_context(c.select(F.col("id").alias("query_id"), "document_id", "chunk_index"), c).select("query_id", "id", "place")


@query("R17_project_results", f"WITH {DOCS}, {_R5} SELECT query_id, top.id, p.section_title, p.page_start, count(*) OVER (PARTITION BY query_id) AS total, publish_date::VARCHAR AS publish_date, status FROM top JOIN chunks p ON p.id = top.parent_chunk_id JOIN docs ON docs.id = top.document_id WHERE rank <= 5")
def r17(spark, sf):
    return S.project_results(_results(spark, sf)).select("query_id", "id", "section_title", "page_start", "total", "publish_date", "status")


# ---------------------------------------------------------------- A


_A1 = f"""{DOCS}, {_R5}, t AS (SELECT query_id, rank AS index, coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, file_name) AS name, p.page_start AS a, p.page_end AS b, p.section_title, p.text_content
FROM top JOIN chunks p ON p.id = top.parent_chunk_id JOIN docs ON docs.id = top.document_id WHERE rank <= 5),
cited AS (SELECT *, (CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END) || (CASE WHEN a <> 0 THEN ' p.' || a ELSE '' END) AS label,
CASE WHEN a <> 0 THEN '（第' || a || (CASE WHEN b <> 0 AND b <> a THEN '-' || b ELSE '' END) || '頁）' ELSE '' END AS page_text FROM t)"""


@query("A1_citations", f"WITH {_A1} SELECT query_id, index, name AS document_name, label, page_text FROM cited")
def a1(spark, sf):
    return A.citations(_results(spark, sf)).select("query_id", "index", "document_name", "label", "page_text")


@query("A2_build_context", f"WITH {_A1} SELECT query_id, string_agg('[' || label || '] 文件：' || name || ' ' || page_text || chr(10) || '章節：' || section_title || chr(10) || '內容：' || chr(10) || text_content || chr(10), chr(10) || '---' || chr(10) ORDER BY index) AS context FROM cited GROUP BY query_id")
def a2(spark, sf):
    return A.build_context(_results(spark, sf))


@query("A3_recent_history", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def a3(spark, sf):
    return A.recent_history(_read(spark, sf, "conversations")).select("conv_id", "turn", "role")


_LAST = "past AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || ':' || text, '|' ORDER BY turn) AS past FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id)"
_CONTEXT = "ctx AS (SELECT query_id, string_agg('[' || label || '] 文件：' || name || ' ' || page_text || chr(10) || '章節：' || section_title || chr(10) || '內容：' || chr(10) || text_content || chr(10), chr(10) || '---' || chr(10) ORDER BY index) AS context FROM cited GROUP BY query_id)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("A4_build_prompt", f"""WITH {_A1}, {_CONTEXT}, {_LAST}, c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
q AS (SELECT query_id, c.conv_id FROM queries JOIN c ON k = query_id // 20 % (SELECT count(*) FROM c))
SELECT q.query_id, q.conv_id, CASE WHEN context IS NULL THEN {_quoted(A.REFUSAL)} END AS answer,
CASE WHEN context IS NULL THEN '' ELSE concat_ws('|', 'user:' || {_quoted(A.TODAY[0])} || '2026年01月01日' || {_quoted(A.TODAY[1])} || 'system', 'model:' || {_quoted(A.ACKNOWLEDGE)}, past, 'user:' || {_quoted(A.ASK[0])} || context || {_quoted(A.ASK[1])} || 'q' || q.query_id || {_quoted(A.ASK[2])}) END AS said
FROM q LEFT JOIN ctx ON ctx.query_id = q.query_id LEFT JOIN past ON past.conv_id = q.conv_id""")
def a4(spark, sf):
    """Each question goes to a conversation; conversations are gone through in turn."""
    turns = _read(spark, sf, "conversations")
    ids = numbered(turns.select("conv_id").distinct(), [], [F.col("conv_id")], "k").withColumn("k", F.col("k") - 1)
    n = ids.agg(F.count(F.lit(1)).alias("n"))
    questions = X.vector_queries(spark, sf).join(F.broadcast(n)).select("query_id", ((F.col("query_id") / 20).cast("long") % F.col("n")).alias("k"), F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question"))  # one row
    made = A.build_prompt(questions.join(ids, "k").drop("k"), A.build_context(_results(spark, sf)), A.recent_history(turns), "system", "2026年01月01日")
    said = F.coalesce("messages", F.array().cast("array<struct<role:string,text:string>>"))
    return made.select("query_id", "conv_id", "answer", F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|").alias("said"))


_ASK = "concat(CASE doc_id % 3 WHEN 0 THEN 'c1 and c2 ' WHEN 1 THEN 'c1 ' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN '2023 ' WHEN 1 THEN '113年 2023 ' ELSE '' END, CASE doc_id % 40 WHEN 0 THEN '比較' WHEN 1 THEN '差異' WHEN 2 THEN '差別' WHEN 3 THEN '不同' WHEN 4 THEN '對比' WHEN 5 THEN '相比' WHEN 6 THEN '優於' WHEN 7 THEN '落後' WHEN 8 THEN '領先' WHEN 9 THEN '變化' WHEN 10 THEN '趨勢' WHEN 11 THEN '成長' WHEN 12 THEN 'x vs y' WHEN 13 THEN 'x VS y' WHEN 14 THEN '勝過' WHEN 15 THEN '超越' WHEN 16 THEN '比起' WHEN 17 THEN 'Vs' ELSE '' END)"


@query("A5_detect_comparison", """SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 4 <> 1 AND doc_id % 40 < 16) THEN 'company' WHEN doc_id % 4 = 1 THEN 'fiscal_year' END AS dimension,
CASE WHEN doc_id % 3 = 0 THEN 'c1|c2' WHEN doc_id % 3 = 1 AND doc_id % 4 <> 1 AND doc_id % 40 < 16 THEN 'c1' WHEN doc_id % 4 = 1 THEN '2023|2024' END AS vals FROM documents""")
def a5(spark, sf):
    asked = _read(spark, sf, "documents").selectExpr("doc_id AS query_id", f"{_ASK} AS question")
    names = X.documents(spark, sf).where("company IN ('c1', 'c2')").select("company").unionByName(X.documents(spark, sf).where("company = 'c1'").select(F.lit("c11").alias("company")))
    return A.detect_comparison(asked, names.distinct()).select("query_id", "dimension", F.array_join("values", "|").alias("vals"))


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for g in ("g0", "g2"):
        docs = R.filter_documents(X.parents(spark, sf), group=g)
        part = R.vector_search(X.chunks(spark, sf), docs, X.vector_queries(spark, sf), 3, 0.1).withColumn("group_label", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return A.compare_search(out.drop("rank"), 3)


_A6 = f"""{DOCS}, {CHUNKS}, s AS (SELECT sims.*, "group" AS group_label FROM sims JOIN docs ON docs.id = document_id WHERE trim("group") IN ('g0', 'g2') AND chunk_type = 'child'),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_label ORDER BY similarity DESC, id) AS r FROM s) WHERE r <= 60 AND similarity >= 0.1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_chunk_id ORDER BY similarity DESC, id) AS b FROM pool) WHERE b = 1),
three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, group_label ORDER BY similarity DESC, id) AS g FROM best) WHERE g <= 3),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, group_label, id)::INT AS rank FROM three)"""


@query("A6_compare_search", f"WITH {_A6} SELECT query_id, group_label, id, rank, round(similarity, 6) AS similarity FROM merged")
def a6(spark, sf):
    return _grouped(spark, sf).select("query_id", "group_label", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("A7_compare_context", f"""WITH {_A6}, t AS (SELECT query_id, rank, group_label, coalesce(CASE WHEN trim(display_name) <> '' THEN display_name END, file_name) AS name, p.page_start AS a, p.page_end AS b, p.section_title, p.text_content
FROM merged m JOIN chunks p ON p.id = m.parent_chunk_id JOIN docs ON docs.id = m.document_id)
SELECT query_id, string_agg('[來源' || rank || '] 【' || group_label || '】文件：' || name || CASE WHEN a <> 0 THEN ' （第' || a || (CASE WHEN b <> 0 AND b <> a THEN '-' || b ELSE '' END) || '頁）' ELSE '' END || chr(10) || '章節：' || section_title || chr(10) || '內容：' || text_content || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id""")
def a7(spark, sf):
    return A.compare_context(_grouped(spark, sf))


@query("A8_usage_records", "SELECT doc_id, greatest(1, length(text) // 2)::INT AS output_tokens, coalesce(CASE WHEN doc_id % 2 = 0 THEN 7 END, (n_chars // 3))::INT AS input_tokens, (greatest(1, length(text) // 2) + coalesce(CASE WHEN doc_id % 2 = 0 THEN 7 END, n_chars // 3))::INT AS total_tokens, left(text, 500) AS question FROM documents")
def a8(spark, sf):
    rows = _read(spark, sf, "documents").select("doc_id", F.col("text").alias("question"), F.col("text").alias("answer"), F.col("n_chars").alias("messages_chars"), F.when(F.col("doc_id") % 2 == 0, 7).alias("input_tokens"))
    return A.usage_records(rows).select("doc_id", "question", "input_tokens", "output_tokens", "total_tokens")


# ---------------------------------------------------------------- W


@query("W1_extract_links", """SELECT page_id, (i - 1)::INT AS pos, hrefs[i] AS href FROM (SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages))
WHERE NOT regexp_matches(lower(trim(hrefs[i])), '^(javascript:|mailto:|tel:|#)')""")
def w1(spark, sf):
    return WEB.extract_links(_read(spark, sf, "pages")).select("page_id", "pos", "href")


_HREFS = "SELECT page_id, url, (i - 1)::INT AS pos, hrefs[i] AS href FROM (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS hrefs FROM pages))"


@query("W2_normalize_url", f"""SELECT page_id, pos, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_replace(href, '(.)/+$', '\\1') AS link FROM ({_HREFS}) WHERE href LIKE '/%'""")
def w2(spark, sf):
    return WEB.extract_links(_read(spark, sf, "pages")).select("page_id", "pos", WEB.normalize_url(F.col("href"), F.col("url")).alias("link"))


@query("W3_should_skip", "SELECT page_id, regexp_matches(u, '1$') OR regexp_matches(lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.(pdf|docx?|xlsx?|pptx?|zip|rar|gz|tar|jpe?g|png|gif|svg|ico|webp|mp3|mp4|avi|mov|wmv|css|js|xml|json|rss|atom)$') AS skip FROM (SELECT page_id, url || CASE page_id % 12 WHEN 0 THEN '/a.7z' WHEN 1 THEN '/A.GZ' WHEN 2 THEN '/b.tar' WHEN 3 THEN '/c.wmv' WHEN 4 THEN '/d.rss' WHEN 5 THEN '/e.atom' WHEN 6 THEN '/f.woff' WHEN 7 THEN '/g.jpeg' ELSE '' END AS u FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS url FROM pages))")
def w3(spark, sf):
    ends = F.expr("CASE page_id % 12 WHEN 0 THEN '/a.7z' WHEN 1 THEN '/A.GZ' WHEN 2 THEN '/b.tar' WHEN 3 THEN '/c.wmv' WHEN 4 THEN '/d.rss' WHEN 5 THEN '/e.atom' WHEN 6 THEN '/f.woff' WHEN 7 THEN '/g.jpeg' ELSE '' END")
    url = F.concat(F.regexp_extract("url", r"^[^?#]*", 0), ends)
    return _read(spark, sf, "pages").select("page_id", WEB.should_skip(url, F.try_parse_url(url, F.lit("AUTHORITY")), ["1$"]).alias("skip"))


def _crawl_sql(depth: int, most: int) -> str:
    return f"""WITH RECURSIVE h AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY host) AS n FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)),
e AS (SELECT a.page_id AS a, b.page_id AS b FROM h a JOIN h b ON a.host = b.host AND (b.k = (3 * a.k + 1) % a.n OR b.k = (3 * a.k + 2) % a.n)),
u AS (SELECT page_id, 'https://' || host || '/p' || page_id AS url FROM h),
r AS (SELECT page_id AS root, page_id AS p, 0 AS depth, '' AS way FROM pages WHERE page_id % 20 = 0 UNION ALL SELECT root, b, depth + 1, way || '.' || lpad(b::VARCHAR, 12, '0') FROM r JOIN e ON a = p WHERE depth < {depth}),
f AS (SELECT root, p, depth, min(way) AS way FROM (SELECT *, min(depth) OVER (PARTITION BY root, p) AS d FROM r) WHERE depth = d GROUP BY root, p, depth),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, way) AS position FROM f)
SELECT ru.url AS root, pu.url AS url, depth::INT AS depth, position FROM o JOIN u ru ON ru.page_id = root JOIN u pu ON pu.page_id = p WHERE position <= {most}"""


#: The whole table as one site, so that a crawl inside its host may go from any page to any other.
_SITE = "site.example"


@query("W4_crawl_reachable", f"""WITH RECURSIVE h AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k, count(*) OVER () AS n FROM pages),
e AS (SELECT a.page_id AS a, b.page_id AS b FROM h a JOIN h b ON b.k = (3 * a.k + 1) % a.n UNION SELECT a.page_id, b.page_id FROM h a JOIN h b ON b.k = (3 * a.k + 2) % a.n),
u AS (SELECT page_id, 'https://{_SITE}/p' || page_id AS url FROM h),
r AS (SELECT page_id AS root, page_id AS p, 0 AS depth, '' AS way FROM pages WHERE page_id % 20 = 0 UNION ALL SELECT root, b, depth + 1, way || '.' || lpad(b::VARCHAR, 12, '0') FROM r JOIN e ON a = p WHERE depth < 5),
f AS (SELECT root, p, depth, min(way) AS way FROM (SELECT *, min(depth) OVER (PARTITION BY root, p) AS d FROM r) WHERE depth = d GROUP BY root, p, depth),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, way) AS position FROM f)
SELECT ru.url AS root, pu.url AS url, depth::INT AS depth, position FROM o JOIN u ru ON ru.page_id = root JOIN u pu ON pu.page_id = p""")
def w4(spark, sf):
    """Crawls from every page whose id is divisible by 20 over the links that W1 to W3 read from the pages' HTML, all pages
    being one site; every page within depth 5 is found, without a budget."""
    links, urls, roots = _linked(spark, sf, _SITE)
    return WEB.crawl_reachable(urls, links, roots, 5, None)


def _linked(spark: SparkSession, sf: str, site: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links, pages and roots. Each page's HTML gets links to two stored pages of its host (with `site`, all pages are on that one),
    as stored links lead to none, and one to another host, which a crawl of its own host doesn't follow; some stored URLs are
    variants of one address, so pages are told apart by number under their hosts."""
    host = (F.lit(site) if site else F.try_parse_url("url", F.lit("AUTHORITY"))).alias("host")
    pages = numbered(_read(spark, sf, "pages").select("page_id", host, "html"), ["host"], [F.col("page_id")], "k").withColumn("k", F.col("k") - 1)
    pages = pages.withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/p"), F.col("page_id").cast("string"), F.lit("/#top")))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    goes = pages.join(sizes, "host").select("page_id", "host", F.explode(F.array((3 * F.col("k") + 1) % F.col("n"), (3 * F.col("k") + 2) % F.col("n"))).alias("k"))
    added = goes.join(pages.select("host", "k", F.col("page_id").alias("to"), F.col("url").alias("target")), ["host", "k"])
    added = added.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("to", "target"))), lambda x: F.concat(F.lit('<a href="'), x["target"], F.lit('">next</a>'))), "").alias("added"))  # two links
    linked = pages.join(added, "page_id", "left").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit('<a href="//elsewhere.example/p0">out</a>'), F.coalesce("added", F.lit(""))))
    links = written(WEB.page_links(linked), "links")
    url = WEB.normalize_url(F.col("url"))
    return links, pages.select(url.alias("url")).unionByName(spark.range(1).select(F.lit("https://elsewhere.example/p0").alias("url"))), pages.where("page_id % 20 = 0").select(url.alias("root")).distinct()


@query("W4_crawl_many_roots", _crawl_sql(7, 200))
def w4_many(spark, sf):
    """The same crawl to depth 7 under the default budget, which that depth can reach."""
    links, urls, roots = _linked(spark, sf)
    return WEB.crawl_reachable(urls, links, roots, 7)


@query("W5_page_meta", """SELECT page_id, CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) END AS title,
CASE WHEN l = '' THEN 'zh-TW' WHEN lower(l) LIKE 'en%' THEN 'en' WHEN lower(l) LIKE 'ja%' THEN 'ja' WHEN lower(l) LIKE 'zh%' THEN CASE WHEN lower(l) LIKE '%tw%' OR lower(l) LIKE '%hant%' THEN 'zh-TW' ELSE 'zh-CN' END ELSE l END AS language
FROM (SELECT *, regexp_extract(html, '(?is)<html[^>]*\\slang\\s*=\\s*["'']([^"'']*)["'']', 1) AS l FROM pages)""")
def w5(spark, sf):
    return WEB.page_meta(_read(spark, sf, "pages")).select("page_id", "title", "language")


@query("W6_main_content")
def w6(spark, sf):
    return WEB.main_content(_read(spark, sf, "pages"))


@query("W7_html_to_markdown")
def w7(spark, sf):
    return WEB.html_to_markdown(_read(spark, sf, "pages"))
