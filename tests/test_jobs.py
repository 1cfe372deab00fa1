"""Sources, streaming and search behaviour that SQL does not say."""

from __future__ import annotations

import json

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from docloom.operators import answers, scoring, search
from docloom.operators.catalog import read_config
from docloom.plans import derived
from docloom.sources import tables
from docloom.streaming.ingest import incremental_ingest


def test_source_files_and_sitemap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"x")
    (tmp_path / "in/b.txt").write_bytes(b"y")
    taken, rejected = tables.read_source_files(spark, str(tmp_path / "in"))
    assert [(r["file_name"], r["source_type"]) for r in taken.collect()] == [("a.PDF", "pdf")]
    assert [r["file_name"] for r in rejected.collect()] == ["b.txt"]
    (tmp_path / "map.xml").write_text("<urlset><url><loc> https://a/1 </loc></url><url><loc>https://a/skip/2</loc></url><url><loc>https://a/3</loc></url></urlset>")
    got = tables.read_sitemap(spark, str(tmp_path / "map.xml"), ["skip"], 5)
    assert [r["loc"] for r in got.orderBy("pos").collect()] == ["https://a/1", "https://a/3"]


def test_manifest(spark, tmp_path):
    m = {"defaults": {"language": "en", "group": "g"}, "targets": [{"type": "pdf_list", "category": "c", "files": ["a", "b"], "group": "h"}, {"type": "sitemap", "category": "d", "url": "u"}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    rows = tables.expand_manifest(tables.read_manifest(spark, str(tmp_path / "m.json"))).orderBy("target_no", "item_no").collect()
    assert [(r["item"], r["group"], r["language"], r["chunk_strategy"]) for r in rows] == [("a", "h", "en", "parent_child"), ("b", "h", "en", "parent_child"), ("u", "g", "en", "parent_child")]


def test_kb_round_trip(spark, tmp_path):
    docs = derived.documents(spark, SF).drop("text")
    tables.write_documents(docs, str(tmp_path / "documents"))
    assert spark.read.parquet(str(tmp_path / "documents")).count() == docs.count()


def test_streaming_twice_is_once(spark, tmp_path):
    source, kb = tmp_path / "src", tmp_path / "kb"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("f").alias("file_name"), "text")
    docs.where("id % 2 = 0").write.mode("append").parquet(str(source))
    incremental_ingest(spark, str(source), str(kb), str(tmp_path / "cp")).awaitTermination()
    docs.write.mode("append").parquet(str(source))
    incremental_ingest(spark, str(source), str(kb), str(tmp_path / "cp")).awaitTermination()
    incremental_ingest(spark, str(source), str(kb), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(kb / "documents"))
    assert stored.count() == stored.select("file_hash").distinct().count() == docs.select("text").distinct().count()


def test_vector_pool_is_exact_whatever_the_partitions(spark):
    c, q = derived.chunks(spark, SF), derived.vector_queries(spark, SF)
    rows = [(r["id"], r["embedding"]) for r in c.where("embedding IS NOT NULL").select("id", "embedding").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for parts in (1, 7):
        got = search.vector_pool(c.repartition(parts), q, 3).collect()
        for r in q.collect():
            v = np.array(r["query_embedding"], float)
            s = np.round(x @ (v / np.linalg.norm(v)), 12)
            want = [int(ids[i]) for i in np.lexsort((ids, -s))[:3]]
            assert [g["id"] for g in sorted((g for g in got if g["query_id"] == r["query_id"]), key=lambda g: g["vec_rank"])] == want


def test_hybrid_finds_what_text_finds(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "solar power plant", [1.0, 0.0], "standalone", None), (2, 2, 0, "wind power", [0.0, 1.0], "standalone", None), (3, 3, 0, "solar farm", None, "standalone", None)], "id long, document_id long, chunk_index int, text_content string, embedding array<float>, chunk_type string, parent_chunk_id long").withColumn("metadata", F.lit(None).cast("struct<section_title:string,page_start:int,page_end:int>"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, file_name string")
    q = spark.createDataFrame([(9, "solar", [0.0, 1.0])], "query_id long, query_text string, query_embedding array<float>")
    got = search.hybrid_search(chunks, docs, q, 3).orderBy("rank").collect()
    assert {r["id"] for r in got} == {1, 2, 3}
    assert abs(got[0]["similarity"] - (1 / 62 + 1 / 61)) < 1e-9 or abs(got[0]["similarity"] - (1 / 61 + 1 / 62)) < 1e-9
    labels = {r["id"]: r["search_type"] for r in search.hybrid_search_labeled(chunks, docs, q, 3, 0.3).collect()}
    assert labels == {1: "fulltext", 2: "vector", 3: "fulltext"}


def test_year_scores(spark):
    rows = [(1, i, 0.0, y, "web") for i, y in enumerate(["2024", "2023", "2022", "2019", None])]
    df = spark.createDataFrame(rows, "query_id long, id long, similarity double, fiscal_year string, source_type string").withColumn("category", F.lit(None).cast("string"))
    got = {r["id"]: round((r["adjusted_score"] - 0.9 * 0.15) / 0.25, 6) for r in scoring.multi_factor_score(df, 2030).collect()}
    assert got == {0: 1.0, 1: 0.75, 2: 0.5, 3: 0.0, 4: 0.85}


def test_prompt_refuses_without_context(spark):
    questions = spark.createDataFrame([(1, 1, "q")], "query_id long, conv_id long, question string")
    none = spark.createDataFrame([], "query_id long, context string")
    history = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    row = answers.build_prompt(questions, none, history, "s", "d").first()
    assert row["messages"] is None and row["answer"] == answers.REFUSAL


def test_years_are_a_set(spark):
    q = spark.createDataFrame([(1, "2024年 113年 2113年")], "query_id long, question string")
    assert answers.detect_comparison(q, []).first()["dimension"] is None


def test_config_overlay(spark):
    defaults = spark.createDataFrame([("a", "1", "int"), ("b", "x", "str"), ("c", "2.5", "float")], "key string, value string, kind string")
    config = spark.createDataFrame([("a", "no"), ("b", ""), ("c", "3")], "key string, value string")
    assert {r["key"]: r["value"] for r in read_config(defaults, config).collect()} == {"a": "1", "b": "x", "c": "3"}
