"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

In every stage a row stands for itself: repeated rows and ids are judged each alike, a null doc_id passes on. Null and empty texts
are judged as empty ones: they hold no test item and are copies of nothing. An empty table gives an empty result. All but
the last stage return the columns that they get, whatever other columns these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import benchmark_leaks, bpe_codec, common, minhash_dups, quality, toxicity

#: No stage but the token digests could be said in SQL: classifiers are fitted, matches have edits.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer, fitted on these documents, does not reject."""
    scored = quality.score(docs.withColumnRenamed("quality_score", "_own")).where("quality_score >= 0.5").drop("quality_score")
    return scored.withColumnRenamed("_own", "quality_score").select(*(f"`{c}`" for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below 0.5, by a network fitted on the labelled ones among them."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumnRenamed("toxicity", "_own"), model).where("toxicity < 0.5").drop("toxicity")
    return scored.withColumnRenamed("_own", "toxicity").select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similarity 0.8: that with the smallest doc_id, a null one last. Each row stands for itself:
    rows without an id are compared, too, and of an id's several texts only those go that are copies."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())  # docs is a stored table: a row keeps its number
    found = minhash_dups.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80)
    alike = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = found.join(alike, "component_id").select("component_id", F.col("doc_id").alias("_row")).join(rows.select("_row", "doc_id"), "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select("first._row")
    dropped = members.select("_row").join(first, "_row", "left_anti")
    return rows.join(dropped, "_row", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item within its error budget."""
    return benchmark_leaks.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and digests of the ids and of the bytes decoded from them."""
    decoded = bpe_codec.encode_and_decode(docs.select("doc_id", "lang", "source", "text"))
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("tokens", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
