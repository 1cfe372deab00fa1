"""Re-ranking, weighting, neighbours and projection of search results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fiscal_year_int

#: Weights of similarity, year and source; of categories.
WEIGHTS = (0.60, 0.25, 0.15)
SOURCE_WEIGHTS = {"永續報告書": 1.0, "網頁": 0.9, "年度報告": 0.75}
OTHER_SOURCE, WEB_SOURCE, NO_YEAR, YEAR_STEP = 0.6, 0.9, 0.85, 0.25


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic scorer for tests: the share of the query's words that the text holds, as a logit."""
    words = [set((q or "").split()) for q in queries]
    return [4.0 * len(w & set((t or "").split())) / max(1, len(w)) - 2.0 for w, t in zip(words, texts, strict=True)]


def rerank_scores(results: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """R12 on results(query_id, query_text, id, display_name, text_content, …): similarity becomes the sigmoid of the scorer's
    logit for title and text cut to 1024 characters; the top k of each query."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            yield pd.Series(scorer(queries.tolist(), texts.tolist()), index=queries.index, dtype="float64")

    text = F.substring(F.concat_ws("\n", "display_name", "text_content"), 1, 1024)
    x = F.col("_logit")
    score = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    ranked = results.withColumn("_logit", run("query_text", text)).withColumn("similarity", score).drop("_logit")
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank_by_order(results: DataFrame, orders: DataFrame, k: int) -> DataFrame:
    """R13 on results(query_id, rank, …) and orders(query_id, order: array<int>, 1-based): listed rows in that order (a
    repeated index repeats its row, an invalid one is ignored), then the others as they were; the top k."""
    listed = orders.select("query_id", F.posexplode("order").alias("pos", "rank"))
    first = results.join(listed, ["query_id", "rank"]).withColumn("key", F.struct(F.lit(0).alias("a"), F.col("pos").alias("b")))
    rest = results.join(listed, ["query_id", "rank"], "left_anti").withColumn("pos", F.lit(None).cast("int")).withColumn("key", F.struct(F.lit(1).alias("a"), F.col("rank").cast("int").alias("b")))
    both = first.unionByName(rest).withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy("key")))
    return both.where(F.col("new_rank") <= k).drop("key", "pos")


def multi_factor_score(results: DataFrame, current_year: int, weights: tuple[float, float, float] = WEIGHTS, similarity: str = "similarity", web_types: tuple[str, ...] = ("web",)) -> DataFrame:
    """adjusted_score and its rank in each query. Years count back from the newest of the query's results, at most
    current_year; a result without a year gets NO_YEAR."""
    year = fiscal_year_int(F.col("fiscal_year"))
    newest = F.least(F.max(year).over(W.partitionBy("query_id")), F.lit(current_year))
    year_score = F.when(year.isNull(), F.lit(NO_YEAR)).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), F.coalesce(newest, F.lit(current_year)) - year) * YEAR_STEP))
    source = F.create_map(*(F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair))[F.coalesce("category", F.lit(""))]
    source = F.when(F.col("source_type").isin(*web_types), F.lit(WEB_SOURCE)).otherwise(F.coalesce(source, F.lit(OTHER_SOURCE)))
    scored = results.withColumn("adjusted_score", F.coalesce(F.col(similarity), F.lit(0.0)) * weights[0] + year_score * weights[1] + source * weights[2])
    return scored.withColumn("adjusted_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("adjusted_score"), "id")))


def neighbour_context(hits: DataFrame, chunks: DataFrame, n: int = 1) -> DataFrame:
    """R16 on hits(query_id, document_id, chunk_index): the chunks up to n before and after each hit of the same document. The
    range becomes an equi-join on (document_id, chunk_index)."""
    near = hits.select("query_id", "document_id", F.col("chunk_index").alias("hit_index"), F.explode(F.sequence(F.greatest(F.col("chunk_index") - n, F.lit(0)), F.col("chunk_index") + n)).alias("chunk_index"))
    place = F.when(F.col("chunk_index") < F.col("hit_index"), "previous").when(F.col("chunk_index") > F.col("hit_index"), "next").otherwise("current")
    return near.join(chunks.select("document_id", "chunk_index", "id", "text_content"), ["document_id", "chunk_index"]).withColumn("place", place)


def project_results(results: DataFrame) -> DataFrame:
    """Metadata lifted, dates as text, and each query's count."""
    keep = [c for c in results.columns if c not in ("metadata", "publish_date", "embedding")]
    lifted = [F.col(f"metadata.{c}").alias(c) for c in ("section_title", "page_start", "page_end")]
    date = [F.col("publish_date").cast("string").alias("publish_date")] if "publish_date" in results.columns else []
    return results.select(*keep, *lifted, *date, F.count(F.lit(1)).over(W.partitionBy("query_id")).alias("total"))
