"""Filters, vector search, full-text search and rank fusion, for many queries at once.

Queries and chunks are tables of any size; vectors meet in packs (vectors.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bound_batches, written
from ._cover import density_of, parse_query
from .vectors import nearest

POOL, RRF_K = 20, 60
#: Rows of a table of words or ids that is broadcast at most. Results don't depend on it.
BROADCAST_ROWS = 200_000


def filter_documents(docs: DataFrame, language: str | None = None, group: str | None = None, company: str | None = None, fiscal_years: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """R1 for one set of filters: literal predicates, which reach the scan."""
    out = docs
    for c, value in (("language", language), ("group", group), ("company", company)):
        if value is not None:
            out = out.where(F.trim(F.col(f"`{c}`")) == value)
    for c, values in (("fiscal_year", fiscal_years), ("category", categories)):
        if values:
            out = out.where(F.trim(F.col(c)).isin(values))
    return out


def filter_sets(docs: DataFrame, sets: dict[str, dict]) -> DataFrame:
    """R1 for several stated filter sets by name: (filter_set, document_id), each set by its own pushed-down predicates."""
    out = None
    for name, filters in sets.items():
        part = filter_documents(docs, **filters).select(F.lit(name).alias("filter_set"), F.col("id").alias("document_id"))
        out = part if out is None else out.unionByName(part)
    return out


#: Optional columns of queries, each a filter of that query alone: a document's field must equal it (or be one of its values).
#: Null, or an empty list, asks for nothing.
QUERY_FILTERS = {"filter_language": "language", "filter_group": "group", "filter_company": "company", "filter_fiscal_years": "fiscal_year", "filter_categories": "category"}
_LISTS = ("filter_fiscal_years", "filter_categories")


def _filters_of(queries: DataFrame) -> list[str]:
    return [c for c in QUERY_FILTERS if c in queries.columns]


def query_allows(filters: list[str]) -> Column:
    """R1 for each query: whether a row's document fields (as searchable() adds them) pass the row's own filters."""
    out = F.lit(True)
    for c in filters:
        own = F.col(f"_{QUERY_FILTERS[c]}")
        out = out & ((F.coalesce(F.size(c), F.lit(0)) <= 0) | F.array_contains(c, own) if c in _LISTS else F.col(c).isNull() | (own == F.col(c)))
    return F.coalesce(out, F.lit(False))


def cosine_similarity(a: Column, b: Column) -> Column:
    """R3 for two array columns: for few rows; null where either is null or has length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def vector_pool(chunks: DataFrame, queries: DataFrame, n: int, threshold: float | None = None, carry: list[str] = ()) -> DataFrame:
    """(query_id, id, similarity, vec_rank, carried columns): each query's n most similar chunks(id, embedding) among those with a
    usable vector, for queries(query_id, query_embedding, filters) of any number (vectors.nearest). A query's filters hold for
    it alone: chunks carry their document's fields (searchable())."""
    return nearest(chunks, queries, n, threshold, {c: f"_{QUERY_FILTERS[c]}" for c in _filters_of(queries)}, carry)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """Flat search: similarity at least threshold, top k of each query."""
    return vector_pool(chunks, queries, k, threshold)


_SEARCHED = "chunk_type IN ('child', 'standalone')"


def searchable(chunks: DataFrame, docs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Chunks that are searched, of a kept document: one equi-join on document_id. Where queries have filters of their own, the
    document's fields that these name come along, trimmed, as _language and so on."""
    return _of_documents(chunks.where(_SEARCHED), docs, queries)


def _of_documents(rows: DataFrame, docs: DataFrame, queries: DataFrame | None) -> DataFrame:
    fields = [QUERY_FILTERS[c] for c in _filters_of(queries)] if queries is not None else []
    kept = docs.select(F.col("id").alias("document_id"), *(F.trim(F.col(f"`{c}`")).alias(f"_{c}") for c in fields))
    return rows.join(kept, "document_id") if fields else rows.join(kept, "document_id", "left_semi")


_DOCUMENT = ["file_name", "display_name", "category", "report_group", "group", "company", "fiscal_year", "language", "source_type", "status", "confidentiality", "tags", "publish_date"]


_OF_CHUNK = ["document_id", "parent_chunk_id"]


def _swapped(hits: DataFrame, chunks: DataFrame, docs: DataFrame, order: list[Column], k: int) -> DataFrame:
    """hits(query_id, id, document_id, parent_chunk_id, …) with their parent's text, the best of each parent, the top k, and
    document columns. Texts are fetched last, for the k hits of each query alone, by one pass over the chunks."""
    group = F.coalesce("parent_chunk_id", "id")
    best = hits.withColumn("_n", F.row_number().over(W.partitionBy("query_id", group).orderBy(*order))).where("_n = 1").drop("_n")
    top = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    texts = chunks.select(F.col("id").alias("_of"), "text_content", "metadata", "chunk_index", "chunk_type")
    asked = top.select("*", F.explode(F.array_compact(F.array("parent_chunk_id", "id"))).alias("_of"))
    mine = F.col("_of") == F.col("id")
    either = lambda c: F.coalesce(F.max(F.when(~mine, F.col(c))), F.max(F.when(mine, F.col(c)))).alias(c)
    own = [F.max(F.when(mine, F.col(c))).alias(c) for c in ("chunk_index", "chunk_type")]
    shown = asked.join(texts, "_of").groupBy(*top.columns).agg(either("text_content"), either("metadata"), *own)
    return shown.join(docs.select(F.col("id").alias("document_id"), *(F.col(f"`{c}`") for c in _DOCUMENT if c in docs.columns)), "document_id", "left")


def vector_search(chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """Pool of 20 k, threshold, parent text, best of each parent, top k. docs are those that pass filters that all queries
    share (R1); a query's own are columns of queries (QUERY_FILTERS)."""
    pool = vector_pool(searchable(chunks, docs, queries), queries, POOL * k, threshold, _OF_CHUNK)
    return _swapped(pool, chunks, docs, [F.desc("similarity"), F.col("id")], k).withColumn("search_type", F.lit("vector"))


def tokens(c: Column) -> Column:
    """R6's words: lower case, runs of letters and digits; no stemming, no stop words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def all_words(c: Column) -> Column:
    """A plain text as a query in web syntax that asks for each of its words: quoted, so "or" and a leading "-" are words too."""
    return F.array_join(F.transform(F.array_distinct(tokens(c)), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def _among(rows: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """rows joined with keys on a column. keys are a stored table: counted, and broadcast if they are few, so that rows aren't shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, column, how)


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ask, query_text, filters), the distinct ones of queries, and (query_id, ask)."""
    keys = ["query_text", *_filters_of(queries)]
    asks = written(queries.select(*keys).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"q.{c}"))
    return asks, asks.alias("a").join(queries.alias("q"), same).select("query_id", "ask")


def _matches(chunks: DataFrame, asks: DataFrame, docs: DataFrame | None) -> DataFrame:
    """(ask, id, rank_cd). Each distinct text is looked for once, whatever filters go with it."""
    bound_batches(chunks.sparkSession)  # words of a text are lists in Python
    filters = _filters_of(asks)
    fields, of_chunk = [f"_{QUERY_FILTERS[c]}" for c in filters], ["document_id"] if docs is not None else []
    parse = F.udf(lambda q: parse_query(q or ""), "array<struct<any:array<array<string>>,negative:boolean>>", useArrow=True)
    texts = asks.select("query_text").distinct().select(F.monotonically_increasing_id().alias("text"), "query_text", parse("query_text").alias("q"))
    parsed = written(texts.where(F.size("q") > 0), "parsed")
    groups = parsed.select("text", F.posexplode("q").alias("g", "group")).where("NOT group.negative")
    asked = groups.select("text", "g", F.explode(F.array_distinct(F.flatten("group.any"))).alias("word"))
    searched = chunks if docs is None else chunks.where(_SEARCHED)
    words = searched.select("id", *of_chunk, F.explode(F.array_distinct(tokens(F.col("text_content")))).alias("word"))
    held = written(_among(words, written(asked.select("word").distinct(), "asked-words"), "word"), "held-words")
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sizes = asked.join(often, "word", "left").groupBy("text", "g").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = sizes.groupBy("text").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    hit = _among(held, written(asked.join(rarest, ["text", "g"]).select("text", "word"), "rarest-words"), "word", "inner").select("text", "id", *of_chunk).distinct()
    if docs is not None:
        hit = _of_documents(hit, docs, asks)
    hit = written(hit, "candidates")
    rows = _among(searched.select("id", "text_content", *(fields if docs is None else [])), written(hit.select("id").distinct(), "candidate-ids"), "id")
    rank = F.udf(density_of, "double", useArrow=True)
    scored = rows.join(hit, "id").join(parsed.drop("query_text"), "text").select("text", "id", *fields, F.round(rank("q", tokens(F.col("text_content"))), 9).alias("rank_cd"))
    scored = written(scored, "text-ranks")  # a condition on ranks would rank a second time, below itself
    found = asks.join(parsed.drop("q"), "query_text").join(scored.where("rank_cd IS NOT NULL"), "text")
    return (found.where(query_allows(filters)) if filters else found).select("ask", "id", "rank_cd")


def fts_match(chunks: DataFrame, queries: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank_cd) of chunks that match a query in web syntax: all words, "a phrase", or, -not.

    A chunk must hold a word of every group that a query asks for, so those that hold a word of the query's rarest group
    are the only candidates: words that all queries share pair nothing. Texts are tokenised once, into a table of each chunk's
    distinct words that some query holds. What is left is matched and ranked by cover density over its words, rounded so that
    equal spans tie. Queries of one text and the same filters are one search. A query's own filters (QUERY_FILTERS) are tried
    on matches, with the fields that chunks carry (searchable()). Where docs are given, chunks needn't come from searchable():
    that join is made for candidates, so no text is shuffled for it.
    """
    asks, of = _asked(queries)
    return of.join(_matches(chunks, asks, docs), "ask").drop("ask")


def fts_topk(chunks: DataFrame, docs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, rank_cd, fts_rank), the n best of each query among chunks of docs."""
    asks, of = _asked(queries)
    w = W.partitionBy("ask").orderBy(F.desc("rank_cd"), "id")
    best = _matches(chunks, asks, docs).withColumn("fts_rank", F.row_number().over(w)).where(F.col("fts_rank") <= n)
    return of.join(best, "ask").drop("ask")


def rrf_fuse(vec: DataFrame, fts: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf_score, vec_rank, fts_rank): reciprocal ranks added, a missing side adds nothing."""
    both = vec.join(fts, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf_score", part("vec_rank") + part("fts_rank"))


def hybrid_search(chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5, texts: DataFrame | None = None) -> DataFrame:
    """Both pools of 20 k (vectors without a threshold), fused; parent text, best of each parent, top k. similarity is the
    fused score. Chunks without a vector never enter the vector pool. texts: the same chunks without vectors, where the two
    are stored apart, so that texts needn't be joined to vectors."""
    texts = chunks if texts is None else texts
    vec = vector_pool(searchable(chunks, docs, queries), queries, POOL * k).select("query_id", "id", "vec_rank")
    fused = rrf_fuse(vec, fts_topk(texts, docs, queries, POOL * k).select("query_id", "id", "fts_rank"))
    hits = fused.select("query_id", "id", F.col("rrf_score").alias("similarity")).join(texts.select("id", *_OF_CHUNK), "id")
    return _swapped(hits, texts, docs, [F.desc("similarity"), F.col("id")], k).withColumn("search_type", F.lit("hybrid"))


def hybrid_search_labeled(chunks: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.3, texts: DataFrame | None = None) -> DataFrame:
    """R10, the older form: pools of 2 k, the threshold on the vector side, no parent text; label by the sides that found the
    row; similarity is the vector's or 0. texts as in hybrid_search()."""
    texts = chunks if texts is None else texts
    vec = vector_pool(searchable(chunks, docs, queries), queries, 2 * k, threshold).select("query_id", "id", "similarity", "vec_rank")
    fused = rrf_fuse(vec, fts_topk(texts, docs, queries, 2 * k).select("query_id", "id", "fts_rank"))
    label = F.when(F.col("vec_rank").isNotNull() & F.col("fts_rank").isNotNull(), "hybrid").when(F.col("vec_rank").isNotNull(), "vector").otherwise("fulltext")
    w = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id")
    top = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "rrf_score", label.alias("search_type"), "rank")


def multi_query(results: DataFrame) -> DataFrame:
    """R11 on results(query_id, variant, rank, id, …): of a chunk that several variants of a query found the first counts."""
    w = W.partitionBy("query_id", "id").orderBy("variant", "rank")
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
