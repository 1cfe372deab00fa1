"""Catalogue statistics, metadata rules, set work and append tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .numbering import numbered
from ..sources.tables import first_of

ALL, UNCATEGORISED, OTHER = "全部", "未分類", "其他"


def kb_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """G1: (kind, name, n): total documents and chunks, documents by category and by source type. A null
    category is a group of its own. Grouping sets: one pass, one small shuffle."""
    sets = docs.select("category", "source_type").groupingSets([("category",), ("source_type",)], "category", "source_type")
    by = sets.agg(F.grouping_id("category", "source_type").alias("g"), F.count(F.lit(1)).alias("n"))
    named = by.select(F.when(F.col("g") == 1, "category").otherwise("source_type").alias("kind"), F.when(F.col("g") == 1, F.col("category")).otherwise(F.col("source_type")).alias("name"), "n")
    total = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), "n")
    return named.unionByName(total(docs, "documents")).unionByName(total(chunks, "chunks"))


def filter_facets(docs: DataFrame) -> DataFrame:
    """Distinct non-empty (facet, value) of five columns, with pos: ascending, fiscal years descending."""
    facets = ["category", "fiscal_year", "language", "group", "company"]
    long = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(f"`{c}`").alias("value")) for c in facets))).alias("f"))
    found = long.select("f.*").where("value <> ''").distinct()
    down = F.when(F.col("facet") == "fiscal_year", F.col("value"))
    return numbered(found, ["facet"], [down.desc(), F.col("value").asc()], "pos").withColumn("pos", F.col("pos").cast("int"))


def list_documents(docs: DataFrame, filters: dict[str, str | None], limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, counts): newest first, ties by id; counts(total, pages) of all that pass the filters."""
    kept = docs
    for c, value in filters.items():
        if value is not None:
            kept = kept.where(F.col(f"`{c}`") == value)
    total = kept.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / limit).cast("long"))
    return kept.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit), total


def _by_rules(source: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first rule whose case-insensitive LIKE pattern source matches, else the default."""
    value = default
    for pattern, name in reversed(rules):
        value = F.when(source.ilike(pattern), F.lit(name)).otherwise(value)
    return value


def backfill_pdf_metadata(docs: DataFrame, names: list[tuple[str, str]], groups: list[tuple[str, str]]) -> DataFrame:
    """display_name and report_group of pdf rows without a display name, by rules; where no rule matches, the file name and
    the category."""
    only = F.coalesce(F.col("source_type") == "pdf", F.lit(False)) & F.col("display_name").isNull()
    name, group = _by_rules(F.col("file_name"), names, F.col("file_name")), _by_rules(F.col("file_name"), groups, F.col("category"))
    return docs.withColumns({"display_name": F.when(only, name).otherwise(F.col("display_name")), "report_group": F.when(only, group).otherwise(F.col("report_group"))})


def url_path(c: Column) -> Column:
    """An http(s) URL without scheme, host, the slash after it, query and fragment."""
    return F.regexp_replace(F.regexp_replace(c, r"^https?://[^/]+/", ""), r"(?s)[?#].*$", "")


def backfill_url_metadata(docs: DataFrame, url_rules: list[tuple[str, str]], url_default: str | None = None, blank_is_missing: bool = False, copy_category: bool = False) -> DataFrame:
    """Url rows' report_group from the category (unless null or 'other'), else from URL patterns, else url_default;
    every row's missing display_name is its URL's path, or its file name where that is no URL.

    blank_is_missing, copy_category: the second variant: a blank counts as missing, the category is copied as it is, and only
    url rows get a display_name.
    """
    url, name = F.coalesce(F.col("source_type") == "url", F.lit(False)), F.col("file_name")
    missing = lambda c: (F.col(c).isNull() | (F.col(c) == "")) if blank_is_missing else F.col(c).isNull()
    ruled = _by_rules(name, url_rules, F.lit(url_default).cast("string"))
    group = F.col("category") if copy_category else F.when(F.col("category").isNotNull() & (F.col("category") != OTHER), F.col("category")).otherwise(ruled)
    shown = url_path(name) if blank_is_missing else F.when(name.startswith("http"), url_path(name)).otherwise(name)
    named = missing("display_name") & url if blank_is_missing else missing("display_name")
    return docs.withColumns(
        {
            "report_group": F.when(url & missing("report_group"), group).otherwise(F.col("report_group")),
            "display_name": F.when(named, shown).otherwise(F.col("display_name")),
        }
    )


def report_group_summary(docs: DataFrame) -> DataFrame:
    """G6"""
    return docs.groupBy("report_group").agg(F.count(F.lit(1)).alias("n"), F.min("display_name").alias("sample")).orderBy(F.desc("n"), "report_group")


#: Words of a file name or URL and the category that they say, for pdf files and for everything else.
PDF_CATEGORIES = [(["永續", "sustain"], "永續報告書"), (["年報", "annual"], "年度報告")]
WEB_CATEGORIES = [(["/esg/", "esg"], "ESG專區"), (["news", "新聞"], "新聞"), (["newsletter", "電子報"], "電子報")]
WEB_DEFAULT = "官網"


def guess_category(docs: DataFrame, pdf_rules: list = PDF_CATEGORIES, web_rules: list = WEB_CATEGORIES, pdf_default: str = OTHER, web_default: str = WEB_DEFAULT) -> DataFrame:
    """The first rule with a word in the lower-cased file name, else the default; pdf files have rules of their own."""

    def first(rules: list, default: str) -> Column:
        out = F.lit(default)
        for words, category in reversed(rules):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.lower("file_name").contains(w)
            out = F.when(hit, category).otherwise(out)
        return out

    return docs.withColumn("guessed_category", F.when(F.col("source_type") == "pdf", first(pdf_rules, pdf_default)).otherwise(first(web_rules, web_default)))


def fill_document_defaults(docs: DataFrame) -> DataFrame:
    """What a catalogue page shows for missing values."""
    either = lambda c, value: F.coalesce(blank_to_null(F.col(c)), value)
    return docs.withColumns(
        {
            "display_name": either("display_name", F.col("file_name")),
            "category": either("category", F.lit("")),
            "report_group": either("report_group", F.lit("")),
            "company": either("company", F.lit("")),
            "fiscal_year": either("fiscal_year", F.lit("")),
            "language": either("language", F.lit("zh-TW")),
            "status": either("status", F.lit("已發布")),
            "fiscal_period": either("fiscal_period", F.lit("Annual")),
            "created_at": F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("")),
        }
    )


def browse_documents(docs: DataFrame, language: str = ALL, category: str = ALL, company: str = ALL) -> tuple[DataFrame, DataFrame]:
    """(rows, counts(shown, total)); a company matches a document's group or company."""
    keep = F.lit(True)
    if language != ALL:
        keep = keep & (F.col("language") == language)
    if category != ALL:
        keep = keep & (F.col("category").isNull() if category == UNCATEGORISED else F.col("category") == category)
    if company != ALL:
        keep = keep & ((F.col("group") == company) | (F.col("company") == company))
    keep = F.coalesce(keep, F.lit(False))
    return docs.where(keep), docs.agg(F.count_if(keep).alias("shown"), F.count(F.lit(1)).alias("total"))


def category_tree_counts(docs: DataFrame, groups: DataFrame, orphan: str = OTHER) -> DataFrame:
    """G10 with groups(group_name, category): counts by group and category, and by group where category_total;
    categories of no group count under `orphan`. A category in several groups counts in each."""
    counts = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))  # small from here on
    placed = counts.join(groups, "category", "left").withColumn("group_name", F.coalesce("group_name", F.lit(orphan)))
    return placed.rollup("group_name", "category").agg(F.grouping_id().alias("level"), F.sum("n").alias("n")).where("level < 3").select("group_name", "category", (F.col("level") == 1).alias("category_total"), "n")


def merge_category_groups(base: Column, custom: Column) -> Column:
    """Union of two maps of group to categories, order kept, no repeats."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(base, custom, lambda k, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))  # noqa: ARG005


def companies_of_group(docs: DataFrame, groups: list[str] | None) -> DataFrame:
    """Distinct companies within groups; no groups chosen: of all."""
    kept = docs.where(F.col("group").isin(groups)) if groups else docs
    return kept.where("company <> ''").select("company").distinct()


def term_counts(terms: DataFrame) -> DataFrame:
    """G13"""
    return terms.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def ingested_since(docs: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """(rows by id, count(total)) created at or after ts."""
    kept = docs.where(F.col("created_at") >= F.lit(ts).cast("timestamp"))
    return kept.orderBy("id"), kept.agg(F.count(F.lit(1)).alias("total"))


def delete_documents(docs: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without documents ids(id): chunks go with their document, children with their parent."""
    gone = ids.select("id").distinct()
    left = chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    parents = chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_semi").select(F.col("id").alias("parent_chunk_id"))
    return docs.join(gone, "id", "left_anti"), left.join(parents, "parent_chunk_id", "left_anti").select(*chunks.columns)


def document_chunks_of(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """G16"""
    return chunks.join(doc_ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "chunk_index", "id", "chunk_type", "parent_chunk_id", "text_content").orderBy("document_id", "chunk_index")


def upsert_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of config(key, value), replaced or joined by those of changes."""
    c, n = config.select("key", F.col("value").alias("_old")), changes.select("key", F.col("value").alias("_new"), F.lit(True).alias("_set"))
    return c.join(n, "key", "full_outer").select("key", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("_old")).alias("value"))


def read_config(defaults: DataFrame, config: DataFrame) -> DataFrame:
    """defaults(key, value, kind) under config: an empty value or one that its kind can't take is no value."""
    v = F.nullif("value_set", F.lit(""))
    ok = F.when(F.col("kind") == "int", v.try_cast("int").isNotNull()).when(F.col("kind") == "float", v.try_cast("double").isNotNull()).otherwise(v.isNotNull())
    return defaults.join(config.select("key", F.col("value").alias("value_set")), "key", "left").select("key", F.when(ok, v).otherwise(F.col("value")).alias("value"), "kind")


def insert_terms_if_absent(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Terms and those of new whose term is not there; an existing term wins, of new ones the least full_name."""
    fresh = first_of(new, ["term"], ["full_name"]).join(terms.select("term"), "term", "left_anti")
    return terms.unionByName(fresh, allowMissingColumns=True)


PATCHABLE = ["display_name", "category", "report_group", "group", "company", "language", "fiscal_year", "fiscal_period"]


def update_documents(docs: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G19 with patches(id, any of eight fields): (documents, count(changed)). A patched blank becomes null."""
    fields = [c for c in PATCHABLE if c in patches.columns]
    p = patches.select("id", *(F.col(f"`{c}`").alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    both = docs.join(p, "id", "left")
    new = {c: F.when(F.col("_hit"), blank_to_null(F.col(f"_{c}"))).otherwise(F.col(f"`{c}`")) for c in fields}
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(f"`{c}`").eqNullSafe(new[c])
    counts = both.agg(F.count_if(F.coalesce(F.col("_hit"), F.lit(False)) & changed).alias("changed"))
    return both.withColumns(new).select(*docs.columns), counts


def backfill_group_company(docs: DataFrame, group: str, company: str) -> DataFrame:
    """G20"""
    no = F.col("group").isNull()
    return docs.withColumns({"group": F.when(no, group).otherwise(F.col("group")), "company": F.when(no, company).otherwise(F.col("company"))})


def split_feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rating must be 'up' or 'down'; source defaults to 'api'."""
    ok = F.coalesce(F.col("rating").isin("up", "down"), F.lit(False))
    return rows.where(ok).withColumn("source", F.coalesce("source", F.lit("api"))), rows.where(~ok)


def append_feedback(rows: DataFrame, path: str) -> DataFrame:
    """Appends what is valid and returns the rest."""
    good, bad = split_feedback(rows)
    good.write.mode("append").parquet(path)
    return bad


def usage_rollup(usage: DataFrame) -> DataFrame:
    """G22 on usage(created_at, source, total_tokens): calls and tokens by day and source, by day, and in all."""
    day = usage.select(F.to_date("created_at").alias("day"), "source", "total_tokens")
    return day.rollup("day", "source").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens"))
