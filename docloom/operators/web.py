"""Links, URL rules, breadth-first reachability and page content over a pages(page_id, url, html) table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import first_of
from ..storage import written
from ._html import page_hrefs, page_parts
from .numbering import numbered

#: Endings of URL paths that are no pages.
ASSETS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".gz", ".tar", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".css", ".js", ".xml", ".json", ".rss", ".atom",
]


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href) of <a href> in order, entities decoded, without links that begin with javascript:, mailto:,
    tel: or #. A page without links or HTML gives no rows."""
    rows = pages.select("page_id", "url", _hrefs(F.col("html")).alias("hrefs")).select("page_id", "url", F.posexplode_outer("hrefs").alias("pos", "href"))
    return rows.where(F.col("href").isNotNull() & ~F.col("href").rlike(r"^(javascript:|mailto:|tel:|#)"))


def _hrefs(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(page_hrefs)

    return run(html)


def _join(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", (href or "").strip())
    except ValueError:
        return None


def _resolved(base: Column, href: Column) -> Column:
    @F.pandas_udf("string")
    def run(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([_join(b, h) for b, h in zip(base, href, strict=True)], index=base.index, dtype=object)

    return run(base, href)


def normalize_url(url: Column, base: Column | None = None, root_scheme: str = "https") -> Column:
    """Resolved against base, root_scheme, no fragment, no slash at the end of the path (an empty path is /); the query stays.
    Something that is no URL gives null."""
    full = _resolved(base, url) if base is not None else url
    full = F.regexp_replace(full, "#.*$", "")
    host, path, query = (F.try_parse_url(full, F.lit(p)) for p in ("AUTHORITY", "PATH", "QUERY"))
    bare = F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")
    return F.when(host.isNotNull(), F.concat(F.lit(f"{root_scheme}://"), host, F.when(bare == "", "/").otherwise(bare), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def should_skip(url: Column, domain: Column, exclude: list[str] = (), assets: list[str] = ASSETS) -> Column:
    """True for another host, an asset's ending on the lower-cased path, or any exclude pattern; null URLs are skipped."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    out = ~F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")) == domain, F.lit(False))
    if assets:
        out = out | path.rlike("(?:" + "|".join(map(re.escape, assets)) + ")$")
    for pattern in exclude:
        out = out | url.rlike(pattern)
    return F.coalesce(out, F.lit(True))


def page_links(pages: DataFrame, exclude: list[str] = (), root_scheme: str = "https", same_host: bool = True) -> DataFrame:
    """(url, pos, link): normalised links of every page, W1 to W3 once for the whole table."""
    own = normalize_url(F.col("url"), None, root_scheme)
    links = extract_links(pages).withColumn("link", normalize_url(F.col("href"), F.col("url"), root_scheme)).withColumn("url", own)
    host = F.try_parse_url("url", F.lit("AUTHORITY")) if same_host else F.try_parse_url("link", F.lit("AUTHORITY"))
    return links.where(~should_skip(F.col("link"), host, exclude)).select("url", "pos", "link")


def crawl_reachable(pages: DataFrame, links: DataFrame, roots: DataFrame, max_depth: int = 5, max_pages: int | None = 200) -> DataFrame:
    """(root, url, depth, position) reached from roots(root) breadth first, in the order a queue would give.

    pages(url) exist; links(url, pos, link) lead on. Only existing pages count towards max_pages and are expanded, below
    max_depth; without max_pages all of them do, and a level is numbered over ranges, however many pages a root has there. Each
    level is one join and is written to the shared folder; a level's order is (parent's place, link's place).
    """
    exist = pages.select("url").distinct()
    frontier = roots.select("root", F.col("root").alias("url"), F.lit(0).cast("long").alias("place"))
    seen = frontier.select("root", "url")
    found, counts = None, roots.select("root", F.lit(0).cast("long").alias("had"))
    for depth in range(max_depth + 1):
        here = first_of(frontier.join(exist, "url", "left_semi"), ["root", "url"], ["place"])
        places = numbered(here, ["root"], [F.col("place")]) if max_pages is None else here.withColumn("n", F.row_number().over(W.partitionBy("root").orderBy("place")))
        places = places.join(counts, "root")
        if max_pages is not None:
            places = places.where(F.col("had") + F.col("n") <= max_pages)
        kept = places.select("root", "url", F.lit(depth).alias("depth"), (F.col("had") + F.col("n")).cast("long").alias("position"))
        kept = written(kept, "level")
        found = kept if found is None else found.unionByName(kept)
        if depth == max_depth or kept.isEmpty():
            break
        counts = counts.join(kept.groupBy("root").agg(F.max("position").alias("m")), "root", "left").select("root", F.coalesce("m", "had").alias("had"))
        nxt = kept.join(links, "url").select("root", F.col("link").alias("url"), F.struct("position", "pos").alias("o"))
        nxt = nxt.groupBy("root", "url").agg(F.min("o").alias("o")).join(seen, ["root", "url"], "left_anti")
        frontier = written(nxt.select("root", "url", (F.col("o.position") * 1_000_000 + F.col("o.pos")).alias("place")), "frontier")
        seen = seen.unionByName(frontier.select("root", "url"))  # each level's table is written once and read again
    return found


def _parts(html: Column) -> Column:
    @F.pandas_udf("struct<title:string,lang:string,content:string,markdown:string>")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in pages:
            yield pd.DataFrame([page_parts(h) for h in part], columns=["title", "lang", "content", "markdown"], index=part.index)

    return run(html)


def language_of(lang: Column) -> Column:
    """En, ja, zh-TW or zh-CN by the language attribute; another language is itself; none is zh-TW."""
    low = F.lower(strip(lang))
    chinese = F.when(low.contains("tw") | low.contains("hant"), "zh-TW").otherwise("zh-CN")
    return F.when(lang.isNull() | (low == ""), "zh-TW").when(low.startswith("en"), "en").when(low.startswith("ja"), "ja").when(low.startswith("zh"), chinese).otherwise(lang)


def page_content(pages: DataFrame) -> DataFrame:
    """W5 to W7 in one pass: page_id, url, title, language, content, markdown."""
    read = pages.select("page_id", "url", _parts(F.col("html")).alias("p"))
    return read.select("page_id", "url", "p.title", language_of(F.col("p.lang")).alias("language"), "p.content", "p.markdown")


def page_meta(pages: DataFrame) -> DataFrame:
    """W5 by column functions: title and language. Entities in titles are decoded by page_content only."""
    title = strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = strip(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    lang = F.nullif(F.regexp_extract("html", r"""(?is)<html[^>]*\slang\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    return pages.select("page_id", "url", F.when(title != "", title).otherwise(h1).alias("title"), language_of(lang).alias("language"))


def main_content(pages: DataFrame) -> DataFrame:
    """W6"""
    return page_content(pages).select("page_id", "content")


def html_to_markdown(pages: DataFrame) -> DataFrame:
    """W7"""
    return page_content(pages).select("page_id", "markdown")
