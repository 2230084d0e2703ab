"""Metadata put together from several sources, and abstracts from web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from litgraph.functions.text import nonempty, strip_tags

# Places of an abstract in a web page, in the order tried.
META_PATTERNS = (
    r"""<meta\s+name=["']citation_abstract["']\s+content=["'](.*?)["']""",
    r"""<meta\s+content=["'](.*?)["']\s+name=["']citation_abstract["']""",
    r"""<meta\s+name=["']dc\.description["']\s+content=["'](.*?)["']""",
    r"""<meta\s+name=["']DC\.Description["']\s+content=["'](.*?)["']""",
    r"""<meta\s+property=["']og:description["']\s+content=["'](.*?)["']""",
    r"""<meta\s+name=["']description["']\s+content=["'](.*?)["']""",
)
BODY_PATTERNS = (
    r"""<(?:div|section|p)[^>]*(?:class|id)=["'][^"']*abstract[^"']*["'][^>]*>(.*?)</(?:div|section|p)>""",
    r"""<abstract[^>]*>(.*?)</abstract>""",
)
TITLE_PATTERN = r"""<meta\s+property=["']og:title["']\s+content=["'](.*?)["']"""
SOURCE_ORDER = ("crossref", "semantic_scholar", "pubmed", "html")


def _long_enough(html: Column, pattern: str) -> Column:
    found = F.trim(strip_tags(F.regexp_extract(html, f"(?is){pattern}", 1)))
    return F.when(F.length(found) > 100, found)


def scrape_abstract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Abstract of a page from its meta tags, else from a body container; and its title."""
    html = F.col(html_col)
    meta = [_long_enough(html, p) for p in META_PATTERNS]
    body = [F.substring(_long_enough(html, p), 1, 5000) for p in BODY_PATTERNS]
    title = nonempty(F.trim(F.regexp_extract(html, f"(?i){TITLE_PATTERN}", 1)))
    return pages.withColumns({"abstract": F.coalesce(*meta, *body), "og_title": title})


def coalesce_metadata(sources: DataFrame, order=SOURCE_ORDER,
                      fields=("title", "abstract", "authors", "journal", "published_date")) -> DataFrame:
    """Per DOI and field the first non-empty value in source order; a row without a DOI is a paper of its own."""
    rank = F.array_position(F.lit(list(order)), F.col("source"))
    ranked = sources.withColumn("_rank", F.when(rank > 0, rank).otherwise(len(order) + 1))
    types = dict(sources.dtypes)

    def cleaned(c):
        v = F.col(c)
        if types[c].startswith("array"):
            v = F.when(F.size(v) > 0, v)
        elif types[c] == "string":
            v = nonempty(F.trim(strip_tags(v))) if c == "abstract" else nonempty(F.trim(v))
        return v

    have = [c for c in fields if c in types]
    doi = nonempty(F.lower(F.trim("doi")))
    named = ranked.filter(doi.isNotNull()).groupBy(doi.alias("doi")).agg(
        *[F.min_by(cleaned(c), F.when(cleaned(c).isNotNull(), F.col("_rank"))).alias(c) for c in have])
    alone = ranked.filter(doi.isNull()).select(F.lit(None).cast("string").alias("doi"), *[cleaned(c).alias(c) for c in have])
    return named.unionByName(alone).withColumn("title", F.coalesce("title", F.lit("Unknown")))
