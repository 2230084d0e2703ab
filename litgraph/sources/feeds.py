"""Feeds of paper metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from litgraph import lookups as L
from litgraph.functions.text import nonempty, strip_tags

_TEXT = "struct<_VALUE:string,_Label:string>"
_DATE = "struct<Year:string,Month:string,Day:string>"
PUBMED_SCHEMA = f"""
MedlineCitation struct<
  PMID:struct<_VALUE:string>, DateCompleted:{_DATE}, DateRevised:{_DATE},
  Article:struct<
    ArticleTitle:string, Abstract:struct<AbstractText:array<{_TEXT}>>,
    AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string>>>,
    Journal:struct<Title:string,JournalIssue:struct<PubDate:{_DATE}>>, ArticleDate:{_DATE}>,
  MedlineJournalInfo:struct<MedlineTA:string>,
  MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>,
  KeywordList:struct<Keyword:array<struct<_VALUE:string>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>
"""
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _filled(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.length(x) > 0)


def month_number(m: Column) -> Column:
    """Two-digit month of a number or an English month name; anything else is 01."""
    at = F.array_position(F.lit(list(MONTHS)), F.lower(F.substring(m, 1, 3)))
    return F.when(m.rlike(r"^\d+$"), F.lpad(m, 2, "0")).when(at > 0, F.lpad(at.cast("string"), 2, "0")).otherwise("01")


def _iso(d: str) -> Column:
    month = F.coalesce(F.col(f"{d}.Month"), F.lit("01"))
    day = F.coalesce(F.col(f"{d}.Day"), F.lit("01"))
    return F.concat(F.col(f"{d}.Year"), F.lit("-"), month_number(month), F.lit("-"), day)


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_SCHEMA).load(path)


def parse_pubmed(df: DataFrame) -> DataFrame:
    """Paper rows of PubMed records as read by ``read_pubmed``."""
    art = "MedlineCitation.Article"
    name = lambda a: F.regexp_replace(F.concat(
        F.coalesce(a["LastName"], F.lit("")), F.lit(", "),
        F.coalesce(nonempty(a["ForeName"]), a["Initials"], F.lit(""))), r"^[, ]+|[, ]+$", "")
    part = lambda t: F.concat(F.coalesce(F.concat(nonempty(t["_Label"]), F.lit(": ")), F.lit("")),
                              F.coalesce(F.trim(strip_tags(t["_VALUE"])), F.lit("")))
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    return df.select(
        F.coalesce("MedlineCitation.PMID._VALUE", F.lit("")).alias("pmid"),
        F.coalesce(F.trim(strip_tags(F.col(f"{art}.ArticleTitle"))), F.lit("")).alias("title"),
        F.array_join(F.transform(f"{art}.Abstract.AbstractText", part), " ").alias("abstract"),
        _filled(F.transform(f"{art}.AuthorList.Author", name)).alias("authors"),
        F.coalesce(f"{art}.Journal.Title", "MedlineCitation.MedlineJournalInfo.MedlineTA").alias("journal"),
        F.coalesce(_iso(f"{art}.Journal.JournalIssue.PubDate"), _iso(f"{art}.ArticleDate"),
                   _iso("MedlineCitation.DateCompleted"), _iso("MedlineCitation.DateRevised")).alias("pub_date"),
        F.get(ids, F.lit(0))["_VALUE"].alias("doi"),
        _filled(F.transform("MedlineCitation.MeshHeadingList.MeshHeading", lambda m: m["DescriptorName"]["_VALUE"])).alias("mesh_terms"),
        _filled(F.transform("MedlineCitation.KeywordList.Keyword", lambda k: k["_VALUE"])).alias("keywords"),
    )


def _year(day: Column) -> Column:
    return F.when(F.length(day) >= 4, F.substring(day, 1, 4).try_cast("int"))


def normalize_preprints(df: DataFrame, server: str, categories=L.PREPRINT_CATEGORIES) -> DataFrame:
    """Paper rows of preprint records; needs a DOI, a real abstract and a wanted category."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    day = F.coalesce(nonempty(F.col("date")), F.col("date_timestamp")) if "date_timestamp" in df.columns else F.col("date")
    out = df.select(
        F.lit(server).alias("source"), clean("doi").alias("external_id"), clean("title").alias("title"),
        clean("abstract").alias("abstract"),
        _filled(F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda x: F.trim(x))).alias("authors"),
        F.lit("medRxiv" if server == "medrxiv" else "bioRxiv").alias("journal"),
        day.alias("pub_date"), _year(day).alias("pub_year"), clean("doi").alias("doi"),
        F.lower(clean("category")).alias("category"),
    ).filter((F.col("doi") != "") & (F.length("abstract") >= 30))
    if categories:
        out = out.filter((F.col("category") == "") | F.col("category").isin(*categories))
    return out.withColumn("keywords", _filled(F.array("category")))


def normalize_europepmc(df: DataFrame, server: str = "both") -> DataFrame:
    """Paper rows of Europe PMC results."""
    flat = lambda c: F.trim(F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), "\n", " "))
    doi = nonempty(F.trim("doi"))
    publisher = F.lower(F.coalesce(nonempty(F.col("bookOrReportDetails.publisher")), F.col("source"), F.lit("")))
    names = F.transform(F.slice("authorList.author", 1, 10), lambda a: F.coalesce(nonempty(a["fullName"]), a["lastName"]))
    day = F.coalesce(nonempty(F.col("firstPublicationDate")), F.col("pubYear"))
    out = df.select(
        F.when(publisher.contains("medrxiv"), "medrxiv").otherwise("biorxiv").alias("_source"),
        F.coalesce(doi, nonempty(F.col("id"))).alias("external_id"), flat("title").alias("title"),
        flat("abstractText").alias("abstract"), _filled(names).alias("authors"), day.alias("pub_date"),
        _year(day).alias("pub_year"), doi.alias("doi"), F.col("id").alias("europepmc_id"),
    ).withColumnRenamed("_source", "source")
    out = out.filter((F.length("abstract") >= 50) & F.col("external_id").isNotNull())
    if server != "both":
        out = out.filter(F.col("source") == server)
    return out.withColumn("journal", F.when(F.col("source") == "medrxiv", "medRxiv").otherwise("bioRxiv"))


ARXIV_SCHEMA = """
id string, title string, summary string, published string, doi string,
author array<struct<name:string>>, category array<struct<_term:string>>
"""


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true")
        .schema(ARXIV_SCHEMA).load(path)
    )


def normalize_arxiv(df: DataFrame) -> DataFrame:
    """Paper rows of arXiv feed entries."""
    flat = lambda c: F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), "\n", " ")
    url = F.trim(F.coalesce("id", F.lit("")))
    day = F.substring("published", 1, 10)
    return df.select(
        F.lit("arxiv").alias("source"),
        F.when(url.contains("/abs/"), F.trim(F.substring_index(url, "/abs/", -1))).alias("external_id"),
        flat("title").alias("title"), flat("summary").alias("abstract"),
        _filled(F.transform(F.slice("author", 1, 10), lambda a: F.trim(a["name"]))).alias("authors"),
        F.lit("arXiv").alias("journal"), day.alias("pub_date"), _year(day).alias("pub_year"),
        nonempty(F.trim("doi")).alias("doi"), F.transform("category", lambda c: c["_term"]).alias("keywords"),
    ).filter((F.length("abstract") >= 50) & (F.length("external_id") > 0))
