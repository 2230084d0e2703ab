"""Catalog: sources, sinks, scalar functions, search, outreach and streams (S, F, X, T)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from litgraph.functions import scores, text as X, vocab as V
from litgraph.operators import entities as E
from litgraph.operators import joins as J
from litgraph.operators import outreach as O
from litgraph.operators import reports as R
from litgraph.operators import search as S
from litgraph.operators import sinks as K
from litgraph.operators import worksets as W
from litgraph.plans.catalog_graph import VERBS
from litgraph.plans.registry import case
from litgraph.runtime import checkpoint_dir
from litgraph.sources import articles, feeds, metadata, model_output
from litgraph.streaming import incremental as T

JOIN = lambda c: F.array_join(c, "|")
text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
num = lambda c: F.col(c).cast("string")


# --- S: records built from the given tables, then parsed -------------------------------------------

def _plain(c):
    """Text without control characters, escaped for XML."""
    kept = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f￾￿]", " ")
    return F.replace(F.replace(F.replace(kept, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _jats(t):
    body = _plain(F.col("text"))
    return t.documents.select(
        F.col("doc_id").cast("string").alias("article_id"),
        text("<article><front><journal-title>Journal ", F.col("source"), "</journal-title><article-id pub-id-type='doi'>10.1/d", num("doc_id"),
             "</article-id><article-title>Document <i>", num("doc_id"), "</i></article-title><contrib contrib-type='author'><name><surname>Doe</surname>"
             "<given-names>", F.col("lang"), "</given-names></name></contrib><pub-date pub-type='ppub'><year>2001</year><month>3</month></pub-date>"
             "<abstract><p>Lang ", F.col("lang"), "</p></abstract></front><body><sec><title>Materials and Methods</title><p>", body,
             "</p></sec><sec><title>Results</title><p>n ", num("n_chars"), "</p></sec></body><back><ref-list><ref id='r1'><year>1999</year>"
             "<pub-id pub-id-type='doi'>10.1/d", num("n_chars"), "</pub-id></ref></ref-list></back></article>").alias("body"))


SQUEEZED = r"length(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '[^\p{L}\p{N}]', '', 'g'))"
JATS_SQL = f"""
select cast(doc_id as string) as article_id, concat('Document ', cast(doc_id as string)) as title, concat('Lang ', lang) as abstract, concat('Doe, ', lang) as authors,
 concat('Journal ', source) as journal, '2001-03-01' as pub_date, concat('10.1/d', cast(doc_id as string)) as doi, concat('10.1/d', cast(n_chars as string)) as ref_doi,
 {SQUEEZED} as body_letters from documents"""


def _letters(c):
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")).cast("long")


@case("S02_parse_jats", JATS_SQL)
def _(t):
    out = articles.parse_jats(_jats(t), "body")
    return out.select("article_id", "title", "abstract", JOIN("authors").alias("authors"), "journal", "pub_date", "doi",
                      F.element_at("references", 1)["doi"].alias("ref_doi"), _letters(F.coalesce(F.col("sections")["methods"], F.lit(""))).alias("body_letters"))


def _bioc(t):
    passage = lambda kind, c: F.struct(F.create_map(F.lit("type"), F.lit(kind)).alias("infons"), c.alias("text"))
    doc = F.struct(
        F.create_map(F.lit("doi"), text("10.1/d", num("doc_id")), F.lit("year"), F.lit("2001"), F.lit("journal"), F.col("source")).alias("infons"),
        F.array(passage("front_title", text("Document ", num("doc_id"))), passage("abstract", text("Lang ", F.col("lang"))),
                passage("METHODS", F.col("text")), passage("results", text("n ", num("n_chars"))),
                passage("methods_more", F.col("lang"))).alias("passages"))
    return t.documents.select(num("doc_id").alias("article_id"), F.to_json(F.struct(F.array(doc).alias("documents"))).alias("body"))


@case("S03_parse_bioc", """
select cast(doc_id as string) as article_id, concat('Document ', cast(doc_id as string)) as title, concat('Lang ', lang) as abstract, source as journal, cast(2001 as bigint) as pub_year,
 concat('10.1/d', cast(doc_id as string)) as doi, length(regexp_replace(concat(text, lang), '[^\\p{L}\\p{N}]', '', 'g')) as body_letters from documents""".replace("\\\\", "\\"))
def _(t):
    out = articles.parse_bioc(_bioc(t), "body")
    return out.select("article_id", "title", "abstract", "journal", F.col("pub_year").cast("long").alias("pub_year"), "doi",
                      _letters(F.col("sections")["methods"]).alias("body_letters"))


@case("S04_parse_article", """
select cast(doc_id as string) as article_id, concat('Document ', cast(doc_id as string)) as title, concat('10.1/d', cast(doc_id as string)) as doi from documents""")
def _(t):
    odd = F.col("article_id").cast("long") % 2 == 1
    both = _jats(t).filter(~odd).withColumn("fmt", F.lit("jats")).unionByName(_bioc(t).filter(odd).withColumn("fmt", F.lit("bioc")))
    return articles.parse_article(both, "fmt", "body").select("article_id", "title", "doi")


@case("S01_match_file_index", """
select concat('PMC', cast(o_orderkey as string)) as pmc_id, concat('oa/', cast(o_orderkey as string), '.tar.gz') as path from orders where o_orderkey in (select l_orderkey from lineitem)""")
def _(t):
    index = t.orders.select(text("oa/", num("o_orderkey"), ".tar.gz ").alias("path"), text(" PMC", num("o_orderkey")).alias("pmc_id"),
                            F.lit("CC BY").alias("license"), F.col("o_orderpriority").alias("citation"))
    return K.match_file_index(index, t.lineitem.select(text("PMC", num("l_orderkey")).alias("pmc_id"))).select("pmc_id", "path")


@case("S05_parse_pubmed", """
select cast(o_orderkey as string) as pmid, concat('On 5-LOW & ', cast(o_orderkey as string)) as title, concat('AIM: see ', o_orderstatus, ' plain') as abstract,
 concat('Doe, J', '|', 'Roe, ', o_orderstatus) as authors, concat(cast(extract(year from o_orderdate) as string), '-', case o_orderstatus when 'O' then '03' when 'F' then '11' else '01' end, '-01') as pub_date,
 concat('10.1/', cast(o_orderkey as string)) as doi from orders""")
def _(t):
    month = F.when(F.col("o_orderstatus") == "O", "<Month>Mar</Month>").when(F.col("o_orderstatus") == "F", "<Month>11</Month>").otherwise("")
    xml = text("<PubmedArticle><MedlineCitation><PMID Version='1'>", num("o_orderkey"), "</PMID><Article><Journal><JournalIssue><PubDate><Year>",
               F.year("o_orderdate").cast("string"), "</Year>", month, "</PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>On 5-LOW &amp; ",
               num("o_orderkey"), "</ArticleTitle><Abstract><AbstractText Label='AIM'>see ", F.col("o_orderstatus"), "</AbstractText><AbstractText>plain</AbstractText></Abstract>"
               "<AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><LastName>Roe</LastName><Initials>", F.col("o_orderstatus"),
               "</Initials></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='pubmed'>1</ArticleId><ArticleId IdType='doi'>10.1/",
               num("o_orderkey"), "</ArticleId></ArticleIdList></PubmedData></PubmedArticle>")
    rows = t.orders.select(F.from_xml(xml, feeds.PUBMED_SCHEMA).alias("r")).select("r.*")
    return feeds.parse_pubmed(rows).select("pmid", "title", "abstract", JOIN("authors").alias("authors"), "pub_date", "doi")


@case("S06_normalize_preprints", """
select concat('10.1101/', cast(o_orderkey as string)) as external_id, 'A|B' as authors, cast(extract(year from o_orderdate) as int) as pub_year, case o_custkey % 3 when 0 then 'genetics' when 2 then '' end as category
from orders where o_orderkey % 5 <> 0 and o_custkey % 4 <> 0 and o_custkey % 3 <> 1""")
def _(t):
    rows = t.orders.select(
        F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(text(" 10.1101/", num("o_orderkey"))).alias("doi"), text(" T ", num("o_orderkey")).alias("title"),
        F.when(F.col("o_custkey") % 4 == 0, "short").otherwise(F.repeat(F.lit("word "), F.lit(10))).alias("abstract"), F.lit("A; B;").alias("authors"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_custkey") % 3 == 0, " Genetics").when(F.col("o_custkey") % 3 == 1, "zoology").alias("category"))
    return feeds.normalize_preprints(rows, "biorxiv").select("external_id", JOIN("authors").alias("authors"), "pub_year", "category")


@case("S07_normalize_europepmc", """
select case when o_orderkey % 2 = 0 then concat('10.1101/', cast(o_orderkey as string)) else concat('PPR', cast(o_orderkey as string)) end as external_id, 'medrxiv' as source, concat('T ', cast(o_orderkey as string)) as title,
 cast(10 as bigint) as n_authors from orders where o_custkey % 2 = 0 and o_custkey % 4 <> 0""")
def _(t):
    author = F.struct(F.lit("").alias("fullName"), F.lit("Doe").alias("lastName"))
    rows = t.orders.select(
        text("PPR", num("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, text("10.1101/", num("o_orderkey"))).alias("doi"),
        text("T\n", num("o_orderkey")).alias("title"), F.when(F.col("o_custkey") % 4 == 0, "short").otherwise(F.repeat(F.lit("word "), F.lit(20))).alias("abstractText"),
        F.struct(F.when(F.col("o_custkey") % 2 == 0, "medRxiv").otherwise("bioRxiv").alias("publisher")).alias("bookOrReportDetails"), F.lit("PPR").alias("source"),
        F.struct(F.array_repeat(author, 12).alias("author")).alias("authorList"), F.lit("2020-01-05").alias("firstPublicationDate"), F.lit("2020").alias("pubYear"))
    out = feeds.normalize_europepmc(rows, "medrxiv")
    return out.select("external_id", "source", "title", F.size("authors").cast("long").alias("n_authors"))


@case("S08_normalize_arxiv", """
select concat(cast(o_orderkey as string), 'v2') as external_id, concat('T ', cast(o_orderkey as string)) as title, cast(extract(year from o_orderdate) as int) as pub_year, 'cs.LG|q-bio' as keywords
from orders where o_custkey % 4 <> 0 and o_orderkey % 6 <> 0""")
def _(t):
    xml = text("<entry><id>http://arxiv.org/", F.when(F.col("o_orderkey") % 6 == 0, "pdf/").otherwise("abs/"), num("o_orderkey"), "v2</id><title>T\n", num("o_orderkey"), "</title><summary>",
               F.when(F.col("o_custkey") % 4 == 0, "short").otherwise(F.repeat(F.lit("word "), F.lit(20))), "</summary><published>", F.date_format("o_orderdate", "yyyy-MM-dd"),
               "T00:00:00Z</published><author><name>A</name></author><category term='cs.LG'/><category term='q-bio'/></entry>")
    rows = t.orders.select(F.from_xml(xml, feeds.ARXIV_SCHEMA).alias("r")).select("r.*")
    return feeds.normalize_arxiv(rows).select("external_id", "title", "pub_year", JOIN("keywords").alias("keywords"))


@case("S09_coalesce_metadata", """
select lower(doi) as doi, case when paper_id % 3 = 0 then concat('S2 ', title) else title end as title, case when paper_id % 2 = 0 then 'from pubmed' else 'from s2' end as abstract
from fx_papers where doi is not null""")
def _(t):
    p = t.papers.filter(F.col("doi").isNotNull())
    row = lambda s, title, abstract: p.select(F.lit(s).alias("source"), "doi", title.alias("title"), abstract.alias("abstract"))
    odd = F.col("paper_id") % 2 == 1
    rows = row("pubmed", F.lit("x"), F.lit("from pubmed")).unionByName(
        row("semantic_scholar", text("S2 ", F.col("title")), F.when(odd, "<p>from s2</p>"))).unionByName(
        row("crossref", F.when(F.col("paper_id") % 3 == 0, " ").otherwise(F.col("title")), F.lit("")))
    return metadata.coalesce_metadata(rows).select("doi", "title", "abstract")


@case("S10_scrape_abstract", r"""
with h as (select page_id, concat('<meta name="description" content="', substr(url, 1, 0), regexp_replace(html, '["''<>]', ' ', 'g'), '">') as html from pages),
c as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<meta\s+name=["'']description["'']\s+content=["''](.*?)["'']', 1), '<[^>]+>', '', 'g')) as a from h)
select page_id, case when length(a) > 100 then length(a) end as n_chars from c""")
def _(t):
    pages = t.pages.withColumn("html", text('<meta name="description" content="', F.regexp_replace("html", "[\"'<>]", " "), '">'))
    return metadata.scrape_abstract(pages).select("page_id", F.length("abstract").cast("long").alias("n_chars"))


@case("S10_scrape_raw_pages", r"""
with c as (select page_id, html, trim(regexp_replace(regexp_extract(html, '(?is)<(?:div|section|p)[^>]*(?:class|id)=["''][^"'']*abstract[^"'']*["''][^>]*>(.*?)</(?:div|section|p)>', 1), '<[^>]+>', '', 'g')) as a from pages)
select page_id, length(a) > 100 as found from c""")
def _(t):
    return metadata.scrape_abstract(t.pages).select("page_id", F.col("abstract").isNotNull().alias("found"))


@case("S11_upsert_papers", """
select source, external_id, max(title) as title from (select source, external_id, title from fx_papers union all select 'events', concat('E', cast(user_id as string)), '' from events) u group by 1, 2""")
def _(t):
    existing = t.papers.select("source", "external_id", num("paper_id").alias("paper_id"), "title", "status")
    arriving = t.events.select(F.lit("events").alias("source"), text("E", num("user_id")).alias("external_id"), num("event_id").alias("paper_id"),
                               F.lit("").alias("title"), F.lit("fetched").alias("status"))
    again = existing.withColumn("title", F.lit("changed"))
    return K.upsert_papers(existing, arriving.unionByName(again)).select("source", "external_id", "title")


@case("S12_merge_fulltext", """
select paper_id, case when data_source like 'full_text%' then 'old' when paper_id % 2 = 0 then 'new' end as full_text,
 case when data_source like 'full_text%' or paper_id % 2 = 1 then status else 'parsed' end as status from fx_papers
union all select distinct cast(1000000000 + user_id as bigint), 'new', 'parsed' from events""")
def _(t):
    existing = t.papers.select("source", "external_id", "paper_id", "title", "abstract", "status", "data_source",
                               F.when(F.col("data_source").startswith("full_text"), "old").alias("full_text"))
    new = lambda df, c: df.withColumn("full_text", c)
    arriving = new(t.papers.select("source", "external_id", "paper_id", "title", "abstract"), F.when(F.col("paper_id") % 2 == 0, "new").otherwise(""))
    users = t.events.select(F.lit("events").alias("source"), num("user_id").alias("external_id"), (F.col("user_id") + 1000000000).alias("paper_id"),
                            F.lit("t").alias("title"), F.lit("a").alias("abstract"), F.lit("new").alias("full_text")).distinct()
    return K.merge_fulltext(existing, arriving.unionByName(users)).select("paper_id", "full_text", "status")


@case("S13_patch_parsed", """
select paper_id, case when paper_id % 2 = 0 then 'better' else title end as title, coalesce(case when paper_id % 3 = 0 then 'added' end, abstract) as abstract from fx_papers""")
def _(t):
    parsed = t.papers.select("paper_id", F.when(F.col("paper_id") % 2 == 0, "better").otherwise("").alias("title"),
                             F.when(F.col("paper_id") % 3 == 0, "added").alias("abstract"))
    return K.patch_parsed(t.papers, parsed).select("paper_id", "title", "abstract")


@case("S14_ingest_report", """
with b as (select event_type as run_id, user_id, count(*) as c from events group by 1, 2)
select run_id, cast(sum(c) as bigint) as found, cast(sum(case when user_id % 2 = 1 then 1 else 0 end) as bigint) as new, cast(sum(c) - sum(case when user_id % 2 = 1 then 1 else 0 end) as bigint) as skipped from b group by run_id""")
def _(t):
    batch = t.events.select(F.col("event_type").alias("run_id"), F.lit("events").alias("source"), num("user_id").alias("external_id"))
    known = t.events.filter(F.col("user_id") % 2 == 0).select(F.lit("events").alias("source"), num("user_id").alias("external_id"))
    return K.ingest_report(batch, known)


GRAPH = """
select 'Paper' as name, 'node' as kind, count(*) as n from fx_papers
union all select 'Researcher', 'node', count(*) from (select author as a from fx_papers union select concat(author, ' jr') from fx_papers) r
union all select 'Entity', 'node', count(*) from (select concat('gene', cast(k1 as string)) as e from fx_ext union select concat('protein', cast(k2 as string)) from fx_ext union select concat('disease', cast(k3 as string)) from fx_ext) e
union all select 'Method', 'node', count(distinct s) from fx_ext
union all select c.name, c.kind, c.n from (select count(distinct (paper_id, k1, verb, k3)) + count(distinct case when qty % 2 = 0 then (paper_id, k1, verb, k3) end) as n from fx_ext) x,
 lateral (select 'Claim' as name, 'node' as kind, x.n union all select 'MAKES_CLAIM', 'edge', x.n) c
union all select c.name, c.kind, c.n from (select count(distinct (paper_id, k1, verb, k2, context)) as n from fx_ext) x,
 lateral (select 'Mechanism' as name, 'node' as kind, x.n union all select 'DESCRIBES_MECHANISM', 'edge', x.n) c
union all select 'AUTHORED_BY', 'edge', count(*) * 2 from fx_papers
union all select 'HAS_ENTITY', 'edge', count(*) from (select paper_id, concat('gene', cast(k1 as string)) as e from fx_ext union select paper_id, concat('protein', cast(k2 as string)) from fx_ext union select paper_id, concat('disease', cast(k3 as string)) from fx_ext) e
union all select 'USES_METHOD', 'edge', count(*) from (select distinct paper_id, s from fx_ext) m"""


@case("S15_build_graph", GRAPH)
def _(t):
    nodes, edges = E.build_graph(t.nested_papers(), t.nested_extractions())
    return R.graph_counts(nodes, edges).select("name", "kind", "n")


@case("S15_entity_ids", """
select distinct substr(sha1(lower(concat('gene:E', cast(k1 as string)))), 1, 12) as id from fx_ext""")
def _(t):
    return t.ext.select(scores.short_id(text("gene:E", num("k1"))).alias("id")).distinct()


@case("S16_load_backbone", """
select concat('pw', cast(s_suppkey as string)) as pathway_id, concat('pw', cast(s_suppkey as string), '_edge_00', cast(i as string)) as edge_id, case when i = 0 then 'a' else 'b' end as from_node from supplier, (select 0 as i union all select 1) x""")
def _(t):
    node = lambda i, name, kind: F.struct(F.lit(i).alias("id"), name.alias("name"), F.array(F.lit(i)).alias("aliases"), F.lit(kind).alias("node_type"), F.lit("Defense").alias("operation"))
    edge = lambda a, b: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit("activates").alias("edge_type"))
    pathways = t.supplier.select(text("pw", num("s_suppkey")).alias("id"), F.array(
        node("a", F.col("s_name"), "complex"), node("b", text("N", num("s_nationkey")), "gene")).alias("nodes"), F.array(edge("a", "b"), edge("b", "a")).alias("edges"))
    return E.load_backbone(pathways)[1].select("pathway_id", "edge_id", "from_node")


@case("S17_merge_aliases", """
with seeds as (select distinct case when p_size % 2 = 0 then concat('E', cast(p_partkey as string)) else concat('New', cast(p_partkey as string)) end as canonical_name, p_brand from part)
select coalesce(e.canonical_name, s.canonical_name) as canonical_name, cast(coalesce(case when e.entity_id is null then 0 when e.alias1 = e.alias2 then 1 else 2 end, 0) + case when s.canonical_name is null then 0 else 1 end as bigint) as n_aliases
from fx_entities e full join seeds s on s.canonical_name = e.canonical_name""")
def _(t):
    name = F.when(F.col("p_size") % 2 == 0, text("E", num("p_partkey"))).otherwise(text("New", num("p_partkey")))
    seeds = t.part.select(name.alias("canonical_name"), F.lit("gene").alias("entity_type"), F.array("p_brand").alias("aliases"), F.lit("Defense").alias("primary_operation"))
    return E.merge_aliases(t.nested_entities(), seeds).select("canonical_name", F.size("aliases").cast("long").alias("n_aliases"))


@case("S18_export_bibtex", """
select o_custkey as collection_id, o_orderkey as paper_id, md5(concat_ws(chr(10), concat('@article{', coalesce(replace(replace(p.doi, '/', '_'), '.', '_'), substr(cast(p.paper_id as string), 1, 8)), ','), concat('  title = {', p.title, '},'),
 concat('  author = {', p.author, ' and ', p.author, ' jr},'), concat('  journal = {', p.journal, '},'), concat('  year = {', cast(p.pub_year as string), '},'), '  doi = {' || p.doi || '},', '}', '')) as entry_md5
from orders join fx_papers p on p.paper_id = o_orderkey""")
def _(t):
    members = t.orders.select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("paper_id"))
    return K.export_collection(members, t.nested_papers()).select("collection_id", "paper_id", F.md5("entry").alias("entry_md5"))


@case("S18_export_csv", "select o_custkey as collection_id, o_orderkey as paper_id, concat(p.author, '; ', p.author, ' jr') as authors, substr(coalesce(p.abstract, ''), 1, 200) as abstract from orders join fx_papers p on p.paper_id = o_orderkey")
def _(t):
    members = t.orders.select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("paper_id"))
    return K.export_collection(members, t.nested_papers(), "csv").select("collection_id", "paper_id", "authors", "abstract")


@case("S19_upsert_connections", """
select connection_id, case when paper_a_id % 2 = 0 then 0.99 else confidence end as confidence from fx_connections""".replace("0.99", "cast(0.99 as double)"))
def _(t):
    conns = t.connections.withColumn("created_at", F.col("created_date"))
    flipped = conns.filter(F.col("paper_a_id") % 2 == 0).select(
        "connection_id", F.col("paper_b_id").alias("paper_a_id"), F.col("paper_a_id").alias("paper_b_id"), "connection_type", "description",
        F.lit(0.99).alias("confidence"), "novelty_score", "created_date", "created_at", F.col("connection_id").alias("row_id"))
    return K.upsert_connections(conns, flipped).select("connection_id", "confidence")


@case("S20_upsert_extractions", """
select paper_id, model_id, extraction_id from (select *, row_number() over (partition by paper_id, model_id order by created_date desc, extraction_id desc) rn from fx_ext) e where rn = 1""")
def _(t):
    new = t.nested_extractions().withColumn("row_id", F.col("extraction_id"))
    old = t.nested_extractions().dropDuplicates(["paper_id", "model_id"]).withColumn("extraction_id", F.lit("old"))  # all replaced
    return K.upsert_extractions(old, new).select("paper_id", "model_id", "extraction_id")


@case("S20_upsert_critiques", """
select critique_id, case when paper_id % 3 = 0 then 'new' else overall_quality end as overall_quality from fx_critiques""")
def _(t):
    old = t.critiques.withColumn("model_id", F.col("critique_id"))
    new = old.filter(F.col("paper_id") % 3 == 0).withColumns({"overall_quality": F.lit("new"), "row_id": F.col("critique_id")})
    return K.upsert_critiques(old, new).select("critique_id", "overall_quality")


@case("S20_sync_claims", """
select distinct paper_id, md5(concat('E', cast(k1 as string), ' ', verb, ' E', cast(k3 as string))) as text_hash from fx_ext union all select -1, 'kept'""")
def _(t):
    kept = t.claims.select(F.lit("c").alias("claim_id"), F.lit(-1).cast("long").alias("paper_id"), "extraction_id", "claim_text", "claim_type", "subject",
                           "predicate", "object", "confidence", F.lit("kept").alias("text_hash")).dropDuplicates(["paper_id", "text_hash"])
    once = K.sync_claims(t.nested_extractions(), kept.drop("claim_id"))
    return K.sync_claims(t.nested_extractions(), once).select("paper_id", "text_hash")


def _scratch(spark, what: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "litgraph", f"{what}-{uuid.uuid4().hex}")


@case("S21_refresh_extended_edges", "select source_entity_name, target_entity_name, lower(source_entity_name) as source_key from fx_edges")
def _(t):
    snap = K.refresh_extended_edges(t.edges, _scratch(t.spark, "edges"))
    return snap.select("source_entity_name", "target_entity_name", "source_key")


@case("S22_bridge_cache", """
select least(lower(event_type), concat('u', cast(user_id as string))) as concept_a, greatest(lower(event_type), concat('u', cast(user_id as string))) as concept_b, count(*) as query_count,
 arg_max(event_id, ts) as result from events group by 1, 2""")
def _(t):
    swap = F.col("event_id") % 2 == 0
    a, b = text(" ", F.upper("event_type")), text("U", num("user_id"), " ")
    req = t.events.select(F.when(swap, a).otherwise(b).alias("concept_a"), F.when(swap, b).otherwise(a).alias("concept_b"),
                          F.col("event_id").alias("result"), "ts", F.col("event_id").alias("request_id"))
    return K.bridge_cache(req)


# --- F ---------------------------------------------------------------------------------------------

@case("F01_norm_key", r"""
select doc_id, length(regexp_replace(lower(text), '[^\p{L}\p{N}_-]', '', 'g')) as n from documents""")
def _(t):
    return t.documents.select("doc_id", F.length(F.regexp_replace(X.norm_key(F.col("text")), r"[^\p{L}\p{N}_-]", "")).cast("long").alias("n"))


@case("F02_canonical_form", """
select p_partkey, concat(lower(p_name), ' fatty acids') as form, case when length(p_brand) between 2 and 30 then p_brand else '' end as extra from part""")
def _(t):
    raw = text(' "', F.upper("p_name"), "  (", F.col("p_brand"), ") fatty acids.")
    return t.part.select("p_partkey", X.canonical_form(raw).alias("form"), JOIN(X.paren_extras(raw)).alias("extra"))


@case("F03_clean_entity", r"select doc_id, case when length(s) between 1 and 200 then length(s) end as n from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from documents) d")
def _(t):
    return t.documents.select("doc_id", F.length(X.clean_entity(F.col("text"))).cast("long").alias("n"))


@case("F05_predicate_types", """
select extraction_id, replace(replace(lower(verb), '-', '_'), ' ', '_') as predicate, case lower(verb) when 'activates' then 'activates' when 'reduces' then 'downregulates' when 'blocks' then 'blocks'
 when 'depends on' then 'requires' when 'restores' then 'rescues' else 'correlates_with' end as predicate_type, case when verb in ('binds', 'up-regulates') then 'associative' when verb = 'depends on' then 'mechanistic' else 'causal' end as direction from fx_ext""")
def _(t):
    p = V.norm_predicate(F.col("verb"))
    return t.ext.select("extraction_id", p.alias("predicate"), V.predicate_type(p).alias("predicate_type"), V.direction(V.predicate_type(p)).alias("direction"))


@case("F08_evidence_type", """
select study_design, case study_design when 'rct' then 'RCT' when 'cohort' then 'cohort' when 'in vitro' then 'in_vitro' when 'Case-Control' then 'case_control' end as evidence_type, count(*) as n from fx_ext group by 1""")
def _(t):
    return t.ext.groupBy("study_design", V.evidence_type(F.col("study_design")).alias("evidence_type")).agg(F.count(F.lit(1)).alias("n"))


@case("F10_section_key", """
select event_id, case event_type when 'view' then 'introduction' when 'click' then 'methods' when 'purchase' then 'conclusion' when 'signup' then 'funding' else 'other' end as section from events""")
def _(t):
    named = {"view": "General BACKGROUND", "click": "Study protocol", "purchase": "Closing remarks", "signup": "Financial support"}
    title = F.coalesce(V.mapped(F.col("event_type"), named), F.lit("Appendix"))
    return t.events.select("event_id", X.section_key(title).alias("section"))


@case("F11_study_fields", """
select extraction_id, case study_design when 'Case-Control' then 'case_control' when 'in vitro' then 'in_vitro' else study_design end as design, case when qty % 3 = 0 then null else cast(1000 + qty as int) end as size,
 case when qty % 2 = 0 then 0.5 else 1.0 end::double as conf from fx_ext""")
def _(t):
    size = F.when(F.col("qty") % 3 == 0, "n/a").otherwise(text("n = ", F.format_string("1,0%02d", "qty"), " people"))
    conf = F.when(F.col("qty") % 2 == 0, "sure").otherwise("3.5")
    return t.ext.select("extraction_id", V.study_design(F.col("study_design")).alias("design"), V.sample_size(size).alias("size"), V.clamp_confidence(conf).alias("conf"))


@case("F12_flexible_date", """
select event_id, case event_id % 3 when 0 then cast(ts as date) when 1 then date '2024-01-01' end as day from events""")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, "2024").otherwise("2024-13-45")
    return t.events.select("event_id", X.flexible_date(raw).alias("day"))


@case("F13_first_name", "select c_custkey, case when c_custkey % 2 = 0 then 'Ann' else 'Customer' end as first_name from customer")
def _(t):
    who = F.when(F.col("c_custkey") % 2 == 0, text(F.col("c_name"), ", Ann B")).otherwise(F.regexp_replace("c_name", "#", " "))
    return t.customer.select("c_custkey", X.first_name(who).alias("first_name"))


@case("F14_emails", r"""
select doc_id, cast(len(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}'))) as bigint) as n from documents""")
def _(t):
    return t.documents.select("doc_id", F.size(X.emails(F.col("text"))).cast("long").alias("n"))


@case("F15_densities", """
select claim_id, case claim_type when 'causal' then 'Conduction' when 'mechanistic' then 'Transduction' when 'associative' then 'Reception' else 'Synthesis' end as operation,
 case when confidence >= 0.8 then 'body' when confidence >= 0.5 then 'soul' else 'spirit' end as density from fx_claims""")
def _(t):
    return t.claims.select("claim_id", V.claim_operation(F.col("claim_type")).alias("operation"), V.confidence_density(F.col("confidence")).alias("density"))


@case("F16_ellipsis", "select doc_id, case when length(text) > 200 then concat(substr(text, 1, 197), '...') else text end as short from documents")
def _(t):
    return t.documents.select("doc_id", X.ellipsis(F.col("text"), 200).alias("short"))


@case("F17_token_cost", """
select event_id, round(case event_type when 'click' then user_id / 1e6 * 2.5 + event_id / 1e6 * 10 when 'view' then user_id / 1e6 * 15 + event_id / 1e6 * 60 else user_id / 1e6 * 3 + event_id / 1e6 * 15 end + 1e-10, 6) as usd from events""")
def _(t):
    model = F.when(F.col("event_type") == "click", "gpt-4o").when(F.col("event_type") == "view", "o1").otherwise("unlisted")
    return t.events.select("event_id", F.round(V.token_cost(model, F.col("user_id"), F.col("event_id")) + 1e-10, 6).alias("usd"))


@case("F18_cosine", """
with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings)
select a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) as sim from e a join e b on b.vec_id = a.vec_id + 1""")
def _(t):
    a = t.embeddings.select("vec_id", "embedding")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


@case("F20_keys", "select paper_id, md5(concat(source, '|', external_id)) as key, substr(sha1(lower(trim(title))), 1, 12) as short from fx_papers")
def _(t):
    return t.papers.select("paper_id", F.md5(text(F.col("source"), "|", F.col("external_id"))).alias("key"), scores.short_id(F.col("title")).alias("short"))


@case("F21_strip_tags", "select page_id, length(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g')) as n from pages")
def _(t):
    return t.pages.select("page_id", F.length(X.strip_tags(X.strip_comments(F.col("html")))).cast("long").alias("n"))


@case("F21_balanced_object", "select event_id, concat('{\"p\": ', props, '}') as obj from events")
def _(t):
    noisy = text("Answer: ", '{"p": ', F.col("props"), "} and {more", " text")
    return t.events.select("event_id", X.balanced_object(noisy).alias("obj"))


@case("F22_epistemic_class", """
select evidence_strength, case evidence_strength when 'strong' then 'fact' when 'moderate' then 'interpretation' else 'hypothesis' end as class, count(*) as n from fx_claims group by 1""")
def _(t):
    return t.claims.groupBy("evidence_strength", V.epistemic_class(F.col("evidence_strength")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@case("F23_predicate_phrases", """
select predicate_type, case predicate_type when 'correlates_with' then 'correlates with' else predicate_type end as phrase, count(*) as n from fx_edges group by 1""")
def _(t):
    return t.edges.groupBy("predicate_type", V.predicate_phrase(F.col("predicate_type")).alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@case("F24_json_strings", "select event_id, case when event_id % 2 = 0 then event_type else '' end as items from events")
def _(t):
    raw = F.when(F.col("event_id") % 2 == 0, text('["', F.col("event_type"), '"]')).otherwise(F.lit("not json"))
    return t.events.select("event_id", JOIN(X.json_strings(raw)).alias("items"))


@case("F25_templates", """
select p_partkey, concat(p_name, ' risk', '|', 'plain') as filled, cast(1 as bigint) as without from part""")
def _(t):
    tpl = F.array(F.lit("{condition} risk"), F.lit("plain"), F.lit("PLAIN"))
    fill = lambda cond: X.distinct_ci(F.transform(tpl, lambda x: X.fill_template(x, cond)))
    return t.part.select("p_partkey", JOIN(fill(F.col("p_name"))).alias("filled"), F.size(fill(F.lit(" "))).cast("long").alias("without"))


# --- X ---------------------------------------------------------------------------------------------

TOK = r"list_filter(string_split_regex(lower(concat_ws(' ', title, abstract)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


DEGREES = "select me, count(distinct connection_id) as n from fx_half group by me"


@case("X04_search", f"""
with w as (select paper_id, unnest({TOK}) as term from fx_docs), tf as (select paper_id, term, count(*) as tf from w where term in ('that', 'the', 'document') group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
r as (select tf.paper_id, round(sum(tf.tf * ln(1.0 + (select count(*) from fx_docs)::double / df.df)), 4) as rank from tf join df on df.term = tf.term group by 1 having count(*) = 3)
select r.paper_id, rank, coalesce(d.n, 0) as connection_count from r left join ({DEGREES}) d on d.me = r.paper_id order by rank desc, d.n desc nulls last, r.paper_id limit 20""")
def _(t):
    out = S.search(t.docs, t.connections, "The that Document", limit=20)
    return out.select("paper_id", F.round("rank", 4).alias("rank"), "connection_count")


@case("X04_search_web", f"""
with w as (select paper_id, unnest({TOK}) as term from fx_docs), h as (select paper_id, list(distinct term) as ts from w group by 1)
select h.paper_id, cast(len(list_filter(ts, lambda x: x in ('und', 'que', 'de'))) as bigint) as terms, coalesce(d.n, 0) as connection_count
from h left join ({DEGREES}) d on d.me = h.paper_id
where list_contains(ts, 'und') or (list_contains(ts, 'que') and list_contains(ts, 'de') and not list_contains(ts, 'the'))""")
def _(t):
    return S.search(t.docs, t.connections, "und or que -the de", mode="web", limit=None).select("paper_id", "terms", "connection_count")


@case("X04_search_phrase", f"""
select paper_id from fx_docs where contains(concat(' ', array_to_string({TOK}, ' '), ' '), ' of the ') and not contains(concat(' ', array_to_string({TOK}, ' '), ' '), ' in the ')""")
def _(t):
    return S.search(t.docs, t.connections, '"of the" -"in the"', mode="web", limit=None).select("paper_id")


@case("X04_search_substring", "select paper_id from fx_papers where contains(lower(title), 'per 12') or contains(lower(abstract), 'per 12') order by published_date desc nulls last, paper_id limit 20")
def _(t):
    return S.search_substring(t.papers, "PER 12").select("paper_id")


@case("X04_search_prefix", f"""
with w as (select paper_id, unnest({TOK}) as term from fx_docs) select paper_id, count(distinct p) as terms from (
 select paper_id, 'tion' as p from w where starts_with(term, 'tion') union all select paper_id, 'wh' from w where starts_with(term, 'wh')) x group by 1""")
def _(t):
    return S.search(t.docs, t.connections, "tion wh", mode="prefix_or", limit=None).select("paper_id", "terms")


@case("X04_term_index", f"""
with w as (select paper_id, unnest({TOK}) as term from fx_docs) select term, count(distinct paper_id) as df, count(*) as tf from w group by term""")
def _(t):
    idx = S.term_index(t.docs)
    return idx.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


RULES = {"confidence in 0..1": lambda: F.col("confidence").between(0.6, 1.0), "known type": lambda: F.col("connection_type").isin("extends", "contradicts"),
         "pair ordered": lambda: F.col("paper_a_id") < F.col("paper_b_id")}


@case("X05_validate_good", "select connection_id from fx_connections where confidence between 0.6 and 1.0 and connection_type in ('extends', 'contradicts')")
def _(t):
    return W.validate(t.connections, {k: f() for k, f in RULES.items()})[0].select("connection_id")


@case("X05_validate_quarantine", """
select connection_id, concat_ws('|', case when confidence < 0.6 then 'confidence in 0..1' end, case when connection_type not in ('extends', 'contradicts') then 'known type' end) as reasons
from fx_connections where confidence < 0.6 or connection_type not in ('extends', 'contradicts')""")
def _(t):
    return W.validate(t.connections, {k: f() for k, f in RULES.items()})[1].select("connection_id", JOIN("reasons").alias("reasons"))


@case("X06_parse_extraction_xml", """
select extraction_id, case study_design when 'Case-Control' then 'case_control' when 'in vitro' then 'in_vitro' else study_design end as study_design, cast(qty as int) as sample_size, concat('E', cast(k1 as string)) as entity, conf as confidence,
 concat('E', cast(k1 as string), ' ', verb) as claim, 'Defense' as primary_operation, cast(1 as bigint) as n_findings from fx_ext""")
def _(t):
    xml = text("Sure:\n<extraction><!-- note --><study_design>", F.col("study_design"), "</study_design><sample_size>n=", num("qty"), "</sample_size><population>null</population><key_findings><finding>f</finding>"
               "<finding> </finding></key_findings><entities><entity type='gene' confidence='", num("conf"), "'> E", num("k1"), "</entity></entities><claims><claim type='causal' subject='a' predicate='b' object='c' "
               "operations='Defense, Synthesis' confidence='7'><text>E", num("k1"), " ", F.col("verb"), "</text></claim></claims><mechanisms><mechanism confidence='0.4'><description>d</description></mechanism></mechanisms>"
               "<operation><primary>Defense</primary><secondary>Magic,Synthesis</secondary></operation></extraction> done")
    out = model_output.parse_extraction_xml(t.ext.select("extraction_id", xml.alias("response")))
    return out.select("extraction_id", "study_design", "sample_size", F.element_at("entities", 1)["text"].alias("entity"), F.element_at("entities", 1)["confidence"].alias("confidence"),
                      F.element_at("claims", 1)["text"].alias("claim"), "primary_operation", F.size("key_findings").cast("long").alias("n_findings"))


@case("X07_parse_validation_json", """
select connection_id, connection_type, case when paper_a_id % 2 = 0 then confidence else 0.5 end as confidence from fx_connections where connection_type <> 'replicates' and paper_b_id % 3 <> 0""")
def _(t):
    conf = F.when(F.col("paper_a_id") % 2 == 0, text(', "confidence": ', num("confidence"))).otherwise("")
    body = text("```json\n{\"connected\": ", F.when(F.col("paper_b_id") % 3 == 0, "false").otherwise("true"), ', "connection_type": "', F.col("connection_type"), '"', conf, "}\n```")
    out = model_output.parse_validation_json(t.connections.select("connection_id", body.alias("response")))
    return out.select("connection_id", "connection_type", "confidence")


@case("X08_parse_critique_json", """
select critique_id, case when created_at % 3 = 0 then 'medium' else overall_quality end as overall_quality, case when created_at % 3 = 0 then 5.0 else methodology_score end as methodology_score, created_at % 3 = 0 as failed from fx_critiques""")
def _(t):
    ok = text("Here it is: {\"overall_quality\": \"", F.col("overall_quality"), '", "methodology_score": ', num("methodology_score"), ', "strengths": ["x"]} as asked')
    out = model_output.parse_critique_json(t.critiques.select("critique_id", F.when(F.col("created_at") % 3 == 0, "no idea").otherwise(ok).alias("response")))
    return out.select("critique_id", "overall_quality", "methodology_score",
                      F.array_contains("weaknesses", "Could not parse response").alias("failed"))


@case("X10_outreach_eligibility", """
select c.connection_id, case when p.author is null then 'x' when p.paper_id % 5 = 0 then 'no author email found' when p.paper_id % 7 = 0 then 'unsubscribed' when p.paper_id % 11 = 0 then '90-day cooldown' else 'eligible' end as reason
from fx_connections c join fx_papers p on p.paper_id = c.paper_a_id where c.confidence >= 0.7 and c.connection_type <> 'extends'""")
def _(t):
    mail = text("A", num("paper_id"), "@X.org ")
    papers = t.papers.withColumn("to_email", F.when(F.col("paper_id") % 5 != 0, mail))
    every = lambda m: t.papers.filter(F.col("paper_id") % m == 0)
    sends = every(11).select(mail.alias("email"), F.lit("2024-05-01").cast("timestamp").alias("sent_at")).unionByName(
        every(13).select(mail.alias("email"), F.lit("2023-05-01").cast("timestamp").alias("sent_at")))
    queued = t.connections.filter(F.col("connection_type") == "extends").select("connection_id")
    out = O.outreach_eligibility(t.connections, papers, queued, sends, every(7).select(mail.alias("email")), "2024-06-01 00:00:00")
    return out.select("connection_id", "reason")


@case("X12_contacts", """
select paper_id, case when paper_id % 2 = 0 then concat('a', cast(paper_id as string), '@x.org') else concat('given', cast(paper_id as string)) end as to_email, concat(author, ' jr') as to_name from fx_papers""")
def _(t):
    meta = F.when(F.col("paper_id") % 2 == 0, text('{"x":["write to a', num("paper_id"), '@x.org now"]}')).otherwise("{}")
    papers = t.nested_papers().withColumns({"raw_metadata": meta, "contact_email": text("given", num("paper_id"))})
    return O.contacts(papers).select("paper_id", "to_email", "to_name")


@case("X13_schedule", """
with q as (select n_name as query, n_regionkey as ring, n_nationkey % 3 as priority from nation), r as (select *, row_number() over (order by ring, priority desc, query) as position from q)
select query, position, cast(least(10, 200 - (position - 1) * 10) as bigint) as query_limit from r where 200 - (position - 1) * 10 > 0""")
def _(t):
    q = t.nation.select(F.col("n_name").alias("query"), F.col("n_regionkey").alias("ring"), (F.col("n_nationkey") % 3).alias("priority"))
    return O.schedule(q, 200).select("query", F.col("position").cast("long").alias("position"), F.col("query_limit").cast("long").alias("query_limit"))


@case("X04_related_by_terms")
def _(t):
    pe = t.docs.select("paper_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("abstract"), r"[^\p{L}]+"), lambda w: F.length(w) > 4))).alias("entity"))
    return S.related_by_terms(1, t.docs, t.nested_extractions(), pe).select("paper_id", "overlap", "rank")


# --- T ---------------------------------------------------------------------------------------------

def _stream(t, name: str):
    """The table as a stream, be it one file or a folder of files; as a glob the path may be either."""
    return t.spark.readStream.schema(t.base(name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def _drain(t, df, what: str, mode: str = "append"):
    """Run a stream over all its input into parquet and read it back."""
    out, ckpt = _scratch(t.spark, what), _scratch(t.spark, f"{what}-ckpt")

    last = []

    def write(batch, i):
        batch.write.mode("overwrite").parquet(os.path.join(out, f"b={i}"))
        last[:] = [f"b={i}"]

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "complete":  # every batch writes the whole table: the last one counts
        out = os.path.join(out, *last)
    return t.spark.read.option("recursiveFileLookup", "true").schema(df.schema).parquet(out)


@case("T01_refresh_stream", f"""
select concat('E', cast(s as string)) as source_entity_name, concat('E', cast(o as string)) as target_entity_name, predicate_type, count(distinct paper_id) as support_count
from (select paper_id, k1 as s, k2 as o, {VERBS} as predicate_type from fx_ext union all select paper_id, k1, k3, {VERBS} from fx_ext) x
where s <> o and predicate_type is not null group by 1, 2, 3""")
def _(t):
    claims = t.claims.withColumn("operations", F.array().cast("array<string>"))
    folders = [_scratch(t.spark, w) for w in ("claims-in", "extractions-in")]
    live = []
    for rows, folder in zip((claims, t.nested_extractions()), folders):
        rows.repartition(2, F.xxhash64("extraction_id")).write.parquet(folder)
        live.append(t.spark.readStream.schema(t.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder))
    out, ckpt = (_scratch(t.spark, w) for w in ("refresh", "refresh-ckpt"))
    T.refresh_stream(*live, t.nested_entities(), out, ckpt, {"availableNow": True}, 8).awaitTermination()
    return t.spark.read.parquet(f"{out}/edges").select(*E.EDGE_KEY, "support_count")


@case("T02_dedupe_stream", "select distinct event_type as source, cast(user_id as string) as external_id from events")
def _(t):
    ev = _stream(t, "events").select("ts", F.col("event_type").alias("source"), num("user_id").alias("external_id"))
    return _drain(t, T.dedupe_stream(ev, "60 days"), "dedupe").select("source", "external_id")


# Append mode gives a day once the watermark, an hour behind the newest row, has passed its end.
@case("T03_spend_stream", """
select cast(ts as date) as day, event_type as task, count(*) as calls, round(sum(value), 2) as cost_usd from events group by 1, 2
having cast(ts as date) + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def _(t):
    ev = _stream(t, "events").select("ts", F.col("event_type").alias("task"), F.col("value").alias("cost_usd"))
    return _drain(t, T.spend_stream(ev, "1 hour"), "spend").select("day", "task", "calls", F.round("cost_usd", 2).alias("cost_usd"))


@case("T04_suppression_stream", """
select concat('u', cast(user_id as string)) as email, cast(sum(case when rn = 1 then 0 else 1 end) as bigint) as suppressed, count(*) as sends from (select *, row_number() over (partition by user_id order by ts, event_id) rn from events) e group by 1""")
def _(t):
    sends = _stream(t, "events").select(text(" U", num("user_id")).alias("email"), F.col("ts").alias("sent_at"))
    out = _drain(t, T.suppression_stream(sends), "suppress")
    return out.groupBy("email").agg(F.count_if("suppressed").alias("suppressed"), F.count(F.lit(1)).alias("sends"))


@case("T04_suppression", """
with recursive a as (select user_id, min(ts) as ts from events group by user_id
 union all select e.user_id, min(e.ts) from a join events e on e.user_id = a.user_id and e.ts > a.ts + interval 1 day group by e.user_id),
f as (select e.user_id, min(event_id) as event_id from events e join a on a.user_id = e.user_id and a.ts = e.ts group by e.user_id, e.ts)
select event_id, event_id not in (select event_id from f) as suppressed from events""")
def _(t):
    sends = t.events.select("event_id", F.col("event_id").alias("send_id"), num("user_id").alias("email"), F.col("ts").cast("timestamp").alias("sent_at"))
    return T.suppression(sends, 1).select("event_id", "suppressed")


@case("T05_watchlist_matches", """
select concat('a', cast(c_custkey as string)) as watchlist_id, paper_id from customer join fx_papers on author = concat('Author ', cast(c_custkey as string))
union all select concat('t', topic), paper_id from (select distinct paper_id, topic from (select paper_id, topic1 as topic from fx_papers union all select paper_id, topic2 from fx_papers) x) y
union all select 'q', paper_id from fx_papers where regexp_matches(lower(concat_ws(' ', title, abstract)), '(^|[^0-9a-z_])urgent([^0-9a-z_]|$)') and regexp_matches(lower(concat_ws(' ', title, abstract)), '(^|[^0-9a-z_])12([^0-9a-z_]|$)')""")
def _(t):
    watch = lambda df, i, kind, v: df.select(i.alias("watchlist_id"), F.lit(kind).alias("watch_type"), v.alias("watch_value")).distinct()
    tags = t.nested_papers().select(F.explode("topic_tags").alias("tag"))
    lists = watch(t.customer, text("a", num("c_custkey")), "author", text("AUTHOR ", num("c_custkey"))).unionByName(
        watch(tags, text("t", F.col("tag")), "entity", F.col("tag"))).unionByName(watch(t.region, F.lit("q"), "query", F.lit("12 urgent")))
    return T.watchlist_matches(t.nested_papers().withColumn("entities", F.col("topic_tags")), lists)


@case("T05_watchlist_stream", "select source as watchlist_id, count(*) as new_count from documents group by source")
def _(t):
    lists = t.documents.select(F.col("source").alias("watchlist_id"), F.lit("entity").alias("watch_type"), F.col("source").alias("watch_value")).distinct()
    none = F.array().cast("array<string>")
    docs = _stream(t, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("").alias("title"), F.col("lang").alias("abstract"), F.array("source").alias("entities"), none.alias("authors"))
    return _drain(t, T.watchlist_stream(docs, lists), "watch", "complete")


SETTLE = """
with c as (select event_type as series, cast(ts as date) as d, count(*) as c from events group by 1, 2),
n as (select series, cast(row_number() over (partition by series order by d) as bigint) as poll, cast(sum(c) over (partition by series order by d) as bigint) as n from c),
g as (select *, n - lag(n) over (partition by series order by poll) as growth from n),
m as (select *, coalesce(growth < 70, false) as calm, sum(case when coalesce(growth < 70, false) then 0 else 1 end) over (partition by series order by poll) as run from g)
select series, poll, cast(sum(case when calm then 1 else 0 end) over (partition by series, run order by poll) as bigint) as streak from m"""


def _counts(t):
    from pyspark.sql import Window

    per_day = t.events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("series").orderBy("d")
    return per_day.select("series", F.row_number().over(w).cast("long").alias("poll"), F.sum("c").over(w).alias("n"))


@case("T06_settling", SETTLE)
def _(t):
    return T.settling(_counts(t), growth=70).select("series", "poll", "streak")


@case("T06_settling_stream", SETTLE)
def _(t):
    src = _scratch(t.spark, "polls")
    counts = _counts(t)
    counts.write.parquet(src)
    live = t.spark.readStream.schema(counts.schema).parquet(src)
    return _drain(t, T.settling_stream(live, growth=70), "settle").select("series", "poll", "streak")


@case("T07_split_immediate", """
select case when confidence >= 0.9 then 'immediate' else 'nightly' end as route, count(*) as n from fx_connections group by 1""")
def _(t):
    now, later = T.split_immediate(t.connections)
    return R.count_by(J.union_sources(now.select(F.lit("immediate").alias("route")), later.select(F.lit("nightly").alias("route"))), "route")


# --- remaining building blocks ---------------------------------------------------------------------

@case("F04_norm_predicate", "select verb, replace(replace(lower(verb), '-', '_'), ' ', '_') as predicate, count(*) as n from fx_ext group by verb")
def _(t):
    return t.ext.groupBy("verb", V.norm_predicate(F.col("verb")).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


@case("F06_direction", """
select predicate_type, case when predicate_type = 'requires' then 'mechanistic' when predicate_type = 'correlates_with' then 'associative' else 'causal' end as direction, count(*) as n from fx_edges group by 1""")
def _(t):
    return t.edges.groupBy("predicate_type", V.direction(F.col("predicate_type")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@case("F07_context_type", """
select p_name, case when contains(p_name, 'cold') then 'condition' else 'unknown' end as context_type, count(*) as n from part group by 1, 2
union all select concat('aged ', p_name), 'condition', count(*) from part group by 1""")
def _(t):
    names = t.part.select(F.explode(F.array(F.col("p_name"), text("aged ", F.col("p_name")))).alias("p_name"))
    return names.groupBy("p_name", V.context_type(F.col("p_name")).alias("context_type")).agg(F.count(F.lit(1)).alias("n"))


@case("F09_pathway_edge_types", """
select p_partkey, case p_size % 4 when 0 then 'is_upstream_of' when 1 then 'requires' when 2 then 'inhibits' else 'correlates_with' end as predicate_type,
 case p_size % 4 when 0 then 'mechanistic' when 1 then 'mechanistic' when 2 then 'associative' else 'associative' end as direction from part""")
def _(t):
    kind = F.when(F.col("p_size") % 4 == 0, "converts_to").when(F.col("p_size") % 4 == 1, "transports").when(F.col("p_size") % 4 == 2, "degrades").otherwise("binds")
    return t.part.select("p_partkey", V.pathway_predicate(kind).alias("predicate_type"), V.pathway_direction(kind).alias("direction"))


@case("F19_scores", """
select extraction_id, round(1 / (1 + exp(-(conf - nov))), 6) as sig, round(exp((ln(greatest(conf, 0.01)) + ln(greatest(nov, 0.01))) / 2), 6) as geo from fx_ext""")
def _(t):
    return t.ext.select("extraction_id", F.round(scores.sigmoid(F.col("conf") - F.col("nov")), 6).alias("sig"),
                        F.round(scores.geomean(F.array("conf", "nov")), 6).alias("geo"))


@case("L04_cap", "select connection_id, confidence from fx_connections order by confidence desc, connection_id limit 500")
def _(t):
    return J.cap(t.connections.select("connection_id", "confidence"), [F.desc("confidence"), F.asc("connection_id")], 500)


@case("J15_self_extend", """
select a.edge_key as first, b.edge_key as second from fx_edges a join fx_edges b on b.source_entity_name = a.target_entity_name where b.target_entity_name <> a.source_entity_name""")
def _(t):
    from litgraph.operators.paths import self_extend

    e = t.edges.withColumn("pred", F.col("edge_key"))
    steps = e.select(F.lower("source_entity_name").alias("from_key"), F.lower("target_entity_name").alias("to_key"), F.col("target_entity_name").alias("to_name"), "pred",
                     F.col("target_operation").alias("to_op"), F.col("edge_source").alias("src"), F.col("support_count").alias("support"),
                     F.col("mean_confidence").alias("conf"), F.col("contradiction_load").alias("contra"))
    start = e.select(F.array(F.lower("source_entity_name"), F.lower("target_entity_name")).alias("path_keys"), F.array("source_entity_name", "target_entity_name").alias("path_names"),
                     F.array("pred").alias("preds"), F.array("source_operation", "target_operation").alias("ops"), F.array("edge_source").alias("edge_sources"),
                     F.array("support_count").alias("supports"), F.array("mean_confidence").alias("confs"), F.col("contradiction_load").alias("contra_load"),
                     F.lower("target_entity_name").alias("last_key"), F.lit(1).alias("hops"))
    out = self_extend(start, steps)
    return out.select(F.element_at("preds", 1).alias("first"), F.element_at("preds", 2).alias("second"))


@case("J08_close_pairs", """
with e as (select vec_id, cast(embedding as double[]) as v from embeddings)
select a.vec_id as paper_a_id, b.vec_id as paper_b_id, cast(round_even(list_cosine_similarity(a.v, b.v) * 10, 0) as bigint) as shared_count from e a join e b on a.vec_id < b.vec_id
where list_cosine_similarity(a.v, b.v) >= 0.3""")
def _(t):
    from litgraph.operators.pairs import similar_pairs

    return similar_pairs(t.embeddings, 0.3, None).select("paper_a_id", "paper_b_id", "shared_count")
