"""Full-text article records: JATS XML and BioC JSON."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections import Counter
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from litgraph.functions.text import nonempty, section_key
from litgraph.lookups import SECTION_PATTERNS

ARTICLE_SCHEMA = (
    "article_id string, title string, abstract string, authors array<string>, journal string, pub_date string, "
    "pub_year int, doi string, sections map<string,string>, references array<struct<ref_id:string,title:string,"
    "authors:string,year:string,doi:string,pmid:string>>, reference_count int, full_text string"
)
BODY_ORDER = ("introduction", "methods", "results", "discussion", "conclusion")


def plain_bytes(body) -> bytes | None:
    """The document without gzip; None if the archive is cut or broken."""
    raw = bytes(body) if isinstance(body, (bytes, bytearray)) else (body or "").encode()
    if raw[:2] != b"\x1f\x8b":
        return raw
    try:
        return gzip.decompress(raw)
    except (OSError, EOFError, zlib.error):
        return None


@F.pandas_udf(StringType())
def unpacked(bodies: pd.Series) -> pd.Series:
    """Text of binary bodies; null where there is none."""
    def text(body):
        raw = None if body is None else plain_bytes(body)
        return None if raw is None else raw.decode("utf-8", "replace")
    return bodies.map(text)


def _inner(el) -> str:
    return "".join(el.itertext()).strip()


def _cited(ref) -> dict:
    """A reference, from the first element of each kind below it."""
    first, people = {}, []
    for el in ref.iter():
        kind = f"id:{el.get('pub-id-type')}" if el.tag == "pub-id" and (el.text or "").strip() else el.tag
        first.setdefault(kind, el)
        if el.tag == "person-group" and el.get("person-group-type") == "author":
            people += [" ".join(filter(None, (n.findtext("surname"), n.findtext("given-names")))) for n in el.iterfind("name")]
    said = lambda kind: first[kind].text.strip() if kind in first and first[kind].text else None
    title = first.get("article-title", first.get("source"))
    return {"ref_id": ref.get("id"), "title": None if title is None else _inner(title), "authors": "; ".join(people) or None,
            "year": said("year"), "doi": said("id:doi"), "pmid": said("id:pmid")}


def _section(sec) -> tuple[str, str]:
    text = " ".join(filter(None, map(_inner, sec.iterfind("p"))))
    title = sec.find("title")
    return ("" if title is None else _inner(title)), text


# Parts of a document: name, tag, attribute and value, tag that must be open around it, what is taken.
PARTS = (
    ("title", "article-title", None, None, _inner),
    ("abstract", "abstract", None, None, lambda el: " ".join(filter(None, map(_inner, el.iter("p")))) or _inner(el)),
    ("author", "contrib", ("contrib-type", "author"), None,
     lambda el: ", ".join(filter(None, (next((x.text for x in el.iter(t)), None) for t in ("surname", "given-names"))))),
    ("journal", "journal-title", None, None, lambda el: (el.text or "").strip()),
    ("journal_nlm", "journal-id", ("journal-id-type", "nlm-ta"), None, lambda el: (el.text or "").strip()),
    ("journal_iso", "journal-id", ("journal-id-type", "iso-abbrev"), None, lambda el: (el.text or "").strip()),
    ("doi", "article-id", ("pub-id-type", "doi"), None, lambda el: (el.text or "").strip()),
    ("date", "pub-date", None, None, lambda el: (el.get("pub-type"), *(el.findtext(t) for t in ("year", "month", "day")))),
    ("section", "sec", None, "body", _section),
    ("body", "body", None, None, _inner),
    ("reference", "ref", None, "ref-list", _cited),
)
DATE_ORDER = ("epub", "ppub", "pmc-release")


def _gathered(raw: bytes) -> dict[str, list] | None:
    """One pass over the document: what each part takes, in the order in which the elements begin."""
    found: dict[str, list] = {part[0]: [] for part in PARTS}
    began, open_tags, n = {}, Counter(), 0
    try:
        for event, el in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
            if event == "start":
                open_tags[el.tag] += 1
                n += 1
                began[el] = n
                continue
            open_tags[el.tag] -= 1
            for name, tag, attribute, around, take in PARTS:
                if el.tag == tag and (not attribute or el.get(attribute[0]) == attribute[1]) and (not around or open_tags[around]):
                    found[name].append((began[el], take(el)))
    except ElementTree.ParseError:
        return None
    return {name: [x for _, x in sorted(rows, key=lambda r: r[0])] for name, rows in found.items()}


def _published(dates: list[tuple]) -> tuple[str | None, int | None]:
    firsts = {kind: next((d for d in dates if kind in (None, d[0])), None) for kind in (*DATE_ORDER, None)}
    for found in firsts.values():
        if found and found[1]:
            _, year, month, day = found
            return f"{year}-{(month or '01').zfill(2)}-{(day or '01').zfill(2)}", int(year) if year.isdigit() else None
    return None, None


def jats_record(body) -> dict:
    """Fields of one JATS document; an unreadable document gives none."""
    raw = plain_bytes(body)
    got = _gathered(raw) if raw is not None else None
    if got is None:
        return {}
    first = lambda *names: next((x for name in names for x in got[name] if x), None)
    sections: dict[str, str] = {}
    for title, text in got["section"]:
        if title and text:
            low = title.lower()
            key = next((k for pattern, k in SECTION_PATTERNS if re.search(pattern, low)), "other")
            sections[key] = " ".join(filter(None, (sections.get(key), text)))
    day, year = _published(got["date"])
    return {
        "title": got["title"][0] if got["title"] else "",
        "abstract": first("abstract"), "authors": [a for a in got["author"] if a],
        "journal": first("journal", "journal_nlm", "journal_iso"), "pub_date": day, "pub_year": year, "doi": first("doi"),
        "sections": sections, "references": got["reference"], "reference_count": len(got["reference"]),
        "full_text": " ".join(sections[k] for k in BODY_ORDER if k in sections) or first("body"),
    }


PARSED = 200  # articles whose parsed fields a Python worker holds at once


def parse_jats(df: DataFrame, xml_col: str, id_col: str = "article_id") -> DataFrame:
    """Article fields of JATS documents (text, bytes or gzip), parsed few at a time."""
    names = [c.strip().split(" ")[0] for c in ARTICLE_SCHEMA.split(", ") if " " in c]

    def rows(batches):
        for pdf in (b.iloc[at:at + PARSED] for b in batches for at in range(0, len(b), PARSED)):
            recs = [{"article_id": i, **jats_record(x)} for i, x in zip(pdf["article_id"], pdf["body"])]
            yield pd.DataFrame(recs, columns=names).astype(object).where(lambda d: d.notna(), None)

    return df.select(F.col(id_col).cast("string").alias("article_id"), F.col(xml_col).alias("body")).mapInPandas(
        rows, ARTICLE_SCHEMA)


_PASSAGE = "struct<infons:map<string,string>,text:string>"
_DOC = f"struct<infons:map<string,string>,passages:array<{_PASSAGE}>>"


def parse_bioc(df: DataFrame, json_col: str, id_col: str = "article_id") -> DataFrame:
    """Article fields of BioC JSON: the first document's passages. Binary bodies may be gzip; broken ones give nulls."""
    text = F.col(json_col) if dict(df.dtypes)[json_col] != "binary" else unpacked(F.col(json_col))
    whole = F.from_json(text, f"struct<documents:array<{_DOC}>,PubTator3:array<{_DOC}>,"
                              f"infons:map<string,string>,passages:array<{_PASSAGE}>>")
    first = lambda c: F.get(F.col(c), F.lit(0))
    kind = lambda p: F.lower(F.coalesce(
        nonempty(p["infons"]["type"]), nonempty(p["infons"]["section_type"]), F.lit("")))
    base = df.select(F.col(id_col).cast("string").alias("article_id"), whole.alias("w")).select(
        "article_id",
        F.coalesce(first("w.documents"), first("w.PubTator3"),
                   F.when(F.col("w.passages").isNotNull(), F.struct("w.infons", "w.passages"))).alias("d"))
    passages = F.transform(
        F.coalesce("d.passages", F.array().cast(f"array<{_PASSAGE}>")),
        lambda p: F.struct(kind(p).alias("kind"), F.trim(F.coalesce(p["text"], F.lit(""))).alias("text")))
    named = base.withColumn("p", passages)
    of = lambda what: nonempty(F.get(F.filter("p", lambda x: x["kind"].contains(what)), F.lit(0))["text"])
    said = F.filter("p", lambda x: x["text"] != "")
    keyed = F.filter(
        F.transform(said, lambda x: F.struct(
            F.when(x["kind"] != "", section_key(x["kind"])).alias("key"), x["text"].alias("text"))),
        lambda x: x["key"].isNotNull() & (x["key"] != "abstract"))
    year = F.col("d.infons")["year"]
    return (
        named.withColumns({"said": said, "keyed": keyed})
        .select(
            "article_id", of("title").alias("title"), of("abstract").alias("abstract"),
            F.array().cast("array<string>").alias("authors"), F.col("d.infons")["journal"].alias("journal"),
            year.alias("pub_date"), F.when(year.rlike(r"^\d+$"), year.try_cast("int")).alias("pub_year"),
            F.col("d.infons")["doi"].alias("doi"),
            F.map_from_entries(F.transform(
                F.array_distinct(F.transform("keyed", lambda x: x["key"])),
                lambda k: F.struct(k, F.array_join(F.transform(F.filter(
                    "keyed", lambda x: x["key"] == k), lambda x: x["text"]), " ")))).alias("sections"),
            F.array().cast("array<struct<ref_id:string,title:string,authors:string,year:string,doi:string,pmid:string>>")
            .alias("references"),
            F.lit(0).alias("reference_count"),
            nonempty(F.array_join(F.transform("said", lambda x: x["text"]), " ")).alias("full_text"),
        )
    )


def parse_article(df: DataFrame, fmt_col: str, body_col: str, id_col: str = "article_id") -> DataFrame:
    """BioC rows by the BioC reader, every other format as JATS."""
    bioc = F.coalesce(F.col(fmt_col) == "bioc", F.lit(False))
    return parse_bioc(df.filter(bioc), body_col, id_col).unionByName(parse_jats(df.filter(~bioc), body_col, id_col))
