"""Dictionary terms in texts against a pattern of all terms, longest first."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from litgraph.operators import entities as E
from litgraph.operators import mentions

SF = "/root/testdata/sf0.001"
ENTITIES = "entity_id string, canonical_name string, aliases array<string>"


def by_force(texts: dict, terms: dict[str, str]) -> set[tuple]:
    """As one pattern of all terms, longest first, between characters that are not alphanumeric, would find them."""
    sizes = sorted({len(t) for t in terms}, reverse=True)
    run = lambda c: c.isascii() and c.isalnum()
    out = set()
    for key, text in texts.items():
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text or "")
        at = 0
        while at < len(low):
            n = 0
            if at == 0 or not run(low[at - 1]):
                n = next((n for n in sizes if low[at:at + n] in terms and len(low) >= at + n and not (at + n < len(low) and run(low[at + n]))), 0)
            if n:
                out.add((key, at, text[at:at + n], terms[low[at:at + n]]))
            at += n or 1
    return out


def found(spark, texts: dict, terms: dict[str, str]) -> set[tuple]:
    names = spark.createDataFrame([(e, t, []) for t, e in terms.items()], ENTITIES)
    rows = E.find_mentions(spark.createDataFrame(list(texts.items()), "k long, body string").repartition(3), names, "k", "body").collect()
    start = {k: [0] for k in texts}
    for k, text in texts.items():
        for piece in mentions.PIECES.findall(text or ""):
            start[k].append(start[k][-1] + len(piece))
    return {(r["k"], start[r["k"]][r["at"]], r["match_text"], r["entity_id"]) for r in rows}


@pytest.mark.parametrize("part", [64 << 20, 200])
def test_random_terms_equal_one_pattern(spark, monkeypatch, part):
    monkeypatch.setattr(mentions, "PART_BYTES", part)  # 200: many parts, a scan each
    rnd = random.Random(part)
    bits = ["a", "b", "ab", "-", " ", "(", "é", "1", "İ", "\n"]
    terms = {t: f"e{i}" for i, t in enumerate(sorted({"".join(rnd.choice(bits[:8]) for _ in range(rnd.randint(2, 5))).strip() for _ in range(60)})) if len(t) >= 2}
    texts = {i: "".join(rnd.choice([*bits, "A", "É"]) for _ in range(rnd.randint(0, 60))) for i in range(300)} | {1000: None, 1001: ""}
    got = found(spark, texts, terms)
    assert got == by_force(texts, terms) and len(got) > 300


def test_whole_dictionary_over_documents(spark):
    """Every word of the benchmark, short ones too, and a text of 20,000 words."""
    words = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in re.findall(r"[^\W\d_]+", r["text"].lower()) if len(w) >= 2}
    terms = {w: w for w in words} | {"of the": "two words"}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rnd = random.Random(1)
    texts[10**6] = " ".join(rnd.choice(sorted(words) + ["zzz", "of", "the"]) for _ in range(20_000))
    got = found(spark, texts, terms)
    assert got == by_force(texts, terms) and len(got) > 10_000


def test_texts_do_not_shuffle(spark):
    names = spark.createDataFrame([("1", "red fox", [])], ENTITIES)
    texts = spark.createDataFrame([(1, "A red fox")], "k long, body string")
    plan = E.find_mentions(texts, names, "k", "body")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again = E.expand_mentions(
        spark.createDataFrame([("t", "red fox", "x"), ("u", "red fox", "Red Fox den")], "triple_id string, subject string, object string"), names,
        only_new=True, existing=spark.createDataFrame([("t",)], "triple_id string"))
    assert {tuple(r) for r in again.collect()} == {("u", "1", "subject", "red fox", "canonical_exact"), ("u", "1", "object", "Red Fox", "canonical_substring")}
    assert E.expand_mentions(texts.select(F.lit("t").alias("triple_id"), F.lit(None).cast("string").alias("subject"), F.col("body").alias("object")), names.limit(0)).collect() == []
