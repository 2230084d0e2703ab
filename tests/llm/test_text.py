"""Operators 1, 5, 8 and 9: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import itertools
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, empty, frame, words  # noqa: E402

from litgraph.llm import chat, decontaminate, language, queries, url_filter, url_labels  # noqa: E402

SF = "/root/testdata/sf0.001"


# URL filters

def judged_by_force(url: str | None) -> tuple:
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    best = None
    for rule in queries.URL_RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "://x.org/", "HTTP://Www.Example.ORG/es/a?b=/c", "http://example.org/es", "http://a.example.org/en/17#x",
        "http://org/", "http://xorg/", "http://com/fr/", "http://b.com/de/?q", "http://b.com?x/de/", "http://É.com/de/1", "http://a.org#/x",
        "http://a.org", "a://b://c.org/d", "http://notexample.org/es/1", "http://u@h.com:80/fr/x y\nz",
    ]
    rows = spark.createDataFrame([(i if i else None, u, "h", "x", 1.0) for i, u in enumerate(urls + urls[-3:])], "page_id long, url string, host string, rule string, score double")
    got = url_filter.judge(rows, url_filter.UrlModel(), queries.URL_RULES).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        url = (urls + urls[-3:])[r["page_id"] or 0]
        assert (r["host"], r["path"], r["rule"]) == judged_by_force(url)
        assert r["verdict"] == (queries.URL_RULES[r["rule"]] if r["rule"] else "block" if r["score"] >= 0.5 else "allow")


def test_url_model_learns_host_parts(spark):
    rnd = random.Random(1)
    names = ["river", "stone", "cloud", "maple"]
    bad = ["casino", "pills", "bets"]
    urls = [(f"http://{rnd.choice(names)}{i % 7}.example.com/en/{i}", False) for i in range(300)]
    urls += [(f"http://{rnd.choice(bad)}-{rnd.choice(names)}.example.com/en/{i}", True) for i in range(60)]
    labelled = spark.createDataFrame(urls + [(None, True), ("x", None)], "url string, bad boolean")
    model = url_filter.train(labelled, rows_per_class=100)
    fresh = [("best-casino.example.net", "/a"), ("pills4u.example.org", "/"), ("stonecloud.example.net", "/b"), ("maple3.example.com", "/en/77")]
    scores = model.score(*map(list, zip(*fresh)))
    assert scores[:2].min() >= 0.5 and scores[:2].min() > scores[2:].max()  # hosts unlike any of the sample stay below
    assert (model.score(["river9.example.com", "bets-stone.example.com"], ["/en/1", "/en/2"]) >= 0.5).tolist() == [False, True]
    assert url_filter.train(labelled.limit(0)).score([""], [""]).shape == (1,)
    again = url_filter.train(labelled.repartition(3), rows_per_class=100)
    assert np.allclose(again.weights, model.weights)


def test_url_model_on_unseen_hosts(spark):
    """Each host's URLs are all learned from or all held out: four turns, so every host is judged once, unseen."""
    rows = [(r["url"], r["bad"]) for r in url_labels.labelled_urls(spark).collect()]
    name = lambda u: max(u.split("/")[2].split("."), key=len) if "example" not in max(u.split("/")[2].split("."), key=len) else u.split("/")[2]
    hosts = sorted({name(u) for u, _ in rows})
    seen = []
    for turn in range(4):
        held = {h for n, h in enumerate(hosts) if n % 4 == turn}
        model = url_filter.train(spark.createDataFrame([r for r in rows if name(r[0]) not in held], "url string, bad boolean"))
        own = [r for r in rows if name(r[0]) in held]
        scores = model.score([u.split("/")[2] for u, _ in own], ["/" + u.split("/", 3)[3].split("?")[0] for u, _ in own])
        seen += [(bad, s >= 0.5) for (_, bad), s in zip(own, scores)]
    hit = sum(b and s for b, s in seen)
    print("held-out precision", hit / sum(s for _, s in seen), "recall", hit / sum(b for b, _ in seen))
    assert hit >= 0.65 * sum(s for _, s in seen) and hit >= 0.65 * sum(b for b, _ in seen)


def test_url_query(spark):
    rows = queries.op1_url_filters(spark, SF).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    marks, right = {"ads", "adult", "bets", "casino", "pills", "spam"}, 0
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == judged_by_force(pages[r["page_id"]])
        right += r["rule"] is not None or (r["verdict"] == "block") == bool(set(re.split("[.-]", r["host"])) & marks)
    assert right >= 0.95 * len(rows)  # hosts that the labelled table does not hold


# Benchmark decontamination

ITEM = "A train leaves the old station at 45 km per hour and after 3 hours it meets Boris near the bridge over the river"
PLAIN = "which of these small stones would sink first when all of them are dropped into the deep lake at once"


def leaks_of(spark, texts, items):
    docs = frame(spark, list(enumerate(texts)))
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, at int")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}


def test_leaks(spark):
    rnd = random.Random(5)
    filler = lambda n: words(rnd, n)
    other = ITEM.replace("45 km", "80 miles").replace("3 hours", "7 hours").replace("Boris", "Maria")
    broken = "A train leaves the old station at 45 km per hour and after 3 hours it meets Boris near Boris the bridge"
    texts = [
        filler(50), f"{filler(30)}. {ITEM}. {filler(2000)}", f"{filler(30)}\n{other}\n{filler(30)}", PLAIN.upper() + "!", None, "", broken,
        f"{filler(9)} {' '.join(PLAIN.split()[:15])} {filler(9)}", f"{filler(9)} {' '.join(PLAIN.split()[:8])} {filler(9)}",
        " ".join([PLAIN] * 40),
    ]
    got = leaks_of(spark, texts, [ITEM, PLAIN, None, "", "too short", PLAIN])
    assert set(got) == {(1, 0), (2, 0), (3, 1), (3, 5), (6, 0), (7, 1), (7, 5), (9, 1), (9, 5)}
    assert got[1, 0]["exact"] and not got[2, 0]["exact"] and got[9, 1]["matched"] == got[9, 1]["item_windows"]


def test_leaks_of_names_at_sentence_starts_and_unspaced_scripts(spark):
    item = "Tom buys 12 red pens. Sara buys 5 blue pens. How many pens do they have?"
    other = item.replace("Tom", "Ben").replace("Sara", "Lucy").replace("12", "17").replace("5", "8")
    han, kana = "小明有十二个红苹果，小红有五个绿苹果，他们一共有多少个苹果？", "太郎はりんごを三つ買いました。花子は何個買いましたか。"
    texts = [item, other, "Then she asked. " + other, f"前文{han}后文", f"x {kana} y", "小明今天没有来上学因为下雨了", other.replace("pens", "cups"),
             other.replace("buys", "sells"), item.upper()]
    got = leaks_of(spark, texts, [item, han, kana])
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (8, 0)}
    assert got[0, 0]["exact"] and got[3, 1]["exact"] and not got[1, 0]["exact"] and got[1, 0]["matched"] == got[1, 0]["item_windows"]


def test_leaks_with_number_words_long_names_and_short_items(spark):
    items = [
        "At noon twelve small boats leave the harbour and five of them carry fresh bread to New York before it rains",
        "Tom Smith buys red pens for NASA while McTavish and O'Neil wait outside the tall gate with two hundred and six dogs",
        "Name every planet.", "Why?", "Who built it", "take 4 of 5"]
    texts = [
        items[0].replace("twelve", "seventeen").replace("five", "eight").replace("New York", "Paris"),
        items[0].replace("twelve", "17").replace("five", "twenty-three").replace("New York", "Rio de Janeiro").replace(" de ", " "),
        items[1].replace("Tom Smith", "Ben").replace("NASA", "ESA").replace("McTavish", "Li").replace("O'Neil", "Mary Ann").replace("two hundred", "three"),
        "Then I saw it. Name every planet. And so on for a while.", "they name every planet here and there", "Why?", "Now. Why? Because.",
        "x\nwho built it\ny", "take 9 of 8", items[1].upper()]
    got = leaks_of(spark, texts, items)
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2), (5, 3), (7, 4), (9, 1)}
    assert not got[0, 0]["exact"] and got[3, 2]["exact"]


def leaks_by_force(doc: str, item: str, width: int = 5) -> bool:
    """The rules word by word, on sentences of lower-case words, figures, number words and capitalised names."""
    def codes(text):
        out, begins, merged = [], True, False
        for w in text.replace("\n", " \n ").split():
            if w == "\n":
                begins, merged = True, False
                continue
            core = w.strip(".,!?")
            kind = "#" if core.isdigit() else "c" if core.lower() in decontaminate.NUMBER_WORDS else "N" if core[0].isupper() and len(core) > 1 else ""
            last = out[-1] if out and not begins else None
            if kind == "c" and last and last[0] == "#":
                last[1].append(core.lower())
            elif kind == "N" and not begins and last and last[0] == "N":
                last[1].append(core.lower())
            else:
                kind = "#" if kind == "c" else kind
                out.append(["?" if kind == "N" and begins else kind, [core.lower()], begins])
            begins = w[-1] in ".!?"
        return out

    def windows(text):
        plain = codes(text)
        readings, place = [(plain, list(range(len(plain))), False)], 0
        led = [i for i in range(len(plain) - 1) if plain[i][0] == "?" and plain[i + 1][0] == "N" and not plain[i + 1][2]]
        if led:
            both = [(["L", c[1] + plain[i + 1][1]] if i in led else c, i) for i, c in enumerate(plain) if i - 1 not in led]
            readings.append(([c for c, _ in both], [i for _, i in both], True))
        found = set()
        for own, places, second in readings:
            for at in range(len(own) - width + 1):
                part = own[at:at + width]
                if second and not any(c[0] == "L" for c in part):
                    continue
                for pick in itertools.product(*[[False, True] if c[0] == "?" else [c[0] in ("#", "N", "L")] for c in part]):
                    if 2 * sum(pick) < width:
                        key = tuple(("<#>" if c[0] == "#" else "<N>") if p else c[1][0] for c, p in zip(part, pick))
                        found.add((places[at], second, key, tuple(" ".join(c[1]) if p else "" for c, p in zip(part, pick))))
        return found, len({a for a, second, _, _ in found if not second})
    ours, (theirs, total) = windows(doc)[0], windows(item)
    groups: dict[int, list] = {}
    for a, _, k, f in ours:
        for b, _, k2, f2 in theirs:
            if k == k2:
                groups.setdefault(a - b, []).append((b, list(zip(f2, f))))
    held, longest = set(), 0
    for members in groups.values():
        slots: dict[str, set] = {}
        for _, pairs in members:
            for i, d in pairs:
                if i:
                    slots.setdefault(i, set()).add(d)
        if sum(len(v) == 1 for v in slots.values()) >= 0.8 * len(slots):
            places = {b for b, _ in members}
            held |= places
            longest = max(longest, len(places))
    return bool(theirs) and (len(held) >= 0.8 * max(total, 1) or longest >= 9)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(12)
    plain = "the red old small boat train takes from over with many slow river under then".split()
    names, counts = ["Anna", "Boris", "Carl", "Dora"], ["12", "7", "five", "twenty", "45", "six"]

    def sentence() -> str:
        out = [rnd.choice(names) if rnd.random() < 0.12 else rnd.choice(counts) if rnd.random() < 0.15 else rnd.choice(plain) for _ in range(rnd.randint(6, 14))]
        return " ".join([out[0][0].upper() + out[0][1:], *out[1:]]) + "."
    items = [" ".join(sentence() for _ in range(rnd.randint(1, 3))) for _ in range(8)]

    def altered(text: str) -> str:
        swap = dict(zip(names + counts, rnd.sample(names, 4) + rnd.sample(counts, 6)))
        out = []
        for w in text.split():
            core = w.strip(".")
            kind = rnd.random()
            new = swap.get(core, core) if kind < 0.9 else core if kind < 0.96 else rnd.choice(plain)
            if core in names and rnd.random() < 0.1:
                new += " Maria"
            out.append(w.replace(core, new))
        return " ".join(out)
    texts = [" ".join(sentence() for _ in range(rnd.randint(0, 3))) + "\n" + altered(rnd.choice(items)) + "\n" + sentence() for _ in range(60)]
    texts += [sentence() for _ in range(20)]
    got = set(leaks_of(spark, texts, items))
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if leaks_by_force(t, x)}
    assert got == want and 10 < len(want) < 80


def test_slots_must_be_consistent(spark):
    item = "take 4 red balls and 4 blue balls then put 4 of them back with 4 more green ones from the box"
    steady, mixed = item.replace("4", "9"), item
    for n in ("1", "2", "3", "5"):
        mixed = mixed.replace(" 4 ", f" {n} ", 1)
    assert set(leaks_of(spark, [steady, mixed], [item])) == {(0, 0)}


def test_template_windows_equal_brute_force(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SF).collect()}
    plain = lambda t: [w for w in (decontaminate.TRIM.sub("", w).lower() for w in t.split()) if w]
    shingles = lambda t: {tuple(w[i:i + 5]) for w in [plain(t)] for i in range(len(w) - 4)}
    items = {i: shingles(t) for i, t in bench.items()}
    held = {}
    for d, text in enumerate(docs):
        own = shingles(text)
        held |= {(d, i): len(s & own) / len(s) for i, s in items.items() if s}
    assert got == {k for k, v in held.items() if v >= 0.8} and len(got) > 0


def test_decontamination_of_dirty_and_empty_tables(spark):
    _, df = documents(spark)
    bench = spark.createDataFrame([(1, PLAIN)], "item_id long, text string")
    assert decontaminate.leaks(df, bench).collect() == []
    assert decontaminate.leaks(df, bench.limit(0)).collect() == []
    assert decontaminate.leaks(empty(spark), bench).collect() == []
    nulls = spark.createDataFrame([(None, PLAIN), (None, PLAIN)], "doc_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.leaks(nulls, bench).collect()] == [(None, 1)]


# Chat formatting

def test_escaping_is_reversible(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["\\", "b", "e", "h", "c", ":", "###", " ", "</turn>", "\n", "é"]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", chat.escaped(df["t"]).alias("e"), chat.unescaped(chat.escaped(df["t"]))).collect():
        assert u == t and "</turn>" not in e and "### " not in e


MESSAGES = "tree_id long, msg_id long, parent_id long, role string, text string, score double, rank int, node string"


def trees(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], MESSAGES).repartition(3)


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 0.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", None),
        (1, 5, 4, "assistant", "d", 5.0), (2, 9, 8, "user", "orphan", None), (3, 1, 1, "user", "self", None),
        (None, 1, None, None, None, None), (None, 2, 1, "assistant", "</turn>\n### x: \\", None),
    ]
    read = chat.read_back(chat.format_trees(trees(spark, rows))).collect()
    got = {(r["tree_id"], r["leaf_id"]): r for r in read}
    assert set(got) == {(1, 3), (1, 5), (2, 9), (3, 1), (None, 2)} and len(read) == 5
    turns = lambda k: [(t["role"], t["text"]) for t in got[k]["turns"]]
    assert turns((1, 5)) == [("user", "q"), ("assistant", "a"), ("user", "c"), ("assistant", "d")]
    assert got[1, 5]["loss_text"] == "ad" and (got[1, 5]["score"], got[1, 5]["rank"]) == (1.5, 2) and got[1, 3]["rank"] == 1
    assert turns((None, 2)) == [("", ""), ("assistant", "</turn>\n### x: \\")]
    assert got[1, 3]["formatted"] == "### user: q</turn>\n### assistant: b</turn>\n"
    best = chat.format_trees(trees(spark, rows), top=1).collect()
    assert {(r["tree_id"], r["leaf_id"]) for r in best} == set(got) - {(1, 5)}


def test_loops_and_copies(spark):
    rows = [(1, 1, 3, "user", "a", None), (1, 2, 1, "assistant", "b", None), (1, 3, 2, "user", "c", None), (1, 4, 3, "assistant", "d", None)]
    got = chat.read_back(chat.format_trees(trees(spark, rows))).collect()
    assert [[t["text"] for t in r["turns"]] for r in got] == [["a", "b", "c", "d"]]  # cut above the smallest
    rows = [(1, 1, None, "user", "a", None), (1, 1, None, "user", "a", None), (1, 2, 1, "assistant", "b", None)]
    got = chat.read_back(chat.format_trees(trees(spark, rows))).collect()
    assert sorted([t["text"] for t in r["turns"]] for r in got) == [["a"], ["a", "b"]]
    long = [(1, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(1, 301)]
    got = chat.read_back(chat.format_trees(trees(spark, long))).collect()
    assert [t["text"] for t in got[0]["turns"]] == [f"t{i}" for i in range(1, 301)] and len(got) == 1
    assert got[0]["loss_text"] == "".join(f"t{i}" for i in range(2, 301, 2))
    assert chat.format_trees(trees(spark, []).limit(0)).collect() == []


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "system", "s"), (None, 1, "assistant", "x"), (1, 2, None, "r"), (2, 1, "assistant", "é👩‍👧")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, msg_id int")
    got = {r["tree_id"]: r for r in chat.read_back(chat.format_trees(chat.threads_of(df))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("system", "s"), ("user", ""), ("user", ""), ("", "r")]
    assert got[None]["loss_text"] == "x" and got[2]["loss_text"] == "é👩‍👧" and [s["length"] for s in got[2]["spans"]] == [4]


# Language ID

def phrases_by_force(text: str, sample: str) -> int:
    """Greedy parse into the longest strings of the sample."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_equal_brute_force():
    rnd = random.Random(4)
    samples = {k: "".join(rnd.choice(a) for _ in range(400)) for k, a in (("x", "abcd "), ("y", "bcde "))}
    model = language.Model(samples)
    for _ in range(60):
        text = "".join(rnd.choice("abcdez ") for _ in range(rnd.randint(1, language.SEGMENT)))
        clean = re.sub(" +", " ", text)
        segments, _ = model._segments(text)
        plain = {k: re.sub(" +", " ", s) for k, s in samples.items()}
        assert model._phrases(segments)[0].tolist() == [phrases_by_force(clean, plain[k]) for k in ("x", "y")]


def test_large_alphabets_keep_their_letters():
    rnd = random.Random(7)
    pools = {"a": [chr(c) for c in range(0x4E00, 0x4E00 + 900)], "b": [chr(c) for c in range(0x4E00 + 450, 0x4E00 + 1350)]}
    pairs = {k: [rnd.choice(p) + rnd.choice(p) for _ in range(300)] for k, p in pools.items()}
    text = lambda k, n: "".join(rnd.choice(pairs[k]) for _ in range(n))
    model = language.Model({k: text(k, 4000) for k in pairs})
    said, _, spans = model.predict([text("a", 80), text("b", 80), "".join(chr(rnd.randint(0xAC00, 0xD000)) for _ in range(100))])
    assert said[:2] == ["a", "b"] and min(spans[:2]) > 1.9 and spans[2] == 1
    assert len(model.owner) < 3 * (len(model.base) + 1800)
    samples = {k: text(k, 60) for k in pairs}
    small = language.Model(samples)
    for _ in range(20):
        probe = text("a", 20) + text("b", 20)
        assert small._phrases(small._segments(probe)[0])[0].tolist() == [phrases_by_force(probe, samples[k]) for k in ("a", "b")]


def test_long_texts_are_read_whole(monkeypatch):
    model = language.Model({"x": "abcabdabe " * 30, "y": "xyzxywxyv " * 30})
    text = "abcabdab " * 50 + "xyzxywxy " * 400
    assert model.predict([text])[0] == ["y"] and model.predict([text[:600]])[0] == ["x"]
    monkeypatch.setattr(language, "SLICE", 100)
    assert model.predict([text, None, "", "12 !?", "日本"], at_once=3)[0] == ["y", "und", "und", "und", "x"]


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op9_language_id(spark, sf).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert 0.1 < len(held) / len(got) < 0.3
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_of_dirty_and_empty_tables(spark):
    rows, df = documents(spark)
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 5)} == {"und"}
    assert language.identify(empty(spark)).collect() == []
    unlabelled = language.identify(df.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())
