"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, row long, sha string, fp long, "
          "part int, rank int, n int, least long, root long, hash long, at int, block int, size int, shard int, _salt int")
EXTRA = ("x", 1, "y", 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13)


def words(rnd: random.Random, n: int, pool: str = "the of and in with river stone cloud maple seven turn") -> str:
    names = pool.split()
    return " ".join(rnd.choice(names) + rnd.choice("abcdefgh") * rnd.randint(0, 2) for _ in range(n))


def dirty_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    long = words(rnd, 30_000)
    base = words(rnd, 220)
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "12 34 !!", long, base, base]
    texts += [base.replace(" the", " a", 1), base + " tail", "É" * 500 + base, "ab" * 700, "日本語のテキスト", "  lead  and\ttabs \r\n"]
    texts += [words(rnd, rnd.randint(1, 120)) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    return rows + [(7, base), (40, "one"), (41, "one"), (None, "one"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else "de", "s", 1, *EXTRA) for d, t in rows], SCHEMA).repartition(3)


def documents(spark, seed: int = 3):
    rows = dirty_texts(seed)
    return rows, frame(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
