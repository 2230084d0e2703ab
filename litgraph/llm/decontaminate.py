"""Operator 5, benchmark decontamination: template windows are hash-joined and their slots checked."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import staged
from litgraph.llm.tokens import in_groups

UNITS = frozenset(
    "% ° mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ml cl l liter liters "
    "litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years hz khz mhz ghz w kw mw v a mol pa kpa j kj cal kcal mph km/h m/s c f k usd eur gbp dollar dollars cent "
    "cents euro euros pound pounds percent degree degrees € $ £".split())
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen null zwei drei vier "
    "fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig "
    "vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze treize "
    "quatorze quinze seize vingt trente quarante cinquante soixante cent mille dos tres cuatro cinco seis siete ocho nueve diez "
    "once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil".split())
BREAK = "\x01"
LITERAL, NUMBER, COUNT, UNIT, NAME, CAPITALS, NOTHING = range(7)
"""Kinds of words; COUNT: a number in words, CAPITALS: all of its letters are."""
PLACEHOLDERS = {k: xxhash.xxh64_intdigest(v) for k, v in ((NUMBER, "<number>"), (UNIT, "<unit>"), (NAME, "<name>"))}
GLUED = re.compile(r"(?<=\d)(?=[^\W\d_]|[%°€$£])|(?<=[€$£])(?=\d)")
TRIM = re.compile(r"^[^\w%°€$£]+|[^\w%°€$£]+$")
FIGURE = re.compile(r"\d[\d.,:/]*")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
"""Characters of scripts without blanks (Thai, Lao, Burmese, Khmer, kana, Han): each is a word."""
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BITMAP_BITS = 24  # the bitmap of the benchmark's windows, 2 MiB, sorts out nearly all other windows before the join
KNOWN_CHUNKS = 200_000  # strings between blanks that a task remembers; beyond, it starts anew
CHARS = 500_000  # characters of texts whose windows a task holds at once
BROADCAST_BYTES = 32 << 20  # the benchmark's windows are broadcast to the join up to this size, as measured


def _described(word: str) -> tuple[int, int, bool, str]:
    """Kind, hash, whether it ends a sentence, and its core."""
    if word == BREAK:
        return NOTHING, 0, True, ""
    core = word if word.isalpha() else TRIM.sub("", word)
    low = core.lower()
    if not core:
        kind = NOTHING
    elif FIGURE.fullmatch(core):
        kind = NUMBER
    elif low in NUMBER_WORDS or "-" in low and all(p in NUMBER_WORDS for p in low.split("-")):
        kind = COUNT
    elif low in UNITS:
        kind = UNIT
    elif core[0].isupper() and len(core) > 1:
        kind = CAPITALS if core.isupper() else NAME
    else:
        kind = LITERAL
    ends = core is not word and word.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":")
    return kind, xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), ends, low


class Lexicon:
    """Words of strings between blanks, each described once: a number per word, several where a string is cut."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.bounds, self.numbers = np.zeros(1, np.int32), np.zeros(0, np.int32)
        self.kind, self.code, self.ends = np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool)
        self.core: list[str] = []

    def _cut(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [chunk] if chunk == BREAK or chunk.isalpha() else GLUED.sub(" ", chunk).split()
        return GLUED.sub(" ", UNSPACED.sub(r" \g<0> ", chunk)).split()

    def _learn(self, chunks: list[str]) -> None:
        cut = [self._cut(c) for c in chunks]
        flat = [w for c in cut for w in c]
        new = [w for w in dict.fromkeys(flat) if w not in self.words]
        if new:
            kind, code, ends, core = zip(*map(_described, new))
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.kind = np.append(self.kind, np.array(kind, np.int8))
            self.code = np.append(self.code, np.array(code, np.uint64))
            self.ends = np.append(self.ends, np.array(ends, bool))
            self.core += core
        numbers = np.fromiter(map(self.words.__getitem__, flat), np.int32, len(flat))
        bounds = len(self.numbers) + np.cumsum([len(c) for c in cut])
        self.chunks.update(zip(chunks, range(len(self.chunks), len(self.chunks) + len(chunks))))
        self.bounds, self.numbers = np.append(self.bounds, bounds.astype(np.int32)), np.append(self.numbers, numbers)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of all texts, and where each text's begin."""
        split = pc.utf8_split_whitespace(pa.array([(t or "").replace("\n", f" {BREAK} ") for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.chunks) > KNOWN_CHUNKS:
            self._clear()
        new = [c for c in chunks if c not in self.chunks]
        if new:
            self._learn(new)
        known = pa.array(np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks)))
        found = pa.ListArray.from_arrays(pa.array(self.bounds), pa.array(self.numbers)).take(known.take(coded.indices))
        return found.flatten().to_numpy(zero_copy_only=False), found.offsets.to_numpy()[split.offsets.to_numpy()]


@dataclass
class Codes:
    """Template codes of many texts, one after the other.

    ``maybe``: a literal that may be a name as well; ``only``: codes of which a window needs one to count; ``place``: the
    code's number in the plain reading of its text; ``first`` and ``stop``: its words; ``bounds``: where each text begins.
    """

    code: np.ndarray
    slot: np.ndarray
    maybe: np.ndarray
    only: np.ndarray | None
    begins: np.ndarray
    place: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    bounds: np.ndarray
    word: np.ndarray


def templates(lexicon: Lexicon, texts: list[str | None], bare: bool = False) -> list[Codes]:
    """The plain reading, and, where a capitalised word at a sentence's start stands before a name, one with both as one name.

    With ``bare`` also one without names, for the benchmark's side: it meets copies in capitals or small letters alone.

    Numbers, units behind them and capitalised words inside sentences are slots; numbers in words behind numbers, and
    names behind names, belong to the slot before. Capitalised words at the start of a sentence, and words all in
    capitals between others, have both readings.
    """
    word, bounds = lexicon.read(texts)
    kind = lexicon.kind[word]
    ends = np.append(0, np.cumsum(lexicon.ends[word]))
    kept = np.flatnonzero(kind != NOTHING)
    word, kind = word[kept], kind[kept]
    bounds = np.searchsorted(kept, bounds)
    starts = np.zeros(len(word) + 1, bool)
    starts[bounds] = True
    begins = starts[:-1].copy()
    begins[1:] |= ends[kept[1:]] > ends[kept[:-1]]
    before = np.append(NOTHING, kind[:-1])[:len(kind)]
    before[starts[:-1]] = NOTHING
    behind = np.append(kind[1:], NOTHING)[:len(kind)]
    behind[starts[1:]] = NOTHING
    number = (kind == NUMBER) | (kind == COUNT)
    counted = (before == NUMBER) | (before == COUNT)
    unit = (kind == UNIT) & counted
    name = (kind == NAME) & ~begins
    maybe = ((kind == NAME) & begins) | ((kind == CAPITALS) & (before != CAPITALS) & (behind != CAPITALS))
    alone = (kind == COUNT) & counted & ~begins
    joined = alone.copy()
    joined[1:] |= name[1:] & name[:-1]
    literal = lexicon.code[word]
    code = literal.copy()
    for which, k in ((number, NUMBER), (unit, UNIT), (name, NAME)):
        code[which] = PLACEHOLDERS[k]
    place = np.cumsum(~joined) - 1
    place -= np.repeat(place[np.minimum(bounds[:-1], max(len(place) - 1, 0))], np.diff(bounds)) if len(place) else 0

    def reading(merged: np.ndarray, led: np.ndarray | None) -> Codes:
        at = np.flatnonzero(~merged)
        own, slot, free = code[at], (number | unit | name)[at], maybe[at]
        if led is not None:
            own[led[at]], slot, free = PLACEHOLDERS[NAME], slot | led[at], free & ~led[at]
        return Codes(own, slot, free, None if led is None else led[at], begins[at], place[at], at, np.append(at[1:], len(code)),
                     np.searchsorted(at, bounds), word)
    found = [reading(joined, None)]
    leads = np.append(maybe[:-1] & name[1:], False)[:len(maybe)]
    if leads.any():
        after = np.append(False, leads[:-1])
        found.append(reading(joined | after, leads))
    if bare and (name | maybe).any():
        at = np.flatnonzero(~alone)
        own = np.where(name, literal, code)[at]
        found.append(Codes(own, (number | unit)[at], np.zeros(len(at), bool), (name | maybe)[at], begins[at], place[at], at,
                           np.append(at[1:], len(code)), np.searchsorted(at, bounds), word))
    return found


def _hashed(code: np.ndarray, at: np.ndarray, width: int, named: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ``at``; bit j of ``named``: word j is read as a name."""
    total = np.full(len(at), width, np.uint64)
    name = np.uint64(PLACEHOLDERS[NAME])
    for j in range(width):
        total = (total ^ np.where(named >> j & 1, name, code[at + j])) * MULTIPLIER
        total ^= total >> np.uint64(29)
    return total


def _choices(codes: Codes, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and words read as names, of windows over half of which is literal: a row for each choice of readings."""
    if codes.only is not None:
        some = np.append(0, np.cumsum(codes.only))
        at = at[some[at + width] > some[at]]
    free = np.zeros(len(at), np.int64)
    for j in range(width):
        free |= codes.maybe[at + j].astype(np.int64) << j
    slots = np.append(0, np.cumsum(codes.slot))
    slots = slots[at + width] - slots[at]
    row, named = [np.arange(len(at))], [np.zeros(len(at), np.int64)]
    for choice in np.unique(free[free > 0]).tolist():  # 31 at most
        rows, some = np.flatnonzero(free == choice), choice
        while some:
            row.append(rows)
            named.append(np.full(len(rows), some))
            some = (some - 1) & choice
    row, named = np.concatenate(row), np.concatenate(named)
    literal = 2 * (slots[row] + np.bitwise_count(named)) < width
    row, named = row[literal], named[literal]
    return at[row], _hashed(codes.code, at[row], width, named), named


def window_hashes(codes: Codes, width: int, sentences: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(place, hash, names, width) of all windows, and of texts under ``width`` words as a whole.

    With ``sentences`` also of whole sentences and lines of two words to ``width`` - 1.
    """
    last = np.repeat(codes.bounds[1:], np.diff(codes.bounds))
    at = np.arange(len(codes.code))
    found = [(*_choices(codes, at[at + width <= last], width), width)]
    texts = np.diff(codes.bounds)
    for short in range(1, width):
        begin = codes.bounds[:-1][texts == short]
        if sentences and short > 1:
            opens = np.flatnonzero(codes.begins)
            begin = np.union1d(begin, opens[np.diff(np.append(opens, len(codes.code))) == short])
        if len(begin):
            found.append((*_choices(codes, begin, short), short))
    return found


def _fillers(lexicon: Lexicon, codes: Codes, at: int, width: int, named: int) -> list[str]:
    return [" ".join(lexicon.core[w] for w in codes.word[codes.first[p]:codes.stop[p]].tolist()) if codes.slot[p] or named >> (p - at) & 1 else ""
            for p in range(at, at + width)]


def _windows(rows: DataFrame, width: int, bitmap: np.ndarray | None) -> DataFrame:
    """(id, text) to (id, at, plain, hash, fillers) of the windows that ``bitmap`` does not sort out; plain: of the plain reading."""
    shared = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_groups(texts, CHARS):
                owner, ats, plain, hashes, fillers = [], [], [], [], []
                for codes in templates(lexicon, texts[a:b], bare=bitmap is None):
                    for places, total, named, wide in window_hashes(codes, width, bitmap is not None):
                        if shared is not None:
                            lead = total >> np.uint64(64 - BITMAP_BITS)
                            known = (shared.value[lead >> np.uint64(6)] >> (lead & np.uint64(63)) & np.uint64(1)).astype(bool)
                            places, total, named = places[known], total[known], named[known]
                        owner.append(np.searchsorted(codes.bounds, places, "right") - 1)
                        ats.append(codes.place[places])
                        plain.append(np.full(len(places), codes.only is None))
                        hashes.append(total)
                        fillers += [_fillers(lexicon, codes, p, wide, n) for p, n in zip(places.tolist(), named.tolist())]
                row, ats, plain, hashes = (np.concatenate(x) for x in (owner, ats, plain, hashes))
                for c in range(0, len(row), 20_000):
                    own = slice(c, c + 20_000)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(a + row[own])), pa.array(ats[own]).cast(pa.int32()), pa.array(plain[own]),
                        pa.array(hashes[own].view(np.int64)), pa.array(fillers[own], pa.list_(pa.string()))],
                        ["id", "at", "plain", "hash", "fillers"])
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, at int, plain boolean, hash bigint, fillers array<string>")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which leading BITMAP_BITS bits occur, 64 to a word; the words that reach the driver are 2**18 at most."""
    lead = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = hashes.groupBy(F.shiftright(lead, 6).alias("w")).agg(F.expr(f"bit_or(1L << int(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 63))").alias("bits"))
    found = words.collect()
    grid = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in found:
        grid[r["w"]] = r["bits"]
    return grid.view(np.uint64)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", width: int = 5, share: float = 0.8, run_words: int = 13, consistency: float = 0.8,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, as such or with other numbers, names or units.

    Words become template codes (see ``templates``): numbers in figures and words, units behind them and names turn into
    typed placeholders, a run of names into one; other words are lower-cased without outer punctuation. Words that may be
    names or not are hashed as either; characters of scripts without blanks are words. Windows of ``width`` codes, over half
    of them literal, are joined by hash; items under ``width`` words as a whole, with sentences, lines and texts that hold
    nothing else (one word: with texts only). Windows of a pair at one shift (place in the document less place in the item)
    form a group. In a group each filler of the item should meet one filler of the document; if under ``consistency``
    of its fillers do, the group does not count. A pair is returned if the counting groups cover ``share`` of the
    item's windows, or one of them holds ``run_words`` words' windows.

    Columns: ``id_col``, ``item_col``, matched (windows), item_windows, longest (windows of the fullest group), exact
    (the same fillers throughout). Null texts are empty; items without words, or of placeholders for the most part, have
    no windows and match nothing. Repeated documents with one id count as one, and so do repeated items. Null
    ids are ids like others. Empty input on either side gives no rows; other columns are ignored.
    """
    items = staged(_windows(benchmark.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").alias("text")), width, None), "items")
    bitmap = _bitmap(items)
    found = _windows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), width, bitmap)
    sizes = items.groupBy("id").agg(F.countDistinct(F.when(F.col("plain"), F.col("at"))).alias("item_windows"))
    theirs = items.distinct().join(sizes.withColumnRenamed("id", "_i"), F.col("id").eqNullSafe(F.col("_i"))).select(
        F.col("id").alias("item"), F.col("at").alias("item_at"), "item_windows", "hash", F.col("fillers").alias("item_fillers"))
    theirs = staged(theirs, "item-windows")
    size = theirs.agg(F.sum(64 + F.aggregate("item_fillers", F.lit(0), lambda n, w: n + 16 + F.octet_length(w)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        theirs = F.broadcast(theirs)
    met = found.join(theirs, "hash")
    slots = F.filter(
        F.arrays_zip(F.col("item_fillers").alias("i"), F.col("fillers").alias("d")), lambda z: z["i"] != "")
    grouped = met.withColumn("slots", slots).groupBy("id", "item", "item_windows", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("places"),  # as many as the item has windows
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    named = F.size(F.array_distinct(F.transform("slots", lambda z: z["i"])))
    steady = F.size(F.filter(
        F.array_distinct(F.transform("slots", lambda z: z["i"])),
        lambda i: F.size(F.filter("slots", lambda z: z["i"] == i)) == 1))
    counted = grouped.filter(steady >= F.lit(consistency) * named).select(
        "id", "item", "item_windows", "places",
        F.forall("slots", lambda z: z["i"] == z["d"]).alias("exact"), F.size("places").alias("held"))
    pairs = counted.groupBy("id", "item").agg(
        F.greatest(F.max("item_windows"), F.lit(1)).cast("long").alias("item_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"),
        F.max("held").cast("long").alias("longest"), F.max_by("exact", "held").alias("exact"))
    return pairs.filter(
        (F.col("matched") >= F.lit(share) * F.col("item_windows")) | (F.col("longest") >= run_words - width + 1)
    ).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "item_windows", "longest", "exact")
