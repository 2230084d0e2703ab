"""Operator 9, language ID: cross-parsing against one suffix automaton per language; the fewest phrases win."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from litgraph.llm.common import staged

SEGMENT = 512  # symbols parsed in a row; many segments are parsed side by side, and a phrase ends with its segment
SLICE = 1 << 20  # characters of one text in memory at once
UNKNOWN = "und"


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a text: for each state its steps, from symbol to next state."""
    following, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in following[at]:
            following[at][c] = new
            at = link[at]
        if at >= 0:
            hit = following[at][c]
            if length[at] + 1 == length[hit]:
                link[new] = hit
            else:
                twin = len(following)
                following.append(dict(following[hit]))
                link.append(link[hit])
                length.append(length[at] + 1)
                link[hit] = link[new] = twin
                while at >= 0 and following[at].get(c) == hit:
                    following[at][c] = twin
                    at = link[at]
        last = new
    return following


def interleaved(following: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, following): the step of a state by a symbol stands at base[state] + symbol, if that is the state's own.

    States of several steps are placed first, each where all of its places are free; the others fill the gaps. So there
    are hardly more places than steps, whatever the number of symbols.
    """
    base = np.zeros(len(following), np.int32)
    owner: list[int] = [-1] * (2 * symbols)
    to = [0] * len(owner)
    begin = symbols
    for state in sorted((s for s, steps in enumerate(following) if len(steps) > 1), key=lambda s: -len(following[s])):
        steps, at, tries = following[state], begin, 0
        while any(owner[at + c] >= 0 for c in steps):
            at, tries = at + 1, tries + 1
            if at + symbols > len(owner):
                owner += [-1] * len(owner)
                to += [0] * len(to)
        begin = at if tries > 16 else begin  # what lies before is nearly full
        base[state] = at
        for c, n in steps.items():
            owner[at + c], to[at + c] = state, n
    single = [s for s, steps in enumerate(following) if len(steps) == 1]
    gaps = np.flatnonzero(np.array(owner[symbols:]) < 0) + symbols
    places = np.append(gaps, len(owner) + np.arange(max(len(single) - len(gaps), 0)))[:len(single)].tolist()
    more = max(places[-1] + 1 - len(owner) if places else 0, 0)
    owner += [-1] * more
    to += [0] * more
    for state, at in zip(single, places):
        (c, n), = following[state].items()
        base[state], owner[at], to[at] = at - c, state, n
    used = max((at for at, s in enumerate(owner) if s >= 0), default=0) + 1 + symbols
    spare = max(used - len(owner), 0)
    return base, np.array((owner + [-1] * spare)[:used], np.int32), np.array((to + [0] * spare)[:used], np.int32)


class Model:
    """Parses texts against the automata of all languages at once.

    Every letter of the samples has a symbol of its own; letters of no sample share one, which no automaton knows.
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        symbols = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        other = len(symbols) + 1
        self.lookup = np.zeros(0x110000, np.uint16 if other < 1 << 16 else np.uint32)  # 0: anything but letters
        for point in range(0x110000):
            if unicodedata.category(chr(point))[0] == "L":
                self.lookup[point] = other
        for n, c in enumerate(symbols):
            self.lookup[ord(c)] = n + 1
        width = other + 1
        self.bits, bases, owners, tos, self.begin = [], [], [], [], np.zeros((len(self.languages), width), np.int32)
        roots, states, places = [], 0, 0
        for n, language in enumerate(self.languages):
            codes = self._codes(samples[language])
            following = automaton(codes.tolist())
            base, owner, to = interleaved(following, width)
            self.begin[n] = states
            for c, step in following[0].items():
                self.begin[n, c] = states + step
            bases.append(base + places)
            owners.append(np.where(owner >= 0, owner + states, -1))
            tos.append(to + states)
            roots.append(states)
            states, places = states + len(base), places + len(owner)
            self.bits.append(np.log2(max(len(codes), 2)))
        join = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
        self.base, self.owner, self.to, self.roots = join(bases), join(owners), join(tos), np.array(roots, np.int32)

    def _codes(self, text: str) -> np.ndarray:
        """Symbols of a text: lower case, every run of other characters being one separator."""
        codes = self.lookup[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]

    def _segments(self, text: str) -> tuple[list[np.ndarray], int]:
        found, letters = [], 0
        for at in range(0, len(text), SLICE):
            codes = self._codes(text[at:at + SLICE])
            letters += int(np.count_nonzero(codes))
            found += [codes[a:a + SEGMENT] for a in range(0, len(codes), SEGMENT)]
        return found, letters

    def _phrases(self, segments: list[np.ndarray]) -> np.ndarray:
        """Phrases of each segment (rows) in each language (columns)."""
        sizes = np.array([len(s) for s in segments])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((SEGMENT, len(segments)), np.int32)
        for column, n in enumerate(order.tolist()):
            grid[:sizes[n], column] = segments[n]
        longer = np.searchsorted(-sizes[order], -np.arange(SEGMENT))  # segments that reach beyond a place
        state = np.repeat(self.roots[:, None], len(segments), axis=1)
        count = np.zeros(state.shape, np.int32)
        roots = self.roots[:, None]
        for place in range(int(sizes.max(initial=0))):
            n = longer[place]
            codes, now = grid[place, :n], state[:, :n]
            at = self.base.take(now) + codes
            goes_on = self.owner.take(at) == now
            count[:, :n] += ~goes_on | (now == roots)  # what is read at the root begins a phrase, and so does what ends one
            state[:, :n] = np.where(goes_on, self.to.take(at), self.begin.take(codes, axis=1))
        out = np.zeros((len(segments), len(self.roots)), np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None], at_once: int = 4096) -> tuple[list[str], list[float], list[float]]:
        """Language, score and mean phrase length of each text; whole texts, in groups of ``at_once`` segments."""
        phrases = np.zeros((len(texts), len(self.languages)))
        letters, symbols = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def parse() -> None:
            np.add.at(phrases, owners, self._phrases(held))
            held.clear()
            owners.clear()
        for n, text in enumerate(texts):
            segments, letters[n] = self._segments(text or "")
            symbols[n] = sum(map(len, segments))
            for segment in segments:
                held.append(segment)
                owners.append(n)
                if len(held) >= at_once:
                    parse()
        if held:
            parse()
        names, scores, spans = [], [], []
        cost = phrases * np.array(self.bits) if self.languages else phrases
        for n in range(len(texts)):
            if not letters[n] or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                spans.append(0.0)
                continue
            order = np.argsort(cost[n], kind="stable")
            best = order[0]
            names.append(self.languages[best])
            scores.append(float(1 - cost[n, best] / cost[n, order[1]]) if len(order) > 1 else 1.0)
            spans.append(float(symbols[n] / phrases[n, best]))
        return names, scores, spans


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 30_000,
    rows_per_language: int = 64, total_chars: int = 3_000_000,
) -> Model:
    """Automata of a bounded sample: per language ``sample_chars`` characters of ``rows_per_language`` labelled rows.

    Over total_chars / sample_chars languages each one's sample is shorter, so that all have ``total_chars`` at most.

    Rows that are held out, have no language or no text are not used. The rows of least hash are taken; of each one
    at most an eighth of the sample's characters, so that no long text fills it. The driver gets this sample only.
    """
    labelled = docs.filter(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = staged(labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).withColumn(
        "n", F.row_number().over(order)).filter(F.col("n") <= rows_per_language), "chosen-rows")
    languages = chosen.select("lang").distinct().count()
    sample_chars = min(sample_chars, total_chars // max(languages, 1))
    share = max(sample_chars // 8, 1)
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.substring(text_col, 1, share).alias("text"))
    found = rows.join(F.broadcast(chosen), ["id", "lang"]).dropDuplicates(["id", "lang", "text"]).collect()
    samples: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (str(r["lang"]), r["n"], r["text"])):
        samples[str(r["lang"])] = (samples.get(str(r["lang"]), "") + r["text"] + "\n")[:sample_chars]
    return Model(samples)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 30_000,
    model: Model | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, lang_pred, score, span, and the columns named in ``carry``.

    A text is parsed, in segments of SEGMENT symbols, into the longest strings that occur in a language's sample. Phrases times
    the bits of a sample position are the cost; the least cost wins, ties go to the first name. ``score`` is one less
    the quotient of the least and second least cost; ``span`` is the mean phrase length of the winner. ``und`` with
    score 0 is given to null texts, texts without a letter and if nothing could be learned. The prediction reads the
    text alone. Null ids are not held out apart from what the crc of an empty text says. Repeated rows are predicted
    each. Empty input gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    model = model or train(docs, id_col, text_col, lang_col, sample_chars)
    shared = spark.sparkContext.broadcast(model)  # some 40 bytes for each character of the samples, total_chars at most

    others = [c for c in carry if c != text_col]
    rows = docs.select(
        F.col(id_col).alias("_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("_text"), *others)
    kept = ["_text"] if text_col in carry else []
    names = ["_id", "held_out", "lang_pred", "score", "span", *kept, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                said, scores, spans = shared.value.predict(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(spans, pa.float64()), *batch.columns[2 if kept else 3:]], names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"_id {kinds['_id']}, held_out boolean, lang_pred string, score double, span double"
    schema += "".join(f", `{c}` {kinds[c]}" for c in [*kept, *others])
    found = rows.mapInArrow(run, schema).withColumnRenamed("_text", text_col)
    return found.select(*([] if id_col in carry else [F.col("_id").alias(id_col)]), *names[1:5], *carry)
