"""Operator 12, quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import staged

PASSAGE = 512  # bytes; a text is a bag of such passages, the last one being shorter
AT_ONCE = 2048  # passages encoded together, 1 MiB of text
KINDS = 8
GRAMS = 256  # buckets of hashed byte trigrams
RUNS = 8  # bytes of the strings whose repeats are counted


def _classes() -> tuple[np.ndarray, int]:
    """A class for each byte: letters by case, digits, blank, line feed, other controls, bytes over 127, each mark."""
    table = np.zeros(256, np.int64)
    for byte in range(256):
        c = chr(byte)
        table[byte] = (
            0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c == " " else 4 if c == "\n"
            else 5 if byte < 32 or byte == 127 else 6 if byte > 127 else -1)
    marks = np.flatnonzero(table < 0)
    table[marks] = 7 + np.arange(len(marks))
    return table, 7 + len(marks)


CLASS, CLASSES = _classes()
KIND = np.minimum(CLASS, KINDS - 1)  # marks share one
FEATURES = CLASSES + KINDS * KINDS + GRAMS + 4


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def encode(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of passages: ``data`` holds one a row, ``lengths`` their bytes; what lies behind these does not count.

    Roots of the shares of byte classes, of pairs of kinds and of hashed trigrams; then the share of repeated strings of
    RUNS bytes, the share of words that equal the one before, the mean word length and the passage's fill.
    """
    n, width = data.shape
    out = np.zeros((n, FEATURES), np.float32)
    row = np.arange(n)[:, None]
    inside = np.arange(width)[None, :] < lengths[:, None]
    many = np.maximum(lengths, 1)[:, None]

    def shares(bucket: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        found = np.bincount((row * size + bucket)[counts], minlength=n * size).reshape(n, size)
        return np.sqrt(found / many)
    at = 0
    out[:, at:(at := at + CLASSES)] = shares(CLASS[data], inside, CLASSES)
    kind = KIND[data]
    out[:, at:(at := at + KINDS * KINDS)] = shares(kind[:, :-1] * KINDS + kind[:, 1:], inside[:, 1:], KINDS * KINDS)
    wide = data.astype(np.uint32)
    gram = (wide[:, :-2] * np.uint32(0x9E3779B1)) ^ (wide[:, 1:-1] * np.uint32(0x85EBCA77)) ^ (wide[:, 2:] * np.uint32(0xC2B2AE3D))
    gram = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(24)
    out[:, at:(at := at + GRAMS)] = shares(gram.astype(np.int64), inside[:, 2:], GRAMS)
    string = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < RUNS:
        string = (string[:, :-step] * np.uint64(0x9E3779B97F4A7C15)) ^ string[:, step:]
        string ^= string >> np.uint64(29)
        step *= 2
    string = np.sort(np.where(inside[:, RUNS - 1:], string, np.uint64(2**64 - 1)), axis=1)
    again = ((string[:, 1:] == string[:, :-1]) & (string[:, 1:] != np.uint64(2**64 - 1))).sum(axis=1)
    out[:, at] = again / many[:, 0]
    blank = (data == 32) | (data == 10) | ~inside
    starts = ~blank
    starts[:, 1:] &= blank[:, :-1]
    words = starts.sum(axis=1)
    power = np.where(blank, np.uint64(0), np.uint64(0x9E3779B97F4A7C15))
    owner, place = np.nonzero(starts)
    flat = owner * width + place
    if len(flat):
        letters = ((data.astype(np.uint64) + np.uint64(1)) * power).ravel()
        turn = (np.arange(letters.size) - np.repeat(np.append(0, flat), np.diff(np.concatenate([[0], flat, [letters.size]])))).astype(np.uint64)
        hashes = np.add.reduceat(letters * (np.uint64(2) * turn + np.uint64(1)), flat)
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        out[:, at + 1] = np.bincount(owner[1:][same], minlength=n) / np.maximum(words, 1)
    out[:, at + 2] = np.minimum((~blank).sum(axis=1) / np.maximum(words, 1) / 32, 4)
    out[:, at + 3] = lengths / PASSAGE
    return out


def passages(texts: list[bytes], at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, passage's number, bytes, lengths) of all passages of whole texts, ``at_once`` at a time.

    An empty text is one empty passage.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, number, rows, lengths = [], [], [], []
        for n, first, part in held:
            count = max(-(-len(part) // PASSAGE), 1)
            rows.append(np.frombuffer(part.ljust(count * PASSAGE, b"\0"), np.uint8).reshape(count, PASSAGE))
            own = np.full(count, PASSAGE)
            own[-1] = len(part) - (count - 1) * PASSAGE
            owner.append(np.full(count, n))
            number.append(first + np.arange(count))
            lengths.append(own)
        return np.concatenate(owner), np.concatenate(number), np.concatenate(rows), np.concatenate(lengths)
    for n, text in enumerate(texts):
        for a in range(0, max(len(text), 1), at_once * PASSAGE):
            part = text[a:a + at_once * PASSAGE]
            held.append((n, a // PASSAGE, part))
            size += max(-(-len(part) // PASSAGE), 1)
            if size >= at_once:
                yield block()
                held, size = [], 0
    if held:
        yield block()


class AttentionModel:
    """Passage encoder, gated attention and a logistic output on the weighted mean of the encoded passages.

    h = tanh(f E + e); weight of a passage ~ exp(w (tanh(h A) * sigmoid(h B))); logit = (sum of weight * h) c + d.
    """

    def __init__(self, encoded: int = 32, gates: int = 16, seed: int = 12) -> None:
        chance = np.random.default_rng(seed)
        scaled = lambda a, b: (chance.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.weights = {
            "E": scaled(FEATURES, encoded), "e": np.zeros(encoded, np.float32), "A": scaled(encoded, gates), "B": scaled(encoded, gates),
            "w": scaled(gates, 1)[:, 0], "c": scaled(encoded, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.middle, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.constant: float | None = None

    def _passages(self, features: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.weights
        h = np.tanh(((features - self.middle) / self.scale) @ p["E"] + p["e"])
        a, b = np.tanh(h @ p["A"]), 1 / (1 + np.exp(-(h @ p["B"])))
        return h, a, b, np.exp(np.clip((a * b) @ p["w"], -30, 30))

    def fit(self, features: np.ndarray, owner: np.ndarray, good: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-2) -> AttentionModel:
        """Adam on documents' logistic loss; ``owner`` is each passage's document, in order; ``weight`` each document's."""
        if not good.any() or good.all():
            self.constant = float((good.sum() + 1) / (len(good) + 2))
            return self
        self.middle, self.scale = features.mean(axis=0), features.std(axis=0) + np.float32(0.02)
        first = np.searchsorted(owner, np.arange(len(good) + 1))
        chance, p, step = np.random.default_rng(21), self.weights, 0
        speed, power = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for _ in range(epochs):
            order = chance.permutation(len(good))
            for at in range(0, len(order), batch):
                docs = order[at:at + batch]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                slopes = self._slopes(features[rows], own, good[docs].astype(np.float32), weight[docs])
                step += 1
                for k, slope in slopes.items():
                    if p[k].ndim == 2:
                        slope = slope + decay * p[k]
                    speed[k] = 0.9 * speed[k] + 0.1 * slope
                    power[k] = 0.999 * power[k] + 0.001 * slope * slope
                    p[k] -= (rate * (speed[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _slopes(self, features: np.ndarray, own: np.ndarray, good: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.weights, len(good)
        f = (features - self.middle) / self.scale
        h, a, b, e = self._passages(features)
        total = np.bincount(own, e, n)
        share = (e / total[own]).astype(np.float32)
        starts = np.searchsorted(own, np.arange(n))
        bag = np.add.reduceat(share[:, None] * h, starts, axis=0)
        said = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))
        d_logit = ((said - good) * weight / weight.sum()).astype(np.float32)
        d_bag = d_logit[:, None] * p["c"]
        d_share = (h * d_bag[own]).sum(axis=1)
        d_score = share * (d_share - np.bincount(own, share * d_share, n)[own].astype(np.float32))
        d_gate = d_score[:, None] * p["w"]
        d_a, d_b = d_gate * b * (1 - a * a), d_gate * a * b * (1 - b)
        d_h = (share[:, None] * d_bag[own] + d_a @ p["A"].T + d_b @ p["B"].T) * (1 - h * h)
        return {
            "E": f.T @ d_h, "e": d_h.sum(axis=0), "A": h.T @ d_a, "B": h.T @ d_b, "w": (a * b).T @ d_score,
            "c": bag.T @ d_logit, "d": d_logit.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of label 1, number of passages and first byte of the passage of most weight, for each whole text."""
        n = len(texts)
        bag, total = np.zeros((n, len(self.weights["e"]))), np.zeros(n)
        count, most, focus = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        for owner, number, data, lengths in passages(texts):
            h, _, _, e = self._passages(encode(data, lengths))
            new = np.flatnonzero(np.diff(owner, prepend=-1))
            docs = owner[new]
            bag[docs] += np.add.reduceat(e[:, None] * h, new, axis=0)
            total[docs] += np.add.reduceat(e, new)
            count[docs] = number[np.append(new[1:], len(owner)) - 1] + 1
            best = np.maximum.reduceat(e, new)
            at = np.flatnonzero(e >= np.repeat(best, np.diff(np.append(new, len(owner)))))
            lead = at[np.unique(owner[at], return_index=True)[1]]
            more = best > most[docs]
            most[docs[more]], focus[docs[more]] = best[more], number[lead[more]] * PASSAGE
        logit = bag / np.maximum(total, 1e-30)[:, None] @ self.weights["c"] + self.weights["d"]
        said = np.full(n, self.constant) if self.constant is not None else 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return said, count, focus


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows_per_label: int = 1500, passages_per_row: int = 32,
) -> AttentionModel:
    """Fits the model on a bounded sample: ``rows_per_label`` rows of each label that are not held out, those of least
    hash, and of each one at most ``passages_per_row`` passages evenly spread over its text. Texts do not shuffle: ids and
    hashes meet the labels, and the chosen ones are broadcast.

    The driver gets the features of these passages alone. Rows weigh as many as they stand for, so that scores are
    probabilities under the labels' true shares. Rows that repeat id and text count once; ids whose labels differ, null
    labels and null ids are not used. With
    one label only, or none, the score is a constant: its share, with one row of each label added.
    """
    said = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("good"), F.max(label_col).alias("_most")).filter("good = _most").select("id", F.col("good").cast("int"))
    rows = docs.filter(~is_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "h", F.xxhash64("id", "text"))
    known = staged(rows.select("id", "h").distinct().join(said, "id"), "labelled")
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    least = [known.filter(F.col("good") == g).orderBy("h", "id").limit(rows_per_label) for g in (0, 1)]
    chosen = rows.join(F.broadcast(least[0].unionByName(least[1])), ["id", "h"]).dropDuplicates(["id", "h"]).select("good", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for good, text, h in zip(*(c.to_pylist() for c in batch.columns)):
                raw = _utf8(text)
                n = max(-(-len(raw) // PASSAGE), 1)
                places = np.unique(np.linspace(0, n - 1, min(n, passages_per_row)).astype(np.int64))
                parts = [raw[i * PASSAGE:(i + 1) * PASSAGE] for i in places.tolist()]
                data = np.frombuffer(b"".join(p.ljust(PASSAGE, b"\0") for p in parts), np.uint8).reshape(-1, PASSAGE)
                features = encode(data, np.array([len(p) for p in parts]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([good], pa.int32()), pa.array([h], pa.int64()), pa.array([features.astype(np.float16).tobytes()], pa.binary())],
                    ["good", "h", "features"])
    found = chosen.mapInArrow(run, "good int, h bigint, features binary").collect()
    found.sort(key=lambda r: (r["h"], r["good"], bytes(r["features"])))
    bags = [np.frombuffer(r["features"], np.float16).astype(np.float32).reshape(-1, FEATURES) for r in found]
    good = np.array([r["good"] for r in found], bool)
    model = AttentionModel()
    if not found:
        model.constant = 0.5
        return model
    sampled = {g: max(int((good == bool(g)).sum()), 1) for g in (0, 1)}
    weight = np.where(good, counts.get(1, 0) / sampled[1], counts.get(0, 0) / sampled[0])
    return model.fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), good, (weight / weight.mean()).astype(np.float32))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, model: AttentionModel | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, score, predicted, passages (number), focus (byte where the passage of most weight begins).

    Every passage of the whole text is encoded; the score reads the text alone. A null or empty text is one empty
    passage and gets the score the model gives that. ``predicted`` is 1 from ``threshold`` on, else 0. Repeated rows and
    null ids are scored each; null ids are not held out apart from what the crc of an empty text says. Empty input
    gives no rows; other columns are ignored.
    """
    model = model or train(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 60 KiB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, count, focus = shared.value.score([_utf8(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.float64()), pa.array(said >= threshold).cast(pa.int32()),
                 pa.array(count, pa.int64()), pa.array(focus, pa.int64())], ["id", "held_out", "score", "predicted", "passages", "focus"])
    rows = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, held_out boolean, score double, predicted int, passages bigint, focus bigint").withColumnRenamed("id", id_col)
