"""Operator 1, URL filters: rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``domain/path``) that fits, and its verdict; nulls where none does.

    A rule fits its domain and all subdomains if the path starts with the rule's. Of rules of one length that both
    fit, the first by text is taken.
    """
    rule = F.lit(None).cast("string")
    for text in sorted(sorted(rules, reverse=True), key=len):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    verdict = F.lit(None).cast("string")
    for text, said in rules.items():
        verdict = F.when(F.col("rule") == text, F.lit(said)).otherwise(verdict)
    return rule, verdict


class UrlModel:
    """Logistic regression; a URL's features are the shares of its hashed n-grams of host and path."""

    def __init__(self, bits: int = 18, sizes: tuple[int, ...] = (3, 4, 5)) -> None:
        self.bits, self.sizes = bits, sizes
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def features(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, value) of all n-grams; host and path stand between marks of their own."""
        rows, buckets = [], []
        for mark, texts in ((b"\x01", hosts), (b"\x02", paths)):
            raw = [mark + t.encode("utf-8", "surrogatepass") + mark for t in texts]
            data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
            lengths = np.array([len(r) for r in raw], np.int64)
            owner = np.repeat(np.arange(len(raw)), lengths)
            for n in self.sizes:
                count = len(data) - n + 1
                if count <= 0:
                    continue
                mixed = np.full(count, n, np.uint64)
                for j in range(n):
                    mixed = (mixed ^ data[j:j + count]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(31)
                inside = owner[:count] == owner[n - 1:]
                rows.append(owner[:count][inside])
                buckets.append((mixed[inside] ^ np.uint64(mark[0] * 0x51ED27)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits))
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        bucket = np.concatenate(buckets).astype(np.int64) if buckets else np.zeros(0, np.int64)
        number = np.bincount(row, minlength=len(hosts))
        return row, bucket, 1 / np.sqrt(np.maximum(number[row], 1))

    def fit(self, hosts: list[str], paths: list[str], bad: np.ndarray, rounds: int = 200, rate: float = 4.0, decay: float = 1e-5) -> UrlModel:
        """Batch gradient descent with momentum; both classes weigh the same."""
        row, bucket, value = self.features(hosts, paths)
        used, at = np.unique(bucket, return_inverse=True)
        weights, bias, speed, bias_speed = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
        ones = max(bad.sum(), 1)
        share = np.where(bad, 0.5 / ones, 0.5 / max(len(bad) - ones, 1))
        for _ in range(rounds):
            found = np.bincount(row, value * weights[at], len(bad)) + bias
            slope = (1 / (1 + np.exp(-np.clip(found, -30, 30))) - bad) * share
            speed = 0.9 * speed - rate * (np.bincount(at, value * slope[row], len(used)) + decay * weights)
            bias_speed = 0.9 * bias_speed - rate * slope.sum()
            weights, bias = weights + speed, bias + bias_speed
        self.weights[used], self.bias = weights, bias
        return self

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that each URL is bad."""
        row, bucket, value = self.features(hosts, paths)
        found = np.bincount(row, value * self.weights[bucket], len(hosts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(found, -30, 30)))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "bad", rows_per_class: int = 2000) -> UrlModel:
    """Fits a model on at most ``rows_per_class`` distinct URLs of each class, those of least hash; nulls are not used."""
    rows = labelled.select(
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(label_col).cast("boolean").alias("bad"),
    ).filter("bad IS NOT NULL AND host <> ''").distinct()
    found = []
    for bad in (True, False):
        found += rows.filter(F.col("bad") == bad).orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows_per_class).collect()
    return UrlModel().fit([r["host"] for r in found], [r["path"] for r in found], np.array([r["bad"] for r in found], bool))


def judge(pages: DataFrame, model: UrlModel, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict, score (probability that the URL is bad).

    The rule's verdict counts where a rule fits, else ``block`` from ``threshold`` on. Null URLs and those without
    ``://`` have an empty host and path and the model's verdict for no n-gram. Repeated rows are judged each; null
    ids stay. Empty input gives no rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # 2 MiB, the size of its weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["id", "host", "path", "score"])
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.withColumn("rule", rule).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"), "score")
