"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the pairs cost no more than the terms, as
2 sum_{i<j} <v_i, v_j> x_i x_j = |sum v_i x_i|^2 - sum |v_i|^2 x_i^2.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, rows_of

WORDS, BINS, RANK = 1 << 15, 10, 8
STATS = 16

def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure statistics in 0..1 each; of an empty text zeros."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    top = [c for _, c in counts.most_common(3)]
    upper, digits = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), sum(map(text.count, "0123456789"))
    return [
        min(1.0, np.log1p(len(words)) / 12),
        len(counts) / m,
        (top[0] / m) if top else 0.0,
        sum(top) / m,
        min(1.0, 2 * upper / n),
        min(1.0, 5 * digits / n),
        min(1.0, 20 * text.count("!") / n),
        min(1.0, 20 * text.count("|") / n),
        min(1.0, 10 * sum(map(text.count, "#$%&*")) / n),
        min(1.0, 10 * sum(map(text.count, "<>{}[]=_\\/")) / n),
        min(1.0, 20 * (text.count(".") + text.count("?")) / n),
        min(1.0, 20 * text.count(",") / n),
        min(1.0, (n - text.count(" ")) / m / 20),
        len(set(lines)) / len(lines),
        min(1.0, 50 * len(lines) / n),
        min(1.0, max(map(len, lines)) / n),
    ]


class Features:
    """Sorted feature numbers and their values. Words by hash, then each statistic and metadata column in bins of its own."""

    def __init__(self, metadata: int):
        self.metadata, self.size = metadata, WORDS + (STATS + metadata) * BINS
        self.hashed: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if len(self.hashed) > 250_000:
            self.hashed.clear()
        self.hashed[word] = b = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % WORDS
        return b

    def of(self, text: str | None, metadata: list) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        got = self.hashed.get
        buckets = np.array([b if (b := got(w)) is not None else self.bucket(w) for w in counts], np.int64)
        at, which = np.unique(buckets, return_inverse=True)
        value = np.sqrt(np.bincount(which, np.fromiter(counts.values(), np.float64, len(counts)), len(at))) if len(at) else np.zeros(0)
        value = value / max(1e-9, np.sqrt((value**2).sum()))
        extra = [min(BINS - 1, int(s * BINS)) for s in statistics(text, words, counts)]
        extra += [0 if x is None or x != x or x < 0 else min(BINS - 1, 1 + int(np.log10(1 + x) * 1.5)) for x in metadata]
        more = WORDS + np.arange(len(extra)) * BINS + np.array(extra)
        return np.concatenate([at, more]), np.concatenate([value, np.full(len(more), 0.5)])


@dataclass
class Machine:
    """bias, weight of each feature, and its RANK factors."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        parts = [self._margins(rows[k : k + 128]) for k in range(0, len(rows), 128)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        at, x = (np.concatenate(c) for c in zip(*rows))
        begin = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
        vx = self.factor[at] * x[:, None]
        pairs = (np.add.reduceat(vx, begin) ** 2 - np.add.reduceat(vx**2, begin)).sum(1) / 2
        return self.bias + np.add.reduceat(self.weight[at] * x, begin) + pairs

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Logistic loss by AdaGrad, a row at a time. One class only, or no rows: its (smoothed) share for every text."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    if len(set(labels.tolist())) < 2:
        m.factor[:] = 0
        return m
    seen, seen_v = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            v = m.factor[at]
            vx = v * x[:, None]
            total = vx.sum(0)
            z = m.bias + m.weight[at] @ x + (total @ total - (vx**2).sum()) / 2
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            dw = g * x + decay * m.weight[at]
            dv = g * (x[:, None] * total - v * (x**2)[:, None]) + decay * v
            seen[at] += dw**2
            seen_v[at] += dv**2
            m.bias -= 0.01 * g
            m.weight[at] -= rate * dw / np.sqrt(seen[at])
            m.factor[at] = v - rate * dv / np.sqrt(seen_v[at])
    return m


def held_out() -> F.Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), most: int = 12_000) -> Machine:
    """A machine fit on `most` labelled rows at most, the first by a hash of doc_id, never on held-out ones.

    labels: doc_id, quality 0 or 1 (others and nulls are ignored; several of one doc_id count by their mean).
    """
    marks = rows_of(labels, doc_id="bigint", quality="double").where(F.col("quality").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("_label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    features = Features(len(metadata))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features.of(t, list(m)) for t, *m in zip(batch["text"].to_pylist(), *(batch[c].to_pylist() for c in metadata))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_label"], pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "at", "x"])

    rows = rows_of(docs, doc_id="bigint", text="string", **{c: "double" for c in metadata}).join(F.broadcast(chosen), "doc_id")
    got = rows.mapInArrow(run, "doc_id bigint, label double, at binary, x binary").toPandas().sort_values(["doc_id", "at"], kind="stable")
    data = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for a, x in zip(got["at"], got["x"])]
    return fit(data, got["label"].to_numpy(np.float64), features.size)


def scored(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """docs with a score in 0..1 in column `name`, which replaces one of that name; all rows, whole texts, null text as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop(name)
    free = [free_name(docs, f"_meta{k}") for k in range(len(metadata))]
    if docs.schema["text"].dataType.typeName() != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    extra = [F.col(f"`{c}`").cast("double").alias(f) for f, c in zip(free, metadata)]
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    keep, place = len(schema) - 1, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(len(metadata)), sent.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):  # a few texts' features at a time
                batch = whole.slice(k, 500)
                meta = [batch.column(keep + c).to_pylist() for c in range(len(metadata))]
                rows = [features.of(t, list(x)) for t, *x in zip(batch.column(place).to_pylist(), *meta)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(m.scores(rows))], names=[f.name for f in schema])

    return docs.select("*", *extra).mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame, least: float = 0.7, metadata: tuple[str, ...] = (), most: int = 12_000) -> DataFrame:
    """The documents whose score is `least` or more, with the columns of docs.

    Null texts are scored as empty ones; repeated rows and rows without a doc_id are scored each. Without labels every score is 0.5. An empty
    table gives none.
    """
    name = free_name(docs, "_score")
    return scored(docs, trained(docs, labels, metadata, most), metadata, name).where(F.col(name) >= least).drop(name)
