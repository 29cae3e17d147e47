"""Language ID by hierarchical discrimination: first the family, then one-versus-one linear support vector machines within it.

Features are hashed runs of one to three bytes of the lower-cased whole text, as square roots of their shares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of

#: Families of closely related languages. A language that is in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "malayic": "id jv ms su tl",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
SIZE = 1 << 12
LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return FAMILY.get(code, code)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed runs of 1 to 3 bytes, a vector of length one per kind (zeros for an empty text)."""
    counts = np.zeros((2, SIZE))
    raw = text.lower().encode("utf-8", "surrogatepass")
    for k in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[k : k + (1 << 20) + 2], np.uint8).astype(np.int64)
        if len(b) > 1:
            counts[0] += np.bincount((b[:-1] * 251 + b[1:]) % SIZE, minlength=SIZE)
        if len(b) > 2:
            counts[1] += np.bincount((b[:-2] * 63_689 + b[1:-1] * 251 + b[2:] * 7) % SIZE, minlength=SIZE)
        if len(raw) == 1:
            counts[0][b[0]] += 1
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).ravel()


@dataclass
class Pairwise:
    """One-versus-one linear machines: for each two classes, positive margins are for the first."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 2 * SIZE + 1)))

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], epochs: int = 30, decay: float = 1e-4) -> Pairwise:
        classes = sorted(set(y))
        pairs, names = list(combinations(range(len(classes)), 2)), np.array(y)
        rows = [cls.machine(x[np.isin(names, [classes[a], classes[b]])], np.where(names[np.isin(names, [classes[a], classes[b]])] == classes[a], 1.0, -1.0), epochs, decay) for a, b in pairs]
        return cls(classes, pairs, np.array(rows).reshape(len(pairs), x.shape[1] + 1))

    @staticmethod
    def machine(x: np.ndarray, y: np.ndarray, epochs: int, decay: float) -> np.ndarray:
        """Hinge loss by averaged subgradient steps on batches of 32; both classes weigh the same."""
        rng, w, mean, steps = np.random.default_rng(3), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
        side = {s: np.flatnonzero(y == s) for s in (1.0, -1.0)}
        for epoch in range(epochs):
            for _ in range(max(1, len(y) // 32)):
                at = np.concatenate([rng.choice(rows, 16) for rows in side.values()])
                wrong = at[y[at] * (x[at] @ w[:-1] + w[-1]) < 1]
                rate = 2.0 / (1 + 0.05 * steps)
                w *= 1 - rate * decay
                w[:-1] += rate / 32 * (y[wrong] @ x[wrong])
                w[-1] += rate / 32 * y[wrong].sum() * 0.1
                steps += 1
                if epoch:
                    mean += w
        return mean / max(1, steps - steps // epochs) if epochs > 1 else w

    def votes(self, x: np.ndarray) -> np.ndarray:
        """A share for each class and row of x: the mean of its machines' odds, one for a single class."""
        if len(self.classes) == 1:
            return np.ones((len(x), 1))
        out = np.zeros((len(x), len(self.classes)))
        margin = x @ self.weight[:, :-1].T + self.weight[:, -1]
        odds = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        for k, (a, b) in enumerate(self.pairs):
            out[:, a] += odds[:, k]
            out[:, b] += 1 - odds[:, k]
        return out / (len(self.classes) - 1)


@dataclass
class Model:
    family: Pairwise
    within: dict[str, Pairwise]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score each; `und` with score one for a text without letters, with score zero if none was learned."""
        lang, score = ["und"] * len(texts), [1.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        if not self.family.classes:
            for k in rows:
                score[k] = 0.0
            return lang, score
        for begin in range(0, len(rows), 64):
            part = rows[begin : begin + 64]
            x = np.stack([features(texts[k]) for k in part])
            families = self.family.votes(x)
            best = families.argmax(1)
            for f in set(best.tolist()):
                own = np.flatnonzero(best == f)
                machine = self.within[self.family.classes[f]]
                votes = machine.votes(x[own])
                for i, v in zip(own.tolist(), votes):
                    lang[part[i]] = machine.classes[int(v.argmax())]
                    score[part[i]] = float(min(1.0, families[i, f] * v.max()))
        return lang, score


def held_out() -> F.Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, most: int = 500, total: int = 4_000) -> Model:
    """Machines fit on the first documents of each language by a hash of doc_id: `most` each and about `total` in all, at most.

    Texts without letters and null languages are left out.
    """
    rows = rows_of(docs, doc_id="bigint", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    dice = F.xxhash64("doc_id")
    # a hash threshold thins the languages before they are ranked, so that a common one isn't gathered whole in one task
    sizes = rows.select("lang").groupBy("lang").count()
    most = max(10, min(most, total // max(1, sizes.count())))
    thin = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(F.pmod(dice, F.lit(1 << 30)) < F.lit(2.0 * most * (1 << 30)) / F.col("count"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(dice, "doc_id"))
    chosen = thin.withColumn("r", rank).where(F.col("r") <= most).select("doc_id", F.col("lang").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) if t and LETTER.search(t) else np.zeros(0) for t in batch["text"].to_pylist()]
            at = [np.flatnonzero(v) for v in x]
            columns = [[a.astype("<u2").tobytes() for a in at], [v[a].astype("<f4").tobytes() for v, a in zip(x, at)]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_lang"], *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "lang", "at", "x"])

    picked = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id bigint, lang string, at binary, x binary")
    got = picked.where(F.length("x") > 0).toPandas().sort_values(["doc_id", "lang", "at"], kind="stable")
    if not len(got):
        return Model(Pairwise([]), {})
    x, langs = np.zeros((len(got), 2 * SIZE), np.float32), got["lang"].tolist()
    for k, (at, v) in enumerate(zip(got["at"], got["x"])):
        x[k, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f4")
    families = [family_of(s) for s in langs]
    own = {f: [k for k, g in enumerate(families) if g == f] for f in set(families)}
    return Model(Pairwise.fit(x, families), {f: Pairwise.fit(x[rows], [langs[k] for k in rows]) for f, rows in own.items()})


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone; null text: `und`. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = sent.value.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows_of(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
