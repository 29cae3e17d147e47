"""I-Match fingerprints: hashes of a document's terms in randomised subsets of a lexicon of middling document frequency.

The lexicon is the terms whose document frequency lies in a band. Random subsets of it, of several densities, each keep some
of a document's distinct terms; those terms, sorted, are hashed to one 64-bit value a subset. A fingerprint is the number of the
document's lexicon terms and these values, from the densest subsets on that a comparison reads. Two fingerprints are compared at the density which leaves them few terms a subset: the
part of subsets whose values agree is their likeness.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored

#: A subset of density level v keeps a term with probability 2^-v, 40 subsets a level.
LEVELS, SUBSETS = tuple(range(0, 15, 2)), 40
TERM = re.compile(r"[^\W_]+")
#: Ranges of doc_id, whose ends are broadcast: at most so many.
MOST_PARTS = 20_000


def terms(text: str | None) -> list[str]:
    """Distinct runs of letters and digits in lower case."""
    return list(set(TERM.findall((text or "").lower())))


class Hashes(dict):
    """64-bit hashes of terms, kept while there are fewer than 100,000."""

    def __missing__(self, term: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms(text)), np.uint64)


def lexicon(docs: DataFrame, rarest: float, commonest: float) -> tuple[int, np.ndarray]:
    """How many documents there are, and the sorted hashes of the terms that occur in a share of rarest..commonest of them, at least in two.

    A document has a mean of t distinct terms, so at most t / rarest terms reach the band, however many documents there are:
    that bounds what reaches the driver and is broadcast (8 bytes a term). Both come from one pass over the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, rows, n = Hashes(), [], 0, 0

        def out() -> pa.RecordBatch:
            term, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(many)], names=["term", "n"])

        for batch in batches:
            n += batch.num_rows
            for k in range(0, batch.num_rows, 500):
                more = list(map(hashes.of, batch["text"].slice(k, 500).to_pylist()))
                held += more
                rows += sum(map(len, more))
                if rows > 1_000_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n])], names=["term", "n"])

    counted = stored(docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    n = next((r.n for r in counted.where("term IS NULL").collect()), 0)
    band = counted.where(F.col("term").isNotNull() & (F.col("n") >= max(2, rarest * n)) & (F.col("n") <= max(2, commonest * n))).select("term").toArrow()
    return n, np.sort(band["term"].to_numpy())


def usual_level(n: int) -> int:
    """The level that leaves n terms a quarter to one a subset; the last but one at most."""
    return min(len(LEVELS) - 2, max(0, int(np.log2(max(n, 1)) / 2 + 0.75)))


@dataclass
class Print:
    """A fingerprint: how many terms it has, its first level, and by level from there and subset the values, and where there is one."""

    n: int
    first: int
    values: np.ndarray
    there: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit word's bits spread over all of them."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


#: Odd factor whose powers tell the places of a subset's terms, and the most terms handled at once.
PLACE, AT_ONCE = 0x9E3779B97F4A7C15, 1 << 13


class Subsets:
    """Fingerprints of arrays of term hashes. A subset keeps the terms whose product with its salt is small; the sparser ones of a salt keep some of the denser ones' terms."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self.salts = np.random.default_rng(11).integers(1, 1 << 63, size=SUBSETS, dtype=np.uint64) | np.uint64(1)
        self.limits = np.array([(1 << 64 - v) - 1 for v in LEVELS], np.uint64)

    def prints(self, texts: list[np.ndarray]) -> list[Print]:
        """One for each array. Terms outside the lexicon don't count, but all do where none is in it."""
        out, k = [], 0
        while k < len(texts):
            size, begin = 0, k
            while k < len(texts) and (k == begin or size + len(texts[k]) <= AT_ONCE):
                size, k = size + len(texts[k]), k + 1
            out += self._prints(texts[begin:k])
        return out

    def _prints(self, texts: list[np.ndarray]) -> list[Print]:
        h, own = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        at = np.minimum(np.searchsorted(self.lexicon, h.view(np.int64)), max(0, len(self.lexicon) - 1))
        kept = self.lexicon[at] == h.view(np.int64) if len(self.lexicon) else np.zeros(len(h), bool)
        kept |= np.bincount(own, kept, len(texts))[own] == 0
        h, own = h[kept], own[kept]
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        n = np.bincount(own, minlength=len(texts))
        first = np.array([usual_level(x) for x in n.tolist()], np.int64)
        values, there = np.zeros((len(texts), len(LEVELS), SUBSETS), np.uint64), np.zeros((len(texts), len(LEVELS), SUBSETS), bool)
        with np.errstate(over="ignore"):
            spread, group = [], []
            for a in range(0, len(h), AT_ONCE):
                part = h[a : a + AT_ONCE, None] * self.salts
                row, subset = np.nonzero(part <= self.limits[first[own[a : a + AT_ONCE]]][:, None])
                spread.append(part[row, subset])
                group.append(own[a + row] * SUBSETS + subset)
            if not spread:
                return [Print(0, 0, values[k], there[k]) for k in range(len(texts))]
            product, group = np.concatenate(spread), np.concatenate(group)
            by = np.argsort(group, kind="stable")  # each subset's terms stay in order
            product, group = product[by], group[by]
            for k in range(len(LEVELS)):
                now = (product <= self.limits[k]) & (first[group // SUBSETS] <= k)
                p, g = product[now], group[now]
                if not len(g):
                    continue
                start = np.flatnonzero(np.diff(g, prepend=-1))
                place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
                power = np.append(np.uint64(1), np.full(place.max(), PLACE, np.uint64)).cumprod(dtype=np.uint64)
                values[g[start] // SUBSETS, k, g[start] % SUBSETS] = mixed(np.add.reduceat(mixed(p) * power[place], start))
                there[g[start] // SUBSETS, k, g[start] % SUBSETS] = True
        return [Print(int(n[k]), int(first[k]), values[k], there[k]) for k in range(len(texts))]


def written(print_: Print) -> str:
    """In hexadecimal: the number of terms and the first level; then by level which of the subsets keep a term, and their values, 16 digits each."""
    levels = []
    for values, there in zip(print_.values[print_.first :], print_.there[print_.first :]):
        levels.append(np.packbits(there).tobytes().hex() + values[there].astype(">u8").tobytes().hex() if there.any() else "")
    return f"{print_.n:x}:{print_.first:x}:" + ",".join(levels).rstrip(",") if print_.n else "0"


def likeness(a: Print, b: Print) -> float:
    """The part of subsets with equal values, of those that keep a term of either, at the two densities next to one term; none: 1 if both are empty, else 0."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    level = usual_level(max(a.n, b.n))
    rows = slice(level, level + 2)
    used, both = a.there[rows] | b.there[rows], a.there[rows] & b.there[rows]
    return float((both & (a.values[rows] == b.values[rows])).sum() / used.sum()) if used.any() else float(a.n == b.n)


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, rarest: float = 2e-4, commonest: float = 0.02, rows_a_part: int = 5_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    Null text is the empty one; an empty text has the fingerprint of no terms. The next document is that of the next smaller doc_id (ties:
    in order of a hash of the text), after the smallest comes the largest; a single document is its own next. Rows without a doc_id come last
    among the next. Repeated rows get a row each. A document none of whose terms is in the band is hashed by all its terms.
    An empty table gives no rows. Other columns are ignored.

    Neighbours meet without an order of all rows in one task: doc_ids are cut into ranges at approximate quantiles, and
    the largest row of each range is also sent to the range above, where it is the next of the smallest.
    """
    spark = docs.sparkSession
    rows = rows_of(docs, doc_id="bigint", text="string").withColumns({"text": F.coalesce("text", F.lit("")), "doc_id": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    rows_in_all, band = lexicon(rows, rarest, commonest)
    keep = spark.sparkContext.broadcast(band)
    n = min(MOST_PARTS, max(1, -(-rows_in_all // rows_a_part)))
    cuts = np.unique(np.array(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy()).astype(np.int32))

    dealt = rows.withColumns({"part": part_of("doc_id"), "tie": F.xxhash64("text")})
    # the largest row of each range; the range above it takes a copy, and the lowest one a copy of the largest of all
    tops = {r.part: r.top for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    above = {p: q for p, q in zip(order, [*order[1:], order[0]] if order else [])}
    firsts = [(int(p), int(tops[p]), int(q)) for p, q in above.items()]
    if not firsts:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # of rows that tie for a top the first is the next one
    heads = spark.createDataFrame(firsts, "part int, doc_id bigint, to int")
    copies = dealt.join(F.broadcast(heads), ["part", "doc_id"]).groupBy("to").agg(F.min_by("text", "tie").alias("text")).select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("to").alias("part"), F.lit(0).cast("bigint").alias("tie"))
    both = dealt.select("doc_id", "text", "part", "tie").unionByName(copies)
    packed = both.mapInArrow(_squeezed, "doc_id bigint, raw binary, part int, tie bigint")
    sorted_ = packed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.desc_nulls_last("doc_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes, subsets, unpack = Hashes(), Subsets(keep.value), zstandard.ZstdDecompressor()
        last: list[tuple] = []  # range, doc_id, text and fingerprint of the row before; no doc_id: the copy that ends a range

        for whole in batches:
            for k in range(0, whole.num_rows, 100):  # a few texts at a time
                batch = whole.slice(k, 100)
                texts = [unpack.decompress(x).decode("utf-8", "surrogatepass") if x else "" for x in batch["raw"].to_pylist()]
                rows = list(zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), texts))
                line = [x[:3] for x in last] + rows
                pairs = [(i, edited(line[i][2], line[i + 1][2])) for i in range(len(line) - 1) if line[i][0] == line[i + 1][0] and line[i][1] is not None]
                prints = [x[3] for x in last]
                prints += subsets.prints([hashes.of(t) for t in texts] + [hashes.of(t) for _, t in pairs])
                out = []
                for (i, changed), new in zip(pairs, prints[len(line) :]):
                    _, doc_id, text = line[i]
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((None if doc_id == -(1 << 63) else doc_id, len(text), sha, written(prints[i]), written(new), likeness(prints[i], new), likeness(prints[i], prints[i + 1])))
                last = [(*line[-1], prints[len(line) - 1])]
                columns = list(zip(*out)) or [()] * 7
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return sorted_.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are sent."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([pack.compress(t) if t else b"" for t in texts], pa.binary()), batch["part"], batch["tie"]], names=["doc_id", "raw", "part", "tie"])
