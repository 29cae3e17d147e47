"""Packing: sequences of fixed length filled from source queues by deficit round-robin at target token proportions.

Every source is a queue of the tokens of its documents. A queue with weight w serves its i-th token at virtual time
(2i+1)/w; ordered by that time, ties by source, the tokens of all queues form one line, and window k is the tokens
2048k .. 2048k+2047 of the line. So each window holds each source's quantum; a fraction that a window can't serve is the
deficit which the next window owes, under one token always. A queue that runs dry leaves its share to the others in
proportion. As a token's place in the line is a closed form of its place in its own queue, windows are cut in any
partition without a pass from one to the next: the deficits cross partitions by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, stored
from .tokens import encoder

SCALE = 1 << 16
TOKENS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("source", T.StringType()), ("part", T.IntegerType()), ("at", T.LongType()), ("n", T.LongType()), ("ids", T.BinaryType()))])
PIECES = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("source", T.StringType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("place", T.LongType()), ("ids", T.BinaryType()))])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Each document's ids as 16-bit bytes with end_id last, and where they begin among its source's ids in its task.

    Null text is empty (end_id alone), null source the source ''; repeated rows and rows without a doc_id are tokenized each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, end, seen = TaskContext.get().partitionId(), encoder(tokenizer), end_id.to_bytes(2, "little"), {}
        for batch in batches:
            ids = [encode(t or "") + end for t in batch["text"].to_pylist()]
            at, source = [], batch["source"].to_pylist()
            for s, x in zip(source, ids):
                at.append(seen.get(s, 0))
                seen[s] = at[-1] + len(x) // 2
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"].cast(pa.string()), pa.array([part] * n, pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=TOKENS.names)

    rows = rows_of(docs, doc_id="bigint", text="string", source="string").withColumn("source", F.coalesce("source", F.lit("")))
    return rows.mapInArrow(run, TOKENS)


class Line:
    """Places in the line of all queues; weight: integers by source, total: tokens by source."""

    def __init__(self, weight: list[int], total: list[int]):
        self.weight, self.total = np.array(weight, np.int64), np.array(total, np.int64)

    def place(self, s: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many tokens come before token i of queue s."""
        own, out = self.weight[s], np.zeros(len(i), np.int64)
        for t in range(len(self.weight)):
            time = (2 * i + 1) * self.weight[t] + own
            before = np.where(t < s, time, time - 1) // (2 * own)
            out += np.where(t == s, i, np.minimum(before, self.total[t]))
        return out

    def first_at(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first token in lo..hi of queue s whose place is not before the given one."""
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            late = self.place(s, mid) >= place
            lo, hi = np.where(open_ & ~late, mid + 1, lo), np.where(open_ & late, mid, hi)
        return lo


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, weights: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of `length` ids: every id is in exactly one piece, only the last sequence may be short.

    docs: doc_id, text, source. weights: target share of tokens by source (missing: 0.000015 of the whole, so that it is
    packed too); default: each source's own share, which lets all queues end together. Null text is empty (one end id),
    null source is the source ''. Repeated rows are packed each. An empty table gives no pieces. Other columns are ignored.
    The driver gets one row a source: sources are the mixture's parts, a bounded set. Ids must be below 65,536.
    """
    tokens = stored(tokenized(docs, tokenizer, end_id), "tokens")
    parts = tokens.groupBy("source", "part").agg(F.max(F.col("at") + F.col("n")).alias("n"))
    own = Window.partitionBy("source").orderBy("part")
    base = stored(parts.withColumn("base", F.sum("n").over(own) - F.col("n")), "bases")
    total = {r.source: r.n for r in base.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(total)
    share = weights or total
    whole = sum(share.get(s, 0) for s in names) or 1
    line = Line([max(1, round(SCALE * share.get(s, 0) / whole)) for s in names], [total[s] for s in names])
    rank = {s: k for k, s in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch["ids"].to_pylist(), batch["n"].to_numpy()
            if not len(n):
                continue
            s = np.array([rank[x] for x in batch["source"].to_pylist()], np.int64)
            first = batch["first"].to_numpy()
            k0, k1 = line.place(s, first) // length, line.place(s, first + n - 1) // length
            more = k1 - k0
            row = np.repeat(np.arange(len(n)), more + 1)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            k = k0[row] + nth
            lo = first[row]
            start = np.where(nth == 0, lo, line.first_at(s[row], lo, lo + n[row], k * length))
            stop = np.where(nth == more[row], lo + n[row], np.append(start[1:], 0))
            keep = stop > start
            row, k, start, stop = row[keep], k[keep], start[keep], stop[keep]
            place = line.place(s[row], start)
            begin, size = start - first[row], stop - start
            texts = [ids[r][2 * b : 2 * (b + z)] for r, b, z in zip(row.tolist(), begin.tolist(), size.tolist())]
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in texts]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["source"].take(at), pa.array(begin), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(k), pa.array(place), pa.array(texts if with_ids else [None] * len(row), pa.binary())], names=PIECES.names)

    rows = tokens.join(base.drop("n"), ["source", "part"]).select("doc_id", "source", (F.col("base") + F.col("at")).alias("first"), "n", "ids")
    seq = Window.partitionBy("sequence_id").orderBy("source", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = rows.mapInArrow(cut, PIECES).withColumn("offset", F.sum("length").over(seq) - F.col("length")).drop("place")
    return pieces if with_ids else pieces.drop("ids")
