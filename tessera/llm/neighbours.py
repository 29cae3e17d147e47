"""Approximate nearest neighbours by collision counting.

Every vector is projected on m random lines. Each line keeps its projections as one sorted array; a query's window on a line is the stretch of
that array within a width of the query's own projection. A vector collides with the query on the lines whose window holds it:
those on which its rank lies between the window's ends. Virtual rehashing widens all windows by a factor and counts again, until enough
vectors have collided on `LEAST` lines or more; these are verified by their true inner products on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Lines, collisions that make a candidate, candidates wanted (a number and a share of the block), the first width in mean projections and the factor of each widening.
LINES, LEAST, ENOUGH, SHARE, FIRST, WIDER = 160, 109, 200, 0.03, 1.1, 1.05
#: Rows of a block on which a query's width is tried first.
SAMPLE = 512
#: Lines whose collisions are counted at once, as many as fit in a core's cache.
SOME = 16
#: Rows of a block (ranks have 16 bits) and queries of a turn.
BLOCK, QUERIES = 8_192, 8_192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array of double, size) of the vectors that take part: those null, zero or holding null or non-finite components don't, nor do rows without a vec_id."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.coalesce(fine & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    return v.withColumn("size", F.size("embedding"))


class Index:
    """Sorted projections of a block. Vectors are lengthened to one norm, so that the nearest by distance have the largest inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, LINES))
        self.lines = lines / np.linalg.norm(lines, axis=0)
        # scaled so that no square is too large
        self.scale = max(np.abs(vectors).max(), 1e-300)
        square = ((vectors / self.scale) ** 2).sum(1)
        self.norm = np.sqrt(square.max())
        at = (vectors / self.scale) @ self.lines[:-1] + np.sqrt(np.maximum(square.max() - square, 0))[:, None] * self.lines[-1]
        order = np.argsort(at, axis=0, kind="stable").T
        # the sorted arrays end to end, each raised above the one before it, so that one search finds the ends of all windows
        self.raised = 4 * self.norm * np.arange(LINES)
        self.sorted = (np.take_along_axis(at.T, order, axis=1) + self.raised[:, None]).ravel()
        self.rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self.past, self.met = np.empty((SOME, len(ids)), np.uint16), np.empty((SOME, len(ids)), bool)

    def collisions(self, at: np.ndarray, width: float, rows: int) -> np.ndarray:
        """On how many lines each of the first `rows` rows lies within a width of the query's projections."""
        n = len(self.ids)
        width = min(width, 1.9 * self.norm)  # all of a line
        begin = np.arange(LINES) * n
        lo = (np.searchsorted(self.sorted, self.raised + np.maximum(at - width, -1.9 * self.norm)) - begin).astype(np.uint16)[:, None]
        hi = (np.searchsorted(self.sorted, self.raised + np.minimum(at + width, 1.9 * self.norm), "right") - begin)[:, None]
        wide, count = np.minimum(hi - lo, 65_535).astype(np.uint16), np.zeros(rows, np.uint8)
        past, met = self.past[:, :rows], self.met[:, :rows]
        for j in range(0, LINES, SOME):
            np.subtract(self.rank[j : j + SOME, :rows], lo[j : j + SOME], out=past)  # below lo: wraps past hi
            np.less(past, wide[j : j + SOME], out=met)
            count += met.view(np.uint8).sum(0, dtype=np.uint8)
        return count

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that collide on LEAST lines once k + ENOUGH and SHARE of the block do, or all.

        The width is first tried on the block's first SAMPLE rows, a random part of it as rows are dealt by a hash, and then widened on all rows
        until enough collide. Every query starts at the same width, so its result depends on the block alone.
        """
        query = query / np.abs(query).max()
        at = (query * (self.norm / np.linalg.norm(query))) @ self.lines[:-1]
        n = len(self.ids)
        want, width = min(n, k + ENOUGH + int(SHARE * n)), FIRST * self.norm / np.sqrt(len(query) + 1)
        for rows in sorted({min(SAMPLE, n), n}):
            while True:
                found = np.flatnonzero(self.collisions(at, width, rows) >= LEAST)
                if len(found) * n >= want * rows or width > 2 * self.norm:
                    break
                width *= WIDER
        return found if len(found) >= want else np.arange(n)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best verified candidates, the query's own row left out: scores are sums of products in double precision."""
        rows = self.candidates(query, k + 1)
        rows = rows[self.ids[rows] != query_id]
        score = (self.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k largest inner products with other rows.

    All rows are indexed, in blocks of bounded size; blocks of queries meet blocks of rows, and each query keeps k of each
    block, then k of all. Vectors of different lengths have no inner product: each length is searched by itself. Vectors that repeat tie and
    go by vec_id. Fewer than k others: all of them. Empty table: no rows. Other columns are ignored.
    """
    base = stored(usable(vectors), "vectors")
    # a row a length, so no more rows than the longest vector has components
    sizes = base.groupBy("size").agg(F.count("*").alias("n"))
    sizes = sizes.select("size", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / (every * QUERIES)).cast("int").alias("turns"))
    base = base.join(F.broadcast(sizes), "size")
    deal = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(m)).cast("int")
    meet = lambda block, turn: F.concat_ws(" ", "size", block, turn).alias("meet")
    rows = base.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(meet(deal("blocks", 1), F.col("turn")), "vec_id", F.col("embedding").alias("mine"))
    asked = base.where(F.col("vec_id") % every == 0)
    wanted = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(meet(F.col("block"), deal("turns", 2)), F.col("vec_id").alias("query_id"), F.col("embedding").alias("theirs"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        # blocks are dealt by a hash and may be a little fuller than BLOCK; rows in one order, whatever order they came in
        mine = mine.sort_values("vec_id", kind="stable")
        for k0 in range(0, len(mine) if len(theirs) else 0, 1 << 15):
            part = mine.iloc[k0 : k0 + (1 << 15)]
            index = Index(part.vec_id.to_numpy(), np.stack(part.mine.to_numpy()))
            for q, v in zip(theirs.query_id.to_numpy(), theirs.theirs):
                ids, score = index.search(q, np.asarray(v), k)
                out.append((np.full(len(ids), q), ids, score))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = rows.groupBy("meet").cogroup(wanted.groupBy("meet")).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
