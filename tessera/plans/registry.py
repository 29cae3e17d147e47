"""Registered queries over the driver's tables: a DataFrame callable each, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import bench

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, nodes: tuple[str, ...] = (), edges: tuple[str, ...] = ()) -> Callable:
    """Register f(g) under a name; sql may use n and e, the bench graph's nodes and edges of the given kinds, as f may by g.n and g.e."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir, nodes, edges))
        if sql:
            head = bench.ctes(nodes, edges) if nodes or edges else ""
            body = sql.strip()
            if head and body[:5].upper() == "WITH ":
                head, body = head.rstrip() + ", ", body[5:]
            SQL[name] = head + body
        return f

    return add


class Tables:
    """The driver's tables by name, and the graph of a query."""

    def __init__(self, spark: SparkSession, sf_dir: str, nodes: tuple[str, ...], edges: tuple[str, ...]):
        self.spark, self.sf_dir, self._nodes, self._edges = spark, sf_dir, nodes, edges

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def n(self) -> DataFrame:
        return bench.nodes(self.spark, self.sf_dir, *self._nodes)

    @property
    def e(self) -> DataFrame:
        return bench.edges(self.spark, self.sf_dir, *self._edges)

    def nodes(self, *kinds: str) -> DataFrame:
        return bench.nodes(self.spark, self.sf_dir, *kinds)

    def edges(self, *kinds: str) -> DataFrame:
        return bench.edges(self.spark, self.sf_dir, *kinds)
