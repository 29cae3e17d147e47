"""Helpers that the operators share: the shared scratch folder, column guards and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; where it is unset, a temporary one in local mode (tests), and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not there:
        there = os.path.join(tempfile.gettempdir(), "checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, and a lost executor loses nothing."""
    return _written(df, name)[0]


def _gone(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types: other columns, also with clashing names, stay out."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def squeezed(rows: DataFrame) -> DataFrame:
    """(doc_id, raw): texts compressed by themselves, before they are sent to another task; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):  # a few texts at a time
                batch = whole.slice(k, 500)
                raw = [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, raw binary")


def opened(raw: pa.Array) -> Iterator[str | None]:
    """The texts of squeezed()."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return (None if r is None else unpack.decompress(r).decode("utf-8", "surrogatepass") for r in raw.to_pylist())


def connected_components(links: DataFrame, kind: str = "bigint") -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Minimum labels spread along links and each round also jumps to the label of the label, so a chain of n
    nodes takes about log n rounds. Every round is written to the shared folder and the one before it deleted. Nothing is collected but the
    number of changed labels. No links: an empty table.
    """
    a, b = F.col("a").cast(kind), F.col("b").cast(kind)
    links = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    links, path = _written(links, "links")
    while True:
        # the larger end of each link points at the smallest neighbour of its star; smaller neighbours are linked to that too
        least = links.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        star = links.join(least, F.col("b") == F.col("n")).select("a", "b", "m")
        grown = (
            star.select(F.col("m").alias("a"), F.col("b"))
            .unionByName(star.select(F.col("m").alias("a"), F.col("a").alias("b")))
            .where("a <> b")
            .distinct()
        )
        grown, next_path = _written(_small_star(grown), "links")
        same = links.join(grown, ["a", "b"], "left_anti").isEmpty() and grown.join(links, ["a", "b"], "left_anti").isEmpty()
        _gone(links.sparkSession, path)
        links, path = grown, next_path
        if same:
            break
    roots = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's neighbours, itself included, are linked to the smallest of them (the larger ones only)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
    return (
        both.join(least, F.col("a") == F.col("n"))
        .where("b > a")
        .select(F.col("m").alias("a"), "b")
        .where("a <> b")
        .distinct()
    )
