"""Readers and writers of graphs: JSON documents, triples, CSV, adapters, ledgers and packages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass
class Graph:
    """Nodes (id, labels, props) and edges (id, source, target, type, kind, props); props are JSON text."""

    nodes: DataFrame
    edges: DataFrame

    def checked(self) -> Graph:
        """The graph itself if no id repeats, else ValueError with how many do."""
        for name, df in (("node", self.nodes), ("edge", self.edges)):
            n = df.groupBy("id").count().where("count > 1").count()
            if n:
                raise ValueError(f"{n} {name} ids repeat")
        return self


NODE = "array<struct<id:string,labels:array<string>,props:string>>"
EDGE = "array<struct<id:string,source:string,target:string,type:string,kind:string,props:string>>"


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A document {nodes: [...], edges: [...]}; props stay JSON text. Edges without a kind get their type, repeated ids their first."""
    doc = spark.read.schema(f"nodes {NODE}, edges {EDGE}").json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    return Graph(nodes, edges.withColumns({"kind": F.coalesce("kind", "type"), "id": F.coalesce("id", F.concat_ws("|", "type", "source", "target"))}))


def read_triples(spark: SparkSession, path: str, head_type: str, relation: str, tail_type: str) -> DataFrame:
    """(head, tail) of a triple CSV by the triple's types; of a head's several tails the last in the file; rows of another width are skipped."""
    schema = "head_type string, head string, relation string, tail_type string, tail string, _bad string"
    rows = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").withColumn("_at", F.monotonically_increasing_id())
    kept = rows.where(F.col("_bad").isNull() & (F.col("head_type") == head_type) & (F.col("relation") == relation) & (F.col("tail_type") == tail_type))
    return kept.groupBy("head").agg(F.max_by("tail", "_at").alias("tail"))


def read_csv_graph(spark: SparkSession, nodes: str, edges: str) -> Graph:
    """CSV with headers :ID, :LABEL and :START_ID, :END_ID, :TYPE; labels are joined by semicolons, other columns become props."""
    n, e = (spark.read.csv(p, header=True, inferSchema=False) for p in (nodes, edges))
    props = lambda df, own: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c.split(":")[-1] not in own] or [F.lit(None).alias("_")]))
    find = lambda df, tail: F.col(f"`{next(c for c in df.columns if c.endswith(tail))}`")
    nodes_ = n.select(find(n, ":ID").alias("id"), F.split(find(n, ":LABEL"), ";").alias("labels"), props(n, ("ID", "LABEL")).alias("props"))
    kind = F.col("kind") if "kind" in e.columns else find(e, ":TYPE")
    edges_ = e.select(F.concat_ws("|", find(e, ":TYPE"), find(e, ":START_ID"), find(e, ":END_ID")).alias("id"), find(e, ":START_ID").alias("source"), find(e, ":END_ID").alias("target"), find(e, ":TYPE").alias("type"), kind.alias("kind"), props(e, ("START_ID", "END_ID", "TYPE", "kind")).alias("props"))
    return Graph(nodes_, edges_)


def read_paper(spark: SparkSession, path: str) -> Graph:
    """One paper: nodes with their dependencies as edges."""
    doc = spark.read.schema("nodes array<struct<id:string,type:string,latex:string,informal_text:string,proof:string,symbols:array<string>>>, dependencies array<struct<source:string,target:string,kind:string,confidence:double>>").json(path, multiLine=True)
    n = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode("dependencies").alias("e")).select("e.*")
    return Graph(
        n.select("id", F.array("type").alias("labels"), F.to_json(F.struct("latex", "informal_text", "proof", "symbols")).alias("props")),
        e.select(F.concat_ws("|", "kind", "source", "target").alias("id"), "source", "target", F.col("kind").alias("type"), "kind", F.to_json(F.struct("confidence")).alias("props")),
    )


def read_relations(spark: SparkSession, path: str) -> Graph:
    """Entities (id, type, name) and relations (head, tail, relation)."""
    doc = spark.read.schema("entities array<struct<id:string,type:string,name:string>>, relations array<struct<head:string,tail:string,relation:string>>").json(path, multiLine=True)
    n = doc.select(F.explode("entities").alias("n")).select("n.*")
    e = doc.select(F.explode("relations").alias("e")).select("e.*")
    return Graph(
        n.select("id", F.array("type").alias("labels"), F.to_json(F.struct("name")).alias("props")),
        e.select(F.concat_ws("|", "relation", "head", "tail").alias("id"), F.col("head").alias("source"), F.col("tail").alias("target"), F.col("relation").alias("type"), F.col("relation").alias("kind"), F.lit(None).cast("string").alias("props")),
    )


def exported(nodes: DataFrame, relationships: DataFrame) -> Graph:
    """A full scan of a store's nodes and relationships (source, target, type, kind, props, at): the kind is the type where there is none, of equal ids the first `at` stays."""
    named = relationships.withColumns({"kind": F.coalesce("kind", "type"), "id": F.concat_ws("|", "type", "source", "target")})
    first = named.groupBy("id").agg(F.min_by(F.struct("source", "target", "type", "kind", "props"), "at").alias("r")).select("id", "r.*")
    return Graph(nodes.dropDuplicates(["id"]), first)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line ends the read with a ValueError that names its file and its number there."""
    good, bad = read_lines(spark, path, schema)
    first = bad.orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"bad line {first[0].line} of {first[0].file}: {first[0]._bad[:200]}")
    return good


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines: the good rows, and (file, line, _bad) of the bad ones. Blank lines are neither; only files with a bad line are numbered, each in one task."""
    text = spark.read.text(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    parsed = text.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("trim(value) <> ''")
    wrong = F.col("row._bad").isNotNull()
    broken = parsed.where(wrong).select("file", "at")
    numbered = text.join(broken.select("file").distinct(), "file", "left_semi").withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    return parsed.where(~wrong).select("row.*").drop("_bad"), numbered.join(broken, ["file", "at"], "left_semi").select("file", "line", F.col("value").alias("_bad"))


def first_source(*sources: Column) -> Column:
    """The first source that there is, in the order given: an explicit one, an inferred one, the normalised one."""
    return F.coalesce(*sources)


def view_meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, n) of a view: nodes (id, type) by type, edges with both ends by kind, and the edges left out."""
    ids = nodes.select(F.col("id").alias("target")).distinct().withColumn("there", F.lit(True))
    marked = edges.join(ids, "target", "left")
    kinds = marked.where("there").groupBy(F.lit("kind").alias("section"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    types = nodes.groupBy(F.lit("type").alias("section"), F.col("type").alias("key")).agg(F.count("*").alias("n"))
    return types.unionAll(kinds).unionAll(marked.where("there IS NULL").agg(F.lit("dangling").alias("section"), F.lit("").alias("key"), F.count("*").alias("n")))


def write_view(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes/ and edges/ as JSON lines, edges with both ends only, and meta/ with the counts."""
    write_lines(nodes, f"{path}/nodes")
    ids = nodes.select(F.col("id").alias("target")).distinct()
    write_lines(edges.join(ids, "target", "left_semi"), f"{path}/edges")
    view_meta(nodes, edges).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_store(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by id, edges by source and again by target, and trigram postings by gram, each sorted, so that a lookup reads a few row groups."""
    from ..operators.search import postings

    for name, df, key in (("nodes", nodes, "id"), ("edges", edges, "source"), ("edges_by_target", edges, "target"), ("postings", postings(nodes), "gram")):
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")


def lines(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys in order of their names."""
    return df.select("id", F.to_json(F.struct(*sorted(df.columns))).alias("line"))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines sorted by id over all files: the same rows give the same bytes in the same order."""
    lines(df).orderBy("id").select("line").write.mode("overwrite").text(path)


def write_package(graph: Graph, path: str, docs: dict[str, str] | None = None, dry: bool = False) -> DataFrame:
    """nodes/, edges/, docs/ and manifest/ with rows and a digest each: staged beside `path`, verified there, then promoted by a rename.

    What lay at `path` is kept as `path`.before until the new package is in place. dry: verified, but not promoted. Returns the manifest;
    a package that doesn't verify is left staged and raises ValueError.
    """
    from ..operators.versions import content_id

    spark, stage = graph.nodes.sparkSession, f"{path}.stage"
    manifest = None
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        write_lines(df, f"{stage}/{name}")
        one = content_id(lines(df), F.col("line")).select(F.lit(name).alias("part"), "n", "content_id")
        manifest = one if manifest is None else manifest.unionAll(one)
    if docs:
        spark.createDataFrame(sorted(docs.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{stage}/docs")
    manifest.coalesce(1).write.mode("overwrite").json(f"{stage}/manifest")
    wrong = [r.part for r in verified_package(spark, stage).where("NOT ok").collect()]
    if wrong:
        raise ValueError(f"{stage}: {', '.join(wrong)} don't have what the manifest says")
    return spark.read.schema("part string, n bigint, content_id string").json(f"{stage if dry else promoted(spark, stage, path)}/manifest")


def promoted(spark: SparkSession, stage: str, path: str) -> str:
    """Rename a staged folder into place in whatever store it is; the folder before it goes once the new one is there, and comes back if that fails."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (stage, f"{path}.before"))
    fs.delete(old, True)
    had = fs.exists(there) and fs.rename(there, old)
    if not fs.rename(new, there):
        if had:
            fs.rename(old, there)
        raise OSError(f"{stage} can't be renamed to {path}")
    fs.delete(old, True)
    return path


def write_slice(graph: Graph, keep: Column, path: str, predicate: dict[str, str]) -> DataFrame:
    """The nodes of a slice, the edges that touch it and the nodes these attach, as a package with its predicate in docs; (matched, attached, internal, crossing)."""
    matched = graph.nodes.where(keep)
    ids = matched.select("id").distinct()
    s, t = (ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")) for end in ("source", "target"))
    touching = graph.edges.join(s, "source", "left").join(t, "target", "left").where("_source OR _target")
    attached = graph.nodes.join(touching.select(F.explode(F.array("source", "target")).alias("id")).distinct(), "id", "left_semi").join(ids, "id", "left_anti")
    write_package(Graph(matched.unionByName(attached), touching.select(*graph.edges.columns)), path, {"predicate": str(sorted(predicate.items()))})
    inside = F.coalesce(F.col("_source") & F.col("_target"), F.lit(False))
    counts = touching.agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("crossing"))
    return matched.agg(F.count("*").alias("matched")).crossJoin(attached.agg(F.count("*").alias("attached"))).crossJoin(counts)


def verified_package(spark: SparkSession, path: str) -> DataFrame:
    """(part, ok): whether what lies in a package still has the rows and the digest of its manifest."""
    from ..operators.versions import content_id

    there = spark.read.schema("part string, n bigint, content_id string").json(f"{path}/manifest")
    now = None
    for name in ("nodes", "edges"):
        one = content_id(spark.read.text(f"{path}/{name}"), F.col("value")).select(F.lit(name).alias("part"), F.col("n").alias("n2"), F.col("content_id").alias("id2"))
        now = one if now is None else now.unionAll(one)
    return there.join(now, "part").select("part", (F.col("n").eqNullSafe(F.col("n2")) & (F.col("content_id") == F.col("id2"))).alias("ok"))


def upsert(rows: DataFrame, write, size: int = 500, tries: int = 6) -> DataFrame:
    """Rows sent in batches by write(list of Row), each tried several times; returns (sent, lost) by partition, so that no loss is silent."""

    def run(batches):
        import time

        import pandas as pd

        for frame in batches:
            sent = lost = 0
            for k in range(0, len(frame), size):
                part = frame.iloc[k : k + size].to_dict("records")
                for n in range(tries):
                    try:
                        write(part)
                        sent += len(part)
                        break
                    except OSError:
                        time.sleep(0.05 * n)
                else:
                    lost += len(part)
            yield pd.DataFrame({"sent": [sent], "lost": [lost]})

    return rows.mapInPandas(run, "sent bigint, lost bigint")
