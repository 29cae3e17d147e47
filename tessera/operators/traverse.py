"""Traversal: neighbourhoods, paths, components, lineage, overview, navigation and the reasons of an empty result.

Frontiers grow by joins, one a hop, and are written to the checkpoint folder when they branch further; nothing but
counts reaches the driver.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import relations as R

HARD = {"hops": 5, "nodes": 5_000, "edges": 20_000, "paths": 200}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; where it is unset, a temporary one in local mode and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    there = there or os.path.join(tempfile.gettempdir(), "checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: written once, where checkpoint() would compute its plan a second time."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, edge columns) in either direction, a self loop once."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), *[c for c in edges.columns])
    back = edges.where("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), *[c for c in edges.columns])
    return out.unionAll(back)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(other, direction, type) of a node's edges."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("other"), F.lit("out").alias("direction"), "type")
    back = edges.where(F.col("target") == node).select(F.col("source").alias("other"), F.lit("in").alias("direction"), "type")
    return out.unionAll(back)


def ego(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within hops of seeds (column id), by fewest hops; more than the hard limit is clamped."""
    step = both_ways(edges.select("source", "target")).select("id", "other")
    found = seeds.select("id", F.lit(0).alias("hop")).distinct()
    edge_of_search = found
    for hop in range(1, min(hops, HARD["hops"]) + 1):
        new = edge_of_search.join(step, "id").select(F.col("other").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        edge_of_search = checkpointed(new.select("id", F.lit(hop).alias("hop")))
        found = found.unionAll(edge_of_search)
    return found


def ego_subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int = 40, max_edges: int = 70) -> tuple[DataFrame, DataFrame]:
    """Nodes by hop and id up to a budget, and the edges among them by id up to theirs; both with the counts before truncation."""
    reached = ego(edges, seeds, hops).join(nodes.select("id"), "id", "left_semi")
    kept = R.budgeted(reached, [F.col("hop"), F.col("id")], min(max_nodes, HARD["nodes"]))
    inside = R.between(edges, kept)
    return kept, R.budgeted(inside, [F.col("source"), F.col("target"), F.col("type"), F.col("pos")], min(max_edges, HARD["edges"]))


def paths(edges: DataFrame, start: str, end: str, hops: int = 4, most: int = 5) -> DataFrame:
    """Simple undirected paths (node chain joined by '>'), shortest first and in order of their chain.

    Grown from both sides and met in the middle, so that a hub is expanded for half the length only.
    """
    step = both_ways(edges.select("source", "target")).select("id", "other")
    hops = min(hops, HARD["hops"])

    def grown(node: str, n: int) -> list[DataFrame]:
        levels = [step.sparkSession.createDataFrame([([node],)], "chain array<string>")]
        for _ in range(n):
            last = levels[-1].withColumn("id", F.element_at("chain", -1)).join(step, "id").where(~F.array_contains("chain", F.col("other")))
            # parallel edges give a chain once; only the edges next to chains are looked at, not all
            levels.append(checkpointed(last.select(F.concat("chain", F.array("other")).alias("chain")).distinct()))
        return levels

    near, far = grown(start, (hops + 1) // 2), grown(end, hops // 2)
    found = None
    for length in range(1, hops + 1):
        a, b = near[(length + 1) // 2], far[length // 2].select(F.reverse("chain").alias("rest"))
        met = a.join(b, F.element_at("chain", -1) == F.get("rest", F.lit(0)))
        whole = F.concat("chain", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))))
        met = met.select(F.array_join(whole, ">").alias("path"), F.lit(length).alias("length"), (F.size(F.array_distinct(whole)) == F.size(whole)).alias("simple")).where("simple").drop("simple")
        found = met if found is None else found.unionAll(met)
    return found.distinct().orderBy("length", "path").limit(min(most, HARD["paths"]))


def _contracted(chunk: int):
    """Rows (id, root) of links (a, b): the ids of about each `chunk` links a task reads, and the number of their component among these links alone."""

    def of(batches: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        links = pa.Table.from_batches(batches)
        coded = pa.concat_arrays([*links["a"].chunks, *links["b"].chunks]).dictionary_encode()
        codes = coded.indices.to_numpy()
        a, b, label = codes[: links.num_rows], codes[links.num_rows :], np.arange(len(coded.dictionary))
        while len(a):
            a, b = label[a], label[b]
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, b, a)
            while (label != (up := label[label])).any():
                label = up
        roots, at = np.unique(label, return_inverse=True)
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(at + first)], names=["id", "root"]), first + len(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size, first = [], 0, 0, TaskContext.get().partitionId() << 40
        for batch in (whole.slice(k, chunk) for whole in batches for k in range(0, whole.num_rows, chunk)):
            if n and (n + batch.num_rows > chunk or size + batch.nbytes > 1 << 28):
                found, first = of(held, first)
                yield from (found.slice(k, 50_000) for k in range(0, found.num_rows, 50_000))
                held, n, size = [], 0, 0
            held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
        if n:
            found, first = of(held, first)
            yield from (found.slice(k, 50_000) for k in range(0, found.num_rows, 50_000))

    return run


def components(edges: DataFrame, chunk: int = 4_000_000) -> DataFrame:
    """(id, component): smallest id that can be reached.

    Links go to tasks by ranges of their source, so that it doesn't matter in which order they lie in the table. Each task finds the components
    among every `chunk` links it gets; those of several chunks that hold a node are linked, and these links contracted in turn until one task
    takes them. Where chunks contract too little, each node is first contracted with a neighbour.
    """
    return _joined(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).repartitionByRange("a"), chunk)


def _joined(links: DataFrame, chunk: int) -> DataFrame:
    """(id, component) of links (a, b); rows without an end take no part."""
    kind = links.schema["a"].dataType.simpleString()
    met = checkpointed(links.where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(_contracted(chunk), f"id {kind}, root bigint"))
    shared = checkpointed(met.withColumn("first", F.min("root").over(Window.partitionBy("id"))))
    more = checkpointed(shared.where("root <> first").select(F.col("first").alias("a"), F.col("root").alias("b")).distinct())
    n, least = more.count(), met.groupBy("root").agg(F.min("id").alias("id"))
    if n:
        if n <= chunk:
            top = checkpointed(more.coalesce(1).mapInArrow(_contracted(n), "id bigint, root bigint")).toDF("root", "top")
        else:
            # the links of one chunk's component go to one task
            top = (_joined(more.repartition("a"), chunk) if n <= 0.7 * met.count() / 2 else _hooked(more, chunk)).toDF("root", "top")
        least = least.join(top, "root", "left").select("root", "id", F.when(F.col("top").isNull(), F.struct(F.lit(False).alias("joined"), F.col("root").alias("n"))).otherwise(F.struct(F.lit(True).alias("joined"), F.col("top").alias("n"))).alias("top"))
        least = least.join(least.groupBy("top").agg(F.min("id").alias("component")), "top").select("root", "component")
    else:
        least = least.withColumnRenamed("id", "component")
    return shared.where("root = first").select("id", "root").join(checkpointed(least), "root").select("id", "component")


def _hooked(links: DataFrame, chunk: int) -> DataFrame:
    """(id, component) of links (a, b) by numbers: each node is replaced by the least of itself and its neighbours, in an order by hash.

    Links stay links, or join a node to itself and go. The last node of a component in that order is never one that replaces another, and of
    any graph only a part of the nodes is left, the less the more links they have.
    """
    step = both_ways(links.select(F.col("a").alias("source"), F.col("b").alias("target"))).select("id", "other")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    up = checkpointed(step.groupBy("id").agg(F.min(rank("other")).alias("other")).select("id", F.least(rank("id"), "other")["n"].alias("up")))
    for c in "ab":
        links = links.join(up.select(F.col("id").alias(c), F.col("up").alias(f"up_{c}")), c)
    left = checkpointed(links.where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
    if left.isEmpty():
        return up.withColumnRenamed("up", "component")
    top = _joined(left.repartition("a"), chunk).toDF("up", "top")
    return up.join(top, "up", "left").select("id", F.coalesce("top", "up").alias("component"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("source", "target")).alias("id")), "id", "left_anti")


def closure(imports: DataFrame, hops: int | None = None) -> DataFrame:
    """(id, ancestor, depth) of lineage (id, parent), by fewest steps, to its end unless hops are given; a cycle shows as id = ancestor."""
    imports = imports.select("id", "parent").distinct()
    found = imports.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    level, depth = found, 1
    while hops is None or depth < hops:
        depth += 1
        level = checkpointed(level.join(imports.select(F.col("id").alias("ancestor"), "parent"), "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti").distinct())
        if level.isEmpty():
            break
        found = found.unionAll(level)
    return found


def on_cycles(imports: DataFrame) -> DataFrame:
    """(id) of lineage (id, parent) that is its own ancestor, however long the cycle.

    Rows without a row before or after them lie on no cycle and are peeled off, as long as a round takes a tenth of them; only what is left is closed.
    """
    core = checkpointed(imports.select("id", "parent").where("id IS NOT NULL AND parent IS NOT NULL").distinct())
    n = core.count()
    while n:
        core = checkpointed(core.join(core.select(F.col("parent").alias("id")), "id", "left_semi").join(core.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent"))
        before, n = n, core.count()
        if n > 0.9 * before:
            break
    return closure(core).where("id = ancestor").select("id")


def frontier(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, hidden): how many edges of a shown node lead on to others that aren't shown."""
    step = both_ways(edges.select("source", "target"))
    inside = step.join(shown.select("id"), "id", "left_semi")
    return inside.join(shown.select(F.col("id").alias("other")), "other", "left_anti").groupBy("id").agg(F.count("*").alias("hidden"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph by subject and type: groups of end nodes and how many edges run between them."""
    named = nodes.select("id", expr.subject_of(F.col("domain"), F.col("id")).alias("subject"), expr.pick_type(F.col("labels")).alias("main"))
    ends = R.with_ends(edges.select("source", "target", "type"), named, subject="subject", main="main")
    return ends.groupBy("s_subject", "s_main", "type", "t_subject", "t_main").agg(F.count("*").alias("n"))


def navigation(nodes: DataFrame) -> DataFrame:
    """(level, parent, key, n): subjects, and domains within each; no domain counts as (无领域), so that the levels' sums agree."""
    named = nodes.select(expr.subject_of(F.col("domain"), F.col("id")).alias("subject"), F.coalesce(expr.blank_as_null(F.col("domain")), F.lit("(无领域)")).alias("domain"))
    top = named.groupBy(F.col("subject").alias("key")).agg(F.count("*").alias("n")).select(F.lit("subject").alias("level"), F.lit("").alias("parent"), "key", "n")
    below = named.groupBy(F.col("subject").alias("parent"), F.col("domain").alias("key")).agg(F.count("*").alias("n")).select(F.lit("domain").alias("level"), "parent", "key", "n")
    return top.unionAll(below)


def diagnosis(edges: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(condition, n, best): edges that would come back if one condition alone were dropped, in one pass; best: the single largest gain.

    Meant for a result without edges: n counts edges that fail this condition and pass all others.
    """
    flags = edges.select(*[F.coalesce(test, F.lit(False)).alias(name) for name, test in conditions.items()])
    others = lambda name: [F.col(c) for c in conditions if c != name]
    one = flags.agg(*[F.count_if(~F.col(name) & (F.forall(F.array(*others(name)), lambda c: c) if others(name) else F.lit(True))).alias(name) for name in conditions])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("condition"), F.col(name).alias("n")) for name in conditions])).alias("r")).select("r.*")
    top = rows.agg(F.max("n").alias("top"), F.max_by(F.col("condition"), F.col("n")).alias("who"))
    ties = rows.crossJoin(F.broadcast(top)).withColumn("best", (F.col("n") > 0) & (F.col("n") == F.col("top")))
    return ties.select("condition", "n", "best")


def same_entity(nodes: DataFrame, key: Column) -> DataFrame:
    """(id, same_as): nodes whose normalised key agrees are linked to the smallest id of the key."""
    keyed = nodes.select("id", key.alias("key")).where(F.col("key").isNotNull())
    least = keyed.groupBy("key").agg(F.min("id").alias("same_as"))
    return keyed.join(least, "key").where("id <> same_as").select("id", "same_as")


def merged_nodes(edges: DataFrame, same: DataFrame) -> DataFrame:
    """Edges with merged nodes' ids rewritten (same: id, same_as); edges that become loops or copies go."""
    for end in ("source", "target"):
        edges = edges.join(same.select(F.col("id").alias("_id"), F.col("same_as").alias("_as")), F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_as", end)).drop("_id", "_as")
    return edges.where("source <> target").dropDuplicates(["source", "target", "type", "kind"])


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, id) and different undirected links (a, b), no loops, by 64-bit hashes of ids; the seed is changed until no two ids share one."""
    ids = edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id"))).where("id IS NOT NULL").distinct()
    ids, seed = checkpointed(ids), 0
    of = lambda c: F.xxhash64(F.lit(seed), c)
    while not ids.groupBy(of(F.col("id")).alias("node")).count().where("count > 1").isEmpty():
        seed += 1
    links = edges.where("source <> target").select(of(F.col("source")).alias("s"), of(F.col("target")).alias("t"))
    return ids.select(of(F.col("id")).alias("node"), "id"), links.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def link_candidates(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, common): unordered pairs without an edge, by the number of common neighbours.

    No pair is counted that has one common neighbour only, unless there are too few others. Nodes are ranked by degree. Paths u - v - w with u ranked
    above v and w are counted by (u, w): a pair whose common neighbours all rank below it is such a (u, w), with all of them; any other pair of
    `least` common neighbours has the two highest of these as (u, w), which stand among the first of its neighbours, and is found as two v of it.
    The best counts of the first kind give `least`. All pairs found are counted in full.
    """
    nodes, links = numbered(edges)
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda n, c: F.struct(F.col(f"d{c}"), F.col(n))
    degree = checkpointed(ends.groupBy("a").count())
    for c in "ab":
        links = links.join(degree.select(F.col("a").alias(c), F.col("count").alias(f"d{c}")), c)
    swap = rank("a", "a") > rank("b", "b")
    up = checkpointed(links.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("v", "a", "b"), ("u", "b", "a"), ("dv", "da", "db"), ("du", "db", "da"))]))
    known = up.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"))
    step = up.select("v", F.col("u").alias("w"), F.col("du").alias("dw"), "dv").unionAll(up.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("dv").alias("dw"), F.col("du").alias("dv")))
    # a node below which and above which there are others is the middle of a path that goes on upwards
    between = checkpointed(up.select("v").distinct().join(up.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))
    tops = up.select("v", "u", "du")
    paths = tops.join(up.select("v", F.col("u").alias("w"), F.col("du").alias("dw")), "v").where(rank("w", "w") < rank("u", "u")).select("u", "w")
    paths = paths.unionAll(tops.join(between, "v", "left_semi").join(up.select(F.col("u").alias("v"), F.col("v").alias("w")).join(between, "v", "left_semi"), "v").select("u", "w"))
    often = checkpointed(paths.groupBy("u", "w").agg(F.count("*").alias("n")).where("n > 1"))

    def unlinked(pairs: DataFrame) -> DataFrame:
        return pairs.join(known, ["a", "b"], "left_anti")

    first = often.select(F.least("u", "w").alias("a"), F.greatest("u", "w").alias("b"), "n")
    best = unlinked(first).orderBy(F.desc("n")).limit(most).agg(F.count("*").alias("rows"), F.min("n").alias("n")).first()
    least = best.n if best.rows == most else 2
    middle = step.join(often.select("w").distinct().withColumnRenamed("w", "v"), "v", "left_semi").select(F.col("v").alias("w"), F.col("w").alias("v"), F.col("dw").alias("dv")).where(F.col("dv") >= least)
    middle = checkpointed(often.select("u", "w").join(middle, "w").join(up.select("v", "u"), ["v", "u"], "left_semi"))
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("dw"), F.desc("w")))
    order = checkpointed(step.join(middle.select("v").distinct(), "v", "left_semi").select("v", "w", place.alias("place")))
    middle = middle.join(order.select("v", F.col("w").alias("u"), F.col("place").alias("pu")), ["v", "u"]).where(F.col("pu") <= F.col("dv") - least + 1)
    middle = middle.join(order.select("v", "w", F.col("place").alias("pw")), ["v", "w"]).where(F.col("pw") <= F.col("dv") - least + 2).select("u", "w", "v")
    middle = checkpointed(middle)
    second = middle.withColumnRenamed("v", "a").join(middle.withColumnRenamed("v", "b"), ["u", "w"]).where("a < b").select("a", "b")
    pairs = checkpointed(unlinked(first.where(F.col("n") >= least).select("a", "b").unionAll(second).distinct()))
    near = step.select(F.col("v").alias("a"), F.col("w").alias("z"))
    common = pairs.join(near, "a").join(near.withColumnRenamed("a", "b"), ["b", "z"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("common")).where(F.col("common") >= least)
    for c in "ab":
        common = common.join(nodes.select(F.col("node").alias(c), F.col("id").alias(f"i{c}")), c)
    found = checkpointed(common.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "common").orderBy(F.desc("common"), "a", "b").limit(most))
    lack = most - found.count()
    return found if lack <= 0 else found.unionAll(_single_common(edges, nodes, lack)).orderBy(F.desc("common"), "a", "b")


def _single_common(edges: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The first pairs (a, b, common) with one common neighbour and without an edge, from the smallest ids on, ten times as many each time."""
    step = both_ways(edges.select("source", "target")).select("id", "other").distinct()
    known = step.select(F.col("id").alias("a"), F.col("other").alias("b"))
    some, all_nodes = 1_000, nodes.count()
    while True:
        head = checkpointed(nodes.select("id").orderBy("id").limit(some))
        x = step.join(head, "id", "left_semi")
        pairs = x.alias("x").join(step.alias("y"), F.col("x.other") == F.col("y.other")).where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("common"))
        found = checkpointed(pairs.where("common = 1").join(known, ["a", "b"], "left_anti").orderBy("a", "b").limit(most))
        if some >= all_nodes or found.count() == most:
            return found
        some *= 10


def sampled(edges: DataFrame, seeds: DataFrame, hops: int, per_node: int) -> DataFrame:
    """Edges met level by level from seeds, of each node the first per_node by priority and id: caps hold per node and level."""
    rank = Window.partitionBy("id").orderBy("priority", "other", "type")
    step = both_ways(edges.select("source", "target", "type", "priority"))
    kept = step.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_node)
    reach = seeds.select("id")
    found = None
    for _ in range(min(hops, HARD["hops"])):
        level = checkpointed(kept.join(reach, "id", "left_semi").select("source", "target", "type").distinct())
        found = level if found is None else found.unionAll(level).distinct()
        reach = level.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return found
