"""Filters, joins, aggregates, rankings and set operations over nodes (id, labels, domain, ...) and edges (source, target, type, kind, level, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

#: Least rank of each trust tier; another name counts as the strictest.
TIERS = {"all": -1, "verified": 3, "verified_strict": 4}


# filters


def trusted(edges: DataFrame, tier: str = "verified") -> DataFrame:
    """Edges of a trust tier; an unknown tier falls back to the strict side, never to all."""
    least = TIERS.get(tier, TIERS["verified_strict"])
    return edges if least < 0 else edges.where(expr.level_rank(F.col("level")) >= least)


def confident(edges: DataFrame, least: float) -> DataFrame:
    """Missing confidence passes only a threshold of zero."""
    return edges.where(F.col("confidence") >= least) if least > 0 else edges


def without_model(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("level").eqNullSafe("model_inferred"))


def stale(fidelity: Column, status: Column) -> Column:
    """Changed or lost sources, stale or rejected records; needs_review and not_in_repo stay."""
    return F.coalesce(fidelity.isin("changed", "unverifiable_no_source"), F.lit(False)) | F.coalesce(status.isin("stale", "rejected"), F.lit(False))


def of_types(edges: DataFrame, types: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """type and kind are separate dimensions."""
    for column, wanted in (("type", types), ("kind", kinds)):
        if wanted:
            edges = edges.where(F.col(column).isin(*wanted))
    return edges


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes: the induced subgraph."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def model_made(edges: DataFrame, kinds: list[str]) -> Column:
    return F.col("kind").isin(*kinds) | F.col("kind").contains("GNN") | F.col("kind").contains("LLM")


def placeholder(name: Column) -> Column:
    return name.rlike(r"(?i)^(FG|reaction|molecule|mol|rxn|rx)[_-]?\d+$")


def matches(rules: list[dict[str, str]]) -> Column:
    """Any of the rules, each a conjunction of column: value."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in rule.items()]) for rule in rules])


# joins


def with_ends(edges: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """Edges with columns of both end nodes as s_<name>, t_<name>: name=column or SQL expression over the node."""
    for side, end in (("s", "source"), ("t", "target")):
        own = nodes.select(F.col("id").alias(f"{side}_id"), *[F.expr(e).alias(f"{side}_{n}") for n, e in columns.items()])
        edges = edges.join(own, F.col(end) == F.col(f"{side}_id")).drop(f"{side}_id")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    ids = nodes.select("id")
    lost = [edges.join(ids, edges[end] == ids.id, "left_anti") for end in ("source", "target")]
    return lost[0].unionAll(lost[1]).distinct()


def incident(edges: DataFrame, node: str) -> DataFrame:
    """Edges of a node, a self loop once."""
    return edges.where(F.col("source") == node).unionAll(edges.where((F.col("target") == node) & (F.col("source") != node)))


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How two sides stand to each other, by key: same, differs, left_only or right_only."""
    both = left.select(*keys, F.col(value).alias("_l"), F.lit(True).alias("_in_l")).join(right.select(*keys, F.col(value).alias("_r"), F.lit(True).alias("_in_r")), keys, "full_outer")
    state = F.when(F.col("_in_r").isNull(), "left_only").when(F.col("_in_l").isNull(), "right_only").when(F.col("_l").eqNullSafe(F.col("_r")), "same").otherwise("differs")
    return both.select(*keys, state.alias("state"))


def redistributable(edges: DataFrame, allowed: DataFrame, *sources: str) -> DataFrame:
    """Edges all of whose source columns are allowed; a missing or unknown source is not (fail-closed)."""
    for k, c in enumerate(sources):
        edges = edges.join(allowed.select(F.col("source").alias(f"_s{k}"), F.col("allowed").alias(f"_ok{k}")), F.col(c) == F.col(f"_s{k}"), "left")
    fine = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_ok{k}"), F.lit(False)) for k in range(len(sources))])
    return edges.withColumn("public", fine).drop(*[f"_s{k}" for k in range(len(sources))], *[f"_ok{k}" for k in range(len(sources))])


# aggregates


def counts(df: DataFrame, *columns: str, missing: str = "unlabeled") -> DataFrame:
    return df.groupBy(*[F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in columns]).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree in both directions; a self loop counts two."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"))


def worst(rows: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The worst status of each key; order runs from best to worst, others count as worse than all."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(status)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return rows.groupBy(key).agg(F.max_by(status, rank).alias(status))


# rankings


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first of every group, then the second of every group, up to n rows."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", group).limit(n)


def unique_edge_ids(edges: DataFrame) -> DataFrame:
    """id: type|source|target; later edges of the same id get |kind, and where that is taken too, #2, #3, ... in order of pos."""
    plain = F.concat_ws("|", "type", "source", "target")
    rows = edges.withColumn("_plain", plain).withColumn("_nth", F.row_number().over(Window.partitionBy("_plain").orderBy("pos", "kind")))
    again = Window.partitionBy("_plain", "_later", "kind").orderBy("pos")
    rows = rows.withColumn("_later", F.col("_nth") > 1).withColumn("_k", F.row_number().over(again))
    name = F.when(~F.col("_later"), F.col("_plain")).when(F.col("_k") == 1, F.concat_ws("|", "_plain", "kind")).otherwise(F.concat(F.concat_ws("|", "_plain", "kind"), F.lit("#"), F.col("_k").cast("string")))
    return rows.withColumn("id", name).withColumn("renamed", F.col("_later")).drop("_plain", "_nth", "_later", "_k")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows of a page with the total and the next offset, null on the last page."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, offset + limit))


def budgeted(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows with the number there was before."""
    total = df.agg(F.count("*").alias("before"))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("before") > most)


def stepped(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a ledger with their number in order and the row before (window over the ledger, whose rows are few)."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)))


# sets


def union_first(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several graphs, of equal keys that of the first."""
    ranked = reduce(DataFrame.unionByName, [f.withColumn("_from", F.lit(k)) for k, f in enumerate(frames)])
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_from"))).where("_r = 1").drop("_r", "_from")


def only_in_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that the other side lacks, with the side they are on."""
    return a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("left")).unionAll(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("right")))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def appended(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A ledger with the new rows whose key it lacks: doing it twice changes nothing."""
    return ledger.unionByName(new.dropDuplicates([key]).join(ledger.select(key), key, "left_anti").select(*ledger.columns))
