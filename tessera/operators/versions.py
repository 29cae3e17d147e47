"""Mutation and versions: deltas, merges, slices, content ids and the ledger of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .relations import with_ends


def applied(nodes: DataFrame, edges: DataFrame, delete_nodes: DataFrame, upserts: DataFrame, delete_edges: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, props map) and edges (source, target, type, props map) after a delta.

    In order: deleted nodes go with their edges; upserts add nodes or lay their props over the old ones, less props_drop (array);
    deleted edges (source, target, type) go; new edges are merged, those with an end that is no node are left out. A null map is empty.
    """
    empty = F.create_map().cast("map<string,string>")
    kept = nodes.join(delete_nodes.select("id"), "id", "left_anti")
    new = upserts.select("id", F.col("props").alias("_new"), "props_drop", F.lit(True).alias("_up"))
    both = kept.select("id", F.col("props").alias("_old")).join(new, "id", "full_outer")
    merged = _laid_over(F.coalesce("_old", empty), F.coalesce("_new", empty))
    merged = F.map_filter(merged, lambda k, v: ~F.array_contains(F.coalesce("props_drop", F.array().cast("array<string>")), k))
    nodes = both.select("id", merged.alias("props"))
    alive = edges.join(delete_nodes.select(F.col("id").alias("source")), "source", "left_anti").join(delete_nodes.select(F.col("id").alias("target")), "target", "left_anti")
    key = ["source", "target", "type"]
    alive = alive.join(delete_edges.select(*key), key, "left_anti")
    fine = new_edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    edges = alive.select(*key, F.col("props").alias("_old")).join(fine.select(*key, F.col("props").alias("_new")), key, "full_outer")
    return nodes, edges.select(*key, _laid_over(F.coalesce("_old", empty), F.coalesce("_new", empty)).alias("props"))


def _laid_over(old: Column, new: Column) -> Column:
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def changes(old: DataFrame, new: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, change) between props maps of two snapshots: added, dropped, changed; volatile keys are ignored."""
    flat = lambda df, name: df.select("id", F.explode("props").alias("key", name)).where(~F.col("key").isin(*volatile) if volatile else F.lit(True))
    both = flat(old, "a").join(flat(new, "b"), ["id", "key"], "full_outer")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "dropped").when(F.col("a") != F.col("b"), "changed")
    return both.select("id", "key", state.alias("change")).where("change IS NOT NULL")


def content_id(rows: DataFrame, line: Column, digits: int = 16) -> DataFrame:
    """(n, content_id): a digest over the sorted digests of all rows.

    Digests are added up by their leading eight hexadecimal places in four decimal sums, so that no row order and no single task is needed; equal multisets have equal ids.
    """
    h = F.sha2(line, 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count("*").alias("n"), *[part(k).alias(f"p{k}") for k in range(4)])
    return sums.select("n", F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"p{k}").cast("string") for k in range(4)]), 256), 1, digits).alias("content_id"))


def bump(before: Column, after: Column) -> Column:
    """major, minor, patch, none or downgrade between versions dataset_vA.B.C; null if one isn't of that form."""
    pattern = r"^dataset_v(\d+)\.(\d+)\.(\d+)$"
    n = lambda v, k: F.try_to_number(F.regexp_extract(v, pattern, k), F.lit("999999")).cast("int")
    out = F.when(~before.rlike(pattern) | ~after.rlike(pattern), F.lit(None).cast("string"))
    for k, name in ((1, "major"), (2, "minor"), (3, "patch")):
        out = out.when(n(after, k) > n(before, k), name).when(n(after, k) < n(before, k), "downgrade")
    return out.otherwise("none")


def classified(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """Each version of a ledger, or of each ledger named in column `by`, (seq, format_version, schema_id, license_profile, source_sha256, files_id) against the one before.

    A changed record schema requires a major step, a changed licence a minor one, changed content a patch; declared: the step made is large enough.
    The first has no baseline: all null.
    """
    w = Window.partitionBy(*([by] if by else [])).orderBy("seq")  # a ledger has a row a release, so without `by` one task is enough
    before = {c: F.lag(c).over(w) for c in ("format_version", "schema_id", "license_profile", "source_sha256", "files_id")}
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = ledger.withColumns({f"_{c}": e for c, e in before.items()}).withColumn("_first", F.row_number().over(w) == 1)
    required = F.when(differs("schema_id"), "major").when(differs("license_profile"), "minor").when(differs("source_sha256") | differs("files_id"), "patch").otherwise("none")
    severity = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ("none", "patch", "minor", "major"))), c), F.lit(0))
    rows = rows.withColumn("required_bump", F.when(~F.col("_first"), required)).withColumn("actual_bump", F.when(~F.col("_first"), bump(F.col("_format_version"), F.col("format_version"))))
    return rows.withColumn("declared", F.when(~F.col("_first"), (F.col("actual_bump") != "downgrade") & (severity(F.col("actual_bump")) >= severity(F.col("required_bump"))))).select(*([by] if by else []), "seq", "format_version", "required_bump", "actual_bump", "declared")


def slices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(slice, nodes, edges, internal, crossing) by slice domain: an edge belongs to its source's slice, and crosses if its target is in another."""
    named = nodes.select("id", expr.slice_domain(F.col("domain")).alias("slice"))
    per = named.groupBy("slice").agg(F.count("*").alias("nodes"))
    ends = with_ends(edges.select("source", "target"), named, slice="slice")
    by = ends.groupBy(F.col("s_slice").alias("slice")).agg(F.count("*").alias("edges"), F.count_if(F.col("s_slice") == F.col("t_slice")).alias("internal"), F.count_if(F.col("s_slice") != F.col("t_slice")).alias("crossing"))
    return per.join(by, "slice", "left").fillna(0, ["edges", "internal", "crossing"])


def thresholds(edges: DataFrame, grade: str) -> DataFrame:
    """(least, n): edges of each grade and above, which isn't additive by design."""
    return edges.select(F.explode(F.sequence(F.lit(1), F.col(grade))).alias("least")).groupBy("least").agg(F.count("*").alias("n"))


def chunks(rows: DataFrame, order: list[Column], group: str, size: int) -> DataFrame:
    """Rows of each group numbered into blocks of a fixed size."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))
