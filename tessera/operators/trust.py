"""Evidence and trust: fidelity of sources, grades, statuses and their accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

FIDELITY = ["verified", "unverifiable_not_in_repo", "unverifiable_no_source", "changed"]
STATUS = ["valid", "needs_review", "stale", "rejected"]
#: Fidelity's share of a grade: a source that can't be recomputed supports no more than 2, one that changed no more than 1.
FIDELITY_GRADE = {"verified": 5, "unverifiable_not_in_repo": 2, "unverifiable_no_source": 1, "changed": 1}
#: A level's share of a grade.
LEVEL_GRADE = {"unverified": 1, "model_inferred": 1, "source_asserted": 3, "by_construction": 3, "rule_checked": 4, "cross_source": 5, "human_reviewed": 5}


def lookup(column: Column, values: dict[str, int], otherwise: int | None = None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def source_fidelity(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """evidence (edge, src, src_hash, indep) with fidelity against registry (src, known, hash, repo_status, redistributable).

    An unregistered or unknown source is no source; one that isn't in the repository can't be checked; a hash that differs has changed.
    """
    rows = evidence.join(registry.withColumnsRenamed({c: f"_{c}" for c in registry.columns}), F.col("src") == F.col("_src"), "left")
    state = (
        F.when(F.col("_known").isNull() | ~F.col("_known"), "unverifiable_no_source")
        .when(F.col("_repo_status") == "not_in_repo", "unverifiable_not_in_repo")
        .when(F.col("src_hash").eqNullSafe(F.col("_hash")), "verified")
        .otherwise("changed")
    )
    return rows.withColumn("fidelity", state).withColumn("public", F.coalesce("_redistributable", F.lit(False))).drop(*[f"_{c}" for c in registry.columns])


def graded(edges: DataFrame, evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """edges (edge, level) with fidelity (the worst of their sources), internal and public grade 1..5.

    The internal grade is the lesser of level and fidelity, one more (at most 5) with several independent sources and at least 3;
    without evidence it is 1. The public grade falls to 2 unless all sources may be passed on.
    """
    per = source_fidelity(evidence, registry)
    rank = lookup(F.col("fidelity"), {f: k for k, f in enumerate(FIDELITY)})
    agg = per.groupBy("edge").agg(F.max_by("fidelity", rank).alias("fidelity"), F.count_distinct(F.when(F.col("indep"), F.col("src"))).alias("independent"), F.bool_and("public").alias("public"))
    rows = edges.join(agg, "edge", "left")
    base = F.least(lookup(F.col("level"), LEVEL_GRADE, 1), lookup(F.col("fidelity"), FIDELITY_GRADE))
    internal = F.when(F.col("fidelity").isNull(), 1).when((F.col("independent") >= 2) & (base >= 3), F.least(base + 1, F.lit(5))).otherwise(base)
    public = F.least(internal, F.when(F.coalesce(F.col("public"), F.lit(False)), 5).otherwise(2))
    return rows.select("edge", "level", F.coalesce("fidelity", F.lit("unverifiable_no_source")).alias("fidelity"), internal.cast("int").alias("internal"), public.cast("int").alias("public_grade"))


def reconciled(grades: DataFrame) -> DataFrame:
    """Violations of what grades promise, by rule; each must be zero."""
    rules = {
        "public_above_internal": F.col("public_grade") > F.col("internal"),
        "five_not_recomputable": (F.col("internal") == 5) & (F.col("fidelity") != "verified"),
        "model_above_one": (F.col("level") == "model_inferred") & (F.col("internal") > 1),
        "out_of_range": ~F.col("internal").between(1, 5) | ~F.col("public_grade").between(1, 5),
    }
    one = grades.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.*")


def statuses(rows: DataFrame, key: str) -> DataFrame:
    """(status, n) of each key's worst record, `no_record` for those without one; severity runs valid, needs_review, stale, rejected."""
    rank = lookup(F.col("status"), {s: k for k, s in enumerate(STATUS)}, -1)
    worst = rows.groupBy(key).agg(F.max_by(F.coalesce("status", F.lit("no_record")), rank).alias("status"))
    return worst.groupBy("status").agg(F.count("*").alias("n"))


def worklist(edges: DataFrame, sources: DataFrame, most: int, grade: int = 2) -> DataFrame:
    """Low-grade edges by source with the number of each source's types; an edge with several sources counts once for each."""
    low = edges.where(F.col("internal") <= grade).join(sources.select("edge", "src").distinct(), "edge", "left")
    by = low.groupBy(F.coalesce("src", F.lit("(none)")).alias("src")).agg(F.count("*").alias("n"), F.count_distinct("level").alias("levels"))
    return by.orderBy(F.desc("n"), "src").limit(most)


def evidence_layers(evidence: DataFrame, verifier: str) -> DataFrame:
    """(edge, traceable, independent): some evidence with detail made by the verifier, and some that is independent."""
    return evidence.groupBy("edge").agg(F.bool_or(F.col("detail").isNotNull() & (F.col("impl") == verifier)).alias("traceable"), F.bool_or("indep").alias("independent"))


def dimension_residual(terms: DataFrame) -> DataFrame:
    """(formula, verdict) of terms (formula, unit, exponent): HOMOGENEOUS if the dimensions cancel, UNDETERMINED if a unit isn't known."""
    dims = F.filter(F.split(expr.unit_dimension(F.col("unit")), " "), lambda d: d != "")
    rows = terms.withColumn("dim", expr.unit_dimension(F.col("unit"))).withColumn("part", F.explode_outer(dims))
    base, power = F.regexp_extract("part", r"^([A-Za-z]+)", 1), F.regexp_extract("part", r"(-?\d+)$", 1)
    sums = rows.groupBy("formula", base.alias("base")).agg(F.sum(F.col("exponent") * F.try_to_number(power, F.lit("S99")).cast("double")).alias("left"), F.bool_or(F.col("dim").isNull()).alias("unknown"))
    whole = sums.groupBy("formula").agg(F.bool_or("unknown").alias("unknown"), F.max(F.abs(F.coalesce("left", F.lit(0.0)))).alias("most"))
    return whole.select("formula", F.when(F.col("unknown"), "UNDETERMINED").when(F.col("most") < 1e-9, "HOMOGENEOUS").otherwise("CONTRADICTION").alias("verdict"))


def atoms(formula: Column) -> Column:
    """Number of atoms by element of a plain formula such as C6H12O6, as a sorted text."""
    parts = F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?\d*)"), F.lit(1))
    counted = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([A-Z][a-z]?)", 1).alias("e"), F.coalesce(F.try_to_number(F.regexp_extract(p, r"(\d+)$", 1), F.lit("9999")).cast("int"), F.lit(1)).alias("n")))
    names = F.array_sort(F.array_distinct(F.transform(counted, lambda c: c["e"])))
    return F.array_join(F.transform(names, lambda e: F.concat(e, F.aggregate(F.filter(counted, lambda c: c["e"] == e), F.lit(0), lambda s, c: s + c["n"]).cast("string"))), " ")
