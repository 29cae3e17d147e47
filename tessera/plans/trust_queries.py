"""Queries of evidence and grades, text and scalars, mutation and versions, streams' batch twins, sources and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import relations as R
from ..operators import traverse as TR
from ..operators import trust as E
from ..operators import versions as V
from ..streaming import flows
from .graph_queries import RANK_SQL
from .registry import Tables, query

EVIDENCE_SQL = """WITH ev AS (SELECT e.pos AS edge, p.p_brand AS src, 'h' || (e.part % 5) AS src_hash, e.line % 2 = 0 AS indep FROM e JOIN part p ON p.p_partkey = e.part WHERE e.qty <> 1
  UNION ALL SELECT pos, 'Brand#' || (supp % 25 + 1), 'h' || (supp % 5), line % 2 = 0 FROM e WHERE line >= 4 AND qty <> 1),
reg AS (SELECT 'Brand#' || b AS src, 'h' || (b % 5) AS hash, CASE WHEN b % 3 = 0 THEN 'not_in_repo' ELSE 'in_repo' END AS repo_status, b % 2 = 0 AS ok FROM (SELECT unnest(range(1, 24)) AS b)),
per AS (SELECT ev.*, CASE WHEN reg.src IS NULL THEN 'unverifiable_no_source' WHEN repo_status = 'not_in_repo' THEN 'unverifiable_not_in_repo' WHEN src_hash = hash THEN 'verified' ELSE 'changed' END AS fidelity, coalesce(ok, false) AS public FROM ev LEFT JOIN reg ON reg.src = ev.src),
worst AS (SELECT edge, CASE max(CASE fidelity WHEN 'verified' THEN 0 WHEN 'unverifiable_not_in_repo' THEN 1 WHEN 'unverifiable_no_source' THEN 2 ELSE 3 END) WHEN 0 THEN 'verified' WHEN 1 THEN 'unverifiable_not_in_repo' WHEN 2 THEN 'unverifiable_no_source' ELSE 'changed' END AS fidelity, count(DISTINCT src) FILTER (WHERE indep) AS independent, bool_and(public) AS public FROM per GROUP BY 1),
base AS (SELECT d.edge, d.level, w.fidelity, w.independent, w.public, least(CASE level WHEN 'cross_source' THEN 5 WHEN 'human_reviewed' THEN 5 WHEN 'rule_checked' THEN 4 WHEN 'by_construction' THEN 3 WHEN 'source_asserted' THEN 3 ELSE 1 END, CASE w.fidelity WHEN 'verified' THEN 5 WHEN 'unverifiable_not_in_repo' THEN 2 ELSE 1 END) AS b
  FROM (SELECT DISTINCT pos AS edge, level FROM e) d LEFT JOIN worst w ON w.edge = d.edge),
internal AS (SELECT edge, level, coalesce(fidelity, 'unverifiable_no_source') AS fidelity, CASE WHEN fidelity IS NULL THEN 1 WHEN independent >= 2 AND b >= 3 THEN least(b + 1, 5) ELSE b END::INT AS internal, coalesce(public, false) AS ok FROM base),
g AS (SELECT edge, level, fidelity, internal, least(internal, CASE WHEN ok THEN 5 ELSE 2 END)::INT AS public_grade FROM internal)
"""


def evidence(g: Tables) -> DataFrame:
    """One or two pieces of evidence an edge of the contains layer: of the part's brand, and from line 4 on of another."""
    e = g.e.where("qty <> 1")
    first = e.join(g.table("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("src")), "part").select(F.col("pos").alias("edge"), "src", F.concat(F.lit("h"), F.col("part") % 5).alias("src_hash"), (F.col("line") % 2 == 0).alias("indep"))
    second = e.where("line >= 4").select(F.col("pos").alias("edge"), F.concat(F.lit("Brand#"), F.col("supp") % 25 + 1).alias("src"), F.concat(F.lit("h"), F.col("supp") % 5).alias("src_hash"), (F.col("line") % 2 == 0).alias("indep"))
    return first.unionAll(second)


def registry(g: Tables) -> DataFrame:
    b = F.col("id")
    return g.spark.range(1, 24).select(F.concat(F.lit("Brand#"), b).alias("src"), F.lit(True).alias("known"), F.concat(F.lit("h"), b % 5).alias("hash"), F.when(b % 3 == 0, "not_in_repo").otherwise("in_repo").alias("repo_status"), (b % 2 == 0).alias("redistributable"))


def grades(g: Tables) -> DataFrame:
    return E.graded(g.e.select(F.col("pos").alias("edge"), "level").distinct(), evidence(g), registry(g))


@query("ev1_fidelity", f"{EVIDENCE_SQL} SELECT edge, fidelity FROM g", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return grades(g).select("edge", "fidelity")


@query("ag8_fidelity_counts", f"{EVIDENCE_SQL} SELECT fidelity, count(*) AS n FROM g GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.counts(grades(g), "fidelity")


@query("ev2_proven_changes", f"{EVIDENCE_SQL} SELECT count(*) FILTER (WHERE proven) AS proven, count(*) FILTER (WHERE NOT proven) AS unproven, count(*) AS changed FROM (SELECT edge, bool_and(fidelity <> 'changed' OR src IN ('Brand#5', 'Brand#10')) AS proven FROM per WHERE edge IN (SELECT edge FROM worst WHERE fidelity = 'changed') GROUP BY 1)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    per = E.source_fidelity(evidence(g), registry(g))
    attested = g.spark.sql("SELECT explode(array('Brand#5', 'Brand#10')) AS src, true AS attested")
    rows = per.where("fidelity = 'changed'").join(attested, "src", "left").groupBy("edge").agg(F.bool_and(F.coalesce("attested", F.lit(False))).alias("proven"))
    return rows.agg(F.count_if("proven").alias("proven"), F.count_if(~F.col("proven")).alias("unproven"), F.count("*").alias("changed"))


STATUS_SQL = "CASE WHEN okey % 11 = 0 THEN NULL WHEN okey % 10 = 0 THEN 'needs_review' WHEN okey % 10 = 1 THEN 'stale' WHEN okey % 10 = 2 THEN 'rejected' ELSE 'valid' END"


def status() -> F.Column:
    k = F.col("okey") % 10
    return F.when(F.col("okey") % 11 == 0, None).when(k == 0, "needs_review").when(k == 1, "stale").when(k == 2, "rejected").otherwise("valid")


@query("ag7_worst_status", f"SELECT target AS id, CASE max(CASE {STATUS_SQL} WHEN 'valid' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'stale' THEN 2 WHEN 'rejected' THEN 3 END) WHEN 0 THEN 'valid' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'stale' ELSE 'rejected' END AS status FROM e WHERE {STATUS_SQL} IS NOT NULL GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.worst(g.e.select(F.col("target").alias("id"), status().alias("status")).where("status IS NOT NULL"), "id", "status", E.STATUS)


@query("ag9_status_counts", f"SELECT coalesce({STATUS_SQL}, 'no_record') AS status, count(DISTINCT okey) AS n FROM e GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return E.statuses(g.e.select("okey", status().alias("status")), "okey")


@query("fl4_without_stale", f"{EVIDENCE_SQL}, st AS (SELECT DISTINCT pos AS edge, {STATUS_SQL} AS status FROM e) SELECT g.edge FROM g JOIN st ON st.edge = g.edge WHERE NOT (g.fidelity IN ('changed', 'unverifiable_no_source') OR coalesce(st.status IN ('stale', 'rejected'), false))", (), ("contains",))
def _(g: Tables) -> DataFrame:
    st = g.e.select(F.col("pos").alias("edge"), status().alias("status")).distinct()
    return grades(g).join(st, "edge").where(~R.stale(F.col("fidelity"), F.col("status"))).select("edge")


@query("ev4_stale_reasons", f"{EVIDENCE_SQL}, st AS (SELECT DISTINCT pos AS edge, {STATUS_SQL} AS status FROM e) SELECT concat_ws(',', CASE WHEN g.fidelity IN ('changed', 'unverifiable_no_source') THEN g.fidelity END, CASE WHEN st.status IN ('stale', 'rejected') THEN st.status END) AS reasons, count(*) AS n FROM g JOIN st ON st.edge = g.edge GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    st = g.e.select(F.col("pos").alias("edge"), status().alias("status")).distinct()
    reasons = F.concat_ws(",", F.when(F.col("fidelity").isin("changed", "unverifiable_no_source"), F.col("fidelity")), F.when(F.col("status").isin("stale", "rejected"), F.col("status")))
    return R.counts(grades(g).join(st, "edge").select(reasons.alias("reasons")), "reasons")


@query("ev3_dependency_status", f"{EVIDENCE_SQL} SELECT src, fidelity, count(*) AS n, count(DISTINCT edge) AS edges FROM per GROUP BY ALL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return E.source_fidelity(evidence(g), registry(g)).groupBy("src", "fidelity").agg(F.count("*").alias("n"), F.count_distinct("edge").alias("edges"))


@query("ev5_internal_grade", f"{EVIDENCE_SQL} SELECT edge, internal FROM g", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return grades(g).select("edge", "internal")


@query("ev6_public_grade", f"{EVIDENCE_SQL} SELECT edge, public_grade FROM g", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return grades(g).select("edge", "public_grade")


@query("ag10_grade_histogram", f"{EVIDENCE_SQL} SELECT internal, public_grade, count(*) AS n FROM g GROUP BY ALL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return grades(g).groupBy("internal", "public_grade").agg(F.count("*").alias("n"))


@query("ev7_grade_rules", f"{EVIDENCE_SQL} SELECT 'public_above_internal' AS rule, count(*) FILTER (WHERE public_grade > internal) AS n FROM g UNION ALL SELECT 'five_not_recomputable', count(*) FILTER (WHERE internal = 5 AND fidelity <> 'verified') FROM g UNION ALL SELECT 'model_above_one', count(*) FILTER (WHERE level = 'model_inferred' AND internal > 1) FROM g UNION ALL SELECT 'out_of_range', count(*) FILTER (WHERE internal NOT BETWEEN 1 AND 5 OR public_grade NOT BETWEEN 1 AND 5) FROM g", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return E.reconciled(grades(g))


@query("ag11_worklist", f"{EVIDENCE_SQL} SELECT coalesce(p.src, '(none)') AS src, count(*) AS n, count(DISTINCT level) AS levels FROM g LEFT JOIN (SELECT DISTINCT edge, src FROM per) p ON p.edge = g.edge WHERE internal <= 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return E.worklist(grades(g), evidence(g), 10)


@query("ag12_source_table", "SELECT src, coalesce(nodes, 0) AS nodes, coalesce(docs, 0) AS docs FROM (SELECT coalesce(a.s, b.s) AS src, nodes, docs FROM (SELECT source AS s, count(*) AS nodes FROM n GROUP BY 1) a FULL JOIN (SELECT source AS s, count(*) AS docs FROM documents GROUP BY 1) b ON a.s = b.s)", ("OR", "PA"))
def _(g: Tables) -> DataFrame:
    a, b = R.counts(g.n, "source").withColumnRenamed("n", "nodes"), R.counts(g.table("documents"), "source").withColumnRenamed("n", "docs")
    return a.join(b, "source", "full_outer").fillna(0, ["nodes", "docs"]).withColumnRenamed("source", "src")


@query("ev8_evidence_layers", f"{EVIDENCE_SQL} SELECT any_indep, count(*) AS n FROM (SELECT edge, bool_or(indep) AS any_indep FROM per GROUP BY 1) GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    rows = E.evidence_layers(evidence(g).withColumns({"detail": F.col("src_hash"), "impl": F.lit("rule")}), "rule")
    return rows.groupBy(F.col("independent").alias("any_indep")).agg(F.count("*").alias("n"))


@query("ev9_well_formed", f"{EVIDENCE_SQL} SELECT count(*) FILTER (WHERE src_hash IS NULL OR NOT regexp_matches(src_hash, '^h[0-9]$')) AS malformed, count(*) AS n FROM per", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return evidence(g).agg(F.count_if(F.col("src_hash").isNull() | ~F.col("src_hash").rlike("^h[0-9]$")).alias("malformed"), F.count("*").alias("n"))


@query("ev10_binding_ratio", f"{EVIDENCE_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE fidelity <> 'unverifiable_no_source') AS bound, round_even(100.0 * count(*) FILTER (WHERE fidelity <> 'unverifiable_no_source') / count(*), 3)::DOUBLE AS pct FROM per", (), ("contains",))
def _(g: Tables) -> DataFrame:
    one = E.source_fidelity(evidence(g), registry(g)).agg(F.count("*").alias("n"), F.count_if(F.col("fidelity") != "unverifiable_no_source").alias("bound"))
    return one.withColumn("pct", expr.percent(F.col("bound"), F.col("n")).cast("double"))


@query("ev11_licence_partition", f"{EVIDENCE_SQL} SELECT src, public, count(*) AS n FROM per GROUP BY ALL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return E.source_fidelity(evidence(g), registry(g)).groupBy("src", "public").agg(F.count("*").alias("n"))


@query("ev12_partition_violations", f"{EVIDENCE_SQL} SELECT count(*) AS n FROM per WHERE public AND src NOT IN (SELECT src FROM reg WHERE ok)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    ok = registry(g).where("redistributable").select("src")
    return E.source_fidelity(evidence(g), registry(g)).where("public").join(ok, "src", "left_anti").agg(F.count("*").alias("n"))


@query("ev13_lineage_licence", "WITH RECURSIVE up AS (SELECT p_partkey AS id, p_partkey AS anc FROM part UNION SELECT id, anc // 2 FROM up WHERE anc >= 2) SELECT id, bool_and(p_size % 7 <> 0) AS allowed FROM up JOIN part ON p_partkey = anc GROUP BY 1")
def _(g: Tables) -> DataFrame:
    from .graph_queries import lineage

    own = g.table("part").select(F.col("p_partkey").alias("ancestor"), (F.col("p_size") % 7 != 0).alias("ok"))
    above = TR.closure(lineage(g)).select("id", "ancestor").unionAll(own.select(F.col("ancestor").alias("id"), "ancestor"))
    return above.join(own, "ancestor").groupBy("id").agg(F.bool_and("ok").alias("allowed"))


@query("ev14_residuals", f"{EVIDENCE_SQL} SELECT CASE WHEN fidelity = 'changed' THEN 'source_changed' WHEN fidelity LIKE 'unverifiable%' THEN 'source_missing' WHEN level IN ('unverified', 'model_inferred') THEN 'level_too_low' ELSE 'UNCLASSIFIED' END AS reason, count(*) AS n FROM g WHERE internal <= 2 GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    reason = F.when(F.col("fidelity") == "changed", "source_changed").when(F.col("fidelity").startswith("unverifiable"), "source_missing").when(F.col("level").isin("unverified", "model_inferred"), "level_too_low").otherwise("UNCLASSIFIED")
    return R.counts(grades(g).where("internal <= 2").select(reason.alias("reason")), "reason")


@query("ev15_denominators", "SELECT count(*) FILTER (WHERE f1 OR f2) AS in_union, count(*) FILTER (WHERE f1) + count(*) FILTER (WHERE f2) AS family_sum, count(*) FILTER (WHERE NOT f1 AND NOT f2) AS outside FROM (SELECT kind = 'R' AS f1, line >= 4 AS f2 FROM e)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    f1, f2 = F.col("kind") == "R", F.col("line") >= 4
    return g.e.agg(F.count_if(f1 | f2).alias("in_union"), (F.count_if(f1) + F.count_if(f2)).alias("family_sum"), F.count_if(~f1 & ~f2).alias("outside"))


@query("ev16_gate_scopes", "SELECT kind, level, count(*) AS n FROM e WHERE (kind, level) NOT IN (('N', 'rule_checked'), ('N', 'by_construction'), ('A', 'source_asserted'), ('A', 'model_inferred')) GROUP BY ALL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    allowed = g.spark.sql("SELECT * FROM VALUES ('N', 'rule_checked'), ('N', 'by_construction'), ('A', 'source_asserted'), ('A', 'model_inferred') AS t(kind, level)")
    return R.counts(g.e.join(allowed, ["kind", "level"], "left_anti"), "kind", "level")


@query("ev17_stored_against_derived", f"SELECT count(*) FILTER (WHERE (kind = 'N') <> ({RANK_SQL} >= 3)) AS differ, count(*) AS n FROM e", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return g.e.agg(F.count_if((F.col("kind") == "N") != expr.verified(F.col("level"))).alias("differ"), F.count("*").alias("n"))


UNIT_ROWS = "CASE p_size % 4 WHEN 0 THEN 'J' WHEN 1 THEN ' kg ' WHEN 2 THEN 'J/(mol*K)' ELSE 'furlong' END"
UNIT_SQL = "CASE p_size % 4 WHEN 0 THEN 'M1 L2 T-2' WHEN 1 THEN 'M1' WHEN 2 THEN 'M1 L2 T-2 Th-1 N-1' END"


@query("tx8_unit_dimensions", f"SELECT p_partkey, {UNIT_SQL} AS dimension FROM part")
def _(g: Tables) -> DataFrame:
    return g.table("part").select("p_partkey", expr.unit_dimension(F.expr(UNIT_ROWS)).alias("dimension"))


@query("ev18_units_of_quantities", f"SELECT p_brand, count(DISTINCT {UNIT_SQL}) AS dimensions, count(*) FILTER (WHERE {UNIT_SQL} IS NULL) AS undecided FROM part GROUP BY 1")
def _(g: Tables) -> DataFrame:
    rows = g.table("part").select("p_brand", expr.unit_dimension(F.expr(UNIT_ROWS)).alias("d"))
    return rows.groupBy("p_brand").agg(F.count_distinct("d").alias("dimensions"), F.count_if(F.col("d").isNull()).alias("undecided"))


@query("ev19_field_report", "SELECT rule, passed, count(*) AS n FROM (SELECT unnest(['named', 'typed', 'priced']) AS rule, unnest([length(p_name) > 9, p_type <> 'PROMO', p_retailprice >= 1000]) AS passed FROM part) GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    rules = {"named": F.char_length("p_name") > 9, "typed": F.col("p_type") != "PROMO", "priced": F.col("p_retailprice") >= 1000}
    rows = g.table("part").select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("passed")) for k, c in rules.items()])).alias("r")).select("r.*")
    return rows.groupBy("rule", "passed").agg(F.count("*").alias("n"))


@query("ev20_atom_balance", "SELECT p_partkey, p_size % 2 = 1 AS balanced FROM part")
def _(g: Tables) -> DataFrame:
    """Hn O against Hm O H, m the even number not above n: they balance where n is odd."""
    left, even = F.concat(F.lit("H"), "p_size", F.lit("O")), F.col("p_size") - F.col("p_size") % 2
    right = F.concat(F.when(even > 0, F.concat(F.lit("H"), even)).otherwise(F.lit("")), F.lit("OH"))
    left = F.when(F.col("p_size") == 1, F.lit("HO")).otherwise(left)
    return g.table("part").select("p_partkey", (E.atoms(left) == E.atoms(right)).alias("balanced"))


@query("ev21_approval_gate", "SELECT CASE WHEN h IS NULL THEN 'no_review' WHEN h <> digest THEN 'outdated' ELSE 'approved' END AS state, count(*) AS n FROM (SELECT substr(sha256(p_name || p_size), 1, 16) AS digest, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN substr(sha256(p_name || p_size), 1, 16) ELSE 'old' END AS h FROM part) GROUP BY 1")
def _(g: Tables) -> DataFrame:
    now = g.table("part").select("p_partkey", expr.digest(F.concat("p_name", F.col("p_size").cast("string"))).alias("digest"))
    reviews = now.where("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 1, F.col("digest")).otherwise("old").alias("reviewed"))
    state = F.when(F.col("reviewed").isNull(), "no_review").when(F.col("reviewed") != F.col("digest"), "outdated").otherwise("approved")
    return R.counts(now.join(reviews, "p_partkey", "left").select(state.alias("state")), "state")


# text and scalars


@query("tx4_tokens", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^0-9a-z]+', ' ', 'g')) AS line FROM part")
def _(g: Tables) -> DataFrame:
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit(" — ")), F.lit("'s (kind)"))
    return g.table("part").select("p_partkey", expr.token_line(raw).alias("line"))


@query("tx5_token_sequence", "SELECT p_partkey FROM part WHERE contains(' ' || p_name || ' ', ' red ring ')")
def _(g: Tables) -> DataFrame:
    return g.table("part").where(expr.holds_tokens(expr.token_line(F.col("p_name")), F.lit("red ring"))).select("p_partkey")


@query("tx6_latex_plain", "SELECT p_partkey, split_part(p_name, ' ', 1) || 'hbar' || split_part(p_name, ' ', 2) || '_' || p_size AS plain FROM part")
def _(g: Tables) -> DataFrame:
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    latex = F.concat(F.lit("$\\mathrm{"), word(1), F.lit("} \\hbar \\text{\\mathbf{"), word(2), F.lit("}}_{"), F.col("p_size").cast("string"), F.lit("}$"))
    return g.table("part").select("p_partkey", expr.latex_plain(latex).alias("plain"))


@query("tx7_has_symbol", "SELECT p_partkey, contains(replace(p_name, ' ', ''), 'ring') AS present, CASE WHEN p_size % 2 = 0 THEN true END AS declared FROM part")
def _(g: Tables) -> DataFrame:
    none, some = F.array().cast("array<string>"), F.array(F.lit("q"), F.lit("m"))
    declared = expr.has_symbol(F.when(F.col("p_size") % 2 == 0, F.lit("a + b")), some, F.lit("m_0"))
    return g.table("part").select("p_partkey", expr.has_symbol(F.col("p_name"), none, F.lit("ring_7")).alias("present"), declared.alias("declared"))


@query("tx10_doi", "SELECT p_partkey, '10.' || (1000 + p_size) || '/' || lower(p_brand) AS doi, true AS valid FROM part")
def _(g: Tables) -> DataFrame:
    raw = F.concat(F.lit(" https://doi.org/10."), (1000 + F.col("p_size")).cast("string"), F.lit("/"), "p_brand")
    return g.table("part").select("p_partkey", expr.doi(raw).alias("doi"), expr.doi_valid(raw).alias("valid"))


@query("tx11_https", "SELECT page_id, starts_with(url, 'https://') AS secure FROM pages")
def _(g: Tables) -> DataFrame:
    return g.table("pages").select("page_id", (F.try_parse_url("url", F.lit("PROTOCOL")) == "https").alias("secure"))


@query("tx13_namespace", "SELECT split_part(id, ':', 1) AS ns, count(*) AS n FROM n GROUP BY 1", ("CU", "PA", "US"))
def _(g: Tables) -> DataFrame:
    return R.counts(g.n.select(expr.namespace(F.col("id")).alias("ns")), "ns")


@query("tx14_iso_dates", "SELECT o_orderkey, try_cast(strftime(o_orderdate, '%Y-%m-%d') AS DATE) IS NOT NULL AS valid, false AS bad FROM orders")
def _(g: Tables) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    good = F.coalesce(F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd") == iso, F.lit(False))
    broken = F.concat(F.substring(iso, 1, 8), F.lit("39"))
    return g.table("orders").select("o_orderkey", good.alias("valid"), F.coalesce(F.try_to_date(broken, "yyyy-MM-dd").isNotNull(), F.lit(False)).alias("bad"))


@query("tx15_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'none' AS missing FROM events")
def _(g: Tables) -> DataFrame:
    return g.table("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.nothing"), F.lit("none")).alias("missing"))


@query("tx16_array_ops", "SELECT id, len(labels) AS size, list_contains(labels, 'Formula') AS formula, array_to_string(list_sort(labels), ',') AS sorted FROM n", ("DE", "DD", "DO", "PA"))
def _(g: Tables) -> DataFrame:
    return g.n.select("id", F.size("labels").cast("bigint").alias("size"), F.array_contains("labels", "Formula").alias("formula"), F.array_join(F.array_sort("labels"), ",").alias("sorted"))


@query("tx17_dimension_equality", "SELECT p_partkey, p_size % 4 = 0 AS is_energy FROM part")
def _(g: Tables) -> DataFrame:
    return g.table("part").select("p_partkey", F.coalesce(expr.unit_dimension(F.expr(UNIT_ROWS)) == expr.unit_dimension(F.lit("eV")), F.lit(False)).alias("is_energy"))


#: Constants in SI units, and the seven relations among them.
CONSTANTS = {"N": 6.02214076e23, "k": 1.380649e-23, "e": 1.602176634e-19, "h": 6.62607015e-34, "c": 299792458.0, "R": 8.314462618, "F": 96485.33212, "eps": 8.8541878128e-12, "mu": 1.25663706212e-6, "hbar": 1.054571817e-34, "sigma": 5.670374419e-8, "alpha": 7.2973525693e-3, "phi": 2.067833848e-15}
RELATIONS = {"R": "N * k", "F": "N * e", "c": "1 / sqrt(eps * mu)", "hbar": "h / (2 * pi())", "sigma": "2 * pow(pi(), 5) * pow(k, 4) / (15 * pow(h, 3) * c * c)", "alpha": "e * e / (2 * eps * h * c)", "phi": "h / (2 * e)"}
CONSTANT_ROW = ", ".join(f"{v!r}{'' if 'e' in repr(v) else 'e0'} AS {k}" for k, v in CONSTANTS.items())


@query("tx18_constants", f"WITH c AS (SELECT {CONSTANT_ROW}) " + " UNION ALL ".join(f"SELECT '{k}' AS name, abs({k} - {f}) / abs({k}) <= 1e-6 AS holds FROM c" for k, f in RELATIONS.items()))
def _(g: Tables) -> DataFrame:
    one = g.spark.sql(f"SELECT {CONSTANT_ROW.replace('e0 AS', 'D AS')}")
    rows = F.array(*[F.struct(F.lit(k).alias("name"), (F.abs(F.col(k) - F.expr(f)) / F.abs(k) <= 1e-6).alias("holds")) for k, f in RELATIONS.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query("tx19_digests", "SELECT p_partkey, substr(sha256(p_name || '|' || p_brand), 1, 12) AS digest FROM part")
def _(g: Tables) -> DataFrame:
    return g.table("part").select("p_partkey", expr.digest(F.concat_ws("|", "p_name", "p_brand"), 12).alias("digest"))


@query(
    "gr21_link_score",
    """SELECT p_partkey, round(0.4 * (1 - levenshtein(p_name, 'red ring')::DOUBLE / greatest(length(p_name), 8)) + 0.1 * (p_size % 2 = 0)::INT / 2.0
    + 0.3 * len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'ring', 'of', 'steel']))::DOUBLE / (len(list_distinct(string_split(p_name, ' '))) + 4 - len(list_intersect(list_distinct(string_split(p_name, ' ')), ['red', 'ring', 'of', 'steel']))) + 0.2 * (p_type = 'PROMO')::INT, 4) AS score FROM part""",
)
def _(g: Tables) -> DataFrame:
    from ..operators.search import link_score

    symbols = (F.array(F.when(F.col("p_size") % 2 == 0, "m").otherwise("q")), F.array(F.lit("m"), F.lit("r")))
    score = link_score(F.col("p_name"), F.lit("red ring"), symbols, (F.col("p_name"), F.lit("red ring of steel")), (F.col("p_type"), F.lit("PROMO")))
    return g.table("part").select("p_partkey", F.round(score, 4).alias("score"))


# mutation and versions

DELTA_SQL = "WITH up AS (SELECT p_partkey + CASE WHEN p_partkey % 97 = 0 THEN 1000000 ELSE 0 END AS id, p_size + 1 AS size FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 97 = 0), kept AS (SELECT p_partkey AS id, p_size AS size FROM part WHERE p_partkey % 50 <> 0)"


def props(**columns: str) -> F.Column:
    return F.create_map(*[x for k, e in columns.items() for x in (F.lit(k), F.expr(e).cast("string"))])


def delta(g: Tables) -> tuple[DataFrame, DataFrame]:
    p = g.table("part")
    nodes = p.select(F.col("p_partkey").alias("id"), props(size="p_size", name="p_name").alias("props"))
    ups = p.where("p_partkey % 7 = 0 OR p_partkey % 97 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 97 == 0, 1000000).otherwise(0)).alias("id"), props(size="p_size + 1").alias("props"), F.lit(None).cast("array<string>").alias("props_drop"))
    edges = g.e.select(F.col("okey").alias("source"), F.col("part").alias("target"), "type", props(kind="kind").alias("props")).dropDuplicates(["source", "target", "type"])
    none = edges.select("source", "target", "type").limit(0)
    new = p.where("p_partkey % 97 = 0").select(F.lit(1).cast("bigint").alias("source"), (F.col("p_partkey") + 1000000).alias("target"), F.lit("contains").alias("type"), props(kind="'new'").alias("props"))
    anchored = nodes.unionByName(g.table("orders").select(F.col("o_orderkey").alias("id"), props(kind="'order'").alias("props")).join(nodes.select("id"), "id", "left_anti"))
    return V.applied(anchored, edges, p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")), ups, none, new)


@query("mg1_delta_nodes", f"{DELTA_SQL}, names AS (SELECT p_partkey AS id, p_name AS name FROM part), ids AS (SELECT id FROM kept UNION SELECT id FROM up UNION SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)) SELECT ids.id, coalesce(up.size, kept.size)::VARCHAR AS size FROM ids LEFT JOIN up ON up.id = ids.id LEFT JOIN kept ON kept.id = ids.id", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return delta(g)[0].select("id", F.element_at("props", "size").alias("size"))


@query("mg1_delta_edges", "WITH alive AS (SELECT DISTINCT okey, part FROM e WHERE part % 50 <> 0 AND okey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0)) SELECT count(*) + (SELECT count(*) FROM part WHERE p_partkey % 97 = 0) AS n FROM alive", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return delta(g)[1].agg(F.count("*").alias("n"))


@query("mg2_seed_merge", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands FROM part")
def _(g: Tables) -> DataFrame:
    p = g.table("part").select("p_partkey", "p_brand")
    return R.appended(p.where("p_partkey % 3 <> 0"), p, "p_partkey").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("mg3_prop_diff", "SELECT key, change, count(*) AS n FROM (SELECT 'size' AS key, 'changed' AS change FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'colour', 'added' FROM part WHERE p_partkey % 5 = 0) GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    p = g.table("part")
    old = p.select(F.col("p_partkey").alias("id"), props(size="p_size", seen="'monday'").alias("props"))
    plain = props(size="p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END", seen="'tuesday'")
    new = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, F.map_concat(plain, props(colour="'red'"))).otherwise(plain).alias("props"))
    return V.changes(old, new, ("seen",)).groupBy("key", "change").agg(F.count("*").alias("n"))


@query("mg4_content_id", """SELECT n, substr(sha256(concat_ws('|', n, p0, p1, p2, p3)), 1, 16) AS content_id FROM (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT) AS p0, sum(('0x' || substr(h, 9, 8))::BIGINT) AS p1, sum(('0x' || substr(h, 17, 8))::BIGINT) AS p2, sum(('0x' || substr(h, 25, 8))::BIGINT) AS p3
    FROM (SELECT sha256(concat_ws('|', id, source, array_to_string(labels, ','))) AS h FROM n))""", ("PA", "CU", "OR"))  # fmt: skip
def _(g: Tables) -> DataFrame:
    return V.content_id(g.n, F.concat_ws("|", "id", "source", F.array_join("labels", ",")))


@query(
    "mg5_change_classes",
    """WITH v AS (SELECT p_brand, p_partkey AS seq, p_partkey // 100 AS x, p_partkey // 10 % 10 AS y, p_partkey % 10 AS z, p_size // 40 AS schema_id, p_type, p_name FROM part),
    l AS (SELECT *, lag(seq) OVER w IS NULL AS first, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0, lag(schema_id) OVER w AS s0, lag(p_type) OVER w AS t0, lag(p_name) OVER w AS n0 FROM v WINDOW w AS (PARTITION BY p_brand ORDER BY seq)),
    c AS (SELECT *, CASE WHEN first THEN NULL WHEN schema_id <> s0 THEN 'major' WHEN p_type <> t0 THEN 'minor' WHEN p_name <> n0 THEN 'patch' ELSE 'none' END AS required_bump, CASE WHEN first THEN NULL WHEN x > x0 THEN 'major' WHEN y > y0 THEN 'minor' WHEN z > z0 THEN 'patch' ELSE 'none' END AS actual_bump FROM l)
    SELECT p_brand, seq, 'dataset_v' || x || '.' || y || '.' || z AS format_version, required_bump, actual_bump, CASE WHEN NOT first THEN list_position(['none', 'patch', 'minor', 'major'], actual_bump) >= list_position(['none', 'patch', 'minor', 'major'], required_bump) END AS declared FROM c""",
)
def _(g: Tables) -> DataFrame:
    k = F.col("p_partkey")
    version = F.concat(F.lit("dataset_v"), F.floor(k / 100), F.lit("."), F.floor(k / 10) % 10, F.lit("."), k % 10)
    rows = g.table("part").select("p_brand", k.alias("seq"), version.alias("format_version"), F.floor(F.col("p_size") / 40).cast("string").alias("schema_id"), F.col("p_type").alias("license_profile"), F.col("p_name").alias("source_sha256"), F.lit("same").alias("files_id"))
    return V.classified(rows, "p_brand")


@query("mg6_slice_ids", """SELECT domain, n, substr(sha256(concat_ws('|', n, p0, p1, p2, p3)), 1, 16) AS content_id FROM (SELECT domain, count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT) AS p0, sum(('0x' || substr(h, 9, 8))::BIGINT) AS p1, sum(('0x' || substr(h, 17, 8))::BIGINT) AS p2, sum(('0x' || substr(h, 25, 8))::BIGINT) AS p3
    FROM (SELECT domain, sha256(concat_ws('|', 'domain', domain, id)) AS h FROM n WHERE domain = 'chem.promo') GROUP BY 1)""", ("PA",))  # fmt: skip
def _(g: Tables) -> DataFrame:
    return V.content_id(g.n.where("domain = 'chem.promo'"), F.concat_ws("|", F.lit("domain"), "domain", "id")).select(F.lit("chem.promo").alias("domain"), "n", "content_id")


@query("sk5_ledger_append", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part")
def _(g: Tables) -> DataFrame:
    """What a ledger holds stays as it is, and what it lacks comes once, however often it is appended."""
    p = g.table("part").select("p_partkey", "p_name")
    once = R.appended(p.where("p_partkey % 2 = 0").withColumn("p_name", F.upper("p_name")), p, "p_partkey")
    return R.appended(once, p, "p_partkey")


@query("sk7_delta_chunks", "SELECT kind, chunk, count(*) AS n FROM (SELECT kind, CAST(floor((row_number() OVER (PARTITION BY kind ORDER BY pos, target) - 1) / 500.0) AS BIGINT) AS chunk FROM e) GROUP BY ALL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return V.chunks(g.e.select("kind", "pos", "target"), [F.col("pos"), F.col("target")], "kind", 500).groupBy("kind", "chunk").agg(F.count("*").alias("n"))


# streams' batch twins


@query("ss1_session_budget", """WITH RECURSIVE o AS (SELECT user_id, coalesce(value, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, k, CASE WHEN v <= 200 THEN v ELSE 0 END AS spent, (v <= 200)::INT AS ok FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN w.spent + o.v <= 200 THEN w.spent + o.v ELSE w.spent END, (w.spent + o.v <= 200)::INT FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
    SELECT user_id, sum(ok)::BIGINT AS accepted, sum(1 - ok)::BIGINT AS rejected, round(max(spent), 4) AS spent FROM w GROUP BY 1""")  # fmt: skip
def _(g: Tables) -> DataFrame:
    return flows.budgets(g.table("events"), 200.0).withColumn("spent", F.round("spent", 4))


@query("ss2_daily_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('view', 'signup', 'error', 'click', 'purchase') AND ts IS NOT NULL GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    return flows.usage(g.table("events")).withColumns({"day": F.col("day").cast("string"), "total": F.round("total", 4)})


@query("ag21_usage_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(g: Tables) -> DataFrame:
    return flows.usage(g.table("events")).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("ss3_sessions", "SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1")
def _(g: Tables) -> DataFrame:
    return flows.sessions(g.table("events"), "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("ss3_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    return flows.tumbling(g.table("events"), "6 hours")


# sources


@query("sc1_graph_frames", "SELECT 'node' AS part, id, labels[1] AS kind FROM n UNION ALL SELECT 'edge', 'in_region|' || source || '|' || target, type FROM e", ("NA", "RG"), ("in_region",))
def _(g: Tables) -> DataFrame:
    """A graph document of nations and regions, written to the shared folder and read back."""
    import uuid

    from ..operators.traverse import shared_dir
    from ..sources.io import read_graph

    nodes = g.n.agg(F.collect_list(F.struct("id", "labels", F.to_json(F.struct("name")).alias("props"))).alias("nodes"))
    edges = g.e.agg(F.collect_list(F.struct("source", "target", "type")).alias("edges"))
    path = f"{shared_dir(g.spark)}/graph-{uuid.uuid4().hex}"
    nodes.crossJoin(F.broadcast(edges)).select(F.to_json(F.struct("nodes", "edges")).alias("value")).coalesce(1).write.text(path)
    graph = read_graph(g.spark, path)
    return graph.nodes.select(F.lit("node").alias("part"), "id", F.get("labels", F.lit(0)).alias("kind")).unionAll(graph.edges.select(F.lit("edge"), "id", "kind"))


@query("sc2_unique_ids", "SELECT count(*) AS repeated FROM (SELECT id FROM n GROUP BY 1 HAVING count(*) > 1)", ("PA", "OR", "CU", "DE", "DD", "DO"))
def _(g: Tables) -> DataFrame:
    return R.repeated(g.n, "id").agg(F.count("*").alias("repeated"))


@query("sc4_last_value", "SELECT source AS head, max_by(target, pos * 100000 + part) AS tail FROM e WHERE kind = 'R' GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return g.e.where("kind = 'R'").groupBy(F.col("source").alias("head")).agg(F.max_by("target", F.col("pos") * 100000 + F.col("part")).alias("tail"))


@query("sc5_bounded_subset", "WITH f AS (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 50) SELECT DISTINCT part FROM e WHERE okey IN (SELECT o_orderkey FROM f)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    first = g.table("orders").orderBy("o_orderkey").limit(50).select(F.col("o_orderkey").alias("okey"))
    return g.e.join(F.broadcast(first), "okey", "left_semi").select("part").distinct()


@query("sk9_unique_constraint", "SELECT count(*) = count(DISTINCT c_custkey) AS holds FROM customer")
def _(g: Tables) -> DataFrame:
    return g.table("customer").agg((F.count("*") == F.count_distinct("c_custkey")).alias("holds"))


# audits: n must be zero where nothing is wrong


@query("au1_same_dimension", f"SELECT p_partkey, {UNIT_SQL} = CASE p_size % 3 WHEN 0 THEN 'M1 L2 T-2' WHEN 1 THEN 'M1' ELSE 'L1' END AS same FROM part")
def _(g: Tables) -> DataFrame:
    other = F.expr("CASE p_size % 3 WHEN 0 THEN 'eV' WHEN 1 THEN 'kg' ELSE 'm' END")
    return g.table("part").select("p_partkey", (expr.unit_dimension(F.expr(UNIT_ROWS)) == expr.unit_dimension(other)).alias("same"))


@query("au3_homogeneous", "SELECT p_partkey AS formula, CASE p_size % 3 WHEN 0 THEN 'HOMOGENEOUS' WHEN 1 THEN 'CONTRADICTION' ELSE 'UNDETERMINED' END AS verdict FROM part")
def _(g: Tables) -> DataFrame:
    """E = m v^2 with v in m/s, in m, and in a unit that isn't known."""
    v = F.expr("CASE p_size % 3 WHEN 0 THEN 'm/s' WHEN 1 THEN 'm' ELSE 'furlong' END")
    terms = F.array(*[F.struct(u.alias("unit"), F.lit(x).alias("exponent")) for u, x in ((F.lit("J"), 1.0), (F.lit("kg"), -1.0), (v, -2.0))])
    return E.dimension_residual(g.table("part").select(F.col("p_partkey").alias("formula"), F.explode(terms).alias("t")).select("formula", "t.*"))


@query("au5_level_bounds", f"SELECT kind, min({RANK_SQL}) AS lowest, max({RANK_SQL}) AS highest FROM e GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    rank = expr.level_rank(F.col("level"))
    return g.e.groupBy("kind").agg(F.min(rank).alias("lowest"), F.max(rank).alias("highest"))


@query("au9_levels_recompute", f"SELECT level AS stored, CASE WHEN kind = 'N' THEN 'rule_checked' ELSE level END AS recomputed, count(*) AS n FROM e GROUP BY ALL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    again = F.when(F.col("kind") == "N", "rule_checked").otherwise(F.col("level"))
    return g.e.groupBy(F.col("level").alias("stored"), again.alias("recomputed")).agg(F.count("*").alias("n"))


@query("au10_enough_references", "SELECT count(*) FILTER (WHERE n < 2) AS few, count(*) AS targets FROM (SELECT target, count(*) AS n FROM e GROUP BY 1)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.counts(g.e, "target").agg(F.count_if(F.col("n") < 2).alias("few"), F.count("*").alias("targets"))


@query("au11_bridge_evidence", f"SELECT target, count(*) AS n, count(*) FILTER (WHERE {RANK_SQL} >= 3) AS strong FROM e GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (WHERE {RANK_SQL} >= 3) = count(*)", (), ("in_region", "supp_nation"))
def _(g: Tables) -> DataFrame:
    per = g.e.groupBy("target").agg(F.count("*").alias("n"), F.count_if(expr.verified(F.col("level"))).alias("strong"))
    return per.where("n >= 5 AND strong = n")


@query("au16_island_freeze", "SELECT count(*) <= 5 AND min(size) >= 1 AS frozen FROM (SELECT target, count(*) AS size FROM e GROUP BY 1)", (), ("in_region",))
def _(g: Tables) -> DataFrame:
    per = TR.components(g.e).groupBy("component").agg(F.count("*").alias("size"))
    return per.agg(((F.count("*") <= 5) & (F.min("size") >= 1)).alias("frozen"))


@query("au19_traceable_share", f"{EVIDENCE_SQL} SELECT count(DISTINCT edge) AS strict_edges, count(DISTINCT edge) FILTER (WHERE edge IN (SELECT edge FROM per WHERE indep)) AS traceable FROM g WHERE level IN ('rule_checked', 'cross_source', 'human_reviewed')", (), ("contains",))
def _(g: Tables) -> DataFrame:
    strict_edges = g.e.where(expr.strict(F.col("level"))).select(F.col("pos").alias("edge")).distinct()
    independent = evidence(g).where("indep").select("edge").distinct().withColumn("t", F.lit(True))
    return strict_edges.join(independent, "edge", "left").agg(F.count("*").alias("strict_edges"), F.count_if("t").alias("traceable"))


@query("au22_source_registered", f"{EVIDENCE_SQL} SELECT src, count(*) AS n FROM per WHERE src NOT IN (SELECT src FROM reg) GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.counts(evidence(g).join(registry(g).select("src"), "src", "left_anti"), "src")


@query("au24_independence_accounted", f"{EVIDENCE_SQL}, i AS (SELECT edge, bool_or(indep) AS indep, count(*) AS n FROM per GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'single_source' ELSE 'dependent_sources' END AS reason, count(*) AS n FROM i WHERE NOT indep GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    per = evidence(g).groupBy("edge").agg(F.bool_or("indep").alias("indep"), F.count("*").alias("k"))
    return R.counts(per.where("NOT indep").select(F.when(F.col("k") == 1, "single_source").otherwise("dependent_sources").alias("reason")), "reason")


@query("au25_scope_accounted", "SELECT CASE WHEN type IN ('contains', 'supplied_by') THEN 'trade' WHEN type IN ('in_nation', 'in_region') THEN 'place' ELSE 'excluded: log' END AS scope, count(*) AS n FROM e GROUP BY 1", (), ("contains", "supplied_by", "cust_nation", "supp_nation", "in_region", "did"))
def _(g: Tables) -> DataFrame:
    scope = F.when(F.col("type").isin("contains", "supplied_by"), "trade").when(F.col("type").isin("in_nation", "in_region"), "place").otherwise("excluded: log")
    return R.counts(g.e.select(scope.alias("scope")), "scope")


@query("au27_release_hygiene", "SELECT (SELECT count(*) FROM (SELECT id FROM n GROUP BY 1 HAVING count(*) > 1)) AS repeated, count(*) FILTER (WHERE e.source = e.target) AS loops, count(*) FILTER (WHERE t.id IS NULL) AS dangling FROM e LEFT JOIN n t ON t.id = e.target", ("PA",), ("contains",))
def _(g: Tables) -> DataFrame:
    ids = g.n.select(F.col("id").alias("target"), F.lit(True).alias("there")).distinct()
    edges = g.e.join(ids, "target", "left").agg(F.count_if(F.col("source") == F.col("target")).alias("loops"), F.count_if(F.col("there").isNull()).alias("dangling"))
    return R.repeated(g.n, "id").agg(F.count("*").alias("repeated")).crossJoin(F.broadcast(edges))


@query("au28_fill_ratio", "SELECT labels[1] AS label, round_even(100.0 * count(domain) / count(*), 2)::DOUBLE AS pct FROM n GROUP BY 1", ("DE", "DD", "DO", "PA"))
def _(g: Tables) -> DataFrame:
    return g.n.groupBy(F.get("labels", F.lit(0)).alias("label")).agg(expr.percent(F.count("domain"), F.count("*"), 2).cast("double").alias("pct"))


@query("au29_covered_parts", "SELECT count(DISTINCT n.id) AS parts, count(DISTINCT n.id) FILTER (WHERE n.id IN (SELECT target FROM e)) AS covered FROM n", ("PA",), ("contains",))
def _(g: Tables) -> DataFrame:
    hit = g.e.select(F.col("target").alias("id")).distinct().withColumn("hit", F.lit(True))
    return g.n.select("id").join(hit, "id", "left").agg(F.count("*").alias("parts"), F.count_if("hit").alias("covered"))


@query("cs1_result_stack", "SELECT kind, count(*) AS n FROM (SELECT pos, target, kind FROM e WHERE kind = 'R' UNION SELECT pos, target, kind FROM e WHERE kind = 'A') GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    steps = [g.e.where(F.col("kind") == k).select("pos", "target", "kind") for k in ("R", "A", "R")]
    return R.counts(R.union_first(steps, ["pos", "target", "kind"]), "kind")


@query("gr11_sampled_neighbourhood", None, (), ("contains",))
def _(g: Tables) -> DataFrame:
    seeds = g.e.agg(F.min("target").alias("id"))
    return TR.sampled(g.e.withColumn("priority", expr.edge_priority(F.col("type"), F.lit(False))), seeds, 3, 3)


@query("ag24_approximate_counts", None, (), ("contains",))
def _(g: Tables) -> DataFrame:
    return g.e.groupBy("kind").agg(F.approx_count_distinct("source").alias("sources"), F.approx_count_distinct("target").alias("targets"))


@query("wn_previous_event", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def _(g: Tables) -> DataFrame:
    return g.table("events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
