"""Queries of projections, filters, joins, aggregates, rankings, sets and traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import relations as R
from ..operators import search as S
from ..operators import traverse as T
from ..sources.bench import DOCUMENTS, GEO, NODES
from .registry import Tables, query

ALL = tuple(NODES)
DOMAINS = ("CU", "PA", "OR", *DOCUMENTS, "US")
PRIORITY = "[" + ", ".join(f"'{t}'" for t in expr.TYPE_PRIORITY) + "]"
TYPE_SQL = f"coalesce(list_filter({PRIORITY}, lambda x: list_contains(labels, x))[1], labels[1], 'Unknown')"
SUBJECT_SQL = """CASE WHEN d LIKE 'chem%' OR d LIKE 'ek%' OR d LIKE 'bio%' THEN '化学' WHEN d LIKE 'phy%' OR d LIKE 'pb%' THEN '物理'
WHEN d LIKE 'math%' OR d LIKE 'mx%' OR d LIKE 'mg%' THEN '数学' WHEN d <> '' THEN '跨学科'
WHEN upper(split_part(id, ':', 1)) IN ('PQ','PB','CM','QM','TH','EM','OP','SM','RT','UN','SY','CO','FO') THEN '物理'
WHEN upper(split_part(id, ':', 1)) IN ('EL','EK','EK2','IC','BC','RX','OM','MO','PC','CE','RH','CH') THEN '化学'
WHEN upper(split_part(id, ':', 1)) = 'WD' THEN '跨学科' ELSE '数学' END"""
RANK_SQL = "CASE level WHEN 'unverified' THEN 0 WHEN 'model_inferred' THEN 1 WHEN 'source_asserted' THEN 2 WHEN 'by_construction' THEN 3 WHEN 'rule_checked' THEN 4 WHEN 'cross_source' THEN 5 WHEN 'human_reviewed' THEN 6 ELSE -1 END"
NAMED_SQL = f"WITH named AS (SELECT id, {TYPE_SQL} AS main, {SUBJECT_SQL} AS subject, domain FROM (SELECT *, lower(trim(coalesce(domain, ''))) AS d FROM n))"


def named(n: DataFrame) -> DataFrame:
    return n.select("id", expr.pick_type(F.col("labels")).alias("main"), expr.subject_of(F.col("domain"), F.col("id")).alias("subject"), "domain")


# projections


@query("pj1_main_type", f"SELECT id, {TYPE_SQL} AS main FROM n", ALL)
def _(g: Tables) -> DataFrame:
    return named(g.n).select("id", "main")


@query("pj2_subject", f"{NAMED_SQL} SELECT id, subject FROM named", ALL)
def _(g: Tables) -> DataFrame:
    return named(g.n).select("id", "subject")


@query("pj3_slice_domain", "SELECT id, CASE split_part(trim(domain), '.', 1) WHEN 'physics' THEN 'physics' WHEN 'phys' THEN 'physics' WHEN 'chem' THEN 'chemistry' WHEN 'chemistry' THEN 'chemistry' WHEN 'math' THEN 'math' WHEN 'biology' THEN 'biology' WHEN 'cross' THEN 'cross' ELSE 'unclassified' END AS slice FROM n", DOMAINS)
def _(g: Tables) -> DataFrame:
    return g.n.select("id", expr.slice_domain(F.col("domain")).alias("slice"))


@query("pj4_node_view", f"{NAMED_SQL} SELECT named.id, coalesce(nullif(n.name, ''), named.id) AS label, main, subject, coalesce(named.domain, '') AS domain FROM named JOIN n ON n.id = named.id", ("CU", "PA", *DOCUMENTS))
def _(g: Tables) -> DataFrame:
    return g.n.select("id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("label"), expr.pick_type(F.col("labels")).alias("main"), expr.subject_of(F.col("domain"), F.col("id")).alias("subject"), F.coalesce("domain", F.lit("")).alias("domain"))


@query("pj5_edge_view", f"SELECT pos, source, target, type, kind, CASE WHEN kind IN ('explicit_citation','defines','reactant_of','product_of','part_of','cites') THEN 'explicit' ELSE 'inferred' END AS explicit_or_inferred, {RANK_SQL} >= 3 AS verified, {RANK_SQL} >= 4 AS strict FROM e", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return g.e.select("pos", "source", "target", "type", "kind", expr.explicit_or_inferred(F.lit(None).cast("string"), F.col("kind")).alias("explicit_or_inferred"), expr.verified(F.col("level")).alias("verified"), expr.strict(F.col("level")).alias("strict"))


@query("pj6_level_rank", f"SELECT level, {RANK_SQL} AS rank, count(*) AS n FROM e GROUP BY ALL", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return g.e.groupBy("level", expr.level_rank(F.col("level")).alias("rank")).agg(F.count("*").alias("n"))


@query(
    "pj7_unique_edge_ids",
    """WITH f AS (SELECT *, type || '|' || source || '|' || target AS plain, row_number() OVER (PARTITION BY type, source, target ORDER BY pos, kind) > 1 AS later FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY plain, later, kind ORDER BY pos) AS k FROM f)
    SELECT CASE WHEN NOT later THEN plain WHEN k = 1 THEN plain || '|' || kind ELSE plain || '|' || kind || '#' || k END AS id, pos, later AS renamed FROM k""",
    (), ("contains",),
)
def _(g: Tables) -> DataFrame:
    return R.unique_edge_ids(g.e).select("id", "pos", "renamed")


@query("pj8_records_with_source", "SELECT d.doc_id, d.source, s.n AS source_docs FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) s ON s.source = d.source")
def _(g: Tables) -> DataFrame:
    d = g.table("documents").select("doc_id", "source")
    return d.join(R.counts(d, "source").withColumnRenamed("n", "source_docs"), "source").select("doc_id", "source", "source_docs")


@query("pj9_node_card", f"SELECT n.id, substr(name, 1, 20) AS title, {TYPE_SQL} AS kind, length(name) > 20 AS cut FROM n", ("PA", *DOCUMENTS))
def _(g: Tables) -> DataFrame:
    return g.n.select("id", F.substring("name", 1, 20).alias("title"), expr.pick_type(F.col("labels")).alias("kind"), (F.char_length("name") > 20).alias("cut"))


@query("pj10_entity_last", "SELECT id, array_to_string(list_append(list_filter(labels, lambda x: x <> 'Entity'), 'Entity'), ',') AS labels FROM n", ("CU", "SU", "PA"))
def _(g: Tables) -> DataFrame:
    return g.n.select("id", F.array_join(F.concat(F.array_remove("labels", "Entity"), F.array(F.lit("Entity"))), ",").alias("labels"))


@query("pj11_name_of_id", "SELECT id, split_part(id, ':', 2) AS local, split_part(name, ' ', 1) AS first_word FROM n", ("PA", "CU"))
def _(g: Tables) -> DataFrame:
    return g.n.select("id", F.split_part("id", F.lit(":"), F.lit(2)).alias("local"), F.split_part("name", F.lit(" "), F.lit(1)).alias("first_word"))


@query("pj12_era", """SELECT y AS time, CASE WHEN y < 1900 THEN CAST(ceil(y / 100.0) AS INT) || ' 世纪' ELSE (y // 10 * 10) || '–' || (y // 10 * 10 + 9) END AS era, CASE WHEN y < 1900 THEN (CAST(ceil(y / 100.0) AS INT) - 1) * 100 + 1 ELSE y // 10 * 10 END AS era_key, n
    FROM (SELECT CAST(1000 + p_size * 20 AS INT) AS y, count(*) AS n FROM part GROUP BY 1)""")  # fmt: skip
def _(g: Tables) -> DataFrame:
    years = g.table("part").groupBy((1000 + F.col("p_size") * 20).cast("int").alias("time")).agg(F.count("*").alias("n"))
    return years.withColumn("era", expr.era(F.col("time").cast("string"))).select("time", "era", expr.era_key(F.col("era")).alias("era_key"), "n")


@query("pj14_canonical_digest", "SELECT id, substr(sha256(concat_ws('|', id, coalesce(domain, ''), source, array_to_string(list_sort(labels), ','))), 1, 16) AS digest FROM n", ("PA", "CU", *DOCUMENTS))
def _(g: Tables) -> DataFrame:
    return g.n.select("id", expr.digest(F.concat_ws("|", "id", F.coalesce("domain", F.lit("")), "source", F.array_join(F.array_sort("labels"), ","))).alias("digest"))


# filters


for _tier, _least in (("all", -1), ("verified", 3), ("verified_strict", 4), ("unheard_of", 4)):

    @query(f"fl1_trust_{_tier}", f"SELECT pos, level FROM e WHERE {RANK_SQL} >= {_least}", (), ("contains",))
    def _(g: Tables, tier: str = _tier) -> DataFrame:
        return R.trusted(g.e, tier).select("pos", "level")


@query("fl2_min_confidence", "SELECT pos, round(confidence, 4) AS confidence FROM e WHERE confidence >= 0.95", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.confident(g.e, 0.95).select("pos", F.round("confidence", 4).alias("confidence"))


@query("fl3_without_model", "SELECT level, count(*) AS n FROM e WHERE level IS DISTINCT FROM 'model_inferred' GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.counts(R.without_model(g.e), "level")


@query("fl5_types_kinds", "SELECT type, kind, count(*) AS n FROM e WHERE type IN ('contains', 'in_nation') AND kind IN ('R', 'cust') GROUP BY ALL", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return R.of_types(g.e, ["contains", "in_nation"], ["R", "cust"]).groupBy("type", "kind").agg(F.count("*").alias("n"))


@query("fl5_endpoint_subjects", f"{NAMED_SQL} SELECT e.pos FROM e JOIN named s ON s.id = e.source JOIN named t ON t.id = e.target WHERE s.subject = '跨学科' AND t.subject = '化学' AND t.domain = 'chem.promo'", ("OR", "PA"), ("contains",))
def _(g: Tables) -> DataFrame:
    ends = R.with_ends(g.e, named(g.n), subject="subject", domain="domain")
    return ends.where("s_subject = '跨学科' AND t_subject = '化学' AND t_domain = 'chem.promo'").select("pos")


@query("fl8_hidden_by_trust", f"SELECT kind, count(DISTINCT pos) FILTER (WHERE {RANK_SQL} < 3) AS hidden, count(DISTINCT pos) FILTER (WHERE {RANK_SQL} >= 3) AS visible, count(DISTINCT pos) AS total FROM e GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    rank = expr.level_rank(F.col("level"))
    per = g.e.groupBy("kind", "pos").agg(F.bool_or(rank < 3).alias("low"), F.bool_or(rank >= 3).alias("high"))
    return per.groupBy("kind").agg(F.count_if("low").alias("hidden"), F.count_if("high").alias("visible"), F.count("*").alias("total"))


@query("fl9_tiers_conserve", f"SELECT 'verified' AS tier, count(*) FILTER (WHERE {RANK_SQL} >= 3) AS visible, count(*) FILTER (WHERE {RANK_SQL} < 3) AS hidden, count(*) AS total FROM e UNION ALL SELECT 'verified_strict', count(*) FILTER (WHERE {RANK_SQL} >= 4), count(*) FILTER (WHERE {RANK_SQL} < 4), count(*) FROM e", (), ("contains",))
def _(g: Tables) -> DataFrame:
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(k).alias("least")) for t, k in (("verified", 3), ("verified_strict", 4))]))
    rank = expr.level_rank(F.col("level"))
    per = g.e.groupBy(rank.alias("rank")).agg(F.count("*").alias("n"))
    return per.select("rank", "n", tiers.alias("t")).groupBy("t.tier").agg(F.sum(F.when(F.col("rank") >= F.col("t.least"), F.col("n")).otherwise(0)).alias("visible"), F.sum(F.when(F.col("rank") < F.col("t.least"), F.col("n")).otherwise(0)).alias("hidden"), F.sum("n").alias("total"))


@query("fl10_forbidden_patterns", "SELECT count(*) AS n FROM e WHERE (type = 'contains' AND kind = 'R' AND level = 'unverified') OR (type = 'in_nation' AND kind = 'supp')", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    rules = [{"type": "contains", "kind": "R", "level": "unverified"}, {"type": "in_nation", "kind": "supp"}]
    return g.e.where(R.matches(rules)).agg(F.count("*").alias("n"))


@query("fl11_forbidden_props", "SELECT count(*) FILTER (WHERE json_extract(props, '$.k') IS NOT NULL) AS with_k, count(*) FILTER (WHERE json_extract(props, '$.secret') IS NOT NULL) AS with_secret FROM events")
def _(g: Tables) -> DataFrame:
    p = F.try_parse_json("props")
    return g.table("events").agg(F.count_if(F.try_variant_get(p, "$.k", "string").isNotNull()).alias("with_k"), F.count_if(F.try_variant_get(p, "$.secret", "string").isNotNull()).alias("with_secret"))


@query("fl12_absent", "SELECT count(*) FILTER (WHERE type = 'contains' AND kind = 'X') = 0 AS absent FROM e", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return g.e.agg((F.count_if((F.col("type") == "contains") & (F.col("kind") == "X")) == 0).alias("absent"))


@query("fl13_model_made", "SELECT kind, count(*) AS n FROM e WHERE kind IN ('R') OR contains(kind, 'GNN') OR contains(kind, 'LLM') GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.counts(g.e.where(R.model_made(g.e, ["R"])), "kind")


@query("fl14_placeholders", "SELECT count(*) FILTER (WHERE regexp_matches(concat('mol_', p_partkey), '(?i)^(FG|reaction|molecule|mol|rxn|rx)[_-]?[0-9]+$')) AS placeholders, count(*) FILTER (WHERE regexp_matches(p_name, '(?i)^(FG|reaction|molecule|mol|rxn|rx)[_-]?[0-9]+$')) AS real_names FROM part")
def _(g: Tables) -> DataFrame:
    p = g.table("part")
    return p.agg(F.count_if(R.placeholder(F.concat(F.lit("mol_"), "p_partkey"))).alias("placeholders"), F.count_if(R.placeholder(F.col("p_name"))).alias("real_names"))


@query("fl16_blank_is_none", "SELECT count(*) AS n, count(CASE WHEN v NOT IN ('', '-') THEN v END) AS with_data FROM (SELECT CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN '-' ELSE p_name END AS r, trim(CASE WHEN p_size % 3 = 0 THEN ' ' WHEN p_size % 3 = 1 THEN '-' ELSE p_name END) AS v FROM part)")
def _(g: Tables) -> DataFrame:
    v = F.when(F.col("p_size") % 3 == 0, " ").when(F.col("p_size") % 3 == 1, "-").otherwise(F.col("p_name"))
    return g.table("part").agg(F.count("*").alias("n"), F.count(expr.blank_as_null(v)).alias("with_data"))


# joins


@query("jn1_edges_with_ends", "SELECT e.pos, s.domain AS s_domain, t.name AS t_name FROM e JOIN n s ON s.id = e.source JOIN n t ON t.id = e.target", ("OR", "PA"), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.with_ends(g.e.select("pos", "source", "target"), g.n, domain="domain", name="name").select("pos", "s_domain", "t_name")


CUT = "id NOT IN (SELECT concat('PA:', p_partkey) FROM part WHERE p_partkey % 97 = 0)"


def cut_nodes(g: Tables) -> DataFrame:
    gone = g.table("part").where("p_partkey % 97 = 0").select(F.concat(F.lit("PA:"), "p_partkey").alias("id"))
    return g.n.join(gone, "id", "left_anti")


@query("jn2_dangling", f"SELECT DISTINCT e.pos, e.target FROM e WHERE e.source NOT IN (SELECT id FROM n WHERE {CUT}) OR e.target NOT IN (SELECT id FROM n WHERE {CUT})", ("OR", "PA"), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.dangling(g.e.select("pos", "source", "target"), cut_nodes(g)).select("pos", "target").distinct()


@query("jn3_induced", f"SELECT kind, count(*) AS n FROM e WHERE e.source IN (SELECT id FROM n WHERE {CUT}) AND e.target IN (SELECT id FROM n WHERE {CUT}) GROUP BY 1", ("OR", "PA"), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.counts(R.between(g.e, cut_nodes(g)), "kind")


@query("jn4_incident", "SELECT type, source, target FROM e WHERE source = 'NA:7' UNION ALL SELECT type, source, target FROM e WHERE target = 'NA:7' AND source <> 'NA:7'", (), GEO)
def _(g: Tables) -> DataFrame:
    return R.incident(g.e, "NA:7").select("type", "source", "target")


@query("jn5_neighbour_page", "SELECT e.source AS id, n.name FROM e JOIN n ON n.id = e.source WHERE e.target = 'NA:7' ORDER BY 1 LIMIT 10 OFFSET 5", ("CU", "SU"), ("cust_nation", "supp_nation"))
def _(g: Tables) -> DataFrame:
    near = g.e.where("target = 'NA:7'").select(F.col("source").alias("id"))
    return near.join(g.n.select("id", "name"), "id").orderBy("id").offset(5).limit(10)


@query("jn6_licence", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE coalesce(try_cast(replace(p.p_brand, 'Brand#', '') AS INT) % 2 = 0 AND replace(p.p_brand, 'Brand#', '')::INT <= 23, false) AND o.o_orderstatus IN ('O', 'F')) AS public FROM e JOIN part p ON p.p_partkey = e.part JOIN orders o ON o.o_orderkey = e.okey GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    allowed = g.spark.range(1, 24).select(F.concat(F.lit("Brand#"), "id").alias("source"), (F.col("id") % 2 == 0).alias("allowed")).unionAll(g.spark.sql("SELECT explode(array('srcO', 'srcF')) AS source, true AS allowed"))
    ends = R.with_ends(g.e.select("source", "target", "kind"), g.nodes("PA", "OR"), source="source")
    return R.redistributable(ends, allowed, "t_source", "s_source").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("public").alias("public"))


@query("jn7_compare_sets", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'differs' END AS state
    FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_partkey % 3 <> 0) b ON a.k = b.k) GROUP BY 1""")  # fmt: skip
def _(g: Tables) -> DataFrame:
    p = g.table("part")
    a = p.where("p_partkey % 5 <> 0").select("p_partkey", F.col("p_size").alias("v"))
    b = p.where("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("v"))
    return R.counts(R.compared(a, b, ["p_partkey"], "v"), "state")


@query("jn8_reconcile", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN r.key IS NULL THEN 'missing' WHEN l.key IS NULL THEN 'extra' WHEN l.kinds = r.kinds THEN 'same' ELSE 'kinds_differ' END AS state FROM
    (SELECT source || '|' || target AS key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e WHERE part % 11 <> 0 GROUP BY 1) l FULL JOIN (SELECT source || '|' || target AS key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM e WHERE okey % 13 <> 0 AND line < 6 GROUP BY 1) r ON l.key = r.key) GROUP BY 1""", (), ("contains",))  # fmt: skip
def _(g: Tables) -> DataFrame:
    kinds = lambda df: df.groupBy(F.concat_ws("|", "source", "target").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    state = R.compared(kinds(g.e.where("part % 11 <> 0")), kinds(g.e.where("okey % 13 <> 0 AND line < 6")), ["key"], "kinds")
    names = F.replace(F.replace(F.replace("state", F.lit("left_only"), F.lit("missing")), F.lit("right_only"), F.lit("extra")), F.lit("differs"), F.lit("kinds_differ"))
    return R.counts(state.withColumn("state", names), "state")


@query("jn9_trigram_search", "SELECT id, name FROM n WHERE contains(lower(name), 'red w')", ("PA",))
def _(g: Tables) -> DataFrame:
    return S.by_trigrams(g.n, S.postings(g.n), "red w").select("id", "name")


@query("jn9_documents", "SELECT id FROM n WHERE contains(lower(name), 'tion')", DOCUMENTS)
def _(g: Tables) -> DataFrame:
    return S.by_trigrams(g.n, S.postings(g.n), "tion").select("id")


@query("jn10_dictionary", "SELECT DISTINCT 'PA:' || p_partkey AS id FROM part WHERE contains('which widget or ring is it', split_part(p_name, ' ', 2))")
def _(g: Tables) -> DataFrame:
    words = g.table("part").select(F.concat(F.lit("PA:"), "p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("alias"))
    return words.where(F.lit("which widget or ring is it").contains(F.col("alias"))).select("id").distinct()


@query("jn11_unregistered_sources", "SELECT source, count(*) AS n FROM n WHERE source NOT IN (SELECT 'Brand#' || b FROM (SELECT unnest(range(1, 24)) AS b)) GROUP BY 1", ("PA",))
def _(g: Tables) -> DataFrame:
    known = g.spark.range(1, 24).select(F.concat(F.lit("Brand#"), "id").alias("source"))
    return R.counts(g.n.join(known, "source", "left_anti"), "source")


@query("jn12_slices_have_parents", "SELECT p_brand AS slice FROM part GROUP BY 1 HAVING p_brand NOT IN (SELECT p_brand FROM part WHERE p_size <= 45)")
def _(g: Tables) -> DataFrame:
    p = g.table("part")
    return p.select(F.col("p_brand").alias("slice")).distinct().join(p.where("p_size <= 45").select(F.col("p_brand").alias("slice")), "slice", "left_anti")


@query("jn13_key_overlap", "SELECT count(*) AS n FROM (SELECT DISTINCT lower(trim(c_name)) AS k FROM customer INTERSECT SELECT DISTINCT lower(replace(s_name, 'Supplier', 'Customer')) FROM supplier)")
def _(g: Tables) -> DataFrame:
    a = g.table("customer").select(F.lower(F.trim("c_name")).alias("k"))
    b = g.table("supplier").select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("k"))
    return a.intersect(b).agg(F.count("*").alias("n"))


@query("jn14_cross_subject", f"{NAMED_SQL} SELECT s.subject AS s_subject, t.subject AS t_subject, count(*) AS n FROM e JOIN named s ON s.id = e.source JOIN named t ON t.id = e.target WHERE s.subject <> t.subject GROUP BY ALL", ("OR", "PA", "CU"), ("contains", "placed_by"))
def _(g: Tables) -> DataFrame:
    ends = R.with_ends(g.e.select("source", "target"), named(g.n), subject="subject")
    return ends.where("s_subject <> t_subject").groupBy("s_subject", "t_subject").agg(F.count("*").alias("n"))


# aggregates


@query("ag1_counts", "SELECT type, kind, count(*) AS n FROM e GROUP BY ALL", (), ("contains", "supplied_by", "placed_by", *GEO, "did"))
def _(g: Tables) -> DataFrame:
    return R.counts(g.e, "type", "kind")


@query("ag2_global_stats", f"SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'types', count(DISTINCT type) FROM e UNION ALL SELECT 'verified', count(*) FROM e WHERE {RANK_SQL} >= 3", ALL, ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    e = g.e.agg(F.count("*").alias("edges"), F.count_distinct("type").alias("types"), F.count_if(expr.verified(F.col("level"))).alias("verified"))
    rows = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in e.columns])).alias("r")).select("r.*")
    return rows.unionAll(g.n.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")))


@query("ag3_degree", "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.degrees(g.e)


@query("ag4_pairs", "SELECT least(s.n_name, t.n_name) AS a, greatest(s.n_name, t.n_name) AS b, count(*) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation s ON s.n_nationkey = c.c_nationkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier p ON p.s_suppkey = l.l_suppkey JOIN nation t ON t.n_nationkey = p.s_nationkey GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    nation = g.table("nation")
    side = lambda df, key, name: df.join(nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)), key)
    c = side(g.table("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "s").select("c_custkey", "s")
    p = side(g.table("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "t").select("s_suppkey", "t")
    lines = g.table("lineitem").select("l_orderkey", "l_suppkey").join(g.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    return R.unordered_pairs(lines.join(c, "c_custkey").join(p.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey"), "s", "t")


@query("ag5_ratio", f"SELECT kind, count(*) FILTER (WHERE {RANK_SQL} >= 3) AS part, count(*) AS whole, round_even(100.0 * count(*) FILTER (WHERE {RANK_SQL} >= 3) / nullif(count(*), 0), 3)::DOUBLE AS pct FROM e GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    per = g.e.groupBy("kind").agg(F.count_if(expr.verified(F.col("level"))).alias("part"), F.count("*").alias("whole"))
    return per.withColumn("pct", expr.percent(F.col("part"), F.col("whole")).cast("double"))


@query("ag6_namespaces", f"{NAMED_SQL} SELECT *, count(*) OVER (PARTITION BY ns) > 1 AS mixed FROM (SELECT split_part(id, ':', 1) AS ns, subject, count(*) AS n FROM named GROUP BY ALL)", ALL)
def _(g: Tables) -> DataFrame:
    per = named(g.n).groupBy(expr.namespace(F.col("id")).alias("ns"), "subject").agg(F.count("*").alias("n"))
    return per.join(per.groupBy("ns").agg((F.count("*") > 1).alias("mixed")), "ns").select("ns", "subject", "n", "mixed")


@query("ag13_slices", """WITH named AS (SELECT id, CASE split_part(trim(domain), '.', 1) WHEN 'chem' THEN 'chemistry' ELSE 'unclassified' END AS slice FROM n),
    per AS (SELECT slice, count(*) AS nodes FROM named GROUP BY 1), f AS (SELECT s.slice, count(*) AS edges, count(*) FILTER (WHERE s.slice = t.slice) AS internal, count(*) FILTER (WHERE s.slice <> t.slice) AS crossing FROM e JOIN named s ON s.id = e.source JOIN named t ON t.id = e.target GROUP BY 1)
    SELECT per.slice, nodes, coalesce(edges, 0) AS edges, coalesce(internal, 0) AS internal, coalesce(crossing, 0) AS crossing FROM per LEFT JOIN f ON f.slice = per.slice""", ("OR", "PA"), ("contains",))  # fmt: skip
def _(g: Tables) -> DataFrame:
    from ..operators.versions import slices

    return slices(g.n, g.e)


@query("ag14_slices_conserve", "SELECT count(*) AS whole, sum(n)::BIGINT AS parts, count(*) = sum(n) AS holds FROM (SELECT 1 AS n FROM n)", ("OR", "PA", *DOCUMENTS))
def _(g: Tables) -> DataFrame:
    per = g.n.groupBy(expr.slice_domain(F.col("domain")).alias("slice")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("parts")).crossJoin(F.broadcast(g.n.agg(F.count("*").alias("whole")))).select("whole", "parts", (F.col("whole") == F.col("parts")).alias("holds"))


@query("ag15_thresholds", "SELECT k AS least, count(*) AS n FROM part, (SELECT unnest(range(1, 6))::INT AS k) WHERE p_size % 5 + 1 >= k GROUP BY 1")
def _(g: Tables) -> DataFrame:
    from ..operators.versions import thresholds

    return thresholds(g.table("part").select((F.col("p_size") % 5 + 1).alias("grade")), "grade")


@query("ag16_task_families", f"SELECT coalesce(type, 'total') AS family, count(*) AS edges, count(*) FILTER (WHERE {RANK_SQL} >= 3) AS passing, round_even(100.0 * count(*) FILTER (WHERE {RANK_SQL} >= 3) / count(*), 3)::DOUBLE AS rate FROM e GROUP BY ROLLUP (type)", (), ("contains", "placed_by", *GEO))
def _(g: Tables) -> DataFrame:
    per = g.e.rollup("type").agg(F.count("*").alias("edges"), F.count_if(expr.verified(F.col("level"))).alias("passing"))
    return per.select(F.coalesce("type", F.lit("total")).alias("family"), "edges", "passing", expr.percent(F.col("passing"), F.col("edges")).cast("double").alias("rate"))


@query("ag17_sensitivity", f"SELECT k AS least, count(*) FILTER (WHERE {RANK_SQL} >= k) AS passing FROM e, (SELECT unnest(range(0, 7))::INT AS k) GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    one = g.e.groupBy(expr.level_rank(F.col("level")).alias("rank")).agg(F.count("*").alias("n"))
    return one.withColumn("least", F.explode(F.sequence(F.lit(0), F.lit(6)))).groupBy("least").agg(F.sum(F.when(F.col("rank") >= F.col("least"), F.col("n")).otherwise(0)).alias("passing"))


@query("ag18_pair_level_matrix", f"SELECT source_ns, kind, sum(CASE WHEN r >= 4 THEN 1 ELSE 0 END)::BIGINT AS strict, count(*) AS n FROM (SELECT split_part(source, ':', 1) || '-' || split_part(target, ':', 1) AS source_ns, kind, {RANK_SQL} AS r FROM e) GROUP BY CUBE (source_ns, kind)", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    rows = g.e.select(F.concat_ws("-", expr.namespace(F.col("source")), expr.namespace(F.col("target"))).alias("source_ns"), "kind", expr.strict(F.col("level")).alias("s"))
    return rows.cube("source_ns", "kind").agg(F.count_if("s").alias("strict"), F.count("*").alias("n"))


@query("ag19_coverage", "SELECT CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 500 THEN 'middle' ELSE 'short' END AS state, count(*) AS n FROM documents GROUP BY 1")
def _(g: Tables) -> DataFrame:
    state = F.when(F.col("n_chars") >= 2000, "long").when(F.col("n_chars") >= 500, "middle").otherwise("short")
    return R.counts(g.table("documents").select(state.alias("state")), "state")


@query("ag20_distinct_family", "SELECT count(*) AS n, count(DISTINCT k) AS keys, count(DISTINCT k) FILTER (WHERE valid) AS valid_keys FROM (SELECT '10.' || (1000 + p_size) || '/' || lower(p_brand) AS k, p_size > 10 AS valid FROM part)")
def _(g: Tables) -> DataFrame:
    raw = F.concat(F.when(F.col("p_size") > 10, "https://doi.org/10.").otherwise("doi:10x."), (1000 + F.col("p_size")).cast("string"), F.lit("/"), "p_brand")
    rows = g.table("part").select(F.replace(expr.doi(raw), F.lit("10x."), F.lit("10.")).alias("k"), expr.doi_valid(raw).alias("valid"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"), F.count_distinct(F.when(F.col("valid"), F.col("k"))).alias("valid_keys"))


@query("ag22_length_pile_up", "SELECT length(p_name) AS len, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2 AND length(p_name) = (SELECT max(length(p_name)) FROM part)")
def _(g: Tables) -> DataFrame:
    per = g.table("part").groupBy(F.char_length("p_name").alias("len")).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(per.agg(F.max("len").alias("len"))), "len").where("n >= 2").select("len", "n")


# rankings


@query("wn1_top_by_degree", """WITH d AS (SELECT target AS id, count(*) AS degree FROM e GROUP BY 1), r AS (SELECT n.domain, d.id, d.degree, row_number() OVER (PARTITION BY n.domain ORDER BY degree DESC, d.id) AS rank FROM d JOIN n ON n.id = d.id)
    SELECT * FROM r WHERE rank <= 3""", ("PA",), ("contains",))  # fmt: skip
def _(g: Tables) -> DataFrame:
    d = g.e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("degree")).join(g.n.select("id", "domain"), "id")
    return R.top_per_group(d, ["domain"], [F.desc("degree"), F.col("id")], 3).select("domain", "id", "degree", "rank")


@query("wn2_round_robin", "SELECT kind, pos, turn FROM (SELECT kind, pos, row_number() OVER (PARTITION BY kind ORDER BY pos, target) AS turn FROM e) ORDER BY turn, kind LIMIT 20", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.round_robin(g.e.select("kind", "pos", "target"), "kind", [F.col("pos"), F.col("target")], 20).select("kind", "pos", "turn")


@query("wn3_per_node_cap", f"SELECT source, target, r FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN {RANK_SQL} >= 4 THEN 0 ELSE 1 END, pos, target) AS r FROM e) WHERE r <= 2", (), ("contains",))
def _(g: Tables) -> DataFrame:
    rows = g.e.select("source", "target", "pos", expr.strict(F.col("level")).alias("s"))
    return R.top_per_group(rows, ["source"], [F.when(F.col("s"), 0).otherwise(1), F.col("pos"), F.col("target")], 2, "r").select("source", "target", "r")


@query("wn4_edge_priority", "SELECT type, CASE WHEN type = 'in_region' THEN 0 ELSE 3 END AS priority, count(*) AS n FROM e GROUP BY ALL", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return g.e.groupBy("type", expr.edge_priority(F.col("type"), F.col("type") == "in_region").alias("priority")).agg(F.count("*").alias("n"))


@query("wn5_max_degree", "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return R.degrees(g.e).orderBy(F.desc("degree"), "id").limit(1)


@query("wn6_most_common", "SELECT kind, level, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, level) AS r FROM (SELECT kind, level, count(*) AS n FROM e GROUP BY ALL)) WHERE r <= 1", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return R.top_per_group(R.counts(g.e, "kind", "level"), ["kind"], [F.desc("n"), F.col("level")], 1).drop("rank")


@query("wn7_sorted_registry", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
def _(g: Tables) -> DataFrame:
    return R.counts(g.table("part"), "p_brand").orderBy(F.desc("n"), "p_brand")


@query("wn8_page", "SELECT id, (SELECT count(*) FROM n) AS total, CASE WHEN (SELECT count(*) FROM n) > 30 THEN 30 END AS next_offset FROM (SELECT id FROM n ORDER BY id LIMIT 10 OFFSET 20)", ("PA",))
def _(g: Tables) -> DataFrame:
    return R.page(g.n.select("id"), [F.col("id")], 20, 10)


@query("wn9_budget", "SELECT pos, target, (SELECT count(*) FROM e) AS before, (SELECT count(*) FROM e) > 15 AS truncated FROM (SELECT pos, target FROM e ORDER BY pos, target LIMIT 15)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.budgeted(g.e.select("pos", "target"), [F.col("pos"), F.col("target")], 15)


@query("wn10_order_of_marks", "SELECT event_type, count(*) FILTER (WHERE value < before) AS falls, count(*) AS n FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def _(g: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return g.table("events").withColumn("before", before).groupBy("event_type").agg(F.count_if(F.col("value") < F.col("before")).alias("falls"), F.count("*").alias("n"))


LEDGER_SQL = "SELECT row_number() OVER (ORDER BY p_brand) AS seq, p_brand AS name, count(*) AS n FROM part GROUP BY p_brand"


def ledger(g: Tables) -> DataFrame:
    return R.stepped(g.table("part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")), [F.col("name")])


@query("wn11_stable_counts", f"SELECT seq, n = lag(n) OVER (ORDER BY seq) AS stable FROM ({LEDGER_SQL})")
def _(g: Tables) -> DataFrame:
    from pyspark.sql import Window

    return ledger(g).select("seq", (F.col("n") == F.lag("n").over(Window.orderBy("seq"))).alias("stable"))


@query("wn12_next_sequence", f"SELECT coalesce(max(seq), 0) + 1 AS next FROM ({LEDGER_SQL})")
def _(g: Tables) -> DataFrame:
    return ledger(g).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("bigint").alias("next"))


@query("wn13_previous_version", f"SELECT seq, name, lag(name) OVER (ORDER BY seq) AS before FROM ({LEDGER_SQL})")
def _(g: Tables) -> DataFrame:
    from pyspark.sql import Window

    return ledger(g).select("seq", "name", F.lag("name").over(Window.orderBy("seq")).alias("before"))


# sets


@query("st1_union_first", "SELECT k, source FROM (SELECT p_partkey AS k, 'a' AS source FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, 'b' FROM part WHERE p_size >= 30 OR p_partkey % 2 = 0 AND p_size >= 30)")
def _(g: Tables) -> DataFrame:
    p = g.table("part")
    frames = [p.where("p_size < 30").select(F.col("p_partkey").alias("k"), F.lit("a").alias("source")), p.select(F.col("p_partkey").alias("k"), F.lit("b").alias("source"))]
    return R.union_first(frames, ["k"])


@query("st2_equal_sets", "SELECT id, 'left' AS side FROM (SELECT DISTINCT target AS id FROM e EXCEPT SELECT id FROM n) UNION ALL SELECT id, 'right' FROM (SELECT id FROM n EXCEPT SELECT target FROM e)", ("PA",), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.only_in_one(g.e.select(F.col("target").alias("id")), g.n.select("id"))


@query("st4_island_nodes", "SELECT id, 'left' AS side FROM (SELECT source AS id FROM e UNION SELECT target FROM e EXCEPT SELECT concat('OR:', o_orderkey) FROM orders)", (), ("contains",))
def _(g: Tables) -> DataFrame:
    ids = g.e.select(F.explode(F.array("source", "target")).alias("id"))
    return R.only_in_one(ids, g.table("orders").select(F.concat(F.lit("OR:"), "o_orderkey").alias("id"))).where("side = 'left'")


@query("st5_merge_results", "SELECT count(*) FILTER (WHERE NOT in_old) AS added, count(*) FILTER (WHERE in_old) AS dup FROM (SELECT DISTINCT id, id IN (SELECT id FROM n WHERE value < 1000) AS in_old FROM n WHERE value >= 950)", ("PA",))
def _(g: Tables) -> DataFrame:
    old, new = g.n.where("value < 1000").select("id", F.lit(True).alias("in_old")), g.n.where("value >= 950").select("id").distinct()
    return new.join(old, "id", "left").agg(F.count_if(F.col("in_old").isNull()).alias("added"), F.count_if("in_old").alias("dup"))


@query("st6_duplicates", "SELECT source, target, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.repeated(g.e, "source", "target")


@query("st7_expected_set", "SELECT name AS id, 'left' AS side FROM n WHERE name NOT IN ('AFRICA', 'AMERICA', 'ASIA')", ("RG",))
def _(g: Tables) -> DataFrame:
    wanted = g.spark.sql("SELECT explode(array('AFRICA', 'AMERICA', 'ASIA')) AS id")
    return R.only_in_one(g.n.select(F.col("name").alias("id")), wanted).where("side = 'left'")


# traversal

STEP_SQL = "WITH st AS (SELECT source AS id, target AS other FROM e UNION SELECT target, source FROM e)"
SEED_SQL = "(SELECT min(target) FROM e)"


def first_part(g: Tables) -> DataFrame:
    return g.e.agg(F.min("target").alias("id"))


@query("gr1_neighbours", "SELECT target AS other, 'out' AS direction, type FROM e WHERE source = 'NA:3' UNION ALL SELECT source, 'in', type FROM e WHERE target = 'NA:3'", (), GEO)
def _(g: Tables) -> DataFrame:
    return T.neighbours(g.e, "NA:3")


for _hops in (1, 2, 3):

    @query(f"gr2_ego_{_hops}", f"{STEP_SQL}, w AS (SELECT {SEED_SQL} AS id, 0 AS hop UNION SELECT st.other, w.hop + 1 FROM w JOIN st ON st.id = w.id WHERE w.hop < {_hops}) SELECT id, min(hop) AS hop FROM w GROUP BY 1", (), ("contains",))
    def _(g: Tables, hops: int = _hops) -> DataFrame:
        return T.ego(g.e, first_part(g), hops)


@query(
    "gr3_paths",
    f"""{STEP_SQL}, ends AS (SELECT min(source) AS a, max(source) AS b FROM e WHERE target = (SELECT target FROM e GROUP BY 1 HAVING count(DISTINCT source) > 1 ORDER BY count(DISTINCT source) DESC, 1 LIMIT 1)),
    w AS (SELECT a AS id, [a] AS chain FROM ends UNION ALL SELECT st.other, list_append(w.chain, st.other) FROM w JOIN st ON st.id = w.id WHERE len(w.chain) <= 4 AND NOT list_contains(w.chain, st.other) AND w.id <> (SELECT b FROM ends))
    SELECT array_to_string(chain, '>') AS path, CAST(len(chain) - 1 AS INT) AS length FROM w WHERE id = (SELECT b FROM ends) AND len(chain) > 1 ORDER BY 2, 1 LIMIT 5""",
    (), ("contains",),
)
def _(g: Tables) -> DataFrame:
    hub = g.e.groupBy("target").agg(F.count_distinct("source").alias("n")).where("n > 1").orderBy(F.desc("n"), "target").limit(1)
    ends = g.e.join(hub.select("target"), "target").agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    return T.paths(g.e, ends.a or "", ends.b or "", 4, 5)


@query("gr5_filter_mode", "SELECT id FROM (SELECT source AS id FROM e WHERE kind = 'R' UNION SELECT target FROM e WHERE kind = 'R')", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return R.of_types(g.e, kinds=["R"]).select(F.explode(F.array("source", "target")).alias("id")).distinct()


@query("gr6_first_hit_seed", "SELECT count(*) AS n FROM e WHERE target = (SELECT id FROM n WHERE contains(lower(name), 'red') ORDER BY id LIMIT 1)", ("PA",), ("contains",))
def _(g: Tables) -> DataFrame:
    seed = g.n.where(F.lower("name").contains("red")).orderBy("id").limit(1).select(F.col("id").alias("target"))
    return g.e.join(F.broadcast(seed), "target").agg(F.count("*").alias("n"))


COMPONENT_SQL = (
    f"{STEP_SQL}, c(id, component) USING KEY (id) AS (SELECT id, min(least(id, other)) FROM st GROUP BY id UNION "
    "(SELECT st.id, min(c.component) FROM c JOIN st ON c.id = st.other JOIN recurring.c r ON r.id = st.id WHERE c.component < r.component GROUP BY st.id))"
)


@query("gr7_components", f"{COMPONENT_SQL} SELECT id, component FROM c", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return T.components(g.e)


@query("gr8_isolated", "SELECT id FROM n WHERE id NOT IN (SELECT source FROM e UNION SELECT target FROM e)", ("OR",), ("contains",))
def _(g: Tables) -> DataFrame:
    return T.isolated(g.n.select("id"), g.e)


@query("gr9_self_loops", "SELECT count(*) AS n FROM e WHERE source = target", (), ("contains", *GEO))
def _(g: Tables) -> DataFrame:
    return g.e.where("source = target").agg(F.count("*").alias("n"))


@query("gr10_islands", f"{COMPONENT_SQL}, s AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS islands FROM s GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    # sizes need no names: nodes by number, orders even and parts odd; a key past 2^62 is an error
    links = g.e.select((F.col("okey") * 2).alias("source"), (F.col("part") * 2 + 1).alias("target"))
    return T.components(links).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("islands"))


LINEAGE_SQL = "WITH RECURSIVE up AS (SELECT p_partkey AS id, p_partkey // 2 AS ancestor, 1 AS depth FROM part WHERE p_partkey >= 2 UNION SELECT up.id, up.ancestor // 2, up.depth + 1 FROM up WHERE up.ancestor >= 2)"


def lineage(g: Tables) -> DataFrame:
    return g.table("part").where("p_partkey >= 2").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("parent"))


@query("gr12_lineage", f"{LINEAGE_SQL} SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    return T.closure(lineage(g))


@query(
    "gr12_acyclic",
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 2 AS parent FROM part WHERE p_partkey >= 2), q AS (SELECT * FROM p UNION ALL SELECT 1, max(p_partkey) FROM part),
    up AS (SELECT id, parent AS ancestor FROM p UNION SELECT up.id, p.parent FROM up JOIN p ON p.id = up.ancestor), round AS (SELECT id, parent AS ancestor FROM q UNION SELECT round.id, q.parent FROM round JOIN q ON q.id = round.ancestor)
    SELECT 'plain' AS lineage, count(*) FILTER (WHERE id = ancestor) AS on_a_cycle FROM up UNION ALL SELECT 'first_from_last', count(*) FILTER (WHERE id = ancestor) FROM round""",
)
def _(g: Tables) -> DataFrame:
    plain = lineage(g)
    again = g.table("part").agg(F.lit(1).cast("bigint").alias("id"), F.max("p_partkey").cast("bigint").alias("parent"))
    out = [T.on_cycles(x).agg(F.lit(n).alias("lineage"), F.count("*").alias("on_a_cycle")) for n, x in (("plain", plain), ("first_from_last", plain.unionByName(again)))]
    return out[0].unionAll(out[1])


@query("gr13_frontier", f"{STEP_SQL}, shown AS (SELECT {SEED_SQL} AS id UNION SELECT other FROM st WHERE id = {SEED_SQL}), ways AS (SELECT source AS id, target AS other FROM e UNION ALL SELECT target, source FROM e) SELECT id, count(*) AS hidden FROM ways WHERE id IN (SELECT id FROM shown) AND other NOT IN (SELECT id FROM shown) GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return T.frontier(g.e, T.ego(g.e, first_part(g), 1))


@query("gr14_overview", f"{NAMED_SQL} SELECT s.subject AS s_subject, s.main AS s_main, e.type, t.subject AS t_subject, t.main AS t_main, count(*) AS n FROM e JOIN named s ON s.id = e.source JOIN named t ON t.id = e.target GROUP BY ALL", ("OR", "PA", "CU", "SU", "NA", "RG"), ("contains", "supplied_by", "placed_by", *GEO))
def _(g: Tables) -> DataFrame:
    return T.overview(g.n, g.e)


@query("gr15_navigation", f"{NAMED_SQL} SELECT 'subject' AS level, '' AS parent, subject AS key, count(*) AS n FROM named GROUP BY ALL UNION ALL SELECT 'domain', subject, coalesce(domain, '(无领域)'), count(*) FROM named GROUP BY ALL", ALL)
def _(g: Tables) -> DataFrame:
    return T.navigation(g.n)


@query("gr16_detail_sections", "SELECT id, length(name) > 0 AS named, domain IS NOT NULL AS placed, value > 2000 AS long_text, CAST(length(name) > 0 AS INT) + CAST(domain IS NOT NULL AS INT) AS present FROM n WHERE list_contains(labels, 'Formula')", DOCUMENTS)
def _(g: Tables) -> DataFrame:
    has = (F.char_length("name") > 0, F.col("domain").isNotNull())
    return g.n.where(F.array_contains("labels", "Formula")).select("id", has[0].alias("named"), has[1].alias("placed"), (F.col("value") > 2000).alias("long_text"), (has[0].cast("int") + has[1].cast("int")).alias("present"))


@query("gr17_diagnosis", f"WITH f AS (SELECT kind = 'none' AS kinds, {RANK_SQL} >= 4 AS trust, confidence >= 0.95 AS confidence FROM e), c AS (SELECT 'kinds' AS condition, count(*) FILTER (WHERE NOT kinds AND trust AND confidence) AS n FROM f UNION ALL SELECT 'trust', count(*) FILTER (WHERE kinds AND NOT trust AND confidence) FROM f UNION ALL SELECT 'confidence', count(*) FILTER (WHERE kinds AND trust AND NOT confidence) FROM f) SELECT condition, n, n > 0 AND n = (SELECT max(n) FROM c) AS best FROM c", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return T.diagnosis(g.e, {"kinds": F.col("kind") == "none", "trust": expr.level_rank(F.col("level")) >= 4, "confidence": F.col("confidence") >= 0.95})


@query("gr18_merge_nodes", "WITH k AS (SELECT id, min(id) OVER (PARTITION BY name, domain) AS same_as FROM n) SELECT DISTINCT e.source, k.same_as AS target, e.kind FROM e JOIN k ON k.id = e.target", ("PA",), ("contains",))
def _(g: Tables) -> DataFrame:
    same = T.same_entity(g.n, F.concat_ws("|", "name", "domain"))
    return T.merged_nodes(g.e, same).select("source", "target", "kind").distinct()


@query("gr19_same_entity", "SELECT id, same_as FROM (SELECT id, min(id) OVER (PARTITION BY name, domain) AS same_as FROM n) WHERE id <> same_as", ("PA",))
def _(g: Tables) -> DataFrame:
    return T.same_entity(g.n, F.concat_ws("|", "name", "domain"))


@query("gr20_link_candidates", f"{STEP_SQL} SELECT x.id AS a, y.id AS b, count(*) AS common FROM st x JOIN st y ON x.other = y.other AND x.id < y.id WHERE NOT EXISTS (SELECT 1 FROM st z WHERE z.id = x.id AND z.other = y.id) GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 20", (), ("contains",))
def _(g: Tables) -> DataFrame:
    return T.link_candidates(g.e, 20)


# search


@query("tx1_search", "WITH h AS (SELECT id, CASE WHEN lower(id) = 'red' THEN 100 WHEN lower(name) = 'red' THEN 90 WHEN starts_with(lower(name), 'red') THEN 70 WHEN contains(' ' || lower(name) || ' ', ' red ') THEN 60 WHEN contains(lower(name), 'red') THEN 40 END AS score FROM n) SELECT id, score, (SELECT count(*) FROM h WHERE score IS NOT NULL) AS total_matches, (SELECT count(*) FROM h WHERE score IS NOT NULL) > 20 AS truncated FROM h WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 20", ("PA", "SU", "NA"))
def _(g: Tables) -> DataFrame:
    return S.hits(g.n.select("id", "name"), "red", 20).drop("name")


@query("tx2_layered_search", "WITH a AS (SELECT DISTINCT id FROM n WHERE id = 'ring' OR lower(name) = 'ring'), b AS (SELECT id FROM n WHERE id IN ('PA:1', 'PA:2')), c AS (SELECT id FROM n WHERE contains(lower(name), 'ring') ORDER BY id LIMIT 200) SELECT id, CASE min(layer) WHEN 0 THEN 'identity' WHEN 1 THEN 'dictionary' ELSE 'text' END AS reason FROM (SELECT id, 0 AS layer FROM a UNION ALL SELECT id, 1 FROM b UNION ALL SELECT id, 2 FROM c) GROUP BY 1", ("PA",))
def _(g: Tables) -> DataFrame:
    aliases = g.spark.sql("SELECT 'ring' AS alias, explode(array('PA:1', 'PA:2')) AS id")
    n = g.n.select("id", "name")
    return S.layered(n, "ring", aliases, S.postings(n))
