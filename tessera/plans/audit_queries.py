"""Queries of audits, requests and client algebra over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import audits as A
from ..operators import relations as R
from ..operators import search as S
from ..operators import traverse as T
from .graph_queries import RANK_SQL
from .registry import SQL, Tables, query
from .trust_queries import EVIDENCE_SQL, UNIT_ROWS, UNIT_SQL, evidence, registry

#: A quantity's dimension by a part's size, and the same as SQL.
DIM = "CASE p_size % 4 WHEN 0 THEN 'M1 L2 T-2' WHEN 1 THEN 'M1' WHEN 2 THEN 'L1' END"


def word(k: int) -> F.Column:
    return F.split_part("p_name", F.lit(" "), F.lit(k))


# audits


@query("au2_dimension_fields", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'COLLISION' WHEN 2 THEN 'UNIT_SYMBOL_IN_DIM' WHEN 4 THEN 'NO_DIM_FIELD' ELSE 'SEPARATED' END AS fields FROM part")
def _(g: Tables) -> DataFrame:
    props = F.expr("""CASE p_size % 5 WHEN 0 THEN '{"dimension": 2}' WHEN 1 THEN '{"dimension_vector": "M1 L2 T-2"}' WHEN 2 THEN '{"dimension_vector": "J"}' WHEN 3 THEN '{"exponent_in_term": 2}' ELSE '{"name": "E"}' END""")
    return g.table("part").select("p_partkey", A.dimension_fields(props).alias("fields"))


@query("au4_molar_mass_names", "SELECT p_partkey, p_size % 5 IN (0, 2, 4) AS molar FROM part")
def _(g: Tables) -> DataFrame:
    name = F.expr("CASE p_size % 5 WHEN 0 THEN 'molar_mass' WHEN 1 THEN 'kinetic_energy' WHEN 2 THEN 'Molecular  Weight' WHEN 3 THEN 'mass' ELSE '摩尔质量' END")
    return g.table("part").select("p_partkey", A.is_molar_mass(name).alias("molar"))


@query("au6_dimension_vectors", "SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN NULL WHEN 1 THEN 'M1 T-1' ELSE 'M1 L2 T-2' END AS canonical, CASE p_size % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END AS normal FROM part")
def _(g: Tables) -> DataFrame:
    vector = F.expr("CASE p_size % 4 WHEN 0 THEN 'M1 L2 T-2' WHEN 1 THEN 'T-1 L0 M1' WHEN 2 THEN 'J' ELSE 'furlong' END")
    canonical = A.canonical_dimension(vector)
    return g.table("part").select("p_partkey", canonical.alias("canonical"), (canonical == vector).alias("normal"))


@query("au7_dimension_mismatches", f"WITH d AS (SELECT p_partkey AS id, {DIM} AS dim FROM part) SELECT a.id AS source, b.id AS target FROM d a JOIN d b ON b.id = a.id + 1 WHERE a.dim <> b.dim")
def _(g: Tables) -> DataFrame:
    dims = g.table("part").select(F.col("p_partkey").alias("id"), F.expr(DIM).alias("dim"))
    return A.dimension_mismatches(dims.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")), dims).select("source", "target")


@query("au8_declared_classes", "SELECT p_size % 4 AS declared, count(*) FILTER (WHERE p_size % 4 IN (0, 2) AND p_size % 3 < 2 OR p_size % 4 = 1 AND p_size % 3 = 2) AS fits, count(*) FILTER (WHERE p_size % 4 IN (0, 2) AND p_size % 3 = 2 OR p_size % 4 = 1 AND p_size % 3 < 2) AS contradict FROM part GROUP BY 1")
def _(g: Tables) -> DataFrame:
    rationale = F.expr("CASE p_size % 4 WHEN 0 THEN '属质量类物理量' WHEN 1 THEN '属能量类物理量' WHEN 2 THEN '摩尔质量 18.02 g/mol' ELSE '同名' END")
    dim = F.expr("CASE p_size % 3 WHEN 0 THEN 'M1' WHEN 1 THEN 'M1 N-1' ELSE 'M1 L2 T-2' END")
    rows = g.table("part").select((F.col("p_size") % 4).alias("declared"), A.class_fits(rationale, dim).alias("fits"))
    return rows.groupBy("declared").agg(F.count_if("fits").alias("fits"), F.count_if(~F.col("fits")).alias("contradict"))


@query("au12_units_of_quantities", f"SELECT p_brand, count(*) FILTER (WHERE {UNIT_SQL} = {DIM}) AS same, count(*) FILTER (WHERE {UNIT_SQL} <> {DIM}) AS different, count(*) FILTER (WHERE {UNIT_SQL} IS NULL OR {DIM} IS NULL) AS undecided FROM part GROUP BY 1")
def _(g: Tables) -> DataFrame:
    same = expr.unit_dimension(F.expr(UNIT_ROWS)) == F.expr(DIM)
    return g.table("part").groupBy("p_brand").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("different"), F.count_if(same.isNull()).alias("undecided"))


@query("au13_one_dimension_each", f"SELECT p_brand, p_type, count(DISTINCT {UNIT_SQL}) AS dimensions FROM part GROUP BY ALL HAVING count(DISTINCT {UNIT_SQL}) > 1")
def _(g: Tables) -> DataFrame:
    return g.table("part").groupBy("p_brand", "p_type").agg(F.count_distinct(expr.unit_dimension(F.expr(UNIT_ROWS))).alias("dimensions")).where("dimensions > 1")


@query("au14_symbols_of_model_edges", "SELECT e.pos, e.target FROM e JOIN part p ON p.p_partkey = e.part WHERE e.level = 'model_inferred' AND NOT contains(replace(p.p_name, ' ', ''), 'ring')", (), ("contains",))
def _(g: Tables) -> DataFrame:
    edges = g.e.where(F.col("level") == "model_inferred").join(g.table("part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    return edges.where(~expr.has_symbol(F.col("p_name"), F.array().cast("array<string>"), F.lit("ring_0"))).select("pos", "target")


@query("au15_bridges_evidenced", f"SELECT target, count(*) AS bridges, count(*) FILTER (WHERE {RANK_SQL} < 4) AS low, count(*) FILTER (WHERE {RANK_SQL} >= 4 AND line % 3 <> 0) AS without FROM (SELECT *  REPLACE ('MC:gradient' AS target) FROM e WHERE kind = 'N') GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    expression = F.expr(r"CASE line % 3 WHEN 0 THEN r'\nabla f' WHEN 1 THEN r'\int x' ELSE 'nabla' END")
    rows = g.e.where(F.col("kind") == "N").withColumn("target", F.lit("MC:gradient")).withColumn("found", A.operator_evidence(expression, F.col("target")))
    rank = expr.level_rank(F.col("level"))
    return rows.groupBy("target").agg(F.count("*").alias("bridges"), F.count_if(rank < 4).alias("low"), F.count_if((rank >= 4) & ~F.col("found")).alias("without"))


@query("au17_claimed_symbols", "SELECT p_type, count(*) AS claimed, count(*) FILTER (WHERE p_size % 2 = 0) AS hold, count(*) FILTER (WHERE p_size % 2 = 0) >= 10 AS enough FROM part GROUP BY 1")
def _(g: Tables) -> DataFrame:
    claim = F.when(F.col("p_size") % 2 == 0, word(2)).otherwise(F.lit("zz"))
    rows = g.table("part").select("p_type", expr.has_symbol(F.col("p_name"), F.array().cast("array<string>"), claim).alias("holds"))
    return rows.groupBy("p_type").agg(F.count("*").alias("claimed"), F.count_if("holds").alias("hold"), (F.count_if("holds") >= 10).alias("enough"))


@query("au18_named_mismatches", "WITH d AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'energy' WHEN 1 THEN 'mass' WHEN 2 THEN 'time' ELSE 'colour' END AS a, CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN 'energy' WHEN 1 THEN 'mass' ELSE 'length' END AS b FROM lineitem) SELECT a AS source, b AS target, count(*) AS n FROM d WHERE a <> 'colour' AND a <> b GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    ends = (F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'PQ:energy' WHEN 1 THEN 'PQ:mass' WHEN 2 THEN 'PQ:time' ELSE 'PQ:colour' END"), F.expr("CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN 'PB:pq:energy' WHEN 1 THEN 'PB:pq:mass' ELSE 'PB:pq:length' END"))
    names = g.table("lineitem").select(*[F.element_at(F.split(e, ":"), -1).alias(c) for c, e in zip(("source", "target"), ends)])
    a, b = A.mapped(F.col("source"), A.QUANTITIES), A.mapped(F.col("target"), A.QUANTITIES)
    return names.where(a != b).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("au20_evidence_faults", f"{EVIDENCE_SQL} SELECT 'no_hash_match' AS fault, count(*) FILTER (WHERE fidelity = 'changed') AS n FROM per UNION ALL SELECT 'unregistered', count(*) FILTER (WHERE fidelity = 'unverifiable_no_source') FROM per UNION ALL SELECT 'independent_of_itself', count(*) FILTER (WHERE indep AND NOT public) FROM per", (), ("contains",))
def _(g: Tables) -> DataFrame:
    rows = evidence(g).join(F.broadcast(registry(g)), "src", "left")
    known = F.coalesce("known", F.lit(False))
    faults = {"no_hash_match": known & (F.col("repo_status") == "in_repo") & (F.col("src_hash") != F.col("hash")), "unregistered": ~known, "independent_of_itself": F.col("indep") & ~F.coalesce("redistributable", F.lit(False))}
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in faults.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fault"), F.col(k).alias("n")) for k in faults])).alias("r")).select("r.*")


PRINTED = """CASE p_size % 6 WHEN 0 THEN "['a', 'b']" WHEN 1 THEN '["a", "b"]' WHEN 2 THEN "{'k': None}" WHEN 3 THEN '[not closed' WHEN 4 THEN '[a b]' ELSE p_name END"""


@query("tx12_printed_containers", "SELECT p_partkey, p_size % 6 IN (0, 2) AS printed FROM part")
def _(g: Tables) -> DataFrame:
    return g.table("part").select("p_partkey", F.coalesce(A.printed_container(F.expr(PRINTED)), F.lit(False)).alias("printed"))


@query("au21_no_printed_values", "SELECT 'p_name' AS key, count(*) AS scanned, 0::BIGINT AS printed FROM part UNION ALL SELECT 'value', count(*), count(*) FILTER (WHERE p_size % 6 IN (0, 2)) FROM part")
def _(g: Tables) -> DataFrame:
    values = F.map_from_arrays(F.array(F.lit("p_name"), F.lit("value")), F.array(F.col("p_name"), F.expr(PRINTED)))
    rows = g.table("part").select(F.explode(values).alias("key", "value")).withColumn("printed", F.coalesce(A.printed_container(F.col("value")), F.lit(False)))
    return rows.groupBy("key").agg(F.count("*").alias("scanned"), F.count_if("printed").alias("printed"))


@query("au23_residuals_accounted", "SELECT CASE WHEN p_size % 5 = 3 THEN 'no_equation' WHEN p_size % 5 = 4 THEN 'on_both_sides' ELSE 'not_found' END AS reason, count(*) AS n FROM part WHERE p_size % 5 >= 2 GROUP BY 1")
def _(g: Tables) -> DataFrame:
    equation = F.when(F.col("p_size") % 5 != 3, F.concat(word(1), F.lit(" + X = Y"), F.when(F.col("p_size") % 5 == 4, F.concat(F.lit(" + "), word(1))).otherwise(F.lit(""))))
    label = F.when(F.col("p_size") % 5 == 2, F.lit("Z")).when(F.col("p_size") % 5 == 1, F.lit("Y")).otherwise(word(1))
    side = A.on_its_side(equation, label, F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(True))
    reason = F.when(equation.isNull(), "no_equation").when(F.size(F.array_intersect(F.split(F.split(equation, " = ")[0], r" \+ "), F.split(F.split(equation, " = ")[1], r" \+ "))) > 0, "on_both_sides").otherwise("not_found")
    return g.table("part").where(side.isNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("au26_registry_and_lineage", f"{EVIDENCE_SQL}, up AS (SELECT p_partkey AS id, p_partkey // 2 AS ancestor FROM part WHERE p_partkey >= 2 UNION SELECT up.id, up.ancestor // 2 FROM up WHERE up.ancestor >= 2) SELECT (SELECT count(*) FROM per WHERE src NOT IN (SELECT src FROM reg)) AS unregistered, (SELECT count(*) FROM up WHERE id = ancestor) AS on_a_cycle", (), ("contains",))
def _(g: Tables) -> DataFrame:
    from .graph_queries import lineage

    missing = evidence(g).join(F.broadcast(registry(g).select("src")), "src", "left_anti").agg(F.count("*").alias("unregistered"))
    return missing.crossJoin(F.broadcast(T.closure(lineage(g)).agg(F.count_if(F.col("id") == F.col("ancestor")).alias("on_a_cycle"))))


# text


@query("tx3_folded", "SELECT p_partkey, 'foo' || replace(lower(p_name), ' ', '') || 'fi' AS folded FROM part")
def _(g: Tables) -> DataFrame:
    return g.table("part").select("p_partkey", A.folded(F.concat(F.lit("Ｆｏｏ　"), F.initcap("p_name"), F.lit(" ﬁ"))).alias("folded"))


@query("tx9_reaction_sides", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN true END AS on_side FROM part")
def _(g: Tables) -> DataFrame:
    """By label, on the other side, by formula, not there, by a synonym, and without an equation."""
    pick = lambda *v: F.element_at(F.array(*v), (F.col("p_size") % 6 + 1).cast("int"))
    none = F.lit(None).cast("string")
    label = pick(F.initcap(word(1)), F.lit("zinc"), F.lit("x"), F.lit("x"), F.lit("x"), word(1))
    equation = F.when(F.col("p_size") % 6 != 5, F.concat(word(1), F.lit(" + H2O(l) + sal-ty = zinc")))
    formula, synonyms = pick(none, none, F.lit("H2O"), none, none, none), F.array(pick(none, none, none, none, F.lit("Sal ty"), none))
    return g.table("part").select("p_partkey", A.on_its_side(equation, label, formula, synonyms, F.lit(True)).alias("on_side"))


@query("tx20_request_digest", """SELECT p_partkey, substr(sha256('{"limit":"' || p_size || '","q":"' || p_name || '"}'), 1, 16) AS digest FROM part""")
def _(g: Tables) -> DataFrame:
    params = F.create_map(F.lit("q"), F.col("p_name"), F.lit("session_id"), F.col("p_partkey").cast("string"), F.lit("limit"), F.col("p_size").cast("string"), F.lit("mode"), F.lit(" "))
    return g.table("part").select("p_partkey", expr.digest(A.request_text(params)).alias("digest"))


# evidence and data sets


@query("ev22_stale_reports", "SELECT CASE WHEN p_size > 40 THEN 'missing' WHEN p_size > 30 THEN 'stale' ELSE 'fresh' END AS status, count(*) AS n FROM part GROUP BY 1")
def _(g: Tables) -> DataFrame:
    """What reports declare of their inputs (digest, size) against the inputs there are."""
    p = g.table("part")
    declared = p.select("p_partkey", expr.digest(F.col("p_name")).alias("digest"), F.char_length("p_name").alias("size"))
    text = F.when(F.col("p_size") > 30, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    now = p.where("p_size <= 40").select("p_partkey", expr.digest(text).alias("digest2"), F.char_length(text).alias("size2"))
    same = (F.col("digest") == F.col("digest2")) & (F.col("size") == F.col("size2"))
    return R.counts(declared.join(now, "p_partkey", "left").select(F.when(F.col("digest2").isNull(), "missing").when(same, "fresh").otherwise("stale").alias("status")), "status")


@query("ev24_map_numbers", "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size % 3 = 0 END AS agree FROM part")
def _(g: Tables) -> DataFrame:
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")
    whole = F.concat(F.lit("[CH3:"), n, F.lit("][OH:"), m, F.lit("]>>[O:"), m, F.lit("]=[CH2:"), F.when(F.col("p_size") % 3 == 0, n).otherwise(m), F.lit("]"))
    return g.table("part").select("p_partkey", A.map_numbers_agree(F.when(F.col("p_size") % 3 == 2, F.lit("CO>>C=O")).otherwise(whole)).alias("agree"))


@query(
    "ev25_dataset_rules",
    f"""WITH x AS (SELECT 'n' || p_partkey AS id FROM part WHERE p_size > 1), g AS (SELECT pos, target, {RANK_SQL} AS grade, part FROM e)
    SELECT 'V1 node ids' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'V2 edge ids', count(*) FROM (SELECT pos FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'V3 sources', 0 UNION ALL SELECT 'V4 targets', count(*) FROM e JOIN part ON p_partkey = e.part WHERE p_size = 1
    UNION ALL SELECT 'V5 manifest counts', 1 UNION ALL SELECT 'V6 labels', count(*) FROM part WHERE p_size > 1 AND p_size % 10 = 0 UNION ALL SELECT 'V7 licences', count(*) FROM part WHERE p_size > 1 AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3', 'src')
    UNION ALL SELECT 'V8 grades', count(*) FILTER (WHERE grade NOT BETWEEN 1 AND 5) FROM g UNION ALL SELECT 'V9 types', 0""",
    (), ("contains",),
)
def _(g: Tables) -> DataFrame:
    labels = F.when(F.col("p_size") % 10 != 0, F.array(F.lit("Part")))
    nodes = g.table("part").where("p_size > 1").select(F.concat(F.lit("PA:"), "p_partkey").alias("id"), labels.alias("labels"), F.col("p_brand").alias("source"))
    nodes = nodes.unionAll(g.table("orders").select(F.concat(F.lit("OR:"), "o_orderkey"), F.array(F.lit("Order")), F.lit("src")))
    edges = g.e.select(F.col("pos").alias("id"), "source", "target", "type", expr.level_rank(F.col("level")).alias("grade"))
    manifest = edges.agg(F.lit("edges").alias("part"), F.count("*").alias("n")).unionAll(nodes.agg(F.lit("nodes").alias("part"), (F.count("*") + 1).alias("n")))
    return A.verified_dataset(nodes, edges, manifest, ["Brand#1", "Brand#2", "Brand#3", "src"])


# sources and sinks


@query("sc3_source_choice", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'explicit' WHEN o_orderkey % 3 = 1 THEN 'inferred' ELSE 'normalized' END AS source FROM orders")
def _(g: Tables) -> DataFrame:
    from ..sources.io import first_source

    given = lambda name, test: F.when(test, F.lit(name))
    k = F.col("o_orderkey") % 3
    return g.table("orders").select("o_orderkey", first_source(given("explicit", k == 0), given("inferred", k <= 1), F.lit("normalized")).alias("source"))


@query("sk2_view_meta", "SELECT 'type' AS section, labels[1] AS key, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'kind', e.kind, count(*) FROM e JOIN n ON n.id = e.target GROUP BY ALL UNION ALL SELECT 'dangling', '', count(*) FROM e WHERE target NOT IN (SELECT id FROM n)", ("PA", "OR"), ("contains", "supplied_by"))
def _(g: Tables) -> DataFrame:
    from ..sources.io import view_meta

    return view_meta(g.n.select("id", F.get("labels", F.lit(0)).alias("type")), g.e)


@query("sk8_sanitised_keys", "SELECT key, kind, count(*) AS n FROM (SELECT unnest([{'key': 'a', 'kind': 'dict'}, {'key': 'b', 'kind': 'list<non-primitive>'}], recursive := true) FROM part WHERE p_size % 2 = 0) GROUP BY ALL")
def _(g: Tables) -> DataFrame:
    props = F.expr("""CASE WHEN p_size % 2 = 0 THEN '{"a": {"x": 1}, "b": [1, "y"], "c": [1, 2], "d": "e"}' ELSE '{"a": "text", "c": ["p", "q"]}' END""")
    return A.sanitised(g.table("part").select(F.col("p_partkey").alias("id"), props.alias("props")), "props")[1]


@query("sk8_sanitised_values", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '{\"x\":1}' ELSE 'text' END AS a, CASE WHEN p_size % 2 = 0 THEN 'e' END AS d FROM part")
def _(g: Tables) -> DataFrame:
    props = F.expr("""CASE WHEN p_size % 2 = 0 THEN '{"a": {"x": 1}, "d": "e"}' ELSE '{"a": "text"}' END""")
    safe = A.sanitised(g.table("part").select(F.col("p_partkey").alias("id"), props.alias("props")), "props")[0]
    return safe.select("id", F.element_at("safe", "a").alias("a"), F.element_at("safe", "d").alias("d"))


@query("sc12_indexed_store", "SELECT 'nodes' AS part, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT id, substr(lower(name), k, 3) AS gram FROM (SELECT id, name, unnest(range(1, length(name) - 1)) AS k FROM n))", ("NA", "RG"), ("in_region",))
def _(g: Tables) -> DataFrame:
    from ..sources.io import write_store

    path = f"{T.shared_dir(g.spark)}/store-{uuid.uuid4().hex}"
    write_store(g.n.select("id", "name", "domain"), g.e, path)
    parts = [g.spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("n")) for p in ("nodes", "edges", "postings")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def scratch(g: Tables, name: str) -> str:
    return f"{T.shared_dir(g.spark)}/{name}-{uuid.uuid4().hex}"


def document(g: Tables, path: str, **lists: DataFrame) -> str:
    """One JSON document of small tables, each a list of its rows."""
    whole = None
    for name, df in lists.items():
        one = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        whole = one if whole is None else whole.crossJoin(F.broadcast(one))
    whole.select(F.to_json(F.struct(*lists)).alias("value")).coalesce(1).write.text(path)
    return path


def geography(g: Tables) -> tuple[DataFrame, DataFrame]:
    """Nations and regions as (id, name, type), and (source, target) between them."""
    n, r = g.table("nation"), g.table("region")
    nation, region = F.concat(F.lit("NA:"), "n_nationkey"), lambda k: F.concat(F.lit("RG:"), k)
    nodes = n.select(nation.alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("type")).unionAll(r.select(region(F.col("r_regionkey")), "r_name", F.lit("Region")))
    return nodes, n.select(nation.alias("source"), region(F.col("n_regionkey")).alias("target"))


GEO_SQL = "WITH n AS (SELECT 'NA:' || n_nationkey AS id, n_name AS name, 'Nation' AS type FROM nation UNION ALL SELECT 'RG:' || r_regionkey, r_name, 'Region' FROM region), e AS (SELECT 'NA:' || n_nationkey AS source, 'RG:' || n_regionkey AS target FROM nation)"
BOTH_SQL = f"{GEO_SQL} SELECT id, type AS kind, name FROM n UNION ALL SELECT 'lies_in|' || source || '|' || target, 'lies_in', NULL FROM e"


def both(graph, name: str) -> DataFrame:
    n = graph.nodes.select("id", F.get("labels", F.lit(0)).alias("kind"), F.get_json_object("props", f"$.{name}").alias("name"))
    return n.unionAll(graph.edges.select("id", "kind", F.lit(None).cast("string")))


@query("sc6_paper", BOTH_SQL)
def _(g: Tables) -> DataFrame:
    from ..sources.io import read_paper

    nodes, edges = geography(g)
    nodes = nodes.select("id", "type", F.col("name").alias("latex"), F.lit("").alias("informal_text"))
    edges = edges.select("source", "target", F.lit("lies_in").alias("kind"), F.lit(0.5).alias("confidence"))
    return both(read_paper(g.spark, document(g, scratch(g, "paper"), nodes=nodes, dependencies=edges)), "latex")


@query("sc7_csv_graph", BOTH_SQL)
def _(g: Tables) -> DataFrame:
    from ..sources.io import read_csv_graph

    nodes, edges = geography(g)
    path = scratch(g, "csv")
    nodes.select(F.col("id").alias("id:ID"), F.concat("type", F.lit(";Entity")).alias(":LABEL"), "name").write.csv(f"{path}/n", header=True)
    edges.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.lit("lies_in").alias(":TYPE")).write.csv(f"{path}/e", header=True)
    return both(read_csv_graph(g.spark, f"{path}/n", f"{path}/e"), "name")


@query("sc9_adapter", BOTH_SQL)
def _(g: Tables) -> DataFrame:
    from ..sources.io import read_relations

    nodes, edges = geography(g)
    relations = edges.select(F.col("source").alias("head"), F.col("target").alias("tail"), F.lit("lies_in").alias("relation"))
    return both(read_relations(g.spark, document(g, scratch(g, "adapter"), entities=nodes, relations=relations)), "name")


@query("sc8_full_export", "SELECT source, target, coalesce(kind, 'contains') AS kind FROM (SELECT 'OR:' || l_orderkey AS source, 'PA:' || l_partkey AS target, nullif(l_returnflag, 'A') AS kind, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def _(g: Tables) -> DataFrame:
    from ..sources.io import exported

    rows = g.table("lineitem").select(F.concat(F.lit("OR:"), "l_orderkey").alias("source"), F.concat(F.lit("PA:"), "l_partkey").alias("target"), F.lit("contains").alias("type"), F.nullif("l_returnflag", F.lit("A")).alias("kind"), F.lit(None).cast("string").alias("props"), F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"))
    return exported(g.table("part").select(F.concat(F.lit("PA:"), "p_partkey").alias("id")), rows).edges.select("source", "target", "kind")


@query("sc10_ledger", "SELECT p_partkey, p_name, p_size FROM part")
def _(g: Tables) -> DataFrame:
    from ..sources.io import read_ledger

    path = scratch(g, "ledger")
    g.table("part").select("p_partkey", "p_name", "p_size").write.json(path)
    return read_ledger(g.spark, path, "p_partkey bigint, p_name string, p_size int")


@query("sc11_bad_lines", "SELECT p_size > 45 AS bad, count(*) AS n FROM part GROUP BY 1")
def _(g: Tables) -> DataFrame:
    from ..sources.io import read_lines

    path = scratch(g, "lines")
    line = F.to_json(F.struct("p_partkey", "p_name"))
    g.table("part").select(F.when(F.col("p_size") > 45, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = read_lines(g.spark, path, "p_partkey bigint, p_name string")
    return good.agg(F.lit(False).alias("bad"), F.count("*").alias("n")).unionAll(bad.agg(F.lit(True), F.count("*"))).where("n > 0")


@query("sk1_sorted_lines", """SELECT '{"id":"PA:' || p_partkey || '","name":"' || p_name || '","size":' || p_size || '}' AS line FROM part""")
def _(g: Tables) -> DataFrame:
    from ..sources.io import write_lines

    path = scratch(g, "sorted")
    write_lines(g.table("part").select(F.col("p_size").alias("size"), F.concat(F.lit("PA:"), "p_partkey").alias("id"), F.col("p_name").alias("name")), path)
    return g.spark.read.text(path).select(F.col("value").alias("line"))


def packaged(g: Tables):
    from ..sources.io import Graph

    nodes, edges = geography(g)
    edges = edges.select(F.concat_ws("|", F.lit("lies_in"), "source", "target").alias("id"), "source", "target", F.lit("lies_in").alias("type"), F.lit("lies_in").alias("kind"), F.lit(None).cast("string").alias("props"))
    return Graph(nodes.select("id", F.array("type").alias("labels"), F.to_json(F.struct("name")).alias("props")), edges)


@query("sk3_package", f"{GEO_SQL} SELECT 'nodes' AS part, count(*) AS n, true AS ok FROM n UNION ALL SELECT 'edges', count(*), true FROM e")
def _(g: Tables) -> DataFrame:
    from ..sources.io import verified_package, write_package

    path = scratch(g, "package")
    return write_package(packaged(g), path, {"README": "nations and regions"}).select("part", "n").join(verified_package(g.spark, path), "part")


@query("mg9_dry_run", f"{GEO_SQL} SELECT 'dry' AS run, (SELECT count(*) FROM n) AS n, false AS there UNION ALL SELECT 'applied', (SELECT count(*) FROM n), true")
def _(g: Tables) -> DataFrame:
    from ..sources.io import write_package

    path, rows = scratch(g, "dry"), []
    there = g.spark._jvm.org.apache.hadoop.fs.Path(path)
    for run in ("dry", "applied"):
        manifest = write_package(packaged(g), path, dry=run == "dry")
        rows.append((run, manifest.where("part = 'nodes'").first().n, there.getFileSystem(g.spark._jsc.hadoopConfiguration()).exists(there)))
    return g.spark.createDataFrame(rows, "run string, n bigint, there boolean")


@query("sk4_slice", f"{GEO_SQL}, m AS (SELECT id FROM n WHERE type = 'Nation' AND name < 'J' OR id = 'RG:1'), t AS (SELECT e.*, e.source IN (SELECT id FROM m) AS a, e.target IN (SELECT id FROM m) AS b FROM e) SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM (SELECT source AS id FROM t WHERE a OR b UNION SELECT target FROM t WHERE a OR b) WHERE id NOT IN (SELECT id FROM m)) AS attached, (SELECT count(*) FROM t WHERE a AND b) AS internal, (SELECT count(*) FROM t WHERE a <> b) AS crossing")
def _(g: Tables) -> DataFrame:
    from ..sources.io import write_slice

    keep = F.array_contains("labels", "Nation") & (F.get_json_object("props", "$.name") < "J") | (F.col("id") == "RG:1")
    return write_slice(packaged(g), keep, scratch(g, "slice"), {"dim": "name", "value": "< J"})


@query("sk6_lost_rows", "SELECT count(*) FILTER (WHERE p_size <= 45) AS sent, count(*) FILTER (WHERE p_size > 45) AS lost FROM part")
def _(g: Tables) -> DataFrame:
    from ..sources.io import upsert

    def write(rows: list[dict]) -> None:
        if any(r["p_size"] > 45 for r in rows):
            raise OSError("refused")

    return upsert(g.table("part").select("p_partkey", "p_size"), write, size=1, tries=1).agg(F.sum("sent").alias("sent"), F.sum("lost").alias("lost"))


@query("st3_declared_files", "SELECT 'nation-' || n_nationkey AS id, 'left' AS side FROM nation WHERE n_regionkey < 3 AND n_nationkey % 5 = 0 UNION ALL SELECT 'nation-' || n_nationkey, 'right' FROM nation WHERE n_regionkey >= 3 AND n_nationkey % 5 <> 0")
def _(g: Tables) -> DataFrame:
    """Files that a manifest declares (left) against those there are (right)."""
    name = F.concat(F.lit("nation-"), "n_nationkey").alias("id")
    return R.only_in_one(g.table("nation").where("n_regionkey < 3").select(name), g.table("nation").where("n_nationkey % 5 <> 0").select(name))


# requests


@query("fl6_filter_needs_a_condition", "SELECT kind, 'ok' AS status, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT ' ', 'error', NULL", (), ("contains",))
def _(g: Tables) -> DataFrame:
    rows = []
    for kind in ("A", "N", "R", " "):
        answer = A.answered(g.e, A.Request("filter", kinds=(kind,), max_edges=20_000))
        rows.append((kind, "error" if answer.status == "error" else "ok", answer.before))
    return g.spark.createDataFrame(rows, "kind string, status string, n bigint")


@query("fl7_clamps", "SELECT p_partkey, least(greatest(p_size, 1), 5) AS hops, CASE WHEN p_size > 5 THEN 'hops' END AS truncated_by FROM part")
def _(g: Tables) -> DataFrame:
    used, by = A.clamped(F.col("p_size"), "hops")
    return g.table("part").select("p_partkey", used.alias("hops"), by.alias("truncated_by"))


@query("fl15_strict_predicate", "SELECT count(*) AS n FROM part WHERE p_size > 25")
def _(g: Tables) -> DataFrame:
    return A.strict_predicate(g.table("part").withColumn("large", F.col("p_size") > 25), "large").agg(F.count("*").alias("n"))


@query("gr4_path_subgraph", None, (), ("contains",))
def _(g: Tables) -> DataFrame:
    hub = g.e.groupBy("target").agg(F.count_distinct("source").alias("n")).where("n > 1").orderBy(F.desc("n"), "target").limit(1)
    ends = g.e.join(hub.select("target"), "target").agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    return A.path_edges(T.paths(g.e, ends.a or "", ends.b or "", 4, 5), g.e).select("source", "target").distinct()


SQL["gr4_path_subgraph"] = f"""WITH p AS ({SQL['gr3_paths']}), s AS (SELECT string_split(path, '>') AS ids FROM p), k AS (SELECT ids, unnest(range(1, len(ids))) AS i FROM s)
    SELECT DISTINCT CASE WHEN starts_with(ids[i], 'OR:') THEN ids[i] ELSE ids[i + 1] END AS source, CASE WHEN starts_with(ids[i], 'OR:') THEN ids[i + 1] ELSE ids[i] END AS target FROM k"""


@query("mg10_promise_is_delivered", f"WITH f AS (SELECT kind = 'none' AS kinds, {RANK_SQL} >= 4 AS trust, confidence >= 0.95 AS confidence FROM e) SELECT 'kinds' AS condition, count(*) FILTER (WHERE trust AND confidence) AS promised, count(*) FILTER (WHERE trust AND confidence) AS delivered FROM f UNION ALL SELECT 'trust', count(*) FILTER (WHERE kinds AND confidence), count(*) FILTER (WHERE kinds AND confidence) FROM f UNION ALL SELECT 'confidence', count(*) FILTER (WHERE kinds AND trust), count(*) FILTER (WHERE kinds AND trust) FROM f", (), ("contains",))
def _(g: Tables) -> DataFrame:
    """What the diagnosis of an empty result promises for each dropped condition, and what comes once it is dropped."""
    conditions = {"kinds": F.col("kind") == "none", "trust": expr.level_rank(F.col("level")) >= 4, "confidence": F.col("confidence") >= 0.95}
    promised = T.diagnosis(g.e, conditions).select("condition", F.col("n").alias("promised"))
    delivered = None
    for name in conditions:
        rest = g.e
        for other, test in conditions.items():
            rest = rest if other == name else rest.where(test)
        one = rest.agg(F.lit(name).alias("condition"), F.count("*").alias("delivered"))
        delivered = one if delivered is None else delivered.unionAll(one)
    return promised.join(delivered, "condition")


@query("mg8_merged_targets", "SELECT same_as AS target, count(*) AS n FROM e JOIN (SELECT id, min(id) OVER (PARTITION BY name, domain) AS same_as FROM n) k ON k.id = e.target WHERE k.id <> same_as GROUP BY 1", ("PA",), ("contains",))
def _(g: Tables) -> DataFrame:
    same = T.same_entity(g.n, F.concat_ws("|", "name", "domain"))
    return g.e.join(same, F.col("target") == F.col("id")).groupBy(F.col("same_as").alias("target")).agg(F.count("*").alias("n"))


@query("ss5_cached_counts", "SELECT 's1' AS snapshot, count(*) AS n, 1 AS computed FROM e UNION ALL SELECT 's1', count(*), 1 FROM e UNION ALL SELECT 's2', count(*), 2 FROM e", (), ("contains",))
def _(g: Tables) -> DataFrame:
    cache = A.SnapshotCache()
    rows = [(s, cache.get(s, "edges", lambda: g.e.count()), cache.computed) for s in ("s1", "s1", "s2")]
    return g.spark.createDataFrame(rows, "snapshot string, n bigint, computed int")


# client algebra


@query("cs2_request_signature", """SELECT p_partkey, '{"mode":"ego","seeds":"PA:' || p_partkey || '"' || CASE WHEN p_size % 2 = 0 THEN ',"types":"contains"' ELSE '' END || '}' AS signature FROM part""")
def _(g: Tables) -> DataFrame:
    types = F.when(F.col("p_size") % 2 == 0, "contains").otherwise(F.lit("  "))
    params = F.create_map(F.lit("types"), types, F.lit("seeds"), F.concat(F.lit("PA:"), "p_partkey"), F.lit("mode"), F.lit("ego"), F.lit("kinds"), F.lit(None).cast("string"))
    return g.table("part").select("p_partkey", A.request_text(params).alias("signature"))


@query("cs3_task_cards", "WITH h AS (SELECT 'ring' AS term, min(id) AS seed FROM n WHERE contains(lower(name), 'ring') UNION ALL SELECT 'widget', min(id) FROM n WHERE contains(lower(name), 'widget') UNION ALL SELECT 'qqqq', min(id) FROM n WHERE contains(lower(name), 'qqqq')), c(card, mode, start, stop) AS (VALUES ('relation', 'path', 'ring', 'widget'), ('units', 'ego', 'ring', NULL), ('nothing', 'path', 'ring', 'qqqq')) SELECT card, CASE WHEN a.seed IS NOT NULL AND (stop IS NULL OR b.seed IS NOT NULL) THEN mode || ' ' || a.seed || coalesce(',' || b.seed, '') END AS request FROM c JOIN h a ON a.term = start LEFT JOIN h b ON b.term = stop", ("PA",))
def _(g: Tables) -> DataFrame:
    """Task cards become requests once their search terms have a first hit; a card without a seed becomes none."""
    terms = F.array(*map(F.lit, ("ring", "widget", "qqqq")))
    found = g.n.select("id", F.explode(F.filter(terms, lambda t: F.lower("name").contains(t))).alias("term")).groupBy("term").agg(F.min("id").alias("seed"))
    cards = g.spark.createDataFrame([("relation", "path", "ring", "widget"), ("units", "ego", "ring", None), ("nothing", "path", "ring", "qqqq")], "card string, mode string, start string, stop string")
    both = cards.join(F.broadcast(found.withColumnsRenamed({"term": "start", "seed": "a"})), "start", "left").join(F.broadcast(found.withColumnsRenamed({"term": "stop", "seed": "b"})), "stop", "left")
    ready = F.col("a").isNotNull() & (F.col("stop").isNull() | F.col("b").isNotNull())
    return both.select("card", F.when(ready, F.concat("mode", F.lit(" "), F.concat_ws(",", "a", "b"))).alias("request"))


@query("cs4_path_items", "SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN '' ELSE 'PA:' || p_partkey || '>x' END AS nodes, CASE p_size % 3 WHEN 1 THEN 'e1' ELSE '' END AS edges FROM part")
def _(g: Tables) -> DataFrame:
    ids = F.concat(F.lit('["PA:'), "p_partkey", F.lit('", "x"]'))
    item = F.when(F.col("p_size") % 3 == 0, ids).when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"nodes": '), ids, F.lit(', "edges": ["e1"]}'))).otherwise(F.lit("{}"))
    nodes, edges = A.path_items(item)
    return g.table("part").select("p_partkey", F.array_join(nodes, ">").alias("nodes"), F.array_join(edges, ">").alias("edges"))


@query("cs5_session_rollback", """WITH RECURSIVE o AS (SELECT user_id, event_type = 'error' AS back, 1 + CAST(event_id AS BIGINT) % 5 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS spent, 0::BIGINT AS steps, 0::BIGINT AS refused FROM o GROUP BY 1
    UNION ALL SELECT o.user_id, o.k, CASE WHEN back THEN greatest(spent - cost, 0) WHEN spent + cost <= 20 THEN spent + cost ELSE spent END, CASE WHEN back THEN greatest(steps - 1, 0) WHEN spent + cost <= 20 THEN steps + 1 ELSE steps END, refused + (NOT back AND spent + cost > 20)::BIGINT FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
    SELECT user_id, max_by(spent, k) AS spent, max_by(steps, k) AS steps, max(refused) AS refused FROM w GROUP BY 1""")  # fmt: skip
def _(g: Tables) -> DataFrame:
    from ..streaming.flows import with_rollback

    rows = g.table("events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("back"), (1 + F.col("event_id") % 5).alias("cost"))
    return with_rollback(rows, 20)


@query("cs6_truncation_words", "SELECT kind, '已截断（max_edges）：显示 15 边，实有 ' || count(*) || ' 边' AS words FROM e GROUP BY 1", (), ("contains",))
def _(g: Tables) -> DataFrame:
    per = R.counts(g.e, "kind")
    return per.select("kind", A.truncation_text(F.least("n", F.lit(15)), F.col("n"), "max_edges").alias("words"))


@query("cs7_any_field_search", "SELECT id, (SELECT count(*) FROM n WHERE contains(lower(name), 'ring') OR contains(lower(source), 'ring') OR contains(lower(id), 'ring')) AS total, CASE WHEN (SELECT count(*) FROM n WHERE contains(lower(name), 'ring') OR contains(lower(source), 'ring') OR contains(lower(id), 'ring')) > 15 THEN 15 END AS next_offset FROM (SELECT id FROM n WHERE contains(lower(name), 'ring') OR contains(lower(source), 'ring') OR contains(lower(id), 'ring') ORDER BY id LIMIT 10 OFFSET 5)", ("PA",))
def _(g: Tables) -> DataFrame:
    return R.page(S.any_field(g.n, "ring", "name", "source", "id").select("id"), [F.col("id")], 5, 10)


@query("cs8_curated_append", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_size <= 40 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size > 40")
def _(g: Tables) -> DataFrame:
    p = g.table("part")
    have = p.where("p_size <= 40").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    new = p.where("p_size > 30").select(F.col("p_partkey").alias("id"), F.lit("new").alias("title"))
    return R.appended(R.appended(have, new, "id"), new, "id")
