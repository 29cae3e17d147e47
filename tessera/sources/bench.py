"""The bench graph: nodes and edges of a typed property graph made from the driver's tables.

One table of SQL expressions defines it, read by both engines: `nodes` and `edges` give DataFrames, `ctes` the same as
text for a SQL oracle. Only the kinds a query names are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

NODE = ("id", "labels", "domain", "source", "name", "value")
EDGE = ("pos", "source", "target", "type", "kind", "confidence", "level", "okey", "part", "supp", "line", "qty")

#: table, then NODE's expressions; labels are named, most specific first or not, as graphs have them
NODES: dict[str, tuple[str, str, str, str, str, str, str]] = {
    "RG": ("region", "concat('RG:', r_regionkey)", "Region", "'geo.region'", "'tpc'", "r_name", "CAST(NULL AS DOUBLE)"),
    "NA": ("nation", "concat('NA:', n_nationkey)", "Nation", "'geo.nation'", "'tpc'", "n_name", "CAST(NULL AS DOUBLE)"),
    "CU": ("customer", "concat('CU:', c_custkey)", "Customer Entity", "concat('cust.', lower(c_mktsegment))", "'crm'", "c_name", "c_acctbal"),
    "SU": ("supplier", "concat('SU:', s_suppkey)", "Supplier Entity", "'supp'", "'crm'", "s_name", "s_acctbal"),
    "PA": ("part", "concat('PA:', p_partkey)", "Part Molecule", "concat('chem.', lower(p_type))", "p_brand", "p_name", "p_retailprice"),
    "OR": ("orders", "concat('OR:', o_orderkey)", "Order", "concat('order.', lower(o_orderpriority))", "concat('src', o_orderstatus)", "CAST(o_orderkey AS VARCHAR(20))", "o_totalprice"),
    "DE": ("documents WHERE lang = 'en'", "concat('DO:', doc_id)", "Document Formula", "'physics.text'", "source", "text", "CAST(n_chars AS DOUBLE)"),
    "DD": ("documents WHERE lang = 'de'", "concat('DO:', doc_id)", "Lemma Formula Document", "'math.text'", "source", "text", "CAST(n_chars AS DOUBLE)"),
    "DO": ("documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')", "concat('mx:', doc_id)", "Document", "CASE WHEN lang = 'fr' THEN 'biology.text' END", "source", "text", "CAST(n_chars AS DOUBLE)"),
    "US": ("(SELECT DISTINCT user_id FROM events) users", "concat('US:', user_id)", "User", "CAST(NULL AS VARCHAR(1))", "'log'", "concat('user ', user_id)", "CAST(NULL AS DOUBLE)"),
}
LEVEL = (
    "CASE concat(l_returnflag, l_linestatus) WHEN 'NO' THEN 'rule_checked' WHEN 'NF' THEN 'by_construction' WHEN 'AO' THEN 'source_asserted' "
    "WHEN 'AF' THEN 'model_inferred' WHEN 'RO' THEN 'cross_source' ELSE 'unverified' END"
)
_PLAIN = ("CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "CAST(NULL AS INT)", "CAST(NULL AS DOUBLE)")
EDGES: dict[str, tuple[str, ...]] = {
    "contains": ("lineitem", "l_orderkey * 10 + l_linenumber", "concat('OR:', l_orderkey)", "concat('PA:', l_partkey)", "'contains'", "l_returnflag", "1 - l_discount", LEVEL, "l_orderkey", "l_partkey", "l_suppkey", "CAST(l_linenumber AS INT)", "l_quantity"),
    "supplied_by": ("lineitem", "l_orderkey * 10 + l_linenumber", "concat('OR:', l_orderkey)", "concat('SU:', l_suppkey)", "'supplied_by'", "l_returnflag", "1 - l_discount", LEVEL, "l_orderkey", "l_partkey", "l_suppkey", "CAST(l_linenumber AS INT)", "l_quantity"),
    "placed_by": ("orders", "CAST(o_orderkey AS BIGINT)", "concat('OR:', o_orderkey)", "concat('CU:', o_custkey)", "'placed_by'", "o_orderstatus", "CAST(1 AS DOUBLE)", "'by_construction'", *_PLAIN),
    "cust_nation": ("customer", "CAST(c_custkey AS BIGINT)", "concat('CU:', c_custkey)", "concat('NA:', c_nationkey)", "'in_nation'", "'cust'", "CAST(1 AS DOUBLE)", "'by_construction'", *_PLAIN),
    "supp_nation": ("supplier", "CAST(s_suppkey AS BIGINT)", "concat('SU:', s_suppkey)", "concat('NA:', s_nationkey)", "'in_nation'", "'supp'", "CAST(1 AS DOUBLE)", "'by_construction'", *_PLAIN),
    "in_region": ("nation", "CAST(n_nationkey AS BIGINT)", "concat('NA:', n_nationkey)", "concat('RG:', n_regionkey)", "'in_region'", "'geo'", "CAST(1 AS DOUBLE)", "'human_reviewed'", *_PLAIN),
    "did": ("(SELECT DISTINCT user_id, event_type FROM events) did", "CAST(user_id AS BIGINT)", "concat('US:', user_id)", "concat('EV:', event_type)", "'did'", "'log'", "CAST(1 AS DOUBLE)", "'source_asserted'", *_PLAIN),
}
DOCUMENTS = ("DE", "DD", "DO")
GEO = ("cust_nation", "supp_nation", "in_region")


def _select(columns: tuple[str, ...], row: tuple[str, ...], array: str) -> str:
    table, *exprs = row
    cells = [f"{array}({', '.join(repr(w) for w in e.split())})" if c == "labels" else e for c, e in zip(columns, exprs)]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in zip(columns, cells))} FROM {table}"


def _frame(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], row: tuple[str, ...]) -> DataFrame:
    """The same select over parquet, without registering views."""
    sql = _select(columns, row, "array").replace("VARCHAR(20)", "STRING").replace("VARCHAR(1)", "STRING")
    name = next(t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "events") if f"FROM {t}" in sql)
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def nodes(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionAll, [_frame(spark, sf_dir, NODE, NODES[k]) for k in kinds or NODES])


def edges(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionAll, [_frame(spark, sf_dir, EDGE, EDGES[k]) for k in kinds])


def ctes(node_kinds: tuple[str, ...] = (), edge_kinds: tuple[str, ...] = ()) -> str:
    """WITH RECURSIVE n AS (...), e AS (...) for the oracle; what isn't named is left out."""
    parts = []
    if node_kinds:
        parts.append("n AS (" + " UNION ALL ".join(_select(NODE, NODES[k], "list_value") for k in node_kinds) + ")")
    if edge_kinds:
        parts.append("e AS (" + " UNION ALL ".join(_select(EDGE, EDGES[k], "list_value") for k in edge_kinds) + ")")
    return "WITH RECURSIVE " + ", ".join(parts) + " "
