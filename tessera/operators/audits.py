"""Audits and requests: dimension vectors, expression evidence, reaction sides, residues, sanitised properties, requests and their answers."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

#: The order of base dimensions in a vector.
BASES = ["M", "L", "T", "I", "Th", "N", "A"]
#: Dimensions of quantities by name, and of the classes that a rationale may declare.
QUANTITIES = {"energy": "M1 L2 T-2", "mass": "M1", "molar_mass": "M1 N-1", "length": "L1", "time": "T1", "force": "M1 L1 T-2", "entropy": "M1 L2 T-2 Th-1"}
CLASSES = {"质量": "M1", "能量": "M1 L2 T-2", "长度": "L1", "时间": "T1"}
#: Operators in an expression, and the concepts whose bridges they are evidence of.
OPERATORS = {"nabla": ["MC:gradient", "MC:divergence"], "int": ["MC:integral"], "partial": ["MC:derivative"]}
#: Parameters of a request that don't change its result.
SESSION_KEYS = ["session_id", "reset", "expand_token"]
#: Hard limits of a request.
LIMITS = {"hops": 5, "nodes": 5_000, "edges": 20_000, "paths": 200}


def mapped(column: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def canonical_dimension(vector: Column) -> Column:
    """A dimension vector in the fixed order of bases, zero exponents left out; a unit's symbol gives its dimension, anything else null."""
    parts = F.filter(F.split(F.trim(vector), r"\s+"), lambda p: p != "")

    def of(base: str) -> Column:
        return F.get(F.filter(parts, lambda p: p.rlike(f"^{base}-?[0-9]+$") & ~p.rlike("[A-Za-z]-?0+$")), F.lit(0))

    ordered = [of(base) for base in BASES]
    fits = F.forall(parts, lambda p: p.rlike(rf"^({'|'.join(BASES)})-?[0-9]+$"))
    return F.when(fits, F.concat_ws(" ", *ordered)).otherwise(expr.unit_dimension(vector))


def dimension_fields(props: Column) -> Column:
    """What a property map (JSON text) says of dimensions: COLLISION, UNIT_SYMBOL_IN_DIM, SEPARATED or NO_DIM_FIELD."""
    keys, vector = F.json_object_keys(props), F.get_json_object(props, "$.dimension_vector")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    clean = F.coalesce(canonical_dimension(vector) == F.trim(vector), F.lit(False))
    return F.when(has("dimension"), "COLLISION").when(has("dimension_vector"), F.when(clean, "SEPARATED").otherwise("UNIT_SYMBOL_IN_DIM")).when(has("exponent_in_term"), "SEPARATED").otherwise("NO_DIM_FIELD")


def is_molar_mass(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", " ")
    return plain.rlike("^(molar mass|molecular (mass|weight))$") | plain.contains("摩尔质量")


def dimension_mismatches(edges: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Edges whose ends (dimensions: id, dim) both have a known dimension and not the same one."""
    known = dimensions.where("dim IS NOT NULL")
    s, t = (known.select(F.col("id").alias(end), F.col("dim").alias(f"{end}_dim")) for end in ("source", "target"))
    return edges.join(s, "source").join(t, "target").where("source_dim <> target_dim")


def class_fits(rationale: Column, dim: Column) -> Column:
    """Whether a target's dimension is that of the class its rationale declares, per mole or not; a stated molar mass declares mass; null if either isn't known."""
    declared = F.coalesce(F.nullif(F.regexp_extract(rationale, "属(.+?)类", 1), F.lit("")), F.when(rationale.rlike(r"摩尔质量\s*[0-9.]+\s*g/mol"), "质量"))
    want = mapped(declared, CLASSES)
    return (dim == want) | (dim == F.concat(want, F.lit(" N-1")))


def operator_evidence(expression: Column, target: Column) -> Column:
    """Whether an expression holds an operator that is evidence of a bridge to the target."""
    found = F.lit(False)
    for operator, targets in OPERATORS.items():
        found = found | (expression.rlike(rf"\\{operator}([^A-Za-z]|$)") & target.isin(*targets))
    return F.coalesce(found, F.lit(False))


def canonical_term(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)", ""), "[ +-]", "")


def on_its_side(equation: Column, label: Column, formula: Column, synonyms: Column, reactant: Column) -> Column:
    """Whether a substance stands on its side of a reaction alone: true, false on the other alone, null if that can't be told.

    Its label decides, else its formula, else its synonyms, which can only say true.
    """
    sides = F.split(equation, " = ", 2)
    terms = lambda k: F.transform(F.filter(F.split(F.get(sides, F.lit(k)), r" \+ "), lambda x: F.trim(x) != ""), canonical_term)
    own, other = F.when(reactant, terms(0)).otherwise(terms(1)), F.when(reactant, terms(1)).otherwise(terms(0))
    has = lambda side, x: F.coalesce((x != "") & F.array_contains(side, x), F.lit(False))
    times = lambda x: F.size(F.filter(own, lambda t: t == x))
    name, plain = canonical_term(label), canonical_term(formula)
    also = F.filter(F.transform(F.coalesce(synonyms, F.array().cast("array<string>")), canonical_term), lambda x: (F.char_length(x) >= 2) & (x != F.coalesce(name, F.lit(""))))
    here, there = F.filter(also, lambda x: has(own, x)), F.filter(also, lambda x: has(other, x))
    first = F.get(here, F.lit(0))
    by_synonym = F.when((F.size(here) > 0) & (F.size(there) == 0) & (times(first) == 1), True)
    by_formula = F.when(has(own, plain) & has(other, plain), None).when(has(other, plain), False).when(has(own, plain), F.when(times(plain) == 1, True)).otherwise(by_synonym)
    by_label = F.when(has(own, name) & has(other, name), None).when(has(other, name), False).when(has(own, name), True).otherwise(by_formula)
    return F.when(F.size(sides) == 2, by_label)


def _is_literal(texts: pd.Series) -> pd.Series:
    import ast
    import json

    def residue(t: str | None) -> bool:
        if t is None:
            return False
        try:
            json.loads(t)
            return False
        except ValueError:
            pass
        try:
            return isinstance(ast.literal_eval(t), (list, dict))
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return False

    return texts.map(residue).astype(bool)


def printed_container(text: Column) -> Column:
    """Whether a text is a list or dictionary as printed by a program, which isn't JSON; only texts in brackets reach Python."""
    t = F.trim(text)
    return F.pandas_udf(_is_literal, "boolean")(F.when((F.char_length(t) >= 3) & (t.rlike(r"(?s)^\[.*\]$") | t.rlike(r"(?s)^\{.*\}$")), t))


def _fold(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()).casefold())


def folded(text: Column) -> Column:
    """Compatibility form, without white space, case folded; Spark has no such function."""
    return F.pandas_udf(_fold, "string")(text)


def sanitised(rows: DataFrame, props: str) -> tuple[DataFrame, DataFrame]:
    """Rows with column `safe` (map of texts), where objects and mixed lists of a JSON property map are JSON text; and (key, kind, n) of what was changed."""
    values = rows.select("id", F.explode_outer(F.from_json(props, "map<string,variant>")).alias("key", "v")).withColumn("schema", F.schema_of_variant("v"))
    mixed = F.col("schema").rlike("^ARRAY<(OBJECT|ARRAY|VARIANT)")
    kind = F.when(F.col("schema").startswith("OBJECT"), "dict").when(mixed, "list<non-primitive>")
    changed = values.select("key", kind.alias("kind")).where("kind IS NOT NULL").groupBy("key", "kind").agg(F.count("*").alias("n"))
    text = F.coalesce(F.expr("try_variant_get(v, '$', 'string')"), F.to_json("v"))
    safe = values.where("key IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", text.alias("value"))))).alias("safe"))
    return safe, changed


def request_text(params: Column) -> Column:
    """A map of parameters in canonical form: keys in order, empty values and session keys left out."""
    kept = F.map_filter(params, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~k.isin(*SESSION_KEYS))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), F.to_json(F.array(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.regexp_replace(p, r'^\["(.*)"\]:\["(.*)"\]$', '"$1":"$2"')), ","), F.lit("}"))


def path_items(item: Column) -> tuple[Column, Column]:
    """Node ids and edge ids of a path, given as a JSON list of ids or as {nodes, edges}; a bare list has no edges."""
    bare = F.from_json(item, "array<string>")
    nodes, edges = (F.from_json(F.get_json_object(item, f"$.{k}"), "array<string>") for k in ("nodes", "edges"))
    none = F.array().cast("array<string>")
    listed = F.trim(item).startswith("[")
    return F.when(listed, F.coalesce(bare, none)).otherwise(F.coalesce(nodes, none)), F.when(listed, none).otherwise(F.coalesce(edges, none))


def clamped(asked: Column, name: str) -> tuple[Column, Column]:
    """The value that is used for a parameter, 1 at least and its hard limit at most, and by what it was cut (null: not)."""
    most = LIMITS[name]
    return F.least(F.greatest(asked, F.lit(1)), F.lit(most)), F.when(asked > most, F.lit(name))


def truncation_text(shown: Column, before: Column, by: str) -> Column:
    """What is shown of how much, in words; an unknown total is said to be unknown."""
    return F.when(before.isNull(), F.concat(F.lit(f"已截断（{by}）："), shown.cast("string"), F.lit(" 边（实有规模未知）"))).otherwise(F.concat(F.lit(f"已截断（{by}）：显示 "), shown.cast("string"), F.lit(" 边，实有 "), before.cast("string"), F.lit(" 边")))


def strict_predicate(rows: DataFrame, test: str) -> DataFrame:
    """Rows for which a boolean column is true; any other type of column is refused, as 'false' would pass for true."""
    if dict(rows.dtypes).get(test) != "boolean":
        raise TypeError(f"{test} is {dict(rows.dtypes).get(test)}, not boolean")
    return rows.where(F.coalesce(F.col(test), F.lit(False)))


@dataclass
class Answer:
    """status ok, no_result, truncated or error; the code and message of an error; what was asked against what was used; nodes and edges."""

    status: str
    code: str | None = None
    message: str | None = None
    clamps: dict[str, tuple[int, int]] = field(default_factory=dict)
    before: int | None = None
    truncated_by: str | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass
class Request:
    """A subgraph request: mode ego, path or filter, and its parameters."""

    mode: str = "ego"
    seeds: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    hops: int = 2
    max_nodes: int = 40
    max_edges: int = 70

    def refused(self) -> str | None:
        """Why the request can't be answered, if so; a filter without a condition would be the whole graph."""
        if self.mode not in ("ego", "path", "filter"):
            return f"unknown mode {self.mode}"
        if self.mode == "filter" and not any(map(str.strip, (*self.types, *self.kinds))):
            return "a filter needs a condition"
        if self.mode == "path" and len(self.seeds) != 2:
            return f"a path needs two seeds, not {len(self.seeds)}"
        return "no seed" if self.mode == "ego" and not self.seeds else None


def answered(edges: DataFrame, request: Request) -> Answer:
    """The answer to a request over edges (source, target, type, kind, pos), with every clamp and truncation told."""
    from . import relations as R
    from . import traverse as T

    if why := request.refused():
        return Answer("error", "BAD_REQUEST", why)
    used = {k: min(max(1, v), LIMITS[n]) for k, n, v in (("hops", "hops", request.hops), ("max_nodes", "nodes", request.max_nodes), ("max_edges", "edges", request.max_edges))}
    clamps = {k: (getattr(request, k), v) for k, v in used.items() if getattr(request, k) != v}
    fits = R.of_types(edges, [*request.types] or None, [*request.kinds] or None)
    if request.mode == "path":
        found = path_edges(T.paths(fits, *request.seeds, used["hops"]), fits)
    elif request.mode == "ego":
        seeds = edges.sparkSession.createDataFrame([(s,) for s in request.seeds], "id string")
        found = R.between(fits, T.ego(fits, seeds, used["hops"]))
    else:
        found = fits
    before = found.count()
    kept = found.orderBy("source", "target", "type", "pos").limit(used["max_edges"])
    by = "max_edges" if before > used["max_edges"] else "hops" if "hops" in clamps else None
    status = "no_result" if not before else "truncated" if by else "ok"
    nodes = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return Answer(status, None, None, clamps, before, by, nodes, kept)


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that paths (column path, ids joined by '>') run along, in either direction, each once."""
    ids = F.split("path", ">")
    steps = paths.select(F.explode(F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1), lambda a, b: F.struct(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")))).alias("s")).select("s.*").distinct()
    return edges.withColumns({"_a": F.least("source", "target"), "_b": F.greatest("source", "target")}).join(steps, ["_a", "_b"], "left_semi").drop("_a", "_b")


class SnapshotCache:
    """Results kept by name for one snapshot id; of several callers that ask at once one computes and the others wait. Another snapshot drops all."""

    def __init__(self):
        self._lock, self._snapshot, self._kept, self.computed = threading.RLock(), None, {}, 0

    def get(self, snapshot: str, name: str, make: Callable[[], object]) -> object:
        with self._lock:
            if snapshot != self._snapshot:
                self._snapshot, self._kept = snapshot, {}
            lock = self._kept.setdefault(name, [threading.Lock(), None, False])
        with lock[0]:
            if not lock[2]:
                lock[1], lock[2] = make(), True
                self.computed += 1
            return lock[1]


def map_numbers_agree(reaction: Column) -> Column:
    """Whether the atoms of a mapped reaction (a>>b) bear the same numbers on both sides, each once; null without two sides or numbers."""
    sides = F.split(reaction, ">>")
    numbers = lambda k: F.array_sort(F.regexp_extract_all(F.get(sides, F.lit(k)), F.lit(r":(\d+)\]"), F.lit(1)))
    a, b = numbers(0), numbers(1)
    return F.when((F.size(sides) == 2) & (F.size(a) + F.size(b) > 0), (a == b) & (F.size(F.array_distinct(a)) == F.size(a)))


def verified_dataset(nodes: DataFrame, edges: DataFrame, manifest: DataFrame, allowed: list[str]) -> DataFrame:
    """(rule, violations) of a data set: nodes (id, labels, source), edges (id, source, target, type, grade), manifest (part, n)."""
    ids = nodes.select("id").distinct()
    count = lambda rows, rule: rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))
    declared = manifest.join(nodes.agg(F.lit("nodes").alias("part"), F.count("*").alias("m")).unionAll(edges.agg(F.lit("edges").alias("part"), F.count("*").alias("m"))), "part", "full")
    found = [
        count(nodes.groupBy("id").count().where("count > 1"), "V1 node ids"),
        count(edges.groupBy("id").count().where("count > 1"), "V2 edge ids"),
        count(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti"), "V3 sources"),
        count(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"), "V4 targets"),
        count(declared.where("NOT (n <=> m)"), "V5 manifest counts"),
        count(nodes.where("labels IS NULL OR size(labels) = 0"), "V6 labels"),
        count(nodes.where(F.col("source").isNull() | ~F.col("source").isin(*allowed)), "V7 licences"),
        count(edges.where("grade IS NULL OR grade NOT BETWEEN 1 AND 5"), "V8 grades"),
        count(edges.where("coalesce(trim(type), '') = ''"), "V9 types"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out
