"""Column expressions of the graph's vocabulary: types, subjects, trust levels, eras, text and units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of priority: main types of a node.
TYPE_PRIORITY = "Symbol Element Molecule Reaction FunctionalGroup Constant PhysicalQuantity Unit Paper WikidataEntity Definition Theorem Lemma Equation MathConcept Formula".split()
#: Subjects by prefix of the lower-case domain, then by namespace of the id.
SUBJECT_PREFIXES = {"化学": "chem ek bio", "物理": "phy pb", "数学": "math mx mg"}
SUBJECT_NAMESPACES = {"物理": "PQ PB CM QM TH EM OP SM RT UN SY CO FO", "化学": "EL EK EK2 IC BC RX OM MO PC CE RH CH", "数学": "MX MG MA MC NT PA", "跨学科": "WD"}
#: Subjects of slices by the domain's first part.
SLICE_DOMAINS = {"physics": "physics", "phys": "physics", "chem": "chemistry", "chemistry": "chemistry", "math": "math", "biology": "biology", "cross": "cross"}
#: Trust levels from rank 0.
LEVELS = "unverified model_inferred source_asserted by_construction rule_checked cross_source human_reviewed".split()
#: Kinds that are explicit.
EXPLICIT_KINDS = "explicit_citation defines reactant_of product_of part_of cites".split()
#: Edge types by priority when a neighbourhood is sampled (others 3).
EDGE_PRIORITY = {1: "has_quantity has_unit dimensionally_consistent uses_operator derived_from defines", 2: "same_as same_formula_as has_element related_to cites discusses", 4: "composed_of"}
#: Exponents of M L T I Th N A by unit.
UNITS = {
    "kg": "M1", "m": "L1", "s": "T1", "j": "M1 L2 T-2", "m/s": "L1 T-1", "m/s^2": "L1 T-2", "n": "M1 L1 T-2", "w": "M1 L2 T-3", "pa": "M1 L-1 T-2", "k": "Th1", "m^3": "L3", "mol": "N1",
    "j/k": "M1 L2 T-2 Th-1", "j/(mol*k)": "M1 L2 T-2 Th-1 N-1", "j/mol*k": "M1 L2 T-2 Th-1 N-1", "c": "T1 I1", "v": "M1 L2 T-3 I-1", "a": "I1", "ohm": "M1 L2 T-3 I-2", "f": "M-1 L-2 T4 I2", "t": "M1 T-2 I-1", "h": "M1 L2 T-2 I-2",
    "wb": "M1 L2 T-2 I-1", "hz": "T-1", "ev": "M1 L2 T-2", "m^2": "L2", "rad": "A1", "mol/l": "L-3 N1",
}


def one_of(column: Column, groups: dict[str, str], found: Column | None = None) -> Column:
    """The key of the group whose words hold the column's value; otherwise found."""
    out = None
    for key, words in groups.items():
        test = column.isin(*words.split())
        out = F.when(test, F.lit(key)) if out is None else out.when(test, F.lit(key))
    return out.otherwise(found) if found is not None else out


def pick_type(labels: Column) -> Column:
    """The first of the priority list among labels, else the first label, else Unknown."""
    ranked = F.array_intersect(F.array(*map(F.lit, TYPE_PRIORITY)), labels)
    return F.coalesce(F.get(ranked, F.lit(0)), F.get(labels, F.lit(0)), F.lit("Unknown"))


def namespace(id_: Column) -> Column:
    return F.split_part(id_, F.lit(":"), F.lit(1))


def subject_of(domain: Column, id_: Column) -> Column:
    """Subject by the domain's prefix; of a domain with another prefix: between subjects; without one: by the id's namespace."""
    d = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    by_prefix = None
    for subject, prefixes in SUBJECT_PREFIXES.items():
        test = reduce(lambda a, b: a | b, [d.startswith(p) for p in prefixes.split()])
        by_prefix = F.when(test, F.lit(subject)) if by_prefix is None else by_prefix.when(test, F.lit(subject))
    return by_prefix.when(d != "", F.lit("跨学科")).otherwise(one_of(F.upper(namespace(id_)), SUBJECT_NAMESPACES, F.lit("数学")))


def slice_domain(domain: Column) -> Column:
    top = F.split_part(F.trim(domain), F.lit("."), F.lit(1))
    mapped = None
    for key, value in SLICE_DOMAINS.items():
        mapped = F.when(top == key, F.lit(value)) if mapped is None else mapped.when(top == key, F.lit(value))
    return mapped.otherwise(F.lit("unclassified"))


def level_rank(level: Column) -> Column:
    """0 to 6; -1 for an unknown or missing level."""
    out = None
    for rank, name in enumerate(LEVELS):
        out = F.when(level == name, F.lit(rank)) if out is None else out.when(level == name, F.lit(rank))
    return out.otherwise(F.lit(-1))


def verified(level: Column, legacy: Column | None = None) -> Column:
    by_rank = level_rank(level) >= 3
    return F.when(level.isNull(), F.coalesce(legacy, F.lit(False))).otherwise(by_rank) if legacy is not None else by_rank


def strict(level: Column) -> Column:
    return level_rank(level) >= 4


def explicit_or_inferred(given: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), F.when(kind.isin(*EXPLICIT_KINDS), "explicit").otherwise("inferred"))


def edge_priority(type_: Column, cross: Column) -> Column:
    return F.when(cross, 0).otherwise(one_of(type_, {k: v for k, v in EDGE_PRIORITY.items()}, F.lit(3)).cast("int"))


def era(time: Column) -> Column:
    """Era of a discovery time: centuries before 1900, decades from then on; anything that isn't a year has none."""
    t = F.trim(time)
    number = lambda pattern: F.try_to_number(F.regexp_extract(t, pattern, 1), F.lit("9999")).cast("int")
    century = lambda y: F.ceil(y / 100).cast("string")
    year = number(r"^(\d{4})$")
    decade = (F.floor(year / 10) * 10).cast("int")
    return (
        F.when(t.rlike(r"^公元前 \d{1,4}$"), F.concat(F.lit("公元前 "), century(number(r"^公元前 (\d{1,4})$")), F.lit(" 世纪")))
        .when(t.rlike(r"^公元 \d{1,3}$"), F.concat(century(number(r"^公元 (\d{1,3})$")), F.lit(" 世纪")))
        .when(t.rlike(r"^\d{4}$") & (year < 1900), F.concat(century(year), F.lit(" 世纪")))
        .when(t.rlike(r"^\d{4}$"), F.concat(decade.cast("string"), F.lit("–"), (decade + 9).cast("string")))
        .otherwise(F.lit("暂无"))
    )


def era_key(name: Column) -> Column:
    """A number that orders eras; none comes last (null)."""
    n = lambda pattern: F.try_to_number(F.regexp_extract(name, pattern, 1), F.lit("9999")).cast("int")
    return (
        F.when(name.rlike(r"^公元前 \d+ 世纪$"), -100 * n(r"^公元前 (\d+) 世纪$"))
        .when(name.rlike(r"^\d{1,4} 世纪$"), (n(r"^(\d{1,4}) 世纪$") - 1) * 100 + 1)
        .when(name.rlike(r"^\d{4}–\d{4}$"), n(r"^(\d{4})–"))
    )


def token_line(text: Column) -> Column:
    """Words of a name, joined by spaces: dashes fold, possessives and brackets go, hyphens join."""
    t = F.translate(text, "–—−’", "---'")
    t = F.regexp_replace(F.regexp_replace(t, r"'s([^A-Za-z]|$)", " $1"), r"\([^)]*\)", " ")
    t = F.regexp_replace(F.regexp_replace(F.lower(t), r"(\w)-(?=\w)", "$1"), r"[^0-9a-z_à-ÿ]+", " ")
    return F.trim(t)


def holds_tokens(line: Column, wanted: Column) -> Column:
    """Whether the words wanted follow each other in a line of words."""
    return F.concat(F.lit(" "), line, F.lit(" ")).contains(F.concat(F.lit(" "), wanted, F.lit(" ")))


def latex_plain(text: Column) -> Column:
    """Wrapping commands give way to what they wrap, four deep; other commands to their names; braces, dollars and space go."""
    wrap = r"\\(?:mathrm|text|operatorname|mbox|textrm|mathbf|mathit|mathcal|mathsf|mathtt|mathbb)\s*\{([^{}]*)\}"
    for _ in range(4):
        text = F.regexp_replace(text, wrap, "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\\([A-Za-z]+)", "$1"), r"[\\{}$\s]+", "")


def has_symbol(text: Column, declared: Column, symbol: Column) -> Column:
    """Whether an expression or its declared symbols hold a symbol or its base before `_`; null if there is neither."""
    base = F.regexp_extract(symbol, r"^(.+?)_\{?(.+?)\}?$", 1)
    cands = F.filter(F.array(F.trim(symbol), F.nullif(base, F.lit(""))), lambda c: c.isNotNull() & (c != ""))
    plain = latex_plain(text)
    found = F.exists(cands, lambda c: F.coalesce(F.array_contains(declared, c), F.lit(False)) | plain.contains(latex_plain(c)))
    return F.when(F.coalesce(symbol, F.lit("")) == "", None).when(F.coalesce(text, F.lit("")) == "", None).otherwise(found)


def unit_dimension(unit: Column) -> Column:
    """Exponents of a unit's dimension, as text; null if the unit isn't known."""
    plain = F.replace(F.regexp_replace(F.lower(F.trim(unit)), " ", ""), F.lit("·"), F.lit("*"))
    bare = F.regexp_replace(plain, r"[()]", "")
    known = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.element_at(known, plain), F.element_at(known, bare))


def doi(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def doi_valid(text: Column) -> Column:
    return doi(text).rlike(r"^10\.\d{4,9}/\S+$")


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """Half-even rounded percentage, zero of nothing."""
    return F.coalesce(F.bround(100.0 * part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def digest(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def blank_as_null(text: Column) -> Column:
    """Blank text and placeholders are no data."""
    t = F.trim(text)
    return F.when(t.isin("", "暂无", "null", "None", "N/A", "-"), None).otherwise(t)
