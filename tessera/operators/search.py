"""Text search and detail of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relations as R


def scored(nodes: DataFrame, query: str, least: int = 2) -> DataFrame:
    """Nodes (id, name) that match, with a score: id 100, name 90, start of the name 70, a word of it 60, inside it 40; a shorter query finds nothing."""
    q = query.strip().lower()
    name = F.lower("name")
    score = (
        F.when(F.lower("id") == q, 100)
        .when(name == q, 90)
        .when(name.startswith(q), 70)
        .when(F.concat(F.lit(" "), name, F.lit(" ")).contains(f" {q} "), 60)
        .when(name.contains(q), 40)
    )
    rows = nodes.withColumn("score", score if len(q) >= least else F.lit(None).cast("int"))
    return rows.where(F.col("score").isNotNull())


def hits(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best hits (score, then id) with the number of all."""
    return R.budgeted(scored(nodes, query), [F.desc("score"), F.col("id")], limit).withColumnRenamed("before", "total_matches")


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of a lower-cased text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def postings(nodes: DataFrame) -> DataFrame:
    """(gram, id): the index of a trigram search; stored by gram it is read in part."""
    return nodes.select("id", F.explode(trigrams(F.col("name"))).alias("gram"))


def by_trigrams(nodes: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """Nodes whose name holds the query: the postings of its trigrams, filtered by gram, name the candidates, whose names alone are read; under three letters by a scan.

    A name may hold all trigrams apart, so candidates are verified. Rows that share an id are verified each.
    """
    q = query.lower()
    if len(q) < 3:
        return nodes.where(F.lower("name").contains(q))
    grams = sorted({q[k : k + 3] for k in range(len(q) - 2)})
    ids = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")
    return nodes.join(ids, "id", "left_semi").where(F.lower("name").contains(q))


def any_field(nodes: DataFrame, query: str, *fields: str) -> DataFrame:
    """Nodes that hold the query in one of the fields; a blank query, or one of over 100 characters, is refused."""
    q = query.strip().lower()
    if not 0 < len(q) <= 100:
        raise ValueError("a query has 1 to 100 characters")
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.lower(f).contains(q), F.lit(False))
    return nodes.where(found)


def layered(nodes: DataFrame, query: str, aliases: DataFrame, index: DataFrame, most: int = 200) -> DataFrame:
    """(id, reason) by layers: identity, dictionary (alias, id), text; a node keeps its first reason, a layer gives `most` rows at most."""
    q = query.strip()
    same = nodes.where((F.col("id") == q) | (F.lower("name") == q.lower())).select("id")
    named = aliases.where(F.lit(q.lower()).contains(F.lower("alias"))).select("id").join(nodes.select("id"), "id", "left_semi")
    text = by_trigrams(nodes, index, q).select("id")
    layers = [f.distinct().orderBy("id").limit(most).select("id", F.lit(k).alias("layer"), F.lit(r).alias("reason")) for k, (r, f) in enumerate((("identity", same), ("dictionary", named), ("text", text)))]
    rows = layers[0].unionAll(layers[1]).unionAll(layers[2])
    return rows.groupBy("id").agg(F.min_by("reason", "layer").alias("reason"))


def overlap(x: Column, y: Column) -> Column:
    """Common part of two lists' distinct items; of two empty ones 0."""
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def link_score(label: Column, name: Column, symbols: tuple[Column, Column], definitions: tuple[Column, Column], domains: tuple[Column, Column]) -> Column:
    """Weighted likeness of a mention and a node: label 0.4, symbols 0.1, words of the definitions 0.3, and 0.2 for the same domain."""
    a, b = F.lower(label), F.lower(name)
    close = 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    words = overlap(*(F.split(F.lower(d), " ") for d in definitions))
    return F.lit(0.4) * close + F.lit(0.1) * overlap(*symbols) + F.lit(0.3) * words + F.lit(0.2) * F.coalesce((domains[0] == domains[1]).cast("double"), F.lit(0.0))
