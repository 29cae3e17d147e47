"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A document of a source whose target share is w and whose own size is z of all n characters is wanted w * n / z times
on average. A hash of seed and doc_id, read as a number in [0, 1), inverts the Poisson distribution of that mean: the count is the number of
its cumulated probabilities that the number reaches. Each document is exploded by its count and all copies are dealt
out by a hash of document and copy, which is also their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Above this rate a Poisson count is the sum of several of smaller rate, each with a hash of its own.
STEP = 100.0


def _number(*parts: Column | str) -> Column:
    """The first 48 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, rate, steps, cdf): mean repetitions of each source, in how many Poisson counts, and the cumulated probabilities of each.

    Sizes are characters plus one for each document. weights: target share by source, others get none; default: size to the
    `power`, which raises small sources. Null source is the source ''.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("double").alias("size"))
    if weights:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(named, "source", "left").fillna(0.0, ["weight"])
    else:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(power)))
    totals = sizes.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes")).first()
    share = F.lit(epochs) * F.col("weight") / F.lit(totals.weights or 1.0) * F.lit(totals.sizes or 0.0) / F.col("size")
    out = sizes.select("source", share.alias("rate")).withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    r = F.col("rate") / F.col("steps")
    start = F.struct((-r).alias("log"), F.array(F.exp(-r)).alias("cdf"))
    grow = lambda acc, k: F.struct((acc["log"] + F.ln(r) - F.ln(k)).alias("log"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["log"] + F.ln(r) - F.ln(k)))).alias("cdf"))
    most = F.ceil(r + 12 * F.sqrt(r) + 30).cast("int")
    cdf = F.when(r > 0, F.aggregate(F.sequence(F.lit(1), most), start, grow, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(2.0)))
    return out.select("source", "rate", "steps", cdf.alias("cdf"))


def copies(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """docs with columns copy (from 1) and shuffle_key, in a global random order: partitions are slices of the key's range, sorted in themselves.

    Rows that share a doc_id are repeated alike; null doc_id counts as ''. An empty table stays empty. All columns of docs are kept.
    """
    own = stored(rates(docs, weights, power, epochs).withColumnsRenamed({"source": "_mix_source", "steps": "_mix_steps", "cdf": "_mix_cdf"}).drop("rate"), "rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("_mix_steps")),
        F.lit(0),
        lambda n, i: n + F.size(F.filter("_mix_cdf", lambda p: p <= _number(F.lit(seed), i.cast("string"), name) / F.lit(float(1 << 48)))),
    )
    rows = docs.join(own, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_mix_source"))
    rows = rows.withColumn("_mix_count", count).where("_mix_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_count")))).drop("_mix_source", "_mix_steps", "_mix_cdf", "_mix_count")
    rows = rows.withColumn("shuffle_key", _number(F.lit(seed), F.lit("order"), name, F.col("copy").cast("string")))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slice_ = F.floor(F.col("shuffle_key") / F.lit(float(1 << 48)) * parts).cast("int")
    return rows.repartitionById(parts, slice_).sortWithinPartitions("shuffle_key")


#: Rows of copies() with default parameters, over the view documents.
ORACLE_SQL = """
WITH sizes AS (
  SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY 1
), weighted AS (
  SELECT source, size, pow(size, 0.7) AS weight FROM sizes
), rated AS (
  SELECT source, 1.0::DOUBLE * weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(size) FROM weighted) / size AS rate FROM weighted
), stepped AS (
  SELECT source, greatest(1, ceil(rate / 100.0))::INT AS steps, rate / greatest(1, ceil(rate / 100.0))::INT AS r FROM rated
), ks AS (
  SELECT source, steps, r, unnest(range(0, ceil(r + 12 * sqrt(r) + 30)::INT + 1)) AS k FROM stepped
), logs AS (
  SELECT source, steps, k, -r + sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(r) - ln(k) END) OVER (PARTITION BY source ORDER BY k) AS lp FROM ks
), cdf AS (
  SELECT source, steps, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs
), drawn AS (
  SELECT d.doc_id, coalesce(d.source, '') AS source, s.i,
         ('0x' || substr(md5('mix:' || s.i || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN (SELECT source, unnest(range(1, steps + 1)) AS i FROM stepped) s ON coalesce(d.source, '') = s.source
), counts AS (
  SELECT doc_id, w.source, count(*) AS n FROM drawn w JOIN cdf c ON w.source = c.source AND c.p <= w.u GROUP BY 1, 2
)
SELECT d.*, c.copy::INT AS copy,
       ('0x' || substr(md5('mix:order:' || coalesce(d.doc_id::VARCHAR, '') || ':' || c.copy), 1, 12))::BIGINT AS shuffle_key
FROM documents d
JOIN (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM counts) c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND coalesce(d.source, '') = c.source
"""
