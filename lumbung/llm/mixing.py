"""Mixing sources to target weights by Poisson replication.

A source whose target share is w of a total mass T, and whose own mass is m, should be repeated w * T / m times on
average. Each document's number of copies is the inverse of that Poisson distribution at a uniform number hashed
from its id, so any part of the data can be drawn again alone and repeats by chance neither vanish nor pile up.
Copies are then put in a global random order: each has a hashed key, is dealt out by it and sorted by it.

Rates are rounded to nine significant digits, so that a small one stays positive and any engine gets the same one.
A source's mass is the code points of its texts, over all documents. A null source is a source of its own, a null or
empty text has no mass; a source without mass gets a rate of 1. Rows that repeat an id share its number; a null
id is replaced by the text's digest. A source with weight 0 gives no rows, as does an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm.common import documents, materialise, text_of

#: Weights are a source's share of the mass to this power where none are given.
TEMPERATURE = 0.5
SEED = 7


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total_mass: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """One row a source: source, mass, rate and cdf, the distribution function of the copies from 0 until it is 1."""
    spark = docs.sparkSession
    sums = materialise(docs.groupBy("source").agg(F.sum(F.length(text_of(docs))).cast("bigint").alias("mass")), "mixing-mass")
    if weights is None:
        weighed = sums.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double").withColumnRenamed("source", "__source")
        weighed = sums.join(given, F.expr("source <=> __source"), "left").drop("__source").na.fill(0.0, ["weight"])
    all_weight, all_mass = weighed.agg(F.sum("weight"), F.sum("mass")).first()
    target = float(total_mass if total_mass is not None else all_mass or 0)
    exact = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(target) / F.col("mass")
    digits = F.pow(F.lit(10.0), 8 - F.floor(F.log10(exact)))
    rate = F.when(F.col("mass") == 0, 1.0).when(exact > 0, F.round(exact * digits) / digits).otherwise(0.0)
    out = weighed.select("source", "mass", rate.alias("rate"))
    # terms of the distribution from their logarithms, so that no rate is too large
    last = (F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    term = lambda a, k: a["log"] + F.ln("rate") - F.ln(k.cast("double"))
    step = lambda a, k: F.struct(term(a, k).alias("log"), (a["sum"] + F.exp(term(a, k))).alias("sum"), F.array_append(a["cdf"], a["sum"] + F.exp(term(a, k))).alias("cdf"))
    first = F.struct((-F.col("rate")).alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), first, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))
    return out.withColumn("cdf", cdf)


def _hash52(*parts: object) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")


def mix(docs: DataFrame, carry: tuple[str, ...], weights: dict[str | None, float] | None = None, total_mass: float | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The carried columns of every copy with copy_no (from 1), rate and mix_key, in the order of mix_key within random partitions."""
    table = materialise(rates(docs, weights, total_mass, temperature), "mixing-rates").withColumnRenamed("source", "__source")
    key = F.coalesce(docs["doc_id"].cast("string"), F.md5(text_of(docs)))
    rows = docs.select(*[docs[c] for c in dict.fromkeys((*carry, "source"))], key.alias("__key"))
    joined = rows.join(table.select("__source", "rate", "cdf"), F.expr("source <=> __source"))
    uniform = _hash52(F.lit(str(seed)), F.lit("copies"), "__key") / F.lit(float(1 << 52))
    joined = joined.withColumn("__u", uniform).withColumn("__n", F.size(F.filter("cdf", lambda c: F.col("__u") >= c)))
    copies = joined.where("__n > 0").select(*carry, "__key", "rate", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy_no"))
    keyed = copies.select(*carry, "copy_no", "rate", _hash52(F.lit(str(seed)), F.lit("order"), "__key", F.col("copy_no").cast("string")).alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of ``documents`` at the default temperature, with their texts, in random order."""
    return mix(documents(spark, sf_dir), ("doc_id", "source", "text"))


OP7_SQL = r"""
WITH m AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS mass FROM documents GROUP BY source),
w AS (SELECT source, mass, pow(CAST(mass AS DOUBLE), 0.5) AS weight FROM m),
r AS (
  SELECT source, CASE WHEN mass = 0 THEN 1.0 ELSE round(exact * pow(10.0, 8 - floor(log10(exact)))) / pow(10.0, 8 - floor(log10(exact))) END AS rate
  FROM (SELECT source, mass, weight / (SELECT sum(weight) FROM w) * CAST((SELECT sum(mass) FROM w) AS DOUBLE) / mass AS exact FROM w)),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS term FROM r, range(0, 100) AS g(k)),
cdf AS (SELECT source, rate, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
u AS (
  SELECT doc_id, source, text,
         CAST('0x' || substr(md5('7:copies:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents),
n AS (
  SELECT u.doc_id, u.source, u.text, cdf.rate, count(*) FILTER (WHERE u.u >= cdf.c) AS n
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL)
SELECT doc_id, source, text, CAST(copy_no AS INTEGER) AS copy_no, rate,
       CAST('0x' || substr(md5('7:order:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy_no AS VARCHAR)), 1, 13) AS BIGINT) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM n)
"""
