"""Word scores from co-occurrence with seeds, and their bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbung.config import LexiconConfig


def token_frequency(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents' token arrays."""
    return docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_tokens(docs: DataFrame, kept: list[str], least: int = 2) -> DataFrame:
    """Documents without tokens rarer than ``least``, kept ones and pairs with a negation apart."""
    rare = token_frequency(docs).where(F.col("n") < least).where(~F.col("word").isin(*kept)).where(~F.col("word").rlike("^(?:tidak|bukan|belum)_"))
    each = docs.select("doc_id", F.posexplode("tokens").alias("at", "word")).join(rare, "word", "left_anti")
    back = each.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("tokens"))
    return docs.drop("tokens").join(back, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def _hits(seeds: list[str], window: int):
    """(word, seed) for each place where a seed stands within the window of a word of ``tokens``."""
    low = lambda i: F.greatest(F.lit(1), i + 1 - window)
    around = lambda i: F.concat(F.slice(F.col("tokens"), low(i), i + 1 - low(i)), F.slice(F.col("tokens"), i + 2, window))
    places = F.filter(F.transform("tokens", lambda w, i: F.struct(w.alias("seed"), i.alias("i"))), lambda s: s["seed"].isin(*seeds))
    return F.flatten(F.transform(places, lambda s: F.transform(around(s["i"]), lambda x: F.struct(x.alias("word"), s["seed"].alias("seed")))))


def near_seeds(docs: DataFrame, seeds: list[str], window: int) -> DataFrame:
    """(doc_id, word, seed, n): how often a seed stands within the window of a word.

    Only seeds are looked for, in each row's own array, so no pair of other words is made; counts are added up in the
    document before they leave it.
    """
    return docs.select("doc_id", F.explode(_hits(seeds, window)).alias("x")).groupBy("doc_id", "x.word", "x.seed").agg(F.count("*").alias("n"))


def joint_counts(docs: DataFrame, seeds: list[str], window: int) -> DataFrame:
    """(word, seed, joint): how often they stand near each other in all documents, added up before any exchange."""
    return docs.select(F.explode(_hits(seeds, window)).alias("x")).groupBy("x.word", "x.seed").agg(F.count("*").alias("joint"))


def _orientation(words: DataFrame, joint: DataFrame, total: DataFrame, genuine: list[str], counterfeit: list[str], config: LexiconConfig, by: list[str]) -> DataFrame:
    """Mean PMI with genuine seeds less that with counterfeit ones; a pair that never meets counts 0."""
    seed = words.select(*by, F.col("word").alias("seed"), F.col("n").alias("n_seed"))
    pmi = joint.join(words.where(F.col("n") >= config.min_count), [*by, "word"]).join(seed, [*by, "seed"])
    pmi = pmi.join(total, by) if by else pmi.join(total)
    pmi = pmi.withColumn("pmi", F.ln(F.col("joint").cast("double") * F.col("total") / (F.col("n").cast("double") * F.col("n_seed"))))
    mean = lambda s: F.coalesce(F.sum(F.when(F.col("seed").isin(*s), F.col("pmi"))), F.lit(0.0)) / max(len(s), 1)
    scored = pmi.groupBy(*by, "word").agg((mean(genuine) - mean(counterfeit)).alias("so"))
    return words.where(F.col("n") >= config.min_count).join(scored, [*by, "word"], "left").select(*by, "word", "n", F.coalesce("so", F.lit(0.0)).alias("so"))


def semantic_orientation(docs: DataFrame, genuine: list[str], counterfeit: list[str], config: LexiconConfig | None = None) -> DataFrame:
    """(word, n, so) of words that occur often enough."""
    config = config or LexiconConfig()
    words = token_frequency(docs)
    joint = joint_counts(docs, [*genuine, *counterfeit], config.window)
    return _orientation(words, joint, words.agg(F.sum("n").alias("total")), genuine, counterfeit, config, [])


def bootstrap(docs: DataFrame, genuine: list[str], counterfeit: list[str], config: LexiconConfig | None = None, seed: int = 42) -> DataFrame:
    """(word, so, low, high, label): percentile intervals over resampled documents.

    A document's number of appearances in a resample comes from 52 bits of md5(seed:iteration:document), as a Poisson
    number of mean 1, the limit of drawing with replacement; so resamples need no order of documents and repeat anywhere.
    """
    config = config or LexiconConfig()
    bounds, term, total = [], 2.718281828459045**-1, 0.0
    for k in range(12):
        total += term
        bounds.append(total)
        term /= k + 1

    def times(i: int):
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
        return sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))

    # a document's appearances in all resamples travel with it, the corpus itself first, and so do a word's sums: no row is repeated for a resample
    drawn = docs.select("tokens", F.array(F.lit(1), *[times(i) for i in range(config.iterations)]).alias("times"))
    seeds, every = [*genuine, *counterfeit], range(config.iterations + 1)

    def summed(df: DataFrame, by: list[str], name: str, each: Column | int = 1) -> DataFrame:
        """(by, name): an array of sums, over the corpus and over each resample."""
        return df.groupBy(*by).agg(F.array(*[F.sum(each * F.get("times", F.lit(i))) for i in every]).alias(name))

    words = summed(drawn.select("times", F.explode("tokens").alias("word")), ["word"], "counts").where(F.get("counts", F.lit(0)) >= config.min_count)
    known = summed(drawn.select("times", F.explode(F.filter("tokens", lambda w: w.isin(*seeds))).alias("seed")), ["seed"], "n_seed")
    total = summed(drawn, [], "total", F.size("tokens").cast("bigint"))
    near = drawn.select("times", F.explode(_hits(seeds, config.window)).alias("x"))
    joint = summed(near.select("times", "x.word", "x.seed"), ["word", "seed"], "joint")
    pairs = joint.join(F.broadcast(known), "seed").groupBy("word").agg(F.collect_list(F.struct("seed", "joint", "n_seed")).alias("pairs"))

    def pmi(x: Column, i: Column) -> Column:
        """0 for a pair that does not meet in a resample."""
        at = lambda c: F.get(c, i).cast("double")
        return F.when(at(x["joint"]) > 0, F.ln(at(x["joint"]) * F.get("total", i) / (at(F.col("counts")) * at(x["n_seed"])))).otherwise(0.0)

    def mean(some: list[str], i: Column) -> Column:
        own = F.filter(F.coalesce("pairs", F.array().cast(pairs.schema["pairs"].dataType)), lambda x: x["seed"].isin(*some))
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + pmi(x, i)) / max(len(some), 1)

    score = lambda n, i: F.when(n >= config.min_count, mean(genuine, i) - mean(counterfeit, i))
    scores = words.join(pairs, "word", "left").join(F.broadcast(total)).select("word", F.get("counts", F.lit(0)).alias("n"), F.transform("counts", score).alias("all"))
    sorted_ = scores.select("word", "n", F.get("all", F.lit(0)).alias("so"), F.array_sort(F.filter(F.slice("all", 2, max(config.iterations, 1)), lambda x: x.isNotNull())).alias("drawn"))

    def percentile(share: float) -> Column:
        """Between the two nearest values, as in SQL."""
        at = F.lit(share) * (F.size("drawn") - 1)
        low, high = F.floor(at), F.ceil(at)
        value = lambda i: F.get("drawn", i.cast("int"))
        return F.when(low == high, value(low)).otherwise((high - at) * value(low) + (at - low) * value(high))

    edge = (1 - config.confidence) / 2
    out = sorted_.where(F.size("drawn") > 0).select("word", "n", "so", percentile(edge).alias("low"), percentile(1 - edge).alias("high"), F.size("drawn").cast("bigint").alias("n_iter"))
    # an end within rounding of 0 counts as 0, so that labels do not hang on the order of sums
    low, high = F.round("low", 9), F.round("high", 9)
    return out.withColumn("label", F.when((low <= 0) & (high >= 0), "discard").when(low > 0, "genuine").otherwise("counterfeit"))
