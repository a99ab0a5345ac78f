"""Exploratory tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.functions.columns import FUNCTION_WORDS, LABELS, PROBABILITIES, argmax_label, brand, capacity, color, length_class, length_classes, letters, max_probability, percent, tokens, word_count
from lumbung.functions.ranks import numbered


def _unpivoted(row: DataFrame, name: str, value: str) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in row.columns])).alias("x")).select("x.*")


def funnel(manifest: DataFrame, reviews: DataFrame, min_reviews: int = 3) -> DataFrame:
    """(tahap, n): files, source rows, reviews, usable ones and those of large enough products."""
    files = manifest.agg(F.count_if(F.col("status") == "ok").alias("berkas"), F.coalesce(F.sum("n_baris_sumber"), F.lit(0)).alias("baris_sumber"))
    usable = F.col("include_for_inference") & F.col("timestamp").isNotNull()
    by = reviews.groupBy("product_id").agg(F.count("*").alias("n"), F.count_if(usable).alias("u"))
    rest = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ulasan"), F.coalesce(F.sum("u"), F.lit(0)).alias("dapat_dipakai"), F.coalesce(F.sum(F.when(F.col("u") >= min_reviews, F.col("u"))), F.lit(0)).alias("produk_cukup"))
    return _unpivoted(files.select(*[F.col(c).cast("bigint") for c in files.columns]), "tahap", "n").unionByName(_unpivoted(rest.select(*[F.col(c).cast("bigint") for c in rest.columns]), "tahap", "n"))


def product_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_id")


def text_quality(reviews: DataFrame, short_words: int = 2) -> DataFrame:
    """(indikator, n, persen) of unusual texts."""
    n = word_count(F.coalesce("text_proposal", F.lit("")))
    tests = {"kosong": F.col("text_proposal_kosong"), "pendek": (n > 0) & (n <= short_words), "penjual": F.col("seller_reply_suspect"), "duplikat_teknis": F.col("is_technical_duplicate"), "duplikat_teks": F.col("is_text_duplicate")}
    row = reviews.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in tests.items()])
    return row.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("indikator"), F.col(k).alias("n")) for k in tests])).alias("x")).select("x.indikator", "x.n", percent(F.col("x.n"), F.col("total")).alias("persen"))


def truncated(lengths: DataFrame, thresholds: tuple[int, ...] = (64, 128, 256, 512)) -> DataFrame:
    """(batas, n, persen): texts of more tokens than each threshold."""
    row = lengths.agg(F.count("n_token").alias("total"), *[F.count_if(F.col("n_token") > t).alias(f"t{t}") for t in thresholds])
    return row.select("total", F.explode(F.array(*[F.struct(F.lit(t).alias("batas"), F.col(f"t{t}").alias("n")) for t in thresholds])).alias("x")).select("x.batas", "x.n", percent(F.col("x.n"), F.col("total")).alias("persen"))


def monthly(reviews: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Reviews of each month that has any."""
    return reviews.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("bulan")).agg(F.count("*").alias("n"))


def time_validity(reviews: DataFrame) -> DataFrame:
    """(kategori, n, persen) of timestamps with, without time and invalid, and by status."""
    has = F.col("timestamp").isNotNull()
    kind = F.when(has & F.col("timestamp_has_time"), "dengan_jam").when(has, "tanpa_jam").otherwise("tidak_valid")
    both = reviews.select(F.explode(F.array(kind, F.concat(F.lit("status:"), "timestamp_status"))).alias("kategori"))
    counts = both.groupBy("kategori").agg(F.count("*").alias("n"))
    return counts.join(reviews.agg(F.count("*").alias("total"))).select("kategori", "n", percent(F.col("n"), F.col("total")).alias("persen"))


def top_ngrams(texts: DataFrame, n: int = 1, k: int = 20, stopwords: tuple[str, ...] = tuple(FUNCTION_WORDS)) -> DataFrame:
    """The k most frequent n-grams, ties by name; single stop words go, longer ones only if all of them are."""
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    words = texts.select(tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
    # stop words are marked once for each word, before any n-gram is joined
    words = words.withColumn("s", F.transform("w", lambda w: F.array_contains(stop, w)))
    all_stop = lambda i: reduce(lambda a, b: a & b, [F.get("s", i + k) for k in range(n)])
    at = F.filter(F.sequence(F.lit(0), F.size("w") - n), lambda i: ~all_stop(i))
    grams = words.select(F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i + 1, n), " "))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("frekuensi")).orderBy(F.desc("frekuensi"), "ngram").limit(k)


def mean_by_length(scored: DataFrame, words: Column) -> DataFrame:
    """Rows and mean probabilities of each length class, also of those without rows."""
    classes = scored.sparkSession.createDataFrame([(i, c) for i, c in enumerate(length_classes())], "urutan int, kelas string")
    # words are counted once, not again for each bound of a class, nor in a filter on classes that could be null
    counted = scored.select(words.alias("n"), *PROBABILITIES)
    got = counted.withColumn("kelas", F.coalesce(length_class(F.col("n")), F.lit(""))).groupBy("kelas").agg(F.count("*").alias("n"), *[F.avg(p).alias(p) for p in PROBABILITIES])
    return classes.join(got, "kelas", "left").na.fill(0, ["n"])


def mean_by_product(scored: DataFrame, min_reviews: int = 3, by: str = "product_id") -> DataFrame:
    """Mean probabilities of groups that are large enough."""
    return scored.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(p).alias(p) for p in PROBABILITIES]).where(F.col("n") >= min_reviews)


def confusion(df: DataFrame, a: str, b: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Rows of one label, columns of the other, all of them, of rows that have both."""
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], "lama string")
    got = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("lama")).pivot(b, list(labels)).agg(F.count(F.lit(1)))
    return rows.join(got, "lama", "left").na.fill(0)


def rolling_mean(df: DataFrame, by: str, order: list[str], value: str, width: int = 25, least: int = 5) -> DataFrame:
    """Mean of the last ``width`` values, null until there are ``least``."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - width, 0)
    return df.withColumn(f"{value}_rolling", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def greatest_jump(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The greatest step between neighbours of a group and its place, the first of equals."""
    w = Window.partitionBy(by).orderBy(*order)
    steps = df.select(by, (F.row_number().over(w) - 1).alias("at"), F.abs(F.col(value) - F.lag(value).over(w)).alias("jump")).where("jump IS NOT NULL")
    best = F.max(F.struct("jump", (-F.col("at")).alias("k"))).alias("b")
    return steps.groupBy(by).agg(best).select(by, F.col("b.jump").alias("max_jump"), (-F.col("b.k")).alias("at"))


def prediction_summary(scored: DataFrame, short_words: int = 2) -> DataFrame:
    """One row: empty and very short texts, labels and their shares, mean probabilities, uncertain ones, token lengths, and the worst sum.

    Without a column text there are no very short ones.
    """
    words = word_count(F.col("text")) if "text" in scored.columns else F.lit(None)
    p = [F.col(c) for c in PROBABILITIES]
    label = argmax_label(*p)
    return scored.agg(
        F.count("*").alias("n"), F.count(p[0]).alias("n_scored"), *[F.count_if(label == k).alias(f"n_{k}") for k in LABELS], *[F.avg(c).alias(f"mean_{c}") for c in PROBABILITIES], F.count_if(max_probability(*p) < 0.6).alias("n_uncertain"),
        F.percentile("n_token", F.lit(0.5)).alias("token_median"), F.percentile("n_token", F.lit(0.95)).alias("token_p95"), F.max("n_token").alias("token_max"), F.count_if(F.col("truncated")).alias("n_truncated"), F.max(F.abs(p[0] + p[1] + p[2] - 1)).alias("worst_sum"),
        F.count_if(p[0].isNull()).alias("n_empty"), F.count_if(p[0].isNotNull() & (words <= short_words)).alias("n_very_short"), *[percent(F.count_if(label == k), F.count(p[0])).alias(f"pct_{k}") for k in LABELS], percent(F.count_if(F.col("truncated")), F.count(p[0])).alias("pct_truncated"),
    )


def overview(reviews: DataFrame) -> DataFrame:
    """(measure, key, n) of a raw review table: shops, products, brands, ratings, months, variants, words and repeated texts (A27, PR28).

    reviews: nama_toko, nama_produk, rating, timestamp, variation, and text where there is one.
    """
    values = {"toko": F.col("nama_toko"), "produk": F.col("nama_produk"), "merek": brand(F.col("nama_produk")), "rating": F.col("rating").cast("string"), "bulan": F.date_format("timestamp", "yyyy-MM"), "kapasitas": capacity(F.col("variation")), "warna": color(F.col("variation"))}
    each = reviews.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.alias("key")) for k, c in values.items()])).alias("x")).select("x.*").where("key IS NOT NULL")
    out = each.groupBy("measure", "key").agg(F.count("*").alias("n"))
    if "text" not in reviews.columns:
        return out
    words = reviews.select(F.explode(F.filter(tokens(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(*FUNCTION_WORDS))).alias("key"))
    again = reviews.where(F.coalesce("text", F.lit("")) != "").groupBy(F.xxhash64("text"), F.md5("text")).agg(F.count("*").alias("n"))
    twice = again.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n")).select(F.lit("teks_berulang").alias("measure"), F.lit("").alias("key"), "n")
    return out.unionByName(words.groupBy("key").agg(F.count("*").alias("n")).select(F.lit("kata").alias("measure"), "key", "n")).unionByName(twice)


def mean_rating(reviews: DataFrame, by: str = "nama_produk") -> DataFrame:
    """Ratings and their mean for each product."""
    return reviews.where(F.col("rating").isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg("rating").alias("rating"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, median, q75, max) of numbers."""
    parts = [(F.count, "n"), (F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (lambda c: F.percentile(c, F.lit(0.25)), "q25"), (lambda c: F.percentile(c, F.lit(0.5)), "median"), (lambda c: F.percentile(c, F.lit(0.75)), "q75"), (F.max, "max")]
    row = df.agg(*[f(F.col(c).cast("double")).cast("double").alias(f"{c}__{name}") for c in columns for f, name in parts])
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{name}").alias(name) for _, name in parts]) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins from low to high, the last one closed, also those without rows."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    got = df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").na.fill(0, ["n"])


def evenly_spaced(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows at even distances of the order."""
    total = df.count()
    if total <= n:
        return df
    at = sorted({round(i * (total - 1) / max(n - 1, 1)) + 1 for i in range(n)})
    return numbered(df, *order, name="__k").where(F.col("__k").isin(at)).drop("__k")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample that does not depend on order or partitions (T5)."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def anonymous_labels(df: DataFrame, column: str, order: str, prefix: str = "Toko") -> DataFrame:
    """(column, label): 'Toko A', 'Toko B', ... 'Toko AA' in order of first appearance (T10); one row a name."""
    firsts = df.groupBy(column).agg(F.min(order).alias("first"))
    return numbered(firsts, "first", column).select(column, F.concat_ws(" ", F.lit(prefix), letters(F.col("number") - 1)).alias("label"))
