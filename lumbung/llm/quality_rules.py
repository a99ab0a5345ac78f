"""Quality rules whose limits follow each language's and source's own distribution.

Every text's counts are computed in its own row. Each ratio's distribution within (language, source) is kept as a
mergeable sketch: counts of logarithmic bins with 32 steps to each doubling, so sketches of parts add up to the sketch
of the whole and a quantile is within 1/32 of its value. A group's quartiles are blended with its language's as if ``PRIOR_DOCS``
documents of the language had come with its own, and a language's likewise with those of all, so a limit moves smoothly
from the wider sketch to the group's own as the group grows. A ratio fails when it lies beyond the quartiles by several interquartile
ranges; repeated words are left to the base rule, as an adaptive limit below its 20 % rejected good documents (37 of 3,409 on sf0.1 with a least
range of 2 %) and no bad one more. Small spreads count as a stated least spread, so that clean documents of uniform groups stay.

Null and empty texts have no words: all counts are 0 and the base rule rejects them. Null languages and sources are
groups of their own. Rows repeat as they come; an empty table gives an empty result; other columns are carried if named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm.common import SPACE, SPACE_CHARS, documents, materialise, text_of

#: ratio: numerator, denominator, which side fails, interquartile ranges beyond the quartile, least range; parts per million.
RATIOS: dict[str, tuple[str, str, str, int, int]] = {
    "symbols": ("n_symbols", "word_chars", "high", 4, 10_000),
    "dup_lines": ("n_dup_lines", "n_lines", "high", 4, 100_000),
    "word_length": ("word_chars", "n_words", "both", 4, 1_000_000),
}
#: Documents that the next wider sketch counts for beside a group's own.
PRIOR_DOCS = 100
MILLION = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window which occurs at least twice in the text."""
    window = 5

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    def among(h: Column) -> Column:
        sorted_windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(let(sorted_windows, twice))).otherwise(0)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= window, let(hashes, lambda h: let(windows(h), among))).otherwise(0)


def base_counts(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    text = text_of(docs)

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), _repeat_words(words).cast("bigint").alias("n_repeat_words"))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    with_word = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = docs.select(
        *[docs[c] for c in carry],
        let(words, counts).alias("__w"),
        let(with_word, lines).alias("__l"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    out = out.select(*carry, "__w.*", "__l.*", "word_chars", "n_symbols")
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def ratio(name: str) -> str:
    over, under, *_ = RATIOS[name]
    return f"({MILLION} * {over} DIV greatest({under}, 1))"


def bin_of(v: str) -> str:
    """The bin of a whole number from 0: itself below 64, then 32 bins to each doubling."""
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"CAST({shift} * 32 + shiftright({v}, {shift}) AS INT)"


def bin_start(b: str) -> str:
    return f"CASE WHEN {b} < 64 THEN CAST({b} AS BIGINT) ELSE shiftleft(CAST({b} % 32 + 32 AS BIGINT), {b} DIV 32 - 1) END"


def sketches(counts: DataFrame) -> DataFrame:
    """Rows (lang, source, name, bin, n): one sketch for each group and ratio, over documents that pass the base rule."""
    pairs = ", ".join(f"'{k}', {bin_of(ratio(k))}" for k in RATIOS)
    each = counts.where(~F.col("base_failed")).selectExpr("lang", "source", f"stack({len(RATIOS)}, {pairs}) AS (name, bin)")
    return each.groupBy("lang", "source", "name", "bin").agg(F.count(F.lit(1)).alias("n"))


def limits(sketch: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """(lang, source) and the limits low_<ratio>, high_<ratio> of each group, from its own and the wider sketches."""
    lang = sketch.groupBy("lang", "name", "bin").agg(F.sum("n").alias("n"))
    every = lang.groupBy("name", "bin").agg(F.sum("n").alias("n"))
    groups = sketch.select("lang", "source").distinct()

    def quartiles(s: DataFrame, by: list[str], level: str) -> DataFrame:
        # a sketch has at most some 1,900 bins, so its array is bounded
        s = s.groupBy(*by, "name").agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))

        def at(q: int) -> Column:
            walk = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["bin"] < 0) & (100 * (a["seen"] + x["n"]) >= q * F.col("docs")), x["bin"]).otherwise(a["bin"]).alias("bin"))
            return F.aggregate("bins", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).alias("bin")), walk, lambda a: a["bin"])

        s = s.select(*by, "name", "docs", at(25).alias("b1"), at(75).alias("b3"))
        return s.select(*by, "name", F.struct("docs", F.expr(bin_start("b1")).alias("q1"), F.expr(bin_start("b3")).alias("q3")).alias(level))

    def same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
        out = left["name"] == right["name"]
        for c in by:
            out &= left[c].eqNullSafe(right[c])
        return out

    names = groups.select("lang", "source", F.explode(F.array(*map(F.lit, RATIOS))).alias("name"))
    for by, s, level in ((["lang", "source"], sketch, "own"), (["lang"], lang, "wide"), ([], every, "all")):
        q = quartiles(s, by, level)
        names = names.join(q, same(names, q, by), "left").select(*[names[c] for c in names.columns], q[level])
    blend = lambda near, far, q: f"({near}.docs * {near}.{q} + {prior_docs} * {far}.{q}) DIV ({near}.docs + {prior_docs})"
    names = names.withColumn("wide", F.expr(f"named_struct('q1', {blend('wide', 'all', 'q1')}, 'q3', {blend('wide', 'all', 'q3')})"))
    names = names.select("lang", "source", "name", F.expr(f"named_struct('q1', {blend('own', 'wide', 'q1')}, 'q3', {blend('own', 'wide', 'q3')})").alias("q"))
    least = F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[4])])
    times = F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[3])])
    both = F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[2] == "both")])
    spread = times[F.col("name")] * F.greatest(F.col("q.q3") - F.col("q.q1"), least[F.col("name")])
    names = names.select(
        "lang", "source", "name", (F.col("q.q3") + spread).alias("high"), F.when(both[F.col("name")], F.col("q.q1") - spread).otherwise(F.lit(-1)).alias("low")
    )
    picks = [F.max(F.when(F.col("name") == k, F.col(side))).cast("bigint").alias(f"{side}_{k}") for k in RATIOS for side in ("low", "high")]
    return names.groupBy("lang", "source").agg(*picks)


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """The carried columns with the counts, base_failed, failed (names of the failed ratios) and kept."""
    needed = tuple(dict.fromkeys((*carry, "lang", "source")))
    counts = base_counts(docs, needed)
    if "text" in carry:  # counting a second time costs less than writing the texts
        sketch = sketches(base_counts(docs, ("lang", "source")))
    else:
        counts = materialise(counts, "quality-counts")
        sketch = sketches(counts)
    limit = materialise(limits(materialise(sketch, "quality-sketches"), prior_docs), "quality-limits")
    joined = counts.join(limit.withColumnsRenamed({"lang": "__lang", "source": "__source"}), F.expr("lang <=> __lang AND source <=> __source"), "left")
    failed = [F.expr(f"CASE WHEN {ratio(k)} > high_{k} OR {ratio(k)} < low_{k} THEN '{k}' END") for k in RATIOS]
    joined = joined.withColumn("failed", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*failed))))
    return joined.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.size("failed") == 0).alias("kept"), F.array_join("failed", ",").alias("failed"), "n_lines"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict of the rules."""
    return quality_rules(documents(spark, sf_dir))
