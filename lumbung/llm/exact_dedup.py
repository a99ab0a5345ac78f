"""Exact deduplication by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Texts are equal when they are so without white space. Lengths and prefix hashes are taken in one scan; only rows whose
length occurs more than once are grouped by prefix hash, and only rows whose prefix hash then occurs more than once
have their full content hashed (unless the caller wants every row's digest). Grouping sends counts and keys through
the shuffles, never texts, with partial sums before each; a large group of copies is thus one row a task, and the
join back to its rows is one that can be split.

Null texts count as empty, and so are copies of each other and of blank ones. Of equal texts the row with the most
code points stays, then the smallest doc_id (a null id is the largest); of rows that agree in both, one. An empty
table gives an empty result. Other columns are carried only if named, and may have any names but those added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.llm.common import SPACE, documents, hash_bits, materialise, text_of, with_maybe

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def exact_dedup(docs: DataFrame, carry: tuple[str, ...] = (), digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, the carried columns, keep_id, group_size, kept and text_sha256 (null for unhashed rows) of every row.

    ``carry`` must hold ``text`` unless ``digest_all`` is set; the digests of all rows are then taken in the first scan.
    """
    if not digest_all and "text" not in carry:
        raise ValueError("full hashes of survivors need the text: carry it, or set digest_all")
    text = text_of(docs)
    first = docs.select(
        docs["doc_id"], *[docs[c] for c in carry if c != "doc_id"], F.length(text).alias("__points"), normalised(text).alias("__plain")
    )
    keys = first.select(
        *[c for c in first.columns if c != "__plain"],
        F.length("__plain").alias("__length"),
        F.xxhash64(F.substring("__plain", 1, prefix_chars)).alias("__prefix"),
        *([F.sha2("__plain", 256).alias("__sha")] if digest_all else []),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = materialise(keys, "exact-keys")

    lengths = rows.groupBy("__length").count().where("count > 1").select("__length")
    prefixes = rows.join(lengths, "__length", "left_semi").groupBy("__length", "__prefix").count().where("count > 1").select("__length", "__prefix", F.lit(True).alias("__survives"))
    rows = rows.join(prefixes, ["__length", "__prefix"], "left")
    full = F.col("__sha") if digest_all else F.when(F.col("__survives"), F.sha2(normalised(text_of(rows)), 256))
    rows = rows.withColumn("text_sha256", full)
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__row").alias("r"))).alias("__best")
    groups = rows.where("__survives").groupBy("__length", "__prefix", "text_sha256").agg(F.count(F.lit(1)).alias("__size"), best).where("__size > 1")
    groups = groups.withColumnRenamed("text_sha256", "__full")
    same = [rows[c] == groups[c] for c in ("__length", "__prefix")] + [rows["text_sha256"] == groups["__full"]]
    return rows.join(groups.withColumn("__in", F.lit(True)), same, "left").select(
        rows["doc_id"],
        *[rows[c] for c in carry if c != "doc_id"],
        F.when(F.col("__in"), F.col("__best.i")).otherwise(rows["doc_id"]).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("__best.r") == rows["__row"], F.lit(True)).alias("kept"),
        rows["text_sha256"],
    )


def first_of_each(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the same refinement and the same choice.

    ``docs`` is what ``packed`` makes. It is scanned for lengths and prefixes, for the full hashes of survivors, and for the result. What is asked of
    each row (does its prefix occur again, is it one to drop) is looked up in tables of bits of a fixed size, which are never wrong about a no; so
    texts stay where they are but for those of rows to drop and a few others, which an exact join judges.
    """
    text = text_of(docs)
    keyed = docs.withColumns({"__plain": normalised(text), "__points": F.length(text)})
    keyed = keyed.withColumns({"__length": F.length("__plain"), "__prefix": F.xxhash64(F.substring("__plain", 1, prefix_chars))})
    counts = materialise(keyed.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("__count")), "exact-counts")
    lengths = counts.groupBy("__length").agg(F.sum("__count").alias("__all")).where("__all > 1").select("__length")
    prefixes = counts.where("__count > 1").join(lengths, "__length", "left_semi").select("__length", "__prefix")
    key = F.xxhash64("__length", "__prefix")
    hashed = with_maybe(keyed, key, hash_bits(prefixes, key, "exact-prefixes"), "__survives").withColumn("__full", F.when(F.col("__survives"), F.sha2("__plain", 256)))

    rows = materialise(hashed.where("__survives").select("doc_id", "__points", "__full", F.xxhash64("__rest").alias("__tie"), F.monotonically_increasing_id().alias("__row")), "exact-survivors")
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__tie").alias("t"), F.col("__row").alias("r"))).alias("__best")
    groups = rows.groupBy("__full").agg(F.count(F.lit(1)).alias("__size"), best).where("__size > 1").select("__full", F.col("__best.r").alias("__keeper"))
    judged = rows.join(groups, "__full").groupBy("doc_id", "__full").agg(F.count_if(F.col("__row") == F.col("__keeper")).alias("__stay"), F.count(F.lit(1)).alias("__n"))
    marks = materialise(judged.where("__stay < __n").select(F.col("doc_id").alias("__id"), F.col("__full").alias("__gone"), "__stay"), "exact-marks")
    bits = hash_bits(marks, F.xxhash64("__id", "__gone"), "exact-gone")
    looked = with_maybe(hashed, F.xxhash64("doc_id", "__full"), bits, "__maybe")
    surely = looked.where(~F.col("__maybe")).select(*docs.columns)
    doubtful = looked.where("__maybe").select(*docs.columns, "__points", "__full", F.xxhash64("__rest").alias("__tie"))
    same = F.expr("doc_id <=> __id AND __full = __gone")
    kept = surely.unionByName(doubtful.join(marks, same, "left_anti").select(*docs.columns))
    one_of = marks.where("__stay = 1").select("__id", "__gone")
    if one_of.isEmpty():
        return kept
    # an id that repeats among equal texts: of its rows one stays, by its length and then by its other columns
    again = doubtful.join(one_of, same, "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "__full").orderBy(F.desc("__points"), "__tie", *[c for c in ("text", "lang", "source")]))
    return kept.unionByName(again.withColumn("__k", place).where("__k = 1").select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the row that stays for its text."""
    return exact_dedup(documents(spark, sf_dir), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS n,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, text_sha256 FROM r
"""
