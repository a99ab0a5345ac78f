"""From cells with roles to one clean row for each review, with its flags (PR7 to PR10, W1 to W5, A3 to A6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.config import CleanConfig
from lumbung.functions.columns import SELLER_STYLE, classify, joined_light, joined_review, relative_parts, schema_family, timestamp_fields, trimmed, word_count
from lumbung.functions.ranks import numbered
from lumbung.functions.text import clean_light, fragment_key


def tagged_cells(cells: DataFrame, roles: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Cells with role and kind, and ``use``: fragment, tag or other. Approved aspect words are tags (PR8).

    Roles and words are sent out: a join by file and column would put all cells of a column in one task.
    """
    c = cells.join(F.broadcast(roles.select("file", "column", "role")), ["file", "column"]).withColumn("value", trimmed(F.coalesce(F.col("value"), F.lit(""))))
    c = c.withColumn("kind", classify(F.col("value"), is_trimmed=True))
    approved: Column = F.lit(False)
    if vocabulary is not None:
        c = c.withColumn("key", F.when((F.col("role") == "review_text") & (F.col("kind") == "teks"), fragment_key("value")))
        c = c.join(F.broadcast(vocabulary.withColumn("approved", F.lit(True))), "key", "left")
        approved = F.coalesce("approved", F.lit(False))
    text = (F.col("role") == "review_text") & (F.col("kind") == "teks")
    use = F.when(text & ~approved, "fragment").when(text | (F.col("role") == "review_text") & (F.col("kind") == "label_aspek") | (F.col("role") == "aspect_tag") & (F.col("value") != ""), "tag").otherwise("other")
    return c.withColumn("use", use)


def rebuilt_rows(tagged: DataFrame) -> DataFrame:
    """One row for each source row, kept or not: fragments, their columns, tags, raw date and why it is dropped (PR7)."""
    ordered = lambda cond, what: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("position", what.alias("x"))))), lambda s: s["x"])
    fragment, tag = F.col("use") == "fragment", F.col("use") == "tag"
    rows = tagged.groupBy("file", "row_order").agg(
        ordered(fragment, F.col("value")).alias("fragments"), ordered(fragment, F.col("column")).alias("fragment_columns"), ordered(tag, F.col("value")).alias("tags"),
        F.max(F.when(F.col("role") == "timestamp", F.col("value"))).alias("timestamp_raw"),
        F.bool_or((F.col("role") == "review_text") & (F.col("kind") != "kosong")).alias("had_cell"),
        F.bool_or(fragment & F.col("value").rlike(SELLER_STYLE)).alias("seller_reply_suspect"),
    )
    reason = F.when(F.size("fragments") > 0, F.lit(None)).when(F.col("had_cell"), "hanya_bukan_teks").otherwise("sel_kosong")
    return rows.withColumns({"drop_reason": reason, "timestamp_raw": F.coalesce("timestamp_raw", F.lit("")), "seller_reply_suspect": F.coalesce("seller_reply_suspect", F.lit(False))})


def fragment_counts(tagged: DataFrame) -> DataFrame:
    """Cells by role and kind (A5)."""
    return tagged.where("value <> ''").groupBy("role", "kind", "use").agg(F.count("*").alias("n"))


def reviews(rows: DataFrame, mapping: DataFrame, anchors: DataFrame, headers: DataFrame, config: CleanConfig) -> DataFrame:
    """Kept rows with ids, texts and timestamps; flags come after (PR19, S9, S10). What is known of files, a row each, is sent out."""
    kept = rows.where("drop_reason IS NULL").join(F.broadcast(mapping.select("file", "nama_toko", "nama_produk", F.col("product_key").alias("product_id"))), "file").join(F.broadcast(headers), "file", "left")
    kept = kept.join(F.broadcast(anchors.select("file", F.col("timestamp_anchor").alias("a"), F.col("timestamp_anchor_source").alias("s"))), "file", "left")
    stamp = timestamp_fields(F.col("timestamp_raw"), F.col("a"))
    relative = relative_parts(F.col("timestamp_raw")).isNotNull()
    out = kept.withColumn("t", stamp).select(
        F.concat_ws("__", "product_id", F.substring(F.sha2("file", 256), 1, 8), F.col("row_order").cast("string")).alias("review_id"),
        "product_id", "nama_toko", "nama_produk", joined_review(F.col("fragments"), config.fragment_separator).alias("review"), joined_light(F.col("fragments")).alias("light"),
        F.array_join("tags", " | ").alias("aspect_tags"), F.col("t.timestamp").alias("timestamp"), F.col("t.has_time").alias("timestamp_has_time"), "timestamp_raw",
        F.col("t.status").alias("timestamp_status"), F.col("t.is_estimated").alias("timestamp_is_estimated"), F.when(relative, F.col("a")).alias("timestamp_anchor"),
        F.when(relative, F.coalesce("s", F.lit("tidak_ada"))).otherwise("tidak_ada").alias("timestamp_anchor_source"), F.when(relative, F.col("timestamp_raw")).otherwise("").alias("timestamp_relative_raw"),
        "row_order", F.col("file").alias("source_file"), F.array_join("fragment_columns", " | ").alias("fragment_cols"), F.size("fragments").cast("bigint").alias("n_fragments"), "seller_reply_suspect", "schema_family",
    )
    return out.withColumn("c", clean_light(F.col("light"), config.unicode_nfkc)).withColumn("text_light", F.col("c.text")).drop("c", "light")


def with_flags(df: DataFrame, config: CleanConfig | None = None) -> DataFrame:
    """Lengths, emptiness, duplicates, inclusion and each review's place in its product (PR10, W1 to W4).

    All windows are within product_id. Digests stand for texts in those of equal texts, which share one exchange; so texts that
    no later step asks for do not travel, neither to them nor to the order of a product, which is one task's.
    """
    config = config or CleanConfig()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = df.withColumns({"n_chars": F.length("text_light").cast("bigint"), "n_words": word_count(F.col("text_light")), "is_empty": F.col("text_light") == ""})
    df = df.withColumn("is_short", ~F.col("is_empty") & (F.col("n_chars") < config.min_review_length))
    eligible = ~F.col("is_empty") & F.col("timestamp").isNotNull() & ~flag("timestamp_is_estimated")
    if config.technical_needs_time:
        eligible &= flag("timestamp_has_time")
    df = df.withColumns({"__e": eligible, "__d": F.unhex(F.sha2("text_light", 256))}).repartition("product_id", "__d")
    same = Window.partitionBy("product_id", "__d", "timestamp", "__e").orderBy("source_file", "row_order", "review_id")
    df = df.withColumn("is_technical_duplicate", F.col("__e") & (F.row_number().over(same) > 1))
    text = Window.partitionBy("product_id", "__d")
    df = df.withColumns(
        {
            "dup_group_size": F.when(F.col("is_empty"), 0).otherwise(F.count("*").over(text)).cast("bigint"),
            "is_text_duplicate": ~F.col("is_empty") & (F.count(F.when(~F.col("is_technical_duplicate"), 1)).over(text) >= 2),
        }
    )
    df = df.withColumn("include_for_inference", ~F.col("is_empty") & ~F.col("is_short") & ~F.col("is_technical_duplicate"))
    order = Window.partitionBy("product_id").orderBy(F.col("timestamp").asc_nulls_last(), "source_file", "row_order", "review_id")
    return df.withColumn("seq_in_product", F.row_number().over(order).cast("bigint")).drop("__e", "__d")


def date_only_candidates(df: DataFrame) -> DataFrame:
    """How many rows repeat another's text on the same day without a time."""
    order = Window.partitionBy("product_id", "text_light", "timestamp").orderBy("source_file", "row_order")
    rows = df.where(~F.col("is_empty") & F.col("timestamp").isNotNull() & ~F.col("timestamp_has_time")).withColumn("k", F.row_number().over(order))
    return rows.agg(F.count_if(F.col("k") > 1).alias("n"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """(file, file_dup_group): files of equal content, groups numbered FD01... by their first file."""
    groups = files.groupBy("sha256").agg(F.count("*").alias("n"), F.min("file").alias("first")).where("n > 1")
    number = F.col("number").cast("string")
    groups = numbered(groups, "first").withColumn("file_dup_group", F.concat(F.lit("FD"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
    return files.join(groups.select("sha256", "file_dup_group"), "sha256").select("file", "file_dup_group")


def same_key_groups(groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file_dup_group, n, satu_kunci): groups of equal files, and whether all of one have the same product key."""
    g = groups.join(mapping.select("file", "product_key"), "file", "left").groupBy("file_dup_group")
    return g.agg(F.count("*").alias("n"), (F.count_distinct("product_key") == 1).alias("satu_kunci"))


def manifest(rows: DataFrame, reviews_: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a file: source rows, why rows were dropped, what came out, and whether all are accounted for."""
    source = rows.groupBy("file").agg(F.count("*").alias("n_baris_sumber"), F.count_if(F.col("drop_reason") == "sel_kosong").alias("n_sel_kosong"), F.count_if(F.col("drop_reason") == "hanya_bukan_teks").alias("n_hanya_bukan_teks"))
    flags = ["is_empty", "is_short", "is_technical_duplicate", "is_text_duplicate", "include_for_inference", "seller_reply_suspect"]
    out = reviews_.groupBy(F.col("source_file").alias("file")).agg(
        F.count("*").alias("n_keluar"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in flags], F.count_if(F.col("timestamp").isNull()).alias("n_nat"),
        *[F.count_if(F.col("timestamp_status") == s).alias(f"n_ts_{s}") for s in ("ok", "relatif_dikonversi", "relatif_tanpa_acuan", "tak_terparsing")],
    )
    joined = mapping.join(source, "file", "left").join(out, "file", "left")
    joined = joined.na.fill(0, [c for c in joined.columns if c.startswith("n_")])
    return joined.withColumns(
        {"pct_nat": F.round(100.0 * F.col("n_nat") / F.nullif(F.col("n_keluar"), F.lit(0)), 2), "seimbang": F.expr("n_baris_sumber = n_sel_kosong + n_hanya_bukan_teks + n_keluar")}
    )


@dataclass
class CleanResult:
    """Lazy tables of one run; nothing runs until one is used."""

    reviews: DataFrame
    roles: DataFrame
    rows: DataFrame
    tagged: DataFrame
    manifest: DataFrame
    anchors: DataFrame
    duplicates: DataFrame
    mapping: DataFrame


def clean_folder(files: DataFrame, cells: DataFrame, mapping: DataFrame, config: CleanConfig | None = None, overrides: DataFrame | None = None, vocabulary: DataFrame | None = None) -> CleanResult:
    """The whole cleaning stage over a folder's files and cells."""
    from lumbung.operators.profile import column_roles
    from lumbung.sources.files import timestamp_anchors

    config = config or CleanConfig()
    if "status" not in mapping.columns:
        mapping = mapping.withColumn("status", F.lit("ok"))
    files = files.join(mapping.select("file"), "file", "left_semi")
    groups = duplicate_files(files)
    if config.exclude_duplicate_files:
        first = Window.partitionBy("file_dup_group").orderBy("file")
        later = groups.withColumn("k", F.row_number().over(first)).where("k > 1").select("file")
        files, mapping = files.join(later, "file", "left_anti"), mapping.join(later, "file", "left_anti")
    cells = cells.join(F.broadcast(mapping.select("file")), "file", "left_semi")
    roles = column_roles(cells, config)
    tagged = tagged_cells(cells, roles, vocabulary)
    rows = rebuilt_rows(tagged)
    anchors = timestamp_anchors(cells, files, overrides, config.timezone)
    headers = cells.groupBy("file").agg(F.collect_set("column").alias("columns")).select("file", schema_family(F.col("columns")).alias("schema_family"))
    out = with_flags(reviews(rows, mapping, anchors, headers, config), config)
    out = out.join(F.broadcast(groups.withColumnRenamed("file", "source_file")), "source_file", "left").na.fill("", ["file_dup_group"])
    return CleanResult(out, roles, rows, tagged, manifest(rows, out, mapping), anchors, groups, mapping)


def legacy_clean(df: DataFrame, min_length: int = 2) -> DataFrame:
    """The retired cleaner: old normalisation, least length, first of equal reviews of a product (PR17, W7)."""
    from lumbung.functions.columns import legacy_text

    df = df.withColumn("review", legacy_text(F.col("review"))).where(F.length("review") >= min_length)
    first = Window.partitionBy("product", "review").orderBy("row_order")
    df = df.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    order = Window.partitionBy("product").orderBy("row_order")
    return df.withColumn("review_id", F.concat_ws("_", "product", F.row_number().over(order).cast("string")))
