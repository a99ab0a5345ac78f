"""Reports, ledgers and invariants as tables."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbung.functions.columns import digit_mask, joined_light, squeezed, trimmed, word_count
from lumbung.functions.text import LIGHT, clean_light

if TYPE_CHECKING:
    from lumbung.operators.clean import CleanResult


def timestamp_patterns(reviews: DataFrame) -> DataFrame:
    """Raw date shapes with counts and an example."""
    by = ["schema_family", "pola", "timestamp_status", "timestamp_anchor_source"]
    r = reviews.withColumn("pola", digit_mask(F.col("timestamp_raw")))
    return r.groupBy(*by).agg(F.count("*").alias("n_baris"), F.count_distinct("source_file").alias("n_file"), F.min_by("timestamp_raw", F.struct("source_file", "row_order")).alias("contoh"))


def aspect_candidates(fragments: DataFrame, max_words: int = 3, min_files: int = 3, top: int = 3) -> DataFrame:
    """Short fragments of many files: counts, usual spelling and the columns they stand in.

    fragments: source_file, column, fragment, key.
    """
    f = fragments.where((F.col("key") != "") & (word_count(F.col("key")) <= max_words))
    total = f.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("n_file"), F.bool_or(trimmed(F.col("fragment")).endswith(":")).alias("berakhir_titik_dua")).where(F.col("n_file") >= min_files)
    first = lambda what: f.groupBy("key", what).agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), what)))
    spelling = first("fragment").where("k = 1").select("key", F.col("fragment").alias("contoh"))
    columns = first("column").where(F.col("k") <= top).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.format_string("%s (%d)", "column", "c").alias("s")))), lambda x: x["s"]), ", ").alias("kolom"))
    return total.join(spelling, "key").join(columns, "key")


def phrase_candidates(fragments: DataFrame, min_words: int = 3, min_files: int = 10) -> DataFrame:
    """Comma-separated parts that many files have."""
    parts = fragments.select("source_file", F.explode(F.split("fragment", ",")).alias("p")).select("source_file", F.lower(squeezed(F.col("p"))).alias("frasa"))
    parts = parts.where(word_count(F.col("frasa")) >= min_words)
    return parts.groupBy("frasa").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("n_file")).where(F.col("n_file") >= min_files)


def product_summary(reviews: DataFrame, thresholds: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row a product: reviews, dates, its names and whether it passes each threshold."""
    include = F.col("include_for_inference")
    usable = include & F.col("timestamp").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    out = reviews.groupBy("product_id").agg(
        joined("nama_toko").alias("nama_toko"), joined("nama_produk").alias("nama_produk"), F.count("*").alias("n_baris"), F.count_if(include).alias("n_include"), F.count_if(include & F.col("timestamp").isNull()).alias("n_include_nat"),
        F.count_if(usable).alias("n_terurut"), F.min("timestamp").alias("pertama"), F.max("timestamp").alias("terakhir"),
    )
    return out.withColumns({f"lolos_{k}": F.col("n_terurut") >= k for k in thresholds})


def ledger(entries: list[tuple[str, str, DataFrame, Column, Column, str]]) -> DataFrame:
    """Rows (stage, rule, before, after, affected, unit), each from one aggregation of a table."""
    out = None
    for stage, rule, df, before, after, unit in entries:
        row = df.agg(before.alias("before"), after.alias("after")).select(F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), F.col("before").cast("bigint"), F.col("after").cast("bigint"))
        row = row.withColumns({"affected": F.col("before") - F.col("after"), "unit": F.lit(unit)})
        out = row if out is None else out.unionByName(row)
    return out


def light_changes(rows: DataFrame) -> DataFrame:
    """(rule, n): kept rows that each step of the light chain changed."""
    c = rows.where("drop_reason IS NULL").select(clean_light(joined_light(F.col("fragments"))).alias("c"))
    return step_counts(c.select("c.*"), list(LIGHT))


#: Why cells of a review column are not part of a review.
CELL_REASONS = {
    "tanggal": "nilai berupa tanggal (kolom bergeser saat scrape)", "tanggal_relatif": "nilai berupa tanggal relatif", "url": "nilai berupa URL", "angka": "nilai tanpa huruf, hanya angka (durasi video, +N foto, dsb.)",
    "label_aspek": "label aspek berakhiran ':' -> dipindah ke aspect_tags", "nama_tersamar": "nama pengguna tersamar (x***y)", "penanda_penjual": "penanda balasan penjual", "simbol": "hanya simbol/tanda baca tanpa huruf/angka/emoji",
}


def cleaning_ledger(run: CleanResult) -> DataFrame:
    """What each of six stages of a cleaning run kept, and why the rest is left out (A11): files, rows, cells, the light chain, flags, timestamps."""
    n, count = F.count("*"), F.count_if
    mapping, rows, r, cells = run.mapping, run.rows, run.reviews, run.tagged.where("value <> ''")
    in_review, text = F.col("role") == "review_text", F.col("use") == "fragment"
    # fixed values: names of stages and rules
    full, kept = count(~F.col("drop_reason").eqNullSafe(F.lit("sel_kosong"))), count(F.col("drop_reason").isNull())
    empty, short = F.col("is_empty"), F.col("is_short")
    fixed = ledger(
        [
            ("1_file", "pemetaan -> status ok", mapping, n, count(F.col("status") == "ok"), "baris pemetaan"),
            ("1_file", "file ok -> file diproses", run.manifest.join(mapping.where("status = 'ok'"), "file", "left_semi"), n, count(F.col("n_baris_sumber") > 0), "file"),
            ("2_baris", "baris tanpa sel teks terisi", rows, n, full, "baris sumber"),
            ("2_baris", "baris yang selnya hanya non-teks", rows, full, kept, "baris sumber"),
            ("3_fragmen", "sel kolom review_text -> fragmen review", cells.where(in_review), n, count(text), "sel"),
            ("5_flag", "is_empty", r, n, count(~empty), "baris"),
            ("5_flag", "is_short", r, count(~empty), count(~empty & ~short), "baris"),
            ("5_flag", "is_technical_duplicate", r, count(~empty & ~short), count(F.col("include_for_inference")), "baris"),
            ("5_flag", "is_text_duplicate (hanya ditandai)", r, n, n, "baris"),
        ]
    )
    row = lambda df, stage, rule, before, after, unit, reason: df.select(F.lit(stage).alias("stage"), rule.alias("rule"), before.cast("bigint").alias("before"), after.cast("bigint").alias("after"), (before - after).cast("bigint").alias("affected"), F.lit(unit).alias("unit"), reason.alias("reason"))
    named = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in CELL_REASONS.items()], F.col("kind"))
    kinds = cells.where(in_review & ~text).groupBy("kind").agg(n.alias("n"))
    other = cells.where(~in_review & (F.col("kind") == "teks")).groupBy("role").agg(n.alias("n"))
    total = r.agg(n.alias("total"))
    status = r.groupBy("timestamp_status").agg(n.alias("n")).join(F.broadcast(total))  # one row
    lost = F.when(F.col("timestamp_status").isin("ok", "relatif_dikonversi"), 0).otherwise(F.col("n"))
    changes = light_changes(rows).join(F.broadcast(total))
    parts = [
        row(kinds, "3_fragmen_rinci", F.concat(F.lit("review_text: "), "kind"), F.col("n"), F.lit(0), "sel", named),
        row(other, "3_fragmen_rinci", F.concat(F.lit("sel berhuruf di kolom berperan "), "role"), F.col("n"), F.lit(0), "sel", F.lit("peran kolom bukan review_text (lihat column_map.csv); tidak masuk review")),
        row(changes, "4_text_light", F.col("rule"), F.col("total"), F.col("total") - F.col("n"), "baris (berubah = terdampak)", F.lit("pembersihan minimal; baris tetap ada")),
        row(status, "6_timestamp", F.concat(F.lit("status "), "timestamp_status"), F.col("total"), F.col("total") - lost, "baris", F.concat(F.col("n").cast("string"), F.lit(" baris"))),
    ]
    out = fixed.withColumn("reason", F.lit(""))
    for p in parts:
        out = out.unionByName(p)
    return out


def flag_ledger(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """The short form of the ledger, from rows and flagged reviews alone."""
    n, count = F.count("*"), F.count_if
    return ledger(
        [
            ("baris", "tanpa fragmen teks", rows, n, count(F.col("drop_reason").isNull()), "baris"),
            ("teks", "teks kosong setelah dibersihkan", reviews, n, count(~F.col("is_empty")), "ulasan"),
            ("teks", "teks terlalu pendek", reviews, n, count(~F.col("is_short")), "ulasan"),
            ("duplikat", "duplikat teknis", reviews, n, count(~F.col("is_technical_duplicate")), "ulasan"),
            ("waktu", "timestamp tidak valid", reviews, n, count(F.col("timestamp").isNotNull()), "ulasan"),
            ("keluaran", "masuk inferensi", reviews, n, count(F.col("include_for_inference")), "ulasan"),
        ]
    )


def checks(tests: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(name, violations, passed): each test counts the rows of a table for which a condition holds, or adds up a number."""
    out = None
    for name, df, wrong in tests:
        row = df.agg(F.coalesce(F.sum(wrong.cast("bigint")), F.lit(0)).cast("bigint").alias("violations")).select(F.lit(name).alias("name"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def clean_checks(reviews: DataFrame, manifest: DataFrame) -> DataFrame:
    """The automatic checks of a cleaning run."""
    by_id = reviews.groupBy("review_id").agg(F.count("*").alias("n"))
    by_product = reviews.groupBy("product_id").agg(F.count("*").alias("n"), F.min("seq_in_product").alias("lo"), F.max("seq_in_product").alias("hi"), F.count_distinct("seq_in_product").alias("d"))
    order = Window.partitionBy("product_id").orderBy("seq_in_product")
    steps = reviews.withColumn("before", F.lag("timestamp").over(order)).withColumn("had", F.lag(F.col("timestamp").isNull()).over(order))
    text = F.col("text_light")
    return checks(
        [
            ("review_id unik", by_id, F.col("n") > 1),
            ("baris sumber = keluar + dibuang", manifest, ~F.col("seimbang")),
            ("urutan 1..n per produk", by_product, F.expr("NOT (lo = 1 AND hi = n AND d = n)")),
            ("waktu tidak mundur", steps, F.col("before") > F.col("timestamp")),
            ("waktu kosong di akhir", steps, F.col("had") & F.col("timestamp").isNotNull()),
            ("tidak ada teks kosong yang masuk", reviews, F.col("include_for_inference") & (text == "")),
            ("duplikat teknis tidak masuk", reviews, F.col("include_for_inference") & F.col("is_technical_duplicate")),
            ("duplikat teknis punya jam", reviews, F.col("is_technical_duplicate") & ~F.col("timestamp_has_time")),
            ("tanpa tag HTML", reviews, text.rlike("</?(?:br|p|div|span|b|i|a)(?:\\s[^>]*)?/?>")),
            ("tanpa URL", reviews, text.rlike(r"(?i)(?:https?://|www\.)\S")),
            ("status waktu dikenal", reviews, ~F.col("timestamp_status").isin("ok", "relatif_dikonversi", "relatif_tanpa_acuan", "tak_terparsing")),
        ]
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as multisets, and on which side."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes of equal rows of two tables, as multisets, with ``surplus``: how many rows ``a`` has more than ``b``.

    Columns are matched by place. One sum for both ways; a digest of each row's texts is dealt out and grouped, not the texts.
    """
    b = b.toDF(*a.columns)
    text = [c for c in a.columns if a.schema[c].dataType.simpleString() == b.schema[c].dataType.simpleString() == "string"]
    marked = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]
    digest = F.unhex(F.sha2(F.concat(F.lit(""), *marked), 256)).alias("__digest")
    rest = [c for c in a.columns if c not in text]
    both = a.select(digest, *rest, F.lit(1).alias("__n")).unionByName(b.select(digest, *rest, F.lit(-1).alias("__n")))
    return both.groupBy("__digest", *rest).agg(F.sum("__n").alias("surplus"))


def one_to_one_join(left: DataFrame, right: DataFrame, key: str, equal: list[str], carry: list[str]) -> DataFrame:
    """``left`` with columns of ``right``; unequal key sets, repeated keys or differing ``equal`` columns are errors."""
    for name, df in (("left", left), ("right", right)):
        if not df.groupBy(key).count().where(f"count > 1 OR {key} IS NULL").isEmpty():
            raise ValueError(f"{name}: {key} is null or not unique")
    r = right.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in dict.fromkeys([*equal, *carry])])
    l_ = left.withColumn("__left", F.lit(1))
    both = l_.join(r.withColumn("__right", F.lit(1)), key, "full")
    wrong = F.col("__left").isNull() | F.col("__right").isNull()
    for c in equal:
        wrong |= ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    if not both.where(wrong).isEmpty():
        raise ValueError("keys or compared columns differ")
    return both.select(*[c for c in left.columns if c not in carry], *[F.col(f"__{c}").alias(c) for c in carry])


def mapping_conflicts(ids: DataFrame) -> DataFrame:
    """(side, id, variants, n): old ids with several new ones, and the reverse."""
    pairs = ids.groupBy("old_id", "new_id").agg(F.count("*").alias("n"))
    out = None
    for a, b in (("old_id", "new_id"), ("new_id", "old_id")):
        g = pairs.groupBy(F.col(a).alias("id")).agg(F.count("*").alias("variants"), F.sum("n").alias("n")).where("variants > 1").withColumn("side", F.lit(a))
        out = g if out is None else out.unionByName(g)
    return out


def leakage(fit: DataFrame, train: DataFrame, test: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Checks on id tables (product_id): fit within train, train and test apart, synthetic in neither."""
    return checks(
        [
            ("fit di dalam train", fit.join(train, "product_id", "left_anti"), F.lit(True)),
            ("train dan test terpisah", train.join(test, "product_id", "left_semi"), F.lit(True)),
            ("sintetis tidak dalam fit", fit.join(synthetic, "product_id", "left_semi"), F.lit(True)),
            ("sintetis tidak dalam test", test.join(synthetic, "product_id", "left_semi"), F.lit(True)),
        ]
    )


def step_counts(steps: DataFrame, names: list[str]) -> DataFrame:
    """(rule, n): rows that each step of a text chain changed."""
    counts = steps.agg(*[F.count_if(F.col(c)).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")


def replacement_trace(traced: DataFrame, top: int = 100, examples: int = 3, seed: int = 42) -> DataFrame:
    """(key, standard, n, n_reviews, examples) of slang replacements, most frequent first.

    traced: review_id, slang array<struct<key, standard>>.
    """
    each = traced.select("review_id", F.explode("slang").alias("s")).select("review_id", "s.*")
    total = each.groupBy("key", "standard").agg(F.count("*").alias("n"), F.count_distinct("review_id").alias("n_reviews")).orderBy(F.desc("n"), "key", "standard").limit(top)
    rank = F.row_number().over(Window.partitionBy("key", "standard").orderBy(F.xxhash64("review_id", F.lit(seed)), "review_id"))
    shown = each.distinct().withColumn("k", rank).where(F.col("k") <= examples).groupBy("key", "standard").agg(F.array_sort(F.collect_list("review_id")).alias("examples"))
    return total.join(shown, ["key", "standard"])


def protected_counts(before: Column, after: Column, terms: tuple[str, ...]) -> Column:
    """array of (term, lost, gained): protected terms in a text before and after a chain."""
    out = []
    for t in terms:
        p = r"(?iU)(?<!\w)" + r"\s+".join(t.split()) + r"(?!\w)"
        a, b = F.regexp_count(before, F.lit(p)), F.regexp_count(after, F.lit(p))
        out.append(F.struct(F.lit(t).alias("term"), F.greatest(a - b, F.lit(0)).alias("lost"), F.greatest(b - a, F.lit(0)).alias("gained")))
    return F.array(*out)


def slang_alternatives(source: DataFrame) -> DataFrame:
    """(key, n, standards) of keys that have several standards in a raw dictionary."""
    s = source.select(F.lower(squeezed(F.col("slang"))).alias("key"), squeezed(F.col("formal")).alias("standard")).where("key <> '' AND standard <> ''")
    return s.groupBy("key").agg(F.array_sort(F.collect_set("standard")).alias("standards")).where(F.size("standards") > 1).select("key", F.size("standards").cast("bigint").alias("n"), "standards")


def slang_source_profile(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a raw dictionary with the first reason to leave each out, and the key loss with its gate.

    source: slang, formal, in_dictionary. A key is ambiguous if it has several standards anywhere in the source.
    """
    s = source.select(F.lower(squeezed(F.col("slang"))).alias("key"), squeezed(F.col("formal")).alias("standard"), F.lower(trimmed(F.col("in_dictionary"))).alias("in_dictionary"))
    w = Window.partitionBy("key")
    s = s.withColumn("variants", F.size(F.collect_set("standard").over(w))).withColumn("k", F.row_number().over(Window.partitionBy("key", "standard").orderBy("in_dictionary")))
    rules = [("slang_kosong", "key = ''"), ("baku_kosong", "standard = ''"), ("sama_dengan_baku", "key = lower(standard)"), ("kata_kamus", "in_dictionary IN ('1', 'true')"), ("berisi_angka", "key RLIKE '[0-9]'"), ("ambigu", "variants > 1"), ("duplikat", "k > 1")]
    rows = s.withColumn("reason", F.coalesce(*[F.when(F.expr(c), n) for n, c in rules]))
    keys = rows.where("key <> ''").groupBy("key").agg(F.bool_or(F.col("reason").isNull()).alias("kept"))
    gate = keys.agg(F.count("*").alias("keys"), F.count_if(~F.col("kept")).alias("lost")).withColumn("stop", F.expr("10 * lost > 3 * keys"))
    return rows, gate
