"""Queries of reports, samples, helpers and invariants whose results SQL can give as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions import columns as C
from lumbung.functions import text as T
from lumbung.functions.ranks import numbered
from lumbung.operators import audits, clean, eda, hmm, overlap, profile, score, sequences, split
from lumbung.plans.queries import AUDIT, LABEL, SCORED, WORDS, export_source, probs, query, scored, table
from lumbung.sources import sinks


@query("numbered_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Places in a total order of a whole table."""
    return numbered(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")


@query("evenly_spaced", "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM n WHERE k IN (SELECT DISTINCT CAST(round_even(i * (n - 1) / 15.0, 0) AS BIGINT) + 1 FROM range(16) AS g(i))")
def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    """T6."""
    return eda.evenly_spaced(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 16)


@query("letter_labels", "WITH f AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) SELECT c_name, 'Toko ' || CASE WHEN k < 26 THEN '' WHEN k < 702 THEN chr(CAST(64 + k // 26 AS INTEGER)) ELSE chr(CAST(65 + (k - 702) // 676 AS INTEGER)) || chr(CAST(65 + (k - 702) // 26 % 26 AS INTEGER)) END || chr(CAST(65 + CASE WHEN k < 702 THEN k ELSE k - 702 END % 26 AS INTEGER)) AS label FROM f")
def letter_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of one, two and three letters."""
    return eda.anonymous_labels(table(spark, d, "customer"), "c_name", "c_custkey")


@query("written_time", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS waktu FROM orders")
def written_time(spark: SparkSession, d: str) -> DataFrame:
    """S29."""
    ts = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", C.written_time(ts, F.col("o_orderkey") % 3 == 2).alias("waktu"))


SHORT = "c_name"
for _d in "0123456789":  # SQL's patterns know no repetition of what was found
    SHORT = f"regexp_replace({SHORT}, '{_d}{{3,}}', '{_d}{_d}', 'g')"


@query("combined_columns", rf"SELECT c_custkey, trim(regexp_replace(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE {SHORT} END || ' ' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, '\s+', ' ', 'g')) AS review FROM customer")
def combined_columns(spark: SparkSession, d: str) -> DataFrame:
    """Null words, tags and addresses go, repeats are cut to two."""
    a = F.when(F.col("c_custkey") % 4 == 0, " NaN ").otherwise(F.col("c_name"))
    b = F.when(F.col("c_custkey") % 3 == 0, "<br><i>").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" https://a.b/c ")))
    return table(spark, d, "customer").select("c_custkey", C.combined_review(a, b).alias("review"))


@query("safe_names", r"SELECT p_partkey, regexp_replace(trim(p_brand || ' / ' || p_type), '[^\w\-.]+', '_', 'g') AS name FROM part")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """S23."""
    return table(spark, d, "part").select("p_partkey", C.safe_name(F.concat(F.lit("  "), "p_brand", F.lit(" / "), "p_type", F.lit(" "))).alias("name"))


@query("review_keys", r"SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS kunci, lower(p_brand) AS fragmen FROM part")
def review_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which equal reviews and labels meet; full-width signs and spaces of any kind are the same."""
    wide = F.concat(F.lit(" "), F.upper("p_name"), F.lit("　\t"), "p_brand", F.lit(" \n"))
    return table(spark, d, "part").select("p_partkey", T.review_key(wide).alias("kunci"), T.fragment_key(F.concat(F.lit(" "), "p_brand", F.lit("：:"))).alias("fragmen"))


@query("schema_families", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A_webscraper' WHEN 1 THEN 'B_lazada' ELSE 'C_acak' END AS family FROM customer")
def schema_families(spark: SparkSession, d: str) -> DataFrame:
    """PR4."""
    header = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("time"), F.lit("web_scraper_order"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("x"), F.when(F.col("c_custkey") % 2 == 0, "time").otherwise("item-content-y"))).otherwise(F.array(F.lit("x"), F.lit("timer")))
    return table(spark, d, "customer").select("c_custkey", C.schema_family(header).alias("family"))


@query("legacy_columns", "SELECT 'a' AS file, 'Isi Ulasan' AS col, 'review' AS kind UNION ALL SELECT 'a', 'Tanggal', 'timestamp' UNION ALL SELECT 'b', 'url', 'review' FROM (SELECT avg(length(url)) AS m FROM (SELECT url FROM pages ORDER BY page_id LIMIT 30)) WHERE m > 20 UNION ALL SELECT 'b', 'created_at', 'timestamp'")
def legacy_columns(spark: SparkSession, d: str) -> DataFrame:
    """PR16: by name, else by the length of the first 30 filled values."""
    pages = table(spark, d, "pages")
    parts = [("a", 0, "Isi Ulasan", "url"), ("a", 1, "Tanggal", "url"), ("a", 2, "isi", "url"), ("b", 0, "url", "url"), ("b", 1, "created_at", "'2024-01-01'"), ("b", 2, "kode", "CAST(page_id AS STRING)"), ("b", 3, "datetimes", "''")]
    cells = None
    for file, position, name, value in parts:
        one = pages.selectExpr(f"'{file}' AS file", "page_id AS row_order", f"{position} AS position", f"'{name}' AS column", f"{value} AS value")
        cells = one if cells is None else cells.unionByName(one)
    return profile.legacy_columns(cells).select("file", F.col("column").alias("col"), "kind")


@query("legacy_clean", r"SELECT product, review, product || '_' || CAST(row_number() OVER (PARTITION BY product ORDER BY k) AS VARCHAR) AS review_id FROM (SELECT o_orderpriority AS product, CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'c' || CAST(o_custkey % 90 AS VARCHAR) END AS review, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) WHERE length(review) >= 2")
def legacy_clean(spark: SparkSession, d: str) -> DataFrame:
    """PR17 W7: the first of equal reviews of a product stays, by the library's own function."""
    o = table(spark, d, "orders").selectExpr("o_orderpriority AS product", "CASE WHEN o_custkey % 50 = 0 THEN ' null ' ELSE concat('<b>c', o_custkey % 90, '</b>') END AS review", "o_orderkey AS row_order")
    return clean.legacy_clean(o).select("product", "review", "review_id")


@query("limited_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def limited_rows(spark: SparkSession, d: str) -> DataFrame:
    """PR24: the first rows by a total order; here the limit is the operator."""
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey").limit(25)


@query("hash_sample", "WITH r AS (SELECT o_orderkey FROM orders) SELECT CAST(least(40, count(*)) AS BIGINT) AS n, CAST(least(40, count(*)) AS BIGINT) AS known FROM r")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """T5: as many distinct rows as asked, the same from any partitioning; here the sample is the operator."""
    o = table(spark, d, "orders").select("o_orderkey")
    a, b = (eda.hash_sample(o.repartition(k), "o_orderkey", 40) for k in (2, 5))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("two", F.lit(1)), "o_orderkey", "full").agg(F.count("one").alias("n"), F.count_if(F.expr("one = two")).alias("known"))


SUMMARY = f"""WITH {SCORED}, x AS (SELECT p.*, event_id % 23 = 0 AS empty, event_id % 200 AS n_token, {LABEL} AS label, event_id % 4 AS words FROM p)
SELECT count(*) AS n, count(*) FILTER (WHERE NOT empty) AS n_scored, count(*) FILTER (WHERE empty) AS n_empty, count(*) FILTER (WHERE NOT empty AND words <= 2) AS n_very_short,
round_even(100.0 * count(*) FILTER (WHERE NOT empty AND label = 'negatif') / count(*) FILTER (WHERE NOT empty), 2) AS pct_negatif, count(*) FILTER (WHERE NOT empty AND label = 'netral') AS n_netral, round_even(100.0 * count(*) FILTER (WHERE NOT empty AND n_token > 128) / count(*) FILTER (WHERE NOT empty), 2) AS pct_truncated,
round(avg(p_netral) FILTER (WHERE NOT empty), 6) AS mean_p_netral, CAST(quantile_cont(n_token, 0.5) FILTER (WHERE NOT empty) AS DOUBLE) AS token_median, max(n_token) FILTER (WHERE NOT empty) AS token_max, max(abs(p_negatif + p_netral + p_positif - 1)) FILTER (WHERE NOT empty) < 1e-9 AS sums FROM x"""


@query("prediction_report", SUMMARY)
def prediction_report(spark: SparkSession, d: str) -> DataFrame:
    """A16 with empty and very short texts, shares and truncation."""
    empty = F.col("event_id") % 23 == 0
    s = scored(spark, d).withColumns({c: F.when(~empty, p) for c, p in zip(C.PROBABILITIES, probs(), strict=True)})
    s = s.withColumns({"n_token": F.when(~empty, F.col("event_id") % 200), "truncated": ~empty & (F.col("event_id") % 200 > 128), "text": F.when(~empty, F.repeat(F.lit("kata "), (F.col("event_id") % 4).cast("int")))})
    r = eda.prediction_summary(s)
    return r.select("n", "n_scored", "n_empty", "n_very_short", "pct_negatif", "n_netral", "pct_truncated", F.round("mean_p_netral", 6).alias("mean_p_netral"), "token_median", "token_max", (F.col("worst_sum") < 1e-9).alias("sums"))


@query("version_comparison", f"WITH {SCORED}, a AS (SELECT event_id, {LABEL} AS label FROM p WHERE event_id % 3 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'netral' ELSE {LABEL} END AS label FROM p WHERE event_id % 7 <> 0) SELECT a.label AS lama, count(*) FILTER (WHERE b.label = 'negatif') AS negatif, count(*) FILTER (WHERE b.label = 'netral') AS netral, count(*) FILTER (WHERE b.label = 'positif') AS positif FROM a JOIN b USING (event_id) GROUP BY a.label")
def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Labels of two versions, joined by id."""
    s = scored(spark, d).select("event_id", C.argmax_label(*probs()).alias("label"))
    new = s.where("event_id % 7 <> 0").select("event_id", F.when(F.col("event_id") % 5 == 0, "netral").otherwise(F.col("label")).alias("label_baru"))
    return eda.confusion(s.where("event_id % 3 <> 0").join(new, "event_id"), "label", "label_baru")


OVERVIEW = r"""WITH r AS (SELECT p_brand AS toko, 'Samsung ' || p_name AS produk, p_size AS rating, 'Variasi: ' || split_part(p_type, ' ', 1) || ', ' || CAST(p_size AS VARCHAR) || '/128GB' AS variation, p_name AS text FROM part),
w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM r)
SELECT 'toko' AS measure, toko AS key, count(*) AS n FROM r GROUP BY toko UNION ALL SELECT 'produk', produk, count(*) FROM r GROUP BY produk UNION ALL SELECT 'merek', 'Samsung', count(*) FROM r UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), count(*) FROM r GROUP BY rating
UNION ALL SELECT 'bulan', strftime(DATE '2024-01-15' + CAST(rating AS INTEGER) * 30, '%Y-%m'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'kapasitas', CAST(rating AS VARCHAR) || '/128GB', count(*) FROM r GROUP BY rating UNION ALL SELECT 'warna', split_part(variation[10:], ',', 1), count(*) FROM r GROUP BY 2
UNION ALL SELECT 'kata', key, count(*) FROM w WHERE length(key) >= 3 GROUP BY key UNION ALL SELECT 'teks_berulang', '', CAST(count(*) - count(DISTINCT text) AS BIGINT) FROM r"""


@query("overview_report", OVERVIEW)
def overview_report(spark: SparkSession, d: str) -> DataFrame:
    """A27 PR18 PR28: all measures."""
    r = table(spark, d, "part").selectExpr("p_brand AS nama_toko", "concat('Samsung ', p_name) AS nama_produk", "p_size AS rating", "CAST(date_add(DATE'2024-01-15', CAST(p_size * 30 AS INT)) AS TIMESTAMP_NTZ) AS timestamp", "concat('Variasi: ', split_part(p_type, ' ', 1), ', ', p_size, '/128GB') AS variation", "p_name AS text")
    return eda.overview(r)


@query("mean_ratings", "SELECT p_brand AS nama_produk, count(*) AS n, round(avg(p_size), 6) AS rating FROM part GROUP BY p_brand")
def mean_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Average ratings."""
    return eda.mean_rating(table(spark, d, "part").selectExpr("p_brand AS nama_produk", "p_size AS rating")).withColumn("rating", F.round("rating", 6))


@query("described", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_linenumber")))
def described(spark: SparkSession, d: str) -> DataFrame:
    """A36 X24."""
    out = eda.described(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "median", "q75")})


@query("histogram", f"WITH {SCORED}, b AS (SELECT CAST(least(floor(p_negatif / 0.125), 7) AS INTEGER) AS bin FROM p) SELECT CAST(g.k AS INTEGER) AS bin, count(b.bin) AS n FROM range(8) AS g(k) LEFT JOIN b ON b.bin = g.k GROUP BY g.k")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    """X24."""
    return eda.histogram(scored(spark, d), "p_negatif", 0.0, 1.0, 8)


@query(
    "slang_source",
    """WITH s AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'w' || CAST(p_partkey % 40 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END END AS slang, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'Lain' ELSE 'Kata' END AS formal, CASE WHEN p_partkey % 8 = 0 THEN '1' ELSE '0' END AS kamus, p_partkey FROM part),
    k AS (SELECT regexp_replace(translate(slang, '0123456789', 'abcdefghij'), '^$', '') AS key, formal, kamus, p_partkey FROM s),
    v AS (SELECT *, (SELECT count(DISTINCT formal) FROM k AS o WHERE o.key = k.key) AS variants, row_number() OVER (PARTITION BY key, formal ORDER BY kamus, p_partkey) AS r FROM k)
    SELECT coalesce(CASE WHEN key = '' THEN 'slang_kosong' WHEN formal = '' THEN 'baku_kosong' WHEN kamus = '1' THEN 'kata_kamus' WHEN variants > 1 THEN 'ambigu' WHEN r > 1 THEN 'duplikat' END, 'masuk') AS alasan, count(*) AS n FROM v GROUP BY 1""",
)
def slang_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a raw dictionary by the first reason to leave them out."""
    raw = table(spark, d, "part").selectExpr("translate(CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE concat('W', p_partkey % 40, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END) END, '0123456789', 'abcdefghij') AS slang", "CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'Lain' ELSE 'Kata' END AS formal", "CASE WHEN p_partkey % 8 = 0 THEN '1' ELSE '0' END AS in_dictionary")
    rows, _ = audits.slang_source_profile(raw)
    return rows.groupBy(F.coalesce("reason", F.lit("masuk")).alias("alasan")).agg(F.count("*").alias("n"))


@query("slang_alternatives", "SELECT lower(p_brand) AS key, count(DISTINCT p_size % 3) AS n, string_agg(DISTINCT CAST(p_size % 3 AS VARCHAR), ' | ' ORDER BY CAST(p_size % 3 AS VARCHAR)) AS standards FROM part GROUP BY p_brand HAVING count(DISTINCT p_size % 3) > 1")
def slang_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """The standards that a key has."""
    return audits.slang_alternatives(table(spark, d, "part").selectExpr("concat(' ', p_brand) AS slang", "CAST(p_size % 3 AS STRING) AS formal")).select("key", "n", F.array_join("standards", " | ").alias("standards"))


@query("protected_terms", "SELECT 'ori' AS term, CAST(count(*) FILTER (WHERE p_partkey % 3 = 0) AS BIGINT) AS lost, CAST(count(*) FILTER (WHERE p_partkey % 5 = 0) AS BIGINT) AS gained FROM part UNION ALL SELECT 'bukan kw', CAST(2 * count(*) FILTER (WHERE p_partkey % 4 = 0) AS BIGINT), CAST(0 AS BIGINT) FROM part")
def protected_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that a chain lost or gained."""
    p = table(spark, d, "part").selectExpr("concat(CASE WHEN p_partkey % 3 = 0 THEN 'ORI x' ELSE 'orix' END, CASE WHEN p_partkey % 4 = 0 THEN ' bukan  kw bukan kw' ELSE '' END) AS a", "concat(CASE WHEN p_partkey % 5 = 0 THEN 'ori' ELSE '' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN ' ' ELSE '' END) AS b", "p_partkey")
    before = F.concat("a", F.lit(" "))
    c = p.select(F.explode(audits.protected_counts(before, F.when((F.col("p_partkey") % 3 == 0) & (F.col("p_partkey") % 5 == 0), F.lit("ori")).otherwise(F.col("b")), ("ori", "bukan kw"))).alias("c")).select("c.*")
    both = p.where("p_partkey % 15 = 0").select(F.explode(audits.protected_counts(F.lit("ori ori"), F.lit("ori"), ("ori",))).alias("c")).select("c.*")
    gained = p.where("p_partkey % 15 = 0").select(F.explode(audits.protected_counts(F.lit(""), F.lit("ori"), ("ori",))).alias("c")).select("c.*")
    return c.unionByName(both).unionByName(gained).groupBy("term").agg(F.sum("lost").cast("bigint").alias("lost"), F.sum("gained").cast("bigint").alias("gained"))


@query("replacement_trace", "WITH t AS (SELECT o_orderkey AS id, o_custkey % 7 AS k, o_orderkey % 3 AS m FROM orders) SELECT 'k' || CAST(k AS VARCHAR) AS key, 'b' AS standard, CAST(sum(m) AS BIGINT) AS n, count(*) FILTER (WHERE m > 0) AS n_reviews, least(3, count(*) FILTER (WHERE m > 0)) AS examples FROM t GROUP BY k HAVING sum(m) > 0")
def replacement_trace(spark: SparkSession, d: str) -> DataFrame:
    """Replacements by key, with reviews and examples."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.array_repeat(F.struct(F.concat(F.lit("k"), (F.col("o_custkey") % 7).cast("string")).alias("key"), F.lit("b").alias("standard")), (F.col("o_orderkey") % 3).cast("int")).alias("slang"))
    return audits.replacement_trace(t).select("key", "standard", "n", "n_reviews", F.size("examples").cast("bigint").alias("examples"))


@query(
    "spoilt_export",
    f"""WITH {AUDIT}, z AS (SELECT * FROM audit WHERE alasan_keluar = ''), n AS (SELECT count(*) FILTER (WHERE seq_sekuens % 10 = 0) AS tens, count(*) AS rows, (SELECT count(*) FROM audit WHERE alasan_keluar <> '' AND event_id % 4 = 0) AS out4 FROM z),
    g AS (SELECT count(*) AS g FROM (SELECT product_id FROM z GROUP BY product_id HAVING max(seq_sekuens) >= 10))
    SELECT name, CAST(violations AS BIGINT) AS violations FROM (SELECT 'jumlah probabilitas 1' AS name, tens AS violations FROM n UNION ALL SELECT 'kunci (produk, seq) unik', tens FROM n UNION ALL SELECT 'urutan 1..T', g FROM g
    UNION ALL SELECT 'dikeluarkan = B di luar sekuens', out4 FROM n UNION ALL SELECT 'A dapat dibentuk dari B', 2 * tens FROM n UNION ALL SELECT 'sel masukan sama', 0 UNION ALL SELECT 'kolom A persis', 0 UNION ALL SELECT 'sama dengan pengelompokan lama', 0 UNION ALL SELECT 'probabilitas hingga', 0)""",
)
def spoilt_export(spark: SparkSession, d: str) -> DataFrame:
    """A14 on a spoilt export: every tenth step comes a second time with another probability, and a quarter of the left-out rows is missing."""
    source = export_source(spark, d)
    audit = sequences.audit_table(source)
    a = sequences.sequence_table(audit)
    twice = a.where("seq % 10 = 0").withColumn("p_positif", (F.col("p_positif").cast("double") + 0.5).cast("string"))
    checks = sequences.export_checks(source, audit, a.unionByName(twice), sequences.excluded_table(audit).where("CAST(review_id AS BIGINT) % 4 <> 0"))
    moved = F.when(F.col("name") == "A dapat dibentuk dari B", 2 * F.col("violations")).otherwise(F.col("violations"))
    named = ("jumlah probabilitas 1", "kunci (produk, seq) unik", "urutan 1..T", "dikeluarkan = B di luar sekuens", "A dapat dibentuk dari B", "sel masukan sama", "kolom A persis", "sama dengan pengelompokan lama", "probabilitas hingga")
    return checks.where(F.col("name").isin(*named)).select("name", moved.cast("bigint").alias("violations"))


@query("leakage_checks", "SELECT name, CAST(violations AS BIGINT) AS violations FROM (SELECT 'fit di dalam train' AS name, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 = 0) AS violations UNION ALL SELECT 'train dan test terpisah', (SELECT count(*) FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 = 0) UNION ALL SELECT 'sintetis tidak dalam fit', (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 = 0) UNION ALL SELECT 'sintetis tidak dalam test', (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 = 0))")
def leakage_checks(spark: SparkSession, d: str) -> DataFrame:
    """Products that a leaking split shares."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"))
    return audits.leakage(c.where("product_id % 3 = 0"), c.where("product_id % 4 <> 0"), c.where("product_id % 5 = 0"), c.where("product_id % 7 = 0")).select("name", "violations")


@query("unordered_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unordered_customers(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one table that a part of another lacks."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey")


@query("from_text", f"WITH {AUDIT}, t AS (SELECT user_id, count(*) FILTER (WHERE event_id % 17 <> 0 AND event_id % 13 <> 0) AS t FROM p GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS product_id, t FROM t WHERE t >= 3")
def from_text(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of a table of texts."""
    return sequences.build_sequences(sequences.from_text(export_source(spark, d).drop("nama_toko", "nama_produk"))).select("product_id", "t")


@query("temporary_split", "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey AS product_id, CASE WHEN k <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM c")
def temporary_split(spark: SparkSession, d: str) -> DataFrame:
    """T8."""
    return split.temporary_split(table(spark, d, "customer").select(F.col("c_custkey").alias("product_id")))


@query("best_partners", "WITH p AS (SELECT p_brand AS file, CAST(p_partkey AS VARCHAR) AS partner, CAST(p_size AS DOUBLE) AS pct, p_partkey % 2 = 0 AS identical FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pct DESC, identical DESC, partner) AS k FROM p) SELECT file, partner, pct FROM r WHERE k = 1")
def best_partners(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    return overlap.best_partners(table(spark, d, "part").selectExpr("p_brand AS file", "CAST(p_partkey AS STRING) AS partner", "CAST(p_size AS DOUBLE) AS pct", "p_partkey % 2 = 0 AS identical")).select("file", "partner", "pct")


@query("state_likelihood", f"""WITH RECURSIVE {SCORED}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, p_negatif AS a, p_netral AS b, p_positif AS c FROM p),
e AS (SELECT user_id, t, exp(-0.5 * (3 * ln(2 * pi()) + 3 * ln(0.04) + (pow(a - 0.1, 2) + pow(b - 0.3, 2) + pow(c - 0.6, 2)) / 0.04)) AS e0, exp(-0.5 * (3 * ln(2 * pi()) + 3 * ln(0.04) + (pow(a - 0.6, 2) + pow(b - 0.3, 2) + pow(c - 0.1, 2)) / 0.04)) AS e1 FROM o),
f AS (SELECT user_id, t, 0.6 * e0 / (0.6 * e0 + 0.4 * e1) AS f0, 0.4 * e1 / (0.6 * e0 + 0.4 * e1) AS f1, ln(0.6 * e0 + 0.4 * e1) AS ll FROM e WHERE t = 1
  UNION ALL SELECT e.user_id, e.t, (f0 * 0.8 + f1 * 0.3) * e0 / ((f0 * 0.8 + f1 * 0.3) * e0 + (f0 * 0.2 + f1 * 0.7) * e1), (f0 * 0.2 + f1 * 0.7) * e1 / ((f0 * 0.8 + f1 * 0.3) * e0 + (f0 * 0.2 + f1 * 0.7) * e1), ll + ln((f0 * 0.8 + f1 * 0.3) * e0 + (f0 * 0.2 + f1 * 0.7) * e1)
  FROM f JOIN e ON e.user_id = f.user_id AND e.t = f.t + 1)
SELECT CAST(user_id AS VARCHAR) AS product_id, max(t) AS n_reviews, round(arg_max(ll, t) / max(t), 5) AS log_lik FROM f GROUP BY user_id HAVING max(t) >= 3""")
def state_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods under the first model, saved and loaded, by a scan of each sequence."""
    s = sequences.build_sequences(scored(spark, d).withColumnsRenamed({"user_id": "product_id", "ts": "timestamp", "event_id": "row_order"}))
    model = hmm.Model.from_json(hmm.first_model().to_json())
    return hmm.features(s, model).select("product_id", F.col("n_reviews").cast("bigint").alias("n_reviews"), F.round("log_lik", 5).alias("log_lik"))


@query("text_steps", rf"SELECT doc_id, {WORDS.format('t')} AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def text_steps(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text, null as none."""
    return table(spark, d, "documents").select("doc_id", C.word_count(F.coalesce("text", F.lit(""))).alias("n"))


ONE = "p_name"
for _d in "abcdefghijklmnopqrstuvwxyz":
    ONE = f"regexp_replace({ONE}, '{_d}{{3,}}', '{_d}', 'g')"
TWO = ONE
for _d in "abcdefghijklmnopqrstuvwxyz":
    TWO = TWO.replace(f"'{_d}', 'g'", f"'{_d}{_d}', 'g'")


@query("markup_stripped", "SELECT p_partkey, ' ' || p_name || '!' || chr(160) || ' ' AS markup, p_name || '    ' AS url, p_name || ' x y' || chr(128104) || chr(8205) || chr(128105) AS controls, p_name || ' ABC 12 fi' AS forms FROM part")
def markup_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Entities before tags, addresses, control and joining characters, compatibility forms, each over a name."""
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", T.without_markup(F.concat(F.lit("&lt;i&gt;"), n, F.lit("&#33;&nbsp;<br/>"))).alias("markup"), T.LIGHT["hapus_url"](F.concat(n, F.lit(" HTTPS://a.b/c?d www.x.y"))).alias("url"),
        T.without_controls(F.concat(n, F.lit("\t\u200bx\u0007y\u200d\u00ad\U0001f468\u200d\U0001f469"))).alias("controls"), T.nfkc(F.concat(n, F.lit(" \uff21\uff22\uff23 \uff11\uff12 \ufb01"))).alias("forms"),
    )


@query("light_chain", rf"SELECT p_partkey, trim(regexp_replace({TWO} || ' baguss 5000 a', '\s+', ' ', 'g')) AS text, TRUE AS hapus_html, TRUE AS hapus_url, FALSE AS normalisasi_nfkc, TRUE AS kurangi_huruf_berulang FROM part")
def light_chain(spark: SparkSession, d: str) -> DataFrame:
    """The whole light chain, and which steps changed a text."""
    c = T.clean_light(F.concat("p_name", F.lit(" <b>bagussss</b> 5000 http://x.y  a")))
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.text", "c.hapus_html", "c.hapus_url", "c.normalisasi_nfkc", "c.kurangi_huruf_berulang")


@query("proposal_chain", rf"SELECT p_partkey, trim(regexp_replace('Bagus! ' || {ONE} || ' tidak BANGET KW bukan ori 12345 a b!?', '\s+', ' ', 'g')) AS text, TRUE AS hapus_angka_panjang, TRUE AS normalisasi_slang, 'bgt>banget gk>tidak' AS slang FROM part")
def proposal_chain(spark: SparkSession, d: str) -> DataFrame:
    """The whole proposal chain over a name, with its replacements."""
    words = F.concat(F.lit("Bagusss!!! "), F.col("p_name"), F.lit(" gk BGT KW bukan  ori 1234567 12345 *\ufe0f\u20e3 a\u2028b\u200b!?\U0001f44d www.x.y"))
    c = T.clean_proposal(words, {"gk": "tidak", "bgt": "banget", "ori": "asli", "kw": "tiruan"})
    traced = F.array_join(F.array_sort(F.transform("c.slang", lambda s: F.concat_ws(">", s["key"], s["standard"]))), " ")
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.text", "c.hapus_angka_panjang", "c.normalisasi_slang", traced.alias("slang"))


@query("lexical_chain", rf"SELECT p_partkey, regexp_replace('barang tidak_bagus sesuai_deskripsi ' || lower({'p_name'}), '\s+', ' ', 'g') AS tokens FROM part")
def lexical_chain(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary, seed phrases, punctuation and digits, negation and stop words around a name."""
    chain = T.LexicalChain(["sesuai deskripsi"], ["tidak"], domain={"brg": "barang"}, public={"gk": "tidak", "brg": "x"}, stopwords=["yang"])
    words = F.concat(F.lit("Brg yang gk bagus, Sesuai   deskripsi 100 "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.lexical_tokens(words, chain), " ").alias("tokens"))


@query("classification_metrics", f"WITH {SCORED}, l AS (SELECT {LABEL} AS a, CASE WHEN event_id % 5 = 0 THEN 'netral' ELSE {LABEL} END AS b FROM p), k AS (SELECT unnest(['negatif', 'netral', 'positif']) AS k), f AS (SELECT k, count(*) FILTER (WHERE a = k) AS support, 2.0 * count(*) FILTER (WHERE a = k AND b = k) / nullif(count(*) FILTER (WHERE a = k) + count(*) FILTER (WHERE b = k), 0) AS f1 FROM k, l GROUP BY k HAVING count(*) FILTER (WHERE a = k) + count(*) FILTER (WHERE b = k) > 0) SELECT round((SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FROM l), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The scorer's metrics (section 2.11)."""
    l_ = scored(spark, d).select("event_id", C.argmax_label(*probs()).alias("a")).withColumn("b", F.when(F.col("event_id") % 5 == 0, "netral").otherwise(F.col("a")))
    return score.classification_metrics(l_, "a", "b").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("sequence_file", f"WITH {SCORED}, t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM p) SELECT user_id AS product_id, CAST(k AS INTEGER) AS step, round(p_negatif, 9) AS p_negatif, round(p_positif, 9) AS p_positif FROM t WHERE n >= 3")
def sequence_file(spark: SparkSession, d: str) -> DataFrame:
    """SK6 H1: sequences of differing lengths, written as arrays and read again."""
    s = sequences.build_sequences(scored(spark, d).withColumnsRenamed({"user_id": "product_id", "ts": "timestamp", "event_id": "row_order"}))
    path = sinks.shared_folder(spark, "sequences")
    sinks.write_new(s, path)
    steps = spark.read.parquet(path).select("product_id", F.posexplode("steps").alias("step", "s"))
    return steps.select("product_id", "step", F.round(F.col("s.x")[0], 9).alias("p_negatif"), F.round(F.col("s.x")[2], 9).alias("p_positif"))
