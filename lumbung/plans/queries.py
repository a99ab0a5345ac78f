"""The engine's operators as queries over the test tables, each with its SQL where SQL can say the same.

Documents stand for reviews (a language is a product, a source a file), events for scored reviews of a user.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.config import HmmConfig, LexiconConfig
from lumbung.functions import columns as C
from lumbung.operators import audits, clean, eda, hmm, lexicon, overlap, profile, score, sequences, split

log = logging.getLogger(__name__)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the columns that flags need."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("lang").alias("product_id"), F.coalesce("text", F.lit("")).alias("text_light"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(date_add(DATE'2024-01-01', CAST(doc_id % 5 AS INT)) AS TIMESTAMP_NTZ) END").alias("timestamp"),
        (F.col("doc_id") % 3 != 0).alias("timestamp_has_time"), F.lit(False).alias("timestamp_is_estimated"), F.col("source").alias("source_file"), F.col("doc_id").alias("row_order"),
    )


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return clean.with_flags(reviews(spark, d))


REVIEWS = r"""
r AS (SELECT doc_id AS review_id, lang AS product_id, coalesce(text, '') AS text_light, source AS source_file, doc_id AS row_order,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS TIMESTAMP) END AS ts, doc_id % 3 <> 0 AS has_time FROM documents),
f0 AS (SELECT *, CAST(length(text_light) AS BIGINT) AS n_chars,
  CAST(len(list_filter(regexp_split_to_array(text_light, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, text_light = '' AS is_empty,
  text_light <> '' AND ts IS NOT NULL AND has_time AS e FROM r),
f1 AS (SELECT *, NOT is_empty AND n_chars < 2 AS is_short,
  e AND row_number() OVER (PARTITION BY product_id, text_light, ts, e ORDER BY source_file, row_order, review_id) > 1 AS is_technical_duplicate FROM f0),
flags AS (SELECT *, CASE WHEN is_empty THEN 0 ELSE count(*) OVER (PARTITION BY product_id, text_light) END AS dup_group_size,
  NOT is_empty AND count(CASE WHEN NOT is_technical_duplicate THEN 1 END) OVER (PARTITION BY product_id, text_light) >= 2 AS is_text_duplicate,
  NOT is_empty AND NOT is_short AND NOT is_technical_duplicate AS include_for_inference,
  row_number() OVER (PARTITION BY product_id ORDER BY ts NULLS LAST, source_file, row_order, review_id) AS seq_in_product FROM f1)
"""


@query(
    "review_flags",
    f"""WITH {REVIEWS} SELECT review_id, n_chars, n_words, is_empty, is_short, is_technical_duplicate, is_text_duplicate,
    CAST(dup_group_size AS BIGINT) AS dup_group_size, include_for_inference, CAST(seq_in_product AS BIGINT) AS seq_in_product FROM flags""",
)
def review_flags(spark: SparkSession, d: str) -> DataFrame:
    """W1 W2 W3 W4 PR10 S31 S32."""
    return flagged(spark, d).select("review_id", "n_chars", "n_words", "is_empty", "is_short", "is_technical_duplicate", "is_text_duplicate", "dup_group_size", "include_for_inference", "seq_in_product")


@query(
    "date_only_candidates",
    f"""WITH {REVIEWS} SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT row_number() OVER (PARTITION BY product_id, text_light, ts ORDER BY source_file, row_order) AS k
    FROM flags WHERE NOT is_empty AND ts IS NOT NULL AND NOT has_time) WHERE k > 1""",
)
def date_only(spark: SparkSession, d: str) -> DataFrame:
    """W5."""
    return clean.date_only_candidates(flagged(spark, d))


@query(
    "product_summary",
    f"""WITH {REVIEWS} SELECT product_id, string_agg(DISTINCT source_file, ' | ' ORDER BY source_file) AS nama_toko, count(*) AS n_baris, count(*) FILTER (WHERE include_for_inference) AS n_include,
    count(*) FILTER (WHERE include_for_inference AND ts IS NULL) AS n_include_nat, count(*) FILTER (WHERE include_for_inference AND ts IS NOT NULL) AS n_terurut,
    count(*) FILTER (WHERE include_for_inference AND ts IS NOT NULL) >= 3 AS lolos_3, count(*) FILTER (WHERE include_for_inference AND ts IS NOT NULL) >= 5 AS lolos_5,
    count(*) FILTER (WHERE include_for_inference AND ts IS NOT NULL) >= 10 AS lolos_10 FROM flags GROUP BY product_id""",
)
def product_summary(spark: SparkSession, d: str) -> DataFrame:
    """A10 J3."""
    r = flagged(spark, d).withColumns({"nama_toko": F.col("source_file"), "nama_produk": F.col("product_id")})
    return audits.product_summary(r).drop("nama_produk", "pertama", "terakhir")


@query(
    "monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS bulan, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1",
)
def monthly_counts(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return eda.monthly(table(spark, d, "orders"), "o_orderdate")


@query(
    "time_validity",
    f"""WITH {REVIEWS}, k AS (SELECT CASE WHEN ts IS NOT NULL AND has_time THEN 'dengan_jam' WHEN ts IS NOT NULL THEN 'tanpa_jam' ELSE 'tidak_valid' END AS kategori FROM r
    UNION ALL SELECT 'status:' || CASE WHEN ts IS NULL THEN 'tak_terparsing' ELSE 'ok' END FROM r)
    SELECT kategori, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 2) AS persen FROM k GROUP BY kategori""",
)
def time_validity(spark: SparkSession, d: str) -> DataFrame:
    """A22 S34."""
    r = reviews(spark, d).withColumn("timestamp_status", F.when(F.col("timestamp").isNull(), "tak_terparsing").otherwise("ok"))
    return eda.time_validity(r).withColumn("persen", F.round("persen", 2))


@query(
    "text_quality",
    f"""WITH {REVIEWS}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_empty) AS kosong, count(*) FILTER (WHERE n_words BETWEEN 1 AND 2) AS pendek, 0 AS penjual,
    count(*) FILTER (WHERE is_technical_duplicate) AS duplikat_teknis, count(*) FILTER (WHERE is_text_duplicate) AS duplikat_teks FROM flags)
    SELECT indikator, CAST(n AS BIGINT) AS n, round(100.0 * n / total, 2) AS persen FROM (
    SELECT 'kosong' AS indikator, kosong AS n, total FROM t UNION ALL SELECT 'pendek', pendek, total FROM t UNION ALL SELECT 'penjual', penjual, total FROM t
    UNION ALL SELECT 'duplikat_teknis', duplikat_teknis, total FROM t UNION ALL SELECT 'duplikat_teks', duplikat_teks, total FROM t)""",
)
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    r = flagged(spark, d).withColumns({"text_proposal": F.col("text_light"), "text_proposal_kosong": F.col("is_empty"), "seller_reply_suspect": F.lit(False)})
    return eda.text_quality(r)


@query(
    "cleaning_ledger",
    f"""WITH {REVIEWS} SELECT stage, rule, before, after, before - after AS affected, unit FROM (
    SELECT 'teks' AS stage, 'teks kosong setelah dibersihkan' AS rule, count(*) AS before, count(*) FILTER (WHERE NOT is_empty) AS after, 'ulasan' AS unit FROM flags
    UNION ALL SELECT 'duplikat', 'duplikat teknis', count(*), count(*) FILTER (WHERE NOT is_technical_duplicate), 'ulasan' FROM flags
    UNION ALL SELECT 'keluaran', 'masuk inferensi', count(*), count(*) FILTER (WHERE include_for_inference), 'ulasan' FROM flags)""",
)
def cleaning_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The library's short form; the full one is folder_ledger's."""
    r = flagged(spark, d)
    rows = r.select(F.lit(None).cast("string").alias("drop_reason"))
    return audits.flag_ledger(rows, r).where("rule IN ('teks kosong setelah dibersihkan', 'duplikat teknis', 'masuk inferensi')")


@query("funnel", f"""WITH {REVIEWS}, b AS (SELECT product_id, count(*) AS n, count(*) FILTER (WHERE include_for_inference AND ts IS NOT NULL) AS u FROM flags GROUP BY 1)
    SELECT 'berkas' AS tahap, CAST(count(DISTINCT source_file) AS BIGINT) AS n FROM flags UNION ALL SELECT 'baris_sumber', count(*) FROM flags UNION ALL SELECT 'ulasan', CAST(sum(n) AS BIGINT) FROM b
    UNION ALL SELECT 'dapat_dipakai', CAST(sum(u) AS BIGINT) FROM b UNION ALL SELECT 'produk_cukup', CAST(sum(u) FILTER (WHERE u >= 3) AS BIGINT) FROM b""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """A17 U1."""
    r = flagged(spark, d)
    manifest = r.groupBy("source_file").agg(F.count("*").alias("n_baris_sumber")).withColumn("status", F.lit("ok"))
    return eda.funnel(manifest, r)


CELLS_SQL = """cells AS (
  SELECT 'customer' AS file, c_custkey AS row_order, 0 AS position, 'c_name' AS col, c_name AS value FROM customer
  UNION ALL SELECT 'customer', c_custkey, 1, 'c_mktsegment', c_mktsegment FROM customer
  UNION ALL SELECT 'customer', c_custkey, 2, 'rating', CAST(c_custkey % 5 + 1 AS VARCHAR) FROM customer
  UNION ALL SELECT 'customer', c_custkey, 3, 'timestamp', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '2024-01-0' || CAST(c_custkey % 9 + 1 AS VARCHAR) END FROM customer
  UNION ALL SELECT 'customer', c_custkey, 4, 'time', CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '3 hari lalu' END FROM customer
  UNION ALL SELECT 'part', p_partkey, 0, 'p_name', p_name FROM part
  UNION ALL SELECT 'part', p_partkey, 1, 'p_brand', p_brand || ':' FROM part
  UNION ALL SELECT 'part', p_partkey, 2, 'p_size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'part', p_partkey, 3, 'penanda', CASE WHEN p_partkey % 3 = 0 THEN 'Respon Penjual:' ELSE '' END FROM part
  UNION ALL SELECT 'part', p_partkey, 4, 'balasan', CASE WHEN p_partkey % 3 = 0 THEN 'terima kasih kami akan bantu ' || p_type ELSE '' END FROM part
  UNION ALL SELECT 'pages', page_id, 0, 'url', url FROM pages
  UNION ALL SELECT 'pages', page_id, 1, 'html', html FROM pages)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Columns of three tables in long form, as a folder of files would give them."""
    t = {n: table(spark, d, n) for n in ("customer", "part", "pages")}
    key = {"customer": "c_custkey", "part": "p_partkey", "pages": "page_id"}
    parts = [
        ("customer", "c_name", "c_name"), ("customer", "c_mktsegment", "c_mktsegment"), ("customer", "rating", "CAST(c_custkey % 5 + 1 AS STRING)"), ("customer", "timestamp", "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '2024-01-0' || CAST(c_custkey % 9 + 1 AS STRING) END"),
        ("customer", "time", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '3 hari lalu' END"), ("part", "p_name", "p_name"), ("part", "p_brand", "p_brand || ':'"), ("part", "p_size", "CAST(p_size AS STRING)"),
        ("part", "penanda", "CASE WHEN p_partkey % 3 = 0 THEN 'Respon Penjual:' ELSE '' END"), ("part", "balasan", "CASE WHEN p_partkey % 3 = 0 THEN 'terima kasih kami akan bantu ' || p_type ELSE '' END"), ("pages", "url", "url"), ("pages", "html", "html"),
    ]
    out, place = None, {}
    for file, column, value in parts:
        n = place.get(file, 0)
        place[file] = n + 1
        one = t[file].selectExpr(f"'{file}' AS file", f"{key[file]} AS row_order", f"{n} AS position", f"'{column}' AS column", f"{value} AS value")
        out = one if out is None else out.unionByName(one)
    return out


TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
KIND = rf"""CASE WHEN lower(v) IN ('', 'nan', 'none', 'null', '<na>') THEN 'kosong'
  WHEN regexp_full_match(v, '(?s)\d{{4}}-\d{{2}}-\d{{2}}(?:[ T]\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?\s*(?:\|.*)?') THEN 'tanggal'
  WHEN regexp_full_match(v, '(?i)(?:\d+\s*(?:detik|menit|jam|hari|minggu|bulan|tahun)\s*(?:yang\s*)?lalu|kemarin|hari ini|baru saja)') THEN 'tanggal_relatif'
  WHEN regexp_full_match(v, '(?i)(?:https?://|www\.)\S+') THEN 'url'
  WHEN lower(v) IN ('respon penjual:', 'respon penjual', 'seller response', 'balasan penjual:') THEN 'penanda_penjual'
  WHEN regexp_full_match(v, '\S\*{{3,}}\S') THEN 'nama_tersamar'
  WHEN NOT regexp_matches(v, '\p{{L}}') AND regexp_matches(v, '\p{{Nd}}') THEN 'angka'
  WHEN NOT regexp_matches(v, '\p{{L}}') AND regexp_matches(v, '\p{{So}}') THEN 'teks'
  WHEN NOT regexp_matches(v, '\p{{L}}') THEN 'simbol'
  WHEN v LIKE '%:' AND {WORDS.format("v")} <= 4 THEN 'label_aspek' ELSE 'teks' END"""
STYLE = r"(?is)pelanggan yang terhormat|\b(?:toko|produk|customer service|cs|admin) kami\b|\bkami (?:akan|mohon|minta|harap|berharap)\b|(?:terima ?kasih|makasih|trimakasih|terimakasih)\b.{0,30}\batas\b.{0,20}\b(?:ulasan|penilaian|review|rating|kepercayaan|dukungan|orderan)|\b(?:sudah|telah) berbelanja\b"
PROFILE_SQL = f"""{CELLS_SQL}, v AS (SELECT *, {TRIM.format("value")} AS v FROM cells), k AS (SELECT *, {KIND} AS kind, {WORDS.format("v")} AS w FROM v),
profiles AS (SELECT file, col, position, count(*) AS n_rows, count(*) FILTER (WHERE kind <> 'kosong') AS n_nonempty,
  {", ".join(f"coalesce(avg(CASE WHEN kind IN ({', '.join(repr(x) for x in ks)}) THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind <> 'kosong'), 0.0) AS {name}" for name, ks in profile.RATES.items())},
  coalesce(avg(CASE WHEN regexp_matches(v, '{STYLE}') THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind <> 'kosong'), 0.0) AS seller_style_rate,
  coalesce(avg(CASE WHEN regexp_full_match(v, '[A-Za-z0-9._]+') AND regexp_matches(v, '[0-9_.]') THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind <> 'kosong'), 0.0) AS handle_rate,
  coalesce(avg(CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind <> 'kosong'), 0.0) AS one_word_rate,
  coalesce(avg(CASE WHEN regexp_full_match(v, '[1-5]') THEN 1.0 ELSE 0.0 END) FILTER (WHERE kind <> 'kosong'), 0.0) AS int_1_5_rate,
  coalesce(avg(length(v)) FILTER (WHERE kind <> 'kosong'), 0.0) AS mean_chars, coalesce(avg(w) FILTER (WHERE kind <> 'kosong'), 0.0) AS mean_words,
  count(DISTINCT CASE WHEN kind <> 'kosong' THEN v END) AS n_unique FROM k GROUP BY file, col, position)"""


@query("classify_cells", f"WITH {CELLS_SQL}, v AS (SELECT *, {TRIM.format('value')} AS v FROM cells) SELECT file, col, row_order, {KIND} AS kind FROM v")
def classify_cells(spark: SparkSession, d: str) -> DataFrame:
    """PR1 X3 X12."""
    return cells(spark, d).select("file", F.col("column").alias("col"), "row_order", C.classify(F.col("value")).alias("kind"))


_RATES = [*profile.RATES, "seller_style_rate", "handle_rate", "one_word_rate", "int_1_5_rate", "mean_chars", "mean_words"]


@query("column_profile", f"WITH {PROFILE_SQL} SELECT file, col, n_rows, n_nonempty, n_unique, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM profiles")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """A1 PR2 PR3."""
    p = profile.column_profiles(cells(spark, d))
    return p.select("file", F.col("column").alias("col"), "n_rows", "n_nonempty", "n_unique", *[F.round(c, 6).alias(c) for c in _RATES])


@query(
    "role_assignment",
    f"""WITH {PROFILE_SQL}, m AS (SELECT file, col FROM profiles WHERE n_nonempty > 0 AND seller_marker_rate >= 0.9), filled AS (SELECT * FROM k WHERE v <> ''),
    marked AS (SELECT DISTINCT f.file, f.row_order FROM filled f JOIN m USING (file, col)),
    share AS (SELECT f.file, f.col, avg(CASE WHEN marked.row_order IS NULL THEN 0.0 ELSE 1.0 END) AS cooc FROM filled f LEFT JOIN marked ON f.file = marked.file AND f.row_order = marked.row_order GROUP BY 1, 2),
    p AS (SELECT profiles.*, CASE WHEN profiles.file IN (SELECT file FROM m) THEN cooc END AS cooccurrence, n_unique * 1.0 / nullif(n_nonempty, 0) AS unique_ratio,
      CASE WHEN regexp_matches(col, '^web_scraper_start_url$|src$') THEN 'url_media' WHEN regexp_matches(col, '^(timestamp|time)$') THEN 'timestamp' WHEN col = 'rating' THEN 'metadata' ELSE '' END AS name_hint FROM profiles LEFT JOIN share USING (file, col)),
    r AS (SELECT *, CASE {" ".join(f"WHEN {c} THEN '{role}'" for c, role, _ in profile.role_rules(clean.CleanConfig()))} ELSE 'perlu_cek' END AS role0 FROM p)
    SELECT file, col, CASE WHEN role0 = 'timestamp' AND row_number() OVER (PARTITION BY file, role0 ORDER BY n_nonempty DESC, position) > 1 THEN 'metadata' ELSE role0 END AS role, round(cooccurrence, 6) AS cooccurrence FROM r""",
)
def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    """PR5 PR6 A2."""
    return profile.column_roles(cells(spark, d)).select("file", F.col("column").alias("col"), "role", F.round("cooccurrence", 6).alias("cooccurrence"))


@query(
    "rebuilt_rows",
    f"""WITH roles AS ({ORACLE_SQL["role_assignment"]}), {PROFILE_SQL}, c AS (SELECT k.*, role, role = 'review_text' AND kind = 'teks' AS fragment FROM k JOIN roles ON roles.file = k.file AND roles.col = k.col)
    SELECT file, row_order, CAST(count(*) FILTER (WHERE fragment) AS INTEGER) AS n_fragments, CAST(count(*) FILTER (WHERE role = 'review_text' AND kind = 'label_aspek' OR role = 'aspect_tag' AND v <> '') AS INTEGER) AS n_tags,
    coalesce(max(v) FILTER (WHERE role = 'timestamp'), '') AS timestamp_raw, CASE WHEN count(*) FILTER (WHERE fragment) > 0 THEN NULL WHEN bool_or(role = 'review_text' AND kind <> 'kosong') THEN 'hanya_bukan_teks' ELSE 'sel_kosong' END AS drop_reason,
    coalesce(bool_or(fragment AND regexp_matches(v, '{STYLE}')), FALSE) AS seller_reply_suspect FROM c GROUP BY file, row_order""",
)
def rebuilt_rows(spark: SparkSession, d: str) -> DataFrame:
    """PR7 PR8 PR9."""
    c = cells(spark, d)
    rows = clean.rebuilt_rows(clean.tagged_cells(c, profile.column_roles(c)))
    return rows.select("file", "row_order", F.size("fragments").alias("n_fragments"), F.size("tags").alias("n_tags"), "timestamp_raw", "drop_reason", "seller_reply_suspect")


@query(
    "fragment_join",
    r"""WITH f AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT conv_id, string_agg(t, ' | ' ORDER BY turn) AS review, coalesce(string_agg(CASE WHEN last OR regexp_matches(t, '[.!?…,;:]$') THEN t ELSE t || '.' END, ' ' ORDER BY turn) FILTER (WHERE t <> ''), '') AS light FROM f GROUP BY conv_id""",
)
def fragment_join(spark: SparkSession, d: str) -> DataFrame:
    """S9 S10."""
    f = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("f"))
    return f.select("conv_id", C.joined_review(F.col("f")).alias("review"), C.joined_light(F.col("f")).alias("light"))


@query(
    "duplicate_groups",
    """WITH s AS (SELECT doc_id AS file, sha256(coalesce(text, '')) AS h FROM documents), g AS (SELECT h, min(file) AS first FROM s GROUP BY h HAVING count(*) > 1)
    SELECT file, 'FD' || CASE WHEN k < 10 THEN '0' ELSE '' END || CAST(k AS VARCHAR) AS file_dup_group FROM s JOIN (SELECT h, row_number() OVER (ORDER BY first) AS k FROM g) USING (h)""",
)
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """A6 S30."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    groups = clean.duplicate_files(files)
    return groups.withColumn("file_dup_group", F.regexp_replace("file_dup_group", "^FD(\\d+)$", "FD$1"))


@query(
    "pattern_report",
    r"""WITH r AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' | Variasi: x' WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 30 AS VARCHAR) || ' hari lalu' WHEN o_orderkey % 4 = 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS raw FROM orders),
    p AS (SELECT *, regexp_replace(split_part(raw, '|', 1), '^\s+|\s+$', '', 'g') AS head FROM r)
    SELECT o_orderstatus AS schema_family, CASE WHEN head = '' THEN '<kosong>' WHEN regexp_matches(head, '[a-zA-Z]') THEN regexp_replace(head, '\d+', 'N', 'g') ELSE regexp_replace(head, '\d', '9', 'g') END || CASE WHEN head <> '' AND raw LIKE '%|%' THEN ' | <teks>' ELSE '' END AS pola,
    count(*) AS n_baris, arg_min(raw, o_orderkey) AS contoh FROM p GROUP BY 1, 2""",
)
def pattern_report(spark: SparkSession, d: str) -> DataFrame:
    """A7 S35."""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    raw = f"CASE WHEN o_orderkey % 4 = 0 THEN {day} || ' | Variasi: x' WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 30 AS STRING) || ' hari lalu' WHEN o_orderkey % 4 = 2 THEN '' ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm') END"
    r = table(spark, d, "orders").selectExpr("o_orderstatus AS schema_family", f"{raw} AS timestamp_raw", "'x' AS timestamp_status", "'x' AS timestamp_anchor_source", "'x' AS source_file", "o_orderkey AS row_order")
    return audits.timestamp_patterns(r).select("schema_family", "pola", "n_baris", "contoh")


@query(
    "phrase_candidates",
    r"""WITH p AS (SELECT source, lower(regexp_replace(regexp_replace(unnest(string_split(text, ',')), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS frasa FROM documents WHERE text IS NOT NULL)
    SELECT frasa, count(*) AS n, count(DISTINCT source) AS n_file FROM p WHERE len(string_split(frasa, ' ')) >= 3 GROUP BY frasa HAVING count(DISTINCT source) >= 2""",
)
def phrase_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    f = table(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("text").alias("fragment"))
    return audits.phrase_candidates(f, 3, 2)


@query(
    "aspect_candidates",
    r"""WITH f AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS fragment FROM documents WHERE text IS NOT NULL), k AS (SELECT *, lower(regexp_replace(fragment, '^\s+|\s+$', '', 'g')) AS key FROM f),
    s AS (SELECT * FROM k WHERE key <> '' AND len(regexp_split_to_array(key, '\s+')) <= 3),
    t AS (SELECT key, count(*) AS n, count(DISTINCT source) AS n_file FROM s GROUP BY key HAVING count(DISTINCT source) >= 3),
    x AS (SELECT key, fragment, row_number() OVER (PARTITION BY key ORDER BY c DESC, fragment) AS r FROM (SELECT key, fragment, count(*) AS c FROM s GROUP BY 1, 2)),
    c AS (SELECT key, string_agg(lang || ' (' || CAST(c AS VARCHAR) || ')', ', ' ORDER BY r) AS kolom FROM (SELECT key, lang, c, row_number() OVER (PARTITION BY key ORDER BY c DESC, lang) AS r FROM (SELECT key, lang, count(*) AS c FROM s GROUP BY 1, 2)) WHERE r <= 3 GROUP BY key)
    SELECT t.key, t.n, t.n_file, x.fragment AS contoh, c.kolom FROM t JOIN x ON x.key = t.key AND x.r = 1 JOIN c ON c.key = t.key""",
)
def aspect_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A8 T3."""
    f = table(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("lang").alias("column"), F.explode(F.split("text", "\n")).alias("fragment"))
    f = f.withColumn("key", F.lower(C.trimmed(F.col("fragment"))))
    return audits.aspect_candidates(f).select("key", "n", "n_file", "contoh", "kolom")


@query(
    "id_mapping_check",
    """WITH p AS (SELECT o_custkey AS old_id, o_orderpriority AS new_id, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT 'old_id' AS side, CAST(old_id AS VARCHAR) AS id, count(*) AS variants, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY old_id HAVING count(*) > 1
    UNION ALL SELECT 'new_id', new_id, count(*), CAST(sum(n) AS BIGINT) FROM p GROUP BY new_id HAVING count(*) > 1""",
)
def id_mapping_check(spark: SparkSession, d: str) -> DataFrame:
    """A13 X13."""
    return audits.mapping_conflicts(table(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS old_id", "o_orderpriority AS new_id"))


TOKENS = r"list_transform(regexp_extract_all(coalesce(text, ''), '\p{L}+(?:''\p{L}+)?'), lambda x: lower(x))"
STOP = "(" + ", ".join(f"'{w}'" for w in C.FUNCTION_WORDS) + ")"


@query("top_unigrams", f"SELECT ngram, count(*) AS frekuensi FROM (SELECT unnest({TOKENS}) AS ngram FROM documents) WHERE ngram NOT IN {STOP} GROUP BY ngram ORDER BY frekuensi DESC, ngram LIMIT 20")
def top_unigrams(spark: SparkSession, d: str) -> DataFrame:
    """A23 S33 T2."""
    return eda.top_ngrams(table(spark, d, "documents"), 1)


@query(
    "top_bigrams",
    f"""WITH t AS (SELECT {TOKENS} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM t WHERE len(w) >= 2)
    SELECT ngram, count(*) AS frekuensi FROM g WHERE NOT (split_part(ngram, ' ', 1) IN {STOP} AND split_part(ngram, ' ', 2) IN {STOP}) GROUP BY ngram ORDER BY frekuensi DESC, ngram LIMIT 20""",
)
def top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    return eda.top_ngrams(table(spark, d, "documents"), 2)


SCORED = """s AS (SELECT event_id, user_id, event_type, ts, 1.0 + event_id % 7 AS a, 1.0 + event_id % 3 AS b, 1.0 + event_id % 2 + CASE WHEN event_type = 'error' THEN 6 ELSE 0 END AS c FROM events),
p AS (SELECT event_id, user_id, event_type, ts, CAST(c / (a + b + c) AS DOUBLE) AS p_negatif, CAST(b / (a + b + c) AS DOUBLE) AS p_netral, CAST(a / (a + b + c) AS DOUBLE) AS p_positif FROM s)"""
SCORED = SCORED.replace("1.0 +", "CAST(1 AS DOUBLE) +")
LABEL = "CASE WHEN p_negatif >= p_netral AND p_negatif >= p_positif THEN 'negatif' WHEN p_netral >= p_positif THEN 'netral' ELSE 'positif' END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", "ts", "1D + event_id % 7 AS a", "1D + event_id % 3 AS b", "1D + event_id % 2 + CASE WHEN event_type = 'error' THEN 6 ELSE 0 END AS c")
    return e.selectExpr("event_id", "user_id", "event_type", "ts", "c / (a + b + c) AS p_negatif", "b / (a + b + c) AS p_netral", "a / (a + b + c) AS p_positif")


def probs() -> list:
    return [F.col(c) for c in C.PROBABILITIES]


@query("argmax_entropy", f"WITH {SCORED} SELECT event_id, {LABEL} AS label, round(-(p_negatif * ln(p_negatif) + p_netral * ln(p_netral) + p_positif * ln(p_positif)), 6) AS entropi, round(greatest(p_negatif, p_netral, p_positif), 6) AS prob_maks FROM p")
def argmax_entropy(spark: SparkSession, d: str) -> DataFrame:
    """PR20 PR21 PR22."""
    return scored(spark, d).select("event_id", C.argmax_label(*probs()).alias("label"), F.round(C.entropy(*probs()), 6).alias("entropi"), F.round(C.max_probability(*probs()), 6).alias("prob_maks"))


@query(
    "observation_clr_alr",
    f"""WITH {SCORED} SELECT event_id, round(ln(p_negatif) - ln(p_netral), 6) AS alr0, round(ln(p_positif) - ln(p_netral), 6) AS alr1,
    round(ln(p_negatif) - (ln(p_negatif) + ln(p_netral) + ln(p_positif)) / 3, 6) AS clr0, round(ln(p_positif) - (ln(p_negatif) + ln(p_netral) + ln(p_positif)) / 3, 6) AS clr2 FROM p""",
)
def observation_clr_alr(spark: SparkSession, d: str) -> DataFrame:
    """PR26."""
    alr, clr = C.observation("alr", *probs()), C.observation("clr", *probs())
    return scored(spark, d).select("event_id", F.round(alr[0], 6).alias("alr0"), F.round(alr[1], 6).alias("alr1"), F.round(clr[0], 6).alias("clr0"), F.round(clr[2], 6).alias("clr2"))


@query("softmax_scores", f"WITH {SCORED} SELECT event_id, round(exp(3 * p_negatif) / (exp(3 * p_negatif) + exp(3 * p_netral) + exp(3 * p_positif)), 6) AS s0, round(exp(3 * p_positif) / (exp(3 * p_negatif) + exp(3 * p_netral) + exp(3 * p_positif)), 6) AS s2 FROM p")
def softmax_scores(spark: SparkSession, d: str) -> DataFrame:
    """PR27."""
    s = C.softmax(*[3 * c for c in probs()])
    return scored(spark, d).select("event_id", F.round(s[0], 6).alias("s0"), F.round(s[2], 6).alias("s2"))


@query("mean_by_group_having", f"WITH {SCORED} SELECT user_id, count(*) AS n, round(avg(p_negatif), 6) AS p_negatif, round(avg(p_netral), 6) AS p_netral, round(avg(p_positif), 6) AS p_positif FROM p GROUP BY user_id HAVING count(*) >= 3")
def mean_by_group(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    return eda.mean_by_product(scored(spark, d), 3, "user_id").select("user_id", "n", *[F.round(c, 6).alias(c) for c in C.PROBABILITIES])


@query("product_counts", "SELECT user_id AS product_id, count(*) AS n FROM events GROUP BY user_id")
def product_counts(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return eda.product_counts(table(spark, d, "events").withColumnRenamed("user_id", "product_id"))


@query(
    "confusion_matrix",
    f"""WITH {SCORED}, l AS (SELECT {LABEL} AS lama, CASE event_id % 3 WHEN 0 THEN 'negatif' WHEN 1 THEN 'netral' ELSE 'positif' END AS baru FROM p)
    SELECT k.lama, count(*) FILTER (WHERE baru = 'negatif') AS negatif, count(*) FILTER (WHERE baru = 'netral') AS netral, count(*) FILTER (WHERE baru = 'positif') AS positif
    FROM (SELECT unnest(['negatif', 'netral', 'positif']) AS lama) k LEFT JOIN l ON l.lama = k.lama GROUP BY k.lama""",
)
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A26 J5."""
    df = scored(spark, d).select(C.argmax_label(*probs()).alias("a"), F.expr("CASE event_id % 3 WHEN 0 THEN 'negatif' WHEN 1 THEN 'netral' ELSE 'positif' END").alias("b"))
    return eda.confusion(df, "a", "b")


@query("rolling_mean_25", f"WITH {SCORED} SELECT event_id, round(CASE WHEN count(*) OVER w >= 5 THEN avg(p_negatif) OVER w END, 6) AS rolling FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return eda.rolling_mean(scored(spark, d), "user_id", ["ts", "event_id"], "p_negatif").select("event_id", F.round("p_negatif_rolling", 6).alias("rolling"))


@query(
    "max_jump",
    f"""WITH {SCORED}, j AS (SELECT user_id, row_number() OVER w - 1 AS k, abs(round(p_negatif, 9) - lag(round(p_negatif, 9)) OVER w) AS jump FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(max(jump), 6) AS max_jump, CAST(arg_max(k, (jump, -k)) AS INTEGER) AS at FROM j WHERE jump IS NOT NULL GROUP BY user_id""",
)
def max_jump(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    s = scored(spark, d).withColumn("p", F.round("p_negatif", 9))
    return eda.greatest_jump(s, "user_id", ["ts", "event_id"], "p").select("user_id", F.round("max_jump", 6).alias("max_jump"), "at")


@query(
    "length_bins",
    rf"""WITH {SCORED}, w AS (SELECT d.doc_id, {WORDS.format("coalesce(text, '')")} AS n, p.* FROM documents d JOIN p ON p.event_id = d.doc_id),
    k AS (SELECT *, CASE WHEN n BETWEEN 1 AND 2 THEN '1-2' WHEN n BETWEEN 3 AND 5 THEN '3-5' WHEN n BETWEEN 6 AND 10 THEN '6-10' WHEN n BETWEEN 11 AND 20 THEN '11-20' WHEN n BETWEEN 21 AND 50 THEN '21-50' WHEN n > 50 THEN '>50' END AS kelas FROM w)
    SELECT c.kelas, count(k.doc_id) AS n, round(avg(p_negatif), 6) AS p_negatif FROM (SELECT unnest(['1-2', '3-5', '6-10', '11-20', '21-50', '>50']) AS kelas) c LEFT JOIN k ON k.kelas = c.kelas GROUP BY c.kelas""",
)
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    """A24."""
    words = table(spark, d, "documents").select("doc_id", C.word_count(F.coalesce("text", F.lit(""))).alias("words"))  # counted before the join, which no text goes to
    both = words.join(scored(spark, d), F.expr("doc_id = event_id"))
    return eda.mean_by_length(both, F.col("words")).select("kelas", "n", F.round("p_negatif", 6).alias("p_negatif"))


@query("truncated", rf"""WITH l AS (SELECT {WORDS.format("coalesce(text, '')")} AS n FROM documents) SELECT t AS batas, count(*) FILTER (WHERE n > t) AS n, round(100.0 * count(*) FILTER (WHERE n > t) / count(*), 2) AS persen FROM l, (SELECT unnest([64, 128, 256, 512]) AS t) GROUP BY t""")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return eda.truncated(table(spark, d, "documents").select(C.word_count(F.coalesce("text", F.lit(""))).alias("n_token"))).withColumn("persen", F.round("persen", 2))


@query(
    "prediction_summary",
    f"""WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (WHERE {LABEL} = 'negatif') AS n_negatif, count(*) FILTER (WHERE {LABEL} = 'netral') AS n_netral, count(*) FILTER (WHERE {LABEL} = 'positif') AS n_positif,
    round(avg(p_negatif), 6) AS mean_p_negatif, count(*) FILTER (WHERE greatest(p_negatif, p_netral, p_positif) < 0.6) AS n_uncertain, round(quantile_cont(event_id % 200, 0.95), 6) AS token_p95, count(*) FILTER (WHERE event_id % 200 > 128) AS n_truncated FROM p""",
)
def prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    s = scored(spark, d).withColumns({"n_token": F.col("event_id") % 200, "truncated": F.col("event_id") % 200 > 128})
    return eda.prediction_summary(s).select("n", "n_negatif", "n_netral", "n_positif", F.round("mean_p_negatif", 6).alias("mean_p_negatif"), "n_uncertain", F.round("token_p95", 6).alias("token_p95"), "n_truncated")


def export_source(spark: SparkSession, d: str) -> DataFrame:
    """Scored reviews as an export has them, all as text."""
    return scored(spark, d).select(
        F.col("event_id").cast("string").alias("review_id"), F.col("user_id").cast("string").alias("product_id"), F.concat(F.lit(" toko "), (F.col("user_id") % 9).cast("string")).alias("nama_toko"), F.col("user_id").cast("string").alias("nama_produk"),
        F.when(F.col("event_id") % 13 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), F.col("event_id").cast("string").alias("row_order"), F.when(F.col("event_id") % 17 == 0, "False").otherwise("True").alias("include_for_inference"),
        F.when(F.col("event_id") % 19 == 0, "true").otherwise("0").alias("text_proposal_kosong"), *[c.cast("string").alias(n) for c, n in zip(probs(), C.PROBABILITIES, strict=True)],
    )


AUDIT = f"""{SCORED}, x AS (SELECT *, 'toko ' || CAST(user_id % 9 AS VARCHAR) || '_' || CAST(user_id AS VARCHAR) AS product_id,
  CASE WHEN event_id % 19 = 0 THEN 'teks_kosong' WHEN event_id % 17 = 0 THEN 'bukan_include' WHEN event_id % 13 = 0 THEN 'timestamp_tidak_valid' END AS r FROM p),
y AS (SELECT *, coalesce(r, CASE WHEN count(CASE WHEN r IS NULL THEN 1 END) OVER (PARTITION BY product_id) < 3 THEN 'produk_kurang_dari_3' ELSE '' END) AS alasan_keluar FROM x),
audit AS (SELECT *, CASE WHEN alasan_keluar = '' THEN row_number() OVER (PARTITION BY product_id, alasan_keluar = '' ORDER BY date_trunc('second', ts), event_id, CAST(event_id AS VARCHAR)) END AS seq_sekuens FROM y)"""


@query("exclusion_reason", f"WITH {AUDIT} SELECT CAST(event_id AS VARCHAR) AS review_id, product_id, alasan_keluar, alasan_keluar = '' AS masuk_sekuens, CAST(seq_sekuens AS BIGINT) AS seq_sekuens FROM audit")
def exclusion_reason(spark: SparkSession, d: str) -> DataFrame:
    """PR11 PR12 PR13 W6 W9 S27."""
    return sequences.audit_table(export_source(spark, d)).select("review_id", "product_id", "alasan_keluar", "masuk_sekuens", "seq_sekuens")


@query("sequence_export", f"WITH {AUDIT} SELECT product_id, CAST(seq_sekuens AS BIGINT) AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, round(p_negatif, 9) AS p_negatif FROM audit WHERE alasan_keluar = ''")
def sequence_export(spark: SparkSession, d: str) -> DataFrame:
    """W6 SC8."""
    return sequences.sequence_table(sequences.audit_table(export_source(spark, d))).select("product_id", "seq", "timestamp", F.round(F.col("p_negatif").cast("double"), 9).alias("p_negatif"))


@query(
    "export_summary",
    f"""WITH {AUDIT}, b AS (SELECT product_id, count(*) FILTER (WHERE alasan_keluar = '') AS t FROM audit GROUP BY 1)
    SELECT CASE WHEN alasan_keluar = '' THEN 'masuk' ELSE alasan_keluar END AS measure, CAST(count(*) AS DOUBLE) AS value FROM audit GROUP BY 1
    UNION ALL SELECT 'produk', CAST(count(*) FILTER (WHERE t > 0) AS DOUBLE) FROM b UNION ALL SELECT 'produk_hilang', CAST(count(*) FILTER (WHERE t = 0) AS DOUBLE) FROM b
    UNION ALL SELECT 't_min', CAST(min(t) FILTER (WHERE t > 0) AS DOUBLE) FROM b UNION ALL SELECT 't_median', quantile_cont(t, 0.5) FILTER (WHERE t > 0) FROM b
    UNION ALL SELECT 't_p95', round(quantile_cont(t, 0.95) FILTER (WHERE t > 0), 6) FROM b UNION ALL SELECT 't_max', CAST(max(t) AS DOUBLE) FROM b""",
)
def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return sequences.export_summary(sequences.audit_table(export_source(spark, d))).withColumn("value", F.round("value", 6))


@query(
    "sequence_lengths",
    f"""WITH {SCORED}, t AS (SELECT user_id, count(*) AS t FROM p WHERE ts IS NOT NULL GROUP BY user_id)
    SELECT count(*) FILTER (WHERE t >= 3) AS n_products, count(*) FILTER (WHERE t < 3) AS n_short, min(t) FILTER (WHERE t >= 3) AS t_min, quantile_cont(t, 0.5) FILTER (WHERE t >= 3) AS t_median, round(quantile_cont(t, 0.95) FILTER (WHERE t >= 3), 6) AS t_p95, max(t) FILTER (WHERE t >= 3) AS t_max FROM t""",
)
def sequence_lengths(spark: SparkSession, d: str) -> DataFrame:
    """A35 H1 PR25 W12."""
    s = scored(spark, d).withColumnsRenamed({"user_id": "product_id", "ts": "timestamp", "event_id": "row_order"})
    return sequences.sequence_report(s).select("n_products", "n_short", "t_min", "t_median", F.round("t_p95", 6).alias("t_p95"), "t_max")


@query(
    "overlap_pairs",
    """WITH c AS (SELECT source AS file, md5(coalesce(text, '')) AS key, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT file, sum(n) AS size FROM c GROUP BY 1),
    p AS (SELECT a.file AS file_a, b.file AS file_b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.key = b.key AND a.file < b.file GROUP BY 1, 2)
    SELECT file_a, file_b, CAST(shared AS BIGINT) AS shared, round(100.0 * shared / x.size, 6) AS pct_a, round(100.0 * shared / y.size, 6) AS pct_b FROM p JOIN s x ON x.file = file_a JOIN s y ON y.file = file_b WHERE greatest(100.0 * shared / x.size, 100.0 * shared / y.size) >= 2""",
)
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J9 U4."""
    keys = table(spark, d, "documents").select(F.col("source").alias("file"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return overlap.overlap_pairs(keys, min_percent=2.0).select("file_a", "file_b", "shared", F.round("pct_a", 6).alias("pct_a"), F.round("pct_b", 6).alias("pct_b"))


@query(
    "identical_pairs",
    """WITH h AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS file, sha256(coalesce(text, '')) AS sha FROM documents)
    SELECT a.file AS file_a, b.file AS file_b, TRUE AS identical FROM h a JOIN h b ON a.sha = b.sha AND a.file < b.file""",
)
def identical_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    h = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    keys = h.select("file", F.col("file").alias("key"))
    return overlap.overlap_pairs(keys, h).select("file_a", "file_b", "identical")


@query("known_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def known_keys(spark: SparkSession, d: str) -> DataFrame:
    """J7."""
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("lookup_join", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """J6; the planner sends out the two small tables, of 25 and 5 rows, by their measured size."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.expr("c_nationkey = n_nationkey"), "left").join(r, F.expr("n_regionkey = r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("union_allow_missing", "SELECT c_custkey AS k, c_name AS name, NULL AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, round(s_acctbal, 2) FROM supplier")
def union_missing(spark: SparkSession, d: str) -> DataFrame:
    """U2."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round("s_acctbal", 2).alias("balance")), allowMissingColumns=True)


@query("frame_difference", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 25)")
def frame_difference(spark: SparkSession, d: str) -> DataFrame:
    """U5 J12."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    b = table(spark, d, "lineitem").where("l_quantity < 25").select("l_orderkey", "l_linenumber").distinct()
    return audits.differences(a, b).agg(F.count("*").alias("n"))


@query("timestamp_carry", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS day FROM orders")
def timestamp_carry(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    new = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format(F.expr("o_orderdate + INTERVAL 1 DAY"), "yyyy-MM-dd").alias("day"))
    return audits.one_to_one_join(o, new, "o_orderkey", ["o_orderstatus"], ["day"])


@query(
    "product_split",
    """WITH i AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) AS k, count(*) OVER () AS n FROM i)
    SELECT user_id AS product_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def product_split(spark: SparkSession, d: str) -> DataFrame:
    """T7 T8."""
    return split.product_split(table(spark, d, "events").select(F.col("user_id").alias("product_id")))


@query(
    "split_summary",
    """WITH i AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || CAST(user_id AS VARCHAR)), user_id) AS k, count(*) OVER () AS n FROM i),
    s AS (SELECT user_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM r)
    SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_products, round(count(*) * 1.0 / (SELECT count(*) FROM events), 6) AS row_share FROM events JOIN s USING (user_id) GROUP BY split""",
)
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    """A34."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("product_id"))
    return split.split_summary(rows, split.product_split(rows)).select("split", "n_rows", "n_products", F.round("row_share", 6).alias("row_share"))


@query(
    "relative_dates",
    """WITH r AS (SELECT event_id, event_id % 8 AS k, CASE event_id % 8 WHEN 0 THEN CAST(event_id % 40 AS VARCHAR) || ' hari lalu' WHEN 1 THEN CAST(event_id % 9 AS VARCHAR) || ' minggu yang lalu' WHEN 2 THEN 'kemarin' WHEN 3 THEN 'sebulan lalu' WHEN 4 THEN CAST(event_id % 14 AS VARCHAR) || ' bulan lalu' WHEN 5 THEN 'baru saja' WHEN 6 THEN '2024-1-5 7:08 | Variasi: x' ELSE CAST(event_id % 5 AS VARCHAR) || ' jam lalu' END AS raw FROM events)
    SELECT event_id, CASE k WHEN 5 THEN 'tak_terparsing' WHEN 6 THEN 'ok' ELSE 'relatif_dikonversi' END AS status, k = 6 AS has_time,
    strftime(CASE k WHEN 0 THEN TIMESTAMP '2026-03-31' - to_days(CAST(event_id % 40 AS INTEGER)) WHEN 1 THEN TIMESTAMP '2026-03-31' - to_days(CAST(7 * (event_id % 9) AS INTEGER)) WHEN 2 THEN TIMESTAMP '2026-03-30' WHEN 3 THEN TIMESTAMP '2026-02-28'
      WHEN 4 THEN TIMESTAMP '2026-03-31' - to_months(CAST(event_id % 14 AS INTEGER)) WHEN 6 THEN TIMESTAMP '2024-01-05 07:08:00' WHEN 7 THEN TIMESTAMP '2026-03-31' END, '%Y-%m-%d %H:%M') AS stamp FROM r""",
)
def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """S24 S25 PR19."""
    raw = F.expr("CASE event_id % 8 WHEN 0 THEN CAST(event_id % 40 AS STRING) || ' hari lalu' WHEN 1 THEN CAST(event_id % 9 AS STRING) || ' minggu yang lalu' WHEN 2 THEN 'kemarin' WHEN 3 THEN 'sebulan lalu' WHEN 4 THEN CAST(event_id % 14 AS STRING) || ' bulan lalu' WHEN 5 THEN 'baru saja' WHEN 6 THEN '2024-1-5 7:08 | Variasi: x' ELSE CAST(event_id % 5 AS STRING) || ' jam lalu' END")
    t = C.timestamp_fields(raw, F.expr("TIMESTAMP_NTZ'2026-03-31 15:00:00'"))
    return table(spark, d, "events").select("event_id", t.alias("t")).select("event_id", F.col("t.status").alias("status"), F.col("t.has_time").alias("has_time"), F.date_format("t.timestamp", "yyyy-MM-dd HH:mm").alias("stamp"))


SEEDS = (["with", "and"], ["that", "der"])
PMI = rf"""t AS (SELECT doc_id, {TOKENS} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t), f AS (SELECT word, count(*) AS n FROM u GROUP BY word),
j AS (SELECT a.word, b.word AS seed, count(*) AS joint FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.word IN ('with', 'and', 'that', 'der') AND a.i <> b.i AND abs(a.i - b.i) <= 10 GROUP BY 1, 2)"""


def lexical_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.tokens(F.col("text")).alias("tokens"))


@query("token_frequency", f"SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS word FROM documents) GROUP BY word")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    """A31."""
    return lexicon.token_frequency(lexical_docs(spark, d))


@query("cooccurrence", f"WITH {PMI} SELECT word, seed, CAST(joint AS BIGINT) AS joint FROM j")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """J11."""
    return lexicon.joint_counts(lexical_docs(spark, d), [*SEEDS[0], *SEEDS[1]], 10)


@query(
    "semantic_orientation",
    f"""WITH {PMI}, n AS (SELECT sum(n) AS total FROM f), s AS (SELECT f.word, f.n, j.seed, ln(CAST(j.joint AS DOUBLE) * total / (CAST(f.n AS DOUBLE) * g.n)) AS pmi FROM f JOIN j ON j.word = f.word JOIN f g ON g.word = j.seed, n WHERE f.n >= 2)
    SELECT f.word, f.n, round(coalesce(sum(pmi) FILTER (WHERE seed IN ('with', 'and')), 0) / 2 - coalesce(sum(pmi) FILTER (WHERE seed IN ('that', 'der')), 0) / 2, 6) AS so FROM f LEFT JOIN s ON s.word = f.word WHERE f.n >= 2 GROUP BY f.word, f.n""",
)
def semantic_orientation(spark: SparkSession, d: str) -> DataFrame:
    """A32."""
    return lexicon.semantic_orientation(lexical_docs(spark, d), *SEEDS).select("word", "n", F.round("so", 6).alias("so"))


_BOUNDS = list(itertools.accumulate(2.718281828459045**-1 / math.factorial(k) for k in range(12)))
_DRAWN = "CAST('0x' || substr(md5('42:' || CAST(i AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0"


@query(
    "bootstrap_ci",
    rf"""WITH {PMI}, x AS (SELECT doc_id, i, {_DRAWN} AS u FROM documents, range(50) AS g(i)), d AS (SELECT doc_id, -1 AS iter, 1 AS times FROM documents UNION ALL SELECT doc_id, i, {" + ".join(f"CASE WHEN u >= {b!r} THEN 1 ELSE 0 END" for b in _BOUNDS)} FROM x),
    uc AS (SELECT doc_id, word, count(*) AS c FROM u GROUP BY 1, 2), fw AS (SELECT iter, word, sum(c * times) AS n FROM uc JOIN d USING (doc_id) WHERE times > 0 GROUP BY 1, 2), tot AS (SELECT iter, sum(n) AS total FROM fw GROUP BY 1),
    jd AS (SELECT a.doc_id, a.word, b.word AS seed, count(*) AS c FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.word IN ('with', 'and', 'that', 'der') AND a.i <> b.i AND abs(a.i - b.i) <= 10 GROUP BY 1, 2, 3),
    jj AS (SELECT iter, word, seed, sum(c * times) AS joint FROM jd JOIN d USING (doc_id) WHERE times > 0 GROUP BY 1, 2, 3),
    s AS (SELECT f.iter, f.word, jj.seed, ln(CAST(jj.joint AS DOUBLE) * tot.total / (CAST(f.n AS DOUBLE) * g.n)) AS pmi FROM fw f JOIN jj ON jj.iter = f.iter AND jj.word = f.word JOIN fw g ON g.iter = f.iter AND g.word = jj.seed JOIN tot ON tot.iter = f.iter WHERE f.n >= 2),
    o AS (SELECT f.iter, f.word, f.n, coalesce(sum(pmi) FILTER (WHERE seed IN ('with', 'and')), 0) / 2 - coalesce(sum(pmi) FILTER (WHERE seed IN ('that', 'der')), 0) / 2 AS so FROM fw f LEFT JOIN s ON s.iter = f.iter AND s.word = f.word WHERE f.n >= 2 GROUP BY 1, 2, 3),
    r AS (SELECT word, CAST(max(n) FILTER (WHERE iter < 0) AS BIGINT) AS n, max(so) FILTER (WHERE iter < 0) AS so, quantile_cont(so, 0.025) FILTER (WHERE iter >= 0) AS low, quantile_cont(so, 0.975) FILTER (WHERE iter >= 0) AS high, count(so) FILTER (WHERE iter >= 0) AS n_iter FROM o GROUP BY word)
    SELECT word, n, round(so, 5) AS so, round(low, 5) AS low, round(high, 5) AS high, n_iter, CASE WHEN round(low, 9) <= 0 AND round(high, 9) >= 0 THEN 'discard' WHEN low > 0 THEN 'genuine' ELSE 'counterfeit' END AS label FROM r WHERE n IS NOT NULL AND n_iter > 0""",
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """50 resamples, drawn by md5."""
    out = lexicon.bootstrap(lexical_docs(spark, d), *SEEDS, LexiconConfig())
    return out.select("word", "n", *[F.round(c, 5).alias(c) for c in ("so", "low", "high")], "n_iter", "label")


@query("events_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def events_json(spark: SparkSession, d: str) -> DataFrame:
    """An extension: values of a JSON column."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("feature_correlation", f"WITH {SCORED} SELECT 'p_negatif' AS a, 'p_positif' AS b, round(corr(p_negatif, p_positif), 4) AS r FROM p UNION ALL SELECT 'p_positif', 'p_negatif', round(corr(p_negatif, p_positif), 4) FROM p UNION ALL SELECT 'p_negatif', 'p_negatif', 1.0 UNION ALL SELECT 'p_positif', 'p_positif', 1.0")
def feature_correlation(spark: SparkSession, d: str) -> DataFrame:
    """A36."""
    return hmm.correlations(scored(spark, d), ["p_negatif", "p_positif"])


@query("anonymous_labels", "WITH f AS (SELECT source, min(doc_id) AS k FROM documents GROUP BY source) SELECT source, 'Toko ' || chr(CAST(64 + row_number() OVER (ORDER BY k, source) AS INTEGER)) AS label FROM f")
def anonymous(spark: SparkSession, d: str) -> DataFrame:
    """T10; twenty sources fit in the letters of SQL's simple form."""
    return eda.anonymous_labels(table(spark, d, "documents"), "source", "doc_id")


@query("clean_light_pages")
def clean_light_pages(spark: SparkSession, d: str) -> DataFrame:
    """S1 to S6, A28 (rows only: compatibility forms and HTML entities are beyond SQL)."""
    from lumbung.functions.text import clean_light

    return table(spark, d, "pages").select("page_id", clean_light(F.col("html")).alias("c")).select("page_id", F.col("c.text").alias("text_light"), F.col("c.hapus_html").alias("hapus_html"))


@query("clean_proposal_documents")
def clean_proposal_documents(spark: SparkSession, d: str) -> DataFrame:
    """S15 to S20, A29 (rows only)."""
    from lumbung.functions.text import clean_proposal

    c = table(spark, d, "documents").select("doc_id", clean_proposal(F.col("text"), {"und": "dan", "with": "dengan"}).alias("c"))
    return c.select("doc_id", F.col("c.text").alias("text_proposal"), (F.col("c.text") == "").alias("text_proposal_kosong"), F.size("c.slang").alias("n_slang"))


def fake_model():
    """A tokenizer and a forward function without a model's weights, for tests and checks of the scorer: a word's id is its length."""
    import numpy as np

    return (lambda texts: [[0, *map(len, t.split()), 0] for t in texts]), (lambda ids: np.array([[sum(x) / 100, len(x) / 20, 1.0] for x in ids]))


@query(
    "scored_documents",
    rf"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''), lambda x: length(x)) AS l FROM documents),
    m AS (SELECT doc_id, len(l) AS n, list_sum(l[1:127]) / 100.0 AS a, least(len(l) + 2, 128) / 20.0 AS b FROM w), e AS (SELECT *, exp(a - greatest(a, b, 1.0)) AS x, exp(b - greatest(a, b, 1.0)) AS y, exp(1.0 - greatest(a, b, 1.0)) AS z FROM m)
    SELECT doc_id, CASE WHEN n > 0 THEN round(x / (x + y + z), 6) END AS p_positif, CASE WHEN n > 0 THEN round(y / (x + y + z), 6) END AS p_netral, CASE WHEN n > 0 THEN round(z / (x + y + z), 6) END AS p_negatif, CASE WHEN n > 0 THEN round(a, 6) END AS logit_positif,
    CASE WHEN n > 0 THEN CAST(n + 2 AS BIGINT) END AS n_token, CASE WHEN n > 0 THEN n + 2 > 128 END AS truncated, CASE WHEN n > 0 THEN CASE WHEN z >= y AND z >= x THEN 'negatif' WHEN y >= x THEN 'netral' ELSE 'positif' END END AS label_argmax FROM e""",
)
def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """S36 T9 J13 of the scorer, with a forward function that SQL can repeat."""
    out = score.score_texts(table(spark, d, "documents").select("doc_id", "text"), "text", fake_model, {0: "Positive", 1: "Neutral", 2: "Negative"})
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_positif", "p_netral", "p_negatif", "logit_positif")], "n_token", "truncated", "label_argmax")


@query("hmm_features")
def hmm_features(spark: SparkSession, d: str) -> DataFrame:
    """H1 to H9 (rows only: an iterative fit, to convergence or 200 updates, of 10 restarts). What the fit warns of is logged."""
    s = scored(spark, d).withColumnsRenamed({"user_id": "product_id", "ts": "timestamp", "event_id": "row_order"})
    seqs = sequences.build_sequences(s)
    found = hmm.fit(seqs, HmmConfig())
    log.warning("hmm_features: %s after %d updates, log likelihood %.4f; %s", "converged" if found.converged else "not converged", found.iterations, found.log_likelihood, "; ".join(found.warnings) or "no warnings")
    return hmm.features(seqs, found.model)
