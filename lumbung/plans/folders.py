"""Queries over folders of CSV files that they write from the test tables: scans, the whole cleaning stage, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.functions import columns as C
from lumbung.operators import audits, clean, overlap, profile
from lumbung.plans.queries import KIND, TRIM, query, table
from lumbung.sources import files, sinks

#: What a shop's export holds of each document: some texts are empty, numbers or dates, some days relative or missing.
REVIEW = "CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 17 = 1 THEN '12345' WHEN doc_id % 17 = 2 THEN '2024-01-05' ELSE coalesce(text, '') END"
STAMP = "CASE WHEN doc_id % 7 = 0 THEN '3 hari lalu' WHEN doc_id % 7 = 1 THEN '' WHEN doc_id % 7 = 2 THEN '2024-1-9' ELSE concat('2024-01-0', doc_id % 5 + 1, ' 10:', 10 + doc_id % 50) END"
STARS = "doc_id % 5 + 1"
EXPORT = f"""s AS (SELECT 'Toko ' || source || '_Barang' AS file, doc_id, {REVIEW} AS ulasan, {STAMP} AS timestamp, CAST({STARS} AS VARCHAR) AS bintang,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_order FROM documents WHERE source IS NOT NULL)"""


def shops(spark: SparkSession, d: str) -> str:
    """A folder with one CSV file for each source."""
    rows = table(spark, d, "documents").where("source IS NOT NULL").selectExpr("concat('Toko ', source, '_Barang') AS file", f"{REVIEW} AS ulasan", f"{STAMP} AS timestamp", f"CAST({STARS} AS STRING) AS bintang", "doc_id")
    path = sinks.shared_folder(spark, "shops")
    sorted_ = rows.repartition("file").sortWithinPartitions("file", "doc_id")
    sinks.write_csv_folder(sorted_.select("file", "ulasan", "timestamp", "bintang", F.col("doc_id").cast("string").alias("nomor")), path, "file")
    return path


def run(spark: SparkSession, d: str) -> clean.CleanResult:
    """The cleaning stage over that folder, with a mapping derived from the files' names."""
    listed = files.read_files(spark, shops(spark, d))
    return clean.clean_folder(listed, files.read_cells(listed), mapping(listed.select("file")))


def mapping(names: DataFrame) -> DataFrame:
    return names.select(C.file_mapping(F.col("file")).alias("m")).select("m.*")


@query("csv_cells", f"WITH {EXPORT} SELECT file, CAST(row_order AS BIGINT) AS row_order, 'ulasan' AS col, 0 AS position, md5(ulasan) AS value, 'utf-8' AS encoding FROM s UNION ALL SELECT file, row_order, 'timestamp', 1, md5(timestamp), 'utf-8' FROM s UNION ALL SELECT file, row_order, 'bintang', 2, md5(bintang), 'utf-8' FROM s UNION ALL SELECT file, row_order, 'nomor', 3, md5(CAST(doc_id AS VARCHAR)), 'utf-8' FROM s")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """SC1 SC3 SC13 SC14 SK2: files of quoted cells with line ends and quotes in them, by their rows' places."""
    got = files.read_cells(files.read_files(spark, shops(spark, d)))
    return got.select("file", "row_order", F.col("column").alias("col"), "position", F.md5("value").alias("value"), "encoding")


@query("csv_table", f"WITH {EXPORT} SELECT CAST(doc_id AS VARCHAR) AS nomor, md5(ulasan) AS ulasan, timestamp, bintang FROM s")
def csv_table(spark: SparkSession, d: str) -> DataFrame:
    """SC8 SC2: the same files as one table of strings, by Spark's reader."""
    got = files.read_table(spark, shops(spark, d), ("ulasan", "timestamp", "bintang", "nomor"))
    return got.select("nomor", F.md5("ulasan").alias("ulasan"), "timestamp", "bintang")


@query("file_checksums", "SELECT r_name AS file, CAST(octet_length(encode(c)) AS BIGINT) AS length, sha256(c) AS sha256 FROM (SELECT r_name, 'n_name' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS c FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)")
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    """SC13 S30 X10: names, sizes and checksums of files."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select(F.col("r_name").alias("file"), "n_nationkey", "n_name")
    path = sinks.shared_folder(spark, "nations")
    rows.repartition("file").sortWithinPartitions("file", "n_nationkey").select("file", "n_name").write.partitionBy("file").option("header", True).csv(path)
    return files.read_files(spark, path).select("file", "length", "sha256")


ROLE = {"ulasan": "review_text", "timestamp": "timestamp", "bintang": "rating", "nomor": "metadata"}


@query("folder_roles", "SELECT 'Toko ' || source || '_Barang' AS file, col, role FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in ROLE.items()) + ") AS v(col, role)")
def folder_roles(spark: SparkSession, d: str) -> DataFrame:
    """PR5 PR6 A2 over files."""
    return run(spark, d).roles.select("file", F.col("column").alias("col"), "role")


KINDS = f"{EXPORT}, v AS (SELECT *, {TRIM.format('ulasan')} AS v FROM s), k AS (SELECT *, {KIND} AS kind FROM v)"


@query(
    "folder_manifest",
    f"""WITH {KINDS} SELECT file, count(*) AS n_baris_sumber, count(*) FILTER (WHERE kind = 'kosong') AS n_sel_kosong, count(*) FILTER (WHERE kind NOT IN ('kosong', 'teks')) AS n_hanya_bukan_teks,
    count(*) FILTER (WHERE kind = 'teks') AS n_keluar, count(*) FILTER (WHERE kind = 'teks' AND timestamp = '') AS n_nat, round(100.0 * count(*) FILTER (WHERE kind = 'teks' AND timestamp = '') / nullif(count(*) FILTER (WHERE kind = 'teks'), 0), 2) AS pct_nat,
    count(*) FILTER (WHERE kind = 'teks' AND timestamp = '3 hari lalu') AS n_ts_relatif_dikonversi, TRUE AS seimbang FROM k GROUP BY file""",
)
def folder_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A3 A4 J2 PR7 PR14: clean.clean_folder's own manifest."""
    return run(spark, d).manifest.select("file", "n_baris_sumber", "n_sel_kosong", "n_hanya_bukan_teks", "n_keluar", "n_nat", "pct_nat", "n_ts_relatif_dikonversi", "seimbang")


KEPT = f"""{KINDS}, r AS (SELECT *, lower(split_part(file, '_', 1)) || '|barang' AS product_id FROM k WHERE kind = 'teks'),
t AS (SELECT *, CASE WHEN timestamp LIKE '2024%' THEN coalesce(try_strptime(timestamp, '%Y-%m-%d %H:%M'), try_strptime(timestamp, '%Y-%m-%d')) END AS ts FROM r)"""


@query(
    "folder_reviews",
    f"""WITH {KEPT} SELECT product_id || '__' || substr(sha256(file), 1, 8) || '__' || CAST(row_order AS VARCHAR) AS review_id, product_id, split_part(file, '_', 1) AS nama_toko, md5(v) AS review, ts AS timestamp, coalesce(timestamp LIKE '%:%', FALSE) AS timestamp_has_time,
    CASE WHEN timestamp = '' THEN 'tak_terparsing' WHEN timestamp LIKE '%lalu' THEN 'relatif_dikonversi' ELSE 'ok' END AS timestamp_status, timestamp LIKE '%lalu' AS timestamp_is_estimated, CAST(1 AS BIGINT) AS n_fragments, 'ulasan' AS fragment_cols,
    row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN timestamp = '' THEN 2 WHEN ts IS NULL THEN 1 ELSE 0 END, ts, file, row_order) AS seq_in_product FROM t""",
)
def folder_reviews(spark: SparkSession, d: str) -> DataFrame:
    """PR7 PR9 PR19 S9 W1: clean rows; a relative day is the file's time less its distance, and so after all the others."""
    r = run(spark, d).reviews
    stamp = F.when(~F.col("timestamp_is_estimated"), F.col("timestamp"))
    return r.select("review_id", "product_id", "nama_toko", F.md5("review").alias("review"), stamp.alias("timestamp"), "timestamp_has_time", "timestamp_status", "timestamp_is_estimated", "n_fragments", "fragment_cols", "seq_in_product")


@query("relative_anchors", f"WITH {KEPT} SELECT 'Toko ' || source || '_Barang' AS file, max(CAST('2024-01-0' || CAST(doc_id % 5 + 1 AS VARCHAR) || ' 10:' || CAST(10 + doc_id % 50 AS VARCHAR) || ':00' AS TIMESTAMP)) FILTER (WHERE doc_id % 7 > 2) AS absolute, FALSE AS mtime_anomaly, 'mtime' AS timestamp_anchor_source, TRUE AS later FROM documents WHERE source IS NOT NULL GROUP BY source")
def relative_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Each file's latest day with a time, and that relative days count from the file's own time."""
    listed = files.read_files(spark, shops(spark, d))
    cells = files.read_cells(listed).where(~((F.col("column") == "timestamp") & (F.col("value") == "2024-1-9")) & (F.col("column") != "ulasan"))
    a = files.timestamp_anchors(cells, listed, None, "Asia/Jakarta")
    return a.select("file", F.col("latest_absolute").alias("absolute"), "mtime_anomaly", "timestamp_anchor_source", (F.col("timestamp_anchor") > F.col("latest_absolute")).alias("later"))


@query("fragment_counts", f"WITH {KINDS} SELECT kind, CASE kind WHEN 'teks' THEN 'fragment' WHEN 'label_aspek' THEN 'tag' ELSE 'other' END AS use, count(*) AS n FROM k WHERE v <> '' GROUP BY kind")
def fragment_counts(spark: SparkSession, d: str) -> DataFrame:
    """A5 PR8."""
    return clean.fragment_counts(run(spark, d).tagged).where("role = 'review_text'").select("kind", "use", "n")


@query(
    "folder_ledger",
    f"""WITH {KINDS}, n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE kind = 'kosong') AS empty, count(*) FILTER (WHERE kind = 'teks') AS kept, count(*) FILTER (WHERE v <> '') AS cells, count(DISTINCT file) AS files FROM k)
    SELECT stage, rule, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM (
    SELECT '1_file' AS stage, 'pemetaan -> status ok' AS rule, files AS before, files AS after FROM n UNION ALL SELECT '1_file', 'file ok -> file diproses', files, files FROM n
    UNION ALL SELECT '2_baris', 'baris tanpa sel teks terisi', rows, rows - empty FROM n UNION ALL SELECT '2_baris', 'baris yang selnya hanya non-teks', rows - empty, kept FROM n
    UNION ALL SELECT '3_fragmen', 'sel kolom review_text -> fragmen review', cells, kept FROM n
    UNION ALL SELECT '3_fragmen_rinci', 'review_text: ' || kind, count(*), 0 FROM k WHERE kind NOT IN ('kosong', 'teks') GROUP BY kind
    UNION ALL SELECT '6_timestamp', 'status tak_terparsing', kept, kept - (SELECT count(*) FROM k WHERE kind = 'teks' AND timestamp = '') FROM n
    UNION ALL SELECT '6_timestamp', 'status ok', kept, kept FROM n UNION ALL SELECT '6_timestamp', 'status relatif_dikonversi', kept, kept FROM n)""",
)
def folder_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The stages whose rows do not depend on the text chain."""
    out = audits.cleaning_ledger(run(spark, d))
    return out.where("stage NOT IN ('4_text_light', '5_flag')").select("stage", "rule", "before", "after")


@query("light_changes", f"WITH {KINDS}, t AS (SELECT * FROM k WHERE kind = 'teks') SELECT 'hapus_url' AS rule, count(*) FILTER (WHERE regexp_matches(v, '(?i)(?:https?://|www\\.)\\S+')) AS n FROM t")
def light_changes(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the URL step of the light chain changed."""
    return audits.light_changes(run(spark, d).rows).where("rule = 'hapus_url'")


@query("folder_checks", f"WITH {KEPT}, n AS (SELECT count(*) AS n FROM t) SELECT name, CAST(violations AS BIGINT) AS violations FROM (SELECT 'review_id unik' AS name, (SELECT count(*) FROM t WHERE row_order % 10 = 0) AS violations UNION ALL SELECT 'status waktu dikenal', (SELECT count(*) + count(*) FILTER (WHERE row_order % 10 = 0) FROM t WHERE row_order % 4 = 1) UNION ALL SELECT 'baris sumber = keluar + dibuang', (SELECT count(DISTINCT file) FROM t) UNION ALL SELECT 'urutan 1..n per produk', (SELECT count(*) FROM (SELECT product_id FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE row_order % 10 = 0) > 0)))")
def folder_checks(spark: SparkSession, d: str) -> DataFrame:
    """A12 on a spoilt table: every tenth row of a file comes twice, a quarter has an unknown status, and the manifest is one row off."""
    r = run(spark, d)
    spoilt = r.reviews.withColumn("timestamp_status", F.when(F.col("row_order") % 4 == 1, "lain").otherwise(F.col("timestamp_status")))
    spoilt = spoilt.unionByName(spoilt.where("row_order % 10 = 0"))
    manifest = r.manifest.withColumn("seimbang", F.expr("n_baris_sumber + 1 = n_sel_kosong + n_hanya_bukan_teks + n_keluar"))
    return audits.clean_checks(spoilt, manifest).where(F.col("name").isin("review_id unik", "status waktu dikenal", "baris sumber = keluar + dibuang", "urutan 1..n per produk")).select("name", "violations")


@query("role_counts", "SELECT role, count(*) AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), (VALUES " + ", ".join(f"('{r}')" for r in ROLE.values()) + ") AS v(role) GROUP BY role")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    """X2."""
    return profile.role_counts(run(spark, d).roles).groupBy("role").agg(F.sum("n").alias("n"))


@query("role_evidence", f"WITH {EXPORT} SELECT file, 'bintang' AS col, 'rating' AS role, 'isi 100%; teks 0%; tanggal 0%; url 0%; angka 100%; label 0%; nama-tersamar 0%; rata2 1.0 kata; unik ' || CAST(CAST(round_even(100.0 * count(DISTINCT bintang) / count(*), 0) AS INTEGER) AS VARCHAR) || '%' AS bukti FROM s GROUP BY file")
def role_evidence(spark: SparkSession, d: str) -> DataFrame:
    """X4."""
    return profile.evidence(run(spark, d).roles).where("column = 'bintang'").select("file", F.col("column").alias("col"), "role", "bukti")


def written(df: DataFrame, name: str) -> str:
    """A table as a CSV folder of its own."""
    path = f"{sinks.shared_folder(df.sparkSession, 'table')}/{name}"
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


@query("file_map", "SELECT 'berkas ' || CAST(s_suppkey AS VARCHAR) || '.csv' AS file, 'toko|' || CAST(s_suppkey AS VARCHAR) AS product_key, s_suppkey % 3 <> 0 AS usable FROM supplier")
def file_map(spark: SparkSession, d: str) -> DataFrame:
    """SC4: usable files and others of a mapping table, with its checks."""
    s = table(spark, d, "supplier").selectExpr("concat('berkas ', s_suppkey, '.csv') AS file", "'toko' AS nama_toko", "CAST(s_suppkey AS STRING) AS nama_produk", "concat('toko|', s_suppkey) AS product_key", "CASE WHEN s_suppkey % 3 = 0 THEN 'perlu_cek' ELSE 'ok' END AS status", "'x' AS sumber_nama", "'' AS catatan", "'1' AS ukuran_byte")
    n = s.count()
    ok, left = files.file_map(spark, written(s, "mapping.csv"), expected_rows=n)
    return ok.select("file", "product_key", F.lit(True).alias("usable")).unionByName(left.select("file", "product_key", F.lit(False).alias("usable")))


@query("slang_dictionary", "SELECT DISTINCT lower(p_brand) AS slang, upper(p_brand) AS baku FROM part")
def slang_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """SC9 SC10: a dictionary of exactly two columns, its keys without case."""
    pairs = table(spark, d, "part").selectExpr("p_brand AS slang", "upper(p_brand) AS baku").distinct()
    return spark.createDataFrame(list(files.slang_dictionary(spark, written(pairs, "slang.csv")).items()), "slang string, baku string")


@query("scrape_dates", "SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS file, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders")
def scrape_dates(spark: SparkSession, d: str) -> DataFrame:
    """SC11."""
    rows = table(spark, d, "orders").selectExpr("concat('f', o_orderkey) AS file", "date_format(o_orderdate, 'yyyy-MM-dd') AS tanggal_scrape")
    return files.scrape_dates(spark, written(rows, "scrape_dates.csv"))


@query("aspect_vocabulary", r"SELECT DISTINCT regexp_replace(lower(trim(regexp_replace(p_brand || ' :', '\s+', ' ', 'g'))), '[:\s]+$', '') AS key FROM part WHERE p_partkey % 2 = 0")
def aspect_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """SC12 S11: approved words only."""
    rows = table(spark, d, "part").selectExpr("concat(p_brand, ' :') AS fragmen", "CASE WHEN p_partkey % 2 = 0 THEN ' Ya' ELSE 'tidak' END AS setuju")
    return files.aspect_vocabulary(spark, written(rows, "kosakata.csv"))


@query("clean_table", "SELECT CAST(doc_id AS BIGINT) AS review_id, source AS product_id, lang FROM documents WHERE doc_id % 3 <> 0")
def clean_table(spark: SparkSession, d: str) -> DataFrame:
    """SC5 SC7 SK1 SK3: written once and read again, included rows only, with its key columns."""
    rows = table(spark, d, "documents").selectExpr("CAST(doc_id AS BIGINT) AS review_id", "source AS product_id", "doc_id AS seq_in_product", "TIMESTAMP_NTZ'2024-01-01' AS timestamp", "doc_id % 3 <> 0 AS include_for_inference", "lang", "text")
    path = sinks.shared_folder(spark, "clean")
    sinks.write_new(rows, path)
    try:
        sinks.write_new(rows.limit(0), path)
        raise AssertionError("an existing table was written over")
    except Exception as e:
        if "already exists" not in str(e).lower() and "PATH_ALREADY_EXISTS" not in str(e):
            raise
    got = files.clean_reviews(spark, path, columns=["lang"])
    assert got.columns == ["review_id", "product_id", "seq_in_product", "timestamp", "lang"]
    return got.select("review_id", "product_id", "lang")


@query("split_ids", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS product_id, CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders")
def split_ids(spark: SparkSession, d: str) -> DataFrame:
    """SC6."""
    rows = table(spark, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS product_id", "CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split", "o_orderpriority")
    return files.split_ids(spark, written(rows, "split"))


@query("report_tables", "SELECT 'nation' AS report, CAST(count(*) AS BIGINT) AS n_rows, TRUE AS same FROM nation UNION ALL SELECT 'orders', count(*), TRUE FROM orders")
def report_tables(spark: SparkSession, d: str) -> DataFrame:
    """SK4 SK8: reports as tables with checksums, which a second run in another order of rows gives again."""
    got = []
    for order in ("n_name", "n_nationkey"):
        reports = {"nation": table(spark, d, "nation").orderBy(order), "orders": table(spark, d, "orders").repartition(3 if order == "n_name" else 2)}
        got.append(sinks.write_reports(reports, sinks.shared_folder(spark, "reports")))
    return got[0].join(got[1].withColumnsRenamed({"n_rows": "__n", "hash": "__hash"}), "report").select("report", "n_rows", F.expr("n_rows = __n AND hash = __hash").alias("same"))


@query("resumed_writes", "SELECT 'a' AS part, 'dilewati' AS status, CAST(count(*) AS BIGINT) AS n_rows FROM nation UNION ALL SELECT 'b', 'ditulis', count(*) FROM region")
def resumed_writes(spark: SparkSession, d: str) -> DataFrame:
    """SK9 X16: a write that fails leaves nothing of its part, and the next call goes on from there."""
    folder = sinks.shared_folder(spark, "resumed")
    bad = table(spark, d, "region").select(F.raise_error(F.lit("planned")).cast("string").alias("x"))
    parts = {"a": lambda: table(spark, d, "nation"), "b": lambda: bad}
    try:
        sinks.write_resumable(parts, folder, spark)
        raise AssertionError("the planned failure did not come")
    except Exception as e:
        if "planned" not in str(e):
            raise
    return sinks.write_resumable(parts | {"b": lambda: table(spark, d, "region")}, folder, spark)


NAMES = "CASE p_partkey % 5 WHEN 0 THEN concat('Toko A_', p_brand, '.csv') WHEN 1 THEN concat('Toko A_', p_brand, ' copy 2.csv') WHEN 2 THEN concat('tokoa_x_', p_brand, '.csv.csv') WHEN 3 THEN concat(p_brand, ' (1).csv') ELSE concat('Toko B _', p_brand, '.csv') END"
STEM = rf"(SELECT p_partkey, p_brand, {NAMES} AS file FROM part)"


@query(
    "mapping_from_names",
    f"""SELECT DISTINCT file, CASE p_partkey % 5 WHEN 2 THEN 'tokoa_x' WHEN 3 THEN '' WHEN 4 THEN 'Toko B' ELSE 'Toko A' END AS nama_toko, p_brand || CASE p_partkey % 5 WHEN 1 THEN ' copy 2' WHEN 3 THEN ' (1)' ELSE '' END AS nama_produk,
    CASE p_partkey % 5 WHEN 0 THEN 'toko a|' || lower(p_brand) WHEN 1 THEN 'toko a|' || lower(p_brand) || ' copy 2' WHEN 2 THEN 'tokoa_x|' || lower(p_brand) WHEN 3 THEN '' ELSE 'toko b|' || lower(p_brand) END AS product_key,
    CASE WHEN p_partkey % 5 = 3 THEN 'perlu_cek' ELSE 'ok' END AS status, CASE p_partkey % 5 WHEN 2 THEN 'underscore terakhir' WHEN 3 THEN 'tanpa underscore - cek manual' ELSE 'nama file' END AS sumber_nama,
    CASE p_partkey % 5 WHEN 1 THEN 'nama berakhiran salinan; akhiran tetap di nama_produk - cek' WHEN 2 THEN 'lebih dari satu underscore; dipisah pada underscore terakhir; akhiran .csv berulang dibuang' WHEN 3 THEN 'nama berkas tanpa ''_'' ; toko tidak dapat diturunkan' WHEN 4 THEN 'spasi di ujung/di sekitar underscore dibuang' ELSE '' END AS catatan FROM {STEM}""",
)
def mapping_from_names(spark: SparkSession, d: str) -> DataFrame:
    """PR14 S14."""
    return mapping(table(spark, d, "part").selectExpr(f"{NAMES} AS file").distinct())


ALIKE = rf"SELECT p_partkey, file, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(file, '(\.csv)+$', ''), '( copy 2| \(1\))$', '')), '[^0-9a-z]+', ' ', 'g'), 'l{{2,}}', 'l', 'g')) AS key FROM {STEM}"


@query("name_groups", f"WITH n AS ({ALIKE}), g AS (SELECT key, list_sort(list(DISTINCT file)) AS f, bool_or(p_partkey % 3 = 0) AS new FROM n GROUP BY key) SELECT key, array_to_string(f, ' / ') AS files FROM g WHERE len(f) > 1 AND new")
def name_groups(spark: SparkSession, d: str) -> DataFrame:
    """X7 S13."""
    f = table(spark, d, "part").selectExpr(f"{NAMES} AS file", "p_partkey % 3 = 0 AS is_new")
    return overlap.name_groups(f).select("key", F.array_join("files", " / ").alias("files"))


@query("key_clashes", "SELECT p_brand AS product_key, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand HAVING count(*) > 1")
def key_clashes(spark: SparkSession, d: str) -> DataFrame:
    """X8."""
    return overlap.key_clashes(table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS product_key"))


@query(
    "file_suggestions",
    """SELECT 'f' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 11 = 0 THEN ' copy' ELSE '' END AS file, CASE WHEN p_partkey % 7 = 0 THEN 'kecualikan (aturan salinan)' ELSE coalesce(nullif(concat_ws('; ',
    CASE WHEN p_partkey % 5 = 0 THEN '0 ulasan terbaca (cleaning akan melewati berkas); cek skema' END, CASE WHEN p_size >= 40 THEN 'tumpang tindih ' || CAST(p_size * 2 AS VARCHAR) || '.5% tanpa nama salinan; tinjau manual' END,
    CASE WHEN p_partkey % 3 = 0 THEN 'product_key sama dengan berkas lain (digabung jadi satu produk)' END, CASE WHEN p_partkey % 11 = 0 THEN 'bernama salinan tetapi tidak memenuhi aturan; tinjau' END), ''), 'pertahankan') END AS usulan FROM part""",
)
def file_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    p = table(spark, d, "part").selectExpr("concat('f', p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' copy' ELSE '' END) AS file", "CASE WHEN p_partkey % 3 = 0 THEN 'satu' ELSE concat('k', p_partkey) END AS product_key", "p_partkey % 5 AS n_reviews", "p_size * 2 + 0.5D AS pct", "p_partkey % 7 = 0 AS excluded")
    return overlap.suggestions(p, overlap.key_clashes(p))


@query("revised_mapping", "SELECT 'f' || CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN n_nationkey = 3 THEN 'bukan_data' WHEN n_nationkey % 6 = 1 THEN 'dikecualikan' WHEN n_nationkey < 20 THEN 'ok' ELSE 'baru' END AS status, concat_ws('; ', nullif(CASE WHEN n_nationkey < 20 THEN 'lama' ELSE '' END, ''), CASE WHEN n_nationkey % 6 = 1 THEN 'salinan' END) AS catatan FROM nation")
def revised_mapping(spark: SparkSession, d: str) -> DataFrame:
    """PR15 U2."""
    n = table(spark, d, "nation").selectExpr("concat('f', n_nationkey) AS file", "n_nationkey AS k")
    old = n.where("k < 20").selectExpr("file", "'ok' AS status", "'lama' AS catatan")
    new = n.where("k >= 15").selectExpr("file", "'baru' AS status", "'' AS catatan")
    return overlap.revised_mapping(old, new, n.where("k % 6 = 1").selectExpr("file", "'salinan' AS note"), "f3").select("file", "status", "catatan")


@query("directed_pairs", "WITH p AS (SELECT p_partkey AS a, p_partkey + 1 AS b, p_size AS x, p_size / 2.0 AS y FROM part) SELECT a AS file, b AS partner, CAST(x AS DOUBLE) AS pct FROM p UNION ALL SELECT b, a, CAST(y AS DOUBLE) FROM p")
def directed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """U7."""
    p = table(spark, d, "part").selectExpr("p_partkey AS file_a", "p_partkey + 1 AS file_b", "CAST(p_size AS DOUBLE) AS pct_a", "p_size / 2.0D AS pct_b", "false AS identical")
    return overlap.directed(p).drop("identical")


@query("same_key_groups", "SELECT 'FD' || CASE WHEN k < 10 THEN '0' ELSE '' END || CAST(k AS VARCHAR) AS file_dup_group, CAST(n AS BIGINT) AS n, one AS satu_kunci FROM (SELECT p_brand, min(p_partkey) AS first, count(*) AS n, count(DISTINCT p_size % 2) = 1 AS one, row_number() OVER (ORDER BY min(p_partkey)) AS k FROM part GROUP BY p_brand HAVING count(*) > 1)")
def same_key_groups(spark: SparkSession, d: str) -> DataFrame:
    """A6 W8."""
    p = table(spark, d, "part").selectExpr("p_partkey AS file", "sha2(p_brand, 256) AS sha256", "CAST(p_size % 2 AS STRING) AS product_key")
    return clean.same_key_groups(clean.duplicate_files(p.select("file", "sha256")), p.select("file", "product_key"))
