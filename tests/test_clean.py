"""A folder of three differently shaped exports, from files to reviews."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lumbung.config import CleanConfig, HmmConfig, SequenceConfig
from lumbung.operators import audits, clean, overlap
from lumbung.sources import files as files_
from lumbung.sources import sinks

A = """web_scraper_order,web_scraper_start_url,data,timestamp,data3
1,https://shop/x,"bagus sekali <b>mantap</b>",2024-01-05 07:08,a***b
2,https://shop/x,"barang sampai dengan cepat | Variasi: Hitam",2024-01-06 09:00,c***d
3,https://shop/x,"bagus sekali <b>mantap</b>",2024-01-05 07:08,e***f
4,https://shop/x,,2024-01-07,g***h
5,https://shop/x,"bagus sekali <b>mantap</b>",3 hari lalu,i***j
"""
B = """time,item-content-main-content-reviews-item,img-more-text,review-attribute
2 minggu lalu,hp nya bagus sekali,+2,Kualitas:
05/01/2024,"kamera jernih, baterai awet",+1,Kinerja:
,,+3,Desain:
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    for name, text in (("Toko A_HP Satu.csv", A), ("Toko B_HP Dua.csv", B), ("Toko C_HP Dua.csv", B)):
        (d / name).write_text(text, encoding="utf-8-sig")
        os.utime(d / name, (1_785_283_200, 1_785_283_200))  # 2026-07-29 in UTC
    return str(d)


@pytest.fixture(scope="module")
def result(spark, folder):
    names = ["Toko A_HP Satu.csv", "Toko B_HP Dua.csv", "Toko C_HP Dua.csv"]
    mapping = spark.createDataFrame([(n, n[:6], n[7:-4], n[:-4].lower().replace("_", "|")) for n in names], "file string, nama_toko string, nama_produk string, product_key string")
    raw = files_.read_files(spark, folder)
    return clean.clean_folder(raw, files_.read_cells(raw), mapping)


def test_roles(result):
    roles = {(r["file"][:6], r["column"]): r["role"] for r in result.roles.collect()}
    assert roles["Toko A", "data"] == "review_text" and roles["Toko A", "timestamp"] == "timestamp"
    assert roles["Toko A", "data3"] == "metadata" and roles["Toko A", "web_scraper_start_url"] == "url_media"
    assert roles["Toko B", "review-attribute"] == "aspect_tag" and roles["Toko B", "item-content-main-content-reviews-item"] == "review_text"


def test_reviews(result):
    rows = {(r["source_file"][:6], r["row_order"]): r for r in result.reviews.collect()}
    assert set(rows) == {("Toko A", 0), ("Toko A", 1), ("Toko A", 2), ("Toko A", 4), ("Toko B", 0), ("Toko B", 1), ("Toko C", 0), ("Toko C", 1)}
    first, again, later = rows["Toko A", 0], rows["Toko A", 2], rows["Toko A", 4]
    assert first["text_light"] == "bagus sekali mantap" and not first["is_technical_duplicate"]
    assert again["is_technical_duplicate"] and not again["include_for_inference"]
    assert later["timestamp_is_estimated"] and later["is_text_duplicate"] and later["include_for_inference"] and later["dup_group_size"] == 3
    assert later["timestamp_anchor_source"] == "mtime" and str(later["timestamp"])[:10] == "2026-07-26"
    assert rows["Toko B", 1]["timestamp_status"] == "tak_terparsing" and rows["Toko B", 0]["aspect_tags"] == "Kualitas:"
    assert rows["Toko B", 0]["file_dup_group"] == "FD01" and rows["Toko A", 0]["schema_family"] == "A_webscraper"
    assert len({r["review_id"] for r in rows.values()}) == len(rows)


def test_checks_hold_and_find_faults(result):
    assert audits.clean_checks(result.reviews, result.manifest).where("NOT passed").count() == 0
    broken = result.reviews.withColumn("review_id", F.lit("x")).withColumn("seq_in_product", F.col("seq_in_product") + 1)
    bad = {r["name"] for r in audits.clean_checks(broken, result.manifest).where("NOT passed").collect()}
    assert {"review_id unik", "urutan 1..n per produk"} <= bad


def test_manifest(result):
    m = {r["file"][:6]: r for r in result.manifest.collect()}
    assert m["Toko A"]["n_baris_sumber"] == 5 and m["Toko A"]["n_sel_kosong"] == 1 and all(r["seimbang"] for r in m.values())


def test_vocabulary_moves_fragments(spark, folder):
    cells = files_.read_cells(files_.read_files(spark, folder, "Toko B*.csv"))
    vocabulary = spark.createDataFrame([("hp nya bagus sekali",)], "key string")
    from lumbung.operators.profile import column_roles

    rows = clean.rebuilt_rows(clean.tagged_cells(cells, column_roles(cells), vocabulary)).orderBy("row_order").collect()
    assert rows[0]["drop_reason"] == "hanya_bukan_teks" and rows[0]["tags"] == ["hp nya bagus sekali", "Kualitas:"]


def test_anchor_rules(spark):
    files = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2026-07-28 20:00:00'), ('b', TIMESTAMP'2024-01-01 00:00:00'), ('c', TIMESTAMP'2024-01-01 00:00:00') AS t(file, modified)")
    cells = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-05-05 10:00"), ("c", "2024-05-05")], "file string, value string")
    over = spark.sql("SELECT 'c' AS file, TIMESTAMP_NTZ'2025-01-01 00:00:00' AS day")
    got = {r["file"]: (r["timestamp_anchor_source"], str(r["timestamp_anchor"])[:10]) for r in files_.timestamp_anchors(cells, files, over, "Asia/Jakarta").collect()}
    assert got == {"a": ("mtime", "2026-07-29"), "b": ("tidak_ada", "None"), "c": ("scrape_dates.csv", "2025-01-01")}


def test_greedy_exclusion():
    files = [("a", False), ("a copy", True), ("b", False), ("c copy", True), ("c copy 2", True)]
    pairs = [("a", "a copy", 90.0, False), ("a copy", "a", 100.0, True), ("b", "a", 95.0, False), ("a", "b", 95.0, False), ("c copy", "c copy 2", 100.0, True), ("c copy 2", "c copy", 100.0, True)]
    assert overlap.exclusions(files, pairs) == {"a copy": ("a", 100.0, True), "c copy": ("c copy 2", 100.0, True)}


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "k int, t string, v int")
    b = spark.createDataFrame([(2, "y", 7), (1, "x", 8)], "k int, t string, v int")
    got = audits.one_to_one_join(a, b, "k", ["t"], ["v"])
    assert sorted(map(tuple, got.collect())) == [(1, "x", 8), (2, "y", 7)]
    for wrong in (b.limit(1), b.union(b), b.withColumn("t", F.lit("z"))):
        with pytest.raises(ValueError, match="differ|unique"):
            audits.one_to_one_join(a, wrong, "k", ["t"], ["v"])


def test_slang_profile(spark):
    rows, gate = audits.slang_source_profile(spark.createDataFrame([("gk", "tidak", "0"), ("gk", "enggak", "0"), ("bgt", "banget", "0"), ("ada", "ada", "1"), ("", "x", "0"), ("a1", "b", "0")], "slang string, formal string, in_dictionary string"))
    reasons = {(r["key"], r["standard"]): r["reason"] for r in rows.collect()}
    assert reasons["gk", "tidak"] == "ambigu" and reasons["bgt", "banget"] is None and reasons["ada", "ada"] == "sama_dengan_baku" and reasons["a1", "b"] == "berisi_angka"
    assert gate.first()["stop"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d.csv").write_text("slang,baku\nGk ,tidak\n", encoding="utf-8-sig")
    assert files_.slang_dictionary(spark, str(tmp_path / "d.csv")) == {"gk": "tidak"}
    (tmp_path / "e.csv").write_text("slang,baku\ngk,tidak\nGK,bukan\n")
    with pytest.raises(ValueError, match="two standards"):
        files_.slang_dictionary(spark, str(tmp_path / "e.csv"))
    (tmp_path / "s.csv").write_text("file,tanggal_scrape\na.csv,2024-01-05\n")
    assert files_.scrape_dates(spark, str(tmp_path / "s.csv")).count() == 1
    assert files_.unique_headers(["a", "b", "a"]) == ["a", "b", "a.1"] and files_.decoded(b"caf\xe9")[1] == "cp1252"
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "d e")], "k int, t string")
    sinks.write_new(df, str(tmp_path / "out"))
    assert sinks.is_done(spark, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(df, str(tmp_path / "out"))
    sinks.write_csv(df.orderBy("k"), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfk,t\n1,")
    assert sinks.table_hash(df).first() == sinks.table_hash(df.orderBy(F.desc("k")).repartition(3)).first()


@pytest.mark.parametrize("make", [lambda: CleanConfig(strong_rate=0.2), lambda: SequenceConfig(min_reviews=1), lambda: HmmConfig(states=1)])
def test_configs_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_legacy_columns(spark, folder):
    from lumbung.operators.profile import legacy_columns

    cells = files_.read_cells(files_.read_files(spark, folder))
    got = {(r["file"][:6], r["column"], r["kind"]) for r in legacy_columns(cells).collect()}
    assert ("Toko A", "timestamp", "timestamp") in got and ("Toko B", "item-content-main-content-reviews-item", "review") in got and ("Toko B", "time", "timestamp") in got
    rows = spark.createDataFrame([("p", 0, "baguuuus 5000"), ("p", 1, "baguuuus 5000"), ("p", 2, "x")], "product string, row_order int, review string")
    assert [r["review"] for r in clean.legacy_clean(rows).collect()] == ["baguus 500"]


def test_files_in_pieces_are_read_as_a_whole(spark, tmp_path, monkeypatch):
    """Cut after any bytes, in each encoding, with line ends of all kinds and a cell longer than the csv module's own limit."""
    import csv
    import io

    texts = {
        "a.csv": "﻿x,y\r\n\"satu\r\ndua\",é\r\n\n,\"\"\r\ntiga\n".encode(), "b.csv": b"x,x\r1,\"caf\xe9 \n \x80\"\r\r2\r", "c.csv": b"x\n\x81\xff\n", "d.csv": b"", "e.csv": ("x,y\n" + "panjang " * 30_000 + ',"z').encode(), "f.csv": b"\xed\xa0\x80,y\n1,2\n"
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    want = set()
    csv.field_size_limit(1 << 30)
    for name, data in texts.items():
        text, encoding = files_.decoded(data)
        rows = csv.reader(io.StringIO(text, newline=""))
        header = files_.unique_headers(next(rows, []))
        for n, row in enumerate(r for r in rows if r):
            want |= {(name, n, k, c, v, encoding) for k, (c, v) in enumerate(zip(header, row + [""] * (len(header) - len(row)), strict=False))}
    for piece in (3, 1000):
        monkeypatch.setattr(files_, "PIECE", piece)
        got = files_.read_cells(files_.read_files(spark, str(tmp_path))).collect()
        assert {tuple(r[c] for c in ("file", "row_order", "position", "column", "value", "encoding")) for r in got} == want and len(got) == len(want)
    assert {e for *_, e in want} == {"utf-8", "cp1252", "latin1"}


def test_a_worker_is_given_pieces_of_a_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(b"x,y\n" + b"satu dua,tiga\n" * 400_000)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    seen, real = spark.sparkContext.accumulator(0), files_.lines

    def lines(pieces, encoding):
        def counted():
            for p in pieces:
                seen.add(1)
                assert len(p) <= files_.PIECE
                yield p

        return real(counted(), encoding)

    monkeypatch.setattr(files_, "lines", lines)
    raw = files_.read_files(spark, str(tmp_path))
    out = files_.read_cells(raw)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert out.count() == 800_000


def test_cells_and_reviews_are_not_dealt_out_by_column_or_text(spark, result):
    """Joins with a row a file or column are sent out; flags put no text into the exchange of a product."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(file#\d+, column#\d+, \d+\)[^\n]*\n[^\n]*value#", plan(result.tagged))
    assert "SortMergeJoin [file" not in plan(result.tagged) and "ShuffledHashJoin [file" not in plan(result.tagged)
    docs = spark.createDataFrame([(1, "p", "teks", None, False, False, "f", 1)], "review_id int, product_id string, text_light string, timestamp timestamp_ntz, timestamp_has_time boolean, timestamp_is_estimated boolean, source_file string, row_order int")
    flags = clean.with_flags(docs).select("review_id", "dup_group_size", "seq_in_product")
    assert [tuple(r) for r in flags.collect()] == [(1, 1, 1)]
    for line in plan(flags).splitlines():
        assert "Window" not in line or "text_light" not in line
