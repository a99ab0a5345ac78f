import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumbung.functions import columns as C


def values(spark, rule, cells):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cells)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_classify(spark):
    cases = {
        "": "kosong", "  NaN ": "kosong", "2024-01-05": "tanggal", "2024-01-05 7:08 | Variasi: Hitam": "tanggal", "3 hari lalu": "tanggal_relatif", "baru saja": "tanggal_relatif", "https://a.b/c": "url", "www.x.y": "url",
        "Respon Penjual:": "penanda_penjual", "a***b": "nama_tersamar", "12,5": "angka", "👍👍": "teks", "...": "simbol", "⚡Kinerja:": "label_aspek", "ini kalimat yang cukup panjang:": "teks", "bagus": "teks",
    }
    assert values(spark, C.classify, cases) == list(cases.values())


@pytest.mark.parametrize(
    ("raw", "status", "day"),
    [
        ("2024-1-5 7:08:09", "ok", dt.datetime(2024, 1, 5, 7, 8, 9)), ("2024-01-05 07:08 | Variasi: x", "ok", dt.datetime(2024, 1, 5, 7, 8)), ("2024-02-30", "tak_terparsing", None), ("05/01/2024", "tak_terparsing", None), ("", "tak_terparsing", None),
        ("2 jam lalu", "relatif_dikonversi", dt.datetime(2026, 7, 29)), ("kemarin", "relatif_dikonversi", dt.datetime(2026, 7, 28)), ("seminggu lalu", "relatif_dikonversi", dt.datetime(2026, 7, 22)), ("1 Bulan yang lalu", "relatif_dikonversi", dt.datetime(2026, 6, 29)),
        ("2 tahun lalu", "relatif_dikonversi", dt.datetime(2024, 7, 29)), ("baru saja", "tak_terparsing", None), ("5 detik lalu", "tak_terparsing", None), ("99999999999 hari lalu", "tak_terparsing", None),
    ],
)
def test_timestamps(spark, raw, status, day):
    df = spark.createDataFrame([(raw,)], "v string")
    anchor = F.expr("TIMESTAMP_NTZ'2026-07-29 10:00:00'")
    got = df.select(C.timestamp_fields(F.col("v"), anchor).alias("t")).select("t.*").first()
    if raw.startswith("999"):
        assert got["timestamp"] is None
    else:
        assert (got["status"], got["timestamp"]) == (status, day)


def test_month_ends_and_missing_anchor(spark):
    df = spark.createDataFrame([("1 bulan lalu", "2026-03-31"), ("1 tahun lalu", "2024-02-29"), ("1 bulan lalu", None)], "v string, a string")
    got = df.select(C.timestamp_fields(F.col("v"), F.expr("CAST(a AS TIMESTAMP_NTZ)")).alias("t")).select("t.timestamp", "t.status").collect()
    assert [r[0] for r in got] == [dt.datetime(2026, 2, 28), dt.datetime(2023, 2, 28), None]
    assert got[2][1] == "relatif_tanpa_acuan"


def test_joins_and_counts(spark):
    df = spark.sql("SELECT array(' bagus ', 'murah!', '', 'awet') AS f")
    r = df.select(C.joined_review(F.col("f")), C.joined_light(F.col("f"))).first()
    assert tuple(r) == ("bagus | murah! |  | awet", "bagus. murah! awet")
    assert values(spark, C.word_count, ["", " a b ", "a b"]) == [0, 2, 2]


def test_booleans(spark):
    assert values(spark, C.strict_boolean, ["True", " 0 ", "1"]) == [True, False, True]
    with pytest.raises(Exception, match="not a boolean"):
        values(spark, C.strict_boolean, ["ya"])


def test_names(spark):
    assert values(spark, C.is_copy_name, ["A_b copy.csv", "A_b copy 2.csv", "A_b (1).csv", "A_copybook.csv"]) == [True, True, True, False]
    assert values(spark, C.name_key, ["PHONCELL_A1 copy.csv", "phoncel a1.csv"]) == ["phoncel a1"] * 2
    assert values(spark, C.base_column_name, ["f35Wh2 (2)", "review 2"]) == ["f35Wh2", "review 2"]
    assert values(spark, C.name_hint, ["K5v3lN (3)", "HcSdrS src (2)", "timestamp", "x"]) == ["aspect_tag", "url_media", "timestamp", ""]
    assert values(spark, C.digit_mask, ["2024-01-05 | x", "12 hari lalu", ""]) == ["9999-99-99 | <teks>", "N hari lalu", "<kosong>"]


def test_probabilities(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.4), (1 / 3, 1 / 3, 1 / 3), (1.0, 0.0, 0.0), (None, 0.5, 0.5)], "a double, b double, c double")
    p = [F.col(x) for x in "abc"]
    got = df.select(C.argmax_label(*p), F.round(C.entropy(*p), 4), C.max_probability(*p)).collect()
    assert [r[0] for r in got] == ["netral", "negatif", "negatif", None]
    assert [r[1] for r in got] == [1.0549, 1.0986, 0.0, None]
    s = df.limit(1).select(*C.softmax(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))).first()
    assert tuple(round(x, 6) for x in s) == (0.5, 0.5, 0.0)


def test_words_are_counted_once_for_all_classes(spark, sf_dir):
    from pyspark.sql import functions as F

    from lumbung.functions import columns as C
    from lumbung.operators import eda
    from lumbung.plans.queries import QUERIES

    texts = ["", " ", "satu", " satu  dua tiga ", "a\u0085b\n", "\x1fa", None]
    df = spark.createDataFrame([(t, 0.2, 0.3, 0.5) for t in texts], "text string, p_negatif double, p_netral double, p_positif double")
    assert [r[0] for r in df.select(C.word_count(F.col("text"))).collect()] == [0, 0, 1, 3, 2, 1, None]
    out = eda.mean_by_length(df, C.word_count(F.col("text")))
    assert {r["kelas"]: r["n"] for r in out.collect() if r["n"]} == {"1-2": 3, "3-5": 1}
    plan = QUERIES["length_bins"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
