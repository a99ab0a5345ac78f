from pyspark.sql import functions as F

from lumbung.functions.text import LexicalChain, clean_light, clean_proposal, review_key, standard_words


def cleaned(spark, texts, chain, field="text"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.select("i", chain(F.col("v")).alias("c")).orderBy("i").select(f"c.{field}").collect()]


def test_light(spark):
    texts = ["bagusss&nbsp;<b>sekali</b> 5000mAh", "lihat https://a.b/c?d ya\u200b\u200b", "\U0001f468\u200d\U0001f469\u200d\U0001f467 a\u200db\t\ufb01", None, "&lt;b&gt;aaaa 1111 \u2460\u2460\u2460", "a\x1cb\u00a0\u00a0c"]
    assert cleaned(spark, texts, clean_light) == ["baguss sekali 5000mAh", "lihat ya", "\U0001f468\u200d\U0001f469\u200d\U0001f467 ab fi", "", "aa 1111 111", "a b c"]
    assert cleaned(spark, ["\ufb01"], lambda c: clean_light(c, False)) == ["\ufb01"]


def test_proposal(spark):
    texts = ["Bagusss!!! \U0001f44d 1\ufe0f\u20e3 12345678 www.x.y", "a\u200bb\u2028c\u00a0d", "!?!?", "*\u20e3 #\u20e3 a_b", "Oriii ORI bukan  ori kwww KW"]
    assert cleaned(spark, texts, clean_proposal) == ["Bagus!", "ab c d", "!?!?", "a b", "Ori ORI bukan ori kw KW"]
    slang = {"gk": "tidak", "bgt": "banget", "ori": "asli", "kw": "tiruan", "bukan kw": "asli", "tdk  bs": "tidak bisa", "tdk": "tidak", "jum'at": "Jumat"}
    texts = ["gk BGT Gk", "bukan  ori kw", "tdk   bs tdk, bsa", "Tdk Bs", "bukan kw", "jum'at jum'ata xjum'at", "gkgk gk"]
    assert cleaned(spark, texts, lambda c: clean_proposal(c, slang)) == ["tidak BANGET Tidak", "bukan ori kw", "tidak bisa tidak, bsa", "Tidak bisa", "bukan kw", "Jumat jum'ata xjum'at", "gkgk tidak"]
    assert standard_words({"gk": "tidak", "ya": "ya"}, ())("gk gk ya") == ("tidak tidak ya", [{"key": "gk", "standard": "tidak"}] * 2)


def test_columns(spark):
    df = spark.createDataFrame([("a<br>b",), (None,)], "v string")
    got = df.select(clean_light(F.col("v")).alias("c")).select("c.text", "c.hapus_html").collect()
    assert [tuple(r) for r in got] == [("a b", True), ("", False)]
    got = df.select(clean_proposal(F.col("v"), {"a": "z"}).alias("c")).select("c.text", "c.slang").collect()
    assert got[0][0] == "z br b" and [tuple(x) for x in got[0][1]] == [("a", "z")]
    assert df.select(review_key("v")).first()[0] == "a<br>b"


def test_lexical():
    chain = LexicalChain(["sesuai deskripsi", "asli"], ["tidak", "bukan", "belum"], domain={"brg": "barang"}, public={"brg": "x", "gk": "tidak"}, stopwords=["yang", "asli"])
    assert chain.tokens("Brg yang gk bagus, sesuai   deskripsi 100 asli") == ["barang", "tidak_bagus", "sesuai_deskripsi", "asli"]
    assert chain.tokens("brg, tidak") == ["brg", "tidak"]


def test_texts_go_to_workers_in_batches_of_bounded_bytes(spark):
    from pyspark.sql import functions as F

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    for make in (clean_light, lambda t: clean_proposal(t, {"und": "dan"}), review_key):
        spark.conf.unset(bound)
        make(F.col("v"))
        assert int(spark.conf.get(bound)) <= 4 << 20
