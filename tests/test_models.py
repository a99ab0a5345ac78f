import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbung.config import HmmConfig, LexiconConfig
from lumbung.functions.columns import PROBABILITIES
from lumbung.operators import audits, eda, hmm, lexicon, score, sequences, split
from lumbung.plans.queries import QUERIES, SEEDS, export_source, fake_model


def random_model(rng, k, d):
    return hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.normal(size=(k, d)), rng.uniform(0.2, 1, (k, d)))


@pytest.mark.parametrize("k", [2, 3])
def test_forward_and_posterior_by_brute_force(k):
    rng = np.random.default_rng(k)
    m, x = random_model(rng, k, 3), rng.normal(size=(5, 3))
    e, paths = m.log_emission(x), {}
    for path in itertools.product(range(k), repeat=5):
        paths[path] = math.log(m.start[path[0]]) + sum(math.log(m.moves[a, b]) for a, b in itertools.pairwise(path)) + sum(e[t, s] for t, s in enumerate(path))
    total = math.log(sum(math.exp(v) for v in paths.values()))
    g, pairs, ll = m.posterior(x)
    assert ll == pytest.approx(total, abs=1e-10) and m.log_likelihood(x) == pytest.approx(total, abs=1e-10)
    for t in range(5):
        for s in range(k):
            assert g[t, s] == pytest.approx(sum(math.exp(v - total) for p, v in paths.items() if p[t] == s), abs=1e-10)
    assert pairs.sum() == pytest.approx(4)


def scored(spark, n=12, length=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for kind, means in (("good", [(0.05, 0.2, 0.75)]), ("shift", [(0.05, 0.2, 0.75), (0.7, 0.2, 0.1)]), ("bad", [(0.7, 0.2, 0.1)])):
        for i in range(n):
            t = length + int(rng.integers(-3, 4))
            for s in range(t):
                p = rng.dirichlet(30 * np.array(means[s * len(means) // t]))
                rows.append((f"{kind}{i}", s, *map(float, p)))
    return spark.createDataFrame(rows, "product_id string, row_order int, p_negatif double, p_netral double, p_positif double").withColumn("timestamp", F.expr("CAST(date_add(DATE'2024-01-01', row_order) AS TIMESTAMP_NTZ)"))


def test_fit_features_and_order_of_rows(spark):
    df = scored(spark)
    config = HmmConfig(iterations=15, restarts=2)
    seqs = sequences.build_sequences(df).cache()
    found = hmm.fit(seqs, config)
    assert found.model.valid() and all(b >= a - 1e-6 for a, b in itertools.pairwise(found.history))
    f = {r["product_id"]: r for r in hmm.features(seqs, found.model).collect()}
    kind = lambda k, c: np.mean([r[c] for p, r in f.items() if p.startswith(k)])
    assert kind("good", "prop_state1") < 0.2 and kind("bad", "prop_state1") > 0.7 and kind("shift", "pos_transisi") > kind("good", "pos_transisi")
    again = hmm.fit(sequences.build_sequences(df.repartition(3, "row_order")), config)
    assert np.allclose(again.model.means, found.model.means, atol=1e-9)
    assert np.allclose(hmm.Model.from_json(found.model.to_json()).moves, found.model.moves)


def test_sums_of_many_sequences_are_those_of_each():
    rng = np.random.default_rng(7)
    models, lengths = [random_model(rng, 2, 3), random_model(rng, 2, 3)], [6, 4, 4, 1]
    x, neg = rng.normal(size=(15, 3)), rng.uniform(size=15)
    for m, got in zip(models, hmm._sums(models, x, neg, np.array(lengths)), strict=True):
        want, at = None, 0
        for n in lengths:
            g, pairs, ll = m.posterior(x[at : at + n])
            one = [g[0], pairs, g.sum(axis=0), g.T @ x[at : at + n], g.T @ x[at : at + n] ** 2, np.array([ll]), g.T @ neg[at : at + n]]
            want, at = one if want is None else [a + b for a, b in zip(want, one, strict=True)], at + n
        assert all(np.allclose(a, b, atol=1e-10) for a, b in zip(got, want, strict=True))


def test_hmm_features_fits_to_the_end(spark, sf_dir, monkeypatch):
    kept, fit = [], hmm.fit
    monkeypatch.setattr(hmm, "fit", lambda *a: kept.append((a[1], fit(*a))) or kept[-1][1])
    QUERIES["hmm_features"](spark, sf_dir)
    config, found = kept[0]
    assert config == HmmConfig() and len(found.restarts) == 10
    assert found.converged or found.iterations == 200


def test_run_guards_the_split(spark, tmp_path):
    df = scored(spark, n=3, length=6).withColumn("label", F.lit(1))
    ids = df.select("product_id").distinct()
    found, out, meta = hmm.run(df, ids.withColumn("split", F.when(F.col("product_id").endswith("0"), "test").otherwise("train")), HmmConfig(iterations=2, restarts=1))
    assert {r["a"] for r in meta["correlation"]} == {"log_lik", "prop_state1", "pos_transisi", "occ_state1"} and meta["describe"][0]["n"] == out.count()
    hmm.saved(found, {"fit_ids": meta["fit_ids"]}, str(tmp_path / "model"), spark)
    model, facts = hmm.loaded(str(tmp_path / "model"), spark)
    assert model.to_json() == found.model.to_json() and facts["fit_ids"] == meta["fit_ids"] and facts["converged"] == found.converged
    with pytest.raises(Exception, match="(?i)exists"):
        hmm.saved(found, {}, str(tmp_path / "model"), spark)
    assert [r["seed"] for r in hmm.stability(sequences.build_sequences(df), (1, 2), HmmConfig(iterations=2, restarts=2)).collect()] == [1, 2]
    assert out.count() == 9 and len(meta["fit_ids"]) == 64
    both = ids.withColumn("split", F.lit("train")).union(ids.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="leaks"):
        hmm.run(df, both, HmmConfig(iterations=1, restarts=1))


def test_sequences_refuse_what_is_off_the_simplex(spark):
    df = scored(spark, n=1, length=5)
    with pytest.raises(Exception, match="simplex"):
        sequences.build_sequences(df.withColumn("p_netral", F.lit(0.9))).collect()
    assert sequences.build_sequences(df.where("row_order < 2")).count() == 0


def test_export_finds_faults(spark):
    df = scored(spark, n=2, length=5).select(
        F.concat_ws("-", "product_id", F.col("row_order").cast("string")).alias("review_id"), "product_id", F.lit("t").alias("nama_toko"), F.col("product_id").alias("nama_produk"), F.col("timestamp").cast("string").alias("timestamp"), F.col("row_order").cast("string").alias("row_order"),
        F.lit("True").alias("include_for_inference"), F.lit("False").alias("text_proposal_kosong"), *[F.col(p).cast("string").alias(p) for p in PROBABILITIES],
    )
    audit = sequences.audit_table(df)
    a = sequences.sequence_table(audit)
    assert sequences.export_checks(df, audit, a).where("NOT passed").count() == 0
    bad = {r["name"] for r in sequences.export_checks(df, audit, a.withColumn("seq", F.col("seq") + 1)).where("NOT passed").collect()}
    assert {"urutan 1..T", "A dapat dibentuk dari B"} <= bad


def test_export_tells_rows_apart_by_digests(spark):
    """counts of differing rows as two differences of multisets have them; an audit sorts once, and no text is dealt out for a count."""
    schema = "a string, b string, n int"
    one = spark.createDataFrame([("1:x", "", 1), ("1:x", "", 1), (None, "-", 2), ("-", None, 2), ("", None, None), ("x", "y", None), ("\u00e9", "1:", 3)], schema)
    other = spark.createDataFrame([("1:x", "", 1), ("-", "-", 2), (None, None, 2), (None, "", None), ("x", "y", None), ("e\u0301", "1:", 3), ("x", "y", None)], schema)
    want = one.exceptAll(other).count(), other.exceptAll(one).count()
    n = [r["surplus"] for r in audits.surplus(one, other.withColumnsRenamed({"a": "b", "b": "a"})).collect()]
    assert (sum(x for x in n if x > 0), -sum(x for x in n if x < 0)) == want == (5, 5)
    assert not any(r["surplus"] for r in audits.surplus(one, one).collect())
    source = export_source(spark, "/root/testdata/sf0.001")
    audit = sequences.audit_table(source)
    assert str(audit._jdf.queryExecution().sparkPlan()).count("Window") == 2 and str(audit._jdf.queryExecution().executedPlan()).count("Sort [") == 1
    plan = str(audits.surplus(source, source)._jdf.queryExecution().executedPlan())
    assert all("nama_produk" not in x for x in plan.splitlines() if "Exchange" in x or "HashAggregate" in x)


def test_orientation_by_hand(spark):
    docs = spark.createDataFrame([(1, ["baik", "asli"]), (2, ["baik", "asli", "cepat"]), (3, ["buruk", "palsu"]), (4, ["buruk", "palsu"])], "doc_id int, tokens array<string>")
    got = {r["word"]: r["so"] for r in lexicon.semantic_orientation(docs, ["asli"], ["palsu"]).collect()}
    assert got["baik"] == pytest.approx(math.log(2 * 9 / 4)) and got["buruk"] == pytest.approx(-math.log(2 * 9 / 4))
    b = {r["word"]: r["label"] for r in lexicon.bootstrap(docs, ["asli"], ["palsu"], LexiconConfig(iterations=20)).collect()}
    assert b["baik"] in ("genuine", "discard")


def test_bootstrap_ci_draws_all_resamples(spark, tmp_path):
    spark.createDataFrame([(i, "good with and fine" if i % 2 else "bad that der poor") for i in range(40)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: r for r in QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()}
    assert got["good"]["n_iter"] == 50 and got["good"]["n"] == 20
    assert got["good"]["label"] == "genuine" and got["bad"]["label"] == "counterfeit"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("doc_id", "split(text, ' ') AS tokens")
    alone = lexicon.semantic_orientation(docs, *SEEDS).collect()
    assert {r["word"]: (r["n"], round(r["so"], 5)) for r in alone} == {w: (r["n"], r["so"]) for w, r in got.items()}


def test_scoring(spark):
    df = spark.createDataFrame([(1, "halo dunia"), (2, "  "), (3, None), (4, "satu " * 200)], "k int, t string")
    labels = {0: "Positive", 1: "neutral", 2: "NEGATIVE"}
    got = {r["k"]: r for r in score.score_texts(df, "t", fake_model, labels).collect()}
    assert got[2]["p_negatif"] is None and got[3]["label_argmax"] is None and got[4]["truncated"] and got[4]["n_token"] == 202
    one = score.score_texts(df.where("k = 1"), "t", fake_model, labels).first()
    assert one["p_positif"] == pytest.approx(got[1]["p_positif"]) and sum(one[p] for p in PROBABILITIES) == pytest.approx(1)
    for bad in ({0: "a", 1: "b", 2: "c"}, {0: "pos", 1: "pos", 2: "neg"}):
        with pytest.raises(ValueError):
            score.label_order(bad)
    with pytest.raises(ValueError):
        score.probabilities(np.array([[np.nan, 0, 0]]))
    with pytest.raises(ValueError):
        score.checked_length(64, 512)


def test_splits(spark):
    ids = spark.range(20).withColumnRenamed("id", "product_id")
    got = {r["split"]: r["count"] for r in split.product_split(ids).groupBy("split").count().collect()}
    assert got == {"train": 16, "validation": 2, "test": 2}
    assert split.temporary_split(ids.limit(2)).where("split = 'test'").count() == 1
    with pytest.raises(ValueError):
        split.product_split(ids, 0.8, 0.1, 0.2)


def test_samples_and_labels(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    assert [r["id"] for r in eda.evenly_spaced(df, ["id"], 3).orderBy("id").collect()] == [0, 50, 99]
    a = {r["id"] for r in eda.hash_sample(df, "id", 10).collect()}
    assert a == {r["id"] for r in eda.hash_sample(df.repartition(5), "id", 10).collect()}
    labels = {r["s"]: r["label"] for r in eda.anonymous_labels(df, "s", "id").collect()}
    assert labels["0"] == "Toko A" and labels["26"] == "Toko AA"


def test_sequences_go_to_workers_in_batches_of_bounded_bytes(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    seqs = sequences.build_sequences(scored(spark))
    for make in (lambda: hmm.features(seqs, hmm.first_model()), lambda: hmm.packed(seqs)):
        spark.conf.unset(bound)
        df = make()
        assert int(spark.conf.get(bound)) <= 4 << 20 and df.count() == 36


def test_bootstrap_makes_no_row_for_a_resample(spark):
    docs = spark.createDataFrame([(i, ["asli", "bagus", "palsu", "rusak"]) for i in range(30)], "doc_id int, tokens array<string>")
    out = lexicon.bootstrap(docs, ["asli"], ["palsu"], LexiconConfig(iterations=20))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert " iter#" not in plan and "[iter#" not in plan and {r["n_iter"] for r in out.collect()} == {20}
