"""Mixing (7) against its SQL, and the pipeline's stages against brute-force versions of each."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lumbung.llm.mixing import OP7_SQL, mix, op7_mixing, rates


def test_op7_is_the_sql(spark, sf_dir, duck, same_rows):
    same_rows(op7_mixing(spark, sf_dir), duck.sql(OP7_SQL))


def test_mixing_meets_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"))
    got = {r["source"]: r["n"] for r in mix(df, ("doc_id", "source"), {"rare": 0.5, "common": 0.5}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["rare"] / 10_000 - 1) < 0.05 and abs(got["common"] / 10_000 - 1) < 0.05
    assert {r["source"]: round(r["rate"], 3) for r in rates(df, {"rare": 0.5, "common": 0.5}).collect()} == {"rare": 5.0, "common": 0.556}
    copies = Counter(r["doc_id"] for r in mix(df, ("doc_id",), {"rare": 1.0}).collect())
    mean = sum(copies.values()) / 2000
    assert abs(mean - 10) < 0.3 and abs(np.var([copies.get(i, 0) for i in range(0, 20_000, 10)]) - 10) < 1.5
    keys = [r["mix_key"] for r in mix(df, ("doc_id",)).limit(500).collect()]
    assert len(set(keys)) == len(keys)


def test_a_tiny_weight_keeps_its_source(spark):
    df = spark.createDataFrame([(1, "a" * 10, "tiny"), (2, "b" * 1000, "big"), (3, "c", "none")], "doc_id bigint, text string, source string")
    got = {r["source"]: r["rate"] for r in rates(df, {"tiny": 1.0, "big": 1e-7, "none": 0.0}).collect()}
    assert got["none"] == 0 and abs(got["big"] / (1e-7 / (1 + 1e-7) * 1011 / 1000) - 1) < 1e-8


def test_large_rates(spark):
    df = spark.createDataFrame([(1, "a" * 3, "s"), (2, "b" * 2997, "t")], "doc_id bigint, text string, source string")
    n = mix(df, ("doc_id",), {"s": 1.0}).count()
    assert 800 < n < 1200


def test_mixing_odd_rows(odd, none):
    assert mix(none, ("doc_id",)).count() == 0
    rows = mix(odd, ("doc_id", "source", "score", "kept")).collect()
    assert Counter(r["doc_id"] for r in rows)[6] % 2 == 0 and {"score", "kept", "copy_no", "rate", "mix_key"} <= set(rows[0].asDict())


def copies_by_force(docs, seed=7):
    """{row: copies} of rows (doc_id, text, source), from the definition of the Poisson distribution."""
    mass = Counter()
    for _, text, source in docs:
        mass[source] += len(text or "")
    weight = {k: m**0.5 for k, m in mass.items()}
    rate = {}
    for k, m in mass.items():
        exact = weight[k] / sum(weight.values()) * sum(mass.values()) / m if m else 1.0
        rate[k] = float(f"{exact:.8e}")
    out = []
    for i, text, source in docs:
        key = str(i) if i is not None else hashlib.md5((text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{seed}:copies:{key}".encode()).hexdigest()[:13], 16) / 2**52
        n, term = 0, math.exp(-rate[source])
        below = term
        while u >= below:
            n += 1
            term *= rate[source] / n
            below += term
        out.append(n)
    return out


def stage(name):
    return dict(cp.STAGES)[name]


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]


def test_pipeline_by_force(spark, sf_dir, docs, library):
    from test_dedup import components_by_force
    from test_quality import verdicts_by_force

    out = cp.materialise(stage("quality rules")(spark, docs, sf_dir), "t")
    verdicts = verdicts_by_force({r["doc_id"]: (r["text"] or "", r["lang"], r["source"]) for r in docs.collect()})
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, kept in verdicts.items() if kept} and out.count() < docs.count()
    good = {r["doc_id"]: r for r in out.collect()}
    out = cp.materialise(stage("exact dedup")(spark, out, sf_dir), "t")
    best = {}
    for i, r in good.items():
        k = "".join(c for c in r["text"] if c not in " \t\n\x0b\x0c\r")
        best[k] = min(best.get(k, (0, 10**9)), (-len(r["text"]), i))
    kept = {i for _, i in best.values()}
    assert {r["doc_id"] for r in out.collect()} == kept
    out = cp.materialise(stage("n-gram Jaccard join")(spark, out, sf_dir), "t")
    near = components_by_force({i: good[i]["text"] for i in kept}, 5, 80)
    heads = {c for _, c in near.values()}
    assert {r["doc_id"] for r in out.collect()} == heads and out.columns == docs.columns
    out = cp.materialise(stage("mixing sources to target weights")(spark, out, sf_dir), "t")
    mixed = Counter(r["doc_id"] for r in out.collect())
    rows = [(i, good[i]["text"], good[i]["source"]) for i in heads]
    want = Counter({i: n for (i, _, _), n in zip(rows, copies_by_force(rows), strict=True) if n})
    assert mixed == want and out.columns == docs.columns
    done = stage("BPE encoding and decoding")(spark, out, sf_dir).collect()
    assert Counter(r["doc_id"] for r in done) == mixed
    for r in done[:80]:
        ids = np.array(library.encode(good[r["doc_id"]]["text"], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r["ids"]) == ids and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
    assert Counter(r["doc_id"] for r in cp.run(spark, sf_dir).select("doc_id").collect()) == mixed


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_rows(spark, odd, none, name):
    f = stage(name)
    assert f(spark, none, "").count() == 0
    out = f(spark, odd, "")
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    if name != cp.STAGES[-1][0]:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = odd.collect()
    if name == "quality rules":
        from test_quality import counts_by_force

        base = [counts_by_force(r["text"] or "") for r in rows]
        assert ids == Counter(r["doc_id"] for r, n in zip(rows, base, strict=True) if n[0] >= 10 and 100 * n[4] <= 20 * n[0])
    if name == "exact dedup":
        assert ids == {3: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    if name == "mixing sources to target weights":
        copies = copies_by_force([(r["doc_id"], r["text"], r["source"]) for r in rows])
        assert ids == Counter({i: n for i in {r["doc_id"] for r in rows} if (n := sum(c for r, c in zip(rows, copies, strict=True) if r["doc_id"] == i))})
    if name == "BPE encoding and decoding":
        got = {r["doc_id"]: r["n_tokens"] for r in out.where("doc_id IN (1, 2, 3, 6)").collect()}
        assert ids == Counter(r["doc_id"] for r in rows) and got[1] == got[2] == got[3] == 0 < got[6]
    if name == "n-gram Jaccard join":
        assert ids[4] == 1 and ids[5] == 0 and ids[None] == 2
