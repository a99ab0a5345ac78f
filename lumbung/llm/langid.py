"""Language identification: averaged hashed subword embeddings under a linear softmax.

The model is fitted with stochastic gradient descent in numpy, on the driver, over a bounded sample of labelled rows
for each language. The sample's texts are taken whole: tasks turn them into counts of subwords, of a bounded number. A text's subwords are the 2 to 4 byte runs of its lower-cased letters with single spaces
between words; each falls in one of ``BUCKETS`` rows of the embedding. As the average and the softmax's layer are both
linear, scoring looks up each subword's share of the logits and averages those. Scores are calibrated with a temperature on
sampled rows that took no part in fitting, which also give the score below which a prediction is rejected.

A text that is null, empty or without letters is ``und`` with score 0 and is rejected. A row's prediction depends on its
text alone, so repeated rows agree; of languages with the same score the first by name wins. Equal rows count once in the
sample. Without labelled rows (an empty table), every text is ``und``. More than ``MOST_LANGS`` languages are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbung.llm.common import documents, held_out, materialise

BUCKETS = 1 << 16
DIM = 16
#: Sampled rows for each language, and languages beyond which a model would not fit the driver.
FIT_DOCS, MOST_LANGS = 1200, 2000
#: Share of right predictions that accepted ones should have on the calibration rows.
PRECISION = 0.99

#: ASCII bytes that are not letters become spaces.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of all runs of 2, 3 and 4 bytes, by the position of their first byte."""
    code, out = data.astype(np.uint32), []
    for n in (2, 3, 4):
        code = code[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] if n <= len(data) else code[:0]
        out.append((code * np.uint32(2654435761 + 2 * n) >> np.uint32(16)) & np.uint32(BUCKETS - 1))
    return out


def examples(text: str | None, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets with their counts: of the whole text, and of short stretches of it, so that short texts are known as well."""
    if not has_letter(text):
        return []
    words, rng = plain(text).split(), np.random.default_rng(key & (1 << 63) - 1)
    cuts = [words] + [words[s : s + n] for n in (1, 3, 10) for s in [int(rng.integers(0, max(1, len(words) - n)))]]
    found = [np.zeros(BUCKETS, np.int64) for _ in cuts]
    for total, cut in zip(found, cuts, strict=True):
        data = b" " + b" ".join(cut) + b" "
        for at, end in _blocks(len(data)):
            for buckets in subwords(np.frombuffer(data[at : end + 3], np.uint8)):
                total += np.bincount(buckets[: end - at], minlength=BUCKETS)
    return [(rows, total[rows]) for total in found for rows in [np.flatnonzero(total)]]


def _blocks(n: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Parts of n bytes; runs may reach 3 bytes past a part's end."""
    for at in range(0, n, size):
        yield at, min(at + size, n)


Sample = list[tuple[str, bool, list[tuple[np.ndarray, np.ndarray]]]]


def fit(sample: Sample, seed: int = 11, epochs: int = 3) -> tuple[list[str], np.ndarray, float, float]:
    """Languages, each bucket's share of the logits, the temperature and the score to reject below.

    The sample: of each text the language, whether it is for calibration only, and its examples.
    """
    rng = np.random.default_rng(seed)
    names = sorted({lang for lang, _, _ in sample})
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0
    y_of = {k: i for i, k in enumerate(names)}
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, len(names)), np.float32)
    learn = [(rows, times, y_of[lang]) for lang, aside, parts in sample if not aside for rows, times in parts if len(rows)]
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs) + 0.02
        for k in rng.permutation(len(learn)):
            rows, times, y = learn[k]
            weight = (times / times.sum()).astype(np.float32)
            mean = weight @ embed[rows]
            logits = mean @ layer
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            embed[rows] -= np.outer(rate * 20 * weight, back)
    shares = (embed @ layer).astype(np.float32)
    aside = [(times @ shares[rows] / times.sum(), y_of[lang]) for lang, a, parts in sample if a for rows, times in parts if len(rows)]
    if not aside:
        return names, shares, 1.0, 0.0
    temperature, reject_below = calibrated(np.stack([a for a, _ in aside]).astype(np.float64), np.array([b for _, b in aside]))
    return names, shares, temperature, reject_below


def calibrated(logits: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """The temperature of the least mean loss, and the least score such that predictions from it on are right in the share ``precision``."""

    def probabilities(t: float) -> np.ndarray:
        z = logits / t
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean())
    p = probabilities(temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(score[order][1:] < score[order][:-1], True)  # rows of one score are taken or left together
    good = np.flatnonzero((share >= precision) & last)
    return float(temperature), float(score[order[good[-1]]]) if len(good) else 1.0


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray, float, float]:
    """Fits on at most ``fit_docs`` labelled rows of a language that are not held out, those of the smallest hashed ids."""
    import pyarrow as pa

    rows = docs.where(~held_out(docs["doc_id"]) & docs["lang"].isNotNull() & docs["doc_id"].isNotNull())
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("__text"))
    # a share of each language's rows by hashed id, about 1.2 times what is asked, so that the window over them is small
    sizes = materialise(rows.groupBy("lang").count(), "language-sizes")
    if sizes.count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = rows.join(F.broadcast(sizes), "lang").where(hashed < (fit_docs * 1.2 + 50) / F.col("count") * float(1 << 40)).drop("count")
    keys = near.select("doc_id", "lang", "__text").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "__text")
    keys = keys.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= fit_docs).drop("__n")
    # at most fit_docs narrow rows for each of the languages, so they can be sent to all executors; else texts would be dealt out
    sample = near.join(F.broadcast(keys), ["doc_id", "lang", "__text"], "left_semi").groupBy("doc_id", "lang", "__text").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                key = int.from_bytes(hashlib.blake2b(f"{doc_id} {text}".encode(), digest_size=8).digest(), "little")
                got = examples(text, key)
                size, buckets, times = [len(r) for r, _ in got], np.concatenate([*(r for r, _ in got), np.empty(0, int)]), np.concatenate([*(t for _, t in got), np.empty(0, int)])
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([key & 0x7FFFFFFF], pa.int64()), pa.array([size], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in (buckets.astype("<u2").tobytes(), times.astype("<u4").tobytes())], ["lang", "key", "size", "buckets", "times"])

    made: Sample = []
    got = sample.mapInArrow(run, "lang string, key bigint, size array<bigint>, buckets binary, times binary").toLocalIterator()
    for _, lang, key, size, buckets, times in sorted((r.key, r.lang, r.key, r.size, bytes(r.buckets), bytes(r.times)) for r in got):
        cuts = np.cumsum(size)[:-1]
        parts = zip(np.split(np.frombuffer(buckets, "<u2"), cuts), np.split(np.frombuffer(times, "<u4"), cuts), strict=True) if size else []
        made.append((lang, key % 5 == 0, list(parts)))
    return fit(made)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, float, float], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred, score and accepted, from each whole text."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x languages of the fit
    source = docs.select(*[docs[c] for c in carry], docs["text"].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(carry)]] + ["lang_pred string", "score double", "accepted boolean"])

    def one(text: str | None, names: list[str], shares: np.ndarray, temperature: float) -> tuple[str, float]:
        if not names or not has_letter(text):
            return "und", 0.0
        data, total, n = plain(text), np.zeros(len(names)), 0
        for at, end in _blocks(len(data)):
            for buckets in subwords(np.frombuffer(data[at : end + 3], np.uint8)):
                buckets = buckets[: end - at]
                total += np.bincount(buckets, minlength=BUCKETS) @ shares if len(buckets) > 4 * BUCKETS else shares[buckets].sum(axis=0, dtype=np.float64)
                n += len(buckets)
        z = total / max(n, 1) / temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return names[int(p.argmax())], float(p.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shares, temperature, reject_below = sent.value
        for batch in batches:
            got = [one(t.as_py(), names, shares, temperature) for t in batch.column("__text")]
            made = [pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([g != "und" and s >= reject_below for g, s in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], [*carry, "lang_pred", "score", "accepted"])

    return source.mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "accepted")
