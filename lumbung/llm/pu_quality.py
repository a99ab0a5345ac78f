"""A quality classifier from trusted positives and unlabelled text (positive-unlabelled learning).

Good documents are known (label 1), the rest of the web is not labelled. The classifier minimises the non-negative
unbiased risk  prior * E_good[loss(+)] + max(0, E_web[loss(-)] - prior * E_good[loss(-)]);  where the second part of a
mini-batch turns negative, its step goes back up. The prior, the share of good documents on the web, is estimated from
a first classifier of good against web: no score can be rarer on the web than prior times its share among the good, so
the least ratio over upper score ranges bounds it. The model is a small network in numpy over measures of a text's
shape; it sees no label but 1, and neither language, source nor id.

The positives are a bounded sample of the trusted rows. All web rows take part: the network starts from mini-batches over a
sample of them, and is then fitted by full steps, for which each task sums the slopes of its rows' risk; their number, moments
and the tails for the prior are such sums too. Sums are of whole numbers, so that their order does not matter.

A null text counts as empty and, like texts without words, has measures of 0 and a score of its own. Rows repeat as
they come; without positives or web text (empty tables), every score is the prior of 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbung.llm.common import documents, held_out, materialise, text_of

#: Trusted rows of the fit at most, and web rows of its first mini-batches: those with the smallest hashed ids. Steps over all web rows.
FIT_ROWS, FULL_STEPS = 20_000, 12
THRESHOLD = 0.3
HIDDEN = 24

_KIND = np.zeros(256, np.int64)  # 0: other punctuation
for _k, _chars in enumerate((b" \t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:!?"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 7
MEASURES = 8 + 12


def shape(text: bytes) -> np.ndarray:
    """Measures of a whole text: shares of byte kinds, word and line statistics, lengths."""
    out = np.zeros(MEASURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:8] = np.bincount(_KIND, weights=counts, minlength=8) / len(text)
    words = text.split()
    n = len(words)
    if not n:
        return out
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    chars = sum(map(len, words))
    ends = Counter(w[-1] for w in words)
    short = sum(1 for w in words if len(w) <= 3)
    out[8:] = (
        np.log1p(n), chars / n / 10, len(seen) / n, seen.most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(c for c in pairs.values() if c > 1) / n, max(map(len, words)) / 50,
        sum(c for b, c in ends.items() if _KIND[b] in (0, 5)) / n, sum(c for b, c in ends.items() if _KIND[b] == 6) / n, short / n,
    )
    return out


class Network:
    """One hidden layer, fitted with Adam."""

    def __init__(self, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        self.weights = [rng.normal(0, 1 / np.sqrt(MEASURES), (MEASURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        self.steps = 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d[0]

    def gradients(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """The risk's slope in each weight, given its slope in each row's logit."""
        a, b, c, _ = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ a + b)
        back = np.outer(slope, c) * (1 - h * h)
        return [x.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        a, _, c, _ = self.weights
        grads = [grads[0] + 1e-4 * a, grads[1], grads[2] + 1e-4 * c, grads[3]]
        self.steps += 1
        for w, g, (m, v) in zip(self.weights, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def thresholds(good: np.ndarray, least: int = 100) -> np.ndarray:
    """Scores that at least ``least`` good rows reach, some 200 of them, the greatest first."""
    return np.sort(good)[::-1][least - 1 :: max(1, len(good) // 200)]


def class_prior(good: np.ndarray, reached: np.ndarray, n_web: int, at: np.ndarray) -> float:
    """The least ratio of upper tails, web to good, over thresholds ``at``, that ``reached`` of the web rows reach.

    The plain estimate, without a margin for its sampling error: too large a prior would stop the fit before the
    rest of the web is told apart, too small a one costs the good ones little.
    """
    if not len(at) or not n_web:
        return 0.5
    g = (good[None, :] >= at[:, None]).mean(axis=1)
    return float(np.clip((reached / n_web / g).min(), 0.05, 0.95))


#: Of web rows: their number, the sum of their losses as bad ones, and of the slopes of these in each weight.
Sums = tuple[float, float, list[np.ndarray]]


def web_sums(net: Network, x: np.ndarray) -> Sums:
    z = net.logits(x)
    return len(x), float(_soft(z).sum()), net.gradients(x, _sigmoid(z))


def risk(net: Network, good: np.ndarray, web: Sums, prior: float) -> tuple[float, float]:
    """The risk of the good ones, and that of the bad ones as estimated, which may come out negative."""
    z = net.logits(good)
    return prior * float(_soft(-z).mean()), web[1] / web[0] - prior * float(_soft(z).mean())


def risk_gradients(net: Network, good: np.ndarray, web: Sums, prior: float) -> list[np.ndarray]:
    """The way down the risk; where the part of the bad ones is negative, which only comes of overfitting, the way up that part."""
    z, n = net.logits(good), len(good)
    down = -prior * _sigmoid(z) / n
    if risk(net, good, web, prior)[1] >= 0:
        return [g + w / web[0] for g, w in zip(net.gradients(good, down - prior * _sigmoid(-z) / n), web[2], strict=True)]
    return [-g - w / web[0] for g, w in zip(net.gradients(good, down), web[2], strict=True)]


def _batches(rng: np.random.Generator, good: np.ndarray, web: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = max(1, min(200, max(len(good), len(web)) // 128))
    for p, u in zip(np.array_split(rng.permutation(len(good)), n), np.array_split(rng.permutation(len(web)), n), strict=True):
        yield good[p if len(p) else rng.integers(0, len(good), 16)], web[u if len(u) else rng.integers(0, len(web), 16)]


def told_apart(rng: np.random.Generator, good: np.ndarray, web: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Network:
    """A plain classifier of good against web."""
    net = Network(rng, mean, scale)
    for _ in range(10):
        for p, u in _batches(rng, good, web):
            x = np.concatenate([p, u])
            z = net.logits(x)
            slope = np.concatenate([-_sigmoid(-z[: len(p)]) / len(p), _sigmoid(z[len(p) :]) / len(u)])
            net.step(net.gradients(x, slope), 0.01)
    return net


def started(rng: np.random.Generator, good: np.ndarray, web: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, epochs: int = 30) -> Network:
    """The network after mini-batches."""
    net = Network(rng, mean, scale)
    for epoch in range(epochs):
        for p, u in _batches(rng, good, web):
            net.step(risk_gradients(net, p, web_sums(net, u), prior), 0.01 * (1 - epoch / epochs) + 0.0005)
    return net


def _matrix(column) -> np.ndarray:
    """Measures from their bytes."""
    return np.frombuffer(b"".join(x.as_py() for x in column), "<f4").reshape(len(column), MEASURES).astype(float)


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the measures of each whole text, as bytes (``__x``)."""
    import pyarrow as pa

    source = docs.select(*[docs[c] for c in carry], text_of(docs).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(carry)]] + ["__x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shape(t.as_py()).astype("<f4").tobytes() for t in batch.column("__text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(x, pa.binary())], [*carry, "__x"])

    return source.mapInArrow(run, schema)


#: Sums are of multiples of this.
_UNIT = 2.0**-20


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of what ``of`` gives for a matrix of measures: each task sends one vector, and vectors are added up by place."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column("__x")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(np.rint(total / _UNIT).astype(np.int64))], ["i", "v"])

    out = np.zeros(width)
    for i, v in rows.select("__x").mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v * _UNIT
    return out


def _some(rows: DataFrame, most: int, n: int, *tie: str) -> DataFrame:
    """At most ``most`` of ``n`` rows, those of the smallest hashed ids; a share of about 1.2 times that goes into the sort."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (1.2 * most + 200) / max(n, 1) * float(1 << 40)
    return rows.where(share).orderBy(F.xxhash64("doc_id"), "doc_id", *tie).limit(most)


def _sample(rows: DataFrame, most: int, n: int) -> np.ndarray:
    """The measures of at most ``most`` rows on the driver, in an order of their own."""
    got = _some(rows, most, n, "__x").select("__x").collect()
    out = np.frombuffer(b"".join(r[0] for r in got), "<f4").reshape(len(got), MEASURES).astype(float)
    return out[np.lexsort(out.T)] if len(out) else out


def train(measures: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> tuple[Network | None, float]:
    """Fits on rows (doc_id, __x) whose ids are not held out: trusted ones (quality 1) and web text as it comes. Returns the network and the prior."""
    pool = measures.where(~held_out(measures["doc_id"]) & measures["doc_id"].isNotNull())
    trusted = labels.where((labels["quality"] == 1) & ~held_out(labels["doc_id"]) & labels["doc_id"].isNotNull())
    known = trusted.select("doc_id").distinct()
    ids = _some(known, fit_rows, known.count())
    good = _sample(pool.join(F.broadcast(ids), "doc_id", "left_semi"), fit_rows, fit_rows)  # at most fit_rows ids
    sums = _summed(pool, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * MEASURES)
    n = int(sums[0])
    if not len(good) or not n:
        return None, 0.5
    mean, square = sums[1 : 1 + MEASURES] / n, sums[1 + MEASURES :] / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    good = good[rng.permutation(len(good))]
    web, half = _sample(pool, fit_rows, n), len(good) // 2

    # the first classifier learns from half of the rows and is tried on the other half
    odd = F.xxhash64("doc_id").bitwiseAND(F.lit(1)) == 1
    learned = _sample(pool.where(~odd), fit_rows, n // 2)
    if half and len(learned):
        first = told_apart(rng, good[:half], learned, mean, scale)
        at = thresholds(first.logits(good[half:]))
        reached = _summed(pool.where(odd), lambda x: np.append((first.logits(x)[None, :] >= at[:, None]).sum(axis=1), len(x)), len(at) + 1)
        prior = class_prior(first.logits(good[half:]), reached[:-1], int(reached[-1]), at)
    else:
        prior = 0.5

    net = started(rng, good, web, prior, mean, scale)
    sizes = [w.size for w in net.weights]
    for k in range(FULL_STEPS):

        def flat(x: np.ndarray) -> np.ndarray:
            count, loss, grads = web_sums(net, x)
            return np.concatenate([[count, loss], *(g.ravel() for g in grads)])

        total = _summed(pool, flat, 2 + sum(sizes))
        grads = [g.reshape(w.shape) for g, w in zip(np.split(total[2:], np.cumsum(sizes)[:-1]), net.weights, strict=True)]
        net.step(risk_gradients(net, good, (total[0], total[1], grads), prior), 0.002 * (1 - k / FULL_STEPS))
    return net, prior


def score(measures: DataFrame, model: tuple[Network | None, float], threshold: float = THRESHOLD) -> DataFrame:
    """The columns beside __x with score and predicted."""
    import pyarrow as pa

    carry = [c for c in measures.columns if c != "__x"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in measures.schema if f.name != "__x"] + ["score double", "predicted int"])
    net, prior = model  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(batch.num_rows, prior) if net is None else _sigmoid(net.logits(_matrix(batch.column("__x"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*carry, "score", "predicted"])

    return measures.mapInArrow(run, schema)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    measures = materialise(measured(documents(spark, sf_dir)), "quality-measures")
    model = train(measures, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(measures, model).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")
