"""Three-class scoring of texts with any forward function (S36, S37, T9, PR24, PR27)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbung.functions.columns import LABELS, PROBABILITIES

LABEL_NAMES = {"negative": "negatif", "negatif": "negatif", "neg": "negatif", "neutral": "netral", "netral": "netral", "neu": "netral", "positive": "positif", "positif": "positif", "pos": "positif"}
SCORES = ", ".join([*(f"{c} double" for c in PROBABILITIES), *(f"logit_{k} double" for k in LABELS), "n_token long", "truncated boolean", "label_argmax string"])


def label_order(id2label: Mapping[int, str]) -> list[int]:
    """Where the model has negatif, netral and positif; other labels are errors."""
    names = {i: LABEL_NAMES.get(re.sub("[^a-z]", "", str(v).lower())) for i, v in id2label.items()}
    if sorted(map(str, names.values())) != sorted(LABELS):
        raise ValueError(f"labels are not the three known ones: {dict(id2label)}")
    return [next(i for i, n in names.items() if n == k) for k in LABELS]


def checked_length(asked: int, capacity: int, override: bool = False) -> int:
    if not 1 <= asked <= capacity:
        raise ValueError(f"length {asked} is not between 1 and {capacity}")
    if asked != 128 and not override:
        raise ValueError("lengths other than 128 need an explicit override")
    return asked


def checked_revision(revision: str) -> str:
    if not re.fullmatch("[0-9a-f]{40}", revision):
        raise ValueError("a revision is 40 lowercase hex digits")
    return revision


def probabilities(logits: np.ndarray) -> np.ndarray:
    """Softmax of rows; values that are not finite or three wide are errors."""
    if logits.ndim != 2 or logits.shape[1] != len(LABELS) or not np.isfinite(logits).all():
        raise ValueError("logits must be finite and three wide")
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score_texts(df: DataFrame, text: str, load: Callable[[], tuple[Callable[[list[str]], list[list[int]]], Callable[[list[list[int]]], np.ndarray]]], id2label: Mapping[int, str], max_length: int = 128, batch_size: int = 16) -> DataFrame:
    """Adds probabilities, logits, token counts and the label to every row; null for blank texts.

    ``load`` makes (tokenizer, forward) once a worker. Rows are sorted by length within an Arrow batch only, so that a
    batch pads little, and come back in their own order.
    """
    new = [c.split()[0] for c in SCORES.split(", ")]
    if clash := set(new) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    order = label_order(id2label)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, forward = load()
        for batch in batches:
            texts = batch[text].fillna("").astype(str).tolist()
            full = [i for i, t in enumerate(texts) if t.strip()]
            ids = dict(zip(full, tokenizer([texts[i] for i in full]), strict=True)) if full else {}
            rows = [(None,) * 6 + (None, None, None)] * len(texts)
            by_length = sorted(full, key=lambda i: len(ids[i]))
            for at in range(0, len(by_length), batch_size):
                some = by_length[at : at + batch_size]
                logits = np.asarray(forward([ids[i][:max_length] for i in some]), float)
                p = probabilities(logits)[:, order]
                for i, a, b in zip(some, p, logits[:, order], strict=True):
                    rows[i] = (*a.tolist(), *b.tolist(), len(ids[i]), len(ids[i]) > max_length, LABELS[int(a.argmax())])
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=new, dtype=object)], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [SCORES])
    return df.mapInPandas(run, schema)


def acceptance(forward_text: Callable[[list[str]], np.ndarray], samples: Mapping[str, str]) -> dict[str, bool]:
    """Checks of a model on labelled sentences: finite, sums of 1, right labels, a batch as good as single texts."""
    texts = list(samples)
    p = probabilities(np.asarray(forward_text(texts), float))
    alone = np.concatenate([probabilities(np.asarray(forward_text([t]), float)) for t in texts])
    return {
        "finite": bool(np.isfinite(p).all()), "sums": bool(np.allclose(p.sum(axis=1), 1, atol=1e-6)), "labels": [LABELS[i] for i in p.argmax(axis=1)] == list(samples.values()), "batch": bool(np.abs(p - alone).max() <= 1e-4),
    }


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, macro and weighted F1 from the confusion counts."""
    counts = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    per = counts.groupBy(F.col(actual).alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    given = counts.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("given"))
    f1 = per.join(given, "k", "full").na.fill(0).withColumn("f1", F.coalesce(2.0 * F.col("hit") / F.nullif(F.col("support") + F.col("given"), F.lit(0)), F.lit(0.0)))
    return f1.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
