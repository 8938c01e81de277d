"""What the two classifiers share: bounded training samples, Adam, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out

ROWS_PER_CLASS = 1500  # the bound of a training sample


def training_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, label, weight, text) of at most `rows` labelled documents a class, none held out.

    Which ones is decided by a hash of the identifier. weight: labelled rows of the class
    for each row of the sample.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).cast("long").alias("doc_id"), F.col(label).alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    parts = []
    for value, n in sizes.items():
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        parts.append(part.withColumn("weight", F.lit(n / min(n, rows))))
    if not parts:
        return docs.limit(0).select(F.col(key).cast("long").alias("doc_id"), F.lit(0).alias("label"), F.lit(1.0).alias("weight"), F.col(text).alias("text"))
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "weight", "text")  # at most 2 * rows rows


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, shift: bool) -> tuple[float, float]:
    """Scale and shift (0 unless asked for) of the logits that minimise the weighted log loss, by Newton steps."""
    a, b = 1.0, 0.0
    w = weight / weight.sum() if len(y) else weight
    for _ in range(50):
        p = sigmoid(a * logits + b)
        r, s = w * (p - y), w * np.maximum(p * (1 - p), 1e-9)
        ga, haa = (r * logits).sum() + 1e-3 * (a - 1), (s * logits * logits).sum() + 1e-3
        if shift:
            gb, hbb, hab = r.sum(), s.sum() + 1e-6, (s * logits).sum()
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        else:
            da, db = ga / haa, 0.0
        a, b = float(np.clip(a - np.clip(da, -1, 1), 0.02, 20)), float(b - np.clip(db, -2, 2))
    return a, b
