"""Words hashed into a fixed number of weights, and bounded samples of labelled texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Words whose weights a task keeps at hand.
CACHE = 400_000


def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


class Remembered(dict):
    """A bounded cache of a function of strings: it is emptied when it is full."""

    def __init__(self, compute: Callable) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str):
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most about ``rows`` labelled documents, chosen by a hash of their id.

    A document with several labels has the largest; null labels and ids teach nothing. The labels
    are sampled first, so what meets the texts has a bound.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    chosen = sampled(known.where(usable), F.col("_id"), rows)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "text", "label")


class Adam:
    """Steps of bounded size for all weights at once."""

    def __init__(self, weights: np.ndarray, rate: float) -> None:
        self.weights, self.rate = weights, rate
        self.mean, self.square, self.steps = np.zeros_like(weights), np.zeros_like(weights), 0

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient * gradient - self.square)
        size = np.sqrt(self.square / (1 - 0.99**self.steps)) + 1e-8
        self.weights -= self.rate * (self.mean / (1 - 0.9**self.steps)) / size
