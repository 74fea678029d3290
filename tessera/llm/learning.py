"""What the two classifiers share: folds, bounded label samples, isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared as S


def in_fold(mod: int, rest: int, column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves `rest`; a null id counts as the empty text."""
    return F.pmod(F.crc32(S.id_text(column).cast("binary")), F.lit(mod)) == rest


def label_sample(labels: DataFrame, label: str, mod: int, rest: int, most: int) -> DataFrame:
    """label_id and y of at most `most` labelled ids out of the held-out fold, the same ones every time.

    Ids with no label or two different ones are left out. The bound makes the sample fit to broadcast.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("y")).where("label_id is not null and y in (0, 1)")
    one = one.where(~in_fold(mod, rest, "label_id")).groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("label_id", "y")
    return one.orderBy(F.xxhash64("label_id", F.lit(1)), "label_id").limit(most)


def labelled(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, y and bytes of the sampled documents; documents are not shuffled."""
    narrow = S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes"))
    return narrow.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", F.col("y").cast("double").alias("y"), "bytes")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, fitted y), y rising; equal x are pooled first."""
    xs, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, weights=y) / weight
    level: list[list[float]] = []
    for i in range(len(xs)):
        level.append([mean[i], weight[i], i, i])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b, a = level.pop(), level.pop()
            level.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    kx = np.array([xs[i] for v in level for i in (v[2], v[3])])
    return kx, np.array([v[0] for v in level for _ in range(2)])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores from 0 to 1; within a flat stretch the raw score still orders, in the third digit."""
    flat = np.interp(raw, *knots) if len(knots[0]) else np.full(len(raw), 0.5)
    return 0.998 * np.clip(flat, 0, 1) + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30)))
