"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are standardised over the sample and mapped to FEATURES random cosines, whose products
approximate a Gaussian kernel. Each partition of the labelled sample sums its part of the normal equations; the sums
(one square matrix a partition, at most PARTS) give the ridge weights. A third of the sample, kept out of the fit,
calibrates the scores. Everything else (statistics, scores) runs over all documents in place, without a shuffle.

The fit uses at most MOST_LABELS labelled rows, the same ones every time. Labels, lang, source and doc_id are no inputs.

Cases: null and empty texts have all statistics 0 and are scored like any other; very long texts are read whole; ids with
two different labels are not learnt from; without both labels in the sample the score is 0.5; repeated rows score alike;
extra columns are kept by `keep_good` and ignored by `score`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from . import learning as L

#: Bound of the labelled rows used, random features, partitions of the sample, ridge strength a row, accepting score.
MOST_LABELS, FEATURES, PARTS, RIDGE, ACCEPT, SEED = 60_000, 320, 8, 1e-3, 0.3, 5

# Byte classes whose shares are statistics.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",", b";:", b"!", b"?", b"|", b"#$%&*", b"<>{}[]=/\\", b"\"'()-_@~^`+", bytes(range(128, 256))]
_OF = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _OF[list(_c), _k] = 1
STATISTICS = len(_CLASSES) + 11


def statistics(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), STATISTICS))
    for i, t in enumerate(texts):
        if not t:
            continue
        n = len(t)
        out[i, : len(_CLASSES)] = np.sqrt(np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _OF / n)
        words, lines = t.split(), t.split(b"\n")
        k = len(words)
        if not k:
            continue
        distinct = set(words)
        sizes = np.fromiter(map(len, words), np.int64, k)
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, k - 1)
        out[i, len(_CLASSES) :] = (
            np.log1p(n), np.log1p(k), np.log1p(len(lines)), len(distinct) / k, len(distinct) / np.sqrt(k), pairs,
            sizes.mean(), sizes.std(), np.log1p(sizes.max()), len(set(lines)) / len(lines), np.log1p(k / len(lines)),
        )
    return out


class Model:
    """mean, spread, directions, phases, weights and calibration knots."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        scale = 1 / np.sqrt(2 * len(mean))
        self.directions, self.phases = rng.normal(size=(len(mean), features)) * scale, rng.uniform(0, 2 * np.pi, features)
        self.weights, self.knots = np.zeros(features + 1), (np.empty(0), np.empty(0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.c_[np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(z))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, texts: list[bytes]) -> np.ndarray:
        return L.calibrated(self.raw(statistics(texts)), self.knots)


def _normal_equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.weights)
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            stats = np.array(batch.column(1).to_pylist()).reshape(-1, STATISTICS)
            y = np.asarray(batch.column(0))
            z = model.features(stats)
            a, b, n = a + z.T @ z, b + z.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["n", "a", "b"])

    return run


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in S.blocks(batches, 2):
        stats = pa.array(list(statistics(texts)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), stats], names=["doc_id", "y", "stats"])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, most: int = MOST_LABELS) -> Model:
    sample = L.labelled(docs, L.label_sample(labels, "quality", mod, rest, most))
    rows = S.cut(sample.mapInArrow(_described, "doc_id long, y double, stats array<double>"), "statistics")
    sums = rows.select([F.array(*[f(F.col("stats")[i]) for i in range(STATISTICS)]) for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = (np.array([x if x is not None else 0.0 for x in v]) for v in sums)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    third = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    parts = rows.where(~third).select("y", "stats").repartition(PARTS).mapInArrow(_normal_equations(model), "n long, a binary, b binary").collect()  # PARTS matrices
    size = len(model.weights)
    n = sum(r["n"] for r in parts)
    if not n:
        return model
    a = sum(np.frombuffer(r["a"]).reshape(size, size) for r in parts)
    b = sum(np.frombuffer(r["b"]) for r in parts)
    model.weights = np.linalg.solve(a + RIDGE * n / size * np.eye(size) + 1e-9 * np.eye(size), b)
    held = rows.where(third).select("y", "stats").collect()  # of at most `most` rows
    if len({r["y"] for r in held}) == 2:
        model.knots = L.isotonic(model.raw(np.array([r["stats"] for r in held])), np.array([r["y"] for r in held]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts))], names=["doc_id", "score"])

    return S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """docs without those that the classifier rejects, filtered in place."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, column, 1 << 20):
            yield part.filter(pa.array(model.score(texts) >= accept))

    return S.small_batches(docs).mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, S.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", L.in_fold(5, 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
