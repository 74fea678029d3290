"""Toxicity: a counterfactual-regularised linear classifier over words and parts of words.

A text is the set of its distinct words; a word's features are itself, its beginnings of 3 to 6 characters and its
4-character pieces, hashed. A text has a feature as often as distinct words of it have, so its score is the sum of its
words' and each word is scored once. Features that occur in at least LEAST labelled texts are ranked by how far their share of
toxic texts departs from the whole, and the best FEATURES, at most two for three labelled texts, are kept. Logistic
weights are fitted with an L2 penalty and with a counterfactual penalty: in every labelled text that names an identity
group, each such term is swapped for the others of its class, and the squared changes of the text's score are added to
the loss. So a group's name carries little of the score, and neutral mentions are not flagged. Scores are calibrated on
texts that four fits, each to three quarters of the sample and its swaps, have not seen; the weights are those of a fifth
fit to all of it. That is the rule at every size.

The fit uses at most MOST_LABELS labelled rows, the same ones every time, and FEATURES features. Labels, lang, source
and doc_id are no inputs. All documents are scored whole, in place, without a shuffle; each worker remembers scores of
words it has met in a table of bounded size.

Cases: null and empty texts have no features and score the intercept; very long texts are read whole; ids with two
different labels are not learnt from; without both labels in the sample the score is 0.5; repeated rows score alike;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from . import learning as L

#: Bound of the labelled rows used, features kept, labelled texts a feature needs, table size, strengths and threshold.
MOST_LABELS, FEATURES, LEAST, REMEMBERED, RIDGE, COUNTERFACTUAL, FLAG = 24_000, 8_000, 3, 200_000, 1e-3, 1.0, 0.3
#: Passes over the sample, texts to a step, length of a step.
EPOCHS, BATCH, RATE = 20, 64, 0.02

# Names of identity groups by class; terms of a class stand in for one another.
IDENTITY_TERMS = {
    "gender": ["woman", "women", "man", "men", "female", "male", "girl", "boy", "transgender", "nonbinary"],
    "religion": ["muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "catholic", "protestant"],
    "origin": ["black", "white", "asian", "african", "american", "european", "mexican", "latino", "arab", "chinese", "indian", "immigrant", "immigrants", "refugee", "refugees"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "homosexual", "heterosexual", "queer"],
    "ability": ["disabled", "deaf", "blind", "autistic"],
    "age": ["old", "young", "elderly", "teenage"],
    "gender-de": ["frau", "frauen", "mann", "männer", "mädchen", "junge", "transgender"],
    "religion-de": ["muslim", "muslime", "christ", "christen", "jude", "juden", "hindu", "buddhist", "atheist", "katholik", "protestant"],
    "origin-de": ["schwarze", "weiße", "asiaten", "afrikaner", "amerikaner", "europäer", "araber", "türken", "ausländer", "flüchtlinge", "einwanderer"],
    "orientation-de": ["schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"],
    "gender-fr": ["femme", "femmes", "homme", "hommes", "fille", "garçon", "transgenre"],
    "religion-fr": ["musulman", "musulmans", "chrétien", "chrétiens", "juif", "juifs", "hindou", "bouddhiste", "athée", "catholique", "protestant"],
    "origin-fr": ["noirs", "blancs", "asiatiques", "africains", "américains", "européens", "arabes", "étrangers", "réfugiés", "immigrés"],
    "orientation-fr": ["gay", "lesbienne", "bisexuel", "hétérosexuel", "homosexuel"],
    "gender-es": ["mujer", "mujeres", "hombre", "hombres", "niña", "niño", "transgénero"],
    "religion-es": ["musulmán", "musulmanes", "cristiano", "cristianos", "judío", "judíos", "hindú", "budista", "ateo", "católico", "protestante"],
    "origin-es": ["negros", "blancos", "asiáticos", "africanos", "americanos", "europeos", "árabes", "extranjeros", "refugiados", "inmigrantes"],
    "orientation-es": ["gay", "lesbiana", "bisexual", "heterosexual", "homosexual"],
}


def others_of(terms: dict[str, list[str]] = IDENTITY_TERMS) -> dict[bytes, list[bytes]]:
    """The terms that may stand in for each term: those of all classes it is in."""
    out: dict[bytes, list[bytes]] = {}
    for own in terms.values():
        for t in own:
            known = out.setdefault(t.encode(), [])
            known += [x.encode() for x in own if x != t and x.encode() not in known]
    return out


_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def distinct_words(text: bytes) -> set[bytes]:
    return set(text.translate(_SPLIT).split())


def features_of(word: bytes) -> list[int]:
    """Hashed features of a word, distinct."""
    w = word.decode("utf-8", "ignore").lower()
    out = {"w" + w} | {"p" + w[:n] for n in range(3, 7) if len(w) > n} | {"c" + w[i : i + 4] for i in range(len(w) - 3)}
    return [zlib.crc32(x.encode()) for x in out]


def counterfactuals(words: set[bytes], others: dict[bytes, list[bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """(term, other term of its class) for every identity term in the text."""
    for w in sorted(words & others.keys()):
        for other in others[w]:
            if other not in words:
                yield w, other


def swap_changes(words: set[bytes], of: Callable[[bytes], list[int]], others: dict[bytes, list[bytes]]) -> list[np.ndarray]:
    """For each counterfactual of the text the features it gains (f + 1) and loses (-f - 1)."""
    if words.isdisjoint(others):
        return []
    changes = ((set(of(a)), set(of(b))) for a, b in counterfactuals(words, others))
    return [np.array(sorted([*(f + 1 for f in new - old), *(-f - 1 for f in old - new)]), dtype=np.int32) for old, new in changes if old != new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label have each feature, summed within the partition."""
    seen = (Counter(), Counter())
    known: dict[bytes, list[int]] = {}
    for part, texts in S.blocks(batches, 2):
        for y, text in zip(part.column(1).to_pylist(), texts, strict=True):
            own: set[int] = set()
            for w in distinct_words(text):
                f = known.get(w)
                if f is None:
                    known = known if len(known) < REMEMBERED else {}
                    f = known[w] = features_of(w)
                own.update(f)
            seen[int(y)].update(own)
            if len(seen[0]) + len(seen[1]) > 2_000_000:
                yield from _counts(seen)
                seen = (Counter(), Counter())
    yield from _counts(seen)


def _counts(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    for y in (0, 1):
        if seen[y]:
            n = pa.array(list(seen[y].values()), pa.int64())
            zero = pa.array(np.zeros(len(n), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen[y]), pa.int64()), n if y else zero, zero if y else n], names=["feature", "toxic", "clean"])


def _encoder(index: dict[int, int], others: dict[bytes, list[bytes]]):
    """Kept features of each sampled text and its counterfactual changes, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}

        def of(w: bytes) -> list[int]:
            nonlocal known
            f = known.get(w)
            if f is None:
                known = known if len(known) < REMEMBERED else {}
                f = known[w] = [index[x] for x in features_of(w) if x in index]
            return f

        for part, texts in S.blocks(batches, 2):
            rows, swaps = [], []
            for text in texts:
                words = distinct_words(text)
                rows.append(np.array(sorted(i for w in words for i in of(w)), dtype=np.uint16).tobytes())  # FEATURES fit
                swaps.append([v.tobytes() for v in swap_changes(words, of, others)])
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(rows, pa.binary()), pa.array(swaps, pa.list_(pa.binary()))], names=["y", "features", "swaps"])

    return run


class _Known(dict):
    """Scores of words met, as they are asked for; forgotten once there are REMEMBERED."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        own = self[word] = math.fsum(self.weights.get(f, 0.0) for f in features_of(word))
        return own


class Model:
    """Weights by hashed feature, intercept and calibration knots; scores words once and texts by their sum."""

    def __init__(self, weights: dict[int, float], intercept: float, knots: tuple[np.ndarray, np.ndarray]):
        self.weights, self.intercept, self.knots = weights, intercept, knots

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Intercept and the scores of the text's distinct words; sums are exact, whatever the words' order."""
        if "known" not in self.__dict__:
            self.known = _Known(self.weights)
        of = self.known.__getitem__
        return np.array([self.intercept + math.fsum(map(of, distinct_words(t))) for t in texts])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def score(self, texts: list[bytes]) -> np.ndarray:
        return L.calibrated(self.raw(texts), self.knots)


class Rows:
    """Feature numbers of texts or signed ones of swaps, each once with how often it occurs, in three flat arrays."""

    def __init__(self, x: list[np.ndarray]):
        each = [np.unique(v, return_counts=True) for v in x]
        self.sizes = np.array([len(v) for v, _ in each], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.column = np.concatenate([v.astype(np.int32) for v, _ in each]) if each else np.empty(0, np.int32)
        self.times = np.concatenate([n.astype(np.float32) for _, n in each]) if each else np.empty(0, np.float32)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row from 0, column, times) of all entries of these rows."""
        n = self.sizes[rows]
        row = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(self.first[rows], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, self.column[at], self.times[at]


def descend(x: list[np.ndarray], y: np.ndarray, swaps: list[np.ndarray], size: int, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient steps with momentum (Adam) on loss + ridge + mean squared counterfactual change.

    EPOCHS passes over texts and swaps in an order that a seed fixes, BATCH texts a step (and as large a share of the
    swaps); the result is the mean of the later half of the steps.
    """
    texts, swapped, rng = Rows(x), Rows(swaps), np.random.default_rng(0)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    parts = -(-len(x) // BATCH)
    total, kept, t = np.zeros(size + 1), 0, 0
    for _ in range(EPOCHS):
        for own, pairs in zip(np.array_split(rng.permutation(len(x)), parts), np.array_split(rng.permutation(len(swaps)), parts), strict=True):
            row, col, times = texts.take(own)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col] * times, minlength=len(own)) + w[-1], -30, 30)))
            error = (p - y[own]) / len(own)
            g = np.append(np.bincount(col, weights=error[row] * times, minlength=size) + ridge * w[:-1], error.sum())
            if len(pairs):
                row, col, times = swapped.take(pairs)
                sign, col = np.sign(col) * times, np.abs(col) - 1
                change = np.bincount(row, weights=sign * w[col], minlength=len(pairs))
                g[:-1] += 2 * counterfactual * np.bincount(col, weights=sign * change[row], minlength=size) / len(pairs)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
            if 2 * t > EPOCHS * parts:
                total, kept = total + w, kept + 1
    w = total / max(kept, 1)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, most: int = MOST_LABELS, terms: dict[str, list[str]] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """The model; terms are the identity terms by class, counterfactual the weight of their penalty (0: none)."""
    sample = S.cut(L.labelled(docs, L.label_sample(labels, "toxic", mod, rest, most)), "sample")
    totals = {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model({}, 0.0, (np.empty(0), np.empty(0)))
    if len(totals) < 2:
        return none
    n1, n = totals[1], totals[0] + totals[1]
    seen = sample.mapInArrow(_counted, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    both = F.col("toxic") + F.col("clean")
    z = F.abs(F.col("toxic") - both * (n1 / n)) / F.sqrt(both * (n1 / n * (1 - n1 / n)) + 1)
    kept = [r["feature"] for r in seen.where(both >= LEAST).orderBy(z.desc(), "feature").limit(min(FEATURES, max(200, 2 * n // 3))).select("feature").collect()]
    index = {f: i for i, f in enumerate(kept)}
    rows = sample.mapInArrow(_encoder(index, others_of(terms)), "y double, features binary, swaps array<binary>").toPandas()  # of at most `most` rows
    rows = rows.sort_values(["y", "features"], kind="stable").reset_index(drop=True)  # the same order in every run
    x = [np.frombuffer(v, np.uint16) for v in rows["features"]]
    y = rows["y"].to_numpy()
    swaps = [[np.frombuffer(v, np.int32) for v in own] for own in rows["swaps"]]

    def fitted(texts: np.ndarray) -> tuple[np.ndarray, float]:
        return descend([x[i] for i in texts], y[texts], [v for i in texts for v in swaps[i]], len(kept), counterfactual=counterfactual)

    fold, raw = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        w, bias = fitted(np.flatnonzero(fold != k))
        unseen = np.flatnonzero(fold == k)
        raw[unseen] = [bias + w[x[i]].sum() for i in unseen]
    w, bias = fitted(np.arange(len(y)))
    S.discard(sample)
    return Model(dict(zip(kept, w.tolist(), strict=True)), bias, L.isotonic(raw, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(texts))], names=["doc_id", "score"])

    return S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes")).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, S.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", L.in_fold(4, 2).alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
