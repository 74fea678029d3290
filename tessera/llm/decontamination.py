"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Every word n-gram of the test items is looked up in all documents; the counts say which are rare. Seeds of an item
   are its n-grams seen at most RARE times, and always at least its rarest SEED_SHARE, however common they are: an item
   that thousands of documents copy keeps its seeds.
2. In a second pass a seed found in a document gives a diagonal (document place less item place). Diagonals of an item
   that an alignment of enough score can join are one candidate window, as wide as such an alignment can drift. A window
   whose shared words cannot reach the score is passed over, the others are aligned, and pairs that reach the threshold
   are returned. So every alignment of enough score that holds a seed is found, however long its gaps.

The items are a query set against all documents: they are broadcast in blocks of at most ITEM_WORDS words (some 40 bytes
a word), two passes a block, so documents are never shuffled. Words are runs of ASCII letters and digits and all
non-ASCII characters, A-Z lowered. A pair counts if its score is at least THRESHOLD of the item's own, or its alignment
scores as much as PASSAGE matching words; items of fewer than SHORT words must be matched whole.

Cases: null texts and items have no words and match nothing; very long texts are read whole; items shorter than n words
are one seed; of equal best alignments the first window counts; repeated rows each give their pairs; extra columns are
kept by `decontaminate`; an empty table on either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

N, RARE, SEED_SHARE = 3, 50, 0.75
THRESHOLD, PASSAGE, SHORT = 0.5, 40, 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Item words broadcast at once, and bytes of texts looked through at once.
ITEM_WORDS, BLOCK = 4_000_000, 1 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Items:
    """A block of test items as word ids, with their n-grams: sorted codes, and for each the items and places it has."""

    def __init__(self, items: list[tuple[object, bytes]], n: int):
        self.n, self.names, self.vocabulary, self.words = n, [], {}, []
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int64)
            if len(ids):
                self.names.append(name)
                self.words.append(ids)
        codes = [self.codes(ids)[0] if len(ids) >= n else self.short_code(ids) for ids in self.words]
        of = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes]) if codes else np.empty(0, np.int32)
        codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.grams, first = np.unique(codes[order], return_index=True)
        self.first, self.item, self.place = np.append(first, len(codes)), of[order], place[order]
        self.short = {len(ids) for ids in self.words if len(ids) < n}

    def codes(self, ids: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One number for each run of n words, and whether all of them are known. Numbers may wrap round: equal runs
        have equal ones, and what is found by them is aligned word by word."""
        n = n or self.n
        base = len(self.vocabulary) + 2
        size = max(0, len(ids) - n + 1)
        out, known = np.zeros(size, dtype=np.int64), np.ones(size, dtype=bool)
        for i in range(n):
            part = ids[i : size + i]
            out *= base
            out += part + 1
            known &= part >= 0
        return out, known

    def short_code(self, ids: np.ndarray) -> np.ndarray:
        """The number of a text shorter than n words, which is one gram, filled up."""
        return self.filled(self.codes(ids, len(ids))[0], len(ids))

    def filled(self, codes: np.ndarray, n: int) -> np.ndarray:
        base = len(self.vocabulary) + 2
        for _ in range(self.n - n):
            codes = codes * base + base - 1
        return codes

    def encode(self, text: bytes) -> np.ndarray:
        w = words(text)
        return np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))

    def line_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words in one array, n unknown ones after each text, and where each text begins."""
        parts, gap = [], np.full(self.n, -1)
        for t in texts:
            parts += (self.encode(t), gap)
        ends = np.cumsum([len(x) for x in parts])[1::2] if parts else np.empty(0, np.int64)
        return np.concatenate(parts) if parts else np.empty(0, np.int64), np.r_[0, ends].astype(np.int64)

    def hits(self, ids: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids at which grams (wanted ones) begin, and the grams' numbers."""
        found = []
        for n in sorted({self.n} | self.short):
            codes, known = self.codes(ids, n)
            at = np.flatnonzero(known)
            own = self.filled(codes[at], n)
            i = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
            good = self.grams[i] == own
            if wanted is not None:
                good &= wanted[i]
            found.append((at[good], i[good]))
        return np.concatenate([a for a, _ in found]), np.concatenate([i for _, i in found])


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of b (the item) in a, and the span in a; anti-diagonals at a time."""
    n, m = len(a), len(b)
    before, last, start_before, start_last = (np.zeros(m + 1, dtype=np.int64) for _ in range(4))
    best = (0, 0, 0)
    for d in range(2, n + m + 1):  # cell (i, j) with i + j = d; arrays are indexed by j
        lo, hi = max(1, d - n), min(m, d - 1)
        j = np.arange(lo, hi + 1)
        i = d - j
        diag = before[j - 1] + np.where(a[i - 1] == b[j - 1], MATCH, MISMATCH)
        up, left = last[j] + GAP, last[j - 1] + GAP
        now = np.zeros(m + 1, dtype=np.int64)
        start = np.zeros(m + 1, dtype=np.int64)
        score = np.maximum(np.maximum(diag, 0), np.maximum(up, left))
        origin = np.where(before[j - 1] > 0, start_before[j - 1], i - 1)
        now[j] = score
        start[j] = np.where(score == diag, origin, np.where(score == up, start_last[j], start_last[j - 1]))
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[j[k]]), int(i[k]))
        before, last, start_before, start_last = last, now, start_last, start
    return best


def needed(length: int, threshold: float = THRESHOLD) -> float:
    return MATCH * length if length < SHORT else min(threshold * MATCH * length, MATCH * PASSAGE)


def drift(length: int, threshold: float = THRESHOLD) -> int:
    """How far an alignment that reaches the score can leave its diagonal: all it may lose, in gaps."""
    return max(0, int((MATCH * length - needed(length, threshold)) // -GAP))


def pairs_of(items: Items, wanted: np.ndarray, texts: list[bytes], threshold: float = THRESHOLD) -> list[list[tuple[int, int, int, int]]]:
    """For each text (item number, score, start, end) of each item that it copies; start and end in words."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    ids, starts = items.line_up(texts)
    at, grams = items.hits(ids, wanted)
    if not len(at):
        return out
    many = items.first[grams + 1] - items.first[grams]  # (item, place) pairs of each hit's gram
    entry = np.repeat(items.first[grams], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, item = np.repeat(at, many), items.item[entry].astype(np.int64)
    text = np.searchsorted(starts, at, "right") - 1
    diagonal = at - starts[text] - items.place[entry]
    found = np.unique(np.stack([text, item, diagonal], axis=1), axis=0)
    for own in np.split(found, np.flatnonzero(np.any(np.diff(found[:, :2], axis=0) != 0, axis=1)) + 1):
        t, k, ds = own[0, 0], own[0, 1], own[:, 2]
        words_, best, slack = items.words[k], (0, 0, 0), drift(len(items.words[k]), threshold)
        least, size = needed(len(words_), threshold), starts[t + 1] - items.n - starts[t]
        for group in np.split(ds, np.flatnonzero(np.diff(ds) > slack) + 1):
            lo, hi = max(0, int(group[0]) - slack), min(int(size), int(group[-1]) + len(words_) + slack)
            window = ids[starts[t] + lo : starts[t] + hi]
            if MATCH * min(np.isin(window, words_).sum(), np.isin(words_, window).sum()) < least:
                continue
            score, a, b = align(window, words_)
            if score > best[0]:
                best = (score, lo + a, lo + b)
        if best[0] >= least:
            out[t].append((int(k), *best))
    return out


def item_blocks(benchmark: DataFrame, n: int) -> Iterator[Items]:
    """Items in blocks of bounded words, read one after another."""
    held, size = [], 0
    for r in benchmark.select("item_id", S.text_bytes().alias("bytes")).orderBy("item_id", "bytes").toLocalIterator():
        held.append((r["item_id"], bytes(r["bytes"])))
        size += len(words(held[-1][1]))
        if size >= ITEM_WORDS:
            yield Items(held, n)
            held, size = [], 0
    if held:
        yield Items(held, n)


def rare_seeds(items: Items, seen: np.ndarray, rare: int = RARE, share: float = SEED_SHARE) -> np.ndarray:
    """Which grams are seeds, from their counts over all documents."""
    gram = np.repeat(np.arange(len(items.grams)), np.diff(items.first))
    order = np.argsort(items.item, kind="stable")
    wanted = seen <= rare
    for own in np.split(gram[order], np.flatnonzero(np.diff(items.item[order])) + 1):
        own = np.unique(own)
        wanted[own[seen[own] <= np.quantile(seen[own], share)]] = True
    return wanted


def _counts(docs: DataFrame, held, n_grams: int) -> np.ndarray:
    """Documents that have each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, total = held.value, np.zeros(n_grams, dtype=np.int64)
        for _, texts in S.blocks(batches, 0, BLOCK):
            ids, starts = items.line_up(texts)
            at, grams = items.hits(ids)
            once = np.unique((np.searchsorted(starts, at, "right") - 1) * n_grams + grams)
            total += np.bincount(once % n_grams, minlength=n_grams)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "seen"])

    seen = np.zeros(n_grams, dtype=np.int64)
    counted = docs.select(S.text_bytes().alias("bytes")).mapInArrow(run, "gram long, seen long").groupBy("gram").agg(F.sum("seen").alias("seen"))
    got = counted.toArrow()  # at most one row a gram of the block
    seen[got.column("gram").to_numpy()] = got.column("seen").to_numpy()
    return seen


def _finders(docs: DataFrame, benchmark: DataFrame, n: int):
    sc = S.small_batches(docs).sparkSession.sparkContext
    for items in item_blocks(benchmark, n):
        if len(items.grams):
            held = sc.broadcast(items)
            seeds = rare_seeds(items, _counts(docs, held, len(items.grams)))
            held.destroy()
            yield sc.broadcast((items, seeds))


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (0 to 1 of the item's own), first_word and last_word of every copy of an item."""
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, score double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for held in _finders(docs, benchmark, n):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, wanted = held.value
            for part, texts in S.blocks(batches, 1, BLOCK):
                doc_ids, rows = part.column(0).to_pylist(), []
                for doc_id, found in zip(doc_ids, pairs_of(items, wanted, texts, threshold), strict=True):
                    rows += [(doc_id, items.names[k], score / (MATCH * len(items.words[k])), a, b - 1) for k, score, a, b in found]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "first_word", "last_word"), r, strict=True)) for r in rows])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes")).mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that copy an item; a filter in place, so nothing is shuffled or joined."""
    kept = docs
    for held in _finders(docs, benchmark, n):
        column = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], held=held, column=column) -> Iterator[pa.RecordBatch]:
            items, wanted = held.value
            for part, texts in S.blocks(batches, column, BLOCK):
                yield part.filter(pa.array([not found for found in pairs_of(items, wanted, texts, threshold)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
