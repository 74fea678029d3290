"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some word lies within r bits of both. So every distinct
fingerprint emits all words within r bits of it (its ball, 2081 words for r = 2); words that two fingerprints share
join them. Fingerprints that share a word are within 2r bits of each other, so a star to the smallest of them keeps
every link without emitting pairs; each edge of it is verified by counting bits.

Balls travel packed, 8 bytes a word at any size: a word is multiplied by an odd constant (a bijection that spreads it);
its leading bits, 12 at least, are its bucket, and the room they leave holds the number of the mask that made the word.
So a row is a bucket and its words, and a fingerprint is had back as word XOR mask. A group of buckets is one task's
work; it is bounded, as equal words come from at most 2081 distinct fingerprints, and the number of groups follows the
number of fingerprints. ROUNDS passes, each over its own share of the words, bound the disk. Within a group union-find
leaves one edge a fingerprint; components over all groups are found by union-find within tasks of bounded size and, where
there is more than one, by alternating large-star and small-star steps on distributed tables.

Copies collapse into one fingerprint before any of this, so a hot group costs one ball.

Cases: null and wordless texts have fingerprint 0, linked like any other; very long texts are read whole, a block of
texts at a time; repeated rows share a fingerprint; a null doc_id is not a smallest id unless its component has no other
(then component_id is null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

SHINGLE, RADIUS, SEED = 4, 2, 42
#: Bits of a mask's number; passes; bytes to a group of buckets; masks at once; fingerprints to a block, least and most.
MASK_BITS, ROUNDS, GROUP_BYTES, MASKS, BLOCK, MOST_BLOCK = 12, 8, 16 << 20, 128, 2048, 1 << 16
#: Words to a shuffled row that a block aims at, bytes to a task that links, and tasks a pass has at least if it has the groups.
ROW_WORDS, TASK_BYTES, MOST_SPREAD = 64, 32 << 20, 32
#: Edges of 16 bytes that one task turns into stars.
TASK_EDGES = 1_000_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_LANES = np.uint64(0x0101010101010101)
_MASK = np.uint64((1 << MASK_BITS) - 1)


def majority(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of hashes (given by lengths, none 0) the word of the bits set in over half of them."""
    runs = -(-lengths // 255)
    first = np.cumsum(runs) - runs
    step = np.arange(runs.sum()) - np.repeat(first, runs)
    starts = np.repeat(np.cumsum(lengths) - lengths, runs) + 255 * step
    counts = np.empty((len(starts), 64), dtype=np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & _LANES, starts)  # eight byte counters of at most 255
        counts[:, s::8] = lanes.view(np.uint8).reshape(-1, 8)
    set_ = np.add.reduceat(counts, first, axis=0) * 2 > lengths[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of all n-word shingles of the text, repeats included."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not words:
        return np.empty(0, dtype=np.uint64)
    line, xxh = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([xxh(line, seed)], dtype=np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: len(words) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)
    return np.fromiter((xxh(line[a:b], seed) for a, b in spans), np.uint64, len(words) - n + 1)


def fingerprints_of(texts: list[bytes], n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    each = [shingle_hashes(t, n, seed) for t in texts]
    lengths = np.array([len(x) for x in each], dtype=np.int64)
    if some := np.flatnonzero(lengths).tolist():
        out[some] = majority(np.concatenate([each[i] for i in some]), lengths[some])
    return out


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(texts, n, seed).view(np.int64))], names=["doc_id", "fp"])

    return S.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), S.text_bytes().alias("bytes")).mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> np.ndarray:
    """Masks of all words with at most `radius` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], dtype=np.uint64)


def packed_words(prints: np.ndarray, masks: np.ndarray, depth: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends): ball words of buckets lo to hi - 1 in bucket order, and where each of these buckets ends.

    A word is multiplied by an odd constant, a bijection that spreads it; its leading `depth` bits are the bucket, the
    others and the number of its mask are kept. So word and fingerprint can be had back from 8 bytes and the bucket.
    """
    shift, parts, buckets = np.uint64(64 - depth), [], []
    for m in range(0, len(masks), MASKS):  # a few masks at once: what other rounds take goes before it adds up
        own = masks[m : m + MASKS]
        w = (prints[:, None] ^ own[None, :]).ravel()
        w *= np.uint64(_ODD)
        of = w >> shift
        of -= np.uint64(lo)
        at = np.flatnonzero(of < np.uint64(hi - lo))
        buckets.append(of[at].astype(np.uint16 if hi - lo <= 1 << 16 else np.uint32))
        w = w[at]
        w <<= np.uint64(depth)
        w >>= np.uint64(depth - MASK_BITS)
        w |= (at % len(own) + m).astype(np.uint64)
        parts.append(w)
    bucket, words = np.concatenate(buckets), np.concatenate(parts)
    return words[np.argsort(bucket, kind="stable")], np.cumsum(np.bincount(bucket, minlength=hi - lo))


def unpacked(bucket: int, packed: np.ndarray, depth: int) -> np.ndarray:
    """The multiplied ball words."""
    return (packed >> np.uint64(MASK_BITS)) | np.uint64(bucket << (64 - depth))


def _emitter(radius: int, depth: int, lo: int, hi: int, group_bits: int, block: int):
    """Rows (group, bucket, words) of packed balls, of buckets lo to hi - 1 only; a group is a run of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(radius)
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fps), block):
                words, ends = packed_words(fps[at : at + block], masks, depth, lo, hi)
                some = np.flatnonzero(np.diff(ends, prepend=0))
                offsets = np.r_[0, ends[some]].astype(np.int32) * 8
                binary = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
                yield pa.RecordBatch.from_arrays([pa.array((some + lo) >> group_bits), pa.array(some + lo), binary], names=["grp", "bucket", "words"])
        S.give_back()

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges that is not itself the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def collisions(words: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (to the smallest fingerprint) among those that share a ball word; masks has the mask of each word."""
    ordered = np.sort(words)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # a bitmap of 24 of the shared words' bits leaves few of the others; the sorted list then decides
    marks = np.zeros(1 << 24, dtype=bool)
    marks[((shared >> np.uint64(11)) & np.uint64(0xFFFFFF)).astype(np.int64)] = True
    keep = np.concatenate([at + np.flatnonzero(marks[((words[at : at + (1 << 18)] >> np.uint64(11)) & np.uint64(0xFFFFFF)).astype(np.int64)]) for at in range(0, len(words), 1 << 18)])
    group = np.minimum(np.searchsorted(shared, words[keep]), len(shared) - 1)
    exact = shared[group] == words[keep]
    keep, group = keep[exact], group[exact]
    fp = (words[keep] * np.uint64(_INVERSE)) ^ masks[keep]
    order = np.lexsort((fp, group))
    group, fp = group[order], fp[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(fp[first], np.diff(np.r_[first, len(fp)]))
    other = fp != least
    return fp[other], least[other]


def _linker(radius: int, depth: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        masks = ball(radius)
        packed = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
        words = np.concatenate([unpacked(b, p, depth) for b, p in zip(table.column("bucket").to_pylist(), packed, strict=True)])
        a, b = collisions(words, masks[(np.concatenate(packed) & _MASK).astype(np.int64)])
        near = bits_apart(a, b) <= 2 * radius  # always, by construction
        a, b = forest(a[near], b[near]) if len(a) else (a, b)
        del words, packed
        S.give_back()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def plan(n: int, radius: int = RADIUS, rounds: int = ROUNDS) -> tuple[int, int, int]:
    """(depth, group_bits, block) for n fingerprints: 2 ** depth buckets, 2 ** group_bits of them to a task's group, and
    fingerprints to an emitted block, so many that its rows have ROW_WORDS words at least (up to MOST_BLOCK)."""
    words = n * len(ball(radius))
    depth = max(MASK_BITS, (words * 8 // GROUP_BYTES).bit_length())
    groups = max(rounds, -(-words * 8 // GROUP_BYTES))
    group_bits = max(0, depth - (groups - 1).bit_length())
    return depth, group_bits, int(min(MOST_BLOCK, max(BLOCK, ROW_WORDS * 2**depth // len(ball(radius)))))


def links(fps: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) that connect what is linked among the distinct fingerprints fps (fp): within a group one each."""
    spark = fps.sparkSession
    n = S.count_by_partition(fps)
    depth, group_bits, block = plan(n, radius, rounds)
    groups = 1 << (depth - group_bits)
    out, spread = None, fps.select("fp").repartition(-(-n // (16 * block)) or 1)
    for r in range(rounds):
        lo, hi = (groups * k // rounds << group_bits for k in (r, r + 1))
        packed = spread.mapInArrow(_emitter(radius, depth, lo, hi, group_bits, block), "grp long, bucket long, words binary")
        tasks = max(2 * min(MOST_SPREAD, (hi - lo) >> group_bits), n * len(ball(radius)) * 8 // rounds // TASK_BYTES)
        part = S.cut(packed.repartition(tasks, "grp").groupBy("grp").applyInArrow(_linker(radius, depth), "a long, b long"), "links")
        out = part if out is None else out.unionByName(part)
        S.free_shuffles(spark)
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the task's edges, in stars."""
    got = [b for b in batches if b.num_rows]
    if got:
        a, b = forest(*(np.concatenate([np.asarray(x.column(i)) for x in got]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(a, root) for every node a of the edges that is not the smallest of its component.

    Union-find first turns the edges of each task (about task_edges of 16 bytes) into stars; where one task holds them
    all, that is the answer. Otherwise large-star (every node's larger neighbours hang on its smallest) and small-star
    (its smaller neighbours do) alternate until nothing changes. Minima aggregate before the shuffle and are written, so
    that both sides of a join are plain tables and a hot node's rows can be split among tasks. Tables of earlier steps
    are deleted as they are replaced.
    """
    old = S.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    tasks = -(-S.count_by_partition(old) // task_edges) or 1
    e = S.cut(old.coalesce(tasks).mapInArrow(_forests, "a long, b long").distinct() if tasks > 1 else old.coalesce(1).mapInArrow(_forests, "a long, b long"), "edges")
    S.discard(old)
    if tasks == 1:
        return e.select("a", F.col("b").alias("root"))
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if not mark[0] or tuple(mark) == seen:
            return e.select("a", F.col("b").alias("root"))
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = S.cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = S.cut(large, "large")
        low = S.cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, S.cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        S.discard(old, least, large, low)


def cluster(prints: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, fp and component_id for every row of prints (doc_id, fp)."""
    nodes = S.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    edges = links(nodes, radius, rounds)
    root = components(edges)
    S.discard(edges)
    rooted = nodes.join(root, nodes["fp"] == root["a"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = S.cut(rooted, "rooted")
    ids = S.cut(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "ids")
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = S.cut(fingerprints(S.table(spark, sf_dir, "documents")), "prints")
    return cluster(prints).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
