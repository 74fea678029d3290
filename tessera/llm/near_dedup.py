"""Keeping one document of each group of near copies, with SimHash ball hashing as the candidate search.

Near copies share NEAR of their five-word shingles or more (Jaccard over the sets). A SimHash of shingles moves too far
under a few edits, so the fingerprint here is of distinct words: pairs at a similarity of 0.8 to 0.85 lie within
2 * RADIUS bits in about half of the cases, at 0.9 in nearly all. Bands of shingle minima find the others.

1. One scan makes narrow prints: a 128-bit hash of the words, FINGERPRINTS fingerprints, and HASHES minima over the
   shingles. Texts of equal words collapse into one unit. Bands are hashes of BAND_ROWS further minima each.
2. Ball hashing links fingerprints; units linked by any of them form candidate components.
3. Units of a component that share two minima are a bucket, and so are units anywhere that share a band: a pair at 0.8
   shares one of the bands with 1 - (1 - 0.8^4)^20 = 99.997 %, whatever its length. Within a bucket units are
   compared by the exact Jaccard similarity of their whole shingle sets: all pairs of a small one; of a larger one each
   unit with all others at once, in tasks, until all that are not yet joined have been compared. Nothing below NEAR is
   ever linked, and no two units of a bucket that reach it stay apart.
4. Components of the verified links keep the row of the smallest doc_id. Rows are known by doc_id and a hash of their
   whole text, so a row goes only if its own text is a copy.

Cases: texts without words (null and empty ones too) are copies of each other; texts of under five words have one
shingle, all their words; very long texts are read whole; rows that repeat a doc_id and text are copies, and one of them
stays, whichever; rows of one doc_id with different texts are documents of their own; a null doc_id is the largest, and
rows with it are kept or go like others (of equal doc_ids the smaller text hash stays); extra columns are kept, whatever
their names and types; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from . import simhash as H

SHINGLE, NEAR, FINGERPRINTS, HASHES, RADIUS = 5, 0.8, 1, 8, 2
BANDS, BAND_ROWS = 20, 4
#: Row keys of 16 bytes that are broadcast at most; beyond, the join shuffles.
BROADCAST_KEYS = 500_000
#: Units of a bucket that become pairs of rows (a larger one goes to tasks whole), units to a chunk, rows to a task.
SMALL, CHUNK, TASK_ROWS = 8, 2048, 20_000
_MIX = np.random.default_rng(11).integers(1, 2**63, 2 * (HASHES + BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash derived from h."""
    x = (h ^ (h >> np.uint64(31))) * _MIX[2 * k]
    return (x ^ (x >> np.uint64(29))) * _MIX[2 * k + 1]


def _print_block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two text hashes, fingerprints, minima, bands) of texts; all zero for a text without words."""
    n = len(texts)
    ids, prints, minima = np.zeros((n, 2), dtype=np.uint64), np.zeros((n, FINGERPRINTS), dtype=np.uint64), np.zeros((n, HASHES), dtype=np.uint64)
    bands = np.zeros((n, BANDS), dtype=np.uint64)
    xxh, words_, shingles_, some = xxhash.xxh64_intdigest, [], [], []
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        line, distinct = b" ".join(words), set(words)
        ids[i] = xxh(line, 1), xxh(line, 2)
        words_.append(np.fromiter((xxh(w, 42) for w in distinct), np.uint64, len(distinct)))
        shingles_.append(H.shingle_hashes(line, SHINGLE))
        some.append(i)
    if some:
        w, s = np.concatenate(words_), np.concatenate(shingles_)
        w_sizes, s_sizes = (np.array([len(x) for x in v], dtype=np.int64) for v in (words_, shingles_))
        starts = np.cumsum(s_sizes) - s_sizes
        for k in range(FINGERPRINTS):
            prints[some, k] = H.majority(_mixed(w, k), w_sizes)
        for k in range(HASHES):
            minima[some, k] = np.minimum.reduceat(_mixed(s, k), starts) >> np.uint64(32)
        for k in range(BANDS * BAND_ROWS):
            least = np.minimum.reduceat(_mixed(s, HASHES + k), starts)
            bands[some, k // BAND_ROWS] = _mixed(bands[some, k // BAND_ROWS] ^ least, k % BAND_ROWS)
    return ids[:, 0], ids[:, 1], prints, minima, bands


def _key(docs: DataFrame) -> dict:
    """What a row is known by: id and k, a hash of its whole text."""
    return {"id": docs["doc_id"].cast("long"), "k": F.xxhash64(docs["text"])}


def prints(docs: DataFrame) -> DataFrame:
    """id, k, t1, t2, fps, minima and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in S.blocks(batches, 2, 1 << 20):
            t1, t2, fps, minima, bands = _print_block(texts)
            lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (fps.view(np.int64), minima.view(np.int64), bands.view(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), *lists], names=["id", "k", "t1", "t2", "fps", "minima", "bands"])

    key = _key(S.small_batches(docs))
    rows = docs.select(key["id"].alias("id"), key["k"].alias("k"), S.text_bytes().alias("bytes"))
    return rows.mapInArrow(run, "id long, k long, t1 long, t2 long, fps array<long>, minima array<long>, bands array<long>")


def candidates(units: DataFrame) -> DataFrame:
    """(uid, root) of all units in components of more than one, by any of the fingerprints."""
    edges, made = None, []
    for k in range(FINGERPRINTS):
        own = units.select("uid", F.col("fps")[k].alias("fp"))
        least = S.cut(own.groupBy("fp").agg(F.min("uid").alias("least")), "least")
        same = own.join(least, "fp").where("uid <> least").select(F.col("uid").alias("a"), F.col("least").alias("b"))
        linked = H.links(least, RADIUS)
        made += [least, linked]
        named = linked.join(least.select(F.col("fp").alias("a"), F.col("least").alias("ua")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("ub")), "b")
        both = same.unionByName(named.select(F.col("ua").alias("a"), F.col("ub").alias("b")))
        edges = both if edges is None else edges.unionByName(both)
    tree = H.components(edges)
    S.discard(*made)
    return tree.select(F.col("a").alias("uid"), "root").unionByName(tree.select(F.col("root").alias("uid"), "root").distinct())


def _by_keys(df: DataFrame, keys: DataFrame, how: str, rows: int) -> DataFrame:
    """df (id, k, ...) joined with keys (key_id, key_k, ...), nulls equal."""
    on = df["id"].eqNullSafe(keys["key_id"]) & (df["k"] == keys["key_k"])
    return df.join(F.broadcast(keys) if rows <= BROADCAST_KEYS else keys, on, how)


def _keys(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("id").alias("key_id"), F.col("k").alias("key_k"), *more)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in S.blocks(batches, 1):
        sets = [np.unique((H.shingle_hashes(t, SHINGLE) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["uid", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ([np.frombuffer(v, np.uint32) for v in batch.column(i).to_pylist()] for i in (2, 3))
        can = [min(len(p), len(q)) >= NEAR * max(len(p), len(q)) - 1e-9 for p, q in zip(x, y, strict=True)]
        common = np.array([len(np.intersect1d(p, q, assume_unique=True)) if c else 0 for p, q, c in zip(x, y, can, strict=True)], dtype=float)
        total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]) - common
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(common >= NEAR * total - 1e-9))
    S.give_back()


def buckets(units: DataFrame, members: DataFrame) -> DataFrame:
    """(uid, bucket, n) of the units that have company in a bucket, with the number of units there."""
    own = members.join(units.select("uid", "minima"), "uid")
    own = own.select("uid", F.explode(F.array(*[F.xxhash64("root", F.lit(k), F.col("minima")[k], F.col("minima")[k + 1]) for k in range(0, HASHES, 2)])).alias("bucket"))
    if "bands" in units.columns:
        own = own.unionByName(units.select("uid", F.posexplode("bands").alias("k", "band")).select("uid", F.xxhash64("k", "band").alias("bucket")))
    own = S.cut(own, "buckets")
    return own.join(own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket").select("uid", "bucket", "n")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Labels (a, b) of the pairs (x, y, lx, ly) of units that are near copies by their shingle sets."""
    both = pairs.join(sets.select(F.col("uid").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("uid").alias("y"), F.col("shingles").alias("sy")), "y")
    return both.select("lx", "ly", "sx", "sy").mapInArrow(_similar, "a long, b long")


def _family(key: tuple, table: pa.Table) -> pa.Table:
    """Edges (a, b) that join all units of a block that are near copies, over as many steps as it takes.

    A unit is compared with all others at once. Units of the largest component so far wait; when all others have had
    their turn, every two units of different components have been compared, so no component is left in parts.
    """
    uid = np.asarray(table.column("uid"))
    sets = [np.frombuffer(v.as_buffer(), np.uint32) for v in table.column("shingles")]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    ends = np.cumsum(size)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held, label, done, edges = np.zeros(shingle.max(initial=-1) + 1, dtype=bool), np.arange(len(uid)), np.zeros(len(uid), dtype=bool), []
    while True:
        waits = done | (label == np.bincount(label).argmax())
        if waits.all():
            break
        x = int(waits.argmin())
        own = shingle[ends[x] - size[x] : ends[x]]
        held[own] = True
        upto = np.r_[0, np.cumsum(held[shingle])]
        held[own] = False
        common = upto[ends] - upto[ends - size]
        near = np.flatnonzero((common >= NEAR * (size + size[x] - common) - 1e-9) & (label != label[x]))
        done[x] = True
        met, first = np.unique(label[near], return_index=True)
        edges += [(uid[x], uid[y]) for y in near[first]]
        label[np.isin(label, met)] = label[x]
    S.give_back()
    a, b = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
    return pa.table({"a": a, "b": b})


def blocks(own: DataFrame, most: int = CHUNK) -> DataFrame:
    """own (uid, bucket, n) with the blocks (i, j) that a unit of a bucket is in: buckets are dealt to chunks of about
    `most` units and any two chunks of a bucket are a block, so any two units of it meet in one."""
    chunks = F.ceil(F.col("n") / most).cast("int")
    dealt = own.select("uid", "bucket", chunks.alias("chunks"), F.pmod(F.xxhash64("uid"), chunks).cast("int").alias("chunk"))
    others = dealt.select("uid", "bucket", "chunk", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("chunk")))).alias("other"))
    return others.select("uid", "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def joined(own: DataFrame, sets: DataFrame, small: int = SMALL, most: int = CHUNK) -> DataFrame:
    """(a, root) of the components of near copies that share a bucket of own (uid, bucket, n: the bucket's units).

    Of a bucket of at most `small` units all pairs are compared. A larger one goes to tasks in blocks, where units are
    compared until no two of different components are left that were not.
    """
    few = own.where(F.col("n") <= small).select("bucket", F.col("uid").alias("x"), F.col("uid").alias("lx"))
    pairs = few.join(few.select("bucket", F.col("x").alias("y"), F.col("lx").alias("ly")), "bucket").where("x > y").select("x", "y", "lx", "ly").distinct()
    many = blocks(own.where(F.col("n") > small), most).join(sets, "uid")
    tasks = max(2 * H.MOST_SPREAD, S.count_by_partition(own) // TASK_ROWS)
    large = many.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(_family, "a long, b long")
    edges = S.cut(verified(pairs, sets).unionByName(large), "near")
    tree = S.cut(H.components(edges), "near_tree")
    S.discard(edges)
    return tree


def duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (id, k) of all rows that copy or nearly copy one that is kept, and the keys that repeat."""
    rows = S.cut(prints(docs), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "k")).alias("rep")
    units = rows.groupBy("t1", "t2").agg(first, F.count(F.lit(1)).alias("n"), F.first("fps").alias("fps"), F.first("minima").alias("minima"), F.first("bands").alias("bands"))
    units = S.cut(units.withColumn("uid", F.monotonically_increasing_id()), "units")  # numbers that are written stay as they are
    members = S.cut(candidates(units), "members")

    own = S.cut(buckets(units, members), "own")
    used = S.cut(own.select("uid").distinct().join(units.select("uid", "rep.id", "rep.k"), "uid"), "used")
    key = _key(docs)
    texts = docs.select(key["id"].alias("id"), key["k"].alias("k"), S.text_bytes().alias("bytes"))
    texts = _by_keys(texts, _keys(used, "uid"), "inner", S.count_by_partition(used)).select("uid", "bytes")
    sets = S.cut(texts.mapInArrow(_shingled, "uid long, shingles binary").dropDuplicates(["uid"]), "sets")

    tree = joined(own, sets)
    tree = S.cut(tree.select(F.col("a").alias("uid"), "root").unionByName(tree.select(F.col("root").alias("uid"), "root").distinct()), "tree")
    S.discard(own, used, sets, members)
    groups = units.select("t1", "t2", "uid", "rep", "n").join(tree, "uid", "left").where("n > 1 or root is not null")
    groups = S.cut(groups.select("t1", "t2", "rep", F.coalesce("root", "uid").alias("root")), "groups")
    owner = groups.join(groups.groupBy("root").agg(F.min("rep").alias("keep")), "root").select("t1", "t2", "keep")
    copies = rows.select("id", "k", "t1", "t2").join(owner, ["t1", "t2"])
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("k") == F.col("keep.k"))
    drops = S.cut(copies.where(~stays).select("id", "k").distinct(), "drops")
    again = S.cut(rows.groupBy("id", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "k"), "again")
    S.discard(rows, units, tree, groups)
    return drops, again


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group."""
    drops, again = (_keys(x) for x in duplicates(docs))
    kept = _by_keys(S.as_rows(docs, **_key(docs)), drops, "left_anti", S.count_by_partition(drops))
    if n := S.count_by_partition(again):
        once = _by_keys(kept, again, "left_semi", n).dropDuplicates(["id", "k"])
        kept = _by_keys(kept, again, "left_anti", n).unionByName(once)
    return kept.select("row.*")
