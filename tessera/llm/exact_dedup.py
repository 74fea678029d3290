"""Exact dedup over an extendible-hash index in shared files, in DataFrame operations only.

1. One scan hashes every text into narrow index entries (doc_id, h, sha256), written to the shared folder.
2. A directory over the leading bits of h doubles until no bucket holds more than `capacity` distinct hashes. Copies
   share a hash and so load a bucket once; a hot text never splits anything.
3. Hashes met more than once are chains. Their rows' texts are read again and go to the owner of their bucket: one task
   takes the whole key range, goes through its chains, compares texts by their bytes, and decides which row of each
   group stays. What it decides is a page of the index. On the way equal texts fall together within each reading task,
   so a text that holds a third of all rows is one row a task.
4. Every entry looks its hash up: the directory gives the bucket, its page the chain, sha256 the link of the chain that
   is the entry's own. (So groups are made by bytes; that a row belongs to a group is told by h and sha256.)

Cases: null text is the empty text; empty texts are equal to each other and to texts of white space only; very long
texts are hashed and compared whole; rows that repeat a doc_id and text get the same decision; a null doc_id loses every
tie; extra columns are ignored by `assign` and kept by `deduplicate`, whatever their names and types; an empty table
gives an empty result. Beyond 2 ** MAX_DEPTH buckets (5 * 10^10 distinct hashes) buckets grow instead of splitting.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

#: A side of a join is broadcast up to this many rows of at most 150 bytes; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Distinct hashes in a bucket page, and the deepest directory (2 ** MAX_DEPTH slots).
CAPACITY, MAX_DEPTH = 50_000, 20


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", "")


def directory(loads: list[tuple[int, int]], depth: int, capacity: int) -> tuple[int, list[int]]:
    """Global depth g and the bucket of each of the 2**g slots, from (leading `depth` bits, distinct hashes) cells.

    Starts with one bucket; an overfull bucket splits on its next bit, and the directory doubles when the bucket's
    local depth had reached the global one.
    """
    cells = [0] * (1 << depth)
    for prefix, load in loads:
        cells[prefix] += load
    total = [0]
    for load in cells:
        total.append(total[-1] + load)
    g, open_, done = 0, [(0, 0)], []
    while open_:
        prefix, local = open_.pop()
        span = depth - local
        if local < depth and total[(prefix + 1) << span] - total[prefix << span] > capacity:
            g = max(g, local + 1)
            open_ += [(prefix << 1, local + 1), (prefix << 1 | 1, local + 1)]
        else:
            done.append((prefix, local))
    slots = [0] * (1 << g)
    for bucket, (prefix, local) in enumerate(sorted(done, key=lambda x: x[0] << (depth - x[1]))):
        for slot in range(prefix << (g - local), (prefix + 1) << (g - local)):
            slots[slot] = bucket
    return g, slots


def _leading(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - bits) if bits else F.lit(0).cast("long")


def _with_bucket(df: DataFrame, g: int, slots: list[int]) -> DataFrame:
    """df with the bucket of its h. The directory has at most 2 ** MAX_DEPTH slots of 16 bytes, so it is broadcast; it
    is made from its runs of slots, one a bucket."""
    if g == 0:
        return df.withColumn("bucket", F.lit(0))
    runs, at = [], 0
    for _, run in groupby(slots):
        runs.append([at, at + sum(1 for _ in run) - 1])
        at = runs[-1][1] + 1
    listed = F.from_json(F.lit(json.dumps(runs)), "array<array<long>>")
    table = df.sparkSession.range(1).select(F.posexplode(listed).alias("bucket", "run")).select("bucket", F.explode(F.sequence(F.col("run")[0], F.col("run")[1])).alias("slot"))
    return df.withColumn("slot", _leading("h", g)).join(F.broadcast(table), "slot").drop("slot")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def owners(chained: DataFrame, buckets: int) -> DataFrame:
    """Pages (bucket, h, text_sha256, keep_id, group_size) of chained rows (bucket, h, doc_id, n, norm).

    A reading task's copies fall together first; a bucket's chains then meet in one task, by nothing but their bucket,
    and are compared by their bytes there.
    """
    two63, two65 = (F.lit(str(2**k)).cast("decimal(38,0)") for k in (63, 65))
    late = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(two63 - F.col("doc_id").cast("decimal(20,0)")).cast("decimal(38,0)")
    rank = (F.col("n").cast("decimal(12,0)").cast("decimal(38,0)") * two65).cast("decimal(38,0)") + late
    own = chained.withColumn("task", F.spark_partition_id()).groupBy("task", "bucket", "h", "norm").agg(F.max(rank.cast("decimal(38,0)")).alias("rank"), F.count(F.lit(1)).alias("rows"))
    met = own.repartition(buckets, "bucket").groupBy("bucket", "h", "norm").agg(F.max("rank").alias("rank"), F.sum("rows").alias("group_size"))
    late = F.col("rank") % two65
    keep = F.when(late > 0, (two63 - late).cast("long"))
    return met.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), keep.alias("keep_id"), "group_size").sortWithinPartitions("bucket", "h")


def assign(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text); hashed gives a long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.length("text").alias("n"), normalised().alias("norm"))
    entries = S.cut(rows.select("doc_id", hashed(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")), "entries")

    keys = S.cut(entries.groupBy("h").agg(F.count(F.lit(1)).alias("rows")), "keys")
    distinct = S.count_by_partition(keys)
    depth = min(MAX_DEPTH, max(0, distinct // capacity).bit_length() + 3)
    loads = keys.groupBy(_leading("h", depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 ** depth rows
    g, slots = directory([(r["p"], r["n"]) for r in loads], depth, capacity)

    chains = _with_bucket(keys.where("rows > 1").select("h"), g, slots).select(F.col("h").alias("chained"), "bucket")
    chained = rows.select("doc_id", "n", "norm", hashed(F.col("norm")).alias("h")).join(_bounded(chains, distinct), F.col("h") == F.col("chained"))
    pages = S.cut(owners(chained.select("bucket", "h", "doc_id", "n", "norm"), max(slots) + 1), "pages")
    page = pages.select("bucket", "h", "text_sha256", F.col("keep_id").alias("chain_id"), F.col("group_size").alias("chain_size"))
    out = _with_bucket(entries, g, slots).join(_bounded(page, S.count_by_partition(pages)), ["bucket", "h", "text_sha256"], "left")
    S.discard(keys)
    keep = F.when(F.col("chain_size").isNull(), F.col("doc_id")).otherwise(F.col("chain_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("chain_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows that `assign` drops. Rows are known by doc_id and normalised text, so an id's other texts
    stay; of rows that repeat both, the longest text stays, one of them."""
    told = S.cut(assign(docs).select("doc_id", "text_sha256", "kept"), "told")
    drops = told.where("not kept").select(F.col("doc_id").alias("key_id"), F.col("text_sha256").alias("key_sha")).distinct()
    again = S.cut(told.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("key_id"), F.col("text_sha256").alias("key_sha")), "again")
    held = S.as_rows(docs, id=F.col("doc_id").cast("long"), sha=F.sha2(normalised(), 256), order=F.struct(F.length("text"), F.xxhash64("text")))
    by = lambda keys: held["id"].eqNullSafe(keys["key_id"]) & (held["sha"] == keys["key_sha"])
    kept = held.join(drops, by(drops), "left_anti")
    once = kept.join(again, by(again), "left_semi").groupBy("id", "sha").agg(F.max_by("row", "order").alias("row"))
    return kept.join(again, by(again), "left_anti").select("row.*").unionByName(once.select("row.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(S.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": ORACLE}
