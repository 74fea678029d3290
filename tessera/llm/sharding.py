"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, hash of the row), so equal texts lie side by side and a hot text can
still be cut between its documents. A size-weighted sample of keys gives quantile boundaries of many more ranges than
shards; ranges that come out overfull are subdivided by splitters of a denser sample of them alone. Range totals are
then summed in order (one row a range), a window within each range places every record on the line of all bytes, and
the shard is the fortieth of that line in which the record's middle lies: shards differ by about one record.

Law: `bytes`. Ranges that stay overfull are single keys (repeated rows), or all there may be (MOST_RANGES); they cost
time, not evenness. Cases: null text has no bytes (size 16) and crc32 0; a very long text is one record, its shard larger
by at most its size; of equal keys the hash of the whole row decides, and rows that agree in it too may change places;
a null doc_id sorts first; an empty table gives an empty result; extra columns of any name and type are kept by `shard`,
but for `size`, `shard` and `slot`, which it gives itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

SHARDS, LAW, OVERHEAD = 40, "bytes", 16
#: Rows and bytes to a range on average, fewest ranges to a shard, sampled keys to a range, and times its share at which a range is overfull.
RANGE_ROWS, RANGE_BYTES, LEAST_RANGES, SAMPLED, OVERFULL = 200_000, 128 << 20, 4, 64, 2.0
#: No more splitters (16 bytes each) and sampled keys (24 bytes) than these are held at once; beyond, ranges grow.
MOST_RANGES, MOST_SAMPLED = 200_000, 4_000_000


def size_of(column: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(column)), F.lit(0)) + OVERHEAD).cast("long")


def _range_of(h: np.ndarray, d: np.ndarray, split_h: np.ndarray, split_d: np.ndarray) -> np.ndarray:
    """Index of the range of each key (h, d) among ascending splitters: how many splitters are at or below it."""
    lo, hi = np.searchsorted(split_h, h, "left"), np.searchsorted(split_h, h, "right")
    for a, b in {(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b}:
        at = (lo == a) & (hi == b)
        lo[at] = a + np.searchsorted(split_d[a:b], d[at], "right")
    return lo


def _assigner(spark: SparkSession, splitters: list[tuple[int, int]]):
    """Column function (h, d) -> range; the splitters are bounded by MOST_RANGES."""
    held = spark.sparkContext.broadcast((np.array([h for h, _ in splitters], dtype=np.int64), np.array([d for _, d in splitters], dtype=np.int64)))

    @F.pandas_udf("int")
    def assign(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, d in parts:
            yield pd.Series(_range_of(h.to_numpy(np.int64), d.to_numpy(np.int64), *held.value), dtype="int32")

    return assign


def _sample(keys: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, d and weight of the keys drawn with odds min(1, size * rate), ascending; a draw depends on its row alone."""
    odds = F.least(F.col("size") * rate, F.lit(1.0))
    u = F.shiftrightunsigned(F.xxhash64("h", "d", F.lit(7)), 11).cast("double") / float(2**53)
    drawn = keys.where(u < odds).select("h", "d", (F.col("size") / odds).alias("w"))
    got = drawn.toArrow()  # MOST_SAMPLED rows or so
    h, d, w = (got.column(c).to_numpy() for c in ("h", "d", "w"))
    order = np.lexsort((d, h))
    return h[order], d[order], w[order]


def _quantiles(h: np.ndarray, d: np.ndarray, w: np.ndarray, ranges: int) -> set[tuple[int, int]]:
    """At most ranges - 1 distinct splitters at equal weights."""
    if not len(h):
        return set()
    at = np.cumsum(w)
    picks = np.minimum(np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges), len(h) - 1)
    return set(zip(h[picks].tolist(), d[picks].tolist(), strict=True))


def splitters(keys: DataFrame, rows: int, total: int, shards: int) -> list[tuple[int, int]]:
    """Boundaries of ranges; overfull ones are subdivided until none is or its keys cannot be told apart."""
    spark = keys.sparkSession
    ranges = min(MOST_RANGES, max(shards * LEAST_RANGES, -(-rows // RANGE_ROWS), -(-total // RANGE_BYTES)))
    share = total / ranges
    bounds = sorted(_quantiles(*_sample(keys, F.lit(min(ranges * SAMPLED, MOST_SAMPLED) / max(total, 1))), ranges))
    while len(bounds) < MOST_RANGES:
        placed = keys.withColumn("range", _assigner(spark, bounds)("h", "d"))
        over = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("most"), F.min(F.struct("h", "d")).alias("lo"), F.max(F.struct("h", "d")).alias("hi"))
        over = over.where((F.col("bytes") > OVERFULL * share + F.col("most")) & (F.col("lo") != F.col("hi"))).collect()  # at most one row a range
        if not over:
            break
        pieces = {r["range"]: 2 * -(-r["bytes"] // int(share + 1)) for r in over}
        dense = min(4 * SAMPLED / share, MOST_SAMPLED / sum(r["bytes"] for r in over))
        h, d, w = _sample(placed.where(F.col("range").isin(list(pieces))), F.lit(dense))
        of = _range_of(h, d, *(np.array([b[i] for b in bounds], dtype=np.int64) for i in (0, 1)))
        more = set().union(*(_quantiles(h[of == k], d[of == k], w[of == k], n) for k, n in pieces.items()))
        # a range is also cut after its first key and before its last, so every pass gains and a heavy key soon stands alone
        ends = {(r["hi"]["h"], r["hi"]["d"]) for r in over} | {(r["lo"]["h"], r["lo"]["d"] + 1) for r in over if r["lo"]["d"] < 2**63 - 1}
        bounds = sorted(set(bounds) | more | ends)
    return bounds


def _keyed(docs: DataFrame) -> dict[str, Column]:
    return {"h": F.xxhash64(F.coalesce(docs["text"], F.lit(""))), "d": F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)).cast("long")), "size": size_of()}


def _row_hash(columns: list[T.StructField]) -> Column:
    """A hash of all the row; what cannot be hashed itself (maps, variants) is hashed as JSON."""
    plain = [F.col("row")[c.name] for c in columns if "map<" not in c.dataType.simpleString() and "variant" not in c.dataType.simpleString()]
    rest = [F.to_json(F.struct(F.col("row")[c.name])) for c in columns if "map<" in c.dataType.simpleString() or "variant" in c.dataType.simpleString()]
    return F.xxhash64(*plain, *rest)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, shard and slot; slots run from 0 without gaps in every shard."""
    return place(S.as_rows(docs.drop("size", "shard", "slot"), **_keyed(docs)), shards).select("row.*", "size", "shard", "slot")


def place(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """row, size, shard and slot of records (row, h, d, size)."""
    spark = records.sparkSession
    keys = S.cut(records.select("h", "d", "size"), "keys")
    rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    assign = _assigner(spark, splitters(keys, rows, total, shards))
    # one row a range, at most MOST_RANGES
    by = keys.withColumn("range", assign("h", "d")).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by = S.cut(by.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before")), "ranges")
    order = Window.partitionBy("range").orderBy("h", "d", "row_hash")
    placed = records.withColumns({"range": assign("h", "d"), "row_hash": _row_hash(records.schema["row"].dataType.fields)})
    placed = placed.withColumns({"before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"), "rank": F.row_number().over(order) - 1})
    placed = placed.join(F.broadcast(by), "range")
    middle = F.col("bytes_before") + F.col("before") + F.col("size") / 2
    shard_ = F.least(F.lit(shards - 1), F.floor(middle * shards / max(total, 1))).cast("int")
    placed = S.cut(placed.select("row", "size", shard_.alias("shard"), (F.col("rows_before") + F.col("rank")).alias("line")), "placed")
    S.discard(keys, by)
    first = placed.groupBy("shard").agg(F.min("line").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("row", "size", "shard", (F.col("line") - F.col("first")).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    row = F.struct("doc_id", F.crc32(S.text_bytes()).cast("long").alias("text_crc32")).alias("row")
    out = place(S.cut(docs.select(row, *[c.alias(k) for k, c in _keyed(docs).items()]), "narrow"))
    return out.select("row.doc_id", "size", "row.text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
