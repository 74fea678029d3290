"""Line dedup by distinct-site spread: lines that many sites share are boilerplate.

1. Lines (stripped of white space at both ends; empty ones never count) are hashed to 128 bits, and a HyperLogLog sketch
   of the sites of each hash is built in every map task and merged by aggregation: a hot line is one small row a task.
2. Lines whose estimate is clearly above the threshold are boilerplate, those clearly below are not; lines within BAND
   of it get their sites counted exactly, from distinct (line, site) rows. At these counts a sketch of 128 registers
   counts the registers met, so it cannot overshoot: under 10 sites give 9.4 at most, and the upper bound is certain. It
   falls below 6 for a line of 10 sites or more only if they share five registers, in 2 or 3 of a million such lines.
3. Boilerplate lines leave the documents. A list of up to BROADCAST_LINES hashes is sent to all tasks and documents are
   filtered in place; a longer one is joined with the lines, and the places to drop go back to the documents by key.

Cases: null text is one empty line; a null site counts as a site of its own; very long texts are split whole; bytes that
are not UTF-8 stay as they are; all of a document may go (clean_text is then empty); repeated rows are treated alike;
extra columns of any name are kept, those that clash with the result's replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

#: Distinct sites that make a line boilerplate; relative error of a sketch; width of the exact band, in shares of SITES.
SITES, ERROR, BAND = 10, 0.1, 0.4
BROADCAST_LINES = 1_000_000
_SPACE = " \t\n\v\f\r"


def _hashes(line: Column) -> tuple[Column, Column]:
    """128 bits of a line, in two longs."""
    return F.xxhash64(line).alias("h"), F.xxhash64(F.concat(line, F.lit("+"))).alias("g")


def lines_of(docs: DataFrame) -> DataFrame:
    """site and (h, g), the hash of the stripped line, of every line that is not empty."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    rows = docs.select(site.alias("site"), F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line"))
    return rows.select("site", F.btrim("line", F.lit(_SPACE)).alias("line")).where("line <> ''").select("site", *_hashes(F.col("line")))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g) of every line that at least `sites` distinct sites have."""
    lines = lines_of(docs)
    spread = lines.groupBy("h", "g").agg(F.approx_count_distinct("site", ERROR).alias("about"))
    spread = S.cut(spread.where(F.col("about") >= sites * (1 - BAND)), "spread")
    sure = spread.where(F.col("about") > sites * (1 + BAND)).select("h", "g")
    near = spread.where(F.col("about") <= sites * (1 + BAND)).select("h", "g")
    near = F.broadcast(near) if S.count_by_partition(near) <= BROADCAST_LINES else near
    exact = lines.join(near, ["h", "g"], "left_semi").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("h", "g")
    out = S.cut(sure.unionByName(exact), "boilerplate")
    S.discard(spread)
    return out


def _cleaner(held):
    """Lines whose two hashes are among the held ones go; held.value is an array of (h, g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop, xxh, space = defaultdict(set), xxhash.xxh64_intdigest, _SPACE.encode()
        for h, g in held.value.tolist():
            drop[h].add(g)

        def goes(line: bytes) -> bool:
            own = line.strip(space)
            return bool(own) and (h := xxh(own, 42)) in drop and xxh(own + b"+", 42) in drop[h]

        for part, texts in S.blocks(batches, -1):
            total, gone, clean = [], [], []
            for text in texts:
                lines = text.split(b"\n")
                keep = [x for x in lines if not goes(x)]
                total.append(len(lines))
                gone.append(len(lines) - len(keep))
                clean.append(b"\n".join(keep))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(clean, pa.binary())], names=[*part.schema.names[:-1], "n_lines", "n_removed", "clean_text"])

    return run


def strip_boilerplate(docs: DataFrame, sites: int = SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with n_lines, n_removed and clean_text; the same rows and columns by either way."""
    lines = boilerplate(docs, sites)
    docs = docs.drop("n_lines", "n_removed", "clean_text")
    clean = F.col("clean_text").cast("string").alias("clean_text")
    if S.count_by_partition(lines) <= broadcast_lines:
        got = lines.toArrow()  # of at most broadcast_lines rows
        held = docs.sparkSession.sparkContext.broadcast(np.stack([got.column(c).to_numpy().view(np.uint64) for c in ("h", "g")], axis=1))
        rows = S.as_rows(S.small_batches(docs), utf8=S.text_bytes())
        return rows.mapInArrow(_cleaner(held), T.StructType([rows.schema["row"], *(T.StructField(c, t) for c, t in (("n_lines", T.LongType()), ("n_removed", T.LongType()), ("clean_text", T.BinaryType())))])).select("row.*", "n_lines", "n_removed", clean)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = {"k": F.xxhash64(text), "k2": F.length(text), "lines": F.split(text, "\n")}
    keyed = docs.select(key["k"].alias("k"), key["k2"].alias("k2"), F.posexplode(key["lines"]).alias("place", "line"))
    hit = keyed.select("k", "k2", "place", *_hashes(F.btrim("line", F.lit(_SPACE)))).join(lines, ["h", "g"], "left_semi")
    drops = hit.groupBy("k", "k2").agg(F.collect_set("place").alias("drops"))
    joined = S.as_rows(docs, **key).join(drops, ["k", "k2"], "left").withColumn("drops", F.coalesce("drops", F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops"), lambda at: F.get("lines", at))
    return joined.select("row.*", F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("clean_text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return strip_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
s AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM l),
b AS (SELECT own FROM s WHERE own <> '' GROUP BY own HAVING count(DISTINCT coalesce('s' || source, 'null')) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(b.own)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE b.own IS NULL), '')) AS clean_sha256
FROM s LEFT JOIN b ON s.own = b.own GROUP BY doc_id
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": ORACLE}
