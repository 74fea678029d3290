"""Mixing sources to target weights by pivotal dependent rounding.

Every document of source s is to be copied target_s / source_size_s times, between 0 and 2. The whole part is given;
the fractional parts are rounded together: two fractional documents exchange words, in a random direction whose odds
leave both expectations as they are, until one of them is integral. Each exchange leaves the source's taken words
unchanged, so all that a source can miss is the rounding of its very last document.

Documents are dealt to blocks within their source by a hash, so a hot source is many blocks; a block ends with at most
one fractional document, and FAN_IN blocks meet in one task at the next level until a source has one left.
Randomness is a hash of (seed, source, level, block, position), so reruns agree.

Targets are found over one row a source, in one task: a table of sources, which may be millions of web hosts.

Cases: null text and texts of white space only have size 0 and are taken 0 times; very long texts are counted whole;
sources with no words have target 0; null is a source of its own, last in order; repeated rows are documents of their
own, dealt to blocks by a hash of id, size, text and their number among their like; an empty table gives an empty result;
extra columns are ignored by `mix` and kept by `materialise`, whatever their names and types.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared as S

SHARE, CEILING, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), 17
#: Documents to a block at the first level, and blocks that meet in one task at each later level.
BLOCK_ROWS, FAN_IN = 4096, 256
#: Rows of one id and text that are numbered at once.
LIKE = 4096

WORD = r"[^\x20\x09-\x0D]+"


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the words of the whole text) and text_hash."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), text_hash().alias("text_hash"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row a source: source, rows, source_size, target.

    target = min(ceiling * source_size, level * weight), with the level at which all targets sum to share * all sizes:
    in ascending order of ceiling * size / weight, the sources below the level are those that stay full when what is
    left is dealt by weight. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("top", F.col("source_size") * ceiling)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = Window.orderBy(F.col("top") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("wanted", F.sum("source_size").over(everything) * share).withColumn("all_weight", F.sum("weight").over(everything))
    # the level if this source and all before it in order stay at their ceilings
    by = by.withColumn("rest", F.col("all_weight") - F.sum("weight").over(full)).withColumn("left", F.col("wanted") - F.sum("top").over(full))
    by = by.withColumn("level_before", (F.col("left") + F.col("top")) / (F.col("rest") + F.col("weight")))
    capped = F.col("top") <= F.col("level_before") * F.col("weight")
    level = F.max(F.when(~capped, F.col("level_before"))).over(everything)
    return by.select("source", "rows", "source_size", F.when(capped | level.isNull(), F.col("top")).otherwise(F.least(F.col("top"), level * F.col("weight"))).alias("target"))


def _uniform(*key: object) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, key)), SEED) / 2.0**64


def round_block(size: np.ndarray, p: np.ndarray, key: tuple) -> int:
    """Pivotal rounding of the fractional p, in place; the index left fractional, or -1."""
    eps = 1e-9
    held = -1
    for j in range(len(p)):
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = float(size[held]), float(size[j])
        up = min(a * (1 - p[held]), b * p[j])  # words that held can gain from j
        down = min(a * p[held], b * (1 - p[j]))
        move = up if _uniform(*key, j) * (up + down) < down else -down
        p[held] += move / a
        p[j] -= move / b
        for i in (held, j):
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = round(p[i])
        held = held if 0 < p[held] < 1 else j if 0 < p[j] < 1 else -1
    return held


_LEVEL = "doc_id long, source string, text_hash long, size long, source_size long, target double, base int, p double, block long, open boolean"


def _rounder(level: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # from large to small: what is left fractional is then small
        pdf = pdf.sort_values(["size", "doc_id", "text_hash", "block"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        p = pdf["p"].to_numpy(dtype=float).copy()
        name = (level, repr(pdf["source"].iloc[0]), int(key[1]))
        held = round_block(pdf["size"].to_numpy(), p, name)
        if last and held >= 0:
            p[held] = float(_uniform(*name, "last") < p[held])
            held = -1
        pdf["p"], pdf["open"] = p, np.arange(len(pdf)) == held
        pdf["block"] = int(key[1])
        return pdf

    return run


def numbered(sized: DataFrame) -> DataFrame:
    """sized with `number`, from 0 among rows that agree in all their columns. Those stand for one another, so they are
    counted and given out again, LIKE at a time; a row that occurs without end is given out by many tasks."""
    like = S.cut(sized.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("like")), "like")
    parts = like.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("like") - 1) / LIKE))))
    if (like.agg(F.max("like")).first()[0] or 0) > LIKE:
        parts = parts.repartition("doc_id", "text_hash", "part")
    last = F.least(F.col("like"), (F.col("part") + 1) * LIKE) - 1
    return parts.withColumn("number", F.explode(F.sequence(F.col("part") * LIKE, last))).drop("part", "like")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, size, source_size, target, text_hash and copies for every row of docs (doc_id, text, source)."""
    sized = S.cut(with_sizes(docs), "sizes")
    goals = S.cut(targets(sized, weights, share, ceiling), "goals")
    most = goals.agg(F.max("rows")).first()[0] or 0
    blocks = -(-most // block_rows)
    goal = goals.withColumnRenamed("source", "goal_source")
    rows = numbered(sized)
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["goal_source"]), "left")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.when(F.col("size") > 0, F.floor(wish + 1e-12)).otherwise(F.lit(0)).cast("int")
    p = F.when(F.col("size") > 0, F.greatest(wish - base, F.lit(0.0))).otherwise(F.lit(0.0))
    in_source = F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long")
    rows = rows.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", base.alias("base"), p.alias("p"),
        F.pmod(F.xxhash64("doc_id", "size", "text_hash", "number"), in_source).alias("block"), F.lit(True).alias("open"),
    )
    done, level = [rows.where("p <= 0").withColumn("open", F.lit(False))], 0
    rows = rows.where("p > 0")
    while True:
        last = blocks <= 1
        out = S.cut(rows.groupBy("source", "block").applyInPandas(_rounder(level, last), _LEVEL), f"level{level}")
        done.append(out.where("not open"))
        if last:
            break
        rows, level, blocks = out.where("open").withColumn("block", F.floor(F.col("block") / fan_in).cast("long")), level + 1, -(-blocks // fan_in)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.select("doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("base") + F.col("p").cast("int")).cast("int").alias("copies"))


def materialise(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it; rows of size 0 go.

    Rows that repeat id, source and text stand for one another: one of them carries the copies of all.
    """
    total = mix(docs).groupBy(F.col("doc_id").alias("key_id"), F.col("source").alias("key_source"), F.col("text_hash").alias("key_hash"))
    total = total.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    held = S.as_rows(docs, id=F.col("doc_id").cast("long"), source=F.col("source"), hash=text_hash())
    same = held["id"].eqNullSafe(total["key_id"]) & held["source"].eqNullSafe(total["key_source"]) & (held["hash"] == total["key_hash"])
    taken = held.join(total, same)
    once = taken.where("rows = 1").unionByName(taken.where("rows > 1").dropDuplicates(["key_id", "key_source", "key_hash"]))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(S.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
