"""Grounding of mentions: one lookup a distinct mention, in the candidate tables that are available.

No table for a type means that nobody could look: the type is pending and nothing is recorded. A table without
candidates, a selector that declines, or too low a confidence is an answer: NIL, kept with its confidence and cached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

LEAST_CONFIDENCE, CANDIDATES = 0.5, 5


def best_score(candidates: Column) -> Column:
    """Selector: the first candidate of the highest score; its score out of 100 is the confidence."""
    top = F.array_max(F.transform(candidates, lambda c: c["score"]))
    index = F.array_position(F.transform(candidates, lambda c: c["score"]), top) - 1
    return F.when(F.size(candidates) > 0, F.struct(index.cast("int").alias("index"), F.least(F.lit(1.0), top / 100).alias("confidence")))


def first_candidate(candidates: Column) -> Column:
    """Selector of replays: the first candidate, surely; none to abstain."""
    return F.when(F.size(candidates) > 0, F.struct(F.lit(0).alias("index"), F.lit(1.0).alias("confidence")))


def candidate_lists(kb: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(source, name_key, candidates) from rows (source, name_key, rank, id, name, score); rows without id or name go."""
    good = kb.where("id is not null and id <> '' and name is not null and name <> ''")
    lists = good.groupBy("source", "name_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "name", "score"))).alias("all"))
    return lists.select("source", "name_key", F.slice("all", 1, limit).alias("candidates"))


def keyed(mentions: DataFrame) -> DataFrame:
    """mentions (item_id, pos, type, surface) with name_key and key."""
    name = T.normalize_name(F.col("surface"))
    return mentions.withColumn("name_key", name).withColumn("key", T.mention_key(F.col("type"), F.col("name_key")))


def ground(mentions: DataFrame, handles: DataFrame, kb: DataFrame, select: Callable[[Column], Column] = best_score, cache: DataFrame | None = None, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(entities by key, pending (item_id, types)).

    mentions: item_id, type, name_key, key; handles: (type, source, priority), the tables that may be asked; kb:
    candidate_lists. Each key is looked up once; keys in the cache are not looked up.
    """
    first = handles.groupBy("type").agg(F.min_by("source", "priority").alias("source"))
    pending = mentions.join(F.broadcast(first), "type", "left_anti").groupBy("item_id").agg(F.array_sort(F.collect_set("type")).alias("reground_pending"))
    keys = mentions.select("key", "type", "name_key").dropDuplicates(["key"])
    if cache is not None:
        keys = keys.join(cache.select("key"), "key", "left_anti")
    asked = keys.join(F.broadcast(first), "type").join(kb, ["source", "name_key"], "left")
    asked = asked.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<struct<rank:int,id:string,name:string,score:double>>")))
    asked = asked.withColumn("choice", select(F.col("candidates"))).withColumn("picked", F.get("candidates", F.col("choice.index")))
    conf = F.coalesce("choice.confidence", F.lit(0.0))
    yes = F.col("picked").isNotNull() & (conf >= least)
    when = lambda c: F.when(yes, c)
    out = asked.select("key", "type", yes.alias("resolved"), when(F.col("picked.id")).alias("id"), when(F.col("source")).alias("source"), when(F.col("picked.name")).alias("name"), conf.alias("confidence"), F.size("candidates").alias("candidate_count"), when(F.col("choice.index")).alias("selected_index"))
    return (out if cache is None else out.unionByName(cache)), pending
