"""Concept scores in a hierarchy: closure, cycles, precision and recall at k over closures, R-precision, recall at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X


def check_acyclic(edges: DataFrame) -> None:
    """ValueError if the hierarchy (vocabulary-sized) has a cycle, self-loops included; the error shows one."""
    parents: dict[str, list[str]] = {}
    for r in edges.select("child", "parent").distinct().orderBy("child", "parent").toLocalIterator():
        parents.setdefault(r["child"], []).append(r["parent"])
    done: set[str] = set()
    for start in parents:
        path, todo = [], [(start, iter(parents[start]))]
        path.append(start)
        while todo and start not in done:
            node, more = todo[-1]
            up = next((p for p in more if p not in done), None)
            if up is None:
                done.add(node)
                todo.pop()
                path.pop()
            elif up in path:
                raise ValueError(f"cycle in concept hierarchy: {' -> '.join([*path[path.index(up):], up])}")
            else:
                path.append(up)
                todo.append((up, iter(parents.get(up, []))))


def ancestors(edges: DataFrame) -> DataFrame:
    """(id, ancestor), all ancestors of every child, each once; the hierarchy must be acyclic."""
    spark = edges.sparkSession
    edges.select("child", "parent").distinct().createOrReplaceTempView("tessera_edges")
    walk = """WITH RECURSIVE up(id, ancestor) AS (
        SELECT child, parent FROM tessera_edges
        UNION ALL SELECT up.id, e.parent FROM up JOIN tessera_edges e ON e.child = up.ancestor)
        SELECT DISTINCT id, ancestor FROM up"""
    return spark.sql(walk)


def closed(ids: DataFrame, up: DataFrame) -> DataFrame:
    """(item_id, concept) of all concepts of an item and their ancestors, each once; unknown ids stand for themselves."""
    more = ids.join(up, ids["concept_id"] == up["id"]).select("item_id", F.col("ancestor").alias("concept"))
    return ids.select("item_id", F.col("concept_id").alias("concept")).unionByName(more).distinct()


def gold_concepts(gold: DataFrame) -> DataFrame:
    return gold.select("item_id", F.explode("concepts").alias("c")).select("item_id", F.col("c.concept_id").alias("concept_id"))


def ranked(pred: DataFrame) -> DataFrame:
    """item_id, concept_id and rank, by descending score (none counts 0), then input order."""
    rows = pred.select("item_id", F.posexplode("concepts").alias("pos", "c")).select("item_id", "pos", F.col("c.concept_id").alias("concept_id"), F.coalesce("c.score", F.lit(0.0)).alias("score"))
    return rank(rows)


def rank(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).select("item_id", "concept_id", "rank")


def closure_counts(gold: DataFrame, top: DataFrame, up: DataFrame, k: int = 5) -> DataFrame:
    """Per item with gold concepts: sizes of both closures and of their intersection."""
    g, p = closed(gold, up).withColumn("in_gold", F.lit(1)), closed(top.where(F.col("rank") <= k), up).withColumn("in_pred", F.lit(1))
    both = g.join(p, ["item_id", "concept"], "full_outer").groupBy("item_id")
    return both.agg(F.count("in_gold").alias("n_gold"), F.count("in_pred").alias("n_pred"), F.count(F.col("in_gold") + F.col("in_pred")).alias("n_both")).where("n_gold > 0")


def hierarchical_prf(gold: DataFrame, top: DataFrame, up: DataFrame, k: int = 5) -> DataFrame:
    """Micro and macro precision, recall and F1 of closures at k, one row."""
    c = closure_counts(gold, top, up, k)
    p, r = X.ratio(F.col("n_both"), F.col("n_pred")), X.ratio(F.col("n_both"), F.col("n_gold"))
    c = c.withColumns({"p": p, "r": r}).withColumn("f", X.f1(F.col("p"), F.col("r")))
    s = c.agg(*[F.sum(x).alias(x) for x in ("n_both", "n_pred", "n_gold")], *[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"macro_{n}") for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))], F.count(F.lit(1)).alias("n_items"))
    return s.select(p.alias("micro_precision"), r.alias("micro_recall"), X.f1(p, r).alias("micro_f1"), "macro_precision", "macro_recall", "macro_f1", "n_items")


def r_precision(gold: DataFrame, top: DataFrame) -> DataFrame:
    """Mean share of the first R predictions (R: the item's distinct gold concepts) that are gold; repeats count twice."""
    g = gold.distinct().withColumn("r", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    sizes = g.select("item_id", "r").distinct()
    hits = top.join(g, ["item_id", "concept_id"]).where("rank <= r").groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))
    each = sizes.join(hits, "item_id", "left").select(X.ratio(F.coalesce("hits", F.lit(0)), F.col("r")).alias("s"))
    return each.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("r_precision"), F.count(F.lit(1)).alias("n_items"))


def recall_at(gold: DataFrame, top: DataFrame, k: int = 5) -> DataFrame:
    """Mean share of an item's distinct gold concepts among its first k predictions."""
    g = gold.distinct()
    got = top.where(F.col("rank") <= k).select("item_id", "concept_id").distinct().withColumn("hit", F.lit(1))
    each = g.join(got, ["item_id", "concept_id"], "left").groupBy("item_id").agg(X.ratio(F.count("hit"), F.count(F.lit(1))).alias("s"))
    return each.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("recall_at_k"), F.count(F.lit(1)).alias("n_items"))
