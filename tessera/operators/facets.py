"""Facet scores by axis: one-vs-rest F1 of every value, their macro mean, and Cohen's kappa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as X

MISSING = "__missing__"


def labels(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """axis, g and p of every gold facet; a facet the prediction lacks is MISSING."""
    g = gold.select("item_id", F.explode("facets").alias("axis", "g"))
    p = pred.select("item_id", F.explode("facets").alias("axis", "p"))
    return g.join(p, ["item_id", "axis"], "left").select("axis", "g", F.coalesce("p", F.lit(MISSING)).alias("p"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("axis", "g", "p").agg(F.count(F.lit(1)).alias("n"))


def value_f1(conf: DataFrame) -> DataFrame:
    """axis, value, tp, fp, fn, f1; MISSING is no value but costs recall."""
    hit = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)
    rows = conf.select(F.col("axis"), F.col("g").alias("value"), hit.alias("tp"), F.lit(0).alias("fp"), (F.col("n") - hit).alias("fn"))
    rows = rows.unionByName(conf.where("g <> p").select(F.col("axis"), F.col("p").alias("value"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")))
    out = rows.where(F.col("value") != MISSING).groupBy("axis", "value").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return out.withColumn("f1", X.prf_counts(F.col("tp"), F.col("fp"), F.col("fn"))[2])


def kappa(conf: DataFrame) -> DataFrame:
    """axis, n, kappa; with full chance agreement 1 if all agree, else 0."""
    total = conf.groupBy("axis").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("agree"))
    a, b = conf.groupBy("axis", F.col("g").alias("v")).agg(F.sum("n").alias("a")), conf.groupBy("axis", F.col("p").alias("v")).agg(F.sum("n").alias("b"))
    chance = a.join(b, ["axis", "v"]).groupBy("axis").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    t = total.join(chance, "axis", "left").withColumns({"po": X.ratio(F.col("agree"), F.col("n")), "pe": X.ratio(F.coalesce("ab", F.lit(0.0)), F.col("n").cast("double") * F.col("n"))})
    return t.select("axis", "n", F.when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def scores(pairs: DataFrame, axes: DataFrame) -> DataFrame:
    """One row of each axis: status, n, macro_f1, kappa; axes without gold are empty."""
    conf = confusion(pairs)
    macro = value_f1(conf).groupBy("axis").agg(F.avg("f1").alias("macro_f1"))
    out = axes.join(kappa(conf), "axis", "left").join(macro, "axis", "left")
    return out.select("axis", F.when(F.col("n").isNull(), "empty").otherwise("scored").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNotNull(), F.coalesce("macro_f1", F.lit(0.0))).alias("macro_f1"), "kappa")
