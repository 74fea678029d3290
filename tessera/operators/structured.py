"""Structured content scores: slots, documents and steps.

Documents are matched by type in order (the n-th gold document of a type with the n-th predicted one), slots by
normalised name, steps by optimal assignment. Relations: slots (item_id, type, nth, name, value), steps (item_id, type,
nth, order, text), documents (item_id, type, nth).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions import text as T
from tessera.operators.align import matched

FUZZY = 90
KEY = ["item_id", "type", "nth"]


def documents(records: DataFrame) -> DataFrame:
    """KEY, pos, slots and steps of every document, numbered within its item and type."""
    rows = records.select("item_id", F.posexplode("structured").alias("pos", "d")).select("item_id", "pos", F.coalesce("d.schemaOrgType", F.lit("")).alias("type"), "d.slots", "d.steps")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("item_id", "type").orderBy("pos")))


def slots(docs: DataFrame) -> DataFrame:
    rows = docs.select(*KEY, F.posexplode("slots").alias("slot", "s"))
    return rows.select(*KEY, "slot", T.normalize_mention(F.coalesce("s.name", F.lit(""))).alias("name"), T.normalize_mention(F.coalesce("s.value", F.lit("None"))).alias("value"))


def slot_hits(gold: DataFrame, pred: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """Gold slots with `correct`: some predicted slot of that name in the matched document agrees. One may serve many."""
    p = pred.select(*KEY, "name", F.col("value").alias("pred_value"))
    agree = F.when(F.col("value") == F.col("pred_value"), True).otherwise(T.set_ratio("value", "pred_value") >= fuzzy)
    pairs = gold.join(p, [*KEY, "name"]).withColumn("agree", agree)
    hit = pairs.groupBy(*KEY, "slot").agg(F.bool_or("agree").alias("correct"))
    return gold.select(*KEY, "slot").join(hit, [*KEY, "slot"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def field_accuracy(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """correct, total, accuracy and (all slots right, or none) complete, for every document of docs."""
    n = hits.groupBy(*KEY).agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"))
    out = docs.select(*KEY).join(n, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("correct", "total")})
    return out.withColumns({"accuracy": X.ratio(F.col("correct"), F.col("total")), "complete": F.col("correct") == F.col("total")})


def steps(docs: DataFrame) -> DataFrame:
    """KEY, pos, order and text of every step."""
    rows = docs.select(*KEY, F.posexplode("steps").alias("pos", "s"))
    return rows.select(*KEY, "pos", F.coalesce("s.order", F.col("pos")).alias("order"), T.normalize_mention(F.coalesce("s.text", F.lit(""))).alias("text"))


def matched_steps(gold: DataFrame, pred: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """KEY, g and p: orders of matched steps, by the optimal matching of each document's."""
    g = gold.select(*KEY, F.col("pos").alias("g"), F.col("order").alias("g_order"), F.col("text").alias("a"))
    p = pred.select(*KEY, F.col("pos").alias("p"), F.col("order").alias("p_order"), F.col("text").alias("b"))
    equal = F.col("a") == F.col("b")
    ratio = T.set_ratio(F.when(~equal, F.col("a")), F.when(~equal, F.col("b")))
    weight = F.when(equal, 1.0).when(ratio >= fuzzy, F.least(ratio / 100, F.lit(0.999)))
    cell = g.join(p, KEY).select(*KEY, "g", "p", "g_order", "p_order", weight.alias("weight")).where("weight > 0")
    return matched(cell, KEY).select(*KEY, F.col("g_order").cast("int").alias("g"), F.col("p_order").cast("int").alias("p"))


def kendall(pairs: DataFrame, *key: str) -> DataFrame:
    """Tau-b of (g, p) by key, n; 1 with fewer than two pairs or where it is undefined."""
    numbered = pairs.select(*key, "g", "p", F.row_number().over(Window.partitionBy(*key).orderBy("g", "p")).alias("i"))
    a, b = (numbered.select(*key, *[F.col(c).alias(f"{c}{k}") for c in ("g", "p", "i")]) for k in (1, 2))
    two = a.join(b, list(key)).where("i1 < i2")
    sign = F.signum(F.col("g1") - F.col("g2")) * F.signum(F.col("p1") - F.col("p2"))
    t = two.groupBy(*key).agg(F.sum(sign).alias("net"), F.count(F.lit(1)).alias("n0"), F.count_if(F.col("g1") == F.col("g2")).alias("tg"), F.count_if(F.col("p1") == F.col("p2")).alias("tp"))
    tau = F.try_divide(F.col("net"), F.sqrt(((F.col("n0") - F.col("tg")) * (F.col("n0") - F.col("tp"))).cast("double")))
    n = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return n.join(t.select(*key, tau.alias("tau")), list(key), "left").withColumn("tau", F.coalesce("tau", F.lit(1.0)))


def structured_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: pooled field accuracy, share of complete documents, mean step recall and order of matched documents."""
    g, p = documents(gold), documents(pred)
    there = p.select(*KEY).withColumn("matched", F.lit(True))
    per = field_accuracy(g, slot_hits(slots(g), slots(p))).join(there, KEY, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    n_steps = g.select(*KEY, F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps")).where("n_steps > 0")
    tau = kendall(matched_steps(steps(g), steps(p)), *KEY)
    step = n_steps.join(tau, KEY, "left").select(*KEY, X.ratio(F.coalesce("n", F.lit(0)), F.col("n_steps")).alias("recall"), F.coalesce("tau", F.lit(1.0)).alias("tau"))
    rows = per.join(step, KEY, "left").withColumn("has", F.col("matched") & F.col("recall").isNotNull())
    return rows.agg(
        X.ratio(F.sum("correct"), F.sum("total")).alias("field_accuracy"), X.ratio(F.count_if(F.col("complete") & F.col("matched")), F.count(F.lit(1))).alias("document_accuracy"),
        F.coalesce(F.avg(F.when(F.col("has"), F.col("recall"))), F.lit(0.0)).alias("step_recall"), F.coalesce(F.avg(F.when(F.col("has"), F.col("tau"))), F.lit(0.0)).alias("step_order"),
        F.count(F.lit(1)).alias("n_docs"), F.count_if("has").alias("n_step_docs"),
    )
