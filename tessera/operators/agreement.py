"""How far annotators, or two ways of extracting, agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as X


def pairwise_f1(marks: DataFrame) -> DataFrame:
    """annotator_a, annotator_b, both, only_a, only_b and f1 of the marks (item_id, annotator, mark) of every two
    annotators, over items that both have. Annotators are few; a mark's annotators are paired within its row."""
    marks = marks.select("item_id", "annotator", "mark").distinct()
    by_item = marks.groupBy("item_id").agg(F.array_sort(F.collect_set("annotator")).alias("all"))
    by_mark = marks.groupBy("item_id", "mark").agg(F.collect_set("annotator").alias("has"))
    rows = by_mark.join(by_item, "item_id")
    two = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = rows.select("has", F.explode(two).alias("t")).select(F.col("t.a").alias("annotator_a"), F.col("t.b").alias("annotator_b"), F.array_contains("has", F.col("t.a")).alias("in_a"), F.array_contains("has", F.col("t.b")).alias("in_b"))
    n = rows.groupBy("annotator_a", "annotator_b").agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("both"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"))
    return n.withColumn("f1", X.ratio(2 * F.col("both"), 2 * F.col("both") + F.col("only_a") + F.col("only_b")))


def krippendorff(values: DataFrame) -> DataFrame:
    """alpha (nominal), pairable units and values of decisions (unit, annotator, value); nulls are missing decisions.

    Observed disagreement is summed within units, expected from the values' totals, so no two units ever meet. Units
    with one decision do not count; alpha is 1 if all values agree.
    """
    cells = values.where("value is not null").groupBy("unit", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    units = cells.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same")).where("m > 1")
    observed = units.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("apart"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("units"))
    totals = cells.join(units.select("unit"), "unit").groupBy("value").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("same"))
    one = observed.crossJoin(totals)
    expected = (F.col("all") * F.col("all") - F.col("same")) / (F.col("all") - 1)
    alpha = F.when(F.col("units") > 0, F.when(expected > 0, 1 - F.col("apart") / expected).otherwise(1.0))
    return one.select(alpha.alias("alpha"), "units", F.coalesce(F.col("all"), F.lit(0.0)).cast("long").alias("n_values"))


def set_comparison(a: Column, b: Column, cost_a: Column, cost_b: Column) -> dict[str, Column]:
    """Two sets of names for one clip: agreement (Jaccard), what the union has beyond each, and a's cost in b's."""
    union = F.size(F.array_union(a, b))
    return {"jaccard": X.jaccard(a, b), "gain_over_a": union - F.size(F.array_distinct(a)), "gain_over_b": union - F.size(F.array_distinct(b)), "cost_ratio": X.ratio(cost_a, cost_b)}
