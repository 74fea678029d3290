"""Which predicted mention stands for which gold mention: optimal one-to-one alignment per item, as one relation.

Every candidate cell is scored once; an item in which no gold and no predicted mention has two candidates needs no
solver, and the rest are solved, all in one pass over items. Alignments of gold and predictions are computed once and shared by all metrics.

Columns of an alignment: item_id, bucket (pair, missed, spurious, non_entity, trap_missed), tier, same_type, and of the
gold and predicted mention type, nil, authority, id and confidence. Item ids present on one side only are kept.
Equal optima: the solver's choice depends on the mentions' order alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions import text as T
from tessera.operators.assign import assign

FUZZY = 90


def last_wins(df: DataFrame, order: Column | None = None) -> DataFrame:
    """One row an item_id; the last in order stays. Without one the rows' own content decides, so that reruns agree."""
    rest = [c for c in df.columns if c != "item_id"]
    picked = df.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.to_json(F.struct(*rest)) if order is None else order).alias("r"))
    return picked.select("item_id", *[F.col("r")[c].alias(c) for c in rest])


def known_and_unknown(gold: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions whose item has gold, and the ids of those that have none, ascending."""
    ids = gold.select("item_id").distinct()
    return pred.join(ids, "item_id", "left_semi"), pred.join(ids, "item_id", "left_anti").select("item_id").distinct().orderBy("item_id")


def outer_items(gold: DataFrame, pred: DataFrame, key: str = "item_id") -> DataFrame:
    """All ids of either side, once, with in_gold and in_pred."""
    g, p = gold.select(key).distinct().withColumn("g", F.lit(True)), pred.select(key).distinct().withColumn("p", F.lit(True))
    return g.join(p, key, "full_outer").select(key, F.col("g").isNotNull().alias("in_gold"), F.col("p").isNotNull().alias("in_pred"))


def gold_mentions(gold: DataFrame) -> DataFrame:
    m = gold.select("item_id", F.posexplode("mentions").alias("g", "m"))
    nil_free = F.coalesce(F.col("m.aliases"), F.array().cast("array<string>"))
    return m.select("item_id", "g", T.gold_forms(F.coalesce("m.surface", F.lit("")), nil_free).alias("forms"), F.col("m.type").alias("gold_type"), F.col("m.nil").alias("gold_nil"), F.col("m.gold_id.authority").alias("gold_authority"), F.col("m.gold_id.id").alias("gold_id"))


def pred_mentions(pred: DataFrame) -> DataFrame:
    p = pred.select("item_id", F.posexplode("mentions").alias("p", "m"))
    g = F.col("m.grounding")
    answered = g.isNotNull() & ~F.coalesce(g["nil"], F.lit(False)) & g["externalId"].isNotNull()
    return p.select("item_id", "p", T.normalize_mention(F.coalesce("m.surface", F.lit(""))).alias("form"), F.col("m.type").alias("pred_type"), g["authority"].alias("pred_authority"), g["externalId"].alias("pred_id"), F.coalesce(answered, F.lit(False)).alias("answered"), F.coalesce(g["grounding_confidence"], F.lit(0.0)).alias("conf"))


def _hopeful(form: Column, forms: Column, fuzzy: float) -> Column:
    """Those of forms that can reach the score with form: texts that share a word, or whose lengths alone allow it (two
    texts of n and m characters without a common word are at most 100 - 100 * |n - m| / (n + m) alike)."""
    words, n = F.split(form, " "), F.length(form)
    apart = lambda x: 100 * F.abs(F.length(x) - n) <= (100 - fuzzy) * (F.length(x) + n)
    return F.filter(forms, lambda x: F.arrays_overlap(F.split(x, " "), words) | apart(x))


def cells(g: DataFrame, p: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """Scored cells above zero within each item. Similarity is worked out for what is not equal and can still reach it."""
    both = g.join(p, "item_id").withColumn("exact", (F.col("form") != "") & F.array_contains("forms", F.col("form")))
    rest = F.when(~F.col("exact"), _hopeful(F.col("form"), F.col("forms"), fuzzy))
    both = both.withColumn("rest", F.when(F.size(rest) > 0, rest))
    ratios = _best_ratio(F.when(F.col("rest").isNotNull(), F.col("form")), F.col("rest"))
    scored = both.withColumn("best", ratios).withColumn("best", F.when(F.col("exact"), 100.0).otherwise(F.col("best")))
    scored = scored.withColumn("score", X.cell_score(F.col("exact"), F.col("best"), fuzzy)).where("score > 0")
    same = F.col("gold_type").eqNullSafe(F.col("pred_type"))
    return scored.select("item_id", "g", "p", "exact", "score", same.alias("same_type"), X.assignment_weight(F.col("score"), F.col("exact"), same).alias("weight"))


@F.pandas_udf(T.T.DoubleType())
def _best_ratio(form: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([0.0 if fs is None else max((T.token_set_ratio(f, x) for x in fs), default=0.0) for f, fs in zip(form, forms, strict=True)])


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    gs, g = np.unique(pdf["g"], return_inverse=True)
    ps, p = np.unique(pdf["p"], return_inverse=True)
    w = np.zeros((len(gs), len(ps)))
    w[g, p] = pdf["weight"]
    chosen = {(int(gs[i]), int(ps[j])) for i, j in assign(w) if w[i, j] > 0}
    return pdf[[k in chosen for k in zip(pdf["g"], pdf["p"], strict=True)]]


def _chosen(pdf: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """Of whole items: cells with no rival are final, other items are solved."""
    rival = pdf.duplicated([*key, "g"], keep=False) | pdf.duplicated([*key, "p"], keep=False)
    item = pdf.groupby(key, sort=False, dropna=False).ngroup()
    busy = item.isin(item[rival].unique())
    return pd.concat([pdf[~busy], *(_solve(own) for _, own in pdf[busy].groupby(item[busy], sort=False))])


def matched(cell: DataFrame, key: Sequence[str] = ("item_id",)) -> DataFrame:
    """Cells (key, g, p, weight, ...) of the optimal matching of each item. The window brings an item's cells together, in
    one task and in a row."""
    key = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the item that may go on in the next batch
        for pdf in batches:
            if len(pdf):
                rows = pd.concat([*held, pdf], ignore_index=True)
                last = (rows[key] == rows[key].iloc[-1]).all(axis=1)
                if not last.all():
                    yield _chosen(rows[~last], key)
                held = [rows[last]]
        if held:
            yield _chosen(held[0], key)

    together = cell.withColumn("cells", F.count(F.lit(1)).over(Window.partitionBy(*key))).drop("cells")
    return together.mapInPandas(run, cell.schema)


def align(gold: DataFrame, pred: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """The alignment of two sets of records, one record an item on each side."""
    g, p = gold_mentions(gold), pred_mentions(pred)
    links = matched(cells(g, p, fuzzy)).select("item_id", "g", "p", F.when(F.col("exact"), "exact").otherwise("fuzzy").alias("tier"), "same_type")
    sided = g.drop("forms").join(links, ["item_id", "g"], "left")
    full = sided.join(p.drop("form"), ["item_id", "p"], "full_outer")
    return with_bucket(full.withColumns({"tier": F.coalesce("tier", F.lit("none")), "same_type": F.coalesce("same_type", F.lit(False)), "answered": F.coalesce("answered", F.lit(False))}))


def with_bucket(df: DataFrame) -> DataFrame:
    """Adds the bucket; a row has gold if g is set and a prediction if p is."""
    trap = F.col("gold_nil").eqNullSafe(F.lit("NON_ENTITY"))
    bucket = F.when(F.col("g").isNull(), "spurious").when(F.col("p").isNull(), F.when(trap, "trap_missed").otherwise("missed")).when(trap, "non_entity").otherwise("pair")
    right = (bucket == "pair") & F.col("answered") & F.col("gold_id").isNotNull() & X.same_id(F.col("gold_authority"), F.col("gold_id"), F.col("pred_authority"), F.col("pred_id"))
    return df.withColumns({"bucket": bucket, "correct": F.coalesce(right, F.lit(False))})


def bare_matches(pairs: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
    """Adds `matched` to rows of (a struct<surface,aliases>, b struct<surface>)."""
    forms, form = T.gold_forms(F.col("a.surface"), F.col("a.aliases")), T.normalize_mention(F.col("b.surface"))
    rows = pairs.withColumns({"forms": forms, "form": form})
    return rows.withColumn("matched", F.array_contains("forms", F.col("form")) | (_best_ratio(F.col("form"), F.col("forms")) >= fuzzy)).drop("forms", "form")
