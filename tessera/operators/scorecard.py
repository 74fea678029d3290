"""The scorecard: five layers, never blended, each skipped if it has no data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import scalars as X
from tessera.operators import align as A
from tessera.operators import bootstrap as B
from tessera.operators import calibration, concepts, extraction, facets, grounding, structured

# Fixed value: why claims are not scored.
CLAIM_NOTE = "faithfulness/coverage require validated judge (Phase 4)"


#: Ids without gold that a card names.
LISTED = 20


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _named(gold: DataFrame, pred: DataFrame, c: float, b: int, seed: int, rng: str) -> dict:
    sizes = lambda df: df.agg(F.coalesce(F.sum(F.size(F.coalesce("mentions", F.array()))), F.lit(0)), F.count_if(F.size(F.coalesce("mentions", F.array())) > 0)).first()
    n_mentions, n_items = sizes(gold)
    if not n_mentions and not sizes(pred)[0]:
        return {"status": "skipped_no_data", "flagship": True, "n_mentions": 0, "n_items": 0}
    al = A.align(gold, pred).cache()
    curve = grounding.risk_coverage(al).cache()
    ans = grounding.answers(al)
    ids = gold.select("item_id").distinct()
    strict = extraction.counts(extraction.categories(al, ("strict",)), "item_id")
    phi = grounding.phi_parts(al, "item_id")
    top, n = grounding.phi_terms(c)
    fill = {k: F.coalesce(k, F.lit(0)) for k in extraction.CATEGORIES}
    f1 = X.prf_muc(*[F.col(k) for k in extraction.CATEGORIES])[2]
    parts = ids.join(phi.select("item_id", top.alias("top"), n.cast("double").alias("den")), "item_id", "left").withColumns({"top": F.coalesce("top", F.lit(0.0)), "den": F.coalesce("den", F.lit(0.0))})
    ci = {
        "strict_micro_f1": _rows(B.cluster_bootstrap(ids.join(strict, "item_id", "left").withColumns(fill), "item_id", extraction.CATEGORIES, f1, b, seed, rng=rng))[0],
        "phi_c": _rows(B.cluster_bootstrap(parts, "item_id", ("top", "den"), X.ratio(F.col("top"), F.col("den")), b, seed, rng=rng))[0],
    }
    return {
        "status": "scored", "flagship": True, "n_mentions": n_mentions, "n_items": n_items,
        "extraction": _rows(extraction.scores(al).orderBy("scheme", "level", "type")),
        "grounding": {
            "disambiguation": _rows(grounding.disambiguation(al)), "inkb": _rows(grounding.inkb(al)), "nil": _rows(grounding.nil(al))[0],
            "phi_c": _rows(grounding.effective_reliability(al, c))[0], "risk_coverage": _rows(grounding.curve_summary(curve))[0] | {"curve": _rows(curve.drop("here", "here_wrong").orderBy(F.desc("threshold")))},
        },
        "calibration": {"brier": calibration.brier(ans).first()["brier"], "smece": next((r["smece"] for r in calibration.smece(ans).collect()), 0.0), "bins": _rows(calibration.bins(ans).orderBy("bin"))},
        "ci": ci,
    }


def build(gold: DataFrame, pred: DataFrame, hierarchy: DataFrame | None = None, axes: DataFrame | None = None, c: float = 10.0, k: int = 5, b: int = 2000, seed: int = 0, rng: str = "pcg64") -> dict:
    """Predictions without gold are dropped first, and counted and named (the first LISTED by id) in the card's meta;
    hierarchy is (child, parent), axes is (axis)."""
    spark = gold.sparkSession
    gold, pred = A.last_wins(gold).cache(), A.last_wins(pred)
    pred, unknown = A.known_and_unknown(gold, pred)
    pred, unknown = pred.cache(), unknown.cache()
    layers: dict = {"named_entity": _named(gold, pred, c, b, seed, rng)}

    with_concepts = gold.where(F.size(F.coalesce("concepts", F.array())) > 0)
    n = with_concepts.count()
    layers["concept"] = {"status": "skipped_no_data", "n_items": 0}
    if n:
        edges = hierarchy if hierarchy is not None else spark.createDataFrame([], "child string, parent string")
        concepts.check_acyclic(edges)
        up, ids, top = concepts.ancestors(edges), concepts.gold_concepts(gold), concepts.ranked(pred)
        layers["concept"] = {"status": "scored", "n_items": n, "hf1_at_k": _rows(concepts.hierarchical_prf(ids, top, up, k))[0], "r_precision": _rows(concepts.r_precision(ids, top))[0]}

    layers["claim"] = {"status": "in_calibration", "note": CLAIM_NOTE}
    n_docs = gold.agg(F.sum(F.size(F.coalesce("structured", F.array())))).first()[0] or 0
    layers["structured"] = {"status": "scored"} | _rows(structured.structured_scores(gold, pred))[0] if n_docs else {"status": "skipped_no_data", "n_docs": 0}

    axes = axes if axes is not None else spark.createDataFrame([(a,) for a in schemas.FACETS], "axis string")
    each = {r["axis"]: r for r in _rows(facets.scores(facets.labels(gold, pred), axes))}
    scored = sum(r["status"] == "scored" for r in each.values())
    layers["facets"] = {"status": "scored" if scored else "skipped_no_data", "n_scored_axes": scored, "per_facet": each}
    return {"layers": layers, "meta": {"schema_version": schemas.CONTRACT_VERSION, "seed": seed, "B": b, "c": c, "k": k, "n_unknown": unknown.count(), "unknown_ids": [r["item_id"] for r in unknown.limit(LISTED).collect()]}}


def table(card: dict) -> list[tuple]:
    """(layer, status, metric, value, lo, hi, n), a row a headline; no row combines layers."""
    ne, co, st, fa = (card["layers"][k] for k in ("named_entity", "concept", "structured", "facets"))
    rows = []
    for name, layer, values in (
        ("named_entity", ne, lambda: [(m, ne["ci"][m]["point"], ne["ci"][m]["lo"], ne["ci"][m]["hi"], ne["n_mentions"]) for m in ("strict_micro_f1", "phi_c")]),
        ("concept", co, lambda: [("macro_hf1_at_k", co["hf1_at_k"]["macro_f1"], None, None, co["n_items"])]),
        ("claim", card["layers"]["claim"], lambda: []),
        ("structured", st, lambda: [("field_accuracy", st["field_accuracy"], None, None, st["n_docs"])]),
        ("facets", fa, lambda: [("scored_axes", float(fa["n_scored_axes"]), None, None, fa["n_scored_axes"])]),
    ):
        rows += [(name, layer["status"], *v) for v in values()] if layer["status"] == "scored" else [(name, layer["status"], None, None, None, None, 0)]
    return rows


def markdown(card: dict) -> str:
    """The headlines as a Markdown table."""
    fmt = lambda x: "–" if x is None else f"{x:.3f}"
    lines = ["| layer | status | metric | value | 95 % CI | n |", "|---|---|---|---|---|---|"]
    for layer, status, metric, value, lo, hi, n in table(card):
        lines.append(f"| {layer} | {status} | {metric or '–'} | {fmt(value)} | {'–' if lo is None else f'[{fmt(lo)}, {fmt(hi)}]'} | {n} |")
    if card["meta"]["n_unknown"]:
        lines.append(f"\n{card['meta']['n_unknown']} predictions have no gold: {', '.join(card['meta']['unknown_ids'])}")
    return "\n".join(lines) + "\n"


def report(card: dict) -> str:
    return json.dumps(card, indent=2, sort_keys=True, default=str)
