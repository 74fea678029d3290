"""Five items with scores worked out by hand, and edge cases of the measures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import align, calibration, concepts, extraction, facets, scorecard, structured
from tessera.operators import bootstrap as B
from tessera.sources import records

EVENT = {"schemaOrgType": "Event", "slots": [{"name": "startDate", "value": "2 May"}, {"name": "location", "value": "Old Pier"}], "steps": [{"order": 1, "text": "Collect the tickets"}, {"order": 2, "text": "Walk to gate four"}]}


def named(n, surface, kind, authority=None, ident=None, **more):
    return {"mention_id": n, "surface": surface, "type": kind} | ({"gold_id": {"authority": authority, "id": ident}} if authority else {}) | more


GOLD = [
    {"item_id": "a", "strata": {"has_vtt": True}, "mentions": [named("1", "Blue Lantern", "book", "openlibrary", "ol-11"), named("2", "Café Nora", "place", "google_places", "pl-7", aliases=["Cafe Nora"])],
     "concepts": [{"concept_id": "bouldering"}], "facets": {"topic": "travel", "affect": "awe"}, "structured": [EVENT]},
    {"item_id": "b", "mentions": [named("3", "Night Ferry", "screen_work", "wikidata", "Q101")], "concepts": [{"concept_id": "regatta"}], "facets": {"topic": "home"}},
    {"item_id": "c", "mentions": [named("4", "some nice shop", "place", nil="NON_ENTITY")], "facets": {"topic": "fashion"}},
    {"item_id": "d", "mentions": [named("5", "Unsigned Trio", "music_recording", nil="NIL_NO_ID", failed_queries=["trio"]), named("6", "Ada Quill", "person", "wikidata", "Q202")]},
    {"item_id": "e", "mentions": [named("7", "Pocket Garden", "game", "wikidata", "Q303")], "concepts": [{"concept_id": "climbing"}]},
]


def g(authority, ext, conf, nil=False):
    return {"authority": authority, "externalId": ext, "nil": nil, "grounding_confidence": conf}


def said(surface, kind, *grounding):
    return {"surface": surface, "type": kind} | ({"grounding": g(*grounding)} if grounding else {})


PRED = [
    {"item_id": "a", "mentions": [said("the blue lantern", "book", "openlibrary", "ol-11", 0.9), said("Cafe Nora", "place", "google_places", "pl-8", 0.7)], "concepts": [{"concept_id": "bouldering", "score": 0.6}], "facets": {"topic": "travel", "affect": "sad"},
     "structured": [EVENT | {"slots": [EVENT["slots"][0], {"name": "location", "value": "Harbour Hall"}]}]},
    {"item_id": "b", "mentions": [said("Night Ferry", "screen_work", "wikidata", "q101", 0.85)], "concepts": [{"concept_id": "sailing", "score": 0.7}], "facets": {"topic": "home"}},
    {"item_id": "c", "mentions": [said("some nice shop", "place", "google_places", "pl-9", 0.6)], "facets": {"topic": "tech"}},
    {"item_id": "d", "mentions": [said("Unsigned Trio", "person", "wikidata", None, 0.3, True)]},
    {"item_id": "e", "mentions": [said("Pocket Garden", "game", "wikidata", "Q303", 0.75), said("Extra Thing", "product", "wikidata", "Q9", 0.4)], "concepts": [{"concept_id": "sailing", "score": 0.2}]},
    {"item_id": "elsewhere", "mentions": [said("x", "game")]},
]
EDGES = {"bouldering": ["climbing"], "climbing": ["sport"], "sailing": ["sport"], "regatta": ["sailing"]}


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("gold")
    (tmp / "h.json").write_text(json.dumps({"edges": EDGES}))
    return records.read_gold(spark, lines(tmp / "g.jsonl", GOLD)), records.read_pred(spark, lines(tmp / "p.jsonl", PRED)), records.read_hierarchy(spark, str(tmp / "h.json"))


@pytest.fixture(scope="module")
def card(sides):
    return scorecard.build(*sides)


def test_named_entities(card):
    """Right: lantern, ferry, garden. Wrong: nora, shop (a trap), extra. The trio is a rightly found nil of another type."""
    ne = card["layers"]["named_entity"]
    strict = next(r for r in ne["extraction"] if r["scheme"] == "strict" and r["level"] == "micro")
    assert [strict[c] for c in extraction.CATEGORIES] == [4, 1, 0, 1, 2] and strict["f1"] == pytest.approx(8 / 13)
    assert ne["grounding"]["phi_c"]["phi"] == pytest.approx((3 - 10 * 3) / 6)
    assert ne["calibration"]["brier"] == pytest.approx((0.1**2 + 0.7**2 + 0.15**2 + 0.6**2 + 0.25**2 + 0.4**2) / 6)
    risk = [0, 0, 0, 1 / 4, 2 / 5, 3 / 6]  # by confidence: .9 .85 .75 right, .7 .6 .4 wrong
    curve = ne["grounding"]["risk_coverage"]
    assert curve["aurc"] == pytest.approx(sum((x + y) / 2 / 6 for x, y in zip(risk, risk[1:], strict=False))) and curve["coverage_at_risk"] == pytest.approx(0.5)
    assert [r["risk"] for r in curve["curve"]] == pytest.approx(risk)
    micro, macro = (next(r for r in ne["grounding"]["inkb"] if r["level"] == lv) for lv in ("micro", "macro"))
    assert (micro["tp"], micro["fp"], micro["fn"]) == (3, 3, 2) and micro["f1"] == pytest.approx(6 / 11) and macro["f1"] == pytest.approx(3 / 9)
    assert next(r for r in ne["grounding"]["disambiguation"] if r["authority"] is None)["accuracy"] == pytest.approx(3 / 4)
    assert ne["grounding"]["nil"]["nil_f1"] == 1
    # COR, INC, MIS, SPU of items a to e; the interval by numpy alone
    parts = np.array([[2, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 1, 1, 0], [1, 0, 0, 1]], dtype=float)
    cor, inc, mis, spu = parts[np.random.default_rng(0).integers(0, 5, (2000, 5))].sum(axis=1).T
    p, r = (np.divide(cor, d, out=np.zeros_like(cor), where=d > 0) for d in (cor + inc + spu, cor + inc + mis))
    f1 = np.divide(2 * p * r, p + r, out=np.zeros_like(p), where=p + r > 0)
    ci = ne["ci"]["strict_micro_f1"]
    assert (ci["point"], ci["lo"], ci["hi"]) == pytest.approx((8 / 13, *np.quantile(f1, (0.025, 0.975))))


def test_other_layers(card):
    layers = card["layers"]
    assert layers["concept"]["hf1_at_k"]["macro_f1"] == pytest.approx((1 + 0.8 + 0.5) / 3)
    assert layers["structured"]["field_accuracy"] == 0.5 and layers["structured"]["n_step_docs"] == 1
    assert layers["facets"]["n_scored_axes"] == 2 and layers["claim"]["status"] == "in_calibration"


def test_running_sums_go_on_over_ranges(spark):
    df = spark.range(5000).selectExpr("id * 7919 % 5003 as k", "id % 11 as x").repartition(7)
    from tessera.operators.ranges import running

    rows = sorted((r["k"], r["x"], r["row_no"], r["upto_x"]) for r in running(df, F.col("k"), ("x",)).collect())
    total = 0
    for i, (_, x, row, upto) in enumerate(rows):
        total += x
        assert (row, upto) == (i, total)


def test_hashed_draws_agree_broadcast_or_joined(spark, monkeypatch):
    parts = spark.createDataFrame([(str(i), float(i % 7), 1.0) for i in range(300)], "k string, x double, m double")
    args = (parts, "k", ("x", "m"), F.col("x") / F.col("m"))
    one = B.cluster_bootstrap(*args, b=200).first()
    monkeypatch.setattr(B, "BROADCAST_CLUSTERS", 0)
    assert B.cluster_bootstrap(*args, b=200).first() == one
    monkeypatch.setattr(B, "MOST_STREAMED", 100)
    with pytest.raises(ValueError, match="hash"):
        B.cluster_bootstrap(*args, b=5, rng="pcg64")


def test_no_blended_number(card):
    assert set(card) == {"layers", "meta"} and "0.615" in scorecard.markdown(card)
    assert len({r[0] for r in scorecard.table(card)}) == 5
    assert card["meta"]["n_unknown"] == 1 and "1 predictions have no gold: elsewhere" in scorecard.markdown(card)


def test_gates_name_the_line(spark, tmp_path):
    both = [GOLD[0], GOLD[1] | {"mentions": [GOLD[1]["mentions"][0] | {"nil": "NIL_NO_ID"}]}]
    with pytest.raises(records.GateError, match="gold line 2: .*exactly one of gold_id and nil"):
        records.read_gold(spark, lines(tmp_path / "a.jsonl", both))
    with pytest.raises(records.GateError, match="line 3: item_id 'a' is also on line 1"):
        records.read_gold(spark, lines(tmp_path / "b.jsonl", [GOLD[0], GOLD[1], GOLD[0]]))
    with pytest.raises(records.GateError, match="facet vocabulary"):
        records.read_pred(spark, lines(tmp_path / "c.jsonl", [PRED[0] | {"facets": {"topic": "nowhere"}}]))
    (tmp_path / "d.jsonl").write_text('{"item_id": "x"}\nnot json\n')
    with pytest.raises(records.GateError, match="line 2: not JSON"):
        records.read_gold(spark, str(tmp_path / "d.jsonl"))
    with pytest.raises(records.GateError, match="externalId"):
        records.read_pred(spark, lines(tmp_path / "e.jsonl", [{"item_id": "x", "mentions": [{"surface": "s", "type": "game", "grounding": g("wikidata", None, 0.5)}]}]))


def test_matcher_pairs(spark):
    pairs = [(["Tom's Diner", []], "toms diner", True), (["Green Market Hall", []], "market hall green", True), (["Lhasa", ["Lhasa de Sela"]], "Lhasa de Sela", True), (["LA", []], "City of Angels", True), (["Vertigo", []], "Vertigo Part Three", False), (["North Park", []], "Mill Road", False)]
    df = spark.createDataFrame([((a[0], a[1]), (b,), h) for a, b, h in pairs], "a struct<surface:string,aliases:array<string>>, b struct<surface:string>, human_match boolean")
    r = extraction.matcher_quality(align.bare_matches(df)).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 1, 1, 1)


def test_alignment_prefers_types_and_is_one_to_one(spark):
    m = lambda s, t: {"surface": s, "type": t}
    gold = spark.createDataFrame([("x", [m("Dune", "book"), m("Dune", "screen_work")])], "item_id string, mentions array<struct<surface:string,type:string>>")
    gold = gold.select("item_id", F.transform("mentions", lambda x: F.struct(x["surface"].alias("surface"), F.array().cast("array<string>").alias("aliases"), x["type"].alias("type"), F.lit(None).cast("string").alias("nil"), F.lit(None).cast("struct<authority:string,id:string>").alias("gold_id"))).alias("mentions"))
    pred = spark.createDataFrame([("x", [("Dune", "screen_work", None)]), ("y", [("Z", "game", None)])], "item_id string, mentions array<struct<surface:string,type:string,grounding:struct<authority:string,externalId:string,nil:boolean,grounding_confidence:double>>>")
    rows = {(r["gold_type"], r["pred_type"]): r["bucket"] for r in align.align(gold, pred).collect()}
    assert rows == {("screen_work", "screen_work"): "pair", ("book", None): "missed", (None, "game"): "spurious"}


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        concepts.check_acyclic(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))
    with pytest.raises(ValueError, match="a -> a"):
        concepts.check_acyclic(spark.createDataFrame([("a", "a")], "child string, parent string"))


def test_duplicate_predictions_count_twice_in_r_precision(spark):
    gold = spark.createDataFrame([("i", "a"), ("i", "b")], "item_id string, concept_id string")
    pred = spark.createDataFrame([("i", 0, "a", 0.9), ("i", 1, "a", 0.8)], "item_id string, pos int, concept_id string, score double")
    assert concepts.r_precision(gold, concepts.rank(pred)).first()["r_precision"] == 1.0


def test_kappa_edges(spark):
    conf = lambda rows: facets.kappa(facets.confusion(spark.createDataFrame(rows, "axis string, g string, p string"))).first()["kappa"]
    assert conf([("x", "a", "a")] * 3) == 1.0
    assert conf([("x", "a", "a"), ("x", "b", "b"), ("x", "a", "b"), ("x", "b", "a")]) == 0.0


def test_calibration_bounds(spark):
    good = spark.createDataFrame([(i / 200, j < i / 2) for i in range(0, 200, 10) for j in range(100)], "conf double, correct boolean")
    bad = spark.createDataFrame([(0.9, False)] * 50 + [(0.1, True)] * 50, "conf double, correct boolean")
    assert calibration.smece(good).first()["smece"] < 0.05 < 0.3 < calibration.smece(bad).first()["smece"]
    b = {r["bin"]: r["n"] for r in calibration.bins(spark.createDataFrame([(1.0, True), (0.0, True), (1.2, False)], "conf double, correct boolean")).collect()}
    assert b[9] == 2 and b[0] == 1 and len(b) == 10
    empty = spark.createDataFrame([], "conf double, correct boolean")
    assert calibration.brier(empty).first()["brier"] == 0


def test_bootstrap_edges(spark):
    parts = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "k string, x double")
    r = B.cluster_bootstrap(parts, "k", ("x",), F.col("x"), b=0).first()
    assert (r["point"], r["lo"], r["hi"]) == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        B.cluster_bootstrap(parts.unionByName(parts), "k", ("x",), F.col("x"), b=5)
    same = B.paired_bootstrap(parts, "k", ("x",), F.col("x"), F.col("x"), b=20).first()
    assert same["delta"] == 0 and same["p_value"] == 1.0


def test_step_order(spark):
    pairs = lambda ps: structured.kendall(spark.createDataFrame([("k", *p) for p in ps], "k string, g int, p int"), "k").first()["tau"]
    assert pairs([(1, 1), (2, 2), (3, 3)]) == 1.0 and pairs([(1, 3), (2, 2), (3, 1)]) == -1.0
    assert pairs([(1, 5)]) == 1.0 and pairs([(1, 2), (2, 2)]) == 1.0


def test_slots_are_reusable_and_documents_are_not(spark):
    doc = lambda slots: [{"schemaOrgType": "R", "slots": [{"name": n, "value": v} for n, v in slots], "steps": []}]
    kind = "item_id string, structured array<struct<schemaOrgType:string,slots:array<struct<name:string,value:string>>,steps:array<struct<`order`:int,text:string>>>>"
    gold = spark.createDataFrame([("i", doc([("Time", "10 min"), ("time", "ten")]) + doc([("x", "1")]))], kind)
    pred = spark.createDataFrame([("i", doc([("time", "10 min"), ("TIME", "ten")]))], kind)
    r = structured.structured_scores(gold, pred).first()
    assert r["field_accuracy"] == pytest.approx(2 / 3) and r["document_accuracy"] == 0.5 and r["n_docs"] == 2


def test_mention_alignment_takes_all_lines_of_a_supplier(spark, tmp_path):
    """Forty lines of one supplier in eight orders, against every assignment of each order."""
    import random
    from collections import Counter
    from itertools import permutations

    from tessera.functions import text
    from tessera.plans.measurement import mention_alignment

    rng = random.Random(2)
    names = {k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3)) for k in range(1, 41)}
    order = {k: k % 8 for k in names}
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, k, k, 1) for k, o in order.items()], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = Counter()
    for o in range(8):
        gold = [names[k] for k in names if order[k] == o]
        pred = [names[k] + "s" * (k % 3 == 0) for k in names if order[k] == o and k % 4]
        score = lambda g, p: 101 if g == p else s if (s := text.token_set_ratio(p, g)) >= 90 else 0
        best = max(permutations(gold, len(pred)), key=lambda gs: sum(map(score, gs, pred)))
        tiers = ["exact" if g == p else "fuzzy" for g, p in zip(best, pred, strict=True) if score(g, p)]
        want.update((str(o), "pair", t) for t in tiers)
        want[str(o), "missed", "none"] += len(gold) - len(tiers)
        want[str(o), "spurious", "none"] += len(pred) - len(tiers)
    got = {(r["item_id"], r["bucket"], r["tier"]): r["n"] for r in mention_alignment(spark, str(tmp_path)).collect()}
    assert got == +want and sum(n for (_, b, _), n in got.items() if b != "spurious") == 40
