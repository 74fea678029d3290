"""Gates: one error for each thing that is wrong, in order, with its place; items down to the last child."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera.functions import gates
from tessera.sources import sinks


def errors(spark, gate, *records):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, j string")
    return [r["e"] for r in rows.select("i", gate(F.try_parse_json("j")).alias("e")).orderBy("i").collect()]


def whole(spark, gate, *records):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "key int, j string").select("key", F.try_parse_json("j").alias("v"))
    return [r["errors"] for r in gates.gated(rows, gate).orderBy("key").collect()]


PLACE = {"mention_id": "1", "surface": "Mill Road Café", "type": "place", "gold_id": {"authority": "google_places", "id": "p1"}}


def test_gold_records_in_full(spark):
    good = {"item_id": "x", "strata": {"has_vtt": True, "duration_tercile": 3}, "mentions": [PLACE | {"aliases": ["Mill"], "nil": None, "hard_case": False, "notes": "n", "kb_snapshot": {"authority": "a", "retrieved": "2025-01-01"}, "verification": {"name": "Mill", "lat": 1.5, "lng": -2}}],
            "concepts": [{"concept_id": "c", "label": "l"}], "facets": {"topic": "food"}, "structured": [{"schemaOrgType": "Event", "slots": [{"name": "n", "value": [1, {"a": 2}]}], "steps": [{"order": 1, "text": "t"}]}], "claims": [{"claim_id": "1", "statement": "s"}]}
    wrong = [
        ({"mentions": [PLACE | {"verification": {"place_id": "p"}}]}, "$.mentions[0].verification: unknown property place_id"),
        ({"mentions": [PLACE | {"kb_snapshot": {"authority": "a"}}]}, "$.mentions[0].kb_snapshot.retrieved: required"),
        ({"mentions": [PLACE | {"gold_id": {"authority": "a"}}]}, "$.mentions[0].gold_id.id: required"),
        ({"mentions": [PLACE | {"type": "shop"}]}, "$.mentions[0].type: not one of"),
        ({"mentions": [PLACE | {"nil": "NON_ENTITY"}]}, "$.mentions[0]: exactly one of gold_id and nil"),
        ({"mentions": [PLACE | {"gold_id": None, "nil": "NIL_NO_ID"}]}, "NIL_NO_ID needs failed_queries"),
        ({"mentions": [PLACE | {"aliases": [1]}]}, "$.mentions[0].aliases[0]: a text is expected"),
        ({"mentions": {}}, "$.mentions: an array is expected"), ({"strata": {"duration_tercile": 4}}, "a number from 1 to 3"), ({"strata": {"duration_tercile": 1.5}}, "a number from 1 to 3"),
        ({"concepts": [{"label": "l"}]}, "$.concepts[0].concept_id: required"), ({"facets": {"topic": 3}}, "$.facets: an object of texts"), ({"facets": {"topic": "nowhere"}}, "facet vocabulary"),
        ({"structured": [{"schemaOrgType": "E", "steps": [{"order": "1", "text": "t"}]}]}, "$.structured[0].steps[0].order: a whole number"), ({"structured": [{"slots": []}]}, "schemaOrgType: required"),
        ({"claims": [{"statement": "s"}]}, "$.claims[0].claim_id: required"), ({"item_id": 7}, "$.item_id: a text is expected"), ({"other": 1}, "$: unknown property other"),
    ]
    got = errors(spark, gates.gold_errors, good, *[{"item_id": "x"} | w for w, _ in wrong], {}, [])
    assert got[0] == [] and got[-2] == ["$.item_id: required"] and got[-1][0].startswith("$: an object")
    for e, (_, message) in zip(got[1:], wrong, strict=False):
        assert any(message in x for x in e), (e, message)


def test_prediction_records(spark):
    mention = {"surface": "s", "type": "game", "grounding": {"authority": "wikidata", "externalId": "Q1", "nil": False, "grounding_confidence": 0.5}}
    say = lambda **g: {"item_id": "x", "mentions": [mention | {"grounding": mention["grounding"] | g}]}
    good = say() | {"structured": [{"schemaOrgType": "E", "slots": [], "steps": []}], "claims": [{"statement": "s"}], "concepts": [{"concept_id": "c", "score": 1}]}
    got = errors(spark, gates.pred_errors, good, say(nil=True, externalId=None), say(nil=True), say(externalId=None), say(grounding_confidence=2), say(extra=1), {"item_id": "x", "claims": [{"claim_id": "1"}]}, {"item_id": "x", "concepts": [{"concept_id": "c", "score": -1}]})
    assert got[:2] == [[], []] and all(got[2:])
    assert "externalId" in got[2][0] and got[6] == ["$.claims[0]: unknown property claim_id", "$.claims[0].statement: required"]


def test_errors_are_in_order_of_places(spark):
    record = {"item_id": "x", "mentions": [PLACE] * 2 + [PLACE | {"type": "b"}] + [PLACE] * 8 + [PLACE | {"type": "b"}], "zeta": 1, "alpha": 2}
    got = errors(spark, gates.gold_errors, record)[0]
    assert [e.split(": ")[0] for e in got] == ["$", "$", "$.mentions[2].type", "$.mentions[11].type"] and got[0] < got[1]


ITEM = {"identity": {"status": "synthetic", "canonicalId": "1"}, "saves": [{"sources": [{"kind": "likes", "at": "2026-01-01T00:00:00Z"}]}], "mediaKind": None}
EVIDENCE = {"channel": "VERBAL_TEXT", "assertion_mode": "STATED", "confidence": 0.5}


@pytest.mark.parametrize(
    ("change", "message"),
    [({"identity": {"status": "inferred"}}, "handle"), ({"saves": []}, "save is required"), ({"mediaKind": "tape"}, "mediaKind"), ({"extra": 1}, "unknown property"), ({"extractions": [{"kind": "claim", "statement": "s", "evidence": []}]}, "evidence is required"), ({"children": [{"order": 0}]}, "post is required")],
)
def test_item_gate(spark, change, message):
    good, bad = errors(spark, gates.item_errors, ITEM, ITEM | change)
    assert good == [] and any(message in e for e in bad)


def test_children_are_checked_to_the_last(spark):
    def nested(depth, last):
        return last if depth == 0 else ITEM | {"children": [{"order": 0, "post": nested(depth - 1, last)}]}

    got = whole(spark, gates.item_errors, nested(4, ITEM), nested(4, ITEM | {"mediaKind": "tape"}), ITEM | {"saves": []})
    assert got[0] == [] and got[1] == ["$" + ".children[0].post" * 4 + ".mediaKind: not known"] and got[2] == ["$.saves: a save is required"]


def test_shapes(spark):
    tiktok = ITEM | {"origin": {"platform": "tiktok"}, "mediaKind": "video"}
    fact = lambda **e: {"extractions": [{"kind": "claim", "statement": "s", "evidence": [EVIDENCE | e]}]}
    base = errors(spark, gates.shape_errors, ITEM, ITEM | fact(), ITEM | fact(assertion_mode="GUESSED"), ITEM | fact(channel="SMELL"), ITEM | {"extractions": [{"kind": "claim"}]}, ITEM | {"saves": [{"sources": [{"kind": "likes"}]}]}, tiktok)
    assert base[0] == base[1] == base[6] == [] and all(base[2:6]) and "dated save" in base[5][0]
    profile = lambda v: gates.shape_errors(v, "tiktok")
    got = errors(spark, profile, tiktok, tiktok | {"identity": {"status": "platform_verified", "canonicalId": "1"}}, tiktok | {"mediaKind": "audio"}, ITEM)
    assert got[0] == ["status is platform_verified"] and got[1] == got[3] == [] and "mediaKind is video or photo" in got[2]
    with pytest.raises(ValueError):
        gates.shape_errors(F.lit(None), "elsewhere")


def test_export_counts_families_too(spark):
    family = lambda last: ITEM | {"children": [{"order": 0, "post": last}]}
    items = [ITEM, ITEM | {"saves": []}, family(ITEM), family(ITEM | {"mediaKind": "tape"})]
    rows = spark.createDataFrame([(str(i), json.dumps(x)) for i, x in enumerate(items)] + [("9", "no json")], "id string, value string")
    assert tuple(sinks.export_report(rows).first()) == (2, 3) and tuple(sinks.export_report(rows.limit(2)).first()) == (1, 1)


def test_check_tells_valid_and_invalid_files_apart(spark, tmp_path):
    files = {"valid/a.json": ITEM, "valid/b.json": ITEM | {"children": [{"order": 0, "post": ITEM}]}, "invalid/c.json": ITEM | {"saves": []}, "invalid/d.json": ITEM, "invalid/e.json": None}
    for name, item in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("not json" if item is None else json.dumps(item))
    got = {r["path"].rsplit("/", 1)[-1]: r["wrong"] for r in cli.check(spark, f"{tmp_path}/valid", f"{tmp_path}/invalid").collect()}
    assert got == {"a.json": False, "b.json": False, "c.json": False, "d.json": True, "e.json": False}
