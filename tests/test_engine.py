import json

import duckdb
from pyspark.sql import functions as F

from tessera.functions import engine as E
from tessera.plans import records
from tessera.sources import kb

EV = [{"channel": "VERBAL_TEXT", "assertion_mode": "STATED", "confidence": 0.5}]
GOOD = {"mentions": [{"surface": "s", "type": "book", "evidence": EV}], "concepts": [], "facets": [{"facet": "topic", "value": "anything", "evidence": EV}], "claims": [], "structured": []}


def admitted(spark, obj):
    return spark.createDataFrame([(json.dumps(obj),)], "j string").select(F.try_parse_json("j").alias("v")).select(E.admitted(F.col("v"))).first()[0]


def test_runtime_gate_is_structural(spark):
    assert admitted(spark, GOOD)  # values of facets are not looked up, unknown top-level keys pass
    assert admitted(spark, GOOD | {"extra": 1})
    assert not admitted(spark, GOOD | {"facets": [{"facet": "mood", "value": "x", "evidence": EV}]})
    assert not admitted(spark, GOOD | {"mentions": [GOOD["mentions"][0] | {"externalId": "Q"}]})
    assert not admitted(spark, GOOD | {"mentions": [{"surface": "s", "type": "book", "evidence": []}]})
    assert not admitted(spark, GOOD | {"claims": None}) and not admitted(spark, [])
    assert not admitted(spark, GOOD | {"concepts": [{"surface": "s", "evidence": [EV[0] | {"confidence": 1.5}]}]})


def test_prompts_leave_out_what_is_unknown(spark):
    df = spark.createDataFrame([("cap", [], None, None, (None, None), "  ")], "d string, h array<string>, a string, n string, m struct<name:string,author:string>, t string")
    text = df.select(E.extractor_prompt(F.lit("B"), F.col("d"), F.col("h"), F.col("a"), F.col("n"), F.col("m"), F.col("t"))).first()[0]
    assert text == "B\n\nCONTEXT:\nCaption: cap"
    hints = spark.range(1).select(E.hints(F.lit("music_recording"), F.lit("x"), F.lit(" c ")).alias("h"), E.hints(F.lit("book"), F.lit("x"), F.lit(" ")).alias("n")).first()
    assert hints["h"] == {"artist": "x", "context": "c"} and hints["n"] is None
    cands = F.array(F.struct(F.lit("Dune").alias("name"), F.array(F.lit("film")).alias("meta")))
    prompt = spark.range(1).select(E.select_prompt(F.lit("dune"), F.lit("book"), F.lit(None).cast("map<string,string>"), cands)).first()[0]
    assert "What the post says" not in prompt and "[0] Dune; film" in prompt


def test_places_need_a_key():
    assert ("place", "places", 0) in kb.handles("key") and not any(t == "place" for t, _, _ in kb.handles())


def test_media_bound_and_dump(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "m" / "b.bin").write_bytes(b"x" * 30)
    rows = {r["length"]: r["content"] for r in kb.media(spark, str(tmp_path / "m"), 20).collect()}
    assert rows[10] == b"x" * 10 and rows[30] is None
    kb.dump_capture(spark.range(2), False, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).where("status = 'incomplete'").count() == 2


def test_wilson_and_sample_size(spark):
    lo, hi = E.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), E.sample_size(F.lit(0.5), F.lit(0.05)).alias("n")).first()
    assert (r["lo"], r["hi"], r["n"]) == (0.0, 0.0, 385)


def test_calls_are_asked_for_at_the_nearest_millisecond(spark, tmp_path):
    """paced_calls as its SQL has it at the edges of a second, before 1970 too."""
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    micros = [s * 1_000_000 + m for s in (1_704_067_200, 1_804_067_200, -5, 0) for m in (-501, -500, -499, 0, 499_500, 999_499, 999_500, 999_999)]
    con.sql(f"create table events as select i as event_id, i % 5 as user_id, make_timestamp(m) as ts from (select unnest({micros}) as m, unnest(range({len(micros)})) as i)")
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    want = con.sql(f"select user_id, seq, started_ms from ({records.ORACLES['paced_calls']})").fetchall()
    assert sorted(map(tuple, records.QUERIES["paced_calls"](spark, str(tmp_path)).collect())) == sorted(want)
