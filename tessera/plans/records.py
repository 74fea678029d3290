"""Queries from records as they are read and written: loaders, gates, pages, prompts, requests, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import engine as E
from tessera.functions import gates
from tessera.functions import scalars as X
from tessera.operators import agreement, linking
from tessera.operators import library as L
from tessera.plans import adapters as P
from tessera.plans.collection import _KB, _grounding
from tessera.plans.measurement import _ratio
from tessera.session import shared_root
from tessera.sources import pages, records
from tessera.streaming import sequencer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _json(fields: dict[str, Column]) -> Column:
    """A JSON object of ready JSON texts; null fields are left out."""
    pairs = [F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), c)) for k, c in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs)), ","), F.lit("}"))


def _quoted(*c) -> Column:
    return F.concat(F.lit('"'), *c, F.lit('"'))


def _lines(rows: DataFrame, label: str) -> str:
    """The folder of JSONL files that hold the column value of rows."""
    path = f"{shared_root(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.select("value").write.text(path)
    return path


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))


def _k() -> Column:
    return F.col("k")


def _kt() -> Column:
    return F.col("k").cast("string")


_TYPE = f"{P._T}[CAST(k % 9 AS INTEGER) + 1]"
_LABELS = """WITH o AS (SELECT o_orderkey AS k FROM orders)"""


@query(f"""{_LABELS} SELECT CAST(k AS VARCHAR) AS item_id, 1 + (k % 4 = 0)::INTEGER AS n_mentions, {_TYPE} AS type, CASE WHEN k % 11 <> 0 THEN 'kb' || CAST(k AS VARCHAR) END AS gold_id, CASE WHEN k % 11 = 0 THEN 'NIL_NO_ID' END AS nil, CASE WHEN k % 2 = 0 THEN 'food' ELSE 'tech' END AS topic, CASE WHEN k % 3 = 0 THEN 2 END::INTEGER AS tercile FROM o""")
def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records written as JSON lines, admitted line by line and read back."""
    mention = lambda i: _json({"mention_id": F.lit(f'"{i}"'), "surface": _quoted(F.lit("m"), _kt()), "type": _quoted(_type()), "gold_id": F.when(_k() % 11 != 0, _json({"authority": F.lit('"kb"'), "id": _quoted(F.lit("kb"), _kt())})), "nil": F.when(_k() % 11 == 0, F.lit('"NIL_NO_ID"')), "failed_queries": F.when(_k() % 11 == 0, F.lit('["q"]'))})
    mentions = F.concat(F.lit("["), mention(0), F.when(_k() % 4 == 0, F.concat(F.lit(","), mention(1))).otherwise(""), F.lit("]"))
    value = _json({"item_id": _quoted(_kt()), "strata": F.when(_k() % 3 == 0, F.lit('{"duration_tercile":2}')), "mentions": mentions, "facets": F.when(_k() % 2 == 0, F.lit('{"topic":"food"}')).otherwise('{"topic":"tech"}')})
    gold = records.read_gold(spark, _lines(_orders(spark, sf_dir).select(value.alias("value")), "gold"))
    m = F.col("mentions")[0]
    return gold.select("item_id", F.size("mentions").alias("n_mentions"), m["type"].alias("type"), m["gold_id"]["id"].alias("gold_id"), m["nil"].alias("nil"), F.col("facets")["topic"].alias("topic"), F.col("strata.duration_tercile").alias("tercile"))


def _type() -> Column:
    return P._pick(P.schemas.TYPES, _k() % 9)


@query(f"{_LABELS} SELECT CAST(k AS VARCHAR) AS item_id, {_TYPE} AS type, CASE WHEN k % 4 <> 0 THEN 'Q' || CAST(k AS VARCHAR) END AS external_id, k % 4 = 0 AS nil, CAST(k % 10 AS DOUBLE) / 10 AS confidence, 'c' || CAST(k % 5 AS VARCHAR) AS concept FROM o")
def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted records written as JSON lines, admitted line by line and read back."""
    grounding = _json({"authority": F.lit('"wikidata"'), "externalId": F.when(_k() % 4 == 0, F.lit("null")).otherwise(_quoted(F.lit("Q"), _kt())), "nil": (_k() % 4 == 0).cast("string"), "grounding_confidence": (_k() % 10 / 10).cast("string")})
    value = _json({"item_id": _quoted(_kt()), "mentions": F.concat(F.lit("["), _json({"surface": F.lit('"s"'), "type": _quoted(_type()), "grounding": grounding}), F.lit("]")), "concepts": F.concat(F.lit('[{"concept_id":"c'), (_k() % 5).cast("string"), F.lit('","score":0.5}]'))})
    pred = records.read_pred(spark, _lines(_orders(spark, sf_dir).select(value.alias("value")), "pred"))
    g = F.col("mentions")[0]["grounding"]
    return pred.select("item_id", F.col("mentions")[0]["type"].alias("type"), g["externalId"].alias("external_id"), g["nil"].alias("nil"), g["grounding_confidence"].alias("confidence"), F.col("concepts")[0]["concept_id"].alias("concept"))


_GOLD_ERRORS = {
    0: ('{"item_id":"x","mentions":[]}', ""),
    1: ('{"item_id":"x","zeta":1,"alpha":2}', "$: unknown property alpha; $: unknown property zeta"),
    2: ('{"mentions":[]}', "$.item_id: required"),
    3: ('{"item_id":"x","mentions":[{"mention_id":"1","surface":"s","type":"game","nil":"NON_ENTITY"},{"mention_id":"1","surface":"s","type":"game","gold_id":{"authority":"a","id":"b"},"nil":"NON_ENTITY"}]}', "$.mentions[1]: exactly one of gold_id and nil is required"),
    4: ('{"item_id":"x","facets":{"topic":"nowhere"}}', "$.facets.topic: value \'nowhere\' not in \'topic\' facet vocabulary"),
    5: ('{"item_id":"x","structured":[{"schemaOrgType":"E","steps":[{"order":1.5,"text":"t"}]}],"claims":[{"claim_id":"1"}]}', "$.claims[0].statement: required; $.structured[0].steps[0].order: a whole number is expected"),
    6: ('{"item_id":"x","mentions":[{"mention_id":"1","surface":"s","type":"game","gold_id":{"authority":"a","id":"b"},"verification":{"place":"p"},"kb_snapshot":{"authority":"a"}}]}', "$.mentions[0].kb_snapshot.retrieved: required; $.mentions[0].verification: unknown property place"),
    7: ("[1]", "$: an object is expected"),
}


def _cases(of: dict[int, tuple[str, str]], column: int) -> Column:
    return F.element_at(F.array(*[F.lit(v[column].replace("\\'", "'")) for v in of.values()]), (_k() % len(of) + 1).cast("int"))


def _told(of: dict[int, tuple[str, str]]) -> str:
    quoted = ", ".join("'" + v[1].replace("\\'", "'").replace("'", "''") + "'" for v in of.values())
    return f"{_LABELS} SELECT k, [{quoted}][CAST(k % {len(of)} AS INTEGER) + 1] AS errors FROM o"


@query(_told(_GOLD_ERRORS))
def gold_gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of records of eight kinds, in order."""
    rows = _orders(spark, sf_dir).select("k", F.try_parse_json(_cases(_GOLD_ERRORS, 0)).alias("v"))
    return rows.select("k", F.array_join(gates.gold_errors(F.col("v")), "; ").alias("errors"))


_POST = '"identity":{"status":"synthetic","canonicalId":"1"},"saves":[{"sources":[{"kind":"likes","at":"2026-01-01T00:00:00Z"}]}]'
_ITEM_ERRORS = {
    0: (f"{{{_POST}}}", ""),
    1: (f'{{{_POST},"children":[{{"order":0,"post":{{{_POST},"children":[{{"order":0,"post":{{{_POST},"mediaKind":"tape"}}}}]}}}}]}}', "$.children[0].post.children[0].post.mediaKind: not known"),
    2: ('{"identity":{"status":"synthetic"},"saves":[]}', "$.identity: a handle is required; $.saves: a save is required"),
    3: (f'{{{_POST},"extractions":[{{"kind":"claim","statement":"s","evidence":[]}}],"extra":1}}', "$: unknown property extra; $.extractions[0]: evidence is required"),
    4: (f'{{{_POST},"children":[{{"order":0,"post":{{{_POST}}}}},{{"order":1}}]}}', "$.children[1]: post is required"),
}
_SHAPE_ERRORS = {k: (v[0], ["", "$.children[0].post.children[0].post: mediaKind is not known", "$: a dated save is required; $: a handle is required", "$: extractions[0]: evidence is required", ""][k]) for k, v in _ITEM_ERRORS.items()}


def _gated(spark: SparkSession, sf_dir: str, gate) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("k").alias("key"), F.try_parse_json(_cases(_ITEM_ERRORS, 0)).alias("v"))
    return gates.gated(rows, gate).select(F.col("key").alias("k"), F.array_join("errors", "; ").alias("errors"))


@query(_told(_ITEM_ERRORS))
def item_gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the item gate says of items of five kinds, with children down to the second level."""
    return _gated(spark, sf_dir, gates.item_errors)


@query(_told(_SHAPE_ERRORS))
def item_shape_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph's shapes say of the same items."""
    return _gated(spark, sf_dir, gates.shape_errors)


_EV = '"evidence":[{"channel":"VERBAL_TEXT","assertion_mode":"STATED","confidence":0.5}]'
_OUTPUT_ERRORS = {
    0: (f'{{"mentions":[{{"surface":"s","type":"book",{_EV}}}],"concepts":[],"facets":[],"claims":[],"structured":[]}}', ""),
    1: ('{"mentions":[],"concepts":[],"facets":[],"structured":[]}', "$.claims: an array is required"),
    2: (f'{{"mentions":[{{"surface":"s","type":"book","externalId":"Q1",{_EV}}}],"concepts":[],"facets":[],"claims":[],"structured":[]}}', "$.mentions[0]: $: unknown property externalId"),
    3: (f'{{"mentions":[],"concepts":[{{"surface":"c","evidence":[]}}],"facets":[{{"facet":"topic","value":"food",{_EV}}}],"claims":[],"structured":[]}}', "$.concepts[0]: evidence is required"),
}


@query(_told(_OUTPUT_ERRORS))
def extractor_output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate of model outputs says of outputs of four kinds."""
    rows = _orders(spark, sf_dir).select("k", F.try_parse_json(_cases(_OUTPUT_ERRORS, 0)).alias("v"))
    return rows.select("k", F.array_join(gates.extractor_output_errors(F.col("v")), "; ").alias("errors"))


@query("""SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 3 WHEN 0 THEN 'favorites' WHEN 1 THEN 'likes' ELSE 'posts' END AS sources, CASE WHEN event_id % 4 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS author,
  CASE WHEN event_id % 4 <> 0 THEN 'https://www.tiktok.com/@u' || CAST(user_id AS VARCHAR) || '/video/' || CAST(event_id AS VARCHAR) END AS url, event_type AS "desc", CASE WHEN event_id % 2 = 0 THEN 'a|b' ELSE '' END AS hashtags, event_id * 3 AS plays, event_id % 6 = 0 AS is_slideshow, event_id % 7 = 0 AS has_subtitles,
  CASE WHEN event_id % 7 = 0 THEN 'https://s.test/en' END AS subtitle_url FROM events WHERE event_id % 10 <> 9""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of intercepted pages: one page an event, with keys in both spellings; pages of other addresses and without
    items give none."""
    k, kt = F.col("event_id"), F.col("event_id").cast("string")
    item = _json({
        "id": _quoted(kt), "desc": _quoted(F.col("event_type")), "author": F.when(k % 4 != 0, _json({"uniqueId": F.when(k % 4 != 1, _quoted(F.lit("u"), F.col("user_id").cast("string"))), "unique_id": F.when(k % 4 == 1, _quoted(F.lit("u"), F.col("user_id").cast("string")))})),
        "challenges": F.when(k % 2 == 0, F.lit('[{"title":"a"},{"title":""},{"title":"b"}]')), "stats": F.when(k % 3 != 0, _json({"playCount": (k * 3).cast("string")})), "statsV2": _json({"playCount": _quoted((k * 3).cast("string"))}),
        "imagePost": F.when(k % 6 == 0, F.lit("{}")), "video": F.when(k % 7 == 0, F.lit('{"subtitleInfos":[{"LanguageCodeName":"de","Url":"https://s.test/de"},{"LanguageCodeName":"eng-US","Url":"https://s.test/en"}]}')),
    })
    body = F.when(k % 2 == 0, F.concat(F.lit('{"itemList":['), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"items":['), item, F.lit("]}")))
    url = F.when(k % 10 == 9, F.lit("https://x.test/api/other")).otherwise(P._pick(("https://x.test/api/user/collect/item_list/", "https://x.test/api/favorite/item_list/", "https://x.test/api/post/item_list/"), k % 3))
    items = pages.page_items(pages.envelopes(P.read(spark, sf_dir, "events").select(url.alias("url"), body.alias("body"))))
    return items.select("id", F.array_join("sources", "|").alias("sources"), "author", "url", "desc", F.array_join("hashtags", "|").alias("hashtags"), F.col("stats.plays").alias("plays"), F.col("isSlideshow").alias("is_slideshow"), F.col("hasSubtitles").alias("has_subtitles"), F.col("subtitleUrl").alias("subtitle_url"))


_MODES = "['STATED', 'SHOWN', 'REPORTED', 'INFERRED']"


@query(f"""WITH e AS (SELECT l_orderkey AS k, l_linenumber * 7 % 4 AS m, CAST(l_linenumber % 5 AS DOUBLE) / 5 AS c FROM lineitem) SELECT k, {_MODES}[CAST(min(m) AS INTEGER) + 1] AS mode, max(c) AS confidence FROM e GROUP BY k""")
def evidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest mode and the highest confidence of an order's lines as evidence."""
    n = F.col("l_linenumber")
    e = P.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(P._pick(P.schemas.MODES, n * 7 % 4).alias("assertion_mode"), (n % 5 / 5).alias("confidence"))).alias("e"))
    return e.select("k", X.rollup(F.col("e"))["assertion_mode"].alias("mode"), X.rollup(F.col("e"))["confidence"].alias("confidence"))


@query(f"""WITH {_KB}, ch AS (SELECT * FROM ky WHERE type = 'book') SELECT key, type, CASE WHEN type = 'book' THEN true ELSE n IS NOT NULL END AS resolved, CASE WHEN type = 'book' THEN 'cached' WHEN n IS NOT NULL THEN 'Q' || CAST(c5.pk AS VARCHAR) END AS id FROM ky LEFT JOIN cn ON cn.p_name = ky.name_key LEFT JOIN c5 ON c5.p_name = ky.name_key AND c5.rn = 1""")
def grounding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second grounding with the replay selector: what the cache knows (all books) is not looked up again."""
    mentions, handles, kb = _grounding(spark, sf_dir)
    known = mentions.where("type = 'book'").select("key", "type").distinct()
    cache = known.select("key", "type", F.lit(True).alias("resolved"), F.lit("cached").alias("id"), F.lit("general").alias("source"), F.lit("n").alias("name"), F.lit(0.7).alias("confidence"), F.lit(1).alias("candidate_count"), F.lit(0).alias("selected_index"))
    return linking.ground(mentions, handles, kb, linking.first_candidate, cache)[0].select("key", "type", "resolved", "id")


@query("""SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN 'artist=' || p_brand || '|context=' || p_name ELSE 'context=' || p_name END AS hints,
'A post mentions something by name. Choose the entry below that it means.' || chr(10) || chr(10) || 'Name: ' || p_name || ' (' || CASE WHEN p_size % 3 = 0 THEN 'music_recording' ELSE 'book' END || ')' || chr(10) || chr(10) || 'What the post says about it:' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '- artist: ' || p_brand || chr(10) ELSE '' END
|| '- context: ' || p_name || chr(10) || chr(10) || 'Entries:' || chr(10) || '[0] ' || p_name || '; ' || p_type || chr(10) || '[1] ' || p_brand || chr(10) || chr(10) || 'Answer with one JSON object and nothing else: {"index": number of the entry, "confidence": number from 0 to 1}. If no entry clearly fits, the index is null.' AS prompt FROM part""")
def select_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of a lookup, and the prompt that asks a model to choose."""
    kind = F.when(F.col("p_size") % 3 == 0, "music_recording").otherwise("book")
    hints = E.hints(kind, F.col("p_brand"), F.concat(F.lit(" "), F.col("p_name")))
    options = F.array(F.struct(F.col("p_name").alias("name"), F.array("p_type").alias("meta")), F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("array<string>").alias("meta")))
    return P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.transform(F.map_entries(hints), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("hints"), E.select_prompt(F.col("p_name"), kind, hints, options).alias("prompt"))


_SCHEMA = {"$id": "x", "type": "object", "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "string", "additionalProperties": False}}}}
_HELD = '{"type":"object","properties":{"a":{"type":"array","items":{"type":"string"}}}}'


@query(f"""SELECT p_partkey AS k, '{{"contents":[{{"parts":[' || CASE WHEN p_partkey % 2 = 0 THEN '{{"inlineData":{{"mimeType":"image/jpeg","data":"' || p_brand || '"}}}},' ELSE '' END || '{{"text":"' || p_name || '"}}]}}],"generationConfig":{{"temperature":0,"responseMimeType":"application/json","responseSchema":{_HELD}}}}}' AS managed,
'{{"model":"' || p_brand || '","stream":false,"format":{_HELD},"messages":[{{"role":"user","content":"' || p_name || '","images":[' || CASE WHEN p_partkey % 2 = 0 THEN '"i"' ELSE '' END || ']}}]}}' AS local FROM part""")
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a managed model, with and without media, and to a local one."""
    k, name = F.col("p_partkey"), F.col("p_name")
    media = F.when(k % 2 == 0, F.array(F.struct(F.lit("image/jpeg").alias("mimeType"), F.col("p_brand").alias("data"))))
    return P.read(spark, sf_dir, "part").select(k.alias("k"), E.managed_request(name, media, _SCHEMA).alias("managed"), E.local_request(F.col("p_brand"), name, F.when(k % 2 == 0, F.array(F.lit("i"))), _SCHEMA).alias("local"))


@query("""WITH r AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS subs, p_partkey % 3 <> 0 AS video FROM part), g AS (SELECT *, CASE WHEN NOT subs THEN 'native' ELSE 'keyframes_vtt' END AS ingestion FROM r)
SELECT k, 'managed' AS lane, ingestion, CASE WHEN ingestion = 'native' AND NOT video THEN 'media_fetch_failed' WHEN k % 5 = 0 THEN 'empty_response' WHEN k % 5 = 1 THEN 'parse_fail' WHEN k % 5 = 2 THEN 'schema_invalid' END AS error, CASE WHEN (ingestion <> 'native' OR video) AND k % 5 > 2 THEN true ELSE false END AS has_output,
  CASE WHEN k % 4 = 0 OR NOT video OR k % 7 = 0 THEN CASE WHEN k % 11 <> 0 THEN 'cover' ELSE '' END ELSE 'f1|f2' END AS frames FROM g""")
def analysis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items through the managed lane with escalation, a stand-in for the model, the reply's gate, and the stills it sees."""
    k = F.col("p_partkey")
    good = F.lit('{"mentions":[],"concepts":[],"facets":[],"claims":[],"structured":[]}')
    model = lambda prompt, ingestion: F.when(k % 5 == 0, "").when(k % 5 == 1, "no json").when(k % 5 == 2, '{"mentions":[]}').otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    url = F.when(k % 3 != 0, F.lit("https://v.test/v.mp4"))
    items = P.read(spark, sf_dir, "part").select("p_partkey", (k % 2 == 0).alias("has_subtitles"), url.alias("play_url"), F.lit("p").alias("prompt"))
    stills = E.frames(k % 4 == 0, F.col("play_url"), F.when(k % 7 != 0, F.array(F.lit("f1"), F.lit("f2"))), F.when(k % 11 != 0, "cover"))
    return E.analyzed(items, Settings(escalateNative=True), model).select(k.alias("k"), "lane", "ingestion", "error", F.col("output").isNotNull().alias("has_output"), F.array_join(stills, "|").alias("frames"))


@query("""WITH f AS (SELECT p_partkey AS k, p_partkey % 7 AS c FROM part) SELECT k, CASE WHEN c > 2 THEN '{"mentions":[],"n":' || CAST(k AS VARCHAR) || '}' END AS output, CASE c WHEN 0 THEN 'no clip id' WHEN 1 THEN 'no frozen result' WHEN 2 THEN 'the frozen result has no output' END AS error FROM f""")
def replayed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen results by clip: only the extractor's output comes through."""
    k = F.col("p_partkey")
    clips = P.read(spark, sf_dir, "part").select(F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("c"), k)).alias("clip_id"), k.alias("k"))
    value = F.when(k % 7 == 2, F.lit('{"grounding":{}}')).otherwise(F.concat(F.lit('{"extractorOutput":{"mentions":[],"n":'), k, F.lit('},"grounding":{"id":"Q1"}}')))
    frozen = P.read(spark, sf_dir, "part").where("p_partkey % 7 > 1").select(F.concat(F.lit("c"), k).alias("clip_id"), value.alias("value"))
    by_clip = E.replayed(clips.select("clip_id").distinct(), frozen)
    out = clips.join(by_clip.withColumnRenamed("clip_id", "c"), clips["clip_id"].eqNullSafe(F.col("c")))
    return out.select("k", "output", "error")


@query("""WITH n AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name FROM part)
SELECT i // 8 AS batch, string_agg(CAST(k AS VARCHAR), '|' ORDER BY i) AS ids, string_agg('### ' || CAST(i % 8 AS VARCHAR) || chr(10) || p_name, chr(10) || chr(10) ORDER BY i) AS prompt FROM n GROUP BY 1""")
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts in batches of eight."""
    out = E.batched(P.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt")), 8)
    return out.select("batch", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"), "prompt")


@query("""WITH c AS (SELECT user_id, event_id AS seq, epoch_ms(ts) // 1000 AS asked_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT user_id, seq, max(asked_ms - i * 100000) OVER (PARTITION BY user_id ORDER BY seq) + i * 100000 AS started_ms FROM c""")
def paced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When calls start that are asked for at once but must be apart."""
    # to the nearest millisecond, halves away from zero, then without its thousandths, as SQL has it
    asked = F.expr("(unix_micros(cast(ts as timestamp)) + if(unix_micros(cast(ts as timestamp)) < 0, -500, 500)) div 1000 div 1000")
    calls = P.read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), asked.alias("asked_ms"))
    return L.paced(calls, 100_000, "user_id").select("user_id", "seq", "started_ms")


_STATES = """lg AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS account, ['favorites', 'likes', 'posts', 'reposts'][event_id % 7 % 4 + 1] AS source, ['begun', 'done', 'giveup'][event_id % 3 + 1] AS event FROM events WHERE event_id % 9 <> 0)"""


@query(f"""WITH {_STATES}, a AS (SELECT DISTINCT account FROM lg), l AS (SELECT account, source, arg_max(event, n) AS event, arg_max(n, n) AS n FROM lg GROUP BY 1, 2), f(place, source) AS (VALUES (0, 'favorites'), (1, 'likes'), (2, 'posts'), (3, 'reposts'))
SELECT a.account, f.source, f.place::INTEGER AS place, CASE event WHEN 'giveup' THEN 'partial · ' || CAST(n AS VARCHAR) WHEN 'done' THEN 'done · ' || CAST(n AS VARCHAR) WHEN 'begun' THEN 'capturing…' ELSE 'pending' END AS label, CASE event WHEN 'begun' THEN 'current' ELSE coalesce(event, 'pending') END AS state FROM a CROSS JOIN f LEFT JOIN l ON l.account = a.account AND l.source = f.source""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each source of each account."""
    k = F.col("event_id")
    ledger = P.read(spark, sf_dir, "events").where("event_id % 9 <> 0").select(k.alias("n"), F.col("user_id").cast("string").alias("account"), F.lit(0).alias("sweep"), P._pick(P.schemas.SOURCES, k % 7 % 4).alias("source"), P._pick(("begun", "done", "giveup"), k % 3).alias("event"), k.alias("captured"), k.alias("at"))
    return L.source_states(sequencer.board(ledger.select("account").distinct(), ledger))


@query("""WITH lib AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, 'new ' || p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'posts' ELSE 'likes' END AS tag FROM part WHERE p_partkey % 3 <> 0), old AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'likes' AS tag FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(lib.id, old.id) AS id, coalesce(lib.title, old.title) AS title, CASE WHEN old.id IS NULL THEN lib.tag WHEN lib.id IS NULL OR lib.tag = 'likes' THEN 'likes' ELSE 'likes|posts' END AS sources FROM lib FULL JOIN old ON lib.id = old.id""")
def migrated_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old list folded into a library, twice; the second time changes nothing."""
    part, k = P.read(spark, sf_dir, "part"), F.col("p_partkey")
    library = part.where("p_partkey % 3 <> 0").select(k.cast("string").alias("id"), F.concat(F.lit("new "), "p_name").alias("title"), F.array(F.when(k % 4 == 0, "posts").otherwise("likes")).alias("sources"))
    legacy = part.where("p_partkey % 2 = 0").select(k.cast("string").alias("id"), F.col("p_name").alias("title"), F.array(F.lit("likes")).alias("sources"))
    once = L.migrated(library, legacy, ["title"])
    return L.migrated(L.migrated(once, legacy, ["title"]), None, ["title"]).withColumn("sources", F.array_join("sources", "|"))


@query("""WITH lg AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_id // 7 AS rev FROM events WHERE event_id % 2 = 0), ch AS (SELECT CAST(user_id AS VARCHAR) AS key, 'd' || CAST(event_id % 4 AS VARCHAR) AS device_id, event_id % 9 = 0 AS deleted, event_id FROM events WHERE event_id % 2 = 1)
SELECT ch.key, (coalesce((SELECT max(rev) FROM lg WHERE lg.key = ch.key), 0) + row_number() OVER (PARTITION BY ch.key ORDER BY event_id))::BIGINT AS rev, device_id, deleted, ((SELECT max(seq) FROM lg) + row_number() OVER (ORDER BY event_id))::BIGINT AS seq FROM ch""")
def pushed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes pushed onto a sync log: sequence numbers go on from the log's, revisions from each key's."""
    e = P.read(spark, sf_dir, "events").withColumn("key", F.col("user_id").cast("string"))
    log = e.where("event_id % 2 = 0").select("key", F.floor(F.col("event_id") / 7).alias("rev"), F.col("event_id").alias("seq"))
    changes = e.where("event_id % 2 = 1").select("key", F.concat(F.lit("d"), F.col("event_id") % 4).alias("device_id"), (F.col("event_id") % 9 == 0).alias("deleted"), "event_id")
    return L.pushed(log, changes, [F.col("event_id")])


@query(f"""WITH r AS (SELECT l_orderkey AS item, l_suppkey % 3 AS who, l_partkey % 50 AS mark FROM lineitem), m AS (SELECT DISTINCT item, who, mark FROM r), t AS (SELECT DISTINCT item, who FROM m), p AS (SELECT x.item, x.who AS a, y.who AS b FROM t x JOIN t y ON x.item = y.item AND x.who < y.who),
n AS (SELECT p.a, p.b, p.item, mk.mark, bool_or(mk.who = p.a) AS ina, bool_or(mk.who = p.b) AS inb FROM p JOIN m mk ON mk.item = p.item GROUP BY ALL),
s AS (SELECT a, b, count(*) FILTER (WHERE ina AND inb) AS "both", count(*) FILTER (WHERE ina AND NOT inb) AS only_a, count(*) FILTER (WHERE inb AND NOT ina) AS only_b FROM n GROUP BY 1, 2)
SELECT a AS annotator_a, b AS annotator_b, "both", only_a, only_b, {_ratio('2 * "both"', '2 * "both" + only_a + only_b')} AS f1 FROM s""")
def annotator_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise F1 of three annotators' marks on orders."""
    marks = P.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_suppkey") % 3).alias("annotator"), (F.col("l_partkey") % 50).alias("mark"))
    return agreement.pairwise_f1(marks)


@query("""WITH v AS (SELECT l_orderkey AS unit, l_returnflag AS value FROM lineitem WHERE l_linestatus = 'F'), c AS (SELECT unit, value, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY 1, 2), u AS (SELECT unit, sum(n) AS m, sum(n * n) AS same FROM c GROUP BY 1 HAVING sum(n) > 1),
t AS (SELECT value, sum(n) AS n FROM c WHERE unit IN (SELECT unit FROM u) GROUP BY 1), o AS (SELECT sum((m * m - same) / (m - 1)) AS apart, sum(m) AS a, count(*) AS units FROM u)
SELECT round(1 - apart / ((a * a - (SELECT sum(n * n) FROM t)) / (a - 1)), 9) AS alpha, units, a::BIGINT AS n_values FROM o""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal alpha of return flags as decisions on orders."""
    values = P.read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("annotator"), F.col("l_returnflag").alias("value"))
    return agreement.krippendorff(values).withColumn("alpha", F.round("alpha", 9))
