"""Queries around the model and the knowledge bases, over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import engine as E
from tessera.functions import scalars as X
from tessera.operators import library as L
from tessera.plans import adapters as P
from tessera.plans.collection import _ITEMS, _items
from tessera.plans.measurement import _ratio, rounded
from tessera.sources import kb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"""WITH {_ITEMS} SELECT id, 'BASE' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || 'Caption: ' || descr || CASE WHEN tags <> '' THEN chr(10) || 'Hashtags: #a #b' ELSE '' END || CASE WHEN author IS NOT NULL THEN chr(10) || 'Creator: ' || author ELSE '' END
|| CASE k % 3 WHEN 0 THEN chr(10) || 'Music (post metadata): song — singer' WHEN 1 THEN chr(10) || 'Music (post metadata): song' ELSE '' END || CASE WHEN k % 2 = 0 THEN chr(10) || 'Transcript:' || chr(10) || 'said' ELSE '' END AS prompt FROM it""")
def extractor_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pos")
    music = F.struct(F.when(k % 3 != 2, "song").alias("name"), F.when(k % 3 == 0, "singer").alias("author"))
    text = E.extractor_prompt(F.lit("BASE"), F.col("desc"), F.col("hashtags"), F.col("author"), F.lit(None).cast("string"), music, F.when(k % 2 == 0, " said "))
    return _items(spark, sf_dir).select("id", text.alias("prompt"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0)) THEN 'native' ELSE 'keyframes_vtt' END AS ingestion,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'native_unsupported_local' WHEN o_orderkey % 3 = 0 AND o_orderkey % 11 = 0 THEN 'media_fetch_failed' END AS refusal FROM orders""")
def ingestion_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lane, wish = F.when(k % 2 == 0, "managed").otherwise("local"), F.when(k % 3 == 0, "native").otherwise("keyframes_vtt")
    return P.read(spark, sf_dir, "orders").select("o_orderkey", E.route(wish, lane, k % 5 == 0, k % 7 == 0).alias("ingestion"), E.lane_error(lane, wish, k % 11 != 0).alias("refusal"))


_EVIDENCE = '[{"channel":"VERBAL_TEXT","assertion_mode":"STATED","confidence":0.5}]'
_REPLIES = (
    '{"mentions":[],"concepts":[],"facets":[],"claims":[],"structured":[]}',
    '```json\n{"mentions":[{"surface":"s","type":"book","evidence":' + _EVIDENCE + '}],"concepts":[],"facets":[],"claims":[],"structured":[]}\n```',
    '{"mentions":[{"surface":"s","type":"book","externalId":"Q1","evidence":' + _EVIDENCE + '}],"concepts":[],"facets":[],"claims":[],"structured":[]}',
    '{"mentions":[],"concepts":[],"facets":[{"facet":"mood","value":"x","evidence":' + _EVIDENCE + '}],"claims":[],"structured":[]}',
    "not json",
    "",
)


@query("SELECT event_id, [NULL, NULL, 'schema_invalid', 'schema_invalid', 'parse_fail', 'empty_response'][event_id % 6 + 1] AS error FROM events")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of both lanes through the parser and the runtime gate."""
    k = F.col("event_id")
    text = F.to_json(F.struct(P._pick(_REPLIES, k % 6).alias("t")))
    inner = F.regexp_extract(text, r"(?s)^\{\"t\":(.*)\}$", 1)
    body = F.when(k % 2 == 0, F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), inner, F.lit("}]}}]}"))).otherwise(F.concat(F.lit('{"message":{"content":'), inner, F.lit("}}")))
    rows = P.read(spark, sf_dir, "events").select("event_id", E.model_reply(F.try_parse_json(body)).alias("reply"))
    rows = rows.withColumn("parsed", E.parsed_reply(F.col("reply")))
    return rows.select("event_id", E.reply_error(F.col("reply"), F.col("parsed")).alias("error"))


@query("""WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS name_key, p_partkey AS k, p_name AS n FROM part), e AS (SELECT name_key, n, k, unnest(range(7)) AS i FROM a)
SELECT CASE k % 3 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'wikidata' ELSE 'places' END AS source, name_key, (row_number() OVER (PARTITION BY name_key ORDER BY i) - 1)::INTEGER AS rank, 'Q' || CAST(i AS VARCHAR) AS id, n || ' ' || CAST(i AS VARCHAR) AS name,
CASE WHEN k % 3 = 0 THEN CAST(100 - i AS DOUBLE) END AS score, CASE k % 3 WHEN 0 THEN 'x, y' WHEN 1 THEN 'about' END AS meta FROM e WHERE i <> 2 QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY i) <= 5""")
def kb_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven entries a search, the third without an id, through the parsers of the three sources."""
    k = F.col("p_partkey")
    source = P._pick(kb.SOURCES, k % 3)
    ident = lambda i: F.when(i == 2, "").otherwise(F.concat(F.lit("Q"), i.cast("string")))
    named = lambda i: F.concat(F.col("p_name"), F.lit(" "), i.cast("string"))
    seven = F.sequence(F.lit(0), F.lit(6))
    music = F.to_json(F.struct(F.transform(seven, lambda i: F.struct(ident(i).alias("id"), named(i).alias("title"), (100 - i).alias("score"), F.array(F.struct(F.lit("x").alias("name")), F.struct(F.lit("y").alias("name"))).alias("artist-credit"))).alias("recordings")))
    general = F.to_json(F.struct(F.transform(seven, lambda i: F.struct(ident(i).alias("id"), named(i).alias("label"), F.lit("about").alias("description"))).alias("search")))
    place = F.to_json(F.struct(F.transform(seven, lambda i: F.struct(ident(i).alias("id"), F.struct(named(i).alias("text")).alias("displayName"))).alias("places")))
    body = F.when(k % 3 == 0, music).when(k % 3 == 1, general).otherwise(place)
    return kb.candidates(P.read(spark, sf_dir, "part").select(source.alias("source"), k.cast("string").alias("name_key"), body.alias("body")))


@query("""WITH e AS (SELECT o_orderkey % 100 AS clip, 'book:' || CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS k FROM orders)
SELECT clip, key, CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 17 = 0 THEN 'unexpected' WHEN k % 5 = 0 AND k % 3 <> 0 THEN 'resolved differs' WHEN k % 7 = 0 THEN 'id differs' END AS problem FROM e WHERE (k % 13 = 0 AND k % 17 <> 0) OR (k % 17 = 0 AND k % 13 <> 0) OR (k % 13 <> 0 AND k % 17 <> 0 AND ((k % 5 = 0 AND k % 3 <> 0) OR (k % 7 = 0 AND k % 3 <> 0)))""")
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = P.read(spark, sf_dir, "orders")
    head = [(k % 100).alias("clip"), F.lit("book").alias("type"), k.cast("string").alias("surface")]
    want = o.where(k % 17 != 0).select(*head, F.when(k % 3 != 0, F.concat(F.lit("Q"), k)).alias("externalId"), (k % 3 == 0).alias("nil"))
    yes = (k % 3 != 0) & (k % 5 != 0)
    got = o.where(k % 13 != 0).select(*head, yes.alias("resolved"), F.when(yes, F.concat(F.when(k % 7 == 0, "X").otherwise("Q"), k)).alias("id"))
    return kb.replay_diff(want, got)


@query(f"""WITH s AS (SELECT o_orderstatus AS stratum, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS hits FROM orders GROUP BY 1),
w AS (SELECT *, {_ratio('hits', 'n')} AS p, 1.959963984540054::DOUBLE AS z FROM s)
SELECT stratum, n, hits, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n)) / (1 + z * z / n), 9) AS lo, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * CAST(n AS DOUBLE) * n)) / (1 + z * z / n), 9) AS hi FROM w""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("hits"))
    lo, hi = E.wilson(F.col("hits"), F.col("n"))
    return rounded(s.withColumns({"lo": lo, "hi": hi}), "lo", "hi")


@query("""SELECT event_id, '⛏ ' || CAST(event_id AS VARCHAR) || ' · ' || CASE WHEN event_id % 4 = 0 THEN '—' ELSE event_type END || ' · more:' || CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '—' END || ' · heap ' || CASE WHEN event_id % 5 = 0 THEN '—' ELSE CAST(user_id AS VARCHAR) || 'MB' END
|| ' · dom 7' || CASE WHEN event_id % 2 = 0 THEN ' · evicted 0' ELSE '' END || ' · scrolling' AS line FROM events""")
def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    line = E.hud_line(e, F.when(e % 4 != 0, F.col("event_type")), F.when(e % 3 == 0, True).when(e % 3 == 1, False), E.heap_mb(F.when(e % 5 != 0, F.col("user_id") * 1024 * 1024)), F.lit(7), F.when(e % 2 == 0, 0), F.lit("scrolling"))
    return P.read(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""WITH r AS (SELECT o_custkey AS id, o_custkey % 2 = 0 AS had_text, list(DISTINCT lower(o_orderpriority)) FILTER (WHERE o_orderkey % 3 <> 0) AS a0, list(DISTINCT lower(o_orderpriority)) FILTER (WHERE o_orderkey % 4 <> 0) AS b0 FROM orders GROUP BY 1),
s AS (SELECT id, had_text, coalesce(a0, []) AS a, coalesce(b0, []) AS b FROM r), m AS (SELECT had_text, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM s),
f AS (SELECT had_text, CASE WHEN u = 0 THEN 1.0 ELSE i / u::DOUBLE END AS j, CASE WHEN na = 0 THEN 1.0 ELSE i / na::DOUBLE END AS ra, CASE WHEN nb = 0 THEN 1.0 ELSE i / nb::DOUBLE END AS rb, na - i AS ao, nb - i AS bo FROM m)
SELECT CAST(had_text AS VARCHAR) AS had_text, count(*) AS n, round(avg(j), 9) AS jaccard, round(avg(ra), 9) AS recall_of_a, round(avg(rb), 9) AS recall_of_b, round(avg(ao), 9) AS a_only, round(avg(bo), 9) AS b_only FROM f GROUP BY GROUPING SETS ((had_text), ())""")
def agreement_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions of the same items, neither taken as truth: agreement overall and by stratum."""
    k, p = F.col("o_orderkey"), F.lower("o_orderpriority")
    sets = P.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(k % 3 != 0, p)).alias("a"), F.collect_set(F.when(k % 4 != 0, p)).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = F.size(F.array_intersect(a, b))
    rows = sets.select((F.col("o_custkey") % 2 == 0).cast("string").alias("had_text"), X.jaccard(a, b).alias("j"), X.recall_of(a, b).alias("ra"), X.recall_of(b, a).alias("rb"), (F.size(a) - both).alias("ao"), (F.size(b) - both).alias("bo"))
    out = rows.cube("had_text").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(x), 9).alias(n) for x, n in (("j", "jaccard"), ("ra", "recall_of_a"), ("rb", "recall_of_b"), ("ao", "a_only"), ("bo", "b_only"))])
    return out


@query("""SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id""")
def key_value_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key-value table after all writes: the last one wins."""
    log = P.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("rev"), F.lit("d").alias("device_id"))
    return L.last_writer(log).select("key", "value")


@query("""SELECT page_id, regexp_matches(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^/@[^/?#]+') AND NOT regexp_matches(url, '/(video|photo)/') AS profile FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://x.test/@u' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '/video/1' ELSE '?a=1' END ELSE url END AS url FROM pages)""")
def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://x.test/@u"), k, F.when(k % 2 == 0, "/video/1").otherwise("?a=1"))).otherwise(F.col("url"))
    return P.read(spark, sf_dir, "pages").select("page_id", X.is_profile(url).alias("profile"))


@query("SELECT p_partkey, lower(CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_type END) || '::' || trim(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read(spark, sf_dir, "part").select("p_partkey", E.entity_key(F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")), F.concat_ws("-", "p_name", "p_brand")).alias("key"))
