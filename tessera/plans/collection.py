"""Library and capture queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import gates
from tessera.functions import scalars as X
from tessera.functions import text as T
from tessera.operators import library as L
from tessera.operators import linking
from tessera.plans import adapters as P
from tessera.plans.measurement import _ratio, rounded
from tessera.session import setting, shared_root
from tessera.sources import pages, sinks
from tessera.streaming import capture, sequencer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _joined(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as text, for comparison."""
    return df.withColumns({n: F.array_join(n, "|") for n in names})


_MERGED = """w AS (SELECT * FROM ar WHERE id <> ''), lastrow AS (SELECT id, arg_max(seq, seq) AS seq FROM w GROUP BY id), cnt AS (SELECT id, count(*) AS arrivals FROM w GROUP BY id),
tg AS (SELECT id, string_agg(tag, '|' ORDER BY f) AS sources FROM (SELECT id, tag, min(seq) AS f FROM w GROUP BY id, tag) GROUP BY id)"""


@query(f"WITH {P.ARRIVALS}, {_MERGED} SELECT w.id, w.value, w.k, cnt.arrivals, tg.sources FROM lastrow JOIN w ON w.id = lastrow.id AND w.seq = lastrow.seq JOIN cnt ON cnt.id = w.id JOIN tg ON tg.id = w.id")
def merge_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(L.merge(L.well_formed(P.arrivals(spark, sf_dir)), ["value", "k"]), "sources")


@query(f"""WITH {P.ARRIVALS}, w AS (SELECT * FROM ar WHERE id <> ''), k AS (SELECT id, arg_max(k, seq) FILTER (WHERE k IS NOT NULL) AS k, arg_max(value, seq) FILTER (WHERE value IS NOT NULL) AS value, count(*) AS arrivals FROM w GROUP BY id),
tg AS (SELECT id, string_agg(tag, '|' ORDER BY f) AS sources FROM (SELECT id, tag, min(seq) AS f FROM w GROUP BY id, tag) GROUP BY id) SELECT k.id, k.value, k.k, k.arrivals, tg.sources FROM k JOIN tg ON tg.id = k.id""")
def merge_keeping_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(L.merge(L.well_formed(P.arrivals(spark, sf_dir)), ["value", "k"], keep_non_null=True), "sources")


@query(f"WITH {P.ARRIVALS}, {_MERGED} SELECT w.id, w.value, w.k, tg.sources FROM lastrow JOIN w ON w.id = lastrow.id AND w.seq = lastrow.seq JOIN tg ON tg.id = w.id")
def upsert_in_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.well_formed(P.arrivals(spark, sf_dir))
    first = L.merge(rows.where("seq < 4000"), ["value", "k"]).select("id", "value", "k", "sources")
    return _joined(L.upsert(first, rows.where("seq >= 4000"), ["value", "k"]), "sources")


@query(f"WITH {P.ARRIVALS}, w AS (SELECT * FROM ar WHERE id <> ''), n AS (SELECT DISTINCT id FROM w WHERE seq >= 100), o AS (SELECT DISTINCT id FROM w WHERE seq < 100) SELECT count(*) FILTER (WHERE o.id IS NULL) AS added, count(o.id) AS merged FROM n LEFT JOIN o ON o.id = n.id")
def upsert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.well_formed(P.arrivals(spark, sf_dir))
    return L.upsert_counts(rows.where("seq < 100").select("id").distinct(), rows.where("seq >= 100"))


@query(f"WITH {P.ARRIVALS} SELECT tag, count(*) AS arrivals, count(*) FILTER (WHERE id = '') AS dropped, count(*) FILTER (WHERE tag = 'view') AS driving FROM ar GROUP BY tag")
def malformed_and_driving_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.col("sources")[0]
    return P.arrivals(spark, sf_dir).groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("arrivals"), F.count_if(F.col("id") == "").alias("dropped"), F.count_if(capture.drives(F.lit("view"), tag)).alias("driving"))


@query(f"WITH {P.ARRIVALS}, {_MERGED} SELECT w.id, w.value, w.k, tg.sources FROM lastrow JOIN w ON w.id = lastrow.id AND w.seq = lastrow.seq JOIN tg ON tg.id = w.id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arrivals as a stream of three files in arrival order, merged batch by batch into a keyed table."""
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    rows = P.arrivals(spark, sf_dir).drop("ts")
    third = F.floor(F.col("seq") * 3 / (1 + F.lit(rows.agg(F.max("seq")).first()[0])))
    for i in range(3):
        rows.where(third == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    table = capture.LibraryTable(spark, f"{base}/library", ["value", "k"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    capture.run_upserts(stream, table, f"{base}/checkpoint").awaitTermination()
    return _joined(table.read(), "sources")


_EVENTS = """e AS (SELECT CAST(user_id AS VARCHAR) AS source, event_id AS seq, event_id % 4 <> 0 AS page, event_id // (100 * (1 + user_id % 40)) AS count, event_id % 211 <> 0 AS has_more, CAST(event_id % 3 AS VARCHAR) AS cursor FROM events)"""


@query(f"""WITH {_EVENTS}, a AS (SELECT *, page AND has_more AS more, row_number() OVER u AS rn, coalesce(max(CASE WHEN page THEN count END) OVER b, 0) AS before, last_value(CASE WHEN page AND has_more THEN cursor END IGNORE NULLS) OVER b AS mark
  FROM e WINDOW u AS (PARTITION BY source ORDER BY seq), b AS (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, more AND count > before AS grown, greatest(before, CASE WHEN page THEN count ELSE 0 END) AS now FROM a),
h AS (SELECT *, more AND NOT grown AND NOT coalesce(cursor = mark, false) AND NOT coalesce(bool_or(grown) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS fair FROM g),
m AS (SELECT *, grown OR (fair AND sum(CAST(fair AS INTEGER)) OVER (PARTITION BY source ORDER BY seq) <= 400) AS moved FROM h),
q AS (SELECT *, rn - coalesce(max(CASE WHEN moved THEN rn END) OVER (PARTITION BY source ORDER BY seq), 0) AS still FROM m),
c AS (SELECT *, CASE WHEN page AND NOT has_more THEN 'done' WHEN moved THEN 'scroll' WHEN still >= 8 THEN 'giveup' ELSE 'wait' END AS act FROM q),
z AS (SELECT *, CASE WHEN act = 'done' THEN 0 ELSE still END AS quiet_now, min(CASE WHEN act IN ('done', 'giveup') THEN rn END) OVER (PARTITION BY source) AS last FROM c),
y AS (SELECT source, seq, rn, x.act, x.quiet_now, x.now FROM (SELECT z.source, z.seq, z.rn, CASE WHEN z.rn > z.last THEN l ELSE {{'act': z.act, 'quiet_now': z.quiet_now, 'now': z.now}} END AS x
  FROM z LEFT JOIN (SELECT source, {{'act': act, 'quiet_now': quiet_now, 'now': now}} AS l FROM z WHERE rn = last) o ON o.source = z.source))
SELECT source, seq, act AS action, CASE WHEN act = 'wait' THEN least(1000 * CAST(2 ** (quiet_now - 1) AS BIGINT), 60000) END::BIGINT AS wait_ms, CASE act WHEN 'scroll' THEN 'scrolling' WHEN 'wait' THEN 'waiting' ELSE act END AS status,
  now::BIGINT AS captured, quiet_now::INTEGER AS quiet, CASE WHEN act = 'giveup' THEN '8 quiet events in a row after ' || CAST(now AS VARCHAR) || ' items, and no page said it was the last' END AS reason FROM y""")
def stream_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completion reducer over users' events as captures that resume, as a stream from files to files."""
    k, u = F.col("event_id"), F.col("user_id")
    base = f"{shared_root(spark)}/completion-{uuid.uuid4().hex}"
    events = P.read(spark, sf_dir, "events").select(
        u.cast("string").alias("source"), k.alias("seq"), F.when(k % 4 != 0, "page").otherwise("tick").alias("kind"), F.floor(k / (100 * (1 + u % 40))).alias("count"), (k % 211 != 0).alias("has_more"), (k % 3).cast("string").alias("cursor"),
    )
    events.write.parquet(f"{base}/in")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        out = capture.completion(spark.readStream.schema(events.schema).parquet(f"{base}/in"), resuming=True)
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


_LEDGER = """lg AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS account, event_id // 900 AS sweep, ['favorites', 'likes', 'posts', 'reposts'][event_id % 7 % 4 + 1] AS source, ['begun', 'done', 'giveup'][event_id % 3 + 1] AS event FROM events)"""


@query(f"""WITH {_LEDGER}, l AS (SELECT account, sweep, source, arg_max(event, n) AS event FROM lg GROUP BY 1, 2, 3),
w AS (SELECT account, sweep, count(*) FILTER (WHERE event <> 'begun') >= 4 AS ended FROM l GROUP BY 1, 2), s AS (SELECT account, max(sweep) AS sweep, arg_max(ended, sweep) AS ended FROM w GROUP BY 1),
b AS (SELECT s.account, s.sweep + CAST(ended AS INTEGER) AS sweep, f.place, f.source FROM s, (VALUES (0, 'favorites'), (1, 'likes'), (2, 'posts'), (3, 'reposts')) f(place, source)),
r AS (SELECT b.*, l.event, coalesce(p.event = 'giveup', false) AS again FROM b LEFT JOIN l ON l.account = b.account AND l.sweep = b.sweep AND l.source = b.source LEFT JOIN l p ON p.account = b.account AND p.sweep = b.sweep - 1 AND p.source = b.source),
o AS (SELECT account, sweep, min(source) FILTER (WHERE event = 'begun') AS open, arg_min(source, (NOT again, place)) FILTER (WHERE event IS NULL) AS first, bool_or(again) FILTER (WHERE event IS NULL) AS again FROM r GROUP BY 1, 2)
SELECT account, sweep::INTEGER AS sweep, CASE WHEN open IS NOT NULL THEN 'idle' WHEN first IS NOT NULL THEN 'capture' ELSE 'all_done' END AS action, CASE WHEN open IS NULL THEN first END AS source, coalesce(open IS NULL AND first IS NOT NULL AND again, false) AS resuming FROM o""")
def next_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's account captures next, by a ledger made of events."""
    k = F.col("event_id")
    ledger = P.read(spark, sf_dir, "events").select(
        k.alias("n"), F.col("user_id").cast("string").alias("account"), F.floor(k / 900).cast("int").alias("sweep"), P._pick(schemas.SOURCES, k % 7 % 4).alias("source"), P._pick(("begun", "done", "giveup"), k % 3).alias("event"), F.lit(0).cast("long").alias("captured"), k.alias("at"),
    )
    return sequencer.next_steps(ledger.select("account").distinct(), ledger, "start")


@query("""WITH u AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'https://x.test/api/user/collect/item_list/?c=1' WHEN 1 THEN 'https://x.test/api/favorite/item_list/' WHEN 2 THEN 'https://x.test/api/post/item_list/?a' WHEN 3 THEN 'https://x.test/api/repost/item_list/' WHEN 4 THEN 'https://x.test/api/mix/item_list/' ELSE 'https://x.test/api/other' END AS url FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'favorites' WHEN 1 THEN 'likes' WHEN 2 THEN 'posts' WHEN 3 THEN 'reposts' WHEN 4 THEN 'mix' END AS source FROM u""")
def source_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = ["https://x.test/api/user/collect/item_list/?c=1", "https://x.test/api/favorite/item_list/", "https://x.test/api/post/item_list/?a", "https://x.test/api/repost/item_list/", "https://x.test/api/mix/item_list/", "https://x.test/api/other"]
    return P.read(spark, sf_dir, "events").select("event_id", X.source_of_url(P._pick(urls, F.col("event_id") % 6)).alias("source"))


@query("""WITH v AS (SELECT event_id, ['true', 'false', '1', '0', 'False', NULL, 'no'][event_id % 7 + 1] AS raw FROM events)
SELECT event_id, NOT coalesce(raw IN ('false', '0'), false) AS has_more, coalesce(CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END, CASE WHEN event_id % 2 = 0 THEN 'm' || CAST(event_id AS VARCHAR) END) AS cursor FROM v""")
def page_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("1"), F.lit("0"), F.lit("False"), F.lit(None).cast("string"), F.lit("no")), (k % 7 + 1).cast("int"))
    return P.read(spark, sf_dir, "events").select("event_id", X.has_more(raw).alias("has_more"), X.cursor(F.when(k % 3 == 0, k), F.when(k % 2 == 0, F.concat(F.lit("m"), k))).alias("cursor"))


@query(f"""WITH {P.MENTIONS}, k AS (SELECT *, type || ':' || name_key AS key FROM mm), f AS (SELECT item_id, key, min(pos) AS pos FROM k GROUP BY 1, 2),
n AS (SELECT k.item_id, k.key, k.surface AS name, k.pos * 2 + CASE WHEN k.pos = f.pos THEN 9 ELSE 0 END AS o, k.pos <> f.pos AS use FROM k JOIN f ON f.item_id = k.item_id AND f.key = k.key UNION ALL SELECT item_id, key, alias, pos * 2 + 1, true FROM k),
d AS (SELECT item_id, key, name, min(o) AS o FROM n WHERE use GROUP BY 1, 2, 3)
SELECT f.item_id, f.key, f.pos, k.type, k.surface, coalesce((SELECT string_agg(name, '|' ORDER BY o) FROM d WHERE d.item_id = f.item_id AND d.key = f.key AND d.name <> k.surface), '') AS aliases FROM f JOIN k ON k.item_id = f.item_id AND k.pos = f.pos""")
def deduped_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(L.first_places(P.mentions(spark, sf_dir)), "aliases")


_INDEX = f"""{P.MENTIONS}, k AS (SELECT *, type || ':' || name_key AS key FROM mm), per AS (SELECT key, item_id, min(item_pos) AS item_pos, min(pos) AS pos FROM k GROUP BY 1, 2),
ids AS (SELECT key, string_agg(item_id, '|' ORDER BY item_pos, pos) AS item_ids FROM per GROUP BY key),
head AS (SELECT key, type, surface FROM (SELECT key, type, surface, row_number() OVER (PARTITION BY key ORDER BY item_pos, pos) AS rn FROM k) WHERE rn = 1)"""


@query(f"WITH {_INDEX} SELECT ids.key, head.type, head.surface, ids.item_ids FROM ids JOIN head ON head.key = ids.key")
def mention_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(L.mention_index(P.mentions(spark, sf_dir)), "item_ids")


@query(f"WITH {_INDEX} SELECT ids.key || ',' || head.type || ',' || head.surface || ',' || ids.item_ids AS value FROM ids JOIN head ON head.key = ids.key")
def mentions_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.mentions_csv(L.mention_index(P.mentions(spark, sf_dir)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analysed items."""
    k, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    none = F.array().cast("array<string>")
    mention = F.struct(P._pick(schemas.TYPES, k % 9).alias("type"), prio.alias("surface"))
    return P.read(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), k.alias("pos"), F.when(k % 3 == 0, F.array(F.lit("favorites"))).when(k % 3 == 1, F.array(F.lit("likes"), F.lit("favorites"))).otherwise(F.array(F.lit("posts"))).alias("sources"),
        F.concat(F.lit("order "), prio, F.when(k % 5 == 0, F.lit(', "rush"')).otherwise("")).alias("desc"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("createTime"),
        F.when(k % 7 != 0, F.concat(F.lit("c"), F.col("o_custkey"))).alias("author"), F.when(k % 2 == 0, F.concat(F.lit("https://x.test/"), k)).alias("url"),
        F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("hashtags"), F.lit("replay").alias("lane"),
        F.struct(F.array(mention).alias("mentions"), F.when(k % 2 == 0, F.array(F.struct(prio.alias("statement")))).otherwise(F.array().cast("array<struct<statement:string>>")).alias("claims")).alias("output"),
        F.struct(F.when(k % 3 != 0, k).alias("plays")).alias("stats"), F.lower("o_orderstatus").alias("status"), F.when(k % 6 != 0, F.concat(F.lit("cover"), k)).alias("cover"), F.col("o_totalprice").alias("price"),
    )


_ITEMS = f"""it AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS prio, 'order ' || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ', "rush"' ELSE '' END AS descr, epoch(o_orderdate)::BIGINT AS ct,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'c' || CAST(o_custkey AS VARCHAR) END AS author, CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.test/' || CAST(o_orderkey AS VARCHAR) END AS url,
  CASE o_orderkey % 3 WHEN 0 THEN ['favorites'] WHEN 1 THEN ['likes', 'favorites'] ELSE ['posts'] END AS src, CASE WHEN o_orderkey % 4 = 0 THEN 'a|b' ELSE '' END AS tags, {P._T}[CAST(o_orderkey % 9 AS INTEGER) + 1] AS type,
  CASE WHEN o_orderkey % 6 <> 0 THEN 'cover' || CAST(o_orderkey AS VARCHAR) END AS cover FROM orders)"""


@query(f"""WITH {_ITEMS} SELECT id || ',' || coalesce(url, '') || ',' || coalesce(author, '') || ',' || CASE WHEN k % 5 = 0 THEN '"' || replace(descr, '"', '""') || '"' ELSE descr END || ',' || tags || ',replay,' || type || ':' || prio || ',' || CASE WHEN k % 2 = 0 THEN prio ELSE '' END || ',' || CASE WHEN k % 3 <> 0 THEN CAST(k AS VARCHAR) ELSE '' END AS value FROM it""")
def items_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.items_csv(_items(spark, sf_dir))


@query(f"""WITH {_ITEMS}, m AS (SELECT type, prio, min(k) AS k FROM it GROUP BY 1, 2) SELECT 'items/' || id || '.md' AS path FROM it UNION ALL SELECT 'entities/' || type || '/' || prio || '.md' FROM m""")
def vault_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    rows = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.posexplode("output.mentions").alias("pos", "m")).select("item_id", "item_pos", "pos", "m.type", "m.surface")
    return sinks.vault(items, L.mention_index(rows)).select("path")


@query(f"WITH {_ITEMS} SELECT id FROM it WHERE lower(descr || ' ' || coalesce(author, '') || ' ' || replace(tags, '|', ' ')) LIKE '%urgent%' AND descr LIKE '%rush%'")
def search_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(_items(spark, sf_dir), "URGENT rush").select("id")


@query(f"WITH {_ITEMS} SELECT id, url FROM it WHERE url = 'https://x.test/42'")
def resolve_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve(_items(spark, sf_dir), "https://x.test/42").select("id", "url")


@query(f"WITH {_INDEX} SELECT ids.key, head.surface, len(string_split(ids.item_ids, '|'))::INTEGER AS items FROM ids JOIN head ON head.key = ids.key WHERE head.type = 'book'")
def list_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.list_by_type(L.mention_index(P.mentions(spark, sf_dir)), "book").select("key", "surface", F.size("item_ids").alias("items"))


@query(f"WITH {_ITEMS} SELECT id FROM it WHERE ct > (SELECT max(ct) FROM it) - 604800")
def this_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    last = items.agg(F.max("createTime")).first()[0]
    return L.this_week(items, F.lit(last)).select("id")


@query(f"WITH {_ITEMS}, t AS (SELECT id, unnest(src) AS tag FROM it) SELECT tag, count(*) AS items FROM t GROUP BY tag")
def collections_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collections(_items(spark, sf_dir))


@query(f"WITH {_ITEMS}, t AS (SELECT id, unnest(src) AS tag FROM it) SELECT x.tag AS a, y.tag AS b, count(*) AS items FROM t x JOIN t y ON x.id = y.id AND x.tag < y.tag GROUP BY 1, 2")
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tag_overlap(_items(spark, sf_dir))


@query(f"WITH {_ITEMS}, r AS (SELECT id, k % 3 = 0 AS s, row_number() OVER (PARTITION BY k % 3 = 0 ORDER BY k) AS rn FROM it) SELECT id, s AS in_stratum FROM r WHERE rn <= CASE WHEN s THEN 6 ELSE 5 END")
def stratified_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return L.head_by_stratum(items.select("id", "pos"), F.col("pos") % 3 == 0, [F.col("pos")], 11).select("id", "in_stratum")


@query(f"""WITH {_ITEMS}, r AS (SELECT *, epoch_ms(ct * 1000) AS t FROM it) SELECT id, strftime(t, '%Y-%m-%dT%H:%M:%S.000Z') AS created_at, CASE WHEN src[1] IN ('favorites', 'likes') THEN src[1] ELSE 'upload' END AS save_kind,
CASE type WHEN 'music_recording' THEN 'musicbrainz' WHEN 'place' THEN 'google_places' ELSE 'wikidata' END AS authority, left(trim(descr), 500) AS context FROM r""")
def export_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("output.mentions")[0]["type"]
    return _items(spark, sf_dir).select("id", X.iso_utc(F.col("createTime")).alias("created_at"), X.save_kind(F.col("sources")[0]).alias("save_kind"), X.authority(kind).alias("authority"), F.substring(F.trim("desc"), 1, 500).alias("context"))


def _open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the open contract made of orders; every tenth has a facet value that is not in the vocabulary."""
    k = F.col("pos")
    ev = F.array(F.struct(F.lit("VERBAL_TEXT").alias("channel"), F.lit("STATED").alias("assertion_mode"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("source_role"), F.lit("q").alias("quote"), F.lit(1.0).alias("t_start"), F.when(k % 2 == 0, 2.5).alias("t_end")))
    out = F.struct(
        F.array(F.struct(F.col("output.mentions")[0]["surface"].alias("surface"), F.col("output.mentions")[0]["type"].alias("type"), F.array().cast("array<string>").alias("aliases"), ev.alias("evidence"))).alias("mentions"), F.array(F.struct(F.lit("c").alias("surface"), ev.alias("evidence"))).alias("concepts"),
        F.array(F.struct(F.lit("topic").alias("facet"), F.when(k % 10 == 0, "nowhere").otherwise("food").alias("value"), ev.alias("evidence"))).alias("facets"), F.array(F.struct(F.lit("s").alias("statement"), ev.alias("evidence"))).alias("claims"),
        F.array().cast("array<struct<schemaOrgType:string,slots:array<struct<name:string,value:string>>,steps:array<struct<`order`:int,text:string>>,evidence:array<struct<channel:string,assertion_mode:string,confidence:double,source_role:string,quote:string,t_start:double,t_end:double>>>>").alias("structured"),
    )
    name = T.normalize_name(F.col("output.mentions")[0]["surface"])
    found = F.array(F.struct(F.col("output.mentions")[0]["type"].alias("type"), name.alias("name_key"), (k % 3 == 0).alias("resolved"), F.when(k % 3 == 0, "Q1").alias("id"), F.lit(0.9).alias("confidence")))
    rec = _items(spark, sf_dir).select(
        "id", "sources", "desc", "createTime", "author", F.lit(None).cast("string").alias("authorName"), "url", F.lit("https://x.test/v.mp4").alias("playUrl"), F.lit(None).cast("string").alias("subtitleUrl"), F.lit(False).alias("isSlideshow"),
        F.struct(F.lit("n").alias("name"), F.lit(None).cast("string").alias("author")).alias("music"), "hashtags", F.struct(F.col("stats.plays").alias("plays"), F.lit(None).cast("long").alias("likes"), F.lit(1).cast("long").alias("comments"), F.lit(2).cast("long").alias("shares")).alias("stats"),
        F.lit("2026-01-01T00:00:00.000Z").alias("updatedAt"), F.lit(None).cast("string").alias("posterRef"), F.lit("m").alias("model"), F.lit("p1").alias("promptVersion"), out.alias("output"), found.alias("groundings"), F.array().cast("array<string>").alias("regroundPending"),
    )
    ref = F.struct(F.lit("m0").alias("model"), F.lit("v").alias("version"), F.lit("p").alias("prompt"), F.lit("r").alias("run"))
    return sinks.open_items(rec, F.lit("2026-01-01T00:00:00.000Z"), ref)


@query(f"WITH {_ITEMS} SELECT count(*) FILTER (WHERE k % 10 <> 0) AS valid, count(*) FILTER (WHERE k % 10 = 0) AS invalid FROM it")
def open_contract_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_report(_open_items(spark, sf_dir))


@query(f"""WITH {_ITEMS} SELECT id, url AS permalink, '@' || author AS handle, CASE WHEN k % 5 = 0 THEN 'order ' || prio || ', "rush"' ELSE descr END AS body, CASE src[1] WHEN 'posts' THEN 'upload' ELSE src[1] END AS save_kind, CASE WHEN k % 3 <> 0 THEN k END AS views, 'rendition' AS asset_role,
  'named_entity concept claim facet' AS kinds, 't=1,2.5' AS span, CASE WHEN k % 2 = 0 THEN true ELSE false END AS has_span, type || ':' || prio AS mention, CASE WHEN k % 3 = 0 THEN 'Q1' END AS external_id, k % 3 <> 0 AS nil, 'STATED' AS mode, 'm' AS model FROM it""")
def open_item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the exported JSON: identity, creator, saves, assets, metrics, extractions in order, grounding, provenance."""
    v = F.try_parse_json("value")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    kinds = F.array_join(F.transform(get("$.extractions", "array<variant>"), lambda x: F.try_variant_get(x, "$.kind", "string")), " ")
    span = get("$.extractions[0].evidence[0].selector.value")
    return _open_items(spark, sf_dir).select("id", v.alias("v")).select(
        "id", get("$.identity.permalink").alias("permalink"), get("$.creator.handle").alias("handle"), get("$.body").alias("body"), get("$.saves[0].sources[0].kind").alias("save_kind"), get("$.metrics[0].views", "long").alias("views"), get("$.assets[0].role").alias("asset_role"),
        kinds.alias("kinds"), F.lit("t=1,2.5").alias("span"), (F.coalesce(span, F.lit("")) == "t=1,2.5").alias("has_span"), F.concat(get("$.extractions[0].type"), F.lit(":"), get("$.extractions[0].surface")).alias("mention"), get("$.extractions[0].grounding.externalId").alias("external_id"),
        get("$.extractions[0].grounding.nil", "boolean").alias("nil"), get("$.extractions[0].rollup.assertion_mode").alias("mode"), get("$.extractions[0].evidence[0].extractor_ref.model").alias("model"),
    )


@query(f"""WITH {P.JOBS}, r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 2 = 0) SELECT r.id, r.id AS "itemId", 'pending' AS status, 0 AS attempts, 1000::BIGINT AS "nextAttemptAt" FROM r WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE jobs."itemId" = r.id)""")
def enqueue_missing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "raw").otherwise("analyzed").alias("status"))
    return L.missing_jobs(records, P.jobs(spark, sf_dir), F.lit(1000)).drop("lastError")


@query(f"""WITH {P.JOBS} SELECT id, "itemId", CASE WHEN status IN ('analyzing', 'grounding') THEN 'pending' ELSE status END AS status, attempts, CASE WHEN status IN ('analyzing', 'grounding') THEN 500::BIGINT ELSE "nextAttemptAt" END AS "nextAttemptAt" FROM jobs""")
def revived_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.revived(P.jobs(spark, sf_dir), F.lit(500)).drop("lastError")


@query(f"""WITH {P.JOBS} SELECT id, attempts FROM jobs WHERE status = 'pending' AND "nextAttemptAt" <= 1000 ORDER BY id LIMIT 200""")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 200 are dispatched at once, by id: the cap is the feature."""
    return L.due(P.jobs(spark, sf_dir), F.lit(1000), 200).select("id", "attempts")


@query(f"""WITH {P.JOBS}, o AS (SELECT *, CAST("itemId" AS BIGINT) % 3 = 0 AS ok, CAST("itemId" AS BIGINT) % 5 = 0 AS rl FROM jobs WHERE status = 'pending'),
n AS (SELECT *, CASE WHEN ok THEN 'done' WHEN NOT rl AND attempts + 1 >= 5 THEN 'failed' ELSE 'pending' END AS st FROM o)
SELECT id, "itemId", st AS status, CASE WHEN ok THEN attempts ELSE attempts + 1 END::INTEGER AS attempts, CASE WHEN st = 'pending' THEN 5000 + round(least(1000 * pow(2, attempts), 60000) * 1.05::DOUBLE)::BIGINT ELSE "nextAttemptAt" END AS "nextAttemptAt", CASE WHEN NOT ok THEN 'boom' END AS "lastError" FROM n""")
def jobs_after_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("itemId").cast("long")
    ran = P.jobs(spark, sf_dir).where("status = 'pending'").withColumns({"ok": k % 3 == 0, "rateLimited": k % 5 == 0, "error": F.lit("boom")})
    return L.after_run(ran, F.lit(5000), F.lit(0.5))


@query(f"WITH {P.JOBS} SELECT status, count(*) AS jobs FROM jobs GROUP BY status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_counts(P.jobs(spark, sf_dir))


_POSTERS = f"{_ITEMS}, ps AS (SELECT id FROM it WHERE k % 5 = 1), fa AS (SELECT id, (k % 4)::INTEGER AS failures FROM it WHERE k % 2 = 1)"


def _posters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = _items(spark, sf_dir)
    return items, items.where("pos % 5 = 1").select("id"), items.where("pos % 2 = 1").select("id", (F.col("pos") % 4).cast("int").alias("failures"))


@query(f"WITH {_POSTERS} SELECT it.id FROM it LEFT JOIN ps ON ps.id = it.id LEFT JOIN fa ON fa.id = it.id WHERE cover IS NOT NULL AND ps.id IS NULL AND coalesce(failures, 0) < 3 ORDER BY k LIMIT 25")
def poster_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of 25: the cap is the feature."""
    return L.poster_work(*_posters(spark, sf_dir), 25).select("id")


@query(f"WITH {_POSTERS}, r AS (SELECT ps.id IS NOT NULL AS d, coalesce(failures, 0) >= 3 AS f FROM it LEFT JOIN ps ON ps.id = it.id LEFT JOIN fa ON fa.id = it.id WHERE cover IS NOT NULL) SELECT count(*) AS total, count(*) FILTER (WHERE d) AS done, count(*) FILTER (WHERE NOT d AND f) AS failed, count(*) FILTER (WHERE NOT d AND NOT f) AS remaining FROM r")
def poster_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.poster_progress(*_posters(spark, sf_dir))


@query("SELECT event_id AS seq FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS rn FROM events) WHERE rn > 60")
def tiles_to_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tiles_to_evict(P.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq")))


_SYNC = "lg AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id // 7 AS rev, 'd' || CAST(event_id % 4 AS VARCHAR) AS device_id, event_id % 9 = 0 AS deleted, event_id AS seq FROM events), lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rev DESC, device_id DESC) AS rn FROM lg) WHERE rn = 1)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return P.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.floor(e / 7).alias("rev"), F.concat(F.lit("d"), e % 4).alias("device_id"), (e % 9 == 0).alias("deleted"), e.alias("seq"))


@query(f"WITH {_SYNC} SELECT key, rev, device_id FROM lw WHERE NOT deleted")
def last_writer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return L.snapshot(L.last_writer(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))).select("key", "rev", "device_id")


@query(f"WITH {_SYNC} SELECT key, rev, seq FROM lg WHERE seq > 9000")
def incremental_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pull(_log(spark, sf_dir), 9000).select("key", "rev", "seq")


def _grounding(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mentions = linking.keyed(P.mentions(spark, sf_dir).select("item_id", "pos", "type", "surface"))
    handles = spark.createDataFrame([(t, "music" if t == "music_recording" else "general", 0) for t in schemas.TYPES if t != "place"], "type string, source string, priority int")
    part = P.read(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys")).where("p_name <> 'red bolt'")
    rows = part.select(F.explode(F.array(F.lit("music"), F.lit("general"))).alias("source"), F.col("p_name").alias("name_key"), F.posexplode("keys").alias("rank", "key")).select("source", "name_key", "rank", F.concat(F.lit("Q"), F.col("key")).alias("id"), F.col("name_key").alias("name"), ((F.col("key") * 13) % 120).cast("double").alias("score"))
    return mentions, handles, linking.candidate_lists(rows)


_KB = f"""{P.MENTIONS}, ky AS (SELECT DISTINCT type || ':' || name_key AS key, type, name_key FROM mm WHERE type <> 'place'),
cd AS (SELECT p_name, p_partkey AS pk, CAST((p_partkey * 13) % 120 AS DOUBLE) AS score, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part WHERE p_name <> 'red bolt'),
c5 AS (SELECT * FROM cd WHERE rn <= 5), cn AS (SELECT p_name, count(*) AS n, max(score) AS top FROM c5 GROUP BY 1), pk AS (SELECT p_name, min(rn) AS rn FROM c5 JOIN cn USING (p_name) WHERE score = top GROUP BY 1)
"""


@query(f"""WITH {_KB}, j AS (SELECT ky.key, ky.type, coalesce(n, 0)::INTEGER AS candidate_count, CASE WHEN top IS NOT NULL THEN least(1.0::DOUBLE, top / 100) END AS conf, pk.rn, c5.pk AS pid, ky.name_key FROM ky LEFT JOIN cn ON cn.p_name = ky.name_key LEFT JOIN pk ON pk.p_name = ky.name_key LEFT JOIN c5 ON c5.p_name = ky.name_key AND c5.rn = pk.rn)
SELECT key, type, coalesce(conf >= 0.5, false) AS resolved, CASE WHEN conf >= 0.5 THEN 'Q' || CAST(pid AS VARCHAR) END AS id, CASE WHEN conf >= 0.5 THEN CASE WHEN type = 'music_recording' THEN 'music' ELSE 'general' END END AS source, CASE WHEN conf >= 0.5 THEN name_key END AS name, coalesce(conf, 0.0::DOUBLE) AS confidence, candidate_count, CASE WHEN conf >= 0.5 THEN rn - 1 END::INTEGER AS selected_index FROM j""")
def grounded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.ground(*_grounding(spark, sf_dir))[0]


@query(f"WITH {P.MENTIONS} SELECT DISTINCT item_id, 'place' AS reground_pending FROM mm WHERE type = 'place'")
def reground_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(linking.ground(*_grounding(spark, sf_dir))[1], "reground_pending")


@query("""WITH a AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents), b AS (SELECT (SELECT list_distinct(string_split(lower(text), ' ')) FROM benchmark ORDER BY item_id LIMIT 1) AS w)
SELECT doc_id, len(list_intersect(a.w, b.w))::INTEGER AS common, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 9) AS jaccard, round(len(list_intersect(a.w, b.w)) / CAST(len(a.w) AS DOUBLE), 9) AS recall FROM a, b""")
def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word sets of documents against one benchmark item."""
    item = P.read(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    w = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    a, b = w(F.col("text")), w(F.lit(item))
    return rounded(P.read(spark, sf_dir, "documents").select("doc_id", F.size(F.array_intersect(a, b)).alias("common"), X.jaccard(a, b).alias("jaccard"), X.recall_of(a, b).alias("recall")), "jaccard", "recall")


_RX = {"google_api_key": r"AIza[0-9A-Za-z_\-]{35}", "openai_key": "sk-[A-Za-z0-9]{20,}", "aws_access_key": "AKIA[0-9A-Z]{16}", "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "localhost_url": r"https?://(localhost|127\.0\.0\.1)", "source_map": "sourceMappingURL=", "websocket_dev": r"ws://(localhost|127\.0\.0\.1)"}


@query("SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in _RX.items()) + ") AS kinds FROM documents WHERE " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _RX.values()))
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.read(spark, sf_dir, "documents").select("doc_id", pages.secrets_in(F.col("text")).alias("kinds")).where(F.size("kinds") > 0)
    return _joined(rows, "kinds")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '$.mood: unknown facet' WHEN o_orderkey % 3 = 0 THEN '$.topic: value ''' || lower(o_orderpriority) || ''' not in ''topic'' facet vocabulary' END AS error FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0""")
def facet_vocabulary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    m = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("mood"), F.lit("x"))).when(k % 3 == 0, F.create_map(F.lit("topic"), F.lower("o_orderpriority"))).otherwise(F.create_map(F.lit("topic"), F.lit("food")))
    rows = P.read(spark, sf_dir, "orders").select("o_orderkey", gates.facet_errors(m, "$").alias("e"))
    return rows.where(F.size("e") > 0).select("o_orderkey", F.col("e")[0].alias("error"))


@query("""WITH v AS (SELECT event_id, value / 10 AS s FROM events)
SELECT event_id, CASE WHEN s > 0 THEN array_to_string(list_transform(range(6), lambda i: printf('%.3f', round((i + 0.5::DOUBLE) * s / 6 * 1000) / 1000)), '|') ELSE '1.000' END AS times, round(least(2000 * pow(2, event_id % 8), 60000) * 1.15::DOUBLE)::BIGINT AS backoff_ms FROM v""")
def keyframes_and_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("value") / 10, F.col("event_id")
    return P.read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(X.keyframes(s), lambda t: F.format_string("%.3f", t)), "|").alias("times"), X.pacing_backoff(e % 8 + 1, F.lit(1.0)).alias("backoff_ms"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 6 AS c FROM orders) SELECT k, CASE c WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END::INTEGER AS index, CASE c WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS confidence FROM r""")
def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: plain, fenced, in prose, out of range, declined and broken."""
    replies = ['{"index": 2, "confidence": 0.5}', '```json\n{"index": 1, "confidence": 7}\n```', 'I pick {"index": 0, "confidence": "x"} here', '{"index": 9, "confidence": 1}', '{"index": null}', "[1, 2]"]
    choice = X.selection(P._pick(replies, F.col("o_orderkey") % 6), F.lit(3))
    return P.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), choice["index"].alias("index"), choice["confidence"].alias("confidence"))


@query("""WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
k AS (SELECT doc_id, pos, trim(regexp_replace(line, '<[^>]+>', '', 'g')) AS t FROM l WHERE line <> '' AND NOT regexp_matches(line, '^NOTE\\b|^WEBVTT|-->|^(?i:Kind|Language|Region|Style):')),
d AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k WHERE t <> '')
SELECT doc_id, string_agg(t, ' ' ORDER BY pos) FILTER (WHERE prev IS NULL OR prev <> t) AS transcript FROM d GROUP BY doc_id""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as captions, which have no notes or timings: lines that repeat the one before go."""
    return P.read(spark, sf_dir, "documents").select("doc_id", X.vtt_text(F.col("text")).alias("transcript")).where("transcript <> ''")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.read(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(P.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = P.read(spark, sf_dir, "nation").join(P.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
