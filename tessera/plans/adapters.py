"""The driver's tables in the shapes the operators take, in DataFrame form and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import align


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment made of orders: clusters are customers; keys decide types, traps, abstentions, errors and gaps."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select(
        c.cast("string").alias("item_id"), F.when(k % 19 != 0, k).alias("g"), F.when(k % 23 != 0, k).alias("p"),
        F.when(k % 3 == 0, "fuzzy").otherwise("exact").alias("t"), _pick(schemas.TYPES, k % 9).alias("gt"), F.when(k % 17 == 0, _pick(schemas.TYPES, (k + 1) % 9)).otherwise(_pick(schemas.TYPES, k % 9)).alias("pt"),
        F.when(k % 13 == 0, "NON_ENTITY").when(k % 11 == 0, "NIL_NO_ID").alias("nil"), F.lower("o_orderpriority").alias("authority"), c.cast("string").alias("id"),
        F.when(k % 7 == 0, (c + 1).cast("string")).otherwise(c.cast("string")).alias("pid"), (k % 5 != 0).alias("yes"), ((k * 7919) % 1000 / F.lit(1000.0)).alias("conf"),
    ).where("g is not null or p is not null")
    has_g, has_p = F.col("g").isNotNull(), F.col("p").isNotNull()
    both, known = has_g & has_p, has_g & F.col("nil").isNull()
    return align.with_bucket(rows.select(
        "item_id", "g", "p", F.when(both, F.col("t")).otherwise("none").alias("tier"), (both & (F.col("gt") == F.col("pt"))).alias("same_type"),
        F.when(has_g, F.col("gt")).alias("gold_type"), F.when(has_g, F.col("nil")).alias("gold_nil"), F.when(known, F.col("authority")).alias("gold_authority"), F.when(known, F.col("id")).alias("gold_id"),
        F.when(has_p, F.col("pt")).alias("pred_type"), F.when(has_p & F.col("yes"), F.col("authority")).alias("pred_authority"), F.when(has_p & F.col("yes"), F.col("pid")).alias("pred_id"), (has_p & F.col("yes")).alias("answered"), F.when(has_p & F.col("yes"), F.col("conf")).otherwise(0.0).alias("conf"),
    ))


_T = "[" + ", ".join(f"'{t}'" for t in schemas.TYPES) + "]"
LINKS = f"""
raw AS (SELECT CAST(o_custkey AS VARCHAR) AS item_id, o_orderkey AS k, o_custkey AS c, o_orderkey % 19 <> 0 AS has_g, o_orderkey % 23 <> 0 AS has_p, o_orderkey % 5 <> 0 AS yes,
  CASE WHEN o_orderkey % 13 = 0 THEN 'NON_ENTITY' WHEN o_orderkey % 11 = 0 THEN 'NIL_NO_ID' END AS nil, lower(o_orderpriority) AS authority,
  {_T}[CAST(o_orderkey % 9 AS INTEGER) + 1] AS gt, {_T}[CAST((o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) % 9 AS INTEGER) + 1] AS pt,
  CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS conf FROM orders),
al AS (SELECT item_id, CASE WHEN has_g THEN gt END AS gold_type, CASE WHEN has_p THEN pt END AS pred_type, CASE WHEN has_g THEN nil END AS gold_nil,
  CASE WHEN has_g AND nil IS NULL THEN authority END AS gold_authority, has_g AND nil IS NULL AS has_id, has_p AND yes AS answered, CASE WHEN has_p AND yes THEN conf ELSE 0 END AS conf,
  CASE WHEN has_g AND has_p THEN CASE WHEN k % 3 = 0 THEN 'fuzzy' ELSE 'exact' END ELSE 'none' END AS tier, has_g AND has_p AND gt = pt AS same_type,
  CASE WHEN NOT has_g THEN 'spurious' WHEN NOT has_p THEN CASE WHEN nil = 'NON_ENTITY' THEN 'trap_missed' ELSE 'missed' END WHEN nil = 'NON_ENTITY' THEN 'non_entity' ELSE 'pair' END AS bucket,
  has_g AND has_p AND nil IS NULL AND yes AND k % 7 <> 0 AS correct FROM raw WHERE has_g OR has_p)
"""


def facet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """axis, g, p: quality and toxicity labels against guesses from length and id; every ninth guess is missing."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    guess = lambda c: F.when(F.col("doc_id") % 9 == 0, "__missing__").otherwise(c)
    q = rows.select(F.lit("quality").alias("axis"), F.col("quality").cast("string").alias("g"), guess(F.when(F.col("n_chars") > 400, "1").otherwise("0")).alias("p"))
    return q.unionByName(rows.select(F.lit("toxic").alias("axis"), F.col("toxic").cast("string").alias("g"), guess(F.when(F.col("doc_id") % 8 == 0, "1").otherwise("0")).alias("p")))


FACET_LABELS = """
r AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
fl AS (SELECT 'quality' AS axis, CAST(quality AS VARCHAR) AS g, CASE WHEN doc_id % 9 = 0 THEN '__missing__' WHEN n_chars > 400 THEN '1' ELSE '0' END AS p FROM r
  UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), CASE WHEN doc_id % 9 = 0 THEN '__missing__' WHEN doc_id % 8 = 0 THEN '1' ELSE '0' END FROM r)
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): nations under regions, regions under one root, and customers' segments under two nations."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = n.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).unionByName(read(spark, sf_dir, "region").select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")))
    seg = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return edges.unionByName(seg.select(F.concat(F.lit("SEG_"), F.col("c_mktsegment"), F.lit("_"), F.col("c_custkey") % 7).alias("child"), F.col("n_name").alias("parent")).distinct())


HIERARCHY = """
edges(child, parent) AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region
  UNION SELECT 'SEG_' || c_mktsegment || '_' || CAST(c_custkey % 7 AS VARCHAR), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
up(id, ancestor) AS (SELECT child, parent FROM edges UNION SELECT up.id, e.parent FROM up JOIN edges e ON e.child = up.ancestor)
"""


def concept_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold (item_id, concept_id) and predictions (item_id, pos, concept_id, score) of orders by their customers' nations."""
    base = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nation = lambda i: F.concat(F.lit("NATION_"), i.cast("string"))
    gold = base.where("o_orderkey % 6 <> 0").select(F.col("o_custkey").cast("string").alias("item_id"), nation((F.col("c_nationkey") + F.col("o_orderkey") % 3) % 25).alias("concept_id"))
    pred = base.select(F.col("o_custkey").cast("string").alias("item_id"), F.col("o_orderkey").alias("pos"), nation((F.col("c_nationkey") + F.col("o_orderkey") % 4) % 25).alias("concept_id"), ((F.col("o_orderkey") * 31) % 100 / F.lit(100.0)).alias("score"))
    return gold, pred


CONCEPTS = """
cb AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS item_id, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey),
gold AS (SELECT item_id, 'NATION_' || CAST((n + k % 3) % 25 AS VARCHAR) AS concept_id FROM cb WHERE k % 6 <> 0),
ranked AS (SELECT item_id, 'NATION_' || CAST((n + k % 4) % 25 AS VARCHAR) AS concept_id,
  row_number() OVER (PARTITION BY item_id ORDER BY CAST((k * 31) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) DESC, k) AS rank FROM cb)
"""


def step_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order, g (line number) and p (rank of the ship date, ties equal) of every line."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return rows.select("l_orderkey", F.col("l_linenumber").alias("g"), F.rank().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate")).alias("p"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as item arrivals: id is the user, the tag the event type, seq the event; every 37th has no id."""
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 37 != 0, F.col("user_id").cast("string")).otherwise("").alias("id"), F.array("event_type").alias("sources"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.try_variant_get(v, "$.k", "long").alias("k"), F.col("ts").alias("ts"),
    )


ARRIVALS = """
ar AS (SELECT CASE WHEN event_id % 37 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS id, event_type AS tag, event_id AS seq,
  CASE WHEN event_id % 5 <> 0 THEN value END AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events)
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, item_pos, pos, type, surface and aliases: parts as mentions of the orders that have them."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("The  "), F.upper("p_name"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("@"), F.col("p_name"))).otherwise(F.col("p_name"))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_orderkey").alias("item_pos"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"),
        _pick(schemas.TYPES, F.col("p_size") % 9).alias("type"), name.alias("surface"), F.array("p_brand").alias("aliases"),
    ).distinct()


MENTIONS = f"""
mm AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS item_id, l_orderkey AS item_pos, l_linenumber * 1000000 + l_partkey AS pos, {_T}[CAST(p_size % 9 AS INTEGER) + 1] AS type,
  CASE l_linenumber % 3 WHEN 0 THEN 'The  ' || upper(p_name) WHEN 1 THEN '@' || p_name ELSE p_name END AS surface, p_brand AS alias, p_name AS name_key FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", F.when(k % 2 == 0, "analyzing").otherwise("grounding")).otherwise("done")
    return read(spark, sf_dir, "orders").where(k % 4 != 0).select(F.concat(F.lit("j"), k).alias("id"), k.cast("string").alias("itemId"), status.alias("status"), (k % 6).cast("int").alias("attempts"), ((k * 37) % 2000).alias("nextAttemptAt"), F.lit(None).cast("string").alias("lastError"))


JOBS = """
jobs AS (SELECT 'j' || CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS "itemId", CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'analyzing' ELSE 'grounding' END ELSE 'done' END AS status,
  CAST(o_orderkey % 6 AS INTEGER) AS attempts, (o_orderkey * 37) % 2000 AS "nextAttemptAt" FROM orders WHERE o_orderkey % 4 <> 0)
"""
