"""Page responses and archives as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import library


def envelopes(responses: DataFrame) -> DataFrame:
    """source, has_more, cursor and raw (array of variants) of responses (url, body); other urls and no-JSON go."""
    v = F.try_parse_json("body")
    parsed = responses.withColumns({"source": X.source_of_url(F.col("url")), "v": v}).where("source is not null and v is not null")
    more = F.coalesce(F.try_variant_get("v", "$.hasMore", "string"), F.try_variant_get("v", "$.has_more", "string"))
    at = X.cursor(*[F.try_variant_get("v", f"$.{k}", "string") for k in ("cursor", "maxCursor", "max_cursor")])
    items = F.coalesce(F.try_variant_get("v", "$.itemList", "array<variant>"), F.try_variant_get("v", "$.items", "array<variant>"), F.array().cast("array<variant>"))
    kept = [c for c in responses.columns if c not in ("body", "source")]
    return parsed.select(*kept, "source", X.has_more(more).alias("has_more"), at.alias("cursor"), items.alias("raw"))


def page_items(pages: DataFrame) -> DataFrame:
    """Library items of all pages, tagged with their page's source."""
    rows = pages.select("source", F.explode("raw").alias("raw"))
    return library.normalize_items(rows, F.col("source"))


def read_responses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of (url, body), as a batch or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("url string, body string").json(path)


def archive(spark: SparkSession, path: str, root: str = "saved_posts") -> DataFrame:
    """Saved entries of an account archive: permalink, saved_at, and the values of its labels as a map.

    A label value is its value, else its link; a label's own timestamp or title fills in for neither.
    """
    entry = "array<struct<timestamp:long,fbid:string,label_values:array<struct<label:string,value:string,href:string,timestamp_value:long,title:string>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"{root} {entry}").alias("d"))
    rows = doc.select(F.posexplode(f"d.{root}").alias("pos", "e"))
    values = F.transform(F.filter("e.label_values", lambda x: x["label"].isNotNull()), lambda x: F.struct(x["label"].alias("k"), F.coalesce(x["value"], x["href"], x["timestamp_value"].cast("string"), x["title"]).alias("v")))
    keys = F.array_distinct(F.transform(values, lambda x: x["k"]))
    labels = F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(values, lambda x: x["k"] == k), F.lit(1))["v"]))
    link = F.try_element_at(F.filter(F.transform("e.label_values", lambda x: x["href"]), lambda h: h.isNotNull()), F.lit(1))
    return rows.select("pos", F.coalesce(link, F.try_element_at(labels, F.lit("URL"))).alias("permalink"), F.timestamp_seconds("e.timestamp").alias("saved_at"), F.col("e.fbid").alias("fbid"), labels.alias("labels"))


def with_collections(saved: DataFrame, members: DataFrame) -> DataFrame:
    """saved entries with the names of their collections, joined by permalink; members: (permalink, collection)."""
    names = members.groupBy("permalink").agg(F.array_sort(F.collect_set("collection")).alias("collections"))
    return saved.join(names, "permalink", "left").withColumn("collections", F.coalesce("collections", F.array().cast("array<string>")))


def secrets_in(text: Column) -> Column:
    """Names of the kinds of secrets and development leftovers found in a text."""
    # Public patterns of credentials and development leftovers.
    kinds = {
        "google_api_key": r"AIza[0-9A-Za-z_\-]{35}",
        "openai_key": r"sk-[A-Za-z0-9]{20,}",
        "aws_access_key": r"AKIA[0-9A-Z]{16}",
        "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        "localhost_url": r"https?://(localhost|127\.0\.0\.1)",
        "source_map": r"sourceMappingURL=",
        "websocket_dev": r"ws://(localhost|127\.0\.0\.1)",
    }
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]))
