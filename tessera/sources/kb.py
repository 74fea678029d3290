"""Knowledge-base search answers as candidate rows, for the linking operators. Answers are stored JSON; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ("musicbrainz", "wikidata", "places")
LIMIT = 5


def query_text(source: Column, surface: Column, artist: Column, locale: Column) -> Column:
    """What each source is asked for a mention."""
    quoted = F.concat(F.lit('recording:"'), surface, F.lit('"'), F.when(F.coalesce(artist, F.lit("")) != "", F.concat(F.lit(' AND artist:"'), artist, F.lit('"'))).otherwise(""))
    placed = F.when(F.coalesce(locale, F.lit("")) != "", F.concat(surface, F.lit(", "), locale)).otherwise(surface)
    return F.when(source == "musicbrainz", quoted).when(source == "places", placed).otherwise(surface)


def candidates(answers: DataFrame) -> DataFrame:
    """Rows (source, name_key, rank, id, name, score, meta) of answers (source, name_key, body), provider order kept.

    Entries without an id or a name go; five at most are kept, by which the sources are asked as well.
    """
    v = F.try_parse_json("body")
    path = {"musicbrainz": "$.recordings", "wikidata": "$.search", "places": "$.places"}
    lists = F.coalesce(*[F.when(F.col("source") == s, F.try_variant_get(v, p, "array<variant>")) for s, p in path.items()], F.array().cast("array<variant>"))
    rows = answers.select("source", "name_key", F.posexplode(lists).alias("at", "e"))
    g = lambda p, t="string": F.try_variant_get("e", p, t)
    name = F.when(F.col("source") == "musicbrainz", g("$.title")).when(F.col("source") == "wikidata", g("$.label")).otherwise(g("$.displayName.text"))
    credits = F.array_join(F.filter(F.transform(F.coalesce(g('$["artist-credit"]', "array<variant>"), F.array().cast("array<variant>")), lambda a: F.try_variant_get(a, "$.name", "string")), lambda n: n.isNotNull() & (n != "")), ", ")
    meta = F.nullif(F.when(F.col("source") == "musicbrainz", credits).when(F.col("source") == "wikidata", g("$.description")), F.lit(""))
    good = rows.select("source", "name_key", "at", g("$.id").alias("id"), name.alias("name"), g("$.score", "double").alias("score"), meta.alias("meta")).where("id <> '' and name <> ''")
    lists = good.groupBy("source", "name_key").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "id", "name", "score", "meta"))), 1, LIMIT).alias("c"))
    return lists.select("source", "name_key", F.posexplode("c").alias("rank", "c")).select("source", "name_key", "rank", "c.id", "c.name", "c.score", "c.meta")


def handles(places_key: str | None = None) -> list[tuple[str, str, int]]:
    """(type, source, priority) of the sources that may be asked; places only with a key."""
    from tessera import schemas

    rows = [(t, "musicbrainz" if t == "music_recording" else "wikidata", 0) for t in schemas.TYPES if t != "place"]
    return rows + ([("place", "places", 0)] if places_key else [])


def replay_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """clip, key and problem of each expectation (clip, type, surface, externalId, nil) that the groundings (clip, type,
    surface, resolved, id) do not meet; a grounding that nobody expected is one too."""
    e = expected.select("clip", F.concat_ws(":", "type", "surface").alias("key"), F.col("externalId").alias("want"), (~F.col("nil")).alias("yes"), F.lit(True).alias("expected"))
    a = actual.select("clip", F.concat_ws(":", "type", "surface").alias("key"), "resolved", "id", F.lit(True).alias("there"))
    both = e.join(a, ["clip", "key"], "full_outer")
    problem = (
        F.when(F.col("there").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("resolved") != F.col("yes"), "resolved differs")
        .when(~F.col("id").eqNullSafe(F.col("want")), "id differs").when(F.col("yes") & F.col("id").isNull(), "no id").when(~F.col("yes") & F.col("id").isNotNull(), "id of a NIL")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("clip", "key", "problem")


def media(spark, path: str, most: int = 18 * 1024 * 1024) -> DataFrame:
    """Media files (path, length, content) of at most `most` bytes; larger ones have no content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))


def dump_capture(items: DataFrame, complete: bool, path: str) -> None:
    """Raw capture as JSON, complete and incomplete runs apart."""
    items.withColumn("status", F.lit("complete" if complete else "incomplete")).write.mode("append").partitionBy("status").json(path)
