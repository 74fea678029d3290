"""Exports: CSV, JSON bundle, a vault of Markdown notes, and items of the open contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import gates
from tessera.functions import scalars as X
from tessera.functions import text as T

ITEM_COLUMNS = ("id", "url", "author", "caption", "hashtags", "lane", "mentions", "claims", "plays")


def items_csv(items: DataFrame) -> DataFrame:
    """One line an item (value), nine columns, lists joined by |; items have output (mentions, claims) and lane."""
    mentions = F.array_join(F.transform("output.mentions", lambda m: F.concat(m["type"], F.lit(":"), m["surface"])), "|")
    claims = F.array_join(F.transform("output.claims", lambda c: c["statement"]), "|")
    return items.select(X.csv_row([F.col("id"), F.col("url"), F.col("author"), F.col("desc"), F.array_join("hashtags", "|"), F.col("lane"), mentions, claims, F.col("stats.plays")]).alias("value"))


def mentions_csv(index: DataFrame) -> DataFrame:
    return index.select(X.csv_row([F.col("key"), F.col("type"), F.col("surface"), F.array_join("item_ids", "|")]).alias("value"))


def write_csv(lines: DataFrame, header: tuple[str, ...], path: str) -> None:
    """Part files of ready lines under path, each with the header, so that any of them can be read alone."""
    _with_header(lines, header).write.mode("overwrite").text(path)


def _with_header(lines: DataFrame, header: tuple[str, ...]) -> DataFrame:
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task
    head = F.lit(",".join(header))
    return lines.select(F.explode(F.when(first, F.array(head, F.col("value"))).otherwise(F.array("value"))).alias("value"))


def json_bundle(items: DataFrame, index: DataFrame) -> DataFrame:
    """The library as one JSON document, version 2; a sink for personal libraries, which fit one document."""
    a = items.agg(F.sort_array(F.collect_list(F.struct("id", F.to_json(F.struct("*")).alias("j")))).alias("i"))
    b = index.agg(F.sort_array(F.collect_list(F.struct("key", F.to_json(F.struct("*")).alias("j")))).alias("x"))
    both = a.crossJoin(b)
    return both.select(F.concat(F.lit('{"version":2,"items":['), F.array_join(F.transform("i", lambda r: r["j"]), ","), F.lit('],"mentionIndex":['), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]}")).alias("value"))


def json_text(c: Column) -> Column:
    """A JSON string literal, which is a YAML scalar too."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _note(items: DataFrame) -> DataFrame:
    heading = F.trim(F.regexp_replace(F.when(F.coalesce("desc", F.lit("")) != "", F.col("desc")).otherwise(F.col("id")), r"\s*\n+\s*", " "))
    bullet = lambda arr, f: F.coalesce(F.nullif(F.array_join(F.transform(arr, f), "\n"), F.lit("")), F.lit("_none_"))
    body = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), json_text(F.col("id"))), F.concat(F.lit("creator: "), json_text(F.col("author"))), F.concat(F.lit("url: "), json_text(F.col("url"))), F.concat(F.lit("lane: "), F.col("lane")), F.lit("---"),
        F.lit(""), F.concat(F.lit("# "), heading), F.array_join(F.transform("hashtags", lambda t: F.concat(F.lit("#"), t)), " "), F.lit(""), F.lit("## Takeaways"), bullet("output.claims", lambda c: F.concat(F.lit("- "), c["statement"])),
        F.lit(""), F.lit("## Mentions"), bullet("output.mentions", lambda m: F.concat(F.lit("- [["), X.file_name(m["surface"]), F.lit("]] ("), m["type"], F.lit(")"))), F.lit(""),
        F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("[Open on TikTok]("), F.col("url"), F.lit(")"))).otherwise(""),
    )
    return items.select(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("at"), F.concat(F.lit("items/"), X.file_name(F.col("id"))).alias("stem"), body.alias("content"), F.col("id").alias("own"))


def vault(items: DataFrame, index: DataFrame) -> DataFrame:
    """(path, content): a note an item (pos gives their order), a note an entity with links back. Of equal paths the first
    in order has it, the others get -2, -3 and so on; where such a name is another note's own, the key's digest makes
    it unique."""
    links = F.array_join(F.transform("item_ids", lambda i: F.concat(F.lit("- [["), i, F.lit("]]"))), "\n")
    content = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("type: "), F.col("type")), F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.col("surface")), F.lit(""), F.lit("## Saved in"), links)
    notes = index.select(F.lit(1).alias("kind"), F.xxhash64("key").alias("at"), F.concat(F.lit("entities/"), X.file_name(F.col("type")), F.lit("/"), X.file_name(F.col("surface"))).alias("stem"), content.alias("content"), F.col("key").alias("own"))
    rows = _note(items).unionByName(notes)
    n = F.row_number().over(Window.partitionBy("stem").orderBy("kind", "at"))
    name = F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""))
    rows = rows.withColumn("n", n).withColumn("name", name)
    taken = F.row_number().over(Window.partitionBy("name").orderBy("n", "kind", "at"))
    digest = F.concat(F.lit("-"), F.substring(F.sha2(F.concat(F.col("kind").cast("string"), F.lit(":"), F.col("own")), 256), 1, 12))
    return rows.withColumn("taken", taken).select(F.concat("name", F.when(F.col("taken") > 1, digest).otherwise(""), F.lit(".md")).alias("path"), "content")


def _evidence(ev: Column, ref: Column) -> Column:
    span = F.when(ev["t_start"].isNotNull() & ev["t_end"].isNotNull(), F.struct(F.lit("FragmentSelector").alias("type"), F.concat(F.lit("t="), X_number(ev["t_start"]), F.lit(","), X_number(ev["t_end"])).alias("value"), F.lit("http://www.w3.org/TR/media-frags/").alias("conformsTo")))
    return F.struct(ev["channel"].alias("channel"), ev["assertion_mode"].alias("assertion_mode"), ev["confidence"].alias("confidence"), ref.alias("extractor_ref"), ev["source_role"].alias("source_role"), ev["quote"].alias("quote"), span.alias("selector"))


def X_number(c: Column) -> Column:
    """A number as JavaScript writes it: whole numbers without a fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def open_items(records: DataFrame, now: Column, ref: Column) -> DataFrame:
    """(id, value): each record as JSON of the open contract.

    records: the item's columns, updatedAt, posterRef, model, promptVersion, output, groundings (array of type, name_key,
    resolved, id, confidence) and regroundPending. The model that made the analysis is named, not the one at export.
    Fields without a value are left out; a mention's grounding is left out while its type is pending or it has none.
    """
    own = F.when(F.col("output").isNotNull() & F.col("model").isNotNull(), F.struct(F.col("model").alias("model"), F.col("promptVersion").alias("version"), F.col("promptVersion").alias("prompt"), ref["run"].alias("run"))).otherwise(ref)
    ev = lambda x: F.transform(x["evidence"], lambda e: _evidence(e, own))
    records = records.withColumn("mention_names", T.normalize_names(F.transform("output.mentions", lambda m: m["surface"])))

    def grounding(m: Column, i: Column) -> Column:
        key = F.get("mention_names", i)
        hits = F.filter(F.coalesce("groundings", F.array().cast("array<struct<type:string,name_key:string,resolved:boolean,id:string,confidence:double>>")), lambda g: (g["type"] == m["type"]) & (g["name_key"] == key))
        g = F.try_element_at(hits, F.lit(-1))
        free = ~F.array_contains(F.coalesce("regroundPending", F.array().cast("array<string>")), m["type"])
        # a JSON null for the id of a NIL must be written, so grounding is made as text
        return F.when(free & g.isNotNull(), F.concat(F.lit('{"authority":"'), X.authority(m["type"]), F.lit('","externalId":'), F.when(g["resolved"], json_text(g["id"])).otherwise("null"), F.lit(',"nil":'), F.when(g["resolved"], "false").otherwise("true"), F.lit(',"grounding_confidence":'), X_number(g["confidence"]), F.lit("}")))

    def named(m: Column, i: Column) -> Column:
        base = F.to_json(F.struct(F.lit("named_entity").alias("kind"), m["surface"].alias("surface"), m["type"].alias("type"), ev(m).alias("evidence"), X.rollup(m["evidence"]).alias("rollup"), F.when(F.size(F.coalesce(m["aliases"], F.array().cast("array<string>"))) > 0, m["aliases"]).alias("aliases")))
        g = grounding(m, i)
        return F.when(g.isNotNull(), F.concat(F.regexp_replace(base, r"\}$", ""), F.lit(',"grounding":'), g, F.lit("}"))).otherwise(base)

    def slot(s: Column) -> Column:
        return F.struct(s["name"].alias("name"), F.struct(s["value"].alias("value"), now.alias("observedAt")).alias("value"))

    o = F.col("output")
    lists = [
        F.transform(o["mentions"], named),
        F.transform(o["concepts"], lambda c: F.to_json(F.struct(F.lit("concept").alias("kind"), c["surface"].alias("surface"), ev(c).alias("evidence")))),
        F.transform(o["claims"], lambda c: F.to_json(F.struct(F.lit("claim").alias("kind"), c["statement"].alias("statement"), ev(c).alias("evidence")))),
        F.transform(o["structured"], lambda s: F.to_json(F.struct(F.lit("structured_content").alias("kind"), s["schemaOrgType"].alias("schemaOrgType"), ev(s).alias("evidence"), F.transform(s["slots"], slot).alias("slots"), s["steps"].alias("steps")))),
        F.transform(o["facets"], lambda f: F.to_json(F.struct(F.lit("facet").alias("kind"), f["facet"].alias("facet"), f["value"].alias("value"), ev(f).alias("evidence")))),
    ]
    none = F.array().cast("array<string>")
    extractions = F.array_join(F.concat(*[F.coalesce(x, none) for x in lists]), ",")
    has_url = F.coalesce("url", F.lit("")) != ""
    asset = lambda c, mime, role, field="url": F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.when(F.lit(field == "url"), c).alias("url"), F.when(F.lit(field != "url"), c).alias("blobRef"), F.lit(mime).alias("declaredMime"), F.lit(role).alias("role")))
    assets = F.array_compact(F.array(asset(F.col("playUrl"), "video/mp4", "rendition"), asset(F.col("subtitleUrl"), "text/vtt", "sidecar"), asset(F.col("posterRef"), "image/jpeg", "rendition", "blobRef")))
    handle = F.concat(F.lit("@"), F.col("author"))
    creator = F.when(F.col("author").isNull(), F.lit('"UNKNOWN"')).otherwise(F.to_json(F.struct(handle.alias("handle"), F.col("authorName").alias("name"))))
    extras = F.concat(F.lit('{"musicName":'), F.when(F.col("music.name").isNull(), "null").otherwise(json_text(F.col("music.name"))), F.lit(',"musicAuthor":'), F.when(F.col("music.author").isNull(), "null").otherwise(json_text(F.col("music.author"))), F.lit(',"hashtags":'), F.to_json("hashtags"), F.lit("}"))
    main = F.to_json(F.struct(
        F.struct(F.lit("platform_verified").alias("status"), F.col("id").alias("canonicalId"), F.when(has_url, F.col("url")).alias("permalink"), F.when(has_url, F.lit("live")).alias("permalinkStatus")).alias("identity"),
        F.struct(F.lit("tiktok").alias("platform"), F.lit("tiktok/1.0").alias("profile")).alias("origin"),
        F.array(F.struct(F.transform("sources", lambda s: F.struct(X.save_kind(s).alias("kind"), now.alias("at"))).alias("sources"))).alias("saves"),
        F.struct(F.col("updatedAt").alias("value"), F.lit("inferred").alias("source"), F.lit(0.9).alias("confidence")).alias("capturedAt"),
        F.when(F.col("isSlideshow"), "photo").otherwise("video").alias("mediaKind"),
        F.array(F.struct(now.alias("observedAt"), F.col("stats.likes").alias("likes"), F.col("stats.shares").alias("shares"), F.col("stats.comments").alias("comments"), F.col("stats.plays").alias("views"))).alias("metrics"),
        F.when(F.col("createTime").isNotNull(), F.struct(X.iso_utc(F.col("createTime")).alias("value"), F.lit("platform").alias("source"), F.lit(1).alias("confidence"))).alias("createdAt"),
        F.when(F.coalesce("desc", F.lit("")) != "", F.col("desc")).alias("body"), F.when(F.size(assets) > 0, assets).alias("assets"),
    ))
    text = F.concat(F.regexp_replace(main, r"\}$", ""), F.lit(',"creator":'), creator, F.lit(',"platformExtras":'), extras, F.lit(',"extractions":['), extractions, F.lit("]}"))
    return records.select("id", text.alias("value"))


def export_report(items: DataFrame) -> DataFrame:
    """valid and invalid counts of exported items (id, value); nothing is withheld. Items without children, which are
    nearly all, are counted in the one pass that checks them; only if others are met are their posts gone through."""
    rows = items.select(F.col("id").alias("key"), F.try_parse_json("value").alias("v"))
    alone = F.col("v").isNull() | (F.size(gates._items(F.col("v"), "$.children")) == 0)
    checked = rows.select(alone.alias("alone"), F.when(alone, F.size(gates.item_errors(F.col("v"))) == 0).alias("good"))
    n = checked.agg(F.count_if(F.col("alone") & F.col("good")).alias("valid"), F.count_if(F.col("alone") & ~F.col("good")).alias("invalid"), F.count_if(~F.col("alone")).alias("families")).first()
    told = items.sparkSession.range(1).select(F.lit(n["valid"]).cast("long").alias("valid"), F.lit(n["invalid"]).cast("long").alias("invalid"))
    if not n["families"]:
        return told
    more = gates.gated(rows.where(~alone), gates.item_errors).select((F.size("errors") == 0).alias("good"))
    more = more.agg(F.count_if("good").alias("valid"), F.count_if(~F.col("good")).alias("invalid"))
    return told.unionByName(more).agg(F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"))


def open_bundle(items: DataFrame, now: str) -> DataFrame:
    """{schemaVersion, exportedAt, items} as one document, for personal libraries."""
    all_ = items.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda r: r["value"]).alias("v"))
    return all_.select(F.concat(F.lit(f'{{"schemaVersion":"{schemas.CONTRACT_VERSION}","exportedAt":"{now}","items":['), F.array_join("v", ","), F.lit("]}")).alias("value"))
