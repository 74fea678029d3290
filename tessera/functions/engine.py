"""The engine around the model: prompts, routing, response parsing, the runtime gate, and telemetry lines."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Settings
from tessera.functions import gates
from tessera.functions import scalars as X
from tessera.operators.ranges import running

# The prompt's version, the labels of its parts, and those of a progress line (below).
PROMPT_VERSION = "extract@v1"


def extractor_prompt(base: Column, desc: Column, hashtags: Column, author: Column, author_name: Column, music: Column, transcript: Column) -> Column:
    """The base prompt and what is known of the post; parts without content are left out."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    creator, text = F.coalesce(author_name, author), F.trim(F.coalesce(transcript, F.lit("")))
    lines = F.concat_ws(
        "\n", F.lit("CONTEXT:"), F.concat(F.lit("Caption: "), desc), F.when(F.size(hashtags) > 0, F.concat(F.lit("Hashtags: "), F.array_join(F.transform(hashtags, lambda t: F.concat(F.lit("#"), t)), " "))),
        F.when(~none(creator), F.concat(F.lit("Creator: "), creator)), F.when(~none(music["name"]), F.concat(F.lit("Music (post metadata): "), music["name"], F.when(none(music["author"]), "").otherwise(F.concat(F.lit(" — "), music["author"])))),
        F.when(text != "", F.concat(F.lit("Transcript:\n"), text)),
    )
    return F.concat(base, F.lit("\n\n"), lines)


def select_prompt(surface: Column, kind: Column, hints: Column, candidates: Column) -> Column:
    """Asks which of the candidates (struct with name, meta array) a mention means; hints is a map or null.

    The reply that `selection` reads is a JSON object with index (null to abstain) and confidence.
    """
    no_text = F.array().cast("array<string>")
    known = F.transform(F.map_entries(hints), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    option = lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.array_join(F.concat(F.array(c["name"]), F.coalesce(c["meta"], no_text)), "; "))
    parts = (
        F.lit("A post mentions something by name. Choose the entry below that it means."), F.concat(F.lit("Name: "), surface, F.lit(" ("), kind, F.lit(")")),
        F.when(F.size(F.coalesce(known, no_text)) > 0, F.concat(F.lit("What the post says about it:\n"), F.array_join(known, "\n"))),
        F.concat(F.lit("Entries:\n"), F.array_join(F.transform(candidates, option), "\n")),
        F.lit('Answer with one JSON object and nothing else: {"index": number of the entry, "confidence": number from 0 to 1}. If no entry clearly fits, the index is null.'),
    )
    return F.concat_ws("\n\n", *parts)


def hints(kind: Column, music_author: Column, desc: Column) -> Column:
    """Map of hints for a lookup: a song's artist, and the caption's first 500 characters; null without any."""
    artist = F.when((kind == "music_recording") & (F.coalesce(music_author, F.lit("")) != ""), music_author)
    text = F.trim(F.coalesce(desc, F.lit("")))
    entries = F.array_compact(F.array(F.when(artist.isNotNull(), F.struct(F.lit("artist"), artist)), F.when(text != "", F.struct(F.lit("context"), F.substring(text, 1, 500)))))
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def route(ingestion: Column, lane: Column, escalate: Column, has_subtitles: Column) -> Column:
    """native only on the managed lane, if configured or (escalating) without subtitles; else keyframes_vtt."""
    managed = lane == "managed"
    return F.when(managed & ((ingestion == "native") | (escalate & ~has_subtitles)), "native").otherwise("keyframes_vtt")


def lane_error(lane: Column, ingestion: Column, has_video: Column) -> Column:
    """Why a lane refuses without asking a model, or null."""
    return F.when((ingestion == "native") & (lane == "local"), "native_unsupported_local").when((ingestion == "native") & ~has_video, "media_fetch_failed")


def _one(check):
    """check as a function of one argument, whatever defaults it binds."""
    return lambda x: check(x)


def admitted(v: Column) -> Column:
    """The runtime gate: the five lists, element keys, types, axes and evidence; values of facets are not looked up."""
    lists = {"mentions": ("surface", "type", "aliases", "evidence"), "concepts": ("surface", "evidence"), "facets": ("facet", "value", "evidence"), "claims": ("statement", "evidence"), "structured": ("schemaOrgType", "slots", "steps", "evidence")}
    need = {"mentions": ("surface",), "concepts": ("surface",), "facets": ("value",), "claims": ("statement",), "structured": ("schemaOrgType",)}
    evidence_keys = F.array(*[F.lit(k) for k in ("channel", "source_role", "quote", "t_start", "t_end", "assertion_mode", "confidence")])

    def evident(x: Column) -> Column:
        ev = gates._items(x, "$.evidence")
        good = lambda e: (F.size(F.array_except(gates._keys(e), evidence_keys)) == 0) & F.coalesce(gates._text(e, "$.channel").isin(*schemas.CHANNELS) & gates._text(e, "$.assertion_mode").isin(*schemas.MODES) & F.try_variant_get(e, "$.confidence", "double").between(0, 1), F.lit(False))
        return (F.size(ev) > 0) & F.forall(ev, good)

    ok = F.coalesce(gates._is_object(v), F.lit(False))
    for k, keys in lists.items():
        def check(x: Column, k=k, keys=keys) -> Column:
            good = (F.size(F.array_except(gates._keys(x), F.array(*[F.lit(a) for a in keys]))) == 0) & evident(x)
            for f in need[k]:
                good &= F.coalesce(gates._is_text(x, f"$.{f}"), F.lit(False))
            if k == "mentions":
                good &= F.coalesce(gates._text(x, "$.type").isin(*schemas.TYPES), F.lit(False))
            if k == "facets":
                good &= F.coalesce(gates._text(x, "$.facet").isin(*schemas.FACETS), F.lit(False))
            return good
        ok &= F.coalesce(gates._is_array(v, f"$.{k}"), F.lit(False)) & F.forall(gates._items(v, f"$.{k}"), _one(check))
    return ok


def model_reply(response: Column) -> Column:
    """The text in a response of either lane (a variant), null if there is none."""
    return F.nullif(F.coalesce(F.try_variant_get(response, "$.candidates[0].content.parts[0].text", "string"), F.try_variant_get(response, "$.message.content", "string")), F.lit(""))


def reply_error(reply: Column, parsed: Column) -> Column:
    """empty_response, parse_fail or schema_invalid for a reply and what without_fences of it parses to; null if good."""
    return F.when(reply.isNull(), "empty_response").when(parsed.isNull(), "parse_fail").when(~admitted(parsed), "schema_invalid")


def parsed_reply(reply: Column) -> Column:
    return F.try_parse_json(X.without_fences(reply))


def heap_mb(used: Column) -> Column:
    return F.round(used / (1024 * 1024)).cast("long")


def hud_line(captured: Column, source: Column, has_more: Column, heap: Column, dom: Column, evicted: Column, state: Column) -> Column:
    """One line on a capture's progress."""
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit("⛏ "), s(captured), F.lit(" · "), F.coalesce(source, F.lit("—")), F.lit(" · more:"), F.when(has_more, "yes").when(~has_more, "no").otherwise("—"), F.lit(" · heap "), F.when(heap.isNull(), "—").otherwise(F.concat(s(heap), F.lit("MB"))),
        F.lit(" · dom "), s(dom), F.when(evicted.isNotNull(), F.concat(F.lit(" · evicted "), s(evicted))).otherwise(""), F.when(F.coalesce(state, F.lit("")) != "", F.concat(F.lit(" · "), state)).otherwise(""),
    )


def log_due(prev: Column, now: Column, interval: Column) -> Column:
    return now - prev >= interval


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; 0 and 0 without observations."""
    p, zz = X.ratio(hits, n), z * z
    mid, half = X.ratio(p + zz / (2 * n), 1 + zz / n), z * F.sqrt(F.greatest(X.ratio(p * (1 - p), n) + X.ratio(F.lit(zz), 4 * n * n), F.lit(0.0)))
    half = X.ratio(half, 1 + zz / n)
    return F.when(n > 0, mid - half).otherwise(0.0), F.when(n > 0, mid + half).otherwise(0.0)


def sample_size(p: Column, error: Column, z: float = 1.959963984540054) -> Column:
    return F.ceil(z * z * p * (1 - p) / (error * error)).cast("long")


def entity_key(kind: Column, name: Column) -> Column:
    """type::name in lower case, the name's other characters than a-z and 0-9 as single spaces."""
    k = F.when(F.coalesce(kind, F.lit("")) == "", "other").otherwise(kind)
    return F.concat(F.trim(F.lower(k)), F.lit("::"), F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")))


# --- requests ---

# Fixed value: keywords of a JSON schema that a managed model's response schema may not have.
_NO_KEYWORDS = ("additionalProperties", "$schema", "$id")


def response_schema(schema: object) -> object:
    """A JSON schema without the keywords that a response schema may not have, at any depth."""
    if isinstance(schema, dict):
        return {k: response_schema(v) for k, v in schema.items() if k not in _NO_KEYWORDS}
    return [response_schema(v) for v in schema] if isinstance(schema, list) else schema


def managed_request(prompt: Column, media: Column, schema: dict) -> Column:
    """JSON of a managed model's request: media (array of mimeType, data; may be null) before the prompt, temperature 0."""
    clip = F.array().cast("array<struct<inlineData:struct<mimeType:string,data:string>,text:string>>")
    parts = F.concat(F.coalesce(F.transform(media, lambda m: F.struct(F.struct(m["mimeType"].alias("mimeType"), m["data"].alias("data")).alias("inlineData"), F.lit(None).cast("string").alias("text"))), clip), F.array(F.struct(F.lit(None).cast("struct<mimeType:string,data:string>").alias("inlineData"), prompt.alias("text"))))
    contents = F.to_json(F.array(F.struct(parts.alias("parts"))))
    config = {"temperature": 0, "responseMimeType": "application/json", "responseSchema": response_schema(schema)}
    return F.concat(F.lit('{"contents":'), contents, F.lit(f',"generationConfig":{json.dumps(config, separators=(",", ":"))}}}'))


def local_request(model: Column, prompt: Column, images: Column, schema: dict) -> Column:
    """JSON of a local chat request: one user message with its images, the reply held to the schema, no streaming."""
    message = F.to_json(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"), F.coalesce(images, F.array().cast("array<string>")).alias("images"))))
    held = json.dumps(response_schema(schema), separators=(",", ":"))
    return F.concat(F.lit('{"model":'), F.to_json(F.array(model)).substr(F.lit(2), F.length(F.to_json(F.array(model))) - 2), F.lit(f',"stream":false,"format":{held},"messages":'), message, F.lit("}"))


def frames(is_slideshow: Column, play_url: Column, decoded: Column, cover: Column) -> Column:
    """The stills a model sees: the video's (decoded, if any), or for a slideshow, no video or an undecodable one the cover;
    none without a cover, which is a media_fetch_failed."""
    none = F.array().cast("array<string>")
    still = F.when(F.coalesce(cover, F.lit("")) != "", F.array(cover)).otherwise(none)
    video = ~F.coalesce(is_slideshow, F.lit(False)) & (F.coalesce(play_url, F.lit("")) != "") & (F.size(F.coalesce(decoded, none)) > 0)
    return F.when(video, decoded).otherwise(still)


def analyzed(items: DataFrame, config: Settings, model: Callable[[Column, Column], Column]) -> DataFrame:
    """items (has_subtitles, play_url, prompt, ...) with the lane and ingestion used, the reply of `model` (prompt and
    ingestion to text), error and output. The lane refuses before a model is asked; what was used is told, not guessed."""
    lane, ingestion = F.lit(config.engineLane), route(F.lit(config.ingestion), F.lit(config.engineLane), F.lit(config.escalateNative), F.col("has_subtitles"))
    rows = items.withColumns({"lane": lane, "ingestion": ingestion}).withColumn("refused", lane_error(F.col("lane"), F.col("ingestion"), F.coalesce("play_url", F.lit("")) != ""))
    rows = rows.withColumn("reply", F.when(F.col("refused").isNull(), model(F.col("prompt"), F.col("ingestion"))))
    rows = rows.withColumn("parsed", parsed_reply(F.col("reply")))
    error = F.coalesce("refused", reply_error(F.nullif(F.col("reply"), F.lit("")), F.col("parsed")))
    return rows.withColumn("error", error).withColumn("output", F.when(F.col("error").isNull(), F.col("parsed"))).drop("refused", "parsed")


def batched(prompts: DataFrame, size: int, order: str = "id") -> DataFrame:
    """batch, ids and one prompt for each `size` prompts (id, prompt) in order, every one under its number from 0."""
    rows = running(prompts, F.col(order)).withColumn("batch", F.floor(F.col("row_no") / size))
    of = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row_no", "id", "prompt"))).alias("p"))
    return of.select("batch", F.transform("p", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("### "), i.cast("string"), F.lit("\n"), x["prompt"])), "\n\n").alias("prompt"))


def replayed(clips: DataFrame, frozen: DataFrame) -> DataFrame:
    """clip_id, output and error of clips: the extractor's output of frozen results (clip_id, value as JSON) and nothing
    else of them, or why there is none."""
    rows = clips.join(frozen.select(F.col("clip_id").alias("frozen_id"), F.try_parse_json("value").alias("v")), clips["clip_id"] == F.col("frozen_id"), "left")
    output = F.try_variant_get("v", "$.extractorOutput", "variant")
    error = F.when(F.coalesce("clip_id", F.lit("")) == "", "no clip id").when(F.col("frozen_id").isNull(), "no frozen result").when(output.isNull(), "the frozen result has no output")
    return rows.select("clip_id", F.when(error.isNull(), F.to_json(output)).alias("output"), error.alias("error"))
