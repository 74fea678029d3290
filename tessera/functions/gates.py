"""Admission gates: columns of error texts, empty if a record is admitted. Records are variants, so absent, null and
mistyped are told apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas

_NONE = "array<string>"


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it, also within a function of elements."""
    return F.get(F.transform(F.array(value), body), 0)


def _is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def _is_array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def _is_text(v: Column, path: str) -> Column:
    """A string, and not a number or anything else that would pass for one: its JSON begins with a quotation mark."""
    return F.coalesce(F.substring(F.to_json(F.try_variant_get(v, path, "variant")), 1, 1) == '"', F.lit(False))


def _is_null(v: Column, path: str) -> Column:
    """Null or absent."""
    return F.is_variant_null(F.coalesce(F.try_variant_get(v, path, "variant"), F.parse_json(F.lit("null"))))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _keys(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast(_NONE))


def _all(*checks: tuple[Column, str]) -> Column:
    """Texts of the checks that do not hold; an undecided check does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(msg)) for ok, msg in checks]))


def _unknown(v: Column, path: str, allowed: Iterable[str]) -> Column:
    return F.transform(F.array_except(_keys(v, path), F.array(*[F.lit(a) for a in allowed])), lambda k: F.concat(F.lit(f"{path}: unknown property "), k))


def _each(items: Column, check, path: str) -> Column:
    """Errors of all elements, with their place in front."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(check(x), lambda e: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]: "), e))))


def _optional(v: Column, path: str, allowed: Iterable[str]) -> Column:
    """Absent or one of the allowed texts."""
    return F.try_variant_get(v, path, "variant").isNull() | _text(v, path).isin(*allowed)


def facet_errors(facets: Column, prefix: str) -> Column:
    """Errors of a map of axis to value: an unknown axis, or a value outside the axis's vocabulary."""
    known = F.create_map(*[x for a, vs in schemas.FACETS.items() for x in (F.lit(a), F.array(*[F.lit(v) for v in vs]))])
    def check(e: Column) -> Column:
        values = F.try_element_at(known, e["key"])
        return F.when(values.isNull(), F.concat(F.lit(f"{prefix}."), e["key"], F.lit(": unknown facet"))).when(
            ~F.coalesce(F.array_contains(values, e["value"]), F.lit(False)), F.concat(F.lit(f"{prefix}."), e["key"], F.lit(": value '"), F.coalesce(e["value"], F.lit("null")), F.lit("' not in '"), e["key"], F.lit("' facet vocabulary"))
        )
    return F.array_compact(F.transform(F.coalesce(F.map_entries(facets), F.array().cast("array<struct<key:string,value:string>>")), check))


def _facets(v: Column) -> Column:
    return facet_errors(F.try_variant_get(v, "$.facets", "map<string,string>"), "$.facets")


def conform(v: Column, spec: dict | str, at: str = "$") -> Column:
    """Errors of the value at a path against a specification; an absent value has none (its object asks for it).

    Specifications: text, boolean, number, integer or anything; {"of": [values]}; {"from": a, "to": b, "whole": bool};
    {"each": spec} for arrays; {"keys": {name: spec}, "needs": [names]} for objects, which are closed; and
    {"texts": True} for objects of texts. "null": True admits null.
    """
    here = F.try_variant_get(v, at, "variant")
    there = here.isNotNull() & ~_is_null(v, at) if isinstance(spec, dict) and spec.get("null") else here.isNotNull()
    none = F.array().cast(_NONE)
    if spec == "anything":
        return none
    told = lambda ok, msg: F.when(there & ~F.coalesce(ok, F.lit(False)), F.array(F.lit(f"{at}: {msg}"))).otherwise(none)
    begins = F.substring(F.to_json(here), 1, 1)
    number = begins.rlike("[-0-9]")
    if spec == "text":
        return told(begins == '"', "a text is expected")
    if spec == "boolean":
        return told(begins.isin("t", "f"), "true or false is expected")
    if spec == "number":
        return told(number, "a number is expected")
    value = F.try_variant_get(v, at, "double")
    if spec == "integer":
        return told(number & (value == F.floor(value)), "a whole number is expected")
    if "of" in spec:
        return told((begins == '"') & _text(v, at).isin(*spec["of"]), f"not one of {', '.join(spec['of'])}")
    if "from" in spec:
        whole = value == F.floor(value) if spec.get("whole") else F.lit(True)
        return told(number & whole & value.between(spec["from"], spec["to"]), f"a number from {spec['from']} to {spec['to']} is expected")
    if "each" in spec:
        inner = F.transform(_items(v, at), lambda x, i: F.transform(conform(x, spec["each"]), lambda e: F.concat(F.lit(f"{at}["), i.cast("string"), F.lit("]"), F.substring(e, 2, 1 << 20))))
        return F.concat(told(_is_array(v, at), "an array is expected"), F.flatten(inner))
    is_object = _is_object(v, at)
    if "texts" in spec:
        texts = F.map_values(F.try_variant_get(v, at, "map<string,variant>"))
        return told(is_object & F.forall(texts, lambda x: F.substring(F.to_json(x), 1, 1) == '"'), "an object of texts is expected")
    needs = [F.when(is_object & F.try_variant_get(v, f"{at}.{k}", "variant").isNull(), F.lit(f"{at}.{k}: required")) for k in spec.get("needs", ())]
    return F.concat(told(is_object, "an object is expected"), F.array_compact(F.array(*needs)) if needs else none, _unknown(v, at, spec["keys"]), *[conform(v, own, f"{at}.{k}") for k, own in spec["keys"].items()])


def ordered(errors: Column) -> Column:
    """Errors by path, numbers in it as numbers, then by message."""
    def key(e: Column) -> Column:
        path = F.split(e, ": ", 2)[0]
        for digits in range(1, 6):
            path = F.regexp_replace(path, rf"\[(\d{{{digits}}})\]", "[" + "0" * (6 - digits) + "$1]")
        return path

    def sorted_(found: Column) -> Column:
        by = F.array_sort(F.transform(found, lambda e: F.struct(key(e).alias("path"), e.alias("e"))))
        return F.when(F.size(found) > 1, F.transform(by, lambda x: x["e"])).otherwise(found)

    return let(errors, sorted_)


# What gold and prediction records hold.
_STRUCTURED = {"each": {"keys": {"schemaOrgType": "text", "slots": {"each": {"keys": {"name": "text", "value": "anything"}, "needs": ["name", "value"]}}, "steps": {"each": {"keys": {"order": "integer", "text": "text"}, "needs": ["order", "text"]}}}, "needs": ["schemaOrgType"]}}
GOLD = {
    "keys": {
        "item_id": "text",
        "strata": {"keys": {"has_vtt": "boolean", "is_slideshow": "boolean", "duration_tercile": {"from": 1, "to": 3, "whole": True}}},
        "mentions": {
            "each": {
                "keys": {
                    "mention_id": "text", "surface": "text", "aliases": {"each": "text"}, "type": {"of": schemas.TYPES},
                    "gold_id": {"keys": {"authority": "text", "id": "text"}, "needs": ["authority", "id"], "null": True}, "nil": {"of": ["NIL_NO_ID", "NON_ENTITY"], "null": True}, "failed_queries": {"each": "text"},
                    "kb_snapshot": {"keys": {"authority": "text", "retrieved": "text"}, "needs": ["authority", "retrieved"]}, "hard_case": "boolean",
                    "verification": {"keys": {"name": "text", "address": "text", "lat": "number", "lng": "number", "url": "text"}}, "notes": "text",
                },
                "needs": ["mention_id", "surface", "type"],
            },
        },
        "concepts": {"each": {"keys": {"concept_id": "text", "authority": "text", "label": "text"}, "needs": ["concept_id"]}},
        "facets": {"texts": True},
        "structured": _STRUCTURED,
        "claims": {"each": {"keys": {"claim_id": "text", "statement": "text"}, "needs": ["claim_id", "statement"]}},
    },
    "needs": ["item_id"],
}
PRED = {
    "keys": {
        "item_id": "text",
        "mentions": {
            "each": {
                "keys": {
                    "surface": "text", "type": {"of": schemas.TYPES},
                    "grounding": {"keys": {"authority": "text", "externalId": "anything", "nil": "boolean", "grounding_confidence": {"from": 0, "to": 1}}, "needs": ["authority", "externalId", "nil", "grounding_confidence"]},
                },
                "needs": ["surface", "type"],
            },
        },
        "concepts": {"each": {"keys": {"concept_id": "text", "authority": "text", "score": {"from": 0, "to": 1}}, "needs": ["concept_id"]}},
        "facets": {"texts": True},
        "structured": _STRUCTURED,
        "claims": {"each": {"keys": {"statement": "text"}, "needs": ["statement"]}},
    },
    "needs": ["item_id"],
}


def _one_label(m: Column) -> Column:
    """A mention has an id or a reason why it has none, and for one that was searched in vain the queries."""
    linked, nil = _is_object(m, "$.gold_id"), _text(m, "$.nil")
    searched = F.size(_items(m, "$.failed_queries")) > 0
    return _all((linked != nil.isNotNull(), "exactly one of gold_id and nil is required"), (F.coalesce(nil != "NIL_NO_ID", F.lit(True)) | searched, "NIL_NO_ID needs failed_queries"))


def _id_by_nil(m: Column) -> Column:
    nil = F.try_variant_get(m, "$.grounding.nil", "boolean")
    ok = F.when(nil, _is_null(m, "$.grounding.externalId")).otherwise(_is_text(m, "$.grounding.externalId"))
    return _all((nil.isNull() | ok, "externalId is a string exactly if nil is false"))


def gold_errors(v: Column) -> Column:
    return ordered(F.concat(conform(v, GOLD), _each(_items(v, "$.mentions"), _one_label, "$.mentions"), _facets(v)))


def pred_errors(v: Column) -> Column:
    return ordered(F.concat(conform(v, PRED), _each(_items(v, "$.mentions"), _id_by_nil, "$.mentions"), _facets(v)))


def _evidence(e: Column) -> Column:
    return _all(
        (_text(e, "$.channel").isin(*schemas.CHANNELS), "channel is not one of the six"), (_text(e, "$.assertion_mode").isin(*schemas.MODES), "assertion_mode is not one of the four"),
        (F.try_variant_get(e, "$.confidence", "double").between(0, 1), "confidence is from 0 to 1"),
    )


def _evident(x: Column) -> Column:
    return let(_items(x, "$.evidence"), lambda ev: F.concat(_all((F.size(ev) > 0, "evidence is required")), _each(ev, _evidence, "evidence")))


_EXTRACTIONS = {
    "named_entity": ("surface", "type"),
    "concept": ("surface",),
    "claim": ("statement",),
    "structured_content": ("schemaOrgType",),
    "facet": ("facet", "value"),
}


def extraction_errors(x: Column) -> Column:
    def of_kind(kind: Column) -> Column:
        """What an extraction of its kind must have, and no other kind's checks."""
        typed = (_text(x, "$.type").isin(*schemas.TYPES), "type is not one of the nine")
        out = F.array(F.lit("kind is not one of the five"))
        for k, fs in _EXTRACTIONS.items():
            own = _all(*([typed] if k == "named_entity" else []), *[(_is_text(x, f"$.{f}"), f"{f} is required") for f in fs])
            if k == "facet":
                pair = F.when(_text(x, "$.facet").isNotNull() & _text(x, "$.value").isNotNull(), F.create_map(F.coalesce(_text(x, "$.facet"), F.lit("")), _text(x, "$.value")))
                own = F.concat(own, facet_errors(pair, "$"))
            out = F.when(F.coalesce(kind == k, F.lit(False)), own).otherwise(out)
        return out

    return F.concat(let(_text(x, "$.kind"), of_kind), _evident(x))


def extractor_output_errors(v: Column) -> Column:
    """The model's output: five arrays, evidence everywhere, and no ids: unknown keys are errors."""
    lists = {"mentions": ("surface", "type", "aliases", "evidence"), "concepts": ("surface", "evidence"), "facets": ("facet", "value", "evidence"), "claims": ("statement", "evidence"), "structured": ("schemaOrgType", "slots", "steps", "evidence")}
    required = {"mentions": ("surface",), "concepts": ("surface",), "facets": ("facet", "value"), "claims": ("statement",), "structured": ("schemaOrgType",)}
    out = [_all((_is_object(v), "$: not an object"), *[(_is_array(v, f"$.{k}"), f"$.{k}: an array is required") for k in lists]), _unknown(v, "$", lists)]
    for k, keys in lists.items():
        def check(x: Column, keys=keys, k=k) -> Column:
            typed = [(_text(x, "$.type").isin(*schemas.TYPES), "type is not one of the nine")] if k == "mentions" else []
            return F.concat(_all(*[(_is_text(x, f"$.{f}"), f"{f} is required") for f in required[k]], *typed), _unknown(x, "$", keys), _evident(x))
        out.append(_each(_items(v, f"$.{k}"), check, f"$.{k}"))
    pairs = F.filter(F.transform(_items(v, "$.facets"), lambda f: F.struct(_text(f, "$.facet").alias("key"), _text(f, "$.value").alias("value"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    # assignments may repeat an axis, so they are checked one by one and not as a map
    out.append(F.flatten(F.transform(pairs, lambda e: facet_errors(F.map_from_arrays(F.array(e["key"]), F.array(e["value"])), "$.facets"))))
    return F.concat(*out)


_ITEM_KEYS = (
    "identity", "saves", "origin", "creator", "createdAt", "capturedAt", "captureStatus", "lastCheckedAt", "title", "body", "mediaKind", "contentForm", "assets", "timeline", "interactive",
    "contentCredentials", "children", "collections", "references", "depicts", "workRef", "versionRef", "versions", "lifecycle", "captureFidelity", "status", "statusObservedAt", "scope",
    "visibility", "gates", "metrics", "platformExtras", "extractions",
)


def _handle(v: Column) -> Column:
    return F.coalesce(_text(v, "$.identity.permalink"), _text(v, "$.identity.canonicalId"), _text(v, "$.identity.contentHash")).isNotNull()


def _dates(v: Column) -> Column:
    sources = F.flatten(F.transform(_items(v, "$.saves"), lambda s: _items(s, "$.sources")))
    return F.array_compact(F.transform(sources, lambda s: _text(s, "$.at")))


def item_errors(v: Column) -> Column:
    """Admission of one post: a handle and a dated save; closed keys; known kinds; extractions; children that are posts
    (which `gated` admits in their turn)."""
    saves = _each(_items(v, "$.saves"), lambda s: F.concat(_all((F.size(_items(s, "$.sources")) > 0, "sources is required")), _each(_items(s, "$.sources"), lambda x: _all((_text(x, "$.kind").isin(*schemas.SAVE_KINDS), "kind is not known"), (_text(x, "$.at").isNotNull(), "at is required")), "sources")), "$.saves")
    media = _is_null(v, "$.mediaKind") | _text(v, "$.mediaKind").isin(*schemas.MEDIA_KINDS)
    errors = F.concat(
        _all((_is_object(v), "$: not an object"), (_text(v, "$.identity.status").isin(*schemas.IDENTITY_STATUSES), "$.identity.status: not known"), (_handle(v), "$.identity: a handle is required"), (F.size(_items(v, "$.saves")) > 0, "$.saves: a save is required"), (media, "$.mediaKind: not known")),
        _unknown(v, "$", _ITEM_KEYS), saves, _each(_items(v, "$.extractions"), extraction_errors, "$.extractions"), _each(_items(v, "$.children"), lambda c: _all((_is_object(c, "$.post"), "post is required")), "$.children"),
    )
    return ordered(errors)


def posts(items: DataFrame) -> DataFrame:
    """Every post of items (key, v), the items' own and their children's down to the last: key, path and v, level by level."""
    level = items.select("key", F.lit("$").alias("path"), "v")
    out = level
    while True:
        level = level.select("key", "path", F.posexplode(_items(F.col("v"), "$.children")).alias("i", "c"))
        level = level.select("key", F.concat("path", F.lit(".children["), F.col("i").cast("string"), F.lit("].post")).alias("path"), F.try_variant_get("c", "$.post", "variant").alias("v")).where("v is not null")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def gated(items: DataFrame, gate: Callable[[Column], Column]) -> DataFrame:
    """key and errors of items (key, v), of all their posts, each checked once."""
    checked = posts(items).select("key", "path", F.transform(gate(F.col("v")), lambda e: F.when(e.startswith("$"), F.substring(e, 2, 1 << 20)).otherwise(F.concat(F.lit(": "), e))).alias("errors"))
    found = checked.select("key", F.transform("errors", lambda e: F.concat(F.col("path"), e)).alias("errors"))
    return found.groupBy("key").agg(F.flatten(F.collect_list("errors")).alias("errors")).select("key", ordered(F.col("errors")).alias("errors"))


def shape_errors(v: Column, profile: str | None = None) -> Column:
    """The graph shapes as predicates: handle, dated save, media kind, and of all extractions evidence, mode and channel.

    A profile tightens the base for items of its platform and is always checked together with it.
    """
    def extraction(x: Column) -> Column:
        ev = _items(x, "$.evidence")
        return _all((F.size(ev) > 0, "evidence is required"), (F.forall(ev, lambda e: F.coalesce(_text(e, "$.assertion_mode").isin(*schemas.MODES), F.lit(True))), "assertion_mode is not one of the four"), (F.forall(ev, lambda e: F.coalesce(_text(e, "$.channel").isin(*schemas.CHANNELS), F.lit(True))), "channel is not one of the six"))
    media = _text(v, "$.mediaKind")
    parts = [_all((_handle(v), "a handle is required"), (F.size(_dates(v)) > 0, "a dated save is required"), (media.isNull() | media.isin(*schemas.MEDIA_KINDS), "mediaKind is not known")), _each(_items(v, "$.extractions"), extraction, "extractions")]
    if profile == "tiktok":
        own = F.coalesce(_text(v, "$.origin.platform") == "tiktok", F.lit(False))
        parts.append(_all((~own | _text(v, "$.identity.canonicalId").isNotNull(), "canonicalId is required"), (~own | (_text(v, "$.identity.status") == "platform_verified"), "status is platform_verified"), (~own | media.isin("video", "photo"), "mediaKind is video or photo")))
    elif profile is not None:
        raise ValueError(f"unknown profile: {profile}")
    return F.concat(*parts)
