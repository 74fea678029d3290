"""Scalar rules as column expressions; clocks and random numbers are always given."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera import schemas


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def prf_counts(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, f1(p, r)


def prf_muc(cor: Column, inc: Column, par: Column, mis: Column, spu: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1 with half credit for partial matches."""
    got = cor + 0.5 * par
    p, r = ratio(got, cor + inc + par + spu), ratio(got, cor + inc + par + mis)
    return p, r, f1(p, r)


def same_id(gold_authority: Column, gold_id: Column, authority: Column, ext_id: Column) -> Column:
    """Same authority (trimmed, any case) and id (trimmed; any case for wikidata)."""
    a, b = F.lower(F.trim(F.coalesce(gold_authority, F.lit("")))), F.lower(F.trim(F.coalesce(authority, F.lit(""))))
    x, y = F.trim(F.coalesce(gold_id, F.lit(""))), F.trim(F.coalesce(ext_id, F.lit("")))
    return (a == b) & F.when(a == "wikidata", F.upper(x) == F.upper(y)).otherwise(x == y)


def cell_score(exact: Column, best: Column, threshold: float = 90) -> Column:
    """Similarity of a cell: 1 if exact, at most .999 if fuzzy, else 0."""
    return F.when(exact, 1.0).when(best >= threshold, F.least(best / 100, F.lit(0.999))).otherwise(0.0)


def assignment_weight(score: Column, exact: Column, same_type: Column) -> Column:
    """Type agreement breaks ties: exact cells gain, fuzzy ones lose half a thousandth."""
    return F.when(exact, 1.0 + F.when(same_type, 0.0005).otherwise(0.0)).when(score > 0, score - F.when(same_type, 0.0).otherwise(0.0005)).otherwise(0.0)


def muc_category(scheme: Column, has_gold: Column, has_pred: Column, exact: Column, same_type: Column) -> Column:
    aligned = (
        F.when(scheme == "strict", F.when(~exact, "PAR").when(same_type, "COR").otherwise("INC"))
        .when(scheme.isin("exact", "partial"), F.when(exact, "COR").otherwise("PAR"))
        .when(scheme == "type", F.when(same_type, "COR").otherwise("INC"))
    )
    return F.when(~has_gold, "SPU").when(~has_pred, "MIS").otherwise(aligned)


def has_more(c: Column) -> Column:
    """Whether more pages may follow: anything but false, "false" and 0 (exactly so written)."""
    return ~F.coalesce(c.isin("false", "0"), F.lit(False))


def cursor(*c: Column) -> Column:
    return F.coalesce(*[x.cast("string") for x in c])


def without_fences(c: Column) -> Column:
    """Text without a surrounding markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_object(c: Column) -> Column:
    """A model's reply as a variant object: the reply, the fenced part, or the first {...}; null if none is an object."""
    tries = [c, without_fences(c), F.regexp_extract(c, r"(?s)(\{.*\})", 1)]
    parsed = [F.try_parse_json(t) for t in tries]
    return F.coalesce(*[F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in parsed])


def selection(reply: Column, n: Column) -> Column:
    """struct(index, confidence) that a reply picks among n candidates, null to abstain."""
    v = json_object(reply)
    index = F.try_variant_get(v, "$.index", "double")
    conf = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    good = index.isNotNull() & (index == F.floor(index)) & (index >= 0) & (index < n)
    return F.when(good, F.struct(index.cast("int").alias("index"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence")))


def queue_backoff(attempts: Column, jitter: Column) -> Column:
    """ms before the next attempt: 1 s doubled, at most 60 s, up to a tenth more."""
    return F.round(F.least(1000 * F.pow(F.lit(2.0), attempts - 1), F.lit(60000.0)) * (1 + 0.1 * jitter)).cast("long")


def pacing_backoff(stall: Column, jitter: Column) -> Column:
    return F.round(F.least(2000 * F.pow(F.lit(2.0), stall - 1), F.lit(60000.0)) * (1 + 0.15 * jitter)).cast("long")


def dwell(u: Column, chance: Column, extra: Column) -> Column:
    """ms to stay on a page, from three uniforms: 900 to 2200, one time in seven 1500 to 4000 more."""
    more = F.when(chance < 1 / 7, 1500 + extra * 2500).otherwise(0.0)
    return F.round(F.greatest(F.lit(900.0), F.least(F.lit(6500.0), 900 + u * 1300 + more))).cast("long")


def keyframes(seconds: Column, n: int = 6) -> Column:
    """Midpoints of n equal parts, in seconds to the millisecond; [1] without a duration."""
    mid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round((i + 0.5) * seconds / n * 1000) / 1000)
    return F.when(seconds > 0, mid).otherwise(F.array(F.lit(1.0)))


def authority(kind: Column) -> Column:
    """First authority of an entity type, wikidata if unknown."""
    out = F.lit("wikidata")
    for t, a in schemas.TYPE_AUTHORITIES.items():
        out = F.when(kind == t, a.split("/")[0].strip()).otherwise(out)
    return out


def save_kind(source: Column) -> Column:
    return F.when(source.isin("favorites", "likes"), source).when(source == "posts", "upload").when(source == "reposts", "repost").otherwise("other")


def source_of_url(url: Column) -> Column:
    """Which listing a page response belongs to, by the path segment before item_list; null for other urls."""
    part = F.lower(F.regexp_extract(url, r"(?i)/([a-z_]+)/item_list", 1))
    name = F.when(part == "collect", "favorites").when(part == "favorite", "likes").when(part == "post", "posts").when(part == "repost", "reposts").when(part != "", part).otherwise("other")
    return F.when(url.rlike(r"(?i)/api/[^?]*item_list"), name)


def is_profile(url: Column) -> Column:
    """A page of a handle, and not of one of its videos or photos."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return path.rlike("^/@[^/]+") & ~path.rlike("/(video|photo)/")


def iso_utc(seconds: Column) -> Column:
    """Epoch seconds as ISO text with milliseconds and Z."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def csv_cell(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(cells: Sequence[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def file_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"))


def rollup(evidence: Column) -> Column:
    """struct(assertion_mode, confidence): the strongest mode, and apart from it the highest confidence."""
    rank = lambda e: F.array_position(F.array(*[F.lit(m) for m in schemas.MODES]), e["assertion_mode"])
    mode = F.array_min(F.transform(evidence, rank))
    return F.struct(F.try_element_at(F.array(*[F.lit(m) for m in schemas.MODES]), mode.cast("int")).alias("assertion_mode"), F.array_max(F.transform(evidence, lambda e: e["confidence"])).alias("confidence"))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(ratio(F.size(F.array_intersect(a, b)), n))


def recall_of(a: Column, b: Column) -> Column:
    """Share of a's distinct elements that b has, 1 for an empty a."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 1.0).otherwise(ratio(F.size(F.array_intersect(a, b)), n))


_TAG, _HEAD = re.compile("<[^>]+>"), re.compile(r"^WEBVTT(?:\s|$)")
_NOTE, _META = re.compile(r"^NOTE\b"), re.compile(r"^(?:Kind|Language|Region|Style):", re.IGNORECASE)


def transcript(vtt: str) -> str:
    """Plain text of WebVTT captions: no header, notes, cue ids, timings or tags; lines that repeat the one before go."""
    lines = [x.strip() for x in re.split(r"\r?\n", vtt)]
    out, note = [], False
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        if not line:
            note = False
        elif note or _HEAD.match(line):
            continue
        elif _NOTE.match(line):
            note = True
        elif "-->" not in line and "-->" not in after and not _META.match(line):
            text = _TAG.sub("", line).strip()
            if text and (not out or out[-1] != text):
                out.append(text)
    return " ".join(out)


@F.pandas_udf(StringType())
def vtt_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: transcript(x or ""))
