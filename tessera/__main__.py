"""Command line: score, check, validate-matcher, ingest, status, ground and export."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import gates
from tessera.operators import align, extraction, library, linking, scorecard
from tessera.session import session, ship, written
from tessera.sources import pages, records, sinks
from tessera.streaming import capture


def _score(spark, a) -> int:
    hierarchy = records.read_hierarchy(spark, a.hierarchy) if a.hierarchy else None
    card = scorecard.build(records.read_gold(spark, a.gold), records.read_pred(spark, a.pred), hierarchy, c=a.c, k=a.k, b=a.resamples, seed=a.seed)
    print(scorecard.report(card) if a.json else scorecard.markdown(card))
    return 0


def check(spark, valid: str, invalid: str, profile: str | None = None):
    """(path, side, errors, wrong) of every item file: valid ones must pass both gates, invalid ones fail at least one."""
    read = lambda path, side: spark.read.text(path, wholetext=True).select(F.input_file_name().alias("key"), F.lit(side).alias("side"), F.try_parse_json("value").alias("v"))
    rows = read(valid, "valid").unionByName(read(invalid, "invalid"))
    own = rows.where("v is null").select("key", F.array(F.lit("$: not JSON")).alias("errors"))
    shapes = lambda v: F.when(F.col("path") == "$", gates.shape_errors(v, profile)).otherwise(gates.shape_errors(v))
    graph = gates.gated(rows.where("v is not null"), shapes).select("key", F.col("errors").alias("shapes"))
    both = gates.gated(rows.where("v is not null"), gates.item_errors).join(graph, "key").select("key", F.concat("errors", "shapes").alias("errors"))
    out = rows.select("key", "side").join(both.unionByName(own), "key").withColumn("wrong", (F.size("errors") == 0) != (F.col("side") == "valid"))
    return out.select(F.col("key").alias("path"), "side", "errors", "wrong")


def _check(spark, a) -> int:
    rows = check(spark, a.valid, a.invalid).orderBy("path").collect()
    for r in rows:
        print(f"{'WRONG' if r['wrong'] else 'ok':5} {r['side']:7} {r['path']} {'; '.join(r['errors'])}")
    return int(any(r["wrong"] for r in rows))


def _matcher(spark, a) -> int:
    r = extraction.matcher_quality(align.bare_matches(records.read_matcher_pairs(spark, a.pairs))).first()
    print(" ".join(f"{k}={r[k]:.3f}" if isinstance(r[k], float) else f"{k}={r[k]}" for k in r.asDict()))
    return 0


_SCALARS = [name for name, _ in schemas.ITEM_FIELDS if name not in ("id", "sources")]


def _ingest(spark, a) -> int:
    """Merge pages (JSON lines of url and body) into the library; the last arrival wins, by file and place in it."""
    responses = pages.read_responses(spark, a.responses)
    placed = responses.select("url", "body", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")).alias("seq"))
    raw = pages.envelopes(placed).select("source", "seq", F.explode("raw").alias("raw"))
    items = library.normalize_items(raw, F.col("source"), "seq")
    table = capture.LibraryTable(spark, a.library, _SCALARS)
    table.apply(items, table.last_version() + 1)
    return 0


def _library(spark, path: str):
    items = capture.LibraryTable(spark, path, _SCALARS).read()
    if items is None:
        raise SystemExit(f"no library at {path}")
    return items


def _status(spark, a) -> int:
    for r in library.collections(_library(spark, a.library)).orderBy("tag").collect():
        print(f"{r['tag']}: {r['items']}")
    return 0


def _ground(spark, a) -> int:
    """Entities of mentions (JSON lines: item_id, pos, type, surface) by candidate rows (JSON lines: source, name_key, rank,
    id, name, score; sources are authorities)."""
    mentions = linking.keyed(spark.read.schema("item_id string, pos int, type string, surface string").json(a.mentions))
    kb = spark.read.schema("source string, name_key string, rank int, id string, name string, score double").json(a.candidates)
    handles = [(t, s.strip(), i) for t, of in schemas.TYPE_AUTHORITIES.items() for i, s in enumerate(of.split("/"))]
    there = kb.select("source").distinct()
    asked = spark.createDataFrame(handles, "type string, source string, priority int").join(there, "source").select("type", "source", "priority")
    entities, pending = linking.ground(mentions, asked, linking.candidate_lists(kb))
    entities.write.mode("overwrite").json(f"{a.out}/entities")
    pending.write.mode("overwrite").json(f"{a.out}/pending")
    return 0


def _export(spark, a) -> int:
    """The library as items of the open contract, one a line, and how many of them are valid."""
    none = lambda kind: F.lit(None).cast(kind)
    evidence = schemas.EVIDENCE
    output = f"struct<mentions:array<struct<surface:string,type:string,aliases:array<string>,evidence:array<{evidence}>>>,concepts:array<struct<surface:string,evidence:array<{evidence}>>>,facets:array<struct<facet:string,value:string,evidence:array<{evidence}>>>,claims:array<struct<statement:string,evidence:array<{evidence}>>>,structured:array<struct<schemaOrgType:string,slots:array<struct<name:string,value:string>>,steps:array<struct<`order`:int,text:string>>,evidence:array<{evidence}>>>>"
    records_ = _library(spark, a.library).withColumns({
        "updatedAt": F.lit(a.now), "posterRef": none("string"), "model": none("string"), "promptVersion": none("string"), "output": none(output),
        "groundings": none("array<struct<type:string,name_key:string,resolved:boolean,id:string,confidence:double>>"), "regroundPending": none("array<string>"),
    })
    ref = F.struct(F.lit("").alias("model"), F.lit("").alias("version"), F.lit("").alias("prompt"), F.lit("").alias("run"))
    items = written(sinks.open_items(records_, F.lit(a.now), ref), "export")
    items.select("value").write.mode("overwrite").text(a.out)
    r = sinks.export_report(items).first()
    print(f"contract {schemas.CONTRACT_VERSION}: {r['valid']} valid, {r['invalid']} invalid")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="verb", required=True)
    s = sub.add_parser("score", help="score predictions against gold")
    for flag, kw in (("--gold", {"required": True}), ("--pred", {"required": True}), ("--hierarchy", {}), ("--json", {"action": "store_true"}), ("-c", {"type": float, "default": 10.0}), ("-k", {"type": int, "default": 5}), ("--resamples", {"type": int, "default": 2000}), ("--seed", {"type": int, "default": 0})):
        s.add_argument(flag, **kw)
    s.set_defaults(run=_score)
    for verb, run, flags in (("check", _check, ("--valid", "--invalid")), ("validate-matcher", _matcher, ("--pairs",)), ("ingest", _ingest, ("--responses", "--library")), ("status", _status, ("--library",)), ("ground", _ground, ("--mentions", "--candidates", "--out")), ("export", _export, ("--library", "--out", "--now"))):
        s = sub.add_parser(verb)
        for flag in flags:
            s.add_argument(flag, required=True)
        s.set_defaults(run=run)
    a = p.parse_args(argv)
    return a.run(ship(session()), a)


if __name__ == "__main__":
    sys.exit(main())
