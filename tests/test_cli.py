"""The command line from pages to the contract."""

import json

from tessera import __main__ as cli


def page(kind, *items):
    url = {"likes": "https://x.test/api/favorite/item_list/", "favorites": "https://x.test/api/user/collect/item_list/"}[kind]
    return json.dumps({"url": url, "body": json.dumps({"itemList": list(items), "hasMore": False})})


def item(i, desc, author="who"):
    return {"id": str(i), "desc": desc, "author": {"uniqueId": author}, "createTime": 1_700_000_000, "stats": {"playCount": 5}}


class Args:
    def __init__(self, **kw):
        self.__dict__.update(kw)


def test_pages_to_a_library_to_the_contract(spark, tmp_path, capsys):
    (tmp_path / "one.jsonl").write_text("\n".join([page("likes", item(1, "a"), item(2, "b")), page("likes", item(1, "later"))]))
    (tmp_path / "two.jsonl").write_text("\n".join([page("favorites", item(2, "new b"), item(3, "c")), json.dumps({"url": "https://x.test/other", "body": "{}"})]))
    lib = f"{tmp_path}/library"
    for f in ("one", "two", "two"):
        assert cli._ingest(spark, Args(responses=f"{tmp_path}/{f}.jsonl", library=lib)) == 0
    got = {r["id"]: (r["desc"], r["sources"], r["stats"]["plays"]) for r in cli._library(spark, lib).collect()}
    assert got == {"1": ("later", ["likes"], 5), "2": ("new b", ["likes", "favorites"], 5), "3": ("c", ["favorites"], 5)}
    cli._status(spark, Args(library=lib))
    assert capsys.readouterr().out.split("\n")[:2] == ["favorites: 2", "likes: 2"]
    cli._export(spark, Args(library=lib, out=f"{tmp_path}/out", now="2026-01-01T00:00:00.000Z"))
    assert "3 valid, 0 invalid" in capsys.readouterr().out
    rows = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert {r["identity"]["canonicalId"] for r in rows} == {"1", "2", "3"} and all(r["extractions"] == [] for r in rows)


def test_grounding_from_files(spark, tmp_path):
    rows = [("i", 0, "book", "The Dune"), ("i", 1, "place", "Mill Road"), ("j", 0, "book", "dune")]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(dict(zip(("item_id", "pos", "type", "surface"), r, strict=True))) for r in rows))
    (tmp_path / "c.jsonl").write_text(json.dumps({"source": "wikidata", "name_key": "dune", "rank": 0, "id": "Q1", "name": "Dune", "score": 90}))
    cli._ground(spark, Args(mentions=f"{tmp_path}/m.jsonl", candidates=f"{tmp_path}/c.jsonl", out=f"{tmp_path}/g"))
    e = spark.read.json(f"{tmp_path}/g/entities").collect()
    assert [(r["key"], r["id"], r["confidence"]) for r in e] == [("book:dune", "Q1", 0.9)]
    assert spark.read.json(f"{tmp_path}/g/pending").first().asDict() == {"item_id": "i", "reground_pending": ["place"]}
