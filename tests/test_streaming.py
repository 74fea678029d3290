import random

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.streaming import capture as C
from tessera.streaming import sequencer as Q

COLUMNS = ["seq", "kind", "count", "has_more", "cursor"]


def run(events, resuming=False, known=None, cut=None):
    """Judge (count, has_more, cursor) pages and None ticks, in batches of `cut`; (action, wait_ms) of each, and the totals."""
    rows = pd.DataFrame([(i, "tick", None, None, None) if e is None else (i, "page", *e) for i, e in enumerate(events)], columns=COLUMNS)
    known, out = known or C.Totals(), []
    for at in range(0, len(rows), cut or len(rows)):
        part, known = C.judged(rows[at : at + (cut or len(rows))].reset_index(drop=True), known, resuming)
        out.append(part)
    return known, pd.concat(out, ignore_index=True)


def test_only_an_end_page_completes():
    known, out = run([(30, True, "1"), (60, True, "2"), (60, False, None), (90, True, "3")])
    assert out["action"].tolist() == ["scroll", "scroll", "done", "done"] and known.captured == 60 and known.ended == "done"


def test_silence_backs_off_and_gives_up():
    known, out = run([(5, True, None)] + [None] * 9)
    assert out["wait_ms"].tolist()[1:8] == [1000, 2000, 4000, 8000, 16000, 32000, 60000] and known.ended == "giveup"
    assert "5 items" in out["reason"][8] and out["reason"][9] == out["reason"][8] and out["quiet"][9] == C.QUIET


def test_growth_ends_the_quiet():
    known, out = run([None] * 7 + [(1, True, None)])
    assert known.quiet == 0 and out["status"].iloc[-1] == "scrolling"


def test_pages_are_spared_while_resuming():
    pages, start = [(100, True, str(i)) for i in range(20)], C.Totals(captured=100)
    assert run(pages, True, start)[0][3:] == (20, 0, None)
    assert run([(100, True, "same")] * 10, True, start)[0][3:] == (1, C.QUIET, "giveup")
    assert run([(101, True, "a"), *pages], True, start)[0][3:] == (0, C.QUIET, "giveup")
    assert run([(100, True, None)] * (C.SPARED + 8), True, start)[0][3:] == (C.SPARED, C.QUIET, "giveup")
    assert run(pages, False, start)[0].ended == "giveup"


def test_batches_are_judged_like_the_whole():
    rng = random.Random(4)
    for trial in range(200):
        events, count = [], 0
        for i in range(rng.randrange(1, 60)):
            count = max(0, count + rng.choice((0, 0, 0, 1, -1)))
            events.append(None if rng.random() < 0.4 else (count, rng.choice([True] * 30 + [False, None]), rng.choice((None, "a", str(i)))))
        whole, parts = run(events, trial % 2 == 0), run(events, trial % 2 == 0, cut=rng.randrange(1, 9))
        assert whole[0] == parts[0] and whole[1].astype(str).equals(parts[1].astype(str))


def test_sweeps_follow_the_ledger(spark):
    accounts = spark.createDataFrame([("me",), ("other",)], "account string")
    rows = []

    def ledger():
        return spark.createDataFrame(rows, Q.LEDGER)

    def step(occasion, account="me"):
        r = Q.next_steps(accounts, ledger(), occasion).where(F.col("account") == account).first()
        return r["action"], r["source"], r["resuming"]

    def begin(occasion):
        rows.extend(map(tuple, Q.begun(ledger(), Q.next_steps(accounts, ledger(), occasion).where("account = 'me'"), F.lit(7)).collect()))

    def end(source, status):
        rows.extend(map(tuple, Q.ended(accounts, ledger(), spark.createDataFrame([("me", source, status, 5)], "account string, source string, status string, captured long"), F.lit(9)).collect()))

    assert step("start") == ("capture", "favorites", False)
    begin("start")
    assert step("start") == ("idle", None, False) and step("restart") == ("capture", "favorites", True) and step("start", "other")[1] == "favorites"
    assert Q.stale(accounts, ledger(), F.lit(8 + Q.STALE_MS)).count() == 1 and Q.stale(accounts, ledger(), F.lit(7 + Q.STALE_MS)).count() == 0
    for source, status in zip(Q.SOURCES, ("done", "giveup", "done", "done"), strict=True):
        end(source, status)
        begin("go on")
    assert step("go on") == ("all_done", None, False) and [r[0] for r in rows] == list(range(8))
    assert step("start") == ("capture", "likes", True)
    begin("start")
    end("likes", "done")
    assert step("go on") == ("capture", "favorites", False)


def test_stream_and_batch_upserts_agree_and_replays_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 7), ["a" if i % 2 else "b"], i, i * 10) for i in range(40)] + [("", ["x"], 99, 0)], "id string, sources array<string>, seq int, v int")
    for lo, hi in ((0, 15), (15, 30), (30, 100)):
        rows.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = C.LibraryTable(spark, f"{tmp_path}/lib", ["v"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    C.run_upserts(stream, table, f"{tmp_path}/ck").awaitTermination()
    want = sorted(map(str, L.merge(L.well_formed(rows), ["v"]).select("id", "v", "sources").collect()))
    assert sorted(map(str, table.read().select("id", "v", "sources").collect())) == want
    table.apply(rows.where("seq >= 30"), 2)  # the last batch again
    assert sorted(map(str, table.read().select("id", "v", "sources").collect())) == want


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    rows = spark.range(200).selectExpr("cast(id as string) as id", "array('a') as sources", "id as seq", "id as v")
    table = C.LibraryTable(spark, f"{tmp_path}/lib", ["v"], buckets=8)
    table.apply(rows, 0)
    first = table.layout()
    for k in (1, 2, 3):
        table.apply(rows.where("id = '7'").selectExpr("id", "array('b') as sources", "seq", f"{k} as v"), k)
    moved = {b: f for b, f in table.layout().items() if f != first[b]}
    assert len(first) == 8 and len(moved) == 1 and "version=3" in list(moved.values())[0] and table.last_version() == 3
    got = {r["id"]: (r["v"], r["sources"]) for r in table.read().collect()}
    assert len(got) == 200 and got["7"] == (3, ["a", "b"]) and got["8"] == (8, ["a"])
    b = list(moved)[0]
    assert [v for v in (0, 1, 2, 3) if b in table._listed(f"{tmp_path}/lib/version={v}", "bucket")] == [2, 3]


def test_completion_stream(spark, tmp_path):
    rows = [("a", i, "page", i + 1, i < 3, str(i)) for i in range(4)] + [("b", i, "tick", 0, True, None) for i in range(9)]
    spark.createDataFrame(rows, "source string, seq long, kind string, count long, has_more boolean, cursor string").coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("source string, seq long, kind string, count long, has_more boolean, cursor string").parquet(f"{tmp_path}/ev")
    C.completion(stream).writeStream.format("memory").queryName("completion_test").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    last = {r["source"]: r["status"] for r in spark.table("completion_test").orderBy("seq").collect()}
    assert last == {"a": "done", "b": "giveup"}


def test_foreign_arrivals_do_not_drive(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [r[0] for r in df.select(C.drives(F.lit("a"), F.col("s"))).collect()] == [True, False, False]
    assert all(r[0] for r in df.select(C.drives(F.lit(None).cast("string"), F.col("s"))).collect())
