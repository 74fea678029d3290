"""Which source each account captures next, by queries over a ledger of what has happened.

The ledger is a table that is only added to: n (rising in an account), account, sweep, source, event (begun, done or
giveup), captured, at. What is under way, what is left of a sweep, and which sources gave up in the one before follow
from it, so a restart needs no state of its own and any number of accounts are planned at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schemas import SOURCES

LEDGER = "n long, account string, sweep int, source string, event string, captured long, at long"
# Fixed value: age in ms beyond which a capture under way is not resumed.
STALE_MS = 24 * 3600 * 1000


def board(accounts: DataFrame, ledger: DataFrame, starting: bool = False) -> DataFrame:
    """A row for each account's source in its newest sweep, or if it is starting and that one is over, in a fresh sweep:
    account, sweep, source, place, again (it gave up in the sweep before), event and captured (null: not begun)."""
    latest = ledger.groupBy("account", "sweep", "source").agg(F.max_by(F.struct("event", "captured", "at"), "n").alias("latest"))
    over = F.count_if(F.col("latest.event") != "begun") >= len(SOURCES)
    newest = latest.groupBy("account", "sweep").agg(over.alias("over")).groupBy("account").agg(F.max(F.struct("sweep", "over")).alias("s"))
    sweep = F.coalesce(F.col("s.sweep") + F.when(F.col("s.over") & F.lit(starting), 1).otherwise(0), F.lit(0))
    rows = accounts.join(newest, "account", "left").select("account", sweep.cast("int").alias("sweep"), F.posexplode(F.array(*map(F.lit, SOURCES))).alias("place", "source"))
    before = latest.select("account", (F.col("sweep") + 1).alias("sweep"), "source", (F.col("latest.event") == "giveup").alias("again"))
    rows = rows.join(latest, ["account", "sweep", "source"], "left").join(before, ["account", "sweep", "source"], "left")
    return rows.select("account", "sweep", "source", "place", F.coalesce("again", F.lit(False)).alias("again"), "latest.event", "latest.captured", "latest.at")


def next_steps(accounts: DataFrame, ledger: DataFrame, occasion: str = "go on") -> DataFrame:
    """account, sweep, action, source and resuming, one row an account. Occasions:

    start    a sweep that is over gives way to a fresh one, in which sources that gave up come first and resume;
    restart  a source under way is captured again, resuming;
    go on    nothing begins while a source is under way (idle); the next one follows, or all_done.
    """
    one = board(accounts, ledger, occasion == "start").groupBy("account", "sweep").agg(
        F.min(F.when(F.col("event") == "begun", F.col("source"))).alias("open"),
        F.min(F.when(F.col("event").isNull(), F.struct((~F.col("again")).alias("later"), "place", "source"))).alias("first"),
    )
    busy, left = F.col("open").isNotNull(), F.col("first").isNotNull()
    resumed = busy & F.lit(occasion == "restart")
    action = F.when(resumed | (~busy & left), "capture").when(busy, "idle").otherwise("all_done")
    source = F.when(resumed, F.col("open")).when(~busy, F.col("first.source"))
    return one.select("account", "sweep", action.alias("action"), source.alias("source"), (resumed | (~busy & left & ~F.coalesce("first.later", F.lit(True)))).alias("resuming"))


def entries(ledger: DataFrame, rows: DataFrame, event: Column, captured: Column, at: Column) -> DataFrame:
    """Ledger rows for rows (account, sweep, source), one an account, to be appended."""
    last = ledger.groupBy("account").agg(F.max("n").alias("last"))
    n = (F.coalesce("last", F.lit(-1)) + 1).cast("long")
    return rows.join(last, "account", "left").select(n.alias("n"), "account", F.col("sweep").cast("int").alias("sweep"), "source", event.alias("event"), captured.cast("long").alias("captured"), at.cast("long").alias("at"))


def begun(ledger: DataFrame, steps: DataFrame, at: Column) -> DataFrame:
    """Entries for the steps that capture a source; they are appended before the capture begins."""
    return entries(ledger, steps.where("action = 'capture'"), F.lit("begun"), F.lit(None), at)


def ended(accounts: DataFrame, ledger: DataFrame, ends: DataFrame, at: Column) -> DataFrame:
    """Entries for captures that came to their end; ends has account, source, status (done or giveup) and captured."""
    newest = board(accounts, ledger).select("account", "sweep").distinct()
    return entries(ledger, ends.join(newest, "account"), F.col("status"), F.col("captured"), at)


def stale(accounts: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """Captures under way (account, source, at) that are too old to resume."""
    return board(accounts, ledger).where((F.col("event") == "begun") & (now - F.col("at") > STALE_MS)).select("account", "source", "at")
