"""Capture as a stream: arrivals are merged idempotently, and a reducer per source tells when its capture has ended.

The reducer reads a source's events in seq order: pages (count so far, has_more, cursor) and ticks, which say that no
page came in time. What it keeps are running totals, so a batch of events is judged by cumulative columns:

  captured  largest count of any page
  moved     the page's count exceeds all before it, or the page is spared
  spared    while resuming, before anything has grown, the first SPARED pages whose cursor is not the last one again
  quiet     events since the last that moved
  ended     the first page without more (done), or QUIET quiet events (giveup); later events change nothing
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators import library

# Quiet events that end a capture, pages spared while resuming, first and longest wait in ms; actions and the statuses they leave.
QUIET, SPARED, FIRST_MS, MOST_MS = 8, 400, 1000, 60_000
STATUS = {"scroll": "scrolling", "wait": "waiting", "done": "done", "giveup": "giveup"}

_OUT = "source string, seq long, action string, wait_ms long, status string, captured long, quiet int, reason string"


class Totals(NamedTuple):
    """What is known of a source from all its events; the state's columns."""

    captured: int = 0
    grown: bool = False
    cursor: str | None = None
    spared: int = 0
    quiet: int = 0
    ended: str | None = None


_TOTALS = "captured long, grown boolean, cursor string, spared int, quiet int, ended string"


def why(ended: str | None, captured: int) -> str | None:
    return f"{QUIET} quiet events in a row after {captured} items, and no page said it was the last" if ended == "giveup" else None


def judged(events: pd.DataFrame, known: Totals, resuming: bool = False) -> tuple[pd.DataFrame, Totals]:
    """action, wait_ms, status, captured, quiet and reason of each event, in order, and the totals after all of them."""
    page = events["kind"].to_numpy() == "page"
    final = page & (events["has_more"] == False).to_numpy(dtype=bool)  # noqa: E712 - null means more
    more = page & ~final
    counts = np.where(page, pd.to_numeric(events["count"]).fillna(0), 0).astype(np.int64)
    captured = np.maximum.accumulate(np.r_[known.captured, counts])
    grown = more & (counts > captured[:-1])
    grown_before = np.r_[known.grown, known.grown | np.logical_or.accumulate(grown)][:-1]
    cursors = events["cursor"].where(more & events["cursor"].notna().to_numpy(), None)
    cursor = pd.concat([pd.Series([known.cursor], dtype=object), cursors.astype(object)], ignore_index=True).ffill()
    again = (cursors.notna() & (cursors.reset_index(drop=True) == cursor[:-1].reset_index(drop=True)).set_axis(cursors.index)).to_numpy()
    fair = more & ~grown & ~grown_before & ~again & resuming
    spared = known.spared + np.cumsum(fair)
    moved = grown | (fair & (spared <= SPARED))
    place = np.arange(1, len(events) + 1)
    since = np.maximum.accumulate(np.where(moved, place, 0))
    quiet = place - since + np.where(since == 0, known.quiet, 0)
    action = np.select([final, moved, quiet >= QUIET], ["done", "scroll", "giveup"], "wait").astype(object)

    over = np.flatnonzero(np.isin(action, ["done", "giveup"]))
    end = -1 if known.ended else int(over[0]) if len(over) else len(events)
    quiet = np.where(final, 0, quiet)
    captured = captured[1:]
    if end < len(events):  # all that comes after the end is as the end was
        after = slice(end + 1, None)
        action[after] = known.ended or action[end]
        captured[after], quiet[after] = (known.captured, known.quiet) if known.ended else (captured[end], quiet[end])
    wait = pd.array(np.minimum(FIRST_MS * 2.0 ** np.maximum(quiet - 1, 0), MOST_MS).astype(np.int64), "Int64")
    wait[action != "wait"] = pd.NA
    out = pd.DataFrame({"seq": events["seq"].to_numpy(), "action": action, "wait_ms": wait, "status": [STATUS[a] for a in action], "captured": captured, "quiet": quiet.astype(np.int32)})
    out["reason"] = [why(a, c) for a, c in zip(action, captured, strict=True)]
    ended = action[-1] if len(events) and action[-1] in ("done", "giveup") else known.ended
    last = cursor.iloc[-1]
    return out, Totals(int(captured[-1]), bool(known.grown or grown.any()), None if pd.isna(last) else last, int(min(spared[-1], SPARED)), int(quiet[-1]), ended) if len(events) else known


class Completion(StatefulProcessor):
    """Judges a source's events batch by batch, with the totals of the batches before."""

    def __init__(self, resuming: bool = False):
        self.resuming = resuming

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        known = Totals(*self.totals.get()) if self.totals.exists() else Totals()
        out, known = judged(events, known, self.resuming)
        self.totals.update(tuple(known))
        yield out.assign(source=key[0])[[c.split()[0] for c in _OUT.split(", ")]]

    def close(self) -> None:
        pass


def completion(events: DataFrame, resuming: bool = False) -> DataFrame:
    """Actions and statuses of a stream of events; needs the RocksDB state store. A source's events are one task's, as
    they are judged in their order; a source is one capture, which people run."""
    return events.groupBy("source").transformWithStateInPandas(Completion(resuming), outputStructType=_OUT, outputMode="Append", timeMode="None")


def drives(expected: Column, arrival: Column) -> Column:
    """Whether an arrival drives the run in progress: its source is the expected one, or none is expected. All are stored."""
    return expected.isNull() | expected.eqNullSafe(arrival)


class LibraryTable:
    """A keyed Parquet table in buckets of ids: path/version=<batch>/bucket=<b>. A batch writes the buckets that its ids
    are in, and nothing else; a bucket is what its newest version holds. A replayed batch reads what was before it and
    overwrites its own version; versions that a replay can no longer need are deleted."""

    def __init__(self, spark: SparkSession, path: str, scalars: Sequence[str], tags: str = "sources", order: str = "seq", buckets: int = 16):
        self.spark, self.path, self.scalars, self.tags, self.order, self.buckets = spark, path.rstrip("/"), list(scalars), tags, order, buckets

    def _listed(self, folder: str, key: str) -> list[int]:
        """Values of key in the names key=<value> of the folder's folders, ascending."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{key}="))

    def _done(self, version: int) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={version}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def layout(self, before: int | None = None) -> dict[int, str]:
        """The folder of each bucket's newest version, or of the newest before a batch."""
        found = {}
        for v in self._listed(self.path, "version"):
            if (before is None or v < before) and self._done(v):
                found |= {b: f"{self.path}/version={v}/bucket={b}" for b in self._listed(f"{self.path}/version={v}", "bucket")}
        return found

    def read(self, before: int | None = None) -> DataFrame | None:
        folders = self.layout(before)
        return self.spark.read.parquet(*folders.values()) if folders else None

    def last_version(self) -> int:
        return max((v for v in self._listed(self.path, "version") if self._done(v)), default=-1)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the batch merged into the buckets that it touches."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        rows = library.well_formed(batch).select("id", self.order, self.tags, *self.scalars)
        before, touched = self.layout(batch_id), [r[0] for r in rows.select(bucket).distinct().collect()]  # at most `buckets`
        folders = [before[b] for b in touched if b in before]
        new = library.merge(rows, self.scalars, self.order, self.tags) if not folders else library.upsert(self.spark.read.parquet(*folders), rows, self.scalars, (), self.order, self.tags)
        new = new.select("id", *self.scalars, self.tags, bucket.alias("bucket")).repartition("bucket")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={batch_id}")
        self._sweep(before, batch_id)

    def _sweep(self, needed: dict[int, str], batch_id: int) -> None:
        """Delete bucket folders of versions before this batch that are neither current nor what a replay of it reads."""
        keep = {*needed.values(), *self.layout().values()}
        for v in self._listed(self.path, "version"):
            for b in self._listed(f"{self.path}/version={v}", "bucket") if v < batch_id else ():
                folder = f"{self.path}/version={v}/bucket={b}"
                if folder not in keep:
                    p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                    p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_upserts(arrivals: DataFrame, table: LibraryTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Start merging a stream of arrivals into the table; by default until all that is there is done."""
    return arrivals.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
