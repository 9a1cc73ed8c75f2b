"""Keyed state of streams (T4, T5, T7): jobs whose end sticks, and requests that share a job that is active.

State is kept for each key, bounded in size, and cleared by a timer once a key has ended and its time is over, so that
what a stream keeps follows the keys that are alive and not all there ever were. Both processors take records in any
number of batches; jobs() gives the same for any order of arrival. They need the store that transformWithState needs, and
stateful() sets it while a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _micros(times: pd.Series) -> list[int]:
    return pd.to_datetime(times).astype("datetime64[us]").astype("int64").tolist()


class _Jobs(StatefulProcessor):
    """The first terminal status, else the last one; the last `history` records, by which replays are told."""

    def __init__(self, terminal: Sequence[str], history: int, keep_ms: int | None):
        self.terminal, self.history, self.keep_ms = frozenset(terminal), history, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, status string")
        self.end = handle.getValueState("end", "at long, seq long, status string")
        self.counts = handle.getValueState("counts", "n long, replays long")
        self.recent = handle.getListState("recent", "at long, seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        end = tuple(self.end.get()) if self.end.exists() else None
        n, replays = tuple(self.counts.get()) if self.counts.exists() else (0, 0)
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        known, ended = set(recent), end
        for part in rows:
            for record in zip(_micros(part["at"]), part["seq"].tolist(), part["status"].tolist(), strict=True):
                if record in known:
                    replays += 1
                    continue
                known.add(record)
                recent.append(record)
                n += 1
                last = record if last is None or record > last else last
                if record[2] in self.terminal and (end is None or record < end):
                    end = record
        self.last.update(last)
        self.counts.update((n, replays))
        self.recent.put(sorted(recent)[-self.history :])
        if end is not None:
            self.end.update(end)
            if ended is None and self.keep_ms is not None:
                self.handle.registerTimer(last[0] // 1000 + self.keep_ms)
        told = end or last
        yield pd.DataFrame({"job": [key[0]], "status": [told[2]], "seq": [told[1]], "ended": [end is not None], "n_records": [n], "replays": [replays]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, self.end, self.counts, self.recent):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def jobs(stream: DataFrame, terminal: Sequence[str], history: int = 64, keep: str | None = None, late: str = "0 seconds") -> DataFrame:
    """job, status, seq, ended, n_records, replays of each job with new records. stream (job long, at timestamp, seq long,
    status string); records are ordered by (at, seq), and the first terminal one is the job's end for good.

    A record that is among a job's last `history` ones is a replay and counts as such. With `keep`, a job is forgotten that
    long after its end, when the watermark (`late` behind the latest record) has passed: a record that comes later still
    would start the job anew.
    """
    schema = "job long, status string, seq long, ended boolean, n_records long, replays long"
    rows = stream.select("job", "at", "seq", "status")
    keep_ms = None
    if keep is not None:
        rows = rows.withWatermark("at", late)
        keep_ms = int(stream.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {keep})").first()[0])
    return rows.groupBy("job").transformWithStateInPandas(_Jobs(terminal, history, keep_ms), schema, "Update", "None" if keep is None else "EventTime")


class _Admissions(StatefulProcessor):
    """The active job of a specification, and how many requests it serves."""

    def __init__(self, ends: Sequence[str]):
        self.ends = frozenset(ends)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "job long, served long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        active = tuple(self.active.get()) if self.active.exists() else None
        records = sorted(r for part in rows for r in zip(_micros(part["at"]), part["seq"].tolist(), part["job"].tolist(), part["status"].tolist(), strict=True))
        out = []
        for _, seq, job, status in records:
            if status in self.ends:
                active = None if active and active[0] == job else active
            else:
                active = (job, 1) if active is None else (active[0], active[1] + 1)
                out.append((key[0], seq, job, active[0], active[0] != job))
        if active is None:
            self.active.clear()
        else:
            self.active.update(active)
        yield pd.DataFrame(out, columns=["spec", "seq", "job", "served_by", "reused"])

    def close(self) -> None:
        pass


def admissions(stream: DataFrame, ends: Sequence[str]) -> DataFrame:
    """spec, seq, job, served_by, reused of each request: a request for what an active job does already is served by that
    job. stream (spec string, at timestamp, seq long, job long, status string), where a status among `ends` ends its job and
    any other is a request. Batches come in order of time; within one, records are put in order. Only active jobs are kept.
    """
    rows = stream.select("spec", "at", "seq", "job", "status")
    return rows.groupBy("spec").transformWithStateInPandas(_Admissions(ends), "spec string, seq long, job long, served_by long, reused boolean", "Append", "None")
