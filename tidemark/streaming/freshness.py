"""Freshness sensor with state and timers of its own.

An occurrence (job, logical time) is open until its deadline; a finish in time closes it, a deadline that passes is a breach.
It is then kept for a while, so that the late finish is reported too, and dropped. Nothing is left in state once
the watermark has passed the last deadline. One state value holds all occurrences of a slice of logical time and a share of the
jobs, as packed arrays, with one timer at the earliest time that matters to any of them: calls into the state
store grow with the slices that a batch touches, not with the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REPORT_DDL = "job_id BIGINT, logical_at TIMESTAMP, report STRING, at TIMESTAMP"
#: What an occurrence waits for. OPEN: its deadline. DONE: nothing more, it keeps repeats away. BREACHED: a late finish. EARLY: its occurrence.
UNKNOWN, OPEN, DONE, BREACHED, EARLY = range(5)
#: Times are microseconds, timers milliseconds; ``nojob`` marks a NULL job, whose ``job`` is 0.
ROW = np.dtype([("job", "i8"), ("nojob", "?"), ("logical", "i8"), ("phase", "i1"), ("timer", "i8"), ("finished", "i8")])
KEY = ["job", "nojob", "logical"]
NEVER = np.iinfo(np.int64).max


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 0 for each distinct key, and how many there are."""
    order = np.lexsort([keys[c] for c in KEY])
    placed = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = np.logical_or.reduce([placed[c][1:] != placed[c][:-1] for c in KEY])
    numbers = np.empty(len(keys), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return numbers, int(new.sum())


def _timer(until: np.ndarray) -> np.ndarray:
    """Timers have milliseconds and are set to the next one."""
    return until // 1000 + 1


class FreshnessProcessor(StatefulProcessor):
    """One BREACH per occurrence whose SLO passes without a finish, one LATE_FINISH if it still comes."""

    def __init__(self, slo_us: int, keep_us: int):
        self.slo_us, self.keep_us = slo_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("occurrences", "packed BINARY")

    def _load(self) -> np.ndarray:
        return np.frombuffer(bytes(self.state.get()[0]), ROW) if self.state.exists() else np.empty(0, ROW)

    def _save(self, before: np.ndarray, rows: np.ndarray, fired: int | None = None) -> None:
        """Replace the rows. The timer stands at the earliest one of theirs; ``fired`` is one that has gone off."""
        old, new = (int(r["timer"].min()) if len(r) else None for r in (before, rows))
        if old != new:
            if old is not None and old != fired:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if len(rows):
            self.state.update((rows.tobytes(),))
        else:
            self.state.clear()

    def _reports(self, rows: np.ndarray, report: str, at: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(rows):
            yield pd.DataFrame({**{c: rows[c] for c in KEY}, "report": report, "at": at})

    def apply(self, before: np.ndarray, keys: np.ndarray, is_finish: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[pd.DataFrame]]:
        """(rows after a batch, reports). ``keys`` name the occurrence of each row of the batch."""
        numbers, n = _numbers(np.concatenate([before[KEY], keys]))
        known, seen = numbers[:len(before)], numbers[len(before):]
        rows = np.zeros(n, ROW)
        for c in KEY:
            rows[c][seen] = keys[c]
        rows[known] = before
        due, finished = np.zeros(n, bool), np.full(n, NEVER)
        due[seen[~is_finish]] = True
        np.minimum.at(finished, seen[is_finish], at[is_finish])
        phase, deadline = rows["phase"].copy(), rows["logical"] + self.slo_us
        first = (phase == UNKNOWN) | (phase == EARLY)
        finished = np.where(phase == EARLY, np.minimum(finished, rows["finished"]), finished)
        done = finished != NEVER
        opened, early = first & due & ~done, (phase == UNKNOWN) & ~due
        judged = done & ((first & due) | (phase == OPEN))
        late = judged & (finished > deadline)
        told = done & (phase == BREACHED)
        rows["phase"] = np.select([opened, early, judged | told], [OPEN, EARLY, DONE], phase)
        rows["timer"] = np.select([opened, early | judged | told], [
            _timer(deadline), _timer(np.maximum(np.where(done, finished, deadline), deadline) + self.keep_us)], rows["timer"])
        rows["finished"] = np.where(early | judged | told, finished, rows["finished"])
        found = [*self._reports(rows[late], "BREACH", deadline[late]), *self._reports(rows[late | told], "LATE_FINISH", finished[late | told])]
        return rows, found

    def expire(self, before: np.ndarray, now: int) -> tuple[np.ndarray, list[pd.DataFrame]]:
        """(rows that still wait for something, reports) once the watermark has reached ``now`` milliseconds."""
        rows = before.copy()
        breach = (rows["timer"] <= now) & (rows["phase"] == OPEN)
        deadline = rows["logical"][breach] + self.slo_us
        found = [*self._reports(rows[breach], "BREACH", deadline)]
        rows["phase"][breach], rows["timer"][breach] = BREACHED, _timer(deadline + self.keep_us)
        return rows[rows["timer"] > now], found

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        keys = np.zeros(len(batch), ROW)[KEY]
        for c in KEY:
            keys[c] = batch[c].to_numpy()
        before = self._load()
        after, found = self.apply(before, keys, batch["is_finish"].to_numpy(bool), batch["at_us"].to_numpy(np.int64))
        self._save(before, after)
        yield from found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._load()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        after, found = self.expire(before, max(fired, timerValues.getCurrentWatermarkInMs()))
        self._save(before, after, fired)
        yield from found

    def close(self) -> None:
        pass


def freshness_reports(
    events: DataFrame, slo_seconds: int, keep_seconds: int, lateness: str, slice_seconds: int = 3600, spread: int = 8,
) -> DataFrame:
    """(job_id, logical_at, report, at) of a stream of (job_id, logical_at, is_finish, at).

    ``at`` is the event time: of an occurrence its logical time, of a finish when it ended. A finish up to ``keep_seconds``
    after the deadline is reported as LATE_FINISH; repeated rows of either kind change nothing. A state value holds the
    occurrences of ``slice_seconds`` of logical time and one of ``spread`` shares of the jobs, 34 bytes each; a
    checkpoint keeps the two numbers it was started with.
    """
    rows = events.withWatermark("at", lateness).select(
        F.floor(F.unix_seconds("logical_at") / slice_seconds).alias("slice"), F.pmod(F.xxhash64("job_id"), F.lit(spread)).alias("share"),
        F.coalesce("job_id", F.lit(0)).cast("bigint").alias("job"), F.col("job_id").isNull().alias("nojob"),
        F.unix_micros("logical_at").alias("logical"), "is_finish", F.unix_micros("at").alias("at_us"), "at")
    reports = rows.groupBy("slice", "share").transformWithStateInPandas(
        FreshnessProcessor(1_000_000 * slo_seconds, 1_000_000 * keep_seconds),
        "job BIGINT, nojob BOOLEAN, logical BIGINT, report STRING, at BIGINT", "append", "eventTime")
    return reports.select(
        F.when(~F.col("nojob"), F.col("job")).alias("job_id"), F.timestamp_micros("logical").alias("logical_at"), "report",
        F.timestamp_micros("at").alias("at"))
