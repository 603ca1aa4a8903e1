"""Jobs over a stream of their events, on the second state API: value, list and map state, timers, and a lifetime after which a job is forgotten.

A job begins with its first event and takes units until it has all of them or is cancelled; what comes after either changes nothing. Each unit
counts once, however often it is reported (map state, which keys one entry a unit); errors are kept as a list, the first ``MOST_ERRORS`` of them. When event time passes a job's
creation by ``life_s``, a timer ends its state, and gives a last row of those that were not done.

Rows of a job within a micro-batch are taken in the order of (ts, seq), so what a task holds of one job is bounded by the batch (``maxFilesPerTrigger`` and the like); batches are taken
as they come. Executors that are lost cost the batch: state is restored from the checkpoint.

Every call of the state is a round trip out of the Python worker, and frames of few rows cost more than their rows: rows come one by one, units of a batch are told in
the worker, and what a batch changes is written once at its end. Of a job that begins and is done in one batch no unit is stored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webloom.session import ship

OUT = "job long, version long, status string, total long, completed long, n_errors long, errors array<string>, created long, last_at long"
MOST_ERRORS = 100
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COLUMNS = ("ts", "seq", "kind", "unit", "total", "text")
EPOCH, MICRO = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(microseconds=1)


def _fields(rows: Iterator[Row]) -> Iterator[tuple]:
    """COLUMNS of each row; their places are looked up once, as names cost a search a value."""
    of = None
    for r in rows:
        of = of or itemgetter(*[r.__fields__.index(c) for c in COLUMNS])
        yield of(tuple(r))


class Jobs(StatefulProcessor):
    def __init__(self, life_s: int):
        self.life_s = life_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, total long, completed long, n_errors long, version long, created long, last_at long")
        self.errors = handle.getListState("errors", "text string")
        self.units = handle.getMapState("units", "unit long", "at long")

    def _row(self, key, now, errors) -> Row:
        status, total, completed, n_errors, version, created, last = now
        return Row(job=key[0], version=version, status=status, total=total, completed=completed, n_errors=n_errors, errors=list(errors), created=created, last_at=last)

    def _kept(self, now) -> list[str]:
        return [e[0] for e in self.errors.get()] if now[3] else []

    def _ends(self, now) -> int:
        """When a job's life ends, in milliseconds."""
        return now[5] // 1000 + self.life_s * 1000

    def _last(self, key, now, errors) -> Iterator[Row]:
        """The end of a life: a row if the job was not done."""
        if now[0] == "scraping":
            yield self._row(key, ["expired", *now[1:4], now[4] + 1, *now[5:]], errors)

    def _forget(self) -> None:
        self.job.clear()
        self.errors.clear()
        self.units.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        batch = sorted((((ts - EPOCH) // MICRO, seq is None, seq or 0, kind, unit, total, text) for ts, seq, kind, unit, total, text in _fields(rows)), key=itemgetter(0, 1, 2))
        before = self.job.get()
        now = list(before) if before else None
        errors = self._kept(now) if now else []
        kept = len(errors)
        # whether this life is in the state and so has its timer, and whether units of it may be there; those of this batch are told here
        stored, units_stored, units = now is not None, now is not None and now[0] == "scraping", {}
        for at, _, _, kind, unit, total, text in batch:
            if now is not None and at > now[5] + self.life_s * 1_000_000:
                # the timer of this life was still to come: timers follow a batch's rows
                yield from self._last(key, now, errors)
                if stored:
                    self.handle.deleteTimer(self._ends(now))
                    self._forget()
                now, errors, kept, before, stored, units_stored, units = None, [], 0, None, False, False, {}
            if now is None:
                now = ["scraping", int(total), 0, 0, 0, at, at]
            if now[0] != "scraping":
                continue
            now[4], now[6] = now[4] + 1, max(now[6], at)
            if kind == "cancel":
                now[0] = "cancelled"
            elif kind == "error":
                now[3] += 1
                if len(errors) < MOST_ERRORS:
                    errors.append(text or "")
            elif kind == "unit" and unit not in units:
                # None: counted by an earlier batch
                units[unit] = None if units_stored and self.units.containsKey((unit,)) else at
                if units[unit] is not None:
                    now[2] += 1
                    if now[2] >= now[1]:
                        now[0] = "completed"
        if not stored:
            self.handle.registerTimer(self._ends(now))
        if now[0] == "scraping":
            for unit, at in units.items():
                if at is not None:
                    self.units.updateValue((unit,), (at,))
        elif units_stored:
            self.units.clear()
        if tuple(now) != before:
            self.job.update(tuple(now))
        if len(errors) > kept:
            self.errors.put([(e,) for e in errors])
        yield self._row(key, now, errors)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if now := self.job.get():
            yield from self._last(key, list(now), self._kept(now))
            self._forget()

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """The state API needs a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def job_stream(events: DataFrame, life_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Rows of OUT after each batch that a job has events in, and one more for those whose life ends before they are done, out of a stream of (job, ts, seq, kind, unit, total, text); kind is unit, error or cancel, others
    count as events alone, and total is that of a job's first event. The row with the highest version is a job's latest."""
    ship(events.sparkSession)
    use_state_store(events.sparkSession)
    named = events.select("job", "ts", "seq", "kind", "unit", "total", "text").withWatermark("ts", late)
    return named.groupBy("job").transformWithState(statefulProcessor=Jobs(life_s), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
