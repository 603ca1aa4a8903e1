"""Sequential state machines over the ordered rows of a key, for what no window function expresses, with hot keys in many segments.

Rows are dealt by ranges of (key, order), so a key with a third of all rows is many segments, one after the other. Every segment is folded at once, as if its
machine began there; the states that segments end with are then handed on to the segments that go on with the same key, and those are folded
again, until no handed state differs from what its segment was folded with. A machine whose state soon depends on its last restart alone, as
sessions and windows do, is done after two rounds; any other still ends, after as many rounds as a key has segments. Only segments that got another
state are folded again. Of a segment's keys only the first can have begun earlier, so there is at most one handed state a segment, and they pass through
the driver. Rows stream through in Arrow batches; the state of one key is held at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.storage import materialise
from webloom.session import ship

OUT = 10_000
#: Columns of a segment's number, and of the state that it ends with, beside a machine's fields.
PART, STATE = "_part", "_state"


def _folded(dealt: DataFrame, keys: list[str], order: list[str], columns: list[str], fields: str, machine: Callable, entries: dict[int, str], going_on: dict[int, bool]) -> DataFrame:
    """(_part, keys, fields, _state) of segments: a machine's rows, without a state; and for the last key of a segment that goes on in the next, the state alone."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"{PART} int, " + ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys) + f", {fields}, {STATE} string"
    out, names, n = to_arrow_schema(_parse_datatype_string(schema)), [PART, *keys], len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows, begun = None, None, [], set()

        def ended(last: bool):
            """The rows of a key's end; of a segment's last key, what it hands on."""
            head = dict(zip(names, now, strict=True))
            if last and going_on.get(now[0]):
                return [head | {STATE: json.dumps(state.state())}]
            return [head | r for r in state.end()]

        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or values[:n] != now:
                    if state is not None:
                        rows += ended(values[0] != now[0])
                    now, state = values[:n], machine()
                    if now[0] not in begun:
                        begun.add(now[0])
                        if entry := entries.get(now[0]):
                            state.restore(json.loads(entry))
                rows += [dict(zip(names, now, strict=True)) | r for r in state.add(*values[n:])]
            if len(rows) >= OUT:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
                rows = []
        if state is not None:
            rows += ended(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return dealt.select(PART, *keys, *order, *columns).repartition(PART).sortWithinPartitions(PART, *keys, *order).mapInArrow(run, schema)


def fold_segments(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fields: str, machine: Callable, segments: int | None = None) -> DataFrame:
    """(keys, fields) in the rows that a machine gives. ``machine()`` makes a key's state: ``add(*order, *columns)`` and ``end()`` each give a list
    of dicts of fields; ``state()`` gives it as JSON values, and ``restore()`` takes it back. ``segments``: how many there are at most; the shuffle's partitions unless given."""
    spark = df.sparkSession
    ship(spark)
    n = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*keys, *order, *columns).repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id())
    dealt = materialise(dealt, "segments")
    whole = F.struct(*keys)
    ends = {r[PART]: (r.low, r.high) for r in dealt.groupBy(PART).agg(F.min(whole).alias("low"), F.max(whole).alias("high")).collect()}
    parts = sorted(ends)
    # a segment goes on where the next one begins with the key that it ends with
    follows = {p: q for p, q in zip(parts, parts[1:], strict=False) if ends[p][1] == ends[q][0]}
    going_on = {p: True for p in follows}
    entries: dict[int, str] = {}
    todo, rounds, where = parts, [], {}
    while todo:
        some = dealt if len(todo) == len(parts) else dealt.where(F.col(PART).isin(todo))
        rounds.append(materialise(_folded(some, keys, order, columns, fields, machine, {p: s for p, s in entries.items() if p in set(todo)}, going_on), "fold"))
        where |= dict.fromkeys(todo, len(rounds) - 1)
        handed = {r[PART]: r[STATE] for r in rounds[-1].where(F.col(STATE).isNotNull()).select(PART, STATE).collect()}
        todo = sorted(q for p, q in follows.items() if p in handed and entries.get(q) != handed[p])
        entries |= {follows[p]: s for p, s in handed.items()}
    if not rounds:
        rounds, where = [_folded(dealt, keys, order, columns, fields, machine, {}, {})], {}
    out = None
    for i, r in enumerate(rounds):
        final = [p for p, k in where.items() if k == i]
        if final or not where:
            mine = r.where(F.col(STATE).isNull())
            mine = (mine if len(final) == len(parts) else mine.where(F.col(PART).isin(final))).drop(PART, STATE)
            out = mine if out is None else out.unionByName(mine)
    return out


class Sessions:
    """Sessions of a key that end when idle for too long or after a lifetime, counted from their opening; the row
    that finds its session ended opens the next one."""

    FIELDS = "opened long, last_at long, n long, ended string"

    def __init__(self, idle: int, life: int):
        self.idle, self.life, self.opened, self.last, self.n = idle, life, None, None, 0

    def state(self) -> list:
        return [self.opened, self.last, self.n]

    def restore(self, state: list) -> None:
        self.opened, self.last, self.n = state

    def _row(self, why: str) -> list[dict]:
        return [{"opened": self.opened, "last_at": self.last, "n": self.n, "ended": why}]

    def add(self, at: int, *_) -> list[dict]:
        out = []
        if self.opened is not None:
            why = "idle" if at - self.last > self.idle else "lifetime" if at - self.opened > self.life else None
            if why:
                out, self.opened = self._row(why), None
        if self.opened is None:
            self.opened, self.n = at, 0
        self.last, self.n = at, self.n + 1
        return out

    def end(self) -> list[dict]:
        return self._row("idle")


class Captures:
    """Windows of a page's requests. A window opens with a content request; it closes when none was in flight for
    ``quiet``, or at ``cap`` after its opening, whatever is in flight. Trackers are counted but keep nothing open.
    Only the first ``most`` requests of a window are recorded."""

    FIELDS = "opened long, closes long, n_content long, n_hits long, n_trackers long, outcome string"

    def __init__(self, quiet: int, cap: int, most: int):
        self.quiet, self.cap, self.most = quiet, cap, most
        self.opened, self.busy, self.n, self.hits, self.trackers, self.threw = None, 0, 0, 0, 0, False

    def state(self) -> list:
        return [self.opened, self.busy, self.n, self.hits, self.trackers, self.threw]

    def restore(self, state: list) -> None:
        self.opened, self.busy, self.n, self.hits, self.trackers, self.threw = state

    def _closes(self) -> int:
        return min(self.busy + self.quiet, self.opened + self.cap)

    def end(self) -> list[dict]:
        if self.opened is None:
            return []
        capped = self.busy + self.quiet > self.opened + self.cap
        outcome = ("window_closed" if capped else "quiesced") if self.hits else "threw" if self.threw else "no_intercepts"
        return [{"opened": self.opened, "closes": self._closes(), "n_content": min(self.n, self.most), "n_hits": self.hits, "n_trackers": self.trackers, "outcome": outcome}]

    def add(self, at: int, seq: int, done: int, tracker: bool, hit: bool, threw: bool) -> list[dict]:
        out = []
        if self.opened is not None and at > self._closes():
            out, self.opened = self.end(), None
        if tracker:
            if self.opened is not None:
                self.trackers += 1
            return out
        if self.opened is None:
            self.opened, self.busy, self.n, self.hits, self.trackers, self.threw = at, done, 0, 0, 0, False
        self.n, self.busy, self.threw = self.n + 1, max(self.busy, done), self.threw or threw
        self.hits += hit and self.n <= self.most
        return out
