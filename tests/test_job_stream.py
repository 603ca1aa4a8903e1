"""Jobs on the state API over several batches."""

import datetime as dt

import pytest
from pyspark.sql import Row

from webloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "job long, ts timestamp, seq long, kind string, unit long, total long, text string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("jobs")
    batches = [
        [(1, at(0), 1, "unit", 1, 3, None), (1, at(1), 2, "unit", 1, 9, None), (2, at(0), 3, "unit", 1, 2, None), (2, at(3), 6, "cancel", None, 2, None), (2, at(2), 5, "error", None, 2, "late"), (3, at(0), 4, "ping", None, 1, None)],
        [(1, at(5), 7, "unit", 1, 3, None), (1, at(6), 8, "unit", 2, 3, None), (2, at(7), 9, "unit", 2, 2, None), (2, at(8), 10, "error", None, 2, "after"), (4, at(9), 11, "error", None, 5, None)],
        [(1, at(10), 12, "unit", 3, 3, None), (1, at(11), 13, "error", None, 3, "too late"), (5, at(200), 14, "unit", 1, 2, None)],
        [(3, at(201), 15, "unit", 7, 1, None), (5, at(202), 16, "unit", 2, 2, None)],
        [(6, at(500), 17, "ping", None, 1, None)],
    ]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{where}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{where}/in/*")
    q = jobs.job_stream(stream, life_s=3600, late="1 minute").writeStream.format("parquet").option("checkpointLocation", f"{where}/state").option("path", f"{where}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(jobs.OUT).parquet(f"{where}/out").collect()


def of(rows, job):
    return [(r.version, r.status, r.completed, r.n_errors, r.errors) for r in sorted((r for r in rows if r.job == job), key=lambda r: (r.created, r.version))]


def test_units_count_once_and_end_a_job(rows):
    got = of(rows, 1)
    assert got[0] == (2, "scraping", 1, 0, []) and got[1] == (4, "scraping", 2, 0, []) and got[2] == (5, "completed", 3, 0, [])
    # further rows say the same: what comes after the end changes nothing
    assert set(got[2:]) == {got[2]} if not isinstance(got[2][4], list) else all(g == got[2] for g in got[2:])


def test_a_cancelled_job_takes_nothing_more(rows):
    assert {(v, s, c, n, tuple(e)) for v, s, c, n, e in of(rows, 2)} == {(3, "cancelled", 1, 1, ("late",))}


def test_lives_end(rows):
    # job 3 was open at its end, and begins anew with its next event; job 4 ends too
    assert [g[:3] for g in of(rows, 3)][:3] == [(1, "scraping", 0), (2, "expired", 0), (1, "completed", 1)]
    assert [g[1] for g in of(rows, 4)] == ["scraping", "expired"] and of(rows, 5)[-1][:3] == (2, "completed", 2)


class Kept:
    """Value, list and map state in memory, which counts its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.items = calls, None, {}

    def __getattr__(self, name):
        def call(*a):
            self.calls.append(name)
            if name == "get":
                return iter(self.value) if isinstance(self.value, list) else self.value
            if name in ("update", "put"):
                self.value = a[0]
            elif name == "containsKey":
                return a[0] in self.items
            elif name == "updateValue":
                self.items[a[0]] = a[1]
            elif name == "clear":
                self.value, self.items = None, {}

        return call


def machine():
    calls = []
    of = Kept(calls)
    of.getValueState = of.getListState = of.getMapState = lambda *a: Kept(calls)
    m = jobs.Jobs(3600)
    m.init(of)

    def batch(*rows):
        calls.clear()
        return [tuple(r) for r in m.handleInputRows((1,), (Row(job=1, ts=t, seq=s, kind=k, unit=u, total=n, text=x) for t, s, k, u, n, x in rows), None)], list(calls)

    return m, batch


def test_a_batch_costs_few_calls_of_the_state():
    m, batch = machine()
    rows, calls = batch(*[(at(i / 60), i, ("unit", "unit", "error")[i % 3], i % 40, 20, f"e{i}") for i in reversed(range(300))])
    assert [r[1:6] for r in rows] == [(29, "completed", 20, 20, 9)] and rows[0][6] == [f"e{i}" for i in range(2, 29, 3)]
    assert len(calls) <= 4 and m.units.items == {}
    rows, calls = batch(*[(at(6 + i / 60), 300 + i, "unit", i % 40, 20, None) for i in range(300)])
    assert rows[0][1:3] == (29, "completed") and len(calls) <= 2


def test_units_of_earlier_batches_are_asked_for_once():
    m, batch = machine()
    batch(*[(at(0), i, "unit", i % 5, 7, None) for i in range(10)])
    assert set(m.units.items) == {(i,) for i in range(5)}
    rows, calls = batch(*[(at(1), 10 + i, "unit", i % 6, 7, None) for i in range(60)])
    assert rows[0][1:5] == (70, "scraping", 7, 6) and calls.count("containsKey") == 6 and calls.count("updateValue") == 1
    rows, _ = batch((at(2), 70, "unit", 6, 7, None), (at(90), 71, "error", None, 3, None), (at(200), 72, "unit", 6, 3, None))
    assert [r[1:5] for r in rows] == [(2, "expired", 3, 0), (1, "scraping", 3, 1)] and set(m.units.items) == {(6,)}
