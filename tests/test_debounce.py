"""Firings by keyed state and timers, against a fold over each key's events."""

import random
import time

import pytest

from millrace.streaming.debounce import Debounce, Waits, debounced
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRED = "k string, first_us long, fired_us long, n long"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def folded(times, waits):
    out, first, last, n, fired = [], None, None, 0, None
    for t in sorted(times):
        if n and t > (due := waits.due(first, last, fired)):
            out.append((first, due, n))
            first, n, fired = None, 0, due
        first, last, n = t if n == 0 else first, t, n + 1
    return [*out, (first, waits.due(first, last, fired), n)] if n else out


def test_due_is_quiet_or_deadline_but_not_before_the_interval():
    waits = Waits.seconds(1, 5, 4)
    second = 1_000_000
    assert waits.due(0, 0, None) == second and waits.due(0, 4 * second + 500_000, None) == 5 * second
    assert waits.due(10 * second, 10 * second, 8 * second) == 12 * second
    for bad in ((0, 1, 0), (2, 1, 0), (1, 2, -1)):
        with pytest.raises(ValueError):
            Waits.seconds(*bad)


def test_event_time_firings_are_those_of_a_fold(rocks, tmp_path):
    r, waits = random.Random(5), Waits.seconds(60, 150, 100)
    start = 1_700_000_000_000_000
    events = [(k, start + r.randrange(0, 4000 * 10**6)) for k in "aaaaaaaabbbc" for _ in range(20)]
    events += [("a", events[0][1])] * 3 + [(None, start), ("b", None)]
    cuts = [start + 1300 * 10**6, start + 2600 * 10**6, start + 10**12]
    parts = [[e for e in events if e[1] is not None and (cuts[i - 1] if i else 0) < e[1] <= cut] for i, cut in enumerate(cuts)]
    parts[0].append(("b", None))
    for turn, rows in enumerate([*parts, [("end", start + 10**13)]]):
        made = rocks.createDataFrame(rows, "k string, us long").select("k", F.timestamp_micros("us").alias("ts"), F.lit("other").alias("at"))
        made.write.parquet(f"{tmp_path}/in/{turn}")
        stream = debounced(rocks.readStream.schema("k string, ts timestamp, at string").parquet(f"{tmp_path}/in/*"), "k", "ts", waits, "0 seconds")
        sink = stream.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{batch}"))
        sink.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(x) for x in rocks.read.schema(FIRED).parquet(f"{tmp_path}/out/*").collect())
    want = sorted((k, *x) for k in "abc" for x in folded([t for key, t in events if key == k and t is not None], waits))
    assert got == want and len(want) > 20 and any(n > 3 for *_, n in want)


def test_processing_time_fires_without_further_events(rocks, tmp_path):
    """Two events of a key fire once, after the quiet time, though no event comes after them."""
    stream = debounced(rocks.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in/*"), "k", "ts", Waits.seconds(2, 20))
    rocks.createDataFrame([("a",), ("a",), ("b",)], "k string").withColumn("ts", F.lit(None).cast("timestamp")).write.parquet(f"{tmp_path}/in/0")
    query = stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 60
        while rocks.table("fired").count() < 2 and time.monotonic() < until:
            time.sleep(1)
        assert sorted((x["k"], x["n"], x["fired_us"] - x["first_us"]) for x in rocks.table("fired").collect()) == [("a", 2, 2_000_000), ("b", 1, 2_000_000)]
    finally:
        query.stop()


def test_state_is_read_and_written_once_however_many_firings():
    calls, timers = [], set()

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        getValueState = lambda self, name, kind: Value()
        listTimers = lambda self: calls.append("list") or list(timers)
        registerTimer = lambda self, at: timers.add(at)
        deleteTimer = lambda self, at: timers.remove(at)

    waits, second = Waits.seconds(1, 5), 1_000_000
    made = Debounce("k", waits, True)
    made.init(Handle())
    fired = []
    for batch in range(2):
        fired += made.handleInputRows(("a",), iter([{"at": (100 * batch + k) * 2 * second} for k in range(100)]), None)
    assert [(x["first_us"], x["fired_us"], x["n"]) for x in fired] == folded([k * 2 * second for k in range(200)], waits)[:-1]
    assert len(calls) <= 4 and timers == {399_000}
