"""Idle closing of connections, by the clock and by the rows' times."""

import datetime
import random
import time

import pytest

from halyard.streaming import connections

ROW = "connection string, kind string, instance string, at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def feed(spark, folder, name, rows):
    df = spark.createDataFrame([(c, k, i, T0 + datetime.timedelta(seconds=s)) for c, k, i, s in rows], ROW)
    df.coalesce(1).write.parquet(str(folder / f".{name}"))
    next((folder / f".{name}").glob("*.parquet")).rename(folder / f"{name}.parquet")


def closed(spark, out):
    got = spark.read.schema(connections.CLOSED).parquet(str(out)).collect()
    seconds = lambda t: (t.replace(tzinfo=None) - T0).total_seconds()
    return sorted((r.connection, seconds(r.opened), seconds(r.closed), r.transfers, r.in_flight, r.reason) for r in got)


def test_one_connection_is_held_open_over_its_timer(spark, tmp_path):
    """By the clock: a closes a second after its last end; b's timer fires while a transfer is open, and b closes after that one's end only."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    feed(spark, src, "1", [("a", "start", "1", 0), ("a", "end", "1", 1), ("b", "start", "1", 0), ("b", "start", "2", 0), ("b", "end", "1", 1), ("c", "start", "9", 0)])
    with connections.state_in_rocksdb(spark):
        stream = spark.readStream.schema(ROW).parquet(str(src))
        q = connections.idle_close(stream, 1000).writeStream.format("memory").queryName("lines").outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        def wait(names, seconds=90):
            end = time.time() + seconds
            while time.time() < end:
                q.exception() and pytest.fail(str(q.exception()))
                got = {r.connection: r for r in spark.table("lines").collect()}
                if names <= set(got):
                    return got
                time.sleep(0.2)
            raise AssertionError(f"{names} not closed")

        first = wait({"a"})
        assert first["a"].transfers == 1 and first["a"].reason == "idle" and (first["a"].closed - first["a"].opened).total_seconds() >= 1
        time.sleep(4)  # several timers of b
        assert {r.connection for r in spark.table("lines").collect()} == {"a"}
        feed(spark, src, "2", [("b", "end", "2", 9), ("c", "abort", None, 9)])
        rest = wait({"a", "b", "c"})
        assert (rest["b"].transfers, rest["b"].in_flight, rest["b"].reason) == (2, 0, "idle")
        assert (rest["c"].in_flight, rest["c"].reason) == (1, "aborted")
        feed(spark, src, "3", [("a", "start", "7", 20), ("a", "end", "7", 21)])  # a new connection of the same name
        end = time.time() + 60
        while spark.table("lines").where("connection = 'a'").count() < 2 and time.time() < end:
            time.sleep(0.2)
        assert spark.table("lines").where("connection = 'a'").count() == 2
    finally:
        q.stop()


def brute(rows, delay):
    out, state = [], {}
    for c, k, i, s in sorted(rows, key=lambda r: (r[3], ("start", "end", "abort").index(r[1]))):
        line = state.get(c)
        if line and line["last"] is not None and not line["open"] and s >= line["last"] + delay:
            out.append((c, line["opened"], line["last"] + delay, line["n"], 0, "idle"))
            line = state[c] = None
        if line is None:
            if k == "abort":
                continue
            line = state[c] = {"opened": s, "open": [], "n": 0, "last": None}
        if k == "abort":
            out.append((c, line["opened"], s, line["n"], len(line["open"]), "aborted"))
            state[c] = None
        elif k == "start":
            line["open"].append(i)
            line["n"] += 1
            line["last"] = None
        else:
            if i in line["open"]:
                line["open"].remove(i)
            line["last"] = s
    return out, state


@pytest.mark.parametrize("batches", [1, 4])
def test_by_event_time_batches_do_not_matter(spark, tmp_path, batches):
    """A timer that fires while a transfer is open is armed again by the delay, as long as the transfer is."""
    rnd = random.Random(6)
    rows = []
    for c in "abcde":
        t = 0
        for i in range(25):
            t += rnd.choice([1, 3, 8, 40, 90])
            rows.append((c, "start", str(i % 7), t))
            rows.append((c, "end", str(i % 7), t + rnd.choice([1, 2, 15, 60])))
        if c == "e":
            rows.append((c, "abort", None, t // 2))
    rows.sort(key=lambda r: r[3])
    want, left = brute(rows, 30)
    last = max(r[3] for r in rows)
    rows.append(("z", "start", "0", last + 10_000))  # moves the watermark past all timers
    want += [(c, x["opened"], x["last"] + 30, x["n"], 0, "idle") for c, x in left.items() if x and x["last"] is not None and not x["open"]]
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    n = -(-len(rows) // batches)
    for b in range(batches):
        feed(spark, src, str(b), rows[b * n : (b + 1) * n])
        with connections.state_in_rocksdb(spark):
            stream = spark.readStream.schema(ROW).parquet(str(src))
            connections.idle_close(stream, 30_000, "1 second").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination()
    got = closed(spark, out)
    assert [(c, o, n, f, r) for c, o, _, n, f, r in got] == [(c, o, n, f, r) for c, o, _, n, f, r in sorted(want)]
    assert got == sorted(want)


def test_state_is_asked_once_for_all_rows_of_a_batch():
    """Each call is a trip to the state store: their number must not follow the rows."""
    calls = []

    class State:
        def __init__(self):
            self.value, self.entries = None, {}

        def __getattr__(self, name):
            calls.append(name)
            return {
                "get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v), "clear": lambda: (setattr(self, "value", None), self.entries.clear()),
                "iterator": lambda: iter(self.entries.items()), "keys": lambda: iter(self.entries), "values": lambda: iter(self.entries.values()), "containsKey": lambda k: k in self.entries,
                "getValue": lambda k: self.entries.get(k), "updateValue": lambda k, v: self.entries.update({k: v}), "removeKey": lambda k: self.entries.pop(k),
                "registerTimer": lambda at: None, "deleteTimer": lambda at: None, "getCurrentProcessingTimeInMs": lambda: 0,
            }[name]

    def made(n):
        calls.clear()
        it, store = connections.IdleClose(1000, True), State()
        it.handle, it.flying, it.line = store, State(), State()
        rows = [{"kind": k, "instance": str(i), "at": T0 + datetime.timedelta(seconds=60 * i + s)} for i in range(n) for s, k in enumerate(("start", "end"))]
        out = list(it.handleInputRows(("a",), iter(rows), store))
        assert len(out) == n - 1 and it.flying.entries == {} and it.line.value[1] == 1
        return len(calls)

    assert made(200) == made(2)
