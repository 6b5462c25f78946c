import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.operators import temporal
from kinelake.streaming import history, wire


def test_rules():
    h = history.History(1.0, 4)
    assert not h.append(0.0, 1, None) and not h.append(0.5, 2, None)
    h.append(0.5, 3)
    assert [v for _, v in h.items] == [1, 3]
    with pytest.raises(ValueError):
        h.append(0.4, 9)
    assert h.append(0.6, 4, "other") and len(h.items) == 1
    for t in (1.0, 1.5, 2.0, 2.5, 3.0):
        h.append(t, t, "other")
    assert [t for t, _ in h.items] == [2.0, 2.5, 3.0]
    assert h.last(5) == [2.0, 2.0, 2.0, 2.5, 3.0]
    with pytest.raises(ValueError):
        h.append(float("nan"), 0)
    with pytest.raises(ValueError):
        history.History(1.0).select(1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=40, unique=True))
def test_select_never_looks_ahead(ticks):
    h = history.History(2.0)
    for t in sorted(ticks):
        h.append(t / 100, t)
        for valid, offset, v in h.select(0.5, 10):
            assert offset <= 0 and v <= t


def _one_by_one(rows, horizon, capacity, length, freq):
    """Brute force: the rules applied row by row."""
    items, context, out = [], None, []
    offsets = temporal.history_offsets(length, freq)
    for ts, value, ctx in sorted(rows, key=lambda r: r[0]):
        cleared = bool(items) and ctx != context
        kept = [] if cleared else items
        if kept and ts < kept[-1][0]:
            out.append((ts, "time fell"))
            continue
        kept = [x for x in kept if x[0] != ts] + [(ts, value)]
        context, kept = ctx, kept[-capacity:]
        old = [x for x in kept if x[0] <= ts - horizon]
        items = old[-1:] + [x for x in kept if x[0] > ts - horizon]
        for o in offsets:
            upto = [x for x in items if x[0] - ts <= o + 1e-9]
            got = upto[-1] if upto else items[0]
            out.append((ts, bool(upto) and o - (got[0] - ts) <= 1 / freq + 1e-9, got[1], cleared))
    return items, context, out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.sampled_from("cd")), max_size=12), min_size=1, max_size=4), st.integers(1, 5))
def test_lines_equal_row_by_row(triggers, capacity):
    """Equal times, falling times and changing contexts, over several triggers."""
    kept, slow, serial = history.Line(np.zeros(0), np.zeros(0)), ([], None), 0
    for trigger in triggers:
        rows = [(t / 4, float(serial + i), c) for i, (t, c) in enumerate(trigger)]
        serial += len(rows)
        line, order, fault, cleared = history.extended(kept, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], 0.5, capacity)
        got, at = [], len(line.times) - int((fault == "").sum())
        for i, o in enumerate(order):
            if fault[i]:
                got.append((rows[o][0], fault[i]))
                continue
            valid, place = line.seen(np.array([at]), 0.5, 4.0)
            got += [(rows[o][0], bool(v), line.values[p], bool(cleared[i])) for v, p in zip(valid[0], place[0])]
            at += 1
        items, context, want = _resumed(slow, rows, capacity)
        assert got == want
        kept, slow = line.trimmed(), (items, context)
        assert list(zip(kept.times, kept.values)) == items


def _resumed(state, rows, capacity):
    """The row-by-row rules behind what was kept."""
    items, context = state
    out = []
    for row in sorted(rows, key=lambda r: r[0]):
        past = [(t, v, context) for t, v in items]
        if past and row[2] == context and row[0] < past[-1][0]:
            out.append((row[0], "time fell"))
            continue
        same = past if row[2] == context else []
        items, _, told = _one_by_one([*same, row], 0.5, capacity, 0.5, 4.0)
        told = told[-len(temporal.history_offsets(0.5, 4.0)) :]
        out += [(*x[:3], bool(past) and not same) for x in told]
        context = row[2]
    return items, context, out


def test_stream_in_batches(spark, tmp_path):
    schema = "stream string, ts double, value double, context string"
    parts = [[("a", 0.0, 1.0, "c"), ("a", 0.1, 2.0, "c"), ("b", 5.0, 9.0, None)], [("a", 0.2, 3.0, "c"), ("a", 0.05, 7.0, "c")], [("a", 0.3, 4.0, "d"), ("b", 5.0, 8.0, None)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = history.replayed(stream, 0.2, 10.0).collect()
    errors = [r for r in got if r.error]
    assert len(errors) == 1 and errors[0].now == 0.05
    last = sorted((r.k, r.valid, r.value) for r in got if r.stream == "a" and r.now == 0.2 and not r.error)
    assert last == [(0, True, 2.0), (1, True, 3.0)]
    fresh = [r for r in got if r.stream == "a" and r.now == 0.3]
    assert all(r.cleared for r in fresh) and {r.value for r in fresh} == {4.0}
    assert {r.value for r in got if r.stream == "b" and r.k == 1} == {9.0, 8.0}


def settle(q, rows):
    """Waits for input; a query with timers runs on without any."""
    until = time.time() + 40
    while sum(p.numInputRows for p in q.recentProgress) < rows and time.time() < until and q.isActive:
        time.sleep(0.2)


def test_live_state_expires(spark, tmp_path):
    schema = "stream string, ts double, value double, context string"
    spark.createDataFrame([("a", 0.0, 1.0, "c")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", history.ROCKS)
    try:
        q = history.live_history(stream, 0.2, 10.0, ttl_ms=300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).start()
        settle(q, 1)
        time.sleep(1)
        # an earlier time is no error any more
        spark.createDataFrame([("a", -5.0, 2.0, "c")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        settle(q, 2)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.now, r.error) for r in got} == {(0.0, None), (-5.0, None)}


def test_event_time_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", f"2025-01-01 00:0{i}:00", float(i)) for i in range(6)], "stream string, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = history.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 minute", "2 minutes").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.n, r["mean"]) for r in spark.table("w").collect()} >= {(2, 0.5)}


def test_wire(spark):
    x = {"a": np.arange(6, dtype=np.int16).reshape(2, 3), "b": [np.float32(1.5), {"c": np.zeros(0)}], "d": "t"}
    y = wire.decode(__import__("json").loads(__import__("json").dumps(wire.encode(x))))
    assert np.array_equal(y["a"], x["a"]) and y["a"].dtype == np.int16 and y["b"][0] == 1.5 and len(y["b"][1]["c"]) == 0
    df = spark.createDataFrame([([0.0, 10.0],), ([5.0, 5.0],)], "s array<double>")
    got = wire.answered(df, lambda v: -v, "s", [0.0, 0.0], [10.0, 10.0]).collect()
    assert np.allclose([r.action for r in got], [[10, 0], [5, 5]], atol=1e-5)
    back = df.select(wire.from_wire(wire.to_wire("s")).alias("s")).collect()
    assert [r.s for r in back] == [[0.0, 10.0], [5.0, 5.0]]


def test_answered_chunks(spark):
    """Relative slices come back absolute, unscaled ones stay, the first steps are the prefix."""
    from kinelake.spec import GRIP, chain

    space = chain(("arm", 2, {"rep": "rel"}), ("gripper", 1, GRIP))
    norm = {"state": ([0.0] * 3, [10.0] * 3), "action": ([-1.0] * 3, [1.0] * 3)}
    prefix = [[[6.0, 5.0, 0.25], [7.0, 5.0, 0.5]]]
    df = spark.createDataFrame([([5.0, 5.0, 0.5], prefix[0], 1)], "s array<double>, p array<array<double>>, n int")

    def model(x, held, steps):
        assert held.shape == (1, 3, 3) and steps.tolist() == [1] and abs(held[0, 0, 0] - 1) < 1e-5  # 6 - 5 is the top of the range
        return np.stack([x * 0 + k / 4 for k in range(3)], 1)

    got = np.array(wire.answered_chunks(df, model, "s", space, norm, 3, "p", "n").first().action)
    assert np.allclose(got[0], prefix[0][0]) and np.allclose(got[1:, :2], [[5.25, 5.25], [5.5, 5.5]], atol=1e-4) and np.allclose(got[1:, 2], [0.25, 0.5], atol=1e-4)
    plain = np.array(wire.answered_chunks(df, lambda x: np.zeros((len(x), 2, 3)), "s", space, norm, 2).first().action)
    assert np.allclose(plain, [[5, 5, 0]] * 2, atol=1e-4)
    masked = wire.answered(df.select("s"), lambda v: v, "s", [0.0] * 3, [10.0] * 3, [True, True, False]).first().action
    assert np.allclose(masked, [5, 5, 0.5], atol=1e-5)
