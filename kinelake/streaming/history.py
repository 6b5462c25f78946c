"""Bounded observation history of live streams, as a stateful operator.

A trigger's rows of a stream are laid behind what was kept of it, in order of
time, and looked up as one line: runs of equal time are one observation whose
last row counts, a change of context begins a new line, and each row sees back
to the bound of ``capacity`` observations and to one observation beyond the
horizon. Lookups are binary searches over the line, for all rows and targets at
once. State per stream is that line, trimmed to what the next row can see, as
two array columns, and the context; it expires when a stream is silent for
``ttl``.

Defined results: a time before that of the last observation kept, or one that
is not finite, is an error of the stream: it changes nothing and comes out with
``error`` set, so that one bad client does not end the query. Null is a
context. A trigger's rows of one stream are one task's: the source's rate
options bound them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinelake.operators import temporal
from kinelake.operators.temporal import MAX_HISTORY, history_offsets

OUT = "stream string, now double, k bigint, valid boolean, offset double, value double, cleared boolean, error string"
KEPT = "times array<double>, seen array<double>, context string"
EMITTED = 10_000  # rows of one output batch
DAY_MS = 24 * 3600 * 1000


@dataclass
class Line:
    """Observations in order: what was kept, then a trigger's accepted rows.

    ``first``: where each row's view begins; ``last``: the row that counts of
    each run of equal time; ``split``: where the first change of context is,
    behind which times rise again.
    """

    times: np.ndarray
    values: np.ndarray
    context: object = None
    split: int = 0
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def before(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The last place at or before each time, on the same side of ``split`` as ``rows`` and not behind them."""
        old = np.searchsorted(self.times[: self.split], times, side="right")
        new = self.split + np.searchsorted(self.times[self.split :], times, side="right")
        return np.minimum(np.where(rows < self.split, old, new) - 1, rows)

    def seen(self, rows: np.ndarray, length: float, freq: float) -> tuple[np.ndarray, np.ndarray]:
        """(valid, place) of each row's targets, oldest first, as two matrices."""
        offsets = np.array(history_offsets(length, freq))
        now, begin = self.times[rows], self.first[rows]
        slack = np.maximum(1e-9, 2 * np.spacing(np.maximum(np.abs(now), np.abs(self.times[begin]))))
        wide = np.repeat(rows, len(offsets))
        at = self.before(wide, (now[:, None] + offsets + slack[:, None]).ravel()).reshape(len(rows), -1)
        place = np.maximum(at, np.minimum(self.last[begin], rows)[:, None])
        age = offsets - (self.times[place] - now[:, None])
        return (at >= begin[:, None]) & (age <= 1 / freq + slack[:, None]), place

    def trimmed(self) -> Line:
        """What the next row can see of it."""
        if not len(self.times):
            return self
        keep = np.arange(self.first[-1], len(self.times))
        keep = keep[self.last[keep] == keep]
        return Line(self.times[keep], self.values[keep], self.context)


def extended(kept: Line, times: np.ndarray, values: np.ndarray, contexts: list, horizon: float, capacity: int) -> tuple[Line, np.ndarray, np.ndarray, np.ndarray]:
    """The line with new rows behind what was kept: (line, order, fault, cleared).

    ``order`` sorts the rows by time; ``fault`` and ``cleared`` are in that
    order, empty text where a row was accepted; accepted rows are the line's last.
    """
    order = np.argsort(times, kind="stable")
    times, values = times[order], values[order]
    codes = pd.factorize(pd.Series([kept.context, *(contexts[i] for i in order)], dtype=object), use_na_sentinel=False)[0]
    finite, k = np.isfinite(times), len(kept.times)
    # rows in order of time fall behind only what was kept, and only until another context begins
    moved = np.logical_or.accumulate(finite & (codes[1:] != codes[0])) if k else np.ones(len(times), bool)
    late = finite & ~moved & (times < kept.times[-1]) if k else np.zeros(len(times), bool)
    fault = np.where(~finite, "time is not finite", np.where(late, "time fell", ""))
    use = np.flatnonzero(fault == "")
    code = codes[1:][use]
    turn = np.diff(np.concatenate([codes[:1] if k else code[:1], code])) != 0
    cleared = np.zeros(len(times), bool)
    cleared[use] = turn
    t, v = np.concatenate([kept.times, times[use]]), np.concatenate([kept.values, values[use]])
    turn = np.concatenate([np.zeros(k, bool), turn])
    here = np.arange(len(t))
    fresh = turn | (np.diff(t, prepend=np.nan) != 0)
    run = np.cumsum(fresh) - 1
    line = Line(t, v, contexts[order[use[-1]]] if len(use) else kept.context, int(np.flatnonzero(turn)[0]) if turn.any() else len(t))
    line.last = np.append(np.flatnonzero(fresh)[1:], len(t))[run] - 1 if len(t) else run
    begin = np.maximum.accumulate(np.where(turn, here, 0)) if len(t) else here
    bound = np.searchsorted(run, run - capacity + 1)
    line.first = np.maximum(np.maximum(begin, bound), line.before(here, t - horizon))
    return line, order, fault, cleared


class History:
    """The history of one stream in memory, row by row: times in seconds, values of any kind."""

    def __init__(self, horizon: float, capacity: int = MAX_HISTORY):
        if not (np.isfinite(horizon) and horizon >= 0 and capacity >= 1):
            raise ValueError("history needs a horizon and a capacity")
        self.horizon, self.capacity = horizon, capacity
        self.line = Line(np.zeros(0), np.zeros(0, object))

    @property
    def items(self) -> list[tuple[float, object]]:
        kept = self.line.trimmed()
        return list(zip(kept.times.tolist(), kept.values))

    def append(self, ts: float, value, context=None) -> bool:
        """Whether a changed context cleared the history; times that are not finite or fall raise."""
        box = np.empty(1, object)
        box[0] = value
        line, _, fault, cleared = extended(self.line.trimmed(), np.array([ts], float), box, [context], self.horizon, self.capacity)
        if fault[0]:
            raise ValueError(str(fault[0]))
        self.line = line
        return bool(cleared[0])

    def select(self, length: float, freq: float) -> list[tuple[bool, float, object]]:
        """(valid, offset, value) of each target, oldest first."""
        n = len(self.line.times)
        if not n:
            raise ValueError("no observations")
        valid, place = self.line.seen(np.array([n - 1]), length, freq)
        return [(bool(ok), float(self.line.times[i] - self.line.times[-1]), self.line.values[i]) for ok, i in zip(valid[0], place[0])]

    def last(self, n: int) -> list:
        """The last n values, the oldest repeated before it (the older kind of history)."""
        values = [v for _, v in self.items][-n:]
        return [values[0]] * (n - len(values)) + values


class HistoryProcessor(StatefulProcessor):
    def __init__(self, length: float, freq: float, capacity: int = MAX_HISTORY, ttl_ms: int | None = DAY_MS):
        history_offsets(length, freq)
        self.length, self.freq, self.capacity, self.ttl_ms = length, freq, capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", KEPT, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = Line(np.zeros(0), np.zeros(0))
        if self.kept.exists():
            times, seen, context = self.kept.get()
            kept = Line(np.array(times, float), np.array(seen, float), context)
        batch = pd.concat([p[["ts", "value", "context"]] for p in rows])
        contexts = batch["context"].astype(object).where(batch["context"].notna(), None).tolist()
        times = batch["ts"].to_numpy(float, na_value=np.nan)
        line, order, fault, cleared = extended(kept, times, batch["value"].to_numpy(float, na_value=np.nan), contexts, self.length, self.capacity)
        bad, ok = np.flatnonzero(fault != ""), np.flatnonzero(fault == "")
        after = line.trimmed()
        self.kept.update((after.times.tolist(), after.values.tolist(), after.context))
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = {"k": "Int64", "valid": "boolean", "offset": "float64", "value": "float64", "cleared": "boolean"}
        if len(bad):
            yield pd.DataFrame({"stream": key[0], "now": times[order[bad]], "k": None, "valid": None, "offset": None, "value": None, "cleared": None, "error": fault[bad]})[names].astype(kinds)
        begin = len(line.times) - len(ok)
        for a in range(0, len(ok), EMITTED):
            part = np.arange(begin + a, begin + min(a + EMITTED, len(ok)))
            valid, place = line.seen(part, self.length, self.freq)
            n, width = valid.shape
            now = np.repeat(line.times[part], width)
            out = {"stream": key[0], "now": now, "k": np.tile(np.arange(width), n), "valid": valid.ravel(), "offset": line.times[place.ravel()] - now}
            out |= {"value": line.values[place.ravel()], "cleared": np.repeat(cleared[ok[a : a + EMITTED]], width), "error": None}
            yield pd.DataFrame(out)[names].astype(kinds)

    def close(self) -> None:
        pass


def live_history(stream: DataFrame, length: float, freq: float, capacity: int = MAX_HISTORY, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """(stream, now, k, valid, offset, value, ...) per observation of a (stream, ts, value, context) stream.

    ``ttl_ms``: a stream that is silent for so long is forgotten; None keeps all,
    for streams that end.
    """
    # stateful workers take no shipped files: what the processor needs travels with it
    for module in (sys.modules[__name__], temporal):
        if module.__name__ not in cloudpickle.list_registry_pickle_by_value():
            cloudpickle.register_pickle_by_value(module)
    return stream.select("stream", "ts", "value", "context").groupBy("stream").transformWithStateInPandas(HistoryProcessor(length, freq, capacity, ttl_ms), OUT, "append", "none" if ttl_ms is None else "processingTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(stream: DataFrame, length: float, freq: float) -> DataFrame:
    """All of a finite stream run through the processor, as a table in the shared folder."""
    import uuid

    from kinelake.session import shared_dir

    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    try:
        q = live_history(stream, length, freq, ttl_ms=None).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUT).parquet(f"{base}/out")


def windowed(stream: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and means of a (ts timestamp, stream, value) stream by event-time window, late rows dropped by watermark."""
    from pyspark.sql import functions as F

    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = stream.withWatermark("ts", late).groupBy(win.alias("w"), "stream").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return by.select("stream", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")
