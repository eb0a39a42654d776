"""Count windows and time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core import BUCKET, OrderedStream
from .fold import fold

#: Copies of each element up to which windows are made by ids.
COPIES = 16


def _check(size: int, step: int) -> None:
    if not (isinstance(size, int) and isinstance(step, int) and not isinstance(size, bool) and not isinstance(step, bool) and size > 0 and step > 0):
        raise ValueError("window size and step are positive integers")


def _started(stream: OrderedStream, size: int, initial_value) -> OrderedStream:
    """The stream after size copies of initial_value, if there is one: its first window is of those."""
    return stream if initial_value is None else stream.prepend([initial_value] * size)


def window(stream: OrderedStream, size: int, step: int, *aggregates: Column, initial_value=None) -> DataFrame:
    """keys, w and aggregates of the elements w * step to w * step + size - 1, for full windows only.

    Windows get ids and are grouped, so even a single long stream is spread over all tasks, with partial
    aggregates before the shuffle.  Each element goes to size / step windows: where size == step to one,
    and where step > size the gaps are dropped first.  For long windows with small steps see reduce_window.
    """
    _check(size, step)
    stream = _started(stream, size, initial_value)
    n = stream.n
    if step >= size:
        rows = stream.df if step == size else stream.df.filter(n % step < size)
        rows = rows.withColumn("w", F.floor(n / step).cast("long"))
    else:
        low = F.greatest(F.ceil((n - size + 1) / step), F.lit(0))
        rows = stream.df.withColumn("w", F.explode(F.sequence(low.cast("long"), F.floor(n / step).cast("long"))))
    out = rows.groupBy(*stream.keys, "w").agg(F.count("*").alias("__n"), *aggregates)
    return out.filter(F.col("__n") == size).drop("__n")


#: How reduce_window makes a value of panes' values: what a pane keeps, and what a window makes of those.
PANES: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def reduce_window(stream: OrderedStream, size: int, step: int, how: str, initial_value=None) -> DataFrame:
    """keys, w and value: sum, count, avg, min or max of full windows, by the strategy that fits size and step.

    Few copies of each element (size / step up to COPIES) go by window ids.  Otherwise elements are first
    reduced to panes of gcd(size, step); windows over panes go by ids if that makes copies few enough, else
    by a row frame in buckets of positions with a halo, which a long unkeyed stream is spread by, too.
    """
    _check(size, step)
    if how == "avg":
        total = reduce_window(stream, size, step, "sum", initial_value)
        return total.withColumn("value", F.col("value") / size)
    if how not in PANES:
        raise ValueError(f"sum, count, avg, min or max, not {how}")
    stream = _started(stream, size, initial_value)
    pane, whole = PANES[how]
    if size <= COPIES * step:
        return window(stream, size, step, pane(stream.value).alias("value"))
    g = gcd(size, step)
    if g > 1:
        panes = window(stream, g, g, pane(stream.value).alias("value")).withColumnRenamed("w", "seq")
        stream, pane, size, step = OrderedStream(panes, keys=stream.keys), whole, size // g, step // g
        if size <= COPIES * step:
            return window(stream, size, step, pane("value").alias("value"))
    return window_frame(stream, size, step, value=pane(stream.value)).select(*stream.keys, "w", "value")


def window_sums(stream: OrderedStream, size: int, step: int, *names: str) -> DataFrame:
    """keys, w and the named sums, cnt or avg (of sum, avg) of full windows, from differences of prefix sums.

    The work is the same for every size.  Sums of doubles may differ from direct sums in the last bits.
    A window partition holds a key's rows; an unkeyed stream goes in buckets with a halo.
    """
    _check(size, step)
    keys = list(stream.keys)
    rows = stream.df if keys else stream.halo(0, size, max(BUCKET, 4 * size))
    parts = keys or ["__b"]
    before = Window.partitionBy(*parts).orderBy(stream.seq)
    total = F.sum(stream.value).over(before.rowsBetween(Window.unboundedPreceding, 0))
    df = rows.withColumn("__s", total)
    start = F.coalesce(F.lag("__s", size).over(before), F.lit(0.0))
    df = df.withColumn("sum", F.col("__s") - start)
    df = df if keys else df.filter("__own")
    df = df.filter((stream.n + 1 >= size) & ((stream.n + 1 - size) % step == 0))
    df = df.withColumn("w", ((stream.n + 1 - size) / step).cast("long")).withColumn("avg", F.col("sum") / size)
    return df.select(*keys, "w", *names)


def window_frame(stream: OrderedStream, size: int, step: int, bucket: int | None = None, **aggregates: Column) -> DataFrame:
    """The same windows by a row frame: for step 1 and native aggregates.  An unkeyed stream, or one given a
    bucket, goes in buckets of positions with the size - 1 rows that follow."""
    _check(size, step)
    keys = list(stream.keys)
    spread = bucket or (None if keys else max(1 << 16, 4 * size))
    rows = stream.halo(size - 1, 0, spread) if spread else stream.df.filter("true")
    frame = Window.partitionBy(*keys, *(["__b"] if spread else [])).orderBy(stream.seq).rowsBetween(0, size - 1)
    df = rows.withColumns({**{k: a.over(frame) for k, a in aggregates.items()}, "__n": F.count("*").over(frame)})
    df = df.filter((stream.n % step == 0) & (F.col("__n") == size))
    df = df.filter("__own").drop("__b", "__own") if spread else df
    return df.withColumn("w", (stream.n / step).cast("long")).drop("__n")


def ordered(value: str, seq: str = "seq") -> Column:
    """An aggregate: the window's values as an array in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda x: x[value])


def window_list(stream: OrderedStream, size: int, step: int, f: Callable[[Column], Column], initial_value=None) -> DataFrame:
    """keys, w, pos, value: the elements of the arrays f(window)."""
    out = window(stream, size, step, ordered(stream.value, stream.seq).alias("__a"), initial_value=initial_value)
    return out.select(*stream.keys, "w", F.posexplode(f(F.col("__a"))).alias("pos", "value"))


def window_fold(stream: OrderedStream, size: int, step: int, f: Callable, initial: Callable[[], object], kind: str = "double", initial_value=None) -> OrderedStream:
    """f(window, state) -> (y, state) for a Python function of a list, window after window of each key; y may
    be NO_VALUE, None or Many, and the stream's positions are dense over what is emitted."""
    lists = window(stream, size, step, ordered(stream.value, stream.seq).alias("__a"), initial_value=initial_value)
    return OrderedStream(fold(OrderedStream(lists, "__a", "w", stream.keys), f, initial, kind, renumber=True), keys=stream.keys)


def startup_window(stream: OrderedStream, size: int, step: int, **aggregates: Column) -> DataFrame:
    """Windows that grow until size elements are there, then slide by step."""
    _check(size, step)
    keys = list(stream.keys)
    rows = stream.df if keys else stream.halo(0, size - 1, max(1 << 16, 4 * size))
    frame = Window.partitionBy(*(keys or ["__b"])).orderBy(stream.seq).rowsBetween(-(size - 1), 0)
    df = rows.withColumns({k: a.over(frame) for k, a in aggregates.items()})
    df = df if keys else df.filter("__own").drop("__b", "__own")
    return df.filter((stream.n + 1) % step == 0).withColumn("w", ((stream.n + 1) / step).cast("long") - 1)


def timed_window(df: DataFrame, duration: str, step: str, *aggregates: Column, time: str = "ts", keys: Iterable[str] = (), origin: str | None = None, closed_by: str = "stream") -> DataFrame:
    """keys, start, end and aggregates of event-time windows that have closed; empty windows don't appear, and
    neither do those whose aggregates are all null.

    A window [start, start + duration) closes when an element at or after its end has come: of any key
    (closed_by "stream") or of its own ("key").  origin: windows start at it and at each step after it;
    without one, at the steps since 1970.
    """
    keys = list(keys)
    end = df.groupBy(*keys).agg(F.max(time).alias("__last")) if closed_by == "key" and keys else df.agg(F.max(time).alias("__last"))
    offset, kind = "0 seconds", df.schema[time].dataType.simpleString()
    micros = lambda x: F.expr(f"unix_micros(timestamp_micros(0) + interval '{x}')")
    length, width = df.sparkSession.range(1).select(micros(duration), micros(step)).first()
    start = F.lit(origin).cast(kind)  # df's own kind of timestamp, with or without zone
    if origin:
        # The window function wants an offset within a step.
        at = F.unix_micros(start) if kind == "timestamp" else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', timestamp_ntz '{origin}')")
        offset = f"{df.sparkSession.range(1).select(at).first()[0] % width} microseconds"
    rows = df.filter(F.col(time) >= start) if origin else df
    if width > length:  # gaps between windows: steps that don't overlap, and what lies in the gaps goes
        rows = rows.withColumn("__w", F.window(time, step, step, offset)).filter(F.col(time) < F.col("__w.start") + F.expr(f"interval '{duration}'"))
        out = rows.groupBy(*keys, "__w").agg(*aggregates)
    else:
        out = rows.groupBy(*keys, F.window(time, duration, step, offset).alias("__w")).agg(*aggregates)
    if origin:
        out = out.filter(F.col("__w.start") >= start)
    out = out.join(end, keys) if closed_by == "key" and keys else out.crossJoin(F.broadcast(end))  # one row
    out = out.withColumns({"start": F.col("__w.start"), "end": F.col("__w.start") + F.expr(f"interval '{duration}'")}).filter(F.col("end") <= F.col("__last"))
    names = [c for c in out.columns if c not in (*keys, "__w", "__last", "start", "end")]
    if names:
        out = out.filter(~F.expr(" and ".join(f"`{c}` is null" for c in names)))
    return out.drop("__w", "__last")


def session_window(df: DataFrame, gap: str, *aggregates: Column, time: str = "ts", keys: Iterable[str] = ()) -> DataFrame:
    """keys, start, end and aggregates of sessions: runs of a key's elements less than gap apart; end is the
    last element's time plus the gap.  Not a refractory filter: for that see functions.signal.quench."""
    out = df.groupBy(*keys, F.session_window(time, gap).alias("__s")).agg(*aggregates)
    return out.withColumns({"start": F.col("__s.start"), "end": F.col("__s.end")}).drop("__s")


def window_python(stream: OrderedStream, size: int, step: int, f: Callable[[np.ndarray], object], kind: str, bucket: int = 1 << 16) -> DataFrame:
    """keys, w, value = f(window) for a Python function of an array, e.g. a long FIR filter or an FFT.

    The stream is dealt in buckets of positions, each with the size - 1 rows that follow it, so one long
    stream uses all tasks and a task holds one bucket.
    """
    _check(size, step)
    keys = list(stream.keys)
    rows = stream.halo(size - 1, 0, bucket).select(*keys, stream.n.alias("__n"), stream.v.cast("double").alias("__v"), "__b")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__n")
        start, values = int(group["__n"].iloc[0]), group["__v"].to_numpy()
        first, stop = int(group["__b"].iloc[0]) * bucket, (int(group["__b"].iloc[0]) + 1) * bucket
        ws = [w for w in range(-(-first // step), -(-stop // step)) if w * step - start + size <= len(values) and w * step >= start]
        out = pd.DataFrame({"w": np.asarray(ws, np.int64), "value": [f(values[w * step - start : w * step - start + size]) for w in ws]})
        for i, k in enumerate(keys):
            out.insert(i, k, group[k].iloc[0])
        return out

    key_schema = ", ".join(f"`{k}` {stream.df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys, "__b").applyInPandas(run, f"{key_schema + ', ' if keys else ''}w long, value {kind}")
