"""Operators with several inputs: by position, by arrival and by time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core import OrderedStream, dense_positions
from .fold import fold, fold_many


def zip_streams(streams: Sequence[OrderedStream]) -> DataFrame:
    """Keys, seq and columns v0, v1, …: the streams by position, as far as the shortest goes.

    Streams of one root are projections of the same rows, so no join is needed.
    """
    if not streams:
        raise ValueError("nothing to zip")
    first = streams[0]
    if all(s.root is first.root and s.keys == first.keys and s.seq == first.seq for s in streams):
        return first.root.select(*first.keys, F.col(first.seq).alias("seq"), *(s.expr.alias(f"v{i}") for i, s in enumerate(streams)))
    parts = [s.df.select(*s.keys, F.col(s.seq).alias("seq"), F.col(s.value).alias(f"v{i}")) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.join(b, [*first.keys, "seq"]), parts)


def zip_map(streams: Sequence[OrderedStream], f: Callable, initial: Callable[[], object] | None = None, kind: str = "double") -> OrderedStream:
    """y[n] = f(x0[n], x1[n], …); with initial, a Python f((x0, x1, …), state) -> (y, state), in order."""
    df, keys = zip_streams(streams), streams[0].keys
    names = [f"v{i}" for i in range(len(streams))]
    if initial is not None:
        one = f if len(names) > 1 else lambda x, s: f((x,), s)
        return OrderedStream(fold(OrderedStream(df, "v0", keys=keys), one, initial, kind, names, renumber=True), keys=keys)
    return OrderedStream(df.select(*keys, "seq", f(*map(F.col, names)).alias("value")), keys=keys)


def zip_structs(streams: Sequence[OrderedStream]) -> OrderedStream:
    return zip_map(streams, lambda *c: F.struct(*c))


def multi_element(streams: Sequence[OrderedStream], f: Callable[..., Sequence], initial: Callable[[], object] | None = None, kinds: Sequence[str] = ()) -> list[OrderedStream]:
    """Several outputs of the zipped inputs; all are projections of one join.  With initial, f is a Python
    function, f((x0, x1, …), state) -> ([y0, y1, …], state), with outputs of the given kinds."""
    df, keys = zip_streams(streams), streams[0].keys
    names = [f"v{i}" for i in range(len(streams))]
    if initial is not None:
        one = f if len(names) > 1 else lambda x, s: f((x,), s)
        return fold_many(OrderedStream(df, "v0", keys=keys), one, initial, kinds, names)
    outs = f(*map(F.col, names))
    return [OrderedStream(df.select(*keys, "seq", o.alias("value")), keys=keys, root=df, expr=o) for o in outs]


def mix(streams: Sequence[OrderedStream], order: str = "ts") -> DataFrame:
    """(order, i, seq, value) of all streams; arrival is defined by (order, i, seq)."""
    parts = [s.df.select(F.col(order), F.lit(i).alias("i"), F.col(s.seq).alias("seq"), F.col(s.value).alias("value")) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def arrivals(streams: Sequence[OrderedStream], order: str = "ts") -> OrderedStream:
    """All elements as they arrive, numbered: struct values (i, value)."""
    rows = mix(streams, order).withColumnRenamed("seq", "__n")
    out = dense_positions(rows, [order, "i", "__n"])
    return OrderedStream(out.select("seq", order, F.struct("i", "value").alias("value")), ts=order)


def merge_asynch(streams: Sequence[OrderedStream], f: Callable, order: str = "ts", initial: Callable[[], object] | None = None, kind: str = "double") -> DataFrame:
    """mix, with f(i, value) for the value; with initial, seq and value of a Python f((i, x), state) -> (y, state)
    of the elements as they arrive."""
    if initial is not None:
        return fold(arrivals(streams, order), lambda x, s: f((x["i"], x["value"]), s), initial, kind, renumber=True)
    return mix(streams, order).withColumn("value", f(F.col("i"), F.col("value")))


def blend(streams: Sequence[OrderedStream], f: Callable, order: str = "ts", initial: Callable[[], object] | None = None, kind: str = "double") -> DataFrame:
    """f of every element of every stream; the index tells nothing but the order of ties.  With initial, seq and
    value of a Python f(x, state) -> (y, state) of the elements as they arrive."""
    if initial is not None:
        return fold(arrivals(streams, order), lambda x, s: f(x["value"], s), initial, kind, renumber=True)
    return mix(streams, order).withColumn("value", f(F.col("value")))


def weave(streams: Sequence[OrderedStream], order: str = "ts") -> DataFrame:
    return mix(streams, order)


def timed_mix(arrivals: DataFrame, time: str = "ts", keys: Sequence[str] = (), arrival: Sequence[str] = ("seq",)) -> DataFrame:
    """Elements in arrival order whose time is over that of all before them; late and tied ones go."""
    before = F.max(time).over(Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return arrivals.withColumn("__max", before).filter(F.col("__max").isNull() | (F.col(time) > F.col("__max"))).drop("__max")


def timed_zip(streams: Sequence[OrderedStream], time: str = "ts") -> DataFrame:
    """time and v0, v1, … (null where a stream has no such time), as far as every stream has come.

    The frontier is the least of the streams' last times: one aggregate row, filtered on both sides of the
    full outer join.
    """
    keys = list(streams[0].keys)
    parts = [s.df.select(*keys, F.col(time), F.col(s.value).alias(f"v{i}")) for i, s in enumerate(streams)]
    joined = reduce(lambda a, b: a.join(b, [*keys, time], "full_outer"), parts)
    last = [p.groupBy(*keys).agg(F.max(time).alias("__last")).withColumn("__i", F.lit(i)) for i, p in enumerate(parts)]
    ends = reduce(lambda a, b: a.unionByName(b), last).groupBy(*keys).agg(F.min("__last").alias("__end"), F.count("__last").alias("__n"))
    ends = ends.filter(F.col("__n") == len(streams)).drop("__n")
    joined = joined.join(ends, keys) if keys else joined.crossJoin(F.broadcast(ends))  # one row
    return joined.filter(F.col(time) <= F.col("__end")).drop("__end")


def timed_zip_map(streams: Sequence[OrderedStream], f: Callable[..., Column], time: str = "ts") -> DataFrame:
    out = timed_zip(streams, time)
    return out.select(*streams[0].keys, time, f(*(F.col(f"v{i}") for i in range(len(streams)))).alias("value"))


def join_timed(streams: Sequence[OrderedStream], get_time: Callable[[Column], Column]) -> DataFrame:
    """time and v0, v1, …: timed_zip by a time that is got from each value; the whole values stay."""
    return timed_zip([OrderedStream(s.df.withColumn("time", get_time(s.v)), s.value, s.seq, s.keys) for s in streams], "time")


def merge_windows(streams: Sequence[OrderedStream], sizes: Sequence[int], steps: Sequence[int], aggregate: Callable[[str], Column], initial_value=None) -> DataFrame:
    """Keys, w and v0, v1, …: window w of every stream reduced, with its own size and step."""
    from .windows import window

    keys = list(streams[0].keys)
    parts = [window(s, size, step, aggregate(s.value).alias(f"v{i}"), initial_value=initial_value) for i, (s, size, step) in enumerate(zip(streams, sizes, steps, strict=True))]
    return reduce(lambda a, b: a.join(b, [*keys, "w"]), parts)


def merge_window(streams: Sequence[OrderedStream], size: int, step: int, aggregate: Callable[[str], Column], initial_value=None) -> DataFrame:
    return merge_windows(streams, [size] * len(streams), [step] * len(streams), aggregate, initial_value)


def window_lists(streams: Sequence[OrderedStream], size: int, step: int, initial_value=None) -> OrderedStream:
    """The streams' windows side by side, v0, v1, … as arrays in order; the position is the window."""
    from .windows import ordered

    same = [OrderedStream(s.df.select(*s.keys, F.col(s.seq).alias("seq"), F.col(s.value).alias("value")), keys=s.keys) for s in streams]
    lists = merge_window(same, size, step, lambda v: ordered(v), initial_value)
    return OrderedStream(lists, "v0", "w", streams[0].keys)


def merge_window_fold(streams: Sequence[OrderedStream], size: int, step: int, f: Callable, initial: Callable[[], object], kind: str = "double", initial_value=None) -> OrderedStream:
    """f([window0, window1, …], state) -> (y, state) for a Python function, window after window."""
    lists = window_lists(streams, size, step, initial_value)
    names = [f"v{i}" for i in range(len(streams))]
    one = lambda x, s: f(list(x) if len(names) > 1 else [x], s)
    return OrderedStream(fold(lists, one, initial, kind, names, renumber=True), keys=lists.keys)


def multi_window(streams: Sequence[OrderedStream], size: int, step: int, aggregates: Sequence[Callable[[str], Column]], f: Callable[..., Sequence[Column]], initial_value=None) -> list[OrderedStream]:
    """Several outputs of aligned windows: f of every aggregate of every stream (stream by stream), from one join."""
    from .windows import window

    keys, k = list(streams[0].keys), len(aggregates)
    parts = [window(s, size, step, *(a(s.value).alias(f"v{i * k + j}") for j, a in enumerate(aggregates)), initial_value=initial_value) for i, s in enumerate(streams)]
    df = reduce(lambda a, b: a.join(b, [*keys, "w"]), parts).withColumnRenamed("w", "seq")
    outs = f(*(F.col(f"v{i}") for i in range(k * len(streams))))
    return [OrderedStream(df.select(*keys, "seq", o.alias("value")), keys=keys, root=df, expr=o) for o in outs]


def multi_window_fold(streams: Sequence[OrderedStream], size: int, step: int, f: Callable, initial: Callable[[], object], kinds: Sequence[str], initial_value=None) -> list[OrderedStream]:
    """f([window0, window1, …], state) -> ([y0, y1, …], state) for a Python function, with an output for each y."""
    lists = window_lists(streams, size, step, initial_value)
    names = [f"v{i}" for i in range(len(streams))]
    return fold_many(lists, lambda x, s: f(list(x) if len(names) > 1 else [x], s), initial, kinds, names)


def lookup(stream: OrderedStream, table: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """The stream's rows with a dimension table's columns; Spark broadcasts the table where it measures small."""
    return stream.df.join(table, on, how)


def as_of(stream: OrderedStream, other: DataFrame, columns: Sequence[str], time: str = "ts") -> DataFrame:
    """The stream's rows with columns of the last row of other at or before their time, by key; null before the first.

    Both sides meet in one sorted pass for each key; other has the keys and time.
    """
    keys = list(stream.keys)
    marked = other.select(*keys, time, F.struct(*columns).alias("__o"), F.lit(0).alias("__side"))
    both = stream.df.withColumn("__side", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    last = F.last("__o", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__last", last).filter("__side = 1")
    return out.select(*stream.df.columns, *(F.col(f"__last.{c}").alias(c) for c in columns))


def hours(df: DataFrame, time: str) -> Column:
    """The number of time's hour, in which later times are never lower, whatever the session's zone and its shifts."""
    if df.schema[time].dataType.simpleString() == "timestamp":
        return F.floor(F.unix_seconds(time) / 3600)
    return F.date_diff(F.to_date(time), F.lit("1970-01-01").cast("date")) * 24 + F.hour(time)


def call_on_clock(stream: OrderedStream, clock: DataFrame, time: str = "ts") -> DataFrame:
    """The stream's rows with tick, the first time of clock at or after theirs: when they would be read.

    A clock with the stream's keys ticks for each key.  Elements after the last tick, and those without
    time, have none; nor do null times tick.  Hours spread a stream over tasks, and each also gets the
    first tick of a later hour.  All frames run from the latest time backwards: they grow row by row, where
    frames that reach to the end are read anew for each row.
    """
    keys = list(stream.keys)
    ticks = clock.select(*keys, F.col(time), F.col(time).alias("tick")).filter(F.col("tick").isNotNull()).distinct()
    both = stream.df.drop("tick").withColumn("__side", F.lit(1)).unionByName(ticks.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("__hour", hours(both, time))
    firsts = both.filter(F.col("__hour").isNotNull()).groupBy(*keys, "__hour").agg(F.min("tick").alias("__first"))  # a row for each hour
    later = F.min("__first").over(Window.partitionBy(*keys).orderBy(F.desc("__hour")).rowsBetween(Window.unboundedPreceding, -1))
    marks = firsts.select(*keys, "__hour", later.alias("tick"), F.lit(0).alias("__side")).filter(F.col("tick").isNotNull()).withColumn(time, F.col("tick"))
    ahead = F.last("tick", ignorenulls=True).over(Window.partitionBy(*keys, "__hour").orderBy(F.desc(time), "__side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.unionByName(marks, allowMissingColumns=True).withColumn("__ahead", ahead).filter("__side = 1")
    return out.withColumn("tick", F.col("__ahead")).drop("__ahead", "__hour", "__side")
