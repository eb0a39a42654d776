"""Sinks: functions of elements, windows and batches that return nothing.

A sink's function runs on the executors, for a key's elements in order.  With initial it is
f(x, state) -> state.  A task that is run again calls it again, as with any function with side effects.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..core import OrderedStream
from .fold import NO_VALUE, fold
from .merge import arrivals, timed_zip, window_lists, zip_streams
from .windows import ordered, window


def _consume(stream: OrderedStream, f: Callable, initial: Callable[[], object] | None, inputs: Sequence[str] | None = None) -> None:
    """f of every element in order; the plan yields no rows."""

    def step(x, state):
        if initial is None:
            f(x)
            return NO_VALUE, None
        return NO_VALUE, f(x, state)

    fold(stream, step, initial or (lambda: None), "int", inputs).write.format("noop").mode("overwrite").save()


def sink_element(stream: OrderedStream, f: Callable, initial: Callable[[], object] | None = None) -> None:
    """f(value) of each element, a key's in order."""
    _consume(stream, f, initial)


def sink_window(stream: OrderedStream, size: int, step: int, f: Callable, initial: Callable[[], object] | None = None, aggregate=None) -> None:
    """f of each full window, in order: of its list of values, or of an aggregate (a Column) of it."""
    value = ordered(stream.value, stream.seq) if aggregate is None else aggregate
    _consume(OrderedStream(window(stream, size, step, value.alias("__a")), "__a", "w", stream.keys), f, initial)


def sink_list(stream: OrderedStream, f: Callable, size: int = 1 << 14, initial: Callable[[], object] | None = None) -> None:
    """f of lists of size consecutive values (the last one may be shorter), in order."""
    lists = stream.df.groupBy(*stream.keys, F.floor(stream.n / size).cast("long").alias("__b")).agg(ordered(stream.value, stream.seq).alias("__a"))
    _consume(OrderedStream(lists, "__a", "__b", stream.keys), f, initial)


def sink_batch(stream: OrderedStream, f: Callable[[DataFrame], None]) -> None:
    """f of the whole bounded stream as a DataFrame, on the driver."""
    f(stream.df)


def signal_sink(stream: OrderedStream, batch, f: Callable, initial: Callable[[], object] | None = None) -> None:
    """f(batch) once for each batch (an expression), whatever its elements, in order."""
    rows = stream.df.select(*stream.keys, batch.alias("__batch")).distinct()
    _consume(OrderedStream(rows, "__batch", "__batch", stream.keys), f, initial)


def zip_map_sink(streams: Sequence[OrderedStream], f: Callable, initial: Callable[[], object] | None = None) -> None:
    """f((x0, x1, …)) of the streams' elements by position, in order."""
    names = [f"v{i}" for i in range(len(streams))]
    one = f if len(names) > 1 else (lambda x, *s: f((x,), *s))
    _consume(OrderedStream(zip_streams(streams), "v0", keys=streams[0].keys), one, initial, names)


def join_asynch_sink(streams: Sequence[OrderedStream], f: Callable, order: str = "ts", initial: Callable[[], object] | None = None, numbered: bool = False) -> None:
    """f(x) of every element of every stream as they arrive; numbered: of (stream number, x)."""
    pick = (lambda x: (x["i"], x["value"])) if numbered else (lambda x: x["value"])
    _consume(arrivals(streams, order), lambda x, *s: f(pick(x), *s), initial)


def join_timed_sink(streams: Sequence[OrderedStream], f: Callable, time: str = "ts", initial: Callable[[], object] | None = None) -> None:
    """f((time, [v0, v1, …])) of the streams' elements by time, in order."""
    rows = timed_zip(streams, time)
    names = [time, *(f"v{i}" for i in range(len(streams)))]
    _consume(OrderedStream(rows, time, time, streams[0].keys), lambda x, *s: f((x[0], list(x[1:])), *s), initial, names)


def merge_window_sink(streams: Sequence[OrderedStream], size: int, step: int, f: Callable, initial: Callable[[], object] | None = None) -> None:
    """f([window0, window1, …]) of the streams' aligned windows, in order."""
    lists, names = window_lists(streams, size, step), [f"v{i}" for i in range(len(streams))]
    _consume(lists, lambda x, *s: f(list(x) if len(names) > 1 else [x], *s), initial, names)


def print_stream(stream: OrderedStream, name: str = "stream", numbered: bool = True, most: int = 1000) -> None:
    """Print `name[seq] = value` (or `name : value`) of the first most elements, in order, on the driver."""
    for r in stream.df.orderBy(*stream.keys, stream.seq).select(stream.seq, stream.value).limit(most).toLocalIterator():
        print(f"{name}[{r[0]}] = {r[1]}" if numbered else f"{name} : {r[1]}")


def take_while(stream: OrderedStream, predicate) -> DataFrame:
    """The elements before the first for which predicate fails, for each key; the rest stay unread."""
    keys = list(stream.keys)
    first = stream.df.filter(~predicate(stream.v)).groupBy(*keys).agg(F.min(stream.seq).alias("__stop"))
    rows = stream.df.join(first, keys, "left") if keys else stream.df.crossJoin(F.broadcast(first))  # one row
    return rows.filter(F.col("__stop").isNull() | (F.col(stream.seq) < F.col("__stop"))).drop("__stop")


def batch_reduce(stream: OrderedStream, batch, *aggregates) -> DataFrame:
    """One row for each batch (an expression): chunk and signal operators with an explicit batch."""
    return stream.df.groupBy(*stream.keys, batch.alias("batch")).agg(*aggregates)
