"""Operators with several outputs.  All outputs are projections or filters of one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..core import OrderedStream
from .fold import fold_many
from .windows import ordered, window


def split_element(stream: OrderedStream, f: Callable, initial: Callable[[], object] | None = None, kinds: Sequence[str] = ()) -> list[OrderedStream]:
    """Output i has the elements f(x)[i] that aren't null, numbered densely.  With initial, f is a Python
    function, f(x, state) -> ([y0, y1, …], state), with outputs of the given kinds."""
    if initial is not None:
        return fold_many(stream, f, initial, kinds)
    parts = [stream.df.withColumn(stream.value, o) for o in f(stream.v)]
    return [stream.like(p.filter(F.col(stream.value).isNotNull())).renumber() for p in parts]


def split_columns(stream: OrderedStream, **outputs: Column) -> DataFrame:
    """All outputs side by side in one pass."""
    return stream.df.select(*stream.keys, stream.seq, *(c.alias(k) for k, c in outputs.items()))


def separate(stream: OrderedStream, tag: str, count: int) -> list[OrderedStream]:
    """Output j has the elements with tag j, numbered densely."""
    return [stream.like(stream.df.filter(F.col(tag) == j)).renumber() for j in range(count)]


def unzip(stream: OrderedStream, count: int) -> list[OrderedStream]:
    """Output i has element i of each array; short arrays give null."""
    return [stream.select_value(lambda v, i=i: F.try_element_at(v, F.lit(i + 1))) for i in range(count)]


def split_tuple(stream: OrderedStream) -> list[OrderedStream]:
    """An output for each field of struct values."""
    return [stream.select_value(lambda v, name=name: v[name]) for name in stream.df.schema[stream.value].dataType.names]


def split_signal(batches: DataFrame, *outputs: Column, batch: str = "batch") -> list[DataFrame]:
    """One element for each batch in every output: batches has a row for each (see sinks.batch_reduce)."""
    return [batches.select(batch, o.alias("value")) for o in outputs]


def timed_unzip(zipped: DataFrame, count: int, time: str = "ts") -> list[DataFrame]:
    """Inverse of timed_zip: output i has (time, v_i) where v_i isn't null."""
    return [zipped.select(time, F.col(f"v{i}").alias("value")).filter("value is not null") for i in range(count)]


def split_window(stream: OrderedStream, size: int, step: int, *aggregates: Column, initial_value=None) -> DataFrame:
    """Several reductions of each window, from one aggregation."""
    return window(stream, size, step, *aggregates, initial_value=initial_value)


def split_window_fold(stream: OrderedStream, size: int, step: int, f: Callable, initial: Callable[[], object], kinds: Sequence[str], initial_value=None) -> list[OrderedStream]:
    """f(window, state) -> ([y0, y1, …], state) for a Python function of a list, with an output for each y."""
    lists = window(stream, size, step, ordered(stream.value, stream.seq).alias("__a"), initial_value=initial_value)
    return fold_many(OrderedStream(lists, "__a", "w", stream.keys), f, initial, kinds)


def partition_sink(stream: OrderedStream, tag: str, path: str) -> None:
    """Write the elements of each tag to a folder of its own."""
    stream.df.write.mode("append").partitionBy(tag).parquet(path)
