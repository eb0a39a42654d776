"""Element functions, and decorators that turn functions of elements or windows into functions of streams."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..core import OrderedStream
from ..operators import fold as folds, lists, merge, sinks, split, windows


def multiply(v: Column, by) -> Column:
    return v * by


def add(v: Column, by) -> Column:
    return v + by


def subtract(v: Column, by) -> Column:
    return v - by


def at_most(v: Column, bound) -> Column:
    return F.least(v, F.lit(bound))


def at_least(v: Column, bound) -> Column:
    return F.greatest(v, F.lit(bound))


def clip(v: Column, bound) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), v))


def large(v: Column, least) -> Column:
    """The predicate of filter_min."""
    return F.abs(v) >= least


def to_float(v: Column) -> Column:
    return v.cast("double")


def to_int(v: Column) -> Column:
    return v.cast("long")


def to_array_sum(a: Column, b: Column) -> Column:
    """Element-wise sum of two vectors."""
    return F.zip_with(a, b, lambda x, y: x + y)


def to_array_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def to_array_product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def exponential_smoothing(stream: OrderedStream, alpha: float, start: float = 0.0) -> DataFrame:
    """s[n] = alpha * s[n-1] + (1 - alpha) * x[n]."""
    return folds.linear_recurrence(stream, alpha, 1 - alpha, start)


def make_echo(stream: OrderedStream, delay: int, attenuation: float) -> DataFrame:
    """heard[n] = spoken[n] + attenuation * heard[n - delay]: one recurrence for each residue of n."""
    phase = stream.df.withColumns({"__phase": stream.n % delay, "__step": F.floor(stream.n / delay)})
    part = OrderedStream(phase, stream.value, "__step", [*stream.keys, "__phase"])
    out = folds.linear_recurrence(part, attenuation, 1.0)
    return out.select(*stream.keys, (F.col("seq") * delay + F.col("__phase")).alias("seq"), "value")


def smooth_and_add(stream: OrderedStream, factor: float) -> DataFrame:
    """y[n] = x[n] + factor * y[n-1]: each element with all before it, fading."""
    return folds.linear_recurrence(stream, factor, 1.0)


def seeded_smoothing(stream: OrderedStream, factor: float) -> DataFrame:
    """y[0] = x[0]; y[n] = factor * x[n] + (1 - factor) * y[n-1]."""

    def step(x, y):
        y = x if y is None else (1 - factor) * y + factor * x
        return y, y

    return folds.fold(stream, step, lambda: None, "double").drop("pos")


def multi_echo(stream: OrderedStream, echoes: list[tuple[int, list[float]]]) -> DataFrame:
    """keys, seq, value: heard[n] = spoken[n] + the sum of all echoes, each a delay and the attenuations of heard
    from that delay on (attenuations[j] of heard[n - delay - j])."""
    if not all(d > 0 and a for d, a in echoes):
        raise ValueError("delays are positive, and every echo has an attenuation")
    reach = max((d + len(a) - 1 for d, a in echoes), default=0)
    taps = [(d + j, c) for d, a in echoes for j, c in enumerate(a)]

    def step(x, past):
        y = x + sum(c * past[-d] for d, c in taps if d <= len(past))
        past.append(y)
        if len(past) > 2 * reach + 64:
            del past[: len(past) - reach]
        return y, past

    return folds.fold(stream, step, list, "double").drop("pos")


def first_n(stream: OrderedStream, n: int) -> DataFrame:
    """The first n elements of each key: stop after n."""
    return stream.df.filter(stream.n < n)


def append_items(streams: list[OrderedStream]) -> OrderedStream:
    """The streams' items at each position as one array (of arrays, for vectors)."""
    return merge.zip_map(streams, lambda *v: F.array(*v))


def sieve(stream: OrderedStream) -> OrderedStream:
    """Elements without a proper divisor among the elements before them that are over one: primes of 2, 3, …

    A number that isn't prime has a divisor up to its root, so only numbers up to the root of the greatest
    mark multiples, in blocks, so that no row or task has all multiples of one.
    """
    top = stream.df.agg(F.max(stream.value).cast("long").alias("top"))
    numbers = stream.df.select(F.col(stream.value).cast("long").alias("p")).join(F.broadcast(top), F.col("p") * F.col("p") <= F.col("top"))  # top is one row
    block = 1 << 16
    blocks = numbers.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - F.col("p") * F.col("p")) / F.col("p") / block)))).repartition("p", "b")
    low = F.col("p") * F.col("p") + F.col("b") * block * F.col("p")
    last = F.least(low + (block - 1) * F.col("p"), F.col("top"))
    multiples = blocks.select(F.explode(F.sequence(low, last, F.col("p"))).alias("m")).distinct()
    return stream.like(stream.df.join(multiples, stream.v == F.col("m"), "left_anti")).renumber()


# Decorators.  f takes Columns and gives Columns, which Spark optimises; those with a state or a list take a
# Python function.  A decorated function takes streams, then the settings by name.


def _with(f: Callable, kw: dict) -> Callable:
    return functools.partial(f, **kw) if kw else f


def element(f: Callable[..., Column]) -> Callable[..., OrderedStream]:
    """f(x, **kw) becomes a function of a stream: y[n] = f(x[n])."""
    return functools.wraps(f)(lambda stream, **kw: stream.map(_with(f, kw)))


def keep(f: Callable[..., Column]) -> Callable[..., OrderedStream]:
    return functools.wraps(f)(lambda stream, **kw: stream.filter(_with(f, kw)))


def many(f: Callable[..., Column]) -> Callable[..., OrderedStream]:
    return functools.wraps(f)(lambda stream, **kw: stream.map_many(_with(f, kw)))


def listed(kind: str = "double", size: int = lists.SIZE) -> Callable:
    """f(list) -> list, a Python function, becomes a function of a stream."""
    return lambda f: functools.wraps(f)(lambda stream, **kw: lists.map_list(stream, _with(f, kw), kind, size))


def windowed(f: Callable[[str], Column]) -> Callable[..., DataFrame]:
    """f(name of the value column) -> aggregate becomes a function of a stream, size and step."""
    return functools.wraps(f)(lambda stream, window_size, step_size=1, **kw: windows.window(stream, window_size, step_size, _with(f, kw)(stream.value).alias("value")))


def windowed_list(f: Callable[[Column], Column]) -> Callable[..., DataFrame]:
    return functools.wraps(f)(lambda stream, window_size, step_size=1, **kw: windows.window_list(stream, window_size, step_size, _with(f, kw)))


def zipped(f: Callable[..., Column]) -> Callable[..., OrderedStream]:
    """f(x, y, …) becomes a function of as many streams."""
    return functools.wraps(f)(lambda *streams, **kw: merge.zip_map(streams, _with(f, kw)))


def zipped_sink(f: Callable) -> Callable[..., None]:
    """f((x, y, …)), a Python function, becomes a sink of as many streams."""
    return functools.wraps(f)(lambda *streams, **kw: sinks.zip_map_sink(streams, _with(f, kw)))


def zipped_window(f: Callable[[str], Column]) -> Callable[..., DataFrame]:
    """f(name) -> aggregate becomes a function of streams, size and step; v0, v1, … are the streams' values."""
    return functools.wraps(f)(lambda streams, window_size, step_size=1, **kw: merge.merge_window(streams, window_size, step_size, _with(f, kw)))


def blended(f: Callable[[Column], Column]) -> Callable[..., DataFrame]:
    return functools.wraps(f)(lambda streams, order="ts", **kw: merge.blend(streams, _with(f, kw), order))


def splitting(f: Callable) -> Callable[..., list[OrderedStream]]:
    """f(x) -> [y0, y1, …] becomes a function of a stream with as many outputs."""
    return functools.wraps(f)(lambda stream, **kw: split.split_element(stream, _with(f, kw)))


def splitting_window(f: Callable[[str], list[Column]]) -> Callable[..., DataFrame]:
    """f(name) -> [aggregate, …] becomes a function of a stream, size and step; o0, o1, … are the outputs."""

    def apply(stream, window_size, step_size=1, **kw):
        return split.split_window(stream, window_size, step_size, *(a.alias(f"o{i}") for i, a in enumerate(_with(f, kw)(stream.value))))

    return functools.wraps(f)(apply)


def multi(f: Callable) -> Callable[..., list[OrderedStream]]:
    return functools.wraps(f)(lambda *streams, **kw: merge.multi_element(streams, _with(f, kw)))


def multi_windowed(*aggregates: Callable[[str], Column]) -> Callable:
    """f of every aggregate of every stream's window becomes a function of streams, size and step, with several outputs."""
    return lambda f: functools.wraps(f)(lambda streams, window_size, step_size=1, **kw: merge.multi_window(streams, window_size, step_size, aggregates, _with(f, kw)))


def sinking(f: Callable) -> Callable[..., None]:
    """f(x), a Python function, becomes a sink of a stream."""
    return functools.wraps(f)(lambda stream, **kw: sinks.sink_element(stream, _with(f, kw)))


def sinking_window(f: Callable) -> Callable[..., None]:
    """f(list), a Python function, becomes a sink of a stream's windows."""
    return functools.wraps(f)(lambda stream, window_size, step_size=1, **kw: sinks.sink_window(stream, window_size, step_size, _with(f, kw)))


def folding(kind: str, start: Callable[[], object]) -> Callable:
    """step(x, state) -> (y, state), a Python function, becomes a function of a stream."""
    return lambda step: functools.wraps(step)(lambda stream, **kw: folds.fold(stream, _with(step, kw), start, kind))
