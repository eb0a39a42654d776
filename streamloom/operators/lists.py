"""List operators: Python functions of whole lists of consecutive elements, one or several inputs and outputs.

What a list is must not depend on how a cluster batches rows, so a list is size consecutive positions of a
key (the last one may be shorter): lists of one long stream go to all tasks, and a task holds one list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..core import OrderedStream, dense_positions
from .fold import Many, _as_struct, _plain, fold
from .merge import zip_streams

#: Elements of a list.
SIZE = 1 << 14


def _outputs(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], size: int, f: Callable, kinds: Sequence[str], seq: str) -> list[OrderedStream]:
    """One stream for each list that f(list, …) returns."""
    keys = list(keys)
    kind = df.sparkSession.createDataFrame([], ", ".join(f"o{i} {k}" for i, k in enumerate(kinds))).schema
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("__b", T.LongType()), T.StructField("__i", T.IntegerType()), T.StructField("__p", T.LongType()), *kind])
    rows = df.select(*keys, F.floor(F.col(seq) / size).cast("long").alias("__b"), F.col(seq).alias("__n"), *(F.col(c).alias(f"__x{i}") for i, c in enumerate(inputs)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        table = table.sort_by("__n")
        outs = f(*(table[f"__x{i}"].to_pylist() for i in range(len(inputs))))
        outs = [outs] if len(kinds) == 1 else outs
        if len(outs) != len(kinds):
            raise ValueError(f"{len(kinds)} lists are expected, not {len(outs)}")
        parts = []
        for i, values in enumerate(outs):
            values = [_plain(v) for v in values]
            n = len(values)
            columns = [*(pa.array([k.as_py()] * n, target.field(j).type) for j, k in enumerate(key)), pa.array([i] * n, pa.int32()), pa.array(range(n), pa.int64())]
            columns += [pa.array(values, target.field(len(columns) + j).type) if j == i else pa.nulls(n, target.field(len(columns) + j).type) for j in range(len(kinds))]
            parts.append(pa.Table.from_arrays(columns, schema=target))
        return pa.concat_tables(parts)

    out = rows.groupBy(*keys, "__b").applyInArrow(run, schema)
    return [_numbered(out.filter(F.col("__i") == i).select(*keys, "__b", "__p", F.col(f"o{i}").alias("value")).filter("value is not null"), keys) for i in range(len(kinds))]


def _numbered(df: DataFrame, keys: Sequence[str]) -> OrderedStream:
    from pyspark.sql import Window

    if keys:
        seq = F.row_number().over(Window.partitionBy(*keys).orderBy("__b", "__p")).cast("long") - 1
        return OrderedStream(df.withColumn("seq", seq).drop("__b", "__p"), keys=keys)
    return OrderedStream(dense_positions(df, ["__b", "__p"]).select("seq", "value"))


def _stateful(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], size: int, f: Callable, initial: Callable[[], object], kinds: Sequence[str], seq: str) -> list[OrderedStream]:
    """The same with f(list, …, state) -> (list or lists, state), list after list of a key."""
    keys = list(keys)
    lists = df.groupBy(*keys, F.floor(F.col(seq) / size).cast("long").alias("__b"))
    lists = lists.agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("__n"), *(F.col(c).alias(f"__x{i}") for i, c in enumerate(inputs))))).alias("__l"))
    lists = lists.select(*keys, "__b", *(F.transform("__l", _field(f"__x{i}")).alias(f"__x{i}") for i in range(len(inputs))))

    def step(x, state):
        x = x if len(inputs) > 1 else (x,)
        outs, state = f(*(list(v) for v in x), state)
        outs = [outs] if len(kinds) == 1 else outs
        rows = Many()
        for i, values in enumerate(outs):
            rows += [{"i": i, **_as_struct([_plain(v) if j == i else None for j in range(len(kinds))], None)[0]} for v in values]
        return rows, state

    kind = "struct<i:int," + ",".join(f"o{i}:{k}" for i, k in enumerate(kinds)) + ">"
    source = OrderedStream(lists, "__x0", "__b", keys)
    out = fold(source, step, initial, kind, [f"__x{i}" for i in range(len(inputs))])
    out = out.withColumnsRenamed({"seq": "__b", "pos": "__p"})
    return [_numbered(out.filter(F.col("value.i") == i).select(*keys, "__b", "__p", F.col(f"value.o{i}").alias("value")).filter("value is not null"), keys) for i in range(len(kinds))]


def _run(df, keys, inputs, f, kinds, size, initial, seq="seq") -> list[OrderedStream]:
    if initial is None:
        return _outputs(df, keys, inputs, size, f, kinds, seq)
    return _stateful(df, keys, inputs, size, f, initial, kinds, seq)


def map_list(stream: OrderedStream, f: Callable, kind: str = "double", size: int = SIZE, initial: Callable[[], object] | None = None) -> OrderedStream:
    """The elements of f(list) of every list, in order; with initial, of f(list, state) -> (list, state)."""
    return _run(stream.df, stream.keys, [stream.value], f, [kind], size, initial, stream.seq)[0]


def map_array(stream: OrderedStream, f: Callable, kind: str = "double", size: int = SIZE) -> OrderedStream:
    """map_list for a function of one NumPy array that returns an array."""
    import numpy as np

    return map_list(stream, lambda values: f(np.asarray(values)), kind, size)


def merge_list(streams: Sequence[OrderedStream], f: Callable, kind: str = "double", size: int = SIZE, initial: Callable[[], object] | None = None) -> OrderedStream:
    """The elements of f([list0, list1, …]) of the streams' lists by position, as far as the shortest goes."""
    return multi_list(streams, f, [kind], size, initial)[0]


zip_map_list = merge_list


def split_list(stream: OrderedStream, f: Callable, kinds: Sequence[str], size: int = SIZE, initial: Callable[[], object] | None = None) -> list[OrderedStream]:
    """Output i has the elements of f(list)[i] of every list."""
    return _run(stream.df, stream.keys, [stream.value], f, kinds, size, initial, stream.seq)


def multi_list(streams: Sequence[OrderedStream], f: Callable, kinds: Sequence[str], size: int = SIZE, initial: Callable[[], object] | None = None) -> list[OrderedStream]:
    """Output i has the elements of f([list0, list1, …])[i]."""
    names = [f"v{i}" for i in range(len(streams))]
    if initial is None:
        return _run(zip_streams(streams), streams[0].keys, names, lambda *lists: f(list(lists)), kinds, size, None)
    return _run(zip_streams(streams), streams[0].keys, names, lambda *args: f(list(args[:-1]), args[-1]), kinds, size, initial)


def iot(stream: OrderedStream, f: Callable, kind: str = "double", size: int = SIZE) -> OrderedStream:
    """f(unread) -> (values, consumed): each list comes after what was left unread of those before it.

    values is a list; consumed is how many leading elements of unread are done with.
    """

    def step(new, unread):
        unread = [*unread, *new]
        values, consumed = f(unread)
        return values, unread[_consumed(consumed, len(unread)) :]

    return map_list(stream, step, kind, size, list)


def iot_merge(streams: Sequence[OrderedStream], f: Callable, kind: str = "double", size: int = SIZE) -> OrderedStream:
    """f([unread0, unread1, …]) -> (values, [consumed0, consumed1, …]) of streams with lists by position; a
    stream that has ended gives empty lists."""
    keys = list(streams[0].keys)
    parts = []
    for i, s in enumerate(streams):
        rows = s.df.groupBy(*keys, F.floor(F.col(s.seq) / size).cast("long").alias("seq"))
        parts.append(rows.agg(F.array_sort(F.collect_list(F.struct(F.col(s.seq).alias("n"), F.col(s.value).alias("x")))).alias(f"__{i}")))
    both = parts[0]
    for p in parts[1:]:
        both = both.join(p, [*keys, "seq"], "full_outer")
    both = both.select(*keys, "seq", *(F.transform(F.coalesce(f"__{i}", F.array().cast(both.schema[f"__{i}"].dataType)), lambda r: r["x"]).alias(f"v{i}") for i in range(len(streams))))

    def step(new, unread):
        unread = [[*u, *x] for u, x in zip(unread, new, strict=True)]
        values, consumed = f(unread)
        return Many(values), [u[_consumed(c, len(u)) :] for u, c in zip(unread, consumed, strict=True)]

    names = [f"v{i}" for i in range(len(streams))]
    one = lambda x, s: step(x if len(names) > 1 else (x,), s)
    return OrderedStream(fold(OrderedStream(both, "v0", keys=keys), one, lambda: [[] for _ in names], kind, names, renumber=True), keys=keys)


def _field(name: str) -> Callable:
    """A function of one Column (a default argument would count as a second): its field."""
    return lambda r: r[name]


def _consumed(n: int, most: int) -> int:
    if not isinstance(n, int) or not 0 <= n <= most:
        raise ValueError(f"the number of consumed elements is an integer from 0 to {most}, not {n!r}")
    return n
