"""Ordered folds: func(x, state) -> (y, state), in the order of positions, for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..core import OrderedStream


class NO_VALUE:
    """What a step returns to emit nothing: this class itself, which is the same in every process."""


class Many(list):
    """What a step returns to emit several values."""


def emitted(y) -> list:
    """The values that a step's result stands for: none for NO_VALUE and None, several for Many."""
    if y is NO_VALUE or y is None:
        return []
    return [v for v in y if v is not None] if isinstance(y, Many) else [y]


def _type(df: DataFrame, kind: str) -> T.DataType:
    return df.sparkSession.createDataFrame([], f"value {kind}").schema[0].dataType


def fold(stream: OrderedStream, step: Callable, initial: Callable[[], object], kind: str, inputs: Sequence[str] | None = None, renumber: bool = False) -> DataFrame:
    """keys, seq, pos, value: the values that step(x, state) -> (y, state) emits; y may be NO_VALUE, None or Many.

    seq is the position of the element that a value comes from, and pos its place among that element's
    values.  renumber: keys, seq and value, with seq dense from 0 over the values.  inputs: columns that
    step gets as a tuple instead of the value.

    Rows are dealt by key and sorted within the tasks, and the state goes with them from batch to batch: a
    task holds a batch and one state, however long a key's stream is.  An unkeyed fold is one task by
    nature; what is before it is not.
    """
    keys, cols = list(stream.keys), list(inputs or [stream.value])
    df = stream.df.select(*keys, F.col(stream.seq).alias("__n"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(cols)])
    df = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*keys, "__n")
    fields = [T.StructField(k, stream.df.schema[k].dataType) for k in keys] + [T.StructField("seq", T.LongType())]
    schema = T.StructType([*fields, *([] if renumber else [T.StructField("pos", T.IntegerType())]), T.StructField("value", _type(stream.df, kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out_n = None, initial(), 0
        target = None
        for batch in batches:
            owners = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * len(batch)
            values = [batch.column(len(keys) + 1 + i).to_pylist() for i in range(len(cols))]
            args = values[0] if len(cols) == 1 else list(zip(*values, strict=True))
            out = []
            for key, n, x in zip(owners, batch.column(len(keys)).to_pylist(), args, strict=True):
                if key != now:
                    now, state, out_n = key, initial(), 0
                y, state = step(x, state)
                for pos, v in enumerate(emitted(y)):
                    out.append((*key, out_n, v) if renumber else (*key, n, pos, v))
                    out_n += 1
            if target is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                target = to_arrow_schema(schema)
            rows = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array([_plain(v) for v in c] if i == len(schema) - 1 else c, f.type) for i, (c, f) in enumerate(zip(rows, target, strict=True))], schema=target)

    return df.mapInArrow(run, schema)


def _plain(v):
    """NumPy scalars and arrays as Python values."""
    return v.tolist() if isinstance(v, np.ndarray | np.generic) else v


def fold_many(stream: OrderedStream, step: Callable, initial: Callable[[], object], kinds: Sequence[str], inputs: Sequence[str] | None = None) -> list[OrderedStream]:
    """step(x, state) -> ([y0, y1, …], state) with an output stream for each place; None and NO_VALUE emit nothing there."""

    def one(x, state):
        ys, state = step(x, state)
        return [None if y is NO_VALUE else _plain(y) for y in ys], state

    kind = "struct<" + ",".join(f"o{i}:{k}" for i, k in enumerate(kinds)) + ">"
    out = fold(stream, lambda x, s: _as_struct(*one(x, s)), initial, kind, inputs)
    parts = [out.select(*stream.keys, "seq", F.col(f"value.o{i}").alias("value")).filter("value is not null") for i in range(len(kinds))]
    return [OrderedStream(p, keys=stream.keys).renumber() for p in parts]


def _as_struct(ys, state):
    return {f"o{i}": y for i, y in enumerate(ys)}, state


def linear_recurrence(stream: OrderedStream, a: float, b: float, start: float = 0.0) -> DataFrame:
    """y[n] = a * y[n-1] + b * x[n], y[-1] = start."""

    def step(x, y):
        y = a * y + b * x
        return y, y

    return fold(stream, step, lambda: start, "double").drop("pos")


def affine_scan(stream: OrderedStream, a: float, b: float, start: float = 0.0, chunk: int = 1 << 14) -> DataFrame:
    """The same recurrence over one long unkeyed stream, on all tasks.

    Chunks of positions are solved from zero; a chunk's end state is affine in its start state, so the
    start states follow from one number for each chunk, and add a power of a to each element.
    """
    df = stream.df.select(F.col(stream.seq).alias("seq"), F.col(stream.value).cast("double").alias("x"), F.floor(F.col(stream.seq) / chunk).alias("c"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        y, out = 0.0, np.empty(len(group))
        for i, x in enumerate(group["x"].to_numpy()):
            y = out[i] = a * y + b * x
        return pd.DataFrame({"c": group["c"], "seq": group["seq"], "y": out})

    local = df.groupBy("c").applyInPandas(solve, "c long, seq long, y double")
    ends = df.groupBy("c").agg(F.count("*").alias("n")).join(local.groupBy("c").agg(F.max_by("y", "seq").alias("last")), "c")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = start
        for batch in batches:
            at = []
            for n, last in zip(batch["n"], batch["last"], strict=True):
                at.append(y)
                y = a**n * y + last
            yield pd.DataFrame({"c": batch["c"], "y0": at})

    first = ends.repartition(1).sortWithinPartitions("c").mapInPandas(starts, "c long, y0 double")  # a row for each chunk
    place = F.col("seq") - F.col("c") * chunk + 1
    return local.join(first, "c").select("seq", (F.col("y") + F.col("y0") * F.pow(F.lit(a), place)).alias("value"))
