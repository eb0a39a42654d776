"""The ordered operators on streaming DataFrames: the same answers as in batch, whatever the micro-batches.

Rows are (key string, seq long, value …); the position seq orders a key's rows, and state is kept for
each key.  Stateful operators use transformWithStateInPandas and need the RocksDB state store: call
configure(spark) first.  State and what is left unread are JSON, so they hold what JSON holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import emitted

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """Use the state store that stateful processors need, and the least of several watermarks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")


def _plain(v):
    return v.item() if hasattr(v, "item") else v.tolist() if hasattr(v, "tolist") else v


class _Slices(StatefulProcessor):
    """f(key, rows, state) -> (out, state) of a micro-batch's rows of one key, tuples in order of some columns.

    out is a list of tuples after the key; the state is a small value and, under "unread", a list of what
    waits, which is kept element by element.
    """

    def __init__(self, f: Callable, start: Callable[[], dict], columns: Sequence[str], order: Sequence[str], names: Sequence[str]):
        self.f, self.start, self.columns, self.order, self.names = f, start, list(columns), list(order), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")
        self.unread = handle.getListState("unread", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        if "unread" in state:
            state["unread"] = [json.loads(r[0]) for r in self.unread.get()]
        out, state = self.f(key[0], [tuple(map(_plain, r)) for r in batch[self.columns].itertuples(index=False)], state)
        waiting = state.get("unread")
        if waiting:
            self.unread.put([(json.dumps(v),) for v in waiting])
        elif waiting is not None:
            self.unread.clear()
        self.state.update((json.dumps({**state, "unread": []} if waiting is not None else state),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.names])

    def close(self) -> None:
        pass


def _sliced(rows: DataFrame, f: Callable, start: Callable[[], dict], columns: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """key and the columns out of f over the micro-batches of rows."""
    names = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy("key").transformWithStateInPandas(_Slices(f, start, columns, order, names), f"key string, {out}", "append", "none")


def _tagged(streams: Sequence[DataFrame], *columns: str) -> DataFrame:
    """All streams' rows with i, the number of their stream."""
    parts = [s.select("key", "seq", *columns, F.lit(i).alias("i")) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.unionByName(b), parts)


# elements


def renumber(rows: DataFrame, kind: str = "double") -> DataFrame:
    """key, seq, value with seq dense from 0 in the order of arrival and of the old seq."""

    def f(key, batch, state):
        n = state["n"]
        return [(n + i, v) for i, (_, v) in enumerate(batch)], {"n": n + len(batch)}

    return _sliced(rows, f, lambda: {"n": 0}, ["seq", "value"], ["seq"], f"seq long, value {kind}")


def keep(rows: DataFrame, predicate: Callable[[Column], Column], kind: str = "double") -> DataFrame:
    """The elements for which predicate holds, numbered densely again."""
    return renumber(rows.filter(predicate(F.col("value"))), kind)


def fold(rows: DataFrame, step: Callable, start, kind: str = "double") -> DataFrame:
    """key, seq, value, pos: what step(x, state) -> (y, state) emits; y may be None, NO_VALUE or Many, pos is
    the place among an element's values, and the state is anything JSON holds."""

    def f(key, batch, state):
        s, out = state["s"], []
        for n, v in batch:
            y, s = step(v, s)
            out += [(n, x, pos) for pos, x in enumerate(emitted(y))]
        return out, {"s": s}

    return _sliced(rows, f, lambda: {"s": start}, ["seq", "value"], ["seq"], f"seq long, value {kind}, pos int")


# several inputs


def zip_map(left: DataFrame, right: DataFrame, f: Callable) -> DataFrame:
    """key, seq, value = f(x, y) of two streams of (key, seq, value), by position."""
    return zip_streams([left, right], f)


def zip_streams(streams: Sequence[DataFrame], f: Callable, kind: str = "double") -> DataFrame:
    """key, seq, value = f(x0, x1, …) by position; what has no partner yet waits."""
    k = len(streams)

    def run(key, batch, state):
        waiting = [[v for i, v in state["unread"] if i == j] for j in range(k)]
        for i, _, v in batch:
            waiting[i].append(v)
        n, both = state["n"], min(map(len, waiting))
        out = [(n + j, f(*(w[j] for w in waiting))) for j in range(both)]
        return out, {"n": n + both, "unread": [(i, v) for i, w in enumerate(waiting) for v in w[both:]]}

    return _sliced(_tagged(streams, "value"), run, lambda: {"n": 0, "unread": []}, ["i", "seq", "value"], ["i", "seq"], f"seq long, value {kind}")


def merge_asynch(streams: Sequence[DataFrame], f: Callable, start=None, kind: str = "double") -> DataFrame:
    """key, seq, i, value = f(i, x) of all streams' elements as they arrive: of a micro-batch, stream 0's first.
    With start, f((i, x), state) -> (y, state), from that state."""

    def run(key, batch, state):
        n, s, out = state["n"], state["s"], []
        for i, _, v in batch:
            if start is None:
                ys = emitted(f(i, v))
            else:
                y, s = f((i, v), s)
                ys = emitted(y)
            for y in ys:
                out.append((n, i, y))
                n += 1
        return out, {"n": n, "s": s}

    return _sliced(_tagged(streams, "value"), run, lambda: {"n": 0, "s": start}, ["i", "seq", "value"], ["i", "seq"], f"seq long, i int, value {kind}")


def mix(streams: Sequence[DataFrame], kind: str = "double") -> DataFrame:
    """key, seq, i, value of all streams' elements as they arrive."""
    return merge_asynch(streams, lambda i, x: x, kind=kind)


def blend(streams: Sequence[DataFrame], f: Callable, start=None, kind: str = "double") -> DataFrame:
    """key, seq, value = f(x) of all streams' elements as they arrive; with start, f(x, state) -> (y, state)."""
    one = (lambda i, x: f(x)) if start is None else (lambda x, s: f(x[1], s))
    return merge_asynch(streams, one, start, kind).drop("i")


def weave(streams: Sequence[DataFrame], kind: str = "double") -> DataFrame:
    return blend(streams, lambda x: x, kind=kind)


def timed_mix(streams: Sequence[DataFrame], time: str = "t", kind: str = "double") -> DataFrame:
    """key, t, i, value of the elements whose numeric time is over that of all before them; late and tied ones go."""

    def run(key, batch, state):
        top, out = state["top"], []
        for i, _, t, v in batch:
            if top is None or t > top:
                top = t
                out.append((t, i, v))
        return out, {"top": top}

    rows = _tagged([s.withColumn("at_time", F.col(time).cast("double")) for s in streams], "at_time", "value")
    return _sliced(rows, run, lambda: {"top": None}, ["i", "seq", "at_time", "value"], ["i", "seq"], f"t double, i int, value {kind}")


# windows


def _advance(tail: list, at: list[int], size: int, step: int):
    """The full windows of a list of waiting elements, what still waits, and how many are still to be skipped."""
    skip = min(at[0], len(tail))
    tail, left, out = tail[skip:], at[0] - skip, []
    first = 0
    while first + size <= len(tail):
        out.append(tail[first : first + size])
        first += step
    left += max(0, first - len(tail))
    return out, tail[first:], [left]


def count_windows(rows: DataFrame, size: int, step: int, f: Callable = sum, kind: str = "double", start=None) -> DataFrame:
    """key, w, value = f(window) for full windows; with start, f(window, state) -> (y, state)."""

    def run(key, batch, state):
        windows, tail, at = _advance(state["unread"] + [v for _, v in batch], state["at"], size, step)
        w, s, out = state["w"], state["s"], []
        for i, x in enumerate(windows):
            if start is None:
                y = f(x)
            else:
                y, s = f(x, s)
            out += [(w + i, v) for v in emitted(y)]
        return out, {"at": at, "w": w + len(windows), "s": s, "unread": tail}

    return _sliced(rows, run, lambda: {"at": [0], "w": 0, "s": start, "unread": []}, ["seq", "value"], ["seq"], f"w long, value {kind}")


def merge_window(streams: Sequence[DataFrame], size: int, step: int, f: Callable, kind: str = "double") -> DataFrame:
    """key, w, value = f([window0, window1, …]) of aligned windows, as far as every stream has come."""
    k = len(streams)

    def run(key, batch, state):
        tails = [[v for i, v in state["unread"] if i == j] for j in range(k)]
        for i, _, v in batch:
            tails[i].append(v)
        skips = state["skips"]
        for j in range(k):
            gone = min(skips[j], len(tails[j]))
            tails[j], skips[j] = tails[j][gone:], skips[j] - gone
        w, out = state["w"], []
        while not any(skips) and all(len(t) >= size for t in tails):
            out.append((w, f([t[:size] for t in tails])))
            w += 1
            for j in range(k):
                gone = min(step, len(tails[j]))
                tails[j], skips[j] = tails[j][gone:], step - gone
        return out, {"w": w, "skips": skips, "unread": [(i, v) for i, t in enumerate(tails) for v in t]}

    return _sliced(_tagged(streams, "value"), run, lambda: {"w": 0, "skips": [0] * k, "unread": []}, ["i", "seq", "value"], ["i", "seq"], f"w long, value {kind}")


def timed_windows(rows: DataFrame, duration: str, step: str, *aggregates: Column, time: str = "ts", keys: tuple[str, ...] = (), delay: str = "0 seconds") -> DataFrame:
    """start, end, keys and aggregates of windows that the watermark has closed; delay admits late rows."""
    out = rows.withWatermark(time, delay).groupBy(F.window(time, duration, step), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *(c for c in out.columns if c not in ("window", *keys)))


def timed_zip(left: DataFrame, right: DataFrame, time: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """ts, v0, v1: the full outer join by time, as far as both watermarks have come."""
    a = left.withWatermark(time, delay).select(F.col(time).alias("t0"), F.col("value").alias("v0"))
    b = right.withWatermark(time, delay).select(F.col(time).alias("t1"), F.col("value").alias("v1"))
    near = F.expr("t0 = t1 AND t1 >= t0 AND t1 <= t0")
    return a.join(b, near, "full_outer").select(F.coalesce("t0", "t1").alias(time), "v0", "v1")


def flag_late(rows: DataFrame, delay_seconds: float, time: str = "ts", kind: str = "double") -> DataFrame:
    """key, seq, t, value, late: late is set where the time (in seconds) is more than the delay before the
    greatest of the key's earlier micro-batches.  Filter by it for a side output of late rows."""

    def run(key, batch, state):
        top = state["top"]
        out = [(n, t, v, top is not None and t < top - delay_seconds) for n, t, v in batch]
        return out, {"top": max([t for _, t, _ in batch] + ([] if top is None else [top]))}

    known = rows.withColumn("at_time", F.col(time).cast("double"))
    return _sliced(known, run, lambda: {"top": None}, ["seq", "at_time", "value"], ["seq"], f"seq long, t double, value {kind}, late boolean")


# several outputs


def separate(rows: DataFrame, tag: str, count: int, kind: str = "double") -> list[DataFrame]:
    """Output j has the elements with tag j, numbered densely."""
    return [renumber(rows.filter(F.col(tag) == j), kind) for j in range(count)]


def split(rows: DataFrame, f: Callable[[Column], Sequence[Column]], kind: str = "double") -> list[DataFrame]:
    """Output i has the elements f(x)[i] that aren't null, numbered densely."""
    return [renumber(rows.withColumn("value", o).filter("value is not null"), kind) for o in f(F.col("value"))]


def unzip(rows: DataFrame, count: int) -> list[DataFrame]:
    """Output i has element i of each array; short arrays give null."""
    return [rows.withColumn("value", F.try_element_at("value", F.lit(i + 1))) for i in range(count)]


# what is left unread


def take_while(rows: DataFrame, predicate: Callable[[object], bool], kind: str = "double") -> DataFrame:
    """key, seq, value of the elements up to the first for which predicate fails: that one and what follows stay
    unread, and are asked about again with each micro-batch."""

    def run(key, batch, state):
        unread, out = [*state["unread"], *([n, v] for n, v in batch)], []
        while unread and predicate(unread[0][1]):
            out.append(tuple(unread.pop(0)))
        return out, {"unread": unread}

    return _sliced(rows, run, lambda: {"unread": []}, ["seq", "value"], ["seq"], f"seq long, value {kind}")


def iot(rows: DataFrame, f: Callable, kind: str = "double") -> DataFrame:
    """key, seq, value: f(unread) -> (values, consumed) with each micro-batch of a key."""

    def run(key, batch, state):
        unread = [*state["unread"], *(v for _, v in batch)]
        values, consumed = f(unread)
        n = state["n"]
        return [(n + i, v) for i, v in enumerate(values)], {"n": n + len(values), "unread": unread[_consumed(consumed, len(unread)) :]}

    return _sliced(rows, run, lambda: {"n": 0, "unread": []}, ["seq", "value"], ["seq"], f"seq long, value {kind}")


def iot_merge(streams: Sequence[DataFrame], f: Callable, kind: str = "double") -> DataFrame:
    """key, seq, value: f([unread0, unread1, …]) -> (values, [consumed0, consumed1, …]) with each micro-batch of a key."""
    k = len(streams)

    def run(key, batch, state):
        unread = [[v for i, v in state["unread"] if i == j] for j in range(k)]
        for i, _, v in batch:
            unread[i].append(v)
        values, consumed = f(unread)
        left = [u[_consumed(c, len(u)) :] for u, c in zip(unread, consumed, strict=True)]
        n = state["n"]
        return [(n + i, v) for i, v in enumerate(values)], {"n": n + len(values), "unread": [(i, v) for i, u in enumerate(left) for v in u]}

    return _sliced(_tagged(streams, "value"), run, lambda: {"n": 0, "unread": []}, ["i", "seq", "value"], ["i", "seq"], f"seq long, value {kind}")


def _consumed(n: int, most: int) -> int:
    if not isinstance(n, int) or not 0 <= n <= most:
        raise ValueError(f"the number of consumed elements is an integer from 0 to {most}, not {n!r}")
    return n


# batches, sources and runs


def signal(rows: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """f(batch, batch id) once for each micro-batch of what is there: signal_element, chunk and their sinks."""
    run_available(rows, f, checkpoint)


def print_batches(rows: DataFrame, checkpoint: str) -> None:
    """Print what is there, batch by batch."""
    query = rows.writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there in micro-batches, calling sink(batch, batch id), and stop."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def file_source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the JSON files that are put in a folder, in order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def text_source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the lines (value) of the text files that are put in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def rate_source(spark: SparkSession, rows_per_second: int, f: Callable[[Column], Column]) -> DataFrame:
    """seq, ts and f(seq), at a steady rate."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rows.select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"), f(F.col("value")).alias("value"))
