"""List operators, operators with state, initial values, sinks, the facade, decorators and networks."""

import bisect
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from streamloom import runtime, simple
from streamloom.core import OrderedStream
from streamloom.functions import basics
from streamloom.operators import fold as folds, lists, merge, sinks, split, windows


def ints(spark, values):
    return OrderedStream.from_list(spark, list(values), "long")


def keyed(spark, rows):
    return OrderedStream(spark.createDataFrame(rows, "user string, seq long, value long"), keys=["user"])


def column(df, name="value", order="seq"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def timed(spark, rows):
    return OrderedStream(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, ts long, value string"), ts="ts")


@pytest.mark.parametrize("size", [3, 4, 100])
def test_list_operators(spark, size):
    s = ints(spark, range(10))
    assert lists.map_list(s, lambda x: [2 * v for v in x], "long", size).values() == list(range(0, 20, 2))
    assert lists.map_list(s, lambda x: [v for v in x if v % 3], "long", size).values() == [1, 2, 4, 5, 7, 8]
    assert lists.map_array(s, lambda x: x + 1, "long", size).values() == list(range(1, 11))

    def add(x, state):
        return [v + state + 2 * i for i, v in enumerate(x)], state + 2 * len(x)

    assert lists.map_list(s, add, "long", size, lambda: 0).values() == [3 * v for v in range(10)]
    both = [s, ints(spark, range(100, 108))]
    assert lists.merge_list(both, lambda xs: [a + b for a, b in zip(*xs, strict=True)], "long", size).values() == list(range(100, 116, 2))
    total = lists.merge_list(both, lambda xs, state: ([state + a + b for a, b in zip(*xs, strict=True)], state + len(xs[0])), "long", size, lambda: 0).values()
    assert total == [100 + 2 * i + i // size * size for i in range(8)]
    odd, square = lists.split_list(s, lambda x: [[v for v in x if v % 2], [v * v for v in x]], ["long", "long"], size)
    assert odd.values() == [1, 3, 5, 7, 9] and square.values() == [v * v for v in range(10)]
    odd, seen = lists.split_list(s, lambda x, n: ([[v for v in x if v % 2], [n]], n + len(x)), ["long", "long"], size, lambda: 0)
    assert odd.values() == [1, 3, 5, 7, 9] and seen.values() == list(range(0, 10, size))
    a, b = lists.multi_list(both, lambda xs: [[x + y for x, y in zip(*xs, strict=True)], [x - y for x, y in zip(*xs, strict=True)]], ["long", "long"], size)
    assert a.values() == list(range(100, 116, 2)) and b.values() == [-100] * 8
    per_user = keyed(spark, [("a", i, i) for i in range(5)] + [("b", i, 10 * i) for i in range(4)])
    out = lists.map_list(per_user, lambda x: [v + 1 for v in x], "long", size)
    assert [tuple(r) for r in out.df.select("user", "seq", "value").orderBy("user", "seq").collect()] == [("a", i, i + 1) for i in range(5)] + [("b", i, 10 * i + 1) for i in range(4)]
    assert lists.map_list(OrderedStream(spark.createDataFrame([], "seq long, value long")), lambda x: x, "long", size).values() == []


@pytest.mark.parametrize("size", [1, 3, 50])
def test_iot(spark, size):
    out = lists.iot(ints(spark, range(11)), lambda a: ([sum(a[i : i + 3]) for i in range(0, len(a) - 2, 3)], len(a) // 3 * 3), "long", size)
    assert out.values() == [3, 12, 21]

    def pairs(unread):
        n = min(map(len, unread))
        return [sum(v) for v in zip(*(u[:n] for u in unread), strict=True)], [n] * len(unread)

    assert lists.iot_merge([ints(spark, range(9)), ints(spark, range(10, 15))], pairs, "long", size).values() == [10, 12, 14, 16, 18]
    with pytest.raises(Exception, match="consumed"):
        lists.iot(ints(spark, range(3)), lambda a: ([], len(a) + 1), "long", 2).values()


def test_states(spark):
    x, y = ints(spark, range(5)), ints(spark, [10, 20, 30])
    assert merge.zip_map([x, y], lambda v, s: (v[0] + v[1] + s, s + 1), lambda: 100, "long").values() == [110, 122, 134]
    a, b = merge.multi_element([x, y], lambda v, s: ([v[0] + s, v[1] if v[1] > 10 else None], s + 1), lambda: 0, ["long", "long"])
    assert a.values() == [0, 2, 4] and b.values() == [20, 30]
    a, b = split.split_element(x, lambda v, s: ([v + s, v if v % 2 else folds.NO_VALUE], s + 2), lambda: 0, ["long", "long"])
    assert a.values() == [0, 3, 6, 9, 12] and b.values() == [1, 3]
    total, top = split.split_window_fold(ints(spark, range(8)), 3, 2, lambda w, s: ([sum(w) + s, max(w)], s + 1), lambda: 0, ["long", "long"])
    assert total.values() == [3, 10, 17] and top.values() == [2, 4, 6]
    assert windows.window_fold(ints(spark, range(16)), 4, 4, lambda w, s: (sum(w) + s, s + 1), lambda: 0, "long").values() == [6, 23, 40, 57]
    some = windows.window_fold(ints(spark, range(16)), 4, 4, lambda w, s: (folds.Many(w[:2]) if s % 2 else folds.NO_VALUE, s + 1), lambda: 0, "long")
    assert some.values() == [4, 5, 12, 13] and column(some.df, "seq") == [0, 1, 2, 3]
    out = merge.merge_window_fold([ints(spark, range(6)), ints(spark, range(10, 30))], 2, 2, lambda w, s: (sum(w[0]) + sum(w[1]) + s, s + 1), lambda: 0, "long")
    assert out.values() == [22, 31, 40]
    a, b = merge.multi_window_fold([ints(spark, range(6)), ints(spark, range(10, 30))], 2, 2, lambda w, s: ([sum(w[0]), sum(w[1]) + s], s + 1), lambda: 0, ["long", "long"])
    assert a.values() == [1, 5, 9] and b.values() == [21, 26, 31]
    p, q = timed(spark, [(1, "a"), (3, "b"), (9, "c")]), timed(spark, [(2, "A"), (3, "B")])
    found = merge.merge_asynch([p, q], lambda x, s: (f"{s}{x[0]}{x[1]}", s + 1), initial=lambda: 0, kind="string")
    assert column(found) == ["00a", "11A", "20b", "31B", "40c"]
    assert column(merge.blend([p, q], lambda x, s: (s + x, s + x), initial=lambda: "", kind="string")) == ["a", "aA", "aAb", "aAbB", "aAbBc"]


def test_initial_values(spark):
    s = ints(spark, [1, 2, 3, 4])
    assert column(windows.window(s, 2, 1, F.sum("value").alias("value"), initial_value=5), order="w") == [10, 6, 3, 5, 7]
    out = merge.merge_window([s, ints(spark, [10, 20, 30])], 2, 2, F.sum, initial_value=0)
    assert [tuple(r) for r in out.orderBy("w").collect()] == [(0, 0, 0), (1, 3, 30)]
    out = windows.window_list(s, 2, 2, lambda a: F.reverse(a), initial_value=9)
    assert [r.value for r in out.orderBy("w", "pos").collect()] == [9, 9, 2, 1, 4, 3]


def test_window_strategies(spark):
    values = [(7 * i) % 23 for i in range(300)]
    unkeyed, per_user = ints(spark, values), keyed(spark, [(u, i, v) for u in "ab" for i, v in enumerate(values)])
    reduce = {"sum": sum, "count": len, "avg": lambda w: sum(w) / len(w), "min": min, "max": max}
    for size, step in ((3, 3), (5, 2), (60, 1), (60, 2), (40, 10), (100, 4), (2, 7), (1, 1), (301, 1)):
        for how, f in reduce.items():
            want = [f(values[k : k + size]) for k in range(0, len(values) - size + 1, step)]
            assert column(windows.reduce_window(unkeyed, size, step, how), order="w") == want
        found = windows.reduce_window(per_user, size, step, "max")
        assert found.count() == 2 * len(want) and column(found.filter("user = 'b'"), order="w") == want
    small = windows.window_frame(unkeyed, 7, 3, bucket=10, value=F.max("value"))  # buckets smaller than the stream
    assert column(small, order="w") == [max(values[k : k + 7]) for k in range(0, 294, 3)]
    grow = windows.startup_window(unkeyed, 10, 3, s=F.sum("value"))
    assert column(grow, "s", "w") == [sum(values[max(0, k - 9) : k + 1]) for k in range(2, 300, 3)]
    for bad in ((0, 1), (3, 0), (2.5, 1), (True, 1)):
        with pytest.raises(ValueError):
            windows.window(unkeyed, *bad, F.sum("value"))


def test_halo(spark):
    s = OrderedStream(spark.range(50).select(F.col("id").alias("seq"), F.col("id").alias("value")))
    got = {(r["__b"], r["seq"]): r["__own"] for r in s.halo(3, 2, 10).collect()}
    assert got == {(b, n): n // 10 == b for b in range(6) for n in range(max(0, 10 * b - 2), min(50, 10 * b + 13)) if b < 5 or n >= 48}


def test_fold_positions(spark):
    s = ints(spark, range(6))
    step = lambda v, t: (folds.Many([v] * (v % 3)) if v != 4 else folds.NO_VALUE, t)
    out = folds.fold(s, step, lambda: None, "long")
    assert sorted(tuple(r) for r in out.select("seq", "pos", "value").collect()) == [(1, 0, 1), (2, 0, 2), (2, 1, 2), (5, 0, 5), (5, 1, 5)]
    dense = folds.fold(s, step, lambda: None, "long", renumber=True)
    assert sorted(tuple(r) for r in dense.select("seq", "value").collect()) == [(0, 1), (1, 2), (2, 2), (3, 5), (4, 5)]


def lines(path):
    with open(path) as f:
        return f.read().splitlines()


def writer(path):
    """A sink: a line for what it is given."""

    def f(x):
        with open(path, "a") as out:
            out.write(f"{x}\n")

    return f


def test_sinks(spark, tmp_path):
    n = iter(range(100))
    new = lambda: str(tmp_path / f"out{next(n)}")
    s, t = ints(spark, range(4)), ints(spark, [10, 20, 30])

    def run(sink, *args, **kw):
        path = new()
        sink(*args, writer(path), **kw)
        return lines(path)

    assert run(sinks.sink_element, s) == ["0", "1", "2", "3"]
    assert run(sinks.sink_window, s, 2, 1) == ["[0, 1]", "[1, 2]", "[2, 3]"]
    path = new()
    sinks.sink_window(s, 2, 2, writer(path), aggregate=F.sum("value"))
    assert lines(path) == ["1", "5"]
    assert run(sinks.sink_list, s, size=3) == ["[0, 1, 2]", "[3]"]
    assert run(sinks.signal_sink, s, F.floor(F.col("seq") / 2)) == ["0", "1"]
    assert run(sinks.zip_map_sink, [s, t]) == ["(0, 10)", "(1, 20)", "(2, 30)"]
    p, q = timed(spark, [(1, "a"), (3, "b")]), timed(spark, [(2, "A"), (3, "B")])
    assert run(sinks.join_asynch_sink, [p, q]) == ["a", "A", "b", "B"]
    assert run(sinks.join_timed_sink, [p, q]) == ["(1, ['a', None])", "(2, [None, 'A'])", "(3, ['b', 'B'])"]
    assert run(sinks.merge_window_sink, [s, t], 2, 1) == ["[[0, 1], [10, 20]]", "[[1, 2], [20, 30]]"]
    path = new()
    f = writer(path)

    def count(x, state):
        f((x, state))
        return state + 1

    sinks.sink_element(s, count, lambda: 5)
    assert lines(path) == ["(0, 5)", "(1, 6)", "(2, 7)", "(3, 8)"]
    got = []
    sinks.sink_batch(s, lambda df: got.append(df.count()))
    assert got == [4]


def test_facade(spark, tmp_path):
    s, t = ints(spark, range(4)), ints(spark, [10, 20, 30])
    p, q = timed(spark, [(1, "a"), (3, "b")]), timed(spark, [(2, "A"), (3, "B")])
    calls = [
        (simple.f_item, (s,), {}, ["0", "1", "2", "3"]),
        (simple.f_window, (s, 2, 2), {}, ["[0, 1]", "[2, 3]"]),
        (simple.f_window, (s, 3), {}, ["[0, 1, 2]", "[1, 2, 3]"]),
        (simple.join_synch, ([s, t],), {}, ["(0, 10)", "(1, 20)", "(2, 30)"]),
        (simple.join_asynch, ([p, q],), {}, ["(0, 'a')", "(1, 'A')", "(0, 'b')", "(1, 'B')"]),
        (simple.f_join_asynch, ([p, q],), {}, ["a", "A", "b", "B"]),
        (simple.join_timed, ([p, q],), {}, ["(1, ['a', None])", "(2, [None, 'A'])", "(3, ['b', 'B'])"]),
    ]
    for i, (f, args, kw, want) in enumerate(calls):
        path = str(tmp_path / str(i))
        f(writer(path), *args, **kw)
        assert lines(path) == want
    items = [timed(spark, [(5, "a"), (7, "b")]), timed(spark, [(5, "x"), (6, "y")])]
    whole = [OrderedStream(s.df.select("seq", F.struct("ts", "value").alias("value"))) for s in items]
    out = merge.join_timed(whole, lambda v: v["ts"])
    assert [(r.time, r.v0 and r.v0.value, r.v1 and r.v1.value) for r in out.orderBy("time").collect()] == [(5, "a", "x"), (6, None, "y")]


def test_print(spark, capsys):
    sinks.print_stream(ints(spark, [5, 6]), "x")
    sinks.print_stream(ints(spark, [7]), "y", numbered=False)
    assert capsys.readouterr().out.splitlines() == ["x[0] = 5", "x[1] = 6", "y : 7"]


def test_decorators(spark, tmp_path):
    s, t = ints(spark, range(6)), ints(spark, [10, 20, 30])

    @basics.element
    def times(x, by):
        return x * by

    @basics.keep
    def over(x, least):
        return x > least

    @basics.many
    def twice(x):
        return F.array(x, x)

    @basics.listed("long", 4)
    def reverse(x):
        return x[::-1]

    @basics.windowed
    def total(name):
        return F.sum(name)

    @basics.windowed_list
    def back(window):
        return F.reverse(window)

    @basics.zipped
    def plus(x, y, more=0):
        return x + y + more

    @basics.zipped_window
    def top(name):
        return F.max(name)

    @basics.splitting
    def parts(x):
        return [F.when(x % 2 == 0, x), F.when(x % 2 == 1, x)]

    @basics.splitting_window
    def ends(name):
        return [F.min(name), F.max(name)]

    @basics.multi
    def both(x, y):
        return [x + y, x - y]

    @basics.multi_windowed(F.sum, F.max)
    def mixed(s0, m0, s1, m1):
        return [s0 + m1, s1 + m0]

    @basics.folding("long", lambda: 0)
    def running(x, state):
        return x + state, x + state

    assert times(s, by=3).values() == [0, 3, 6, 9, 12, 15] and over(s, least=3).values() == [4, 5]
    assert twice(t).values() == [10, 10, 20, 20, 30, 30] and reverse(s).values() == [3, 2, 1, 0, 5, 4]
    assert column(total(s, 2, 2), order="w") == [1, 5, 9] and column(total(s, window_size=5), order="w") == [10, 15]
    assert [r.value for r in back(t, 2).orderBy("w", "pos").collect()] == [20, 10, 30, 20]
    assert plus(s, t).values() == [10, 21, 32] and plus(s, t, more=1).values() == [11, 22, 33]
    assert [tuple(r) for r in top([s, t], 2, 2).orderBy("w").collect()] == [(0, 1, 20)]
    assert [p.values() for p in parts(s)] == [[0, 2, 4], [1, 3, 5]]
    assert [tuple(r) for r in ends(s, 3, 3).orderBy("w").collect()] == [(0, 0, 2), (1, 3, 5)]
    assert [p.values() for p in both(s, t)] == [[10, 21, 32], [-10, -19, -28]]
    assert [p.values() for p in mixed([s, t], 2)] == [[21, 33], [31, 52]]
    assert column(running(s)) == [0, 1, 3, 6, 10, 15]
    assert column(basics.blended(lambda v: F.upper(v))([timed(spark, [(1, "a")]), timed(spark, [(2, "b")])]), order="ts") == ["A", "B"]
    path = str(tmp_path / "sink")
    write = writer(path)
    basics.sinking(lambda x: write(x))(t)
    basics.sinking_window(lambda x: write(x))(t, 2, 2)
    basics.zipped_sink(lambda x: write(x))(s, t)
    assert lines(path) == ["10", "20", "30", "[10, 20]", "(0, 10)", "(1, 20)", "(2, 30)"]


def test_core_helpers(spark):
    s = ints(spark, range(3))
    assert s.extend([7, 8]).values() == [0, 1, 2, 7, 8] and s.copy().values() == [0, 1, 2] and ints(spark, []).extend([1]).values() == [1]
    assert s.transform(lambda x, by: x.map(basics.multiply, by), 5).values() == [0, 5, 10]
    assert s.checked("long") is s
    with pytest.raises(TypeError):
        s.checked("string")
    pairs = OrderedStream(spark.createDataFrame([(0, (1, "a")), (1, (2, "b"))], "seq long, value struct<x:long,y:string>"))
    assert [p.values() for p in split.split_tuple(pairs)] == [[1, 2], ["a", "b"]]
    assert s.latest_value(9).first()[0] == 2 and ints(spark, []).latest_value(9).first()[0] == 9
    keyed_rows = keyed(spark, [("a", 0, 5), ("a", 1, 6), ("b", 0, 7)])
    assert [tuple(r) for r in basics.first_n(keyed_rows, 1).orderBy("user").collect()] == [("a", 0, 5), ("b", 0, 7)]
    assert basics.append_items([s, s.map(basics.add, 1)]).values() == [[0, 1], [1, 2], [2, 3]]


def test_clock_and_as_of(spark):
    rows = spark.createDataFrame([("a", 0, "2024-01-01 00:00:01", 1), ("a", 1, "2024-01-01 00:00:05", 2), ("b", 0, "2024-01-01 00:00:02", 3), ("b", 1, "2024-01-05 00:00:00", 4)], "user string, seq long, ts string, value long").withColumn("ts", F.to_timestamp("ts"))
    clock = spark.createDataFrame([("a", "2024-01-01 00:00:03"), ("a", "2024-01-02 00:00:00"), ("b", "2024-01-04 00:00:00")], "user string, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = {(r.user, r.seq): r.tick and str(r.tick) for r in merge.call_on_clock(OrderedStream(rows, keys=["user"]), clock).collect()}
    assert out == {("a", 0): "2024-01-01 00:00:03", ("a", 1): "2024-01-02 00:00:00", ("b", 0): "2024-01-04 00:00:00", ("b", 1): None}
    other = clock.withColumn("tick", F.col("ts"))
    out = {(r.user, r.seq): r.tick and str(r.tick) for r in merge.as_of(OrderedStream(rows, keys=["user"]), other, ["tick"]).collect()}
    assert out == {("a", 0): None, ("a", 1): "2024-01-01 00:00:03", ("b", 0): None, ("b", 1): "2024-01-04 00:00:00"}


def test_clock_over_a_long_day(spark):
    """A day of 60,000 elements, with tied times and ticks: work grows with the elements, not with their square."""
    n = 60_000
    at = [i * 7919 % 80_000 // 2 for i in range(n)]  # seconds
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "seq long, t long").withColumn("ts", F.timestamp_seconds("t"))
    clock = rows.filter("seq % 100 = 50").select("ts")
    out = merge.call_on_clock(OrderedStream(rows), clock)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    start = time.perf_counter()
    got = {r.seq: r.tick for r in out.select("seq", F.unix_seconds("tick").alias("tick")).collect()}
    assert time.perf_counter() - start < 60
    ticks = sorted({t for i, t in enumerate(at) if i % 100 == 50})
    places = [bisect.bisect_left(ticks, t) for t in at]
    assert got == {i: ticks[p] if p < len(ticks) else None for i, p in enumerate(places)}


def test_clock_odd_rows(spark):
    """Null times and keys stay, null ticks are none, and a day that comes twice by the zone's shift is no limit."""
    at = lambda rows, kind: spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("ts"))
    rows = at([("a", 0, 10), ("a", 1, None), (None, 0, 10), (None, 1, 99_999), ("c", 0, 5)], "user string, seq long, ts long")
    clock = at([("a", 10), ("a", None), (None, 20), (None, 200_000), ("b", 7)], "user string, ts long")
    out = merge.call_on_clock(OrderedStream(rows, keys=["user"]), clock)
    assert out.columns == ["user", "seq", "ts", "tick"]
    got = sorted(((r.user or "", r.seq, r.t) for r in out.select("user", "seq", F.unix_seconds("tick").alias("t")).collect()))
    assert got == [("", 0, 20), ("", 1, 200_000), ("a", 0, 10), ("a", 1, None), ("c", 0, None)]
    none = merge.call_on_clock(OrderedStream(rows.drop("user")), clock.select("ts").limit(0))
    assert none.count() == 5 and none.filter("tick is not null").count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")  # 2010-11-07 00:01 was 2010-11-06 23:01 again
        rows = at([(0, 1289097030)], "seq long, ts long")
        out = merge.call_on_clock(OrderedStream(rows), at([(1289098800,)], "ts long"))
        assert out.select(F.unix_seconds("tick")).first()[0] == 1289098800
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Apia")  # 2011-12-30 was left out
        local = lambda *times: spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        out = merge.call_on_clock(OrderedStream(local("2011-12-30 05:00:00", "2011-12-30 07:00:00")), local("2011-12-30 06:00:00", "2011-12-31 03:00:00").select("ts"))
        assert {r.seq: str(r.tick) for r in out.collect()} == {0: "2011-12-30 06:00:00", 1: "2011-12-31 03:00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def net():
    double = runtime.Process("double", {"x": "i"}, {"y": "i"}, lambda i: {"y": i["x"].map(basics.multiply, 2)})
    add = runtime.Process("add", {"a": "i", "b": "bigint"}, {"c": "i"}, lambda i: {"c": i["a"] + i["b"]})
    return runtime.Network().source("s", "i").add(double).add(add).connect("s", "s", "double", "x").connect("s", "s", "add", "a").connect("double", "y", "add", "b")


def test_networks(spark):
    n = net()
    assert n.check() == ["double", "add"] and n.readers("s") == ["add", "double"]
    assert n.run({"s": ints(spark, range(4))})["add"]["c"].values() == [0, 3, 6, 9]
    with pytest.raises(TypeError):
        n.run({"s": OrderedStream.from_list(spark, ["a"], "string")})
    text = runtime.Process("text", {"x": "c_wchar"}, {"y": "c_wchar"}, lambda i: {"y": i["x"]})
    for bad, kind in (
        (lambda n: n.connect("s", "s", "add", "a"), ValueError),  # two writers
        (lambda n: n.connect("s", "t", "add", "a"), ValueError),  # no such stream
        (lambda n: n.connect("none", "s", "add", "a"), ValueError),
        (lambda n: n.connect("s", "s", "none", "a"), ValueError),
        (lambda n: n.connect("s", "s", "add", "none"), ValueError),
        (lambda n: n.add(text), ValueError),  # no writer
        (lambda n: n.add(text).connect("s", "s", "text", "x"), TypeError),
        (lambda n: n.source("u", "i"), ValueError),  # nothing reads it
        (lambda n: n.source("s", "i"), ValueError),
        (lambda n: n.add(n.processes["add"]), ValueError),
    ):
        with pytest.raises(kind):
            bad(net()).check()
    loop = runtime.Network().add(runtime.Process("p", {"x": "i"}, {"y": "i"}, None)).add(runtime.Process("q", {"x": "i"}, {"y": "i"}, None))
    with pytest.raises(ValueError, match="cycle"):
        loop.connect("p", "y", "q", "x").connect("q", "y", "p", "x").check()
    wrong = runtime.Network().source("s", "i").add(runtime.Process("p", {"x": "i"}, {"y": "i"}, lambda i: {})).connect("s", "s", "p", "x")
    with pytest.raises(ValueError):
        wrong.run({"s": ints(spark, [1])})


def test_shared_variables(spark):
    numbers = runtime.Shared([5, 3, 9, 1])
    for i in range(3):

        def swap(v, i=i):
            if v.value[i] > v.value[i + 1]:
                v.set([*v.value[:i], v.value[i + 1], v.value[i], *v.value[i + 2 :]])

        numbers.register(swap)
    numbers.activate()
    assert numbers.value == [1, 3, 5, 9]
    numbers.delete(numbers._subscribers[0])
    with pytest.raises(RuntimeError):
        forever = runtime.Shared(0)
        forever.register(lambda v: v.set(v.value + 1))
        forever.activate(20)
    total = runtime.Shared(0)
    seen = []
    total.register(lambda v: seen.append(v.value))
    total.set(4)
    assert seen == [4]
    same = lambda a, b: a.agg(F.max("x")).first() == b.agg(F.max("x")).first()
    out = runtime.fixpoint(spark.createDataFrame([(1,), (7,)], "x long"), lambda df: df.select(F.least(F.col("x") * 2, F.lit(50)).alias("x")), same)
    assert sorted(r.x for r in out.collect()) in ([32, 50], [50, 50], [16, 50], [8, 50])


def test_external_streams(spark, tmp_path):
    from streamloom.streaming import operators as st

    folder = str(tmp_path / "topic")
    s = runtime.ExternalStream(folder, "x", "k")
    s.extend([1.0, 2.0])
    s.append(3.0)
    other = runtime.ExternalStream(folder, "other", "k")
    other.extend([99.0])
    s = runtime.ExternalStream(folder, "x", "k")  # another program goes on
    s.extend([4.0])
    assert not s.finished()
    s.terminate()
    assert s.finished()
    got = []
    st.run_available(s.read(spark), lambda b, _: got.extend((r.seq, r.value) for r in b.collect()), str(tmp_path / "checkpoint"))
    assert sorted(got) == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    assert all(json.loads(row) for f in os.listdir(folder) if f.endswith(".json") for row in open(os.path.join(folder, f)))
