"""The ordered operators against plain loops over small inputs."""

import random

from pyspark.sql import functions as F

from streamloom.core import OrderedStream, dense_positions
from streamloom.functions import basics, graph, signal, sketches
from streamloom.operators import fold as folds, merge, sinks, split, windows

DRAW = random.Random(17)
NUMBERS = [DRAW.randrange(-40, 40) for _ in range(37)]


def ints(spark, values):
    return OrderedStream.from_list(spark, values, "long")


def floats(spark, values):
    return OrderedStream.from_list(spark, [float(v) for v in values], "double")


def column(df, name="value", order="w"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_elements(spark):
    s = ints(spark, NUMBERS)
    assert s.map(basics.multiply, 3).values() == [3 * v for v in NUMBERS]
    kept = s.filter(lambda v: v >= 11)
    assert kept.values() == [v for v in NUMBERS if v >= 11]
    assert column(kept.df, "seq", "seq") == list(range(kept.df.count()))
    assert ints(spark, [7, None, 3, None]).values() == [7, 3]
    assert OrderedStream.from_list(spark, [7, None, 3], "long", keep_none=True).values() == [7, None, 3]
    assert s.map(basics.clip, 9).values() == [max(-9, min(9, v)) for v in NUMBERS]
    assert s.map(basics.at_most, 5).values() == [min(5, v) for v in NUMBERS] and s.map(basics.at_least, 5).values() == [max(5, v) for v in NUMBERS]
    assert s.filter(basics.large, 20).values() == [v for v in NUMBERS if abs(v) >= 20]
    assert ints(spark, [4, 9]).map_many(lambda v: F.array(v, -v, v)).values() == [4, -4, 4, 9, -9, 9]
    assert ints(spark, [4, 9]).prepend([8, 8]).values() == [8, 8, 4, 9]
    assert s.prepend([]).bounds().first().asDict() == {"first": 0, "last": 36, "n": 37}
    assert column(s.latest(2), "seq", "seq") == [35, 36] and s.after(30).count() == 7


def test_operators_on_streams(spark):
    other = [v * v % 13 + 1 for v in NUMBERS[:30]]
    x, y = ints(spark, NUMBERS), ints(spark, other)
    pairs = list(zip(NUMBERS, other, strict=False))
    assert (x + y).values() == [a + b for a, b in pairs] and (x - y).values() == [a - b for a, b in pairs]
    assert (x * y).values() == [a * b for a, b in pairs] and (x // y).values() == [a // b for a, b in pairs]
    assert (x % y).values() == [a % b for a, b in pairs]
    assert (x % (y * -1)).values() == [a % -b for a, b in pairs]  # the divisor's sign
    assert (x / y).values() == [a / b for a, b in pairs]
    assert (x <= y).values() == [a <= b for a, b in pairs] and (x >= y).values() == [a >= b for a, b in pairs]
    assert (x < y).values() == [a < b for a, b in pairs] and (x > y).values() == [a > b for a, b in pairs]
    assert x.equals(y).values() == [a == b for a, b in pairs] and x.differs(y).values() == [a != b for a, b in pairs]
    same = merge.zip_streams([x, x.map(basics.add, 1)])
    assert "Join" not in same._jdf.queryExecution().optimizedPlan().toString()


def test_count_windows(spark):
    s = ints(spark, NUMBERS)
    for size, step in ((5, 5), (4, 3), (3, 7), (1, 1), (37, 2), (38, 1)):
        want = [sum(NUMBERS[k : k + size]) for k in range(0, len(NUMBERS) - size + 1, step)]
        assert column(windows.window(s, size, step, F.sum("value").alias("value"))) == want
        assert column(windows.window_sums(s, size, step, "sum"), "sum") == want
        assert column(windows.window_frame(s, size, step, m=F.sum("value")), "m") == want
        assert column(windows.window_python(s, size, step, lambda a: float(a.sum()), "double", bucket=6)) == want
    grow = windows.startup_window(s, 9, 2, s=F.sum("value"))
    assert column(grow, "s") == [sum(NUMBERS[max(0, k - 8) : k + 1]) for k in range(1, 37, 2)]


def test_timed_windows(spark):
    times = sorted(DRAW.sample(range(1, 130), 25))
    rows = [(t, chr(97 + i)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "t long, v string").withColumn("ts", F.timestamp_seconds("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]), "").alias("value")
    for duration, step in ((7, 7), (20, 10), (5, 9)):
        out = windows.timed_window(df, f"{duration} seconds", f"{step} seconds", text, origin="1970-01-01 00:00:00")
        found = {int(r["end"].timestamp()): r["value"] for r in out.collect()}
        want = {s + duration: "".join(v for t, v in rows if s <= t < s + duration) for s in range(0, 140, step) if s + duration <= times[-1]}
        assert found == {k: v for k, v in want.items() if v}


def test_merge(spark):
    x, y = ints(spark, NUMBERS[:9]), ints(spark, NUMBERS[9:21])
    pairs = list(zip(NUMBERS[:9], NUMBERS[9:21], strict=False))
    assert merge.zip_map([x, y], lambda a, b: 5 * a - b).values() == [5 * a - b for a, b in pairs]
    a, b = merge.multi_element([x, y], lambda p, q: [F.greatest(p, q), p + q])
    assert a.values() == [max(p) for p in pairs] and b.values() == [sum(p) for p in pairs]
    out = merge.merge_windows([x, y], [3, 2], [1, 2], F.sum)
    want = [sum(NUMBERS[k : k + 3]) + sum(NUMBERS[9 + 2 * k : 11 + 2 * k]) for k in range(6)]
    assert column(out.withColumn("value", F.col("v0") + F.col("v1"))) == want
    arrivals = [(n, DRAW.randrange(30), n % 2, f"x{n}") for n in range(20)]
    top, kept = -1, []
    for n, t, _, v in arrivals:
        if t > top:
            top = t
            kept.append(v)
    assert column(merge.timed_mix(spark.createDataFrame(arrivals, "seq long, ts long, i int, value string")), "value", "seq") == kept
    sides = [sorted(DRAW.sample(range(60), 12)) for _ in range(3)]
    streams = [OrderedStream(spark.createDataFrame([(i, t, f"{k}.{t}") for i, t in enumerate(ts)], "seq long, ts long, value string")) for k, ts in enumerate(sides)]
    zipped = merge.timed_zip(streams)
    end = min(ts[-1] for ts in sides)
    want = [(t, *(f"{k}.{t}" if t in ts else None for k, ts in enumerate(sides))) for t in sorted(set().union(*sides)) if t <= end]
    assert [tuple(r) for r in zipped.orderBy("ts").collect()] == want
    assert [column(p, "value", "ts") for p in split.timed_unzip(zipped, 3)] == [[f"{k}.{t}" for t in ts if t <= end] for k, ts in enumerate(sides)]


def test_split(spark):
    a, b = split.split_element(ints(spark, NUMBERS), lambda v: [v - 1, F.when(v % 3 == 0, v * 5)])
    assert a.values() == [v - 1 for v in NUMBERS] and b.values() == [5 * v for v in NUMBERS if v % 3 == 0]
    tagged = OrderedStream(spark.createDataFrame([(n, n * n % 3, v) for n, v in enumerate(NUMBERS)], "seq long, tag int, value long"))
    assert [s.values() for s in split.separate(tagged, "tag", 3)] == [[v for n, v in enumerate(NUMBERS) if n * n % 3 == j] for j in range(3)]
    uneven = OrderedStream.from_list(spark, [[3, 1, 9], [], [4, 8]], "array<long>")
    assert [s.values() for s in split.unzip(uneven, 2)] == [[3, None, 4], [1, None, 8]]


def test_folds(spark):
    values = [float(v) for v in NUMBERS]
    s = floats(spark, values)
    smooth, echo, late = [], [], []
    for n, v in enumerate(values):
        smooth.append(0.25 * (smooth[-1] if smooth else 0) + 0.75 * v)
        echo.append(v + 0.25 * (echo[-1] if echo else 0))
        late.append(v + 0.5 * (late[n - 4] if n >= 4 else 0))
    close = lambda got, want: all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    assert close(column(basics.exponential_smoothing(s, 0.25), order="seq"), smooth)
    assert close(column(basics.make_echo(s, 1, 0.25), order="seq"), echo) and close(column(basics.make_echo(s, 4, 0.5), order="seq"), late)
    for chunk in (1, 5, 100):
        assert close(column(folds.affine_scan(s, 0.25, 0.75, chunk=chunk), order="seq"), smooth)
    running = folds.fold(ints(spark, NUMBERS), lambda v, t: (v * t, t + 1), lambda: 2, "long")
    assert column(running, order="seq") == [v * (n + 2) for n, v in enumerate(NUMBERS)]
    dot = signal.window_dot(ints(spark, NUMBERS), [3, -1, 7])
    assert column(dot) == [3 * a - b + 7 * c for a, b, c in zip(NUMBERS, NUMBERS[1:], NUMBERS[2:], strict=False)]
    stop = next(n for n, v in enumerate(NUMBERS) if v >= 30)
    assert column(sinks.take_while(ints(spark, NUMBERS), lambda v: v < 30), order="seq") == NUMBERS[:stop]
    mean = signal.subtract_mean(floats(spark, NUMBERS), 6)
    assert close(column(mean, order="seq"), [NUMBERS[k] - sum(NUMBERS[k - 5 : k + 1]) / 6 for k in range(5, 37)])


def test_sketches_and_graphs(spark):
    rows = [(n, DRAW.choice(["add", "check"]), DRAW.choice("pqrs")) for n in range(60)]
    df = spark.createDataFrame(rows, "seq long, cmd string, key string")
    adds = [[m for m, c, k in rows if c == "add" and k == key and m < n] for n, cmd, key in rows if cmd == "check"]
    assert column(sketches.members(df), "found", "seq") == [bool(a) for a in adds]
    assert column(sketches.counts(df), "n", "seq") == [len(a) for a in adds]
    edges = [(DRAW.randrange(12), DRAW.randrange(12), DRAW.randrange(1, 9)) for _ in range(40)]
    best = {}
    for i, j, d in edges:
        best[i, j] = min(d, best.get((i, j), d))
    for k in range(12):
        for i in range(12):
            for j in range(12):
                if (i, k) in best and (k, j) in best:
                    best[i, j] = min(best[i, k] + best[k, j], best.get((i, j), 10**9))
    found = graph.shortest_paths(spark.createDataFrame(edges, "i long, j long, d long"))
    assert {(r.i, r.j): r.d for r in found.collect()} == best


def test_positions(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("x"))
    out = dense_positions(df, ["x"])
    assert out.filter("x <> seq * 3").count() == 0 and out.count() == 1000
    empty = spark.createDataFrame([], "seq long, value long")
    assert OrderedStream(empty).filter(lambda v: v > 0).values() == []
    for parts in (1, 5):
        s = OrderedStream(spark.range(50).repartition(parts).select(F.col("id").alias("seq"), F.col("id").alias("value")))
        assert column(windows.window(s, 7, 3, F.sum("value").alias("value"))) == [sum(range(3 * k, 3 * k + 7)) for k in range(15)]


def test_positions_of_a_hot_key(spark):
    rows = [("hot" if n % 3 else f"k{n % 7}" if n % 5 else None, n * 7919 % 1000) for n in range(1000)]
    df = spark.createDataFrame(rows, "k string, x long")
    found = [tuple(r) for r in OrderedStream.of(df, ["x"], "x", ["k"], spread=True).df.select("k", "seq", "x").collect()]
    want = []
    for key in {k for k, _ in rows}:
        want += [(key, i, x) for i, x in enumerate(sorted(x for k, x in rows if k == key))]
    order = lambda r: (r[0] or "", r[1])
    assert sorted(found, key=order) == sorted(want, key=order)
    kept = OrderedStream.of(df.filter("k is not null"), ["x"], "x", ["k"]).filter(lambda x: x % 2 == 1)
    for key in ("hot", "k3"):
        assert column(kept.df.filter(F.col("k") == key), "x", "seq") == sorted(x for k, x in rows if k == key and x % 2)
        assert column(kept.df.filter(F.col("k") == key), "seq", "seq") == list(range(sum(k == key and x % 2 == 1 for k, x in rows)))
