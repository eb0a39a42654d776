"""The streaming operators give what batch gives, for several micro-batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from streamloom.core import OrderedStream
from streamloom.operators import fold as folds, lists, merge, windows
from streamloom.streaming import operators as st


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition and query is most of these tests' time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def files(folder, batches):
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"{i:03d}.json")
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def rows(values, start=0):
    return [{"key": "k", "seq": start + i, "value": float(v)} for i, v in enumerate(values)]


def collected(df, tmp):
    out = []
    st.run_available(df, lambda b, _: out.extend(map(tuple, b.collect())), str(tmp / "checkpoint"))
    return sorted(out)


SCHEMA = "key string, seq long, value double"
CUTS = [[10], [1, 4, 5], [3, 3, 4]]


def cut(values, cuts, key="k", start=0, **more):
    """Rows of values in micro-batches of the given lengths; what is beyond goes to the last."""
    out, at = [], 0
    for i, c in enumerate(cuts):
        stop = at + c if i + 1 < len(cuts) else len(values)
        out.append([{"key": key, "seq": start + n, "value": float(values[n]), **{k: f(n) for k, f in more.items()}} for n in range(at, min(stop, len(values)))])
        at = stop
    return out


def source(spark, tmp_path, name, values, cuts, schema=SCHEMA, **more):
    return st.file_source(spark, files(tmp_path / name, cut(values, cuts, **more)), schema)


@pytest.mark.parametrize("cuts", CUTS)
def test_count_windows(spark, tmp_path, cuts):
    st.configure(spark)
    found = collected(st.count_windows(source(spark, tmp_path, "in", range(10), cuts), 3, 2), tmp_path)
    assert [r[2] for r in found] == [3, 9, 15, 21]


def test_fold_and_gap_windows(spark, tmp_path):
    st.configure(spark)
    data = files(tmp_path / "in", [rows([64, 32]), rows([16, 8, 4], 2), rows([2, 1], 5)])
    smooth = st.fold(st.file_source(spark, data, SCHEMA), lambda x, s: (0.5 * s + 0.5 * x,) * 2, 0.0)
    assert [r[2] for r in collected(smooth, tmp_path / "a")] == [32, 32, 24, 16, 10, 6, 3.5]
    data = files(tmp_path / "in2", [rows(range(3)), rows(range(3, 10), 3)])
    assert [r[2] for r in collected(st.count_windows(st.file_source(spark, data, SCHEMA), 2, 5), tmp_path / "b")] == [1, 11]


def test_zip(spark, tmp_path):
    st.configure(spark)
    a = st.file_source(spark, files(tmp_path / "a", [rows([0, 1, 2]), rows([3, 4], 3)]), SCHEMA)
    b = st.file_source(spark, files(tmp_path / "b", [rows([10, 15, 18]), rows([37], 3), rows([96, 95], 4)]), SCHEMA)
    assert [r[2] for r in collected(st.zip_map(a, b, lambda x, y: x + y), tmp_path)] == [10, 16, 20, 40, 100]


def test_timed_windows(spark, tmp_path):
    data = files(tmp_path / "in", [[{"t": t, "v": 1} for t in b] for b in ([1, 3], [6, 9], [12])])
    source = st.file_source(spark, data, "t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    out = collected(st.timed_windows(source, "5 seconds", "5 seconds", F.count("*").alias("n")), tmp_path)
    assert [(int(r[1].timestamp()), r[2]) for r in out] == [(5, 2), (10, 2)]


def test_timed_zip(spark, tmp_path):
    side = lambda name, times: st.file_source(spark, files(tmp_path / name, [[{"t": t, "value": f"{name}{t}"} for t in b] for b in times]), "t long, value string").withColumn("ts", F.timestamp_seconds("t"))
    times = [[1, 3], [10], [40], [41]], [[2], [3, 9], [50], [51]]
    zipped = st.timed_zip(side("a", times[0]), side("b", times[1]))
    out = [(int(r[0].timestamp()), r[1], r[2]) for r in collected(zipped, tmp_path)]
    sides = [OrderedStream(spark.createDataFrame([(t, f"{n}{t}") for b in ts for t in b], "ts long, value string"), seq="ts") for n, ts in zip("ab", times, strict=True)]
    assert out == sorted(tuple(r) for r in merge.timed_zip(sides).collect()) and len(out) == 7


VALUES = [5, 3, 8, 1, 9, 2, 7, 7, 4, 6]


def batch(spark, values):
    return OrderedStream.from_list(spark, [float(v) for v in values], "double")


def order(df, name="value"):
    return [r[0] for r in df.orderBy(df.columns[0]).select(name).collect()]


@pytest.mark.parametrize("cuts", CUTS[:2])
def test_elements_like_batch(spark, tmp_path, cuts):
    st.configure(spark)
    read = lambda name: source(spark, tmp_path, name, VALUES, cuts)
    kept = collected(st.keep(read("a"), lambda v: v > 4), tmp_path / "1")
    assert kept == [("k", i, v) for i, v in enumerate(batch(spark, VALUES).filter(lambda v: v > 4).values())]
    step = lambda x, s: (folds.Many([x, s]) if x > 4 else folds.NO_VALUE, s + 1)
    out = collected(st.fold(read("b"), step, 0), tmp_path / "2")
    assert sorted((r[1], r[3], r[2]) for r in out) == sorted(tuple(r) for r in folds.fold(batch(spark, VALUES), step, lambda: 0, "double").select("seq", "pos", "value").collect())
    running = collected(st.count_windows(read("c"), 3, 3, lambda w, s: (sum(w) + s, sum(w) + s), start=0.0), tmp_path / "3")
    assert [r[2] for r in running] == windows.window_fold(batch(spark, VALUES), 3, 3, lambda w, s: (sum(w) + s, sum(w) + s), lambda: 0.0).values()
    firsts = collected(st.take_while(read("d"), lambda v: v != 9), tmp_path / "4")
    assert [r[2] for r in firsts] == [5, 3, 8, 1]
    parts = st.split(read("e"), lambda v: [F.when(v > 4, v), v * 2])
    assert [r[2] for r in collected(parts[0], tmp_path / "5")] == [5, 8, 9, 7, 7, 6] and [r[2] for r in collected(parts[1], tmp_path / "6")] == [2 * v for v in VALUES]
    pairs = lambda a: ([x + y for x, y in zip(a[::2], a[1::2], strict=False)], len(a) // 2 * 2)
    assert [r[2] for r in collected(st.iot(read("f"), pairs), tmp_path / "7")] == lists.iot(batch(spark, VALUES), pairs).values()


@pytest.mark.parametrize("cuts", [([10], [12]), ([2, 3, 5], [6, 1, 5])])
def test_several_streams_like_batch(spark, tmp_path, cuts):
    st.configure(spark)
    other = [v * 10 for v in VALUES] + [1, 2]
    read = lambda name: [source(spark, tmp_path, f"{name}{i}", v, c) for i, (v, c) in enumerate(zip((VALUES, other), cuts, strict=True))]
    a, b = batch(spark, VALUES), batch(spark, other)
    zipped = collected(st.zip_streams(read("a"), lambda x, y: x + y), tmp_path / "1")
    assert [r[2] for r in zipped] == merge.zip_map([a, b], lambda x, y: x + y).values()
    for size, step in ((3, 2), (2, 5)):
        got = collected(st.merge_window(read(f"w{size}"), size, step, lambda w: sum(map(sum, w))), tmp_path / f"w{size}out")
        want = merge.merge_window([a, b], size, step, F.sum)
        assert [r[2] for r in got] == [r.v0 + r.v1 for r in want.orderBy("w").collect()]

    def both(unread):
        n = min(map(len, unread))
        return [sum(v) for v in zip(*(u[:n] for u in unread), strict=True)], [n] * len(unread)

    assert [r[2] for r in collected(st.iot_merge(read("i"), both), tmp_path / "3")] == lists.iot_merge([a, b], both).values()
    mixed = collected(st.mix(read("m")), tmp_path / "4")
    assert [r[1] for r in mixed] == list(range(22))
    assert [r[3] for r in mixed if r[2] == 0] == [float(v) for v in VALUES] and [r[3] for r in mixed if r[2] == 1] == [float(v) for v in other]
    total = collected(st.blend(read("t"), lambda x, s: (s + x,) * 2, 0.0), tmp_path / "5")
    assert total[-1][2] == sum(VALUES) + sum(other) and len(total) == 22
    assert sorted(r[2] for r in collected(st.weave(read("v")), tmp_path / "6")) == sorted(map(float, VALUES + other))
    tagged = collected(st.merge_asynch(read("g"), lambda i, x: x if i else -x), tmp_path / "7")
    assert sorted(r[3] for r in tagged) == sorted([-float(v) for v in VALUES] + [float(v) for v in other])


def test_timed_mix(spark, tmp_path):
    st.configure(spark)
    schema = SCHEMA + ", t double"
    rows_of = lambda times, start: [{"key": "k", "seq": start + i, "value": float(t), "t": t} for i, t in enumerate(times)]
    a = st.file_source(spark, files(tmp_path / "a", [rows_of([0, 1], 0), rows_of([3, 4, 8], 2)]), schema)
    b = st.file_source(spark, files(tmp_path / "b", [rows_of([2, 5], 0), rows_of([8, 9], 2)]), schema)
    assert [(r[1], r[2]) for r in collected(st.timed_mix([a, b]), tmp_path)] == [(0, 0), (1, 0), (2, 1), (5, 1), (8, 0), (9, 1)]


def test_take_while_asks_again(spark, tmp_path):
    """A head that failed is asked about again with the next micro-batch, and what follows it waits."""
    st.configure(spark)
    gate = str(tmp_path / "gate")

    def open_(v):
        return v < 3 or os.path.exists(gate)

    folder = files(tmp_path / "in", cut([1, 2, 3, 4], [4]))
    read = lambda: st.file_source(spark, folder, SCHEMA)
    out = []
    run = lambda: st.run_available(st.take_while(read(), open_), lambda b, _: out.extend(r.value for r in b.orderBy("seq").collect()), str(tmp_path / "checkpoint"))
    run()
    assert out == [1, 2]
    open(gate, "w").close()
    path = os.path.join(folder, "009.json")
    with open(path, "w") as f:
        f.write(json.dumps({"key": "k", "seq": 4, "value": 0.0}) + "\n")
    run()
    assert out == [1, 2, 3, 4, 0]


def test_late_rows(spark, tmp_path):
    st.configure(spark)
    batches = [[{"key": "k", "seq": i, "value": float(i), "t": t} for i, t in b] for b in ([(0, 10), (1, 20)], [(2, 14), (3, 15), (4, 40)], [(5, 34)])]
    read = st.file_source(spark, files(tmp_path / "in", batches), SCHEMA + ", t long")
    out = collected(st.flag_late(read, 5, "t"), tmp_path)
    assert [(r[1], r[4]) for r in out] == [(0, False), (1, False), (2, True), (3, False), (4, False), (5, True)]


def test_separate_unzip_signal(spark, tmp_path):
    st.configure(spark)
    tag = lambda name: source(spark, tmp_path, name, VALUES, [4, 6], SCHEMA + ", tag int", tag=lambda n: n % 2)
    a, b = st.separate(tag("a"), "tag", 2)
    assert [r[2] for r in collected(a, tmp_path / "1")] == VALUES[::2] and [r[2] for r in collected(b, tmp_path / "2")] == VALUES[1::2]
    pairs = tag("c").withColumn("value", F.array("value", F.col("value") * 2))
    c, d = st.unzip(pairs, 2)
    assert [r.value for r in sorted(_rows(d, tmp_path / "3"), key=lambda r: r.seq)] == [2.0 * v for v in VALUES]
    sizes = []
    st.signal(tag("e"), lambda batch, n: sizes.append((n, batch.count())), str(tmp_path / "4"))
    assert sizes == [(0, 4), (1, 6)]
    st.print_batches(tag("f"), str(tmp_path / "5"))
    with open(tmp_path / "lines.txt", "w") as f:
        f.write("x\ny\n")
    os.makedirs(tmp_path / "text")
    os.rename(tmp_path / "lines.txt", tmp_path / "text" / "lines.txt")
    assert [r.value for r in _rows(st.text_source(spark, str(tmp_path / "text")), tmp_path / "6")] == ["x", "y"]


def _rows(df, tmp):
    out = []
    st.run_available(df, lambda b, _: out.extend(b.collect()), str(tmp / "checkpoint"))
    return out


def test_rate(spark):
    out = st.rate_source(spark, 5, lambda n: n * 2)
    assert out.isStreaming and out.columns == ["seq", "ts", "value"]


def test_queue(spark, tmp_path):
    """Published, subscribed, written by a stream and read by another; batches that run again replace themselves."""
    from streamloom.sources import queue

    topic, copy = str(tmp_path / "topic"), str(tmp_path / "copy")
    queue.Publisher(topic, "x").publish(spark.createDataFrame([(1, 20), (0, 10)], "seq long, value long"))
    queue.Publisher(topic, "y", batched=True).publish(spark.createDataFrame([(0, 7), (1, 8)], "seq long, value long"))
    got = [(r["name"], r["value"]) for r in _rows(queue.subscribe(spark, topic, "long"), tmp_path / "1")]
    assert got == [("x", 10), ("x", 20), ("y", 7), ("y", 8)]
    again = queue.subscribe(spark, topic)
    again.writeStream.format("queue").option("path", copy).option("checkpointLocation", str(tmp_path / "2")).trigger(availableNow=True).start().awaitTermination()
    queue.Publisher(topic, "x").publish(spark.createDataFrame([(0, 30)], "seq long, value long"))
    queue.Publisher(topic, "x").close()
    for _ in range(2):
        again.writeStream.format("queue").option("path", copy).option("checkpointLocation", str(tmp_path / "2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(m["value"] for m in queue.Broker(copy).read(-1)) == [7, 8, 10, 20, 30]
    broker = queue.Broker(str(tmp_path / "own"))
    broker.commit([broker.stage([{"name": "a", "value": 1}])], 0)
    broker.commit([broker.stage([{"name": "a", "value": 1}])], 0)  # the same batch, run again
    assert len(list(broker.read(-1))) == 1 and broker.last() == 0


def test_queue_functions(spark, tmp_path, capsys):
    from streamloom.sources import queue

    topic = str(tmp_path / "topic")
    queue.func_to_queue(lambda s: (s * 2, s + 1), topic, "x", 4, 1)
    assert queue.drain(topic, str(tmp_path / "out")) == 4 and open(tmp_path / "out").read().split() == ["2", "4", "6", "8"]
    n = iter(range(9))
    queue.func_to_queue(lambda: next(n), str(tmp_path / "t2"), "x", 2)
    queue.drain(str(tmp_path / "t2"))
    assert capsys.readouterr().out.split() == ["0", "1"]
    rows = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "a", "3"), (3, "a", "_close"), (4, "a", "9")], "seq long, name string, value string")
    open_ = queue.open_until(rows)
    assert [r["value"] for r in open_.orderBy("seq").collect()] == ["1", "2", "3"]
    parts = queue.by_lookup(open_, lambda name: F.when(name == "a", "p").otherwise("q"), ["p", "q"])
    assert [r["value"] for r in parts["p"].orderBy("seq").collect()] == ["1", "3"] and parts["q"].count() == 1
