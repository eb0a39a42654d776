"""Functions and sources against plain loops over the same data."""

import math
import random
import sqlite3
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.core import OrderedStream
from streamloom.functions import basics, signal, sketches, text
from streamloom.operators import merge
from streamloom.sources import files


def floats(spark, values):
    return OrderedStream.from_list(spark, [float(v) for v in values], "double")


def column(df, name="value", order="seq"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def noise(n, seed=1):
    rng = random.Random(seed)
    return [round(rng.gauss(0, 1) + (8 if rng.random() < 0.03 else 0), 3) for _ in range(n)]


def test_detect_anomaly(spark):
    """A window slides until its ends differ; then the elements after its start part go out whole, or wait."""
    for seed, (size, part, cloned, factor) in enumerate([(6, 3, 4, 2.0), (10, 2, 15, 3.0), (5, 2, 1, 1.0)]):
        x, at, out = noise(400, seed), 0, []
        found = False
        while at + (cloned if found else size) <= len(x):
            if found:
                out += x[at : at + cloned]
                at, found = at + cloned, False
                continue
            w = np.array(x[at : at + size])
            found = abs(w[-part:].mean() - w[:part].mean()) > factor * w[:part].std()
            at += size - part if found else 1
        got = signal.detect_anomaly(floats(spark, x), size, part, cloned, factor)
        assert out and column(got) == out and column(got, "seq") == list(range(len(out)))


def test_misra_gries(spark):
    import json

    rng = random.Random(2)
    x = rng.choices("abcdefg", [8, 5, 3, 1, 1, 1, 1], k=300)
    got = [json.loads(v) for v in column(sketches.misra_gries(OrderedStream.from_list(spark, x, "string"), 4))]
    for n in range(len(x)):
        counts = {c: x[: n + 1].count(c) for c in set(x[: n + 1])}
        assert len(got[n]) <= 3
        for c, exact in counts.items():  # the sketch's guarantee, after every element
            assert exact - (n + 1) / 4 <= got[n].get(c, 0) <= exact


def test_k_means_windows(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.2, (30, 2)), rng.normal(5, 0.2, (30, 2))])[rng.permutation(60)]
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "seq long, x double, y double")
    got = signal.k_means_windows(OrderedStream(rows, "x"), ["x", "y"], 20, 10, 2).orderBy("seq").collect()
    assert [r.seq for r in got] == [19, 29, 39, 49, 59]
    for r in got:
        centres = np.array(r.value).reshape(2, 2)
        own = points[r.seq - 19 : r.seq + 1]
        near = ((own[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for i in range(2):  # centres of their own points, one at each cluster
            assert np.allclose(own[near == i].mean(axis=0), centres[i], atol=1e-6)
        assert sorted(np.round(centres.mean(axis=1))) == [0, 5]


def test_principal_axes(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (60, 2)) @ np.array([[3, 1], [0, 0.5]])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "seq long, x double, y double")
    got = signal.principal_axis_windows(OrderedStream(rows, "x"), ["x", "y"], 20).orderBy("seq").collect()
    for r in got:
        values = np.linalg.eigvalsh(np.cov(points[: r.seq + 1].T))
        assert abs(r.value - values[-1] / values.sum()) < 1e-9
    assert [r.seq for r in got] == [19, 39, 59]


def vocoder(x, factor, size, hop):
    """The phase vocoder, frame by frame."""
    window = np.hanning(size + 1)[:-1]
    weight = (window**2).reshape(-1, hop).sum(axis=0).mean()
    frames, phase = [], 0
    k = 0
    while math.floor(k * hop / factor) + size + hop <= len(x):
        at = math.floor(k * hop / factor)
        now, later = (np.fft.rfft(window * x[at + d : at + d + size]) for d in (0, hop))
        phase = phase + np.angle(later) - np.angle(now)
        frames.append(np.fft.irfft(np.abs(later) * np.exp(1j * phase), size) * window / weight)
        k += 1
    out = np.zeros((len(frames) - 1) * hop + size)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + size] += f
    return out


@pytest.mark.parametrize("factor", [2.0, 0.5, 1.3])
def test_stretch(spark, factor):
    x = np.sin(np.arange(900) * 0.21) + 0.3 * np.sin(np.arange(900) * 0.57)
    want = vocoder(x, factor, 64, 16)
    for chunk in (1 << 16, 200, 64):
        got = signal.stretch(floats(spark, x), factor, 64, 16, chunk).orderBy("seq").collect()
        assert [r.seq for r in got] == list(range(len(want)))
        assert np.allclose([r.value for r in got], want, atol=1e-6)
    # The pitch stays: the strongest frequency is the input's.
    spectrum = np.abs(np.fft.rfft(want[200:-200] * np.hanning(len(want) - 400)))
    assert abs(spectrum.argmax() * 2 * np.pi / (len(want) - 400) - 0.21) < 0.03
    with pytest.raises(ValueError):
        signal.stretch(floats(spark, x), 1.0, 64, 20)


def test_speed_and_pitch(spark):
    x = [math.sin(i * 0.1) for i in range(1200)]
    for factor in (1.5, 0.7, 2.0):
        want = [x[round(k * factor)] for k in range(2000) if round(k * factor) < len(x)]
        assert signal.speed(floats(spark, x), factor).values() == want
    high = np.array(signal.pitch_shift(floats(spark, x), 12, 128, 32).values())
    spectrum = np.abs(np.fft.rfft(high[100:900] * np.hanning(800)))
    assert abs(spectrum.argmax() * 2 * np.pi / 800 - 0.2) < 0.02  # an octave up
    heard = signal.shimmer(floats(spark, x), 50, 0.5, 12, 128, 32).values()
    assert heard[:50] == x[:50] and len(heard) == len(x) and np.allclose(heard[50:850], np.array(x[50:850]) + 0.5 * high[:800])


def test_butterworth(spark):
    b, a = signal.butterworth_band_pass(1.0, 5.0, 50.0, 2)
    # The coefficients of this filter, order 2, 1 to 5 Hz at 50 samples a second.
    assert len(b) == len(a) == 5 and a[0] == pytest.approx(1) and b[1] == pytest.approx(0) and b[2] == pytest.approx(-2 * b[0])
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 50)) / np.polyval(a, np.exp(2j * np.pi * f / 50)))
    assert gain(1.0) == pytest.approx(math.sqrt(0.5)) and gain(5.0) == pytest.approx(math.sqrt(0.5)) and gain(0.05) < 0.01 and gain(20) < 0.05
    assert max(gain(f) for f in np.arange(0.5, 20, 0.1)) <= 1 + 1e-9
    x = noise(120)
    y = []
    for n in range(len(x)):
        y.append((sum(b[i] * x[n - i] for i in range(5) if n >= i) - sum(a[i] * y[n - i] for i in range(1, 5) if n >= i)) / a[0])
    assert np.allclose(column(signal.iir(floats(spark, x), b, a)), y)


def test_fir(spark):
    taps = signal.fir_band_pass(1.0, 5.0, 50.0, 101)
    gain = lambda f: abs(np.sum(taps * np.exp(-2j * np.pi * f / 50 * np.arange(101))))
    assert gain(3.0) == pytest.approx(1, abs=0.02) and gain(12) < 0.02 and gain(0) < 0.05
    x = noise(300)
    got = column(signal.fir(floats(spark, x), taps), order="w")
    assert np.allclose(got, [np.dot(x[k : k + 101], taps[::-1]) for k in range(200)])


def test_smoothing_and_echoes(spark):
    x = noise(60)
    s = floats(spark, x)
    y, z, heard = [], [], []
    for n, v in enumerate(x):
        y.append(v if not y else 0.7 * y[-1] + 0.3 * v)
        z.append(v + (0.3 * z[-1] if z else 0))
        heard.append(v + sum(c * heard[n - d] for d, c in ((2, 0.5), (3, 0.25), (7, 0.1)) if n >= d))
    assert np.allclose(column(basics.seeded_smoothing(s, 0.3)), y) and np.allclose(column(basics.smooth_and_add(s, 0.3)), z)
    assert np.allclose(column(basics.multi_echo(s, [(2, [0.5, 0.25]), (7, [0.1])])), heard)
    with pytest.raises(ValueError):
        basics.multi_echo(s, [(0, [1.0])])


def test_quench(spark):
    times = [0, 1, 2, 3, 5, 6, 9]
    rows = OrderedStream(spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "seq long, t double"), "t")
    assert column(signal.quench(rows, "t", 2)) == [0, 2, 5, 9]
    assert column(signal.quench(rows, "t", 2, strict=True, last=0.0)) == [3, 6, 9]


def test_anomalies_of_several_sensors(spark):
    rng = random.Random(5)
    sensors = [sorted(rng.sample(range(200), 30)) for _ in range(3)]
    streams = [OrderedStream(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ts)], "seq long, ts long, value double")) for ts in sensors]
    end = min(max(ts) for ts in sensors)
    rows = [(t, [1.0 if t in ts else None for ts in sensors]) for t in sorted(set().union(*sensors)) if t <= end]
    zipped = merge.timed_zip(streams).withColumn("seq", F.col("ts"))
    got = column(signal.aggregate_anomalies(OrderedStream(zipped, "v0"), "ts", 3, 6.0, 2))
    # Window by window: sensors are remembered until two have been seen.
    want, seen, latest, start = [], [False] * 3, -1.0, 0
    while start + 6 <= rows[-1][0]:
        own = [r for r in rows if start <= r[0] < start + 6]
        for t, values in own:
            seen = [a or b is not None for a, b in zip(seen, values, strict=True)]
            if sum(seen) >= 2:
                at, seen = (own[0][0] + t) / 2, [False] * 3
                if at != latest:
                    want.append(at)
                    latest = at
                    break
        start += 1
    assert want and got == want
    stamped = [OrderedStream(s.df.withColumn("ts", F.timestamp_seconds("ts"))) for s in streams]
    found = {int(r["start"].timestamp()): r.sensors for r in signal.coincidences(stamped, "10 seconds", "10 seconds", 2).collect()}
    counts = {k: sum(any(k <= t < k + 10 and t <= end for t in ts) for ts in sensors) for k in range(0, end - 9, 10)}
    assert found == {k: n for k, n in counts.items() if n >= 2}


def test_picker(spark):
    rng = random.Random(6)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), i * 0.25) for i in range(200)]
    stream = OrderedStream(spark.createDataFrame(rows, "seq long, n double, e double, t double"), "n")
    found = signal.picker(stream, {"n": 1 / 3, "e": -1 / 3}, "t")
    for axis, scale, place in (("n", 1 / 3, 1), ("e", -1 / 3, 2)):
        blocks = [((rows[k][place] + rows[k + 1][place]) * scale / 2, rows[k + 1][3]) for k in range(0, 200, 2)]
        want, last = [], 0
        for k, (v, t) in enumerate(blocks):
            x = 0 if k == 0 else v - (v + blocks[k - 1][0]) / 2
            if abs(x) > 0.5 and t > 2 + last:
                want.append((t, pytest.approx(x)))
                last = t
        assert want or axis
        assert [(r["t"], r["value"]) for r in found[axis].values()] == want


def test_sketches_are_one_sided(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["add", "check"]), f"k{rng.randrange(300)}") for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, cmd string, key string")
    exact = {r.seq: r.found for r in sketches.members(df).collect()}
    rough = {r.seq: r.found for r in sketches.approximate_members(df, 9, 2).collect()}
    assert exact.keys() == rough.keys() and all(rough[k] or not exact[k] for k in exact) and rough != exact
    counts = {r.seq: r.n for r in sketches.counts(df).collect()}
    over = {r.seq: r.n for r in sketches.approximate_counts(df, 6, 2).collect()}
    assert counts.keys() == over.keys() and all(over[k] >= counts[k] for k in counts) and over != counts


def test_sieve(spark):
    s = OrderedStream(spark.range(2, 3000).select((F.col("id") - 2).alias("seq"), F.col("id").alias("value")))
    assert basics.sieve(s).values() == [n for n in range(2, 3000) if all(n % d for d in range(2, math.isqrt(n) + 1))]


def test_messages(spark, tmp_path):
    rows = ['{"text": "RT good news http://x.y/z", "lang": "en", "user": {"followers_count": 7}, "retweeted_status": {"retweet_count": 3}}', '{"text": "bad", "lang": "de"}', '{"text": "other", "lang": "en", "user": {}}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(rows))
    found = files.messages(spark, str(tmp_path / "in"), ["Good", "other"], "en")
    df = found.withColumn("seq", F.monotonically_increasing_id())
    out = sorted(tuple(r)[1:] for r in text.judged_messages(df, ["good"], ["bad"]).collect())
    assert out == [("good news", 0.5, 7, 3), ("other", 0.0, 0, 0)]
    assert files.messages(spark, str(tmp_path / "in")).count() == 3


def test_files(spark, tmp_path):
    path = str(tmp_path / "lines")
    files.to_text(floats(spark, [1.5, 2.0, -3.0]), path)
    assert files.float_lines(spark, path).values() == [1.5, 2.0, -3.0]
    (tmp_path / "ints.txt").write_text("4\n 5\nx\n6")  # the last line has no end
    assert files.int_lines(spark, str(tmp_path / "ints.txt")).values() == [4, 5, None, 6]
    total = files.parsed_lines(spark, str(tmp_path / "ints.txt"), lambda line, s: (len(line) + s, s + 1), lambda: 0, "long")
    assert total.values() == [1, 3, 3, 4]
    files.to_json(floats(spark, [1, 2]), str(tmp_path / "json"))
    files.json_to_csv(spark, str(tmp_path / "json"), str(tmp_path / "csv"), "seq long, value double")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("0", "1.0"), ("1", "2.0")]
    assert files.from_function(spark, lambda n: n * n, 4).values() == [0, 1, 4, 9]
    assert files.from_steps(spark, lambda s: (s * 2, s + 1), 3, 2, lambda: 1, "long").values() == [2, 4, 6, 8, 10, 12]
    parts = files.by_name(spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "_close")], "name string, value string"), ["a", "b"])
    assert [p.count() for p in parts] == [1, 1]


def test_sounds_arrays_and_databases(spark, tmp_path):
    samples = np.array([0, 100, -100, 32767, -32768, 5], "<i2")
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.stack([samples, np.zeros(6, "<i2")], axis=1).tobytes())
    s = files.wave_files(spark, str(tmp_path / "x.wav"))
    assert s.values() == samples.tolist() and s.keys == ("file",)
    np.save(tmp_path / "x.npy", np.array([1.5, 2.5]))
    assert files.array_files(spark, str(tmp_path / "x.npy")).values() == [1.5, 2.5]
    path = str(tmp_path / "x.db")
    connection = sqlite3.connect(path)
    connection.execute("create table sensors (id integer, place text)")
    connection.executemany("insert into sensors values (?, ?)", [(i, f"p{i}") for i in range(5)])
    connection.commit()
    connection.close()
    table = files.sqlite_table(spark, path, "select id, place from sensors where id > 1", "id long, place string")
    readings = OrderedStream(spark.createDataFrame([(0, 3), (1, 9)], "seq long, value long"))
    assert [(r.seq, r.place) for r in merge.lookup(readings, table, F.col("value") == F.col("id")).orderBy("seq").collect()] == [(0, "p3"), (1, None)]


def test_partition_sink(spark, tmp_path):
    from streamloom.operators import split

    rows = OrderedStream(spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "seq long, tag int, value double"))
    split.partition_sink(rows, "tag", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out" / "tag=0")).collect()) == [1.0, 3.0]


def test_timed_window_origin(spark):
    df = spark.createDataFrame([(t,) for t in (1, 3, 8, 13, 14, 21, 40)], "t long").withColumn("ts", F.timestamp_seconds("t"))
    from streamloom.operators import windows

    out = windows.timed_window(df, "5 seconds", "5 seconds", F.count("*").alias("n"), origin="1970-01-01 00:00:02")
    assert sorted((int(r["start"].timestamp()), r.n) for r in out.collect()) == [(2, 1), (7, 1), (12, 2), (17, 1)]
    out = windows.timed_window(df, "6 seconds", "4 seconds", F.collect_list("t").alias("n"), origin="1970-01-01 00:00:03")
    found = {int(r["start"].timestamp()): sorted(r.n) for r in out.collect()}
    assert found == {s: [t for t in (1, 3, 8, 13, 14, 21, 40) if s <= t < s + 6] for s in range(3, 35, 4) if any(s <= t < s + 6 for t in (3, 8, 13, 14, 21, 40)) and s + 6 <= 40}
    nothing = windows.timed_window(df, "5 seconds", "5 seconds", F.max(F.when(F.col("t") > 100, F.col("t"))).alias("n"))
    assert nothing.count() == 0  # windows without a value don't come out
