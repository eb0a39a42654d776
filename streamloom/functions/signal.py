"""Signal, anomaly and clustering functions over ordered streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..core import OrderedStream
from ..operators import merge
from ..operators.fold import NO_VALUE, Many, fold
from ..operators.windows import timed_window, window, window_python


def polynomial(v: Column, coefficients: Sequence[float]) -> Column:
    """Highest power first, by Horner's rule."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * v + c
    return out


def magnitude(*axes: Column) -> Column:
    return F.sqrt(sum(a * a for a in axes))


def subtract_mean(stream: OrderedStream, size: int) -> DataFrame:
    """keys, seq and value: the last element of every window less the window's mean."""
    keys = list(stream.keys)
    rows = stream.df if keys else stream.halo(0, size - 1, max(1 << 16, 4 * size))
    frame = Window.partitionBy(*(keys or ["__b"])).orderBy(stream.seq).rowsBetween(-(size - 1), 0)
    df = rows.withColumn("__m", F.avg(stream.value).over(frame)).filter(stream.n >= size - 1)
    df = df if keys else df.filter("__own")
    return df.select(*keys, F.col(stream.seq).alias("seq"), (stream.v - F.col("__m")).alias("value"))


def window_dot(stream: OrderedStream, weights: Sequence[float]) -> DataFrame:
    """keys, w, value: the dot product of each window of len(weights) elements; short filters."""
    keys = list(stream.keys)
    rows = stream.df if keys else stream.halo(len(weights) - 1, 0, max(1 << 16, 4 * len(weights)))
    order = Window.partitionBy(*(keys or ["__b"])).orderBy(stream.seq)
    total = sum(F.lead(stream.value, i).over(order) * float(c) for i, c in enumerate(weights))
    df = rows.withColumn("__t", total)
    df = df if keys else df.filter("__own")
    return df.filter(F.col("__t").isNotNull()).select(*keys, F.col(stream.seq).alias("w"), F.col("__t").alias("value"))


def fir(stream: OrderedStream, taps: Sequence[float]) -> DataFrame:
    """The same for long filters, on arrays of a bucket of positions; taps apply newest first."""
    reverse = np.asarray(taps, float)[::-1]
    return window_python(stream, len(reverse), 1, lambda x: float(x @ reverse), "double")


def fir_band_pass(low: float, high: float, rate: float, taps: int) -> np.ndarray:
    """Coefficients of a windowed-sinc band-pass with a Hamming window."""
    n = np.arange(taps) - (taps - 1) / 2
    ideal = 2 * high / rate * np.sinc(2 * high / rate * n) - 2 * low / rate * np.sinc(2 * low / rate * n)
    h = ideal * np.hamming(taps)
    centre = (low + high) / 2
    return h / abs(np.sum(h * np.exp(-2j * np.pi * centre / rate * n)))


def butterworth_band_pass(low: float, high: float, rate: float, order: int = 2) -> tuple[list[float], list[float]]:
    """b and a of a digital Butterworth band-pass, for iir(): the analogue poles of the unit low-pass, moved to
    the band and mapped by the bilinear transform."""
    lower, upper = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    centre, width = np.sqrt(lower * upper), upper - lower
    unit = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = unit * width / 2
    poles = np.concatenate((half + np.sqrt(half**2 - centre**2 + 0j), half - np.sqrt(half**2 - centre**2 + 0j)))
    digital = (2 * rate + poles) / (2 * rate - poles)
    zeros = np.concatenate((np.ones(order), -np.ones(order)))
    a, b = np.poly(digital).real, np.poly(zeros).real
    at = np.exp(-2j * np.arctan(centre / (2 * rate)) * np.arange(len(a)))
    return (b * abs(np.sum(a * at) / np.sum(b * at))).tolist(), a.tolist()


def iir(stream: OrderedStream, b: Sequence[float], a: Sequence[float]) -> DataFrame:
    """y[n] = (sum of b[i] * x[n-i] less sum of a[i] * y[n-i], i > 0) / a[0]."""
    b, a = [float(x) for x in b], [float(x) for x in a]

    def step(x, state):
        xs, ys = state
        xs = ([x] + xs)[: len(b)]
        y = (sum(c * v for c, v in zip(b, xs, strict=False)) - sum(c * v for c, v in zip(a[1:], ys, strict=False))) / a[0]
        return y, (xs, ([y] + ys)[: max(0, len(a) - 1)])

    return fold(stream, step, lambda: ([], []), "double")


def quench(stream: OrderedStream, time: str, pause: float, strict: bool = False, last: float | None = None) -> DataFrame:
    """Elements at least (strict: more than) pause after the last one that was kept; the first is kept, or
    comes after last, if that is given."""

    def step(t, before):
        far = before is None or (t - before > pause if strict else t - before >= pause)
        return (t, t) if far else (NO_VALUE, before)

    return fold(stream, step, lambda: last, "double", [time])


def crossings(stream: OrderedStream, threshold: float) -> DataFrame:
    """Positions and magnitudes of elements over the threshold."""
    return stream.df.filter(F.abs(stream.value) > threshold).select(*stream.keys, F.col(stream.seq).alias("seq"), F.abs(stream.value).alias("value"))


def quenched_crossings(stream: OrderedStream, threshold: float, pause: int) -> DataFrame:
    """Positions of crossings at least pause elements after the last that was kept."""
    found = OrderedStream(crossings(stream, threshold).withColumn("at", F.col("seq").cast("double")), "at", "seq", stream.keys)
    return quench(found, "at", pause)


def short_over_long(stream: OrderedStream, size: int, short: int, step: int, ratio: float) -> DataFrame:
    """keys, w, sta, lta, anomaly: the mean magnitude of a window's last elements over that of all."""
    recent = stream.df.withColumn("__a", F.abs(stream.value))
    part = OrderedStream(recent, "__a", stream.seq, stream.keys)
    last = F.slice(F.transform(F.array_sort(F.collect_list(F.struct(stream.seq, "__a"))), lambda x: x["__a"]), size - short + 1, short)
    total = F.aggregate(last, F.lit(0.0), lambda s, x: s + x)
    out = window(part, size, step, F.avg("__a").alias("lta"), (total / short).alias("sta"))
    return out.withColumn("anomaly", F.col("sta") > ratio * F.col("lta"))


def k_sigma(stream: OrderedStream, size: int, recent: int, step: int, k: float) -> DataFrame:
    """keys, w, anomaly: whether the last elements' mean is k sample deviations from the first ones'."""
    place = OrderedStream(stream.df, stream.value, stream.seq, stream.keys)
    values = F.transform(F.array_sort(F.collect_list(F.struct(stream.seq, stream.value))), lambda x: x[stream.value])
    out = window(place, size, step, values.alias("x"))
    head, tail = F.slice("x", 1, size - recent), F.slice("x", size - recent + 1, recent)
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    out = out.withColumn("m", mean(head, size - recent)).withColumn("r", mean(tail, recent))
    spread = F.sqrt(F.aggregate(F.transform(head, lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda s, x: s + x) / (size - recent - 1))
    return out.select(*stream.keys, "w", (F.abs(F.col("r") - F.col("m")) > k * spread).alias("anomaly"))


def detect_anomaly(stream: OrderedStream, size: int, part: int, cloned: int, factor: float) -> DataFrame:
    """keys, seq, value: the elements after anomalies, in order and numbered densely.

    A window whose last part elements' mean is over factor deviations from that of its first part is an
    anomaly: all but its last part is dropped, and the next cloned elements go out, once they are all
    there; the search goes on after them.  Other windows move by one.
    """

    def step(x, state):
        buffer, found = [*state[0], x], state[1]
        out = Many()
        while len(buffer) >= (cloned if found else size):
            if found:
                out += buffer[:cloned]
                buffer, found = buffer[cloned:], False
                continue
            head, tail = np.asarray(buffer[:part]), np.asarray(buffer[size - part : size])
            found = bool(abs(tail.mean() - head.mean()) > factor * head.std())
            buffer = buffer[size - part if found else 1 :]
        return out, (buffer, found)

    return fold(stream, step, lambda: ([], False), "double", renumber=True)


def coincidences(streams: Sequence[OrderedStream], duration: str, step: str, least: int, time: str = "ts") -> DataFrame:
    """start, end, sensors: the time windows in which at least least of the streams have an element (k of n).

    Streams are zipped by time first, so windows close when every stream has come that far.
    """
    zipped = merge.timed_zip(streams, time)
    some = [F.max(F.col(f"v{i}").isNotNull().cast("int")) for i in range(len(streams))]
    found = timed_window(zipped, duration, step, sum(some).alias("sensors"), time=time, keys=streams[0].keys)
    return found.filter(F.col("sensors") >= least)


def aggregate_anomalies(zipped: OrderedStream, time: str, count: int, duration: float, least: int, step: float = 1.0) -> DataFrame:
    """keys, seq, value: mean times of anomalies that at least least of count streams share.

    zipped is the timed_zip of the streams, v0, v1, … (null: no anomaly), by a numeric time.  Windows of
    duration begin every step; within one, streams with an anomaly are remembered, from window to window,
    until there are enough of them: the mean of the window's first time and the one at hand goes out,
    unless it is that of the last output, and all are forgotten.
    """
    names = [f"v{i}" for i in range(count)]

    def judge(rows, state):
        seen, latest = state
        first = rows[0][0]
        for t, *values in rows:
            seen = [s or v is not None for s, v in zip(seen, values, strict=True)]
            if sum(seen) >= least:
                at, seen = (first + t) / 2, [False] * count
                if at != latest:
                    return at, (seen, at)
        return NO_VALUE, (seen, latest)

    def one(x, state):
        start, rows, rest = state
        out, t = Many(), x[0]
        rows = [*rows, x]
        while t >= start + duration:
            own = [r for r in rows if start <= r[0] < start + duration]
            if own:
                y, rest = judge(own, rest)
                out += [] if y is NO_VALUE else [y]
            start += step
            rows = [r for r in rows if r[0] >= start]
            if rows and rows[0][0] >= start + duration:  # empty windows are passed over
                start += step * max(0, int((rows[0][0] - duration - start) // step))
        return out, (start, rows, rest)

    return fold(zipped, one, lambda: (0.0, [], ([False] * count, -1.0)), "double", [time, *names], renumber=True)


def pick_orientation(stream: OrderedStream, time: str, decimation: int = 2, count: int = 2, threshold: float = 0.5, pause: float = 2.0) -> OrderedStream:
    """Picks of one axis: struct values (t, value).

    Blocks of decimation are averaged, and keep the time of their last element; each is taken less the mean of
    the last count of them (the first count - 1 give 0); magnitudes over threshold that are more than pause
    after the last pick (from time 0) are picks.
    """
    keys = list(stream.keys)
    last = F.max_by(time, stream.seq)
    blocks = window(stream, decimation, decimation, F.avg(stream.value).alias("__x"), last.alias("t"))
    frame = Window.partitionBy(*keys).orderBy("w").rowsBetween(-(count - 1), 0)
    if not keys:
        spread = OrderedStream(blocks, "__x", "w").halo(0, count - 1)
        frame = Window.partitionBy("__b").orderBy("w").rowsBetween(-(count - 1), 0)
        blocks = spread
    value = F.when(F.col("w") < count - 1, 0.0).otherwise(F.col("__x") - F.avg("__x").over(frame))
    blocks = blocks.withColumn("value", value)
    blocks = blocks if keys else blocks.filter("__own")
    large = blocks.filter(F.abs("value") > threshold).select(*keys, F.col("w").alias("seq"), F.col("t").cast("double").alias("t"), "value")

    def step(x, before):
        t, v = x
        return ({"t": t, "value": v}, t) if t > pause + before else (NO_VALUE, before)

    return OrderedStream(fold(OrderedStream(large, keys=keys), step, lambda: 0.0, "struct<t:double,value:double>", ["t", "value"], renumber=True), keys=keys)


def picker(stream: OrderedStream, axes: dict[str, float], time: str, **settings) -> dict[str, OrderedStream]:
    """pick_orientation of several columns, each times its scale (negative to turn an axis round)."""
    return {name: pick_orientation(OrderedStream(stream.df.withColumn("__axis", F.col(name) * scale), "__axis", stream.seq, stream.keys), time, **settings) for name, scale in axes.items()}


def sensor_reader(stream: OrderedStream, axes: dict[str, float], time: str, decimation: int, interval: float) -> OrderedStream:
    """Readings of a sensor: the columns axes, scaled and averaged over blocks of decimation, with the time of a
    block's last element, kept where that is at most interval after the last reading that wasn't; the
    others only set the clock (which starts at 0)."""
    blocks = window(stream, decimation, decimation, *(F.avg(F.col(c) * scale).alias(c) for c, scale in axes.items()), F.max_by(time, stream.seq).cast("double").alias("t"))

    def step(x, before):
        t = x[-1]
        return (NO_VALUE, t) if t - before > interval else (dict(zip([*axes, "t"], x, strict=True)), before)

    kind = "struct<" + ",".join(f"{c}:double" for c in [*axes, "t"]) + ">"
    return OrderedStream(fold(OrderedStream(blocks, "t", "w", stream.keys), step, lambda: 0.0, kind, [*axes, "t"], renumber=True), keys=stream.keys)


def running_max_deviation(stream: OrderedStream, size: int, threshold: float) -> DataFrame:
    """Tumbling means less the greatest so far (at least 0), 0 where under the threshold."""
    means = window(stream, size, size, F.avg(stream.value).alias("m"))
    so_far = F.greatest(F.lit(0.0), F.max("m").over(Window.partitionBy(*stream.keys).orderBy("w")))
    gap = so_far - F.col("m")
    return means.select(*stream.keys, "w", F.when(gap < threshold, F.lit(0.0)).otherwise(gap).alias("value"))


def decimate(stream: OrderedStream, block: int) -> DataFrame:
    return window(stream, block, block, F.avg(stream.value).alias("value"))


def wave(spark, kind: str, frequency: float, amplitude: float, rate: float, count: int, shift: float = 0.0) -> OrderedStream:
    """sine, cosine or square; shift: samples that it is ahead."""
    angle = 2 * np.pi * frequency * (F.col("seq") + shift) / rate
    f = {"sine": F.sin(angle), "cosine": F.cos(angle), "square": F.when(F.sin(angle) >= 0, 1.0).otherwise(-1.0)}[kind]
    return OrderedStream(spark.range(count).select(F.col("id").alias("seq"), (amplitude * f).alias("value")))


def k_means_windows(stream: OrderedStream, columns: Sequence[str], size: int, step: int, k: int, rounds: int = 10) -> DataFrame:
    """keys, seq (of a window's last element), value: the window's centroids, each window starting from the last's."""

    def one(x, state):
        buffer, skip, centres = state
        if skip:
            return NO_VALUE, (buffer, skip - 1, centres)
        buffer = [*buffer, x]
        if len(buffer) < size:
            return NO_VALUE, (buffer, 0, centres)
        points = np.asarray(buffer, float)
        centres = points[:k].copy() if centres is None else centres
        for _ in range(rounds):
            near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.asarray([points[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        return centres.ravel().tolist(), (buffer[step:], max(0, step - size), centres)

    return fold(stream, one, lambda: ([], 0, None), "array<double>", list(columns))


def principal_axis_windows(stream: OrderedStream, columns: Sequence[str], size: int) -> DataFrame:
    """keys, seq, value: the share of variance on the first axis after each tumbling window, over all rows so
    far; moments of windows are merged, so no window is kept."""

    def one(x, state):
        buffer, (n, mean, scatter) = state
        buffer = [*buffer, x]
        if len(buffer) < size:
            return NO_VALUE, (buffer, (n, mean, scatter))
        points = np.asarray(buffer, float)
        m, own = points.mean(axis=0), len(points)
        s = (points - m).T @ (points - m)
        gap = m - mean if n else np.zeros_like(m)
        scatter = s if not n else scatter + s + np.outer(gap, gap) * n * own / (n + own)
        mean = m if not n else mean + gap * own / (n + own)
        values = np.linalg.eigvalsh(scatter)
        return float(values[-1] / values.sum()) if values.sum() else 0.0, ([], (n + own, mean, scatter))

    return fold(stream, one, lambda: ([], (0, 0.0, 0.0)), "double", list(columns))


def _frames(x: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)


def stretch(stream: OrderedStream, factor: float, size: int, hop: int, chunk: int = 1 << 16) -> DataFrame:
    """keys, seq, value: a phase vocoder, the stream played at 1 / factor of its speed at the same pitch.

    Output frames of size samples stand hop samples apart; frame k is read at k * hop / factor.  Its
    spectrum keeps its magnitudes, and each frequency's phase goes on from the frame before by what the
    input's phase does in hop samples; frames are read and added under Hann windows that overlap to 1.

    Phases add up along the stream.  So frames are dealt in chunks of about chunk output samples: one pass
    finds each chunk's whole phase advance, a running sum over chunks (a row of frequencies each) gives where
    they begin, and a second pass adds up the frames, each chunk with the frames that reach into it.
    """
    import pandas as pd

    if not (size > 0 and hop > 0 and size % hop == 0 and size // hop >= 3 and factor > 0):
        raise ValueError("size is a multiple of hop, three times or more, and factor is positive")
    keys = list(stream.keys)
    per = max(1, chunk // hop)  # frames of a chunk
    lap = size // hop
    read = lambda k: np.floor(np.asarray(k) * hop / factor).astype(np.int64)
    kinds = "".join(f"`{k}` {stream.df.schema[k].dataType.simpleString()}, " for k in keys)
    rows = stream.df.select(*keys, stream.n.alias("__n"), stream.v.cast("double").alias("__v"))
    length = rows.groupBy(*keys).agg(F.max("__n").alias("__end"))
    rows = rows.join(length, keys) if keys else rows.crossJoin(F.broadcast(length))  # one row
    # Sample n is read by frames k with k * hop / factor - 1 < n < k * hop / factor + size + hop, in chunks of per frames
    # that also have the lap frames before them.
    low = F.floor((F.col("__n") - size - hop) * factor / hop / per)
    high = F.floor(((F.col("__n") + 2) * factor / hop + lap + 1) / per)
    rows = rows.withColumn("__c", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.greatest(high, F.lit(0)).cast("long"))))
    window_ = np.hanning(size + 1)[:-1]
    weight = (window_**2).reshape(lap, hop).sum(axis=0).mean()

    def spectra(group, first: int, stop: int):
        """Frames first to stop (as far as the input has them): spectra, and phase advances to each."""
        group = group.sort_values("__n")
        n0, x, end = int(group["__n"].iloc[0]), group["__v"].to_numpy(), int(group["__end"].iloc[0])
        k = np.arange(first, stop)
        k = k[read(k) + size + hop <= end + 1]
        if not len(k):
            return k, None, None
        at = read(k) - n0
        frames = _frames(x, size)
        now, later = (np.fft.rfft(frames[at + d] * window_, axis=1) for d in (0, hop))
        return k, later, np.angle(later) - np.angle(now)

    def advance(group: pd.DataFrame) -> pd.DataFrame:
        c = int(group["__c"].iloc[0])
        k, _, turn = spectra(group, c * per, (c + 1) * per)
        out = pd.DataFrame({"__c": [c], "__turn": [(turn.sum(axis=0) if len(k) else np.zeros(size // 2 + 1)).tolist()]})
        for i, name in enumerate(keys):
            out.insert(i, name, group[name].iloc[0])
        return out

    turns = rows.groupBy(*keys, "__c").applyInPandas(advance, f"{kinds}__c long, __turn array<double>")

    def before(x, total):
        c, turn = x
        total = np.zeros(len(turn)) if total is None else total
        after = (total + np.asarray(turn)) % (2 * np.pi)
        return {"c": c, "phase": total.tolist()}, after

    starts = fold(OrderedStream(turns, "__turn", "__c", keys), before, lambda: None, "struct<c:bigint,phase:array<double>>", ["__c", "__turn"])
    starts = starts.select(*keys, F.col("value.c").alias("__c"), F.col("value.phase").alias("__phase"))

    def add(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*keys, "seq", "value"])
        c = int(left["__c"].iloc[0])
        first = max(0, c * per - lap + 1)
        k, spectrum, turn = spectra(left, first, (c + 1) * per)
        if not len(k) or k[-1] < c * per:
            return pd.DataFrame(columns=[*keys, "seq", "value"])
        # The phase at chunk c's beginning is known; frames before it go back from there.
        phase = np.cumsum(turn, axis=0)
        zero = c * per - first
        phase += np.asarray(right["__phase"].iloc[0]) - (phase[zero - 1] if zero else 0)
        made = np.fft.irfft(np.abs(spectrum) * np.exp(1j * phase), size, axis=1) * window_ / weight
        out = np.zeros((len(k) + lap - 1) * hop)
        for j in range(lap):
            out[j * hop : (j + len(k)) * hop] += made[:, j * hop : (j + 1) * hop].ravel()
        seq = np.arange(len(out)) + first * hop
        last = not read([k[-1] + 1])[0] + size + hop <= int(left["__end"].iloc[0]) + 1
        own = (seq >= c * per * hop) & ((seq < (c + 1) * per * hop) | (last & (k[-1] // per == c)))
        done = pd.DataFrame({"seq": seq[own], "value": out[own]})
        for i, name in enumerate(keys):
            done.insert(i, name, left[name].iloc[0])
        return done

    both = rows.groupBy(*keys, "__c").cogroup(starts.groupBy(*keys, "__c"))
    return both.applyInPandas(add, f"{kinds}seq long, value double")


def speed(stream: OrderedStream, factor: float) -> OrderedStream:
    """The stream played factor times as fast: output k is the input at k * factor, rounded to the nearest even
    where it is between two; each sample finds its outputs, so nothing is gathered."""
    n, f = stream.n, F.lit(float(factor))
    low, high = F.floor((n - 0.5) / f), F.ceil((n + 0.5) / f)  # with a margin for rounding
    outs = F.filter(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.greatest(high, F.lit(0)).cast("long")), lambda k: F.bround(k * f, 0) == n)
    rows = stream.df.select(*stream.keys, F.explode(outs).alias("seq"), stream.v.alias("value"))
    return OrderedStream(rows, keys=stream.keys)


def pitch_shift(stream: OrderedStream, semitones: float, size: int = 1 << 13, hop: int = 1 << 11) -> OrderedStream:
    """The same speed at another pitch: stretched, less the first frame, then played as much faster."""
    factor = 2 ** (semitones / 12)
    long = stretch(stream, factor, size, hop).filter(F.col("seq") >= size).withColumn("seq", F.col("seq") - size)
    return speed(OrderedStream(long, keys=stream.keys), factor)


def shimmer(stream: OrderedStream, delay: int, attenuation: float, semitones: float = 12, size: int = 1 << 13, hop: int = 1 << 11, rounds: int = 1) -> OrderedStream:
    """The stream plus echoes of what is heard, each shifted in pitch: rounds times heard = input + delayed(shift(heard))."""
    heard = stream
    for _ in range(rounds):
        echo = pitch_shift(heard, semitones, size, hop).df.select(*stream.keys, (F.col("seq") + delay).alias("seq"), (F.col("value") * attenuation).alias("echo"))
        own = stream.df.select(*stream.keys, stream.n.alias("seq"), stream.v.alias("own"))
        both = own.join(echo, [*stream.keys, "seq"], "left")
        heard = OrderedStream(both.select(*stream.keys, "seq", (F.col("own") + F.coalesce("echo", F.lit(0.0))).alias("value")), keys=stream.keys)
    return heard
