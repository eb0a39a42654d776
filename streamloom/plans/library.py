"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..core import OrderedStream
from ..functions import basics, graph, signal, sketches, text
from ..operators import fold as folds, lists, merge, sinks, split, windows
from ..sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Events numbered for each user, and for each event type.
E = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
T = "t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events)"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, keys=("user_id",)) -> OrderedStream:
    """Events by key, in order of time."""
    return OrderedStream.of(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", keys, "ts")


def whole(spark: SparkSession, sf_dir: str) -> OrderedStream:
    """All events as one stream: event_id is their position already."""
    return OrderedStream.of(table(spark, sf_dir, "events"), ["ts"], "value", (), "ts", seq="event_id")


def kinds(spark: SparkSession, sf_dir: str) -> list[OrderedStream]:
    """The events of each type, as a stream of positions from 0 each; the types are few."""
    all_kinds = events(spark, sf_dir, ("event_type",)).df
    names = [r[0] for r in all_kinds.select("event_type").distinct().orderBy("event_type").collect()]
    return [OrderedStream(all_kinds.filter(F.col("event_type") == n).select("seq", "ts", "event_id", "value"), ts="ts") for n in names]


def halves(spark: SparkSession, sf_dir: str) -> list[OrderedStream]:
    """All events as two streams, those of even and of odd event_id, for what takes exactly two inputs."""
    rows = table(spark, sf_dir, "events").withColumn("seq", F.floor(F.col("event_id") / 2).cast("long"))
    return [OrderedStream(rows.filter(F.col("event_id") % 2 == i).select("seq", "ts", "event_id", "value"), ts="ts") for i in (0, 1)]


#: The types as SQL: k (0, 1, …), n, ts, event_id, value; and names, a row for each.
K = f"""{T}, names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
k AS (SELECT k, n, ts, event_id, value FROM t JOIN names USING (event_type))"""
#: The halves in the same form.
H = "k AS (SELECT event_id % 2 AS k, event_id // 2 AS n, ts, event_id, value FROM events)"
#: A condition on groups of one row from each type.
WHOLE = "HAVING count(*) = (SELECT count(*) FROM names)"


def r4(c):
    return F.round(c, 4)


def micros(c):
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz") if isinstance(c, str) else c.cast("timestamp_ntz"))


# elements


@query("SELECT event_id, round(value * 2, 4) AS value FROM events")
def map_element(spark, d):
    return whole(spark, d).map(basics.multiply, 2).df.select("event_id", r4("value").alias("value"))


@query(f"WITH {E} SELECT user_id, n AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY n), 4) AS value FROM e")
def map_element_stateful(spark, d):
    """A running sum as a fold with native operators."""
    s = events(spark, d)
    return s.df.select("user_id", "seq", r4(F.sum("value").over(s.order.rowsBetween(Window.unboundedPreceding, 0))).alias("value"))


@query(f"WITH {E} SELECT user_id, n AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY n), 4) AS value FROM e")
def fold_python(spark, d):
    """The same running sum by a Python step."""
    out = folds.fold(events(spark, d), lambda x, s: (x + s, x + s), lambda: 0.0, "double")
    return out.select("user_id", "seq", r4("value").alias("value"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, value FROM events WHERE value > 100")
def filter_element(spark, d):
    out = whole(spark, d).filter(lambda v: v > 100)
    return out.df.select(F.col("event_id").alias("seq"), "value")


@query(f"WITH {E} SELECT user_id, n AS seq, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY n) AS p FROM e) WHERE p IS NULL OR value > p")
def filter_stateful(spark, d):
    """Elements over the one before."""
    s = events(spark, d)
    df = s.df.withColumn("p", F.lag("value").over(s.order)).filter("p is null or value > p")
    return df.select("user_id", "seq", "value")


@query("SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS batch, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def signal_chunk(spark, d):
    out = sinks.batch_reduce(whole(spark, d), F.date_trunc("day", "ts"), F.count("*").alias("n"), r4(F.sum("value")).alias("total"))
    return out.select(micros("batch").alias("batch"), "n", "total")


@query("SELECT count(DISTINCT date_trunc('day', ts)) AS batches FROM events")
def signal_element(spark, d):
    """One output for each batch, whatever its elements."""
    return sinks.batch_reduce(whole(spark, d), F.date_trunc("day", "ts"), F.lit(1).alias("one")).agg(F.count("*").alias("batches"))


@query("SELECT event_id, value FROM events WHERE CAST(floor(value) AS BIGINT) % 2 = 1")
def map_list(spark, d):
    """A function of whole lists."""
    s = whole(spark, d)
    s = s.like(s.df.select("event_id", F.struct("event_id", "value").alias("v")), "v")
    out = lists.map_list(s, lambda rows: [r for r in rows if int(r["value"] // 1) % 2 == 1], "struct<event_id:bigint,value:double>", 1000)
    return out.df.select("value.event_id", "value.value")


@query("SELECT event_id AS seq, round(sum(value) OVER (ORDER BY event_id), 4) AS value FROM events")
def map_list_stateful(spark, d):
    """A running sum, list after list."""

    def add(values, total):
        out = []
        for v in values:
            total += v
            out.append(total)
        return out, total

    return lists.map_list(whole(spark, d), add, "double", 1000, lambda: 0.0).df.select("seq", r4("value").alias("value"))


@query("SELECT event_id AS seq, value * 2 AS value FROM events")
def map_array(spark, d):
    return lists.map_array(whole(spark, d), lambda x: x * 2).df.select("seq", "value")


@query(f"WITH {H} SELECT n AS seq, round(sum(value), 4) AS value FROM k GROUP BY n HAVING count(*) = 2")
def merge_list(spark, d):
    return lists.merge_list(halves(spark, d), lambda xs: [a + b for a, b in zip(*xs, strict=True)], size=1000).df.select("seq", r4("value").alias("value"))


@query("""WITH s AS (SELECT *, CAST(floor(value) AS BIGINT) % 2 AS i FROM events)
SELECT CAST(i AS INTEGER) AS i, row_number() OVER (PARTITION BY i ORDER BY event_id) - 1 AS seq, value FROM s WHERE i IN (0, 1)""")
def split_list(spark, d):
    """Values with even and with odd whole parts."""
    f = lambda x: [[v for v in x if v // 1 % 2 == i] for i in (0, 1)]
    a, b = (p.df.select(F.lit(i).alias("i"), "seq", "value") for i, p in enumerate(lists.split_list(whole(spark, d), f, ["double"] * 2, 1000)))
    return a.unionAll(b)


@query(f"""WITH {H}, z AS (SELECT n, sum(value) AS s, max(value) AS m FROM k GROUP BY n HAVING count(*) = 2)
SELECT n AS seq, round(s, 4) AS total, m AS top FROM z""")
def multi_list(spark, d):
    f = lambda xs: [[a + b for a, b in zip(*xs, strict=True)], [max(a, b) for a, b in zip(*xs, strict=True)]]
    out = merge.zip_streams(lists.multi_list(halves(spark, d), f, ["double"] * 2, 1000))
    return out.select("seq", r4("v0").alias("total"), F.col("v1").alias("top"))


@query("SELECT event_id // 2 AS seq, round(sum(value), 4) AS value FROM events GROUP BY 1 HAVING count(*) = 2")
def iot(spark, d):
    """Pairs of elements; one that has no partner in its list is left unread."""
    f = lambda a: ([x + y for x, y in zip(a[::2], a[1::2], strict=False)], len(a) // 2 * 2)
    return lists.iot(whole(spark, d), f, "double", 999).df.select("seq", r4("value").alias("value"))


@query(f"WITH {K} SELECT n AS seq, round(sum(value), 4) AS value FROM k GROUP BY n {WHOLE}")
def iot_merge(spark, d):
    """What all types have comes out; the rest is left unread."""

    def f(unread):
        n = min(map(len, unread))
        return [sum(v) for v in zip(*(u[:n] for u in unread), strict=True)], [n] * len(unread)

    return lists.iot_merge(kinds(spark, d), f, size=500).df.select("seq", r4("value").alias("value"))


@query("SELECT event_id, i AS pos, round(value + 100 * i, 4) AS value FROM events, (VALUES (0), (1)) v(i)")
def multivalue(spark, d):
    """Two elements for each: v and v + 100."""
    out = whole(spark, d).map_many(lambda v: F.array(v, v + 100), renumber=False)
    return out.df.select("event_id", "pos", r4("value").alias("value"))


@query("SELECT event_id, least(value, 50.0) AS low, greatest(value, 50.0) AS high FROM events")
def min_max(spark, d):
    return split.split_columns(whole(spark, d), low=basics.at_most(F.col("value"), 50.0), high=basics.at_least(F.col("value"), 50.0))


@query("SELECT event_id, greatest(-20.0, least(20.0, value - 50)) AS value FROM events")
def clip(spark, d):
    return whole(spark, d).map(lambda v: basics.clip(v - 50, 20.0)).df.select("event_id", "value")


@query("SELECT event_id, value - 50 AS value FROM events WHERE abs(value - 50) >= 25")
def filter_min(spark, d):
    s = whole(spark, d).map(basics.subtract, 50)
    return s.filter(basics.large, 25, renumber=False).df.select("event_id", "value")


@query("SELECT event_id, round(value * 3, 4) AS mul, round(value + 3, 4) AS plus, round(value - 3, 4) AS minus FROM events")
def constants(spark, d):
    v = F.col("value")
    return split.split_columns(whole(spark, d), mul=r4(basics.multiply(v, 3)), plus=r4(basics.add(v, 3)), minus=r4(basics.subtract(v, 3)))


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS i, CAST(user_id AS DOUBLE) AS f FROM events")
def casts(spark, d):
    return split.split_columns(whole(spark, d), i=basics.to_int(F.col("value")), f=basics.to_float(F.col("user_id")))


@query("SELECT * FROM (VALUES (0, -1.0::DOUBLE), (1, -2.0::DOUBLE)) v(seq, value) UNION ALL SELECT event_id + 2, value FROM events")
def prepend(spark, d):
    return whole(spark, d).prepend([-1.0, -2.0]).df.select(F.col("event_id").alias("seq"), "value")


# count windows


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events WHERE value > 0),
w AS (SELECT user_id, n, sum(value * 2) OVER f AS s, count(*) OVER f AS c FROM p WINDOW f AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT user_id, n // 2 AS w, round(s, 4) AS value FROM w WHERE n % 2 = 0 AND c = 5""")
def map_window_sum(spark, d):
    s = OrderedStream.of(table(spark, d, "events").filter("value > 0"), ["ts", "event_id"], "value", ("user_id",)).map(basics.multiply, 2)
    return windows.window(s, 5, 2, r4(F.sum("value")).alias("value"))


def _frame(size: int, step: int, f: str, value: str = "value") -> str:
    return f"""WITH {E}, w AS (SELECT user_id, n, {f} AS s, count(*) OVER f AS c FROM e WINDOW f AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING))
SELECT user_id, n // {step} AS w, {value} FROM w WHERE n % {step} = 0 AND c = {size}"""


@query(_frame(4, 4, "sum(value) OVER f", "round(s, 4) AS value"))
def map_window_tumbling(spark, d):
    return windows.window(events(spark, d), 4, 4, r4(F.sum("value")).alias("value"))


@query(_frame(2, 5, "max(value) OVER f", "s AS value"))
def map_window_gap(spark, d):
    return windows.window(events(spark, d), 2, 5, F.max("value").alias("value"))


@query(_frame(20, 1, "sum(value) OVER f", "round(s, 4) AS value"))
def map_window_prefix(spark, d):
    """Step 1, by differences of prefix sums."""
    return windows.window_sums(events(spark, d), 20, 1, "sum").select("user_id", "w", r4("sum").alias("value"))


@query(_frame(3, 1, "max(value) OVER f", "s AS value"))
def map_window_frame(spark, d):
    return windows.window_frame(events(spark, d), 3, 1, m=F.max("value")).select("user_id", "w", F.col("m").alias("value"))


@query("""WITH w AS (SELECT event_id AS n, avg(value) OVER f AS s, count(*) OVER f AS c FROM events WINDOW f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 499 FOLLOWING))
SELECT n // 100 AS w, round(s, 4) AS value FROM w WHERE n % 100 = 0 AND c = 500""")
def map_window_unkeyed(spark, d):
    """One long stream without keys, spread by window ids."""
    return windows.window(whole(spark, d), 500, 100, r4(F.avg("value")).alias("value"))


@query(f"""WITH {E}, w AS (SELECT user_id, n // 4 AS w, max(value) AS m, count(*) AS c FROM e GROUP BY 1, 2)
SELECT user_id, w, i AS pos, m AS value FROM w, (VALUES (0), (1), (2), (3)) v(i) WHERE c = 4""")
def map_window_list(spark, d):
    return windows.window_list(events(spark, d), 4, 4, lambda a: F.transform(a, lambda x: F.array_max(a)))


@query(f"""WITH {E} SELECT user_id, (n + 1) // 3 - 1 AS w, round(s, 4) AS value FROM
(SELECT user_id, n, sum(value) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM e) WHERE (n + 1) % 3 = 0""")
def window_startup(spark, d):
    return windows.startup_window(events(spark, d), 10, 3, s=F.sum("value")).select("user_id", "w", r4("s").alias("value"))


@query(f"""WITH {E}, w AS (SELECT user_id, n // 4 AS w, sum(value) AS s, count(*) AS c FROM e GROUP BY 1, 2)
SELECT user_id, w, round(sum(s) OVER (PARTITION BY user_id ORDER BY w), 4) AS value FROM w WHERE c = 4""")
def map_window_stateful(spark, d):
    """Window sums with a running state."""
    out = windows.window(events(spark, d), 4, 4, F.sum("value").alias("s"))
    return out.select("user_id", "w", r4(F.sum("s").over(Window.partitionBy("user_id").orderBy("w"))).alias("value"))


@query(f"""WITH {E}, w AS (SELECT user_id, n // 4 AS w, sum(value) AS s FROM e GROUP BY 1, 2 HAVING count(*) = 4)
SELECT user_id, w AS seq, round(sum(s) OVER (PARTITION BY user_id ORDER BY w), 4) AS value FROM w""")
def map_window_fold(spark, d):
    """The same by a Python function of windows and a state."""
    out = windows.window_fold(events(spark, d), 4, 4, lambda x, s: (s + sum(x),) * 2, lambda: 0.0)
    return out.df.select("user_id", "seq", r4("value").alias("value"))


@query("""WITH p AS (SELECT i AS n, 7.0 AS value FROM generate_series(0, 3) g(i) UNION ALL SELECT event_id + 4, value FROM events),
w AS (SELECT n, sum(value) OVER f AS s, count(*) OVER f AS c FROM p WINDOW f AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT n // 2 AS w, round(s, 4) AS value FROM w WHERE n % 2 = 0 AND c = 4""")
def map_window_initial(spark, d):
    """Windows that begin with an initial value."""
    return windows.window(whole(spark, d), 4, 2, r4(F.sum("value")).alias("value"), initial_value=7.0)


def _long(size: int, step: int, f: str) -> str:
    return f"""WITH w AS (SELECT event_id AS n, {f}(value) OVER f AS s, count(*) OVER f AS c FROM events WINDOW f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING))
SELECT n // {step} AS w, round(s, 4) AS value FROM w WHERE n % {step} = 0 AND c = {size}"""


@query(_long(500, 1, "max"))
def reduce_window_frame(spark, d):
    """Long windows of one unkeyed stream, step 1: a row frame in buckets of positions."""
    return windows.reduce_window(whole(spark, d), 500, 1, "max").select("w", r4("value").alias("value"))


@query(_long(500, 20, "avg"))
def reduce_window_panes(spark, d):
    """Long windows by panes of 20."""
    return windows.reduce_window(whole(spark, d), 500, 20, "avg").select("w", r4("value").alias("value"))


@query(f"""WITH {E}, w AS (SELECT user_id, n // 3 AS w, sum(value) AS s, max(value) AS m, count(*) AS c FROM e GROUP BY 1, 2)
SELECT user_id, w, round(s, 4) AS total, m AS top FROM w WHERE c = 3""")
def split_window(spark, d):
    return split.split_window(events(spark, d), 3, 3, r4(F.sum("value")).alias("total"), F.max("value").alias("top"))


# time windows


def _timed(hours: int, step: int, f: str) -> str:
    return f"""WITH b AS (SELECT min(ts) AS a, max(ts) AS z FROM events),
starts AS (SELECT unnest(generate_series(time_bucket(INTERVAL '{step} hours', a) - INTERVAL '{hours} hours', z, INTERVAL '{step} hours')) AS s FROM b)
SELECT event_type, CAST(epoch_us(s) AS BIGINT) AS start, CAST(epoch_us(s + INTERVAL '{hours} hours') AS BIGINT) AS stop, {f}
FROM starts JOIN events ON ts >= s AND ts < s + INTERVAL '{hours} hours', b WHERE s + INTERVAL '{hours} hours' <= z GROUP BY event_type, s"""


def _timed_frame(df):
    return df.select("event_type", micros("start").alias("start"), micros("end").alias("stop"), "n", "total")


@query(_timed(6, 6, "count(*) AS n, round(sum(value), 4) AS total"))
def timed_window_tumbling(spark, d):
    return _timed_frame(windows.timed_window(table(spark, d, "events"), "6 hours", "6 hours", F.count("*").alias("n"), r4(F.sum("value")).alias("total"), keys=["event_type"]))


@query(_timed(6, 3, "count(*) AS n, round(sum(value), 4) AS total"))
def timed_window_sliding(spark, d):
    return _timed_frame(windows.timed_window(table(spark, d, "events"), "6 hours", "3 hours", F.count("*").alias("n"), r4(F.sum("value")).alias("total"), keys=["event_type"]))


@query(_timed(24, 24, "string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY ts, event_id) AS users"))
def timed_window_list(spark, d):
    """Ordered contents."""
    users = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "user_id"))), lambda x: x["user_id"].cast("string")), ",")
    out = windows.timed_window(table(spark, d, "events"), "24 hours", "24 hours", users.alias("users"), keys=["event_type"])
    return out.select("event_type", micros("start").alias("start"), micros("end").alias("stop"), "users")


@query("""WITH b AS (SELECT max(ts) AS z FROM events), starts AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 01:30:00', z, INTERVAL '5 hours')) AS s FROM b)
SELECT event_type, CAST(epoch_us(s) AS BIGINT) AS start, CAST(epoch_us(s + INTERVAL '12 hours') AS BIGINT) AS stop, count(*) AS n, round(sum(value), 4) AS total
FROM starts JOIN events ON ts >= s AND ts < s + INTERVAL '12 hours', b WHERE s + INTERVAL '12 hours' <= z GROUP BY event_type, s""")
def timed_window_origin(spark, d):
    """Windows that start at a given time and every five hours after it."""
    return _timed_frame(windows.timed_window(table(spark, d, "events"), "12 hours", "5 hours", F.count("*").alias("n"), r4(F.sum("value")).alias("total"), keys=["event_type"], origin="2024-01-02 01:30:00"))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL '6 hours', true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, CAST(epoch_us(max(ts) + INTERVAL '6 hours') AS BIGINT) AS stop, count(*) AS n FROM s GROUP BY user_id, s""")
def session_window(spark, d):
    """Users' sessions with gaps of less than six hours."""
    out = windows.session_window(table(spark, d, "events"), "6 hours", F.count("*").alias("n"), keys=["user_id"])
    return out.select("user_id", micros("start").alias("start"), micros("end").alias("stop"), "n")


# several inputs


@query(f"WITH {K} SELECT n AS seq, round(sum(value), 4) AS value FROM k GROUP BY n {WHOLE}")
def zip_map_add(spark, d):
    return merge.zip_map(kinds(spark, d), lambda *v: r4(sum(v))).df


@query(f"""WITH {K}, z AS (SELECT n, sum(value) AS s FROM k GROUP BY n {WHOLE}) SELECT n AS seq, round(sum(s) OVER (ORDER BY n), 4) AS value FROM z""")
def zip_map_stateful(spark, d):
    out = merge.zip_map(kinds(spark, d), lambda x, s: (s + sum(x), s + sum(x)), lambda: 0.0)
    return out.df.select("seq", r4("value").alias("value"))


@query(f"""WITH {H} SELECT a.n AS seq, round(x + y, 4) AS plus, round(x - y, 4) AS minus, round(x * y, 4) AS times, CAST(floor(x / y) AS BIGINT) AS floordiv,
round(x - y * floor(x / y), 4) AS modulo, x < y AS lt, x <= y AS le, x > y AS gt, x >= y AS ge, x = y AS eq, x <> y AS ne
FROM (SELECT n, value AS x FROM k WHERE k = 0) a JOIN (SELECT n, value - 50.5 AS y FROM k WHERE k = 1) b ON a.n = b.n""")
def zip_ops(spark, d):
    a, b = halves(spark, d)
    y = b - 50.5
    df = merge.zip_streams([a, y])
    x, z = F.col("v0"), F.col("v1")
    q = F.floor(F.try_divide(x, z))
    return df.select("seq", r4(x + z).alias("plus"), r4(x - z).alias("minus"), r4(x * z).alias("times"), q.alias("floordiv"), r4(x - z * q).alias("modulo"), (x < z).alias("lt"), (x <= z).alias("le"), (x > z).alias("gt"), (x >= z).alias("ge"), (x == z).alias("eq"), (x != z).alias("ne"))


@query(f"WITH {E} SELECT user_id, n AS seq, round(value * 2 + (value + 1) - value, 4) AS value FROM e")
def zip_same_parent(spark, d):
    """x + y - z of maps of one stream: a projection, without a join."""
    s = events(spark, d)
    return merge.zip_map([s.map(basics.multiply, 2), s.map(basics.add, 1), s], lambda a, b, c: r4(a + b - c)).df


@query(f"WITH {K} SELECT row_number() OVER (ORDER BY ts, k, n) - 1 AS seq, CAST(k AS INTEGER) AS i, value FROM k")
def mix(spark, d):
    from ..core import dense_positions

    out = dense_positions(merge.mix(kinds(spark, d)).withColumnRenamed("seq", "n"), ["ts", "i", "n"])
    return out.select("seq", "i", "value")


@query(f"WITH {K} SELECT CAST(k AS INTEGER) AS i, n AS seq, round(CASE k WHEN 0 THEN value + 273.15 ELSE value END, 4) AS value FROM k")
def merge_asynch(spark, d):
    """A branch on the stream's index."""
    out = merge.merge_asynch(kinds(spark, d), lambda i, v: r4(F.when(i == 0, v + 273.15).otherwise(v)))
    return out.select("i", "seq", "value")


@query(f"WITH {K} SELECT row_number() OVER w - 1 AS seq, round(sum(k * value) OVER w, 4) AS value FROM k WINDOW w AS (ORDER BY ts, k, n)")
def merge_asynch_stateful(spark, d):
    out = merge.merge_asynch(kinds(spark, d), lambda x, s: (s + x[0] * x[1],) * 2, initial=lambda: 0.0)
    return out.select("seq", r4("value").alias("value"))


@query(f"WITH {K} SELECT row_number() OVER w - 1 AS seq, max(value) OVER w AS value FROM k WINDOW w AS (ORDER BY ts, k, n)")
def blend_stateful(spark, d):
    """The greatest so far."""
    return merge.blend(kinds(spark, d), lambda x, s: (max(x, s),) * 2, initial=lambda: float("-inf")).select("seq", "value")


@query(f"WITH {K} SELECT CAST(epoch_us(ts) AS BIGINT) AS at, round(2 * value, 4) AS value FROM k")
def blend(spark, d):
    return merge.blend(kinds(spark, d), lambda v: r4(2 * v)).select(micros("ts").alias("at"), "value")


@query(f"WITH {K} SELECT CAST(epoch_us(ts) AS BIGINT) AS at, value FROM k")
def weave(spark, d):
    return merge.weave(kinds(spark, d)).select(micros("ts").alias("at"), "value")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders)
SELECT o_custkey, o_orderkey FROM a WHERE m IS NULL OR o_orderdate > m""")
def timed_mix(spark, d):
    """Orders as they arrive, late and tied dates dropped, for each customer."""
    return merge.timed_mix(table(spark, d, "orders"), "o_orderdate", ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"""WITH {K}, w AS (SELECT k, n // 3 AS w, sum(value) AS s FROM k GROUP BY 1, 2 HAVING count(*) = 3)
SELECT w, round(sum(s), 4) AS value FROM w GROUP BY w {WHOLE}""")
def merge_window(spark, d):
    streams = kinds(spark, d)
    out = merge.merge_window(streams, 3, 3, F.sum)
    return out.select("w", r4(sum(F.col(f"v{i}") for i in range(len(streams)))).alias("value"))


@query(f"""WITH {K}, w AS (SELECT k, n // 3 AS w, sum(value) AS s FROM k GROUP BY 1, 2 HAVING count(*) = 3), z AS (SELECT w, sum(s) AS s FROM w GROUP BY w {WHOLE})
SELECT w AS seq, round(sum(s) OVER (ORDER BY w), 4) AS value FROM z""")
def merge_window_stateful(spark, d):
    out = merge.merge_window_fold(kinds(spark, d), 3, 3, lambda x, s: (s + sum(map(sum, x)),) * 2, lambda: 0.0)
    return out.df.select("seq", r4("value").alias("value"))


@query(f"""WITH {H}, x AS (SELECT n, sum(value) OVER f AS s, count(*) OVER f AS c FROM k WHERE k = 0 WINDOW f AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT n // 2 AS w, round(s + value, 4) AS value FROM x JOIN (SELECT n AS m, value FROM k WHERE k = 1) ON m = n // 2 WHERE n % 2 = 0 AND c = 3""")
def merge_multiple_windows(spark, d):
    out = merge.merge_windows(halves(spark, d), [3, 1], [2, 1], F.sum)
    return out.select("w", r4(F.col("v0") + F.col("v1")).alias("value"))


#: The number of types in the tables, for SQL with a column for each.
TYPES = 5
_HOURS = f"""{K}, h AS (SELECT k, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour_us, round(sum(value), 4) AS v FROM k GROUP BY 1, 2),
z AS (SELECT hour_us, {', '.join(f'max(CASE k WHEN {i} THEN v END) AS v{i}' for i in range(TYPES))} FROM h
WHERE hour_us <= (SELECT min(m) FROM (SELECT max(hour_us) AS m FROM h GROUP BY k)) GROUP BY hour_us)"""


def _hours(spark, d) -> list[OrderedStream]:
    """Each type's hourly sums, by time."""
    return [OrderedStream(s.df.groupBy(micros(F.date_trunc("hour", "ts")).alias("ts")).agg(r4(F.sum("value")).alias("value")), seq="ts") for s in kinds(spark, d)]


def _hourly(spark, d) -> DataFrame:
    return merge.timed_zip(_hours(spark, d))


@query(f"WITH {_HOURS} SELECT hour_us, {', '.join(f'v{i}' for i in range(TYPES))} FROM z")
def timed_zip(spark, d):
    return _hourly(spark, d).withColumnRenamed("ts", "hour_us")


@query(f"WITH {_HOURS} SELECT hour_us, round({' + '.join(f'coalesce(v{i}, 0)' for i in range(TYPES))}, 4) AS value FROM z")
def timed_zip_map(spark, d):
    out = merge.timed_zip_map(_hours(spark, d), lambda *v: r4(sum(F.coalesce(x, F.lit(0.0)) for x in v)))
    return out.withColumnRenamed("ts", "hour_us")


@query(f"WITH {_HOURS} SELECT hour_us, {', '.join(f'v{i}' for i in range(TYPES))} FROM z")
def join_timed(spark, d):
    """The same, by a time that is got from whole items."""
    items = [OrderedStream(s.df.select("ts", F.struct(F.col("ts").alias("t"), "value").alias("value")), seq="ts") for s in _hours(spark, d)]
    out = merge.join_timed(items, lambda v: v["t"])
    return out.select(F.col("time").alias("hour_us"), *(F.col(f"v{i}.value").alias(f"v{i}") for i in range(len(items))))


@query(f"WITH {_HOURS} {' UNION ALL '.join(f'SELECT hour_us, {i} AS i, v{i} AS value FROM z WHERE v{i} IS NOT NULL' for i in range(TYPES))}")
def timed_unzip(spark, d):
    from functools import reduce

    zipped = _hourly(spark, d)
    parts = [p.select(F.col("ts").alias("hour_us"), F.lit(i).alias("i"), "value") for i, p in enumerate(split.timed_unzip(zipped, len(zipped.columns) - 1))]
    return reduce(DataFrame.unionAll, parts)


@query(f"""WITH {_HOURS}, b AS (SELECT max(hour_us) AS z FROM z), s AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-01 00:00:00', make_timestamp(z), INTERVAL '4 hours')) AS s FROM b),
c AS (SELECT s, {', '.join(f'max(CASE WHEN v{i} > 300 THEN 1 ELSE 0 END) AS c{i}' for i in range(TYPES))} FROM s JOIN z ON make_timestamp(hour_us) >= s AND make_timestamp(hour_us) < s + INTERVAL '4 hours', b
WHERE s + INTERVAL '4 hours' <= make_timestamp(z) GROUP BY s)
SELECT CAST(epoch_us(s) AS BIGINT) AS start, CAST({' + '.join(f'c{i}' for i in range(TYPES))} AS BIGINT) AS sensors FROM c WHERE {' + '.join(f'c{i}' for i in range(TYPES))} >= 2""")
def coincidences(spark, d):
    """Four hours in which two types or more have an hour of over 300; types without such hours still tell how far they have come."""
    hours = [OrderedStream(s.df.select(F.timestamp_micros("ts").alias("ts"), F.when(F.col("value") > 300, F.col("value")).alias("value")), seq="ts") for s in _hours(spark, d)]
    out = signal.coincidences(hours, "4 hours", "4 hours", 2)
    return out.select(micros("start").alias("start"), F.col("sensors").cast("long").alias("sensors"))


@query(f"WITH {K} SELECT n AS seq, max(value) AS top, round(sum(value), 4) AS total FROM k GROUP BY n {WHOLE}")
def multi_element(spark, d):
    a, b = merge.multi_element(kinds(spark, d), lambda *v: [F.greatest(*v), r4(sum(v))])
    return merge.zip_streams([a, b]).select("seq", F.col("v0").alias("top"), F.col("v1").alias("total"))


@query(f"""WITH {K}, z AS (SELECT n, sum(value) AS s, max(value) AS m FROM k GROUP BY n {WHOLE})
SELECT n AS seq, round(sum(s) OVER (ORDER BY n), 4) AS total, max(m) OVER (ORDER BY n) AS top FROM z""")
def multi_element_stateful(spark, d):
    def step(x, state):
        state = [state[0] + sum(x), max(state[1], *x)]
        return state, state

    out = merge.zip_streams(merge.multi_element(kinds(spark, d), step, lambda: [0.0, float("-inf")], ["double", "double"]))
    return out.select("seq", r4("v0").alias("total"), F.col("v1").alias("top"))


@query(f"""WITH {H}, w AS (SELECT k, n // 2 AS w, sum(value) AS s, max(value) AS m FROM k GROUP BY 1, 2 HAVING count(*) = 2)
SELECT a.w, round(a.s + b.m, 4) AS x, round(a.m + b.s, 4) AS y FROM w a JOIN w b ON a.w = b.w WHERE a.k = 0 AND b.k = 1""")
def multi_window(spark, d):
    out = merge.zip_streams(merge.multi_window(halves(spark, d), 2, 2, [F.sum, F.max], lambda s0, m0, s1, m1: [r4(s0 + m1), r4(m0 + s1)]))
    return out.select(F.col("seq").alias("w"), F.col("v0").alias("x"), F.col("v1").alias("y"))


@query("""SELECT event_id, e.user_id, c_name, n_name FROM events e LEFT JOIN customer ON c_custkey = e.user_id LEFT JOIN nation ON n_nationkey = c_nationkey""")
def lookup_join(spark, d):
    s = whole(spark, d)
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = merge.lookup(s, customers, F.col("c_custkey") == F.col("user_id")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("event_id", "user_id", "c_name", "n_name")


@query("""WITH c AS (SELECT ts AS tick FROM events WHERE event_id % 100 = 50), x AS (SELECT event_id, (SELECT min(tick) FROM c WHERE tick >= events.ts) AS tick FROM events)
SELECT event_id, CAST(epoch_us(tick) AS BIGINT) AS tick FROM x""")
def call_streams(spark, d):
    """The clock tick at which each element is read."""
    s = whole(spark, d)
    clock = s.df.filter("event_id % 100 = 50").select("ts")
    return merge.call_on_clock(s, clock).select("event_id", micros("tick").alias("tick"))


# several outputs


@query("SELECT event_id, round(value + 1, 4) AS a, round(2 * value, 4) AS b FROM events")
def split_element(spark, d):
    out = merge.zip_streams(split.split_element(whole(spark, d), lambda v: [r4(v + 1), r4(2 * v)]))
    return out.select(F.col("seq").alias("event_id"), F.col("v0").alias("a"), F.col("v1").alias("b"))


@query("""SELECT 0 AS i, row_number() OVER (ORDER BY event_id) - 1 AS seq, value FROM events WHERE value > 60
UNION ALL SELECT 1, row_number() OVER (ORDER BY event_id) - 1, value FROM events WHERE value < 40""")
def split_element_some(spark, d):
    """Outputs of which each has some elements only."""
    a, b = split.split_element(whole(spark, d), lambda v: [F.when(v > 60, v), F.when(v < 40, v)])
    return a.df.select(F.lit(0).alias("i"), F.col("event_id").alias("seq"), "value").unionAll(b.df.select(F.lit(1).alias("i"), F.col("event_id").alias("seq"), "value"))


@query(f"""WITH {E}, r AS (SELECT user_id, n, value, round(sum(value) OVER w, 4) AS s, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, 0 AS i, n AS seq, s AS value FROM r UNION ALL SELECT user_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1, value FROM r WHERE value > m""")
def split_element_stateful(spark, d):
    """Running sums, and the records."""

    def step(x, state):
        total, top = state
        return [total + x, x if x > top else None], [total + x, max(x, top)]

    a, b = split.split_element(events(spark, d), step, lambda: [0.0, -1e9], ["double", "double"])
    return a.df.select("user_id", F.lit(0).alias("i"), "seq", r4("value").alias("value")).unionAll(b.df.select("user_id", F.lit(1).alias("i"), "seq", "value"))


@query("SELECT event_id AS seq, user_id, value FROM events")
def split_tuple(spark, d):
    s = whole(spark, d)
    s = s.like(s.df.select("event_id", F.struct("user_id", "value").alias("v")), "v")
    return merge.zip_streams(split.split_tuple(s)).select("seq", F.col("v0").alias("user_id"), F.col("v1").alias("value"))


@query("""SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS batch, 0 AS i, count(*) AS value FROM events GROUP BY 1
UNION ALL SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT), 1, count(DISTINCT user_id) FROM events GROUP BY 1""")
def split_signal(spark, d):
    batches = sinks.batch_reduce(whole(spark, d), F.date_trunc("day", "ts"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    a, b = split.split_signal(batches, F.col("n"), F.col("users"))
    return a.select(micros("batch").alias("batch"), F.lit(0).alias("i"), "value").unionAll(b.select(micros("batch").alias("batch"), F.lit(1).alias("i"), "value"))


@query("SELECT row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS seq, CAST(user_id % 2 AS INTEGER) AS j, value FROM events")
def separate(spark, d):
    s = whole(spark, d)
    s = s.like(s.df.withColumn("tag", F.col("user_id") % 2))
    parts = [p.df.select(F.col("event_id").alias("seq"), F.lit(j).alias("j"), "value") for j, p in enumerate(split.separate(s, "tag", 2))]
    return parts[0].unionAll(parts[1])


@query("SELECT vec_id AS seq, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c FROM embeddings")
def unzip(spark, d):
    """Positions of an array; one past its end gives null."""
    s = OrderedStream(table(spark, d, "embeddings"), "embedding", "vec_id")
    s = s.map(lambda v: v.cast("array<double>"))
    a, b, _ = split.unzip(s, 3)
    past = s.select_value(lambda v: F.try_element_at(v, F.lit(1000)))
    return merge.zip_streams([a, b, past]).select("seq", F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"))


# folds: SQL by recursion over positions

def _recursive(start: str, step: str, out: str, table_sql: str = E, key: str = "user_id", source: str = "e") -> str:
    return f"""WITH RECURSIVE {table_sql}, r AS (SELECT {key}, n, value, {start} FROM {source} WHERE n = 0
UNION ALL SELECT {source}.{key}, {source}.n, {source}.value, {step} FROM r JOIN {source} ON {source}.{key} = r.{key} AND {source}.n = r.n + 1)
SELECT {key}, n AS seq, {out}"""


@query(_recursive("0.63 * value AS s", "0.37 * r.s + 0.63 * e.value", "round(s, 4) AS value FROM r"))
def exponential_smoothing(spark, d):
    return basics.exponential_smoothing(events(spark, d), 0.37).select("user_id", "seq", r4("value").alias("value"))


@query(_recursive("value AS s", "e.value + 0.37 * r.s", "round(s, 4) AS value FROM r"))
def make_echo(spark, d):
    return basics.make_echo(events(spark, d), 1, 0.37).select("user_id", "seq", r4("value").alias("value"))


@query("""WITH RECURSIVE r AS (SELECT event_id, value AS s FROM events WHERE event_id < 3 UNION ALL
SELECT e.event_id, e.value + 0.25 * r.s FROM r JOIN events e ON e.event_id = r.event_id + 3) SELECT event_id AS seq, round(s, 4) AS value FROM r""")
def make_echo_delayed(spark, d):
    """A delay of three elements over the whole stream."""
    s = whole(spark, d)
    return basics.make_echo(s, 3, 0.25).select("seq", r4("value").alias("value"))


@query("""WITH RECURSIVE r AS (SELECT event_id, 0.1 * value AS s FROM events WHERE event_id = 0 UNION ALL
SELECT e.event_id, 0.9 * r.s + 0.1 * e.value FROM r JOIN events e ON e.event_id = r.event_id + 1) SELECT event_id AS seq, round(s, 4) AS value FROM r""")
def affine_scan(spark, d):
    """A linear recurrence over one unkeyed stream, in chunks."""
    return folds.affine_scan(whole(spark, d), 0.9, 0.1, chunk=1 << 10).select("seq", r4("value").alias("value"))


@query(_recursive("value AS x1, value AS y, true AS k", "e.value, 0.5 * e.value + 0.3 * r.x1 + 0.2 * r.y, true", "round(y, 4) AS value FROM r").replace("value AS x1, value AS y", "value AS x1, 0.5 * value AS y"))
def iir_filter(spark, d):
    return signal.iir(events(spark, d), [0.5, 0.3], [1.0, -0.2]).select("user_id", "seq", r4("value").alias("value"))


@query(_recursive("epoch_us(ts) AS k, true AS keep", "CASE WHEN epoch_us(e.ts) - r.k >= 7200000000 THEN epoch_us(e.ts) ELSE r.k END, epoch_us(e.ts) - r.k >= 7200000000", "CAST(k AS BIGINT) AS at FROM r WHERE keep"))
def quench(spark, d):
    """Events two hours or more after the last kept one."""
    s = events(spark, d)
    s = s.like(s.df.withColumn("t", micros("ts").cast("double")))
    return signal.quench(s, "t", 7.2e9).select("user_id", "seq", F.col("value").cast("long").alias("at"))


@query(_recursive("CASE WHEN value > 60 THEN n ELSE -1000 END AS k, value > 60 AS keep", "CASE WHEN e.value > 60 AND e.n - r.k >= 5 THEN e.n ELSE r.k END, e.value > 60 AND e.n - r.k >= 5", "k AS at FROM r WHERE keep"))
def quenched_crossing(spark, d):
    return signal.quenched_crossings(events(spark, d), 60.0, 5).select("user_id", "seq", F.col("value").cast("long").alias("at"))


@query(_recursive("value AS s", "e.value + 0.37 * r.s", "round(s, 4) AS value FROM r"))
def smooth_and_add(spark, d):
    return basics.smooth_and_add(events(spark, d), 0.37).select("user_id", "seq", r4("value").alias("value"))


@query(_recursive("value AS s", "0.63 * r.s + 0.37 * e.value", "round(s, 4) AS value FROM r"))
def seeded_smoothing(spark, d):
    return basics.seeded_smoothing(events(spark, d), 0.37).select("user_id", "seq", r4("value").alias("value"))


@query(_recursive("value AS h1, 0.0::DOUBLE AS h2, 0.0::DOUBLE AS h3", "e.value + 0.4 * r.h1 + 0.2 * r.h2 + 0.1 * r.h3, r.h1, r.h2", "round(h1, 4) AS value FROM r"))
def multi_echo(spark, d):
    """An echo after one element, and one of two attenuations after two."""
    return basics.multi_echo(events(spark, d), [(1, [0.4]), (2, [0.2, 0.1])]).select("user_id", "seq", r4("value").alias("value"))


_PICKS = f"""{E}, b AS (SELECT user_id, n // 2 AS w, avg(value) AS x, max(epoch_us(ts)) / 1e6 AS t FROM e GROUP BY 1, 2 HAVING count(*) = 2),
m AS (SELECT user_id, w, t, CASE WHEN w < 1 THEN 0 ELSE x - avg(x) OVER (PARTITION BY user_id ORDER BY w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS v FROM b),
p AS (SELECT user_id, t, v, row_number() OVER (PARTITION BY user_id ORDER BY w) AS i FROM m WHERE abs(v) > 8)"""


@query(f"""WITH RECURSIVE {_PICKS}, r AS (SELECT user_id, i, t, v, t > 36000 AS keep, CASE WHEN t > 36000 THEN t ELSE 0 END AS last FROM p WHERE i = 1
UNION ALL SELECT p.user_id, p.i, p.t, p.v, p.t > 36000 + r.last, CASE WHEN p.t > 36000 + r.last THEN p.t ELSE r.last END FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i + 1)
SELECT user_id, CAST(round(t * 1e6, 0) AS BIGINT) AS t, round(v, 4) AS value FROM r WHERE keep""")
def pick_orientation(spark, d):
    """Blocks of two, less their running mean, over 8, ten hours apart."""
    s = events(spark, d)
    s = s.like(s.df.withColumn("t", micros("ts") / 1e6))
    out = signal.pick_orientation(s, "t", threshold=8.0, pause=36000.0)
    return out.df.select("user_id", F.round(F.col("value.t") * 1e6, 0).cast("long").alias("t"), r4("value.value").alias("value"))


_READINGS = f"""{E}, b AS (SELECT user_id, n // 2 AS w, avg(value * 0.5) AS x, max(epoch_us(ts)) / 1e6 AS t FROM e GROUP BY 1, 2 HAVING count(*) = 2)"""


@query(f"""WITH RECURSIVE {_READINGS}, r AS (SELECT user_id, w, x, t, t - 0 <= 1.7e9 + 7.2e4 AS keep, CASE WHEN t > 1.7e9 + 7.2e4 THEN t ELSE 0 END AS last FROM b WHERE w = 0
UNION ALL SELECT b.user_id, b.w, b.x, b.t, b.t - r.last <= 1.7e9 + 7.2e4, CASE WHEN b.t - r.last > 1.7e9 + 7.2e4 THEN b.t ELSE r.last END FROM r JOIN b ON b.user_id = r.user_id AND b.w = r.w + 1)
SELECT user_id, round(x, 4) AS x, CAST(round(t * 1e6, 0) AS BIGINT) AS t FROM r WHERE keep""")
def sensor_reader(spark, d):
    """Averaged readings, thinned by the clock."""
    s = events(spark, d)
    s = s.like(s.df.withColumns({"t": micros("ts") / 1e6, "x": F.col("value")}))
    out = signal.sensor_reader(s, {"x": 0.5}, "t", 2, 1.7e9 + 7.2e4)
    return out.df.select("user_id", r4("value.x").alias("x"), F.round(F.col("value.t") * 1e6, 0).cast("long").alias("t"))


@query("SELECT seq, value FROM (SELECT event_id, value FROM events) JOIN (SELECT k AS seq, CAST(round_even(k * 1.5, 0) AS BIGINT) AS place FROM (SELECT unnest(generate_series(0, (SELECT max(event_id) FROM events))) AS k)) ON place = event_id")
def speed(spark, d):
    """One and a half times as fast."""
    return signal.speed(whole(spark, d), 1.5).df.select("seq", "value")


@query()
def detect_anomaly(spark, d):
    """A state machine whose consumption jumps: no SQL; tested on a fixture."""
    return signal.detect_anomaly(events(spark, d), 10, 4, 3, 1.5).select("user_id", "seq", r4("value").alias("value"))


@query()
def misra_gries(spark, d):
    s = events(spark, d, ("event_type",))
    return sketches.misra_gries(s.like(s.df.withColumn("u", F.col("user_id").cast("string")), "u"), 8)


@query()
def k_means_windows(spark, d):
    s = events(spark, d)
    s = s.like(s.df.withColumn("hour", F.hour("ts").cast("double")))
    return signal.k_means_windows(s, ["value", "hour"], 20, 10, 2).select("user_id", "seq", F.transform("value", lambda x: F.round(x, 4)).alias("value"))


@query()
def principal_axes(spark, d):
    s = events(spark, d)
    s = s.like(s.df.withColumn("hour", F.hour("ts").cast("double")))
    return signal.principal_axis_windows(s, ["value", "hour"], 20).select("user_id", "seq", r4("value").alias("value"))


@query()
def phase_vocoder(spark, d):
    return signal.stretch(events(spark, d, ("event_type",)), 2.0, 64, 16).select("event_type", "seq", r4("value").alias("value"))


@query("""WITH n AS (SELECT event_id + 2 AS p FROM events)
SELECT row_number() OVER (ORDER BY p) - 1 AS seq, p AS value FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.p * m.p <= n.p AND n.p % m.p = 0)""")
def sieve(spark, d):
    s = OrderedStream(table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") + 2).alias("value")))
    return basics.sieve(s).df.select("seq", "value")


# signal and anomaly functions


@query(f"""WITH {E} SELECT user_id, n AS seq, round(value - m, 4) AS value FROM (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM e) WHERE n >= 4""")
def subtract_mean(spark, d):
    return signal.subtract_mean(events(spark, d), 5).select("user_id", "seq", r4("value").alias("value"))


@query(f"""WITH {E}, w AS (SELECT user_id, n // 4 AS w, avg(value) AS m, count(*) AS c FROM e GROUP BY 1, 2)
SELECT user_id, w, CAST(n % 4 AS INTEGER) AS pos, round(value - m, 4) AS value FROM e JOIN (SELECT user_id AS u, w, m FROM w WHERE c = 4) ON u = user_id AND w = n // 4 WHERE n % 4 < 2""")
def subtract_mean_block(spark, d):
    """The first two elements of each window of four, less its mean."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    out = windows.window_list(events(spark, d), 4, 4, lambda a: F.transform(F.slice(a, 1, 2), lambda x: x - mean(a)))
    return out.select("user_id", "w", "pos", r4("value").alias("value"))


@query("SELECT event_id, round(2 * value * value - 3 * value + 1, 4) AS value FROM events")
def polynomial(spark, d):
    return whole(spark, d).map(lambda v: r4(signal.polynomial(v, [2, -3, 1]))).df.select("event_id", "value")


@query(f"WITH {K} SELECT n AS seq, round(sqrt(sum(value * value)), 4) AS value FROM k GROUP BY n {WHOLE}")
def magnitude(spark, d):
    return merge.zip_map(kinds(spark, d), lambda *v: r4(signal.magnitude(*v))).df


@query(f"WITH {E} SELECT user_id, n AS w, round(2 * value + 100 * b, 4) AS value FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY n) AS b FROM e) WHERE b IS NOT NULL")
def window_dot(spark, d):
    return signal.window_dot(events(spark, d), [2, 100]).select("user_id", "w", r4("value").alias("value"))


@query("""SELECT event_id AS w, round(avg(value) OVER f, 4) AS value FROM events WINDOW f AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 200 FOLLOWING)
QUALIFY count(*) OVER f = 201""")
def fir_filter(spark, d):
    """201 equal taps over one unkeyed stream."""
    return signal.fir(whole(spark, d), [1 / 201] * 201).select("w", r4("value").alias("value"))


@query(f"WITH {E} SELECT user_id, n AS seq, abs(value) AS value FROM e WHERE abs(value) > 60")
def threshold_crossing(spark, d):
    return signal.crossings(events(spark, d), 60.0)


@query(f"""WITH {E}, w AS (SELECT user_id, n, avg(abs(value)) OVER f AS l, avg(abs(value)) OVER g AS s, count(*) OVER f AS c FROM e
WINDOW f AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), g AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING))
SELECT user_id, n // 5 AS w, round(s, 4) AS sta, round(l, 4) AS lta FROM w WHERE n % 5 = 0 AND c = 10""")
def sta_lta(spark, d):
    return signal.short_over_long(events(spark, d), 10, 3, 5, 1.5).select("user_id", "w", r4("sta").alias("sta"), r4("lta").alias("lta"))


@query(f"""WITH {E}, w AS (SELECT user_id, n, avg(value) OVER h AS m, stddev_samp(value) OVER h AS sd, avg(value) OVER g AS r, count(*) OVER f AS c FROM e
WINDOW f AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), h AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING),
g AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING))
SELECT user_id, n // 5 AS w, abs(r - m) > sd AS anomaly FROM w WHERE n % 5 = 0 AND c = 10""")
def k_sigma(spark, d):
    return signal.k_sigma(events(spark, d), 10, 3, 5, 1.0)


@query(f"""WITH {K}, w AS (SELECT k, n // 10 AS w, bool_or(value > 60) AS a, count(*) AS c FROM k GROUP BY 1, 2)
SELECT w, count(*) FILTER (a) > 1 AS anomaly FROM w WHERE c = 10 GROUP BY w {WHOLE}""")
def regional_anomaly(spark, d):
    """Windows in which more than one of the streams has an anomaly."""
    streams = [s.map(lambda v: v > 60) for s in kinds(spark, d)]
    out = merge.merge_window(streams, 10, 10, F.bool_or)
    return out.select("w", (sum(F.col(f"v{i}").cast("int") for i in range(len(streams))) > 1).alias("anomaly"))


@query(f"""WITH {E}, w AS (SELECT user_id, n // 4 AS w, avg(value) AS m, count(*) AS c FROM e GROUP BY 1, 2), g AS (SELECT user_id, w, m, greatest(0, max(m) OVER (PARTITION BY user_id ORDER BY w)) - m AS g FROM w WHERE c = 4)
SELECT user_id, w, round(CASE WHEN g < 5 THEN 0 ELSE g END, 4) AS value FROM g""")
def deviation_from_max(spark, d):
    return signal.running_max_deviation(events(spark, d), 4, 5.0).select("user_id", "w", r4("value").alias("value"))


@query("SELECT event_id // 10 AS w, round(avg(value), 4) AS value FROM events GROUP BY 1 HAVING count(*) = 10")
def decimate(spark, d):
    return signal.decimate(whole(spark, d), 10).select("w", r4("value").alias("value"))


@query("""SELECT i AS seq, round(3 * sin(2 * pi() * i / 50), 4) + 0.0 AS sine, round(3 * cos(2 * pi() * i / 50), 4) + 0.0 AS cosine,
CAST(CASE WHEN sin(2 * pi() * (i + 0.5) / 50) >= 0 THEN 3 ELSE -3 END AS DOUBLE) AS square FROM generate_series(0, 9999) g(i)""")
def waves(spark, d):
    """Ten thousand samples of each wave; the square wave half a sample on."""
    a, b = (signal.wave(spark, kind, 1.0, 3.0, 50.0, 10_000) for kind in ("sine", "cosine"))
    c = signal.wave(spark, "square", 1.0, 3.0, 50.0, 10_000, 0.5)
    return merge.zip_streams([a, b, c]).select("seq", (r4("v0") + 0.0).alias("sine"), (r4("v1") + 0.0).alias("cosine"), F.col("v2").alias("square"))


@query(f"WITH {K} SELECT n AS seq, list_sort(list(value))[(count(*) + 1) // 2] AS value FROM k GROUP BY n {WHOLE}")
def median_streams(spark, d):
    return merge.zip_map(kinds(spark, d), lambda *v: F.array_sort(F.array(*v))[(len(v) - 1) // 2]).df


def _next_vectors(spark, d) -> list[OrderedStream]:
    """Vectors, and those after them."""
    base = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return [OrderedStream(base, "embedding", "vec_id"), OrderedStream(base.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"), "embedding", "vec_id")]


def _vectors(f: str) -> str:
    """Sums, differences and products of two single-precision numbers are exact in double precision."""
    return f"SELECT a.vec_id AS seq, list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) {f} CAST(x[2] AS DOUBLE)) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(_vectors("+"))
def array_add(spark, d):
    return merge.zip_map(_next_vectors(spark, d), basics.to_array_sum).df


@query(_vectors("-"))
def array_subtract(spark, d):
    return merge.zip_map(_next_vectors(spark, d), basics.to_array_difference).df


@query(_vectors("*"))
def array_multiply(spark, d):
    return merge.zip_map(_next_vectors(spark, d), basics.to_array_product).df


@query("""WITH v AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, generate_series(1, 64) g(i))
SELECT vec_id AS seq, CAST(i - 1 AS INTEGER) AS pos, round(x - avg(x) OVER (PARTITION BY i ORDER BY vec_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS value FROM v QUALIFY vec_id >= 3""")
def array_subtract_mean(spark, d):
    """Each coordinate less its mean over the last four vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    return signal.subtract_mean(OrderedStream(rows, "value", "vec_id", ("pos",)), 4).filter("seq >= 3").select("seq", "pos", r4("value").alias("value"))


@query("SELECT round(avg(value), 4) AS mean, round(median(value), 4) AS median, mode(event_type) AS mode FROM events")
def stats(spark, d):
    return table(spark, d, "events").agg(r4(F.avg("value")).alias("mean"), r4(F.median("value")).alias("median"), F.mode("event_type", True).alias("mode"))


# sketches, text, lookups


_COMMANDS = "c AS (SELECT event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'add' ELSE 'check' END AS cmd, user_id % 500 AS key FROM events)"


def _commands(spark, d):
    cmd = F.when(F.col("event_type").isin("click", "purchase"), "add").otherwise("check")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), cmd.alias("cmd"), (F.col("user_id") % 500).alias("key"))


@query(f"WITH {_COMMANDS} SELECT seq, key, EXISTS (SELECT 1 FROM c a WHERE a.cmd = 'add' AND a.key = c.key AND a.seq < c.seq) AS found FROM c WHERE cmd = 'check'")
def bloom_protocol(spark, d):
    return sketches.members(_commands(spark, d))


@query(f"WITH {_COMMANDS}, r AS (SELECT *, count(*) FILTER (cmd = 'add') OVER (PARTITION BY key ORDER BY seq) AS n FROM c) SELECT seq, key, n FROM r WHERE cmd = 'check'")
def count_protocol(spark, d):
    return sketches.counts(_commands(spark, d))


@query(f"WITH {_COMMANDS} SELECT seq, key, EXISTS (SELECT 1 FROM c a WHERE a.cmd = 'add' AND a.key = c.key AND a.seq < c.seq) AS found FROM c WHERE cmd = 'check'")
def bloom_filter(spark, d):
    """By a Bloom filter, large enough to be exact for these keys."""
    return sketches.approximate_members(_commands(spark, d), 24)


@query(f"WITH {_COMMANDS}, r AS (SELECT *, count(*) FILTER (cmd = 'add') OVER (PARTITION BY key ORDER BY seq) AS n FROM c) SELECT seq, key, n FROM r WHERE cmd = 'check'")
def count_min_sketch(spark, d):
    """By a count-min sketch, large enough to be exact for these keys."""
    return sketches.approximate_counts(_commands(spark, d), 20)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 0.0001 * (SELECT count(*) FROM lineitem)")
def heavy_hitters(spark, d):
    return sketches.heavy_hitters(table(spark, d, "lineitem"), "l_suppkey", 0.0001)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_projection(spark, d):
    out = text.json_fields(table(spark, d, "events"), "props", k="$.k")
    return out.select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT doc_id FROM documents WHERE (contains(text, 'License') OR contains(text, 'rights')) AND NOT contains(text, 'MIT')")
def phrase_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(text.has_phrase(F.col("text"), ["License", "rights"], ["MIT"])).select("doc_id")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, round((len(list_filter(w, lambda x: x IN ('good', 'the'))) - len(list_filter(w, lambda x: x IN ('bad', 'of'))))::DOUBLE / nullif(len(w), 0), 4) AS score FROM w""")
def sentiment(spark, d):
    score = text.word_score(F.col("text"), ["good", "the"], ["bad", "of"])
    return table(spark, d, "conversations").select("conv_id", "turn", r4(score.cast("double")).alias("score"))


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 5")
def latest_n(spark, d):
    return whole(spark, d).latest(5).select("event_id", "value")


@query("SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events")
def bounds(spark, d):
    return whole(spark, d).bounds()


@query("SELECT event_id, value FROM events WHERE event_id >= 9000")
def contents_after(spark, d):
    return whole(spark, d).after(9000).select("event_id", "value")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def contents_after_time(spark, d):
    return whole(spark, d).after_value("ts", F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("event_id")


@query("SELECT coalesce(min(event_id), -1) AS \"index\" FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def index_of_time(spark, d):
    return whole(spark, d).index_of("ts", F.to_timestamp(F.lit("2024-01-15 00:00:00")))


@query(f"WITH {E}, s AS (SELECT user_id, min(n) AS stop FROM e WHERE NOT value < 80 GROUP BY 1) SELECT user_id, n AS seq, value FROM e LEFT JOIN s USING (user_id) WHERE stop IS NULL OR n < stop")
def sink_conditional(spark, d):
    return sinks.take_while(events(spark, d), lambda v: v < 80).select("user_id", "seq", "value")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS seq FROM orders")
def distributed_sort(spark, d):
    from ..core import dense_positions

    return dense_positions(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


_LEGS = "legs AS (SELECT n_nationkey AS i, n_regionkey AS r, (n_nationkey * 7 + 3) % 25 AS j, n_nationkey % 5 + 1 AS d FROM nation)"


@query(f"""WITH RECURSIVE {_LEGS}, p AS (SELECT i, j, d, 1 AS k FROM legs UNION ALL SELECT p.i, legs.j, p.d + legs.d, p.k + 1 FROM p JOIN legs ON p.j = legs.i WHERE p.k < 25)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(min(d) AS BIGINT) AS d FROM p GROUP BY 1, 2""")
def shortest_paths(spark, d):
    n = F.col("n_nationkey").cast("long")
    legs = table(spark, d, "nation").select(n.alias("i"), ((n * 7 + 3) % 25).alias("j"), (n % 5 + 1).alias("d"))
    return graph.shortest_paths(legs)


_MESSAGES = """m AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS followers, CASE WHEN event_id % 5 = 0 THEN event_id END AS retweets FROM events)"""


@query(f"WITH {_MESSAGES} SELECT event_id AS seq, event_type AS text, coalesce(followers, 0) AS followers, coalesce(retweets, 0) AS retweets FROM m JOIN events USING (event_id)")
def judged_messages(spark, d):
    """Followers, retweets and clean text of JSON messages."""
    user = F.when(F.col("event_id") % 3 == 0, F.struct(F.col("user_id").alias("followers_count")))
    passed = F.when(F.col("event_id") % 5 == 0, F.struct(F.col("event_id").alias("retweet_count")))
    words = F.concat(F.lit("RT "), F.col("event_type"), F.lit(" http://a.b/c"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.to_json(F.struct(words.alias("text"), user.alias("user"), passed.alias("retweeted_status"))).alias("value"))
    return text.judged_messages(rows, ["click"], ["error"]).select("seq", "text", "followers", "retweets")


@query("""WITH c AS (SELECT ts, user_id % 10 AS g, event_id AS c FROM events WHERE event_type = 'click'), x AS (SELECT event_id, user_id % 10 AS g, ts FROM events WHERE event_type <> 'click')
SELECT event_id, c FROM x ASOF LEFT JOIN (SELECT g, ts, max(c) AS c FROM c GROUP BY g, ts) c ON x.g = c.g AND x.ts >= c.ts""")
def as_of(spark, d):
    """Each event with the last click before it in its group."""
    rows = table(spark, d, "events").withColumn("g", F.col("user_id") % 10)
    clicks = rows.filter("event_type = 'click'").groupBy("g", "ts").agg(F.max("event_id").alias("c"))
    s = OrderedStream(rows.filter("event_type <> 'click'"), seq="event_id", keys=["g"])
    return merge.as_of(s, clicks, ["c"]).select("event_id", "c")


@query(f"WITH {E} SELECT user_id, n AS seq, value FROM e WHERE n < 3")
def first_n(spark, d):
    return basics.first_n(events(spark, d), 3).select("user_id", "seq", "value")


@query(f"WITH {K} SELECT n AS seq, list(value ORDER BY k) AS value FROM k GROUP BY n {WHOLE}")
def append_items(spark, d):
    return basics.append_items(kinds(spark, d)).df


@query("SELECT event_id, value FROM events")
def copy_stream(spark, d):
    return whole(spark, d).copy().df.select("event_id", "value")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM events")
def stream_to_file(spark, d):
    """Written as lines, and read again in order."""
    path = _folder(spark)
    files.to_text(whole(spark, d).map(lambda v: F.floor(v)), path)
    return files.text_lines(spark, path).df.select("seq", "value")


@query("SELECT event_id, value FROM events")
def stream_to_json(spark, d):
    """Written as JSON lines, made CSV, and read again."""
    path = _folder(spark)
    s = whole(spark, d)
    files.to_json(s.like(s.df.select("event_id", "value")), f"{path}/json")
    files.json_to_csv(spark, f"{path}/json", f"{path}/csv", "event_id long, value double")
    return spark.read.schema("event_id long, value double").option("header", True).csv(f"{path}/csv")


def _folder(spark) -> str:
    """A new folder that goes when the application ends."""
    import uuid

    from ..core import delete_at_end, shared_dir

    path = f"{shared_dir(spark)}/streamloom/files-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def _program():
    """A network: a source is scaled, then split into what is over and under 100, which are counted by another process."""
    from ..runtime import Network, Process

    net = Network().source("values", "d")
    net.add(Process("scale", {"x": "d"}, {"y": "d"}, lambda i: {"y": i["x"].map(basics.multiply, 2)}))
    net.add(Process("split", {"x": "d"}, {"high": "d", "low": "d"}, lambda i: dict(zip(["high", "low"], split.split_element(i["x"], lambda v: [F.when(v > 100, v), F.when(v <= 100, v)]), strict=True))))
    net.add(Process("join", {"a": "d", "b": "d"}, {"sum": "d"}, lambda i: {"sum": i["a"] + i["b"]}))
    return net.connect("values", "values", "scale", "x").connect("scale", "y", "split", "x").connect("split", "high", "join", "a").connect("split", "low", "join", "b")


@query("""WITH y AS (SELECT event_id, value * 2 AS v FROM events), a AS (SELECT v, row_number() OVER (ORDER BY event_id) - 1 AS n FROM y WHERE v > 100),
b AS (SELECT v, row_number() OVER (ORDER BY event_id) - 1 AS n FROM y WHERE v <= 100) SELECT a.n AS seq, round(a.v + b.v, 4) AS value FROM a JOIN b ON a.n = b.n""")
def network(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), "value")
    return _program().run({"values": OrderedStream(rows)})["join"]["sum"].df.select("seq", r4("value").alias("value"))
