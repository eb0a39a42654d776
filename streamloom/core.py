"""Ordered streams: DataFrames whose rows have a dense position, for the whole or for each key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Positions of one bucket when an unkeyed stream is numbered again or windowed; a task holds one bucket.
BUCKET = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster, whose machines would each
    write to a folder of their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="streamloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete path when the application ends; until then plans may read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that it is computed once and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/streamloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_positions(df: DataFrame, order: Sequence[str], name: str = "seq", keys: Sequence[str] = ()) -> DataFrame:
    """Number the rows of df from 0 in the given order, for each key if there are keys, without gathering the
    rows, or a key's rows, in one task.

    Rows are sorted by ranges of keys and order; the counts of the partitions (of each key in them), a
    number each, give their first positions.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = cut(ranged.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("__p", *keys).agg(F.count("*").alias("n"), F.min("__m").alias("__f"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", *keys, (before - F.col("__f")).alias("__s"))
    if not keys:
        return ranged.join(F.broadcast(starts), "__p").withColumn(name, F.col("__m") + F.col("__s")).drop("__p", "__m", "__s")
    return with_rows(ranged, starts, ["__p"], keys).withColumn(name, F.col("__m") + F.col("__s")).drop("__p", "__m", "__s")


def with_rows(left: DataFrame, right: DataFrame, on: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """left's rows with right's other columns, by columns that aren't null and by keys, of which null is one."""
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed({**named, **{c: f"__on{i}" for i, c in enumerate(on)}})
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()] + [F.col(c) == F.col(f"__on{i}") for i, c in enumerate(on)]
    return left.join(right, same).drop(*named.values(), *(f"__on{i}" for i in range(len(on))))


class OrderedStream:
    """A DataFrame with a position column seq (from 0, dense for each key), values, and perhaps event times.

    keys take the place of one stream object for each sensor or user.  Operators return new streams and
    only declare the plan.  root has the ancestor rows and expr the value as an expression over them: two
    streams of one root have the same rows and positions, so zipping them is a projection and no join.
    """

    def __init__(self, df: DataFrame, value: str = "value", seq: str = "seq", keys: Sequence[str] = (), ts: str | None = None, root: DataFrame | None = None, expr: Column | None = None):
        self.df, self.value, self.seq, self.keys, self.ts = df, value, seq, tuple(keys), ts
        self.root, self.expr = (df, F.col(value)) if root is None else (root, expr)

    # construction

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str], value: str = "value", keys: Sequence[str] = (), ts: str | None = None, seq: str | None = None, spread: bool = False) -> OrderedStream:
        """A stream of df's rows in the given order; seq names a column that already is the position.

        A key's rows are numbered by one task; with spread, by ranges, whatever share of all rows a key has.
        """
        if seq:
            return cls(df, value, seq, keys, ts)
        if keys and spread:
            return cls(dense_positions(df, order, keys=keys), value, "seq", keys, ts)
        if keys:
            return cls(df.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1), value, "seq", keys, ts)
        return cls(dense_positions(df, order), value, "seq", (), ts)

    @classmethod
    def from_list(cls, spark: SparkSession, values: Sequence, kind: str, keep_none: bool = False) -> OrderedStream:
        """A stream of Python values; None is dropped unless keep_none."""
        rows = [v for v in values if keep_none or v is not None]
        return cls(spark.createDataFrame(list(enumerate(rows)), f"seq long, value {kind}"))

    def like(self, df: DataFrame, value: str | None = None) -> OrderedStream:
        return OrderedStream(df, value or self.value, self.seq, self.keys, self.ts)

    def select_value(self, f: Callable[[Column], Column]) -> OrderedStream:
        """The same rows with f of the value."""
        return OrderedStream(self.df.withColumn(self.value, f(self.v)), self.value, self.seq, self.keys, self.ts, self.root, f(self.expr))

    @property
    def v(self) -> Column:
        return F.col(self.value)

    @property
    def n(self) -> Column:
        return F.col(self.seq)

    @property
    def order(self):
        """The window of a key's rows in order; an unkeyed stream has only one, so use it for short streams."""
        return Window.partitionBy(*self.keys).orderBy(self.seq)

    # elements

    def map(self, f: Callable[..., Column], *args) -> OrderedStream:
        """y[n] = f(x[n], *args)."""
        return self.select_value(lambda v: f(v, *args))

    def filter(self, predicate: Callable[..., Column], *args, renumber: bool = True) -> OrderedStream:
        """The elements for which predicate holds, numbered densely again."""
        out = self.like(self.df.filter(predicate(self.v, *args)))
        return out.renumber() if renumber else out

    def discard_null(self) -> OrderedStream:
        return self.filter(lambda v: v.isNotNull())

    def renumber(self) -> OrderedStream:
        """Positions from 0 without gaps.

        Rows are ranked within buckets of BUCKET old positions of a key, and the buckets' counts give their
        first positions, so that no task orders a whole stream.
        """
        keys = list(self.keys)
        df = self.df.withColumn("__b", F.floor(self.n / BUCKET))
        rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(self.seq)) - 1
        df = df.withColumn("__r", rank)
        before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        counts = df.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
        starts = counts.select(*keys, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
        return self.like(with_rows(df, starts, ["__b"], keys).withColumn(self.seq, (F.col("__r") + F.col("__s")).cast("long")).drop("__b", "__r", "__s"))

    def map_many(self, f: Callable[[Column], Column], renumber: bool = True) -> OrderedStream:
        """The elements of the arrays f(x[n]), in order; an empty or null array gives none."""
        df = self.df.select("*", F.posexplode(f(self.v)).alias("__i", "__v"))
        if not renumber:
            return self.like(df.withColumn(self.value, F.col("__v")).drop("__v").withColumnRenamed("__i", "pos"))
        keyed = F.row_number().over(Window.partitionBy(*self.keys).orderBy(self.seq, "__i")).cast("long") - 1
        if self.keys:
            return self.like(df.withColumn(self.seq, keyed).withColumn(self.value, F.col("__v")).drop("__i", "__v"))
        return self.like(dense_positions(df.withColumn(self.value, F.col("__v")), [self.seq, "__i"], "__n").withColumn(self.seq, F.col("__n")).drop("__i", "__v", "__n"))

    def prepend(self, values: Sequence) -> OrderedStream:
        """values, then the stream."""
        kind = self.df.schema[self.value].dataType
        spark = self.df.sparkSession
        head = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"`{self.seq}` long, `{self.value}` {kind.simpleString()}")
        if self.keys:
            head = head.crossJoin(self.df.select(*self.keys).distinct())
        return self.like(head.unionByName(self.df.withColumn(self.seq, self.n + len(values)), allowMissingColumns=True))

    def transform(self, f: Callable[..., object], *args, **kwargs):
        """f of this stream: the general operator, for anything that Spark can say of its rows."""
        return f(self, *args, **kwargs)

    def copy(self) -> OrderedStream:
        """The same stream under another name: plans are immutable, so nothing is copied."""
        return OrderedStream(self.df, self.value, self.seq, self.keys, self.ts, self.root, self.expr)

    def checked(self, kind: str) -> OrderedStream:
        """This stream, if its values are of the Spark type kind; an error otherwise."""
        own = self.df.schema[self.value].dataType.simpleString()
        want = self.df.sparkSession.createDataFrame([], f"value {kind}").schema[0].dataType.simpleString()
        if own != want:
            raise TypeError(f"a stream of {want} is expected, not of {own}")
        return self

    def extend(self, values: Sequence) -> OrderedStream:
        """An unkeyed stream, then values; their other columns are null."""
        if self.keys:
            raise ValueError("extend an unkeyed stream")
        kind = self.df.schema[self.value].dataType
        more = self.df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"`__i` long, `{self.value}` {kind.simpleString()}")
        end = self.df.agg((F.coalesce(F.max(self.seq), F.lit(-1)) + 1).alias("__end"))
        more = more.crossJoin(F.broadcast(end)).select((F.col("__i") + F.col("__end")).cast(self.df.schema[self.seq].dataType).alias(self.seq), self.value)  # one row
        return self.like(self.df.unionByName(more, allowMissingColumns=True))

    def halo(self, after: int, before: int = 0, bucket: int = BUCKET) -> DataFrame:
        """Rows with a bucket of positions, __b, each bucket with the rows within after and before of its own
        (__own tells them): windows by (keys, __b) then spread one long stream over all tasks."""
        n = self.n
        low = F.greatest(F.floor((n - after) / bucket), F.lit(0)).cast("long")
        high = F.floor((n + before) / bucket).cast("long")
        rows = self.df.withColumn("__b", F.explode(F.sequence(low, high)))
        return rows.withColumn("__own", F.floor(n / bucket) == F.col("__b"))

    # reading

    def latest(self, n: int = 1) -> DataFrame:
        return self.df.orderBy(self.n.desc()).limit(n)

    def latest_value(self, default=None) -> DataFrame:
        return self.df.agg(F.coalesce(F.max_by(self.value, self.seq), F.lit(default)).alias(self.value))

    def bounds(self) -> DataFrame:
        """first and last position (-1 if empty), and the number of elements."""
        return self.df.agg(F.coalesce(F.min(self.seq), F.lit(-1)).alias("first"), F.coalesce(F.max(self.seq), F.lit(-1)).alias("last"), F.count("*").alias("n"))

    def after(self, position: int) -> DataFrame:
        return self.df.filter(self.n >= position)

    def after_value(self, column: str, value) -> DataFrame:
        return self.df.filter(F.col(column) >= value)

    def index_of(self, column: str, value) -> DataFrame:
        """The first position at which column is at least value, -1 if none."""
        return self.df.filter(F.col(column) >= value).agg(F.coalesce(F.min(self.seq), F.lit(-1)).alias("index"))

    def values(self) -> list:
        """All values in order, on the driver: the sink into a list, for what is small."""
        return [r[0] for r in self.df.orderBy(*self.keys, self.seq).select(self.value).collect()]

    # operators on two streams, by position

    def _with(self, other, f: Callable[[Column, Column], Column]) -> OrderedStream:
        if not isinstance(other, OrderedStream):
            return self.map(lambda v: f(v, F.lit(other)))
        from .operators.merge import zip_map

        return zip_map([self, other], f)

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._with(other, lambda a, b: F.try_divide(a, b))

    def __floordiv__(self, other):
        return self._with(other, lambda a, b: F.floor(F.try_divide(a, b)))

    def __mod__(self, other):
        """The modulo that has the divisor's sign."""
        return self._with(other, lambda a, b: a - b * F.floor(F.try_divide(a, b)))

    def __lt__(self, other):
        return self._with(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._with(other, lambda a, b: a <= b)

    def __gt__(self, other):
        return self._with(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._with(other, lambda a, b: a >= b)

    def equals(self, other):
        return self._with(other, lambda a, b: a == b)

    def differs(self, other):
        return self._with(other, lambda a, b: a != b)
