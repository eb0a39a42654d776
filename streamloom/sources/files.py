"""Sources and sinks on files, tables and functions; the streaming twins are in streamloom.streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import OrderedStream, dense_positions


def text_lines(spark: SparkSession, path: str, parse: Callable[[Column], Column] | None = None) -> OrderedStream:
    """A line for each element, the last one too, in order of file and line."""
    lines = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__o"), F.monotonically_increasing_id().alias("__m"))
    out = dense_positions(lines, ["__f", "__o", "__m"]).drop("__f", "__o", "__m")
    return OrderedStream(out.withColumn("value", parse(F.col("value"))) if parse else out)


def float_lines(spark: SparkSession, path: str) -> OrderedStream:
    return text_lines(spark, path, lambda c: F.trim(c).try_cast("double"))


def int_lines(spark: SparkSession, path: str) -> OrderedStream:
    return text_lines(spark, path, lambda c: F.trim(c).try_cast("long"))


def parsed_lines(spark: SparkSession, path: str, f: Callable, initial: Callable[[], object], kind: str) -> OrderedStream:
    """What a Python f(line, state) -> (y, state) emits, line after line."""
    from ..operators.fold import fold

    return OrderedStream(fold(text_lines(spark, path), f, initial, kind, renumber=True))


def from_steps(spark: SparkSession, f: Callable, steps: int, window_size: int = 1, initial: Callable[[], object] | None = None, kind: str = "double") -> OrderedStream:
    """window_size values of each of steps calls of a Python f(), or of f(state) -> (y, state), in order.

    One task calls f, as each call may depend on the one before; it yields batches of bounded size.
    """
    import pyarrow as pa

    schema = spark.createDataFrame([], f"seq long, value {kind}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for _ in batches:
            state, out, n = initial() if initial else None, [], 0
            for _ in range(steps * window_size):
                if initial is None:
                    y = f()
                else:
                    y, state = f(state)
                out.append(y)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(out)), pa.int64()), pa.array(out, target.field(1).type)], schema=target)
                    n, out = n + len(out), []
            yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(out)), pa.int64()), pa.array(out, target.field(1).type)], schema=target)

    return OrderedStream(spark.range(1, numPartitions=1).mapInArrow(run, schema))


def wave_files(spark: SparkSession, path: str) -> OrderedStream:
    """Samples of 16-bit WAV files, the first channel, by file: key file, seq and value.

    Files are read whole by the JVM, each by one task, and parsed in batches of frames.
    """
    import io
    import wave

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with wave.open(io.BytesIO(blob)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{name}: 16-bit samples are expected")
                    at = 0
                    while data := w.readframes(1 << 16):
                        x = np.frombuffer(data, "<i2").reshape(-1, w.getnchannels())[:, 0].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(at, at + len(x))), pa.array(x)], ["file", "seq", "value"])
                        at += len(x)

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return OrderedStream(rows.mapInArrow(run, "file string, seq long, value long"), keys=["file"])


def array_files(spark: SparkSession, path: str) -> OrderedStream:
    """The numbers of NumPy files (.npy; pickled objects are refused), by file: key file, seq and value."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.load(io.BytesIO(blob), allow_pickle=False).astype(float).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(x)], ["file", "seq", "value"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return OrderedStream(rows.mapInArrow(run, "file string, seq long, value double"), keys=["file"])


def database(spark: SparkSession, url: str, query: str, key: str | None = None, parts: int = 8, bounds: tuple[int, int] | None = None) -> DataFrame:
    """The rows of a query on a database, over JDBC, in parts by a numeric key between bounds."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of a query on an sqlite file that all machines see; one task reads it, in batches."""
    import sqlite3

    import pyarrow as pa

    kind = spark.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(kind)
        for _ in batches:
            connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            try:
                found = connection.execute(query)
                while rows := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
            finally:
                connection.close()

    return spark.range(1, numPartitions=1).mapInArrow(run, kind)


def messages(spark: SparkSession, path: str, words: list[str] = (), language: str | None = None, streaming: bool = False) -> DataFrame:
    """value: the JSON messages (a line each) of a folder that a collector writes to, with any of the words in
    their text and in that language, bounded or as a stream."""
    lines = (spark.readStream if streaming else spark.read).text(path)
    if words:
        text = F.lower(F.get_json_object("value", "$.text"))
        lines = lines.filter(F.greatest(*(text.contains(w.lower()).cast("int") for w in words), F.lit(0)) == 1)
    return lines.filter(F.get_json_object("value", "$.lang") == language) if language else lines


def from_function(spark: SparkSession, f: Callable[[Column], Column], count: int) -> OrderedStream:
    """f of the position, for count elements."""
    return OrderedStream(spark.range(count).select(F.col("id").alias("seq"), f(F.col("id")).alias("value")))


def to_text(stream: OrderedStream, path: str) -> None:
    """A line for each element, appended."""
    stream.df.select(F.col(stream.value).cast("string").alias("value")).write.mode("append").text(path)


def to_json(stream: OrderedStream, path: str) -> None:
    """A JSON object for each element, a line each, appended."""
    stream.df.write.mode("append").json(path)


def json_to_csv(spark: SparkSession, source: str, target: str, schema: str) -> None:
    spark.read.schema(schema).json(source).write.mode("append").option("header", True).csv(target)


def by_name(messages: DataFrame, names: list[str], name: str = "name", close: str = "_close") -> list[DataFrame]:
    """A topic of named messages as one DataFrame for each name; those that close are left out."""
    return [messages.filter((F.col(name) == n) & (F.col("value") != close)) for n in names]
