"""A Python data source and sink for message queues: a folder of JSON lines stands for the broker.

Every message file is a batch with its number in its name; a writer's files appear together when its
micro-batch commits, under the batch's number, so a batch that is run again replaces itself.  Offsets are
(file number, line): reads continue after the last file that was read to its end.  Subclass Broker
for a real broker: publish and read are all that the source and the sink use.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage

END, CLOSE = "_finished", "_close"


class Broker:
    """Numbered batches of a topic's messages, in a folder that driver and executors share."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def _files(self) -> list[tuple[int, str]]:
        if not os.path.isdir(self.folder):
            return []
        return sorted((int(name.split(".")[0]), os.path.join(self.folder, name)) for name in os.listdir(self.folder) if name.endswith(".json"))

    def last(self) -> int:
        """The number of the last batch, -1 before the first."""
        return max((n for n, _ in self._files()), default=-1)

    def read(self, after: int, to: int | None = None) -> Iterator[dict]:
        """Messages of the batches after one number, up to another."""
        for n, path in self._files():
            if n > after and (to is None or n <= to):
                with open(path) as f:
                    yield from map(json.loads, f)

    def stage(self, messages: Iterable[dict]) -> str:
        """Write messages where they aren't read yet."""
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{uuid.uuid4().hex}.part")
        with open(path, "w") as f:
            f.writelines(json.dumps(m) + "\n" for m in messages)
        return path

    def commit(self, parts: Iterable[str], number: int) -> None:
        """Make staged messages the batch of that number, in the order of parts."""
        whole = os.path.join(self.folder, f"{uuid.uuid4().hex}.whole")
        parts = list(parts)
        os.makedirs(self.folder, exist_ok=True)
        with open(whole, "w") as out:
            for p in parts:
                with open(p) as f:
                    out.write(f.read())
        os.replace(whole, os.path.join(self.folder, f"{number:012d}.json"))
        for p in parts:
            os.remove(p)

    def publish(self, messages: Iterable[dict]) -> None:
        """A batch after the last one; for one publisher at a time."""
        part = self.stage(messages)
        self.commit([part], self.last() + 1)


def _rows(messages: Iterable[dict]) -> Iterator[tuple[str, str]]:
    """name and value of messages; a list value is a batch of several, and an end mark is none."""
    for m in messages:
        value = m.get("value")
        for v in value if m.get("batch") else [value]:
            if v != END:
                yield m.get("name", ""), json.dumps(v)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.broker = Broker(options["path"])

    def initialOffset(self):
        return {"after": -1}

    def read(self, start):
        last = max(self.broker.last(), start["after"])
        return iter(list(_rows(self.broker.read(start["after"], last)))), {"after": last}

    def readBetweenOffsets(self, start, end):
        return iter(list(_rows(self.broker.read(start["after"], end["after"]))))


@dataclass
class _Staged(WriterCommitMessage):
    part: str


class _Writer(DataSourceStreamWriter):
    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows):
        messages = [{"name": r["name"], "value": json.loads(r["value"])} for r in rows]
        return _Staged(Broker(self.folder).stage(messages))

    def commit(self, messages, batchId):
        Broker(self.folder).commit([m.part for m in messages if m], batchId)

    def abort(self, messages, batchId):
        for m in messages:
            if m and os.path.exists(m.part):
                os.remove(m.part)


class QueueSource(DataSource):
    """format("queue"): name and value (JSON) of a topic's messages; register with spark.dataSource."""

    @classmethod
    def name(cls):
        return "queue"

    def schema(self):
        return "name string, value string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options)

    def streamWriter(self, schema, overwrite):
        return _Writer(self.options)


class Publisher:
    """Publishes the elements of a bounded stream to a topic: one message each, or one for each batch of them."""

    def __init__(self, folder: str, name: str, batched: bool = False):
        self.broker, self.name, self.batched = Broker(folder), name, batched

    def publish(self, df: DataFrame, value: str = "value", order: str = "seq") -> None:
        """Elements in order, as they come from the executors."""
        values = (r[0] for r in df.orderBy(order).select(value).toLocalIterator())
        if self.batched:
            self.broker.publish([{"name": self.name, "value": list(values), "batch": True}])
        else:
            self.broker.publish({"name": self.name, "value": v} for v in values)

    def close(self) -> None:
        """Mark the end of the topic's stream of this name."""
        self.broker.publish([{"name": self.name, "value": END}])


def subscribe(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """name and value of a topic's messages as a stream; schema parses the values, JSON, into that type."""
    spark.dataSource.register(QueueSource)
    rows = spark.readStream.format("queue").option("path", folder).load()
    if schema is None:
        return rows
    whole = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), f"v {schema}")  # a type may be a plain one
    return rows.withColumn("value", whole["v"])


def func_to_queue(f: Callable, folder: str, name: str, steps: int, state=None) -> None:
    """Publish f() of each step, or with a state the y of f(state) -> (y, state), and the end."""
    out = []
    for _ in range(steps):
        if state is None:
            y = f()
        else:
            y, state = f(state)
        out.append({"name": name, "value": y})
    broker = Broker(folder)
    broker.publish(out)
    broker.publish([{"name": name, "value": END}])


def open_until(messages: DataFrame, order: str = "seq", mark: str = CLOSE) -> DataFrame:
    """A bounded topic's messages before the first that closes it."""
    end = messages.filter(F.col("value") == mark).agg(F.min(order).alias("__end"))
    return messages.crossJoin(F.broadcast(end)).filter(F.col("__end").isNull() | (F.col(order) < F.col("__end"))).drop("__end")  # one row


def by_lookup(messages: DataFrame, lookup: Callable, names: list[str]) -> dict[str, DataFrame]:
    """A topic as one DataFrame for each of names, which lookup (a Column of the message's name) gives."""
    found = messages.withColumn("__to", lookup(F.col("name")))
    return {n: found.filter(F.col("__to") == n).drop("__to") for n in names}


def drain(folder: str, path: str | None = None) -> int:
    """Append a topic's messages, up to its end, to a text file, or print them; how many there were."""
    n = 0
    out = open(path, "a") if path else None
    try:
        for m in Broker(folder).read(-1):
            if m.get("value") in (END, None):
                break
            print(m["value"], file=out)
            n += 1
    finally:
        if out:
            out.close()
    return n


__all__ = ["Broker", "Publisher", "QueueSource", "by_lookup", "drain", "func_to_queue", "open_until", "subscribe"]
