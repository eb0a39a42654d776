"""Networks of processes, shared variables and external streams: how programs are put together and run.

A network is a declared graph: processes with named, typed input and output streams, and connections.
Nothing moves between processes but plans: run() builds one plan for each output that is asked for.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from .core import OrderedStream

# One-letter names of types, and the Spark types they stand for.
KINDS = {"i": "bigint", "f": "float", "d": "double", "c_wchar": "string", "x": "string"}


@dataclass(frozen=True)
class Process:
    """f(inputs by name) -> outputs by name, all ordered streams of the declared types."""

    name: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    f: Callable[[dict[str, OrderedStream]], dict[str, OrderedStream]]


def _kind(name: str) -> str:
    return KINDS.get(name, name)


@dataclass
class Network:
    """Processes, and connections (from process or source, its stream, to process, its stream)."""

    processes: dict[str, Process] = field(default_factory=dict)
    connections: list[tuple[str, str, str, str]] = field(default_factory=list)
    sources: dict[str, str] = field(default_factory=dict)

    def source(self, name: str, kind: str) -> Network:
        if name in self.sources or name in self.processes:
            raise ValueError(f"{name} is there already")
        self.sources[name] = kind
        return self

    def add(self, process: Process) -> Network:
        if process.name in self.processes or process.name in self.sources:
            raise ValueError(f"{process.name} is there already")
        if twice := set(process.inputs) & set(process.outputs):
            raise ValueError(f"{process.name} reads and writes {sorted(twice)}")
        self.processes[process.name] = process
        return self

    def connect(self, origin: str, out: str, process: str, into: str) -> Network:
        """A source's only stream has the source's name."""
        self.connections.append((origin, out, process, into))
        return self

    def _offered(self, origin: str) -> dict[str, str]:
        if origin in self.sources:
            return {origin: self.sources[origin]}
        if origin in self.processes:
            return self.processes[origin].outputs
        raise ValueError(f"there is no process or source {origin}")

    def check(self) -> list[str]:
        """The processes in an order in which each comes after those it reads from; an error where a stream
        doesn't exist, has two writers or none, types differ, or there is a cycle."""
        writers: dict[tuple[str, str], tuple[str, str]] = {}
        graph = TopologicalSorter({name: set() for name in self.processes})
        for origin, out, process, into in self.connections:
            offered = self._offered(origin)
            if out not in offered:
                raise ValueError(f"{origin} has no stream {out}")
            if process not in self.processes:
                raise ValueError(f"there is no process {process}")
            wanted = self.processes[process].inputs
            if into not in wanted:
                raise ValueError(f"{process} has no input {into}")
            if (process, into) in writers:
                raise ValueError(f"{into} of {process} has two writers")
            if _kind(offered[out]) != _kind(wanted[into]):
                raise TypeError(f"{out} of {origin} is {offered[out]}, {into} of {process} is {wanted[into]}")
            writers[process, into] = (origin, out)
            if origin in self.processes:
                graph.add(process, origin)
        for p in self.processes.values():
            for i in p.inputs:
                if (p.name, i) not in writers:
                    raise ValueError(f"{i} of {p.name} has no writer")
        for s in self.sources:
            if not any(origin == s for origin, *_ in self.connections):
                raise ValueError(f"nothing reads the source {s}")
        try:
            return list(graph.static_order())
        except CycleError as e:
            raise ValueError(f"a cycle: {' -> '.join(e.args[1])}; write a feedback loop as a fold") from e

    def readers(self, name: str) -> list[str]:
        """The processes that read a source or a process."""
        return sorted({process for origin, _, process, _ in self.connections if origin == name})

    def run(self, given: dict[str, OrderedStream]) -> dict[str, dict[str, OrderedStream]]:
        """The outputs of all processes by name, declared over the given sources; values are checked by type."""
        order = self.check()
        made = {name: {name: given[name].checked(_kind(kind))} for name, kind in self.sources.items()}
        for name in order:
            p = self.processes[name]
            inputs = {into: made[origin][out] for origin, out, process, into in self.connections if process == name}
            outputs = p.f(inputs)
            if set(outputs) != set(p.outputs):
                raise ValueError(f"{name} gave {sorted(outputs)}, not {sorted(p.outputs)}")
            made[name] = {out: stream.checked(_kind(p.outputs[out])) for out, stream in outputs.items()}
        return made


class Shared:
    """A variable on the driver with subscribers; activate() calls them, and what they change calls others,
    until nothing more changes."""

    def __init__(self, value=None):
        self.value, self._subscribers, self._active = value, [], False

    def register(self, f: Callable[[Shared], None]) -> None:
        if f not in self._subscribers:
            self._subscribers.append(f)

    def delete(self, f: Callable[[Shared], None]) -> None:
        self._subscribers.remove(f)

    def set(self, value) -> None:
        """Change the value; within activate(), subscribers are called again if it differs."""
        self._changed = value != self.value
        self.value = value
        if self._changed and not self._active:
            self.activate()

    def activate(self, most: int = 10_000) -> int:
        """How many rounds it took; an error after too many."""
        self._active = True
        try:
            for n in range(1, most + 1):
                before = self.value
                for f in list(self._subscribers):
                    f(self)
                if self.value == before:
                    return n
        finally:
            self._active = False
        raise RuntimeError(f"no end after {most} rounds")


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], same: Callable[[DataFrame, DataFrame], bool], most: int = 100) -> DataFrame:
    """step of step of … start until same(before, after); each round is written, so the plan doesn't grow."""
    from .core import cut

    now = cut(start)
    for _ in range(most):
        new = cut(step(now))
        if same(now, new):
            return new
        now = new
    raise RuntimeError(f"no end after {most} rounds")


class ExternalStream:
    """A stream that other programs extend: a folder of JSON lines, {"name", "key", "seq", "value"}, that a query reads.

    A call's items appear together, in a file whose name follows those before it.  terminate() marks the
    end; the reader is then done when it has read what is there.  One program extends a stream.
    """

    END = "_finished"

    def __init__(self, folder: str, name: str, key: str = ""):
        self.folder, self.name, self.key = folder, name, key
        os.makedirs(folder, exist_ok=True)
        self.files = [f for f in os.listdir(folder) if f.endswith(".json")]
        self.count, self.next = len(self.files), self._count()

    def _count(self) -> int:
        n = 0
        for f in self.files:
            with open(os.path.join(self.folder, f)) as rows:
                n += sum(json.loads(r)["name"] == self.name and not json.loads(r).get("end") for r in rows)
        return n

    def _put(self, rows: Iterable[dict]) -> None:
        path = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        stamp = 1_000_000_000 + self.count
        os.utime(path, (stamp, stamp))  # readers take files in the order of their times
        os.replace(path, os.path.join(self.folder, f"{self.count:012d}.json"))
        self.count += 1

    def extend(self, values: Sequence) -> None:
        self._put({"name": self.name, "key": self.key, "seq": self.next + i, "value": v, "end": False} for i, v in enumerate(values))
        self.next += len(values)

    def append(self, value) -> None:
        self.extend([value])

    def terminate(self) -> None:
        self._put([{"name": self.name, "key": self.key, "seq": self.next, "end": True}])

    def finished(self) -> bool:
        last = os.path.join(self.folder, f"{self.count - 1:012d}.json")
        if not os.path.exists(last):
            return False
        with open(last) as f:
            return any(json.loads(r).get("end") for r in f)

    def read(self, spark: SparkSession, kind: str = "double") -> DataFrame:
        """key, seq, value as a streaming DataFrame."""
        rows = spark.readStream.schema(f"name string, key string, seq long, value {kind}, end boolean").option("maxFilesPerTrigger", 1).json(self.folder)
        return rows.filter((rows["name"] == self.name) & ~rows["end"]).select("key", "seq", "value")


def halt(query) -> None:
    """Stop a streaming query; it goes on from its checkpoint when it is started again."""
    query.stop()
