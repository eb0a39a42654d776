"""Counting and membership over command streams, and heavy hitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..core import OrderedStream
from ..operators.fold import fold


def members(commands: DataFrame, seq: str = "seq", command: str = "cmd", key: str = "key") -> DataFrame:
    """seq, key, found of every `check`: whether an `add` of its key came before.  Exact, by key."""
    first = F.min(F.when(F.col(command) == "add", F.col(seq))).over(Window.partitionBy(key))
    out = commands.withColumn("__first", first).filter(F.col(command) == "check")
    return out.select(seq, key, F.coalesce(F.col("__first") < F.col(seq), F.lit(False)).alias("found"))


def counts(commands: DataFrame, seq: str = "seq", command: str = "cmd", key: str = "key") -> DataFrame:
    """seq, key, n of every `check`: how many `add`s of its key came before.  Exact, by key."""
    so_far = F.count(F.when(F.col(command) == "add", True)).over(Window.partitionBy(key).orderBy(seq))
    return commands.withColumn("n", so_far).filter(F.col(command) == "check").select(seq, key, "n")


def _places(key, bits: int, hashes: int, salt: int = 0):
    """hashes places of 2**bits for a key, by two hashes."""
    size = 1 << bits
    one, two = (F.pmod(F.xxhash64(key, F.lit(2 * salt + i)), F.lit(size)) for i in (0, 1))
    return F.array(*((one + F.lit(i) * two.bitwiseOR(F.lit(1))) % size for i in range(hashes)))


def approximate_members(commands: DataFrame, bits: int = 20, hashes: int = 4, seq: str = "seq", command: str = "cmd", key: str = "key") -> DataFrame:
    """members() by a Bloom filter of 2**bits places and hashes places a key: found is never wrongly false.

    A place is set from the first `add` of any key that has it; a key is found if all its places are set.  Places
    are partial minima, so the shuffle has at most 2**bits rows a task whatever the number of keys.
    """
    marked = commands.withColumn("__p", F.explode(_places(F.col(key), bits, hashes)))
    first = marked.filter(F.col(command) == "add").groupBy("__p").agg(F.min(seq).alias("__first"))
    checks = marked.filter(F.col(command) == "check").join(first, "__p", "left")
    set_ = F.coalesce(F.col("__first") < F.col(seq), F.lit(False))
    return checks.groupBy(seq, key).agg(F.bool_and(set_).alias("found"))


def approximate_counts(commands: DataFrame, width_bits: int = 16, depth: int = 4, seq: str = "seq", command: str = "cmd", key: str = "key") -> DataFrame:
    """counts() by a count-min sketch of depth rows of 2**width_bits counters: n is never too small."""
    marked = commands.select("*", F.posexplode(_places(F.col(key), width_bits, depth, 1)).alias("__row", "__p"))
    so_far = F.count(F.when(F.col(command) == "add", True)).over(Window.partitionBy("__row", "__p").orderBy(seq))
    return marked.withColumn("__n", so_far).filter(F.col(command) == "check").groupBy(seq, key).agg(F.min("__n").alias("n"))


def heavy_hitters(df: DataFrame, column: str, least: float) -> DataFrame:
    """Values that over least of all rows have, with their counts: partial counts, then one row a value."""
    total = df.agg(F.count("*").alias("__t"))
    return df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter(F.col("n") > least * F.col("__t")).drop("__t")


def misra_gries(stream: OrderedStream, counters: int) -> DataFrame:
    """keys, seq, value (a JSON map): the counters after every element, at most counters - 1 of them."""
    import json

    def step(x, now):
        now = dict(now)
        if x in now:
            now[x] += 1
        elif len(now) < counters - 1:
            now[x] = 1
        else:
            now = {k: n - 1 for k, n in now.items() if n > 1}
        return json.dumps(now, sort_keys=True), now

    return fold(stream, step, dict, "string")
