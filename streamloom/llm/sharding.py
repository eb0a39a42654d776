"""Consistent hashing with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Hash buckets of a ring arc's keys; with the arcs they bound the summary that reaches the driver.
BUCKETS = 64
#: Rows of a cell (arc, bucket) that one task orders; a cell with more, as of a key that very many rows share, is split.
CELL_ROWS = 4_000_000
#: Leading bits of a point by which the ring is looked up.
LEAD = 12


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in clockwise order; points are 32-bit."""
    points = ((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(virtual_nodes))
    return sorted(points)


def place(cells: dict[tuple[int, int, int], int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (arc, bucket, part, first rank, shard, first slot) that place all keys within the bounds.

    cells: keys of each (arc, bucket, part).  Keys go in the order (bucket, arc, part, rank); each takes the
    first shard clockwise of its arc that isn't full.  Capacities are the total over shards, rounded up for
    the first of them and down for the rest, so that counts differ by one at most.
    """
    total = sum(cells.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    clockwise = []
    for a in range(len(nodes)):
        clockwise.append(list(dict.fromkeys(nodes[(a + k) % len(nodes)][1] for k in range(len(nodes)))))
    runs = []
    for bucket, arc, part in sorted((b, a, p) for a, b, p in cells):
        rank, left = 0, cells[arc, bucket, part]
        for s in clockwise[arc]:
            if not left:
                break
            take = min(left, free[s])
            if take:
                runs.append((arc, bucket, part, rank, s, used[s]))
                free[s], used[s], rank, left = free[s] - take, used[s] + take, rank + take, left - take
    return runs


def _arc(point: Column, nodes: list[tuple[int, int]]) -> Column:
    """The number of the first node at or after a 32-bit point, past the last the first.

    The point's leading bits give the nodes before that stretch of the ring and the few within it, so the
    cost doesn't grow with the number of nodes.
    """
    points, step = [p for p, _ in nodes], 32 - LEAD
    cuts = [bisect_left(points, k << step) for k in range((1 << LEAD) + 1)]
    table = json.dumps([{"b": a, "p": points[a:z]} for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
    stretches = F.from_json(F.lit(table), "array<struct<b:int,p:array<bigint>>>")  # folded to a constant
    own = F.element_at(stretches, (F.shiftright(point, step) + 1).cast("int"))
    behind = own["b"] + F.size(F.filter(own["p"], lambda p: p < point))
    return F.pmod(behind, F.lit(len(nodes)))


def shard(rows: DataFrame, key: Column, shards: int = 16, virtual_nodes: int = 16, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard).

    The law is `rows`: shard counts differ by one at most.  A key's arc is the first virtual node
    clockwise of its hash; keys that overflow a full shard continue clockwise.  Only the counts of
    (arc, bucket) cells, at most shards * virtual_nodes * BUCKETS of them, reach the driver, and of the parts
    of those few that are split; ranks are taken within a cell or part, so no task orders more than that.

    rows are written first, each with a number, so that a task that runs again numbers alike.  Rows with
    equal keys are ordered by that number; a null key is a key of its own; a key that more than cell_rows
    rows share is spread by the number, too.  An empty table gives an empty result.  Other columns stay,
    whatever their names, but for shard and slot, which are replaced.
    """
    nodes = ring(shards, virtual_nodes)
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.withColumn("__digest", digest).select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("__digest").alias("hash"), F.monotonically_increasing_id().alias("number"))
    rows = written(rows, "sharding").withColumn("point", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"))
    rows = rows.select("row", "hash", "number", _arc(F.col("point"), nodes).alias("arc"), (F.conv(F.substring("hash", 9, 4), 16, 10).cast("int") % BUCKETS).alias("bucket"))
    counts = {(r["arc"], r["bucket"], 0): r["n"] for r in rows.groupBy("arc", "bucket").agg(F.count("*").alias("n")).collect()}  # at most one row a cell
    large = {c: -(-n // cell_rows) for c, n in counts.items() if n > cell_rows}
    part = F.lit(0)
    if large:
        parts = F.create_map(*(F.lit(x) for (a, b, _), k in large.items() for x in (a * BUCKETS + b, k)))
        own = F.try_element_at(parts, F.col("arc") * BUCKETS + F.col("bucket"))
        part = F.when(own.isNull(), 0).otherwise(F.pmod(F.xxhash64("number"), own)).cast("int")
    rows = rows.withColumn("part", part)
    if large:
        split = rows.filter(F.array_contains(F.array(*(F.lit(a * BUCKETS + b) for a, b, _ in large)), F.col("arc") * BUCKETS + F.col("bucket")))
        counts = {c: n for c, n in counts.items() if c not in large}
        counts |= {(r["arc"], r["bucket"], r["part"]): r["n"] for r in split.groupBy("arc", "bucket", "part").agg(F.count("*").alias("n")).collect()}
    by_cell: dict[tuple[int, int, int], list] = {}
    for a, b, p, first, s, slot in place(counts, nodes, shards):
        by_cell.setdefault((a, b, p), []).append((first, s, slot))
    table = json.dumps([{"a": a, "b": b, "p": p, "r": [{"f": f, "s": s, "t": t} for f, s, t in v]} for (a, b, p), v in by_cell.items()])
    kind = "array<struct<a:int,b:int,p:int,r:array<struct<f:bigint,s:int,t:bigint>>>>"
    cells = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), kind)))
    cells = cells.select(F.col("a").alias("arc"), F.col("b").alias("bucket"), F.col("p").alias("part"), F.col("r").alias("runs"))
    rank = F.row_number().over(Window.partitionBy("arc", "bucket", "part").orderBy("hash", "number")) - 1
    out = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(cells), ["arc", "bucket", "part"])
    run = F.element_at(F.filter("runs", lambda x: x["f"] <= F.col("rank")), -1)
    return out.withColumn("run", run).select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("run.s").alias("shard"), (F.col("run.t") + F.col("rank") - F.col("run.f")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = 16, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 that of the text (null: of no bytes).
    Rows with null or repeated doc_ids each have a slot of their own.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(rows, F.col("doc_id"), shards, virtual_nodes, cell_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
