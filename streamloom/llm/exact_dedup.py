"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, written

#: Bytes of the first rounds' digits, which split almost all different texts; then the width doubles up to MOST.
WIDTHS = (24, 232, 3840, 61440, 1 << 20)
MOST = 1 << 26
#: Bytes of a group's texts that one task takes; a larger group is dealt out.
HOT_BYTES = 1 << 25


def _labelled(digit: DataFrame, groups: DataFrame, hot_bytes: int) -> DataFrame:
    """digit's rows with their group's columns, null without a group.

    Both sides are shuffled, at every size alike.  A group of over hot_bytes is dealt to as many tasks as it
    needs: its row is repeated, and its members take one of them by turns.  Such groups are known by a
    64-bit hash of their keys, of which there are at most all bytes / hot_bytes: that is broadcast.
    """
    keys = ["group", "digit", "ended"]
    deals = F.ceil(F.col("size") / hot_bytes).cast("int")
    hot = groups.select(F.xxhash64(*keys).alias("hash"), deals.alias("deals")).filter("deals > 1").groupBy("hash").agg(F.max("deals").alias("deals"))
    if hot.take(1):
        own = lambda df: df.withColumn("hash", F.xxhash64(*keys)).join(F.broadcast(hot), "hash", "left").drop("hash")
        digit = own(digit).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.coalesce("deals", F.lit(1))).cast("int")).drop("deals")
        groups = own(groups).withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
        keys = [*keys, "deal"]
    return digit.join(groups.drop("size").hint("merge"), keys, "left")


def exact_duplicates(docs: DataFrame, normalise=None, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Groups of documents with equal texts, by splitting on successive bytes; no digest decides equality.

    Round r splits each group by the next bytes of its texts and by whether they end there.  A group of one
    is done; a group whose texts have ended is a class of equal texts; other groups go on.  Counts are
    pre-aggregated before the shuffle, so copies of one text meet as one row for each task, and are
    written; the join that labels members deals a group of over hot_bytes to several tasks.

    Returns doc_id, keep_id (the largest doc_id of the class), group_size (its rows), kept and
    text_sha256, a row for each row of docs.  Null counts as empty.  normalise, if given, maps the text
    column first.  Rows are judged by their texts, so a doc_id that repeats is in several classes if its
    texts differ; all its rows of one class are kept or dropped alike.  A null doc_id counts as less than
    any other: its row is kept only in a class without another, whose keep_id is null.  An empty table gives
    an empty result.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("bytes"))
    active = rows.select("doc_id", F.lit(0).cast("long").alias("group"), "bytes", F.sha2("bytes", 256).alias("sha"))
    done, r = [], 0
    while True:
        width = WIDTHS[r] if r < len(WIDTHS) else min(MOST, WIDTHS[-1] << (r - len(WIDTHS) + 1))
        digit = active.withColumns({"digit": F.substring("bytes", 1, width), "ended": F.octet_length("bytes") <= width})
        size = F.sum(F.octet_length("bytes").cast("long")).alias("size")
        groups = digit.groupBy("group", "digit", "ended").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), size).filter("n > 1")
        groups = written(groups.withColumn("next", F.monotonically_increasing_id()), "radix")
        over = F.col("n").isNull() | F.col("ended")
        label = _labelled(digit, groups, hot_bytes)
        label = label.select("doc_id", "sha", over.alias("over"), F.col("next").alias("group"), "n", "keep_id", F.when(~over, F.expr(f"substring(bytes, {width + 1})")).alias("bytes"))
        label = written(label, "radix")
        done.append(label.filter("over").select("doc_id", "sha", "n", "keep_id"))
        active = label.filter("not over").select("doc_id", "group", "bytes", "sha")
        forget(groups)
        r += 1
        if not active.take(1):
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
