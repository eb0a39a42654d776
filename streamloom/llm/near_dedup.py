"""MinHash near-dedup with odd sketches.

Every document's distinct word shingles give MinHash samples.  Bands of samples find candidates; an odd
sketch (a bitmap in which each sample flips one bit) estimates a candidate pair's similarity from the
population count of the XOR of two bitmaps, so that clearly different pairs are rejected without
reading their texts; the rest is confirmed on the full shingle sets.

Steps, each linear in its input:

1. sign: sets, bands and sketches, in one pass.  Rows with equal sets collapse to the first of them.
2. Each band bucket's smallest member is its star centre.  Pairs (centre, member) are estimated, then
   confirmed on full sets; links give components.  Every member meets the centre with which it shares most bands.
3. Components that still share a bucket: their members' sketches are compared in blocks of bounded size,
   and what is near is confirmed there, until a block has a link.  So links are not lost where the centre is unlike both ends.
   Buckets of up to CENTRES components go by pairs of components; fuller ones by all pairs of their members'
   sketches, which is quadratic in the bucket, and no bucket or member is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHasher, arrow_text, distinct_by, forget, give_back, mix, saved, shingles, slices
from .components import connected_components

SAMPLES, ROWS, BITS = 160, 5, 512
BLOCK = 256  # members of a component in one block of step 3
SMALL = 64  # pairs of members up to which two components are joined
CENTRES = 16  # components of a bucket that are compared by pairs of components; fuller buckets go by all pairs of members

SIGNED = "doc_id long, t1 long, t2 long, row long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def _factors() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(1, 2**62, SAMPLES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int, hasher: WordHasher):
    hashes, _, _, bounds = hasher(data, offsets)
    return distinct_by(*shingles(hashes, bounds, words))


def sign_sets(values: np.ndarray, bounds: np.ndarray, factors: np.ndarray):
    """Set keys (n x 2), bands and odd sketches (n x 8) of the non-empty sets of values."""
    starts, n = bounds[:-1], len(bounds) - 1
    if not n:
        return np.empty((0, 2), np.uint64), np.empty((0, SAMPLES // ROWS), np.int64), np.empty((0, BITS // 64), np.int64)
    keys = np.stack([np.add.reduceat(values, starts), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts)], axis=1)
    bands = np.zeros((n, SAMPLES // ROWS), np.uint64)
    parity, at = np.zeros((n, BITS), np.uint8), np.arange(n)
    for i, f in enumerate(factors):
        sample = mix(np.minimum.reduceat(values * f, starts) + np.uint64(i))
        parity[at, (sample >> np.uint64(40)) % np.uint64(BITS)] ^= 1
        bands[:, i // ROWS] = mix(bands[:, i // ROWS] + sample)
    sketch = np.packbits(parity, axis=1).view(np.int64)
    return keys, bands.view(np.int64), sketch


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (two hashes of the text, which with doc_id tell rows apart) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row of SIGNED for each document, numbered by row; without words its key, bands and sketch are null."""
    factors = _factors()

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            data, offsets = arrow_text(batch.column(4))
            for a, b in slices(offsets):
                values, bounds = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, hasher)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                keys, bands, sketch = sign_sets(values, np.append(bounds[:-1][full], bounds[-1]), factors)
                two = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
                place = pa.array(np.cumsum(sizes > 0) - 1, mask=sizes == 0)  # null where there is no word
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array(sizes), *(x.take(place) for x in (pa.array([k.tobytes() for k in keys], pa.binary()), two(bands), two(sketch)))],
                    ["doc_id", "t1", "t2", "row", "n_shingles", "set_key", "bands", "sketch"],
                )
        give_back()

    rows = _rows(docs).withColumn("row", F.monotonically_increasing_id())
    return saved(rows.select("doc_id", "t1", "t2", "row", "text"), "signed", run, SIGNED)


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of (id, text): the distinct shingle hashes, sorted, as 64-bit little-endian bytes."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            data, offsets = arrow_text(batch.column(1))
            for a, b in slices(offsets):
                values, bounds = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words, hasher)
                blobs = [values[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(blobs, pa.binary())], ["id", "shingles"])
        give_back()

    return saved(rows.select("id", "text"), "shingles", run, "id long, shingles binary")


def _bits():
    """How many bits of the sketches sa and sb differ."""
    return sum(F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64))


def max_xor(similarity: float) -> int:
    """XOR bits above which a pair's similarity is safely (over six standard deviations) under the bound."""
    low = max(0.0, similarity - 6.2 * math.sqrt(similarity * (1 - similarity) / SAMPLES))
    flips = 2 * SAMPLES * (1 - low)
    return math.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** flips) + 3)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return saved(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb"), "links", run, "a long, b long")


def _across(group: pd.DataFrame, most: int, percent: int) -> pd.DataFrame:
    """A link of one block's left side with each component on its right, if there is any: pairs with near
    sketches are confirmed, nearest first."""
    a, b = group[~group.right], group[group.right]
    out_a, out_b, done = [], [], set()
    if len(a) and len(b):
        x, y = (np.stack(side.sketch.to_list()).view(np.uint64) for side in (a, b))
        apart = np.stack([np.bitwise_count(y ^ row).sum(axis=1, dtype=np.int64) for row in x])
        i, j = np.nonzero(apart <= most)
        sets = [[np.frombuffer(v, np.uint64) for v in side.shingles] for side in (a, b)]
        of = b.component.tolist()
        for k in np.argsort(apart[i, j], kind="stable"):
            if of[j[k]] not in done and _linked(sets[0][i[k]], sets[1][j[k]], percent):
                done.add(of[j[k]])
                out_a.append(a.id.iloc[i[k]])
                out_b.append(b.id.iloc[j[k]])
    return pd.DataFrame({"a": np.asarray(out_a, np.int64), "b": np.asarray(out_b, np.int64)})


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least percent / 100.

    Returns doc_id, n_shingles (distinct shingles of words words), component_id (the smallest reachable
    doc_id) and kept (doc_id = component_id), a row for each row of docs.  Words are runs of anything
    but ASCII white space; A-Z count as a-z.  Texts with fewer than words words have one shingle, the
    whole sequence.  Null, empty or blank texts have none and link with nothing.  Every row is judged by its
    own text, so rows that share a doc_id but no text aren't linked by it.  Null doc_ids count as greater
    than any other; a component of only those has a null component_id, and one of its rows is kept.  An
    empty table gives an empty result.  Other columns are ignored, whatever their names.

    The bands miss a link of similarity 0.8 with probability (1 - 0.8**5)**32 = 3e-6, and only if no
    chain of other links joins the two documents.
    """
    return _judged(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; all columns stay, whatever their names.

    Rows alike in doc_id and text stay or go together; rows without words stay.
    """
    judged = _judged(docs.select("doc_id", "text"), words, percent)
    gone = judged.groupBy("doc_id", "t1", "t2").agg(F.bool_or("kept").alias("stays")).filter("not stays")
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(text) == gone["t1"]) & (F.xxhash64(F.lit(1), text) == gone["t2"])
    return rows.join(gone, same, "left_anti").select("row.*")


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates() with t1 and t2 for each row.  Sets are told apart by the number of their first row."""
    most = max_xor(percent / 100)
    signed = signatures(docs, words)
    first = F.min(F.struct("row", "doc_id", "t1", "t2")).alias("first")
    reps = signed.filter("set_key is not null").groupBy("set_key").agg(first, F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = saved(reps.select("set_key", F.col("first.row").alias("rep"), "first.doc_id", "first.t1", "first.t2", "least", "bands", "sketch"), "sets")
    rows = reps.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", "band", F.xxhash64("band", "h").alias("h"))
    stars = rows.groupBy("h").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("h", "centre")
    buckets = saved(rows.join(stars, "h"), "buckets")
    pairs = buckets.filter("rep <> centre").groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("n"))
    first = pairs.groupBy("b").agg(F.max_by("a", F.struct(F.col("n"), -F.col("a"))).alias("a"))
    sketches = reps.select("rep", "sketch")
    near = saved(_near_pairs(first, sketches, most), "near")
    members = buckets.select("rep").distinct()
    sets = _member_sets(docs, reps.join(members, "rep", "left_semi").select("rep", "doc_id", "t1", "t2"), words)
    links = _confirm(near, sets, percent)
    forget(near)
    components = connected_components(links)
    named = saved(_named(members, components), "named")
    pairs, full, used = _crossing(buckets, named)
    crossing = saved(pairs, "crossing")
    forget(buckets, *used)
    close = _close_components(crossing, named, links, sets, percent)
    forget(crossing, links)
    small, large, wanted = _near_components(close, named, sketches, sets, most, percent)
    near = saved(small.distinct(), "near")
    confirmed = _confirm(near, sets, percent)
    new = saved(confirmed.unionAll(large), "links")
    forget(near, close, named, wanted, confirmed)
    stars = lambda c: c.select(F.col("id").alias("a"), F.col("component").alias("b"))
    if new.take(1):
        merged = connected_components(stars(components).unionAll(new))
        forget(components)
        components = merged
    forget(new)
    if full.take(1):
        new = saved(_full_buckets(full, components, reps, sets, most, percent), "links")
        merged = connected_components(stars(components).unionAll(new))
        forget(components, new)
        components = merged
    forget(full, sets)
    of_rep = _smallest(reps.select("set_key", "rep", "least"), components)
    out = signed.select("doc_id", "t1", "t2", "row", "n_shingles", "set_key").join(of_rep, "set_key", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    kept = F.when(component.isNull(), F.coalesce(F.col("row") == F.col("root"), F.lit(True))).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "t1", "t2", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the first rows of sets; rows alike in doc_id and text count once."""
    rows = _rows(docs)
    same = rows["doc_id"].eqNullSafe(members["doc_id"]) & (rows["t1"] == members["t1"]) & (rows["t2"] == members["t2"])
    sets = shingle_sets(rows.join(members, same).select(members["rep"].alias("id"), rows["text"].alias("text")), words)
    if sets.count() > members.count():
        distinct = saved(sets.dropDuplicates(["id"]), "shingles")
        forget(sets)
        sets = distinct
    return sets


def _smallest(reps: DataFrame, components: DataFrame) -> DataFrame:
    """set_key, root (the component's least rep) and smallest (its least doc_id) of every set."""
    linked = components.join(reps.select(F.col("rep").alias("id"), "least"), "id")
    of_root = linked.groupBy("component").agg(F.min("least").alias("others")).join(reps.select(F.col("rep").alias("component"), "least"), "component")
    of_root = of_root.select("component", F.least("others", "least").alias("smallest"))
    named = _named(reps, components).join(of_root, "component", "left")
    smallest = F.least(F.col("smallest"), F.col("least"))  # nulls are passed over
    return named.select("set_key", F.col("component").alias("root"), smallest.alias("smallest"))


def _named(rows: DataFrame, components: DataFrame) -> DataFrame:
    """rows with the component of their rep; rep itself if it has no links or is its component's smallest."""
    return rows.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _near_pairs(pairs: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in at most that many bits."""
    side = lambda name: sketches.select(F.col("rep").alias(name), F.col("sketch").alias(f"s{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(_bits() <= most).select("a", "b")


def _crossing(buckets: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(ca, cb): the pairs of components that share a bucket of at most CENTRES components; (h, band, rep)
    of all fuller buckets, which hold unlike documents that share a common passage; and the tables that the
    pairs are made from."""
    rows = saved(buckets.join(named, "rep").select("h", "band", "rep", "component"), "mixed")
    each = rows.select("h", "component").distinct()
    sizes = saved(each.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "sizes")
    few = each.join(sizes.filter(F.col("k") <= CENTRES).select("h"), "h")
    pairs = few.withColumnRenamed("component", "ca").join(few.withColumnRenamed("component", "cb"), "h").filter("ca < cb").select("ca", "cb")
    full = rows.join(sizes.filter(F.col("k") > CENTRES).select("h"), "h").select("h", "band", "rep")
    return pairs.distinct(), saved(full, "full"), [rows, sizes]


def _full_buckets(full: DataFrame, components: DataFrame, reps: DataFrame, sets: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b): links between the components of full buckets' members, from all pairs of members.

    A bucket's members are dealt into blocks of about BLOCK, and each two blocks meet in a group of their own,
    so a bucket of any size is spread.  Sketches meet first; only members with a near one in a group
    go on to it with their sets.
    """
    rows = _named(full, components).join(reps.select("rep", "sketch", "bands"), "rep")
    blocks = full.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "h").withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("h", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), "own", "band", F.col("rep").alias("id"), "component", "sketch", "bands")

    def near(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seen = np.zeros(len(table), bool)
        for i, others in _near_members(table, key[1].as_py(), key[2].as_py(), most):
            seen[i] = seen[others] = True
        return table.filter(pa.array(seen))

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _full_links(table, key[1].as_py(), key[2].as_py(), most, percent)

    some = rows.groupBy("h", "row", "column").applyInArrow(near, rows.schema)
    return some.join(sets.select("id", "shingles"), "id").groupBy("h", "row", "column").applyInArrow(links, "a long, b long").distinct()


def _near_members(table: pa.Table, row: int, column: int, most: int):
    """Each member of block row, by place in table, with the members of block column that have near sketches
    and other components, nearest first; only pairs that share no earlier band, as those meet there."""
    get = lambda name: table[name].combine_chunks()
    own, component, band = get("own").to_numpy(), get("component").to_numpy(), get("band")[0].as_py()
    sketch = get("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
    bands = get("bands").flatten().to_numpy().reshape(-1, SAMPLES // ROWS)[:, :band]
    right = np.flatnonzero(own == column)
    y, of = sketch[right], component[right]
    for i in np.flatnonzero(own == row):
        apart = np.bitwise_count(y ^ sketch[i]).sum(axis=1, dtype=np.int64)
        ok = (apart <= most) & (of != component[i])
        if row == column:
            ok &= right > i
        at = np.flatnonzero(ok)
        at = at[~(bands[right[at]] == bands[i]).any(axis=1)]
        if len(at):
            yield i, right[at[np.argsort(apart[at], kind="stable")]]


def _full_links(table: pa.Table, row: int, column: int, most: int, percent: int) -> pa.Table:
    """Links among the near members of two blocks; pairs that other links of the group join already need none."""
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(x) for x in sets])[:-1])
    mark = np.zeros(1 + max(int(c.max()) for c in codes), bool)
    ids, component = table["id"].to_pylist(), table["component"].to_pylist()
    parent = {c: c for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out_a, out_b = [], []
    for i, others in _near_members(table, row, column, most):
        mark[codes[i]] = True
        for j in others.tolist():
            p, q = root(component[i]), root(component[j])
            if p != q:
                both = int(np.count_nonzero(mark[codes[j]]))
                if 100 * both >= percent * (len(codes[i]) + len(codes[j]) - both):
                    parent[p] = q
                    out_a.append(ids[i])
                    out_b.append(ids[j])
        mark[codes[i]] = False
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _close_components(crossing: DataFrame, named: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The component pairs that can have a link, judged by their roots' full sets.

    One less the Jaccard similarity is a metric.  With links of distance at most t, members that link
    directly with their root lie within t of it, so two such components have a link only if their roots
    lie within t, plus t for each that isn't a single document.  A component with other members
    is always kept.
    """
    direct = links.select(F.col("a").alias("component"), F.col("b").alias("rep")).distinct().join(named, ["component", "rep"]).groupBy("component").agg((F.count("*") + 1).alias("direct"))
    shape = named.groupBy("component").agg(F.count("*").alias("n")).join(direct, "component", "left")
    far = F.when(F.col("n") == 1, 0).when(F.col("n") == F.col("direct"), 100 - percent).otherwise(100)
    shape = shape.select("component", far.alias("far"))
    pairs = crossing
    for c in ("ca", "cb"):
        pairs = pairs.join(shape.select(F.col("component").alias(c), F.col("far").alias(f"f{c}")), c)
    pairs = pairs.select("ca", "cb", (F.lit(percent) - F.col("fca") - F.col("fcb")).cast("int").alias("need"))
    far_apart = pairs.filter("need > 0")
    for c in ("ca", "cb"):
        far_apart = far_apart.join(sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")), c)

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ok = [need <= 0 or _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), need) for need, x, y in rows]
            yield batch.select(["ca", "cb"]).filter(pa.array(ok, pa.bool_()))

    none = F.lit(None).cast("binary")
    others = pairs.filter("need <= 0").select("ca", "cb", "need", none.alias("sca"), none.alias("scb"))
    return saved(far_apart.select("ca", "cb", "need", "sca", "scb").unionAll(others), "close", run, "ca long, cb long")


def _near_components(crossing: DataFrame, named: DataFrame, sketches: DataFrame, sets: DataFrame, most: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b) of the component pairs (ca, cb): members of small components with near sketches, yet to be
    confirmed; and links between larger ones; and the table that both are made from.

    Pairs of small components are joined, sketches only.  Otherwise the larger component meets the members
    of all its partners, with their sets, in blocks of about BLOCK x BLOCK; a block gives one link at most
    for each partner, which is all that components need.  So neither links nor members are repeated for
    each pair.
    """
    sizes = named.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = named.join(sizes, "component").join(sketches, "rep")
    member = member.select("component", F.col("rep").alias("id"), "sketch", F.expr("cast(pmod(xxhash64(rep), blocks) as int)").alias("block"))
    a, b = (sizes.select(F.col("component").alias(c), F.col("blocks").alias(f"n{c}"), F.col("n").alias(f"m{c}")) for c in ("ca", "cb"))
    whole_pairs = wanted = saved(crossing.join(a, "ca").join(b, "cb"), "wanted")
    small = F.col("mca") * F.col("mcb") <= SMALL
    side = lambda c, x: member.select(F.col("component").alias(c), F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
    joined = wanted.filter(small).join(side("ca", "a"), "ca").join(side("cb", "b"), "cb").filter(_bits() <= most).select("a", "b")
    more = F.col("mca") >= F.col("mcb")
    wanted = wanted.filter(~small).select(F.when(more, F.col("ca")).otherwise(F.col("cb")).alias("big"), F.when(more, F.col("cb")).otherwise(F.col("ca")).alias("component"), F.when(more, F.col("nca")).otherwise(F.col("ncb")).alias("rows"), F.least("mca", "mcb").alias("m"))
    columns = wanted.groupBy("big").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("columns"))
    whole = member.select("component", "id", "sketch", "block").join(sets.select("id", "shingles"), "id")
    left = whole.withColumnRenamed("component", "big").join(columns, "big").withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    left = left.select("big", F.col("block").alias("row"), "column", F.col("big").alias("component"), "id", "sketch", "shingles", F.lit(False).alias("right"))
    right = wanted.join(columns, "big").join(whole.drop("block"), "component").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    right = right.select("big", "row", F.expr("cast(pmod(xxhash64(id), columns) as int)").alias("column"), "component", "id", "sketch", "shingles", F.lit(True).alias("right"))

    def across(group: pd.DataFrame) -> pd.DataFrame:
        return _across(group, most, percent)

    large = left.unionAll(right).groupBy("big", "row", "column").applyInPandas(across, "a long, b long")
    return joined, large.distinct(), whole_pairs  # distinct: its shuffle parts the groups' workers from those that save
