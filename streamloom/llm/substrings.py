"""Suffix-array dedup: all long strings that occur more than once, with all their occurrences.

Sorting every suffix of a corpus isn't needed.  Every window of SEEN bytes picks the k-gram of least
hash in it as its anchor, so equal windows have equal anchors at equal places, and each anchor that two
windows share gathers its occurrences.  For each anchor an enhanced suffix array (suffixes that start at
the anchor's occurrences, with longest common prefixes) is scanned with a stack; each interval of the
common-prefix tree is tested for the diversity of what stands on its left, which gives the maximal repeats
through the anchor as groups of all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_BYTES, arrow_text, give_back, mix, powers, slices, written

#: Bytes of an anchor, and of the windows that have one each: repeats of at least SEEN bytes are seen.
GRAM, SEEN = 48, 256
#: Occurrences of one anchor that one task takes; beyond that its different contexts' windows are counted by key.
MOST = 50_000
#: Occurrences that make an anchor frequent, at least; and how many frequent anchors there are at most, by that or
#: a greater bound.  Their few rows go to all tasks, instead of all their occurrences to one.
OFTEN, OFTEN_ANCHORS = 10_000, 500_000
#: Different contexts of an anchor up to which Python lists are quicker than arrays.
FEW = 24


class Anchors:
    """Anchors of all windows of length bytes of many texts at once."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        rng = np.random.Generator(np.random.PCG64(3))
        self.codes = rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.up = 0x9E3779B97F4A7C15, np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = powers(self.base, 2 * n), powers(pow(self.base, -1, 2**64), 2 * n)

    def grams(self, data: np.ndarray, gram: int) -> np.ndarray:
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.down[:n], out=sums[1:])
        return mix((sums[gram:] - sums[: n - gram + 1]) * self.up[: n - gram + 1])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors, and their hashes; a long text goes in parts that share windows' bytes."""
        if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
            return self._some(data, offsets)
        found = []
        for at in range(0, len(data), SLICE_BYTES):
            part = data[at : at + SLICE_BYTES + self.length - 1]
            places, hashes = self._some(part, np.array([0, len(part)]))
            found.append((places + at, hashes))
        places, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        places, first = np.unique(places, return_index=True)
        return places, hashes[first]

    def _some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        hashes = self.grams(data, self.gram)
        w, bits = self.length - self.gram + 1, max(1, int(n).bit_length())
        packed = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(hashes), dtype=np.uint64)
        # Minima of all windows of w values, from prefix and suffix minima of chunks of w.
        pad = -len(packed) % w
        chunks = np.concatenate((packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
        ahead = np.minimum.accumulate(chunks, axis=1).ravel()
        back = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - self.length + 1
        least = np.minimum(back[:count], ahead[w - 1 : w - 1 + count])
        doc = np.searchsorted(offsets, np.arange(count), side="right")
        inside = np.arange(count) + self.length <= offsets[np.minimum(doc, len(offsets) - 1)]
        places = np.unique((least[inside] & np.uint64((1 << bits) - 1)).astype(np.int64))
        return places, hashes[places]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of all intervals of the common-prefix tree, by a scan with a stack.

    lcp[i] is the common prefix of suffixes i and i + 1.  Intervals have two suffixes at least.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] >= value:
            top, begun = stack.pop()
            first = begun
            if top > value:
                yield top, begun, i
        if value >= 0:
            stack.append((value, first))


def repeats(lefts: Sequence[bytes], rights: Sequence[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, occurrences) of the maximal repeats through one anchor of at least least bytes.

    rights are the texts from the anchor on, lefts those before it, reversed.  Every group has all the
    occurrences that share left bytes before the anchor and right bytes from it on; beyond, two of them
    at least differ on either side.
    """
    n = len(rights)
    if n == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        if left + right >= least:
            yield left, right, [0, 1]
        return
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [common_prefix(rights[order[i]], rights[order[i + 1]]) for i in range(n - 1)]
    place = {x: i for i, x in enumerate(sorted(range(n), key=lefts.__getitem__))}
    rank = {x: i for i, x in enumerate(order)}
    for right, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=place.__getitem__)
        shares = [common_prefix(lefts[members[i]], lefts[members[i + 1]]) for i in range(len(members) - 1)]
        for left, a, b in intervals(shares):
            if left + right >= least:
                group = members[a : b + 1]
                if len(group) == len(members) or min(lcp[min(map(rank.get, group)) : max(map(rank.get, group))]) == right:
                    yield left, right, group


class LeftTree:
    """The texts before an anchor's occurrences in sorted order, and the common prefix of any two of them."""

    def __init__(self, lefts: Sequence[bytes]):
        n = len(lefts)
        order = sorted(range(n), key=lefts.__getitem__)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        level = np.fromiter((common_prefix(lefts[order[i]], lefts[order[i + 1]]) for i in range(n - 1)), np.int64, n - 1)
        self.levels = [level]
        while 1 << len(self.levels) < n:
            level, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(level[:-half], level[half:]))

    def shares(self, ranks: np.ndarray) -> np.ndarray:
        """The common prefix of each two neighbours of ascending ranks: the least between them."""
        a, b = ranks[:-1], ranks[1:] - 1
        out = np.empty(len(a), np.int64)
        level = np.frexp(b - a + 1)[1] - 1
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.levels[k][a[some]], self.levels[k][b[some] - (1 << int(k)) + 1])
        return out


def covered(lefts: Sequence[bytes], rights: Sequence[bytes], least: int) -> tuple[list[set[tuple[int, int]]], list[int]]:
    """For every occurrence the stretches (bytes before, bytes from the anchor on) that the groups it is in
    cover, and the occurrences of its largest group.

    Few occurrences go through repeats().  Of many, each interval's members are taken in the order of
    what stands on their left; where neighbours share too little the groups of all occurrences of a
    repeat of least bytes part; within one, a member's deepest group is what it shares with its nearer
    neighbour.  What doesn't cover more than a longer repeat did before is passed over.
    """
    n = len(rights)
    out: list[set[tuple[int, int]]] = [set() for _ in rights]
    size = [1] * n
    if n <= FEW:
        for left, right, group in repeats(lefts, rights, least):
            for z in group:
                out[z].add((left, right))
                size[z] = max(size[z], len(group))
        return out, size
    order = sorted(range(n), key=rights.__getitem__)
    tree = LeftTree(lefts)
    ranks = tree.rank[order]
    of_rank = np.empty(n, np.int64)
    of_rank[tree.rank] = np.arange(n)
    best, most = np.full(n, -1), np.ones(n, np.int64)
    for right, first, last in intervals([common_prefix(rights[order[i]], rights[order[i + 1]]) for i in range(n - 1)]):
        members = np.sort(ranks[first : last + 1])
        shares = tree.shares(members)
        group = np.concatenate(([0], np.cumsum(shares < least - right)))
        count = np.bincount(group)[group]
        left = np.maximum(np.append(shares, -1), np.concatenate(([-1], shares)))
        most[members] = np.maximum(most[members], count)
        for k in np.flatnonzero((count > 1) & (left > best[members])).tolist():
            out[of_rank[members[k]]].add((int(left[k]), right))
        best[members] = np.where(count > 1, np.maximum(best[members], left), best[members])
    for z in range(n):
        size[z] = int(most[tree.rank[z]])
    return out, size


def in_anchor(befores: Sequence[bytes], afters: Sequence[bytes], least: int) -> list[tuple[int, set[tuple[int, int]], int]]:
    """(occurrence, its stretches, the size of its largest group) of one anchor's occurrences that repeat.

    Occurrences with the same bytes all around are one to the tree, of their number.
    """
    if len(afters) == 2:
        return [(i, {(x, y)}, 2) for x, y, group in repeats(befores, afters, least) for i in group]
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for i, context in enumerate(zip(befores, afters, strict=True)):
        same.setdefault(context, []).append(i)
    lefts, rights = zip(*same, strict=True)
    found, sizes = covered(lefts, rights, least) if len(same) > 1 else ([set()], [1])
    out = []
    for (left, right), rows, spans, size in zip(same, same.values(), found, sizes, strict=True):
        if len(rows) > 1 and len(left) + len(right) >= least:
            spans = {(len(left), len(right))}
            size = max(size, len(rows))
        if spans:
            out += [(i, spans, size) for i in rows]
    return out


def _anchored(docs: DataFrame, seen: int) -> DataFrame:
    """(h, d, k, at): every anchor's hash and place."""

    def run(batches):
        find = Anchors(seen)
        for batch in batches:
            data, offsets = arrow_text(batch.column(2))
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                places, hashes = find(data[offsets[a] : offsets[b]], own)
                doc = np.searchsorted(own, places, side="right") - 1
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *(batch.column(i).slice(a, b - a).take(at) for i in (0, 1)), pa.array((places - own[doc]).astype(np.int64))], ["h", "d", "k", "at"])
        give_back()

    return docs.select("d", "k", "bytes").mapInArrow(run, "h long, d long, k long, at long")


CONTEXT = "h long, d long, k long, at long, before binary, after binary"


def _contexts(rows: DataFrame, seen: int, length: int) -> DataFrame:
    """CONTEXT: the bytes around every wanted anchor of (d, k, bytes, anchors), those before it reversed."""
    reach = seen - min(GRAM, seen)

    def run(batches):
        for batch in batches:
            for d, k, blob, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                h, at = anchors.values.field("h"), anchors.values.field("at").to_numpy()
                for i in range(0, len(at), 2000):
                    part = at[i : i + 2000].tolist()
                    before = [blob[max(0, p - reach) : p][::-1] for p in part]
                    after = [blob[p : p + length] for p in part]
                    own = [pa.array([x] * len(part), pa.int64()) for x in (d, k)]
                    yield pa.RecordBatch.from_arrays([h.slice(i, len(part)), *own, pa.array(part, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], [c.split()[0] for c in CONTEXT.split(", ")])

    return rows.select("d", "k", "bytes", "anchors").mapInArrow(run, CONTEXT)


SPANS = "d long, k long, a long, b long, n long"


def _spans_in_tasks(contexts: DataFrame, seen: int) -> DataFrame:
    """SPANS: stretches a to b of repeats, in groups of n; anchors come sorted, so a task holds one at a time."""

    def group(rows) -> list[tuple[int, int, int, int, int]]:
        if len(rows) < 2:
            return []
        return [(rows[i][0], rows[i][1], rows[i][2] - x, rows[i][2] + y, n) for i, spans, n in in_anchor([r[3] for r in rows], [r[4] for r in rows], seen) for x, y in spans]

    def run(batches):
        now, rows = None, []

        def emit(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in SPANS.split(", ")])

        for batch in batches:
            out = []
            for h, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != now:
                    out += group(rows)
                    now, rows = h, []
                rows.append(row)
            yield emit(out)
        yield emit(group(rows))
        give_back()

    return contexts.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(run, SPANS)


def _spans_by_key(contexts: DataFrame, seen: int, length: int) -> DataFrame:
    """SPANS of anchors with very many occurrences: equal contexts become one with their number, before the
    shuffle, and the others' windows of seen and of length bytes meet by key, numbers summed."""
    contexts = written(contexts.withColumns({"c1": F.xxhash64("before", "after"), "c2": F.xxhash64(F.lit(1), "before", "after")}), "hot")
    kinds = contexts.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"))
    kinds = written(kinds, "kinds")

    def run(batches):
        for batch in batches:
            for h, c1, c2, n, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, out = before[::-1] + after, []
                for size in {seen, length}:
                    out += [(h, c1, c2, n, size, i - len(before), hashlib.blake2b(whole[i : i + size], digest_size=16).digest()) for i in range(min(len(before), len(whole) - size) + 1)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "c1", "c2", "n", "size", "from", "key"])

    windows = written(kinds.select("h", "c1", "c2", "n", "before", "after").mapInArrow(run, "h long, c1 long, c2 long, n long, size int, from long, key binary"), "windows")
    again = written(windows.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1"), "again")
    # Neighbouring windows make one stretch; those of each size by themselves.
    found = windows.join(again, "key").groupBy("h", "c1", "c2", "size").agg(F.sort_array(F.collect_set("from")).alias("f"), F.max("times").alias("times"))
    begins = F.filter("f", lambda x, i: (i == 0) | (F.get("f", i - 1) < x - 1))
    ends = F.filter("f", lambda x, i: (i == F.size("f") - 1) | (F.get("f", i + 1) > x + 1))
    found = found.select("h", "c1", "c2", "size", "times", F.explode(F.arrays_zip(begins.alias("x"), ends.alias("y"))).alias("s"))
    out = contexts.select("h", "c1", "c2", "d", "k", "at").join(found, ["h", "c1", "c2"])
    return out.select("d", "k", (F.col("at") + F.col("s.x")).alias("a"), (F.col("at") + F.col("s.y") + F.col("size")).alias("b"), F.col("times").alias("n"))


def _whole_words(blob: bytes, a: int, b: int) -> int:
    """How many whole words (between white space) blob[a:b] has."""
    blank = b" \t\n\v\f\r"
    n = len(blob[a:b].split())
    if n and a and blob[a - 1] not in blank and blob[a] not in blank:
        n -= 1
    if n and b < len(blob) and blob[b] not in blank and blob[b - 1] not in blank:
        n -= 1
    return n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


CUT = "d long, k long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_group long"


def _cut(rows: DataFrame, length: int, words: int) -> DataFrame:
    """CUT of (d, k, bytes, spans)."""

    def run(batches):
        for batch in batches:
            out = []
            for d, k, blob, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, at = hashlib.sha256(), 0
                runs = _merged([(s["a"], s["b"]) for s in spans if s["b"] - s["a"] >= length])
                for a, b in runs:
                    kept.update(blob[at:a])
                    at = b
                kept.update(blob[at:])
                passages = _merged([s for s in {*runs, *((s["a"], s["b"]) for s in spans)} if _whole_words(blob, *s) > words])
                out.append((d, k, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), len(passages), max(s["n"] for s in spans)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in CUT.split(", ")])
        give_back()

    return rows.select("d", "k", "bytes", "spans").mapInArrow(run, CUT)


def _shared(anchors: DataFrame, often: int) -> DataFrame:
    """(d, k, h, at, n) of the anchors that occur n times, more than once.

    The rows of frequent anchors, a bounded number, are broadcast; the others' are joined by h.
    """
    counts = written(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(often, total // OFTEN_ANCHORS)
    frequent = F.broadcast(counts.filter(F.col("n") > bound))
    rest = anchors.join(frequent.select("h"), "h", "left_anti").join(counts.filter(F.col("n") <= bound), "h")
    return rest.unionByName(anchors.join(frequent, "h")).select("d", "k", "h", "at", "n")


def remove_repeats(docs: DataFrame, length: int = 400, most: int = MOST, words: int = 50, seen: int = SEEN, often: int = OFTEN) -> DataFrame:
    """What is left of every document without the bytes of repeated strings of length bytes.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in the same or
    another document; strings are judged on the input.  Returns doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs) and kept_sha256, a row for each row of docs; and n_passages (runs of removed
    bytes or of a repeat of at least seen bytes, which may be less than length, with over words whole words), repeated
    (whether there is any) and n_group (occurrences of the repeat of at least seen bytes that has most of
    them; 0 without one).  Null counts as empty; texts shorter than seen keep everything.  Rows are judged by
    their texts, so null and repeated doc_ids make no difference; an empty table gives an empty result.
    Other columns are ignored, whatever their names.

    Whole copies of one text, told by their length and 128 bits of hash, go entirely and only those of the
    smallest doc_id are searched, so copies don't gather.  Only anchors that occur twice are read again,
    with the text around them.  An anchor with more than most occurrences takes the way by keys.
    """
    seen = min(seen, length)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("bytes"))
    # A row is found again by d, its doc_id, and k, a hash of its text.
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("bytes").alias("k"), "bytes")
    n_words = F.size(F.array_remove(F.split(F.col("bytes").cast("string"), r"[\x20\x09-\x0D]+"), ""))
    meta = base.select("doc_id", "d", "k", F.octet_length("bytes").cast("long").alias("n_bytes"), F.xxhash64(F.lit(1), "bytes").alias("k2"), F.sha2("bytes", 256).alias("sha"), (n_words > words).alias("wordy"))
    meta = written(meta, "meta")
    copies = meta.filter(F.col("n_bytes") >= seen).groupBy("n_bytes", "k", "k2").agg(F.min("d").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    copied = written(meta.select("d", "n_bytes", "k", "k2").join(copies, ["n_bytes", "k", "k2"]).select("d", "k", "rep", "copies").distinct(), "copied")
    later = copied.filter("d <> rep").select("d", "k")
    anchors = written(_anchored(base, seen), "anchors").join(later, ["d", "k"], "left_anti")
    wanted = _shared(anchors, often)
    wanted = written(wanted.groupBy("d", "k").agg(F.collect_list(F.struct("h", "at", "n")).alias("anchors")), "wanted")
    read = written(base.select("d", "k", "bytes").join(wanted, ["d", "k"]), "read")
    pick = lambda test: read.select("d", "k", "bytes", F.filter("anchors", test).alias("anchors")).filter(F.size("anchors") > 0)
    spans = _spans_in_tasks(_contexts(pick(lambda x: x["n"] <= most), seen, length), seen)
    if wanted.filter(F.exists("anchors", lambda x: x["n"] > most)).take(1):
        spans = spans.unionAll(_spans_by_key(_contexts(pick(lambda x: x["n"] > most), seen, length), seen, length))
    spans = written(spans.groupBy("d", "k").agg(F.collect_set(F.struct("a", "b", "n")).alias("spans")), "spans")
    cut = written(_cut(read.select("d", "k", "bytes").join(spans, ["d", "k"]), length, words), "cut").dropDuplicates(["d", "k"])
    out = meta.join(cut, ["d", "k"], "left").join(copied.drop("rep"), ["d", "k"], "left")
    copy = F.col("copies").isNotNull()
    whole = copy & (F.col("n_bytes") >= length)
    passages = F.when(copy & F.col("wordy"), F.lit(1)).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        passages.alias("n_passages"),
        (passages > 0).alias("repeated"),
        F.greatest(F.coalesce("copies", F.lit(0)), F.coalesce("n_group", F.lit(0))).cast("long").alias("n_group"),
    )
