"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WordHasher, arrow_text, give_back, shingles, slices

#: Words of a seed.
SEED = 3
#: Alignment: points for equal words, other words, and a word without partner.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items and bytes of benchmark text that one block broadcasts; further items take further blocks.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"


def _hasher() -> WordHasher:
    """Words without regard to case and ASCII punctuation."""
    h = WordHasher()
    for i in range(128):
        if not chr(i).isalnum():
            h.solid[i] = False
    return h


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score, and its first and last place in words (Smith-Waterman, linear gaps)."""
    n = len(words)
    place = np.arange(n)
    score = np.zeros(n, np.int64)
    begin = place.copy()
    best = (0, 0, 0)
    for w in item:
        diagonal = np.concatenate(([0], score[:-1])) + np.where(words == w, MATCH, MISMATCH)
        from_diagonal = np.concatenate(([0], begin[:-1]))
        from_diagonal = np.where(np.concatenate(([0], score[:-1])) > 0, from_diagonal, place)
        up = score + GAP
        here = np.where(diagonal >= up, diagonal, up)
        came = np.where(diagonal >= up, from_diagonal, begin)
        here_pos = np.maximum(here, 0)
        came = np.where(here > 0, came, place)
        lifted = here_pos - GAP * place
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, place, 0))
        score, begin = run + GAP * place, came[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begin[top]), top)
    return best


def most_points(item: np.ndarray, words: np.ndarray) -> int:
    """No local alignment has more points: each aligned word gains a match at most, and costs one point at least
    if it is none of the other side's words."""
    best = []
    for x, y in ((words, item), (item, words)):
        run = np.concatenate(([0], np.cumsum(np.where(np.isin(x, y), MATCH, -1))))
        best.append(int((run - np.minimum.accumulate(run)).max()))
    return min(best)


class Items:
    """A block of benchmark items: their words, and all their n-grams, the seeds, as sorted keys with the items
    that hold them.  An item of fewer than SEED words has one seed, all its words; seeds goes by their size."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, offsets = arrow_text(pa.array(texts, pa.string()))
        words, _, _, bounds = _hasher()(data, offsets)
        self.ids, self.words, self.bounds = pa.array(ids, pa.int64()), words, bounds
        lengths = np.diff(bounds)
        self.seeds = {}
        for size in range(1, SEED + 1):
            some = np.flatnonzero(lengths == size if size < SEED else lengths >= size)
            if len(some):
                parts = [shingles(words[bounds[i] : bounds[i + 1]], np.array([0, lengths[i]]), size)[0] for i in some]
                owner = np.repeat(some, [len(x) for x in parts]).astype(np.uint64)
                pairs = np.unique(np.stack([np.concatenate(parts), owner], axis=1), axis=0)
                keys, first = np.unique(pairs[:, 0], return_index=True)
                self.seeds[size] = (keys, first, np.append(first[1:], len(pairs)), pairs[:, 1].astype(np.int64))

    def item(self, i: int) -> np.ndarray:
        return self.words[self.bounds[i] : self.bounds[i + 1]]

    def met(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, last word, item) of every seed in texts, in order of text."""
        out = []
        for size, (keys, first, last, owners) in self.seeds.items():
            grams, gb = shingles(words, bounds, size)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == grams)
            text = np.searchsorted(gb, hit, side="right") - 1
            k = at[hit]
            n = last[k] - first[k]
            place = np.repeat(hit - gb[text], n)
            which = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(text, n), place, place + size - 1, owners[which]))
        if not out:
            return (np.empty(0, np.int64),) * 4
        out = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.argsort(out[0], kind="stable")
        return tuple(x[order] for x in out)


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _passages(items: Items, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray):
    """(item, first word, last word) of stretches of a text that hold a seed of an item or several near one another."""
    order = np.lexsort((starts, owners))
    starts, ends, owners = starts[order], ends[order], owners[order]
    lengths = np.diff(items.bounds)[owners]
    new = np.ones(len(starts), bool)
    new[1:] = (owners[1:] != owners[:-1]) | (np.diff(starts) > 2 * lengths[1:])
    at = np.append(np.flatnonzero(new), len(starts))
    return zip(owners[at[:-1]].tolist(), starts[at[:-1]].tolist(), (ends[at[1:] - 1] + 1).tolist(), strict=True)


def found_in(items: Items, words: np.ndarray, bounds: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word) of the items that align with texts; an item's best one for each text."""
    out = []
    text, starts, ends, owners = items.met(words, bounds)
    cuts = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        t = int(text[x])
        own = words[bounds[t] : bounds[t + 1]]
        best: dict[int, tuple] = {}
        for i, p, q in _passages(items, starts[x:y], ends[x:y], owners[x:y]):
            item = items.item(i)
            lo, hi = max(0, p - len(item)), min(len(own), q + len(item))
            if most_points(item, own[lo:hi]) < least * MATCH * len(item):
                continue
            points, s, e = align(item, own[lo:hi])
            score = points / (MATCH * len(item))
            if score >= least and score > best.get(i, (0.0,))[0]:
                best[i] = (score, lo + s, lo + e)
        out += [(t, i, *v) for i, v in best.items()]
    return out


def _search(docs: DataFrame, items: Items, least: float) -> DataFrame:
    def run(batches):
        hasher = _hasher()
        for batch in batches:
            data, offsets = arrow_text(batch.column(1))
            ids, out = batch.column(0), []
            for a, b in slices(offsets):
                words, _, _, bounds = hasher(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += [(a + t, *found) for t, *found in found_in(items, words, bounds, least)]
            doc, item, *rest = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc, pa.int64())), items.ids.take(pa.array(item, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], ["doc_id", "item_id", "score", "first_word", "last_word"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null").mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """FOUND: a row for each document and benchmark item that align with a score of at least least.

    score is the best local alignment's points divided by those of the whole item (1: a whole copy);
    first_word and last_word are its place among the document's words.  Case and ASCII punctuation don't
    count.  All of an item's n-grams are seeds and one is enough, so what is found of a document depends on it and the
    benchmark only.  An item of fewer than SEED words is found where all its words stand together; one
    without words never.  The benchmark goes to the executors in blocks of at most BLOCK_ITEMS items and about
    BLOCK_BYTES bytes, each with one narrow pass over docs.  Null and empty texts match nothing.  Rows that
    repeat a doc_id or an item_id are judged each by itself, and the best one counts; null ids count as an
    id.  An empty table on either side gives an empty result.  Other columns are ignored.
    """
    found = None
    for items in _blocks(benchmark):
        part = _search(docs, items, least)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "last_word")).alias("m")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "m.score", (-F.col("m.f")).alias("first_word"), "m.last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text contaminated() would find; all columns stay, whatever their names.

    Each row is judged by its own text, so null and repeated doc_ids make no difference; rows with null
    or empty texts stay.  A narrow pass for each block of the benchmark, without a shuffle.
    """
    at = docs.columns.index("text")

    def clean(items: Items):
        def run(batches):
            hasher = _hasher()
            for batch in batches:
                data, offsets = arrow_text(batch.column(at))
                keep = np.ones(len(batch), bool)
                for a, b in slices(offsets):
                    words, _, _, bounds = hasher(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    keep[[a + t for t, *_ in found_in(items, words, bounds, least)]] = False
                yield batch.filter(pa.array(keep))
            give_back()

        return run

    for items in _blocks(benchmark):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
