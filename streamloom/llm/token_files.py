"""Token ids in a grammar-compressed file format with random access.

Documents go in ascending doc_id order.  A shard is a run of them with about SHARD ids, and a row of
Parquet files, written by Spark's own committer: a lost executor's half-written files are never read.
Each shard is compressed by Re-Pair: frequent pairs of neighbours are replaced by new symbols, again and
again, until no pair is frequent.  The file keeps the rules, every symbol's expansion
length, and the sequence that is left, so that any range of ids is decoded from the symbols that cover it.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, written
from .units import UnitCoder, gathered

#: Ids of a shard, about.
SHARD = 1 << 20
#: Occurrences that make a pair frequent.
LEAST = 6
#: Pairs are counted by this many slots (a power of two).
SLOT_BITS = 18
END_ID = 2

FORMAT = "part int, shard int, nulls long, doc_ids binary, ends binary, n_ids long, base int, rules binary, lengths binary, wide boolean, symbols binary"


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n x 2) and the sequence left, by Re-Pair in rounds; rule i defines symbol base + i.

    A round counts the pairs of neighbours and replaces, from the left, all that occur least times and
    more.  Pairs are counted by the slots of a hash table, a pair for each; those that share a slot wait
    for another round, whose hash differs.  A pair that was counted and is rare stays so, and is passed over
    until a neighbour is replaced.  The end is when two rounds in turn find no frequent pair.
    """
    bits = min(SLOT_BITS, max(4, int(len(ids)).bit_length()))
    rules, now, made, idle, turn = [], ids.astype(np.uint64), 0, 0, 0
    table, number = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.uint32)
    open_ = np.ones(len(ids), bool)  # whether the pair that begins here may be frequent
    open_[-1:] = False
    while idle < 2 and len(now) >= 2:
        turn += 1
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) & (2**64 - 1))
        where = np.flatnonzero(open_)
        pairs = now[where] << np.uint64(32) | now[where + 1]
        slot = (pairs * odd >> np.uint64(64 - bits)).astype(np.int32)
        table[slot] = np.arange(len(slot), dtype=np.int32)  # of several pairs in a slot, the last stands for it
        hit = np.flatnonzero(pairs[table[slot]] == pairs)
        own = slot[hit]
        often = (np.bincount(own, minlength=1 << bits) >= least)[own]
        open_[where[hit[~often]]] = False
        hit = hit[often]
        if not len(hit):
            idle += 1
            continue
        idle = 0
        at = where[hit]
        begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        within = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
        hit = hit[within % 2 == 0]  # every other one of a run of overlapping pairs
        at, own = where[hit], slot[hit]
        used = np.flatnonzero(np.bincount(own, minlength=1 << bits))
        kinds = pairs[table[used]]
        rules.append(np.stack([kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)], axis=1))
        number[used] = np.arange(base + made, base + made + len(used), dtype=np.uint32)
        now[at] = number[own]
        made += len(used)
        open_[at] = True
        open_[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(now), bool)
        keep[at + 1] = False
        now, open_ = now[keep], open_[keep]
        open_[-1:] = False
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.uint64)).astype(np.uint32), now.astype(np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule's symbol stands for; rules only use symbols of earlier ones."""
    out = np.ones(len(rules) + 1, np.int64)  # the last one stands for all ids
    parts = np.where(rules >= base, rules.astype(np.int64) - base, len(rules))
    while len(rules):
        new = out[parts].sum(axis=1)
        if (new == out[:-1]).all():
            break
        out[:-1] = new
    return out[:-1].astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: each rule is expanded once, then all symbols are looked up."""
    now = rules.astype(np.int64).ravel()
    while len(now) and now.max() >= base:
        big = now >= base
        n = 1 + big
        at = np.cumsum(n) - n
        out = np.empty(n.sum(), np.int64)
        out[at[~big]] = now[~big]
        pair = rules[now[big] - base]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        now = out
    # Every id that occurs alone follows the rules' expansions, once.
    symbols = symbols.astype(np.int64)
    big = symbols >= base
    alone, which = np.unique(symbols[~big], return_inverse=True)
    sizes = lengths.astype(np.int64)
    starts = np.empty(len(symbols), np.int64)
    starts[big] = (np.cumsum(sizes) - sizes)[symbols[big] - base]
    starts[~big] = len(now) + which
    each = np.ones(len(symbols), np.int64)
    each[big] = sizes[symbols[big] - base]
    return gathered(np.concatenate((now, alone)).astype(np.uint32), starts, each)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's symbols, rules and expansion lengths."""
    symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2").astype(np.uint32)
    return symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4")


def decode_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) of a shard, by expanding only the symbols that cover them."""
    symbols, rules, lengths = unpack(row)
    base = row["base"]
    big = symbols >= base
    sizes = np.ones(len(symbols), np.int64)
    sizes[big] = lengths[symbols[big] - base]
    ends = np.cumsum(sizes)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, stop, side="left")) + 1
    skipped = int(ends[a - 1]) if a else 0
    now = symbols[a:b].astype(np.int64)
    while len(now) and now.max() >= base:
        big = now >= base
        n = 1 + big
        at = np.cumsum(n) - n
        out = np.empty(n.sum(), np.int64)
        out[at[~big]] = now[~big]
        pair = rules[now[big] - base]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        now = out
    return now[start - skipped : stop - skipped].astype(np.uint32)


#: Characters below it are told apart by kind; a unit with another one is encoded whole.
LATIN = 0x250
LIMIT = chr(LATIN)
# White space beyond them.
WIDE_SPACES = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
VISIBLE, LETTER, NUMBER, WHITE, BEYOND = range(5)


def _kinds() -> np.ndarray:
    out = np.full(LATIN + 1, VISIBLE, np.uint8)
    out[LATIN] = BEYOND
    for c in range(LATIN):
        category = unicodedata.category(chr(c))
        if category[0] in "LN":
            out[c] = LETTER if category[0] == "L" else NUMBER
        elif category[0] == "Z" or 9 <= c <= 13 or c == 0x85:
            out[c] = WHITE
    return out


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them, for byte-level tokenizers.

    Before such a tokenizer joins anything it cuts a text: a single space between visible characters
    begins a new piece, a single line feed or other white space there is one, and a letter, number or other
    character after one of another kind begins one (but for apostrophes, which begin endings like 's).  So a text's ids are those of these pieces, and each
    distinct piece goes through the library once.  Pieces are not cut further where they have an
    apostrophe, the beginning of an added token, more white space or characters beyond LATIN.  A
    tokenizer that cuts otherwise gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.cuts = bool(plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])))
        self.kinds = _kinds()
        self.odd = np.zeros(LATIN + 1, bool)
        self.odd[[ord("'"), LATIN]] = True
        for t in spec.get("added_tokens", []):
            self.odd[min(LATIN, ord(t["content"][0]))] = True
        self.model, self.table = self.tokenizer.model, dict(enumerate(_byte_letters()))
        letters = dict.fromkeys(_byte_letters(), 1)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(1 + max(vocabulary.values()), np.int64)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        for token, i in vocabulary.items():
            self.bytes[i] = len(token.encode()) if token in added else sum(letters.get(c, 0) for c in token)
        self.coder = UnitCoder(self._starts, self._make)

    @staticmethod
    @lru_cache(1)
    def of(path: str) -> Encoder:
        """This process's encoder: a Python worker keeps its pieces from task to task."""
        return Encoder(path)

    def _starts(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            return first, first
        low = np.minimum(points, LATIN)
        kind = self.kinds[low]
        beyond = np.flatnonzero(kind == BEYOND)
        kind[beyond[np.isin(points[beyond], WIDE_SPACES)]] = WHITE
        white = kind == WHITE
        alone = white.copy()  # white space between visible characters
        alone[:1] = alone[-1:] = False
        alone[1:] &= ~white[:-1] & ~first[1:]
        alone[:-1] &= ~white[1:] & ~first[1:]
        odd = self.odd[low] | (white & ~alone)
        safe = alone | first
        safe[1:] |= alone[:-1] & (points[:-1] != 32)  # a line feed or tab is a piece of its own
        at = np.flatnonzero(safe)
        whole = np.repeat(np.logical_or.reduceat(odd, at), np.diff(at, append=len(points))) if len(at) else safe
        units = safe.copy()
        units[1:] |= (kind[1:] != kind[:-1]) & ~white[:-1] & ~whole[1:]
        return units, safe

    def _make(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and how many each has."""
        if not self.cuts:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            return np.asarray([i for x in ids for i in x], np.uint32), np.asarray([len(x) for x in ids], np.int64)
        # A word of letters is one piece: the library's model alone gives its ids, in half the time.
        tokenize, table, space = self.model.tokenize, self.table, self.table[32]
        sizes, word_ids, others = np.zeros(len(units), np.int64), [], []
        for i, u in enumerate(units):
            spaced = u[0] == " "
            if not (u[1:] if spaced else u).isalpha():
                others.append(i)
                continue
            if u.isascii():
                found = [t.id for t in tokenize(space + u[1:] if spaced else u)]
            elif max(u) < LIMIT:
                found = [t.id for t in tokenize(u.encode().decode("latin-1").translate(table))]
            else:
                others.append(i)
                continue
            word_ids += found
            sizes[i] = len(found)
        ids = np.asarray(word_ids, np.uint32)
        if not others:
            return ids, sizes
        more, lengths = self._pieces([units[i] for i in others])
        words = sizes > 0
        sizes[others] = lengths
        starts = np.empty(len(units), np.int64)
        starts[words] = np.cumsum(sizes[words]) - sizes[words]
        starts[others] = len(ids) + np.cumsum(lengths) - lengths
        return gathered(np.concatenate((ids, more)), starts, sizes), sizes

    def _pieces(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units by the whole tokenizer; where one ends in the ids of all is told by their bytes."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([units], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        at = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(u.encode()) for u in units]), side="left") + 1
        if at[-1] != len(ids):
            raise ValueError("a token of unknown length")
        return ids, np.diff(at, prepend=0)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one after another, and the n + 1 bounds of each text's."""
        return self.coder([t or "" for t in texts])


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID, partitions: int | None = None, target: str | None = None) -> DataFrame:
    """The files of docs' token ids, in ascending doc_id order, as a DataFrame of FORMAT that reads them.

    Every text (null: empty) is encoded whole with the tokenizer file at path, without special tokens, and
    end_id is appended.  Rows are dealt by ranges of doc_id, then of their text's hash, so a doc_id that
    many rows share is spread; null doc_ids come first, and rows with the same doc_id and text tie in any
    order.  An empty table gives no shard.  Other columns are ignored.  target: the folder to write to;
    without one, a folder that goes when the application ends.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.col("tie"), F.col("place")]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)

    def run(batches):
        encode = Encoder.of(path)
        base = len(encode.bytes)
        part, shard = TaskContext.get().partitionId(), 0
        ids, pieces, counts, size = [], [], [], 0

        def pack():
            whole, ends = np.concatenate(pieces), np.cumsum(np.concatenate(counts))
            docs = pa.chunked_array(ids).combine_chunks()
            known = docs.drop_null().to_numpy().astype("<i8")
            rules, left = compress(whole, base)
            wide = bool(len(left) and left.max() > 0xFFFF)
            row = [part, shard, docs.null_count, known.tobytes(), ends.astype("<i8").tobytes(), len(whole), base, rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), wide, left.astype("<u4" if wide else "<u2").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            names = [c.split()[0] for c in FORMAT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                found, bounds = encode(some.column(1).to_pylist())
                n = np.diff(bounds) + 1
                out = np.full(int(n.sum()), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[np.cumsum(n) - 1] = False
                out[keep] = found
                ids.append(some.column(0))
                pieces.append(out)
                counts.append(n)
                size += len(out)
                if size >= SHARD:
                    yield pack()
                    ids, pieces, counts, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield pack()
        give_back()

    shards = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, FORMAT)
    if not target:
        return written(shards, "tokens")
    shards.write.parquet(target)
    return docs.sparkSession.read.schema(FORMAT).parquet(target)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in files."""
    # A row for each part, that is for each partition that wrote: few, whatever the number of documents.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "shard", "n_ids").withColumn("inner", F.coalesce(inner, F.lit(0))).join(parts, "part").select("part", "shard", (F.col("inner") + F.col("part_start")).alias("shard_start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, rules, lengths = unpack(row)
                ids = expand(symbols, rules, row["base"], lengths).astype("<u4")
                known, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["ends"], "<i8")
                docs = pa.concat_arrays([pa.nulls(row["nulls"], pa.int64()), pa.array(known, pa.int64())])
                begins = np.concatenate(([0], ends[:-1]))
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(np.full(len(docs), row["part"], np.int32)), pa.array(np.full(len(docs), row["shard"], np.int32)), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "shard", "begin", "n_tokens", "ids_crc32"],
                )

    each = files.mapInArrow(run, "doc_id long, part int, shard int, begin long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["part", "shard"]).select("doc_id", (F.col("begin") + F.col("shard_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")
