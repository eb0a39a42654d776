"""SentencePiece encoding and decoding by a Viterbi search shared between words with common prefixes."""

from __future__ import annotations

import gc
import re
import zlib
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_text, give_back, slices
from .units import UnitCoder, gathered

MARK = "▁"
#: Boundaries of pieces that a worker keeps.
CACHE = 200_000
#: Places of the table of character pairs, as a power of two.
PAIR_BITS = 20
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


@contextmanager
def _uncollected():
    """No garbage collection: it would look through very many short lists again and again."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


class Model:
    """The pieces and scores of a SentencePiece model file, and a search for the best segmentation.

    For a unigram model the best segmentation has the greatest sum of piece scores; of equal ones the longest
    last piece wins.  For a BPE model a sum of scores would not give the model's own ids: there a path
    counts only if all its neighbouring pieces are what merging their text gives, and the one such path
    is the model's segmentation.  Both are forward searches over a word's prefixes.

    A character in no piece becomes its bytes' pieces, or the unknown piece if the model has no bytes; in a
    unigram search it counts ten less than the least score.

    Between two characters that stand next to one another in no piece, no piece can reach over, so words
    are also cut there: the best segmentation of the whole is that of the parts.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and marked word starts are supported")
        self.bpe = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.joins: dict[tuple[str, str], bool] = {}
        self.made: dict[str, tuple[str, str] | None] = {}
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in m.pieces]
        self.scores, self.ids, self.bytes, self.unknown = {}, {}, {}, 0
        least = 0.0
        for i, p in enumerate(m.pieces):
            if p.type in (NORMAL, USER, UNUSED):
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                least = min(least, p.score)
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("pieces that reach over words are not supported")
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
            elif p.type == UNKNOWN:
                self.unknown = i
        self.lost = least - 10
        self.begins = {p[:i] for p in self.scores for i in range(1, len(p) + 1)}
        self.near = np.zeros(1 << PAIR_BITS, bool)
        pairs = {(ord(a), ord(b)) for p in self.scores for a, b in zip(p.replace(MARK, " "), p.replace(MARK, " ")[1:], strict=False)}
        if pairs:
            left, right = np.array(sorted(pairs), np.uint32).T
            self.near[self._pair(left, right)] = True
        self.plain = [b"" if p.type not in (NORMAL, USER, UNUSED) else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        for b, i in self.bytes.items():
            self.plain[i] = bytes([b])
        self.plain[self.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(p) for p in self.plain], np.int64)
        self.places, self.letters = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.plain), np.uint8)

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def starts(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a piece can only begin: at a text's beginning and between characters that no piece joins."""
        out = first.copy()
        out[1:] |= ~self.near[self._pair(points[:-1], points[1:])]
        return out, out

    def make(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, and how many each has."""
        marked = [u.replace(" ", MARK) for u in units]
        found = self.search(marked)
        ids = [found[u] for u in marked]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def normalise(self, text: str) -> str:
        """The text as it is encoded, with spaces for marks."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return " " + text if self.dummy and text else text

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose joining makes piece, None for a character, ("", "") if merging never makes it."""
        found = self.made.get(piece, 0)
        if found == 0:
            found = None
            if len(piece) > 1:
                parts, scores = list(piece), self.scores
                while len(parts) > 2:
                    options = [(-s, i) for i in range(len(parts) - 1) if (s := scores.get(parts[i] + parts[i + 1])) is not None]
                    if not options:
                        break
                    i = min(options)[1]
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                found = (parts[0], parts[1]) if len(parts) == 2 and piece in scores else ("", "")
            self.made[piece] = found
        return found

    def joined(self, left: str, right: str) -> bool:
        """Whether merging keeps the pieces left and right apart.

        The joins that made them are undone, the last one first (of equal ones the right one, as merging goes
        from the left); before each, the two pieces at the boundary must not have joined earlier.
        """
        key = (left, right)
        found = self.joins.get(key)
        if found is not None:
            return found
        scores, bound, apart = self.scores, -np.inf, True
        while True:
            score = scores.get(left + right)
            if score is not None and score > bound:
                apart = False
                break
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                break
            if b is None or (a is not None and scores[left] < scores[right]):
                bound, left = scores[left], a[1]
            else:
                bound, right = np.nextafter(scores[right], -np.inf), b[0]
        if len(self.joins) >= CACHE:
            self.joins.clear()
        self.joins[key] = apart
        return apart

    def _merging(self, word: str, end: int, live: list[int], last: list[str]) -> int:
        """Where the last piece of word[:end] starts, from the last pieces of its prefixes."""
        scores, joins = self.scores, self.joins
        for start in live[:-1]:
            piece = word[start:end]
            if piece in scores and self.halves(piece) != ("", ""):
                if not start:
                    return start
                apart = joins.get((last[start], piece))
                if self.joined(last[start], piece) if apart is None else apart:
                    return start
        return end - 1

    def _summing(self, word: str, end: int, live: list[int], best: list[float]) -> int:
        """Where the last piece of word[:end] starts; its score is appended to best."""
        scores, top, where = self.scores, -np.inf, -1
        for start in live:
            score = scores.get(word[start:end])
            if score is not None and best[start] + score > top:
                top, where = best[start] + score, start
        if word[end - 1] not in scores and best[end - 1] + self.lost > top:
            top, where = best[end - 1] + self.lost, end - 1
        best.append(top)
        return where

    def search(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words: sorted, they are the leaves of a trie in depth-first order.

        The forward state of a prefix is computed at its first word and kept for the next words while they
        share it: the last piece of its segmentation and where that starts, its score, and the places from
        which a piece may still go on.
        """
        out: dict[str, list[int]] = {}
        best, last, back, before = [0.0], [""], [0], ""
        lives: list[list[int]] = [[]]
        begins, step = self.begins, self._merging if self.bpe else self._summing
        state = last if self.bpe else best
        with _uncollected():
            for word in sorted(words):
                shared, most = 0, min(len(before), len(word))
                while shared < most and before[shared] == word[shared]:
                    shared += 1
                del best[shared + 1 :], back[shared + 1 :], last[shared + 1 :], lives[shared + 1 :]
                for end in range(shared + 1, len(word) + 1):
                    live = [s for s in lives[-1] if word[s:end] in begins]
                    live.append(end - 1)
                    lives.append(live)
                    start = step(word, end, live, state)
                    back.append(start)
                    last.append(word[start:end])
                before = word
                out[word] = self._path(word, back, last)
        return out

    def _path(self, word: str, back: list[int], last: list[str]) -> list[int]:
        """The ids of a word's segmentation, from the last piece to the first."""
        ids, end = [], len(word)
        while end:
            piece, end = last[end], back[end]
            own = self.ids.get(piece)
            if own is not None:
                ids.append(own)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(piece.encode())]
            else:
                ids.append(self.unknown)
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of many texts, one after another, and where each begins and ends in them; the space that
        was put before a text is passed over."""
        sizes = self.sizes[ids]
        data = gathered(self.letters, self.places[ids], sizes)
        at = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        begins, ends = at[:-1].copy(), at[1:]
        if self.dummy:
            some = np.flatnonzero(ends > begins)
            begins[some] += data[begins[some]] == 32
        return data, begins, ends


@lru_cache(2)
def _model(path: str) -> Model:
    return Model(path)


class Coder:
    """Ids of texts: each distinct unit is searched once, the new ones of a window together."""

    def __init__(self, path: str):
        self.model = _model(path)
        self.coder = UnitCoder(self.model.starts, self.model.make)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The normalised texts, the ids of all of them, and the n + 1 bounds of each one's."""
        normal = [self.model.normalise(t) if t else "" for t in texts]
        return normal, *self.coder(normal)

    def close(self) -> None:
        """Forget the boundaries met: a task's own words repeat, another's gain next to nothing."""
        self.model.joins.clear()
        give_back()


def _text_column(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Strings of stretches of data, null where empty; bytes that aren't UTF-8 are replaced."""
    lengths = ends - begins
    whole = gathered(data, begins, lengths)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if offsets[-1] < 2**31:
        valid = pa.array(~empty).buffers()[1] if len(empty) else None
        out = pa.Array.from_buffers(pa.string(), len(lengths), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole)])
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            pass
    raw = whole.tobytes()
    return pa.array([None if e else raw[a:b].decode("utf-8", "replace") for a, b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), empty.tolist(), strict=True)], pa.string())


def _parts(batch: pa.RecordBatch, at: int):
    """A batch in parts of bounded text."""
    _, offsets = arrow_text(batch.column(at))
    for a, b in slices(offsets):
        yield batch.slice(a, b - a)


def encode_pieces(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """docs with piece_ids (array of int, null where text is null, empty where it is empty) added.

    Whole texts, one narrow pass; rows that repeat are encoded alike and an empty table gives one.  Extra
    white space goes first where the model says so.  An existing column piece_ids is replaced, and with
    decoded one named piece_text; all others stay.  decoded: piece_text, what decode_pieces gives, is
    added by the same workers.
    """
    docs = docs.drop("piece_ids", *["piece_text"][: int(decoded)])
    at = docs.columns.index("text")
    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_text", T.StringType())][: 1 + decoded]
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches):
        coder = Coder(path)
        for batch in batches:
            for part in _parts(batch, at):
                texts = part.column(at).to_pylist()
                _, ids, bounds = coder(texts)
                empty = np.asarray([t is None for t in texts], bool)
                offsets = pa.array(bounds.astype(np.int32), mask=np.append(empty, False))
                new = [pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))]
                if decoded:
                    new.append(_text_column(*coder.model.decode_all(ids, bounds), empty))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)
        coder.close()

    return docs.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, path: str) -> DataFrame:
    """rows with piece_text, what piece_ids stand for (null where they are null), added; an existing column
    piece_text is replaced.  Bytes that aren't UTF-8 become the replacement character."""
    rows = rows.drop("piece_text")
    at = rows.columns.index("piece_ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("piece_text", T.StringType())])

    def run(batches):
        model = _model(path)
        for batch in batches:
            column = batch.column(at)
            empty = np.asarray(column.is_null())
            lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
            ids = np.asarray(column.flatten(), np.int64)
            text = _text_column(*model.decode_all(ids, np.concatenate(([0], np.cumsum(lengths)))), empty)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "piece_text"])

    return rows.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers), decoded_crc32 and
    round_trip (whether decoding the ids gives the normalised text) of every row, repeated ones too; null
    counts as empty.  Other columns are ignored."""

    def run(batches):
        coder = Coder(path)
        for batch in batches:
            for part in _parts(batch, 1):
                normal, ids, bounds = coder(part.column(1).to_pylist())
                data, begins, ends = coder.model.decode_all(ids, bounds)
                view, back = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                skip = int(coder.model.dummy)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                texts = [back[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                same = [t == n[skip:].encode() for t, n in zip(texts, normal, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"],
                )
        coder.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
