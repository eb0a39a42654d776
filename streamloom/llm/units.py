"""Ids of texts by their distinct units: NumPy finds the units, and each new one is encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from .common import mix, powers

#: Characters whose units are looked up at once.
WINDOW = 1 << 18
#: Characters below it have codes from a table; those beyond are mixed.
TABLE = 1 << 12


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class UnitCoder:
    """Ids of whole texts, as the ids of their units.

    starts(points, first) marks where units begin (first marks the beginnings of texts), and which of
    these don't depend on what is more than a character away.  make encodes a list of units: their ids, one
    after another, and how many each has.  Units are known by 64-bit hashes, in a table with one place for
    each hash's leading bits, where a new unit replaces an old one: memory is bounded, and what is
    forgotten is encoded again.
    """

    #: Places of the table, as a power of two, and ids that are kept before those of replaced units go.
    BITS, KEEP = 20, 1 << 22

    def __init__(self, starts: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.starts, self.make = starts, make
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.at = np.zeros(1 << self.BITS, np.int32)
        self.sizes = np.zeros(1 << self.BITS, np.int32)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        rng = np.random.Generator(np.random.PCG64(5))
        self.codes = rng.integers(1, 2**63, TABLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)

    def _hashes(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(points)
        if n >= len(self.up):
            self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, 2**64), n)
        codes = self.codes[np.minimum(points, TABLE - 1)]
        rare = np.flatnonzero(points >= TABLE)
        codes[rare] = mix(points[rare].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        codes *= self.down[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        return mix((sums[ends] - sums[begins]) * self.up[begins]) | np.uint64(1)

    def _add(self, ids: np.ndarray) -> int:
        """Keep ids; where they begin."""
        if self.used + len(ids) > self.KEEP and self.used:
            live = np.flatnonzero(self.keys)
            flat = gathered(self.flat, self.at[live].astype(np.int64), self.sizes[live].astype(np.int64))
            if len(flat) > self.KEEP // 2:
                self.keys[:], flat = 0, flat[:0]
            else:
                self.at[live] = np.cumsum(self.sizes[live]) - self.sizes[live]
            self.flat, self.used = flat.copy(), len(flat)
        if self.used + len(ids) > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), self.used + len(ids)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        first = self.used
        self.flat[first : first + len(ids)] = ids
        self.used += len(ids)
        return first

    def _window(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are joined in text, and how many each has."""
        points = code_points(text)
        first = np.zeros(len(points) + 1, bool)
        first[bounds] = True
        first = first[:-1]
        begins = np.flatnonzero(self.starts(points, first)[0])
        ends = np.append(begins[1:], len(points))
        hashes = self._hashes(points, begins, ends)
        place = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        lost = np.flatnonzero(self.keys[place] != hashes)
        if len(lost):
            keys, k, which = np.unique(hashes[lost], return_index=True, return_inverse=True)
            some = lost[k]
            ids, sizes = self.make([text[a:b] for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)])
            at = self._add(ids) + np.cumsum(sizes) - sizes
            lost = np.flatnonzero(self.keys[place] != hashes) if not self.keys.any() else lost
            if len(lost) != len(which):  # the table was emptied to make room
                return self._window(text, bounds)
        starts, lengths = self.at[place].astype(np.int64), self.sizes[place].astype(np.int64)
        if len(lost):
            starts[lost], lengths[lost] = at[which], sizes[which]
            there = place[some]
            self.keys[there], self.at[there], self.sizes[there] = keys, at, sizes
        before = np.concatenate(([0], np.cumsum(lengths)))
        return gathered(self.flat, starts, lengths), np.diff(before[np.searchsorted(begins, bounds)])

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that begin with a unit; a unit of any length is kept whole."""
        at, size = 0, WINDOW
        while at < len(text):
            part = text[at : at + size]
            if at + size < len(text):
                points = code_points(part)
                first = np.zeros(len(points), bool)
                first[0] = True
                safe = np.flatnonzero(self.starts(points, first)[1][:-1])
                if not len(safe) or not safe[-1]:
                    size *= 2
                    continue
                part = part[: safe[-1]]
            yield part
            at, size = at + len(part), WINDOW

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the n + 1 bounds of each text's."""
        counts, out, k = np.zeros(len(texts), np.int64), [], 0
        while k < len(texts):
            last, size = k, 0
            while last < len(texts) and (last == k or size + len(texts[last]) <= WINDOW):
                size += len(texts[last])
                last += 1
            if size <= WINDOW:
                lengths = np.fromiter(map(len, texts[k:last]), np.int64, last - k)
                ids, counts[k:last] = self._window("".join(texts[k:last]), np.concatenate(([0], np.cumsum(lengths)))) if size else (np.empty(0, np.uint32), 0)
                out.append(ids)
            else:
                for part in self._parts(texts[k]):
                    ids, n = self._window(part, np.array([0, len(part)]))
                    counts[k] += n[0]
                    out.append(ids)
            k = last
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), np.concatenate(([0], np.cumsum(counts)))
