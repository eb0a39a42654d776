"""Language identification by compression with per-language Zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents, and characters of each, that a language's dictionary is made of at most: the bounded sample.
SAMPLE_DOCS, SAMPLE_CHARS = 256, 1000
LEVEL = 3
#: Bytes of a text that are compressed at once, each such piece against a fresh dictionary.
PIECE = 1 << 16
#: Characters that are looked at together.
STRETCH = 1 << 18
_WORDS, _BREAK = regex.compile(r"\p{L}+"), regex.compile(r"\P{L}")
#: A prediction whose best size isn't smaller than the second by this share of it is rejected as too close.
MARGIN = 0.004


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by 5: such rows are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw dictionary content of every language: texts of the sample documents of least hash.

    Learns from text and lang of rows with both and outside the held-out fifth.  The number of such rows of
    each language is counted over all documents; a hash bound on (doc_id, text) then selects about twice
    the sample, of which the driver keeps sample documents of chars characters; rows that repeat count once
    there, so however many there are of one, few reach the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1 << 40, (1 << 40) * (2 * sample + 16) // n))))
    chosen = rows.filter(spread < F.try_element_at(share, "lang")).select("lang", spread.alias("h"), "doc_id", F.substring("text", 1, chars).alias("text")).distinct().collect()
    out = {}
    for lang in sorted(counts):
        own = sorted((r["h"], r["doc_id"], r["text"]) for r in chosen if r["lang"] == lang)[:sample]
        out[lang] = "\n".join(plain(t) for _, _, t in reversed(own)).encode()
    return out


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of about STRETCH characters that end between words."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + STRETCH)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def plain(text: str) -> str:
    """The text's words, runs of letters, in lower case: so neither capitals nor symbols and numerals count."""
    return " ".join(_WORDS.findall(text.lower()))


class Classifier:
    """The language whose dictionary compresses a text to the fewest bytes, over all its pieces of PIECE bytes:
    in one stream a long text would be compressed against itself, alike for all languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.by = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def _add(self, sizes: list[int], piece: bytes) -> None:
        for i, c in enumerate(self.by):
            sizes[i] += len(c.compress(piece))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), and whether the margin is too narrow."""
        sizes, rest = [0] * len(self.by), b""
        for part in stretches(text or ""):
            rest += (b" " if rest else b"") + plain(part).encode()
            while len(rest) >= PIECE:
                self._add(sizes, rest[:PIECE])
                rest = rest[PIECE:]
        if rest.strip():
            self._add(sizes, rest)
        if not any(sizes):
            return "und", 0.0, True
        sizes = sorted((n, i) for i, n in enumerate(sizes))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return self.names[sizes[0][1]], min(1.0, margin / (margin + MARGIN)) if margin else 0.0, margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of docs, from its whole text only.

    lang_pred is the learned language of least compressed size, summed over pieces of PIECE bytes (ties: the first by name), `und` where text
    is null or has no letter or no language was learned.  score is m / (m + MARGIN) of the margin m between
    the two smallest sizes; rejected is set for `und` and for margins under MARGIN.  dictionaries: what
    learn() gave; learned from docs if none.  Rows with a null doc_id are predicted, not held out and never
    learned from; rows that repeat are predicted alike; an empty table gives one.  Other columns are ignored.
    """
    known = learn(docs) if dictionaries is None else dictionaries

    def run(batches):
        classify = Classifier(known)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(2)]
            lang, score, bad = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that identify() rejects, each judged by its own text; one narrow pass.

    All columns stay, whatever their names.  Null and empty texts and those without letters go, rows that
    repeat stay or go alike, and an empty table gives one.  Where no language can be learned all rows go.
    """
    known = learn(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        classify = Classifier(known)
        for batch in batches:
            yield batch.filter(pa.array([not classify(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
