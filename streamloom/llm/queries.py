"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .html_text import extract_text
from .language import identify
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .pieces import piece_digests
from .sharding import shard_documents
from .substrings import remove_repeats
from .token_files import read_tokens, write_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; read by path, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op3_radix_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_minhash_near_dedup, op2_ring_sharding, op3_radix_exact_dedup, op4_site_line_dedup, op5_html_text, op6_decontamination, op7_repeated_substrings, op8_language_id, op9_token_files, op10_sentencepiece, pipeline)
    return {f.__name__: f for f in own}


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM runs
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r
), least AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON least.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

LINES_SQL = """
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), places AS (
  SELECT doc_id, source, unnest(generate_series(1, len(lines))) AS i, lines FROM pages
), line AS (
  SELECT doc_id, source, i, lines[i] AS raw, trim(lines[i]) AS line FROM places
), totals AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), marked AS (
  SELECT line.source, line, true AS bad FROM line JOIN totals ON totals.source IS NOT DISTINCT FROM line.source
  WHERE line <> '' GROUP BY line.source, line, totals.n HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) > 0.05 * totals.n
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(bad) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (bad IS NULL), '') AS text
  FROM line LEFT JOIN marked ON marked.source IS NOT DISTINCT FROM line.source AND marked.line = line.line GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END) AS text_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Ring placement, alignment, compression, token and piece files have no SQL; tests/llm has brute force."""
    return {"op1_minhash_near_dedup": NEAR_SQL, "op3_radix_exact_dedup": EXACT_SQL, "op4_site_line_dedup": LINES_SQL}
