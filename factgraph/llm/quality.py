"""Operator 6, quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over whole Arrow chunks, mark the
characters inside n-grams and lines that a text holds more than once.

Defined cases: a null or empty text has no words and fails the base rule; a text of any length is
measured whole; equal rows get equal results; an empty table gives an empty result; other columns
are left alone by ``filter_quality`` and never clash, since results keep their own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import SMALL_CHUNK_BYTES, Words, chunks, covered, later, mix, span_hashes, tidied, twice


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict, as shares of a text's characters in words (lines: of all characters).

    A clean text repeats next to nothing at these lengths: the limits follow published practice
    for repetition rules and hold for texts of every size.
    """

    min_words: int = 50
    repeat_n: int = 3
    max_repeat_share: float = 0.50
    lengths: tuple[int, ...] = (5, 7, 10)
    max_cover: tuple[float, ...] = (0.30, 0.25, 0.20)
    max_line_chars: float = 0.30
    max_symbols_a_word: float = 0.50


_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, cover_chars array<long>"


def measure(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of a chunk of texts, one entry a row."""
    w = Words(column)
    rows = len(w.count)
    if not rows:
        return {}
    data = w.data
    char = (data & 0xC0) != 0x80
    word_char = char & w.inside
    salt = mix(np.arange(rows, dtype=np.uint64), 3)
    letters = np.concatenate([[0], np.cumsum(word_char, dtype=np.int64)])
    per_word = letters[w.end] - letters[w.start]

    def repeated(n: int) -> np.ndarray:
        key, at = w.ngrams(n)
        return covered(twice(key ^ salt[w.doc[at]]), at, n, len(w))

    cover = [w.per_doc(repeated(n) * per_word) for n in rules.lengths]
    n_repeat = w.per_doc(repeated(rules.repeat_n))
    out = {"n_words": w.count.astype(np.int64), "word_chars": w.per_doc_bytes(word_char), "n_symbols": w.per_doc_bytes(_SYMBOL[data]), "n_repeat_words": n_repeat}
    out["n_dup_lines"], out["dup_line_chars"] = _lines(w, char, salt)
    chars = np.maximum(out["word_chars"], 1)
    failed = (out["n_words"] < rules.min_words) | (n_repeat > rules.max_repeat_share * out["n_words"])
    bad = (out["dup_line_chars"] > rules.max_line_chars * np.maximum(w.per_doc_bytes(char), 1)) | (out["n_symbols"] > rules.max_symbols_a_word * out["n_words"])
    for c, most in zip(cover, rules.max_cover, strict=True):
        bad |= c > most * chars
    return out | {"base_failed": failed, "kept": ~failed & ~bad, "cover": np.stack(cover, 1)}


def _lines(w: Words, char: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and the characters in them."""
    rows, data = len(w.count), w.data
    newline = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([w.offsets[:-1], newline + 1]), kind="stable")
    end = np.sort(np.concatenate([w.offsets[1:], newline]), kind="stable")
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)  # has a word
    start, end = start[full], end[full]
    doc = np.searchsorted(w.offsets, start, side="right") - 1
    same = later(span_hashes(data, start, end) ^ salt[doc]) if len(start) else np.zeros(0, bool)
    chars = np.concatenate([[0], np.cumsum(char, dtype=np.int64)])
    return np.bincount(doc[same], minlength=rows), np.bincount(doc[same], weights=(chars[end] - chars[start])[same], minlength=rows).astype(np.int64)


def _batch(m: dict[str, np.ndarray], first: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    cover = m["cover"]
    lists = pa.ListArray.from_arrays(np.arange(len(cover) + 1, dtype=np.int32) * cover.shape[1], cover.ravel().astype(np.int64))
    kinds = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars")
    return pa.RecordBatch.from_arrays([*first, *[pa.array(m[k]) for k in kinds], lists], [*names, *kinds, "cover_chars"])


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Per row: its id, the base measures, the verdict and the covered characters by n-gram length."""
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text", SMALL_CHUNK_BYTES):
                yield _batch(measure(c.column("text"), rules), [c.column("doc_id")], ["doc_id"])

    return two.mapInArrow(tidied(run), "doc_id long, " + FIELDS)


def filter_quality(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text is kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, text_col, SMALL_CHUNK_BYTES):
                yield c.filter(pa.array(measure(c.column(text_col), rules)["kept"]))

    return docs.mapInArrow(tidied(run), docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, rules = quality_measures(spark.read.parquet(f"{sf_dir}/documents.parquet")), Rules()
    return out.select("*", *[F.col("cover_chars")[i].alias(f"cover_{n}") for i, n in enumerate(rules.lengths)]).drop("cover_chars")


def _covered(n: int) -> str:
    """SQL for the characters of a document's words inside runs of n words that it holds twice or more."""
    return f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {n - 1}], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)),
h{n} AS (SELECT DISTINCT doc_id, i + o AS i FROM g{n}, (SELECT unnest(range({n})) AS o) WHERE c > 1),
c{n} AS (SELECT doc_id, count(*) AS words, sum(size)::BIGINT AS chars FROM h{n} JOIN u USING (doc_id, i) GROUP BY doc_id)"""


#: All columns, by the words themselves.  The limits are those of ``Rules``.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, i, length(w[i]) AS size FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
{", ".join(_covered(n) for n in (3, 5, 7, 10))},
l AS (SELECT doc_id, sum(c - 1)::BIGINT AS n, sum((c - 1) * length(l))::BIGINT AS chars FROM (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(text) AS chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words, coalesce(l.chars, 0)::BIGINT AS dup_line_chars,
  coalesce(c5.chars, 0)::BIGINT AS cover_5, coalesce(c7.chars, 0)::BIGINT AS cover_7, coalesce(c10.chars, 0)::BIGINT AS cover_10
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT * EXCLUDE (chars), NOT base_failed AND dup_line_chars <= 0.30::DOUBLE * greatest(chars, 1) AND n_symbols <= 0.50::DOUBLE * n_words
  AND cover_5 <= 0.30::DOUBLE * greatest(word_chars, 1) AND cover_7 <= 0.25::DOUBLE * greatest(word_chars, 1) AND cover_10 <= 0.20::DOUBLE * greatest(word_chars, 1) AS kept FROM b"""
