"""Quality rules: base counts, then compression bands that reject repetitive or incompressible text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from planweave.llm.common import WORD, documents, in_slices

#: zstandard level of all ratios, and the bytes of a fixed chunk.
LEVEL, CHUNK = 3, 4096
#: Whole documents: from so many UTF-8 bytes on, the ratio (bytes / compressed bytes) must lie within these limits. Ratios of
#: ordinary prose rise with length, as the compressor finds more to refer to.
BANDS = (
    (0, 0.00, 2.00),
    (128, 0.90, 2.05),
    (256, 1.10, 2.10),
    (512, 1.15, 2.15),
    (1024, 1.25, 2.28),
    (2048, 1.35, 2.38),
    (4096, 1.40, 2.48),
    (8192, 1.45, 2.58),
    (16384, 1.50, 2.68),
    (65536, 1.50, 2.85),
    (262144, 1.50, 3.20),
)
#: All chunks are of one length, so they have one band. How many of a document's chunks may lie outside goes by their number: from so many
#: chunks on, a document with at least this share outside is rejected.
CHUNK_BAND = (1.45, 2.90)
CHUNK_SHARES = ((2, 0.50), (4, 0.25), (64, 0.20))
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

_WORDS = re.compile(WORD)

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which is found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[str, int] = {}
    a = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = np.unique(a[:-1] * len(numbers) + a[1:], return_inverse=True)[1]  # numbered anew, so that the product below fits
    _, place, count = np.unique(pairs[:-1] * len(numbers) + a[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines equal to an earlier line, and repeated words."""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def limits(table: tuple, size: int) -> tuple:
    """The row of a table of limits for a length."""
    return next(row for row in reversed(table) if size >= row[0])


def compression(data: bytes, compress=zstandard.ZstdCompressor(level=LEVEL).compress) -> tuple[float, int, int, bool]:
    """Ratio of the whole, chunks, chunks outside their band, and whether the bands accept the document.

    A document of more than one chunk is cut into chunks of CHUNK bytes; the last one is its final CHUNK bytes, which overlap the one before, so
    no byte is left out. A shorter one is judged as a whole only. An empty one is accepted here (the base rule rejects it).
    """
    size = len(data)
    if not size:
        return 1.0, 0, 0, True
    ratio = size / len(compress(data))
    _, low, high = limits(BANDS, size)
    starts = [*range(0, size - CHUNK, CHUNK), size - CHUNK] if size > CHUNK else []
    bad = sum(not CHUNK_BAND[0] <= CHUNK / len(compress(data[i : i + CHUNK])) <= CHUNK_BAND[1] for i in starts)
    return ratio, len(starts), bad, low <= ratio <= high and not (starts and bad >= limits(CHUNK_SHARES, len(starts))[1] * len(starts))


def judge(text: str | None) -> tuple:
    """All columns that ``quality_rules`` adds, for one text."""
    text = text or ""
    n, chars, symbols, dup_lines, repeats = base_counts(text)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    ratio, chunks, bad, accepted = compression(text.encode("utf-8", "surrogatepass"))
    return n, chars, symbols, dup_lines, repeats, failed, ratio, chunks, bad, accepted and not failed


def quality_rules(docs: DataFrame) -> DataFrame:
    """Adds the columns of COLUMNS to the documents; columns of the same name that came in are replaced.

    One pass over whole texts without a shuffle, very long ones included. Null and empty texts have no words, so they fail the base rule. Repeated rows are
    judged each for itself; a ratio on a limit is within it. An empty table gives none.
    """
    added = T._parse_datatype_string(COLUMNS)
    docs = docs.drop(*added.names)
    place = docs.columns.index("text")
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            found = list(zip(*map(judge, batch.column(place).to_pylist()), strict=True)) or [()] * len(kinds)
            new = [pa.array(v, k) for v, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}
