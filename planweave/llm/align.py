"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how often ids are linked over a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import documents, stored
from planweave.llm.tokens import PieceEncoder, TextEncoder

#: Bytes of text after which a block of documents ends. Id pairs are counted per block before they are dealt; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22
#: Tokens whose links are held at once.
LINK_TOKENS = 1 << 18
#: Compression of a document's ids, which are written once and dealt once.
LEVEL = 3
#: A pair of ids is one key, ``a * 2^32 + b``.
SHIFT = 32


class TokenTable:
    """Byte strings of a vocabulary as arrays, and ids as decimal text with what may follow them."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.texts = {mark: np.array([f"{i}{mark}".encode() for i in range(len(tokens))]) for mark in ",|;"}

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return np.zeros(0, np.uint8)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])]


class Pair:
    """Both tokenizers and their tables."""

    def __init__(self, first: str, second: str):
        self.a, self.b = TextEncoder(first, plain=True), PieceEncoder(second)
        self.table_a, self.table_b = TokenTable(self.a.token_bytes()), TokenTable(self.b.token_bytes())
        widest = max(len(self.table_a.lengths), len(self.table_b.lengths))
        self.width = "<u2" if widest <= 1 << 16 else "<u4"

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of a space and the text by both, as integers of ``width``; none where a tokenizer's bytes are not those of the text."""
        a, b = self.a.encode(text, spaced=True), self.b.encode(text)
        data = np.frombuffer((" " + (text or "")).encode(), np.uint8)
        ids = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        same = text and all(np.array_equal(t.joined(i), data) for t, i in zip((self.table_a, self.table_b), ids, strict=True))
        return tuple(i.astype(self.width).tobytes() for i in ids) if same else (b"", b"")


@lru_cache(maxsize=1)
def pair(first: str, second: str) -> Pair:
    """One pair of tokenizers per worker."""
    return Pair(first, second)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of both sides the terminal token of its component, a token of the second side.

    ``a_end`` and ``b_end`` are where tokens end in the same bytes. A token points to the farthest-right token that overlaps it, if that one ends later (of two that end
    together, to the one of the second side), else to itself. Pointers only lead right, so doubling them takes a logarithmic number of steps.
    """
    n = len(a_end)
    over = np.searchsorted(a_end, b_end - 1, "right")
    own = np.arange(n, n + len(b_end))
    later = a_end[over] > b_end if n else np.zeros(0, bool)
    to = np.concatenate([n + np.searchsorted(b_end, a_end - 1, "right"), np.where(later, over, own)])
    open_ = np.flatnonzero(to[to] != to)  # tokens that do not yet point to a terminal one
    while len(open_):
        to[open_] = to[to[open_]]
        open_ = open_[to[to[open_]] != to[open_]]
    return to[:n] - n, to[n:] - n


def links(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, lengths: np.ndarray, at_once: int = LINK_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all overlapping occurrences, and which occurrence of the first side each is of; some tokens at a time."""
    for i in range(0, len(a), at_once):
        part, end = a[i : i + at_once], a_end[i : i + at_once]
        low = np.searchsorted(b_end, end - lengths[part], "right")
        n = np.searchsorted(b_end, end - 1, "right") - low + 1
        which = np.repeat(np.arange(len(part)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        yield (part[which] << SHIFT) | b[at], which + i


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, both: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids as text in the order of groups, first side first, each with the mark behind it; and the places of both sides' tokens."""
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    width = max(both.table_a.texts[","].dtype.itemsize, both.table_b.texts[","].dtype.itemsize)
    out = np.zeros(len(a) + len(b), f"S{width}")
    for ids, group, place, table, mark in ((a, group_a, place_a, both.table_a, "|"), (b, group_b, place_b, both.table_b, ";")):
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        out[place[last]] = table.texts[mark][ids[last]]
        out[place[~last]] = table.texts[","][ids[~last]]
    return out, place_a, place_b


class Block:
    """The tokens of some documents one behind another."""

    def __init__(self, texts: list[tuple[bytes, bytes]], both: Pair):
        self.a, self.b = (np.frombuffer(b"".join(t[side] for t in texts), both.width).astype(np.int64) for side in (0, 1))
        self.n_a, self.n_b = (np.array([len(t[side]) for t in texts], np.int64) // np.dtype(both.width).itemsize for side in (0, 1))
        self.a_end, self.b_end = np.cumsum(both.table_a.lengths[self.a]), np.cumsum(both.table_b.lengths[self.b])
        self.both = both

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return links(self.a, self.b, self.a_end, self.b_end, self.both.table_a.lengths)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys and their numbers."""
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for found, _ in self.links():
            some, times = np.unique(found, return_counts=True)
            keys, where = np.unique(np.concatenate([keys, some]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, times]), len(keys)).astype(np.int64)
        return keys, n

    def digests(self, keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> list[np.ndarray | list]:
        """Per document: tokens of both sides, groups, links, best links, sum of counts, digest of the groups. ``keys`` are sorted."""
        docs = len(self.n_a)
        doc_a, first_b = np.repeat(np.arange(docs), self.n_a), np.cumsum(self.n_b) - self.n_b
        n_links, n_best, total = np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        for found, which in self.links():
            at, doc = np.searchsorted(keys, found), doc_a[which]
            np.add.at(n_links, *_per_doc(doc, np.ones(len(doc), np.int64)))
            np.add.at(n_best, *_per_doc(doc, best[at].astype(np.int64)))
            np.add.at(total, *_per_doc(doc, n[at]))
        group_a, group_b = terminals(self.a_end, self.b_end)
        ends = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, bool)
        per_doc = np.bincount(np.repeat(np.arange(docs), self.n_b)[ends], minlength=docs)
        texts, _, _ = group_texts(self.a, self.b, group_a, group_b, self.both)
        start = np.cumsum(self.n_a) - self.n_a + first_b
        shas = []
        for i in range(docs):
            size = self.n_a[i] + self.n_b[i]
            text = texts[start[i] : start[i] + size].tobytes().replace(b"\0", b"")[:-1]
            shas.append(hashlib.sha256(text).hexdigest() if size else "")
        return [self.n_a, self.n_b, per_doc, n_links, n_best, total, shas]


def _per_doc(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of runs of equal documents."""
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
    return doc[at], np.add.reduceat(values, at) if len(at) else values


def encoded_blocks(docs: DataFrame, first: str, second: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as tokens of both tokenizers, in blocks, and the id pairs of each block: rows ``block, doc_id, a, b`` and rows ``block, key, n``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_id", "a", "b", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, ids, tokens, size = pair(first, second), TaskContext.get().partitionId() << 32, [], [], 0
        pack = zstandard.ZstdCompressor(level=LEVEL).compress

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            none = [pa.nulls(len(ids), pa.int64())] * 2
            a, b = (pa.array([pack(t[side]) for t in tokens], pa.binary()) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(ids, id_arrow), a, b, *none], names)
            keys, n = Block(tokens, both).counts()
            void = [pa.nulls(len(keys), t) for t in (id_arrow, pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number), pa.int64()), *void, pa.array(keys), pa.array(n)], names)
            number += 1
            ids.clear()
            tokens.clear()

        for batch in batches:
            id_arrow = batch.schema.types[0]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                ids.append(batch.column(0)[i].as_py())
                tokens.append(both.encode(text))
                size += len(tokens[-1][1]) + 64
                if size > block_bytes:
                    yield from flush()
                    size = 0
        if ids:
            yield from flush()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_id {id_type}, a binary, b binary, key long, n long")


def align_tokenizers(docs: DataFrame, first: str, second: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Alignment of two tokenizers over ``docs`` (``doc_id, text``): per document its counts and groups, and per id pair how many links hold it.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. Pairs: ``a_id, b_id, n, best`` (whether no other id of the first vocabulary is
    linked to ``b_id`` more often). ``first`` is a byte-level tokenizer file, ``second`` a sentencepiece model, which adds a space; both see a space before the text.
    Strings of special tokens are ordinary text. A null or empty text, or one whose bytes a tokenizer does not give back, has no tokens: zeros and an empty digest. Rows that repeat
    count each, null ids pass through, other columns are not read, and an empty table has no rows.

    Pairs are counted in blocks of about ``block_bytes`` before they are dealt by key, so a frequent pair has one row a block. Totals go back to the blocks by the same key,
    and each block then meets its documents: nothing that grows with the corpus is broadcast or held by one task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    both = stored(encoded_blocks(docs, first, second, block_bytes), "token-blocks")
    met = both.where("key IS NOT NULL").select("block", "key", "n")
    counts = stored(met.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("key").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    pairs = counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")  # a row per id of the second vocabulary at most
    totals = pairs.select("key", F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("best"))
    back = met.select(F.col("block").alias("at"), "key").join(totals, "key")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(keys := right["key"].to_numpy())
        known = keys[order], right["total"].to_numpy()[order], np.asarray(right["best"].to_numpy(zero_copy_only=False), bool)[order]
        unpack = zstandard.ZstdDecompressor().decompress
        tokens = [(unpack(a), unpack(b)) for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True)]
        made = Block(tokens, pair(first, second)).digests(*known)
        columns = [left["doc_id"].combine_chunks(), *(pa.array(m, pa.int64()) for m in made[:-1]), pa.array(made[-1], pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    fields = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    tokens = both.where("a IS NOT NULL").select("block", "doc_id", "a", "b")
    aligned = tokens.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(meet, fields)
    listed = pairs.select(F.shiftright("key", SHIFT).cast("int").alias("a_id"), F.col("b_id").cast("int").alias("b_id"), "n", (F.col("n") == F.col("most")).alias("best"))
    return aligned, listed


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two public tokenizers over all documents."""
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokenizers(documents(spark, sf_dir), first, second)[0]


QUERIES = {"op12_align_tokenizers": op12_align_tokenizers}
SQL: dict[str, str] = {}
