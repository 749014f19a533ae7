"""Token ids in Simple-8b files: encode texts, pack the ids into 64-bit words, write shards in doc_id order, read them back.

A shard is a run of documents in ascending doc_id order. Its ids are cut into blocks of BLOCK ids, and each block into 64-bit words: four
bits of selector, sixty bits of payload. The selector says how many ids the word holds and how wide each is; every word takes as many of
the next ids as fit. Ids of more than ESCAPE_BITS bits are escapes: the word holds 0 in their place, and a side list holds their place and
value. The first word of every block is listed, so a reader decodes all words of one selector at once, or any block alone.

Shards are Parquet rows (one per frame of about FRAME ids), as Spark's committers make them safe against lost tasks on any store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.llm.common import documents, in_slices, scratch_path
from planweave.llm.tokens import encoder

END_ID = 2
BLOCK = 512
#: A frame ends with the document that fills it up to so many ids.
FRAME = 1 << 19
#: Blocks that are packed side by side at a time, which bounds the memory of packing.
SLAB = 1 << 10
ESCAPE_BITS = 30
#: Selector -> (ids per word, bits per id).
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_N = np.array([n for n, _ in SELECTORS])

SHARD = (
    "shard int, frame int, first long, n_ids long, doc_ids array<long>, lengths array<long>, "
    "words binary, block_starts binary, escape_places binary, escape_values binary"
)


def pack_ids(ids: np.ndarray, escape_bits: int = ESCAPE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the end), places and values of the escapes of an array of unsigned 64-bit ids."""
    slabs = [_pack_slab(ids[i : i + SLAB * BLOCK], escape_bits) for i in range(0, max(1, len(ids)), SLAB * BLOCK)]
    done = np.cumsum([0, *(len(s[0]) for s in slabs)])
    starts = [s[1][:-1] + d for s, d in zip(slabs, done, strict=False)]
    places = [s[2] + i * SLAB * BLOCK for i, s in enumerate(slabs)]
    return (
        np.concatenate([s[0] for s in slabs]),
        np.concatenate([*starts, done[-1:]]),
        np.concatenate(places),
        np.concatenate([s[3] for s in slabs]),
    )


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of ids of at most 52 bits, which floating point holds exactly."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.int8)


def _pack_slab(ids: np.ndarray, escape_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks are packed side by side: in each round every unfinished block takes its next word."""
    ids = np.asarray(ids, np.uint64)
    places = np.flatnonzero(ids >> np.uint64(escape_bits))
    escapes = ids[places]
    n_blocks = -(-len(ids) // BLOCK)
    wide = BLOCK + int(_N[0])
    values = np.zeros((n_blocks, wide), np.uint64)  # zeros behind a block's end fit into any word
    low = np.zeros(n_blocks * BLOCK, np.uint64)
    low[: len(ids)] = ids
    low[places] = 0
    values[:, :BLOCK] = low.reshape(n_blocks, BLOCK)
    table = np.zeros((n_blocks, wide), np.int8)
    table[:, :BLOCK] = _bits(low).reshape(n_blocks, BLOCK)
    # a selector that fits is one of more and narrower ids than all behind it, which fit too: so the number that fits tells the first one
    choice = np.full((n_blocks, BLOCK), len(SELECTORS) - 1, np.int8)
    widest = {1: table}  # widest[n][b, i]: most bits among n ids from i on
    for n, bits in reversed(SELECTORS[:-1]):
        half = max(k for k in widest if k < n)
        rest = min(k for k in widest if k >= n - half)
        shift = n - rest
        joined = widest[half].copy()
        np.maximum(joined[:, : wide - shift], widest[rest][:, shift:], out=joined[:, : wide - shift])
        widest[n] = joined
        choice -= joined[:, :BLOCK] <= bits
    size = np.full(n_blocks, BLOCK)
    if n_blocks:
        size[-1] = len(ids) - BLOCK * (n_blocks - 1)
    jump = np.arange(BLOCK) + _N[choice]
    at, live = np.zeros(n_blocks, np.int64), np.flatnonzero(size > 0)
    owner, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(live):  # each round: where the next word of every unfinished block begins
        owner.append(live)
        start.append(at)
        at = jump[live, at]
        on = at < size[live]
        live, at = live[on], at[on]
    owner, start = np.concatenate(owner), np.concatenate(start)
    order = np.argsort(owner, kind="stable")
    owner, start = owner[order], start[order]
    sel = choice[owner, start]
    words = sel.astype(np.uint64) << np.uint64(60)
    flat, begin = values.reshape(-1), owner * wide + start
    for k in np.unique(sel):
        n, bits = SELECTORS[k]
        mine = np.flatnonzero(sel == k)
        got, first = words[mine], begin[mine]
        for j in range(n if bits else 0):
            got |= flat[first + j] << np.uint64(j * bits)
        words[mine] = got
    return words, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_blocks))]), places, escapes


def unpack_ids(words: np.ndarray, starts: np.ndarray, places: np.ndarray, escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids that ``pack_ids`` packed, all words of a selector at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = _N[sel]
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ahead = np.cumsum(count) - count
    place = ahead - ahead[starts[:-1][block]] + block * BLOCK if len(words) else ahead
    ids = np.zeros(n_ids + int(_N[0]), np.uint64)
    limit = np.minimum((block + 1) * BLOCK, n_ids)
    for k in np.unique(sel):
        n, bits = SELECTORS[k]
        mine = np.flatnonzero(sel == k)
        for j in range(n if bits else 0):
            to = place[mine] + j
            inside = to < limit[mine]
            ids[to[inside]] = (words[mine[inside]] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    ids[places] = escapes
    return ids[:n_ids]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, shards: int, end_id: int | None = END_ID
) -> None:
    """Encode every whole text of ``docs`` (``doc_id, text`` and others), append ``end_id``, and write the ids as Simple-8b shards to ``path``.

    Shards are in ascending doc_id order (nulls first, equal doc_ids by a hash of the text, so that rows of one id may lie in several shards). Texts are
    dealt by ranges before they are encoded, as they are smaller than ids and sampling the ranges then encodes nothing. A null text counts as
    an empty one; rows that repeat are encoded each; a very long text is in one frame. An empty table gives no files.
    """
    names = [c.split()[0] for c in SHARD.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4]
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def frame_row(shard: int, frame: int, first: int, docs: list, parts: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), "<u4")
        words, starts, places, escapes = pack_ids(ids)
        row = [shard, frame, first, len(ids), docs, [len(p) // 4 for p in parts], words.astype("<u8").tobytes()]
        row += [starts.astype("<u4").tobytes(), places.astype("<u4").tobytes(), escapes.astype("<u8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        shard, frame, first, held, docs, parts = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for batch in in_slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + tail
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // 4
                if held >= FRAME:
                    yield frame_row(shard, frame, first, docs, parts)
                    frame, first, held, docs, parts = frame + 1, first + held, 0, [], []
        if docs:
            yield frame_row(shard, frame, first, docs, parts)

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    ordered = hashed.repartitionByRange(shards, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``shard, begin, doc_id, ids``: each document's ids, decoded from the files, and how many ids of its shard are before it."""
    kinds = {"shard": pa.int32(), "begin": pa.int64(), "doc_id": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                whole = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: B023, E731
                places = whole("escape_places", "<u4").astype(np.int64)
                starts = whole("block_starts", "<u4").astype(np.int64)
                got = unpack_ids(whole("words", "<u8"), starts, places, whole("escape_values", "<u8"), row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - np.array(row["lengths"], np.int64)
                ids = [got[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
                made = ([row["shard"]] * len(ids), begins + row["first"], row["doc_ids"], ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds.values(), strict=True)], list(kinds))

    return spark.read.schema(SHARD).parquet(path).mapInArrow(run, "shard int, begin long, doc_id long, ids binary")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``, from the files alone.

    ``start`` counts the ids of all documents before it: those of its shard stand in the frame, those of the shards before it come from
    the small table of shard totals. No files give no rows.
    """
    totals = spark.read.schema(SHARD).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_offset"))
    read = read_token_files(spark, path).select(
        "shard", "begin", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    placed = read.join(offsets, F.col("shard") == F.col("_shard"))
    return placed.select("doc_id", (F.col("begin") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write their ids as Simple-8b shards, and digest what the files hold."""
    path = scratch_path(spark, "token-files")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), shards)
    return token_index(spark, path)


QUERIES = {"op1_token_files": op1_token_files}
SQL: dict[str, str] = {}
