"""Best-fit packing of documents into training sequences under several capacities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planweave.llm.common import documents, free_name, in_slices, stored
from planweave.llm.tokens import REMEMBERED, encoder

MAX_TOKENS = 2048
END_ID = 0
#: Pieces that are packed together in one task. A group leaves at most a few sequences less than full.
GROUP_PIECES = 16384
#: Weights of the residual tokens, pieces and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.2, 0.2)
#: Pieces that a sequence may hold at least.
LEAST_DOCUMENTS = 64


def cut_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """Token pieces of whole texts: ``doc_id, piece, start, length, ids`` (little-endian 32-bit integers).

    A document's ids, with ``end_id`` appended, are one piece if there are at most ``max_tokens``; a longer document is cut into pieces of
    ``max_tokens`` and a last one that may be shorter. A null text counts as empty and still has its end id. Repeated rows give repeated pieces, and very long
    texts many. ``remembered`` bounds the words that a worker keeps with their ids: fewer take more time and less memory, and give the same ids.
    """
    tail, step = np.array([end_id], "<u4").tobytes(), 4 * max_tokens
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remembered).encode
        for batch in in_slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + tail
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    rows.append((doc, i // step, i // 4, len(part) // 4, part))
            made = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds.values(), strict=True)], list(kinds))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def vector_best_fit(demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """The bin of every item. ``demands``: items x dimensions; an item that exceeds a capacity has a bin of its own.

    Items come in descending order of their largest demand as a share of capacity. Among the open bins in which an item fits in every
    dimension, ``dot`` takes the one whose residual has the largest weighted dot product with the demand, and ``norm`` the one
    whose residual after the item has the smallest weighted norm; equal bins: the oldest. Bins are kept by equal residuals, so an item is
    compared with the distinct residuals only.
    """
    share = demands / capacities
    order = np.lexsort((np.arange(len(demands)), *(-share[:, d] for d in range(share.shape[1])), -share.max(axis=1)))
    room = len(demands)
    bins = np.full(room, -1, np.int64)
    residual = np.zeros((256, len(capacities)))  # distinct residuals of open bins, as shares of capacity
    stacks: list[list[int]] = []  # bins with that residual
    place: dict[tuple, int] = {}
    free: list[int] = []
    used = 0
    opened = 0

    def add(left: np.ndarray, number: int) -> None:
        nonlocal residual, used
        key = tuple(np.round(left, 9))
        at = place.get(key)
        if at is None:
            if free:
                at = free.pop()
            else:
                at, used = used, used + 1
                if at >= len(residual):
                    residual = np.concatenate([residual, np.zeros_like(residual)])
                stacks.append([])
            place[key] = at
            residual[at] = left
        stacks[at].append(number)

    for i in order:
        need = share[i]
        open_ = residual[:used]
        fits = (open_ >= need - 1e-9).all(axis=1)
        if rule == "dot":
            score = np.where(fits, open_ @ (weights * need), -np.inf)
        else:
            score = np.where(fits, -(weights * (open_ - need) ** 2).sum(axis=1), -np.inf)
        best = int(score.argmax()) if used else -1
        if best < 0 or score[best] == -np.inf:
            number, opened, left = opened, opened + 1, 1.0 - need
        else:
            number, left = stacks[best].pop(0), residual[best] - need
            if not stacks[best]:
                del place[tuple(np.round(residual[best], 9))]
                residual[best] = -1.0
                free.append(best)
        bins[i] = number
        if (left > 1e-9).all():
            add(left, number)
    return bins


def pack_pieces(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces (``doc_id, piece, length`` and any other columns; those named like a result are replaced).

    Capacities of a sequence: tokens, pieces of documents, and attention cost (sum of squared lengths). The default number of pieces is twice what
    a full sequence of this table has on average (LEAST_DOCUMENTS at least), so that short pieces are spread over the sequences and cost none. The default cost is that of one
    piece that fills a sequence: a lower one would leave every longer piece alone in its sequence. All three residuals choose the sequence, by ``weights`` and ``rule``.

    Pieces are kept as a table and dealt by their places in it into groups of about ``group_pieces``, whatever their ids, and each group is packed by
    ``vector_best_fit``: no task holds more, and the sequences that groups leave open are few. Places in a sequence are gapless. Null doc_ids,
    equal lengths and repeated rows are pieces like others (longer ones first, then by doc_id and piece); an empty table gives none. A piece longer than ``max_tokens`` has a sequence of its own.
    """
    pieces = stored(pieces.drop("sequence_id", "offset"), "pieces")
    total = pieces.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    groups = max(1, -(-total["n"] // group_pieces))
    mean = max_tokens * total["n"] / max(total["tokens"] or 0, 1)
    documents_ = max_documents or min(max_tokens, max(LEAST_DOCUMENTS, math.ceil(2 * mean)))
    capacities = np.array([max_tokens, documents_, float(max_tokens) ** 2 if max_cost is None else max_cost])
    weight, names = np.array(weights, float), pieces.columns
    group = free_name(pieces, "group")

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table["length"].to_numpy().astype(np.float64)
        doc, piece = (table[c].fill_null(-1).to_numpy() for c in ("doc_id", "piece"))
        order = np.lexsort((piece, doc, -n))
        bins = vector_best_fit(np.stack([n, np.ones(len(n)), n * n], axis=1)[order], capacities, weight, rule)
        by_bin = np.argsort(bins, kind="stable")
        order, bins = order[by_bin], bins[by_bin]
        length = n[order].astype(np.int64)
        ahead = np.cumsum(length) - length
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        offset = ahead - np.repeat(ahead[first], np.diff(np.append(first, len(bins))))
        sequence = (np.int64(table[group][0].as_py()) << np.int64(32)) + bins
        return table.select(names).take(pa.array(order)).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(group).applyInArrow(pack, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids`` from packed pieces with ``ids``, joined in order of ``offset``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    joined = F.array_join(F.transform(parts, lambda p: p["hex"]), "")
    return packed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    pieces = cut_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


QUERIES = {"op9_pack_documents": op9_pack_documents}
SQL: dict[str, str] = {}
