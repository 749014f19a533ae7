"""The append-only id ledger: which source id stands for which destination id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planweave.functions.canonical import canonical_json, deterministic_id, is_legacy_id, is_portable_id, row_hash, set_digest
from planweave.operators.prefix import running_sum
from planweave.operators.store import kept

#: Bytes of a ledger document.
CHUNK_BYTES = 131_072
#: Fresh ids that are tried for one source id.
ATTEMPTS = 10_000


def source_only_legacy(source_ids: DataFrame, destination_ids: DataFrame) -> DataFrame:
    """``namespace, id, malformed``: ids that only the source has and that are not portable; malformed ones are not legacy either."""
    only = source_ids.join(destination_ids, ["namespace", "id"], "left_anti")
    return only.where(~is_portable_id(F.col("id"))).withColumn("malformed", ~is_legacy_id(F.col("id")))


def seed(site: str, counter) -> F.Column:
    """Seed text of a reserved id: site, namespace, source id, and the counter from 1 on."""
    base = F.concat(F.lit(f"planweave-id:{site}:"), "namespace", F.lit(":"), "source_id")
    return F.when(counter == 0, base).otherwise(F.concat(base, F.lit(":"), counter.cast("string")))


def reserve_ids(wanted: DataFrame, occupied: DataFrame, site: str, attempts: int = ATTEMPTS) -> DataFrame:
    """``namespace, source_id, target_id``: a deterministic portable id for every row of ``wanted``.

    Clashes, with ``occupied`` (``namespace, target_id``) or among each other (the smallest source id wins), go on with the next counter; only they run again.
    """
    rest, taken, out = wanted.select("namespace", "source_id").distinct(), occupied.select("namespace", "target_id"), None
    for counter in range(attempts):
        tried = rest.withColumn("target_id", deterministic_id(seed(site, F.lit(counter))))
        first = F.row_number().over(W.partitionBy("namespace", "target_id").orderBy("source_id")) == 1
        good = tried.join(taken, ["namespace", "target_id"], "left_anti").withColumn("first", first).where("first").select("namespace", "source_id", "target_id")
        out = good if out is None else out.unionByName(good)
        out, taken = kept(out, "reserved"), kept(taken.unionByName(good.select("namespace", "target_id")), "taken")
        rest = kept(rest.join(out.select("namespace", "source_id"), ["namespace", "source_id"], "left_anti"), "clashes")
        if rest.isEmpty():
            return out
    raise RuntimeError(f"no free id within {attempts} attempts")


def prepare_mapping(legacy: DataFrame, ledger: DataFrame) -> DataFrame:
    """``namespace, source_id, target_id, status``: reused where the ledger knows the id, else to be reserved."""
    known = ledger.select("namespace", "source_id", "target_id")
    joined = legacy.select("namespace", F.col("id").alias("source_id")).join(known, ["namespace", "source_id"], "left")
    return joined.withColumn("status", F.when(F.col("target_id").isNull(), "reserve").otherwise("reuse"))


def apply_mapping(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` rewritten by the mapping (``source_id, target_id``); ids without an entry stay."""
    m = mapping.select(F.col("source_id").alias(column), F.col("target_id").alias("_mapped"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_mapped", column)).drop("_mapped")


def chunk_ledger(entries: DataFrame, limit: int = CHUNK_BYTES, envelope: int = 512) -> DataFrame:
    """Adds ``chunk``: sorted entries cut so that no chunk's entries exceed ``limit``; by running sums per namespace, with room for the longest entry."""
    size = F.octet_length(F.concat_ws(":", "namespace", "source_id", "target_id")) + 3
    longest = entries.groupBy("namespace").agg(F.max(size).alias("_longest"))
    summed = running_sum(entries, ["namespace"], [F.col("source_id"), F.col("target_id")], size, "_upto").join(longest, "namespace")
    return summed.withColumn("chunk", F.floor((F.col("_upto") - size) / (F.lit(limit - envelope) - F.col("_longest"))).cast("long")).drop("_upto", "_longest")


def greedy_chunks(entries: DataFrame, limit: int = CHUNK_BYTES, envelope: int = 512) -> DataFrame:
    """Adds ``chunk``: sorted entries of each namespace packed one after another, a new chunk where the next entry would exceed ``limit`` less ``envelope``; exactly what one pass from the first entry gives.

    Running sums place each entry on a scale of bytes. Where a chunk that began with an entry would end follows from a look into two stretches of the scale, each as long as a chunk, so of bounded size; which entries begin chunks
    follows from the first one by doubling these pointers. No task holds a namespace. An entry that fits no chunk is an error; equal entries count once each, in any order.
    """
    room = limit - envelope
    size = F.octet_length(F.concat_ws(":", "namespace", "source_id", "target_id")) + 3
    if not entries.where(size > room).isEmpty():
        raise ValueError("an entry does not fit in a chunk")
    order = [F.col("source_id"), F.col("target_id"), F.col("_id")]
    told = kept(entries.withColumn("_id", F.monotonically_increasing_id()).withColumn("_size", size.cast("long")), "entries")
    placed = kept(running_sum(told, ["namespace"], order, F.col("_size"), "_upto"), "placed-entries")
    stretch = lambda at: F.floor(at / room).cast("long")
    spots = placed.select("namespace", "_id", F.col("_upto").alias("_at"), F.lit(False).alias("_asks"), stretch(F.col("_upto")).alias("_s"))
    full = F.col("_upto") - F.col("_size") + room  # a chunk that begins here ends with the last entry up to this
    asks = placed.select("namespace", "_id", full.alias("_at"), F.lit(True).alias("_asks"), stretch(full).alias("_s"))
    within = W.partitionBy("namespace", "_s").orderBy(F.desc("_at"), F.desc("_asks")).rowsBetween(W.unboundedPreceding, -1)
    later = F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"))
    near = spots.unionByName(asks).withColumn("_next", F.last(F.when(~F.col("_asks"), later), ignorenulls=True).over(within)).where("_asks")
    firsts = spots.groupBy("namespace", (F.col("_s") - 1).alias("_s")).agg(F.min(later).alias("_first"))
    near = near.withColumn("_next", F.when(F.col("_next.at") > F.col("_at"), F.col("_next")))
    jump = near.join(firsts, ["namespace", "_s"], "left").select(F.col("_id").alias("src"), F.coalesce("_next", "_first")["id"].alias("dst")).where("dst IS NOT NULL")
    jump = kept(jump, "breaks")
    begins = kept(placed.where("_upto = _size").select("_id"), "begins")
    while not jump.isEmpty():
        more = begins.join(jump, begins["_id"] == jump["src"]).select(F.col("dst").alias("_id"))
        begins = kept(begins.unionByName(more).distinct(), "begins")
        to = jump.select(F.col("src").alias("_mid"), F.col("dst").alias("_to"))
        jump = kept(jump.join(to, F.col("dst") == F.col("_mid")).select("src", F.col("_to").alias("dst")), "breaks")
    flagged = kept(placed.join(begins.withColumn("_new", F.lit(1)), "_id", "left").withColumn("_new", F.coalesce("_new", F.lit(0)).cast("long")), "flagged-entries")
    counted = running_sum(flagged, ["namespace"], order, F.col("_new"), "chunk")
    return counted.select(*entries.columns, (F.col("chunk") - 1).alias("chunk"))


def ledger_batches(chunks: DataFrame) -> DataFrame:
    """``namespace, batch_id, chunk, chunk_id, n, bytes``: ids of a namespace's batch, from all of its entries in any order, and of each of its chunks (``greedy_chunks``)."""
    size = F.octet_length(F.concat_ws(":", "namespace", "source_id", "target_id")) + 3
    whole = chunks.groupBy("namespace").agg(set_digest(row_hash("source_id", "target_id")).alias("_sum"), F.count("*").alias("_n"))
    batch = deterministic_id(F.concat_ws(":", F.lit("ledger-batch"), "namespace", "_n", "_sum"))
    each = chunks.groupBy("namespace", "chunk").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).join(whole.select("namespace", batch.alias("batch_id")), "namespace")
    return each.select("namespace", "batch_id", "chunk", deterministic_id(F.concat_ws(":", F.lit("ledger-record"), "batch_id", "chunk")).alias("chunk_id"), "n", "bytes")


def read_ledger(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (``id, batch, source_id, target_id, hash``) of ledger documents (``id, text``), with the hash of their document, and violations (``id, problem``):
    documents that are no JSON or not in canonical form; these have no entries."""
    entry = "struct<batch:string,entries:array<struct<source:string,target:string>>>"
    read = documents.withColumn("plain", canonical_json(F.col("text")))
    problem = F.when(F.col("plain").isNull(), "unreadable").when(F.col("plain") != F.col("text"), "not canonical")
    fine = read.where(problem.isNull()).select("id", F.from_json("text", entry).alias("d"), F.sha2("text", 256).alias("hash"))
    rows = fine.select("id", "d.batch", "hash", F.explode("d.entries").alias("e"))
    return rows.select("id", "batch", F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"), "hash"), read.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def ledger_violations(entries: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """``rule, subject``: ids claimed twice, as source or as target, gaps in chunk numbers, and chunks that are too long."""
    rule = lambda df, name, subject: df.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))
    twice = lambda c: entries.groupBy("namespace", c).agg(F.count("*").alias("n")).where("n > 1")
    chunk = entries.groupBy("namespace", "chunk").agg(F.sum(F.octet_length(F.concat_ws(":", "namespace", "source_id", "target_id")) + 3).alias("bytes"))
    gaps = chunk.groupBy("namespace").agg(F.count("*").alias("n"), F.max("chunk").alias("last")).where("last <> n - 1")
    return (
        rule(twice("source_id"), "source claimed twice", F.col("source_id"))
        .unionByName(rule(twice("target_id"), "target claimed twice", F.col("target_id")))
        .unionByName(rule(chunk.where(F.col("bytes") > limit), "chunk too long", F.col("chunk")))
        .unionByName(rule(gaps, "chunks not contiguous", F.col("namespace")))
    )
