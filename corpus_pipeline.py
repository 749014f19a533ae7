"""A training corpus in five stages: quality rules, near duplicates, personal data, source mix, packing.

Each stage takes the documents that the one before kept and returns documents of the same columns; the last returns packed pieces. Between
stages they are written as Parquet to the shared folder and read again. Every stage works on all rows and whole texts, very long ones
included. Columns that a stage does not read go around it in a struct, so whatever their names are, they come out as they went in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import documents, n_words, stored
from planweave.llm.mixing import mix_sources
from planweave.llm.near_dup import near_duplicates, without
from planweave.llm.packing import cut_pieces, pack_pieces
from planweave.llm.pii import find_pii
from planweave.llm.quality import quality_rules


#: Words that a worker of the packing stage keeps. Workers also hold what earlier stages left, so this is less than for packing alone.
REMEMBERED = 1 << 16


def _aside(docs: DataFrame, *read: str) -> tuple[DataFrame, list]:
    """The columns ``read`` and all others in the struct ``_rest``, and the columns that bring back the order of ``docs``."""
    rest = [c for c in docs.columns if c not in read]
    around = docs.select(*read, F.struct(*rest).alias("_rest") if rest else F.lit(None).cast("string").alias("_rest"))
    return around, [F.col(c) if c in read else F.col("_rest")[c].alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go (they have no words); rows that repeat are judged each; an empty table stays empty."""
    around, back = _aside(docs, "text")
    return quality_rules(around).where("kept").select(back)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (4-word shingles, similarity 0.8).

    Null doc_ids and texts without words are linked with nothing and stay; rows that repeat a doc_id stay or go together.
    """
    found = stored(near_duplicates(docs), "near-duplicates")
    return without(docs, found.where("NOT kept").select("doc_id").distinct(), "doc_id")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows. A null text stays null, with no characters; every row stays."""
    around, back = _aside(docs, "text", "n_chars")
    found = find_pii(around.drop("n_chars"), redact=True).withColumn("text", F.col("pii_redacted"))
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it, also no time.

    Null texts have no words and null sources are one source; rows that repeat are taken each for itself. Which rows of one size are taken goes by a hash.
    """
    around, back = _aside(docs, "doc_id", "source", "text")
    sized = around.withColumn("size", n_words(F.col("text"))).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    mixed = mix_sources(sized, by=("doc_id", "digest")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: where each piece of each document lies. A null text is an empty one, which is its end id; rows that repeat are packed each."""
    pieces = cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("personal data", redact),
    ("source mix", mix),
    ("packing", pack),
]
#: No SQL: the first stage already rests on compression, the last on a tokenizer. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
