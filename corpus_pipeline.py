"""A training corpus from documents in five stages; each takes and, but for the last, returns the columns of documents.

All stages take nulls in any column, repeated rows and empty tables: texts that are null or have no word go in the
first stage, as they fail its rules; null ids and sources are kept like any other; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents, drop_table, table
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mix
from quire.llm.pieces import encode_decode
from quire.llm.quality_rules import keep_quality
from quire.llm.similar import keep_one_similar

#: SQL has no SimHash, no exponential tilts and no SentencePiece.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go; null and empty texts are among them."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that have no word left; n_chars follows the text. Ties go by id, null last."""
    out = dedup_lines(docs).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 of their five-word shingles stays: the one of the smallest id, null last.

    Pairs within a few bits of SimHash are verified and linked first, then what the prefix filter finds beyond those bits.
    """
    return keep_one_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; null is a source of its own."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus, and whether its ids decode to the text; a null text counts as empty, here and in `same`."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_decode(docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text"), model)
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_pieces"), same.alias("same"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash),
    ("mixing sources to target weights", mixing),
    ("sentencepiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder before the next reads it, and dropped once that is written."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs)
            if i:
                drop_table(before)
    return docs
