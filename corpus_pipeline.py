"""Corpus pipeline: language ID, quality, near-dedup, secret masking and packing, in this order.

Each stage takes what its predecessor kept and returns the columns of documents, but
for the last, which returns the packed pieces. Models are fitted from the labelled
rows of ``sf_dir``'s tables by the same rules as in the single queries.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import langid, packing, quality, secrets, simhash
from gristmill.llm.common import documents, fresh, id_crc, settle

#: A text goes if no language reaches this probability, or if it has no letter.
LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is recognised: not ``und``, and LANGUAGE_SCORE or more.

    Null, empty and letterless texts go. Texts of any length are read whole; repeated rows
    fare alike; rows without an id, language or source stay by their text.
    """
    net = langid.fit(documents(spark, sf_dir).where(F.pmod(id_crc(F.col("doc_id")), F.lit(3)) != 1))
    pred, score = fresh("_pred", docs.columns), fresh("_score", docs.columns)
    rated = langid.identify(docs, net, pred=pred, score=score)
    return rated.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LANGUAGE_SCORE)).drop(pred, score)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose quality score reaches the acceptance mark, at it included.

    Null texts count as empty, and are scored like any. Texts of any length are read whole;
    repeated rows fare alike; other columns play no part.
    """
    ranker = quality.fit(quality.labelled(spark, sf_dir))
    score = fresh("_score", docs.columns)
    return quality.rate(docs, ranker, score=score).where(F.col(score) >= quality.ACCEPT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document of the least id.

    Near-duplicates share 0.8 or more of their shingles of five words, found by one-wildcard
    variants of fingerprints' segments and verified. Texts that are null, empty or without words are one
    group; texts of any length are compared whole. Rows without an id belong to groups
    like all others, and repeated rows of the kept id are told apart by a number, so exactly
    one row of a group stays.
    """
    row = fresh("_row", docs.columns)
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    keyed = numbered.select(F.col(row).alias("row"), "text", "doc_id")
    groups = simhash.similar_texts(keyed, key="row")
    first = simhash.merged(groups, keyed.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(row))
    return simhash.merged(numbered, first.select(row), row, "left_semi").drop(row)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; all documents stay, with ``n_chars`` of the changed texts counted anew.

    Null and empty texts stay as they are; texts of any length are masked whole.
    """
    return secrets.mask_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens.

    Null and empty texts are the end id alone; repeated rows and rows without an id are
    documents of their own; a text of any length is cut into whole sequences.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Trained models, fingerprints and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages lineage is cut by a checkpoint."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
