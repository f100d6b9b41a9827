"""From raw documents to token ids: quality, near-duplicates, contamination, secrets, byte-level BPE.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.llm import bpe, classifier, decontam, secret_scan, setsketch
from stageloom.scratch import materialise
from stageloom.tables import load

LEAST_QUALITY = 0.3
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score by the rule ensemble, fitted on the labelled ones, is at least LEAST_QUALITY.

    NULL and empty texts are scored like others, rows with a NULL id by the same rules though they have no label; repeated rows
    stay or go together. Without labels, or with those of one class, the smoothed share of good ones is every row's score.
    """
    scored = classifier.with_statistics(docs)
    columns = classifier.statistic_columns(scored)
    narrow = classifier.with_statistics(docs.select("doc_id", "text"))
    narrow_columns = classifier.statistic_columns(narrow)
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = narrow.select("doc_id", *[F.col(a).alias(b) for a, b in zip(narrow_columns, columns, strict=True)])
    labelled = materialise(labelled, "statistics").join(labels, "doc_id")
    score = classifier.fit_rules(labelled, columns).score(columns)
    return scored.where(score >= LEAST_QUALITY).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    The row of the smallest id stays, of equal rows one; a NULL id is greater than all others. Rows without words all stay.
    """
    return setsketch.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no substitution-tolerant window with a benchmark item.

    NULL and empty texts and items share nothing; rows of one id are judged by their own texts; without items all stay.
    """
    return decontam.without_overlaps(docs, load(spark, sf_dir, "benchmark"), short_items=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text (0 for a NULL one, which stays NULL)."""
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the bytes they decode to; a NULL or empty text has none."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
