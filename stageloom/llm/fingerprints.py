"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an LZ78 dictionary; the smallest hashes of the phrase set are
its signature, and the likeness of two signatures estimates the phrase sets' Jaccard similarity.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.llm import text as tx

SIGNATURE = 128
ROWS_PER_BLOCK = 2000
MOST_BLOCKS = 20_000


def parse(text: str, seen: dict[str, None], phrase: str = "") -> str:
    """Adds the phrases of ``text`` to ``seen``, going on from an unfinished phrase; returns the one left open.

    A phrase is the shortest prefix of the rest that is not in the dictionary yet.
    """
    for character in text:
        phrase += character
        if phrase not in seen:
            seen[phrase] = None
            phrase = ""
    return phrase


def signature(phrases: Iterable[str], k: int = SIGNATURE) -> np.ndarray:
    """The k smallest different 32-bit hashes of the phrases, ascending."""
    phrases = list(phrases)
    if not phrases:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer("".join(phrases).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, phrases), dtype=np.int64, count=len(phrases)))
    starts = np.concatenate(([0], ends[:-1]))
    hashes = tx.spans_hash(tx.mix(codes.astype(tx.U64) + tx.U64(1)), starts, ends)
    return tx.distinct((hashes >> tx.U64(32)).astype(np.uint32))[0][:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Share of the union's k smallest hashes that both have; 1 for two empty sets. Exact for sets below k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    repeated = both[1:] == both[:-1]
    first = np.concatenate(([True], ~repeated))
    limit = np.flatnonzero(first)[:k][-1]
    return float(np.count_nonzero(repeated[: limit + 1]) / min(k, int(first.sum())))


def encoded(signature_: np.ndarray) -> str:
    return base64.b64encode(signature_.astype(">u4").tobytes()).decode()


def fingerprint_text(text: str, k: int = SIGNATURE) -> np.ndarray:
    seen: dict[str, None] = {}
    parse(text, seen)
    return signature(seen, k)


def fingerprint_edit(text: str, kept: int, edited: str, k: int = SIGNATURE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of ``edited``, which share their first ``kept`` characters.

    The shared head is parsed once: what the dictionary holds at its end is common to both.
    """
    seen: dict[str, None] = {}
    rest = parse(text[:kept], seen)
    common = len(seen)
    parse(text[kept:], seen, rest)
    own = signature(seen, k)
    while len(seen) > common:
        seen.popitem()
    parse(edited[kept:], seen, rest)
    return own, signature(seen, k)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIGNATURE) -> DataFrame:
    """Every row's id and fingerprint: the signature as base64 of big-endian 32-bit hashes.

    Equal texts have equal fingerprints. A NULL text is empty and has the empty fingerprint.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType(), False)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoded(fingerprint_text(t.as_py() or "", k)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def in_blocks(docs: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows (doc_id, text) dealt into blocks of neighbouring ids, each block preceded by its predecessor.

    Adds (block, own): a block's rows are its own, and the greatest id of the block before (of the
    last one for the first) comes as a row that is not its own. Texts are shuffled once; splits come
    from quantiles of the ids, and the driver holds a few numbers per block (at most MOST_BLOCKS).
    A NULL id is below all others; rows of one id are ordered by text.
    """
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    keyed = docs.withColumn("key", key)
    n = docs.count()
    blocks = min(max(1, n // rows_per_block), MOST_BLOCKS)
    splits = []
    if blocks > 1:
        finite = docs.select(F.col("doc_id").cast("double").alias("key")).where("key IS NOT NULL")
        found = finite.approxQuantile("key", [i / blocks for i in range(1, blocks)], 0.2 / blocks)
        splits = sorted(set(found))
    if splits:
        edges = [float("-inf"), *splits, float("inf")]
        keyed = Bucketizer(splits=edges, inputCol="key", outputCol="block", handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn("block", F.lit(0.0))
    keyed = keyed.select("doc_id", "text", F.col("block").cast("int").alias("block"))
    greatest = keyed.groupBy("block").agg(F.max("doc_id").alias("greatest")).orderBy("block").collect()  # a row per block
    following = {r.block: s.block for r, s in zip(greatest, greatest[1:] + greatest[:1], strict=True)}
    rows = [(r.block, r.greatest, following[r.block]) for r in greatest]
    table = docs.sparkSession.createDataFrame(rows, "block int, greatest long, following int")
    own = F.struct("block", F.lit(True).alias("own"))
    carried = F.struct(F.col("following").alias("block"), F.lit(False).alias("own"))
    last = F.col("doc_id").eqNullSafe(F.col("greatest"))
    return (
        keyed.join(F.broadcast(table), "block")
        .select("doc_id", "text", F.explode(F.when(last, F.array(own, carried)).otherwise(F.array(own))).alias("at"))
        .select("doc_id", "text", "at.block", "at.own")
        .repartition("block")
        .sortWithinPartitions("block", "own", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIGNATURE) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, descending id (after the last: the first).

    The edit replaces the last n // 3 characters by as many from the start of the next text, or all
    of it. near_edited and near_next are the likeness to the edited and to the next text. A NULL
    text is empty; a lone document is its own next one; an empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_chars", T.LongType(), False)]
        + [T.StructField(c, T.StringType(), False) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType(), False) for c in ("near_edited", "near_next")]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_text, next_signature = "", np.zeros(0, dtype=np.uint32)
        for batch in batches:
            out: list[list] = [[] for _ in schema.names]
            for doc_id, text, own in zip(batch["doc_id"], batch["text"], batch["own"], strict=True):
                text = text.as_py() or ""
                if not own.as_py():
                    next_text, next_signature = text, fingerprint_text(text, k)
                    continue
                kept = len(text) - len(text) // 3
                edited = text[:kept] + next_text[: len(text) // 3]
                mine, other = fingerprint_edit(text, kept, edited, k)
                digest = hashlib.sha256(edited.encode()).hexdigest()
                near = likeness(mine, other, k), likeness(mine, next_signature, k)
                for column, value in zip(out, (doc_id.as_py(), len(text), digest, encoded(mine), encoded(other), *near), strict=True):
                    column.append(value)
                next_text, next_signature = text, mine
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            arrays = [pa.array(column, type=kind) for column, kind in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    blocks = in_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return blocks.mapInArrow(run, schema)
