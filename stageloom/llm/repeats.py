"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words.

All window hashes are counted in Spark, in packed form: a chunk of documents sends the hashes of one
range of values as one row, a window that a chunk has several times only from its smallest document.
What the ranges find goes back to the chunks, where windows merge into maximal intervals per document.
Equality of windows is that of hashes with 56 bits or more behind the range; words are compared as they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.llm import members
from stageloom.llm import text as tx
from stageloom.scratch import materialise

WIDTH = 50
CHUNK_BYTES = 2 << 20
WINDOWS_PER_RANGE = 1_500_000
NO_ID = (1 << 63) - 1  # a NULL id counts as greater than all others

_PACKED = "part int, chunk long, ids binary, tags binary, first binary, hashes binary, low binary, high binary"
_FOUND = "chunk long, ids binary, tags binary, first binary, low binary, high binary"


def _planes(places: np.ndarray) -> tuple[bytes, bytes]:
    """32-bit numbers as their low and high halves: the high ones hardly differ and compress away."""
    return (places & 0xFFFF).astype("<u2").tobytes(), (places >> 16).astype("<u2").tobytes()


def _places(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, dtype="<u2").astype(np.int64) | (np.frombuffer(high, dtype="<u2").astype(np.int64) << 16)


def _least(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each entry whether another entry of the same value has a smaller key."""
    order = np.argsort(values)
    sorted_values, sorted_keys = values[order], keys[order]
    edges = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    least = np.repeat(np.minimum.reduceat(sorted_keys, edges), np.diff(np.concatenate((edges, [len(values)]))))
    out = np.zeros(len(values), dtype=bool)
    out[order[sorted_keys > least]] = True
    return out


def _pack(width: int, bits: int, chunk_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in "ids tags first hashes low high".split()])
        for batch in tx.chunks(batches, limit=chunk_bytes):
            serial += 1
            chunk = (task << 32) | serial
            data, offsets = tx.raw(batch.column("text"))
            starts, ends, first = tx.words(data, offsets)
            at = tx.window_starts(first, width)
            if not len(at):
                continue
            hashes = tx.spans_hash(tx.word_hashes(data, starts, ends, False), at, at + width)
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            steps = np.diff(ids, prepend=0).tobytes()
            keys = ids[np.searchsorted(first, at, side="right") - 1]
            repeated = _least(hashes, keys)
            tags = batch.column("tag").to_numpy(zero_copy_only=False).tobytes()
            firsts = first.astype("<u4").tobytes()
            rows = [(chunk % (1 << bits), chunk, steps, tags, firsts, None, *_planes(at[repeated]))]
            at, hashes = at[~repeated], hashes[~repeated]
            parts = (hashes >> tx.U64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(hashes), dtype=np.uint32)
            order = np.argsort(parts.astype(np.uint16) if bits <= 16 else parts, kind="stable")
            at, parts = at[order], parts[order]
            tails = np.ascontiguousarray(hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
            edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
            for a, b in zip(edges, np.concatenate((edges[1:], [len(parts)])), strict=True):
                rows.append((int(parts[a]), chunk, steps, None, firsts, tails[a:b].tobytes(), *_planes(at[a:b])))
            for k in range(0, len(rows), 64):
                columns = zip(*rows[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _compare(table: pa.Table) -> pa.Table:
    """One range of hash values: places of windows that also start in a smaller document."""
    rows, hashes, keys, edges = table.to_pylist(), [], [], [0]
    sent = [r for r in rows if r["hashes"] is not None]
    for r in sent:
        tails = np.frombuffer(r["hashes"], dtype=np.uint8).reshape(-1, 7)
        whole = np.zeros((len(tails), 8), dtype=np.uint8)
        whole[:, :7] = tails
        ids = np.cumsum(np.frombuffer(r["ids"], dtype=np.int64))
        first = np.frombuffer(r["first"], dtype="<u4")
        hashes.append(whole.reshape(-1).view("<u8"))
        keys.append(ids[np.searchsorted(first, _places(r["low"], r["high"]), side="right") - 1])
        edges.append(edges[-1] + len(whole))
    out = [{k: r[k] for k in ("chunk", "ids", "tags", "first", "low", "high")} for r in rows if r["hashes"] is None]
    if sent:
        repeated = _least(np.concatenate(hashes), np.concatenate(keys))
        for r, a, b in zip(sent, edges, edges[1:], strict=False):
            if repeated[a:b].any():
                low, high = _planes(_places(r["low"], r["high"])[repeated[a:b]])
                out.append({"chunk": r["chunk"], "ids": None, "tags": None, "first": None, "low": low, "high": high})
        del repeated
    del hashes, keys, rows, sent
    tx.trim()
    kinds = [("chunk", pa.int64())] + [(c, pa.binary()) for c in ("ids", "tags", "first", "low", "high")]
    return pa.Table.from_pylist(out, pa.schema(kinds))


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        ids = np.cumsum(np.frombuffer(own["ids"], dtype=np.int64))
        tags, first = np.frombuffer(own["tags"], dtype=np.int64), np.frombuffer(own["first"], dtype="<u4").astype(np.int64)
        places = np.concatenate([_places(r["low"], r["high"]) for r in rows])
        change = np.zeros(int(first[-1]) + 1, dtype=np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + width, -1)
        gone = np.cumsum(change[:-1]) > 0
        opens, closes = gone.copy(), gone.copy()
        opens[1:] &= ~gone[:-1]
        closes[:-1] &= ~gone[1:]
        edges = first[(first > 0) & (first < len(gone))]
        opens[edges], closes[edges - 1] = gone[edges], gone[edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        owner = np.searchsorted(first, starts, side="right") - 1
        out = []
        for doc in np.unique(owner):
            a, b = np.searchsorted(owner, (doc, doc + 1))
            pairs = np.stack((starts[a:b], ends[a:b]), axis=1) - first[doc]
            doc_id = None if ids[doc] == NO_ID else int(ids[doc])
            out.append({"doc_id": doc_id, "tag": int(tags[doc]), "cuts": pairs.astype("<u4").tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("cuts", pa.binary())]))

    return run


def repeated_intervals(
    docs: DataFrame,
    width: int = WIDTH,
    windows_per_range: int = WINDOWS_PER_RANGE,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(doc_id, tag, cuts) of documents (doc_id, text, tag) with words in windows of a smaller document.

    ``cuts`` packs maximal intervals of word numbers, end exclusive, as 32-bit pairs. The number of value
    ranges follows the bytes of all texts, so that a range fits a task; raise both sizes with the memory
    of executors. ``docs`` must give the same rows per partition when read again, as stored tables do.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, int(size // 6 // windows_per_range)).bit_length()
    packed = docs.mapInArrow(_pack(width, bits, chunk_bytes), _PACKED)
    found = packed.groupBy("part").applyInArrow(_compare, _FOUND)
    return found.groupBy("chunk").applyInArrow(_merge(width), "doc_id long, tag long, cuts binary")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = False
) -> DataFrame:
    """Every row's n_words, n_removed and kept_sha256 (kept words joined by a space), and the kept text if asked for.

    A word goes if any window of ``width`` words that covers it has a word sequence that also starts in a
    document of smaller id. A NULL text has no words; a NULL id is greater than all others; rows of one
    id do not remove each other's words; texts below ``width`` words stay whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    cuts = materialise(repeated_intervals(docs, width).dropDuplicates(["doc_id", "tag"]), "cuts")
    touched, whole = members.may_be_in(docs, cuts, "tag", "tag")
    cuts = cuts.withColumnsRenamed({"doc_id": "cut_id", "tag": "cut_tag"})
    touched = touched.join(cuts, (F.col("tag") == F.col("cut_tag")) & F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    rows = touched.select("doc_id", "text", "cuts").unionByName(whole.select("doc_id", "text", F.lit(None).cast("binary").alias("cuts")))
    fields = [T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType(), False) for c in ("n_words", "n_removed")]
    fields.append(T.StructField("kept_sha256", T.StringType(), False))
    if keep_text:
        fields.append(T.StructField("kept_text", T.StringType(), False))
    names = [f.name for f in fields]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            counts, removed, kept = [], [], []
            for text, packed in zip(batch["text"], batch["cuts"], strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if packed.is_valid:
                    pairs = np.frombuffer(packed.as_py(), dtype="<u4").astype(np.int64).reshape(-1, 2)
                    for start, end in pairs[::-1].tolist():
                        del words[start:end]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            arrays = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            arrays.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
            if keep_text:
                arrays.append(pa.array([k.decode() for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(keep, T.StructType(fields))
