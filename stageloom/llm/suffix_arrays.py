"""Substring dedup by suffix arrays: every byte in a 200-byte string that starts more than once goes.

Windows (strings of the width) are dealt to shards by content: a window's key is the least hash of the short strings
inside it, so equal windows meet, and neighbouring windows share a key and travel as one segment of text. Keys that
occur once in the corpus are counted out first. A shard sorts the suffixes of its different segments by
Larsson-Sadakane refinement and finds windows that agree by Kasai's rule. A key with more segments than a shard should
hold is spread: chunks sort the fingerprints of its windows, and the sorted runs of one value range are merged by
binary search. The same merge counts keys. Both are exact up to 64-bit fingerprints of keys and hot windows; a shard
compares bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.llm import members
from stageloom.llm import text as tx
from stageloom.scratch import materialise

WIDTH = 200
CHUNK_BYTES = 2 << 20
VALUES_PER_RANGE = 1 << 20
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 1 << 16  # bytes that are hashed or sorted together; a key with more text in a shard stays whole
HOT_SEGMENTS = 8192  # a key of more segments does not go to a shard
LONGEST_RUN = 255  # windows of one segment
LARGEST = tx.U64((1 << 64) - 1)

BREAK = 128  # positions after which a common prefix is compared anew

_PACKED = "part long, chunk long, first long, hashes binary, counts binary, docs binary, at binary, windows binary, slot binary"
_MATCHED = "chunk long, place binary, hashes binary, levels binary, docs binary, at binary, windows binary, slot binary"
_RUNS = "tag long, tag2 long, base long, at binary, windows binary, levels binary, keys binary"
_CUT = "tag long, tag2 long, start long, stop long"


def _text_key(column: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text."""
    text = F.coalesce(column, F.lit(""))
    return [F.xxhash64(text).alias("tag"), F.xxhash64(F.lit(1), text).alias("tag2")]


# Suffix arrays


def suffix_array(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the bytes ordered by their first ``depth`` bytes or more, and the rank of each.

    Larsson-Sadakane: suffixes start in groups of equal first eight bytes; each round sorts the groups that still have
    several members by the rank of the suffix ``h`` bytes on and doubles ``h``. Single suffixes are left alone. Zero bytes
    follow the data, so that suffixes that reach its end may share a rank.

    With ``wanted`` (one flag a byte) only those suffixes are in order, by their first ``depth`` bytes, which all must have; a round
    leaves out suffixes that neither they nor a later round look up.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8))).astype(tx.U64)
    key = np.zeros(n, dtype=tx.U64)
    for j in range(8):
        key = (key << tx.U64(8)) | padded[j : j + n]
    # (bytes known before, bytes looked ahead, suffixes looked up) of each round, the last one first.
    rounds, needed, known = [], wanted, [8]
    while known[-1] < depth:
        known.append(2 * known[-1])
    for h in reversed(known[:-1]):
        step = h if wanted is None else min(h, depth - h)
        rounds.append((step, needed))
        if needed is not None:
            needed = needed.copy()
            needed[step:] |= rounds[-1][1][: n - step]
    order = np.argsort(key)
    # Zero bytes and the end of the data give equal keys; the rank of the end, -1, tells them apart later.
    rank, open_ = _regroup(order, key[order], np.arange(n), np.zeros(n, dtype=np.int64))
    for step, needed in reversed(rounds):
        suffixes = order[open_]
        if needed is not None:
            kept = needed[suffixes]
            suffixes, open_ = suffixes[kept], open_[kept]
        if not len(open_):
            break
        after = np.where(suffixes + step < n, rank[np.minimum(suffixes + step, n - 1)], -1)
        pair = rank[suffixes] * (n + 1) + after + 1
        by = np.argsort(pair)
        order[open_] = suffixes[by]
        rank, open_ = _regroup(suffixes[by], pair[by], open_, rank)
    return order, rank


def _regroup(suffixes: np.ndarray, keys: np.ndarray, places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of suffixes in order at the given places (the first place of their group), and places of groups of several."""
    edge = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(edge)
    sizes = np.diff(np.concatenate((heads, [len(keys)])))
    rank[suffixes] = np.repeat(places[heads], sizes)
    return rank, places[np.repeat(sizes > 1, sizes)]


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place of an order of some or all suffixes, how many bytes (at most ``limit``) it shares with the place before.

    Kasai's rule by position: where a suffix and its predecessor are themselves preceded by equal bytes, the count is one
    less than that of the position before. Only the other positions are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = data[at[follows] - 1] == data[before[follows] - 1]
    follows[1:] &= before[1:] == before[:-1] + 1
    follows[::BREAK] = False
    compared = np.flatnonzero(~follows & (before >= 0))
    shared_bytes = np.zeros(n, dtype=np.int64)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded.data, strides=(1,))  # the eight bytes from every position on
    live, done = compared, 0
    while len(live) and done < limit + BREAK:
        a, b = live + done, before[live] + done
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        length = np.full(len(live), 8, dtype=np.int64)
        some = np.flatnonzero(differ)
        lowest = differ[some] & (~differ[some] + tx.U64(1))
        length[some] = (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3
        length = np.minimum(length, np.maximum(n - np.maximum(a, b), 0))
        shared_bytes[live] += length
        live, done = live[length == 8], done + 8
    # From each compared position the counts fall by one a step.
    start = np.maximum.accumulate(np.where(follows, 0, at))
    shared_bytes = np.maximum(shared_bytes[start] - (at - start), 0)
    shared_bytes[before < 0] = 0
    return np.minimum(shared_bytes, limit)[order]


def _repeated(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the joined texts' bytes at which a window starts that does so more than once, and each text's start and end."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - width + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    order, _ = suffix_array(data, width, inside)
    order = order[inside[order]]
    alike = np.cumsum(common_prefixes(data, order, width) < width)
    repeated = np.zeros(len(data), dtype=bool)
    repeated[order] = np.bincount(alike)[alike] > 1
    return repeated, starts, ends


def repeated_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text which of its windows start more than once in all the texts."""
    repeated, starts, ends = _repeated(texts, width)
    return [repeated[a : b - width + 1] for a, b in zip(starts, ends, strict=True)]


# Keys of windows, and the merge of sorted runs


def in_windows(values: np.ndarray, width: int, better=np.minimum) -> np.ndarray:
    """The least (or by np.maximum the largest) of every ``width`` neighbouring values, by windows of doubled width."""
    size, out = 1, values
    while 2 * size <= width:
        out, size = better(out[:-size], out[size:]), 2 * size
    return better(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def window_keys(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``width`` bytes the least hash of the short strings in it, and keys that come up near themselves.

    A run of neighbouring windows with one key holds equal windows only if the key's string occurs in it twice: at less than
    a window's distance (told here), or in a run longer than the strings of a window.
    """
    strings, n = width - max(1, width // 4) + 1, len(data) - width + 1
    keys, more = [], []
    for start in range(0, n, BLOCK_BYTES):  # blocks that fit the processor's cache, with the windows around them
        low, stop = max(0, start - strings), min(n, start + BLOCK_BYTES)
        found, value, place = _block_keys(data[low : min(n, stop + strings) + width - 1], width)
        keys.append(found[start - low : stop - low])
        here = (place >= start - low) & ((place < stop - low) | (stop == n))
        more.append(value[:-1][(value[1:] == value[:-1]) & (np.diff(place) < strings) & here[:-1]])
    return np.concatenate(keys), np.concatenate(more)


def _block_keys(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window the least hash of the short strings in it; hashes and places of the strings that give a key, by hash."""
    short = max(1, width // 4)
    strings = width - short + 1
    at = np.arange(len(data) - short + 1)
    hashes = tx.spans_hash(tx.CODES[data], at, at + short)
    keys = in_windows(hashes, strings)
    # A string gives a key if it is as small as the largest key of the windows around it.
    edge = np.zeros(strings - 1, dtype=tx.U64)
    chosen = np.flatnonzero(in_windows(np.concatenate((edge, keys, edge)), strings, np.maximum) == hashes)
    order = np.argsort(hashes[chosen], kind="stable")
    return keys, hashes[chosen][order], chosen[order]


def _pieces(batches: Iterable[pa.RecordBatch], width: int, limit: int):
    """Runs of whole texts as (batch, bytes, offsets, base); a longer text in pieces that share width - 1 bytes."""
    for batch in tx.chunks(batches, limit=limit):
        data, offsets = tx.raw(batch.column("text"))
        if len(data) <= 2 * limit:
            yield batch, data, offsets, np.zeros(len(batch), dtype=np.int64)
            continue
        row = next(i for i in range(len(batch)) if offsets[i + 1] - offsets[i] > limit)
        whole, lone = data[offsets[row] : offsets[row + 1]], batch.slice(row, 1)
        for start in range(0, len(whole), limit):
            part = whole[start : start + limit + width - 1]
            yield lone, part, np.array([0, len(part)]), np.array([start], dtype=np.int64)


def _key_runs(keys: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, text and number of windows of every run of neighbouring windows of one text with one key."""
    first = np.zeros(len(keys) + 1, dtype=bool)
    first[1:-1] = keys[1:] != keys[:-1]
    last = np.maximum(offsets[1:] - width + 1, offsets[:-1])  # where a text's windows end
    first[offsets[:-1][last > offsets[:-1]]] = True
    # Windows across the end of a text are runs that no text owns.
    first[last[last < len(keys)]] = True
    edges = np.flatnonzero(first[:-1])
    sizes = np.diff(edges, append=len(keys))
    doc = np.searchsorted(offsets, edges, side="right") - 1
    own = edges < last[doc]
    edges, sizes, doc = edges[own], sizes[own], doc[own]
    pieces = -(-sizes // LONGEST_RUN)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(edges, pieces) + LONGEST_RUN * part
    return at, np.repeat(doc, pieces), np.minimum(np.repeat(edges + sizes, pieces) - at, LONGEST_RUN)


def _packed_rows(
    chunk: int, docs: np.ndarray, doc: np.ndarray, at: np.ndarray, windows: np.ndarray, keys: np.ndarray, more: np.ndarray, bits: int
) -> Iterator[dict]:
    """One row with the places of a chunk's keys, and its sorted run of keys cut by value ranges; ``more`` count again."""
    own, slot, counts = np.unique(keys, return_inverse=True, return_counts=True)
    more = more[np.isin(more, own)]
    np.add.at(counts, np.searchsorted(own, more), 1)
    sizes = np.bincount(doc, minlength=len(docs))
    head = np.column_stack((docs, sizes)).astype("<i8").tobytes()
    yield {"part": -1, "chunk": chunk, "docs": head, "at": at.astype("<u4").tobytes(), "windows": windows.astype("u1").tobytes(), "slot": slot.astype("<u4").tobytes()}
    parts = (own >> tx.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), dtype=np.int64)
    edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1])))
    counts = np.minimum(counts, 65535).astype("<u2")
    for a, b in zip(edges, [*edges[1:], len(own)], strict=True):
        yield {"part": int(parts[a]), "chunk": chunk, "first": int(a), "hashes": own[a:b].astype("<u8").tobytes(), "counts": counts[a:b].tobytes()}


def _batched(rows: Iterable[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[k : k + size], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _pack_keys(width: int, bits: int, limit: int):
    """Runs of neighbouring windows with one key, by chunks of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch, data, offsets, base in _pieces(batches, width, limit):
            serial += 1
            if np.diff(offsets).max(initial=0) < width:
                continue
            keys, more = window_keys(data, width)
            at, own, windows = _key_runs(keys, offsets, width)
            keys = keys[at]
            docs = np.column_stack([batch.column(c).to_numpy() for c in ("tag", "tag2")] + [base])
            more = np.concatenate((more, keys[windows > width - max(1, width // 4)]))
            # Least hashes are small numbers: mixed anew, they spread over all value ranges.
            rows = _packed_rows((task << 32) | serial, docs, own, at - offsets[own], windows, tx.mix(keys), tx.mix(more), bits)
            yield from _batched(rows, _schema(_PACKED))

    return run


def _merge_runs(table: pa.Table) -> pa.Table:
    """One range of values: every chunk's sorted run is looked up in the union by binary search, and counts add up.

    Level 1 is a value that occurs more than once, level 2 one of more than HOT_SEGMENTS occurrences.
    """
    rows = table.select(["chunk", "first", "hashes", "counts"]).to_pylist()
    runs = [np.frombuffer(r["hashes"], dtype="<u8") for r in rows]
    union = np.unique(np.concatenate(runs))
    total = np.zeros(len(union), dtype=np.int64)
    places = [np.searchsorted(union, r) for r in runs]
    for place, r in zip(places, rows, strict=True):
        total[place] += np.frombuffer(r["counts"], dtype="<u2")
    level = (total > 1).astype(np.uint8) + (total > HOT_SEGMENTS)
    out = []
    for run, place, r in zip(runs, places, rows, strict=True):
        hit = np.flatnonzero(level[place])
        if len(hit):
            found = (hit + r["first"]).astype("<u4").tobytes()
            out.append({"chunk": r["chunk"], "place": found, "hashes": run[hit].tobytes(), "levels": level[place][hit].astype("u1").tobytes()})
    del rows, runs, union, total, places
    tx.trim()
    return pa.Table.from_pylist(out, _schema(_MATCHED))


def _own_places(table: pa.Table) -> pa.Table:
    """One chunk: its runs of windows whose keys the merge found, by text."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["docs"] is not None)
    docs = np.frombuffer(own["docs"], dtype="<i8").reshape(-1, 4)
    slot = np.frombuffer(own["slot"], dtype="<u4")
    level, keys = np.zeros(int(slot.max(initial=0)) + 1, dtype="u1"), np.zeros(int(slot.max(initial=0)) + 1, dtype="<u8")
    for r in rows:
        if r["place"] is not None:
            place = np.frombuffer(r["place"], dtype="<u4")
            level[place], keys[place] = np.frombuffer(r["levels"], dtype="u1"), np.frombuffer(r["hashes"], dtype="<u8")
    at, windows = np.frombuffer(own["at"], dtype="<u4"), np.frombuffer(own["windows"], dtype="u1")
    out, ends = [], np.cumsum(docs[:, 3])
    for (tag, tag2, base, size), end in zip(docs.tolist(), ends.tolist(), strict=True):
        hit = end - size + np.flatnonzero(level[slot[end - size : end]])
        if len(hit):
            row = {"tag": tag, "tag2": tag2, "base": base, "at": at[hit].tobytes(), "windows": windows[hit].tobytes()}
            out.append(row | {"levels": level[slot[hit]].tobytes(), "keys": keys[slot[hit]].tobytes()})
    return pa.Table.from_pylist(out, _schema(_RUNS))


def _matched(packed: DataFrame, label: str) -> DataFrame:
    """(tag, tag2, base, at, windows, levels, keys): the places whose keys occur more than once, stored once a text."""
    packed = materialise(packed, label)
    blank = [F.lit(None).cast("binary").alias(c) for c in ("place", "hashes", "levels")]
    own = packed.where("part < 0").select("chunk", *blank, "docs", "at", "windows", "slot")
    found = packed.where("part >= 0").groupBy("part").applyInArrow(_merge_runs, _MATCHED)
    runs = own.unionByName(found).groupBy("chunk").applyInArrow(_own_places, _RUNS)
    return materialise(runs.dropDuplicates(["tag", "tag2", "base"]), f"{label}-matched")


# Segments of text, dealt to shards


def _row_runs(batch: pa.RecordBatch):
    """(text bytes, tag, tag2, at, windows, levels, keys) of each row, places counted from the text's start."""
    for i in range(len(batch)):
        text = batch["text"][i].as_py().encode()
        at = np.frombuffer(batch["at"][i].as_py(), dtype="<u4").astype(np.int64) + batch["base"][i].as_py()
        windows = np.frombuffer(batch["windows"][i].as_py(), dtype="u1").astype(np.int64)
        levels, keys = (np.frombuffer(batch[c][i].as_py(), dtype=k) for c, k in (("levels", "u1"), ("keys", "<u8")))
        yield text, batch["tag"][i].as_py(), batch["tag2"][i].as_py(), at, windows, levels, keys


def _segments(width: int, shards: int, limit: int):
    """Texts of runs that go to shards; equal ones of a chunk once, with their places and number."""
    ddl = "shard long, key long, text binary, places binary, times long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, limit=limit):
            seen: dict[bytes, list] = {}
            for text, tag, tag2, at, windows, levels, keys in _row_runs(batch):
                cold = levels == 1
                for a, n, key in zip(at[cold].tolist(), windows[cold].tolist(), keys[cold].tolist(), strict=True):
                    entry = seen.setdefault(text[a : a + n + width - 1], [key, set(), 0])
                    entry[1].add((tag, tag2, a))
                    entry[2] += 1
            for start in range(0, len(seen), 4096):
                some = list(islice(seen.items(), start, start + 4096))
                columns = (
                    [key % shards for _, (key, _, _) in some],
                    [key - (1 << 63) for _, (key, _, _) in some],
                    [text for text, _ in some],
                    [struct.pack(f"<{3 * len(places)}q", *chain.from_iterable(sorted(places))) for _, (_, places, _) in some],
                    [times for _, (_, _, times) in some],
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _schema(ddl), strict=True)], schema=_schema(ddl))

    return run, ddl


def _in_shard(width: int):
    """One shard: intervals of bytes in windows that start more than once."""

    def run(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        own = np.array([number.setdefault(t, len(number)) for t in table.column("text").to_pylist()], dtype=np.int64)
        texts, sizes = list(number), np.array([len(t) for t in number], dtype=np.int64)
        times = np.zeros(len(texts), dtype=np.int64)
        np.add.at(times, own, table.column("times").to_numpy())
        keys = np.zeros(len(texts), dtype=np.int64)
        keys[own] = table.column("key").to_numpy()
        _, key, different = np.unique(keys, return_inverse=True, return_counts=True)
        # A text that occurs twice goes as a whole; if its key has no other text, nothing is left to sort.
        whole = np.flatnonzero(times > 1)
        owners, spans = [whole], [np.column_stack((np.zeros(len(whole), dtype=np.int64), sizes[whole]))]
        sorted_ = np.flatnonzero((different[key] > 1) | (times == 1))
        # Texts of different keys share no window: runs of whole keys are sorted one after the other, in the processor's cache.
        sorted_ = sorted_[np.argsort(key[sorted_], kind="stable")]
        heads = np.flatnonzero(np.diff(key[sorted_], prepend=-1))
        volume = np.add.reduceat(sizes[sorted_], heads) if len(heads) else heads
        edges = np.append(heads, len(sorted_))
        for a, b in tx.runs(volume, BLOCK_BYTES):
            some = sorted_[edges[a] : edges[b]]
            hits, starts, ends = _repeated([texts[i] for i in some.tolist()], width)
            hits = np.flatnonzero(hits)
            text = np.searchsorted(ends, hits, side="right")
            once = times[some[text]] == 1
            hits, text = hits[once], text[once]
            found = covered(hits + text, np.full(len(hits), width))  # a free place between texts: no span crosses them
            text = text[np.searchsorted(hits + text, found[:, 0])]
            owners.append(some[text])
            spans.append(found - (starts[text] + text)[:, None])
        owners, spans = np.concatenate(owners), np.concatenate(spans)
        by = np.argsort(owners, kind="stable")
        spans, counts = spans[by], np.bincount(owners, minlength=len(texts))
        first = np.cumsum(counts) - counts
        # Every place of a text gets the text's spans; chunks with equal texts name the same place.
        places = table.column("places").to_pylist()
        owner = np.repeat(own, np.array([len(p) // 24 for p in places], dtype=np.int64))
        at = np.column_stack((owner, np.frombuffer(b"".join(places), dtype="<i8").reshape(-1, 3)))[counts[owner] > 0]
        at = np.unique(at, axis=0)
        n = counts[at[:, 0]]
        row = np.repeat(np.arange(len(at)), n)
        span = spans[np.arange(len(row)) - (np.cumsum(n) - n)[row] + first[at[row, 0]]]
        columns = (at[row, 1], at[row, 2], at[row, 3] + span[:, 0], at[row, 3] + span[:, 1])
        del texts, number, places
        tx.trim()
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_schema(_CUT))

    return run


def covered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Maximal intervals (start, stop) of what the spans cover; spans that touch are one."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate((starts + lengths)[order])
    edge = np.flatnonzero(np.concatenate(([True], starts[1:] > stops[:-1])))
    return np.column_stack((starts[edge], stops[np.concatenate((edge[1:], [len(starts)])) - 1]))


def _pack_hot(width: int, bits: int, limit: int):
    """Fingerprints of the windows of hot runs, by chunks of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in tx.chunks(batches, limit=limit):
            serial += 1
            docs, owners, places, prints = [], [], [], []
            for text, tag, tag2, at, windows, levels, _ in _row_runs(batch):
                at, windows = at[levels == 2], windows[levels == 2]
                if not len(at):
                    continue
                starts = np.repeat(at, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                for a in range(0, len(starts), limit):
                    some = starts[a : a + limit]
                    low = int(some.min())
                    data = np.frombuffer(text, dtype=np.uint8)[low : int(some.max()) + width]
                    prints.append(tx.spans_hash(tx.CODES[data], some - low, some - low + width))
                owners.append(np.full(len(starts), len(docs)))
                docs.append((tag, tag2, 0))
                places.append(starts)
            if docs:
                owners, places, prints = map(np.concatenate, (owners, places, prints))
                rows = _packed_rows((task << 32) | serial, np.array(docs), owners, places, np.ones(len(places)), prints, prints[:0], bits)
                yield from _batched(rows, _schema(_PACKED))

    return run


def _hot_cuts(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, tag2, at in zip(batch["tag"], batch["tag2"], batch["at"], strict=True):
                starts = np.frombuffer(at.as_py(), dtype="<u4").astype(np.int64)
                spans = covered(starts, np.full(len(starts), width))
                columns = [np.full(len(spans), tag.as_py()), np.full(len(spans), tag2.as_py()), spans[:, 0], spans[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_schema(_CUT))

    return run


def _with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts joined with their rows of ``runs``; only texts that may have some are shuffled."""
    touched = members.may_be_in(texts, runs, "tag", "tag")[0]
    return touched.join(runs, ["tag", "tag2"]).where("text IS NOT NULL")


def repeated_spans(texts: DataFrame, width: int = WIDTH, limit: int = CHUNK_BYTES) -> DataFrame:
    """(tag, tag2, spans) of texts (tag, tag2, text) that have windows which start more than once, stored.

    ``spans`` is a set of (start, stop) byte intervals, overlapping ones included. Texts with equal tags are equal.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = lambda values: max(0, int(values // VALUES_PER_RANGE)).bit_length()
    runs = _matched(texts.mapInArrow(_pack_keys(width, bits(3 * size // width), limit), _PACKED), "window-keys")
    volume, hot = runs.agg(
        F.coalesce(F.sum(F.octet_length("windows")), F.lit(0)), F.sum(F.when(F.col("levels").contains(F.lit(b"\x02")), F.octet_length("windows")))
    ).first()
    shards = max(1, int(volume * 1.5 * width // SHARD_BYTES))
    segment, ddl = _segments(width, shards, limit)
    found = _with_runs(texts, runs).mapInArrow(segment, ddl).groupBy("shard").applyInArrow(_in_shard(width), _CUT)
    if hot:
        packed = _with_runs(texts, runs.where(F.col("levels").contains(F.lit(b"\x02")))).mapInArrow(_pack_hot(width, bits(hot * width // 2), limit), _PACKED)
        found = found.unionByName(_matched(packed, "hot-windows").mapInArrow(_hot_cuts(width), _CUT))
    spans = found.groupBy("tag", "tag2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return materialise(spans, "byte-spans")


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_bytes: bool = False
) -> DataFrame:
    """Every row's n_bytes, n_removed, n_spans and kept_sha256, and with ``keep_bytes`` the kept bytes.

    A byte goes if a string of ``width`` bytes around it also starts anywhere else, in the same text too; strings do not
    cross texts and are judged on the input. Removed runs are maximal. A NULL text is empty; ids, also NULL ones, only pass
    by; repeated rows repeat each other; texts below ``width`` bytes stay whole; an empty table gives no rows. Kept
    bytes need not be whole characters. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", "text", *_text_key(F.col("text")))
    spans = repeated_spans(docs.select("tag", "tag2", "text"), width)
    touched, whole = members.may_be_in(docs, spans, "tag", "tag")
    rows = touched.join(spans, ["tag", "tag2"], "left").select("doc_id", "text", "spans")
    rows = rows.unionByName(whole.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(c, T.LongType(), False) for c in ("n_bytes", "n_removed", "n_spans")]
    fields.append(T.StructField("kept_sha256", T.StringType(), False))
    if keep_bytes:
        fields.append(T.StructField("kept_bytes", T.BinaryType(), False))
    names = [f.name for f in fields]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            counts, kept = [], []
            for text, found in zip(batch["text"], batch["spans"], strict=True):
                text, cuts = (text.as_py() or "").encode(), np.zeros((0, 2), dtype=np.int64)
                if found.is_valid:
                    start, stop = (f.to_numpy() for f in found.values.flatten())
                    cuts = covered(start, stop - start)
                removed = int((cuts[:, 1] - cuts[:, 0]).sum())
                edges = [0, *cuts.reshape(-1).tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                counts.append((len(text), removed, len(cuts)))
            columns = zip(*counts, strict=True) if counts else ([], [], [])
            arrays = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns)]
            arrays.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
            if keep_bytes:
                arrays.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(keep, T.StructType(fields))
