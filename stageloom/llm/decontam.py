"""Benchmark decontamination by spaced seeds.

Fixed masks look at some of SPAN neighbouring words and ignore the others. Hashes of masked windows of
test items and of documents are joined; a hit is verified on the whole window, which may differ in
MOST_DIFFERENT words. The masks ignore every pair of positions at least once, so no such window is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.llm import members
from stageloom.llm import text as tx
from stageloom.scratch import materialise

SPAN, MOST_DIFFERENT = 10, 2
LEAST_WORDS = 5  # shorter items only match as whole lines or sentences, see short_items of overlaps
MAP_BITS = 1 << 26

_GROUPS = [list(range(g, SPAN, 4)) for g in range(4)]
# Two of four interleaved groups are ignored; any two positions lie in two groups at most.
MASKS = [sorted(set(range(SPAN)) - {*_GROUPS[a], *_GROUPS[b]}) for a, b in combinations(range(4), MOST_DIFFERENT)]

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BREAKS, _STOPS, _CLOSING = (np.isin(np.arange(256), list(c)) for c in (b"\n\r\v\f", b".!?", b"\"')]}"))
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "、。「」『』！，．？：；（）"])
_WIDE_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "。！？．"])


def _unsegmented(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length in bytes of each character of a script without spaces between words."""
    at = np.flatnonzero(data >= 0xE0)
    lead, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    has = lambda byte, low, high: (lead == byte) & (second >= low) & (second <= high)
    found = has(0xE0, 0xB8, 0xBF) | has(0xE1, 0x80, 0x82) | has(0xE1, 0x9E, 0x9F)  # Thai, Lao, Tibetan; Myanmar; Khmer
    found |= has(0xE3, 0x81, 0x83) | has(0xE3, 0x90, 0xBF) | ((lead >= 0xE4) & (lead <= 0xE9)) | has(0xEF, 0xA4, 0xAB)  # kana, Han
    found |= has(0xF0, 0xA0, 0xB3)
    return at[found], np.where(lead[found] == 0xF0, 4, 3)


def _wide_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each wide punctuation mark, and whether it ends a sentence."""
    at = np.flatnonzero((data[:-2] == 0xE3) | (data[:-2] == 0xEF)) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    code = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
    known = np.isin(code, _WIDE)
    return at[known], np.isin(code[known], _WIDE_ENDS)


def normal_words(data: np.ndarray, offsets: np.ndarray, cut: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, A-Z lower-cased and without ASCII punctuation, and each row's first word.

    With ``cut`` characters of scripts without spaces are words, and their punctuation is left out too.
    """
    return _words_and_edges(data, offsets, cut, False)[:2]


def _words_and_edges(data: np.ndarray, offsets: np.ndarray, cut: bool, edges: bool):
    """normal_words, and with ``edges`` for each word whether a line or sentence begins or ends with it."""
    kept = ~_MARKS[data]
    wide, ends_sentence = _wide_marks(data) if cut else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))
    for k in range(3):
        kept[wide + k] = False
    moved = np.concatenate(([0], np.cumsum(kept)))
    bounds = moved[np.concatenate((offsets, _bounds(data, offsets), wide[ends_sentence]))] if edges else None
    offsets, data = moved[offsets], data[kept]
    starts, ends, first = tx.words(data, offsets)
    if cut:
        at, size = _unsegmented(data)
        at = np.unique(np.concatenate((at, at + size)))
        word = np.searchsorted(starts, at, side="right") - 1
        at = at[(word >= 0) & (starts[word] < at) & (at < ends[word])] if len(starts) else at[:0]
        starts, ends = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
        first = np.searchsorted(starts, offsets)
    hashes = tx.word_hashes(data, starts, ends, True)
    if not edges:
        return hashes, first, None, None
    bounds.sort()
    before = np.concatenate(([0], ends))[: len(starts)]
    begins = np.searchsorted(bounds, starts, side="right") > np.searchsorted(bounds, before, side="left")
    return hashes, first, begins, np.concatenate((begins[1:], [True]))[: len(starts)]


def _bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Line breaks, and . ! ? before a blank, a closing quote or bracket or the end of a row."""
    last = np.zeros(len(data) + 1, dtype=bool)
    last[offsets] = True
    follows = np.concatenate((tx.SPACE[data[1:]] | _CLOSING[data[1:]], [True])) if len(data) else np.zeros(0, dtype=bool)
    return np.flatnonzero(_BREAKS[data] | (_STOPS[data] & (follows | last[1:])))


def _seeds(hashes: np.ndarray, at: np.ndarray, mask: list[int], salt: int) -> np.ndarray:
    power = tx.powers(tx.BASE, SPAN + 2)
    total = np.zeros(len(at), dtype=tx.U64)
    for k in mask:
        total += hashes[at + k] * power[k + 1]
    return tx.mix(total + tx.U64(salt + 1)).view(np.int64)


def _windows(
    hashes: np.ndarray, first: np.ndarray, lengths: list[int], short_items: bool, begins=None, closes=None
) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(places, window length, seeds of each mask as columns): full windows, then those of shorter lengths.

    With ``short_items`` the masks of lengths from LEAST_WORDS on ignore each single position, and lengths
    below that only stand where ``begins`` and ``closes`` have a line or sentence.
    """
    at = tx.window_starts(first, SPAN)
    yield at, SPAN, np.stack([_seeds(hashes, at, mask, i) for i, mask in enumerate(MASKS)], axis=1)
    for length in lengths:
        at = tx.window_starts(first, length)
        if begins is not None and length < LEAST_WORDS:
            at = at[begins[at] & closes[at + length - 1]]
        if not short_items or length < LEAST_WORDS:
            yield at, length, _seeds(hashes, at, list(range(length)), 100 + length)[:, None]
            continue
        masks = [[k for k in range(length) if k != left] for left in range(length)]
        yield at, length, np.stack([_seeds(hashes, at, mask, 1000 + SPAN * length + i) for i, mask in enumerate(masks)], axis=1)


def _item_seeds(short_items: bool):
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.int64()), ("item_place", pa.int64()), ("item_window", pa.list_(pa.int64())), ("seed", pa.int64())])
    lengths = list(range(1 if short_items else LEAST_WORDS, SPAN))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            hashes, first = normal_words(*tx.raw(batch["text"]), short_items)
            ids, counts = batch["item_id"].to_pylist(), np.diff(first)
            signed, rows = hashes.view(np.int64), []
            for at, length, seeds in _windows(hashes, first, lengths, short_items):
                for place, values in zip(at.tolist(), seeds.tolist(), strict=True):
                    item = int(np.searchsorted(first, place, side="right")) - 1
                    if counts[item] >= SPAN if length == SPAN else counts[item] == length:
                        window = signed[place : place + length].tolist()
                        rows += [(ids[item], int(counts[item]), place - int(first[item]), window, seed) for seed in values]
            for k in range(0, len(rows), 5000):
                columns = zip(*rows[k : k + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _document_seeds(lengths: list[int], short_items: bool, shared):
    names = ["doc_id", "tag", "place", "window", "seeds"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            edges = bool(lengths) and lengths[0] < LEAST_WORDS
            hashes, first, begins, closes = _words_and_edges(*tx.raw(batch["text"]), short_items, edges)
            signed = hashes.view(np.int64)
            for at, length, seeds in _windows(hashes, first, lengths, short_items, begins, closes):
                hit = members.marked(shared.value, seeds)
                rows = np.flatnonzero(hit.any(axis=1))
                if not len(rows):
                    continue
                at, hit, seeds = at[rows], hit[rows], seeds[rows]
                owner = np.searchsorted(first, at, side="right") - 1
                windows = signed[at[:, None] + np.arange(length)]
                lists = lambda values, counts: pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(owner)),
                        batch["tag"].take(pa.array(owner)),
                        pa.array(at - first[owner]),
                        lists(windows.ravel(), np.full(len(at), length)),
                        lists(seeds[hit], hit.sum(axis=1)),
                    ],
                    names=names,
                )

    return run


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    short_items: bool = False,
) -> DataFrame:
    """One row per document and item that share a window: doc_id, tag, item_id, n_windows, first_word, last_word, item_share.

    A shared window is SPAN aligned words of which MOST_DIFFERENT may differ, or a whole item of LEAST_WORDS
    to SPAN - 1 words. With ``short_items`` one word of such an item may differ too, an item of fewer words
    is found where it is a whole line or sentence (or several), and characters of scripts without spaces
    between words count as words. ``tag`` is xxhash64 of the text and tells rows of one id apart; repeated rows
    of a document or item count once. n_windows counts the document's shared windows, first_word and
    last_word (of the punctuation-free words) bound them, item_share is the part of the item's words they
    cover. NULL and short texts share nothing; an empty table gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    seeds = items.mapInArrow(
        _item_seeds(short_items), "item_id long, words long, item_place long, item_window array<long>, seed long"
    )
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    short = seeds.where(F.col("words") < SPAN).select("words").distinct().collect()  # a few lengths below SPAN
    shared = docs.sparkSession.sparkContext.broadcast(members.bit_map(seeds, "seed", MAP_BITS))
    found = docs.mapInArrow(
        _document_seeds(sorted(int(r[0]) for r in short), short_items, shared),
        "doc_id long, tag long, place long, window array<long>, seeds array<long>",
    )
    hits = found.select("doc_id", "tag", "place", "window", F.explode("seeds").alias("seed")).join(seeds, "seed")
    equal = F.size(F.filter(F.zip_with("window", "item_window", lambda a, b: a == b), lambda same: same))
    least = F.when(F.col("words") >= SPAN, SPAN - MOST_DIFFERENT)
    if short_items:
        least = least.when(F.col("words") >= LEAST_WORDS, F.col("words") - 1)
    least = least.otherwise(F.col("words"))
    verified = hits.where(F.size("window") == F.size("item_window")).where(equal >= least)
    width = F.size("window").cast("long")
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("item_place", F.col("item_place") + width - 1))))
    return (
        verified.groupBy("doc_id", "tag", "item_id")
        .agg(
            F.count_distinct("place").alias("n_windows"),
            F.min("place").alias("first_word"),
            F.max(F.col("place") + width - 1).alias("last_word"),
            F.size(covered).alias("covered"),
            F.max("words").alias("words"),
        )
        .select(
            "doc_id", "tag", "item_id", "n_windows", "first_word", "last_word", (F.col("covered") / F.col("words")).alias("item_share")
        )
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_items: bool = False) -> DataFrame:
    """Rows of ``docs`` with all their columns that share no window with any test item."""
    hit = overlaps(docs, benchmark, id_col, text_col, short_items=short_items).select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct()
    hit = materialise(hit, "contaminated")
    return members.rows_without(docs, hit, id_col, text_col)
