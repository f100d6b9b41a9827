"""Language-model scores by prediction by partial matching.

A trie of byte contexts up to ORDER bytes is counted over all training texts in Spark. A byte's
probability comes from the longest known context; on an escape (method D: half a count goes from each
different symbol to the escape) the context loses its oldest byte and symbols seen before are excluded.
The text is its words, A-Z lower-cased, joined by single spaces, and an end symbol.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.llm import text as tx
from stageloom.scratch import materialise

ORDER = 5
SHARED_ORDER = 2  # counts up to this order go to every task
SYMBOLS = 256  # bytes; 0xFE stands for the end and 0xFF for what is before the text, neither occurs in UTF-8
END, BEFORE = 0xFE, 0xFF
GRAMS_PER_SLICE = 4_000_000
HOT_WORDS = 200_000
ALPHA = 0.1
CHUNK_BYTES = 1 << 20
FLUSH_ENTRIES = 1_000_000

_U = tx.U64


def normal_stream(data: np.ndarray, offsets: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """All grams of ORDER bytes and the symbol they precede (lowest byte), and each row's first gram."""
    starts, ends, first = words
    keep = ~tx.SPACE[data]
    inner = np.ones(len(ends), dtype=bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False  # no space after a row's last word
    gaps = ends[inner]
    lowered = tx.LOWER[data]
    lowered[gaps] = 0x20
    keep[gaps] = True
    sizes = np.diff(np.concatenate(([0], np.cumsum(keep)))[offsets])
    rows = len(sizes)
    begin = np.concatenate(([0], np.cumsum(sizes + ORDER + 1)))
    stream = np.full(int(begin[-1]), BEFORE, dtype=np.uint8)
    total = int(sizes.sum())
    shift = begin[:-1] + ORDER - (np.cumsum(sizes) - sizes)
    stream[np.arange(total) + np.repeat(shift, sizes)] = lowered[keep]
    stream[begin[1:] - 1] = END
    if not rows:
        return np.zeros(0, dtype=_U), np.zeros(1, dtype=np.int64)
    grams = np.zeros(len(stream) - ORDER, dtype=_U)
    for k in range(ORDER + 1):
        grams <<= _U(8)
        grams |= stream[k : len(stream) - ORDER + k]
    return grams[stream[ORDER:] != BEFORE], np.concatenate(([0], np.cumsum(sizes + 1)))


class Table:
    """Numbers by 64-bit key: open addressing over numpy arrays, looked up many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) / 0.75).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        place = np.full(1 << bits, -1, dtype=np.int32)
        at, waiting = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(waiting):
            free = place[at[waiting]] < 0
            place[at[waiting[free]]] = waiting[free]
            waiting = waiting[place[at[waiting]] != waiting]
            at[waiting] = (at[waiting] + 1) & self.mask
        self.used = place >= 0
        self.keys = np.zeros(1 << bits, dtype=_U)
        self.keys[self.used] = keys[place[self.used]]
        self.values = np.zeros(1 << bits)
        self.values[self.used] = values[place[self.used]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(tx.BASE)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, known) of every key; an unknown key has the value 0."""
        at = self._home(keys)
        known = self.used[at] & (self.keys[at] == keys)
        values = np.where(known, self.values[at], 0.0)
        open_ = np.flatnonzero(self.used[at] & ~known)
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            used, same = self.used[at[open_]], self.keys[at[open_]] == keys[open_]
            hit = open_[used & same]
            known[hit], values[hit] = True, self.values[at[hit]]
            open_ = open_[used & ~same]
        return values, known


def _where(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, known) of keys in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Trie:
    """Grams with counts as sorted arrays per order, with what escapes need.

    ``grams`` are (ORDER bytes, symbol) of all contexts in a range of last bytes; ``shorter`` are all grams
    of SHARED_ORDER bytes and a symbol, for the orders that such a slice does not hold by itself.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shorter: np.ndarray, shorter_counts: np.ndarray):
        self.grams, self.counts, self.contexts, self.n, self.q = {}, {}, {}, {}, {}
        for order in range(ORDER, -1, -1):
            base, base_counts = (grams, counts) if order > SHARED_ORDER else (shorter, shorter_counts)
            mask = _U((1 << 8 * (order + 1)) - 1)
            self.grams[order], self.counts[order] = tx.summed(base & mask, base_counts)
            context = self.grams[order] >> _U(8)
            self.contexts[order], self.q[order] = tx.distinct(context)
            edges = np.cumsum(self.q[order]) - self.q[order]
            self.n[order] = np.add.reduceat(self.counts[order], edges) if len(edges) else edges
        # Per context of an order: what is left of the next shorter one once its symbols are excluded.
        self.left_n, self.left_q = {}, {}
        for order in range(ORDER, 0, -1):
            below = order - 1
            if not len(self.grams[order]):
                self.left_n[order] = self.left_q[order] = np.zeros(0)
                continue
            parent, _ = _where(self.contexts[below], self.contexts[order] & _U((1 << 8 * below) - 1))
            same, _ = _where(self.grams[below], self.grams[order] & _U((1 << 8 * order) - 1))
            owner, _ = _where(self.contexts[order], self.grams[order] >> _U(8))
            seen = np.bincount(owner, weights=self.counts[below][same], minlength=len(self.contexts[order]))
            self.left_n[order] = self.n[below][parent] - seen
            self.left_q[order] = self.q[below][parent] - self.q[order]
        at, _ = _where(self.contexts[ORDER], self.grams[ORDER] >> _U(8))
        direct = np.log10((self.counts[ORDER] - 0.5) / self.n[ORDER][at]) if len(at) else np.zeros(0)
        self.direct = Table(self.grams[ORDER], direct)
        del self.grams[ORDER], self.counts[ORDER]  # from here on only looked up in the table

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out, known = self.direct.find(keys)
        rest = np.flatnonzero(~known)
        if len(rest):
            out[rest] = self._escaped(keys[rest])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        child, has_child = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        for order in range(ORDER, -1, -1):
            gram = keys[open_] & _U((1 << 8 * (order + 1)) - 1)
            context, has = _where(self.contexts[order], gram >> _U(8))
            place, found = (None, np.zeros(len(gram), dtype=bool)) if order == ORDER else _where(self.grams[order], gram)
            n = np.where(has, self.n[order][context] if len(self.n[order]) else 0, 0).astype(float)
            q = np.where(has, self.q[order][context] if len(self.q[order]) else 0, 0).astype(float)
            if order < ORDER and len(self.contexts[order + 1]):
                n = np.where(has_child, self.left_n[order + 1][child], n)
                q = np.where(has_child, self.left_q[order + 1][child], q)
            if found.any():
                hit = np.flatnonzero(found)
                out[open_[hit]] += np.log10((self.counts[order][place[hit]] - 0.5) / n[hit])
            escapes = np.flatnonzero(~found & has & (q > 0))  # with no symbol left an escape is certain
            out[open_[escapes]] += np.log10(0.5 * q[escapes] / n[escapes])
            open_, child, has_child = open_[~found], context[~found], has[~found]
        different = int(self.q[0][0]) if len(self.q[0]) else 0
        out[open_] -= np.log10(max(1, SYMBOLS - different))
        return out


def _counted():
    """Counts of grams (kind 0) and of word hashes (kind 1) of one partition, combined before they are sent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trie.cache_clear()  # a worker process may still hold tables of an earlier query
        _hot.cache_clear()
        held: list[list] = [[], []]
        n_words = n_rows = 0

        def combined(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = zip(*held[kind], strict=True)
            return tx.summed(np.concatenate(keys), np.concatenate(counts))

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 20_000):
                part = keys[k : k + 20_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, dtype=np.int32)), pa.array(part), pa.array(counts[k : k + 20_000])],
                    names=["kind", "key", "count"],
                )

        for batch in tx.chunks(batches, limit=CHUNK_BYTES):
            data, offsets = tx.raw(batch["text"])
            words = tx.words(data, offsets)
            held[0].append(tx.distinct(normal_stream(data, offsets, words)[0]))
            held[1].append(tx.distinct(tx.word_hashes(data, words[0], words[1], True)))
            n_words, n_rows = n_words + len(words[0]), n_rows + batch.num_rows
            for kind in (0, 1):
                if sum(len(k) for k, _ in held[kind]) > FLUSH_ENTRIES:
                    held[kind] = [combined(kind)]
                    if len(held[kind][0][0]) > FLUSH_ENTRIES // 2:
                        yield from rows(kind, *held[kind][0])
                        held[kind] = []
        for kind in (0, 1):
            if held[kind]:
                yield from rows(kind, *combined(kind))
        if n_rows:
            yield from rows(2, np.array([0, 1], dtype=_U), np.array([n_words, n_rows], dtype=np.int64))

    return run


@lru_cache(maxsize=1)
def _trie(key: str, shared) -> Trie:
    return Trie(*shared.value)


@lru_cache(maxsize=1)
def _hot(key: str, shared) -> Table:
    return Table(*shared.value)


def _long_array(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    table = rows.select(*columns).toArrow()
    return [table[c].to_numpy() for c in columns]


def slices(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Ranges of suffixes, first to last, that start at listed ones and hold at most ``limit`` grams or one entry."""
    starts, room = [0], limit
    for suffix, size in sizes:
        if size > room and room < limit:
            starts.append(suffix)
            room = limit
        room -= size
    return list(zip(starts, [s - 1 for s in starts[1:]] + [0xFFFFFF], strict=True))


def _suffix(key: Column) -> Column:
    """The last three context bytes, the last one first."""
    byte = lambda k: F.shiftright(key, 8 * k).bitwiseAND(0xFF)
    return F.shiftleft(byte(1), 16) + F.shiftleft(byte(2), 8) + byte(3)


def _suffix_sizes(grams: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Gram counts by the last two context bytes (at most 65,536 rows), by three where two have over ``limit``."""
    suffix = _suffix(F.col("key"))
    sizes = grams.groupBy(F.shiftright(suffix, 8).alias("two")).agg(F.count(F.lit(1)).alias("n")).collect()
    large = [r.two for r in sizes if r.n > limit]
    out = [(r.two << 8, r.n) for r in sizes if r.n <= limit]
    for two in large:
        inside = grams.where(F.shiftright(suffix, 8) == two)
        out += [tuple(r) for r in inside.groupBy(suffix.alias("three")).agg(F.count(F.lit(1))).collect()]
    return sorted(out)


def score_documents(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    grams_per_slice: int = GRAMS_PER_SLICE,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """Every row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    ``held_out`` is a condition on ``doc_id``; rows where it is not true train the models. The base is a
    unigram model of words and an end token with additive smoothing. A NULL text is empty: one
    end token. Rows may repeat; without training rows every byte has probability 1/256.

    Counts cover all training rows. The trie reaches tasks in slices, ranges of contexts by their last three
    bytes: at most max(grams_per_slice, 256 ** 3) grams each, one pass over the texts per slice, with
    the at most 256 ** 3 grams of SHARED_ORDER. Counts of the ``hot_words`` most frequent words are broadcast; the others are joined.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = docs.where(~F.col("held_out")).select("text")
    counts = training.mapInArrow(_counted(), "kind int, key long, count long")
    counts = materialise(counts.groupBy("kind", "key").agg(F.sum("count").alias("count")), "counts")
    totals = dict(counts.where("kind = 2").select("key", "count").collect())
    n_words, n_rows = totals.get(0, 0), totals.get(1, 0)
    grams, words = counts.where("kind = 0"), counts.where("kind = 1").select(F.col("key").alias("word"), "count")
    shorter = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (SHARED_ORDER + 1)) - 1).alias("key"))
    shorter = _long_array(shorter.agg(F.sum("count").alias("count")), "key", "count")
    shorter = shorter[0].astype(_U), shorter[1].copy()
    different = words.count()
    train_tokens = n_words + n_rows
    spread = different + (1 if n_rows else 0)
    per_token = float(np.log10(train_tokens + ALPHA * (spread + 1)))
    end_score = float(np.log10(n_rows + ALPHA))
    hot = [a.copy() for a in _long_array(words.orderBy(F.desc("count"), "word").limit(hot_words), "word", "count")]
    context = docs.sparkSession.sparkContext
    hot_shared = context.broadcast((hot[0].view(_U), np.log10(hot[1] + ALPHA)))
    rows = docs.withColumns({"score": F.lit(0.0), "tag": F.xxhash64(F.coalesce("text", F.lit("")))})
    parts = slices(_suffix_sizes(grams, grams_per_slice), grams_per_slice)
    for i, (low, high) in enumerate(parts):
        chosen = grams.where(_suffix(F.col("key")).between(low, high))
        arrays = [a.copy() for a in _long_array(chosen.select("key", "count"), "key", "count")]
        trie = context.broadcast((arrays[0].view(_U), arrays[1], *shorter))
        add = _add_scores(trie, uuid.uuid4().hex, low, high)
        if i + 1 < len(parts):
            rows = materialise(rows.mapInArrow(add, rows.schema), "scored-slices")
    tokens = rows.mapInArrow(
        _tokens(add, hot_shared, uuid.uuid4().hex),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, tag long, n_tokens long, "
        "n_hot long, hot_score double, rare array<long>, times array<long>",
    )
    tokens = materialise(tokens, "tokens")
    rare = tokens.where(F.size("rare") > 0).select("doc_id", "tag", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("doc_id", "tag", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    known = F.when(F.col("count") > 0, F.col("times")).otherwise(F.lit(0))
    summed = (
        rare.join(words, "word", "left")
        .groupBy("doc_id", "tag")
        .agg(
            F.sum(known).alias("n_rare"),
            F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + ALPHA)).alias("rare_score"),
            F.sum("times").alias("n_all"),
        )
        .withColumnsRenamed({"doc_id": "sum_id", "tag": "sum_tag"})
    )
    same = (F.col("tag") == F.col("sum_tag")) & F.col("doc_id").eqNullSafe(F.col("sum_id"))
    own = F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b)
    # Rows with the same id and text have a common sum: each row's part is the sum over the number of them.
    copies = F.col("n_all") / F.nullif(own, F.lit(0).cast("long"))
    n_known = F.col("n_hot") + F.coalesce(F.round(F.col("n_rare") / copies), F.lit(0.0)).cast("long")
    base = F.col("hot_score") + F.coalesce(F.col("rare_score") / copies, F.lit(0.0)) + end_score - F.col("n_tokens") * per_token
    return tokens.join(summed, same, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (n_known + (1 if n_rows else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def _add_scores(shared, key: str, low: int, high: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(key, shared)
        for batch in tx.chunks(batches, limit=CHUNK_BYTES):
            data, offsets = tx.raw(batch["text"])
            keys, first = normal_stream(data, offsets, tx.words(data, offsets))
            if (low, high) == (0, 0xFFFFFF):
                scores = trie.log10(keys)
            else:
                byte = lambda k: (keys >> _U(8 * k)) & _U(0xFF)  # noqa: B023, E731
                suffix = (byte(1) << _U(16)) | (byte(2) << _U(8)) | byte(3)
                mine = (suffix >= _U(low)) & (suffix <= _U(high))
                scores = np.zeros(len(keys))
                scores[mine] = trie.log10(keys[mine])
            added = batch["score"].to_numpy() + np.add.reduceat(scores, first[:-1])  # no row is without its end
            columns = [pa.array(added) if n == "score" else batch[n] for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _tokens(add, shared, key: str):
    """The last slice's scores and the words of every row in one pass, so that a task needs one Python process."""
    names = ["doc_id", "held_out", "score", "tag", "n_tokens", "n_hot", "hot_score", "rare", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _hot(key, shared)
        for batch in add(batches):
            data, offsets = tx.raw(batch["text"])
            starts, ends, first = tx.words(data, offsets)
            hashes = tx.word_hashes(data, starts, ends, True)
            values, known = hot.find(hashes)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            n_hot = np.bincount(owner[known], minlength=batch.num_rows)
            hot_score = np.bincount(owner[known], weights=values[known], minlength=batch.num_rows)
            rare, rare_owner = hashes[~known], owner[~known]
            order = np.lexsort((rare, rare_owner))
            rare, rare_owner = rare[order], rare_owner[order]
            edge = np.flatnonzero((np.diff(rare, prepend=_U(0)) != 0) | (np.diff(rare_owner, prepend=-1) != 0))
            times = np.diff(np.concatenate((edge, [len(rare)])))
            offsets32 = np.concatenate(([0], np.cumsum(np.bincount(rare_owner[edge], minlength=batch.num_rows)))).astype(np.int32)
            arrays = [
                *(batch[c] for c in names[:4]),
                pa.array(np.diff(first) + 1),
                pa.array(n_hot.astype(np.int64)),
                pa.array(hot_score.astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(offsets32), pa.array(rare[edge].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(offsets32), pa.array(times.astype(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run
