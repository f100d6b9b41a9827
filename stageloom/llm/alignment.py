"""Alignment of two tokenizers over the same bytes by interval coalescing.

Tokens of both sides are intervals of byte offsets. Sorted by start, with the running maximum of their ends, they fall
into groups: a new one begins where a start reaches the maximum of all ends before. Overlaps are expanded inside the
groups. Where neither tokenizer looks across a single blank between two words, both encode each different word once;
ids of known words are gathered from a table of bounded size. How many documents link a pair of ids is counted over the corpus; the most frequent pairs reach the tasks
as a table of fixed size, the others by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.llm import text as tx
from stageloom.operators.sizing import broadcast_if_small
from stageloom.scratch import materialise

KNOWN_PAIRS = 1 << 20  # pairs whose counts reach every task
PAIRS_HELD = 1 << 21  # different pairs that a counting task holds
WORDS_HELD = 1 << 18  # words whose ids a process keeps
LONGEST_WORD = 64  # bytes of a word that is kept
JOINED_BYTES = 1 << 14  # new words that are encoded as one text
COMMA, BAR, SEMICOLON, NOTHING = range(4)

BLANK = np.zeros(256, dtype=bool)
BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
WIDE_BLANKS = np.array([int.from_bytes(c.encode()) for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])


def byte_level_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer file of the tokenizers library; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before = parts["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and not parts["normalizer"]
        whole = parts.get("truncation") or parts.get("padding") or parts["model"].get("dropout")
        self.by_words = bool(plain and not whole and all(t["special"] for t in parts["added_tokens"]))
        alphabet, pieces = byte_level_alphabet(), self.tokenizer.get_vocab()
        self.pieces = [b""] * (max(pieces.values(), default=-1) + 1)
        for piece, i in pieces.items():
            self.pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that puts a space in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.by_words = self._by_words()

    def _by_words(self) -> bool:
        """Whether the model merges pieces, changes no characters, and has no piece with a blank behind other characters."""
        from sentencepiece import sentencepiece_model_pb2 as model

        parts = model.ModelProto.FromString(self.model.serialized_model_proto())
        form, trained = parts.normalizer_spec, parts.trainer_spec
        plain = not form.precompiled_charsmap and not form.remove_extra_whitespaces and form.add_dummy_prefix and form.escape_whitespaces
        merges = trained.model_type == model.TrainerSpec.BPE and not trained.treat_whitespace_as_suffix
        return plain and merges and not any("▁" in p.piece.lstrip("▁") or p.type == model.ModelProto.SentencePiece.USER_DEFINED for p in parts.pieces)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, out_type=int, num_threads=1)


class Side:
    """Ids of one tokenizer with their bytes."""

    def __init__(self, tokenizer):
        self.encode, self.by_words = tokenizer.encode, tokenizer.by_words
        self.bytes = pa.array(tokenizer.pieces, pa.binary())
        self.lengths = np.array([len(p) for p in tokenizer.pieces], dtype=np.int64)

    def tokens(self, texts: list[str], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, their number by text, and whether each text's tokens join to the wanted bytes."""
        found = self.encode(texts)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum()))
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
        joined = tx.raw(self.bytes.take(pa.array(ids)))[0].tobytes()
        if joined == b"".join(wanted) and np.array_equal(np.diff(ends), [len(w) for w in wanted]):
            return ids, counts, np.ones(len(texts), dtype=bool)
        good = [joined[a:b] == w for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted, strict=True)]
        return ids, counts, np.array(good, dtype=bool)


    def joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words that begin with a blank and end without one, several encoded as one text."""
        found, sizes = [], np.array([len(w) for w in words], dtype=np.int64)
        for i, j in tx.runs(sizes, JOINED_BYTES):
            some, whole = words[i:j], b"".join(words[i:j])
            ids, _, good = self.tokens([whole[1:].decode()], [whole])
            ends, stops = np.cumsum(self.lengths[ids]), np.cumsum(sizes[i:j])
            last = np.searchsorted(ends, stops)
            if good[0] and np.array_equal(ends[last], stops):
                found.append((ids, np.diff(last, prepend=-1), np.ones(len(some), dtype=bool)))
            else:
                found.append(self.tokens([w[1:].decode() for w in some], some))
        none = np.zeros(0, dtype=np.int64)
        return tuple(map(np.concatenate, zip((none, none, np.zeros(0, dtype=bool)), *found, strict=True)))


def word_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where words begin: at every text, and at every blank between two characters that are none.

    Neither tokenizer's result depends on what lies beyond such a place. ``edges`` are the texts' first bytes and the end.
    """
    first = np.zeros(len(data) + 1, dtype=bool)
    first[edges] = True
    at = np.flatnonzero(data == 0x20)
    at = at[~first[at] & ~first[at + 1]]
    at = at[~BLANK[data[at - 1]] & ~BLANK[data[at + 1]]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    if len(wide):
        one, two, three = (data[at[wide] - k].astype(np.int64) for k in (1, 2, 3))
        blank = np.isin((two << 8) | one, WIDE_BLANKS) | np.isin((three << 16) | (two << 8) | one, WIDE_BLANKS)
        at = np.delete(at, wide[blank])
    first[at] = True
    return np.flatnonzero(first[:-1])


class Words:
    """Ids of words by both tokenizers; up to WORDS_HELD words are kept from batch to batch."""

    def __init__(self, *both: Side):
        self.both, self.slots = both, {}
        none = np.zeros(0, dtype=np.int64)
        self.tables = [(none, none, np.zeros(0, dtype=bool)) for _ in both]

    def tokens(self, wanted: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each side what ``Side.tokens`` gives for texts with a blank in front."""
        data = np.frombuffer(b"".join(wanted), dtype=np.uint8)
        edges = np.concatenate(([0], np.cumsum([len(w) for w in wanted])))
        starts = word_starts(data, edges)
        offsets = np.append(starts, len(data)).astype(np.int32)
        encoded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        words = encoded.dictionary.to_pylist()
        slot = np.array([self.slots.get(w, -1) for w in words], dtype=np.int64)
        new = np.flatnonzero(slot < 0)
        plain = np.array([len(words[i]) <= LONGEST_WORD and not words[i].decode()[-1].isspace() for i in new.tolist()], dtype=bool)
        new, n_plain = np.concatenate((new[plain], new[~plain])), int(plain.sum())
        have = len(self.tables[0][1])
        slot[new] = have + np.arange(len(new))
        fresh = [words[i] for i in new.tolist()]
        keep = n_plain if have + n_plain <= WORDS_HELD else 0
        self.slots.update(zip(fresh[:keep], range(have, have + keep), strict=True))
        text, word = np.searchsorted(starts, edges[:-1]), slot[encoded.indices.to_numpy()]
        out = []
        for k, side in enumerate(self.both):
            others = side.tokens([w[1:].decode() for w in fresh[n_plain:]], fresh[n_plain:])
            ids, counts, good = map(np.concatenate, zip(self.tables[k], side.joined(fresh[:n_plain]), others, strict=True))
            first, n = np.cumsum(counts) - counts, counts[word]
            at = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((ids[at], np.add.reduceat(n, text), np.logical_and.reduceat(good[word], text)))
            if keep:
                self.tables[k] = ids[: int(counts[: have + keep].sum())], counts[: have + keep], good[: have + keep]
        return out


@lru_cache(maxsize=2)
def known_words(a_path: str, b_path: str) -> Words | None:
    """The process's table of words, if both tokenizers allow it."""
    a, b, _ = sides(a_path, b_path)
    return Words(a, b) if a.by_words and b.by_words else None


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side, pa.Array]:
    """Both tokenizers, loaded once per Python process, and the decimal ids with each sign that may follow them."""
    a, b = Side(ByteLevel(a_path)), Side(Pieces(b_path))
    largest = max(len(a.lengths), len(b.lengths))
    return a, b, pa.array([f"{i}{sign}" for i in range(largest) for sign in (",", "|", ";", "")], pa.large_string())


def coalesce(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and every B interval, numbered by place."""
    starts, ends = np.concatenate((a_starts, b_starts)), np.concatenate((a_ends, b_ends))
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_starts)], group[len(a_starts) :]


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all A and B intervals that share a byte; both sides are in order and do not overlap themselves."""
    low, high = np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left")
    counts = np.maximum(high - low, 0)
    first = np.cumsum(counts) - counts
    a = np.repeat(np.arange(len(a_starts)), counts)
    return a, np.arange(len(a)) - first[a] + low[a]


def group_texts(table: pa.Array, ids: tuple, groups: tuple, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2` for all groups in a row, and where each id's text ends; ``last`` marks a text's last groups."""
    (a, b), (a_group, b_group) = ids, groups
    n = len(last)
    a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    place_a = np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group]
    place_b = np.arange(len(b)) + np.cumsum(a_count)[b_group]
    a_sign, b_sign = np.full(len(a), COMMA), np.full(len(b), COMMA)
    a_sign[np.cumsum(a_count) - 1] = BAR
    b_sign[np.cumsum(b_count) - 1] = np.where(last, NOTHING, SEMICOLON)
    entries = np.empty(len(a) + len(b), dtype=np.int64)
    entries[place_a], entries[place_b] = a * 4 + a_sign, b * 4 + b_sign
    return tx.raw(table.take(pa.array(entries)))


def _kind(largest: int) -> str:
    return "<u2" if largest <= 1 << 16 else "<u4"


def _aligned(a_path: str, b_path: str, schema: T.StructType, keep_groups: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b, table = sides(a_path, b_path)
        known = known_words(a_path, b_path)
        kinds = _kind(len(side_a.lengths)), _kind(len(side_b.lengths))
        for batch in tx.chunks(batches):
            n = len(batch)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            wanted = [(" " + t).encode() for t in texts]
            both = known.tokens(wanted) if known else (side_a.tokens(texts, wanted), side_b.tokens(texts, wanted))
            (a, a_counts, good), (b, b_counts, also) = both
            good = good & also & np.array([bool(t) for t in texts], dtype=bool)
            a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
            a_counts, b_counts = a_counts * good, b_counts * good
            a_ends, b_ends = np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b])
            a_starts, b_starts = a_ends - side_a.lengths[a], b_ends - side_b.lengths[b]
            # All texts lie in a row: where one ends, tokens of both sides end.
            groups = coalesce(a_starts, a_ends, b_starts, b_ends)
            a_at, b_at = overlaps(a_starts, a_ends, b_starts, b_ends)
            a_doc = np.repeat(np.arange(n), a_counts)
            group_doc = a_doc[np.unique(groups[0], return_index=True)[1]]
            n_groups = np.bincount(group_doc, minlength=n)
            last = np.concatenate((group_doc[1:] != group_doc[:-1], [True])) if len(group_doc) else np.zeros(0, dtype=bool)
            data, ends = group_texts(table, (a, b), groups, last)
            edges = ends[np.concatenate(([0], np.cumsum(a_counts + b_counts)))]
            strings = [data[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            # Different pairs of each document: document, A id and B id in one number.
            bits = max(len(side_b.lengths) - 1, 1).bit_length()
            low = max(len(side_a.lengths) - 1, 1).bit_length() + bits
            pair = (a_doc[a_at] << low) | (a[a_at] << bits) | b[b_at]
            pair, times = tx.distinct(pair)
            per_doc = np.concatenate(([0], np.cumsum(np.bincount(pair >> low, minlength=n))))
            a_pair, b_pair = ((pair >> bits) & ((1 << (low - bits)) - 1)).astype(kinds[0]), (pair & ((1 << bits) - 1)).astype(kinds[1])
            slices = list(zip(per_doc[:-1].tolist(), per_doc[1:].tolist(), strict=True))
            columns = [
                batch.column("doc_id"),
                *(pa.array(c) for c in (a_counts, b_counts, n_groups, np.bincount(a_doc[a_at], minlength=n))),
                pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in strings], pa.string()),
                *(pa.array([x[i:j].tobytes() for i, j in slices], pa.binary()) for x in (a_pair, b_pair, times.astype("<u4"))),
            ]
            if keep_groups:
                stops = a_ends[np.searchsorted(groups[0], np.arange(len(group_doc)), side="right") - 1]
                base = np.concatenate(([0], a_ends))[np.concatenate(([0], np.cumsum(a_counts)))]
                where = np.concatenate(([0], np.cumsum(n_groups)))
                columns.append(pa.array([s.decode() for s in strings], pa.string()))
                columns.append(pa.array([(stops[where[i] : where[i + 1]] - base[i]).tolist() for i in range(n)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def _pairs(batch: pa.RecordBatch, kinds: tuple[str, str]) -> np.ndarray:
    """A and B id of the batch's pairs in one number each."""
    a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=k).astype(np.int64) for c, k in zip(("a", "b"), kinds, strict=True))
    return (a << 32) | b


def _counted(kinds: tuple[str, str]):
    """In how many documents each pair occurs; counts leave the task when it holds too many pairs, and at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                new, n = tx.distinct(_pairs(batch.slice(at, 256), kinds))
                held, counts = tx.summed(np.concatenate((held, new)), np.concatenate((counts, n)))
                if len(held) > PAIRS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])
                    held, counts = held[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])
        tx.trim()

    return run


def pair_counts(encoded: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """(pair, n, best): documents that hold a pair of ids linked, and whether no pair of its A id has more. Stored."""
    counts = encoded.select("a", "b").mapInArrow(_counted(kinds), "pair long, n long")
    counts = materialise(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # at most one row for each A id
    joined = counts.join(broadcast_if_small(most), a == F.col("a"))
    return materialise(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "linked-pairs")


def _summed_counts(shared, kinds: tuple[str, str], names: list[str]):
    """Adds n_best and count_sum of the known pairs, and the pairs that are not known, to each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                pairs, n = _pairs(batch, kinds), len(batch)
                times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<u4").astype(np.int64)
                doc = np.repeat(np.arange(n), [len(x) // 4 for x in batch.column("times").to_pylist()])
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
                place, total, most = place[hit], np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                np.add.at(total, doc[hit], counts[place] * times[hit])
                np.add.at(most, doc[hit], best[place] * times[hit])
                rare = np.concatenate(([0], np.cumsum(np.bincount(doc[~hit], minlength=n)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(rare), pa.array(x[~hit])) for x in (pairs, times)]
                kept = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(most), pa.array(total), *lists], names=[*names, "n_best", "count_sum", "rare", "often"])

    return run


def align_documents(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_groups: bool = False,
    known_pairs: int = KNOWN_PAIRS,
) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A is a byte-level tokenizer file over a space and the text, B a sentencepiece model that adds the space; both paths
    must be readable by every worker. Groups are cut where tokens of both end; links are the pairs of tokens that share
    bytes. A pair's count is the number of rows that hold it linked; ``n_best`` counts links whose count is the highest of
    their A id, ``count_sum`` adds counts over links. ``keep_groups`` adds ``groups`` (`a1,a2|b1;a3|b2`, decimal ids)
    and ``group_ends`` (byte offsets in space and text).

    A NULL or empty text, or one whose tokens do not join to space and text, has no tokens: zeros and ''. Ids, also NULL
    ones, only pass by; a repeated row counts as another document; an empty table gives no rows. Other columns are
    ignored. A text is tokenized whole. Counts of ``known_pairs`` pairs reach the tasks, those of the others are joined.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    long = [T.StructField(c, T.LongType(), False) for c in ("n_a", "n_b", "n_groups", "n_links")]
    fields = [T.StructField("doc_id", id_type), *long, T.StructField("groups_sha256", T.StringType(), False)]
    fields += [T.StructField(c, T.BinaryType(), False) for c in ("a", "b", "times")]
    if keep_groups:
        fields += [T.StructField("groups", T.StringType(), False), T.StructField("group_ends", T.ArrayType(T.LongType()), False)]
    schema = T.StructType(fields)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    encoded = materialise(rows.mapInArrow(_aligned(a_path, b_path, schema, keep_groups), schema), "aligned")
    a, b, _ = sides(a_path, b_path)
    kinds = _kind(len(a.lengths)), _kind(len(b.lengths))
    pairs = pair_counts(encoded, kinds)
    top = pairs.orderBy(F.desc("n"), "pair").limit(known_pairs).toArrow()
    order = np.argsort(top.column("pair").to_numpy(), kind="stable")
    known = tuple(top.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast((known[0], known[1], known[2].astype(np.int64)))
    names = [f.name for f in fields if f.name not in ("a", "b", "times")]
    out = T.StructType([f for f in fields if f.name in names])
    lists = T.ArrayType(T.LongType())
    out = out.add("n_best", T.LongType()).add("count_sum", T.LongType()).add("rare", lists).add("often", lists)
    result = encoded.mapInArrow(_summed_counts(shared, kinds, names), out)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *names[6:]]
    if len(order) < known_pairs:
        return result.select(columns)
    # The rest of the pairs occur in few documents each: only their occurrences are shuffled.
    result = materialise(result.withColumn("row", F.monotonically_increasing_id()), "known-counts")
    rare = result.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "often")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("pair"), F.col("r.often").alias("often")).join(pairs, "pair")
    best = F.when(F.col("best"), F.col("often")).otherwise(F.lit(0).cast("long"))
    rare = rare.groupBy("row").agg(F.sum(best).alias("more_best"), F.sum(F.col("n") * F.col("often")).alias("more"))
    result = result.join(rare, "row", "left").withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0).cast("long")),
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0).cast("long")),
        }
    )
    return result.select(columns)
