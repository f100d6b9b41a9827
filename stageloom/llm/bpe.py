"""Byte-level BPE with two tiers of lookup.

A minimal perfect hash over the vocabulary resolves every pre-token that is a token itself; the
others are merged by a heap over linked bytes. Both are exact: a hash hit is compared with the
token's bytes. Results of earlier pre-tokens are kept in two bounded tables per Python process.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.llm import text as tx

# Letters and numbers that the regex module knows and the library's older Unicode tables do not.
NEWER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
NEWER_NUMBERS = [(0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6)]

KEPT_RESULTS = 300_000
LONG_TEXT = 1 << 20
KEYS_PER_BUCKET = 4
TRIES = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file with a base64 token and a rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a piece after repeatedly joining the neighbouring pair of lowest rank, leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the token that starts here ends; 0 once it was joined to its left
    before = list(range(-1, n))  # where the token left of the one starting here starts
    get = ranks.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, j = heappop(heap)
        middle = end[i]
        if not 0 < middle < j or end[middle] != j:
            continue  # a part of this pair was joined otherwise
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            rank = get(piece[i : end[j]])
            if rank is not None:
                heappush(heap, (rank, i, end[j]))
        left = before[i]
        if left >= 0:
            rank = get(piece[left:j])
            if rank is not None:
                heappush(heap, (rank, left, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, one slot per key, no empty slot."""

    def __init__(self, keys: list[bytes]):
        hashes = hash_pieces(keys)
        if len(tx.distinct(hashes)[0]) < len(keys):
            raise ValueError("two keys are equal or share a 64-bit hash")
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // KEYS_PER_BUCKET)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slot_key = np.zeros(n, dtype=np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(n, dtype=bool)
        by_size = np.argsort(-sizes, kind="stable")
        singles = []
        for b in by_size[: int((sizes > 0).sum())]:
            members = order[ends[b] - sizes[b] : ends[b]]
            if sizes[b] == 1:
                singles.append((b, members[0]))
                continue
            start = 0
            while True:
                shifts = np.arange(start, start + TRIES, dtype=np.int64)
                slots = np.sort(self._slot(hashes[members][None, :], shifts[:, None]), axis=1)
                good = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
                if good.any():
                    break
                start += TRIES
            self.shift[b] = shifts[int(good.argmax())]
            slots = self._slot(hashes[members], self.shift[b])
            free[slots], self.slot_key[slots] = False, members
        for (b, member), slot in zip(singles, np.flatnonzero(free), strict=False):
            self.shift[b] = -1 - slot
            self.slot_key[slot] = member

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> tx.U64(32)) % tx.U64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift) -> np.ndarray:
        moved = np.asarray(shift).astype(tx.U64) * tx.U64(tx.BASE)
        return (tx.mix(hashes + moved) % tx.U64(self.n)).astype(np.int64)

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash the number of the only key it can belong to."""
        shift = self.shift[self._bucket(hashes)]
        return self.slot_key[np.where(shift < 0, -1 - shift, self._slot(hashes, np.maximum(shift, 0)))]


def hash_pieces(pieces: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
    starts = np.concatenate(([0], ends[:-1])) if len(pieces) else ends
    return tx.spans_hash(tx.CODES[np.frombuffer(b"".join(pieces), dtype=np.uint8)], starts, ends)


def _ranges(spans: list[tuple[int, int]]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


def without_newer(pattern: str) -> str:
    """The pattern with the letter and number classes of the library, as set differences."""
    pattern = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_ranges(NEWER_LETTERS)}]]")
    return "(?V1)" + pattern.replace(r"\p{N}", rf"[\p{{N}}--[{_ranges(NEWER_NUMBERS)}]]")


class Encoder:
    """Encoder and decoder of one vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = list(ranks)
        self.token_ids = np.fromiter(ranks.values(), dtype="<u4", count=len(ranks))
        lengths = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(ranks))
        self.all_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.length_of = np.full(int(self.token_ids.max(initial=0)) + 1, -1, dtype=np.int64)
        self.length_of[self.token_ids] = lengths
        self.start_of = np.zeros(len(self.length_of), dtype=np.int64)
        self.start_of[self.token_ids] = np.cumsum(lengths) - lengths
        self.hash = PerfectHash(self.tokens)
        self.pattern = regex.compile(pattern)
        self.exact = regex.compile(without_newer(pattern))
        self.newer = re.compile(f"[{_ranges(NEWER_LETTERS + NEWER_NUMBERS)}]")
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}  # the table before, when this one was full

    def resolve(self, pieces: list[str]) -> None:
        """Adds the packed ids of pre-tokens to the table: perfect hash first, heap for what it misses."""
        encoded = [p.encode() for p in pieces]
        for at in range(0, len(pieces), 50_000):
            part = encoded[at : at + 50_000]
            for piece, raw, key in zip(pieces[at:], part, self.hash.candidates(hash_pieces(part)).tolist(), strict=False):
                if self.tokens[key] == raw:
                    self.known[piece] = self.token_ids[key].tobytes()
                else:
                    self.known[piece] = np.array(merge_bytes(raw, self.ranks), dtype="<u4").tobytes()

    def cutter(self, text: str) -> regex.Pattern:
        """The pattern as it stands, or for texts with newer letters or numbers with the library's classes."""
        return self.pattern if text.isascii() or not self.newer.search(text) else self.exact

    def encode(self, text: str) -> bytes:
        if len(text) > LONG_TEXT:
            matches = (m[0] for m in self.cutter(text).finditer(text))
            parts = []
            while block := list(islice(matches, 100_000)):
                parts.append(self._pack([block])[0])
            return b"".join(parts)
        return self._pack([self.cutter(text).findall(text)])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; new pre-tokens of short texts are resolved together."""
        if any(len(t) > LONG_TEXT for t in texts):
            return [self.encode(t) for t in texts]
        return self._pack([self.cutter(t).findall(t) for t in texts])

    def _pack(self, found: list[list[str]]) -> list[bytes]:
        pieces = set().union(*found)
        new = pieces - self.known.keys()
        if new and len(self.known) + len(new) > KEPT_RESULTS:
            self.earlier, self.known = self.known, {}
            new = pieces
        if new:
            seen = new & self.earlier.keys()
            self.known.update((piece, self.earlier[piece]) for piece in seen)
            self.resolve(list(new - seen))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in found]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids; an id outside the vocabulary raises KeyError."""
        out, every = [], np.frombuffer(packed, dtype="<u4")
        for at in range(0, len(every), 100_000):
            ids = every[at : at + 100_000]
            if int(ids.max()) >= len(self.length_of) or int((lengths := self.length_of[ids]).min()) < 0:
                raise KeyError("an id is not in the vocabulary")
            ends = np.cumsum(lengths)
            places = np.arange(int(ends[-1])) + np.repeat(self.start_of[ids] - ends + lengths, lengths)
            out.append(self.all_bytes[places].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python process; tasks that run in the same process share its table."""
    return Encoder(read_ranks(path), pattern)


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Per row the id column, n_tokens, ids_sha256 and decoded_sha256, and token_ids if asked for.

    ``vocabulary`` is the path of a rank file that every worker can read; ``pattern`` cuts a text into
    pre-tokens. Special tokens are ordinary text. A NULL or empty text has no tokens. Ids are decoded
    again and the digest is that of the decoded bytes. Repeated rows are encoded again.
    """
    fields = [
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
    if keep_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False))
    schema = T.StructType(fields)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)
        for batch in tx.chunks(batches):
            packed = coder.encode_many([t or "" for t in batch.column("text").to_pylist()])
            counts = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
            arrays = [
                batch.column("doc_id"),
                pa.array(counts),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(coder.decode(p)).hexdigest() for p in packed], pa.string()),
            ]
            if keep_ids:
                ids = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(offsets, ids))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)
