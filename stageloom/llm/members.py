"""A filter of fixed size in front of a shuffle: which rows may have a key of a set.

The set's keys are 64-bit hashes. Their low bits mark places in one bit map of BITS bits (or another
fixed number), whatever the set's size; a full map lets every row pass, so a filter only ever saves work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.scratch import materialise

BITS = 1 << 22


def bit_words(keys: DataFrame, column: str, size: int = BITS) -> DataFrame:
    """(word, bits): the bit map of a column of 64-bit hashes in at most size / 64 rows. ``size`` is a power of 2."""
    place = F.col(column).bitwiseAND(F.lit(size - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))")
    return keys.where(F.col(column).isNotNull()).groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def bit_map(keys: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """The bit map as an array of size / 64 numbers."""
    out = np.zeros(size // 64, dtype=np.int64)
    for word, bits in bit_words(keys, column, size).collect():
        out[word] = bits
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each 64-bit hash (signed) whether its place is marked."""
    return (bits[(hashes & (len(bits) * 64 - 1)) >> 6] >> (hashes & 63)) & 1 == 1


def may_be_in(df: DataFrame, keys: DataFrame, column: str, key_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose hash may be among the keys, and those whose hash is not; NULL is not.

    Native: the stored bit map, of at most BITS / 64 rows, is broadcast and joined.
    """
    word, bits = free_name(df, "word"), free_name(df, "bits")
    words = materialise(bit_words(keys, key_column), "bit-map").toDF(word, bits)
    place = F.shiftright(F.col(column).bitwiseAND(F.lit(BITS - 1)), 6)
    joined = df.join(F.broadcast(words), place == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{column}` & 63 AS int)) & 1") == 1, F.lit(False))
    return joined.where(hit).drop(word, bits), joined.where(~hit).drop(word, bits)


def rows_without(docs: DataFrame, hit: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows whose id and text are not in ``hit`` (hit_id, hit_tag); only rows that may be are shuffled."""
    tag = free_name(docs, "tag")
    tagged = docs.withColumn(tag, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    touched, whole = may_be_in(tagged, hit, tag, "hit_tag")
    hit = hit.select("hit_id", "hit_tag").toDF(free_name(docs, "hit_id"), free_name(docs, "hit_tag"))
    same = (F.col(tag) == F.col(hit.columns[1])) & F.col(id_col).eqNullSafe(F.col(hit.columns[0]))
    return whole.unionByName(touched.join(hit, same, "left_anti")).drop(tag)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
