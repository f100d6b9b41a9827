"""Hard negatives by an inverted multi-index with certified search.

Vectors are cut into halves, each half gets a codebook, and a pair of codewords is a cell. An anchor's score with
any row of a cell is at most the sum of two half-space bounds: inner product with the codeword plus norm times the
codeword's radius. A heap over the two sorted bound lists (the multi-sequence algorithm) gives the cells by falling
bounds. Spark scans the next cells of all open anchors in blocks, round by round with twice the rows each time, until
every anchor's next bound lies below what it has found. Nothing is approximate: codebooks only steer the order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stageloom.operators.sizing import broadcast_if_small
from stageloom.scratch import materialise

SCALE = 256
SAMPLE_ROWS = 20_000  # rows that codebooks are fitted on, about, picked by hash
ROWS_PER_CELL = 1024
MOST_CODEWORDS = 256  # a half; cells are at most its square
BLOCK_ROWS = 4096
ANCHORS_PER_BLOCK = 512
FIRST_ROWS = 8192  # rows that an anchor's first round looks at
ITERATIONS = 8
LOW, HIGH = -(1 << 63), (1 << 63) - 1

_STATE = "anchor long, label long, v binary, low array<long>, high array<long>, least array<long>, seen int"


@dataclass
class Index:
    """Codebooks and what is known of each cell, all of bounded size; ``blocks`` is the stored table of rows."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray  # rows by cell
    parts: np.ndarray  # blocks by cell
    exact: bool  # scores fit a double without rounding
    blocks: DataFrame | None = None


def quantised(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v) with floor(256 * x) as doubles; rows with a NULL or non-finite part, or repeated, are left out."""
    x = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    rows = rows.dropna(subset=["id", "label", "x"])
    rows = rows.where(F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))))
    return rows.select("id", "label", F.transform("x", lambda a: F.floor(a * SCALE).cast("double")).alias("v")).distinct()


def _fit(sample: np.ndarray, k: int) -> np.ndarray:
    """Codewords of one half by Lloyd's rule, from different rows of the sample; the last ones may be fewer than k."""
    words = np.unique(sample, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(k, len(words))).astype(int)]
    for _ in range(ITERATIONS):
        near = _nearest(sample, words)[0]
        sums = np.zeros_like(words)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(words))
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def _nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword of each row and the distance to it."""
    at, own = np.zeros(len(x), dtype=np.int64), (words * words).sum(axis=1)[None, :]
    for i in range(0, len(x), BLOCK_ROWS):
        part = x[i : i + BLOCK_ROWS]
        at[i : i + BLOCK_ROWS] = ((part * part).sum(axis=1)[:, None] - 2 * part @ words.T + own).argmin(axis=1)
    return at, np.sqrt(((x - words[at]) ** 2).sum(axis=1))


def _matrix(vectors: Iterable[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype="<f8").reshape(-1, dims)


def _padded(values: Iterable[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """The vectors of about SAMPLE_ROWS of ``n`` different rows, those of the lowest hashes. A sorted limit would bring as
    many rows of every partition to the driver."""
    if n > SAMPLE_ROWS:
        rows = rows.where(F.xxhash64("id", "label", "v") < LOW + (HIGH - LOW) * SAMPLE_ROWS // n)
    return rows.select("v")


def _shuffled(side: DataFrame) -> DataFrame:
    """Joined by shuffle: Catalyst takes the size of a stored table from its files and leaves out what vectors unpack to and what
    an explode adds, so it would broadcast hundreds of MB through the driver."""
    return side.hint("merge")


def build_index(rows: DataFrame) -> Index | None:
    """Index of every row of ``rows`` (id, label, v); codebooks come from about SAMPLE_ROWS rows. None without rows."""
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    n, dims, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), largest).first()
    if not n:
        return None
    dims = max(2, dims)
    half = dims // 2
    sample = _padded(_sample(rows, n).toArrow()["v"].to_pandas(), dims)
    k = int(min(MOST_CODEWORDS, max(2, np.ceil(np.sqrt(n / ROWS_PER_CELL)))))
    books = _fit(sample[:, :half], k), _fit(sample[:, half:], k)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _padded(pdf["v"], dims)
            a, da = _nearest(x[:, :half], books[0])
            b, db = _nearest(x[:, half:], books[1])
            packed = [row.astype("<f8").tobytes() for row in x]
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "v": packed, "a": a, "b": b, "da": da, "db": db})

    placed = rows.mapInPandas(place, "id long, label long, v binary, a int, b int, da double, db double")
    placed = materialise(placed, "placed-vectors")
    radii = []
    for book, word, distance in ((books[0], "a", "da"), (books[1], "b", "db")):
        radius = np.zeros(len(book))
        for at, far in placed.groupBy(word).agg(F.max(distance)).collect():
            radius[at] = far
        radii.append(radius)
    sizes = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for a, b, count in placed.groupBy("a", "b").agg(F.count(F.lit(1))).collect():
        sizes[a, b] = count
    sizes = sizes.reshape(-1)
    parts = -(-sizes // BLOCK_ROWS)
    spread = rows.sparkSession.createDataFrame(
        pd.DataFrame({"cell": np.flatnonzero(parts).astype("int32"), "parts": parts[parts > 0]}), "cell int, parts long"
    )
    placed = placed.withColumn("cell", (F.col("a") * len(books[1]) + F.col("b")).cast("int")).drop("a", "b", "da", "db")
    placed = placed.join(broadcast_if_small(spread), "cell")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.col("parts")).cast("int"))
    blocks = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
    blocks = materialise(blocks, "vector-blocks")
    exact = 100.0 * dims * max(most, 1.0) ** 2 < 2.0**53
    return Index(books, tuple(radii), sizes, parts, exact, blocks)


def cells_by_bound(v: np.ndarray, index: Index) -> Iterator[tuple[float, int]]:
    """Cells with an upper bound of their rows' scores with ``v``, largest first, by the multi-sequence heap."""
    half = index.books[0].shape[1]
    bounds = []
    for part, book, radius in zip((v[:half], v[half:]), index.books, index.radii, strict=True):
        bound = book @ part + np.linalg.norm(part) * radius
        bounds.append(bound + 1e-9 * (np.abs(bound) + 1))  # rounding
    orders = [np.argsort(-b, kind="stable") for b in bounds]
    first, second = (b[o] for b, o in zip(bounds, orders, strict=True))
    heap, width = [(-(first[0] + second[0]), 0, 0)], len(index.books[1])
    while heap:
        bound, i, j = heappop(heap)
        yield -bound, int(orders[0][i]) * width + int(orders[1][j])
        # (i, j + 1) from every cell, (i + 1, 0) from the first column: each cell enters once, after a larger one.
        if j + 1 < len(second):
            heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


def next_cells(v: np.ndarray, index: Index, seen: int, needed: float, rows: int) -> tuple[list[int], int]:
    """The cells to scan next, about ``rows`` rows with bounds of at least ``needed``, and how many were taken from the heap."""
    out, taken = [], seen
    for at, (bound, cell) in enumerate(cells_by_bound(v, index)):
        if at < seen:
            continue
        if bound < needed or rows <= 0:
            break
        taken = at + 1
        if index.sizes[cell]:
            out.append(cell)
            rows -= int(index.sizes[cell])
    return out, taken


def _scores(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles by Python integers (an OverflowError beyond 64 bits)."""
    if exact:
        return np.rint(anchors @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (anchors, rows)]
    return (whole[0] @ whole[1].T).astype(np.int64)


def _scan(same: bool, k: int, dims: int, exact: bool):
    """Scores of a block of rows with a block of anchors; the best k rows of every window leave the task."""
    schema = pa.schema([("anchor", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(batch.column("rows"), batch.column("asked"), strict=True):
                ids, labels, vectors = rows.values.flatten()
                ids, labels = ids.to_numpy(), labels.to_numpy()
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], labels[order]
                block, asked = _matrix(vectors.to_pylist(), dims)[order], asked.as_py()
                scores = _scores(_matrix([a["v"] for a in asked], dims), block, exact)
                for a, score in zip(asked, scores, strict=True):
                    fits = (labels == a["label"]) & (ids != a["anchor"]) if same else labels != a["label"]
                    for w, (low, high, least) in enumerate(zip(a["low"], a["high"], a["least"], strict=True)):
                        at = np.flatnonzero(fits & (score >= least)) if low <= high else ids[:0]
                        if low > LOW:
                            at = at[(100 * score[at] >= low) & (100 * score[at] <= high)]
                        at = at[np.argsort(-score[at], kind="stable")[:k]]
                        if len(at):
                            columns = np.full(len(at), a["anchor"]), np.full(len(at), w, dtype=np.int32), score[at], ids[at]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The best k rows of each anchor's windows: (anchor, w, rank, id, score), higher scores first, ties by smaller id.

    ``anchors``: (anchor, label, v, low, high); ``same`` asks for other rows of the anchor's label, else for rows
    of other labels. Window w holds scores with low[w] <= 100 * score <= high[w]; LOW and HIGH leave a side open, and low
    above high is an empty window. ``anchor`` must be unique.
    """
    dims = index.books[0].shape[1] + index.books[1].shape[1]
    spark, plain = anchors.sparkSession, Index(index.books, index.radii, index.sizes, index.parts, index.exact)
    n = anchors.count()
    open_ = F.transform("low", lambda _: F.lit(LOW))
    state = materialise(anchors.select("*", open_.alias("least"), F.lit(0).alias("seen")), "search-state")
    best = spark.createDataFrame([], "anchor long, w int, score long, id long")
    rows = FIRST_ROWS

    def plan(budget: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                cells, seen = [], []
                for v, low, high, least, before in zip(pdf["v"], pdf["low"], pdf["high"], pdf["least"], pdf["seen"], strict=True):
                    live = [max(float(b), a / 100.0 if a > LOW else -np.inf) for a, z, b in zip(low, high, least, strict=True) if a <= z]
                    found = next_cells(_matrix([v], dims)[0], plain, before, min(live, default=np.inf), budget)
                    cells.append([c * (1 << 32) + b for c in found[0] for b in range(plain.parts[c])])
                    seen.append(found[1])
                yield pdf.assign(seen=seen, cells=cells)

        return run

    while True:
        planned = state.mapInPandas(plan(rows), f"{_STATE}, cells array<long>")
        planned = materialise(planned, "search-plan")
        if not planned.where(F.size("cells") > 0).limit(1).count():
            break
        asked = planned.select(F.struct("anchor", "label", "v", "low", "high", "least").alias("q"), F.explode("cells").alias("at"))
        asked = asked.select("q", F.shiftright("at", 32).cast("int").alias("cell"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("block"))
        # Anchors meet a block of rows in blocks themselves, so that no list grows with their number.
        slices = max(1, -(-n // ANCHORS_PER_BLOCK))
        asked = asked.groupBy("cell", "block", F.pmod(F.xxhash64("q.anchor"), F.lit(slices)).alias("slice"))
        pairs = asked.agg(F.collect_list("q").alias("asked")).join(_shuffled(index.blocks), ["cell", "block"]).select("rows", "asked")
        found = pairs.mapInArrow(_scan(same, k, dims, index.exact), "anchor long, w int, score long, id long")
        best = materialise(_ranked(best.unionByName(found), k).drop("rank"), "search-best")
        kth = best.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("kth"))
        state = planned.where(F.size("cells") > 0).join(_shuffled(kth), "anchor", "left")
        least = F.expr(f"transform(low, (x, w) -> coalesce(kth[w], {LOW + 1}L - 1L))")
        state = materialise(state.withColumn("least", least).select([c.split()[0] for c in _STATE.split(", ")]), "search-state")
        rows *= 2
    return _ranked(best, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    An anchor's positives are its ``positives`` best other rows of the same label; a pair's negatives are the best
    ``negatives`` rows of other labels with percent[0] * p <= 100 * score <= percent[1] * p, p the positive's score.
    Higher scores come first, ties by smaller id. Scores are integer inner products of floor(256 * x).

    Rows with a NULL id, label, vector or component, or a component that is not finite, take no part; repeated rows
    count once, and rows with an anchor's own id are not its positives. Shorter vectors count as if zeros followed.
    If an id has several different rows, the first by label and vector is the anchor. Other columns are ignored;
    an empty table, or one without anchors, gives no rows. A score beyond 64 bits raises OverflowError.
    """
    label = F.col("label") if label is None else label
    rows = materialise(quantised(rows, vec_id, vector, label), "quantised-vectors")
    index = build_index(rows)
    none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return rows.sparkSession.createDataFrame([], none)
    dims = index.books[0].shape[1] + index.books[1].shape[1]
    is_anchor = F.col("id") % 100 == 0 if is_anchor is None else is_anchor
    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(v=[row.tobytes() for row in _padded(pdf["v"], dims)])

    anchors = anchors.select(F.col("id").alias("anchor"), "r.label", "r.v").mapInPandas(pack, "anchor long, label long, v binary")
    anchors = materialise(anchors, "anchors")
    whole = anchors.select("*", F.array(F.lit(LOW)).alias("low"), F.array(F.lit(HIGH)).alias("high"))
    near = materialise(search(index, whole, True, positives), "positives")
    # Windows in the order of the positives' ranks; at most ``positives`` of them.
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    low, high = F.transform("p", lambda p: p["score"] * percent[0]), F.transform("p", lambda p: p["score"] * percent[1])
    windows = _shuffled(windows.withColumnRenamed("anchor", "own"))
    windows = materialise(anchors.join(windows, F.col("anchor") == F.col("own")), "windows")
    found = search(index, windows.select("anchor", "label", "v", low.alias("low"), high.alias("high")), False, negatives)
    near = near.select(F.col("anchor").alias("of"), (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = found.join(_shuffled(near), (F.col("anchor") == F.col("of")) & (F.col("w") == F.col("nth")))
    return joined.select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
