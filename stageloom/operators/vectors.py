"""Vectors: hash embeddings, best cosine match, k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.functions.text import normalise_space
from stageloom.operators.ordering import group_number
from stageloom.operators.sizing import broadcast_if_small, literal_table
from stageloom.scratch import materialise

PIVOTS = 64
BLOCK = 512


def _let(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times inside a higher-order function."""
    return F.transform(F.array(value), use)[0]


def hash_embedding(column: Column, dims: int = 256) -> Column:
    """Unit vector from sha256 of ``text:i``: the first four bytes, little-endian, scaled to [-1, 1)."""

    def component(text: Column, i: Column) -> Column:
        digest = F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256)
        word = _let(digest, lambda h: F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]))
        return F.conv(word, 16, 10).cast("double") / F.lit(float(2**32)) * 2 - 1

    raw = _let(
        normalise_space(F.lower(column)),
        lambda t: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: component(t, i)),
    )
    return _let(raw, unit)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    return _let(
        norm(vector),
        lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(vector),
    )


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero norm or different lengths."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot / size)


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest of the first ``pivots`` pivots of each unit vector and the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.full(len(pdf), -1, dtype="int32")
            dist = np.zeros(len(pdf))
            same = (pdf["dim"] == pivots.shape[1]).to_numpy()
            if same.any():
                m = np.stack(pdf.loc[same, "v"].to_numpy())
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * m @ pivots.T))
                unused = np.arange(len(pivots))[None, :] >= pdf.loc[same, "pivots"].to_numpy()[:, None]
                d[unused] = np.inf
                cell[same] = d.argmin(axis=1)
                dist[same] = d.min(axis=1)
            yield pdf.assign(cell=cell, dist=dist)

    schema = T.StructType(
        [*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())]
    )
    return rows.mapInPandas(assign, schema)


def vector_blocks(placed: DataFrame, side: str) -> DataFrame:
    """Placed vectors in blocks of ``BLOCK`` by partition value and cell, nearest to the pivot first.

    Vectors of a cell are numbered by distance, so a block covers a narrow range of distances, all blocks of a cell
    but the last are full, and a hot partition value or cell only gives more blocks.
    """
    where = ["part", "dim", "cell"]
    numbered = group_number(placed, where, ["dist", "id"], "_rn")
    grouped = numbered.groupBy(*where, F.floor((F.col("_rn") - 1) / BLOCK).alias("slice")).agg(
        F.collect_list(F.struct("id", "v")).alias("rows"), F.min("dist").alias("near"), F.max("dist").alias("far")
    )
    return grouped.select(
        *[F.col(c).alias(f"{side}_{c}") for c in (*where, "near", "far")],
        F.col("rows.id").alias(f"{side}_ids"),
        F.flatten("rows.v").alias(f"{side}_m"),
    )


def place_vectors(rows: DataFrame, sizes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, part, v, dim) with cell and distance, stored; ``sizes`` says how many pivots a partition value uses."""
    on = rows["part"].eqNullSafe(sizes["_part"]) & (rows["dim"] == sizes["_dim"])
    sized = rows.join(broadcast_if_small(sizes), on).drop("_part", "_dim")
    return materialise(_cells(sized, pivots).drop("pivots"), "placed")


def cosine_best_match(
    queries: DataFrame,
    base: DataFrame,
    key: str,
    vector: str,
    part: str,
    t: float = 0.95,
    alive: Column | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Best base row per query with the same partition value and cosine >= t: (query, match, cosine).

    Exact. Blocks of vectors are compared by matrix product and only the best match per query leaves a
    block pair. Every partition value uses as many pivots as its size calls for. A block of queries joins
    the base cells within its reach (triangle inequality over the pivots) on partition value and cell;
    blocks of a reached cell that cannot hold a match are left out.
    """
    if alive is not None:
        base = base.where(alive)

    def prepare(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(key).alias("id"), F.col(part).alias("part"), v.alias("v")).where(
            norm(F.col("v")) > 0
        ).select("id", "part", unit(F.col("v")).alias("v"), F.size("v").alias("dim"))

    q, b = prepare(queries), prepare(base)
    # A fixed number of vectors, picked by hash: they only steer the blocking.
    sample = b.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()
    if not sample:
        return q.select(
            F.col("id").alias("query"), F.col("id").alias("match"), F.lit(0.0).alias("cosine")
        ).limit(0)
    width = len(sample[0][0])
    pivots = np.array([r[0] for r in sample if len(r[0]) == width])
    distances = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T))
    pairs_of_pivots = [(i, j, float(distances[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
    apart = literal_table(q.sparkSession, pairs_of_pivots, "_q int, _b int, apart double")  # at most PIVOTS squared
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * t))) + 1e-6
    used = F.least(F.lit(len(pivots)), F.ceil(F.count(F.lit(1)) / (2 * BLOCK))).cast("int")
    sizes = b.groupBy(F.col("part").alias("_part"), F.col("dim").alias("_dim")).agg(used.alias("pivots"))
    sizes = materialise(sizes, "sizes")
    placed_b = place_vectors(b, sizes, pivots)
    q_blocks, b_blocks = vector_blocks(place_vectors(q, sizes, pivots), "q"), vector_blocks(placed_b, "b")
    cells = placed_b.groupBy("part", "dim", "cell").agg(F.max("dist").alias("radius"))
    cells = cells.withColumnsRenamed({"part": "_part", "dim": "_dim", "cell": "_cell"})
    here = F.col("q_part").eqNullSafe(F.col("_part")) & (F.col("q_dim") == F.col("_dim"))
    known = (F.col("q_cell") == F.col("_q")) & (F.col("_cell") == F.col("_b"))
    near = (F.col("q_cell") == F.col("_cell")) | (F.col("apart") - F.col("q_far") - F.col("radius") <= reach)
    reached = q_blocks.join(broadcast_if_small(cells), here).join(F.broadcast(apart), known, "left").where(near)
    gap = F.when(
        F.col("q_cell") == F.col("b_cell"), F.greatest(F.col("q_near") - F.col("b_far"), F.col("b_near") - F.col("q_far"))
    ).otherwise(F.col("apart") - F.col("q_far") - F.col("b_far"))
    pairs = reached.join(
        b_blocks,
        F.col("_part").eqNullSafe(F.col("b_part")) & (F.col("_dim") == F.col("b_dim")) & (F.col("_cell") == F.col("b_cell"))
        & ((F.col("q_cell") < 0) | (gap <= reach)),
    )

    def best(batches):
        for pdf in batches:
            out = []
            for qi, qm, bi, bm, dim in zip(
                pdf["q_ids"], pdf["q_m"], pdf["b_ids"], pdf["b_m"], pdf["q_dim"]
            ):
                qi, bi = np.asarray(qi), np.asarray(bi)
                # Matches with equal cosine go to the lowest id.
                order = np.argsort(bi, kind="stable")
                bi = bi[order]
                m = np.round(
                    np.asarray(qm).reshape(-1, dim) @ np.asarray(bm).reshape(-1, dim)[order].T, 12
                )
                if exclude_self:
                    m[qi[:, None] == bi[None, :]] = -2.0
                at = m.argmax(axis=1)
                top = m[np.arange(len(qi)), at]
                keep = top >= t
                out.append(pd.DataFrame({"query": qi[keep], "match": bi[at[keep]], "cosine": top[keep]}))
            yield pd.concat(out) if out else pd.DataFrame(
                {"query": np.array([], "int64"), "match": np.array([], "int64"), "cosine": np.array([], "float64")}
            )

    found = pairs.select("q_ids", "q_m", "b_ids", "b_m", "q_dim").mapInPandas(
        best, "query bigint, match bigint, cosine double"
    )
    top = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("match").alias("m")))
    return found.groupBy("query").agg(top.alias("t")).select(
        "query", F.col("t.m").alias("match"), (-F.col("t.c")).alias("cosine")
    )


def kmeans_clusters(
    df: DataFrame, key: str, vector: str, k: int, seed: int = 42
) -> tuple[DataFrame, float | None]:
    """Cluster of each row and the silhouette; k is at most the number of rows."""
    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = df.count()
    model = KMeans(k=min(k, n), seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    out = model.transform(rows)
    silhouette = (
        ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(out)
        if n > min(k, n) > 1
        else None
    )
    return out.select(key, "cluster"), silhouette
