"""Levels of a directed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.scratch import materialise

HEAD_BITS = 1 << 24  # bit map of the nodes with links out; when full, all links are compared with them


def _chains(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(node, head, far) of nodes inside chains, those with one link in and one out: the first node before that is not, and its distance.

    Pointers are doubled, so rounds follow the logarithm of the longest chain. Nodes of a cycle of such nodes find no head
    and are left out.
    """
    inner = degrees.where("n_in = 1 AND n_out = 1").select("node")
    open_ = edges.join(inner.withColumnRenamed("node", "v"), "v", "left_semi").select(F.col("v").alias("node"), F.col("u").alias("head"), F.lit(1).cast("long").alias("far"))
    open_ = materialise(open_, "chain-pointers")
    rounds = int(open_.count()).bit_length() + 1
    done = open_.limit(0)
    for _ in range(rounds):
        known = done.unionByName(open_)
        ahead = known.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"))
        moved = open_.join(ahead, "head", "left")
        moved = materialise(
            moved.select(
                "node", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNull().alias("ended")
            ),
            "chain-pointers",
        )
        done = done.unionByName(moved.where("ended").drop("ended"))
        open_ = moved.where("NOT ended").drop("ended")
        if open_.isEmpty():
            break
    return done


def _inner_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level) of ``nodes``, by the different links (u, v) between them. Stored.

    Chains are first contracted to one weighted link. Then each round takes the nodes all of whose links have been
    followed, and adds to the counts and levels of the nodes they point to; links are stored once and never rewritten, and a
    round writes what it touches. Rounds follow the depth without chains.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    ends = ends.unionByName(nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    degrees = materialise(ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")), "degrees")
    chains = materialise(_chains(edges, degrees), "chains")
    outer = degrees.where("n_in <> 1 OR n_out <> 1")
    step = F.coalesce(F.col("far"), F.lit(0)) + 1
    joined = edges.join(outer.select(F.col("node").alias("v")), "v", "left_semi").join(chains.withColumnRenamed("node", "u"), "u", "left")
    short = joined.groupBy(F.coalesce("head", "u").alias("u"), "v").agg(F.max(step).alias("far"))
    short = materialise(short, "short-links")
    wanted = materialise(short.groupBy("v").agg(F.count(F.lit(1)).alias("n_in")), "links-in")
    ready = materialise(outer.where("n_in = 0").select("node", F.lit(0).cast("long").alias("level")), "ready")
    found, waiting = [ready], None
    while not ready.isEmpty():
        reached = short.join(ready.withColumnRenamed("node", "u"), "u").select("v", F.lit(1).cast("long").alias("n"), (F.col("level") + F.col("far")).alias("level"))
        touched = reached if waiting is None else waiting.unionByName(reached)
        touched = touched.groupBy("v").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        touched = materialise(touched.join(wanted, "v").select("v", "n", "level", (F.col("n") == F.col("n_in")).alias("free")), "touched")
        ready = touched.where("free").select(F.col("v").alias("node"), "level")
        waiting = touched.where("NOT free").select("v", "n", "level")
        found.append(ready)
    done = found[0]
    for part in found[1:]:
        done = done.unionByName(part)
    done = materialise(done, "levels")
    inside = chains.join(done.withColumnRenamed("node", "head"), "head").select("node", (F.col("level") + F.col("far")).alias("level"))
    return materialise(done.unionByName(inside), "inner-levels")


def topological_levels(links: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessor, else one more than the highest predecessor.

    Links into nodes without links out are followed once, when all other levels are known, and only rows that point
    to a node with links out take part in the rounds before. A bit map tells most of the others apart without a shuffle. Nodes on or behind a cycle, or behind a NULL, get no level.
    """
    links = links.select(F.col("from_stage").alias("u"), F.col("to_stage").alias("v"))
    links = materialise(links, "links")
    heads = materialise(links.select(F.col("u").alias("node")).distinct(), "heads")
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(HEAD_BITS - 1))
    words = heads.select(place("node").alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    words = materialise(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")), "head-bits")
    placed = links.withColumn("place", place("v")).join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"), "left")
    hit = F.coalesce(F.expr("shiftright(bits, cast(place & 63 AS int)) & 1 = 1"), F.lit(False))
    same = F.col("v").eqNullSafe(F.col("node"))
    marked = placed.where(hit).select("u", "v").join(heads.withColumn("inner", F.lit(True)), same, "left")
    marked = marked.select("u", "v", F.coalesce("inner", F.lit(False)).alias("inner"))
    marked = materialise(marked, "marked-links")
    levels = _inner_levels(materialise(marked.where("inner").select("u", "v").distinct(), "edges"), heads)
    last = placed.where(~hit).select("u", "v").unionByName(marked.where("NOT inner").select("u", "v")).where("v IS NOT NULL")
    last = last.join(levels.withColumnRenamed("node", "u"), "u", "left")
    last = last.groupBy(F.col("v").alias("node")).agg((F.max("level") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("known"))
    return levels.unionByName(last.where("known").drop("known")).withColumn("level", F.col("level").cast("int"))
