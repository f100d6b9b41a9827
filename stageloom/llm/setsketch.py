"""Near-duplicate groups by SetSketch registers.

A document is a set of word shingles. Its sketch holds, per register, the least of exponentially
distributed values of all shingles, on an exponential scale: mergeable by maximum, and equal in two
sketches about as often as the sets' Jaccard similarity. Bands of equal registers propose pairs, a joint
likelihood of both sketches sorts them, and links are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.llm import members
from stageloom.llm import text as tx
from stageloom.llm.components import connected_components
from stageloom.scratch import materialise

REGISTERS, ROWS_PER_BAND = 200, 5
SCALE = 1.05  # base of the exponential scale
RATE = 20.0  # keeps registers of single shingles above zero
MARGIN = 0.15  # over five standard errors of the estimate at 200 registers
NO_ID = (1 << 63) - 1
ROWS_PER_BLOCK, SHINGLES_PER_BLOCK = 1500, 4_000_000
CHUNK_BYTES = 2 << 20

_U = tx.U64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of every row; A-Z lower-cased, a shorter text is one shingle."""
    starts, ends, first = tx.words(data, offsets)
    hashes = tx.word_hashes(data, starts, ends, True)
    at = tx.window_starts(first, width)
    full = tx.spans_hash(hashes, at, at + width)
    edges = np.searchsorted(at, first)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = dict(zip(short.tolist(), tx.spans_hash(hashes, first[short], first[short + 1]), strict=True))
    return [
        np.array([whole[i]], dtype=_U) if i in whole else tx.distinct(full[edges[i] : edges[i + 1]])[0]
        for i in range(len(offsets) - 1)
    ]


def sketch(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Registers (sets x registers) of non-empty sets.

    Every shingle is the seed of a sequence of growing times, each at a random register; a register
    keeps the least. A sequence stops when its time is beyond all registers of its set, so the work
    hardly depends on the number of registers.
    """
    rows = len(sets)
    least = np.full(rows * registers, np.inf)
    if not rows:
        return np.zeros((0, registers), dtype=np.uint16)
    seeds = np.concatenate(sets)
    owner = np.repeat(np.arange(rows), [len(s) for s in sets])
    time, step = np.zeros(len(seeds)), 0
    while len(seeds):
        ahead = int(np.clip(20_000 // len(seeds), 1, 64))
        steps = np.arange(step + 1, step + ahead + 1, dtype=_U) * _U(tx.BASE)
        random = tx.mix(seeds[:, None] + steps[None, :])
        times = time[:, None] + np.cumsum(-np.log(((random >> _U(11)).astype(np.float64) + 1) * 2.0**-53), axis=1)
        register = ((random & _U(0x7FF)).astype(np.int64) * registers) >> 11
        np.minimum.at(least, (owner[:, None] * registers + register).ravel(), times.ravel())
        bound = least.reshape(rows, registers).max(axis=1)
        going = times[:, -1] < bound[owner]
        seeds, owner, time, step = seeds[going], owner[going], times[going, -1], step + ahead
    values = np.floor(1 - np.log(least / (registers * RATE)) / np.log(SCALE))
    return np.clip(values, 0, 65_535).astype(np.uint16).reshape(rows, registers)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketches: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One 64-bit key per sketch and band of ``rows`` registers."""
    bands = sketches.shape[1] // rows
    parts = sketches[:, : bands * rows].astype(_U).reshape(len(sketches), bands, rows)
    keys = (parts * tx.powers(tx.BASE, rows + 1)[1:]).sum(axis=2, dtype=_U)
    return tx.mix(keys + tx.mix(np.arange(1, bands + 1, dtype=_U))[None, :])


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, log_base = (SCALE - 1) / SCALE, np.log(SCALE)

    def slope(j: np.ndarray) -> np.ndarray:
        """Derivative of the log-likelihood; it falls with j."""
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-x * c) / log_base, -np.log1p(-y * c) / log_base
        dp, dq = -v * c / (1 - x * c) / log_base, -u * c / (1 - y * c) / log_base
        rest = np.maximum(1 - p - q, 1e-12)
        return above * dp / p + below * dq / q - equal * (dp + dq) / rest

    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    for _ in range(30):
        middle = (low + high) / 2
        rising = slope(middle) > 0
        low, high = np.where(rising, middle, low), np.where(rising, high, middle)
    return (low + high) / 2


def _sketched(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, limit=CHUNK_BYTES):
            sets = shingle_sets(*tx.raw(batch.column("text")), width)
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            # The set's own key: the sum of its hashes mixed anew, whatever their order.
            keys = np.array([tx.mix(s + _U(1)).sum(dtype=_U) for s in sets], dtype=_U)
            filled = np.flatnonzero(sizes)
            found = sketch([sets[i] for i in filled])
            registers: list[bytes | None] = [None] * len(sets)
            for i, row in zip(filled.tolist(), found, strict=True):
                registers[i] = row.astype("<u2").tobytes()
            arrays = [batch["doc_id"], batch["tag"], pa.array(sizes), pa.array(keys.view(np.int64)), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tag", "n", "node", "registers"])

    return run


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), -1)


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = band_keys(_as_registers(part["registers"]))
            nodes = np.repeat(part["node"].to_numpy(), keys.shape[1])
            at = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(at), pa.array(nodes)], names=["band", "at", "node"]
            )


def _likely(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n_a, n_b = part["n_a"].to_numpy().astype(float), part["n_b"].to_numpy().astype(float)
                value = estimate(_as_registers(part["r_a"]), _as_registers(part["r_b"]), n_a, n_b)
                yield part.select(["a", "b"]).filter(pa.array(value >= least))

    return run


def _confirmed(width: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, np.zeros(0, dtype=_U)
        for batch in batches:
            for part in tx.chunks([batch], "t_a"):
                keep = []
                sets = shingle_sets(*tx.raw(part["t_a"]), width)
                for b, text, mine in zip(part["b"].to_pylist(), part["t_b"], sets, strict=True):
                    if b != last:  # rows come by b, so a leader's set serves its whole group
                        last, last_set = b, shingle_sets(*tx.raw(pa.array([text.as_py()])), width)[0]
                    common = len(mine) + len(last_set) - len(tx.distinct(np.concatenate((mine, last_set)))[0])
                    keep.append(100 * common >= percent * (len(mine) + len(last_set) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; only documents that may be theirs are shuffled."""
    rep = nodes.select("node", "rep.tag", F.col("rep.id").alias("rep_id"))
    wanted = materialise(wanted.join(rep, "node"), "wanted")
    some, _ = members.may_be_in(docs, wanted, "tag", "tag")
    same = (some["tag"] == wanted["tag"]) & (F.coalesce(some["doc_id"], F.lit(NO_ID)) == wanted["rep_id"])
    return some.join(wanted, same).select("node", "text").dropDuplicates(["node"])


def _check_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets are similar enough."""
    mine = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    sized = pairs.join(mine, "a").join(other, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = materialise(sized.mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialise(_texts(wanted, nodes, docs), "texts")
    with_a = likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
    return materialise(with_both.mapInArrow(_confirmed(width, percent), "a long, b long"), "links")


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            sets = [x.tobytes() for x in shingle_sets(*tx.raw(batch["text"]), width)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _cross_links(percent: int):
    """Links between components inside one bucket, or between two of its blocks."""

    def run(table: pa.Table) -> pa.Table:
        registers, n = _as_registers(table["registers"]), table["n"].to_numpy()
        component, node, own = (table[c].to_numpy() for c in ("component", "node", "own"))
        first, second, at, grid = (table[c][0].as_py() for c in ("i", "j", "at", "grid"))
        sets = [np.frombuffer(x, dtype=_U) for x in table["shingles"].to_pylist()]
        used = registers.shape[1] // ROWS_PER_BAND * ROWS_PER_BAND
        cell = table["cell"].to_numpy()
        links = []
        for x in np.flatnonzero(own == first):
            y = np.flatnonzero((own == second) & (component != component[x]))
            y = y[y > x] if first == second else y
            y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
            if grid:
                y = y[cell[y] != cell[x]]  # pairs of one cell were seen on the other grid
            same = registers[y] == registers[x]
            # A pair is looked at in the first band that it shares. Registers are equal at least as often as the
            # similarity, so pairs further below than the estimate's margin need no estimate.
            first_shared = same[:, :used].reshape(len(y), used // ROWS_PER_BAND, ROWS_PER_BAND).all(axis=2).argmax(axis=1) == at
            y = y[first_shared & (same.mean(axis=1) >= percent / 100 - 1.2 * MARGIN)]
            if not len(y):
                continue
            like = estimate(registers[[x] * len(y)], registers[y], np.full(len(y), float(n[x])), n[y].astype(float))
            for k in y[like >= percent / 100 - MARGIN]:
                common = len(sets[x]) + len(sets[k]) - len(tx.distinct(np.concatenate((sets[x], sets[k])))[0])
                if 100 * common >= percent * (len(sets[x]) + len(sets[k]) - common):
                    links.append((max(node[x], node[k]), min(node[x], node[k])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _cell_width(percent: int) -> float:
    return 2 * math.log(100 / percent)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Every row's doc_id, n_shingles, component_id, kept, group (of linked rows) and tag (xxhash64 of the text).

    Rows link when their sets of ``width``-word shingles have ``100 * intersection >= percent * union``;
    component_id is the smallest id reachable by links, and kept says that it is the row's own. A NULL
    or wordless text has no shingle, no link and its own id; a NULL id is greater than all others;
    rows of equal sets share one node, whatever their ids, so copies are never paired.

    Pairs that share a bucket of a band are candidates. Every bucket's members are compared with one leader,
    which mostly closes it. Buckets whose other members are still in several components are looked at
    again, cut by set size and into blocks of ROWS_PER_BLOCK and SHINGLES_PER_BLOCK at most: members of different components are compared
    in place, sketches first, and only links leave a task. So no pair is emitted, but the comparisons in such
    a bucket grow with its square. A link is lost only if no band of equal registers proposes it (below 1e-6
    at 0.8) or if the estimate is off by five standard errors, and then only if no other path connects the two.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketches = materialise(docs.mapInArrow(_sketched(width), "doc_id long, tag long, n long, node long, registers binary"), "sketches")
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("tag"))).alias("rep")
    nodes = sketches.where("n > 0").groupBy("node").agg(rep, F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = materialise(nodes, "nodes")
    bands = nodes.select("node", "registers").mapInArrow(_bands, "band long, at int, node long")
    leaders = bands.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialise(bands.join(leaders, "band").where("node <> leader").select("band", "at", "node", "leader"), "buckets")
    pairs = materialise(buckets.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    links = _check_pairs(pairs, nodes, docs, width, percent)
    component = materialise(connected_components(links), "components")
    # Similar sets differ in size by the percentage at most, so they share a cell of twice that width
    # on one of two grids that are half a cell apart.
    place = F.log(F.col("n").cast("double")) / _cell_width(percent)
    cells = F.array(*[F.struct(F.lit(g).alias("grid"), F.floor(place + g / 2).alias("cell")) for g in (0, 1)])
    spread = buckets.join(nodes.select("node", "n"), "node").select("band", "at", "node", "n", F.floor(place).alias("cell"), F.explode(cells).alias("c"))
    spread = spread.select(F.xxhash64("band", "c.grid", "c.cell").alias("band"), "at", "c.grid", "cell", "node", "n").join(component, "node", "left")
    spread = spread.withColumn("component", F.coalesce("component", "node"))
    sizes = spread.groupBy("band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK), F.ceil(F.sum("n") / SHINGLES_PER_BLOCK)).cast("int").alias("blocks"),
        F.min("component").alias("least"),
        F.max("component").alias("most"),
        F.min(F.struct("at", "grid")).alias("place"),
        F.min("cell").alias("low"),
        F.max("cell").alias("high"),
        F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node"))).alias("members"),
    )
    # On the second grid only pairs of different cells are looked at. Of buckets with the same members the one of the
    # first band is enough: it holds every pair's first shared band.
    open_ = sizes.where("least < most AND (place.grid = 0 OR low < high)").groupBy("members").agg(F.min_by(F.struct("band", "blocks"), "place").alias("b"))
    left = materialise(spread.join(open_.select("b.*"), "band").drop("n"), "open-buckets")
    if not left.isEmpty():
        sets = materialise(_texts(left.select("node").distinct(), nodes, docs).mapInArrow(_sets(width), "node long, shingles binary"), "sets")
        own = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
        dealt = left.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("band", "at", "grid", "cell", "node", "component", "own", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
        full = dealt.join(nodes.select("node", "n", "registers"), "node").join(sets, "node")
        found = full.groupBy("band", "i", "j").applyInArrow(_cross_links(percent), "a long, b long").distinct()
        links = links.unionByName(materialise(found, "cross-links"))
        component = materialise(connected_components(links), "components")
    grouped = nodes.select("node", "rep.id").join(component, "node", "left")
    grouped = materialise(grouped.select("node", "id", F.coalesce("component", "node").alias("component")), "grouped")
    least = grouped.groupBy("component").agg(F.min("id").alias("least"))
    of_node = materialise(grouped.join(least, "component").select("node", "component", "least"), "of-node")
    out = sketches.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    component_id = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("least", F.lit(NO_ID)))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("component").alias("group"), "tag")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the row with the smallest id of every near-duplicate group; wordless rows stay.

    Of several rows with that id the one with the least ``tag`` stays, and of equal rows any one.
    """
    found = materialise(near_duplicates(docs, id_col, text_col, width, percent).where("n_shingles > 0"), "near-duplicates")
    first = found.where("kept").groupBy("group").agg(F.min("tag").alias("first"), F.count(F.lit(1)).alias("rows"))
    several = materialise(first.where("rows > 1"), "several")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag"))
    others = found.where("kept").join(several, "group").where("tag <> first").select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag"))
    gone = materialise(gone.unionByName(others).distinct(), "gone")
    left = members.rows_without(docs, gone, id_col, text_col)
    if several.isEmpty():
        return left
    tag = members.free_name(docs, "tag")
    tagged = left.withColumn(tag, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    repeated, single = members.may_be_in(tagged, several, tag, "first")
    return single.unionByName(repeated.dropDuplicates([id_col, tag])).drop(tag)
