"""Transcripts into chat turns by a hidden Markov model.

Lines of a raw transcript are observations (speaker markers, blank lines, length, question mark). States
are a role with a place in its turn: first line, further line, gap behind the turn. Probabilities are
counted on conversations with known roles; Viterbi recovers the roles, and turns are rendered canonically.

Long transcripts are decoded in blocks: every block's best scores between its border states form a
matrix, matrices combine in two levels, and blocks are decoded between the border states so found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stageloom.scratch import materialise

ROLES = ("system", "user", "assistant")
FIRST, FURTHER, GAP = range(3)
STATES = 3 * len(ROLES)
START = STATES  # what is before the first line
SEGMENTS_PER_BLOCK = 256
BLOCKS_PER_GROUP = 256
SMOOTH = 0.05

# Speaker markers by role, lower-case.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "q", "customer"),
    "assistant": ("assistant", "ai", "a", "bot"),
}
_ALL = "|".join(m for names in MARKERS.values() for m in names)
MARKER = rf"(?i)^(?:#{{1,3}} ?|\[|<\||\*\*)?({_ALL})(?:\]:?|\|>|\*\*:?|:|$)[ \t]*"
_MARKER = re.compile(MARKER)
_ROLE_OF = {m: i for i, role in enumerate(ROLES) for m in MARKERS[role]}
STYLES = ("User: |Assistant: |System: ", "Human: |AI: |System: ", "### User\n|### Assistant\n|### System\n", "[user] |[assistant] |[system] ")
OBSERVATIONS = 4 * 3 * 2 + 1


def observe(line: str) -> int:
    """Number of a line's observation: blank, or marker x length class x question mark."""
    line = line.strip()
    if not line:
        return OBSERVATIONS - 1
    marker = _MARKER.match(line)
    said = _ROLE_OF[marker[1].lower()] + 1 if marker else 0
    length = 0 if len(line) < 40 else 1 if len(line) < 200 else 2
    return (said * 3 + length) * 2 + line.endswith("?")


@dataclass(frozen=True)
class Model:
    step: np.ndarray  # (STATES + 1) x STATES log probabilities, the last row from START
    emit: np.ndarray  # STATES x OBSERVATIONS log probabilities


def render_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, role, text): every turn as raw transcript lines, then a blank line.

    A conversation's marker style follows from its id; one turn in eight has no marker. Other
    roles than ROLES have none either. NULL texts are empty.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marker = F.lit("")
    for number, forms in enumerate(STYLES):
        for role, form in zip(("user", "assistant", "system"), forms.split("|"), strict=True):
            marker = F.when((style == number) & (F.col("role") == role), F.lit(form)).otherwise(marker)
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(8)) == 0
    text = F.concat(F.when(bare, F.lit("")).otherwise(marker), F.coalesce("text", F.lit("")), F.lit("\n"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("part"), "role", text.alias("text"))


def fit(segments: DataFrame) -> Model:
    """Count the model on (conv_id, part, role, text) with one turn per row, the blank line behind it included.

    Rows with another or no role are left out. All rows are counted; the driver gets two small tables.
    """
    number = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    known = segments.where(F.col("role").isin(*ROLES)).select("conv_id", "part", "text", number[F.col("role")].alias("role"))

    def emissions(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((STATES, OBSERVATIONS + 3), dtype=np.int64)
        for frame in frames:
            for role, text in zip(frame.role, frame.text, strict=True):
                lines = text.split("\n")
                for i, line in enumerate(lines):
                    place = GAP if i and i == len(lines) - 1 else FURTHER if i else FIRST
                    counts[3 * role + place, observe(line)] += 1
                further = max(0, len(lines) - 2)
                # Steps inside a turn: first to further, further to itself, further or first to the gap.
                counts[3 * role + FIRST, OBSERVATIONS + (FURTHER if further else GAP)] += len(lines) > 1
                if further:
                    counts[3 * role + FURTHER, OBSERVATIONS + FURTHER] += further - 1
                    counts[3 * role + FURTHER, OBSERVATIONS + GAP] += 1
        state, what = np.nonzero(counts)
        yield pd.DataFrame({"state": state, "what": what, "n": counts[state, what]})

    counted = known.select("role", "text").mapInPandas(emissions, "state long, what long, n long")
    emit, inside = np.full((STATES, OBSERVATIONS), SMOOTH), np.zeros((STATES, 3))
    for state, what, n in counted.groupBy("state", "what").agg(F.sum("n")).collect():  # at most STATES x (OBSERVATIONS + 3)
        if what < OBSERVATIONS:
            emit[state, what] += n
        else:
            inside[state, what - OBSERVATIONS] += n
    before = known.select("conv_id", (F.col("part") + 1).alias("part"), F.col("role").alias("before"))
    after = known.select("conv_id", "part", "role").join(before, ["conv_id", "part"], "left")
    step = np.full((STATES + 1, STATES), 1e-6)
    for row in after.groupBy("before", "role").count().collect():  # at most 12 rows
        step[START if row.before is None else 3 * row.before + GAP, 3 * row.role + FIRST] += row["count"]
    for role in range(len(ROLES)):
        block = slice(3 * role, 3 * role + 3)
        step[block, block] += inside[block]
        step[3 * role + GAP, 3 * role + GAP] += SMOOTH
    return Model(np.log(step / step.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True)))


def block_matrix(model: Model, observations: list[int]) -> np.ndarray:
    """Best score from each state before the block (rows, START last) to each state of its last line."""
    best = None
    for seen in observations:
        scores = model.step + model.emit[:, seen]
        best = scores if best is None else (best[:, :, None] + scores[None, :STATES, :]).max(axis=1)
    return best


def decode(model: Model, observations: list[int], entry: int, last: int) -> list[int]:
    """Best states of the lines between the state before them and the state of the last one."""
    scores = model.step[entry] + model.emit[:, observations[0]]
    back = []
    for seen in observations[1:]:
        options = scores[:, None] + model.step[:STATES]
        back.append(options.argmax(axis=0))
        scores = options.max(axis=0) + model.emit[:, seen]
    path = [last]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def combine(matrices: list[np.ndarray]) -> np.ndarray:
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None, :STATES, :]).max(axis=1)
    return best


def borders(matrices: list[np.ndarray], entry: int, last: int | None) -> list[tuple[int, int]]:
    """(state before, last state) of every block on the best path; ``last`` None leaves the end open."""
    scores, back = matrices[0][entry], []
    for m in matrices[1:]:
        options = scores[:, None] + m[:STATES]
        back.append(options.argmax(axis=0))
        scores = options.max(axis=0)
    path = [int(scores.argmax()) if last is None else last]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    path = path[::-1]
    return list(zip([entry, *path[:-1]], path, strict=True))


def _packed(m: np.ndarray) -> bytes:
    return m.astype("<f8").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype="<f8").reshape(STATES + 1, STATES)


def _groups(batches: Iterable[pa.RecordBatch], key_columns: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys of a partition sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[c] for c in key_columns)
            if rows and now != key:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _tables(rows: Iterable[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def parse_transcripts(segments: DataFrame, model: Model) -> DataFrame:
    """Turns (conv_id, turn, role, text, rendered) of raw transcripts in segments (conv_id, part, text).

    Segments are runs of whole lines in order of ``part`` (NULL first, equal ones by text); turns need not
    follow their borders. Turns are numbered from 0 per conv_id, markers are cut off, blank lines around a
    turn's text go. A NULL conv_id is a transcript of its own; a NULL text is an empty line; a transcript
    of blank lines only is one turn without text.
    """
    block = F.floor(F.coalesce("part", F.lit(0)) / SEGMENTS_PER_BLOCK).cast("long")
    rows = segments.select("conv_id", "part", F.coalesce("text", F.lit("")).alias("text"), block.alias("block"))
    kind = segments.schema["conv_id"].dataType.simpleString()
    conv = rows.limit(0).toArrow().schema.field("conv_id").type
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("part").asc_nulls_first(), "text")

    def lines_of(group: list[dict]) -> list[str]:
        return [line for row in group for line in row["text"].split("\n")]

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv), ("block", pa.int64()), ("matrix", pa.binary())])
        found = (
            {"conv_id": key[0], "block": key[1], "matrix": _packed(block_matrix(model, [observe(x) for x in lines_of(group)]))}
            for key, group in _groups(batches, ["conv_id", "block"])
        )
        yield from _tables(found, schema)

    blocks = materialise(dealt.mapInArrow(matrices, f"conv_id {kind}, block long, matrix binary"), "blocks")
    upper = F.floor(F.col("block") / BLOCKS_PER_GROUP).cast("long").alias("upper")
    blocks = blocks.select("*", upper)
    by_group = blocks.repartition("conv_id", "upper").sortWithinPartitions("conv_id", "upper", "block")

    def combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv), ("upper", pa.int64()), ("matrix", pa.binary())])
        found = (
            {"conv_id": key[0], "upper": key[1], "matrix": _packed(combine([_unpacked(r["matrix"]) for r in group]))}
            for key, group in _groups(batches, ["conv_id", "upper"])
        )
        yield from _tables(found, schema)

    def upper_borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv), ("upper", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())])
        found = (
            {"conv_id": key[0], "upper": r["upper"], "entry": entry, "last": last}
            for key, group in _groups(batches, ["conv_id"])
            for r, (entry, last) in zip(group, borders([_unpacked(r["matrix"]) for r in group], START, None), strict=True)
        )
        yield from _tables(found, schema)

    def block_borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", conv), ("block", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())])
        found = (
            {"conv_id": key[0], "block": r["block"], "entry": entry, "last": last}
            for key, group in _groups(batches, ["conv_id", "upper"])
            for r, (entry, last) in zip(
                group, borders([_unpacked(r["matrix"]) for r in group], group[0]["entry"], group[0]["last"]), strict=True
            )
        )
        yield from _tables(found, schema)

    groups = by_group.mapInArrow(combined, f"conv_id {kind}, upper long, matrix binary")
    ordered = groups.repartition("conv_id").sortWithinPartitions("conv_id", "upper")
    found = ordered.mapInArrow(upper_borders, f"conv_id {kind}, upper long, entry int, last int")
    renamed = found.withColumnsRenamed({"conv_id": "c", "upper": "u"})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("upper") == F.col("u"))
    bounded = blocks.join(renamed, same).drop("c", "u")
    bounded = bounded.repartition("conv_id", "upper").sortWithinPartitions("conv_id", "upper", "block")
    bounds = materialise(bounded.mapInArrow(block_borders, f"conv_id {kind}, block long, entry int, last int"), "borders")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", conv), ("block", pa.int64()), ("piece", pa.int64()), ("begins", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        )

        def cut() -> Iterator[dict]:
            for (conv_id, number), group in _groups(batches, ["conv_id", "block"]):
                lines = lines_of(group)
                path = decode(model, [observe(x) for x in lines], group[0]["entry"], group[0]["last"])
                starts = [i for i, state in enumerate(path) if state % 3 == FIRST or i == 0]
                count = 0
                for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
                    begins = path[a] % 3 == FIRST or group[0]["entry"] == START and a == 0
                    own = [_MARKER.sub("", lines[a].strip(), count=1) if begins else lines[a], *lines[a + 1 : b]]
                    count += begins
                    role = ROLES[path[a] // 3]
                    yield {"conv_id": conv_id, "block": number, "piece": count, "begins": int(begins), "role": role, "text": "\n".join(own)}

        yield from _tables(cut(), schema)

    borders_of = bounds.withColumnsRenamed({"conv_id": "c", "block": "b"})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    inside = rows.join(borders_of, same).drop("c", "b").repartition("conv_id", "block")
    inside = inside.sortWithinPartitions("conv_id", "block", F.col("part").asc_nulls_first(), "text")
    cut = materialise(
        inside.mapInArrow(pieces, f"conv_id {kind}, block long, piece long, begins long, role string, text string"), "pieces"
    )
    # Turns of earlier blocks: one row per block of a transcript, cumulated.
    begun = cut.groupBy("conv_id", "block").agg(F.sum("begins").alias("n"))
    earlier = F.expr("sum(n) OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    offsets = begun.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(earlier, F.lit(0)).alias("offset"))
    numbered = cut.join(offsets, same).withColumn("turn", F.col("offset") + F.col("piece") - 1)
    part = F.struct("block", "piece", "begins", "text")
    turns = numbered.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("begins") == 1, F.col("role"))).alias("role"), F.sort_array(F.collect_list(part)).alias("parts")
    )
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), r"^\s+|\s+$", "")
    turns = turns.select("conv_id", "turn", "role", text.alias("text"))
    return turns.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>")))
