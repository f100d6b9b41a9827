"""Quality classifier: a sparse rule ensemble over text statistics.

Trees are grown on labelled rows, every path below a root becomes a conjunctive rule, a lasso
logistic regression picks and weighs rules, and the rest is a Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stageloom.llm import text as tx

STATISTICS = (
    "n_words word_length upper_share symbol_share bang_share stop_share comma_share line_share distinct_share non_ascii_share"
).split()
MAX_TRAINING_ROWS = 200_000
TREES, DEPTH, LASSO = 16, 3, 0.001
LONGEST_COUNTED = 16

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "bang": b"!?",
    "stop": b".",
    "comma": b",;:",
    "line": b"\n",
}


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every row; all are 0 for an empty text."""
    starts, ends, first = tx.words(data, offsets)
    rows = len(offsets) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    def of(name: str) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(_CLASS[name])] = True
        return count(table[data])

    n = np.diff(first).astype(np.float64)
    solid = np.maximum(count(~tx.SPACE[data]), 1)
    per_word = np.maximum(n, 1)
    owner = np.repeat(np.arange(rows), np.diff(first))
    # A row's different words: rows in the upper 20 bits, 44 bits of the hash below.
    tagged = (owner.astype(tx.U64) << tx.U64(44)) | (tx.word_hashes(data, starts, ends, True) >> tx.U64(20))
    different, _ = tx.distinct(tagged)
    # One key or address in a short text must not look like a text of long words.
    length = np.bincount(owner, weights=np.minimum(ends - starts, LONGEST_COUNTED), minlength=rows)
    return {
        "n_words": n,
        "word_length": length / per_word,
        "upper_share": of("upper") / solid,
        "symbol_share": of("symbol") / solid,
        "bang_share": of("bang") / solid,
        "stop_share": of("stop") / per_word,
        "comma_share": of("comma") / per_word,
        "line_share": of("line") / per_word,
        "distinct_share": np.bincount((different >> tx.U64(44)).astype(np.int64), minlength=rows) / per_word,
        "non_ascii_share": count(data >= 128) / solid,
    }


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "stat_") -> DataFrame:
    """All columns of ``docs`` and one double per statistic; whole texts, a NULL text is empty."""
    names = {c.lower() for c in docs.columns}
    while any(f"{prefix}{s}".lower() in names for s in STATISTICS):
        prefix = "_" + prefix
    added = [T.StructField(prefix + s, T.DoubleType(), False) for s in STATISTICS]
    schema = T.StructType(docs.schema.fields + added)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, text_col):
            found = statistics(*tx.raw(batch.column(text_col)))
            arrays = [*batch.columns, *(pa.array(found[s], pa.float64()) for s in STATISTICS)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(add, schema)


def statistic_columns(df: DataFrame, prefix: str = "stat_") -> list[str]:
    """The columns that with_statistics added last."""
    return df.columns[-len(STATISTICS) :]


Condition = tuple[int, str, float]
Rule = tuple[Condition, ...]


def tree_rules(debug_text: str) -> list[Rule]:
    """Every path below a root of the printed trees as a conjunction, each once, shortest form."""
    found: dict[Rule, None] = {}
    path: list[Condition] = []
    for line in debug_text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if re.match(r" *Tree \d", line):
            path, base = [], None
        if not m:
            continue
        if base is None:
            base = len(m[1])
        path = path[: len(m[1]) - base] + [(int(m[2]), m[3], float(m[4]))]
        bounds: dict[tuple[int, str], float] = {}
        for feature, op, value in path:
            tighter = min if op == "<=" else max
            bounds[feature, op] = tighter(bounds.get((feature, op), value), value)
        found[tuple(sorted((f, op, v) for (f, op), v in bounds.items()))] = None
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules over the statistics; a score is the logistic of the sum."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, columns: list[str]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, columns: list[str]) -> Column:
    tests = [F.col(columns[f]) <= v if op == "<=" else F.col(columns[f]) > v for f, op, v in rule]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def fit_rules(
    labelled: DataFrame,
    columns: list[str],
    label: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
    lasso: float = LASSO,
) -> RuleModel:
    """Fit on at most about ``max_rows`` labelled rows, a documented bound (a uniform sample by seed beyond it).

    Rows with a NULL label are left out. With no row, or with one class only, the model is the
    smoothed share of label 1.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), *columns)
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (good + 1) / (n + 2)
    plain = RuleModel((), float(np.log(share / (1 - share))))
    if good in (0, n):
        return plain
    if n > max_rows:
        rows = rows.sample(fraction=max_rows / n, seed=7)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=11, subsamplingRate=0.7
    ).fit(vectors.select("label", "features"))
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return plain
    hits = F.array(*[_holds(rule, columns).cast("double") for rule in rules])
    fired = rows.select("label", array_to_vector(hits).alias("features"))
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(fired)
    weighted = tuple((r, float(w)) for r, w in zip(rules, lasso_fit.coefficients.toArray(), strict=True) if w)
    return RuleModel(weighted, float(lasso_fit.intercept))
