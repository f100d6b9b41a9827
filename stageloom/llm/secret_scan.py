"""Secrets by assignment-aware lexing.

The text is read as source or configuration: names left of an assignment sign, literals and names
right of it. Literals travel along names (``key = "..."``, ``password = key``), joined parts count
together, and a literal is scored by its target's name and its own look.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Group = tuple[tuple[int, int], ...]  # start and end of literals that are joined

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no match
_HINTS = ("passw", "secret", "token", "api")

# Target names by how surely they hold a secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "api_key": 3,
    "access_key": 3, "private_key": 3, "secret_key": 3, "credential": 2, "credentials": 2, "auth": 2, "bearer": 2,
}
THRESHOLD = 5
ENOUGH = THRESHOLD - min(SENSITIVE.values())  # a literal's points that any sensitive name needs at most

_SIGN = re.compile(r"=>|:=|[=:]")
_NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NAME_START = re.compile(r"[A-Za-z_]")
_BLANKS = re.compile(r"[ \t]*+")
# A literal runs to its closing quote: three quotes over lines, one quote within a line, with or without escapes.
_QUOTED = re.compile(
    r"""\"{3}(.+?)\"{3}|'{3}(.+?)'{3}|"((?:[^"\\\n]++|\\.)++)"|'((?:[^'\\\n]++|\\.)++)'|"([^"\n]++)"|'([^'\n]++)'""", re.S
)
_UNQUOTED = re.compile(r"[A-Za-z0-9+/_.=-]++")
_PEM = re.compile(r"-----(BEGIN|END) [^-\n]*-----")
_PEM_AHEAD = re.compile(r"""(?:[|>][+-]?[ \t]*\r?\n\s*+|["']{1,3}\s*+)?(?=-----BEGIN )""")  # a block scalar or a quote may open it
_JOIN = re.compile(r"[ \t]*+\+\s*+(?=[\"'A-Za-z_])")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z", re.A)
# A placeholder word, or what stands around one.
_PLACEHOLDER = re.compile(
    r"(?i)(change.?me|example|placeholder|your[_-]|x{4,}|\*{3,}|dummy)|value|here|api|key|token|secret|passw(?:or)?d|pwd|auth"
    r"|credentials?|access|private|please|before|my|test|123[0-9]*|[-_.\s]+"
)
_TEMPLATE = re.compile(r"\$?[{(<%]")
_ONE_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CAMEL = re.compile(r"[A-Za-z][a-z]+(?:[A-Z][a-z]{2,})*(?:[A-Z][a-z])?")  # a random key is so once in hundreds
WORD_ENTROPY = 3.6
_ONE_CLASS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the plain patterns, leftmost without overlap within a kind."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


def _sensitivity(name: str) -> int:
    flat = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().replace("-", "_").replace(".", "_")
    parts = [p for p in flat.split("_") if p]
    pairs = [f"{a}_{b}" for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0) for p in parts + pairs + [flat]), default=0)


class _Placeholders:
    """Where placeholder words and the words around them stand in a text."""

    def __init__(self, text: str) -> None:
        self.starts, self.ends, self.covered, self.words = [], [], [0], [0]
        for m in _PLACEHOLDER.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.covered.append(self.covered[-1] + m.end() - m.start())
            self.words.append(self.words[-1] + (m.lastindex == 1))

    def fill(self, start: int, end: int) -> bool:
        """Whether a placeholder word stands in the literal, and such words and their like are more than half of it."""
        a, b = bisect_left(self.starts, start), bisect_right(self.ends, end)
        return b > a and self.words[b] > self.words[a] and 2 * (self.covered[b] - self.covered[a]) > end - start


def _plain_word(text: str, start: int, end: int) -> bool:
    """Letters as words and identifiers have them: one case, or capitals with small letters behind them.

    Sixteen letters or more of one case are no word if they differ as much as random ones.
    """
    if _ONE_CASE.fullmatch(text, start, end):
        return end - start < 16 or _entropy(text[start:end]) < WORD_ENTROPY
    return bool(_CAMEL.fullmatch(text, start, end))


def _literal_score(text: str, start: int, end: int, placeholders: _Placeholders) -> int:
    """0 to 4: length, mixed characters, entropy; a placeholder or a plain word gets -9.

    Signs inside one run give literals with a common end: nothing here copies or reads a long literal
    of several kinds of characters to its end.
    """
    size = end - start
    if size < 6 or _plain_word(text, start, end) or _TEMPLATE.match(text, start, end) or placeholders.fill(start, end):
        return -9
    mixed = not _ONE_CLASS.fullmatch(text, start, end)
    points = (size >= 8) + (size >= 16) + mixed
    return points if points >= ENOUGH else points + (_entropy(text[start:end]) >= 2.8)


def _entropy(literal: str) -> float:
    return -sum(c / len(literal) * math.log2(c / len(literal)) for c in Counter(literal).values())


def _name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, any run of blanks and a closing quote aside; empty if there is none."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] in "\"'":
        at -= 1
    start = at
    while start and text[start - 1] in _NAME_CHARACTERS:
        start -= 1
    first = _NAME_START.search(text, start, at)
    return text[first.start() : at] if first else ""


def _pem_blocks(text: str) -> dict[int, int]:
    """Start and end of every BEGIN line with its END line."""
    marks = list(_PEM.finditer(text)) if "-----BEGIN " in text else []
    return {m.start(): n.end() for m, n in zip(marks, marks[1:], strict=False) if m[1] == "BEGIN" and n[1] == "END"}


def assignments(text: str) -> list[tuple[str, list[tuple[int, int, bool]]]]:
    """(name, parts) of every assignment; a part is (start, end, quoted), several when joined by +."""
    found = []
    pem = _pem_blocks(text)
    run = (0, 0)  # the last unquoted run: signs inside it share its end, so no run is read twice

    def part(at: int) -> tuple[int, int, bool, int] | None:
        nonlocal run
        at = _BLANKS.match(text, at).end()
        if m := _QUOTED.match(text, at):
            return *m.span(m.lastindex), True, m.end()
        if pem and (m := _PEM_AHEAD.match(text, at)) and m.end() in pem:
            end = pem[m.end()]
            return m.end(), end, True, end + (text[at] in "\"'" and text[end : end + 1] == text[at])
        if not run[0] <= at < run[1]:
            m = _UNQUOTED.match(text, at)
            if not m:
                return None
            run = m.span()
        return at, run[1], False, run[1]

    for sign in _SIGN.finditer(text):
        name = _name_before(text, sign.start())
        if not name:
            continue
        parts, at = [], sign.end()
        while m := part(at):
            parts.append(m[:3])
            joined = _JOIN.match(text, m[3])
            if not joined:
                break
            at = joined.end()
        if parts:
            found.append((name, parts))
    return found


def _groups(text: str, pairs: list[tuple[str, list[tuple[int, int, bool]]]]) -> Callable[[int], list[Group]]:
    """A function from the number of an assignment to the groups of literals that it joins.

    A name stands for its last assignment before the place, or for every later one, each a group, if there is none.
    """
    numbers: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(pairs):
        numbers.setdefault(name, []).append(i)
    known: dict[int | str, list[Group]] = {}

    def meant(i: int, start: int, end: int, quoted: bool) -> int | str | None:
        """The assignment that a part refers to, the name if all of its assignments, None for a literal."""
        name = None if quoted or not _NAME.match(text, start, end) else text[start:end]
        at = numbers.get(name)
        if at is None or at == [i]:
            return None
        before = bisect_left(at, i)
        return at[before - 1] if before else name

    def joined(node: int | str, have: dict[int | str, list[Group]]) -> list[Group]:
        if isinstance(node, str):
            return list(dict.fromkeys(g for k in numbers[node] for g in have.get(k) or known.get(k, ())))
        choices = []
        for part in pairs[node][1]:
            to = meant(node, *part)
            choices.append([((part[0], part[1]),)] if to is None else have.get(to) or known.get(to, []))
        choices = [c for c in choices if c]
        if len(choices) < 2:
            return choices[0] if choices else []
        width = max(map(len, choices))
        return list(dict.fromkeys(_few([s for c in choices for s in c[min(k, len(c) - 1)]]) for k in range(width)))

    def groups(root: int) -> list[Group]:
        have: dict[int | str, list[Group]] = {}
        opened, stack = set(), [root]
        partial = set()  # inside a cycle: they lack what the nodes on the way from the root give to it themselves
        while stack:
            node = stack[-1]
            if node in known or node in have:
                stack.pop()
                continue
            needs = numbers[node] if isinstance(node, str) else [k for p in pairs[node][1] if (k := meant(node, *p)) is not None]
            needs = [k for k in needs if k not in known]
            if node not in opened:
                opened.add(node)
                stack += [k for k in needs if k not in opened]
                continue
            stack.pop()
            have[node] = joined(node, have)
            if any(k not in have or k in partial for k in needs):
                partial.add(node)
            else:
                known[node] = have[node]
        return known.setdefault(root, have.get(root, []))

    return groups


def _few(spans: list[tuple[int, int]]) -> Group:
    """At most 16 of each: more of the same tell nothing new, and x = x + x would double them line by line."""
    seen: Counter = Counter()
    kept = []
    for span in spans:
        seen[span] += 1
        if seen[span] <= 16:
            kept.append(span)
    return tuple(kept)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, directly, by a joined part or through other names."""
    if not any(s in text for s in "=:"):
        return []
    pairs = assignments(text)
    targets = [(i, s) for i, (name, _) in enumerate(pairs) if (s := _sensitivity(name))]
    if not targets:
        return []
    groups_of, placeholders = _groups(text, pairs), _Placeholders(text)
    lists: dict[tuple[int, int], list[Group]] = {}  # targets of one name share one list
    for i, s in targets:
        groups = groups_of(i)
        lists[id(groups), s] = groups
    sources: dict[Group, int] = {}
    for (_, s), groups in lists.items():
        for group in groups:
            sources[group] = max(sources.get(group, 0), s)
    found = set()
    for group, sensitivity in sources.items():
        if len(group) == 1:
            score = _literal_score(text, *group[0], placeholders)
        else:
            whole = "".join(text[a:b] for a, b in group)
            score = _literal_score(whole, 0, len(whole), _Placeholders(whole))
        if sensitivity + score >= THRESHOLD:
            found.update((a, b, 3) for a, b in group)
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each by start, then kind."""
    by_start = lambda s: (s[0], s[2])
    base = sorted(base_spans(text), key=by_start)
    return base, sorted(base + literal_spans(text), key=by_start)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, end, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of the base kinds, their digest and all spans (code points, end exclusive).

    A NULL text is empty, ids may repeat or be NULL, every row gives one row; whole texts are read.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType(), False) for c in ("n_assign", "n_access", "n_hex")]
        + [T.StructField(c, T.StringType(), False) for c in ("base_sha256", "spans")]
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column("text"):
                base, every = all_spans(text.as_py() or "")
                for kind in range(3):
                    counts[kind].append(sum(k == kind for _, _, k in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; overlapping spans give one mark."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        spans = all_spans(text)[1] if text else []
        if not spans:
            return text
        out, end = [], 0
        for start, stop, _ in spans:
            if start >= end:
                out += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([masked(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(scan, schema)
