"""Text functions as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space in text clean-up.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_NO_NEWLINE = SPACE.replace(r"\t-\r", r"\t\x0b-\r")

# Spark-side classes: printable ASCII, nearly every character, is ruled out by the first test.
_ANY = f"[[^!-~]&&[{SPACE}]]"
_NOT_BLANK = f"[[^ -~]&&[{SPACE}]]"
_IN_LINE = f"[[^!-~]&&[{SPACE_NO_NEWLINE}]]"

# Long term -> short form, applied in this order.
SHORT_FORMS = {
    "OracleConnectorPX": "OraclePX",
    "DB2ConnectorPX": "DB2PX",
    "TeradataConnectorPX": "TeradataPX",
    "SQLServerConnectorPX": "SQLServerPX",
    "PxSequentialFile": "SeqFile",
    "SequentialFile": "SeqFile",
    "CTransformerStage": "Transformer",
    "PxTransform": "Transform",
    "transformation_ctx": "ctx",
    "DynamicFrame": "DynFrame",
    "glueContext": "glueCx",
}

# Words that tag the subject of a step.
SUBJECT_WORDS = (
    "customer order payment invoice product sale transaction account balance "
    "aggregate calculate validate enrich deduplicate merge reconcile"
).split()


def field_trim(column: Column, delimiter: str, n: int) -> Column:
    """The n-th (1-based) delimited field, trimmed; out of range gives ''."""
    return F.trim(F.split_part(column, F.lit(delimiter), F.lit(n)))


def fmt_money(column: Column, sign: str = "$") -> Column:
    return F.concat(F.lit(sign), F.format_number(column, 2))


def safe_name(column: Column, style: str = "file") -> Column:
    """Lower-case safe name for a ``file``, a ``variable`` or a ``job``."""
    text = F.lower(column)
    if style == "file":
        text = F.regexp_replace(text, r'[ /\\:*?"<>|]', "_")
        return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")
    if style == "variable":
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")
        return F.when(text.rlike("^[0-9]"), F.concat(F.lit("stage_"), text)).otherwise(text)
    if style == "job":
        text = F.regexp_replace(text, "[ -]", "_")
        text = F.when(text.rlike("^[0-9]"), F.concat(F.lit("job_"), text)).otherwise(text)
        return F.left(text, F.lit(255))
    raise ValueError(f"unknown style {style!r}")


def strip_space(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACE_CHARS))


def normalise_space(column: Column) -> Column:
    # Single blanks, nearly all white space there is, are left as they are.
    return strip_space(F.regexp_replace(column, f" {_ANY}+|{_NOT_BLANK}{_ANY}*", " "))


def clean_text(column: Column) -> Column:
    """Blank-line runs to one blank line, space runs to one space, no trailing spaces."""
    text = F.regexp_replace(
        column, f"\\n{_ANY}*\\n{_ANY}*\\n+", "\n\n"
    )
    text = F.regexp_replace(text, "  +", " ")
    text = F.regexp_replace(text, f"{_IN_LINE}+\\n", "\n")
    return strip_space(text)


def compact_json(column: Column) -> Column:
    """Tighten the spaces around ``: , { } [ ]``."""
    rules = [
        (f":[{SPACE}]+", ": "),
        (f",[{SPACE}]+", ", "),
        (f"\\{{[{SPACE}]+", "{"),
        (f"[{SPACE}]+\\}}", "}"),
        (f"\\[[{SPACE}]+", "["),
        (f"[{SPACE}]+\\]", "]"),
    ]
    for pattern, replacement in rules:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def replace_terms(column: Column, terms: Mapping[str, str] = SHORT_FORMS) -> Column:
    for long, short in terms.items():
        column = F.replace(column, F.lit(long), F.lit(short))
    return column


def truncate_middle(column: Column, budget: int) -> Column:
    """Over ``budget`` characters: keep the first half and the last third of it."""
    start, end = budget // 2, budget // 3
    dropped = F.length(column) - F.lit(start + end)
    marker = F.concat(
        F.lit("\n\n[... "), dropped.cast("string"), F.lit(" chars truncated ...]\n\n")
    )
    short = F.concat(F.left(column, F.lit(start)), marker, F.right(column, F.lit(end)))
    return F.when(F.length(column) <= budget, column).otherwise(short)


def hash_prefix(column: Column, algorithm: str = "md5", n: int | None = None) -> Column:
    digest = F.md5(column) if algorithm == "md5" else F.sha2(column, 256)
    return F.left(digest, F.lit(n)) if n else digest


def clamp(column: Column, low, high) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def keyword_tags(column: Column, words: Sequence[str] = tuple(SUBJECT_WORDS)) -> Column:
    """Which of the words occur in the text, as a sorted array."""
    text = F.lower(column)
    return F.array_compact(
        F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in sorted(words)])
    )


def extract_score(column: Column, word: str = "similarity", default: float = 50.0) -> Column:
    """The first number after ``word`` and colons or spaces."""
    digits = F.regexp_extract(F.lower(column), f"{word}[:{SPACE}]+(\\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(default))


def extract_lines(column: Column, word: str, n: int | None = None) -> Column:
    """All or the first ``n`` lines that contain ``word``, joined by a space, else 'N/A'."""
    lines = F.filter(F.split(F.lower(column), "\n"), lambda x: F.contains(x, F.lit(word)))
    return F.when(F.size(lines) == 0, F.lit("N/A")).otherwise(
        F.array_join(lines if n is None else F.slice(lines, 1, n), " ")
    )


def extract_block(column: Column) -> Column:
    """Fenced block of python, else any fenced block, else text that reads like code."""
    tagged = F.regexp_extract(column, "(?s)```python(.+?)```", 1)
    fenced = strip_space(F.regexp_extract(column, "(?s)```(.+?)```", 1))
    # An untagged fence may carry the language on its first line.
    body = F.when(
        fenced.startswith("py"),
        F.when(
            F.contains(fenced, F.lit("\n")), F.regexp_replace(fenced, "(?s)^[^\n]*\n", "")
        ).otherwise(F.lit("")),
    ).otherwise(fenced)
    looks_like_code = F.contains(column, F.lit("import ")) & F.contains(
        column, F.lit("def ")
    )
    any_fence = F.regexp_like(column, F.lit("(?s)```.+?```"))
    return (
        F.when(tagged != "", strip_space(tagged))
        .when(any_fence, strip_space(body))
        .when(looks_like_code, strip_space(column))
    )


def epoch_day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def json_long(column: Column, path: str, default: int = 0) -> Column:
    """A number inside a JSON text; bad JSON or a missing path gives the default."""
    return F.coalesce(F.get_json_object(column, path).try_cast("bigint"), F.lit(default))


def kind_ladder(column: Column, rules: Sequence[tuple[Sequence[str], str]], default: Column) -> Column:
    """First rule with any of its substrings in the text decides the kind."""
    branch = None
    for words, kind in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(column, F.lit(word))
        branch = (F if branch is None else branch).when(hit, F.lit(kind))
    return branch.otherwise(default)
