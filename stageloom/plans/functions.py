"""Scalar functions over names, texts, JSON properties and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.functions import text as X
from stageloom.plans.registry import query
from stageloom.tables import load

SP, SPN = X.SPACE, X.SPACE_NO_NEWLINE
STRIP = f"'^[{SP}]+|[{SP}]+$', '', 'g'"


@query("fn_field_trim", "SELECT p_partkey, trim(split_part(p_name, ' ', 2)) AS second_word FROM part")
def fn_field_trim(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", X.field_trim(F.col("p_name"), " ", 2).alias("second_word")
    )


@query(
    "fn_fmt_money",
    """SELECT o_orderkey, '$' || format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE) AS price
       FROM orders""",
)
def fn_fmt_money(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", X.fmt_money(F.col("o_totalprice").cast("decimal(18,2)")).alias("price")
    )


@query(
    "fn_if_then_else",
    "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debit' ELSE 'credit' END AS side FROM supplier",
)
def fn_if_then_else(spark, d):
    return load(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") < 0, "debit").otherwise("credit").alias("side")
    )


@query("fn_concat", "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS title FROM customer")
def fn_concat(spark, d):
    return load(spark, d, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("title")
    )


@query(
    "fn_normalise_ws",
    f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM (
        SELECT doc_id, regexp_replace(regexp_replace(text, '[{SP}]+', ' ', 'g'), {STRIP}) AS t
        FROM documents)""",
)
def fn_normalise_ws(spark, d):
    t = X.normalise_space(F.col("text"))
    return load(spark, d, "documents").select(
        "doc_id", F.md5(t).alias("digest"), F.length(t).alias("n")
    )


@query(
    "fn_clean_text",
    f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n FROM (
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '\\n[{SP}]*\\n[{SP}]*\\n+', chr(10) || chr(10), 'g'), ' +', ' ', 'g'),
          '[{SPN}]+\\n', chr(10), 'g'), {STRIP}) AS t
        FROM documents)""",
)
def fn_clean_text(spark, d):
    t = X.clean_text(F.col("text"))
    return load(spark, d, "documents").select(
        "doc_id", F.md5(t).alias("digest"), F.length(t).alias("n")
    )


@query(
    "fn_compact_json",
    f"""SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          regexp_replace('[ ' || props || ',   ' || props || ' ]', ':[{SP}]+', ': ', 'g'), ',[{SP}]+', ', ', 'g'),
          '\\{{[{SP}]+', '{{', 'g'), '[{SP}]+\\}}', '}}', 'g'), '\\[[{SP}]+', '[', 'g'), '[{SP}]+\\]', ']', 'g') AS js
        FROM events""",
)
def fn_compact_json(spark, d):
    wide = F.concat(F.lit("[ "), "props", F.lit(",   "), "props", F.lit(" ]"))
    return load(spark, d, "events").select("event_id", X.compact_json(wide).alias("js"))


def _replace_sql(column: str) -> str:
    for long, short in X.SHORT_FORMS.items():
        column = f"replace({column}, '{long}', '{short}')"
    return column


STEP_TEXT_SQL = """'Stage: ' || p_name || ' (' || CASE p_type WHEN 'LARGE' THEN 'OracleConnectorPX'
  WHEN 'SMALL' THEN 'PxSequentialFile' WHEN 'MEDIUM' THEN 'CTransformerStage'
  WHEN 'PROMO' THEN 'SequentialFile' ELSE p_type END || ')'"""


@query("fn_replace_terms", f"SELECT p_partkey, {_replace_sql(STEP_TEXT_SQL)} AS line FROM part")
def fn_replace_terms(spark, d):
    kind = (
        F.when(F.col("p_type") == "LARGE", "OracleConnectorPX")
        .when(F.col("p_type") == "SMALL", "PxSequentialFile")
        .when(F.col("p_type") == "MEDIUM", "CTransformerStage")
        .when(F.col("p_type") == "PROMO", "SequentialFile")
        .otherwise(F.col("p_type"))
    )
    line = F.concat(F.lit("Stage: "), "p_name", F.lit(" ("), kind, F.lit(")"))
    return load(spark, d, "part").select("p_partkey", X.replace_terms(line).alias("line"))


@query(
    "fn_truncate_middle",
    """SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 300) || chr(10) || chr(10)
         || '[... ' || CAST(length(text) - 500 AS VARCHAR) || ' chars truncated ...]' || chr(10) || chr(10)
         || right(text, 200) END AS short_text
       FROM documents""",
)
def fn_truncate_middle(spark, d):
    return load(spark, d, "documents").select(
        "doc_id", X.truncate_middle(F.col("text"), 600).alias("short_text")
    )


@query(
    "fn_hash",
    "SELECT doc_id, left(md5(text), 16) AS short_md5, sha256(text) AS sha FROM documents",
)
def fn_hash(spark, d):
    return load(spark, d, "documents").select(
        "doc_id",
        X.hash_prefix(F.col("text"), "md5", 16).alias("short_md5"),
        X.hash_prefix(F.col("text"), "sha256").alias("sha"),
    )


@query(
    "fn_clamp_round",
    """SELECT c_custkey, CAST(round(CAST(least(greatest(c_acctbal, 0.0), 5000.0) AS DECIMAL(18,2)), 1)
              AS DOUBLE) AS capped FROM customer""",
)
def fn_clamp_round(spark, d):
    capped = X.clamp(F.col("c_acctbal"), 0.0, 5000.0).cast("decimal(18,2)")
    return load(spark, d, "customer").select(
        "c_custkey", F.round(capped, 1).cast("double").alias("capped")
    )


_TAGS = " , ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in sorted(X.SUBJECT_WORDS))


@query("fn_keyword_tags", f"SELECT item_id, concat_ws(',', {_TAGS}) AS tags FROM (SELECT doc_id AS item_id, text FROM documents UNION ALL SELECT -1 - c_custkey, c_name || c_mktsegment FROM customer)")
def fn_keyword_tags(spark, d):
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    names = load(spark, d, "customer").select(
        (-1 - F.col("c_custkey")).alias("item_id"), F.concat("c_name", "c_mktsegment").alias("text")
    )
    return rows.unionByName(names).select(
        "item_id", F.array_join(X.keyword_tags(F.col("text")), ",").alias("tags")
    )


@query(
    "fn_extract_score",
    f"""SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(lower(t), 'similarity[:{SP}]+(\\d+)', 1), '') AS DOUBLE),
              50.0::DOUBLE) AS score
        FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'Similarity: ' || CAST(user_id AS VARCHAR)
              ELSE event_type END AS t FROM events)""",
)
def fn_extract_score(spark, d):
    t = F.when(
        F.col("event_type") == "view", F.concat(F.lit("Similarity: "), F.col("user_id").cast("string"))
    ).otherwise(F.col("event_type"))
    return load(spark, d, "events").select("event_id", X.extract_score(t).alias("score"))


@query(
    "fn_extract_lines",
    """SELECT doc_id, CASE WHEN len(hits) = 0 THEN 'N/A' ELSE array_to_string(hits, ' ') END AS lines
       FROM (SELECT doc_id, list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'license')) AS hits
             FROM documents)""",
)
def fn_extract_lines(spark, d):
    return load(spark, d, "documents").select(
        "doc_id", X.extract_lines(F.col("text"), "license").alias("lines")
    )


@query(
    "fn_extract_block",
    f"""SELECT item_id, CASE
           WHEN tagged <> '' THEN regexp_replace(tagged, {STRIP})
           WHEN fence THEN regexp_replace(CASE WHEN starts_with(body, 'py')
                THEN CASE WHEN contains(body, chr(10)) THEN regexp_replace(body, '^[^\\n]*\\n', '') ELSE '' END
                ELSE body END, {STRIP})
           WHEN contains(t, 'import ') AND contains(t, 'def ') THEN regexp_replace(t, {STRIP}) END AS code
        FROM (SELECT item_id, t, regexp_extract(t, '(?s)```python(.+?)```', 1) AS tagged,
                     regexp_replace(regexp_extract(t, '(?s)```(.+?)```', 1), {STRIP}) AS body,
                     regexp_matches(t, '(?s)```.+?```') AS fence
              FROM (SELECT doc_id AS item_id, CASE lang WHEN 'en' THEN 'x ```python' || chr(10) || text || '``` y'
                      WHEN 'fr' THEN '```py' || chr(10) || text || '```'
                      WHEN 'de' THEN 'import a' || chr(10) || 'def f(): ' || text ELSE text END AS t
                    FROM documents))""",
)
def fn_extract_block(spark, d):
    text, lang = F.col("text"), F.col("lang")
    t = (
        F.when(lang == "en", F.concat(F.lit("x ```python\n"), text, F.lit("``` y")))
        .when(lang == "fr", F.concat(F.lit("```py\n"), text, F.lit("```")))
        .when(lang == "de", F.concat(F.lit("import a\ndef f(): "), text))
        .otherwise(text)
    )
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), X.extract_block(t).alias("code")
    )


@query(
    "fn_epoch_day",
    """SELECT event_id, CAST(make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS DATE) AS day,
              ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS recent FROM events""",
)
def fn_epoch_day(spark, d):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select(
        "event_id",
        X.epoch_day(seconds).alias("day"),
        (F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_interval(0, 0, 0, 7)")).alias("recent"),
    )


@query(
    "fn_json_props",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
              coalesce(TRY_CAST(json_extract_string(props, '$.none') AS BIGINT), 0) AS missing FROM events""",
)
def fn_json_props(spark, d):
    return load(spark, d, "events").select(
        "event_id",
        X.json_long(F.col("props"), "$.k").alias("k"),
        X.json_long(F.col("props"), "$.none").alias("missing"),
    )
