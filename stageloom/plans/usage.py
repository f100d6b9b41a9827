"""Token, cost, session and cache queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.operators import usage as U
from stageloom.operators.sequences import bag_profiles
from stageloom.plans import fleet as G
from stageloom.plans.registry import query
from stageloom.plans.rules import predictions
from stageloom.plans.sequences import IGNORED, sequences
from stageloom.functions.text import SPACE
from stageloom.tables import load

PROVIDERS = ["anthropic", "azure", "azure_foundry", "aws", "gcp", "openrouter", "elsewhere"]
MODELS = {
    "view": "gpt-4o",
    "click": "claude-3-haiku-20240307",
    "purchase": "gemini-1.5-pro",
    "signup": "mistral-large",
    "error": "unknown-model",
}


def requests(spark, d):
    """Usage rows from events: who, which model, how many tokens, cached or not."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    model = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    return load(spark, d, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.col("event_type").alias("operation"),
        F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (F.col("user_id") % 7 + 1).cast("int")).alias("provider"),
        F.try_element_at(model, F.col("event_type")).alias("model"),
        (k * 10).alias("input_tokens"),
        F.floor("value").alias("output_tokens"),
        (k % 4 == 0).alias("cached"),
    )


_PRICES = ", ".join(f"('{p}', '{m}', {i}::DECIMAL(10,8), {o}::DECIMAL(10,8))" for p, m, i, o in U.price_rows())
REQUESTS_SQL = f"""WITH requests AS (SELECT event_id, ts, user_id, event_type AS operation, {PROVIDERS}[user_id % 7 + 1] AS provider,
    CASE event_type {' '.join(f"WHEN '{e}' THEN '{m}'" for e, m in MODELS.items())} END AS model,
    k * 10 AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens, k % 4 = 0 AS cached
    FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)),
  prices(pp, pm, price_in, price_out) AS (VALUES {_PRICES}),
  priced AS (SELECT r.*, CAST((input_tokens::DECIMAL(18,0) * coalesce(e.price_in, f.price_in) + output_tokens::DECIMAL(18,0) * coalesce(e.price_out, f.price_out)) * 0.001 AS DECIMAL(35,11)) AS full_cost
    FROM (SELECT *, CASE WHEN provider IN (SELECT pp FROM prices) THEN provider ELSE 'anthropic' END AS pa FROM requests) r
    LEFT JOIN prices e ON e.pp = pa AND e.pm = model LEFT JOIN prices f ON f.pp = pa AND f.pm = 'default'),
  records AS MATERIALIZED (SELECT *, CASE WHEN cached THEN 0 ELSE full_cost END AS cost, CASE WHEN cached THEN full_cost ELSE 0 END AS saved FROM priced)
"""


def records(spark, d):
    return U.usage_records(requests(spark, d))


@query(
    "token_estimate",
    f"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor(length(regexp_replace(regexp_replace(text, '[{SPACE}]+', ' ', 'g'),
          '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) / 3.5::DOUBLE) + 1 AS BIGINT) END AS tokens FROM documents""",
)
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", U.token_estimate(F.col("text"), "claude").alias("tokens"))


@query(
    "conversation_tokens",
    f"""SELECT conv_id, CAST(sum(4 + CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor(length(regexp_replace(regexp_replace(text, '[{SPACE}]+', ' ', 'g'),
          '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) / 4.0::DOUBLE) + 1 AS BIGINT) END) + 2 AS BIGINT) AS tokens FROM conversations GROUP BY 1""",
)
def conversation_tokens(spark, d):
    return U.conversation_tokens(load(spark, d, "conversations"), "conv_id", "text")


@query("usage_cost", REQUESTS_SQL + "SELECT event_id, CAST(full_cost AS DOUBLE) AS cost FROM priced")
def usage_cost(spark, d):
    return U.usage_cost(requests(spark, d)).select("event_id", F.col("cost").cast("double").alias("cost"))


_TEXT_PRICE = lambda i: "CASE " + " ".join(f"WHEN contains(lower(model), '{r[0]}') THEN {r[i]}" for r in U.PRICES_BY_TEXT) + f" ELSE {U.PRICES_BY_TEXT[-1][i]} END::DECIMAL(10,8)"


@query(
    "usage_cost_by_text",
    REQUESTS_SQL + f"""SELECT event_id, CAST(CAST((input_tokens::DECIMAL(18,0) * {_TEXT_PRICE(1)} + output_tokens::DECIMAL(18,0) * {_TEXT_PRICE(2)}) * 0.001 AS DECIMAL(35,11)) AS DOUBLE) AS cost
      FROM requests""",
)
def usage_cost_by_text(spark, d):
    return U.cost_by_text(requests(spark, d)).select("event_id", F.col("cost").cast("double").alias("cost"))


@query(
    "usage_records",
    REQUESTS_SQL + "SELECT event_id, provider, model, cached, CAST(cost AS DOUBLE) AS cost, CAST(saved AS DOUBLE) AS saved FROM records",
)
def usage_records(spark, d):
    return records(spark, d).select(
        "event_id", "provider", "model", "cached", F.col("cost").cast("double").alias("cost"), F.col("saved").cast("double").alias("saved")
    )


@query(
    "usage_report",
    REQUESTS_SQL + """SELECT n AS total_requests, i AS input_tokens, o AS output_tokens, round(c, 4) AS total_cost, h AS cached_requests, round(h / n * 100, 1) AS hit_rate,
       round(h * (c / (n - h)), 4) AS estimated_saving, round(c / 50.0::DOUBLE * 100, 1) AS budget_used_pct
       FROM (SELECT count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(cost) AS DOUBLE) AS c,
             count(*) FILTER (cached) AS h FROM records)""",
)
def usage_report(spark, d):
    return U.usage_totals(records(spark, d), 50.0)


_BY = """count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cost) AS DOUBLE) AS cost, count(*) FILTER (cached) AS cached FROM records GROUP BY 1"""


@query("usage_by_day", REQUESTS_SQL + f"SELECT CAST(ts AS DATE) AS day, {_BY}")
def usage_by_day(spark, d):
    return U.usage_by(records(spark, d), F.to_date("ts"), "day")


@query("usage_by_type", REQUESTS_SQL + f"SELECT operation, {_BY}")
def usage_by_type(spark, d):
    return U.usage_by(records(spark, d), F.col("operation"), "operation")


@query("usage_by_provider", REQUESTS_SQL + f"SELECT provider || '/' || model AS model, {_BY}")
def usage_by_provider(spark, d):
    return U.usage_by(records(spark, d), F.concat_ws("/", "provider", "model"), "model")


SESSION_SQL = """, marked AS (SELECT *, CASE WHEN prev IS NULL OR ts > prev + INTERVAL 600 MINUTE THEN 1 ELSE 0 END AS st
     FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM records)),
  sessions AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM marked)
  SELECT user_id, session_no, count(*) AS requests, count(*) FILTER (cached) AS cached, round(100.0::DOUBLE * count(*) FILTER (cached) / count(*), 1) AS hit_rate,
    CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost) AS DOUBLE) AS cost,
    CAST(sum(saved) AS DOUBLE) AS saved, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM sessions GROUP BY 1, 2"""


@query("session_summary", REQUESTS_SQL + SESSION_SQL)
def session_summary(spark, d):
    return U.session_summary(records(spark, d), "user_id", "ts", ["ts", "event_id"], 600)


@query(
    "cache_stats",
    REQUESTS_SQL + """, cache AS (SELECT model, user_id, count(*) AS access_count, CAST(max(input_tokens) AS BIGINT) AS input_tokens, max(output_tokens) AS output_tokens,
        min(ts) AS created_at FROM requests GROUP BY 1, 2)
      SELECT model, count(*) AS entries, CAST(sum(access_count) AS BIGINT) AS accesses, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens, min(created_at) AS oldest, max(created_at) AS newest FROM cache GROUP BY 1""",
)
def cache_stats(spark, d):
    cache = requests(spark, d).groupBy("model", "user_id").agg(
        F.count(F.lit(1)).alias("access_count"),
        F.max("input_tokens").alias("input_tokens"),
        F.max("output_tokens").alias("output_tokens"),
        F.min("ts").alias("created_at"),
    )
    return U.cache_stats(cache)


@query(
    "request_key",
    """SELECT conv_id, turn, sha256('{"model":"m-1","prompt":' || to_json(text)::VARCHAR || ',"system":"' || role || '","temperature":0.7}') AS request_key FROM conversations""",
)
def request_key(spark, d):
    return load(spark, d, "conversations").select(
        "conv_id", "turn", U.request_key(F.col("text"), F.col("role"), F.lit("m-1"), F.lit(0.701)).alias("request_key")
    )


@query(
    "ttl_match",
    """SELECT event_id, coalesce(made < ts AND made > ts - INTERVAL 7 DAY, FALSE) AS hit FROM events LEFT JOIN
       (SELECT user_id AS u, event_type AS e, min(ts) AS made FROM events GROUP BY 1, 2) ON u = user_id AND e = event_type""",
)
def ttl_match(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    cache = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("made"))
    return U.ttl_match(events, cache, ["user_id", "event_type"], "ts", "made", F.expr("INTERVAL 7 DAY")).select("event_id", "hit")


@query(
    "ttl_live",
    """SELECT user_id, event_type, made FROM (SELECT user_id, event_type, min(ts) AS made FROM events GROUP BY 1, 2)
       WHERE made > (SELECT max(ts) FROM events) - INTERVAL 28 DAY""",
)
def ttl_live(spark, d):
    events = load(spark, d, "events")
    cache = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("made"))
    now = events.agg(F.max("ts").alias("m")).scalar()
    return U.live_entries(cache, "made", now, F.expr("INTERVAL 28 DAY"))


@query(
    "plan_cost",
    G.PREDICTIONS_SQL + f""", fps AS (SELECT job_id, md5(string_agg(type, '|' ORDER BY type)) AS fp FROM stages WHERE type NOT IN {IGNORED} GROUP BY 1),
      paid AS (SELECT job_id, fp, CASE category WHEN 'SEMI_AUTO' THEN 2000 ELSE 3000 END AS t_in, CASE category WHEN 'SEMI_AUTO' THEN 1500 ELSE 2500 END AS t_out
        FROM predictions LEFT JOIN fps USING (job_id) WHERE category <> 'AUTO'),
      priced AS (SELECT *, (t_in * 0.003 + t_out * 0.015) / 1000 AS alone_d, CAST((t_in * 3 + t_out * 15) AS BIGINT) AS alone FROM paid),
      groups AS (SELECT fp, count(*) AS n, CAST(sum(alone) AS BIGINT) AS alone, arg_min(t_in, job_id) AS fi, arg_min(t_out, job_id) AS fo, arg_min(alone, job_id) AS fc FROM priced WHERE fp IS NOT NULL GROUP BY 1),
      parts AS (SELECT n, alone, 1 + greatest(1, (n - 1) // 5) AS calls, fi + fo + greatest(1, (n - 1) // 5) * ((fi + fo) * 15 // 100) AS tokens,
          fc + greatest(1, (n - 1) // 5) * ((fi + fo) * 15 // 100) * 15 AS cost FROM groups WHERE n >= 2
        UNION ALL SELECT 1, alone, 1, fi + fo, alone FROM groups WHERE n = 1 UNION ALL SELECT 1, alone, 1, t_in + t_out, alone FROM priced WHERE fp IS NULL),
      tot AS (SELECT CAST(sum(n) AS BIGINT) AS n_entities, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens,
          CAST(CAST(sum(alone) AS DECIMAL(30,6)) / 1000000 AS DOUBLE) AS cost_alone, CAST(CAST(sum(cost) AS DECIMAL(30,6)) / 1000000 AS DOUBLE) AS cost_batched FROM parts)
      SELECT *, round((cost_alone - cost_batched) / cost_alone * 100, 4) AS saving_pct, cost_batched > 100 AS over_budget FROM tot""",
)
def plan_cost(spark, d):
    fps = bag_profiles(sequences(spark, d), "job_id", "step").select("job_id", "fingerprint")
    rows = predictions(spark, d).select("job_id", "category").join(fps, "job_id", "left")
    return U.plan_cost(rows, "job_id", "category", "fingerprint", "anthropic", 100.0)
