"""Token estimates, prices, usage reports, sessions and cache lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.functions.text import normalise_space
from stageloom.operators.ordering import OrderKey, ordered_scan
from stageloom.operators.sizing import literal_table

# Characters per token by model family.
CHARS_PER_TOKEN = {
    "claude": 3.5,
    "gpt": 4.0,
    "llama": 3.8,
    "mistral": 3.8,
    "gemini": 4.0,
    "default": 4.0,
}

# Words in a model name that decide its family, in this order.
FAMILY_WORDS = [
    ("claude", ["claude", "anthropic"]),
    ("gpt", ["gpt", "openai"]),
    ("llama", ["llama", "meta"]),
    ("mistral", ["mistral"]),
    ("gemini", ["gemini", "google"]),
]

# Price per 1000 input and output tokens by provider and model.
PRICES = [
    ("anthropic", "claude-sonnet-4-20250514", "0.003", "0.015"),
    ("anthropic", "claude-3-5-sonnet-20241022", "0.003", "0.015"),
    ("anthropic", "claude-3-opus-20240229", "0.015", "0.075"),
    ("anthropic", "claude-3-haiku-20240307", "0.00025", "0.00125"),
    ("anthropic", "default", "0.003", "0.015"),
    ("azure", "gpt-4o", "0.005", "0.015"),
    ("azure", "gpt-4o-mini", "0.00015", "0.0006"),
    ("azure", "gpt-4-turbo", "0.01", "0.03"),
    ("azure", "default", "0.005", "0.015"),
    ("azure_foundry", "meta-llama-3.1-70b-instruct", "0.00268", "0.00354"),
    ("azure_foundry", "meta-llama-3.1-8b-instruct", "0.0003", "0.00061"),
    ("azure_foundry", "mistral-large", "0.004", "0.012"),
    ("azure_foundry", "cohere-command-r-plus", "0.003", "0.015"),
    ("azure_foundry", "default", "0.003", "0.01"),
    ("aws", "anthropic.claude-3-sonnet-20240229-v1:0", "0.003", "0.015"),
    ("aws", "anthropic.claude-3-haiku-20240307-v1:0", "0.00025", "0.00125"),
    ("aws", "meta.llama3-1-70b-instruct-v1:0", "0.00265", "0.0035"),
    ("aws", "mistral.mistral-large-2402-v1:0", "0.004", "0.012"),
    ("aws", "amazon.titan-text-premier-v1:0", "0.0005", "0.0015"),
    ("aws", "default", "0.003", "0.015"),
    ("gcp", "gemini-1.5-pro", "0.00125", "0.005"),
    ("gcp", "gemini-1.5-flash", "0.000075", "0.0003"),
    ("gcp", "gemini-1.0-pro", "0.0005", "0.0015"),
    ("gcp", "claude-3-5-sonnet@20240620", "0.003", "0.015"),
    ("gcp", "default", "0.00125", "0.005"),
    ("openrouter", "anthropic/claude-sonnet-4", "0.003", "0.015"),
    ("openrouter", "anthropic/claude-3.5-sonnet", "0.003", "0.015"),
    ("openrouter", "openai/gpt-4o", "0.005", "0.015"),
    ("openrouter", "meta-llama/llama-3.1-70b-instruct", "0.0008", "0.0008"),
    ("openrouter", "google/gemini-pro-1.5", "0.00125", "0.005"),
    ("openrouter", "default", "0.003", "0.015"),
]

# Price by the first of these texts that a model name contains.
PRICES_BY_TEXT = [
    ("claude-sonnet-4", "0.003", "0.015"),
    ("claude-3-5-sonnet", "0.003", "0.015"),
    ("claude-3-haiku", "0.00025", "0.00125"),
    ("gpt-4o", "0.005", "0.015"),
    ("gpt-4o-mini", "0.00015", "0.0006"),
    ("gpt-4", "0.03", "0.06"),
    ("gemini-1.5-pro", "0.00125", "0.005"),
    ("gemini-1.5-flash", "0.000075", "0.0003"),
    ("llama-3.1-70b", "0.0008", "0.0008"),
    ("mistral-large", "0.003", "0.009"),
    ("default", "0.01", "0.03"),
]

# Tokens in and out per class of entity, and prices of a plan.
PLAN_TOKENS = {"AUTO": (500, 800), "SEMI_AUTO": (2000, 1500), "MANUAL": (3000, 2500)}
PLAN_PRICES = {
    "anthropic": ("0.003", "0.015"),
    "azure": ("0.005", "0.015"),
    "azure_foundry": ("0.003", "0.01"),
    "aws": ("0.003", "0.015"),
    "gcp": ("0.00125", "0.005"),
    "openrouter": ("0.003", "0.015"),
}

PRICE = "decimal(10,8)"


def price_rows() -> list[tuple[str, str, str, str]]:
    return list(PRICES)


def price_table(spark: SparkSession) -> DataFrame:
    rows = literal_table(
        spark, price_rows(), "provider string, model string, price_in string, price_out string"
    )
    return rows.select(
        "provider", "model", F.col("price_in").cast(PRICE), F.col("price_out").cast(PRICE)
    )


def model_family(model: Column) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    branch = None
    for family, words in FAMILY_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(name, F.lit(word))
        branch = (F if branch is None else branch).when(hit, F.lit(family))
    return branch.otherwise(F.lit("default"))


def token_estimate(text: Column, family: str | Column = "default") -> Column:
    """Characters after white-space clean-up by characters per token, plus one; empty gives 0."""
    if isinstance(family, str):
        per_token = F.lit(CHARS_PER_TOKEN[family])
    else:
        per_token = F.lit(CHARS_PER_TOKEN["default"])
        for name, value in CHARS_PER_TOKEN.items():
            per_token = F.when(family == name, F.lit(value)).otherwise(per_token)
    count = F.floor(F.length(normalise_space(text)) / per_token) + 1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(count).cast("bigint")


def conversation_tokens(
    df: DataFrame, key: str, text: str, family: str = "default"
) -> DataFrame:
    """4 per message and 2 per conversation on top of the texts."""
    return df.groupBy(key).agg(
        (F.sum(token_estimate(F.col(text), family) + 4) + 2).alias("tokens")
    )


def _cost() -> Column:
    """Exact: decimal tokens times decimal price, per thousand."""
    tokens = lambda c: F.col(c).cast("decimal(18,0)")
    total = tokens("input_tokens") * F.col("price_in") + tokens("output_tokens") * F.col("price_out")
    return (total * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(35,11)")


def usage_cost(df: DataFrame) -> DataFrame:
    """Add ``cost``: price of the model, else of the provider's default, else of the first provider's."""
    prices = price_table(df.sparkSession)
    fallback = next(r for r in price_rows() if r[:2] == ("anthropic", "default"))
    exact = prices.select(
        F.col("provider").alias("_p"), F.col("model").alias("_m"),
        F.col("price_in").alias("_ein"), F.col("price_out").alias("_eout"),
    )
    default = prices.where("model = 'default'").select(
        F.col("provider").alias("_dp"), F.col("price_in").alias("_din"), F.col("price_out").alias("_dout")
    )
    # The price list has about thirty rows. An unknown provider is priced like 'anthropic',
    # model names included.
    known = F.col("provider").isin(sorted({r[0] for r in price_rows()}))
    priced_as = F.when(known, F.col("provider")).otherwise("anthropic")
    return (
        df.withColumn("_as", priced_as)
        .join(F.broadcast(exact), (F.col("_as") == F.col("_p")) & (F.col("model") == F.col("_m")), "left")
        .join(F.broadcast(default), F.col("_as") == F.col("_dp"), "left")
        .withColumns(
            {
                "price_in": F.coalesce("_ein", "_din", F.lit(fallback[2]).cast(PRICE)),
                "price_out": F.coalesce("_eout", "_dout", F.lit(fallback[3]).cast(PRICE)),
            }
        )
        .withColumn("cost", _cost())
        .drop("_as", "_p", "_m", "_ein", "_eout", "_dp", "_din", "_dout", "price_in", "price_out")
    )


def cost_by_text(df: DataFrame) -> DataFrame:
    """Add ``cost`` by the first listed text that the model name contains."""
    name = F.lower("model")
    default = PRICES_BY_TEXT[-1]
    price_in = price_out = None
    for text, p_in, p_out in PRICES_BY_TEXT:
        hit = F.contains(name, F.lit(text))
        price_in = (F if price_in is None else price_in).when(hit, F.lit(p_in))
        price_out = (F if price_out is None else price_out).when(hit, F.lit(p_out))
    return (
        df.withColumns(
            {
                "price_in": price_in.otherwise(F.lit(default[1])).cast(PRICE),
                "price_out": price_out.otherwise(F.lit(default[2])).cast(PRICE),
            }
        )
        .withColumn("cost", _cost())
        .drop("price_in", "price_out")
    )


def usage_records(df: DataFrame) -> DataFrame:
    """Cached requests cost nothing; what they would have cost is kept as ``saved``."""
    priced = usage_cost(df)
    zero = F.lit(0).cast("decimal(35,11)")
    return priced.withColumns(
        {
            "saved": F.when(F.col("cached"), F.col("cost")).otherwise(zero),
            "cost": F.when(F.col("cached"), zero).otherwise(F.col("cost")),
        }
    )


def usage_totals(records: DataFrame, budget: float | None = None) -> DataFrame:
    """Totals, hit rate, estimated saving and budget use, one row from one pass."""
    one = records.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("_cost"),
        F.count_if("cached").alias("cached_requests"),
    )
    n, hit, cost = F.col("total_requests"), F.col("cached_requests"), F.col("_cost")
    out = one.select(
        "total_requests",
        "input_tokens",
        "output_tokens",
        F.round("_cost", 4).alias("total_cost"),
        "cached_requests",
        F.round(hit / F.greatest(n, F.lit(1)) * 100, 1).alias("hit_rate"),
        F.round(F.when(n > hit, hit * (cost / (n - hit))).otherwise(0.0), 4).alias("estimated_saving"),
        F.round(cost / F.lit(budget) * 100, 1).alias("budget_used_pct")
        if budget
        else F.lit(None).cast("double").alias("budget_used_pct"),
    )
    return out


def usage_by(records: DataFrame, by: Column, out: str) -> DataFrame:
    return (
        records.groupBy(by.alias(out))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("cost").cast("double").alias("cost"),
            F.count_if("cached").alias("cached"),
        )
        .orderBy(F.desc("cost"), F.asc(out))
    )


def session_summary(
    records: DataFrame,
    key: str,
    ts: str,
    order: Sequence[OrderKey],
    gap_minutes: int = 30,
    limit: int | None = None,
) -> DataFrame:
    """Requests, hits, tokens, cost and length of each session of a key.

    A session starts at the first event or after a pause longer than the gap. The scan splits
    a hot key, which a session window would sort in one task.
    """
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTE")

    def starts(d: DataFrame) -> DataFrame:
        is_new = F.col("_prev").isNull() | (F.col(ts) > F.col("_prev") + gap)
        return d.withColumn("_start", F.when(is_new, 1).otherwise(0).cast("long"))

    scanned = ordered_scan(
        records, [key], order, [{"_prev": ("lag", ts)}, starts, {"session_no": ("sum", "_start")}], limit
    )
    first, last = F.min(ts), F.max(ts)
    return scanned.groupBy(key, "session_no").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("cached").alias("cached"),
        F.round(F.lit(100.0) * F.count_if("cached") / F.count(F.lit(1)), 1).alias("hit_rate"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").cast("double").alias("cost"),
        F.sum("saved").cast("double").alias("saved"),
        (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))).alias("duration_us"),
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("access_count").alias("accesses"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def request_key(prompt: Column, system: Column, model: Column, temperature: Column) -> Column:
    """sha256 of the request as JSON with sorted keys."""
    body = F.to_json(
        F.struct(
            model.alias("model"),
            prompt.alias("prompt"),
            F.coalesce(system, F.lit("")).alias("system"),
            F.round(temperature, 2).alias("temperature"),
        )
    )
    return F.sha2(body, 256)


def ttl_match(
    requests: DataFrame,
    cache: DataFrame,
    keys: Sequence[str],
    now: str,
    created: str,
    ttl: Column,
    limit: int | None = None,
) -> DataFrame:
    """Requests with ``hit``: an entry of the same keys, made before and not older than the TTL.

    Only the newest entry before a request matters. Requests and entries of a key are put in
    time order and a running maximum carries that entry along, so a key with many
    requests and many entries costs a sort and not a product.
    """
    ts = requests.schema[now].dataType
    asked = requests.withColumns(
        {
            "_t": F.col(now),
            "_kind": F.lit(0),
            "_made": F.lit(None).cast(ts),
        }
    )
    made = cache.select(
        *keys,
        F.col(created).cast(ts).alias("_t"),
        F.lit(1).alias("_kind"),
        F.col(created).cast(ts).alias("_made"),
    )
    # At the same instant a request comes first: it does not see that entry.
    timeline = asked.unionByName(made, allowMissingColumns=True)
    scanned = ordered_scan(timeline, keys, ["_t", "_kind"], [{"_newest": ("max", "_made")}], limit)
    hit = F.coalesce(F.col("_newest") > F.col(now) - ttl, F.lit(False))
    return (
        scanned.where(F.col("_kind") == 0)
        .withColumn("hit", hit)
        .drop("_t", "_kind", "_made", "_newest")
    )


def live_entries(cache: DataFrame, created: str, now: Column, ttl: Column) -> DataFrame:
    """What expiry leaves."""
    return cache.where(F.col(created) > now - ttl)


def plan_cost(
    entities: DataFrame, key: str, category: str, cluster: str, provider: str = "anthropic", budget: float | None = None
) -> DataFrame:
    """Cost of a plan, each entity alone and by clusters, one row.

    AUTO entities need no call. A cluster of two or more takes one full call for its first
    entity and a fifth of the others (at least one) as variations at 15 % of its tokens.
    """
    p_in, p_out = (F.lit(p).cast(PRICE) for p in PLAN_PRICES[provider])
    tokens_in = tokens_out = None
    for name, (t_in, t_out) in PLAN_TOKENS.items():
        hit = F.col(category) == name
        tokens_in = (F if tokens_in is None else tokens_in).when(hit, t_in)
        tokens_out = (F if tokens_out is None else tokens_out).when(hit, t_out)
    per = F.lit("0.001").cast("decimal(4,3)")
    paid = entities.where(F.col(category) != "AUTO").select(
        key,
        cluster,
        tokens_in.cast("decimal(10,0)").alias("t_in"),
        tokens_out.cast("decimal(10,0)").alias("t_out"),
    )
    paid = paid.withColumn("alone", ((F.col("t_in") * p_in + F.col("t_out") * p_out) * per).cast("decimal(20,11)"))
    groups = paid.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("alone").alias("alone"),
        F.min(F.struct(key, "t_in", "t_out", F.col("alone").alias("cost"))).alias("first"),
    )
    n = F.col("n")
    calls = F.greatest(F.lit(1), F.floor((n - 1) / 5))
    whole = F.col("first.t_in") + F.col("first.t_out")
    variation = F.floor(whole * F.lit("0.15").cast("decimal(3,2)"))
    extra = (calls.cast("decimal(18,0)") * variation.cast("decimal(10,0)")).cast("decimal(20,0)")
    batch = groups.where(n >= 2).select(
        "n",
        "alone",
        (calls + 1).alias("calls"),
        (whole + extra).cast("bigint").alias("tokens"),
        (F.col("first.cost") + (extra * p_out * per).cast("decimal(30,11)")).alias("cost"),
    )
    single = paid.where(F.col(cluster).isNull()).select("alone", "t_in", "t_out").unionByName(
        groups.where(n == 1).select("alone", F.col("first.t_in").alias("t_in"), F.col("first.t_out").alias("t_out"))
    ).select(
        F.lit(1).cast("bigint").alias("n"),
        "alone",
        F.lit(1).cast("bigint").alias("calls"),
        (F.col("t_in") + F.col("t_out")).cast("bigint").alias("tokens"),
        F.col("alone").alias("cost"),
    )
    one = batch.unionByName(single).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("alone"), F.lit(0)).cast("double").alias("cost_alone"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost_batched"),
    )
    saving = F.round((F.col("cost_alone") - F.col("cost_batched")) / F.nullif("cost_alone", F.lit(0.0)) * 100, 4)
    over = F.col("cost_batched") > F.lit(float(budget)) if budget else F.lit(False)
    return one.withColumns({"saving_pct": F.coalesce(saving, F.lit(0.0)), "over_budget": over})
