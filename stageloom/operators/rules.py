"""Rule scoring, classing and ranking of entities made of typed steps and links.

``features`` reduces the steps and links of each entity to one row of counts and
flags: names are judged once per distinct type, then sums and one bit mask combine map-side. Everything after it is column arithmetic on that row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.ordering import dense_number
from stageloom.operators.rule_tables import (
    BLOCKERS,
    DEFAULT_WEIGHT,
    FEATURES_NEEDED,
    FULL,
    MANUAL,
    METADATA,
    MIGRATION_CATEGORIES,
    PARTIAL,
    RECOMMENDATIONS,
    RISK_FACTORS,
    SOURCES,
    TARGETS,
    TRANSFORMS,
    type_rule_table,
)
from stageloom.scratch import materialise


def branch_counts(links: DataFrame, key: str) -> DataFrame:
    """Links per entity, and nodes with more than one (or two) outgoing links."""
    per_node = links.groupBy(key, "from_stage").agg(F.count(F.lit(1)).alias("_out"))
    return per_node.groupBy(key).agg(
        F.sum("_out").alias("n_links"),
        F.count_if(F.col("_out") > 1).alias("n_branches"),
        F.count_if(F.col("_out") > 2).alias("n_complex_branches"),
    )


# Flags of a step type, packed so that an entity needs a single bitwise aggregate.
FLAGS = (
    "any_source any_target file_source file_target connector_source change_transform any_change "
    "any_teradata any_netezza any_pivot any_connector any_file any_jdbc"
).split()


def type_profiles(stages: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """Weight, effort, support class and packed flags of every distinct type.

    Names are looked at once per distinct type and not once per step.
    """
    types = stages.select(F.coalesce("type", F.lit("Unknown")).alias("type")).distinct()
    # The rule rows are a list in code of about a hundred entries.
    known = types.join(F.broadcast(type_rule_table(stages.sparkSession, weights)), "type", "left")
    t, no = F.col("type"), F.lit(False)
    has = lambda word: F.contains(t, F.lit(word))
    is_ = lambda c: F.coalesce(F.col(c), no)
    file_like = has("File") | has("Dataset")
    conditions = {
        "any_source": is_("is_source"),
        "any_target": is_("is_target"),
        "file_source": is_("is_source") & file_like,
        "file_target": is_("is_target") & file_like,
        "connector_source": is_("is_source") & has("Connector"),
        "change_transform": is_("is_transform") & has("Change"),
        "any_change": has("Change"),
        "any_teradata": has("Teradata"),
        "any_netezza": has("Netezza"),
        "any_pivot": has("Pivot"),
        "any_connector": has("Connector"),
        "any_file": file_like,
        "any_jdbc": has("Oracle") | has("DB2") | has("SQLServer"),
    }
    mask = F.lit(0)
    for bit, name in enumerate(FLAGS):
        mask = mask + F.when(conditions[name], 1 << bit).otherwise(0)
    one = lambda condition: F.when(condition, 1).otherwise(0)
    return known.select(
        "type",
        F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight"),
        F.coalesce("effort", F.lit(1.0)).cast("decimal(10,1)").alias("effort"),
        one(F.col("support") == "full").alias("n_full"),
        one(F.col("support") == "partial").alias("n_partial"),
        one(F.col("support") == "manual").alias("n_manual"),
        one(F.col("support").isNull() & (t != "Unknown") & (t != "")).alias("n_unknown"),
        one(has("Lookup")).alias("n_lookups"),
        one(is_("is_transform")).alias("n_transforms"),
        one(t == "Transformer").alias("n_transformers"),
        mask.alias("mask"),
    )


def features(
    stages: DataFrame,
    links: DataFrame,
    key: str,
    weights: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per entity with everything the rules look at."""
    sums = "weight effort n_full n_partial n_manual n_unknown n_lookups n_transforms n_transformers"
    # Stored, so that Catalyst knows its size and broadcasts it below the usual threshold.
    profiles = materialise(type_profiles(stages, weights), "types")
    typed = stages.select(key, F.coalesce("type", F.lit("Unknown")).alias("type")).join(
        profiles, "type"
    )
    per_entity = typed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stages"),
        *[F.sum(c).alias(c) for c in sums.split()],
        F.bit_or("mask").alias("_mask"),
    )
    flags = {
        name: F.col("_mask").bitwiseAND(F.lit(1 << bit)) != 0 for bit, name in enumerate(FLAGS)
    }
    counted = per_entity.withColumns(flags).drop("_mask")
    return with_score(
        counted.join(branch_counts(links, key), key, "left").na.fill(
            0, ["n_links", "n_branches", "n_complex_branches"]
        )
    )


def with_score(df: DataFrame) -> DataFrame:
    """Complexity: steps (at most 30) + type weights + links (at most 20) + branches (at most 10)."""
    n, links, branches = F.col("n_stages"), F.col("n_links"), F.col("n_branches")
    score = (
        F.least(n * 2, F.lit(30))
        + F.col("weight")
        + F.least(links * F.lit(1.5), F.lit(20.0))
        + F.least(branches * 3, F.lit(10))
    )
    return df.withColumn("score", F.least(score, F.lit(100.0)))


def migration_category(df: DataFrame) -> DataFrame:
    score, names = F.col("score"), MIGRATION_CATEGORIES
    return df.withColumn(
        "migration_category",
        F.when(F.col("file_source") & F.col("file_target") & (score < 20), names["files"])
        .when(F.col("any_source") & ~F.col("any_target") & (score < 30), names["read_only"])
        .when(F.col("connector_source") & (score < 40) & (F.col("n_transforms") < 3), names["simple_connector"])
        .when(F.col("change_transform"), names["change"])
        .when((F.col("n_transforms") > 5) | (score > 70), names["transformations"])
        .when(score < 30, names["score_below_30"])
        .when(score < 50, names["score_below_50"])
        .when(score < 70, names["score_below_70"])
        .otherwise(names["rest"]),
    )


def _filled(text: str, value: Column) -> Column:
    """The text with {} replaced by a column's value."""
    before, after = text.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def with_automation(df: DataFrame) -> DataFrame:
    total = F.greatest("n_stages", F.lit(1))
    return df.withColumn(
        "automation_ratio", (F.col("n_full") + F.col("n_partial") * F.lit(0.5)) / total
    )


def with_risk(df: DataFrame) -> DataFrame:
    """Risk factors and score. The score is kept in hundredths, so thresholds compare exactly."""
    conditions = {
        "lookups": (F.col("n_lookups") > 2, F.col("n_lookups")),
        "change": (F.col("any_change"), None),
        "branches": (F.col("n_complex_branches") > 0, F.col("n_complex_branches")),
        "teradata": (F.col("any_teradata"), None),
        "netezza": (F.col("any_netezza"), None),
        "score": (F.col("score") > 80, F.col("score")),
        "pivot": (F.col("any_pivot"), None),
    }
    factors = [
        (condition, RISK_FACTORS[name][0], F.lit(RISK_FACTORS[name][1]) if value is None else _filled(RISK_FACTORS[name][1], value))
        for name, (condition, value) in conditions.items()
    ]
    points = F.lit(0)
    for condition, value, _ in factors:
        points = points + F.when(condition, value).otherwise(0)
    return df.withColumns(
        {
            "risk_points": F.least(points, F.lit(100)),
            "risk_factors": F.array_compact(F.array(*[F.when(c, text) for c, _, text in factors])),
        }
    ).withColumn("risk", F.col("risk_points") / F.lit(100.0))


def with_class(df: DataFrame) -> DataFrame:
    ratio, score, risk = F.col("automation_ratio"), F.col("score"), F.col("risk")
    points = F.col("risk_points")
    manual = (F.col("n_manual") > 0) | (points > 40)
    auto = (ratio > 0.8) & (score < 40) & (points < 20)
    semi = (ratio > 0.6) & (score < 60)
    return df.withColumns(
        {
            "category": F.when(manual, "MANUAL")
            .when(auto, "AUTO")
            .when(semi, "SEMI_AUTO")
            .when(score > 70, "MANUAL")
            .otherwise("SEMI_AUTO"),
            "confidence": F.when(manual, F.least(F.lit(0.95), F.lit(0.7) + F.lit(0.3) * risk))
            .when(auto, F.least(F.lit(0.95), ratio - risk))
            .when(
                semi,
                F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.3) * ratio - F.lit(0.2) * risk),
            )
            .otherwise(F.lit(0.6)),
        }
    )


def with_success(df: DataFrame, baseline: Column | float = 0.85) -> DataFrame:
    base = baseline if isinstance(baseline, Column) else F.lit(baseline)
    p = (
        base
        + F.col("automation_ratio") * F.lit(0.15)
        - F.col("risk") * F.lit(0.3)
        - F.col("score") / F.lit(100.0) * F.lit(0.2)
        - F.col("n_unknown") / F.greatest("n_stages", F.lit(1)) * F.lit(0.1)
    )
    return df.withColumn(
        "success_probability", F.greatest(F.lit(0.1), F.least(F.lit(0.99), p))
    )


def with_effort(df: DataFrame, factor: Column | float = 1.0) -> DataFrame:
    """Hours in decimal arithmetic, so that halves round alike everywhere."""
    scale = factor if isinstance(factor, Column) else F.lit(factor)
    by_class = (
        F.when(F.col("category") == "AUTO", F.lit("0.5"))
        .when(F.col("category") == "MANUAL", F.lit("2.0"))
        .otherwise(F.lit("1.0"))
    ).cast("decimal(2,1)")
    hours = (
        (F.col("effort").cast("decimal(12,1)") + F.lit(2))
        * (F.lit(1) + F.col("score").cast("decimal(6,1)") / F.lit(100)).cast("decimal(8,4)")
        * by_class
        * scale.cast("decimal(10,4)")
    )
    return df.withColumn("estimated_hours", F.round(hours, 1).cast("double"))


def with_risk_level(df: DataFrame) -> DataFrame:
    critical = F.lit(False)
    text = F.lower(F.array_join("risk_factors", "\n"))
    for word in ("cdc/scd", "custom routine", "external call"):
        critical = critical | F.contains(text, F.lit(word))
    points = F.col("risk_points")
    return df.withColumn(
        "risk_level",
        F.when(critical | (points > 60), "CRITICAL")
        .when(points > 40, "HIGH")
        .when(points > 20, "MEDIUM")
        .otherwise("LOW"),
    )


def predictions(
    entity_features: DataFrame,
    baseline: Column | float = 0.85,
    factor: Column | float = 1.0,
) -> DataFrame:
    df = with_class(with_risk(with_automation(migration_category(entity_features))))
    return with_risk_level(with_effort(with_success(df, baseline), factor))


def with_labels(df: DataFrame) -> DataFrame:
    """Recommendation, blocker and feature label arrays of a prediction row."""
    factors = F.array_join("risk_factors", "\n")
    says = lambda word: F.contains(factors, F.lit(word))
    auto, semi = F.col("category") == "AUTO", F.col("category") == "SEMI_AUTO"
    manual = ~auto & ~semi
    advice = {
        "auto": auto,
        "semi_auto": semi,
        "manual": manual,
        "change": says("CDC"),
        "lookup": says("Lookup"),
        "teradata": says("Teradata"),
        "large": F.col("n_stages") > 10,
    }
    needs = {
        "always": F.lit(True),
        "connector": F.col("any_connector"),
        "file": F.col("any_file"),
        "change": F.col("any_change"),
        "score": F.col("score") > 60,
        "jdbc": F.col("any_jdbc"),
        "teradata": F.col("any_teradata"),
    }
    pick = lambda conditions, texts: F.array_compact(
        F.array(*[F.when(c, F.lit(text)) for name, c in conditions.items() for text in texts[name]])
    )
    blockers = F.array_compact(
        F.array(
            F.when(says("CDC") | says("SCD"), F.lit(BLOCKERS["change"])),
            F.when(F.contains(F.lower(factors), F.lit("custom")), F.lit(BLOCKERS["custom"])),
            F.when(F.col("n_transformers") > 3, _filled(BLOCKERS["transformers"], F.col("n_transformers"))),
        )
    )
    return df.withColumns(
        {
            "recommendations": pick(advice, RECOMMENDATIONS),
            "features_needed": F.sort_array(pick(needs, FEATURES_NEEDED)),
            "rule_blockers": blockers,
        }
    )


def type_blockers(stages: DataFrame, key: str) -> DataFrame:
    """One blocker row per entity and distinct step type that needs manual work."""
    return (
        stages.where(F.col("type").isin(MANUAL))
        .select(
            key,
            _filled(BLOCKERS["type"], F.col("type")).alias("blocker"),
        )
        .distinct()
    )


def common_blockers(stages: DataFrame, labelled: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Blockers by how many entities have them, all or the first ``n``.

    ``labelled`` are predictions with labels (``with_labels``).
    """
    named = labelled.select(key, F.explode("rule_blockers").alias("blocker"))
    counts = type_blockers(stages, key).unionByName(named).groupBy("blocker").agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), "blocker").limit(n)


def portfolio_report(stages: DataFrame, categorised: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """(section, label, n): entities per category and score bucket, and per source, target and transform type.

    ``categorised`` has migration_category and score per entity; type lists may be cut to the first ``n``.
    """
    score = F.col("score")
    bucket = F.when(score < 30, "simple").when(score < 60, "medium").otherwise("complex")
    count = F.count(F.lit(1)).alias("n")
    out = categorised.groupBy(F.lit("category").alias("section"), F.col("migration_category").alias("label")).agg(count)
    out = out.unionByName(categorised.groupBy(F.lit("bucket").alias("section"), bucket.alias("label")).agg(count))
    distinct = stages.select(key, "type").distinct()
    for name, types in (("source", SOURCES), ("target", TARGETS), ("transform", TRANSFORMS)):
        top = distinct.where(F.col("type").isin(types)).groupBy(F.lit(name).alias("section"), F.col("type").alias("label"))
        top = top.agg(count)
        out = out.unionByName(top if n is None else top.orderBy(F.desc("n"), "label").limit(n))
    return out


def unknown_rollup(stages: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """(section, label, n): entities per unknown step type, totals, and unknown types per entity (all or the first ``n``)."""
    known = sorted({*FULL, *PARTIAL, *MANUAL, *METADATA})
    unknown = stages.where(~F.col("type").isin(known) & (F.col("type") != "")).select(key, "type").distinct()
    count = F.count(F.lit(1)).alias("n")
    out = unknown.groupBy(F.lit("type").alias("section"), F.col("type").alias("label")).agg(count)
    for label, column in (("unique types", "type"), ("entities", key)):
        total = unknown.agg(F.count_distinct(column).alias("n"))
        out = out.unionByName(total.select(F.lit("total").alias("section"), F.lit(label).alias("label"), "n"))
    each = unknown.groupBy(key).agg(count)
    if n is not None:
        each = each.orderBy(key).limit(n)
    return out.unionByName(each.select(F.lit("entity").alias("section"), F.col(key).cast("string").alias("label"), "n"))


def calibration(results: DataFrame) -> DataFrame:
    """Effort factor and success base from actual results; 1.0 where nothing was predicted."""
    predicted = F.sum("predicted_hours")
    return results.agg(
        F.when(predicted > 0, F.sum("actual_hours") / predicted).otherwise(F.lit(1.0)).alias("effort_factor"),
        F.avg(F.col("success").cast("int")).alias("success_baseline"),
    )


def calibrated_predictions(entity_features: DataFrame, results: DataFrame) -> DataFrame:
    one = calibration(results)
    return predictions(
        entity_features,
        one.select("success_baseline").scalar(),
        one.select("effort_factor").scalar(),
    )


def with_priority(df: DataFrame, business: Column | float = 0.5) -> DataFrame:
    """Weighted priority. The rows are stored once: the largest effort, a scalar, and the rest read them there."""
    df = materialise(df, "predictions")
    top = df.agg(
        F.coalesce(F.nullif(F.max("estimated_hours"), F.lit(0.0)), F.lit(1.0)).alias("m")
    ).scalar()
    auto = (
        F.when(F.col("category") == "AUTO", 1.0)
        .when(F.col("category") == "SEMI_AUTO", 0.5)
        .when(F.col("category") == "MANUAL", 0.2)
        .otherwise(0.3)
    )
    calm = (
        F.when(F.col("risk_level") == "LOW", 1.0)
        .when(F.col("risk_level") == "MEDIUM", 0.7)
        .when(F.col("risk_level") == "HIGH", 0.4)
        .when(F.col("risk_level") == "CRITICAL", 0.1)
        .otherwise(0.5)
    )
    value = business if isinstance(business, Column) else F.lit(business)
    priority = (
        F.lit(0.3) * auto
        + F.lit(0.25) * F.col("success_probability")
        + F.lit(0.2) * value
        + F.lit(0.15) * (F.lit(1.0) - F.col("estimated_hours") / top)
        + F.lit(0.1) * calm
    )
    return df.withColumn("priority", F.round(priority, 3))


def priority_rank(df: DataFrame, key: str) -> DataFrame:
    return dense_number(df, [("priority", "desc"), key], "rank")


def capacity(df: DataFrame) -> DataFrame:
    hours = (
        F.lit("0.5").cast("decimal(4,2)")
        + (F.col("score").cast("decimal(6,1)") / F.lit(100)).cast("decimal(8,4)")
        + F.col("n_stages").cast("decimal(12,0)") * F.lit("0.05").cast("decimal(4,2)")
    )
    return df.withColumn("capacity_hours", F.round(hours, 2))


def capacity_cost(df: DataFrame) -> DataFrame:
    """Total capacity and monthly cost at 0.44 per hour and 30 days."""
    return capacity(df).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("capacity_hours").cast("double").alias("capacity_hours"),
        F.round(F.sum("capacity_hours") * F.lit("13.2").cast("decimal(4,1)"), 2)
        .cast("double")
        .alias("monthly_cost"),
    )


def batch_report(df: DataFrame) -> DataFrame:
    """Counts per class and risk level, mean probability and total hours, one row."""
    n = F.count(F.lit(1))
    is_class = lambda c: F.count_if(F.col("category") == c)
    is_risk = lambda r: F.count_if(F.col("risk_level") == r)
    pct = lambda c: F.round(F.lit(100.0) * c / n, 1)
    return df.agg(
        n.alias("n_total"),
        is_class("AUTO").alias("n_auto"),
        is_class("SEMI_AUTO").alias("n_semi"),
        is_class("MANUAL").alias("n_manual"),
        pct(is_class("AUTO")).alias("auto_pct"),
        pct(is_class("SEMI_AUTO")).alias("semi_pct"),
        pct(is_class("MANUAL")).alias("manual_pct"),
        F.round(F.sum(F.col("success_probability").cast("decimal(18,6)")) / n * 100, 1)
        .cast("double")
        .alias("mean_success_pct"),
        F.sum(F.col("estimated_hours").cast("decimal(18,1)")).cast("double").alias("total_hours"),
        is_risk("LOW").alias("n_low"),
        is_risk("MEDIUM").alias("n_medium"),
        is_risk("HIGH").alias("n_high"),
        is_risk("CRITICAL").alias("n_critical"),
    )


def run_summary(runs: DataFrame, ok: Column, producer: str, cost: str) -> DataFrame:
    """Runs, successes, success rate and total cost, for all and per producer, in one pass."""
    n = F.count(F.lit(1))
    return runs.groupingSets([[], [producer]], producer).agg(
        F.grouping(producer).alias("_all"),
        n.alias("n_runs"),
        F.count_if(ok).alias("n_ok"),
        F.round(F.lit(100.0) * F.count_if(ok) / n, 1).alias("success_rate"),
        F.sum(F.col(cost).cast("decimal(18,2)")).cast("double").alias("total_cost"),
    ).select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col(producer)).alias(producer),
        "n_runs", F.col("n_ok"), "success_rate", "total_cost",
    )


def threshold_rules(summary: DataFrame) -> DataFrame:
    """Advice rows whose condition holds on a one-row summary.

    Needs ``n_total, auto_pct, effort_reduction, n_high_risk, n_unknown_types, total_hours, n_files,
    n_connectors, n_lookups, n_change, n_complex, n_teradata``.
    """
    auto = F.col("auto_pct")
    share = lambda name, limit: F.col(name) > F.col("n_total") * F.lit(limit)
    rules = [
        ("success", "automation high", (auto >= 70), auto),
        ("tip", "automation medium", (auto >= 40) & (auto < 70), auto),
        ("warning", "automation low", (auto < 40), auto),
        ("success", "batch processing pays", F.col("effort_reduction") > 20, F.col("effort_reduction")),
        ("warning", "many high-risk entities", F.col("n_high_risk") > 5, F.col("n_high_risk")),
        ("tip", "unknown step types", F.col("n_unknown_types") > 0, F.col("n_unknown_types")),
        ("tip", "total effort", F.col("total_hours") > 0, F.col("total_hours")),
        ("tip", "file heavy", share("n_files", 0.5), F.col("n_files")),
        ("tip", "connector heavy", share("n_connectors", 0.3), F.col("n_connectors")),
        ("tip", "lookup heavy", share("n_lookups", 0.3), F.col("n_lookups")),
        ("warning", "change capture present", F.col("n_change") > 0, F.col("n_change")),
        ("warning", "complex entities", share("n_complex", 0.3), F.col("n_complex")),
        ("tip", "special connector present", F.col("n_teradata") > 0, F.col("n_teradata")),
    ]
    rows = F.array(
        *[
            F.when(
                condition,
                F.struct(
                    F.lit(level).alias("level"),
                    F.lit(rule).alias("rule"),
                    value.cast("double").alias("value"),
                ),
            )
            for level, rule, condition, value in rules
        ]
    )
    return summary.select(F.inline(F.array_compact(rows)))
