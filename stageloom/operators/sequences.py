"""Ordered step sequences per entity: fingerprints, classes, roles, diffs and summaries.

Sequences stay in long form (entity, step number, step). Arrays are collected only per entity:
distinct steps with counts, runs, or the ordered steps for an order comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.functions.text import kind_ladder
from stageloom.operators.ordering import OrderKey, group_number, ordered_scan
from stageloom.operators.rule_tables import (
    CLASS_TEMPLATES,
    IGNORED_STEPS,
    KINDS,
    PARAMETER_WORDS,
    SOURCE_WORDS,
    TARGET_WORDS,
    endpoint_kinds,
)
from stageloom.operators.windows import collapse_runs

#: A fingerprint over lines hashes parts of this many lines, then the parts' digests.
LINES_PER_PART = 1000


def kept_steps(df: DataFrame, step: str, ignore: Sequence[str] = tuple(IGNORED_STEPS)) -> DataFrame:
    """Steps without blanks and ignored types; a missing type counts as 'Unknown'."""
    named = df.withColumn(step, F.coalesce(step, F.lit("Unknown")))
    return named.where(~F.col(step).isin(list(ignore)) & (F.col(step) != ""))


def step_sequences(
    df: DataFrame,
    key: str,
    order: Sequence[OrderKey],
    step: str,
    ignore: Sequence[str] = tuple(IGNORED_STEPS),
) -> DataFrame:
    """(entity, step number 1..n, step) of the steps that count."""
    numbered = group_number(kept_steps(df, step, ignore), [key], order, "step_no")
    return numbered.select(key, "step_no", step)


def bag_profiles(steps: DataFrame, key: str, step: str) -> DataFrame:
    """Length, distinct steps with counts and order-free fingerprint per entity.

    Counting (entity, step) first combines map-side; the collected array then has
    one entry per distinct step type.
    """
    counts = steps.groupBy(key, step).agg(F.count(F.lit(1)).alias("n"))
    bags = counts.groupBy(key).agg(
        F.sum("n").alias("n_steps"),
        F.sort_array(F.collect_list(F.struct(F.col(step).alias("step"), "n"))).alias("bag"),
    )
    return bags.withColumn("fingerprint", bag_fingerprint(F.col("bag.step"), F.col("bag.n")))


def bag_fingerprint(steps: Column, counts: Column) -> Column:
    """md5 prefix over the sorted steps joined by '|': every step's repeats are written as one piece (2 GB of text at most)."""

    def piece(pair: Column) -> Column:
        repeated = F.repeat(F.concat(pair["step"], F.lit("|")), pair["n"].cast("int"))
        return F.left(repeated, F.char_length(repeated) - 1)

    pairs = F.zip_with(steps, counts, lambda s, n: F.struct(s.alias("step"), n.alias("n")))
    return F.left(F.md5(F.array_join(F.transform(pairs, piece), "|")), F.lit(16))


EMPTY_FINGERPRINT = "d41d8cd98f00b204"  # md5 prefix of the empty text


def ordered_steps(steps: DataFrame, key: str, position: str, step: str) -> DataFrame:
    """Ordered step array of every entity."""
    ordered = F.sort_array(F.collect_list(F.struct(position, step))).alias("s")
    return steps.groupBy(key).agg(ordered).select(key, F.col("s")[step].alias("seq"))


def sequence_profiles(steps: DataFrame, key: str, position: str, step: str) -> DataFrame:
    """Ordered step array and order-free fingerprint of every entity, from one grouping of its steps.

    The fingerprint is that of ``bag_profiles``: the sorted steps are the same text.
    """
    text = F.array_join(F.sort_array("seq"), "|")
    return ordered_steps(steps, key, position, step).withColumn("fingerprint", F.left(F.md5(text), F.lit(16)))


def fingerprint_lines(
    lines: DataFrame,
    key: str,
    order: Sequence[OrderKey],
    line: str,
    out: str = "fingerprint",
    lines_per_part: int = LINES_PER_PART,
) -> DataFrame:
    """sha256 over the ordered lines of each entity, in one form for every size.

    Lines are numbered, each part of ``lines_per_part`` lines joined by '|' is hashed, and the digests of
    the parts, joined by '|' in order, are hashed again. Large entities are numbered in blocks.
    """
    numbered = group_number(lines, [key], list(order), "_rn")
    joined = lambda at, text: F.array_join(F.sort_array(F.collect_list(F.struct(at, text)))[text], "|")
    parts = (
        numbered.withColumn("_part", F.floor((F.col("_rn") - 1) / lines_per_part))
        .groupBy(key, "_part")
        .agg(F.sha2(joined("_rn", line), 256).alias("_digest"))
    )
    return parts.groupBy(key).agg(F.sha2(joined("_part", "_digest"), 256).alias(out))


def structural_lines(
    stages: DataFrame, links: DataFrame, key: str, properties: Sequence[str] = ("FileName", "SQL", "TableName")
) -> DataFrame:
    """Lines that describe a structure: '1' + stage (name first, with its key properties)
    and '2' + link, so that sorting puts stages by name before links.
    """
    parts = [F.concat(F.col("type"), F.lit(":"), F.col("name"))]
    for p in sorted(properties):
        value = F.col("properties")[p]
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{p}:"), value)))
    stage_text = F.concat_ws("|", *parts)
    stage_lines = stages.select(
        key, F.struct(F.lit(1).alias("k"), F.col("name").alias("a"), F.lit("").alias("b"), stage_text.alias("t")).alias("line")
    )
    link_lines = links.select(
        key,
        F.struct(
            F.lit(2).alias("k"),
            F.col("from_stage").alias("a"),
            F.col("to_stage").alias("b"),
            F.concat(F.lit("link:"), F.col("from_stage"), F.lit("->"), F.col("to_stage")).alias("t"),
        ).alias("line"),
    )
    return stage_lines.unionByName(link_lines)


def structural_fingerprint(
    stages: DataFrame, links: DataFrame, key: str, lines_per_part: int = LINES_PER_PART
) -> DataFrame:
    """sha256 over stages by name (with key properties), then links, as ``fingerprint_lines`` does it."""
    lines = structural_lines(stages, links, key).select(key, "line.*")
    return fingerprint_lines(lines, key, ["k", "a", "b", "t"], "t", lines_per_part=lines_per_part)


def exact_duplicates(df: DataFrame, fingerprint: str, member: str) -> DataFrame:
    """Members of every group of two or more, one row each; groups numbered by size.

    ``group_id`` counts groups by size (largest first), then by first member.
    """
    from stageloom.operators.ordering import dense_number

    groups = (
        df.groupBy(fingerprint)
        .agg(F.min(member).alias("representative"), F.count(F.lit(1)).alias("n_members"))
        .where(F.col("n_members") > 1)
    )
    numbered = dense_number(groups, [("n_members", "desc"), "representative"], "group_id")
    return df.select(fingerprint, member).join(numbered, fingerprint)


def class_flags(steps: DataFrame, key: str, step: str, entities: DataFrame) -> DataFrame:
    """Which kinds of step an entity has; entities without steps keep a row."""
    has = lambda *words: F.max(
        F.lit(False) if not words else _contains_any(F.col(step), words)
    )
    flags = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_steps"),
        has("Transformer", "Trx").alias("transform"),
        has("Seq", "File").alias("file"),
        has("Oracle", "DB2", "SQL", "ODBC", "JDBC").alias("db"),
        has("Hash", "Lookup").alias("lookup"),
        has("Custom").alias("custom"),
        has("Join").alias("join"),
        has("Aggregat").alias("aggregate"),
    )
    return entities.select(key).join(flags, key, "left").na.fill(0, ["n_steps"])


def _contains_any(column: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(column, F.lit(word))
    return hit


def classify_sequence(steps: DataFrame, key: str, step: str, entities: DataFrame) -> DataFrame:
    """First class whose rule holds."""
    f = F.col
    family = (
        F.when(f("n_steps") == 0, "Empty Job")
        .when(f("custom"), "Custom Processing")
        .when(f("db") & f("file") & f("transform"), "DB to File ETL")
        .when(f("db") & f("transform"), "Database ETL")
        .when(f("file") & f("transform"), "File Processing")
        .when(f("lookup") & f("transform"), "Lookup Enrichment")
        .when(f("join"), "Join Pipeline")
        .when(f("aggregate"), "Aggregation Pipeline")
        .when(f("transform"), "Transformation Only")
        .when(f("file"), "File Copy")
        .when(f("db"), "Database Copy")
        .otherwise("Other")
    )
    return class_flags(steps, key, step, entities).select(key, "n_steps", family.alias("family"))


def pattern_families(classed: DataFrame) -> DataFrame:
    """Size, template and effort reduction of each class."""
    template = F.lit("custom_etl")
    for family, name in CLASS_TEMPLATES.items():
        template = F.when(F.col("family") == family, name).otherwise(template)
    n = F.col("n_members")
    reduction = (n - (F.lit(1) + (n - 1) * F.lit(0.15))) / n * 100
    return (
        classed.groupBy("family")
        .agg(F.count(F.lit(1)).alias("n_members"))
        .withColumns(
            {
                "template": template,
                "effort_reduction": F.when(n <= 1, 0.0).otherwise(F.round(reduction, 4)),
            }
        )
    )


def pattern_signature(
    sequences: DataFrame, key: str, step: str, entities: DataFrame, n: int | None = None
) -> DataFrame:
    """Step kinds with repeats collapsed, all or the first ``n`` joined by an arrow."""
    kinds = sequences.withColumn("kind", kind_ladder(F.col(step), KINDS, F.col(step)))
    runs = collapse_runs(kinds, [key], ["step_no"], "kind", n)
    joined = runs.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("run", "kind")))["kind"], " → ").alias("signature")
    )
    return entities.select(key).join(joined, key, "left").na.fill("Empty", ["signature"])


def commonality_summary(fingerprints: DataFrame, fingerprint: str) -> DataFrame:
    """Totals and the effort that duplicates save: 8 hours per unique one, 1 per copy, at most 95 %."""
    groups = fingerprints.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n"))
    total, unique = F.col("n_total"), F.col("n_unique")
    before, after = total * 8, unique * 8 + (total - unique)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicates"),
    ).withColumn(
        "effort_reduction",
        F.when(total > 0, F.round(F.least((before - after) / before * 100, F.lit(95.0)), 4)).otherwise(0.0),
    )


def structure_diff(pairs: DataFrame, properties: DataFrame) -> DataFrame:
    """Differences of ``other_id`` against ``base_id``.

    ``properties`` is (id, name, property, value), with ``position`` if properties may repeat: the last value by position
    counts, without that column the greatest one. Rows: added and removed names, and changed properties of common names with
    both values.
    """
    at = F.struct("position", "value") if "position" in properties.columns else F.struct("value")
    single = properties.groupBy("id", "name", "property").agg(F.max_by("value", at).alias("value"))
    # A name without any property is there too: its only entry has no key.
    entries = F.filter(F.collect_list(F.struct("property", "value")), lambda e: e["property"].isNotNull())
    per_name = single.groupBy("id", "name").agg(entries.alias("p"))
    # One row per id, so that a pair carries each side once and names meet inside the row instead of in another shuffle.
    per_id = per_name.groupBy("id").agg(F.collect_list(F.struct("name", "p")).alias("names"))
    both = pairs.join(per_id.withColumnsRenamed({"id": "base_id", "names": "b"}), "base_id", "left").join(
        per_id.withColumnsRenamed({"id": "other_id", "names": "o"}), "other_id", "left"
    )
    tagged = lambda side, no: F.transform(
        F.col(side), lambda e: F.struct(e["name"].alias("name"), F.lit(no).alias("side"), e["p"].alias("p"))
    )
    none = F.array().cast(both.select(tagged("b", 0).alias("t")).schema["t"].dataType)
    merged = F.sort_array(F.concat(F.coalesce(tagged("b", 0), none), F.coalesce(tagged("o", 1), none)))
    return both.select("base_id", "other_id", F.inline(F.flatten(F.flatten(F.transform(F.array(merged), _name_changes)))))


def _name_changes(merged: Column) -> Column:
    """Rows of each name of two sides in order: a name that both have stands next to itself. NULL names match nothing."""
    missing = F.lit(None).cast("string")

    def row(e: Column, change: str, k: Column = missing, old: Column = missing, new: Column = missing) -> Column:
        return F.struct(
            e["name"].alias("name"),
            F.lit(change).alias("change"),
            k.alias("property"),
            old.alias("from_value"),
            new.alias("to_value"),
        )

    def changed(e: Column, other: Column) -> Column:
        b, o = F.map_from_entries(e["p"]), F.map_from_entries(other["p"])
        value = lambda x, k: F.try_element_at(x, k)
        keys = lambda m: F.filter(
            F.array_union(F.map_keys(m["b"]), F.map_keys(m["o"])), lambda k: ~value(m["b"], k).eqNullSafe(value(m["o"], k))
        )
        maps = F.array(F.struct(b.alias("b"), o.alias("o")))
        rows = lambda m: F.transform(keys(m), lambda k: row(e, "changed", k, value(m["b"], k), value(m["o"], k)))
        return F.transform(maps, rows)[0]

    def rows_of(e: Column, i: Column) -> Column:
        after, before = F.get(merged, i + 1), F.get(merged, i - 1)
        first = e["side"] == 0
        return (
            F.when(first & (after["name"] == e["name"]), changed(e, after))
            .when(first, F.array(row(e, "removed")))
            .when(F.coalesce(before["name"] == e["name"], F.lit(False)), F.slice(F.array(row(e, "added")), 1, 0))
            .otherwise(F.array(row(e, "added")))
        )

    return F.transform(merged, rows_of)


def parameter_only(pairs: DataFrame, diff: DataFrame) -> DataFrame:
    """Is every difference of a pair a changed property that only parameterises a step?"""
    simple = (F.col("change") == "changed") & _contains_any(
        F.lower(F.coalesce("property", F.lit(""))), PARAMETER_WORDS
    )
    verdict = diff.groupBy("base_id", "other_id").agg(F.bool_and(simple).alias("parameter_only"))
    return pairs.join(verdict, ["base_id", "other_id"], "left").na.fill(True, ["parameter_only"])


def infer_roles(stages: DataFrame, key: str, order: Sequence[OrderKey]) -> DataFrame:
    """Role of each known step: source, target, transform or lookup.

    Endpoints are named by marker words; without one, the first endpoint of an entity
    that has no source before it is a source, later ones are targets.
    """
    kinds = endpoint_kinds()
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    known = stages.withColumn("kind", F.try_element_at(table, F.col("type"))).where(
        F.col("kind").isNotNull()
    )
    name = F.lower("name")
    endpoint = F.col("kind").isin("jdbc", "s3")
    marked = known.withColumn(
        "_mark",
        F.when(~endpoint, "none")
        .when(_contains_any(name, SOURCE_WORDS), "source")
        .when(_contains_any(name, TARGET_WORDS), "target")
        .otherwise("open"),
    ).withColumn(
        "_opens", F.when(F.col("_mark").isin("source", "open"), 1).otherwise(0).cast("long")
    )
    scanned = ordered_scan(marked, [key], order, [{"_seen": ("sum", "_opens")}])
    role = (
        F.when(F.col("_mark").isin("source", "target"), F.col("_mark"))
        .when(F.col("_mark") == "open", F.when(F.col("_seen") == 1, "source").otherwise("target"))
        .when(F.col("kind").isin("lookup", "join"), "lookup")
        .otherwise("transform")
    )
    return scanned.withColumn("role", role).drop("_mark", "_opens", "_seen")


def layout_pattern(roles: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """Layout of an entity from its endpoint kinds, in file and in warehouse terms."""
    has = lambda role, kind: F.coalesce(
        F.bool_or((F.col("role") == role) & (F.col("kind") == kind)), F.lit(False)
    )
    flags = roles.groupBy(key).agg(
        has("source", "jdbc").alias("js"),
        has("target", "jdbc").alias("jt"),
        has("source", "s3").alias("fs"),
        has("target", "s3").alias("ft"),
        F.bool_or(F.col("role") == "lookup").alias("lk"),
        F.bool_or(F.col("role") == "transform").alias("tr"),
    )
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    layout = (
        F.when(f("js") & f("ft"), "jdbc_to_s3")
        .when(f("fs") & f("jt"), "s3_to_jdbc")
        .when(f("js") & f("jt"), "jdbc_to_jdbc")
        .when(f("fs") & f("ft"), "s3_to_s3")
        .when(f("lk"), "lookup_transform")
        .when(f("tr"), "transform_only")
        .otherwise("simple_copy")
    )
    warehouse = (
        F.when(f("fs") & f("jt"), "staging_to_table")
        .when(f("js") & f("jt"), "table_to_table")
        .when(f("js") & f("ft"), "table_to_staging")
        .when(f("lk"), "lookup_transform")
        .when(f("tr"), "transform")
        .otherwise("simple_copy")
    )
    return entities.select(key).join(flags, key, "left").select(
        key, layout.alias("layout"), warehouse.alias("warehouse_layout")
    )


def entity_text(
    stages: DataFrame,
    links: DataFrame,
    key: str,
    lines_per_part: int = 1000,
    max_value: int | None = None,
) -> DataFrame:
    """Text document of each entity: steps in order with their properties, then links.

    With ``max_value``, properties of that many characters or more are left out.

    Lines are numbered and joined per part of ``lines_per_part`` lines, so an entity of any
    size is written out whole; a usual one is a single part.
    """
    short = F.sort_array(F.map_entries("properties"))
    if max_value is not None:
        short = F.filter(short, lambda e: F.length(e["value"]) < max_value)
    texts = F.concat(
        F.array(F.concat(F.lit("Stage "), F.col("name"), F.lit(" of type "), F.col("type"))),
        F.transform(
            F.coalesce(short, F.array().cast("array<struct<key:string,value:string>>")),
            lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
        ),
    )
    head = stages.select(key).distinct().select(
        key,
        F.lit(0).alias("_s"),
        F.lit(0).cast("long").alias("_p"),
        F.lit("").alias("_a"),
        F.concat(F.lit("Job: "), F.col(key).cast("string")).alias("line"),
    )
    body = stages.select(
        key,
        F.lit(1).alias("_s"),
        F.col("position").cast("long").alias("_p"),
        F.lit("").alias("_a"),
        F.array_join(texts, " ").alias("line"),
    )
    tail = links.select(
        key,
        F.lit(2).alias("_s"),
        F.lit(0).cast("long").alias("_p"),
        F.concat_ws("|", "from_stage", "to_stage").alias("_a"),
        F.concat(F.lit("Link from "), F.col("from_stage"), F.lit(" to "), F.col("to_stage")).alias("line"),
    )
    numbered = group_number(
        head.unionByName(body).unionByName(tail), [key], ["_s", "_p", "_a", "line"], "_rn"
    )
    part = F.floor((F.col("_rn") - 1) / lines_per_part)
    return (
        numbered.withColumn("part", part)
        .groupBy(key, "part")
        .agg(
            F.array_join(
                F.sort_array(F.collect_list(F.struct("_rn", "line")))["line"], " "
            ).alias("text")
        )
    )


def entity_summary(
    stages: DataFrame, key: str, subject: Column, scores: DataFrame, limits: dict[str, int] | None = None
) -> DataFrame:
    """Compact summary: distinct types, sources, targets, transforms and subject words, each in order.

    ``limits`` may cut a list to its first values, for example ``{"types": 10, "sources": 3}``.
    """
    from stageloom.functions.text import keyword_tags
    from stageloom.operators.rule_tables import SOURCES, TARGETS, TRANSFORMS

    # One pass and one shuffle: the distinct types hold all lists of types, and tags come as one short array a step.
    gathered = stages.select(key, F.coalesce("type", F.lit("Unknown")).alias("_type"), keyword_tags(subject).alias("_tags")).groupBy(key).agg(
        F.sort_array(F.collect_set("_type")).alias("_types"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("_tags")))).alias("_words"),
    )
    among = lambda kinds: F.filter("_types", lambda v: v.isin(list(kinds)))
    lists = {
        "types": F.col("_types"), "sources": among(SOURCES), "targets": among(TARGETS), "transforms": among(TRANSFORMS), "subjects": F.col("_words")
    }
    for name, n in (limits or {}).items():
        if name in lists:
            lists[name] = F.slice(lists[name], 1, n)
    joined = gathered.select(key, *[F.array_join(values, ",").alias(name) for name, values in lists.items()])
    return scores.join(joined, key, "left").na.fill("", list(lists))
