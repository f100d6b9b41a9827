"""Similar sequences without comparing all pairs.

Similarity of two step sequences is ``0.5 J + 0.3 L + 0.2 O``: Jaccard of the step sets, ratio of
the lengths, and order similarity from the longest common subsequence. With a
threshold t > 0.5, L <= 1 and O <= 1 give ``J >= 2t - 1``, so two similar sets share at least
``ceil((2t - 1) * size)`` steps of each. Candidates come from equi-joins built on that bound
and every candidate is then scored exactly; no pair is lost and none is sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stageloom.operators.ordering import dense_number
from stageloom.operators.sequences import sequence_profiles
from stageloom.scratch import materialise

#: Sets up to this size are joined on shared subsets, larger ones on rare steps.
SUBSET_LIMIT = 13

#: Sequences up to this length go along with their subsets, so that their pairs are scored where they meet.
CARRIED_STEPS = 32

#: Bits of a BIGINT used at a time: two of them and a carry add up without overflow.
WORD = 62

WEIGHT_SET, WEIGHT_LENGTH, WEIGHT_ORDER = 0.5, 0.3, 0.2


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def length_similarity(m: Column, n: Column) -> Column:
    longest = F.greatest(m, n)
    return F.when(longest == 0, 1.0).otherwise(F.least(m, n) / longest)


def _once(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), use)[0]


def _place_words(a: Column, item: Column) -> Column:
    """The places of ``item`` in an array as bits, WORD of them in a number."""

    def bits(word: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("place"))

        def add(acc: Column, x: Column) -> Column:
            here = F.when(x.eqNullSafe(item), acc["place"]).otherwise(F.lit(0).cast("long"))
            return F.struct((acc["bits"] + here).alias("bits"), F.shiftleft(acc["place"], 1).alias("place"))

        return F.aggregate(F.slice(a, word * WORD + 1, WORD), start, add, lambda acc: acc["bits"])

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / WORD).cast("int")), bits)


def _next_row(row: Column, met: Column) -> Column:
    """``(row + both) | (row - both)`` for numbers of several words, ``both = row & met``.

    The carries of WORD words are kept as the bits of one BIGINT, so that a row is written once a step.
    """
    full, zero, one = F.lit((1 << WORD) - 1), F.lit(0).cast("long"), F.lit(1).cast("long")
    pairs = F.zip_with(row, met, lambda r, m: F.struct(r.alias("r"), r.bitwiseAND(m).alias("both")))

    def word(acc: Column, pair: Column) -> Column:
        carry = F.shiftright(pair["r"] + pair["both"] + acc["carry"], WORD)  # the sum is below 2 ** 63
        bits = acc["bits"] + F.when(acc["carry"] > 0, acc["place"]).otherwise(zero)
        return F.struct(carry.alias("carry"), bits.alias("bits"), F.shiftleft(acc["place"], 1).alias("place"))

    def carries_of(pairs: Column) -> Column:
        def block(acc: Column, at: Column) -> Column:
            start = F.struct(acc["carry"].alias("carry"), zero.alias("bits"), one.alias("place"))
            walked = F.aggregate(F.slice(pairs, at * WORD + 1, WORD), start, word)
            return _once(walked, lambda w: F.struct(w["carry"].alias("carry"), F.concat(acc["blocks"], F.array(w["bits"])).alias("blocks")))

        start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("blocks"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / WORD).cast("int"))
        return F.aggregate(blocks, start, block, lambda acc: acc["blocks"])

    def added(x: Column) -> Column:
        def new(pair: Column, at: Column) -> Column:
            bits = F.get(x["carries"], F.floor(at / WORD).cast("int"))
            carry = F.call_function("shiftright", bits, F.pmod(at, F.lit(WORD))).bitwiseAND(one)
            return (pair["r"] + pair["both"] + carry).bitwiseAND(full).bitwiseOR(pair["r"] - pair["both"])

        return F.transform(x["pairs"], new)

    return _once(pairs, lambda p: _once(F.struct(p.alias("pairs"), carries_of(p).alias("carries")), added))


def lcs_length(a: Column, b: Column, kind: str = "string") -> Column:
    """Longest common subsequence of two arrays: a row of the usual table at a time, in the bits of BIGINTs. NULL arrays are empty."""
    empty = F.array().cast(f"array<{kind}>")
    a, b = F.coalesce(a.cast(f"array<{kind}>"), empty), F.coalesce(b.cast(f"array<{kind}>"), empty)

    def length(x: Column) -> Column:
        kinds = F.array_distinct(x["a"])
        masks = F.transform(kinds, lambda kind: _place_words(x["a"], kind))

        def walk(t: Column) -> Column:
            def step(row: Column, y: Column) -> Column:
                at = F.coalesce(F.array_position(t["kinds"], y), F.lit(0))
                return F.when(at > 0, _next_row(row, F.get(t["masks"], (at - 1).cast("int")))).otherwise(row)

            ones = F.transform(_place_words(x["a"], F.lit(None).cast(kind)), lambda _: F.lit((1 << WORD) - 1))
            zeros = lambda row: F.aggregate(row, F.lit(0).cast("long"), lambda n, w: n + F.lit(WORD) - F.bit_count(w))
            return F.aggregate(x["b"], ones, step, zeros)

        return _once(F.struct(kinds.alias("kinds"), masks.alias("masks")), walk)

    return _once(F.struct(a.alias("a"), b.alias("b")), length)


def order_similarity(
    a: Column,
    b: Column,
    m: Column,
    n: Column,
    set_a: Column | None = None,
    set_b: Column | None = None,
    approximate_above: int | None = None,
    kind: str = "string",
) -> Column:
    """``2 LCS / (m + n)``, exact for every size; 0 if one is empty. ``kind`` is the type of the steps.

    With ``approximate_above``, pairs of more than that many cells m * n use the shared set over the longer
    length instead, from the step sets ``set_a`` and ``set_b``.
    """
    exact = F.try_divide(F.lit(2.0) * lcs_length(a, b, kind), m + n)
    out = F.when((m == 0) | (n == 0), 0.0)
    if approximate_above is not None:
        out = out.when(m * n > approximate_above, F.size(F.array_intersect(set_a, set_b)) / F.greatest(m, n))
    return out.otherwise(exact)


def weighted(j: Column, length: Column, order: Column) -> Column:
    return F.lit(WEIGHT_SET) * j + F.lit(WEIGHT_LENGTH) * length + F.lit(WEIGHT_ORDER) * order


def sequence_patterns(sequences: DataFrame, key: str, step: str) -> tuple[DataFrame, DataFrame]:
    """Unique patterns, and the pattern of every entity.

    ``sequences`` is (entity, step_no, step). Copies collapse here, so a pattern that a third
    of all entities share is compared once. Patterns: id (first member), n_members, n_steps, steps
    (distinct), counts, seq. The steps below read each of these tables several times, so they are
    stored. Steps are shuffled once, by entity; all else follows from an entity's sequence.
    """
    profiles = materialise(sequence_profiles(sequences, key, "step_no", step), "profiles")
    members = profiles.select(key, "fingerprint")
    unique = profiles.groupBy("fingerprint").agg(F.min(F.struct(key, "seq")).alias("first"), F.count(F.lit(1)).alias("n_members"))
    steps = F.sort_array(F.array_distinct("first.seq"))
    patterns = unique.select(
        F.col(f"first.{key}").alias("id"),
        "fingerprint",
        "n_members",
        F.size("first.seq").cast("long").alias("n_steps"),
        steps.alias("steps"),
        F.transform(steps, lambda s: F.size(F.filter("first.seq", lambda x: x == s)).cast("long")).alias("counts"),
        F.col("first.seq").alias("seq"),
    )
    return materialise(patterns, "patterns"), members


def _shared_at_least(size: Column, permille: int) -> Column:
    """ceil(j * size) in whole numbers, j in thousandths."""
    return F.floor((size * permille + 999) / 1000).cast("int")


def _subsets(items: Column, skip: Column) -> Column:
    """All sub-arrays that leave out at most ``skip`` items, in order."""
    empty = F.array(
        F.struct(F.array().cast("array<bigint>").alias("k"), F.lit(0).alias("out"))
    )

    def extend(found: Column, x: Column) -> Column:
        taken = F.transform(
            found, lambda s: F.struct(F.concat(s["k"], F.array(x)).alias("k"), s["out"].alias("out"))
        )
        left = F.transform(
            F.filter(found, lambda s: s["out"] < skip),
            lambda s: F.struct(s["k"].alias("k"), (s["out"] + 1).alias("out")),
        )
        return F.concat(taken, left)

    return F.aggregate(items, empty, extend, lambda found: found["k"])


def _least_length_ratio(t: float) -> float:
    """Lowest L of a similar pair: J <= 1 and O <= 2L / (1 + L) in 0.5 J + 0.3 L + 0.2 O >= t."""
    c = t - WEIGHT_SET
    a, b = WEIGHT_LENGTH, WEIGHT_LENGTH + 2 * WEIGHT_ORDER - c
    return max(0.01, (-b + math.sqrt(b * b + 4 * a * c)) / (2 * a) - 1e-6)


def _may_reach(j: Column, m: Column, n: Column, t: float) -> Column:
    """Upper bound of the similarity from set overlap and lengths alone."""
    ratio = F.least(m, n) / F.greatest(m, n)
    best_order = F.lit(2.0) * ratio / (F.lit(1.0) + ratio)
    return weighted(j, ratio, best_order) >= F.lit(t - 1e-9)


def _shuffled(side: DataFrame) -> DataFrame:
    """Joined by shuffle. Catalyst takes the size of a stored table from its files, where arrays of few values are packed many
    times over, and leaves out what an explode adds: it would broadcast a side far above its threshold."""
    return side.hint("merge")


def _code(step: Column) -> Column:
    return F.xxhash64(step)


def _subset_meetings(patterns: DataFrame, t: float, permille: int, items: str, more: Column) -> DataFrame:
    """Pairs of short sets: the intersection of a similar pair is a large subset of both sides.

    Both sides list their large subsets; a pair meets at its intersection and is kept
    only there. Lengths go into the key in geometric classes, so that variants of
    one popular set do not all meet; the longer one, b, looks in its own class and the one below. ``items`` is the column
    that goes along as x and has the set's items; ``more`` is a further condition, evaluated last.
    """
    base = math.log(1 / _least_length_ratio(t))
    size = F.size("h")
    # A set that loses d steps has J <= 1 - d / size, and at most n - d of its n steps are shared: O <= 1 - d / n at L = 1.
    most = F.floor(F.lit(1 - t + 1e-9) / (F.lit(WEIGHT_SET) / size + F.lit(WEIGHT_ORDER) / F.col("n_steps"))).cast("int")
    skip = F.least(size - _shared_at_least(size, permille), most)
    rows = patterns.select(
        "id",
        "n_steps",
        size.alias("size"),
        F.col(items).alias("x"),
        F.explode(_subsets(F.col("h"), skip)).alias("k"),
        F.floor(F.log("n_steps") / base + 1e-9).cast("int").alias("length_class"),
    ).select(
        "id", "n_steps", "size", "x", F.xxhash64("k").alias("key"), F.size("k").alias("n_key"), "length_class"
    )
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    classes = F.array(F.col("length_class") - 1, F.col("length_class"))
    right = rows.select(
        *[F.col(c).alias(f"b_{c}") for c in rows.columns if c not in ("length_class", "n_key")],
        F.explode(F.filter(classes, lambda c: c >= 0)).alias("b_length_class"),
    )
    m, n, shared = F.col("a_n_steps"), F.col("b_n_steps"), F.col("a_n_key")
    union = F.col("a_size") + F.col("b_size") - shared
    common = F.least(m - F.col("a_size"), n - F.col("b_size")) + shared
    meets = (
        (F.col("a_key") == F.col("b_key"))
        & (F.col("a_length_class") == F.col("b_length_class"))
        & ((m < n) | ((m == n) & (F.col("a_id") < F.col("b_id"))))
        & (weighted(shared / union, length_similarity(m, n), F.lit(2.0) * common / (m + n)) >= F.lit(t - 1e-9))
        & (F.size(F.array_intersect("a_x", "b_x")) == shared)
    )
    return left.join(_shuffled(right), meets & more)


def _subset_candidates(patterns: DataFrame, t: float, permille: int, longer_than: int = 0) -> DataFrame:
    """(a, b) of the pairs of short sets that may be similar and have a sequence of more than so many steps."""
    pairs = _subset_meetings(patterns, t, permille, "h", F.col("b_n_steps") > longer_than)
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def _near_pairs(patterns: DataFrame, t: float, permille: int) -> DataFrame:
    """(a, b, similarity) of all similar pairs of short sets, scored in the join: no candidate is shuffled."""
    m, n, shared = F.col("a_n_steps"), F.col("b_n_steps"), F.col("a_n_key")
    repeats = lambda side, s: F.size(F.filter(f"{side}_x", lambda x: x == s))
    common = F.aggregate(
        F.array_intersect("a_x", "b_x"), F.lit(0), lambda acc, s: acc + F.least(repeats("a", s), repeats("b", s))
    )
    j, length = shared / (F.col("a_size") + F.col("b_size") - shared), length_similarity(m, n)
    # Order similarity is at most the shared steps with repeats; LCS runs on what is left.
    possible = weighted(j, length, F.lit(2.0) * common / (m + n)) >= F.lit(t - 1e-9)
    similarity = weighted(j, length, order_similarity(F.col("a_x"), F.col("b_x"), m, n, kind="bigint"))
    pairs = _subset_meetings(patterns, t, permille, "codes", possible & (similarity >= t))
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), similarity.alias("similarity"))


def _prefix_candidates(patterns: DataFrame, t: float, permille: int) -> DataFrame:
    """Pairs with at least one long set, met at the rarest step they share.

    With steps in ascending frequency, two sets that share ceil(j * size) steps share
    one within their first ``size - ceil(j * size) + 1``.
    """
    long = patterns.where(F.size("h") > SUBSET_LIMIT)
    tokens = patterns.select("id", "n_steps", F.size("h").alias("size"), F.explode("h").alias("x"))
    # Step types, not rows: one entry per distinct step.
    frequency = tokens.groupBy("x").agg(F.count(F.lit(1)).alias("f"))
    ranked = (
        tokens.join(frequency, "x")
        .groupBy("id", "n_steps", "size")
        .agg(F.sort_array(F.collect_list(F.struct("f", "x")))["x"].alias("r"))
    )
    prefix = ranked.withColumn(
        "p", F.slice("r", F.lit(1), F.col("size") - _shared_at_least(F.col("size"), permille) + 1)
    ).select("id", "n_steps", "size", "p", F.explode("p").alias("x"))
    left = prefix.join(long.select("id"), "id", "left_semi").select(
        *[F.col(c).alias(f"a_{c}") for c in prefix.columns]
    )
    right = prefix.select(*[F.col(c).alias(f"b_{c}") for c in prefix.columns])
    both_long = F.col("b_size") > SUBSET_LIMIT
    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    meets = (
        (F.col("a_x") == F.col("b_x"))
        & (F.col("a_id") != F.col("b_id"))
        & (~both_long | (F.col("a_id") < F.col("b_id")))
        & (small >= _shared_at_least(large, permille))
        & _may_reach(small / large, F.col("a_n_steps"), F.col("b_n_steps"), t)
        & (F.element_at(F.array_intersect("a_p", "b_p"), 1) == F.col("a_x"))
    )
    return left.join(_shuffled(right), meets).select(
        F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")
    )


def similar_pairs(patterns: DataFrame, t: float = 0.85) -> DataFrame:
    """(a, b, similarity) with a < b of all unique patterns at or above the threshold.

    All similar pairs are the result, so it grows with the square of a group of similar patterns.
    """
    if t <= 0.5:
        raise ValueError("a threshold of 0.5 or less puts no bound on the set overlap")
    permille = int(math.floor((2 * t - 1) * 1000 + 1e-6))
    sets = materialise(patterns.where(F.col("n_steps") > 0).select(
        "id", "n_steps", F.sort_array(F.transform("steps", _code)).alias("h"), F.transform("seq", _code).alias("codes")
    ), "sets")
    # Step types, not rows. Should two have one code, all pairs are scored by the steps themselves.
    n_types, n_codes = patterns.select(F.explode("steps").alias("s")).distinct().agg(
        F.count(F.lit(1)), F.count_distinct(_code(F.col("s")))
    ).first()
    carried = CARRIED_STEPS if n_types == n_codes else 0
    is_near = (F.size("h") <= SUBSET_LIMIT) & (F.col("n_steps") <= carried)
    near = _near_pairs(sets.where(is_near), t, permille)
    # The other pairs have a long set or a long sequence; these are all that can be part of one.
    shortest = -(-(SUBSET_LIMIT + 1) * permille // 1000)
    may_be_far = lambda steps: (F.size(steps) >= shortest) | (F.col("n_steps") > carried * _least_length_ratio(t))
    sets = sets.where(may_be_far("h")).drop("codes")
    # Candidates depend on the set and the length alone: patterns that share both are one form while they are sought.
    forms = materialise(sets.groupBy("h", "n_steps").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "forms")
    short = forms.where((F.size("h") <= SUBSET_LIMIT) & (F.col("n_steps") > carried * _least_length_ratio(t)))
    same = forms.where(~is_near & (F.col("n") > 1))
    form_pairs = (
        _subset_candidates(short, t, permille, carried)
        .unionByName(_prefix_candidates(forms, t, permille))
        .distinct()
        .unionByName(same.select(F.col("id").alias("a"), F.col("id").alias("b")))
    )
    of_form = sets.join(forms.select("h", "n_steps", F.col("id").alias("form")), ["h", "n_steps"]).select("form", "id")
    candidates = (
        form_pairs.join(of_form.select(F.col("form").alias("a"), F.col("id").alias("x")), "a")
        .join(of_form.select(F.col("form").alias("b"), F.col("id").alias("y")), "b")
        .where("a <> b OR x < y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    candidates = materialise(candidates, "candidates")
    side = lambda p: patterns.where(may_be_far("steps")).select(
        F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("n_steps", "steps", "counts", "seq")]
    )
    # A candidate is a few bytes but takes work to score: keep the full number of tasks for
    # the last join instead of letting AQE merge its small partitions.
    tasks = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = candidates.join(_shuffled(side("b")), "b").repartition(tasks, "a").join(_shuffled(side("a")), "a")
    m, n = F.col("a_n_steps"), F.col("b_n_steps")
    scored = scored.withColumns(
        {
            "j": jaccard(F.col("a_steps"), F.col("b_steps")),
            "l": length_similarity(m, n),
            "common": _common_steps(),
        }
    )
    # Order similarity is at most the shared steps with repeats; LCS runs on what is left.
    possible = weighted(F.col("j"), F.col("l"), F.lit(2.0) * F.col("common") / (m + n))
    scored = scored.where(possible >= F.lit(t - 1e-9))
    order = order_similarity(F.col("a_seq"), F.col("b_seq"), m, n)
    far = scored.withColumn("similarity", weighted(F.col("j"), F.col("l"), order)).where(F.col("similarity") >= t)
    return near.unionByName(far.select("a", "b", "similarity"))


def _common_steps() -> Column:
    """Shared steps counted with repeats."""
    shared = F.array_intersect("a_steps", "b_steps")
    count = lambda side, s: F.element_at(
        F.col(f"{side}_counts"), F.array_position(F.col(f"{side}_steps"), s).cast("int")
    )
    return F.aggregate(
        shared, F.lit(0).cast("bigint"), lambda acc, s: acc + F.least(count("a", s), count("b", s))
    )


def greedy_clusters(pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Greedy clusters of similar patterns; a pattern can be in several.

    The rule: go through the pairs, most similar first; a pair seeds a cluster unless
    both of its patterns are seeds already; patterns that are similar to both seeds and
    not yet seeds join it. A pair is therefore a seed exactly if it is the best pair of one of
    its ends, and a pattern can join exactly if its own best pair comes later. Both are
    grouped minima, so no order has to be walked.

    Returns (cluster_id, member, similarity, cluster_size, cluster_rank); the size counts entities.
    """
    rank = F.struct((-F.col("similarity")).alias("s"), F.col("a").alias("a"), F.col("b").alias("b"))
    ranked = pairs.select("a", "b", "similarity", rank.alias("rank"))
    edges = ranked.select(F.col("a").alias("u"), F.col("b").alias("v"), "rank").unionByName(
        ranked.select(F.col("b").alias("u"), F.col("a").alias("v"), "rank")
    )
    # Read for the seeds, for their degrees and for what joins later.
    best = materialise(edges.groupBy("u").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("degree")), "best")
    seeds = best.select("best").distinct().select(
        F.col("best.a").alias("a"), F.col("best.b").alias("b"), (-F.col("best.s")).alias("similarity"),
        F.col("best").alias("rank"),
    )
    numbered = dense_number(
        seeds.withColumn("s", -F.col("similarity")), ["s", "a", "b"], "cluster_id", start=-1
    ).select("cluster_id", "a", "b", "similarity", "rank")
    # Look for joiners among the neighbours of the end that has fewer of them.
    degree = best.select("u", "degree")
    ends = (
        numbered.join(degree.withColumnsRenamed({"u": "a", "degree": "da"}), "a")
        .join(degree.withColumnsRenamed({"u": "b", "degree": "db"}), "b")
        .select(
            "cluster_id",
            "similarity",
            F.col("rank").alias("seed_rank"),
            F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("p"),
            F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("q"),
        )
    )
    later = best.select(F.col("u").alias("c"), "best")
    near_p = edges.select(F.col("u").alias("p"), F.col("v").alias("c"))
    near_q = edges.select(F.col("u").alias("q"), F.col("v").alias("c"))
    joiners = (
        ends.join(near_p, "p")
        .join(later, "c")
        .where(F.col("best") > F.col("seed_rank"))
        .join(near_q, ["q", "c"], "left_semi")
        .select("cluster_id", F.col("c").alias("member"), "similarity")
    )
    members = (
        numbered.select("cluster_id", F.explode(F.array("a", "b")).alias("member"), "similarity")
        .unionByName(joiners)
        .join(patterns.select(F.col("id").alias("member"), "n_members"), "member")
    )
    sizes = members.groupBy("cluster_id").agg(F.sum("n_members").alias("cluster_size"))
    by_size = dense_number(sizes, [("cluster_size", "desc"), "cluster_id"], "cluster_rank")
    return members.join(by_size, "cluster_id").select(
        "cluster_id", "member", "similarity", "cluster_size", "cluster_rank"
    )


def expand_members(clusters: DataFrame, patterns: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Every entity of each clustered pattern."""
    return (
        clusters.join(patterns.select(F.col("id").alias("member"), "fingerprint"), "member")
        .join(members, "fingerprint")
        .select(key, "cluster_id", "cluster_rank", "similarity")
    )
