import hashlib
import os
import random
import struct
import time

import numpy as np
import pandas as pd
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stageloom.operators import batches as B
from stageloom.operators import sequences as Q
from stageloom.operators import similarity as S
from stageloom.operators import vectors as V
from stageloom.operators.graph import topological_levels
from stageloom.operators.rules import branch_counts
from stageloom.plans import sequences


def table(spark, seqs):
    data = [(i, p, s) for i, seq in enumerate(seqs) for p, s in enumerate(seq)]
    return spark.createDataFrame(data, "id long, pos int, step string")


def test_fingerprint_groups(spark):
    df = spark.createDataFrame([(i, f) for i, f in enumerate(["fp1", "fp1", "fp2", "fp3", "fp3", "fp3"])], "id int, fp string")
    assert rows(df.groupBy("fp").count()) == [("fp1", 2), ("fp2", 1), ("fp3", 3)]
    assert rows(Q.exact_duplicates(df, "fp", "id"), "group_id", "id", "representative", "n_members") == [
        (1, 3, 3, 3), (1, 4, 3, 3), (1, 5, 3, 3), (2, 0, 0, 2), (2, 1, 0, 2)
    ]


def test_bag_fingerprint_ignores_order(spark):
    steps = Q.step_sequences(table(spark, [["b", "a", "CAnnotation", "a"], ["a", "a", "", "b"], ["a", "b"]]), "id", ["pos"], "step")
    fp = {r["id"]: r["fingerprint"] for r in Q.bag_profiles(steps, "id", "step").collect()}
    assert fp[0] == fp[1] == hashlib.md5(b"a|a|b").hexdigest()[:16]
    assert fp[2] == hashlib.md5(b"a|b").hexdigest()[:16]
    assert rows(steps.where("id = 0")) == [(0, 1, "b"), (0, 2, "a"), (0, 3, "a")]
    assert hashlib.md5(b"").hexdigest()[:16] == Q.EMPTY_FINGERPRINT


def test_structural_fingerprint(spark):
    stages = spark.createDataFrame(
        [("j", 0, "b", "T", {"FileName": "x", "other": "1"}), ("j", 1, "a", "S", {})],
        "job_id string, position int, name string, type string, properties map<string,string>",
    )
    links = spark.createDataFrame([("j", "b", "a")], "job_id string, from_stage string, to_stage string")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = sha(sha("S:a|T:b|FileName:x|link:b->a"))
    assert rows(Q.structural_fingerprint(stages, links, "job_id")) == [("j", want)]
    # Over several parts the digest still depends on the content only.
    large = Q.structural_fingerprint(stages, links, "job_id", lines_per_part=2).first().fingerprint
    again = Q.structural_fingerprint(stages.orderBy(F.desc("position")), links, "job_id", lines_per_part=2).first().fingerprint
    assert large == again == sha(sha("S:a|T:b|FileName:x") + "|" + sha("link:b->a"))


def test_fingerprint_lines_of_any_size(spark):
    lines = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "a")], "k int, line string")
    for size in (1, 100):
        fp = dict(rows(Q.fingerprint_lines(lines, "k", ["line"], "line", lines_per_part=size)))
        assert fp[1] == fp[2] != fp[3]
    large = spark.range(100_050).select(F.lit(1).alias("k"), F.format_string("%06d", "id").alias("line"))
    digests = []
    for at in range(0, 100_050, 1000):
        digests.append(hashlib.sha256("|".join(f"{i:06d}" for i in range(at, min(at + 1000, 100_050))).encode()).hexdigest())
    want = hashlib.sha256("|".join(digests).encode()).hexdigest()
    assert rows(Q.fingerprint_lines(large, "k", ["line"], "line")) == [(1, want)]


def test_entities_above_the_former_limits(spark):
    """One entity of 100 050 steps: spelled fingerprint, exact order, nothing cut."""
    n = 100_050
    steps = spark.range(n).select(F.lit(1).alias("id"), F.col("id").alias("step_no"), F.concat(F.lit("s"), F.col("id") % 7).alias("step"))
    md5 = hashlib.md5("|".join(sorted(f"s{i % 7}" for i in range(n))).encode()).hexdigest()[:16]
    assert Q.bag_profiles(steps, "id", "step").first().fingerprint == md5
    a = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.concat(F.lit("t"), x % 5)).alias("a"))
    pair = a.select("a", F.filter("a", lambda x: x != "t3").alias("b"))
    got = pair.select(S.order_similarity(F.col("a"), F.col("b"), F.size("a"), F.size("b")), S.lcs_length(F.col("a"), F.col("b"))).first()
    assert got[1] == 2400 and abs(got[0] - 4800 / 5400) < 1e-12
    near = pair.select(S.order_similarity(
        F.col("a"), F.col("b"), F.size("a"), F.size("b"), F.array_distinct("a"), F.array_distinct("b"), approximate_above=10_000
    )).first()
    assert abs(near[0] - 4 / 3000) < 1e-12
    signature = Q.pattern_signature(steps, "id", "step", spark.createDataFrame([(1,)], "id int")).first().signature
    assert signature.count(" → ") == n - 1
    clusters = spark.range(12).select(F.col("id").alias("c"), F.col("id").alias("k"))
    assert B.select_representatives(clusters, "c", "k", 3).count() == 12


CLASSES = [
    ([], "Empty Job"), (["CCustomStage", "Join"], "Custom Processing"),
    (["OracleX", "SeqFile", "Transformer"], "DB to File ETL"), (["DB2X", "CTrx"], "Database ETL"),
    (["SeqFile", "Transformer"], "File Processing"), (["Lookup", "Transformer"], "Lookup Enrichment"),
    (["Join"], "Join Pipeline"), (["Aggregator"], "Aggregation Pipeline"), (["Transformer"], "Transformation Only"),
    (["SeqFile"], "File Copy"), (["ODBCX"], "Database Copy"), (["Sort"], "Other"),
]


def test_classes_and_signatures(spark):
    steps = Q.step_sequences(table(spark, [s for s, _ in CLASSES]), "id", ["pos"], "step")
    ids = spark.range(len(CLASSES))
    assert rows(Q.classify_sequence(steps, "id", "step", ids), "id", "family") == sorted(
        ((i, c) for i, (_, c) in enumerate(CLASSES)), key=str
    )
    long = table(spark, [["CTrx", "Transformer", "CSeqFileStage", "CHashedFileStage", "Hash", "OracleX", "Sort", "Join"], []])
    seqs = Q.step_sequences(long, "id", ["pos"], "step")
    assert rows(Q.pattern_signature(seqs, "id", "step", spark.range(2), 5)) == [
        (0, "Transform → File → Lookup → Database → Sort"), (1, "Empty")
    ]
    assert rows(Q.pattern_signature(seqs, "id", "step", spark.range(2)))[0][1].endswith("Sort → Join")


def test_families_and_summary(spark):
    df = spark.createDataFrame([("File Copy",)] * 4 + [("Other",)], "family string")
    assert rows(Q.pattern_families(df)) == [("File Copy", 4, "s3_copy", 63.75), ("Other", 1, "custom_etl", 0.0)]
    fps = spark.createDataFrame([("a",)] * 3 + [("b",)], "fp string")
    assert rows(Q.commonality_summary(fps, "fp")) == [(4, 2, 1, 3, 43.75)]


def test_structure_diff_shuffles_each_entity_once(spark, plan_of):
    """Pairs meet whole entities: no shuffle of (pair, name) rows. NULL names match nothing, and an id without names has none."""
    spark_rows = [("a", "x", "P", "1"), ("a", None, "P", "1"), ("a", "gone", None, None), ("b", "x", "P", None), ("b", "x", "Q", "2"), ("b", None, "P", "1")]
    props = spark.createDataFrame(spark_rows, "id string, name string, property string, value string")
    pairs = spark.createDataFrame([("a", "b"), ("none", "a"), ("b", "none"), ("b", "b")], "base_id string, other_id string")
    diff = Q.structure_diff(pairs, props)
    shuffled = [line for line in plan_of(diff).splitlines() if "Exchange hashpartitioning(" in line and "_id#" in line and "name#" in line]
    assert shuffled == []
    out = sorted(tuple(r) for r in diff.where("base_id <> 'b' OR other_id = 'none'").na.fill("-").collect())
    assert out == [
        ("a", "b", "-", "added", "-", "-", "-"), ("a", "b", "-", "removed", "-", "-", "-"), ("a", "b", "gone", "removed", "-", "-", "-"),
        ("a", "b", "x", "changed", "P", "1", "-"), ("a", "b", "x", "changed", "Q", "-", "2"),
        ("b", "none", "-", "removed", "-", "-", "-"), ("b", "none", "x", "removed", "-", "-", "-"),
        ("none", "a", "-", "added", "-", "-", "-"), ("none", "a", "gone", "added", "-", "-", "-"), ("none", "a", "x", "added", "-", "-", "-"),
    ]
    assert {r["name"] for r in diff.where("base_id = 'b' AND other_id = 'b'").collect()} == {None}


def test_structure_diff(spark):
    props = spark.createDataFrame(
        [("t", "A", "TableName", "x"), ("t", "A", "Mode", "1"), ("t", "B", "Mode", "1"),
         ("j", "A", "TableName", "y"), ("j", "A", "Mode", "1"), ("j", "C", "Mode", "1"),
         ("k", "A", "TableName", "z"), ("k", "A", "Mode", "1"), ("k", "B", "Mode", "1")],
        "id string, name string, property string, value string",
    )
    pairs = spark.createDataFrame([("t", "j"), ("t", "k"), ("t", "t")], "base_id string, other_id string")
    diff = Q.structure_diff(pairs, props)
    assert rows(diff) == sorted([
        ("t", "j", "A", "changed", "TableName", "x", "y"), ("t", "j", "B", "removed", None, None, None),
        ("t", "j", "C", "added", None, None, None), ("t", "k", "A", "changed", "TableName", "x", "z"),
    ], key=str)
    assert rows(Q.parameter_only(pairs, diff)) == [("t", "j", False), ("t", "k", True), ("t", "t", True)]


def test_a_repeated_property_takes_its_last_value(spark):
    data = [("b", "s", "P", "1", 0), ("b", "s", "P", "0", 1), ("o", "s", "P", "9", 0), ("o", "s", "P", "0", 1), ("o", "s", "Q", "x", 2), ("b", "t", None, None, 0), ("o", "t", None, None, 0)]
    properties = spark.createDataFrame(data, "id string, name string, property string, value string, position int")
    pairs = spark.createDataFrame([("b", "o")], "base_id string, other_id string")
    assert rows(Q.structure_diff(pairs, properties), "name", "change", "property", "to_value") == [("s", "changed", "Q", "x")]
    assert rows(Q.structure_diff(pairs, properties.drop("position")), "property", "from_value", "to_value") == [("P", "1", "9"), ("Q", None, "x")]


def test_roles_and_layout(spark):
    stages = spark.createDataFrame(
        [("j", 0, "first", "OracleConnectorPX"), ("j", 1, "second", "OracleConnectorPX"), ("j", 2, "my_tgt", "SequentialFile"),
         ("j", 3, "x", "PxLookup"), ("j", 4, "y", "Transformer"), ("j", 5, "z", "Mystery"),
         ("k", 0, "tgt_1", "SequentialFile"), ("k", 1, "open", "SequentialFile")],
        "job_id string, position int, name string, type string",
    )
    roles = Q.infer_roles(stages, "job_id", ["position"])
    assert rows(roles, "job_id", "position", "role") == [
        ("j", 0, "source"), ("j", 1, "target"), ("j", 2, "target"), ("j", 3, "lookup"), ("j", 4, "transform"),
        ("k", 0, "target"), ("k", 1, "source"),
    ]
    ids = stages.select("job_id").distinct()
    assert rows(Q.layout_pattern(roles, "job_id", ids)) == [("j", "jdbc_to_s3", "table_to_table"), ("k", "s3_to_s3", "simple_copy")]


def test_entity_text_is_written_whole_in_parts(spark):
    stages = spark.createDataFrame(
        [("j", i, f"s{i}", "T", {"a": "b", "long": "x" * 200}) for i in range(5)],
        "job_id string, position int, name string, type string, properties map<string,string>",
    )
    links = spark.createDataFrame([("j", "s0", "s1")], "job_id string, from_stage string, to_stage string")
    want = "Job: j " + " ".join(f"Stage s{i} of type T a: b" for i in range(5)) + " Link from s0 to s1"
    assert rows(Q.entity_text(stages, links, "job_id", max_value=100), "text") == [(want,)]
    whole = Q.entity_text(stages, links, "job_id").first().text
    assert whole == want.replace("a: b", "a: b long: " + "x" * 200)
    parts = Q.entity_text(stages, links, "job_id", lines_per_part=2, max_value=100).orderBy("part").collect()
    assert len(parts) == 4 and " ".join(p.text for p in parts) == want


def test_topological_levels_drop_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("c", "z")]
    links = spark.createDataFrame(edges, "from_stage string, to_stage string")
    assert rows(topological_levels(links)) == [("a", 0), ("b", 1), ("c", 2)]
    keyed = links.withColumn("k", F.lit(1))
    assert rows(branch_counts(keyed, "k")) == [(1, 8, 2, 1)]


# Brute force, written from the formulas.
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def similarity(a, b):
    sa, sb = set(a), set(b)
    j = 1.0 if not sa | sb else len(sa & sb) / len(sa | sb)
    longest = max(len(a), len(b))
    length = 1.0 if longest == 0 else min(len(a), len(b)) / longest
    if not a or not b:
        order = 0.0
    else:
        order = 2 * lcs(a, b) / (len(a) + len(b))
    return 0.5 * j + 0.3 * length + 0.2 * order


def unique(seqs):
    first = {}
    for i, s in enumerate(seqs):
        if s:
            first.setdefault(tuple(sorted(s)), i)
    return sorted(first.values())


def brute_pairs(seqs, t):
    ids = unique(seqs)
    return {
        (i, j): similarity(seqs[i], seqs[j])
        for x, i in enumerate(ids) for j in ids[x + 1:]
        if similarity(seqs[i], seqs[j]) >= t
    }


def brute_clusters(seqs, t):
    pairs, ids = brute_pairs(seqs, t), unique(seqs)
    seeds, out = set(), []
    for (i, j), sim in sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0])):
        if i in seeds and j in seeds:
            continue
        members = {i, j}
        for o in ids:
            if o not in members and o not in seeds and min(similarity(seqs[o], seqs[i]), similarity(seqs[o], seqs[j])) >= t:
                members.add(o)
        seeds |= {i, j}
        out.append((sim, members))
    return out


def random_sequences(seed):
    rng = random.Random(seed)
    seqs = []
    for _ in range(60):
        seqs.append([rng.choice("abcdef") for _ in range(rng.randint(0, 7))])
    # Long sets (more than 13 distinct steps), and near copies of them.
    wide = [f"w{i}" for i in range(22)]
    for _ in range(25):
        s = rng.sample(wide, rng.randint(12, 20))
        seqs.append(s)
        near = list(s)
        near[rng.randrange(len(near))] = rng.choice(wide)
        seqs.append(near)
    # Products above 10 000 take the set form of the order term.
    for n in (101, 120):
        seqs.append([rng.choice("abc") for _ in range(n)])
        seqs.append(["a", "b"] * (n // 2))
    seqs += [list(seqs[3]), list(reversed(seqs[5])), []]
    return seqs


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """Stored tables follow the logarithm of the chain; a branch behind it, a shortcut and a cycle."""
    from stageloom.operators import graph

    stored, materialise = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label: stored.append(label) or materialise(df, label))
    n = 10_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("from_stage"), (F.col("id") + 1).cast("string").alias("to_stage"))
    more = [(str(n), "x"), (str(n), "y"), ("x", "z"), ("y", "z"), ("0", "z"), ("c", "d"), ("d", "c"), ("c", "e"), ("p", "q"), ("q", "p")]
    got = dict(rows(topological_levels(chain.unionByName(spark.createDataFrame(more, "from_stage string, to_stage string")))))
    assert len(got) == n + 4 and all(got[str(k)] == k for k in range(0, n + 1, 617))
    assert (got["x"], got["y"], got["z"]) == (n + 1, n + 1, n + 2)
    assert len(stored) < 40


def test_levels_of_random_graphs(spark):
    rng = random.Random(5)
    for _ in range(3):
        links = {(str(min(p)), str(max(p))) for p in (rng.sample(range(40), 2) for _ in range(45))}
        level = {}
        for v in sorted({x for link in links for x in link}, key=int):
            level[v] = max((level[a] + 1 for a, b in links if b == v), default=0)
        assert dict(rows(topological_levels(spark.createDataFrame(sorted(links), "from_stage string, to_stage string")))) == level


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_links_into_ends_take_no_part_in_the_rounds(spark, monkeypatch, bits):
    """Rounds see only links between nodes with links out; also when the bit map is full. Cycles and NULLs give their ends no level."""
    from stageloom.operators import graph

    stored, materialise = {}, graph.materialise

    def record(df, label):
        out = materialise(df, label)
        stored[label] = max(stored.get(label, 0), out.count())
        return out

    monkeypatch.setattr(graph, "materialise", record)
    monkeypatch.setattr(graph, "HEAD_BITS", bits)
    heads = [("r", "n0"), ("r", "n1"), ("n0", "c0"), ("n1", "c1"), ("r", "c1"), ("p", "q"), ("q", "p")]
    ends = [(u, f"o{k}") for k in range(300) for u in ("n0", "c0", "c1", f"s{k % 3}")]
    more = [("r", "o1"), ("r", "early"), ("n0", "early"), ("p", "lost"), ("r", "lost"), (None, "unknown"), ("r", "unknown"), ("r", None)]
    links = spark.createDataFrame(heads + ends + ends[:50] + more, "from_stage string, to_stage string")
    got = [tuple(r) for r in topological_levels(links).where("node IS NOT NULL").collect()]
    want = {"r": 0, "n0": 1, "n1": 1, "c0": 2, "c1": 2, "s0": 0, "s1": 0, "s2": 0, "early": 2} | {f"o{k}": 3 for k in range(300)}
    assert len(got) == len(want) and dict(got) == want
    assert stored["edges"] <= len(heads) + 1 and stored["touched"] <= 4


@pytest.mark.parametrize("seed,t", [(1, 0.85), (3, 0.7)])
def test_similar_pairs_and_clusters_match_brute_force(spark, seed, t):
    seqs = random_sequences(seed)
    steps = table(spark, seqs).withColumn("step_no", F.col("pos") + 1)
    patterns, members = S.sequence_patterns(steps, "id", "step")
    patterns = patterns.cache()
    pairs = S.similar_pairs(patterns, t).cache()
    want = brute_pairs(seqs, t)
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    clusters = {}
    for r in S.greedy_clusters(pairs, patterns).collect():
        clusters.setdefault(r.cluster_id, (r.similarity, set()))[1].add(r.member)
    expected = brute_clusters(seqs, t)
    assert [clusters[i] for i in range(len(clusters))] == expected
    every = S.expand_members(S.greedy_clusters(pairs, patterns), patterns, members, "id")
    assert every.count() >= sum(len(m) for _, m in expected)


@pytest.mark.parametrize("longest", [11, 20])
def test_similar_pairs_do_not_broadcast_what_small_files_unpack_to(spark, plan_of, longest):
    """Every size class of a set meets its candidates by shuffle: files of a few kB unpack to many times their size."""
    steps = table(spark, [[chr(97 + (i * k) % 25) for k in range(longest)] for i in range(1, 60)]).withColumnRenamed("pos", "step_no")
    patterns, _ = S.sequence_patterns(steps, "id", "step")
    forms = patterns.select("id", "n_steps", F.sort_array(F.transform("steps", lambda s: F.xxhash64(s))).alias("h"))
    for candidates in (S._subset_candidates, S._prefix_candidates):
        first_join = plan_of(candidates(forms, 0.85, 700)).split("Join")[0]
        assert first_join.endswith("SortMerge")


def test_similar_pairs_use_no_cartesian_product(spark, plan_of):
    steps = table(spark, random_sequences(4)).withColumn("step_no", F.col("pos") + 1)
    patterns, _ = S.sequence_patterns(steps, "id", "step")
    plan = plan_of(S.similar_pairs(patterns))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        S.similar_pairs(patterns, 0.5)


EDGES = [([], []), ([], ["a"]), (["a", "b"], ["a", "b"]), (["a", "b", "c"], ["c", "b", "a"]), (["a", "a", "b"], ["a", "b"]), (list("abca"), list("bcad"))]


def test_common_subsequences_over_several_words_and_without_python(spark, plan_of):
    rng = random.Random(9)
    pairs = [([rng.choice("abcd") for _ in range(rng.choice(sizes))], [rng.choice("abcde") for _ in range(rng.choice(sizes))])
             for sizes in ([0, 1, 5], [61, 62, 63], [124, 125, 200]) for _ in range(8)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = df.select("i", S.lcs_length(F.col("a"), F.col("b")).alias("n"))
    assert [n for _, n in sorted(tuple(r) for r in got.collect())] == [plain(a, b) for a, b in pairs]
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)


def test_sequence_edge_cases(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(EDGES)], "i int, a array<string>, b array<string>")
    m, n = F.size("a"), F.size("b")
    got = df.select(
        "i", S.jaccard(F.col("a"), F.col("b")), S.length_similarity(m, n),
        S.order_similarity(F.col("a"), F.col("b"), m, n),
        S.lcs_length(F.col("a"), F.col("b")),
    ).orderBy("i").collect()
    for (a, b), row in zip(EDGES, got):
        j, length, order = row[1], row[2], row[3]
        assert abs(0.5 * j + 0.3 * length + 0.2 * order - similarity(a, b)) < 1e-12
        assert row[4] == (lcs(a, b) if a and b else 0)


def test_hash_embedding_bytes(spark):
    def expected(text, dims):
        e = []
        for i in range(dims):
            h = hashlib.sha256(f"{' '.join(text.lower().split())}:{i}".encode()).digest()
            e.append(struct.unpack("<I", h[:4])[0] / 2**32 * 2 - 1)
        n = sum(v * v for v in e) ** 0.5
        return [v / n for v in e]

    text = "Some  Text\nhere"
    got = spark.createDataFrame([(text,)], "t string").select(V.hash_embedding(F.col("t"), 16)).first()[0]
    assert np.allclose(got, expected(text, 16), atol=1e-12)


@pytest.mark.parametrize("block", [4, 512])
def test_best_match_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    data = []
    for i in range(150):
        v = (centres[i % 6] + rng.normal(scale=0.15, size=8)) * rng.uniform(0.5, 2)
        data.append((i, [float(x) for x in v], "p" if i % 3 else "q"))
    data += [(900, [0.0] * 8, "p"), (901, [1.0, 2.0], "p"), (902, [2.0, 4.0], "p"), (903, data[7][1], data[7][2])]
    df = spark.createDataFrame(data, "id long, v array<double>, part string")
    got = {r["query"]: (r["match"], r["cosine"]) for r in V.cosine_best_match(df, df, "id", "v", "part", 0.95, exclude_self=True).collect()}
    want = {}
    for i, v, p in data:
        best = None
        for j, w, q in data:
            if i == j or p != q or len(v) != len(w) or not np.any(v) or not np.any(w):
                continue
            c = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12)
            if c >= 0.95 and (best is None or (-c, j) < (-best[1], best[0])):
                best = (j, c)
        if best:
            want[i] = best
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 and got[k][0] == want[k][0] for k in want)


def test_blocks_are_full_on_a_large_table(spark):
    """200 000 vectors in four partition values: blocks hold more than 100 on average."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    pivots = centres[:16] / np.linalg.norm(centres[:16], axis=1, keepdims=True)
    made = spark.range(200_000, numPartitions=8).mapInPandas(
        lambda frames: (
            pd.DataFrame({"id": f.id, "part": f.id % 4, "v": list((c := centres[f.id % 20] + np.sin(np.outer(f.id, np.arange(1, 9)))) / np.linalg.norm(c, axis=1, keepdims=True)), "dim": 8})
            for f in frames
        ),
        "id long, part long, v array<double>, dim int",
    )
    sizes = spark.createDataFrame([(i, 8, 16) for i in range(4)], "_part long, _dim int, pivots int")
    blocks = V.vector_blocks(V.place_vectors(made, sizes, pivots), "b")
    n, total = blocks.agg(F.count("*"), F.sum(F.size("b_ids"))).first()
    assert total == 200_000 and total / n > 100


def test_kmeans_sizes_add_up(spark):
    rows_ = [(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows_, "id long, v array<double>")
    clusters, silhouette = V.kmeans_clusters(df, "id", "v", 2)
    assert sorted(r["count"] for r in clusters.groupBy("cluster").count().collect()) == [10, 10]
    assert silhouette > 0.9
    few, _ = V.kmeans_clusters(df.limit(2), "id", "v", 15)
    assert few.count() == 2


def test_batches_fall_back_to_family(spark):
    data = [(i, "c1", "f") for i in range(41)] + [(50, "-", "f"), (51, None, "other")]
    df = spark.createDataFrame(data, "id int, cluster string, family string")
    out = B.build_batches(df, "id", "cluster", "family", ["id"])
    assert rows(out.groupBy("batch_id", "batch_size", "savings").count()) == [
        ("batch_c1_0", 20, 0.81, 20), ("batch_c1_1", 20, 0.81, 20), ("pattern_f_0", 2, 0.43, 2)
    ]


def test_representatives_get_their_share(spark):
    df = spark.createDataFrame([("a", i) for i in range(90)] + [("b", i) for i in range(100, 110)] + [("c", 200)], "c string, id int")
    out = B.select_representatives(df, "c", "id", 20)
    assert rows(out.groupBy("c").count()) == [("a", 17), ("b", 1), ("c", 1)]


def test_membership_takes_the_last_cluster(spark):
    ids = spark.range(3).withColumnRenamed("id", "k")
    dup = spark.createDataFrame([(0, 1)], "k long, group_id long")
    sim = spark.createDataFrame([(0, 5, 1), (0, 3, 2)], "k long, cluster_id long, cluster_rank long")
    fam = spark.createDataFrame([(1, "f")], "k long, family string")
    assert rows(B.cluster_membership(ids, "k", dup, sim, fam)) == [(0, "DUP_1", "SIM_3", None), (1, None, None, "f"), (2, None, None, None)]


def test_summary_gathers_an_entity_in_one_pass(spark, plan_of):
    """All lists come from one grouping of the steps; limits keep the first values, entities without steps have empty lists."""
    data = [(1, "Transformer", "customer order"), (1, "ODBCConnector", "order"), (1, None, None), (1, "Transformer", "account")]
    steps = spark.createDataFrame(data, "id int, type string, text string")
    scores = spark.createDataFrame([(1, 5), (2, 6)], "id int, score int")
    out = Q.entity_summary(steps, "id", F.col("text"), scores, {"types": 2})
    assert plan_of(out).count("Scan ExistingRDD") == 2
    found = {r["id"]: r for r in out.collect()}
    assert found[1]["types"] == "ODBCConnector,Transformer"
    words = found[1]["subjects"].split(",")
    assert words == sorted(words) and {"account", "customer", "order"} & set(words)
    assert tuple(found[2])[1:] == (6, "", "", "", "", "")


def test_pairs_read_stored_lists(spark, plan_of):
    """Steps are numbered and grouped once, not once for each side of a pair."""
    plan = plan_of(sequences.paired(spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and "lineitem" not in plan


def test_patterns_shuffle_steps_once_and_leave_no_shuffled_files(spark, monkeypatch, plan_of):
    """Steps are shuffled by entity, then sequences by fingerprint; what was shuffled goes when its table is stored."""
    stored, materialise = {}, S.materialise
    monkeypatch.setattr(S, "materialise", lambda df, label: stored.update({label: plan_of(df)}) or materialise(df, label))
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()
    steps = materialise(table(spark, random_sequences(2)).withColumnRenamed("pos", "step_no"), "steps")
    before = files()
    patterns, members = S.sequence_patterns(steps, "id", "step")
    assert set(stored) == {"profiles", "patterns"} and all(plan.count("Exchange") == 1 for plan in stored.values())
    deadline = time.time() + 20
    while files() > before and time.time() < deadline:
        time.sleep(0.2)
    assert files() <= before
    bags = {r.id: (r.fingerprint, r.n_steps, [s.step for s in r.bag], [s.n for s in r.bag]) for r in Q.bag_profiles(steps, "id", "step").collect()}
    assert dict(rows(members)) == {k: b[0] for k, b in bags.items()}
    assert all((r.fingerprint, r.n_steps, r.steps, r.counts) == bags[r.id] and len(r.seq) == r.n_steps for r in patterns.collect())


def test_steps_are_those_of_the_stages(spark):
    """Fewer columns are shuffled, in the same order of lines."""
    from stageloom.plans import fleet

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("test tables are not here")
    assert sorted(rows(fleet.steps(spark, d))) == sorted(rows(fleet.stages(spark, d).select("job_id", "position", "type")))


@pytest.mark.parametrize("carried, t, seed", [(0, 0.85, 5), (4, 0.85, 5), (5, 0.65, 6), (32, 0.65, 6)])
def test_pairs_scored_where_they_meet_are_those_of_the_steps(spark, monkeypatch, carried, t, seed):
    """Sequences may be short, long or of both kinds; short ones leave no candidates to be shuffled."""
    monkeypatch.setattr(S, "CARRIED_STEPS", carried)
    seqs = random_sequences(seed) + [list(p) for p in ("aabbab", "aabbba", "abcdeaf", "abcdefa", "abcdefb", "abcdef")]
    stored, materialise = {}, S.materialise

    def record(df, label):
        out = materialise(df, label)
        stored[label] = out
        return out

    patterns, _ = S.sequence_patterns(table(spark, seqs).withColumn("step_no", F.col("pos") + 1), "id", "step")
    monkeypatch.setattr(S, "materialise", record)
    want = brute_pairs(seqs, t)
    got = S.similar_pairs(patterns, t).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want.keys()
    assert all(r.similarity == pytest.approx(want[r.a, r.b], abs=1e-12) for r in got)
    if carried == 32:
        few, kept = patterns.where("size(steps) < 7 AND n_steps < 20"), [len(set(s)) < 7 and len(s) < 20 for s in seqs]
        assert S.similar_pairs(few, t).count() == sum(kept[x] and kept[y] for x, y in want) > 5
        assert stored["candidates"].count() == 0


def test_steps_of_one_hash_are_told_apart(spark, monkeypatch):
    """Pairs are scored by the steps themselves if hashes do not tell all of them apart."""
    seqs = [list("abcdef"), list("abcdfe"), list("aabcde"), list("abxdef"), list("abydef"), list("abcdeff")]
    patterns, _ = S.sequence_patterns(table(spark, seqs).withColumn("step_no", F.col("pos") + 1), "id", "step")
    want, xxhash64 = brute_pairs(seqs, 0.65), F.xxhash64
    one = lambda c: F.when(c == "y", F.lit("x")).otherwise(c)
    monkeypatch.setattr(S, "_code", lambda c: xxhash64(one(c)))
    got = {(r.a, r.b): r.similarity for r in S.similar_pairs(patterns, 0.65).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got) and (0, 1) in got and got[3, 4] < 0.95
