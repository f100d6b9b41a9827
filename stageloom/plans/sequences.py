"""Sequences, fingerprints, clusters, diffs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from stageloom.functions.text import SUBJECT_WORDS
from stageloom.operators import batches as B
from stageloom.operators import sequences as Q
from stageloom.operators import similarity as S
from stageloom.operators import vectors as V
from stageloom.operators.graph import topological_levels as levels
from stageloom.operators.joins import group_links
from stageloom.operators.rule_tables import CLASS_TEMPLATES, ENDPOINTS, IGNORED_STEPS, SOURCES, TARGETS, TRANSFORMS
from stageloom.operators.rules import branch_counts as count_branches
from stageloom.plans import fleet as G
from stageloom.plans.registry import query
from stageloom.plans.rules import predictions
from stageloom.scratch import materialise, new_path
from stageloom.sources.jobs import content_hash as read_content_hash
from stageloom.tables import load

IGNORED = G.sql_list(IGNORED_STEPS)
SEQ_SQL = f"""WITH {G.STAGES_SQL}, seqs AS MATERIALIZED (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY position) AS step_no, type AS step
  FROM stages WHERE type NOT IN {IGNORED} AND type <> ''), jobs AS (SELECT DISTINCT job_id FROM stages),
fps AS MATERIALIZED (SELECT job_id, left(md5(string_agg(step, '|' ORDER BY step)), 16) AS fingerprint FROM seqs GROUP BY 1)
"""


def sequences(spark, d):
    s = G.steps(spark, d).withColumnRenamed("type", "step")
    return Q.step_sequences(s, "job_id", ["position"], "step")


def fingerprints(spark, d):
    return Q.bag_profiles(sequences(spark, d), "job_id", "step").select("job_id", "fingerprint")


@query("step_sequences", SEQ_SQL + "SELECT job_id, step_no, step FROM seqs")
def step_sequences(spark, d):
    return sequences(spark, d)


@query("bag_fingerprint", SEQ_SQL + "SELECT job_id, fingerprint FROM fps")
def bag_fingerprint(spark, d):
    return fingerprints(spark, d)


@query(
    "structural_fingerprint",
    f"""WITH {G.STAGES_SQL}, {G.LINKS_SQL}, lines AS (
          SELECT job_id, 1 AS k, name AS a, '' AS b, type || ':' || name || '|TableName:' || p_type AS t FROM stages
          UNION ALL SELECT job_id, 2, from_stage, to_stage, 'link:' || from_stage || '->' || to_stage FROM links)
        SELECT job_id, sha256(string_agg(digest, '|' ORDER BY part)) AS fingerprint FROM (SELECT job_id, part, sha256(string_agg(t, '|' ORDER BY rn)) AS digest
          FROM (SELECT job_id, t, rn, (rn - 1) // 1000 AS part FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k, a, b, t) AS rn FROM lines))
          GROUP BY 1, 2) GROUP BY 1""",
)
def structural_fingerprint(spark, d):
    s = G.stages(spark, d)
    return Q.structural_fingerprint(s, G.links(spark, d, s), "job_id")


@query("content_hash", "SELECT lang, source, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_hash FROM documents GROUP BY 1, 2")
def content_hash(spark, d):
    """One file for each language and source, written here; their bytes are hashed as they are stored."""
    path = new_path(spark, "files")
    docs = load(spark, d, "documents").select("lang", "source", "doc_id", "text")
    ordered = docs.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id")
    ordered.select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    folder = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return read_content_hash(spark, path, "part-*").select(folder("lang"), folder("source"), "content_hash")


DUP_SQL = """g AS (SELECT md5(text) AS fp, min(doc_id) AS representative, count(*) AS n_members FROM documents GROUP BY 1 HAVING count(*) > 1),
  numbered AS (SELECT *, row_number() OVER (ORDER BY n_members DESC, representative) AS group_id FROM g),
  dups AS (SELECT fp, doc_id, representative, n_members, group_id FROM (SELECT doc_id, md5(text) AS fp FROM documents) JOIN numbered USING (fp))"""


@query("exact_duplicates", f"WITH {DUP_SQL} SELECT * FROM dups")
def exact_duplicates(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("fp"))
    return Q.exact_duplicates(docs, "fp", "doc_id")


@query(
    "structural_clusters",
    SEQ_SQL + """SELECT n_members, count(*) AS n_clusters, min(first) AS first_member FROM
      (SELECT fingerprint, count(*) AS n_members, min(job_id) AS first FROM fps GROUP BY 1) GROUP BY 1""",
)
def structural_clusters(spark, d):
    groups = fingerprints(spark, d).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("job_id").alias("first")
    )
    return groups.groupBy("n_members").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min("first").alias("first_member")
    )


PAIR_SQL = SEQ_SQL + """, pairs AS (SELECT DISTINCT o_custkey, left_id, o_orderkey AS right_id FROM orders JOIN
     (SELECT o_custkey AS c, min(o_orderkey) AS left_id FROM orders JOIN jobs ON job_id = o_orderkey GROUP BY 1) ON c = o_custkey
     WHERE left_id < o_orderkey AND o_orderkey IN (SELECT job_id FROM jobs)),
  lists AS (SELECT j.job_id, coalesce(list(step ORDER BY step_no) FILTER (step IS NOT NULL), []::VARCHAR[]) AS seq,
     coalesce(list(DISTINCT step) FILTER (step IS NOT NULL), []::VARCHAR[]) AS steps
     FROM jobs j LEFT JOIN seqs s ON s.job_id = j.job_id GROUP BY 1),
  lists2 AS (SELECT left_id, right_id, a.seq AS sa, b.seq AS sb, a.steps AS da, b.steps AS db FROM pairs
     JOIN lists a ON a.job_id = left_id JOIN lists b ON b.job_id = right_id)
"""
JACCARD_SQL = """(CASE WHEN len(da) = 0 AND len(db) = 0 THEN 1.0::DOUBLE
  ELSE len(list_intersect(da, db))::DOUBLE / (len(da) + len(db) - len(list_intersect(da, db))) END)"""
LENGTH_SQL = """(CASE WHEN greatest(len(sa), len(sb)) = 0 THEN 1.0::DOUBLE ELSE least(len(sa), len(sb))::DOUBLE / greatest(len(sa), len(sb)) END)"""
LCS_SQL = """list_reduce(list_transform(range(1, len(sa) + 1), lambda i: [i]),
  lambda prev, xi: list_reduce(list_transform(range(1, len(sb) + 1), lambda j: [j]),
    lambda cur, jj: list_append(cur, CASE WHEN sb[jj[1]] = sa[xi[1]] THEN prev[jj[1]] + 1 ELSE greatest(prev[jj[1] + 1], cur[-1]) END), [0::BIGINT]),
  list_transform(range(0, len(sb) + 1), lambda z: 0::BIGINT))[-1]"""
ORDER_SQL = f"""(CASE WHEN len(sa) = 0 OR len(sb) = 0 THEN 0.0::DOUBLE
  ELSE 2.0::DOUBLE * {LCS_SQL} / (len(sa) + len(sb)) END)"""


def paired(spark, d):
    """First sequence of each customer against each later one."""
    s = sequences(spark, d)
    ids = G.jobs(spark, d)
    orders = load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("job_id"))
    profiles = Q.bag_profiles(s, "job_id", "step")
    seqs = Q.ordered_steps(s, "job_id", "step_no", "step")
    none = F.array().cast("array<string>")
    lists = ids.join(profiles, "job_id", "left").join(seqs, "job_id", "left").select(
        "job_id",
        F.coalesce("n_steps", F.lit(0)).alias("n"),
        F.coalesce(F.col("bag.step"), none).alias("steps"),
        F.when(F.col("n_steps").isNull(), none).otherwise(F.col("seq")).alias("seq"),
    )
    # Both sides of a pair and the check of its ids read them.
    lists = materialise(lists, "lists")
    pairs = group_links(orders.join(lists.select("job_id"), "job_id", "left_semi"), ["o_custkey"], "job_id")
    side = lambda key, p: lists.select(
        F.col("job_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "steps", "seq")]
    )
    return pairs.join(side("left_id", "a"), "left_id").join(side("right_id", "b"), "right_id")


@query("jaccard_pairs", PAIR_SQL + f"SELECT left_id, right_id, round({JACCARD_SQL}, 9) AS jaccard FROM lists2")
def jaccard_pairs(spark, d):
    return paired(spark, d).select(
        "left_id", "right_id", F.round(S.jaccard(F.col("a_steps"), F.col("b_steps")), 9).alias("jaccard")
    )


@query("length_similarity", PAIR_SQL + f"SELECT left_id, right_id, round({LENGTH_SQL}, 9) AS length_similarity FROM lists2")
def length_similarity(spark, d):
    return paired(spark, d).select(
        "left_id", "right_id", F.round(S.length_similarity(F.col("a_n"), F.col("b_n")), 9).alias("length_similarity")
    )


def _order():
    return S.order_similarity(*[F.col(c) for c in ("a_seq", "b_seq", "a_n", "b_n")])


@query("order_similarity", PAIR_SQL + f"SELECT left_id, right_id, round({ORDER_SQL}, 9) AS order_similarity FROM lists2")
def order_similarity(spark, d):
    return paired(spark, d).select("left_id", "right_id", F.round(_order(), 9).alias("order_similarity"))


@query(
    "sequence_similarity",
    PAIR_SQL + f"SELECT left_id, right_id, round(0.5::DOUBLE * {JACCARD_SQL} + 0.3::DOUBLE * {LENGTH_SQL} + 0.2::DOUBLE * {ORDER_SQL}, 9) AS similarity FROM lists2",
)
def sequence_similarity(spark, d):
    sim = S.weighted(
        S.jaccard(F.col("a_steps"), F.col("b_steps")), S.length_similarity(F.col("a_n"), F.col("b_n")), _order()
    )
    return paired(spark, d).select("left_id", "right_id", F.round(sim, 9).alias("similarity"))


SIMILAR_SQL = SEQ_SQL + f""", codes AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS code FROM (SELECT DISTINCT step FROM seqs)),
  pats AS MATERIALIZED (SELECT min(job_id) AS id, count(*) AS n_members FROM fps GROUP BY fingerprint),
  lists AS MATERIALIZED (SELECT id, n_members, list(seqs.step ORDER BY step_no) AS seq, list(DISTINCT seqs.step) AS steps,
      bit_or(1::BIGINT << code::INTEGER) AS mask, count(*) AS n FROM pats JOIN seqs ON job_id = id JOIN codes USING (step) GROUP BY 1, 2),
  near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.seq AS sa, b.seq AS sb, a.steps AS da, b.steps AS db FROM lists a JOIN lists b ON a.id < b.id
      AND bit_count(a.mask & b.mask) * 10 >= bit_count(a.mask | b.mask) * 7 AND least(a.n, b.n) * 2 >= greatest(a.n, b.n)),
  sims AS MATERIALIZED (SELECT a, b, 0.5::DOUBLE * {JACCARD_SQL} + 0.3::DOUBLE * {LENGTH_SQL} + 0.2::DOUBLE * {ORDER_SQL} AS similarity FROM near),
  pairs AS MATERIALIZED (SELECT * FROM sims WHERE similarity >= 0.85::DOUBLE)
"""


def similar(spark, d):
    patterns, members = S.sequence_patterns(sequences(spark, d), "job_id", "step")
    return S.similar_pairs(patterns), patterns, members


@query("similar_pairs", SIMILAR_SQL + "SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def similar_pairs(spark, d):
    pairs, _, _ = similar(spark, d)
    return pairs.select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(
    "similarity_clusters",
    SIMILAR_SQL + """, edges AS (SELECT a AS u, b AS v, -similarity AS s, a, b FROM pairs UNION ALL SELECT b, a, -similarity, a, b FROM pairs),
      best AS (SELECT u, min((s, a, b)) AS best FROM edges GROUP BY 1),
      seeds AS (SELECT *, row_number() OVER (ORDER BY r) - 1 AS cluster_id FROM (SELECT DISTINCT best AS r FROM best)),
      sd AS (SELECT cluster_id, r, r[2] AS a, r[3] AS b, -r[1] AS similarity FROM seeds),
      members AS (SELECT cluster_id, a AS member, similarity FROM sd UNION ALL SELECT cluster_id, b, similarity FROM sd
        UNION ALL SELECT cluster_id, c.u, similarity FROM sd JOIN edges x ON x.u = sd.a JOIN edges y ON y.u = sd.b AND y.v = x.v
          JOIN best c ON c.u = x.v WHERE c.best > sd.r),
      sizes AS (SELECT cluster_id, CAST(sum(n_members) AS BIGINT) AS cluster_size FROM members JOIN pats ON id = member GROUP BY 1)
      SELECT cluster_id, member, round(similarity, 9) AS similarity, cluster_size,
             dense_rank() OVER (ORDER BY cluster_size DESC, cluster_id) AS cluster_rank FROM members JOIN sizes USING (cluster_id)""",
)
def similarity_clusters(spark, d):
    pairs, patterns, _ = similar(spark, d)
    return S.greedy_clusters(materialise(pairs, "pairs"), patterns).withColumn("similarity", F.round("similarity", 9))


_KIND_SQL = """CASE WHEN contains(step, 'Transformer') OR contains(step, 'Trx') THEN 'Transform' WHEN contains(step, 'Seq') OR contains(step, 'File') THEN 'File'
  WHEN contains(step, 'Hash') THEN 'Lookup' WHEN contains(step, 'Oracle') OR contains(step, 'DB2') OR contains(step, 'SQL') OR contains(step, 'ODBC') THEN 'Database'
  WHEN contains(step, 'Custom') THEN 'Custom' ELSE step END"""


@query(
    "pattern_signature",
    SEQ_SQL + f""", kinds AS (SELECT job_id, step_no, {_KIND_SQL} AS kind FROM seqs),
      runs AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY step_no) AS run FROM
        (SELECT *, lag(kind) OVER (PARTITION BY job_id ORDER BY step_no) AS prev FROM kinds) WHERE prev IS NULL OR prev <> kind)
      SELECT job_id, coalesce(signature, 'Empty') AS signature FROM jobs LEFT JOIN
        (SELECT job_id, string_agg(kind, ' → ' ORDER BY run) AS signature FROM runs GROUP BY 1) USING (job_id)""",
)
def pattern_signature(spark, d):
    return Q.pattern_signature(sequences(spark, d), "job_id", "step", G.jobs(spark, d))


CLASS_SQL = SEQ_SQL + """, flags AS (SELECT job_id, count(*) AS n_steps, bool_or(contains(step, 'Transformer') OR contains(step, 'Trx')) AS tr,
     bool_or(contains(step, 'Seq') OR contains(step, 'File')) AS fi,
     bool_or(contains(step, 'Oracle') OR contains(step, 'DB2') OR contains(step, 'SQL') OR contains(step, 'ODBC') OR contains(step, 'JDBC')) AS db,
     bool_or(contains(step, 'Hash') OR contains(step, 'Lookup')) AS lk, bool_or(contains(step, 'Custom')) AS cu,
     bool_or(contains(step, 'Join')) AS jo, bool_or(contains(step, 'Aggregat')) AS ag FROM seqs GROUP BY 1),
  classed AS (SELECT job_id, coalesce(n_steps, 0) AS n_steps, CASE WHEN n_steps IS NULL THEN 'Empty Job' WHEN cu THEN 'Custom Processing'
     WHEN db AND fi AND tr THEN 'DB to File ETL' WHEN db AND tr THEN 'Database ETL' WHEN fi AND tr THEN 'File Processing'
     WHEN lk AND tr THEN 'Lookup Enrichment' WHEN jo THEN 'Join Pipeline' WHEN ag THEN 'Aggregation Pipeline' WHEN tr THEN 'Transformation Only'
     WHEN fi THEN 'File Copy' WHEN db THEN 'Database Copy' ELSE 'Other' END AS family FROM jobs LEFT JOIN flags USING (job_id))
"""


def classed(spark, d):
    return Q.classify_sequence(sequences(spark, d), "job_id", "step", G.jobs(spark, d))


@query("classify_sequence", CLASS_SQL + "SELECT job_id, n_steps, family FROM classed")
def classify_sequence(spark, d):
    return classed(spark, d)


_TEMPLATE_SQL = "CASE family " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in CLASS_TEMPLATES.items()) + " ELSE 'custom_etl' END"


@query(
    "pattern_families",
    CLASS_SQL + f"""SELECT family, count(*) AS n_members, {_TEMPLATE_SQL} AS template,
      CASE WHEN count(*) <= 1 THEN 0.0::DOUBLE ELSE round((count(*) - (1 + (count(*) - 1) * 0.15::DOUBLE)) / count(*) * 100, 4) END AS effort_reduction
      FROM classed GROUP BY 1""",
)
def pattern_families(spark, d):
    return Q.pattern_families(classed(spark, d))


@query(
    "commonality_summary",
    SEQ_SQL + """SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_duplicate_groups,
      CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_duplicates,
      round(least((sum(n) * 8 - (count(*) * 8 + (sum(n) - count(*)))) / (sum(n) * 8) * 100, 95.0), 4)::DOUBLE AS effort_reduction
      FROM (SELECT fingerprint, count(*)::DOUBLE AS n FROM fps GROUP BY 1)""",
)
def commonality_summary(spark, d):
    return Q.commonality_summary(fingerprints(spark, d), "fingerprint")


@query(
    "kmeans_sizes",
    "SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, least(15, count(*)) AS n_clusters, true AS silhouette_holds FROM embeddings",
)
def kmeans_sizes(spark, d):
    """Every vector has one cluster, all clusters are used, and the silhouette is a proper one."""
    clusters, silhouette = V.kmeans_clusters(load(spark, d, "embeddings"), "vec_id", "embedding", 15)
    return clusters.agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("vec_id").alias("n_ids"),
        F.count_distinct("cluster").alias("n_clusters"),
    ).withColumn("silhouette_holds", F.lit(-1 <= silhouette <= 1))


@query(
    "cluster_representatives",
    """WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), q AS (SELECT label, greatest(1, CAST(floor(n / (SELECT count(*) FROM embeddings) * 100) AS BIGINT)) AS quota FROM s)
       SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) JOIN q USING (label)
       WHERE rn <= quota""",
)
def cluster_representatives(spark, d):
    return B.select_representatives(load(spark, d, "embeddings"), "label", "vec_id", 100)


@query(
    "entity_text",
    f"""WITH {G.STAGES_SQL}, {G.LINKS_SQL}, lines AS (SELECT DISTINCT job_id, 0 AS s, 0 AS p, '' AS a, 'Job: ' || job_id AS line FROM stages
        UNION ALL SELECT job_id, 1, position, '', 'Stage ' || name || ' of type ' || type || ' Mode: ' || l_returnflag || ' TableName: ' || p_type FROM stages
        UNION ALL SELECT job_id, 2, 0, from_stage || '|' || to_stage, 'Link from ' || from_stage || ' to ' || to_stage FROM links)
        SELECT job_id, 0::BIGINT AS part, string_agg(line, ' ' ORDER BY s, p, a, line) AS text FROM lines GROUP BY 1""",
)
def entity_text(spark, d):
    s = G.stages(spark, d)
    return Q.entity_text(s, G.links(spark, d, s), "job_id")


_QUANT = "list_transform(embedding, lambda x: round(x::DOUBLE, 1))"


@query(
    "cosine_top1",
    f"""SELECT vec_id, match, round(c, 6) AS cosine FROM (SELECT q.vec_id, b.vec_id AS match, list_cosine_similarity(q.v, b.v) AS c,
          row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, b.v) DESC, b.vec_id) AS rn
        FROM (SELECT vec_id, label, {_QUANT} AS v FROM embeddings) q JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b
        ON q.label = b.label) WHERE rn = 1 AND c >= 0.95""",
)
def cosine_top1(spark, d):
    """Each vector, rounded to one decimal, looks up its best match among the exact ones."""
    base = load(spark, d, "embeddings")
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    found = V.cosine_best_match(base.withColumn("embedding", rounded), base, "vec_id", "embedding", "label", 0.95)
    return found.select(F.col("query").alias("vec_id"), "match", F.round("cosine", 6).alias("cosine"))


@query(
    "hash_embedding",
    """WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM benchmark
         UNION ALL SELECT 1000000 + conv_id * 1000 + turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) FROM conversations),
       h AS (SELECT item_id, list_transform(range(0, 256), lambda i: sha256(t || ':' || i)) AS hs FROM n),
       v AS (SELECT item_id, list_transform(hs, lambda x: ('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2])::BIGINT / 4294967296.0::DOUBLE * 2 - 1) AS e FROM h)
       SELECT item_id, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first,
              round(e[256] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS last, CAST(len(e) AS INTEGER) AS dims FROM v""",
)
def hash_embedding(spark, d):
    texts = load(spark, d, "benchmark").select("item_id", "text").unionByName(
        load(spark, d, "conversations").select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    )
    e = texts.select("item_id", V.hash_embedding(F.col("text"), 256).alias("e"))
    return e.select("item_id", F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", -1), 6).alias("last"), F.size("e").alias("dims"))


DIFF_SQL = f"""WITH {G.STAGES_SQL}, pairs AS (SELECT DISTINCT left_id AS base_id, o_orderkey AS other_id FROM orders JOIN
     (SELECT o_custkey AS c, min(o_orderkey) AS left_id FROM orders GROUP BY 1) ON c = o_custkey WHERE left_id < o_orderkey),
  props AS (SELECT job_id AS id, type AS name, max(p_type) AS tn, max(l_returnflag) AS md FROM stages GROUP BY 1, 2),
  bs AS (SELECT base_id, other_id, name, tn, md FROM pairs JOIN props ON id = base_id),
  os AS (SELECT base_id, other_id, name, tn, md FROM pairs JOIN props ON id = other_id),
  j AS (SELECT coalesce(bs.base_id, os.base_id) AS base_id, coalesce(bs.other_id, os.other_id) AS other_id, coalesce(bs.name, os.name) AS name,
        bs.name IS NOT NULL AS in_b, os.name IS NOT NULL AS in_o, bs.tn AS bt, os.tn AS ot, bs.md AS bm, os.md AS om
        FROM bs FULL JOIN os ON bs.base_id = os.base_id AND bs.other_id = os.other_id AND bs.name = os.name),
  diff AS (SELECT base_id, other_id, name, CASE WHEN in_b THEN 'removed' ELSE 'added' END AS change, NULL::VARCHAR AS property, NULL::VARCHAR AS from_value, NULL::VARCHAR AS to_value
        FROM j WHERE NOT (in_b AND in_o)
      UNION ALL SELECT base_id, other_id, name, 'changed', 'TableName', bt, ot FROM j WHERE in_b AND in_o AND bt <> ot
      UNION ALL SELECT base_id, other_id, name, 'changed', 'Mode', bm, om FROM j WHERE in_b AND in_o AND bm <> om)
"""


def diff_input(spark, d):
    orders = load(spark, d, "orders")
    pairs = group_links(orders, ["o_custkey"], "o_orderkey").select(
        F.col("left_id").alias("base_id"), F.col("right_id").alias("other_id")
    )
    per_type = G.stages(spark, d).groupBy("job_id", "type").agg(
        F.max(F.col("properties")["TableName"]).alias("TableName"), F.max(F.col("properties")["Mode"]).alias("Mode")
    )
    # Unlike unpivot, inline keeps the grouping by job and type, so that the diff need not shuffle the properties anew.
    entries = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in ("TableName", "Mode")])
    props = per_type.select(F.col("job_id").alias("id"), F.col("type").alias("name"), F.inline(entries))
    return pairs, Q.structure_diff(pairs, props)


@query("structure_diff", DIFF_SQL + "SELECT * FROM diff")
def structure_diff(spark, d):
    return diff_input(spark, d)[1]


@query(
    "parameter_only",
    DIFF_SQL + """SELECT base_id, other_id, coalesce(p, TRUE) AS parameter_only FROM pairs LEFT JOIN
       (SELECT base_id, other_id, bool_and(change = 'changed' AND property = 'TableName') AS p FROM diff GROUP BY 1, 2) USING (base_id, other_id)""",
)
def parameter_only(spark, d):
    return Q.parameter_only(*diff_input(spark, d))


@query(
    "build_batches",
    """WITH e AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY md5(text)) > 1 THEN left(md5(text), 8) ELSE '-' END AS cl,
           CASE WHEN lang = 'es' THEN 'other' ELSE lang || ':' || source END AS fam FROM documents),
       c1 AS (SELECT doc_id, cl, (row_number() OVER (PARTITION BY cl ORDER BY doc_id) - 1) // 20 AS k, count(*) OVER (PARTITION BY cl) AS n FROM e WHERE cl <> '-'),
       b1 AS (SELECT doc_id, 'batch_' || cl || '_' || k AS batch_id, least(20, n - k * 20) AS batch_size FROM c1 WHERE n - k * 20 >= 2),
       c2 AS (SELECT doc_id, fam, (row_number() OVER (PARTITION BY fam ORDER BY doc_id) - 1) // 20 AS k, count(*) OVER (PARTITION BY fam) AS n FROM e
              WHERE fam <> 'other' AND doc_id NOT IN (SELECT doc_id FROM b1)),
       b2 AS (SELECT doc_id, 'pattern_' || fam || '_' || k, least(20, n - k * 20) FROM c2 WHERE n - k * 20 >= 2)
       SELECT doc_id, batch_id, batch_size, round(1 - (3500 + (batch_size - 1) * 500) / (batch_size * 3500), 2) AS savings
       FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)""",
)
def build_batches(spark, d):
    docs = load(spark, d, "documents").withColumn("fp", F.md5("text"))
    sizes = docs.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.join(sizes, "fp").select(
        "doc_id",
        F.when(F.col("n") > 1, F.left("fp", F.lit(8))).otherwise("-").alias("cl"),
        F.when(F.col("lang") == "es", "other").otherwise(F.concat_ws(":", "lang", "source")).alias("fam"),
    )
    return B.build_batches(rows, "doc_id", "cl", "fam", ["doc_id"])


@query(
    "select_template",
    G.PREDICTIONS_SQL + """SELECT migration_category, job_id AS template, ts AS template_score FROM (SELECT *, row_number() OVER
       (PARTITION BY migration_category ORDER BY ts DESC, job_id) AS rn FROM (SELECT migration_category, job_id,
        round(10.0::DOUBLE + n_stages * 0.1::DOUBLE + n_links * 0.05::DOUBLE + success_probability * 5.0::DOUBLE
         + (CASE WHEN score BETWEEN 3 AND 7 THEN 2.0 ELSE 0.0 END)::DOUBLE, 6) AS ts FROM predictions)) WHERE rn = 1""",
)
def select_template(spark, d):
    return B.select_template(predictions(spark, d), ["migration_category"], "job_id")


@query(
    "batch_savings",
    "SELECT source, count(*) AS n, round(1 - (3500 + (count(*) - 1) * 500) / (count(*) * 3500), 2) AS savings FROM documents GROUP BY 1",
)
def batch_savings(spark, d):
    sizes = load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("savings", B.batch_savings(F.col("n")))


@query(
    "cluster_membership",
    f"""WITH {DUP_SQL} SELECT doc_id, CASE WHEN group_id IS NOT NULL THEN 'DUP_' || group_id END AS duplicate_group,
          CASE WHEN label IS NOT NULL THEN 'SIM_' || label END AS similarity_cluster, lang AS family
        FROM documents LEFT JOIN (SELECT doc_id, group_id FROM dups) USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id""",
)
def cluster_membership(spark, d):
    docs = load(spark, d, "documents")
    dups = Q.exact_duplicates(docs.select("doc_id", F.md5("text").alias("fp")), "fp", "doc_id")
    sims = load(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"), F.col("label").alias("cluster_rank")
    )
    return B.cluster_membership(docs, "doc_id", dups, sims, docs.select("doc_id", F.col("lang").alias("family")))


_ENDPOINT_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in ENDPOINTS.items()) + " END"
ROLES_SQL = f"""WITH {G.STAGES_SQL}, known AS (SELECT *, lower(name) AS ln FROM (SELECT *, {_ENDPOINT_SQL} AS kind FROM stages) WHERE kind IS NOT NULL),
  marked AS (SELECT *, CASE WHEN kind NOT IN ('jdbc', 's3') THEN 'none' WHEN contains(ln, 'src') OR contains(ln, 'source') OR contains(ln, 'in') OR contains(ln, 'read') THEN 'source'
     WHEN contains(ln, 'tgt') OR contains(ln, 'target') OR contains(ln, 'out') OR contains(ln, 'write') OR contains(ln, 'dest') THEN 'target' ELSE 'open' END AS mark FROM known),
  seen AS (SELECT *, sum(CASE WHEN mark IN ('source', 'open') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY position) AS n FROM marked),
  roles AS (SELECT job_id, position, kind, CASE WHEN mark IN ('source', 'target') THEN mark WHEN mark = 'open' THEN CASE WHEN n = 1 THEN 'source' ELSE 'target' END
     WHEN kind IN ('lookup', 'join') THEN 'lookup' ELSE 'transform' END AS role FROM seen)
"""


@query("infer_roles", ROLES_SQL + "SELECT * FROM roles")
def infer_roles(spark, d):
    return Q.infer_roles(G.stages(spark, d), "job_id", ["position"]).select("job_id", "position", "kind", "role")


@query(
    "layout_pattern",
    ROLES_SQL + """, f AS (SELECT job_id, bool_or(role = 'source' AND kind = 'jdbc') AS js, bool_or(role = 'target' AND kind = 'jdbc') AS jt,
       bool_or(role = 'source' AND kind = 's3') AS fs, bool_or(role = 'target' AND kind = 's3') AS ft, bool_or(role = 'lookup') AS lk, bool_or(role = 'transform') AS tr FROM roles GROUP BY 1)
       SELECT job_id, CASE WHEN js AND ft THEN 'jdbc_to_s3' WHEN fs AND jt THEN 's3_to_jdbc' WHEN js AND jt THEN 'jdbc_to_jdbc' WHEN fs AND ft THEN 's3_to_s3'
         WHEN lk THEN 'lookup_transform' WHEN tr THEN 'transform_only' ELSE 'simple_copy' END AS layout,
         CASE WHEN fs AND jt THEN 'staging_to_table' WHEN js AND jt THEN 'table_to_table' WHEN js AND ft THEN 'table_to_staging'
         WHEN lk THEN 'lookup_transform' WHEN tr THEN 'transform' ELSE 'simple_copy' END AS warehouse_layout
       FROM (SELECT DISTINCT job_id FROM stages) LEFT JOIN f USING (job_id)""",
)
def layout_pattern(spark, d):
    roles = Q.infer_roles(G.stages(spark, d), "job_id", ["position"])
    return Q.layout_pattern(roles, "job_id", G.jobs(spark, d))


GRAPH_SQL = """e AS (SELECT 'R' || n_regionkey AS u, 'N' || n_nationkey AS v FROM nation
  UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders UNION SELECT 'S' || l_suppkey, 'O' || l_orderkey FROM lineitem
  UNION SELECT 'N' || c_nationkey, 'O' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT 'R' || n_regionkey, 'S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "topological_levels",
    f"""WITH RECURSIVE {GRAPH_SQL}, walk(node, level) AS (SELECT DISTINCT u, 0 FROM e WHERE u NOT IN (SELECT v FROM e)
        UNION SELECT e.v, level + 1 FROM walk JOIN e ON e.u = walk.node)
        SELECT node, max(level) AS level FROM walk GROUP BY 1""",
)
def topological_levels(spark, d):
    """Levels of the key hierarchy; brands and types refer to each other, so they and the parts get none."""
    t = {n: load(spark, d, n) for n in ("nation", "customer", "supplier", "orders", "lineitem", "part")}

    def edge(df, u, v):
        node = lambda tag, c: F.concat(F.lit(tag), F.col(c).cast("string"))
        return df.select(node(*u).alias("from_stage"), node(*v).alias("to_stage"))

    buyers = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    sellers = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    edges = [
        edge(t["nation"], ("R", "n_regionkey"), ("N", "n_nationkey")),
        edge(t["customer"], ("N", "c_nationkey"), ("C", "c_custkey")),
        edge(t["supplier"], ("N", "s_nationkey"), ("S", "s_suppkey")),
        edge(t["orders"], ("C", "o_custkey"), ("O", "o_orderkey")),
        edge(t["lineitem"], ("S", "l_suppkey"), ("O", "l_orderkey")),
        edge(buyers, ("N", "c_nationkey"), ("O", "o_orderkey")),
        edge(sellers, ("R", "n_regionkey"), ("S", "s_suppkey")),
        edge(t["part"], ("B", "p_brand"), ("T", "p_type")),
        edge(t["part"], ("T", "p_type"), ("B", "p_brand")),
        edge(t["part"], ("B", "p_brand"), ("P", "p_partkey")),
    ]
    links = edges[0]
    for more in edges[1:]:
        links = links.unionByName(more)
    return levels(links)


@query(
    "branch_counts",
    f"""WITH {G.STAGES_SQL}, {G.LINKS_SQL} SELECT job_id, CAST(sum(o) AS BIGINT) AS n_links, count(*) FILTER (o > 1) AS n_branches,
        count(*) FILTER (o > 2) AS n_complex_branches FROM (SELECT job_id, from_stage, count(*) AS o FROM links GROUP BY 1, 2) GROUP BY 1""",
)
def branch_counts(spark, d):
    return count_branches(G.links(spark, d), "job_id")


def _joined(name, types):
    return f"""{name} AS (SELECT job_id, string_agg(v, ',' ORDER BY v) AS {name} FROM (SELECT DISTINCT job_id, type AS v FROM stages {types}) GROUP BY 1)"""


_WORDS_SQL = " UNION ALL ".join(f"SELECT '{w}' AS w" for w in SUBJECT_WORDS)


@query(
    "entity_summary",
    G.FEATURES_SQL + ", " + _joined("types", "") + ", " + _joined("sources", f"WHERE type IN {G.sql_list(SOURCES)}") + ", "
    + _joined("targets", f"WHERE type IN {G.sql_list(TARGETS)}") + ", " + _joined("transforms", f"WHERE type IN {G.sql_list(TRANSFORMS)}")
    + f""", subjects AS (SELECT job_id, string_agg(w, ',' ORDER BY w) AS subjects FROM (SELECT DISTINCT job_id, w FROM stages JOIN ({_WORDS_SQL})
         ON contains(CASE WHEN l_returnflag = 'A' THEN 'account balance' WHEN l_returnflag = 'N' THEN 'customer order' ELSE lower(name) END, w)) GROUP BY 1)
         SELECT job_id, n_stages, score, coalesce(types, '') AS types, coalesce(sources, '') AS sources, coalesce(targets, '') AS targets,
         coalesce(transforms, '') AS transforms, coalesce(subjects, '') AS subjects FROM scored LEFT JOIN types USING (job_id) LEFT JOIN sources USING (job_id)
         LEFT JOIN targets USING (job_id) LEFT JOIN transforms USING (job_id) LEFT JOIN subjects USING (job_id)""",
)
def entity_summary(spark, d):
    """Subjects come from the stage's mode spelled out, or its name."""
    from stageloom.operators.rules import features

    s = G.stages(spark, d)
    scores = features(s, G.links(spark, d, s), "job_id").select("job_id", "n_stages", "score")
    mode = F.col("properties")["Mode"]
    subject = F.when(mode == "A", "Account balance").when(mode == "N", "Customer order").otherwise(F.col("name"))
    return Q.entity_summary(s, "job_id", subject, scores)
