"""The registered queries of the corpus operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.llm import alignment, bpe, chat, classifier, decontam, fingerprints, hard_negatives, ppm, repeats, secret_scan, setsketch, suffix_arrays, urls
from stageloom.llm.sql import BYTE_SQL, NEAR_SQL, NEGATIVE_SQL, REPEAT_SQL, URL_SQL
from stageloom.scratch import materialise
from stageloom.tables import load

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    urls.UrlRule("block", "net", "/"),
    urls.UrlRule("allow", "example.net", "/en/"),
    urls.UrlRule("block", "example.com", "/de/"),
    urls.UrlRule("allow", "org", "/fr/"),
]

# Common suffixes of several labels; the given pages have none of them.
URL_SUFFIXES = """
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk com.au net.au org.au edu.au gov.au id.au co.nz org.nz net.nz ac.nz
govt.nz co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr go.kr ac.kr com.cn net.cn org.cn gov.cn edu.cn com.hk org.hk com.tw org.tw
com.sg com.my co.th co.id or.id co.in net.in org.in ac.in gov.in com.pk com.ph com.vn com.br net.br org.br gov.br com.ar com.mx
com.co com.pe com.ve com.tr org.tr gov.tr co.il org.il ac.il co.za org.za com.eg com.sa com.ua com.pl com.pt com.es co.at or.at
""".split()


def remainder(n: int):
    """crc32 of the id's text modulo n; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(load(spark, sf_dir, "documents"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), short_items=True).drop("tag")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document that its url's path names by number."""
    pages, labels = load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.url_path(F.col("url")), r"/(\d{1,18})", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    outcomes = numbered.join(labels.select("doc_id", "quality"), "doc_id").select("url", F.col("quality").alias("good"))
    return urls.judge_urls(pages, outcomes, URL_RULES, suffixes=URL_SUFFIXES)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = load(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN, keep_ids=False)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(load(spark, sf_dir, "documents"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(load(spark, sf_dir, "documents"), remainder(10) == 0)


def op7_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(load(spark, sf_dir, "documents"), width=4).drop("group", "tag")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    stats = classifier.with_statistics(docs.select("doc_id", "text"))
    columns = classifier.statistic_columns(stats)
    stats = materialise(stats.drop("text").withColumn("held_out", remainder(5) == 0), "statistics")
    labelled = stats.where(~F.col("held_out")).join(labels.select("doc_id", "quality"), "doc_id")
    score = classifier.fit_rules(labelled, columns).score(columns)
    return stats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as raw transcripts, their roles taken away and found again."""
    segments = chat.render_transcripts(load(spark, sf_dir, "conversations"))
    return chat.parse_transcripts(segments.drop("role"), chat.fit(segments))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are moved on by one, as for mislabelled rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"), label=label)


def op12_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.remove_repeated_bytes(load(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(load(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lempel_ziv,
        op2_spaced_seeds,
        op3_host_reputation,
        op4_byte_bpe,
        op5_secrets,
        op6_ppm,
        op7_setsketch,
        op8_repeats,
        op9_quality,
        op10_transcripts,
        op11_multi_index,
        op12_suffix_arrays,
        op13_alignment,
    )
} | {"pipeline": corpus_pipeline.run}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    sql = {"op3_host_reputation": URL_SQL, "op7_setsketch": NEAR_SQL, "op8_repeats": REPEAT_SQL, "op11_multi_index": NEGATIVE_SQL, "op12_suffix_arrays": BYTE_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
