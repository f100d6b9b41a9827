import os

import pyarrow as pa
import pytest
from helpers import ODD, docs_of
from pyspark.sql import functions as F

from stageloom.llm import classifier, queries
from stageloom.llm import text as tx

SF = "/root/testdata/sf0.01"


def test_statistics():
    texts = ["Ab, cd.\nCD 12!", "", None, "é $$$"]
    got = classifier.statistics(*tx.raw(pa.array(texts)))
    assert got["n_words"].tolist() == [4, 0, 0, 2]
    assert got["upper_share"].tolist() == [pytest.approx(3 / 11), 0, 0, 0]
    assert got["distinct_share"].tolist() == [1, 0, 0, 1]  # "cd." and "CD" differ
    assert got["symbol_share"][3] == pytest.approx(3 / 5) and got["non_ascii_share"][3] == pytest.approx(2 / 5)


def test_tree_rules_join_paths():
    text = """RandomForestClassificationModel: uid=x, numTrees=1, numClasses=2, numFeatures=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 0 <= 0.25)
      Predict: 0.0
     Else (feature 0 > 0.25)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert classifier.tree_rules(text) == [
        ((0, "<=", 0.5),),
        ((0, "<=", 0.25),),
        ((0, "<=", 0.5), (0, ">", 0.25)),
        ((0, ">", 0.5),),
    ]


def test_score_is_the_sum_of_rules(spark):
    model = classifier.RuleModel(((((0, ">", 1.0), (1, "<=", 2.0)), 1.5), (((1, ">", 2.0),), -0.5)), 0.25)
    rows = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(model.score(["a", "b"])).collect()]
    logistic = lambda x: 1 / (1 + 2.718281828459045**-x)
    assert got == pytest.approx([logistic(1.75), logistic(-0.25), logistic(0.25)])


def test_columns_stay_and_odd_rows(spark):
    docs = docs_of(spark, ODD, "stat_n_words")
    got = classifier.with_statistics(docs)
    assert got.columns[:3] == docs.columns and got.count() == len(ODD)
    columns = classifier.statistic_columns(got)
    assert "_stat_n_words" in columns
    assert [r[0] for r in got.where("doc_id = 6").select("_stat_n_words").collect()] == [8000.0]
    none = got.limit(0).withColumn("quality", F.lit(1))
    assert classifier.fit_rules(none, columns) == classifier.RuleModel((), 0.0)
    one = got.withColumn("quality", F.lit(1))
    model = classifier.fit_rules(one, columns)
    assert model.rules == () and model.intercept > 0
    assert classifier.with_statistics(docs_of(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    got = queries.op9_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out AND quality IS NOT NULL")
    n, right, good, good_kept = held.agg(
        F.count("*"), F.sum((F.col("quality") == F.col("predicted")).cast("int")),
        F.sum("quality"), F.sum(F.col("quality") * F.col("predicted")),
    ).first()
    assert n > 50 and right / n > 0.95 and good_kept / good > 0.97
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
