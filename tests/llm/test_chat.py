import os

import pytest
from pyspark.sql import functions as F

from stageloom.llm import chat

SF = "/root/testdata/sf0.01"


def conversations(spark, n=60):
    rows = []
    for c in range(n):
        turns = ["system"] * (c % 3 == 0) + ["user", "assistant"] * (1 + c % 4)
        for t, role in enumerate(turns):
            text = f"You help with {c}." if role == "system" else f"What is {t} of {c}?" if role == "user" else f"It is {t * c}.\nAnd a longer line to explain {c} " + "in detail " * 9
            rows.append((c, t, role, text.strip(), "extra"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")


def recovered(table, turns):
    both = turns.alias("g").join(table.alias("t"), ["conv_id", "turn"])
    return both.where(F.expr("g.role = t.role AND g.text = trim(t.text)")).count()


def test_roles_and_texts_come_back(spark):
    table = conversations(spark)
    segments = chat.render_transcripts(table)
    turns = chat.parse_transcripts(segments.drop("role"), chat.fit(segments))
    assert turns.count() == table.count()
    assert recovered(table, turns) >= 0.98 * table.count()
    row = turns.where("conv_id = 0 AND turn = 0").first()
    assert row.rendered == "<|im_start|>system\nYou help with 0.<|im_end|>"


def test_blocks_change_nothing(spark, monkeypatch):
    segments = chat.render_transcripts(conversations(spark, 20))
    model = chat.fit(segments)
    whole = sorted(map(tuple, chat.parse_transcripts(segments.drop("role"), model).collect()))
    monkeypatch.setattr(chat, "SEGMENTS_PER_BLOCK", 1)
    monkeypatch.setattr(chat, "BLOCKS_PER_GROUP", 2)
    assert sorted(map(tuple, chat.parse_transcripts(segments.drop("role"), model).collect())) == whole


def test_viterbi_against_all_paths(spark):
    from itertools import product

    segments = chat.render_transcripts(conversations(spark, 12))
    model = chat.fit(segments)
    seen = [chat.observe(x) for x in ("User: hello?", "", "It is so.", "")]
    score = lambda path: sum(
        model.step[a, b] + model.emit[b, o] for a, b, o in zip((chat.START, *path), path, seen, strict=False)
    )
    best = max(product(range(chat.STATES), repeat=len(seen)), key=score)
    last = int(chat.block_matrix(model, seen)[chat.START].argmax())
    assert chat.block_matrix(model, seen)[chat.START].max() == pytest.approx(score(best))
    assert score(chat.decode(model, seen, chat.START, last)) == pytest.approx(score(best))


def test_odd_rows(spark):
    model = chat.fit(chat.render_transcripts(conversations(spark, 12)))
    rows = [(1, None, None), (1, 3, "User: a?\n\nAssistant: b"), (1, 3, "User: a?\n\nAssistant: b"), (None, 0, "Human: x"), (5, 0, ""), (6, 0, "q\n" * 300)]
    got = chat.parse_transcripts(spark.createDataFrame(rows, "conv_id long, part long, text string"), model)
    counts = {r.conv_id: r["count"] for r in got.groupBy("conv_id").count().collect()}
    assert set(counts) == {1, None, 5, 6}
    assert got.where("conv_id = 5").first().text == ""
    assert got.where("conv_id IS NULL").first().text == "x"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse_transcripts(chat.render_transcripts(empty).drop("role"), chat.fit(chat.render_transcripts(empty))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_accuracy_on_the_given_conversations(spark):
    from stageloom.llm import queries

    table = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = queries.op10_transcripts(spark, SF)
    assert recovered(table, turns) >= 0.98 * table.count()
