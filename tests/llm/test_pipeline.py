import os

import corpus_pipeline
import pytest
from helpers import ODD, components, words

import __spark_entry__ as entry
from stageloom.llm import decontam, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_follow_each_other(spark, tmp_path):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "keep_quality", "drop_near_duplicates", "drop_contaminated", "mask_secrets", "encode",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        assert name == "encoding" or docs.columns == columns
        assert set(steps[name][1]) <= set(steps[name][0])

    given, kept = steps["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in given if labels.get(d) == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and len(kept) < len(given)

    given, kept = steps["near_duplicates"]
    sets = {}
    for d, r in given.items():
        w = words(r.text.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(alike, sets)
    assert set(kept) == {d for d in sets if root[d] == d}

    given, kept = steps["decontamination"]
    hit = decontam.overlaps(spark.read.parquet(str(tmp_path / "near_duplicates")), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(given) - set(kept) == {r.doc_id for r in hit.collect()}

    given, kept = steps["secrets"]
    assert set(given) == set(kept)
    for d, r in kept.items():
        assert not secret_scan.all_spans(r.text)[1] and r.n_chars == len(r.text)
        assert r.text == given[d].text or secret_scan.all_spans(given[d].text)[1]
    assert set(steps["encoding"][1]) == set(kept)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, tag string, stat_n_words double, spans string"


def tables(spark, folder, labels, benchmark):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("filled", [True, False])
def test_stages_with_odd_rows_empty_tables_and_clashing_columns(spark, tmp_path, filled):
    secret = (8, 'password = "Zx81kQ9vLm2TtR4w"', "z")
    rows = [(*r[:2], None, "s", None, r[2], 1.0, "x") for r in [*ODD, secret]] if filled else []
    leaked = "another text with the same id"
    sf = tables(spark, tmp_path / "sf", *(([(1, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 0), (6, None, None)], [(1, leaked), (2, None), (None, "")]) if filled else ([], [])))
    given = spark.createDataFrame(rows, COLUMNS)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf)
        assert name == "encoding" or out.columns == given.columns
        kept[name] = out if name == "encoding" else texts(out)
    everything = texts(given)
    assert all(kept["quality"].count(r) in (0, everything.count(r)) for r in everything)
    assert kept["secrets"] == everything if not filled else [r for r in kept["secrets"] if r not in everything] != []
    encoded = kept["encoding"].collect()
    assert sorted((r.doc_id for r in encoded), key=str) == sorted((r[0] for r in everything), key=str)
    assert all(r.n_tokens == 0 for r in encoded if r.doc_id in (1, 2))
    if filled:
        assert sorted(everything, key=str) == sorted([*kept["near_duplicates"], ODD[0][:2]], key=str)
        assert sorted(everything, key=str) == sorted([*kept["decontamination"], (7, leaked)], key=str)
        assert (8, secret[1]) not in kept["secrets"] and (1, None) in kept["secrets"]


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert len(got) == len({r.doc_id for r in got}) > 50


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
