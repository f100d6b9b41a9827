import gzip
import hashlib
import os

import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stageloom.operators.project import with_audit
from stageloom.plans import exports, fleet
from stageloom.sources import files as R
from stageloom.sources import jdbc as D
from stageloom.sources import jobs as G
from stageloom.sources import sinks as K


def test_delimited_with_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id|name\n1|"x|y"\nbad|z\n3|w\n')
    df = R.read_delimited(spark, str(tmp_path), "id int, name string", sep="|", keep_corrupt=True)
    good, errors = R.split_corrupt(df)
    assert rows(good) == [(1, "x|y"), (3, "w")]
    bad = errors.collect()
    assert [r.line for r in bad] == ["bad|z"] and bad[0].path.endswith("a.csv")


def test_gzip_and_recursive_grouped_read(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "b.csv.gz", "wt") as f:
        f.write("id\n1\n2\n")
    assert rows(R.read_delimited(spark, str(tmp_path / "deep"), "id int")) == [(1,), (2,)]
    for i in range(6):
        spark.range(i, i + 1).write.parquet(str(tmp_path / f"p/{i}"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        df = R.read_grouped(spark, str(tmp_path / "p"), group_bytes=64 * 1024 * 1024, pattern="*.parquet")
        assert df.count() == 6 and df.rdd.getNumPartitions() <= 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_partition_pruning_and_tables(spark, tmp_path, plan_of):
    df = spark.range(100).withColumn("p", F.col("id") % 4)
    K.write_partitioned(df, str(tmp_path / "t"), ["p"])
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("pruned")
    one = R.read_table(spark, "pruned", "p = 2")
    assert one.count() == 25 and "PartitionFilters: [isnotnull(p" in plan_of(one)
    K.write_table(df.select("id"), "bucketed", bucket_by=["id"], buckets=4)
    K.write_table(df.select("id"), "bucketed", bucket_by=["id"], buckets=4)
    assert R.read_table(spark, "bucketed").count() == 200


def test_incremental_read(spark):
    df = spark.range(10)
    fresh, last = R.incremental_read(df, "id", 6)
    assert fresh.count() == 3 and last == 9
    fresh, last = R.incremental_read(df, "id", 9)
    assert fresh.count() == 0 and last == 9
    assert R.incremental_read(df, "id")[1] == 9


def test_versioned_overwrite_reads_its_own_table(spark, tmp_path):
    base = str(tmp_path / "v")
    assert K.read_current(spark, base) is None
    K.overwrite(spark.range(3), base)
    K.overwrite(K.read_current(spark, base).withColumn("id", F.col("id") + 10), base)
    assert rows(K.read_current(spark, base)) == [(10,), (11,), (12,)]


def test_audit_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    row = with_audit(spark.read.parquet(str(tmp_path / "t")), "src", from_files=True).first()
    assert row._source_table == "src" and row._source_file.endswith(".parquet") and row._extracted_at


def test_jdbc_predicates_cover_every_key(spark):
    parts = D.key_predicates("id", 3)
    df = spark.createDataFrame([(i,) for i in (-5, -1, 0, 1, 2, 7, None)], "id int")
    assert sum(df.where(p).count() for p in parts) == 7
    assert D.vendor_url("postgresql", "h:1", "d")[0] == "jdbc:postgresql://h:1/d"


EXPORT = """<DSExport>
<Job Identifier="J1">
  <Record Identifier="V0S1" Type="CSeqFileStage"><Property Name="Name">SRC</Property><Property Name="FileName">in.txt</Property>
    <Collection Name="Columns" Type="OutputColumn"/></Record>
  <Record Identifier="V0S2" Type="CTransformerStage"/>
  <Record Identifier="A" Type="CAnnotation"/>
  <Record Identifier="L1" Type="CDSLink"><Property Name="FromStage">SRC</Property><Property Name="ToStage">T</Property></Record>
  <Record Identifier="L2" Type="CDSLink"/>
</Job>
<Job Identifier="J2"><Record Identifier="X" Type="CODBCStage"><Property Name="Query">select 1</Property></Record></Job>
</DSExport>"""


def test_xml_export(spark, tmp_path):
    (tmp_path / "a.xml").write_text(EXPORT)
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "b.xml.gz", "wt") as f:
        f.write(EXPORT.replace("J1", "J3").replace("J2", "J4"))
    out = G.read_job_xml(spark, str(tmp_path), "*.xml*")
    assert rows(out["jobs"], "job_id") == [("J1",), ("J2",), ("J3",), ("J4",)]
    assert rows(out["stages"].where("job_id = 'J1'"), "position", "name", "type") == [
        (0, "V0S1", "CSeqFileStage"), (1, "V0S2", "CTransformerStage")
    ]
    props = out["stages"].where("job_id = 'J1' AND position = 0").first().properties
    assert props == {"Identifier": "V0S1", "Name": "SRC", "FileName": "in.txt", "Collection_Columns": "OutputColumn"}
    assert rows(out["links"].where("job_id = 'J3'"), "from_stage", "to_stage", "name") == [("SRC", "T", "L1")]


def test_truncated_xml_gives_an_error_row(spark, tmp_path):
    (tmp_path / "good.xml").write_text(EXPORT)
    (tmp_path / "bad.xml").write_text('<DSExport><Job Identifier="B"><Record Identifier="x" Type="C"><Oops></Record></Job></DSExport>')
    (tmp_path / "empty.xml").write_text("")
    out = G.read_job_xml(spark, str(tmp_path))
    assert rows(out["jobs"], "job_id") == [("J1",), ("J2",)]
    assert [os.path.basename(r.path) for r in out["errors"].collect()] == ["bad.xml"]


def test_older_xml(spark, tmp_path):
    (tmp_path / "o.xml").write_text(
        '<ROOT><JOB NAME="OJ"><STAGE NAME="s1" STGTYPE="Lookup"><PROPERTY NAME="Table">t1</PROPERTY></STAGE>'
        '<STAGE NAME="s2" STGTYPE="Sort"/><LINK FROMSTAGE="s1" TOSTAGE="s2" NAME="l"/></JOB></ROOT>'
    )
    out = G.read_older_xml(spark, str(tmp_path))
    assert rows(out["stages"], "job_id", "name", "type", "properties") == [
        ("OJ", "s1", "Lookup", {"Table": "t1"}), ("OJ", "s2", "Sort", {})
    ]
    assert rows(out["links"], "from_stage", "to_stage", "name") == [("s1", "s2", "l")]


BLOCKS = """BEGIN HEADER
   CharacterSet "CP1252"
END HEADER
BEGIN DSJOB
   Identifier "JA"
   BEGIN DSRECORD
      Identifier "ROOT"
      Name "JA"
   END DSRECORD
   BEGIN DSRECORD
      Identifier "S0"
      OLEType "CSeqFileStage"
      FileName = "in=1.txt"
      FileName = "in=2.txt"
   END DSRECORD
END DSJOB
BEGIN DSJOB
   Identifier "JB"
   BEGIN DSRECORD
      Identifier "S1"
      OLEType "CTransformerStage"
   END DSRECORD
END DSJOB
BEGIN DSJOB
   Identifier "CUT"
   BEGIN DSRECORD
      Identifier "S2"
"""


def test_block_text(spark, tmp_path):
    (tmp_path / "a.dsx").write_text(BLOCKS)
    with gzip.open(tmp_path / "b.dsx.gz", "wt") as f:
        f.write(BLOCKS.replace('"JA"', '"JC"').replace('"JB"', '"JD"').split('BEGIN DSJOB\n   Identifier "CUT"')[0])
    (tmp_path / "empty.dsx").write_text("")
    out = G.read_job_blocks(spark, str(tmp_path), "*.dsx*")
    assert rows(out["jobs"], "job_id") == [("JA",), ("JB",), ("JC",), ("JD",)]
    # The record without a type is no stage; a repeated property keeps its last value.
    assert rows(out["stages"].where("job_id IN ('JA', 'JB')"), "job_id", "name", "type", "properties") == [
        ("JA", "S0", "CSeqFileStage", {"FileName =": "in=2.txt"}), ("JB", "S1", "CTransformerStage", {})
    ]
    errors = out["errors"].collect()
    assert len(errors) == 1 and "CUT" in errors[0].line


def test_a_broken_older_file_gives_an_error_row(spark, tmp_path):
    (tmp_path / "good.xml").write_text('<ROOT><JOB NAME="j"><STAGE NAME="s" STGTYPE="T"></STAGE></JOB></ROOT>')
    (tmp_path / "bad.xml").write_text('<ROOT><JOB NAME="k"><STAGE NAME="s"><Oops></STAGE></JOB></ROOT>')
    out = G.read_older_xml(spark, str(tmp_path))
    assert rows(out["jobs"], "job_id") == [("j",)] and rows(out["stages"], "job_id", "name") == [("j", "s")]
    assert [r.path.rsplit("/", 1)[1] for r in out["errors"].collect()] == ["bad.xml"]


def test_content_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "x.dsx").write_bytes(b"abc")
    assert G.content_hash(spark, str(tmp_path)).first().content_hash == hashlib.sha256(b"abc").hexdigest()


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    (tmp_path / "deep er").mkdir()
    contents = {"a.bin": b"\x00\xff" * 500, "deep er/b.gz": gzip.compress(b"packed" * 100), "d": b"1234567890", "e": b"12345678901"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = sorted((name.rsplit("/", 1)[-1], hashlib.sha256(content).hexdigest()) for name, content in contents.items())
    for largest, block in ((10, 7), (10, 1 << 20), (0, 1), (1 << 20, 7)):
        got = G.content_hash(spark, str(tmp_path), largest=largest, block=block).collect()
        assert sorted((r.path.rsplit("/", 1)[-1], r.content_hash) for r in got) == want


def test_older_exports_are_written_packed(spark, tmp_path, monkeypatch):
    """The export is the largest thing the query writes; as gzip it takes a tenth, and reads back the same."""
    from stageloom.plans import exports

    monkeypatch.setattr(exports, "new_path", lambda spark, label: str(tmp_path / label))
    exports.job_older_xml(spark, "/root/testdata/sf0.001")
    written = [p.name for p in (tmp_path / "older").rglob("part-*")]
    assert written and all(name.endswith(".txt.gz") for name in written)


def test_links_from_the_steps_of_a_job_are_those_of_the_fleet(spark):
    steps = spark.createDataFrame(
        [(1, i, f"s{i}", f"s{i - 1}" if i > 1 else None, q) for i, q in enumerate([30.0, 30.0, 26.0, 25.0, 40.0], 1)] + [(2, 1, "t1", None, 50.0)],
        "job_id long, position int, name string, previous string, quantity double",
    )
    gathered = steps.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("position", "name", "previous", "quantity"))).alias("steps"))
    pair = lambda a, b: F.struct(a.alias("from_stage"), b.alias("to_stage"))
    made = gathered.select("job_id", F.explode(exports._chained(F.col("steps"), pair)).alias("l")).select("job_id", "l.*")
    assert rows(made) == rows(fleet.links(spark, "", steps))
    assert len(rows(made)) == 6
