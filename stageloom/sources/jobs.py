"""Exported ETL jobs: XML and block text -> ``jobs``, ``stages`` and ``links`` tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stageloom.functions.text import strip_space
from stageloom.scratch import materialise

# Record types that are stages.
STAGE_RECORDS = [
    "CCustomStage", "CTransformerStage", "CContainerDef", "CDBConnectorStage", "CFileConnectorStage",
    "CODBCStage", "COracleOCIStage", "CDB2Stage", "CSeqFileStage", "CDatasetStage", "CHashedFileStage",
    "CLookupStage", "CAggregatorStage", "CJoinStage", "CSortStage", "CFilterStage", "CFunnelStage",
    "CMergeStage", "CRemoveDupStage", "CSurrogateKeyStage", "CChangeApplyStage", "CChangeCaptureStage",
    "CSCDStage", "CPivotStage", "CRowGeneratorStage", "CColumnGeneratorStage", "CModifyStage", "CCopyStage",
    "CMetaDataImportStage",
]

# Record properties that are kept.
STAGE_PROPERTIES = [
    "Identifier", "Name", "SQLStatement", "TableName", "FileName", "Connection", "Database", "Schema", "Query", "Server",
    "InputLinks", "OutputLinks", "StageType", "OLEType", "NextID", "Description", "XMLProperties",
]

EXPORT_SCHEMA = """
  _Identifier string,
  Record array<struct<
    _Identifier: string, _Type: string,
    Property: array<struct<_Name: string, _VALUE: string>>,
    Collection: array<struct<_Name: string, _Type: string>>>>,
  _corrupt_record string
"""

OLDER_SCHEMA = """
  _NAME string,
  STAGE array<struct<_NAME: string, _STGTYPE: string,
    PROPERTY: array<struct<_NAME: string, _VALUE: string>>>>,
  LINK array<struct<_NAME: string, _FROMSTAGE: string, _TOSTAGE: string>>,
  _corrupt_record string
"""


def _xml(spark: SparkSession, path: str, row_tag: str, schema: str, pattern: str | None) -> DataFrame:
    reader = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("recursiveFileLookup", True)
        .option("mode", "PERMISSIVE")
        .schema(schema)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # Parsed once and stored: jobs, stages, links and errors are all cut from it.
    return materialise(reader.load(path).withColumn("path", F.col("_metadata.file_path")), "xml")


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) entries; a repeated key keeps its last value."""
    later = lambda e, i: F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]
    )
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def _property(name: str) -> Column:
    values = F.filter("r.Property", lambda p: p["_Name"] == name)
    return F.nullif(F.try_element_at(values, F.lit(1))["_VALUE"], F.lit(""))


def read_job_xml(
    spark: SparkSession, path: str, pattern: str | None = None
) -> dict[str, DataFrame]:
    """XML export with ``Job`` / ``Record`` / ``Property`` elements; also yields ``errors``."""
    raw = _xml(spark, path, "Job", EXPORT_SCHEMA, pattern)
    good = raw.where(F.col("_corrupt_record").isNull())
    errors = raw.where(F.col("_corrupt_record").isNotNull()).select(
        "path", F.col("_corrupt_record").alias("line")
    )
    named = good.withColumn("job_id", F.coalesce("_Identifier", F.lit("")))
    records = named.select("path", "job_id", F.posexplode("Record").alias("position", "r"))
    identifier = F.coalesce(F.nullif("r._Identifier", F.lit("")), _property("Identifier"))
    kept = F.array(
        F.struct(F.lit("Identifier").alias("key"), identifier.alias("value")),
        *[
            F.struct(F.lit(p).alias("key"), _property(p).alias("value"))
            for p in STAGE_PROPERTIES
            if p != "Identifier"
        ],
    )
    collections = F.transform(
        F.filter(
            F.coalesce("r.Collection", F.array().cast("array<struct<_Name:string,_Type:string>>")),
            lambda c: (c["_Name"] != "") & (c["_Type"] != ""),
        ),
        lambda c: F.struct(
            F.concat(F.lit("Collection_"), c["_Name"]).alias("key"), c["_Type"].alias("value")
        ),
    )
    properties = _last_wins(
        F.filter(F.concat(kept, collections), lambda e: e["value"].isNotNull())
    )
    stages = records.where(F.col("r._Type").isin(STAGE_RECORDS)).select(
        "path",
        "job_id",
        "position",
        F.coalesce(identifier, _property("Name"), F.lit("")).alias("name"),
        F.col("r._Type").alias("type"),
        properties.alias("properties"),
    )
    source = F.coalesce(_property("FromStage"), _property("InputPin"))
    target = F.coalesce(_property("ToStage"), _property("OutputPin"))
    links = (
        records.where(F.col("r._Type") == "CDSLink")
        .select(
            "path",
            "job_id",
            source.alias("from_stage"),
            target.alias("to_stage"),
            F.coalesce(identifier, _property("Name"), F.lit("")).alias("name"),
        )
        .where(F.col("from_stage").isNotNull() | F.col("to_stage").isNotNull())
        .na.fill("", ["from_stage", "to_stage"])
    )
    return {
        "jobs": named.select("job_id", "path"),
        "stages": stages,
        "links": links,
        "errors": errors,
    }


def read_older_xml(
    spark: SparkSession, path: str, pattern: str | None = None
) -> dict[str, DataFrame]:
    """Older XML form: ``JOB`` / ``STAGE`` / ``PROPERTY`` / ``LINK``; also yields ``errors``."""
    whole = _xml(spark, path, "JOB", OLDER_SCHEMA, pattern)
    errors = whole.where(F.col("_corrupt_record").isNotNull()).select("path", F.col("_corrupt_record").alias("line"))
    raw = whole.where(F.col("_corrupt_record").isNull()).withColumn("job_id", F.coalesce("_NAME", F.lit("")))
    entry = lambda p: F.struct(
        F.coalesce(p["_NAME"], F.lit("")).alias("key"),
        F.coalesce(p["_VALUE"], F.lit("")).alias("value"),
    )
    empty = F.array().cast("array<struct<_NAME:string,_VALUE:string>>")
    stages = raw.select("path", "job_id", F.posexplode("STAGE").alias("position", "s")).select(
        "path",
        "job_id",
        "position",
        F.coalesce("s._NAME", F.lit("")).alias("name"),
        F.coalesce("s._STGTYPE", F.lit("")).alias("type"),
        _last_wins(F.transform(F.coalesce("s.PROPERTY", empty), entry)).alias("properties"),
    )
    links = raw.select("path", "job_id", F.explode("LINK").alias("l")).select(
        "path",
        "job_id",
        F.coalesce("l._FROMSTAGE", F.lit("")).alias("from_stage"),
        F.coalesce("l._TOSTAGE", F.lit("")).alias("to_stage"),
        F.coalesce("l._NAME", F.lit("")).alias("name"),
    )
    return {"jobs": raw.select("job_id", "path"), "stages": stages, "links": links, "errors": errors}


def _quoted(line: Column) -> Column:
    """Text after the first quote, up to the next one."""
    return F.regexp_extract(line, '^[^"]*"([^"]*)', 1)


def read_job_blocks(
    spark: SparkSession, path: str, pattern: str | None = None
) -> dict[str, DataFrame]:
    """Block text: ``BEGIN DSJOB`` ... ``END DSJOB`` with nested ``DSRECORD`` blocks.

    Each job block is one input row, so a large file with many jobs is read in parallel.
    Blocks without an end or a name go to ``errors``.
    """
    reader = (
        spark.read.option("lineSep", "BEGIN DSJOB").option("recursiveFileLookup", True)
    )
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    blocks = raw.where(
        (F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
        & ~F.col("value").rlike(r"^\s*BEGIN HEADER")
    )
    closed = F.regexp_like("value", F.lit(r"\n\s*END DSJOB"))
    body = F.regexp_replace("value", r"(?s)\n\s*END DSJOB.*$", "")
    pieces = F.split(body, r"\n\s*BEGIN DSRECORD")
    lines = lambda text: F.transform(F.split(text, "\n"), lambda x: strip_space(x))
    is_identifier = lambda x: x.startswith("Identifier") & F.contains(x, F.lit('"'))
    parsed = blocks.select(
        "path",
        "value",
        closed.alias("closed"),
        _quoted(F.try_element_at(F.filter(lines(pieces[0]), is_identifier), F.lit(1))).alias("job_id"),
        F.slice(pieces, 2, F.size(pieces)).alias("records"),
    )
    # Cut once and stored: jobs, stages and errors are all taken from it.
    parsed = materialise(parsed, "blocks")
    valid = F.col("closed") & (F.coalesce("job_id", F.lit("")) != "")
    # The one-element explode keeps the lines a column, which the uses below share.
    own = F.regexp_replace("record", r"(?s)\n\s*END DSRECORD.*$", "")
    records = (
        parsed.where(valid)
        .select("path", "job_id", F.posexplode("records").alias("position", "record"))
        .select("path", "job_id", "position", F.explode(F.array(lines(own))).alias("lines"))
    )
    is_type = lambda x: x.startswith("OLEType") & F.contains(x, F.lit('"'))
    type_at = F.array_position(F.transform("lines", is_type), F.lit(True))
    property_lines = F.filter(
        F.slice(F.col("lines"), type_at.cast("int") + 1, F.size("lines")),
        lambda x: F.contains(x, F.lit("="))
        & x.rlike('".*"')
        & ~is_identifier(x)
        & ~is_type(x),
    )
    entries = F.transform(
        property_lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, '"', 1)).alias("key"), _quoted(x).alias("value")
        ),
    )
    stages = (
        records.withColumn(
            "type", _quoted(F.try_element_at(F.filter("lines", is_type), F.lit(-1)))
        )
        .where(F.coalesce("type", F.lit("")) != "")
        .select(
            "path",
            "job_id",
            "position",
            F.coalesce(
                _quoted(F.try_element_at(F.filter("lines", is_identifier), F.lit(-1))), F.lit("")
            ).alias("name"),
            "type",
            _last_wins(entries).alias("properties"),
        )
    )
    return {
        "jobs": parsed.where(valid).select("job_id", "path"),
        "stages": stages,
        "errors": parsed.where(~valid).select("path", F.col("value").alias("line")),
    }


#: What one value of a row can hold: larger files are read in blocks.
LARGEST_FILE = (1 << 31) - 16
BLOCK_BYTES = 8 << 20


def _block_digests(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                scheme, _, rest = path.partition(":")
                if scheme == "file":
                    files, place = pa.fs.LocalFileSystem(), "/" + rest.lstrip("/")
                else:
                    files, place = pa.fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
                digest = hashlib.sha256()
                with files.open_input_stream(place, compression=None) as stream:
                    while part := stream.read(block):
                        digest.update(part)
                yield pa.RecordBatch.from_pydict({"path": [path], "content_hash": [digest.hexdigest()]})

    return run


def content_hash(
    spark: SparkSession, path: str, pattern: str | None = None, largest: int = LARGEST_FILE, block: int = BLOCK_BYTES
) -> DataFrame:
    """sha256 of each file as stored, of any size; empty files have no row, as in all of Spark's file sources.

    Files up to ``largest`` bytes are rows of the file source. Larger ones, which no row can hold, are read by one task each in
    blocks of ``block`` bytes, with constant memory, through Arrow's file systems (local disks, HDFS, S3, GCS).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    small = files.where(F.col("length") <= largest).select("path", F.sha2(F.col("content"), 256).alias("content_hash"))
    # Without their content, files are a few bytes a row: one task each by their names.
    large = files.where(F.col("length") > largest).select("path")
    if large.isEmpty():
        return small
    tasks = max(1, min(large.count(), 10_000))
    hashed = large.repartition(tasks, "path").mapInArrow(_block_digests(block), "path string, content_hash string")
    return small.unionByName(hashed)
