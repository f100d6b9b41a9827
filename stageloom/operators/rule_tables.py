"""Rule data for steps of known types. All lists below are fixed values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from stageloom.operators.sizing import literal_table

# Complexity weight of a step type; any type not listed weighs DEFAULT_WEIGHT.
WEIGHTS = {
    "SequentialFile": 1,
    "FileSet": 1,
    "Dataset": 1,
    "OracleConnector": 2,
    "OracleConnectorPX": 2,
    "DB2Connector": 2,
    "DB2ConnectorPX": 2,
    "SQLServerConnector": 2,
    "SQLServerConnectorPX": 2,
    "ODBCConnector": 2,
    "JDBCConnector": 2,
    "TeradataConnector": 4,
    "TeradataConnectorPX": 4,
    "NetezzaConnector": 3,
    "RedshiftConnector": 1,
    "Transformer": 2,
    "Filter": 1,
    "Join": 2,
    "Lookup": 3,
    "Aggregator": 2,
    "Sort": 1,
    "Funnel": 1,
    "Remove Duplicates": 2,
    "Copy": 1,
    "Modify": 2,
    "Pivot": 3,
    "Merge": 2,
    "Switch": 3,
    "ChangeCapture": 5,
    "ChangeApply": 5,
    "SurrogateKeyGenerator": 2,
    "ColumnGenerator": 1,
    "RowGenerator": 2,
    "Peek": 1,
    "Head": 1,
    "Tail": 2,
    "Sample": 1,
    "CTransformerStage": 2,
    "CTrxInput": 0,
    "CTrxOutput": 0,
    "CCustomStage": 3,
    "CCustomInput": 0,
    "CCustomOutput": 0,
    "CSeqFileStage": 1,
    "CSeqInput": 0,
    "CSeqOutput": 0,
    "CHashedFileStage": 2,
    "CHashedInput": 0,
    "CHashedOutput": 0,
    "CContainerView": 0,
    "CJobDefn": 0,
    "CAnnotation": 0,
    "CODBCStage": 2,
    "COracleOCIStage": 2,
    "CDB2APISTG": 2,
    "CXMLStage": 3,
    "CWebServicePXStage": 4,
    "CMQSeriesPXStage": 4,
    "CKafkaConnectorPX": 2,
    "CS3PXStage": 1,
}
DEFAULT_WEIGHT = 2

# Step types that can be the source, the target or a transformation of a job.
SOURCES = [
    "OracleConnector",
    "DB2Connector",
    "SQLServerConnector",
    "TeradataConnector",
    "SequentialFile",
    "FileSet",
    "Dataset",
    "ODBCConnector",
    "JDBCConnector",
    "CSeqFileStage",
    "CHashedFileStage",
    "CODBCStage",
    "COracleOCIStage",
    "CDB2APISTG",
    "CKafkaConnectorPX",
    "CS3PXStage",
]

TARGETS = [
    "OracleConnector",
    "DB2Connector",
    "SQLServerConnector",
    "TeradataConnector",
    "SequentialFile",
    "Dataset",
    "ODBCConnector",
    "JDBCConnector",
    "CSeqFileStage",
    "CHashedFileStage",
    "CODBCStage",
    "COracleOCIStage",
    "CDB2APISTG",
    "CKafkaConnectorPX",
    "CS3PXStage",
]

TRANSFORMS = [
    "Transformer",
    "Join",
    "Lookup",
    "Aggregator",
    "Sort",
    "Funnel",
    "Remove Duplicates",
    "Filter",
    "Copy",
    "Modify",
    "Pivot",
    "ChangeCapture",
    "SurrogateKeyGenerator",
    "ColumnGenerator",
    "Merge",
    "Switch",
    "CTransformerStage",
    "CCustomStage",
    "CXMLStage",
]

# How far a step type can be converted.
FULL = [
    "SequentialFile",
    "FileSet",
    "Dataset",
    "Filter",
    "Sort",
    "Copy",
    "Funnel",
    "JDBCConnector",
    "ODBCConnector",
    "CSeqFileStage",
    "CS3PXStage",
]

PARTIAL = [
    "Transformer",
    "Join",
    "Aggregator",
    "Lookup",
    "OracleConnector",
    "OracleConnectorPX",
    "DB2Connector",
    "DB2ConnectorPX",
    "SQLServerConnector",
    "SQLServerConnectorPX",
    "Modify",
    "ColumnGenerator",
    "SurrogateKeyGenerator",
    "Remove Duplicates",
    "Merge",
    "CTransformerStage",
    "CHashedFileStage",
    "CODBCStage",
    "COracleOCIStage",
    "CDB2APISTG",
    "CKafkaConnectorPX",
]

MANUAL = [
    "ChangeCapture",
    "ChangeApply",
    "Pivot",
    "Switch",
    "TeradataConnector",
    "TeradataConnectorPX",
    "NetezzaConnector",
    "CustomStage",
    "CCustomStage",
    "CXMLStage",
    "CWebServicePXStage",
    "CMQSeriesPXStage",
]

METADATA = [
    "CContainerView",
    "CJobDefn",
    "CAnnotation",
    "CTrxInput",
    "CTrxOutput",
    "CCustomInput",
    "CCustomOutput",
    "CSeqInput",
    "CSeqOutput",
    "CHashedInput",
    "CHashedOutput",
    "CJSJobActivity",
    "CJSActivityInput",
    "CJSActivityOutput",
    "CJSUserVarsActivity",
    "CJSEndLoopActivity",
    "CJSStartLoopActivity",
    "CJSCondition",
    "CJSExecCmdActivity",
    "CJSSequencer",
    "CJSTerminatorActivity",
    "CJSExceptionHandler",
    "CJSWaitFileActivity",
    "CContainerStage",
    "CStdPin",
    "CStdOutput",
    "CStdInput",
    "CUnattachedDst",
    "CRecord",
]

# Effort in hours per step type; any other type takes 1.
EFFORT = {
    "SequentialFile": 0.5,
    "Transformer": 2.0,
    "Join": 1.5,
    "Lookup": 2.0,
    "Aggregator": 1.5,
    "ChangeCapture": 4.0,
    "Pivot": 2.5,
    "TeradataConnector": 3.0,
}

# Step types that a sequence leaves out.
IGNORED_STEPS = [
    "CContainerView",
    "CJobDefn",
    "CAnnotation",
    "CTrxInput",
    "CTrxOutput",
    "CCustomInput",
    "CCustomOutput",
    "CSeqInput",
    "CSeqOutput",
    "CHashedInput",
    "CHashedOutput",
    "CJSJobActivity",
    "CJSActivityInput",
    "CJSActivityOutput",
    "CJSUserVarsActivity",
    "CJSCondition",
    "CJSSequencer",
]

# Readable kind of a step type: the first rule with a matching substring.
KINDS = [
    (["Transformer", "Trx"], "Transform"),
    (["Seq", "File"], "File"),
    (["Hash"], "Lookup"),
    (["Oracle", "DB2", "SQL", "ODBC"], "Database"),
    (["Custom"], "Custom"),
]

# Endpoint kind of a step type in a layout.
ENDPOINTS = {
    "OracleConnectorPX": "jdbc",
    "OracleODBC": "jdbc",
    "DB2ConnectorPX": "jdbc",
    "TeradataConnectorPX": "jdbc",
    "SQLServerConnectorPX": "jdbc",
    "PostgreSQLConnectorPX": "jdbc",
    "ODBCConnectorPX": "jdbc",
    "DSDB2PX": "jdbc",
    "PxSequentialFile": "s3",
    "SequentialFile": "s3",
    "PxDataSet": "s3",
    "FileConnectorPX": "s3",
    "ParquetFileConnectorPX": "s3",
    "CTransformerStage": "transform",
    "PxTransform": "transform",
    "Transformer": "transform",
    "PxLookup": "lookup",
    "PxJoin": "join",
    "PxMerge": "join",
    "PxAggregator": "aggregate",
    "Aggregator": "aggregate",
    "PxFilter": "filter",
    "PxSort": "sort",
    "PxRemoveDuplicates": "distinct",
    "PxFunnel": "union",
    "PxCopy": "copy",
}
SOURCE_WORDS = ["src", "source", "in", "read"]
TARGET_WORDS = ["tgt", "target", "out", "write", "dest"]

# Template of a sequence class.
CLASS_TEMPLATES = {
    "DB to File ETL": "jdbc_to_s3_etl",
    "File to DB ETL": "s3_to_jdbc_etl",
    "Database ETL": "jdbc_transform",
    "File Processing": "s3_to_s3_etl",
    "Lookup Enrichment": "join_lookup_etl",
    "Join Pipeline": "join_lookup_etl",
    "Aggregation Pipeline": "aggregation_etl",
    "Transformation Only": "s3_transform",
    "File Copy": "s3_copy",
    "Database Copy": "jdbc_copy",
    "Custom Processing": "custom_etl",
    "Empty Job": "skip",
    "Other": "custom_etl",
}

# Property names that only parameterise a step.
PARAMETER_WORDS = [
    "table",
    "file",
    "filename",
    "path",
    "connection",
    "database",
    "schema",
    "query",
    "sql",
]


# Names of migration categories by the rule that gives them.
MIGRATION_CATEGORIES = {
    "files": "AUTO - S3 to S3 ETL",
    "read_only": "AUTO - Read-Only (Athena candidate)",
    "simple_connector": "AUTO - Simple JDBC ETL",
    "change": "MANUAL - CDC/SCD Pattern (Delta Lake)",
    "transformations": "MANUAL - Complex Transformations",
    "score_below_30": "AUTO - Basic Glue Job",
    "score_below_50": "SEMI-AUTO - Standard ETL",
    "score_below_70": "SEMI-AUTO - Advanced ETL",
    "rest": "MANUAL - Complex Job",
}

# Points (hundredths) and text of a risk factor; {} stands for the number in question.
RISK_FACTORS = {
    "lookups": (20, "Multiple lookups ({}) - complex data enrichment"),
    "change": (30, "CDC/SCD pattern detected - requires Glue Bookmarks + custom logic"),
    "branches": (15, "Complex branching ({} multi-output stages)"),
    "teradata": (15, "Teradata connector - requires custom JDBC configuration"),
    "netezza": (15, "Netezza connector - legacy system, verify compatibility"),
    "score": (10, "High complexity score ({}/100)"),
    "pivot": (10, "Pivot transformation - requires DataFrame API"),
}

# Recommendations by the condition that gives them.
RECOMMENDATIONS = {
    "auto": [
        "✅ Good candidate for automated migration",
        "Run generated script in Glue Dev Endpoint for validation",
    ],
    "semi_auto": [
        "📝 Review generated template and complete TODOs",
        "Test with sample data before full migration",
    ],
    "manual": [
        "⚠️ Requires manual analysis and custom implementation",
        "Consider breaking into smaller, simpler jobs",
    ],
    "change": [
        "💡 Use Glue Bookmarks for incremental processing",
        "Consider Delta Lake or Apache Iceberg for CDC",
    ],
    "lookup": [
        "💡 Use broadcast joins for small lookup tables",
        "Consider caching lookup data in Glue Data Catalog",
    ],
    "teradata": [
        "🔧 Configure Teradata JDBC driver in Glue",
        "Consider migrating Teradata tables to Redshift first",
    ],
    "large": [
        "📊 Complex job - consider modularizing into multiple Glue jobs",
    ],
}

# Services and features needed by the condition that needs them.
FEATURES_NEEDED = {
    "always": ["Glue ETL Job", "IAM Role for Glue"],
    "connector": ["Glue Connection (JDBC)", "VPC Configuration", "Secrets Manager (credentials)"],
    "file": ["S3 Bucket", "Glue Data Catalog"],
    "change": ["Job Bookmarks", "Delta Lake / Iceberg (recommended)"],
    "score": ["Glue Dev Endpoint (testing)", "CloudWatch Logs", "Spark UI"],
    "jdbc": ["JDBC Drivers"],
    "teradata": ["Teradata JDBC Driver (custom)", "Glue Marketplace Connector (optional)"],
}

# Texts of automation blockers.
BLOCKERS = {
    "change": "CDC/SCD logic must be manually validated",
    "custom": "Custom code/routines need manual conversion",
    "transformers": "Multiple Transformers ({}) - review SQL/logic",
    "type": "Stage type '{}' requires manual implementation",
}


def endpoint_kinds() -> dict[str, str]:
    return dict(ENDPOINTS)


def type_rules() -> list[tuple]:
    """One row per known type: weight, support class, effort, endpoint and transform flags."""
    support = {t: "full" for t in FULL}
    support.update({t: "partial" for t in PARTIAL})
    support.update({t: "manual" for t in MANUAL})
    support.update({t: "metadata" for t in METADATA})
    known = sorted({*WEIGHTS, *support, *EFFORT, *SOURCES, *TARGETS, *TRANSFORMS})
    return [
        (
            t,
            WEIGHTS.get(t, DEFAULT_WEIGHT),
            support.get(t),
            EFFORT.get(t, 1.0),
            t in SOURCES,
            t in TARGETS,
            t in TRANSFORMS,
        )
        for t in known
    ]


def type_rule_table(spark: SparkSession, weights: Mapping[str, int] | None = None) -> DataFrame:
    """The rules as a table of about a hundred rows; weights can be overridden."""
    rows = [
        (t, (weights or {}).get(t, w), *rest) for t, w, *rest in type_rules()
    ]
    rows += [
        (t, w, None, 1.0, False, False, False)
        for t, w in (weights or {}).items()
        if t not in {r[0] for r in rows}
    ]
    return literal_table(
        spark,
        rows,
        "type string, weight int, support string, effort double, is_source boolean, "
        "is_target boolean, is_transform boolean",
    )
