"""Dimension tables (tiny, fixed size, safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Migration types offered when a project is created
# (value, label, source language, target language).
MIGRATION_TYPES = [
    ("COBOL-to-Java", "COBOL to Java", "COBOL", "Java 17"),
    ("PostgreSQL-to-Oracle", "PostgreSQL to Oracle", "PostgreSQL", "Oracle"),
    ("PL1-to-Java", "PL/I to Java", "PL/I", "Java 17"),
    ("Oracle-to-PostgreSQL", "Oracle to PostgreSQL", "Oracle", "PostgreSQL"),
    ("MySQL-to-Oracle", "MySQL to Oracle", "MySQL", "Oracle"),
]

# File extensions admitted per migration type (upload filter).
ADMISSION_RULES = [
    ("COBOL-to-Java", [".cbl", ".cob", ".sql", ".ddl"]),
    ("PostgreSQL-to-Oracle", [".sql", ".java", ".xml", ".yml", ".yaml"]),
    ("Oracle-to-PostgreSQL", [".sql", ".java", ".xml", ".yml", ".yaml"]),
    ("MySQL-to-Oracle", [".sql", ".java", ".xml", ".yml", ".yaml"]),
]


def migration_types(spark: SparkSession) -> DataFrame:
    """The 5-row migration-type dimension."""
    return spark.createDataFrame(
        MIGRATION_TYPES, "migration_type string, label string, source_language string, target_language string")


def admission_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADMISSION_RULES, "migration_type string, exts array<string>")


PROJECTS_SQL = """
SELECT 'p' || CAST(n_nationkey AS STRING) AS project_id,
       n_name AS name,
       CASE CAST(n_nationkey % 5 AS INT)
            WHEN 0 THEN 'COBOL-to-Java' WHEN 1 THEN 'PostgreSQL-to-Oracle'
            WHEN 2 THEN 'PL1-to-Java' WHEN 3 THEN 'Oracle-to-PostgreSQL'
            ELSE 'MySQL-to-Oracle' END AS migration_type
FROM {nation}"""


def projects_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated portfolio: one project per nation (25 projects)."""
    from migscope.sources.generated import run_sql
    p = run_sql(spark, sf_dir, PROJECTS_SQL)
    mt = migration_types(spark).select("migration_type", "source_language", "target_language")
    return p.join(F.broadcast(mt), "migration_type", "left")
