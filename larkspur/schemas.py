"""Schemas of the store's tables, their keys, and the checks that a relational store would make (section 1.3 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_SIZE = 1024

# Columns and types of each table; ! marks what may not be null.
TABLES = {
    "projects": "id string!, slug string!, name string!, root_path string, constraints array<string>, tech_stack variant, lint_commands variant, test_commands variant, metadata variant, status string!, team string, compose_project string, archived_at timestamp, created_at timestamp",
    "raw_sessions": "id string!, project_id string, source_app string!, source_path string, source_hash string!, session_id string, model_used string, started_at timestamp, ended_at timestamp, message_count int, raw_content string, summary string, files_touched array<string>, created_at timestamp",
    "chunks": "id string!, project_id string, source_type string!, source_id string, source_line_start int, source_line_end int, content string!, embedding array<float>, token_count int, metadata variant, created_at timestamp",
    "decisions": "id string!, project_id string, title string!, context string, decision string!, rationale string, alternatives array<string>, status string, superseded_by string, created_at timestamp",
    "patterns": "id string!, project_id string, name string!, category string, description string, example_code string, files array<string>, tags array<string>, created_at timestamp",
    "issues": "id string!, project_id string, title string!, category string, description string, root_cause string, fix_applied string, prevention string, created_at timestamp",
    "codebase_index": "id string!, project_id string!, file_path string!, file_type string, summary string, imports array<string>, exports array<string>, embedding array<float>, last_commit string, last_indexed timestamp",
    "factory_jobs": "id string!, project_id string!, title string!, spec string, status string!, priority int, branch_name string, current_phase string, error_count int, max_retries int, assigned_cli string, metadata variant, submitted_by string, blocked_by_job_id string, blocked_resolution string, archived_at timestamp, created_at timestamp, updated_at timestamp",
    "factory_artifacts": "id string!, job_id string!, phase string!, artifact_type string!, content string!, model_used string, findings_count int, blocking_count int, warning_count int, metadata variant, created_at timestamp",
    "factory_cleanup_reports": "id string!, job_id string!, report_type string!, outcome string!, summary string, phases_traversed array<string>, artifacts_summary variant, time_elapsed_seconds int, created_at timestamp",
    "file_locks": "id string!, job_id string!, project_id string!, file_path string!, dev_id string, locked_at timestamp!, expires_at timestamp!",
    "devs": "id string!, dev_id string!, full_name string, channels array<struct<type:string,address:string>>, event_subscriptions array<string>",
    "notifications": "id string!, recipient_dev_id string!, job_id string, event_type string!, title string!, body string!, channels_attempted array<string>, channels_delivered array<string>, delivery_errors map<string,string>, sent_at timestamp!, metadata variant",
    "factory_runtime_state": "key string!, reasons array<string>, updated_at timestamp",
    "schema_migrations": "filename string!, applied_at timestamp!, checksum string",
    "memory": "id string!, project_id string!, kind string!, title string, content string!, embedding array<float>, strength decimal(38,18), hit_count int, last_hit timestamp, applies_when variant, provenance_id string, tier string!, archived_at timestamp, created_at timestamp!, updated_at timestamp!",
    "port_assignments": "id string!, project_id string!, host string!, purpose string!, port_start int!, port_end int!, notes string, assigned_at timestamp!, archived_at timestamp",
    "memory_dependencies": "id bigint!, from_memory_id string!, to_memory_id string!, edge_type string!, confidence float, created_at timestamp, created_by string, metadata variant",
    "memory_ledger": "seq bigint!, memory_id string!, operation string!, actor string!, project_slug string!, payload_hash string!, prev_hash string, row_hash string!, created_at timestamp",
}
# Members of the enumerations.
ENUMS = {
    ("projects", "status"): ["active", "inactive", "archived", "experimental"],
    ("memory", "kind"): ["chunk", "decision", "pattern", "issue", "session_summary"],
    ("memory", "tier"): ["memory", "lesson", "rule"],
    ("memory_ledger", "operation"): ["create", "update", "archive", "restore", "delete"],
}


def ddl(table: str) -> str:
    """The schema as Spark reads it."""
    return TABLES[table].replace("!", "")


def required(table: str) -> list[str]:
    import re

    return re.findall(r"(\w+) [^\s,]+!", TABLES[table])


def violations(df: DataFrame, table: str, vector_size: int = VECTOR_SIZE) -> DataFrame:
    """Rows of df that break a rule of the table, each with the rules' names in `broken`."""
    rules: dict[str, Column] = {f"{c} is null": F.col(c).isNull() for c in required(table) if c in df.columns}
    rules |= {f"{c} not in list": ~F.col(c).isin(values) for (t, c), values in ENUMS.items() if t == table and c in df.columns}
    if "embedding" in df.columns:
        rules[f"embedding not of {vector_size}"] = F.col("embedding").isNotNull() & (F.size("embedding") != vector_size)
    if table == "port_assignments":
        rules["range"] = ~((F.col("port_start") >= 1) & (F.col("port_start") <= F.col("port_end")) & (F.col("port_end") <= 65535))
    if table == "memory_dependencies":
        rules["self-loop"] = F.col("from_memory_id") == F.col("to_memory_id")
        rules["confidence"] = ~F.col("confidence").between(0, 1)
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("broken", found).filter(F.size("broken") > 0)


def pending_migrations(applied: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filename): files to apply, in order; and applied ones that are no longer there, to warn of."""
    a, d = applied.select("filename").distinct(), on_disk.select("filename").distinct()
    return d.join(a, "filename", "left_anti").orderBy("filename"), a.join(d, "filename", "left_anti")


def record_migration(applied: DataFrame, filename: str, checksum: str, as_of: Column) -> DataFrame:
    """applied with one more row, if it isn't there."""
    new = applied.sparkSession.range(1).select(F.lit(filename).alias("filename"), as_of.alias("applied_at"), F.lit(checksum).alias("checksum"))
    return applied.unionByName(new.join(applied.select("filename"), "filename", "left_anti"))


def merge_settings(base: dict, override: dict) -> dict:
    """A deep merge of nested settings; override wins."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merge_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
