"""Imports and captured changes over the driver's tables: registries, repeated keys, grown sessions, snapshots by digest; each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import merge, snapshots
from larkspur.plans.registry import query
from larkspur.sources import registry
from larkspur.sources.files import tables


@query("change_capture", "SELECT doc_id AS id, CASE doc_id % 101 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN 'archive' WHEN 3 THEN 'restore' ELSE 'update' END AS operation FROM documents WHERE doc_id % 101 < 5")
def change_capture(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots that differ in one row of twenty: buckets without such a row are not read."""
    (docs,) = tables(spark, d, "documents")
    k, moment = F.col("id") % 101, F.lit("2024-01-01").cast("timestamp")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    before = rows.filter(k != 0).withColumn("archived_at", F.when(k == 3, moment))
    after = rows.filter(k != 1).withColumn("archived_at", F.when(k == 2, moment)).withColumn("content", F.when(k == 4, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return snapshots.changes_between(snapshots.write_snapshot(before), snapshots.write_snapshot(after)).select("id", "operation")


def _registry(spark: SparkSession, d: str) -> registry.Registry:
    """Customers as projects, a document for each nation: of six kinds, by their keys."""
    (c,) = tables(spark, d, "customer")
    k = F.col("c_custkey")
    port = (3000 + k % 60000).cast("string")
    ported = F.concat(F.lit('{"name": "n'), k, F.lit('", "team": "t'), F.col("c_nationkey"), F.lit('", "ports": {"web": "'), port, F.lit("-"), (3005 + k % 60000).cast("string"), F.lit('", "db": '), port, F.lit("}}"))
    kinds = [ported, F.lit('{"status": " Archived "}'), F.lit('"text"'), F.lit('{"status": "lost", "ports": {"web": 80}}'), F.lit('{"ports": {"web": "9-1"}}'), F.lit('{"ports": []}')]
    config = F.element_at(F.array(*kinds), (k % 6 + 1).cast("int"))
    entry = F.concat(F.lit('"p'), k, F.lit('": '), config)
    documents = c.groupBy(F.concat(F.lit("r"), "c_nationkey").alias("path")).agg(F.concat(F.lit('{"projects": {'), F.array_join(F.collect_list(entry), ", "), F.lit("}}")).alias("value"))
    return registry.read_registry(documents)


_KINDS = "(SELECT *, c_custkey % 6 AS k, 'p' || c_custkey AS slug FROM customer)"


@query("registry_rows", f"SELECT slug, 'project' AS kind, concat_ws('|', CASE WHEN k = 0 THEN 'n' || c_custkey ELSE slug END, CASE WHEN k = 0 THEN 't' || c_nationkey END, CASE WHEN k = 1 THEN 'archived' ELSE 'active' END) AS told FROM {_KINDS} WHERE k NOT IN (2, 3) UNION ALL SELECT slug, 'port', 'web ' || (3000 + c_custkey % 60000) || '-' || (3005 + c_custkey % 60000) FROM {_KINDS} WHERE k = 0 UNION ALL SELECT slug, 'port', 'db ' || (3000 + c_custkey % 60000) FROM {_KINDS} WHERE k = 0 UNION ALL SELECT slug, 'skipped', slug || CASE k WHEN 2 THEN ': config is not a mapping' WHEN 3 THEN ': unknown status ''lost''' WHEN 4 THEN '/web: bad port spec ''9-1''' ELSE ': ports are not a mapping' END FROM {_KINDS} WHERE k >= 2")
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    found = _registry(spark, d)
    projects = found.projects.select("slug", F.lit("project").alias("kind"), F.concat_ws("|", "name", "team", "status").alias("told"))
    ports = found.ranges.select("slug", F.lit("port").alias("kind"), F.concat_ws(" ", "purpose", text.format_range(F.col("range_start"), F.col("range_end"))).alias("told"))
    skipped = found.skipped.select(F.regexp_extract("message", "^[^:/]*", 0).alias("slug"), F.lit("skipped").alias("kind"), F.col("message").alias("told"))
    return projects.unionByName(ports).unionByName(skipped)


@query("registry_import", f"SELECT count(*) FILTER (k NOT IN (2, 3) AND c_custkey % 5 <> 0) AS projects_created, count(*) FILTER (k NOT IN (2, 3) AND c_custkey % 5 = 0) AS projects_existing, 2 * count(*) FILTER (k = 0 AND c_custkey % 5 <> 0) + count(*) FILTER (k = 0 AND c_custkey % 5 = 0) AS ports_created, count(*) FILTER (k = 0 AND c_custkey % 5 = 0) AS ports_existing, count(*) FILTER (k >= 2) AS skipped FROM {_KINDS}")
def registry_import(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "customer")
    have = c.filter("c_custkey % 5 = 0").select(F.concat(F.lit("p"), "c_custkey").alias("slug"), F.lit("web").alias("purpose"), F.lit(1).alias("range_start"), F.lit(2).alias("range_end"))
    return registry.import_registry(_registry(spark, d), have.select("slug"), have)["counts"]


@query("get_or_create_repeated", "SELECT l_suppkey AS key, coalesce(e.id, min(l.id) OVER (PARTITION BY l_suppkey)) AS id, e.id IS NULL AND row_number() OVER (PARTITION BY l_suppkey ORDER BY l.id) = 1 AS created FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id FROM lineitem) l LEFT JOIN (SELECT s_suppkey, -s_suppkey AS id FROM supplier WHERE s_nationkey < 12) e ON l_suppkey = s_suppkey")
def get_or_create_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Every line asks for its supplier's row; suppliers of some nations are there already."""
    lines, s = tables(spark, d, "lineitem", "supplier")
    rows = lines.select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return merge.get_or_create(s.filter("s_nationkey < 12").select(F.col("s_suppkey").alias("key"), (-F.col("s_suppkey")).alias("id")), rows, ["key"])


@query("coalesce_update_repeated", "SELECT c_custkey, coalesce(n.v, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT user_id, arg_min(value, struct_pack(a := ts, b := event_id)) FILTER (value > 10) AS v FROM events GROUP BY 1) n ON user_id = c_custkey")
def coalesce_update_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Each customer takes the first value above 10 that its events have, if there is one."""
    c, e = tables(spark, d, "customer", "events")
    rows = e.select(F.col("user_id").alias("c_custkey"), F.when(F.col("value") > 10, F.col("value")).alias("balance"), "ts", "event_id")
    return merge.coalesce_update(c.select("c_custkey", F.col("c_acctbal").alias("balance")), rows, ["c_custkey"], ["balance"], ["ts", "event_id"])


_SESSIONS = "(SELECT conv_id, turn, text, md5(conv_id || '|' || turn || '|' || coalesce(text, '')) AS h FROM conversations)"


@query("grown_sessions", f"SELECT conv_id % 3 AS source_app, conv_id AS session_id, arg_max(h, struct_pack(a := turn, b := h)) AS content_hash, min(turn) AS started, arg_max(len(string_split(text, chr(10))), struct_pack(a := turn, b := h))::BIGINT AS n_children FROM {_SESSIONS} WHERE text IS NOT NULL GROUP BY 1, 2")
def grown_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each turn stands for its session's file as it was then: the first are in the store, all come again, and the last one counts. Lines are children."""
    (c,) = tables(spark, d, "conversations")
    content = F.md5(F.concat_ws("|", "conv_id", "turn", F.coalesce("text", F.lit(""))))
    versions = c.filter("text is not null").select((F.col("conv_id") % 3).alias("source_app"), F.col("conv_id").alias("session_id"), content.alias("content_hash"), F.col("turn").alias("started"), F.col("turn").alias("modified"), F.col("text").alias("value"))
    first = versions.groupBy("source_app", "session_id").agg(F.min_by(F.struct("content_hash", "started", "modified", "value"), F.struct("modified", "content_hash")).alias("v")).select("source_app", "session_id", "v.*")
    lines = lambda rows: rows.select("source_app", F.col("session_id").alias("source_id"), F.explode(F.split("value", "\n")).alias("content"))
    kept, children = merge.replace_grown(first, lines(first), versions, lines, F.col("modified"), keep=["started"])
    counts = children.groupBy("source_app", F.col("source_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return kept.join(counts, ["source_app", "session_id"]).select("source_app", "session_id", "content_hash", "started", "n_children")
