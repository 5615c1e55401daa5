"""The library's operators over the driver's tables, each with its DuckDB counterpart.

customer, orders and lineitem stand for projects, jobs and artifacts; documents for chunks and sessions, embeddings for memory vectors, events for
notifications and status logs, conversations for session messages, pages for code files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import findings, text, vectors
from larkspur.operators import chunking, context, jobs, ledger, merge, ports, search, vector_index
from larkspur.plans.registry import ORACLES, query
from larkspur.sources.files import tables

AS_OF = "2000-01-01"
ACTIVE = ["queued", "implementing", "reviewing"]


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def _query_vector(e: DataFrame) -> list[float]:
    return e.filter("vec_id = 0").select("embedding").first()[0]


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    (o,) = tables(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "approved").otherwise("implementing")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("archived_at"), F.col("o_totalprice").alias("price"))


JOBS = "(SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'approved' ELSE 'implementing' END AS status, substr(o_orderpriority, 1, 1)::INT AS priority, o_orderdate AS created_at, o_totalprice AS price FROM orders)"

# lineitem as artifacts: the ship date orders them, and all columns break ties, as (orderkey, linenumber) isn't a key
TIES = "lpad(l_linenumber::VARCHAR, 4, '0') || '|' || lpad(l_partkey::VARCHAR, 10, '0') || '|' || lpad(l_suppkey::VARCHAR, 10, '0') || '|' || lpad((l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0') || '|' || l_returnflag || '|' || lpad(l_quantity::BIGINT::VARCHAR, 4, '0')"
ARTIFACTS = f"(SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'reviewing' WHEN 'R' THEN 'fix_loop' ELSE 'planning' END AS phase, CASE l_linestatus WHEN 'O' THEN 'arch_review' ELSE 'plan_doc' END AS artifact_type, (l_quantity % 5)::INT AS findings_count, (l_quantity % 3)::INT AS blocking_count, l_shipdate AS created_at, {TIES} AS id FROM lineitem)"


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as artifacts; their id is a struct that orders as TIES does (see _told)."""
    (li,) = tables(spark, d, "lineitem")
    ident = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_returnflag", F.col("l_quantity").cast("long").alias("quantity"))
    phase = F.when(F.col("l_returnflag") == "A", "reviewing").when(F.col("l_returnflag") == "R", "fix_loop").otherwise("planning")
    return li.select(F.col("l_orderkey").alias("job_id"), phase.alias("phase"), F.when(F.col("l_linestatus") == "O", "arch_review").otherwise("plan_doc").alias("artifact_type"), (F.col("l_quantity") % 5).cast("int").alias("findings_count"), (F.col("l_quantity") % 3).cast("int").alias("blocking_count"), F.col("l_shipdate").alias("created_at"), ident.alias("id"))


def _told(artifacts: DataFrame) -> DataFrame:
    """artifacts with the id as a string."""
    pad = lambda c, n: F.lpad(F.col(f"id.{c}").cast("string"), n, "0")
    return artifacts.withColumn("id", F.concat_ws("|", pad("l_linenumber", 4), pad("l_partkey", 10), pad("l_suppkey", 10), pad("cents", 14), F.col("id.l_returnflag"), pad("quantity", 4)))


COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query("vector_topk", f"SELECT vec_id AS id, round({COSINE}, 4) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    best = search.vector_top_k(e.select(F.col("vec_id").alias("id"), "embedding"), _query_vector(e), 10)
    return best.select("id", F.round("score", 4).alias("score"))


@query("vector_topk_filtered", f"SELECT e.vec_id AS id, coalesce(l.quality, -1) AS quality, round({COSINE}, 4) AS score FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id AND e.label < 5 WHERE e.label IN (1, 2, 3, 7) AND (e.label >= 5 OR l.quality = 1) ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e, lab = tables(spark, d, "embeddings", "labels")
    rows = e.join(lab, (lab["doc_id"] == e["vec_id"]) & (e["label"] < 5), "left").filter(F.col("label").isin(1, 2, 3, 7) & ((F.col("label") >= 5) | (F.col("quality") == 1)))
    return search.vector_top_k(rows.select(F.col("vec_id").alias("id"), "quality", "embedding"), _query_vector(e), 20).select("id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.round("score", 4).alias("score"))


@query("search_two_branch_merge", f"SELECT * FROM (SELECT vec_id AS id, 'memory' AS kind, round({COSINE}, 4) AS score FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, 'codebase', round({COSINE}, 4) FROM embeddings WHERE label >= 5) ORDER BY score DESC, id LIMIT 15")
def search_two_branch_merge(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    branch = lambda c, k: e.filter(c).select(F.col("vec_id").alias("id"), F.lit(k).alias("kind"), "embedding")
    both = branch("label < 5", "memory").unionByName(branch("label >= 5", "codebase"))
    score = F.round(vectors.cosine(F.col("embedding"), F.lit([float(x) for x in _query_vector(e)])), 4)
    return search.top_k(both, score, "id", 15).select("id", "kind", "score")


@query("vector_join_topk", "SELECT query_id, rank, id, round(s, 4) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id)::INT AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def vector_join_topk(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.vector_join_top_k(asked, rows, 5).withColumn("score", F.round("score", 4))


@query("vector_index_topk", ORACLES["vector_topk"])
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    index = vector_index.build_vector_index(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return index.search(_query_vector(e), 10).select("id", F.round("score", 4).alias("score"))


@query("vector_index_join_topk", ORACLES["vector_join_topk"])
def vector_index_join_topk(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vector_index.build_vector_index(rows.filter("id % 5 <> 0"))
    index.add(rows.filter("id % 5 = 0"))  # what came after the centres were fitted
    return index.join(rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 5).withColumn("score", F.round("score", 4))


DEEP = f"""WITH s AS (SELECT e.vec_id, e.label, {COSINE} AS s, len(string_split(d.text, chr(10)))::INT AS n, d.doc_id FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id AND e.label < 4)
SELECT vec_id::VARCHAR AS id, CASE WHEN label < 4 THEN 'chunk' WHEN label < 6 THEN 'decision' WHEN label < 8 THEN 'pattern' ELSE 'codebase' END AS kind, round(s, 4) AS score,
CASE WHEN doc_id IS NOT NULL THEN 'session_' || substr(vec_id::VARCHAR, 1, 8) || ':1-3' ELSE CASE WHEN label < 4 THEN 'chunk' WHEN label < 6 THEN 'decision' WHEN label < 8 THEN 'pattern' ELSE 'codebase' END || '_' || substr(vec_id::VARCHAR, 1, 8) || ':?-?' END AS reference,
CASE WHEN doc_id IS NULL THEN 0 ELSE 1 END AS first_line, CASE WHEN n IS NULL THEN 0 ELSE least(n, 5) END AS last_line, coalesce(n, 0) AS lines FROM s ORDER BY s DESC, vec_id::VARCHAR LIMIT 20"""


@query("deep_search", DEEP)
def deep_search(spark: SparkSession, d: str) -> DataFrame:
    e, docs = tables(spark, d, "embeddings", "documents")
    kind = F.when(F.col("label") < 4, "chunk").when(F.col("label") < 6, "decision").otherwise("pattern")
    memory = e.filter("label < 8").select(F.col("vec_id").cast("string").alias("id"), F.lit("p").alias("project_id"), kind.alias("kind"), F.concat(F.lit("t"), "vec_id").alias("title"), F.lit("").alias("content"), "embedding", F.col("vec_id").cast("string").alias("provenance_id"), F.lit(None).cast("timestamp").alias("archived_at"))
    code = e.filter("label >= 8").select(F.col("vec_id").cast("string").alias("id"), F.lit("p").alias("project_id"), F.concat(F.lit("f"), "vec_id").alias("file_path"), F.lit("").alias("summary"), "embedding")
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("session").alias("source_type"), F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("source_line_start"), F.lit(3).alias("source_line_end"))
    sessions = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    out = search.deep_search(memory, chunks, code, sessions, _query_vector(e), 20, depth="full", around=2)
    return out.select("id", "kind", "score", "reference", *[F.coalesce(f"context.{c}", F.lit(0)).alias(n) for c, n in (("first", "first_line"), ("last", "last_line"), ("total", "lines"))])


@query("drilldown_window", "SELECT doc_id, greatest(0, 3 - 2) + 1 AS first_line, least(len(l), 5 + 2)::INT AS last_line, len(l)::INT AS lines, array_to_string(l[2:least(len(l), 7)], chr(10)) AS body, source || '_' || substr(doc_id::VARCHAR, 1, 8) || ':3-?' AS reference FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 3")
def drilldown_window(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    w = text.line_window(F.col("text"), F.lit(3), F.lit(5), 2)
    out = docs.withColumn("w", w).filter("w.total >= 3")
    return out.select("doc_id", F.col("w.first").alias("first_line"), F.col("w.last").alias("last_line"), F.col("w.total").alias("lines"), F.col("w.text").alias("body"), text.source_reference(F.col("source"), F.col("doc_id"), F.lit(3), F.lit(None)).alias("reference"))


@query("project_context_recent", f"SELECT project_id, id, rank FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id)::INT AS rank FROM {JOBS}) WHERE rank <= 3")
def project_context_recent(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id")
    return context.recent(_jobs(spark, d), 3, "created_at", ["project_id"]).select("project_id", "id", F.row_number().over(w).alias("rank"))


@query("context_json", f"SELECT project_id, '[' || string_agg('{{\"id\":' || id || ',\"status\":\"' || status || '\"}}', ',' ORDER BY n) || ']' AS items FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n FROM {JOBS}) WHERE n <= 3 GROUP BY project_id")
def context_json(spark: SparkSession, d: str) -> DataFrame:
    return context.context_json(_jobs(spark, d), "project_id", "created_at", ["id", "status"])


@query("storage_counts", "SELECT 'memory:' || CASE WHEN label < 5 THEN 'chunk' ELSE 'decision' END AS name, count(*) AS n FROM embeddings GROUP BY 1 UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labels', count(*) FROM labels")
def storage_counts(spark: SparkSession, d: str) -> DataFrame:
    e, docs, lab = tables(spark, d, "embeddings", "documents", "labels")
    return context.storage_counts(e.select(F.when(F.col("label") < 5, "chunk").otherwise("decision").alias("kind")), documents=docs, labels=lab)


@query("project_list_filter_count", f"SELECT c_custkey AS id, c_name AS name, count(j.id) FILTER (WHERE j.status <> 'approved') AS live_count FROM customer LEFT JOIN {JOBS} j ON j.project_id = c_custkey WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') GROUP BY 1, 2")
def project_list_filter_count(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "customer")
    c = jobs.matching(c, c_mktsegment=["BUILDING", "HOUSEHOLD"], c_name=None)
    projects = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return context.list_with_counts(projects, _jobs(spark, d).drop("id"), "project_id", F.col("status") != "approved")


@query("job_queue_order", f"SELECT id, name, rank FROM (SELECT j.id, c_name AS name, row_number() OVER (ORDER BY priority DESC, created_at, j.id)::INT AS rank FROM {JOBS} j JOIN customer ON c_custkey = project_id WHERE status = 'queued') WHERE rank <= 50")
def job_queue_order(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "customer")
    first = jobs.queue_order(jobs.matching(_jobs(spark, d), status="queued").join(c, F.col("project_id") == F.col("c_custkey"))).limit(50)
    return first.select("id", F.col("c_name").alias("name"), F.row_number().over(Window.orderBy(F.desc("priority"), "created_at", "id")).alias("rank"))


@query("nulls_last_order", "SELECT doc_id, coalesce(quality, -1) AS quality, rank FROM (SELECT d.doc_id, l.quality, row_number() OVER (ORDER BY lang, quality ASC NULLS LAST, d.doc_id)::INT AS rank FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE rank <= 100")
def nulls_last_order(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    order = [F.col("lang"), F.asc_nulls_last("quality"), F.col("doc_id")]
    return docs.join(lab, "doc_id", "left").orderBy(*order).limit(100).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("unsummarised_nulls_first", "SELECT doc_id, coalesce(quality, -1) AS quality, rank FROM (SELECT d.doc_id, l.quality, row_number() OVER (ORDER BY quality DESC NULLS FIRST, d.doc_id)::INT AS rank FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE rank <= 30")
def unsummarised_nulls_first(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    order = [F.desc_nulls_first("quality"), F.col("doc_id")]
    return docs.join(lab, "doc_id", "left").orderBy(*order).limit(30).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("active_vs_completed", f"SELECT project_id, count(*) FILTER (WHERE status IN ('queued', 'implementing', 'reviewing')) AS active, count(*) FILTER (WHERE status = 'approved' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 8760 HOUR) AS completed FROM {JOBS} GROUP BY 1")
def active_vs_completed(spark: SparkSession, d: str) -> DataFrame:
    recent = jobs.since(F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz"), 8760)
    return _jobs(spark, d).groupBy("project_id").agg(F.count_if(F.col("status").isin(ACTIVE)).alias("active"), F.count_if((F.col("status") == "approved") & recent).alias("completed"))


@query("recent_events_summary", f"SELECT a.job_id, c_name AS project, a.phase, CASE WHEN artifact_type = 'arch_review' THEN 'arch_review: ' || blocking_count || ' blocking, ' || (findings_count - blocking_count) || ' other findings' ELSE 'planning complete' END AS summary, strftime(a.created_at, '%Y-%m-%d') AS day FROM {ARTIFACTS} a JOIN {JOBS} j ON j.id = a.job_id JOIN customer ON c_custkey = j.project_id ORDER BY a.created_at DESC, a.job_id, a.id LIMIT 30")
def recent_events_summary(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "customer")
    a, j = _artifacts(spark, d), _jobs(spark, d).select(F.col("id").alias("j"), "project_id")
    rows = a.join(j, F.col("job_id") == F.col("j")).join(c, F.col("project_id") == F.col("c_custkey"))
    rows = rows.orderBy(F.desc("created_at"), "job_id", "id").limit(30)
    return rows.select("job_id", F.col("c_name").alias("project"), "phase", text.event_summary(F.col("artifact_type"), F.col("findings_count"), F.col("blocking_count")).alias("summary"), _day("created_at").alias("day"))


@query("job_artifact_summary", f"SELECT job_id, phase, count(*) AS n, sum(sum(findings_count)) OVER (PARTITION BY job_id)::BIGINT AS total_findings, sum(sum(blocking_count)) OVER (PARTITION BY job_id)::BIGINT AS total_blocking, row_number() OVER (PARTITION BY job_id ORDER BY min(struct_pack(a := created_at, b := id)))::INT AS place FROM {ARTIFACTS} GROUP BY job_id, phase")
def job_artifact_summary(spark: SparkSession, d: str) -> DataFrame:
    s = jobs.phase_counts(_artifacts(spark, d))
    out = s.select("job_id", F.posexplode("phases").alias("place", "phase"), "phase_counts", "total_findings", "total_blocking")
    return out.select("job_id", "phase", F.try_element_at("phase_counts", "phase").alias("n"), "total_findings", "total_blocking", (F.col("place") + 1).alias("place"))


@query("failure_category", f"SELECT job_id, CASE WHEN b > 0 AND f > 0 THEN 'qa_failure' WHEN b > 0 THEN 'persistent_blocking' ELSE 'unknown' END AS category, b AS blocking, f AS fix_attempts FROM (SELECT job_id, coalesce(sum(blocking_count) FILTER (WHERE phase = 'reviewing'), 0)::BIGINT AS b, count(*) FILTER (WHERE phase = 'fix_loop') AS f FROM {ARTIFACTS} GROUP BY 1)")
def failure_category(spark: SparkSession, d: str) -> DataFrame:
    return jobs.failure_category(_artifacts(spark, d))


@query("fix_convergence", f"SELECT j.job_id, coalesce(n >= 2 AND l < f, false) AS converging FROM (SELECT DISTINCT job_id FROM {ARTIFACTS}) j LEFT JOIN (SELECT job_id, count(*) AS n, arg_min(blocking_count, struct_pack(a := created_at, b := id)) AS f, arg_max(blocking_count, struct_pack(a := created_at, b := id)) AS l FROM {ARTIFACTS} WHERE phase = 'reviewing' AND blocking_count > 0 GROUP BY 1) r USING (job_id)")
def fix_convergence(spark: SparkSession, d: str) -> DataFrame:
    return jobs.fix_convergence(_artifacts(spark, d))


@query("check_reduction", "SELECT l_orderkey AS job_id, bool_and(l_discount < 0.09) AS passed, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FILTER (WHERE l_discount >= 0.09), '') AS failing FROM lineitem GROUP BY 1")
def check_reduction(spark: SparkSession, d: str) -> DataFrame:
    (li,) = tables(spark, d, "lineitem")
    checks = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("name"), (F.col("l_discount") < 0.09).alias("ok"))
    return jobs.reduce_checks(checks).withColumn("failing", F.array_join("failing", ","))


@query("blocked_recommendation", f"SELECT l_partkey AS job_id, CASE WHEN bool_or(status IN ('queued', 'implementing')) THEN 'wait' WHEN bool_or(status = 'approved') THEN 'replan' ELSE 'proceed' END AS recommendation FROM lineitem LEFT JOIN {JOBS} j ON j.id = l_orderkey GROUP BY 1")
def blocked_recommendation(spark: SparkSession, d: str) -> DataFrame:
    (li,) = tables(spark, d, "lineitem")
    conflicts = li.select(F.col("l_partkey").alias("job_id"), F.col("l_orderkey").alias("blocking_job_id"))
    return jobs.blocked_recommendation(conflicts, _jobs(spark, d))


@query("review_gate", f"WITH r AS (SELECT job_id, month(created_at) AS round, sum(blocking_count) AS b, sum(findings_count) AS w, bool_or(blocking_count + findings_count = 0 AND artifact_type = 'arch_review') AS silent, max(CASE WHEN phase = 'fix_loop' THEN 1 ELSE 0 END) AS e, bool_or(findings_count = 4) AS rep FROM {ARTIFACTS} GROUP BY 1, 2) SELECT job_id, round::INT AS round, CASE WHEN b = 0 AND w > 0 AND e >= 1 AND rep THEN 'failed' WHEN b > 0 OR w > 0 OR silent THEN 'fix_loop' ELSE 'qa' END AS next_status, CASE WHEN b = 0 AND w > 0 AND e >= 1 AND rep THEN 'warning_oscillation' WHEN b > 0 THEN 'blocking' WHEN w > 0 THEN 'warnings' WHEN silent THEN 'malformed_review' ELSE 'clean' END AS reason FROM r")
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    a = _artifacts(spark, d)
    r = a.select("job_id", F.month("created_at").alias("round"), "blocking_count", F.col("findings_count").alias("warning_count"), (F.col("artifact_type") == "arch_review").alias("malformed_multiple"), F.when(F.col("phase") == "fix_loop", 1).otherwise(0).alias("error_count"), (F.col("findings_count") == 4).alias("repeating"))
    return jobs.review_gate(r, True)


@query("notification_history", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('error', 'click') AND ts >= TIMESTAMP '2024-01-15' - INTERVAL 72 HOUR ORDER BY ts DESC, event_id LIMIT 40")
def notification_history(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    rows = jobs.matching(e, event_type=["error", "click"], user_id=None).filter(jobs.since(F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz"), 72))
    return rows.orderBy(F.desc("ts"), "event_id").limit(40).select("event_id", "user_id", "event_type", _day("ts").alias("day"))


@query("json_field_filter", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT BETWEEN 10 AND 19")
def json_field_filter(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).filter("k between 10 and 19")


@query("json_merge", "SELECT event_id, (json_extract_string(props, '$.k')::BIGINT + 1) AS k, event_type AS kind FROM events")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") + 1
    merged = F.try_parse_json(text.merge_json(F.col("props"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind")))))
    return e.select("event_id", F.try_variant_get(merged, "$.k", "bigint").alias("k"), F.try_variant_get(merged, "$.kind", "string").alias("kind"))


@query("duration_parse", "SELECT event_id, coalesce(CASE substr(s, len(s)) WHEN 'h' THEN 1 WHEN 'd' THEN 24 WHEN 'w' THEN 168 WHEN 'm' THEN 720 END * substr(s, 1, len(s) - 1)::INT, -1) AS hours FROM (SELECT event_id, (event_id % 50) || substr('hdwmx', (event_id % 5 + 1)::INT, 1) AS s FROM events)")
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    spec = F.concat((F.col("event_id") % 50).cast("string"), F.substring(F.lit("hdwmx"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1)))
    return e.select("event_id", F.coalesce(text.duration_hours(spec), F.lit(-1)).alias("hours"))


@query("age_format", "SELECT event_id, CASE WHEN s IS NULL THEN '?' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age, CASE WHEN s IS NULL THEN '?' WHEN s < 60 THEN greatest(s, 0) || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END AS long_age FROM (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN floor(epoch(TIMESTAMP '2024-03-01' - ts))::BIGINT END AS s FROM events)")
def age_format(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    as_of = F.lit("2024-03-01").cast("timestamp")
    ts = F.when(F.col("event_id") % 10 > 0, F.col("ts").cast("timestamp"))
    return e.select("event_id", text.age(ts, as_of).alias("age"), text.age(ts, as_of, True).alias("long_age"))


@query("id_prefix_lookup", "SELECT min(o_orderkey) AS id FROM orders WHERE starts_with(o_orderkey::VARCHAR, '42')")
def id_prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    (o,) = tables(spark, d, "orders")
    return o.filter(F.startswith(F.col("o_orderkey").cast("string"), F.lit("42"))).orderBy("o_orderkey").limit(1).select(F.col("o_orderkey").alias("id"))


@query("insert_ignore_plan", "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 2")
def insert_ignore_plan(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    rows = docs.select("doc_id", F.md5("text").alias("key"))
    return merge.insert_ignore(rows.join(lab.select("doc_id"), "doc_id", "left_semi"), rows, ["key"], [F.col("doc_id")])


@query("get_or_create", "SELECT d.doc_id AS key, coalesce(l.doc_id + 1000000, d.doc_id) AS id, l.doc_id IS NULL AS created FROM documents d LEFT JOIN labels l USING (doc_id)")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    target = lab.select(F.col("doc_id").alias("key"), (F.col("doc_id") + 1000000).alias("id"))
    return merge.get_or_create(target, docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("id")), ["key"])


@query("backfill_dry_run", "SELECT 'documents' AS name, count(*) AS scanned, count(*) FILTER (WHERE source = 'src7') AS skipped_no_project, count(*) FILTER (WHERE source <> 'src7' AND n_chars < 200) AS skipped_invalid, count(*) FILTER (WHERE source <> 'src7' AND n_chars >= 200 AND l.doc_id IS NULL) AS would_insert, count(*) FILTER (WHERE source <> 'src7' AND n_chars >= 200 AND l.doc_id IS NOT NULL) AS already FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (WHERE source = 'src7'), count(*) FILTER (WHERE source <> 'src7' AND n_chars < 200), count(*) FILTER (WHERE source <> 'src7' AND n_chars >= 200 AND l.doc_id IS NULL), count(*) FILTER (WHERE source <> 'src7' AND n_chars >= 200 AND l.doc_id IS NOT NULL) FROM documents d LEFT JOIN labels l USING (doc_id)")
def backfill_dry_run(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("source") != "src7", F.col("source")).alias("project_id"), "n_chars")
    memory = lab.select(F.col("doc_id").alias("provenance_id"), F.lit("chunk").alias("kind"))
    counts = merge.backfill_counts(rows, memory, "chunk", F.col("n_chars") >= 200).withColumn("name", F.lit("documents"))
    return merge.with_total(counts, "name")


@query("upsert_latest_wins", "SELECT c_custkey AS user_id, coalesce(e.value, c_acctbal) AS value FROM customer LEFT JOIN (SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1) e ON e.user_id = c_custkey UNION ALL SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    c, e = tables(spark, d, "customer", "events")
    target = c.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return merge.upsert(target, e.select("user_id", "value", "ts", "event_id"), ["user_id"], F.struct("ts", "event_id"))


@query("coalesce_merge", "SELECT d.doc_id, coalesce(l.quality, d.n_chars % 7) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    target = docs.select("doc_id", (F.col("n_chars") % 7).alias("quality"))
    return merge.coalesce_update(target, lab.select("doc_id", "quality"), ["doc_id"], ["quality"])


@query("latest_row_per_key", "SELECT user_id, max(event_id) FILTER (WHERE n = 1) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') GROUP BY 1")
def latest_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    return context.latest_per_key(e.filter("event_type = 'error'").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("orphan_inherit", "SELECT d.doc_id, CASE WHEN d.source IN ('src1', 'src2') THEN 'label' || l.quality ELSE d.source END AS project_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def orphan_inherit(spark: SparkSession, d: str) -> DataFrame:
    docs, lab = tables(spark, d, "documents", "labels")
    chunks = docs.select("doc_id", F.col("doc_id").alias("source_id"), F.when(~F.col("source").isin("src1", "src2"), F.col("source")).alias("project_id"))
    return context.inherit_project(chunks, lab.select(F.col("doc_id").alias("id"), F.concat(F.lit("label"), F.col("quality")).alias("project_id"))).select("doc_id", "project_id")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query("prefix_attribution", "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1) AS path FROM pages), r AS (SELECT DISTINCT '/' || " + HOST + " AS root FROM pages WHERE page_id % 2 = 0 UNION SELECT DISTINCT '/' || " + HOST + " || '/en' FROM pages) SELECT page_id, path, arg_max(root, len(root)) AS slug FROM p LEFT JOIN r ON rtrim(path, '/') = root OR starts_with(path, root || '/') GROUP BY ALL")
def prefix_attribution(spark: SparkSession, d: str) -> DataFrame:
    (p,) = tables(spark, d, "pages")
    paths = p.select("page_id", F.regexp_extract("url", "^[a-z]+:/(/[^?#]*)", 1).alias("path"))
    host = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    roots = p.filter("page_id % 2 = 0").select(host.alias("root")).union(p.select(F.concat(host, F.lit("/en")))).distinct().withColumn("slug", F.col("root"))
    return context.longest_prefix(paths, roots)


@query("prefix_attribution_unbounded", "WITH p AS (SELECT page_id, " + HOST + " AS path FROM pages), r AS (SELECT DISTINCT substr(" + HOST + ", 1, (3 + page_id % 5)::INT) AS root FROM pages WHERE page_id % 3 = 0) SELECT page_id, path, arg_max(root, len(root)) AS slug FROM p LEFT JOIN r ON starts_with(path, root) GROUP BY ALL")
def prefix_attribution_unbounded(spark: SparkSession, d: str) -> DataFrame:
    (p,) = tables(spark, d, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    roots = p.filter("page_id % 3 = 0").select(F.substring(host, F.lit(1), (3 + F.col("page_id") % 5).cast("int")).alias("root")).distinct().withColumn("slug", F.col("root"))
    return context.longest_prefix(p.select("page_id", host.alias("path")), roots, boundary=False)


@query("orphan_counts", "WITH p AS (SELECT page_id, " + HOST + " AS h FROM pages), r AS (SELECT DISTINCT h FROM p WHERE page_id % 2 = 0) SELECT CASE WHEN page_id % 10 = 0 THEN 'kept' WHEN r.h IS NOT NULL THEN 'attributed' ELSE 'unrecoverable' END AS outcome, count(*) AS n FROM p LEFT JOIN r USING (h) GROUP BY 1")
def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    (p,) = tables(spark, d, "pages")
    host = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    roots = p.filter("page_id % 2 = 0").select(host.alias("root")).distinct().withColumn("slug", F.col("root"))
    rows = p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 == 0, "x").alias("project"), F.concat(host, F.lit("/a")).alias("path"))
    return context.attribute_orphans(rows, roots).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("semi_terminal", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def semi_terminal(spark: SparkSession, d: str) -> DataFrame:
    li, o = tables(spark, d, "lineitem", "orders")
    return li.join(o.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("anti_live", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def anti_live(spark: SparkSession, d: str) -> DataFrame:
    li, o = tables(spark, d, "lineitem", "orders")
    keys = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return merge.delete_where_in(li, keys, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("conflict_join", "SELECT r.l_orderkey AS job_id, r.l_partkey::VARCHAR AS file_path, o.l_orderkey AS owner_job_id FROM lineitem r JOIN lineitem o ON o.l_partkey = r.l_partkey AND o.l_orderkey <> r.l_orderkey AND o.l_shipdate >= TIMESTAMP '2001-10-20' WHERE r.l_shipdate < TIMESTAMP '2001-10-20'")
def conflict_join(spark: SparkSession, d: str) -> DataFrame:
    requests, locks = _lock_rows(spark, d)
    return context.lock_conflicts(requests, locks, F.lit("2001-10-20").cast("timestamp_ntz"))


def _lock_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines shipped from 20 October 2001 on hold their part for their order, all others ask for theirs."""
    (li,) = tables(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("job_id"), F.lit("p").alias("project_id"), F.col("l_partkey").cast("string").alias("file_path"), F.col("l_shipdate").alias("expires_at"))
    since = F.col("expires_at") >= F.lit("2001-10-20").cast("timestamp_ntz")
    return rows.filter(~since).drop("expires_at"), rows.filter(since)


RANGES = "(SELECT p_partkey AS id, p_brand AS host, (3000 + p_partkey * 37 % 4000)::INT AS range_start, (3000 + p_partkey * 37 % 4000 + p_size % 40)::INT AS range_end FROM part)"


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    (p,) = tables(spark, d, "part")
    start = (3000 + F.col("p_partkey") * 37 % 4000).cast("int")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("host"), start.alias("range_start"), (start + F.col("p_size") % 40).alias("range_end"))


@query("range_overlap", f"SELECT a.host, a.id AS left_id, b.id AS right_id FROM {RANGES} a JOIN {RANGES} b ON a.host = b.host AND a.range_start <= b.range_end AND b.range_start <= a.range_end AND a.id < b.id")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    r = _ranges(spark, d)
    return ports.overlap_join(r, r, "host").filter("left_id < right_id")


@query("range_containment", f"SELECT host, count(*) AS n FROM {RANGES} WHERE range_start <= 3500 AND range_end >= 3505 GROUP BY 1")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    return ports.covering(_ranges(spark, d), 3500, 3505).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("first_free_range", f"WITH r AS (SELECT *, greatest(3000, coalesce(max(range_end) OVER (PARTITION BY host ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 3000)) AS at_ FROM {RANGES} WHERE range_end >= 3000), s AS (SELECT host, min(at_) FILTER (WHERE at_ + 49 < range_start) AS gap, max(range_end) + 1 AS tail FROM r GROUP BY 1) SELECT host, coalesce(gap, CASE WHEN tail + 49 <= 65535 THEN tail END)::INT AS range_start, (coalesce(gap, CASE WHEN tail + 49 <= 65535 THEN tail END) + 49)::INT AS range_end FROM s WHERE coalesce(gap, CASE WHEN tail + 49 <= 65535 THEN tail END) IS NOT NULL")
def first_free_range(spark: SparkSession, d: str) -> DataFrame:
    return ports.first_free(_ranges(spark, d), 3000, 50)


LOG = "(SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'planning' WHEN 'view' THEN 'implementing' WHEN 'purchase' THEN 'reviewing' ELSE 'queued' END AS status FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    t = F.col("event_type")
    status = F.when(t == "error", "failed").when(t == "click", "planning").when(t == "view", "implementing").when(t == "purchase", "reviewing").otherwise("queued")
    return e.select(F.col("user_id").alias("job_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), status.alias("status"))


@query("transition_validate", f"SELECT job_id, seq, status, before FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM {LOG}) WHERE before IS NOT NULL AND NOT ((before = 'queued' AND status = 'planning') OR (before = 'planning' AND status IN ('implementing', 'failed')) OR (before = 'implementing' AND status IN ('reviewing', 'failed')) OR (before = 'reviewing' AND status = 'failed') OR (before = 'failed' AND status = 'queued'))")
def transition_validate(spark: SparkSession, d: str) -> DataFrame:
    return jobs.illegal_transitions(_log(spark, d))


@query("last_round_window", f"SELECT job_id, id, blocking_count FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS n, count(*) OVER (PARTITION BY job_id) AS c FROM {ARTIFACTS} WHERE phase = 'reviewing') WHERE n IN (3, 4) AND c >= 4")
def last_round_window(spark: SparkSession, d: str) -> DataFrame:
    return _told(jobs.last_round(_artifacts(spark, d))).select("job_id", "id", "blocking_count")


@query("since_marker", f"SELECT a.job_id, a.id FROM {ARTIFACTS} a LEFT JOIN (SELECT job_id, max(struct_pack(a := created_at, b := id)) AS m FROM {ARTIFACTS} WHERE phase = 'fix_loop' GROUP BY 1) f USING (job_id) WHERE m IS NULL OR struct_pack(a := a.created_at, b := a.id) >= m")
def since_marker(spark: SparkSession, d: str) -> DataFrame:
    return _told(jobs.since_marker(_artifacts(spark, d), jobs.FIXES)).select("job_id", "id")


REVIEW = "('- BLOCKING → rubric' || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: chr(10) || CASE WHEN i % 2 = 1 THEN '1. **BLOCKING:** ' ELSE '- WARNING — ' END || x), '') || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'BLOCKING: again' ELSE '' END)"


def _review(docs: DataFrame) -> DataFrame:
    """A review with a finding for every line of a text, blocking and warning by turns."""
    line = lambda x, i: F.concat(F.when(i % 2 == 0, "\n1. **BLOCKING:** ").otherwise("\n- WARNING — "), x)
    more = F.when(F.col("doc_id") % 3 == 0, "\nBLOCKING: again").otherwise("")
    return docs.select("doc_id", F.concat(F.lit("- BLOCKING → rubric"), F.array_join(F.transform(F.split("text", "\n", -1), line), ""), more).alias("review"))


@query("marker_count", f"SELECT doc_id, len(regexp_extract_all(regexp_replace(r, 'BLOCKING →', '', 'g'), '(?i)(?:^|\\n)\\s*(?:(?:\\d+\\.\\s*|\\*\\*?|-\\s*)\\s*){{0,4}}BLOCKING\\b'))::INT AS blocking, len(regexp_extract_all(r, '(?i)(?:^|\\n)\\s*(?:(?:\\d+\\.\\s*|\\*\\*?|-\\s*)\\s*){{0,4}}WARNING\\b'))::INT AS warnings, ((len(r) - len(replace(r, chr(10) || '- ', ''))) / 3 + (len(r) - len(replace(r, chr(10) || '1.', ''))) / 3)::INT AS bullets FROM (SELECT doc_id, {REVIEW} AS r FROM documents)")
def marker_count(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    r = _review(docs)
    return r.select("doc_id", findings.count_severity(F.col("review"), "BLOCKING").alias("blocking"), findings.count_severity(F.col("review"), "WARNING").alias("warnings"), text.bullet_findings(F.col("review")).alias("bullets"))


@query("marker_items", "SELECT doc_id, ((i - 1) // 2)::INT AS place, regexp_replace('** ' || l[i], '^\\s+|\\s+$', '', 'g') AS item FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1, 2)) AS i FROM documents) UNION ALL SELECT doc_id, ((len(string_split(text, chr(10))) + 1) // 2)::INT, 'again' FROM documents WHERE doc_id % 3 = 0")
def marker_items(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    return _review(docs).select("doc_id", F.posexplode(findings.severity_items(F.col("review"), "BLOCKING")).alias("place", "item"))


SIGNATURE = "CASE WHEN regexp_matches(line, '\\S') THEN substr(regexp_replace(regexp_replace(lower(line), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), 1, 80) ELSE '__empty__' END"


@query("signatures_overlap", f"WITH s AS (SELECT DISTINCT doc_id, {SIGNATURE} AS sig FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT DISTINCT doc_id FROM s WHERE sig IN (SELECT sig FROM s WHERE sig <> '__empty__' GROUP BY sig HAVING count(*) > 1)")
def signatures_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which a line, as a finding, has the signature of a line of another document."""
    (docs,) = tables(spark, d, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("doc_id", F.explode(findings.signatures(F.lit(None).cast("string"), F.col("line"))).alias("sig")).filter(F.col("sig") != findings.EMPTY_SIGNATURE).distinct()
    shared = lines.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sig")
    return lines.join(shared, "sig", "left_semi").select("doc_id").distinct()


@query("repeated_findings", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT *, {SIGNATURE} AS sig FROM l), hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sig ORDER BY i) AS n FROM s WHERE i % 2 = 1 AND EXISTS (SELECT 1 FROM s p WHERE p.doc_id = s.doc_id AND p.sig = s.sig AND p.i % 2 = 0)) SELECT doc_id, string_agg(line, '|' ORDER BY i) AS texts FROM hit WHERE n = 1 GROUP BY 1")
def repeated_findings(spark: SparkSession, d: str) -> DataFrame:
    """A text's lines as findings of two rounds by turns: what of one round was found in the other."""
    (docs,) = tables(spark, d, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.lit(None).cast("string").alias("title"), x.alias("body"), (i % 2).alias("turn")))
    turn = lambda n: F.filter("l", lambda x: x["turn"] == n)
    out = docs.select("doc_id", lines.alias("l")).select("doc_id", findings.repeated_findings(turn(0), turn(1)).alias("r"))
    return out.filter(F.size("r") > 0).select("doc_id", F.array_join("r", "|").alias("texts"))


@query("path_extract", "SELECT page_id, paths FROM (SELECT page_id, '/x' || (page_id % 7) || '.py,src/' || page_id || '.ts' AS paths FROM pages)")
def path_extract(spark: SparkSession, d: str) -> DataFrame:
    (p,) = tables(spark, d, "pages")
    n, m = F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string")
    plan = F.concat(F.lit("Create: `src/"), n, F.lit(".ts`, see `Foo.bar`.\nModify: /x"), m, F.lit(".py. Test: none\nUse `/x"), m, F.lit(".py`"))
    return p.select("page_id", F.array_join(text.plan_paths(plan), ",").alias("paths"))


@query("code_imports", "SELECT doc_id, 'import os;from a.b import c' AS imports, 'f;G' AS exports, 'py file: 2 exports, imports: [import, a.b]' AS summary FROM documents")
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    code = F.concat(F.lit('"""Module '), F.col("doc_id").cast("string"), F.lit('."""\nimport os\nfrom a.b import c\n\ndef f():\n  pass\nclass G: pass\n'))
    info = text.file_info(F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".py")), code)
    return docs.select("doc_id", info.alias("i")).select("doc_id", F.array_join("i.imports", ";").alias("imports"), F.array_join("i.exports", ";").alias("exports"), "i.summary")


@query("code_of_lines", rf"""WITH l AS (SELECT doc_id, regexp_extract(line, '[A-Za-z]+') AS w, i % 6 AS k, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, i, k, CASE WHEN w = '' THEN 'x' ELSE w END AS w FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k IN (0, 1) ORDER BY i) AS imported, row_number() OVER (PARTITION BY doc_id, k IN (2, 3) ORDER BY i) AS named FROM c)
SELECT doc_id, coalesce(string_agg(CASE k WHEN 0 THEN 'import ' || w ELSE 'from ' || w || ' import y' END, ';' ORDER BY i) FILTER (k IN (0, 1) AND imported <= 50), '') AS imports, coalesce(string_agg(w, ';' ORDER BY i) FILTER (k IN (2, 3) AND named <= 50), '') AS exports FROM r GROUP BY 1""")
def code_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines become imports, definitions, indented definitions and comments by turns, each named by the line's first word."""
    (docs,) = tables(spark, d, "documents")

    def line(x: F.Column, i: F.Column) -> F.Column:
        w = F.regexp_extract(x, "[A-Za-z]+", 0)
        w = F.when(w == "", "x").otherwise(w)
        forms = ["import {}", "from {} import y", "def {}(a):", "class {}:", "# def {}():", "{} = def_(1)"]
        out = None
        for k, form in enumerate(forms):
            before, after = form.split("{}")
            made = F.concat(F.lit(before), w, F.lit(after))
            out = F.when(i % 6 == k, made) if out is None else out.when(i % 6 == k, made)
        return out

    code = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    info = text.file_info(F.lit("m.py"), code)
    rows = docs.filter("text is not null").select("doc_id", info.alias("i"))
    return rows.select("doc_id", F.array_join("i.imports", ";").alias("imports"), F.array_join("i.exports", ";").alias("exports"))


@query("session_render", "SELECT conv_id, string_agg('[' || turn || '] [' || role || '] ' || substr(text, 1, 2000), chr(10) ORDER BY turn) AS body, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def session_render(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "conversations")
    message = F.struct("turn", "role", F.col("turn").cast("string").alias("timestamp"), F.col("text").alias("content"))
    out = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return out.select("conv_id", text.render_session(F.col("m")).alias("body"), "roles")


CHUNKS = r"""WITH RECURSIVE d AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l, list_transform(string_split(text, chr(10)), lambda x: len(x) + 1) AS z FROM documents),
s AS (SELECT id, l, len(l)::INT AS n, list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(z[1:k]), 0)::BIGINT) AS p FROM d),
w AS (SELECT id, 0 AS i, 0 AS f, 0 AS a, -1 AS b FROM s
  UNION ALL SELECT w.id, w.i + 1, CASE WHEN p[w.i + 2] - p[w.f + 1] >= 1600 THEN coalesce(list_max(list_filter(range(w.f, w.i + 1), lambda j: p[w.i + 2] - p[j + 1] >= 320)), w.f)::INT ELSE w.f END, w.f, CASE WHEN p[w.i + 2] - p[w.f + 1] >= 1600 THEN w.i ELSE -1 END FROM w JOIN s ON s.id = w.id WHERE w.i < s.n),
c AS (SELECT id, a, b, 0 AS last FROM w WHERE b >= 0 UNION ALL SELECT w.id, w.f, s.n - 1, 1 FROM w JOIN s ON s.id = w.id AND w.i = s.n),
t AS (SELECT c.id, (row_number() OVER (PARTITION BY c.id ORDER BY last, b) - 1)::INT AS chunk, array_to_string(l[a + 1:b + 1], chr(10)) AS content, a AS line_start, b AS line_end, last FROM c JOIN s ON s.id = c.id)
SELECT id, chunk, content, line_start, line_end, (len(content) // 4)::INT AS token_count FROM t WHERE last = 0 OR regexp_matches(content, '\S')"""


@query("chunk_lines", CHUNKS)
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    return chunking.chunk_lines(docs, "doc_id", "text")


@query("exact_dedup", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    return docs.groupBy(text.sha256_hex(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query("similar_existing", "SELECT n.vec_id AS id FROM embeddings n WHERE n.vec_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM embeddings o WHERE o.vec_id % 4 <> 0 AND o.label = n.label AND list_cosine_similarity(n.embedding::DOUBLE[], o.embedding::DOUBLE[]) > 0.4)")
def similar_existing(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return context.similar_existing(rows.filter("id % 4 = 0"), rows.filter("id % 4 <> 0"), "label", 0.4).select("id")


GREEDY = """WITH RECURSIVE r AS MATERIALIZED (SELECT label::VARCHAR AS batch, vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT batch, n, [id] AS ids, [v] AS kept FROM r WHERE n = 1
  UNION ALL SELECT batch, n, CASE WHEN near THEN ids ELSE list_append(ids, id) END, CASE WHEN near THEN kept ELSE list_append(kept, v) END
  FROM (SELECT f.batch, r.n, f.ids, f.kept, r.id, r.v, len(list_filter(kept, lambda k: list_cosine_similarity(k, r.v) > 0.4)) > 0 AS near FROM f JOIN r ON r.batch = f.batch AND r.n = f.n + 1))
SELECT batch, unnest(ids) AS id, unnest(ids) AS seq FROM (SELECT * FROM f QUALIFY n = max(n) OVER (PARTITION BY batch))"""


@query("greedy_semantic_dedup", GREEDY)
def greedy_semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("batch"), F.col("embedding").alias("vector"))
    return context.greedy_dedup(rows, "batch", "seq", 0.4)


@query("supersede_edges", "WITH g AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS nxt FROM documents) SELECT 'm' || nxt AS from_id, 'm' || doc_id AS to_id, 'supersedes' AS edge_type FROM g WHERE nxt IS NOT NULL")
def supersede_edges(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    w = Window.partitionBy("text").orderBy("doc_id")
    decisions = docs.select(F.col("doc_id").alias("id"), F.lead("doc_id").over(w).alias("superseded_by"))
    memory = docs.select(F.concat(F.lit("m"), "doc_id").alias("id"), F.lit("decision").alias("kind"), F.col("doc_id").alias("provenance_id"))
    return context.supersede_edges(decisions, memory)


@query("env_pivot", "SELECT s_suppkey AS id, upper(replace(p, '-', '_')) || '_PORT' AS name, (3000 + s_suppkey)::VARCHAR AS value FROM (SELECT s_suppkey, 'web-' || s_nationkey AS p FROM supplier WHERE s_suppkey % 2 = 0) UNION ALL SELECT s_suppkey, 'DB_PORT_START', (3000 + s_suppkey)::VARCHAR FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'DB_PORT_END', (3009 + s_suppkey)::VARCHAR FROM supplier WHERE s_suppkey % 2 = 1")
def env_pivot(spark: SparkSession, d: str) -> DataFrame:
    (s,) = tables(spark, d, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    purpose = F.when(even, F.concat(F.lit("web-"), "s_nationkey")).otherwise("db")
    start = (3000 + F.col("s_suppkey")).cast("int")
    return s.select(F.col("s_suppkey").alias("id"), F.explode(text.env_pairs(purpose, start, F.when(even, start).otherwise(start + 9))).alias("name", "value"))


@query("migration_diff", "SELECT n_nationkey AS key FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_custkey % 17 = 0")
def migration_diff(spark: SparkSession, d: str) -> DataFrame:
    n, c = tables(spark, d, "nation", "customer")
    return context.set_difference(n.select(F.col("n_nationkey").alias("key")), c.filter("c_custkey % 17 = 0").select(F.col("c_nationkey").alias("key")), "key")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    (e,) = tables(spark, d, "events")
    rows = e.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").cast("string").alias("memory_id"), F.col("event_type").alias("operation"), F.lit("bot").alias("actor"), F.lit("p").alias("project_slug"), F.sha2("props", 256).alias("payload_hash"))
    return ledger.build_chain(rows)


CHAIN = "WITH RECURSIVE r AS MATERIALIZED (SELECT event_id + 1 AS seq, user_id::VARCHAR AS memory_id, event_type AS operation, 'bot' AS actor, 'p' AS project_slug, sha256(props) AS payload_hash FROM events), c AS (SELECT *, NULL::VARCHAR AS prev_hash, sha256(concat_ws('|', seq, memory_id, operation, actor, project_slug, payload_hash, '')) AS row_hash FROM r WHERE seq = 1 UNION ALL SELECT r.*, c.row_hash, sha256(concat_ws('|', r.seq, r.memory_id, r.operation, r.actor, r.project_slug, r.payload_hash, c.row_hash)) FROM c JOIN r ON r.seq = c.seq + 1)"


@query("hash_chain_build", CHAIN + " SELECT * FROM c")
def hash_chain_build(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d)


@query("hash_chain_verify", CHAIN + " SELECT 151::BIGINT AS broken_at_seq, (SELECT row_hash FROM c WHERE seq = 149) AS expected, prev_hash AS actual, 'prev_hash' AS reason FROM c WHERE seq = 151")
def hash_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return ledger.verify_chain(_ledger(spark, d).filter("seq <> 150"))


_VERIFIED = "SELECT '{0}' AS range, {1}::BIGINT AS broken_at_seq, {2} AS expected_hash, {3} AS actual_hash, '{4}' AS reason"


@query("verify_chain_sql", CHAIN + f" {_VERIFIED.format('gap', 151, '(SELECT row_hash FROM c WHERE seq = 149)', 'prev_hash', 'prev_hash-mismatch')} FROM c WHERE seq = 151 UNION ALL {_VERIFIED.format('no predecessor', 0, 'NULL', 'NULL', 'gap-before-start')} UNION ALL {_VERIFIED.format('changed', 301, 'row_hash', chr(39) + 'x' + chr(39), 'row_hash-mismatch')} FROM c WHERE seq = 301")
def verify_chain_sql(spark: SparkSession, d: str) -> DataFrame:
    """Four ranges of the ledger by the table function: with a row missing, with its predecessor missing, with a hash changed, and one that is whole and gives no row."""
    ledger.register_functions(spark)
    chain = _ledger(spark, d)
    missing, changed = chain.filter("seq <> 150"), chain.withColumn("row_hash", F.when(F.col("seq") == 301, "x").otherwise(F.col("row_hash")))
    cases = [("gap", missing, 1, None), ("no predecessor", missing, 151, None), ("changed", changed, 152, None), ("whole", missing, 1, 149)]
    out = None
    for name, rows, start, end in cases:
        span = f"start_seq => {start}, end_seq => CAST({'NULL' if end is None else end} AS BIGINT)"
        found = spark.sql("SELECT * FROM verify_chain(TABLE({rows}) PARTITION BY stretch ORDER BY seq, " + span + ") ORDER BY broken_at_seq LIMIT 1", rows=ledger.stretches(rows, start, end))
        one = found.select(F.lit(name).alias("range"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("sql_text", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sql_text(spark: SparkSession, d: str) -> DataFrame:
    from larkspur.plans.catalog import run_select

    return run_select(spark, d, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
