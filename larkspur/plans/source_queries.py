"""Transcripts, reviews, code and snapshots over the driver's tables: each is rendered in the form that an operator reads, and read back.

conversations stand for transcripts in each format, lines of documents for findings, lessons and code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import findings, models, text
from larkspur.operators import context, jobs, ledger
from larkspur.plans.queries import ARTIFACTS, JOBS, RANGES, _artifacts, _jobs, _ranges
from larkspur.plans.queries import _told as _artifact_names
from larkspur.plans.registry import query
from larkspur.sources import transcripts
from larkspur.sources.files import changed_files, tables, unseen

TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _json(c: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.array(c))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _lines(spark: SparkSession, d: str, line: Column, first: Column | None = None) -> DataFrame:
    """(path, n, line) of the conversations, with a line that can't be parsed or a given one before each."""
    (c,) = tables(spark, d, "conversations")
    path = F.concat(F.lit("/s/c"), "conv_id", F.lit(".jsonl")).alias("path")
    rows = c.select(path, F.col("turn").cast("int").alias("n"), line.alias("line"))
    return rows.unionByName(c.select(path, F.lit(-1).alias("n"), (F.lit("{broken") if first is None else first).alias("line")).distinct())


def _told(sessions: DataFrame) -> DataFrame:
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return sessions.select("session_id", "model", "started_at", "ended_at", F.size("messages").alias("n"), body.alias("body"), F.array_join("files_changed", ",").alias("files"))


@query("transcript_a", f"SELECT 'c' || conv_id AS session_id, min('m' || turn % 2) AS model, 't' || min(turn) AS started_at, 't' || max(turn) AS ended_at, count(*)::INT AS n, string_agg(role || ':' || {TRIMMED}, chr(10) ORDER BY turn) AS body, coalesce(string_agg(DISTINCT CASE WHEN turn % 2 = 1 THEN '/f/' || turn % 3 END, ',' ORDER BY CASE WHEN turn % 2 = 1 THEN '/f/' || turn % 3 END), '') AS files FROM conversations GROUP BY conv_id")
def transcript_a(spark: SparkSession, d: str) -> DataFrame:
    said = _json(F.col("text"))
    content = F.when(F.col("turn") % 2 == 0, said).otherwise(F.concat(F.lit('[{"type":"text","text":'), said, F.lit('},{"type":"tool_use","name":"edit","input":{"file_path":"/f/'), F.col("turn") % 3, F.lit('"}}]')))
    kind = F.when(F.col("role") == "system", "message").otherwise(F.col("role"))
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","timestamp":"t'), "turn", F.lit('","message":{"role":"'), "role", F.lit('","model":"m'), F.col("turn") % 2, F.lit('","content":'), content, F.lit("}}"))
    return _told(transcripts.format_a(_lines(spark, d, line), "a"))


@query("transcript_b", f"SELECT 'sid' || conv_id AS session_id, 'prov' AS model, 't-1' AS started_at, 't' || max(turn) AS ended_at, (count(*) FILTER (WHERE turn % 5 <> 4))::INT AS n, string_agg(CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END || ':' || {TRIMMED} || CASE WHEN turn % 3 = 1 THEN chr(10) || '[tool_result] done' ELSE '' END, chr(10) ORDER BY turn) FILTER (WHERE turn % 5 <> 4) AS body, '' AS files FROM conversations GROUP BY conv_id")
def transcript_b(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("turn") % 3 == 1, ',{"type":"function_call_output","output":"done"}').otherwise("")
    role = F.when(F.col("turn") % 5 == 4, "developer").otherwise(F.col("role"))
    line = F.concat(F.lit('{"type":"response_item","timestamp":"t'), "turn", F.lit('","payload":{"role":"'), role, F.lit('","content":[{"type":"input_text","text":'), _json(F.col("text")), F.lit("}"), more, F.lit("]}}"))
    meta = F.concat(F.lit('{"type":"session_meta","timestamp":"t-1","payload":{"id":"sid'), "conv_id", F.lit('","model_provider":"prov"}}'))
    return _told(transcripts.format_b(_lines(spark, d, line, meta), "b"))


@query("transcript_c", f"SELECT 'g' || conv_id AS session_id, 'gemini' AS model, 'a' AS started_at, 'z' AS ended_at, count(*)::INT AS n, string_agg(CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END || ':' || {TRIMMED}, chr(10) ORDER BY turn) AS body, '' AS files FROM conversations GROUP BY conv_id")
def transcript_c(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "conversations")
    said = _json(F.col("text"))
    content = F.when(F.col("turn") % 2 == 0, said).otherwise(F.concat(F.lit('[{"text":'), said, F.lit('},{"text":""}]')))
    message = F.concat(F.lit('{"type":"'), F.when(F.col("role") == "user", "user").otherwise("gemini"), F.lit('","timestamp":"t'), "turn", F.lit('","content":'), content, F.lit("}"))
    other = ',{"type":"info","content":"not a message"}'
    value = F.concat(F.lit('{"sessionId":"g'), "conv_id", F.lit('","startTime":"a","lastUpdated":"z","messages":['), F.array_join(F.transform(F.array_sort("m"), lambda x: x["v"]), ","), F.lit(other + "]}"))
    files = c.groupBy("conv_id").agg(F.collect_list(F.struct("turn", message.alias("v"))).alias("m")).select(F.concat(F.lit("/s/"), "conv_id", F.lit(".json")).alias("path"), value.alias("value"))
    return _told(transcripts.format_c(files, "c"))


@query("transcript_d", r"SELECT 'c' || conv_id AS session_id, 'm' AS model, 't' || min(turn) AS started_at, 't' || max(turn) AS ended_at, count(*)::INT AS n, string_agg(role || ':' || regexp_replace(CASE WHEN turn % 2 = 0 THEN '[thinking] ' || substr(text, 1, 1000) || chr(10) ELSE '' END || text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY turn) AS body, coalesce(max(CASE WHEN turn % 2 = 1 THEN '/t/x' END), '') AS files FROM conversations GROUP BY conv_id")
def transcript_d(spark: SparkSession, d: str) -> DataFrame:
    said = _json(F.col("text"))
    before = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"type":"thinking","thinking":'), said, F.lit("},"))).otherwise('{"type":"function_call","function":{"name":"go"},"arguments":{"target":"/t/x","path":"flat"}},')
    line = F.concat(F.lit('{"type":"message","timestamp":"t'), "turn", F.lit('","message":{"role":"'), "role", F.lit('","model":"m","content":['), before, F.lit('{"type":"text","text":'), said, F.lit("}]}}"))
    return _told(transcripts.format_d(_lines(spark, d, line), "d"))


@query("transcript_markdown", r"SELECT '2026-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '-' || doc_id AS session_id, '2026-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS started_at, md5(text) AS content FROM documents WHERE regexp_matches(text, '\S')")
def transcript_markdown(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    path = F.concat(F.lit("/notes/2026-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("-"), "doc_id", F.lit(".md"))
    out = transcripts.format_markdown(docs.select(path.alias("path"), F.col("text").alias("value")), "m")
    return out.select("session_id", "started_at", F.md5(F.col("messages")[0]["content"]).alias("content"))


@query("findings_block", "WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN (n - (n // 4))::INT ELSE -1 END AS kept, CASE doc_id % 6 WHEN 0 THEN CASE WHEN n >= 4 THEN 'invalid_severity:HUGE' ELSE 'none' END WHEN 1 THEN 'no_findings_block' WHEN 2 THEN 'multiple_findings_blocks:2' WHEN 3 THEN 'JSONDecodeError' WHEN 4 THEN 'missing_findings_key' ELSE 'missing_keys:[''severity'', ''title'']' END AS error FROM l")
def findings_block(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with a finding for each line of a text, every fourth of a severity that there isn't, or with a block that is broken in one of five ways."""
    (docs,) = tables(spark, d, "documents")
    severity = lambda i: F.element_at(F.array(*map(F.lit, ["BLOCKING", "warning", "NIT", "HUGE"])), (i % 4 + 1).cast("int"))
    finding = lambda x, i: F.concat(F.lit('{"severity":"'), severity(i), F.lit('","title":"t'), i, F.lit('","body":'), _json(x), F.lit("}"))
    block = lambda c: F.concat(F.lit("Some words.\n```json findings\n"), c, F.lit("\n```\n"))
    whole = F.concat(F.lit('{"findings":['), F.array_join(F.transform(F.split("text", "\n", -1), finding), ","), F.lit("]}"))
    k = F.col("doc_id") % 6
    review = F.when(k == 0, block(whole)).when(k == 1, F.col("text")).when(k == 2, F.concat(block(whole), block(whole))).when(k == 3, block(F.concat(F.lit("["), whole))).when(k == 4, block(F.lit('{"other":[]}'))).otherwise(block(F.lit('{"findings":[{"body":"b"}]}')))
    out = docs.select("doc_id", findings.parse_findings(review).alias("f"))
    return out.select("doc_id", F.when(F.col("f.findings").isNotNull(), F.size("f.findings")).otherwise(-1).alias("kept"), F.coalesce("f.error", F.lit("none")).alias("error"))


def _code(docs: DataFrame, line: object) -> Column:
    return F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")


NUMBERED = "(SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


@query("script_code", f"SELECT d.doc_id, 'ts' AS file_type, least(50, coalesce(a.imports, 0))::INT AS imports, coalesce(a.exports, '') AS exports FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE i % 3 = 0) AS imports, string_agg('k' || i, ',' ORDER BY i) FILTER (WHERE i % 3 = 1 AND i < 150) AS exports FROM {NUMBERED} GROUP BY 1) a USING (doc_id)")
def script_code(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    kinds = F.array(*map(F.lit, ["const ", "function ", "class ", "type "]))
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("  import {a} from './m"), i, F.lit("'"))).when(i % 3 == 1, F.concat(F.lit("export "), F.element_at(kinds, (i % 4 + 1).cast("int")), F.lit("k"), i, F.lit(" = 1"))).otherwise(F.concat(F.lit("// "), x))
    info = text.file_info(F.concat(F.lit("src/m"), "doc_id", F.lit(".ts")), _code(docs, line))
    return docs.select("doc_id", info.alias("i")).select("doc_id", "i.file_type", F.size("i.imports").alias("imports"), F.array_join("i.exports", ",").alias("exports"))


@query("sql_code", f"SELECT d.doc_id, coalesce(exports, '') AS exports FROM documents d LEFT JOIN (SELECT doc_id, string_agg('s.t' || i, ',' ORDER BY i) FILTER (WHERE i % 2 = 0 AND i < 100) AS exports FROM {NUMBERED} GROUP BY 1) a USING (doc_id)")
def sql_code(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    kinds = F.array(*map(F.lit, ["CREATE TABLE IF NOT EXISTS ", "create or replace view ", "Create Function ", "CREATE  INDEX "]))
    line = lambda x, i: F.when(i % 2 == 0, F.concat(F.element_at(kinds, (i % 8 / 2 + 1).cast("int")), F.lit("s.t"), i, F.lit(" (x int);"))).otherwise(F.concat(F.lit("-- "), x))
    info = text.file_info(F.concat(F.lit("db/m"), "doc_id", F.lit(".sql")), _code(docs, line))
    return docs.select("doc_id", F.array_join(info["exports"], ",").alias("exports"))


@query("lessons", r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(0, len(string_split(text, chr(10))), 4)) AS i FROM documents), f AS (SELECT doc_id, i, regexp_replace(l[i + 1], '^\s+|\s+$', '', 'g') AS lesson, CASE WHEN i + 1 < len(l) THEN 'cat' || (i + 1) ELSE '-' END AS category, CASE WHEN i + 2 < len(l) THEN 'n' || (i + 2) ELSE '-' END AS context FROM l) SELECT doc_id, count(*)::INT AS n, string_agg(concat_ws('/', lesson, category, context), '|' ORDER BY i) AS told FROM f WHERE lesson <> '' GROUP BY 1")
def lessons(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    line = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("LESSON: "), x)).when(i % 4 == 1, F.concat(F.lit("- Category: Cat"), i)).when(i % 4 == 2, F.concat(F.lit("CONTEXT: n"), i)).otherwise(F.concat(F.lit("* "), x))
    out = docs.select("doc_id", findings.parse_lessons(_code(docs, line)).alias("l")).filter(F.size("l") > 0)
    told = F.transform("l", lambda x: F.concat_ws("/", x["lesson"], F.coalesce(x["category"], F.lit("-")), F.coalesce(x["context"], F.lit("-"))))
    return out.select("doc_id", F.size("l").alias("n"), F.array_join(told, "|").alias("told"))


@query("change_operations", "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'create' WHEN doc_id % 7 = 1 THEN 'delete' WHEN doc_id % 7 = 2 THEN 'archive' WHEN doc_id % 7 = 3 THEN 'restore' ELSE 'update' END AS operation FROM documents WHERE doc_id % 7 < 5")
def change_operations(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    k, moment = F.col("id") % 7, F.lit("2024-01-01").cast("timestamp")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    before = rows.filter(k != 0).withColumn("archived_at", F.when(k == 3, moment))
    after = rows.filter(k != 1).withColumn("archived_at", F.when(k == 2, moment)).withColumn("content", F.when(k == 4, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return ledger.change_log(before, after).select("id", "operation")


@query("prior_items", f"SELECT job_id, artifact_type, id AS item FROM (SELECT *, max(struct_pack(a := created_at, b := id)) OVER (PARTITION BY job_id, artifact_type) AS m FROM {ARTIFACTS}) WHERE struct_pack(a := created_at, b := id) < m")
def prior_items(spark: SparkSession, d: str) -> DataFrame:
    a = _artifact_names(_artifacts(spark, d)).withColumn("content", F.concat(F.lit("Notes\n1. **BLOCKING:** "), "id", F.lit("\n- WARNING: other")))
    return jobs.prior_items(a).select("job_id", "artifact_type", F.regexp_replace("item", r"^\*\* ", "").alias("item"))


@query("range_listing", f"SELECT host, range_start, id, rank FROM (SELECT *, row_number() OVER (ORDER BY host, range_start, id)::INT AS rank FROM {RANGES}) WHERE rank <= 200")
def range_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first page of all ranges, by host, start and id."""
    order = ["host", "range_start", "id"]
    return _ranges(spark, d).orderBy(*order).limit(200).select("host", "range_start", "id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("changed_paths", "SELECT DISTINCT '/p' || page_id || '.py' AS path, page_id % 4 IN (2, 3) AS removed FROM pages UNION SELECT '/n' || page_id || '.py', false FROM pages WHERE page_id % 4 = 3")
def changed_paths(spark: SparkSession, d: str) -> DataFrame:
    (p,) = tables(spark, d, "pages")
    k, path = F.col("page_id") % 4, F.concat(F.lit("/p"), "page_id", F.lit(".py"))
    line = F.when(k == 0, F.concat(F.lit("M\t"), path)).when(k == 1, path).when(k == 2, F.concat(F.lit("D\t"), path)).otherwise(F.concat(F.lit("R090\t"), path, F.lit("\t/n"), "page_id", F.lit(".py")))
    return changed_files(p.select(line.alias("value")))


@query("embedding_input", "SELECT doc_id, md5(concat_ws(chr(10), '/d/' || doc_id, source, lang || ', ' || source, substr(text, 1, 500))) AS input FROM documents")
def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    told = text.embedding_text(F.concat(F.lit("/d/"), "doc_id"), F.col("source"), F.array("lang", "source"), F.col("text"))
    return docs.select("doc_id", F.md5(told).alias("input"))


CONTEXT = f"""WITH p AS (SELECT min(project_id) AS id FROM {JOBS}), j AS (SELECT * FROM {JOBS} WHERE project_id = (SELECT id FROM p)),
o AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM j WHERE status <> 'approved'), c AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM j WHERE status = 'approved'),
m AS (SELECT *, ['decision', 'issue', 'pattern'][(id % 3 + 1)::INT] AS kind FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at DESC, id) AS n FROM m)
SELECT (SELECT c_name FROM customer WHERE c_custkey = (SELECT id FROM p)) AS project,
coalesce((SELECT string_agg('t' || id, ',' ORDER BY n) FROM k WHERE kind = 'decision' AND n <= 5), '') AS decisions, coalesce((SELECT string_agg('c' || id, ',' ORDER BY n) FROM k WHERE kind = 'issue' AND n <= 5), '') AS issues,
coalesce((SELECT string_agg('t' || id, ',' ORDER BY n) FROM k WHERE kind = 'pattern' AND n <= 5), '') AS patterns, coalesce((SELECT string_agg('j' || id, ',' ORDER BY n) FROM o WHERE n <= 5), '') AS active,
coalesce((SELECT string_agg('j' || id, ',' ORDER BY n) FROM c WHERE n <= 5), '') AS completed, (SELECT count(*) FROM j WHERE created_at > TIMESTAMP '1997-01-01') AS locks"""


@query("project_context", CONTEXT)
def project_context(spark: SparkSession, d: str) -> DataFrame:
    """One project's context, its jobs standing for its memory and locks too."""
    (c,) = tables(spark, d, "customer")
    j = _jobs(spark, d)
    named = lambda p: F.concat(F.lit(p), "id")
    memory = j.select("id", "project_id", F.element_at(F.array(*map(F.lit, ["decision", "issue", "pattern"])), (F.col("id") % 3 + 1).cast("int")).alias("kind"), named("t").alias("title"), named("c").alias("content"), "created_at", "archived_at")
    work = j.select("id", "project_id", named("j").alias("title"), "status", F.lit("x").alias("current_phase"), F.lit("b").alias("branch_name"), F.lit(0).alias("error_count"), "created_at", F.col("created_at").alias("updated_at"), "archived_at")
    locks = j.select("project_id", F.col("created_at").alias("expires_at"))
    first = j.agg(F.min("project_id")).first()[0]
    projects = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), "c_custkey").alias("slug"), F.col("c_name").alias("name"))
    out = context.project_context(projects, memory, work, locks, f"s{first}", F.lit("1997-01-01").cast("timestamp_ntz"))
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return out.select(F.col("project.name").alias("project"), names("recent_decisions", "title").alias("decisions"), names("recent_issues", "description").alias("issues"), names("relevant_patterns", "name").alias("patterns"), names("active_jobs", "title").alias("active"), names("recent_completed_jobs", "title").alias("completed"), F.col("active_file_locks").alias("locks"))


@query("model_embedding", "SELECT doc_id, CASE WHEN length(text) > 10000 THEN 0 ELSE length(text) END AS chars, CASE WHEN length(text) > 10000 THEN 0 ELSE length(text) - length(replace(text, 'e', '')) END AS es FROM documents")
def model_embedding(spark: SparkSession, d: str) -> DataFrame:
    """A model that fails on batches with a long text, and on very long ones alone too: those get zeros."""
    (docs,) = tables(spark, d, "documents")

    def counting(texts: list[str]) -> list[list[float]]:
        if any(len(t) > (10_000 if len(texts) == 1 else 2_000) for t in texts):
            raise ValueError("too long")
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    out = models.reembed(docs.select("doc_id", "text"), "text", counting, 2)
    return out.select("doc_id", *[F.col("embedding")[k].cast("long").alias(n) for k, n in enumerate(("chars", "es"))])


@query("model_summaries", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE coalesce(nullif(split_part(substr(text, 1, 12000), chr(10), 1), ''), '-') END AS summary FROM documents")
def model_summaries(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    sessions = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), F.col("text").alias("raw_content"), F.when(F.col("doc_id") % 3 == 0, "kept").alias("summary"))
    filled, _ = models.fill_summaries(sessions, lambda t: t.split("\n")[0] or None)
    return filled.select(F.col("id").alias("doc_id"), F.coalesce("summary", F.lit("-")).alias("summary"))


@query("model_lessons", r"SELECT doc_id AS job_id, lesson, 'c' AS category FROM (SELECT doc_id, regexp_replace(split_part(substr(text, 1, 8000), chr(10), 1), '^\s+|\s+$', '', 'g') AS lesson FROM documents) WHERE lesson <> ''")
def model_lessons(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("job_id"), F.lit(0).alias("created_at"), F.lit("a").alias("id"), F.col("text").alias("content"))
    return models.extract_lessons(rows, lambda t: "LESSON: " + t.split("\n")[0] + "\nCATEGORY: C").select("job_id", "lesson", "category")


@query("unseen_sources", "SELECT DISTINCT source AS source_app, sha256(text) AS content_hash FROM documents EXCEPT SELECT source, sha256(text) FROM documents WHERE doc_id % 4 = 0")
def unseen_sources(spark: SparkSession, d: str) -> DataFrame:
    (docs,) = tables(spark, d, "documents")
    rows = docs.select("doc_id", F.col("source").alias("source_app"), text.sha256_hex(F.col("text")).alias("content_hash"))
    return unseen(rows, rows.filter("doc_id % 4 = 0")).select("source_app", "content_hash")
