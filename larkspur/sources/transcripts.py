"""Session transcripts in five formats as one schema (S2-S6, S8): every row is (path, source_app, session_id, model, started_at, ended_at, messages, files_changed).

Line formats are read as text with each line's number, parsed with try_parse_json, so a broken line costs only itself, and folded by
session. `project` follows from the path by operators.context.longest_prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import stripped

MESSAGE = "struct<role:string,timestamp:string,content:string,tool_calls:array<struct<tool:string,args:string>>,files_touched:array<string>>"
SESSION = ["path", "source_app", "session_id", "model", "started_at", "ended_at", "messages", "files_changed"]
# Cut lengths, and keys of a tool's arguments that hold paths.
RESULT_CUT, THINKING_CUT = 500, 1000
PATH_KEYS = ["file_path", "path", "file"]


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    """A string field; '' for what is absent or not a string."""
    return F.when(_kind(_get(v, path, "variant")) == "STRING", _get(v, path)).otherwise("")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line): lines of each file in order; n is the line's place, as files are read whole."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\r?\n", -1)).alias("n", "line"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _blocks(content: Column) -> Column:
    """The objects of a content list."""
    return F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda b: F.startswith(_kind(b), F.lit("OBJECT")))


def _fold(entries: DataFrame, app: str, session: Column, model: Column, all_paths: bool = True) -> DataFrame:
    """entries (path, n, ts, model, role, content, tool_calls, files; content null: no message) by file."""
    message = F.when((F.col("content") != "") | (F.size("tool_calls") > 0), F.struct("role", F.col("ts").alias("timestamp"), "content", "tool_calls", F.coalesce("files", F.array().cast("array<string>")).alias("files_touched")).cast(MESSAGE))
    marked = entries.withColumn("m", message).withColumn("at", F.when(F.coalesce("ts", F.lit("")) != "", F.col("n")))
    grouped = marked.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("n", "m")))), lambda x: x["m"]).alias("messages"),
        F.min_by("ts", "at").alias("started_at"), F.max_by("ts", "at").alias("ended_at"), model.alias("model"), session.alias("session_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("files", F.array().cast("array<string>")))))).alias("files_changed"),
    )
    out = grouped.filter(F.size("messages") > 0).withColumn("source_app", F.lit(app)).withColumn("session_id", F.coalesce("session_id", stem(F.col("path"))))
    return out.select(*SESSION)


def _argument_paths(args: Column, keys: list[str], slash: bool) -> Column:
    found = F.array(*[F.when(_kind(_get(args, k, "variant")) == "STRING", _get(args, k)) for k in keys])
    return F.filter(found, lambda p: p.isNotNull() & (F.contains(p, F.lit("/")) if slash else F.lit(True)))


def _messages(lines: DataFrame, types: list[str], tool_kinds: list[str], keys: list[str], slash: bool, thinking: bool, results: bool) -> DataFrame:
    e = lines.select("path", "n", F.try_parse_json("line").alias("e")).filter(F.startswith(_kind(F.col("e")), F.lit("OBJECT")))
    e = e.filter(_text(F.col("e"), "type").isin(types)).withColumn("msg", _get(F.col("e"), "message", "variant")).filter(F.startswith(_kind(F.col("msg")), F.lit("OBJECT")))
    content = _get(F.col("msg"), "content", "variant")
    blocks = _blocks(content)
    kind = lambda b: _text(b, "type")
    parts = lambda b: F.when(kind(b) == "text", _text(b, "text"))
    if thinking:
        said = parts
        parts = lambda b: said(b).when((kind(b) == "thinking") & (_text(b, "thinking") != ""), F.concat(F.lit("[thinking] "), F.substring(_text(b, "thinking"), 1, THINKING_CUT)))
    if results:
        told = parts
        parts = lambda b: told(b).when((kind(b) == "tool_result") & F.coalesce(_kind(_get(b, "content", "variant")).isin("STRING", "VOID"), F.lit(True)), F.concat(F.lit("[tool_result] "), F.substring(_text(b, "content"), 1, RESULT_CUT)))
    tools = F.filter(blocks, lambda b: kind(b).isin(tool_kinds))
    args = lambda b: F.coalesce(_get(b, "input", "variant"), _get(b, "arguments", "variant"))
    name = lambda b: F.coalesce(_get(b, "name"), _get(b, "function.name"), F.lit(""))
    text = F.when(_kind(content) == "STRING", _get(F.col("msg"), "content")).otherwise(F.array_join(F.array_compact(F.transform(blocks, parts)), "\n"))
    return e.select(
        "path", "n", _get(F.col("e"), "timestamp").alias("ts"), F.coalesce(_get(F.col("msg"), "model"), _get(F.col("e"), "model")).alias("model"),
        F.coalesce(_get(F.col("msg"), "role"), _get(F.col("e"), "type")).alias("role"), F.coalesce(stripped(text), F.lit("")).alias("content"),
        F.coalesce(F.transform(tools, lambda b: F.struct(name(b).alias("tool"), F.to_json(args(b)).alias("args"))), F.array().cast("array<struct<tool:string,args:string>>")).alias("tool_calls"),
        F.coalesce(F.flatten(F.transform(tools, lambda b: _argument_paths(args(b), keys, slash))), F.array().cast("array<string>")).alias("files"),
    )


def format_a(lines: DataFrame, app: str) -> DataFrame:
    """Entries typed user, assistant or message; content is text or blocks of text, tool_use and tool_result."""
    rows = _messages(lines, ["user", "assistant", "message"], ["tool_use"], PATH_KEYS, False, False, True)
    return _fold(rows, app, F.lit(None).cast("string"), F.min("model"))


def format_d(lines: DataFrame, app: str) -> DataFrame:
    """Entries typed message; blocks of text, thinking and calls; `target` is a path key too."""
    rows = _messages(lines, ["message"], ["tool_use", "function_call"], [*PATH_KEYS, "target"], True, True, False)
    return _fold(rows, app, F.lit(None).cast("string"), F.min("model"))


def format_b(lines: DataFrame, app: str) -> DataFrame:
    """session_meta and response_item entries; developer messages are left out; arguments may be JSON in a string."""
    e = lines.select("path", "n", F.try_parse_json("line").alias("e")).filter(F.startswith(_kind(F.col("e")), F.lit("OBJECT"))).withColumn("p", _get(F.col("e"), "payload", "variant"))
    is_meta, is_item = _text(F.col("e"), "type") == "session_meta", (_text(F.col("e"), "type") == "response_item") & F.startswith(_kind(F.col("p")), F.lit("OBJECT")) & (_text(F.col("p"), "role") != "developer")
    content = _get(F.col("p"), "content", "variant")
    blocks, kind = _blocks(content), lambda b: _text(b, "type")
    result = lambda b: F.coalesce(_get(b, "output"), F.to_json(_get(b, "output", "variant")))
    parts = F.transform(blocks, lambda b: F.when(kind(b).isin("input_text", "output_text", "text") & (_text(b, "text") != ""), _text(b, "text")).when((kind(b) == "function_call_output") & (F.coalesce(result(b), F.lit("")) != ""), F.concat(F.lit("[tool_result] "), F.substring(result(b), 1, RESULT_CUT))))
    text = F.when(_kind(content) == "STRING", _get(F.col("p"), "content")).otherwise(F.array_join(F.array_compact(parts), "\n"))
    calls = F.filter(blocks, lambda b: kind(b) == "function_call")
    args = lambda b: F.coalesce(F.try_parse_json(F.when(_kind(_get(b, "arguments", "variant")) == "STRING", _get(b, "arguments"))), _get(b, "arguments", "variant"))
    none = F.array().cast("array<struct<tool:string,args:string>>")
    rows = e.select(
        "path", "n", _get(F.col("e"), "timestamp").alias("ts"), F.when(is_meta, _get(F.col("p"), "model_provider")).alias("model"), F.when(is_meta, _get(F.col("p"), "id")).alias("meta_id"),
        F.when(_text(F.col("p"), "role") == "user", "user").otherwise("assistant").alias("role"), F.when(is_item, F.coalesce(stripped(text), F.lit(""))).alias("content"),
        F.when(is_item, F.coalesce(F.transform(calls, lambda b: F.struct(_text(b, "name").alias("tool"), _get(b, "arguments").alias("args"))), none)).otherwise(none).alias("tool_calls"),
        F.when(is_item, F.flatten(F.transform(calls, lambda b: _argument_paths(args(b), PATH_KEYS, True)))).alias("files"),
    )
    return _fold(rows, app, F.max_by("meta_id", F.when(F.col("meta_id").isNotNull(), F.col("n"))), F.max_by("model", F.when(F.col("meta_id").isNotNull(), F.col("n"))))


def format_c(files: DataFrame, app: str) -> DataFrame:
    """files (path, value): one JSON document each, with messages typed user or `gemini`."""
    d = files.select("path", F.try_parse_json("value").alias("d")).filter("d is not null")
    content = lambda m: _get(m, "content", "variant")
    part = lambda b: F.when(_kind(b) == "STRING", F.try_variant_get(b, "$", "string")).when(F.startswith(_kind(b), F.lit("OBJECT")), _text(b, "text"))
    text = lambda m: stripped(F.when(_kind(content(m)) == "STRING", _get(m, "content")).otherwise(F.array_join(F.filter(F.transform(F.try_variant_get(content(m), "$", "array<variant>"), part), lambda x: x.isNotNull() & (x != "")), "\n")))
    role = lambda m: F.when(_text(m, "type") == "user", "user").when(_text(m, "type") == "gemini", "assistant")
    none, no_calls = F.array().cast("array<string>"), F.array().cast("array<struct<tool:string,args:string>>")
    messages = F.filter(F.transform(_get(F.col("d"), "messages", "array<variant>"), lambda m: F.struct(role(m).alias("role"), _get(m, "timestamp").alias("timestamp"), F.coalesce(text(m), F.lit("")).alias("content"), no_calls.alias("tool_calls"), none.alias("files_touched"))), lambda m: m["role"].isNotNull() & (m["content"] != ""))
    out = d.select("path", F.lit(app).alias("source_app"), F.coalesce(_get(F.col("d"), "sessionId"), stem(F.col("path"))).alias("session_id"), F.lit("gemini").alias("model"), _get(F.col("d"), "startTime").alias("started_at"), _get(F.col("d"), "lastUpdated").alias("ended_at"), messages.cast(f"array<{MESSAGE}>").alias("messages"), none.alias("files_changed"))
    return out.filter(F.size("messages") > 0)


def format_markdown(files: DataFrame, app: str) -> DataFrame:
    """files (path, value): one assistant message each, dated by the file's name."""
    day = F.regexp_extract(stem(F.col("path")), r"^(\d{4}-\d{2}-\d{2})", 1)
    ts = F.when(day != "", F.concat(day, F.lit("T00:00:00Z")))
    none, no_calls = F.array().cast("array<string>"), F.array().cast("array<struct<tool:string,args:string>>")
    message = F.struct(F.lit("assistant").alias("role"), ts.alias("timestamp"), F.col("value").alias("content"), no_calls.alias("tool_calls"), none.alias("files_touched"))
    rows = files.filter(stripped(F.col("value")) != "")
    return rows.select("path", F.lit(app).alias("source_app"), stem(F.col("path")).alias("session_id"), F.lit(None).cast("string").alias("model"), ts.alias("started_at"), ts.alias("ended_at"), F.array(message).cast(f"array<{MESSAGE}>").alias("messages"), none.alias("files_changed"))


def detect(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The app of the first rule (app, regex of the path) that matches; null if none does."""
    out = None
    for app, pattern in rules:
        out = F.when(path.rlike(pattern), app) if out is None else out.when(path.rlike(pattern), app)
    return out
