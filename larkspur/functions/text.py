"""Text, path, time and format scalars (P7, P12-P19, X5-X21, M5-M8) as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that make a token a path, and the punctuation around one.
PLAN_EXTENSIONS = ["py", "ts", "tsx", "js", "jsx", "sql", "md", "yaml", "yml", "json", "toml", "sh", "go", "rs", "java", "c", "cpp", "h", "css", "html", "txt", "env"]
PLAN_ACTION = r"(?i)\b(?:create|modify|test|edit|update|add)\s*:\s*`?([^\s`,;]+)`?"
PLAN_TICKED = r"`([^`\n]+)`"
LEADING, TRAILING = "([{<\"'", ".,;:!?)]}>\"'"
# What SQL DDL, script languages and Python export.
SQL_OBJECT = r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|FUNCTION|INDEX|TYPE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)"
SCRIPT_EXPORT = r"^export\s+(?:default\s+)?(?:function|class|const|let|var|type|interface|enum)\s+(\w+)"
# The list of exported names, definitions and docstrings of Python, and encoded work trees.
PYTHON_ALL = r"__all__\s*=\s*\[([^\]]+)\]"
PYTHON_NAME = r"^(?:def|class)\s+(\w+)"
PYTHON_DOC = r'(?s)^"""(.*?)"""'
WORK_TREE = r"^(.+)/worktrees/([0-9a-f][0-9a-f-]{3,39})(/.*)?$"
# The phases that progress is shown in, in their order.
PHASES = ["queued", "planning", "implementing", "reviewing", "qa", "ready_for_approval"]
# Purposes of each category; others are a category of their own.
PURPOSES = {
    "web": ["web", "ui", "frontend", "app"],
    "apis": ["api", "backend", "gateway", "graphql"],
    "db_cache": ["postgres", "mysql", "db", "database", "redis", "cache", "elasticsearch", "memcached"],
}
# What names of branches and developers look like, and branches that are never worked on.
BRANCH = "^[A-Za-z0-9_][A-Za-z0-9_./-]{0,254}$"
IDENTIFIER = "^[a-z0-9_-]{1,64}$"
PROTECTED = ["main", "master"]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(a: Column) -> Column:
    """The elements of an array that are neither null nor empty."""
    return F.filter(a, lambda x: x.isNotNull() & (x != ""))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def bullet_findings(c: Column) -> Column:
    return occurrences(c, "\n- ") + occurrences(c, "\n1.")


def plan_paths(c: Column) -> Column:
    """Sorted distinct file paths of a plan: after action words, and in back-ticks."""
    tokens = F.concat(F.regexp_extract_all(c, F.lit(PLAN_ACTION), 1), F.regexp_extract_all(c, F.lit(PLAN_TICKED), 1))
    cleaned = F.transform(tokens, lambda t: F.rtrim(F.ltrim(F.trim(t), F.lit(LEADING)), F.lit(TRAILING)))
    extension = lambda t: F.lower(F.regexp_extract(t, r"\.([^.]*)$", 1))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(cleaned, lambda t: ~F.contains(t, F.lit(" ")) & extension(t).isin(*PLAN_EXTENSIONS)))), F.array().cast("array<string>"))


def line_window(text: Column, start: Column, end: Column, around: int) -> Column:
    """struct(text, first, last, total): lines [start - around, end + around) of a text, numbered from 0, clamped."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    a = F.greatest(F.lit(0), F.coalesce(start, F.lit(0)) - around)
    b = F.least(n, F.coalesce(end, n) + around)
    body = F.array_join(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), "\n")
    return F.struct(body.alias("text"), (a + 1).alias("first"), b.alias("last"), n.alias("total"))


def source_reference(kind: Column, ident: Column, start: Column, end: Column) -> Column:
    """'kind_id8:start-end', with ? for what is null."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(kind, F.lit("_"), F.substring(ident.cast("string"), 1, 8), F.lit(":"), known(start), F.lit("-"), known(end))


def preview(c: Column, n: int = 500) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def duration_hours(spec: Column) -> Column:
    """'3d' and the like to hours; null if it doesn't begin as one. h, d, w, and m of 30 days."""
    n = F.regexp_extract(spec, r"^(\d+)([hdwm])", 1)
    unit = F.regexp_extract(spec, r"^(\d+)([hdwm])", 2)
    size = F.when(unit == "h", 1).when(unit == "d", 24).when(unit == "w", 168).when(unit == "m", 720)
    return F.when(n != "", n.try_cast("int") * size)


def age(ts: Column, as_of: Column, two_units: bool = False) -> Column:
    """Seconds, minutes, hours or days since ts; two units also show the next smaller one and clamp the future to 0; ? without a time."""
    s = F.timestamp_diff("SECOND", ts, as_of)
    if two_units:
        s = F.greatest(s, F.lit(0))
        part = lambda big, small, a, b: F.concat(F.floor(s / big).cast("string"), F.lit(a + " "), F.floor((s % big) / small).cast("string"), F.lit(b))
        text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, part(60, 1, "m", "s")).when(s < 86400, part(3600, 60, "h", "m")).otherwise(part(86400, 3600, "d", "h"))
    else:
        one = lambda big, a: F.concat(F.floor(s / big).cast("string"), F.lit(a))
        text = F.when(s < 60, one(1, "s")).when(s < 3600, one(60, "m")).when(s < 86400, one(3600, "h")).otherwise(one(86400, "d"))
    return F.when(ts.isNull(), "?").otherwise(text)


def phase_progress(status: Column) -> Column:
    """Place of a status among the phases, 0 if it is none."""
    return F.array_position(F.array(*[F.lit(p) for p in PHASES]), status).cast("int")


def event_summary(kind: Column, findings: Column, blocking: Column) -> Column:
    b, f = F.coalesce(blocking, F.lit(0)), F.coalesce(findings, F.lit(0))
    review = F.concat(kind, F.lit(": "), b.cast("string"), F.lit(" blocking, "), (f - b).cast("string"), F.lit(" other findings"))
    out = F.when(kind.isin("arch_review", "security_review"), review)
    # fixed values: what other artifacts say
    for name, text in (("plan_doc", "planning complete"), ("impl_output", "implementation complete"), ("qa_report", "QA complete"), ("diff", "diff captured"), ("lock_conflicts", "BLOCKED on file lock conflicts")):
        out = out.when(kind == name, F.lit(text))
    return out.otherwise(kind)


def env_pairs(purpose: Column, start: Column, end: Column, prefix: str = "") -> Column:
    """map of the variables for a range: PURPOSE_PORT, or _PORT_START and _PORT_END."""
    name = F.concat(F.lit(prefix), F.upper(F.translate(purpose, "-", "_")))
    one = F.create_map(F.concat(name, F.lit("_PORT")), start.cast("string"))
    return F.when(start == end, one).otherwise(F.create_map(F.concat(name, F.lit("_PORT_START")), start.cast("string"), F.concat(name, F.lit("_PORT_END")), end.cast("string")))


def purpose_category(purpose: Column) -> Column:
    """The category that a purpose, without regard to case, is listed in, else the purpose itself."""
    p = F.lower(purpose)
    out = p
    for category, words in PURPOSES.items():
        out = F.when(p.isin(words), category).otherwise(out)
    return out


def parse_range(spec: Column, cap: int = 65535) -> Column:
    """'a-b' or 'a' to struct(start, end); null unless 1 <= a <= b <= cap. The fields are int where the cap is one, else long."""
    kind = "int" if cap < 1 << 31 else "long"
    a = F.regexp_extract(spec, r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*$", 1).try_cast(kind)
    b = F.coalesce(F.regexp_extract(spec, r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*$", 2).try_cast(kind), a)
    return F.when((a >= 1) & (a <= b) & (b <= cap), F.struct(a.alias("start"), b.alias("end")))


def format_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def branch_slug(title: Column) -> Column:
    return F.trim(F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9-]", "-"), 1, 40), F.lit("-"))


def valid_branch(name: Column) -> Column:
    """Whether a name, trimmed, can be worked on as a branch: safe characters, at most 255, and no protected branch."""
    bare = stripped(name)
    return bare.rlike(BRANCH) & ~F.contains(bare, F.lit("\n")) & ~F.lower(bare).isin(PROTECTED)


def valid_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER) & ~F.contains(name, F.lit("\n"))


def redact_url(url: Column) -> Column:
    """The password of a URL becomes ***."""
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:@]*):[^/?#@]*@", "$1:***@")


def without_nul(c: Column, n: int | None = None) -> Column:
    out = F.replace(c, F.lit("\0"), F.lit(""))
    return F.substring(out, 1, n) if n else out


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def embedding_text(path: Column, summary: Column, exports: Column, content: Column) -> Column:
    return F.concat_ws("\n", path, summary, F.array_join(exports, ", "), F.substring(content, 1, 500))


def decode_project_path(path: Column, home: str) -> Column:
    """The directory that a transcript path encodes with dashes; work trees are glued back; null if it encodes none."""
    prefix = f"{home}/.claude/projects/"  # fixed value: where transcripts of this format lie
    first = F.split_part(F.substring(path, len(prefix) + 1, 1 << 20), F.lit("/"), F.lit(1))
    bare = F.ltrim(first, F.lit("-"))
    decoded = F.concat(F.lit("/"), F.translate(bare, "-", "/"))
    glued = F.regexp_replace(decoded, WORK_TREE, "$1-worktrees/$2$3")
    return F.when(F.startswith(path, F.lit(prefix)) & (bare != ""), glued)


def python_info(content: Column) -> Column:
    """struct(imports, exports, summary) of Python source."""
    lines = F.transform(F.split(content, r"\r\n|\r|\n", -1), stripped)
    imports = F.filter(lines, lambda x: F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from ")))
    named = F.filter(F.transform(lines, lambda x: F.when(~F.startswith(x, F.lit("import ")) & ~F.startswith(x, F.lit("from ")), F.regexp_extract(x, PYTHON_NAME, 1))), lambda x: x.isNotNull() & (x != ""))
    listed = F.regexp_extract(content, PYTHON_ALL, 1)
    declared = F.transform(F.split(listed, ",", -1), lambda x: F.trim(stripped(x), F.lit("\"'")))
    # the list replaces names above it; names below are added
    marker = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("__all__"))), True).cast("int")
    below = F.filter(F.transform(F.slice(lines, F.greatest(marker, F.lit(1)), F.size(lines)), lambda x: F.regexp_extract(x, PYTHON_NAME, 1)), lambda x: x != "")
    exports = F.when((marker > 0) & (listed != ""), F.concat(declared, below)).otherwise(named)
    doc = F.split(stripped(F.regexp_extract(content, PYTHON_DOC, 1)), "\n")[0]
    summary = F.when(doc != "", doc).otherwise(F.concat(F.size(exports).cast("string"), F.lit(" exports, "), F.size(imports).cast("string"), F.lit(" imports")))
    return F.struct(imports.alias("imports"), exports.alias("exports"), summary.alias("summary"))


def script_info(content: Column) -> Column:
    """struct(imports, exports, summary) of TypeScript or JavaScript."""
    lines = F.transform(F.split(content, r"\r\n|\r|\n", -1), stripped)
    imports = F.filter(lines, lambda x: F.startswith(x, F.lit("import ")))
    exports = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, SCRIPT_EXPORT, 1)), lambda x: x != "")
    summary = F.concat(F.size(exports).cast("string"), F.lit(" exports, "), F.size(imports).cast("string"), F.lit(" imports"))
    return F.struct(imports.alias("imports"), exports.alias("exports"), summary.alias("summary"))


def file_info(path: Column, content: Column, most: int = 50) -> Column:
    """struct(file_type, imports, exports, summary) by extension; lists end at `most`."""
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    empty = F.array().cast("array<string>")
    sql = F.regexp_extract_all(content, F.lit(SQL_OBJECT), 1)
    py, script = suffix == ".py", suffix.isin(".ts", ".tsx", ".js", ".jsx")
    imports = F.when(py, python_info(content)["imports"]).when(script, script_info(content)["imports"]).otherwise(empty)
    exports = F.when(py, python_info(content)["exports"]).when(script, script_info(content)["exports"]).when(suffix == ".sql", sql).otherwise(empty)
    names = F.filter(F.transform(imports, lambda x: F.regexp_extract(x, r"^(?:from\s+)?([\w.]+)", 1)), lambda x: x != "")
    more = F.when(F.size(names) > 20, F.concat(F.lit(" (+"), (F.size(names) - 20).cast("string"), F.lit(" more)"))).otherwise("")
    kind = F.substring(suffix, 2, 20)
    told = F.concat(kind, F.lit(" file: "), F.size(exports).cast("string"), F.lit(" exports, imports: ["), F.array_join(F.slice(names, 1, 20), ", "), more, F.lit("]"))
    plain = F.concat(suffix, F.lit(" file, "), F.length(content).cast("string"), F.lit(" chars"))
    summary = F.when(py | script | (suffix == ".sql"), told).otherwise(plain)
    return F.struct(kind.alias("file_type"), F.slice(imports, 1, most).alias("imports"), F.slice(exports, 1, most).alias("exports"), summary.alias("summary"))


def render_session(messages: Column, limit: int = 2000) -> Column:
    """Messages (role, timestamp, content) as text, a line each."""
    stamp = lambda m: F.when(F.coalesce(m["timestamp"].cast("string"), F.lit("")) != "", F.concat(F.lit("["), m["timestamp"].cast("string"), F.lit("] "))).otherwise("")
    return F.array_join(F.transform(messages, lambda m: F.concat(stamp(m), F.lit("["), m["role"], F.lit("] "), F.substring(m["content"], 1, limit))), "\n")


def session_json(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def merge_json(base: Column, patch: Column) -> Column:
    """Top-level merge of two JSON objects; the patch wins. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN for shared keys, so keys are filtered."""
    kind = "map<string,variant>"
    a, b = (F.coalesce(F.expr("null").cast(kind) if c is None else F.try_variant_get(F.try_parse_json(c), "$", kind), F.create_map().cast(kind)) for c in (base, patch))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b))
