"""Column functions, table-driven."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from larkspur.functions import findings, text, vectors

BLOCK = "prose\n```json findings\n%s\n```\n"
GOOD = BLOCK % '{"findings": [{"severity": "BLOCKING", "title": "a", "body": "first", "file": "x.py", "line": 3}, {"severity": "blocking", "title": "b", "body": "second"}, {"severity": "WARNING", "title": "c", "body": "w"}, {"severity": "NIT", "title": "d", "body": "n"}]}'


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "n", "error"),
    [
        (GOOD, 4, None),
        (BLOCK % '{"findings": []}', 0, None),
        ("no block", None, "no_findings_block"),
        (GOOD + GOOD, None, "multiple_findings_blocks:2"),
        (BLOCK % "{broken", None, "JSONDecodeError"),
        (BLOCK % '{"other": 1}', None, "missing_findings_key"),
        (BLOCK % "[1]", None, "missing_findings_key"),
        (BLOCK % '{"findings": 3}', None, "findings_not_a_list"),
        (BLOCK % '{"findings": [3]}', None, "finding_not_a_dict"),
        (BLOCK % '{"findings": [{"title": "x", "severity": "NIT"}]}', None, "missing_keys:['body']"),
        (BLOCK % '{"findings": [{"title": "x", "severity": "HUGE", "body": "b"}]}', 0, "invalid_severity:HUGE"),
        (BLOCK % '{"findings": [{"title": "x", "severity": "NIT", "body": {"a": 1}}, {"title": "x", "severity": "NIT", "body": "b"}]}', 1, "invalid_severity:non_string_body:dict"),
        (BLOCK % '{"findings": [{"title": 7, "severity": "NIT", "body": "b"}]}', 0, "invalid_severity:non_string_title:int"),
    ],
)
def test_parse_findings(spark, given, n, error):
    r = one(spark, given, findings.parse_findings)
    assert (None if r.findings is None else len(r.findings)) == n and r.error == error


@pytest.mark.parametrize(
    ("given", "blocking", "warning"),
    [
        (GOOD, 2, 1),
        ("WARNING: a\n1. WARNING: b\n**WARNING:** c\n- WARNING d", 0, 4),
        ("**1. WARNING — x**", 0, 1),
        ("1. **WARNING:** x", 0, 1),
        ("- BLOCKING → the rubric\nBLOCKING: real", 1, 0),
        ("a warning sign in prose", 0, 0),
        ("- - - - - - WARNING: too deep", 0, 0),
        ("", 0, 0),
    ],
)
def test_markers(spark, given, blocking, warning):
    assert one(spark, given, lambda c: findings.count_severity(c, "BLOCKING")) == blocking
    assert one(spark, given, lambda c: findings.count_severity(c, "WARNING")) == warning


def test_marker_items(spark):
    given = "intro\n1. BLOCKING: first\nmore\n- WARNING: no\n**BLOCKING** second \nNIT: x"
    assert one(spark, given, lambda c: findings.severity_items(c, "BLOCKING")) == ["first\nmore", "** second"]
    assert one(spark, GOOD, lambda c: findings.severity_items(c, "BLOCKING")) == ["first", "second"]


def test_signatures_and_repeats(spark):
    df = spark.sql("select array(named_struct('title', 'A  B', 'body', 'x'), named_struct('title', null, 'body', 'Y y'), named_struct('title', 'a b', 'body', 'x')) cur, array(named_struct('title', 'a b', 'body', 'other'), named_struct('title', '', 'body', 'y   Y')) old")
    assert df.select(findings.repeated_findings(F.col("cur"), F.col("old")).alias("r")).first().r == ["x", "Y y"]
    none = F.lit(None).cast("string")
    assert one(spark, "", lambda c: findings.signatures(none, c)) == [findings.EMPTY_SIGNATURE]
    assert one(spark, "B" * 200, lambda c: findings.signatures(none, c)) == ["b" * 80]


def test_lessons(spark):
    given = "noise\n- LESSON: use keys: always\nCATEGORY: Data\ncontext: c1\n\nLESSON: two\nLESSON:\nCONTEXT: lost"
    assert [tuple(r) for r in one(spark, given, findings.parse_lessons)] == [("use keys: always", "data", "c1"), ("two", None, None)]


@pytest.mark.parametrize(
    ("plan", "paths"),
    [
        ("Create: `src/a.py`\nModify: b/c.ts, then\nTest: tests/t.py.", ["b/c.ts", "src/a.py", "tests/t.py"]),
        ("see `Foo.get_job` and `(x/y.sql)` and `x/y.sql`", ["x/y.sql"]),
        ("edit: foo", []),
        ("", []),
    ],
)
def test_plan_paths(spark, plan, paths):
    assert one(spark, plan, text.plan_paths) == paths


@pytest.mark.parametrize(("start", "end", "first", "last", "body"), [(3, 5, 2, 7, "b\nc\nd\ne\nf\ng"), (None, None, 1, 8, "a\nb\nc\nd\ne\nf\ng\nh"), (0, 1, 1, 3, "a\nb\nc"), (7, 30, 6, 8, "f\ng\nh")])
def test_line_window(spark, start, end, first, last, body):
    r = one(spark, "a\nb\nc\nd\ne\nf\ng\nh", lambda c: text.line_window(c, F.lit(start), F.lit(end), 2))
    assert (r["first"], r["last"], r["total"], r["text"]) == (first, last, 8, body)


@pytest.mark.parametrize(("spec", "hours"), [("3h", 3), ("2d", 48), ("1w", 168), ("1m", 720), ("5x", None), ("h", None), ("10days", 240)])
def test_duration(spark, spec, hours):
    assert one(spark, spec, text.duration_hours) == hours


@pytest.mark.parametrize(("seconds", "short", "long"), [(5, "5s", "5s"), (150, "2m", "2m 30s"), (7300, "2h", "2h 1m"), (200000, "2d", "2d 7h"), (-5, "-5s", "0s")])
def test_age(spark, seconds, short, long):
    now = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(now - dt.timedelta(seconds=seconds),)], "t timestamp")
    as_of = F.lit("2024-01-01").cast("timestamp")
    assert tuple(df.select(text.age(F.col("t"), as_of), text.age(F.col("t"), as_of, True)).first()) == (short, long)


def test_small_formats(spark):
    assert one(spark, "Fix: the (API) bug!", text.branch_slug) == "fix--the--api--bug"
    assert one(spark, "a-b", text.parse_range) is None
    assert tuple(one(spark, "3000-3010", text.parse_range)) == (3000, 3010) and tuple(one(spark, "80", text.parse_range)) == (80, 80)
    assert one(spark, "postgresql://u:se:cret@h/db", text.redact_url) == "postgresql://u:***@h/db"
    assert one(spark, "postgresql://h/db", text.redact_url) == "postgresql://h/db"
    assert one(spark, "a\0b", text.without_nul) == "ab"
    assert one(spark, "abcdefgh", text.estimate_tokens) == 2
    assert one(spark, "x\n- a\n- b\n1. c", text.bullet_findings) == 3
    assert [one(spark, x, text.purpose_category) for x in ("DB", "UI", "gateway", "db-main")] == ["db_cache", "web", "apis", "db-main"]
    names = ["feat/a-1", " a..b ", "x/", "b" * 255, "b" * 256, "-x", "a b", "main", " MASTER", "", "a\n"]
    assert [one(spark, x, text.valid_branch) for x in names] == [True, True, True, True, False, False, False, False, False, False, True]
    assert [one(spark, x, text.valid_identifier) for x in ("7a_-", "A", "", "a" * 64, "a" * 65, "a\n")] == [True, False, False, True, False, False]
    assert [one(spark, x, text.phase_progress) for x in ("queued", "planning", "reviewing", "qa", "ready_for_approval", "fix_loop", "none")] == [1, 2, 4, 5, 6, 0, 0]
    assert one(spark, None, lambda c: text.age(c.cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))) == "?"
    assert one(spark, "web-1", lambda c: text.env_pairs(c, F.lit(3), F.lit(5), "P_")) == {"P_WEB_1_PORT_START": "3", "P_WEB_1_PORT_END": "5"}
    assert one(spark, '{"a": 1, "b": 2}', lambda c: text.merge_json(c, F.lit('{"b": [3], "c": null}'))) == '{"a":1,"b":[3],"c":null}'
    assert one(spark, None, lambda c: text.merge_json(c, F.lit('{"b": 3}'))) == '{"b":3}'


@pytest.mark.parametrize(
    ("path", "decoded"),
    [
        ("/home/u/.claude/projects/-code-foo/s.jsonl", "/code/foo"),
        ("/home/u/.claude/projects/-code-foo/sub/s.jsonl", "/code/foo"),
        ("/home/u/.claude/projects/-code-foo-worktrees-0abc-12/s.jsonl", "/code/foo-worktrees/0abc/12"),
        ("/home/u/.claude/projects/---/s.jsonl", None),
        ("/elsewhere/s.jsonl", None),
    ],
)
def test_decode_path(spark, path, decoded):
    assert one(spark, path, lambda c: text.decode_project_path(c, "/home/u")) == decoded


def test_code_info(spark):
    python = '"""Top.\nmore"""\nimport os\nfrom a.b import c\ndef f(): pass\n__all__ = ["x", \'y\']\nclass G: pass\n'
    r = one(spark, python, text.python_info)
    assert (r.imports, r.exports, r.summary) == (["import os", "from a.b import c"], ["x", "y", "G"], "Top.")
    r = one(spark, "import x from 'y'\nexport default function go() {}\n  export const K = 1\nexport {z}", text.script_info)
    assert (r.exports, r.summary) == (["go", "K"], "2 exports, 1 imports")
    many = "\n".join(f"import m{i}" for i in range(25))
    r = one(spark, many, lambda c: text.file_info(F.lit("a/b.py"), c))
    assert r.summary.endswith("(+5 more)]") and r.file_type == "py"
    assert one(spark, "create table if not exists a.b (x int); CREATE OR REPLACE VIEW v as select 1", lambda c: text.file_info(F.lit("m.sql"), c)).exports == ["a.b", "v"]
    assert one(spark, "hello", lambda c: text.file_info(F.lit("r.md"), c)).summary == ".md file, 5 chars"


def test_vectors(spark):
    df = spark.sql("select array(3f, 4f) a, array(4f, 3f) b, array(0f, 0f) z")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n"), vectors.cosine_or_zero(F.col("a"), F.col("z")).alias("o"), vectors.parse_vector(vectors.format_vector(F.col("a"))).alias("p"), vectors.zero_vector(3).alias("v")).first()
    assert abs(r.c - 0.96) < 1e-12 and r.n is None and r.o == 0.0 and r.p == [3.0, 4.0] and r.v == [0.0] * 3


def test_repeats_take_time_by_the_finding(spark):
    """5,000 findings, each as in the round before: lambdas that look each up among all others don't end in this time."""
    n = 5000
    found = lambda start: F.transform(F.sequence(F.lit(start), F.lit(start + n - 1)), lambda i: F.struct(F.lit(None).cast("string").alias("title"), F.concat(F.lit("Line  "), i.cast("string")).alias("body")))
    df = spark.range(1).select(found(0).alias("cur"), found(10).alias("old"), found(0).alias("none"))
    began = time.monotonic()
    got = df.select(findings.repeated_findings(F.concat("cur", "cur"), F.col("old")).alias("r")).filter(F.size("r") > 0).first().r
    assert got == [f"Line  {i}" for i in range(10, n)]
    assert time.monotonic() - began < 30
    odd = df.select(findings.repeated_findings(F.when(F.lit(False), F.col("cur")), F.col("old")).alias("a"), findings.repeated_findings(F.col("cur"), F.when(F.lit(False), F.col("old"))).alias("b"))
    assert tuple(odd.first()) == (None, [])


def test_ranges_up_to_another_cap(spark):
    df = spark.createDataFrame([("70000-70001",), ("9999999999",), ("7-6",)], "s string")
    assert [r[0] for r in df.select(text.parse_range(F.col("s"))["start"]).collect()] == [None, None, None]
    assert [r[0] for r in df.select(text.parse_range(F.col("s"), cap=2**63 - 1)["start"]).collect()] == [70000, 9999999999, None]
