"""Review findings (X1-X4, X15): a fenced JSON block with a validation ladder, severity markers otherwise."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import stripped

# The fence, the prefix that markers may have, severities and required keys.
FENCE = r"(?is)```json\s+findings\s*\n(.*?)\n```"
PREFIX = r"\s*(?:(?:\d+\.\s*|\*\*?|-\s*)\s*){0,4}"
NO_ARROW = r"\b(?!\s*→)"
SEVERITIES = ["BLOCKING", "WARNING", "NIT"]
REQUIRED = ["body", "severity", "title"]
EMPTY_SIGNATURE = "__empty__"

FINDING = "struct<severity:string,title:string,body:string,file:string,line:bigint>"


def parse_findings(text: Column) -> Column:
    """struct(findings, error): findings null if the block is absent or malformed; error null if all is well."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), 1)
    whole = F.try_parse_json(F.get(blocks, F.lit(0)))
    kind = lambda v: F.schema_of_variant(v)
    found = F.try_variant_get(whole, "$.findings", "variant")
    items = F.try_variant_get(whole, "$.findings", "array<variant>")
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    is_object = lambda v: F.startswith(kind(v), F.lit("OBJECT"))
    missing = lambda v: F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys(v))
    bad = F.get(F.filter(items, lambda v: ~is_object(v) | (F.size(missing(v)) > 0)), F.lit(0))
    quoted = F.array_join(F.transform(missing(bad), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
    name = lambda v: F.when(F.startswith(kind(v), F.lit("OBJECT")), "dict").when(F.startswith(kind(v), F.lit("ARRAY")), "list").when(kind(v) == "BIGINT", "int").when(kind(v) == "BOOLEAN", "bool").when(kind(v) == "VOID", "NoneType").when(kind(v) == "STRING", "str").otherwise("float")
    field = lambda v, k, t="string": F.try_variant_get(v, f"$.{k}", t)
    is_text = lambda v, k: kind(field(v, k, "variant")) == "STRING"
    severity = lambda v: F.coalesce(field(v, "severity"), F.lit("None"))
    fault = lambda v: F.when(~F.upper(severity(v)).isin(*SEVERITIES), F.substring(severity(v), 1, 64)).when(~is_text(v, "title"), F.concat(F.lit("non_string_title:"), name(field(v, "title", "variant")))).when(~is_text(v, "body"), F.concat(F.lit("non_string_body:"), name(field(v, "body", "variant"))))
    kept = F.transform(F.filter(items, lambda v: fault(v).isNull()), lambda v: F.struct(F.upper(severity(v)).alias("severity"), field(v, "title").alias("title"), field(v, "body").alias("body"), field(v, "file").alias("file"), field(v, "line", "bigint").alias("line")))
    dropped = F.get(F.filter(F.transform(items, fault), lambda x: x.isNotNull()), F.lit(0))
    n = F.size(blocks)
    fatal = (
        F.when(n == 0, F.lit("no_findings_block"))
        .when(n > 1, F.concat(F.lit("multiple_findings_blocks:"), n.cast("string")))
        .when(whole.isNull(), F.lit("JSONDecodeError"))
        .when(~is_object(whole) | found.isNull(), F.lit("missing_findings_key"))
        .when(items.isNull(), F.lit("findings_not_a_list"))
        .when(bad.isNotNull() & ~is_object(bad), F.lit("finding_not_a_dict"))
        .when(bad.isNotNull(), F.concat(F.lit("missing_keys:["), quoted, F.lit("]")))
    )
    return F.struct(F.when(fatal.isNull(), kept).cast(f"array<{FINDING}>").alias("findings"), F.coalesce(fatal, F.concat(F.lit("invalid_severity:"), dropped)).alias("error"))


def marker_count(text: Column, severity: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?i)(?:^|\n){PREFIX}{severity}{NO_ARROW}"))


def marker_items(text: Column, severity: str) -> Column:
    """What follows each marker, up to the next marker of any severity."""
    parts = F.split(text, rf"(?i)(?:^|\n){PREFIX}{severity}{NO_ARROW}[:\s]*", -1)
    until = rf"(?i)\n{PREFIX}(?:{'|'.join(SEVERITIES)}){NO_ARROW}"
    items = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: stripped(F.split(p, until, 2)[0]))
    return F.filter(items, lambda x: x != "")


def count_severity(text: Column, severity: str) -> Column:
    parsed = parse_findings(text)["findings"]
    return F.when(parsed.isNotNull(), F.size(F.filter(parsed, lambda f: f["severity"] == severity))).otherwise(marker_count(text, severity)).cast("int")


def severity_items(text: Column, severity: str) -> Column:
    parsed = parse_findings(text)["findings"]
    bodies = F.transform(F.filter(parsed, lambda f: f["severity"] == severity), lambda f: f["body"])
    return F.when(parsed.isNotNull(), bodies).otherwise(marker_items(text, severity))


def used_fallback(text: Column) -> Column:
    return parse_findings(text)["findings"].isNull()


def collapsed(text: Column) -> Column:
    return F.regexp_replace(stripped(F.lower(text)), r"\s+", " ")


def signatures(title: Column, body: Column) -> Column:
    """One or two strings by which findings of different rounds are compared."""
    whole = F.when(stripped(F.coalesce(title, F.lit(""))) != "", collapsed(title))
    start = F.when(stripped(F.coalesce(body, F.lit(""))) != "", F.substring(collapsed(body), 1, 80))
    found = F.array_distinct(F.array_compact(F.array(whole, start)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(EMPTY_SIGNATURE)))


def repeated_findings(current: Column, prior: Column) -> Column:
    """Texts of the current findings (title, body) that share a signature with a prior one, once per signature set, in order.

    Lambdas of columns would look through all prior findings, and all hits, for each one; sets in Python look each up, so the work grows with the findings and not with their pairs.
    """
    sets = lambda c: F.transform(c, lambda f: F.array_sort(signatures(f["title"], f["body"])))
    texts = F.transform(current, lambda f: F.coalesce(F.when(f["body"] != "", f["body"]), f["title"], F.lit("")))

    def repeats(current: pa.Array, texts: pa.Array, prior: pa.Array) -> pa.Array:
        out: list[list[str] | None] = []
        for own, told, before in zip(current.to_pylist(), texts.to_pylist(), prior.to_pylist(), strict=True):
            if own is None:
                out.append(None)
                continue
            known, hits = {s for other in before or [] for s in other}, {}
            for s, text in zip(map(tuple, own), told, strict=True):
                if s not in hits and not known.isdisjoint(s):
                    hits[s] = text
            out.append(list(hits.values()))
        return pa.array(out, pa.list_(pa.string()))

    # nondeterministic, so that a filter on the result doesn't work it out again
    return F.arrow_udf(repeats, "array<string>").asNondeterministic()(sets(current), texts, sets(prior))


# The keys of a lesson's lines.
LESSON, CATEGORY, CONTEXT = "LESSON", "CATEGORY", "CONTEXT"


def parse_lessons(text: Column) -> Column:
    """array<struct(lesson, category, context)> from LESSON / CATEGORY / CONTEXT lines."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda x: x != "")
    is_a = lambda x, k: x.rlike(rf"(?i)^(- )?{k}:")
    value = lambda x: stripped(F.regexp_replace(x, r"^[^:]*:", ""))
    empty = F.struct(F.lit(None).cast("string").alias("lesson"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("context"))
    start = F.array().cast("array<struct<lesson:string,category:string,context:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.element_at(acc, -1), empty)
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        fresh = F.concat(acc, F.array(F.struct(value(x).alias("lesson"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("context"))))
        category = F.concat(rest, F.array(F.struct(last["lesson"].alias("lesson"), F.lower(value(x)).alias("category"), last["context"].alias("context"))))
        context = F.concat(rest, F.array(F.struct(last["lesson"].alias("lesson"), last["category"].alias("category"), value(x).alias("context"))))
        started = F.size(acc) > 0
        return F.when(is_a(x, LESSON), fresh).when(started & is_a(x, CATEGORY), category).when(started & is_a(x, CONTEXT), context).otherwise(acc)

    return F.filter(F.aggregate(lines, start, step), lambda s: s["lesson"] != "")
