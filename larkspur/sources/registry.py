"""Registries of projects and their port ranges: documents in, rows and an import's counts out.

A registry document is JSON or YAML with a mapping `projects` from slug to settings. Documents come as rows, YAML becomes JSON in batches on the executors, and all that
follows is columns: one row a project, one row a port, one row for whatever was skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import parse_range, stripped
from larkspur.session import cut

# The states that a project may have.
STATUSES = ["active", "inactive", "archived", "experimental"]
_FIELDS = "name string, team string, status string, path string, compose_project string, ports string"


@dataclass(frozen=True)
class Registry:
    """projects (source, slug, name, team, status, path, compose_project), ranges (source, slug, purpose, range_start, range_end), skipped (source, message)."""

    projects: DataFrame
    ranges: DataFrame
    skipped: DataFrame


@F.pandas_udf(T.StringType())
def _as_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A YAML document as JSON; null for one that can't be read."""
    import yaml

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text or ""), default=str)
        except yaml.YAMLError:
            return None

    for some in texts:
        yield some.map(one)


def _mapping(c: Column) -> Column:
    return F.ltrim(c).startswith("{")


def read_registry(documents: DataFrame, source: str = "path", text: str = "value", yaml: bool = False) -> Registry:
    """What the documents (source, text) hold.

    A project without a name has its slug for one, and without a status it is active; a status is trimmed and lower-cased, and a project with another status than STATUSES is skipped with its ports. A project that isn't
    a mapping, ports that aren't one, and ports whose range isn't 'a' or 'a-b' with 1 <= a <= b <= 65535 are skipped each, and told in skipped. A document that can't be
    read, or that isn't a mapping or has no projects, has none.
    """
    body = _as_json(F.col(text)) if yaml else F.col(text)
    found = F.from_json(body, "projects map<string, string>")["projects"]
    raw = cut(documents.select(F.col(source).alias("source"), F.explode(found).alias("slug", "raw")), "registry")
    fields = F.from_json("raw", _FIELDS)
    told = raw.withColumn("f", F.when(_mapping(F.col("raw")), fields)).select("source", "slug", "raw", "f.*")
    none = lambda c: F.when(stripped(c) != "", c)
    status = F.lower(stripped(F.coalesce(none(F.col("status")), F.lit("active"))))
    rows = told.withColumn("status", status).withColumn("problem", F.when(~F.coalesce(_mapping(F.col("raw")), F.lit(False)), F.concat("slug", F.lit(": config is not a mapping"))).when(~F.col("status").isin(STATUSES), F.concat("slug", F.lit(": unknown status '"), "status", F.lit("'"))))
    good = rows.filter("problem is null")
    projects = good.select("source", "slug", F.coalesce(none(F.col("name")), F.col("slug")).alias("name"), "team", "status", "path", "compose_project")
    has_ports = good.filter("ports is not null")
    listed = has_ports.filter(_mapping(F.col("ports"))).select("source", "slug", F.explode(F.from_json("ports", "map<string, string>")).alias("purpose", "spec")).withColumn("range", parse_range(F.col("spec")))
    ranges = listed.filter("range is not null").select("source", "slug", "purpose", F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end"))
    spec = F.coalesce("spec", F.lit("null"))
    skipped = rows.filter("problem is not null").select("source", F.col("problem").alias("message"))
    skipped = skipped.unionByName(has_ports.filter(~_mapping(F.col("ports"))).select("source", F.concat("slug", F.lit(": ports are not a mapping")).alias("message")))
    skipped = skipped.unionByName(listed.filter("range is null").select("source", F.concat("slug", F.lit("/"), "purpose", F.lit(": bad port spec '"), spec, F.lit("'")).alias("message")))
    return Registry(projects, ranges, skipped)


def import_registry(registry: Registry, projects: DataFrame, ranges: DataFrame) -> dict[str, DataFrame]:
    """What an import of a registry writes and counts, against projects (slug, ...) and ranges (slug, purpose, range_start, range_end) that exist.

    projects and ranges: with action, insert or update (a range that is the same is existing, and written as it was); a slug or port that several
    documents name counts once, as the least source has it. counts: one row with projects_created, projects_existing, ports_created, ports_existing, skipped.
    """
    first = lambda df, keys: df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in (*keys, "source")]), "source").alias("r")).select(*keys, "r.*")
    known = projects.select("slug").distinct().withColumn("_lk_in", F.lit(True))
    named = first(registry.projects, ["slug"]).join(known, "slug", "left").withColumn("action", F.when(F.col("_lk_in"), "update").otherwise("insert")).drop("_lk_in")
    old = ranges.groupBy("slug", "purpose").agg(F.min(F.struct("range_start", "range_end")).alias("_lk_old"))
    listed = first(registry.ranges, ["slug", "purpose"]).join(old, ["slug", "purpose"], "left")
    action = F.when(F.col("_lk_old").isNull(), "insert").when(F.col("_lk_old") == F.struct("range_start", "range_end"), "existing").otherwise("update")
    listed = listed.withColumn("action", action).drop("_lk_old")
    new = lambda df, n: df.agg(F.count_if(F.col("action") == "insert").alias(f"{n}_created"), F.count_if(F.col("action") != "insert").alias(f"{n}_existing"))
    counts = new(named, "projects").crossJoin(new(listed, "ports")).crossJoin(registry.skipped.agg(F.count(F.lit(1)).alias("skipped")))  # one row each
    return {"projects": named, "ranges": listed, "counts": counts}
