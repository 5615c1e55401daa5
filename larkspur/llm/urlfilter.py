"""URL filters with dated lists: each capture is judged by the entries that were active when it was fetched. DataFrame functions only.

A list is a log of dated events that add or remove an entry. An entry is a domain, which stands for its subdomains too, or a domain with a
path, which stands for the paths below it. The events of an entry, in the order of their time, become validity intervals
[from, to); of events at the same time, a removal is the last. A capture has a key for each suffix of its host and each prefix of its path; keys
meet intervals by an equi-join on (key, month) with the interval's bounds as the residual, so a host that has a third of all captures is
spread over the months it was fetched in, and adaptive execution splits what is still large. The same (URL, time) is judged
once.

Defined results: a null or unparsable URL and a null time match nothing and are kept; user, port, case of the host and a final dot are
ignored; events with a null key, time or action are ignored; captures may repeat and have null ids; empty tables give
results without matches; all columns of captures are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import free_name, unpacked

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def url_keys(url: Column) -> Column:
    """All entries that would cover a URL: host suffixes, and the host with each prefix of the path's segments."""
    labels = F.split(host_of(url), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    keys = F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>")))
    return F.when(host_of(url) != "", keys)


def intervals(events: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) from events (list, key, action 'add' or 'remove', at); valid_to null: still valid."""
    known = events.filter("key is not null and at is not null and action in ('add', 'remove')").select(F.coalesce("list", F.lit("")).alias("list"), F.lower("key").alias("key"), "action", "at")
    known = known.groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "key").orderBy("at")
    changed = known.withColumn("before", F.lag("action").over(w)).filter("before is null or before <> action")
    return changed.withColumn("valid_to", F.lead("at").over(w)).filter("action = 'add'").select("list", "key", F.col("at").alias("valid_from"), "valid_to")


def match_captures(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with matched_entries (long), matched_lists (sorted array) and blocked (any match), named as free_name has it."""
    url, moment = F.col(url_col).cast("string"), F.col(time_col).cast("timestamp_ntz")
    packed = captures.select(F.struct("*").alias("row"), url.alias("url"), moment.alias("moment"))
    seen = packed.select(F.col("url").alias("_lk_url"), F.col("moment").alias("_lk_at")).filter("_lk_url is not null and _lk_at is not null").distinct()
    keyed = seen.withColumn("_lk_month", F.trunc("_lk_at", "month")).select("*", F.explode(url_keys(F.col("_lk_url"))).alias("_lk_key"))
    months = seen.select(F.trunc("_lk_at", "month").alias("m")).agg(F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    valid = intervals(events.withColumn("at", F.col("at").cast("timestamp_ntz")))
    low, high = F.lit(months["lo"]).cast("date"), F.lit(months["hi"]).cast("date")
    first, last = F.greatest(F.trunc("valid_from", "month"), low), F.least(F.coalesce(F.trunc("valid_to", "month"), high), high)
    spread = valid.filter(first <= last).withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    hits = keyed.join(spread, (F.col("_lk_key") == F.col("key")) & (F.col("_lk_month") == F.col("month")) & (F.col("valid_from") <= F.col("_lk_at")) & (F.col("valid_to").isNull() | (F.col("_lk_at") < F.col("valid_to"))))
    found = hits.groupBy("_lk_url", "_lk_at").agg(F.count(F.lit(1)).alias("_lk_n"), F.array_sort(F.collect_set("list")).alias("_lk_lists"))
    out = packed.join(found, (F.col("url") == F.col("_lk_url")) & (F.col("moment") == F.col("_lk_at")), "left")
    names = [free_name(n, captures.columns) for n in ("matched_entries", "matched_lists", "blocked")]
    added = [F.coalesce("_lk_n", F.lit(0)).cast("long"), F.coalesce("_lk_lists", F.array().cast("array<string>")), F.col("_lk_n").isNotNull()]
    return out.select(*unpacked("row", captures.columns), *[c.alias(n) for c, n in zip(added, names, strict=True)])
