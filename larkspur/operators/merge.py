"""Write patterns as DataFrame results (W1-W26, J6, J7, J17, J19): each returns what the target would hold, or what would be appended.

Parquet has no constraints or transactions, so idempotency comes from anti-joins on keys, and a caller publishes a new snapshot.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut

_log = logging.getLogger(__name__)


def _key(df: DataFrame, keys: list[str]) -> list[Column]:
    return [df[k] for k in keys]


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: the first of each key that the target lacks; rows with a null key always."""
    whole = None
    for k in keys:
        whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keyed = rows.filter(whole).withColumn("_lk_n", first).filter("_lk_n = 1").drop("_lk_n")
    return keyed.join(target.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(rows.filter(~whole))


def get_or_create(target: DataFrame, rows: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """(keys, id, created) for each row: the target's id where the key exists, else the least id among the rows of the key, so a key has one id.

    created is true for the row whose own id that is, and for one of them if several have it. A null in a key matches nothing: such a row creates its own.
    """
    have = target.groupBy(*keys).agg(F.min(ident).alias("_lk_have"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    firsts = rows.groupBy(*keys).agg(F.min(ident).alias("_lk_least")).filter(whole)
    known = firsts.join(have, keys, "left")
    # the rows stream past a task's keys and are never sorted, however many a key has
    out = rows.select(*keys, ident).join(known.hint("shuffle_hash"), keys, "left")
    fresh, least = F.col("_lk_have").isNull(), F.col("_lk_least")
    first = F.coalesce(fresh & (F.col(ident) == least), F.lit(False))
    others = out.filter(~first).select(*keys, F.coalesce("_lk_have", "_lk_least", ident).alias(ident), (fresh & least.isNull()).alias("created"))
    # rows of one key and id are alike, so they are counted, and one of them is the one that creates
    counted = out.filter(first).groupBy(*keys).agg(F.min("_lk_least").alias(ident), F.count(F.lit(1)).cast("int").alias("_lk_n"))
    creators = counted.withColumn("_lk_i", F.explode(F.sequence(F.lit(1), F.col("_lk_n")))).select(*keys, ident, (F.col("_lk_i") == 1).alias("created"))
    return others.unionByName(creators)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], latest: Column, keep_old: list[str] = (), overwrite: bool = True) -> DataFrame:
    """The target after rows are merged: the latest row of each key wins; columns of keep_old take a null from the old row.

    overwrite=False keeps existing rows as they are.
    """
    new = rows.withColumn("_lk_n", F.row_number().over(Window.partitionBy(*keys).orderBy(latest.desc()))).filter("_lk_n = 1").drop("_lk_n")
    if not overwrite:
        return target.unionByName(new.join(target.select(*keys), keys, "left_anti").select(*target.columns))
    others = [c for c in target.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"_lk_old_{c}") for c in others], F.lit(True).alias("_lk_in_old"))
    n = new.select(*keys, *[c for c in others], F.lit(True).alias("_lk_in_new"))
    both = t.join(n, keys, "full_outer")
    merged = [F.coalesce(c, f"_lk_old_{c}") if c in keep_old else F.when(F.col("_lk_in_new"), F.col(c)).otherwise(F.col(f"_lk_old_{c}")) for c in others]
    return both.select(*keys, *[m.alias(c) for m, c in zip(merged, others, strict=True)]).select(*target.columns)


def upsert_latest_row(target: DataFrame, rows: DataFrame, keys: list[str], created: str = "created_at", ident: str = "id") -> DataFrame:
    """Updates to apply: each row with the id of the newest target row of its key, or null for an insert."""
    newest = target.groupBy(*keys).agg(F.max_by(ident, F.struct(created, ident)).alias("existing_id"))
    return rows.join(newest, keys, "left")


def once(source: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key of source, with _lk_ before the columns: in each column the first non-null value by order, or the least one. So a repeated key multiplies nothing."""
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))) if order else F.min(c)
    return source.groupBy(*keys).agg(*[value(c).alias(f"_lk_{c}") for c in columns])


def coalesce_update(target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Null-preserving update: new values where they are not null. Of a key that repeats in rows see once."""
    out = target.join(once(rows, keys, columns, order), keys, "left")
    return out.select(*[F.coalesce(f"_lk_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def fill_nulls(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Only nulls are filled. Of a key that repeats in source see once."""
    out = target.join(once(source, keys, columns, order), keys, "left")
    return out.select(*[F.coalesce(c, f"_lk_{c}").alias(c) if c in columns else F.col(c) for c in target.columns])


def ensure_ranges(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action): existing, update or insert, by range_start and range_end."""
    old = target.select(*keys, F.col("range_start").alias("_lk_s"), F.col("range_end").alias("_lk_e"))
    action = F.when(F.col("_lk_s").isNull(), "insert").when((F.col("_lk_s") == F.col("range_start")) & (F.col("_lk_e") == F.col("range_end")), "existing").otherwise("update")
    return rows.join(old, keys, "left").select(*rows.columns, action.alias("action"))


def delete_where_in(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def delete_expired(target: DataFrame, as_of: Column, column: str = "expires_at") -> DataFrame:
    """Rows whose lease has not ended: one that ends at as_of stays."""
    return target.filter(~(F.col(column) < as_of) | F.col(column).isNull())


def soft_archive(target: DataFrame, ids: DataFrame, as_of: Column, terminal: list[str]) -> DataFrame:
    """archived_at is set for the ids whose status is terminal and which aren't archived."""
    marked = target.join(ids.select("id").distinct().withColumn("_lk_hit", F.lit(True)), "id", "left")
    when = F.when(F.col("_lk_hit") & F.col("status").isin(terminal) & F.col("archived_at").isNull(), as_of).otherwise(F.col("archived_at"))
    return marked.withColumn("archived_at", when).select(*target.columns)


def with_defaults(rows: DataFrame, **defaults: Column) -> DataFrame:
    """Rows to append, with defaults for columns that are absent or null."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def insert_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """New edges (from_id, to_id, edge_type): no self-loops, no repeats."""
    keys = ["from_id", "to_id", "edge_type"]
    return rows.filter("from_id <> to_id").dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti").select(*rows.columns)


def set_flag(flags: DataFrame, key: str, reasons: list[str], as_of: Column) -> DataFrame:
    new = flags.sparkSession.range(1).select(F.lit(key).alias("key"), F.array(*map(F.lit, reasons)).cast("array<string>").alias("reasons"), as_of.alias("updated_at"))
    return flags.filter(F.col("key") != key).select("key", "reasons", "updated_at").unionByName(new)


def clear_flag(flags: DataFrame, key: str) -> DataFrame:
    return flags.filter(F.col("key") != key)


def session_summary(**sections: Column) -> Column:
    """Non-empty sections under their names, a line each."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n.capitalize()}: "), c)) for n, c in sections.items()])


def store_fan_out(rows: DataFrame, kind: str) -> dict[str, DataFrame]:
    """One stored entity as an entity row, a memory row and an auxiliary chunk."""
    text = F.concat_ws("\n", "title", "content")
    memory = rows.select("project_id", F.lit(kind).alias("kind"), "title", text.alias("content"), F.col("id").alias("provenance_id"))
    chunk = rows.select("project_id", F.lit(f"{kind}_aux").alias("source_type"), F.col("id").alias("source_id"), text.alias("content"))
    return {"entity": rows, "memory": memory, "chunk": chunk}


def resolve_memory_ids(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, memory_id): an id of memory as it is, else the memory row with that provenance, else null."""
    own = memory.select(F.col("id").alias("own_id"))
    via = memory.filter("provenance_id is not null").groupBy(F.col("provenance_id").alias("via_id")).agg(F.min("id").alias("via"))
    out = ids.select("id").join(own, F.col("id") == F.col("own_id"), "left").join(via, F.col("id") == F.col("via_id"), "left")
    return out.select("id", F.coalesce("own_id", "via").alias("memory_id"))


def backfill_counts(rows: DataFrame, memory: DataFrame, kind: str, valid: Column) -> DataFrame:
    """One row: scanned, skipped_no_project, skipped_invalid, would_insert, already."""
    have = memory.filter(F.col("kind") == kind).select(F.col("provenance_id").alias("_lk_p")).distinct()
    flagged = rows.join(have, F.col("id") == F.col("_lk_p"), "left").withColumn("_lk_ok", valid)
    no_project = F.col("project_id").isNull()
    usable = ~no_project & F.col("_lk_ok")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return flagged.agg(F.count(F.lit(1)).alias("scanned"), n(no_project).alias("skipped_no_project"), n(~no_project & ~F.col("_lk_ok")).alias("skipped_invalid"), n(usable & F.col("_lk_p").isNull()).alias("would_insert"), F.greatest(F.lit(0), n(usable & F.col("_lk_p").isNotNull())).alias("already"))


def backfill(rows: DataFrame, memory: Callable[[], DataFrame], kind: str, valid: Column, append: Callable[[DataFrame], None], batch_rows: int = 1_000_000) -> dict[str, int]:
    """Append rows (id, project_id, ...) to memory as (kind, provenance_id, ...) in batches; returns counts.

    Batches are dealt by a hash of the id once, so each reads its own part only. memory is read anew for each batch, so rows that were
    appended meanwhile, by an earlier run or another writer, count as skipped_dup, and running again inserts nothing. A batch whose append fails is
    counted in batch_failures, and the others go on.
    """
    named = rows.withColumn("_lk_state", F.when(F.col("project_id").isNull(), "skipped_no_project").when(~F.coalesce(valid, F.lit(False)), "skipped_invalid").otherwise("ready"))
    counts = {k: 0 for k in ("scanned", "inserted", "skipped_dup", "skipped_no_project", "skipped_invalid", "batch_failures")}
    for r in named.groupBy("_lk_state").agg(F.count(F.lit(1)).alias("n")).collect():
        counts["scanned"] += r["n"]
        if r["_lk_state"] != "ready":
            counts[r["_lk_state"]] = r["n"]
    ready = counts["scanned"] - counts["skipped_no_project"] - counts["skipped_invalid"]
    batches = max(1, -(-ready // batch_rows))
    dealt = cut(named.filter("_lk_state = 'ready'").drop("_lk_state").withColumn("_lk_batch", F.pmod(F.xxhash64("id"), F.lit(batches))).repartitionByRange("_lk_batch", "id"), "backfill")
    for n in range(batches):
        batch = dealt.filter(F.col("_lk_batch") == n).drop("_lk_batch").withColumnRenamed("id", "provenance_id").withColumn("kind", F.lit(kind))
        try:
            new = cut(insert_ignore(memory(), batch, ["provenance_id", "kind"], [F.col("provenance_id")]), "backfill-new")
            append(new)
        except Exception as e:  # noqa: BLE001  whatever a store may raise fails one batch only
            _log.warning("batch %d of %d failed: %s", n + 1, batches, e)
            counts["batch_failures"] += 1
            continue
        inserted = new.count()
        counts["inserted"] += inserted
        counts["skipped_dup"] += batch.count() - inserted
    return counts


def replace_grown(sessions: DataFrame, children: DataFrame, read: DataFrame, rebuild: Callable[[DataFrame], DataFrame], latest: Column, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """sessions and children after rows of read came in. A session is one (source_app, session_id), whatever files it stands in.

    Content that the application has already, by content_hash, is passed over. Of several new rows of a session the last by latest, then content_hash, counts. It takes the place of
    the session's rows, but for the columns of keep, whose old values stay where they are not null. The session's children (source_app, source_id) go and are rebuilt from
    it. A row without a session_id is a session of its own, which nothing replaces. What didn't change leaves all as it was.
    """
    ident = ["source_app", "session_id"]
    fresh = read.dropDuplicates(["source_app", "content_hash"]).join(sessions.select("source_app", "content_hash"), ["source_app", "content_hash"], "left_anti")
    by = Window.partitionBy(*ident).orderBy(latest.desc_nulls_last(), F.desc("content_hash"))
    named = fresh.filter("session_id is not null").withColumn("_lk_n", F.row_number().over(by)).filter("_lk_n = 1").drop("_lk_n")
    old = sessions.groupBy(*ident).agg(*[F.max(c).alias(f"_lk_{c}") for c in keep], F.lit(True).alias("_lk_old"))
    named = named.join(old, ident, "left")
    named = named.select(*[F.coalesce(f"_lk_{c}", c).alias(c) if c in keep else F.col(c) for c in sessions.columns])
    changed = cut(named.unionByName(fresh.filter("session_id is null").select(*sessions.columns)), "grown")
    replaced = changed.filter("session_id is not null").select(*ident)
    kept = sessions.join(replaced, ident, "left_anti").select(*sessions.columns).unionByName(changed)
    rest = children.join(replaced.withColumnRenamed("session_id", "source_id"), ["source_app", "source_id"], "left_anti").select(*children.columns)
    return kept, rest.unionByName(rebuild(changed).select(*children.columns))


def with_total(counts: DataFrame, name: str) -> DataFrame:
    """Rows of counts and their sum as a row named TOTAL."""
    sums = [F.sum(c).alias(c) for c in counts.columns if c != name]
    return counts.unionByName(counts.agg(*sums).withColumn(name, F.lit("TOTAL")))


def import_rows(target: DataFrame, rows: DataFrame, projects: DataFrame, keys: list[str], order: list[Column]) -> dict[str, DataFrame]:
    """Imported rows with the destination's project ids: rows to insert, projects to create, counters."""
    slugs = projects.select(F.col("slug"), F.col("id").alias("_lk_project"))
    mapped = rows.join(slugs, F.col("project_slug") == F.col("slug"), "left").drop("slug")
    stubs = rows.filter("project_slug is not null").select(F.col("project_slug").alias("slug")).distinct().join(slugs, "slug", "left_anti")
    ready = mapped.filter("project_slug is not null").withColumn("project_id", F.coalesce("_lk_project", F.concat(F.lit("new:"), "project_slug"))).drop("_lk_project", "project_slug")
    new = insert_ignore(target, ready, keys, order)
    counters = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("project_slug").isNull()).alias("skipped_no_slug")).crossJoin(new.agg(F.count(F.lit(1)).alias("inserted"))).withColumn("skipped_dup", F.expr("rows - skipped_no_slug - inserted"))
    return {"insert": new, "projects": stubs, "counters": counters}


def import_export(parts: dict[str, DataFrame], targets: dict[str, DataFrame], projects: DataFrame, keys: dict[str, list[str]], append: Callable[[dict[str, DataFrame]], None], dry_run: bool = False) -> dict[str, dict[str, int]]:
    """Import the parts of an export, each into its target; counters by part. Nothing is handed to append, once and with all there is to write, before every part is worked out;
    with dry_run nothing is.
    """
    writes, counters = {}, {}
    stubs = None
    for name, rows in parts.items():
        found = import_rows(targets[name], rows, projects, keys[name], [F.col(k) for k in keys[name]])
        writes[name] = cut(found["insert"], "import")
        stubs = found["projects"] if stubs is None else stubs.unionByName(found["projects"])
        counters[name] = found["counters"].first().asDict()
    if stubs is not None:
        writes["projects"] = cut(stubs.distinct(), "import")
        counters["projects"] = {"inserted": writes["projects"].count()}
    if not dry_run:
        append(writes)
    return counters
