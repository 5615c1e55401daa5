"""Snapshots, counts, attribution, edges, locks, routing and set operations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.jobs import TERMINAL
from larkspur.operators.placing import PART_ROWS, placed, sorted_parts
from larkspur.session import cut, ship


def storage_counts(memory: DataFrame, **tables: DataFrame) -> DataFrame:
    """(name, n): memory by kind, and each table; archived rows count."""
    out = memory.groupBy(F.concat(F.lit("memory:"), "kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name, t in tables.items():
        out = out.unionByName(t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


def write_drift(memory: DataFrame, base: DataFrame) -> bool:
    """Whether the base table has rows while memory has none."""
    return memory.isEmpty() and not base.isEmpty()


def recent(df: DataFrame, n: int, by: str, keys: list[str] | None = None, ident: str = "id") -> DataFrame:
    """The n newest rows, of each key if keys are given."""
    if not keys:
        return df.orderBy(F.desc(by), F.asc(ident)).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(ident))
    return df.withColumn("_lk_n", F.row_number().over(w)).filter(F.col("_lk_n") <= n).drop("_lk_n")


def context_json(df: DataFrame, key: str, by: str, columns: list[str], n: int = 3, ident: str = "id") -> DataFrame:
    """(key, items): the n newest rows of each key as one JSON array."""
    rows = recent(df, n, by, [key], ident)
    items = F.array_sort(F.collect_list(F.struct(F.col(by).alias("_o"), F.col(ident).alias("_i"), F.struct(*columns).alias("v"))), lambda a, b: F.when(a["_o"] > b["_o"], -1).when(a["_o"] < b["_o"], 1).when(a["_i"] < b["_i"], -1).when(a["_i"] > b["_i"], 1).otherwise(0))
    return rows.groupBy(key).agg(F.to_json(F.transform(items, lambda x: x["v"])).alias("items"))


def recent_or_open(archived_at: Column, as_of: Column, hours: int = 24) -> Column:
    """Not archived, or archived within the last hours."""
    return archived_at.isNull() | (archived_at > as_of - F.make_dt_interval(hours=F.lit(hours)))


def project_context(projects: DataFrame, memory: DataFrame, jobs: DataFrame, locks: DataFrame, slug: str, as_of: Column, n: int = 5) -> DataFrame:
    """One row: the project, its n newest live decisions, issues and patterns, open jobs and lately completed ones, and how many locks are live.

    An unknown slug is an error. What memory has no column for is null.
    """
    found = projects.filter(F.col("slug") == slug).limit(1).collect()
    if not found:
        raise ValueError(f"no project {slug!r}")
    of = lambda df: df.filter(F.col("project_id") == found[0]["id"])
    none = lambda name: F.lit(None).cast("string").alias(name)
    title, content, created = F.col("title"), F.col("content"), F.col("created_at")
    shapes = {
        "recent_decisions": ("decision", [title, content.alias("decision"), none("rationale"), created]),
        "recent_issues": ("issue", [title, none("category"), content.alias("description"), none("fix_applied"), created]),
        "relevant_patterns": ("pattern", [title.alias("name"), none("category"), content.alias("description")]),
    }
    live = of(memory).filter("archived_at is null")
    lists = {name: recent(live.filter(F.col("kind") == kind), n, "created_at").select("created_at", "id", F.struct(*shape).alias("v")) for name, (kind, shape) in shapes.items()}
    state = ["title", "status", "current_phase", "branch_name"]
    open_jobs = of(jobs).filter(~F.col("status").isin(TERMINAL) & F.col("archived_at").isNull())
    lists["active_jobs"] = recent(open_jobs, n, "created_at").select("created_at", "id", F.struct(*state).alias("v"))
    done = of(jobs).filter(F.col("status").isin(TERMINAL) & recent_or_open(F.col("archived_at"), as_of))
    lists["recent_completed_jobs"] = recent(done, n, "updated_at").select(F.col("updated_at").alias("created_at"), "id", F.struct(*state, "error_count", "archived_at").alias("v"))
    shown = [c for c in ("name", "description", "root_path", "constraints", "tech_stack") if c in projects.columns]
    out = projects.filter(F.col("slug") == slug).limit(1).select(F.struct(*shown).alias("project"))
    newest_first = lambda a, b: F.when(a["created_at"] > b["created_at"], -1).when(a["created_at"] < b["created_at"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    for name, rows in lists.items():  # n rows each
        out = out.crossJoin(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "v")), newest_first), lambda x: x["v"]).alias(name)))
    return out.crossJoin(of(locks).filter(F.col("expires_at") > as_of).agg(F.count(F.lit(1)).alias("active_file_locks")))


def list_with_counts(parents: DataFrame, children: DataFrame, key: str, live: Column) -> DataFrame:
    """Parents with how many live children they have, 0 included."""
    n = children.filter(live).groupBy(key).agg(F.count(F.lit(1)).alias("live_count"))
    return parents.join(n, parents["id"] == n[key], "left").select(*[parents[c] for c in parents.columns], F.coalesce("live_count", F.lit(0)).alias("live_count"))


def latest_per_key(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*by)).alias("_lk")).select(*keys, "_lk.*")


def longest_prefix(paths: DataFrame, roots: DataFrame, boundary: bool = True) -> DataFrame:
    """(path, slug): the root (slug, root) that is the longest prefix of each path; null without one. Of equal roots the largest slug counts.

    With boundary a path's own prefixes up to each '/' are exploded and meet roots by an equi-join. Without it paths and roots are sorted
    together (see prefix_search).
    """
    distinct = paths.select("path").distinct()
    if boundary:
        parts = F.split(F.rtrim(F.col("path"), F.lit("/")), "/", -1)
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        keyed = distinct.select("path", F.explode_outer(prefixes).alias("prefix"))
        hits = keyed.join(roots.select("slug", F.rtrim(F.col("root"), F.lit("/")).alias("prefix")), "prefix").groupBy("path").agg(F.max_by("slug", F.struct(F.length("prefix"), "slug")).alias("slug"))
    else:
        named = roots.select("slug", F.rtrim(F.col("root"), F.lit("/")).alias("root")).filter("root <> ''").groupBy("root").agg(F.max("slug").alias("slug"))
        found = prefix_search(distinct.filter("path is not null"), named.select("root"))
        hits = found.join(named, "root").select("path", "slug")
    return paths.join(hits, "path", "left")


def prefix_search(paths: DataFrame, roots: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(path, root): the longest root that each path begins with, for distinct paths (path) and distinct roots (root); paths without one are left out.

    Paths and roots are sorted together by range. Whatever stands between a root and a text that begins with it begins with it too, so going
    through a part with a stack of the roots that enclose each other, the top of those that the path begins with is its longest. What a part must know of the parts
    before are the roots that its first text begins with: that text's prefixes, one text a part, meet the roots by an equi-join. So
    each path and root is shuffled once, whatever its length.
    """
    ship(paths.sparkSession)
    both = paths.select(F.col("path").alias("text"), F.lit(False).alias("is_root")).unionByName(roots.select(F.col("root").alias("text"), F.lit(True).alias("is_root")))
    parts = sorted_parts(both, ["text"], "part", part_rows)
    first = parts.groupBy("part").agg(F.min("text").alias("first"))
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.substring(F.col("first"), F.lit(1), i))).alias("text")
    open_ = first.filter("first <> ''").select("part", prefixes).join(roots.select(F.col("root").alias("text")), "text").select("text", F.lit(True).alias("is_root"), "part")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("root", T.StringType())])

    def searched(table: pa.Table) -> pa.Table:
        stack: list[str] = []
        out: list[tuple[str, str]] = []
        rows = zip(table.column("text").to_pylist(), table.column("is_root").to_pylist(), strict=True)
        for text, is_root in sorted(rows, key=lambda r: (r[0].encode(), not r[1])):  # a root before the path that equals it
            while stack and not text.startswith(stack[-1]):
                stack.pop()
            if is_root:
                stack.append(text)
            elif stack:
                out.append((text, stack[-1]))
        return pa.table({"path": pa.array([p for p, _ in out], pa.string()), "root": pa.array([r for _, r in out], pa.string())})

    return parts.select("text", "is_root", "part").unionByName(open_).groupBy("part").applyInArrow(searched, schema)


def attribute_orphans(rows: DataFrame, roots: DataFrame, fallback: str | None = None) -> DataFrame:
    """rows (id, project, path) with project filled by path, and outcome: kept, attributed, fallback or unrecoverable."""
    found = longest_prefix(rows.withColumn("path", F.coalesce("path", F.lit(""))), roots)
    outcome = F.when(F.col("project").isNotNull(), "kept").when(F.col("slug").isNotNull(), "attributed").when(F.lit(fallback is not None), "fallback").otherwise("unrecoverable")
    return found.select(*[c for c in rows.columns if c != "project"], F.coalesce("project", "slug", F.lit(fallback)).alias("project"), outcome.alias("outcome"))


def inherit_project(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Chunks without a project take their session's; those without a session stay."""
    s = sessions.select(F.col("id").alias("_lk_s"), F.col("project_id").alias("_lk_p"))
    out = chunks.join(s, chunks["source_id"] == F.col("_lk_s"), "left")
    return out.withColumn("project_id", F.coalesce("project_id", "_lk_p")).drop("_lk_s", "_lk_p")


def supersede_edges(decisions: DataFrame, memory: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type) between the memory rows of a decision and of the one that supersedes it."""
    m = lambda n: memory.filter("kind = 'decision'").select(F.col("provenance_id").alias(f"{n}_p"), F.col("id").alias(f"{n}_id"))
    pairs = decisions.filter("superseded_by is not null").select(F.col("id").alias("old"), F.col("superseded_by").alias("new"))
    out = pairs.join(m("to"), F.col("old") == F.col("to_p")).join(m("from"), F.col("new") == F.col("from_p"))
    return out.select("from_id", "to_id", F.lit("supersedes").alias("edge_type")).filter("from_id <> to_id").distinct()


def lock_conflicts(requests: DataFrame, locks: DataFrame, as_of: Column) -> DataFrame:
    """(job_id, file_path, owner_job_id): requested paths that a live lock of another job in the project holds."""
    live = locks.filter(F.col("expires_at") >= as_of).select("project_id", "file_path", F.col("job_id").alias("owner_job_id"))
    return requests.join(live, ["project_id", "file_path"]).filter(F.col("job_id") != F.col("owner_job_id")).select("job_id", "file_path", "owner_job_id")


#: Rows of asking jobs that one task decides by itself, in the order of the jobs.
ALONE = 200_000


def _in_order(asked: DataFrame) -> DataFrame:
    """Of a bounded number of rows (job_id, path columns) those of the jobs that find all their paths free as they ask one after the other, in one task."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set[tuple] = set()
        out: list[dict] = []
        schema = None
        for _, rows in groupby((r for b in batches if (schema := b.schema) for r in b.to_pylist()), key=lambda r: r["job_id"]):
            own = list(rows)
            paths = [tuple(r.values())[1:] for r in own]
            if taken.isdisjoint(paths):
                taken.update(paths)
                out += own
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return asked.coalesce(1).sortWithinPartitions("job_id").mapInArrow(decided, asked.schema)


def grant_locks(requests: DataFrame, locks: DataFrame, as_of: Column) -> DataFrame:
    """Locks to append when jobs ask in the order of their ids, each for all its paths or none.

    A job gets its paths unless a live lock, or a lock granted to an earlier job of the batch, holds one of them; a refused job takes
    nothing and stands in nobody's way. A path that the job holds already is not asked again; rows without a job ask for nothing. Rounds decide all jobs that no
    earlier undecided job shares a path with, and those refused by them: a job is free if it comes first on as many paths as it asks for. The last
    ALONE rows are decided by one task in order. Where a round decides fewer, as along a chain of jobs that wait for each other, the next stretch of about ALONE rows is, too,
    so a batch takes at most about two rounds for each ALONE rows, however long its chains. The paths of one job meet in one task.
    """
    ship(requests.sparkSession)
    path = ["project_id", "file_path"]
    live = cut(locks.filter(F.col("expires_at") >= as_of).select(*path, "job_id"), "live")
    # the least and the greatest holder tell whether another job holds a path, however many do
    holders = live.groupBy(*path).agg(F.min("job_id").alias("_lk_low"), F.max("job_id").alias("_lk_high"))
    refused = requests.join(holders, path).filter((F.col("job_id") != F.col("_lk_low")) | (F.col("job_id") != F.col("_lk_high"))).select("job_id").distinct()
    # a hash table of the refused jobs of a task spares the sort of all requests; a job's rows then lie together for what follows
    asked = requests.select("job_id", *path).filter("job_id is not null").join(refused.hint("shuffle_hash"), "job_id", "left_anti").distinct()
    open_ = cut(asked.withColumn("_lk_n", F.count(F.lit(1)).over(Window.partitionBy("job_id"))), "asked")
    granted = open_.limit(0).drop("_lk_n")
    left, stretch = open_.count(), False
    while left > ALONE:
        if stretch:
            head = sorted_parts(open_, ["job_id"], "_lk_part", ALONE).filter("_lk_part = 0").drop("_lk_part")
            now = cut(_in_order(head.drop("_lk_n")), "granted")
        else:
            head = open_.limit(0)
            first = open_.groupBy(*path).agg(F.min("job_id").alias("job_id"), F.min_by("_lk_n", "job_id").alias("_lk_n"))
            won = first.withColumn("_lk_won", F.count(F.lit(1)).over(Window.partitionBy("job_id")))
            now = cut(won.filter("_lk_won = _lk_n").select("job_id", *path), "granted")
        granted = granted.unionByName(now)
        taken = now.select(*[F.col(c).alias(f"_lk_{c}") for c in path])
        same = [F.col(c).eqNullSafe(F.col(f"_lk_{c}")) for c in path]
        out = open_.join(taken, same, "left_semi").select("job_id").unionByName(head.select("job_id")).distinct()  # those that got theirs among them
        open_ = cut(open_.join(out, "job_id", "left_anti"), "asked")
        before, left = left, open_.count()
        stretch = not stretch and before - left < ALONE
    new = granted.unionByName(_in_order(open_.drop("_lk_n"))).join(live, [*path, "job_id"], "left_anti")
    return new.select("job_id", *path, as_of.alias("locked_at"), (as_of + F.expr("interval 2 hours")).alias("expires_at"))


def route(events: DataFrame, devs: DataFrame, enabled: list[str], known: list[str]) -> DataFrame:
    """(event_id, recipient, channel, address, outcome) for events (event_id, event_type, recipient)."""
    d = devs.select(F.col("dev_id").alias("recipient"), "channels", "event_subscriptions")
    out = events.join(d, "recipient", "left")
    outcome = F.when(~F.col("event_type").isin(known), "skipped").when(F.col("event_subscriptions").isNull(), "unknown_dev").when(~F.array_contains("event_subscriptions", F.col("event_type")), "not_subscribed").otherwise("send")
    wanted = F.filter("channels", lambda c: c["type"].isin(enabled))
    out = out.withColumn("outcome", outcome).withColumn("c", F.explode_outer(F.when(F.col("outcome") == "send", wanted)))
    return out.select("event_id", "recipient", F.col("c.type").alias("channel"), F.col("c.address").alias("address"), "outcome")


def fan_out(events: DataFrame) -> DataFrame:
    """Conflict events go to the blocking developer too, if that is someone else."""
    second = events.filter(F.col("event_type").isin("lock_conflict", "blocked") & F.col("blocking_dev").isNotNull() & (F.col("blocking_dev") != F.col("recipient")))
    return events.unionByName(second.withColumn("recipient", F.col("blocking_dev")))


def add_channel(channels: Column, kind: str, address: str) -> Column:
    new = F.struct(F.lit(kind).alias("type"), F.lit(address).alias("address"))
    return F.array_distinct(F.concat(F.coalesce(channels, F.array().cast("array<struct<type:string,address:string>>")), F.array(new)))


def remove_channel(channels: Column, kind: str, address: str) -> Column:
    return F.filter(channels, lambda c: ~((c["type"] == kind) & (c["address"] == address)))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


#: Rows of a key that a task holds on either side, and that one round of greedy_dedup decides.
ROUND = 4096


def _unit(table: pa.Table) -> np.ndarray:
    """The vectors, of length 1, or 0 for a zero vector."""
    v = np.array(table.column("vector").to_pylist(), float).reshape(table.num_rows, -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _similar(new: DataFrame, old: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(id) of the rows of new (id, keys, vector) that are more similar to a row of old of the same keys than the threshold.

    Each key's rows are dealt into blocks of about ROUND rows on either side, as many as that key needs, and each pair of blocks is a matrix product in a task
    of its own. How many blocks a key has travels to its rows by a join on the key, so a large key leaves the others' rows alone.
    """
    ship(new.sparkSession)

    def sized(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROUND).cast("int").alias(n))

    names = [f"_lk_k{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    named = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    # keys without rows on both sides drop out here
    blocks = cut(sized(new, "_lk_na").join(sized(old, "_lk_nb").select(*named, "_lk_nb"), same).select(*names, "_lk_na", "_lk_nb"), "blocks")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.select("id", *keys, "vector").join(blocks, same)
        rows = rows.withColumn(f"_lk_{own}", F.pmod(F.xxhash64("id"), F.col(f"_lk_n{own}")).cast("int"))
        rows = rows.withColumn(f"_lk_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_lk_n{other}") - 1)))
        # columns of their own, as both sides may come from one table
        return rows.select(*[F.col(c).alias(c) for c in ("id", *keys, "vector", "_lk_a", "_lk_b")]).groupBy(*keys, "_lk_a", "_lk_b")

    def near(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hit = (_unit(left) @ _unit(right).T > threshold).any(1) if left.num_rows and right.num_rows else np.zeros(left.num_rows, bool)
        return left.filter(pa.array(hit)).select(["id"])

    return dealt(new, "a", "b").cogroup(dealt(old, "b", "a")).applyInArrow(near, T.StructType([new.schema["id"]])).distinct()


def signed(rows: DataFrame, tables: int, bits: int, seed: int = 11) -> DataFrame:
    """rows (id, key, vector) once for each of `tables` tables, with table and signature: the sides of `bits` random hyperplanes that the vector lies on.

    Two vectors at the angle a lie on the same sides with probability (1 - a / pi) ** bits in each table. Zero vectors, which are similar to nothing, are left out.
    """
    ship(rows.sparkSession)
    schema = T.StructType([rows.schema["id"], rows.schema["key"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("table", T.IntegerType()), T.StructField("signature", T.LongType())])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes[sizes > 0]).tolist():
                own = np.flatnonzero(sizes == size)
                v = np.array([vectors[i] for i in own])
                planes = np.random.default_rng([seed, size]).normal(size=(size, tables * bits))
                side = (v @ planes > 0).reshape(len(own), tables, bits)
                signature = (side * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                has = np.flatnonzero((v != 0).any(1))
                row = np.repeat(has, tables)
                at = pa.array(own[row])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(has))), pa.array(signature[has].reshape(-1))], schema.names)

    return rows.select("id", "key", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null").mapInArrow(sides, schema)


def tables_for(threshold: float, bits: int, sure: float = 0.99) -> int:
    """How many tables find a pair at the threshold with the probability `sure`."""
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - sure) / math.log(1 - share)))


def _near(new: DataFrame, old: DataFrame, key: str, threshold: float, bits: int | None) -> DataFrame:
    """(id) of similar rows of new: of all pairs of a key, or, with bits, of those that share a signature in some table."""
    if bits is None:
        return _similar(new, old, [key], threshold)
    tables = tables_for(threshold, bits)
    both = [signed(df.select("id", F.col(key).alias("key"), "vector"), tables, bits) for df in (new, old)]
    return _similar(*both, ["key", "table", "signature"], threshold)


def similar_existing(new: DataFrame, existing: DataFrame, key: str, threshold: float = 0.85, bits: int | None = None) -> DataFrame:
    """New rows (id, key, vector) without an existing one of the same key that is more similar than the threshold; rows without a key have none.

    bits None compares all pairs of a key. With bits only pairs that lie on the same sides of `bits` random hyperplanes in one of
    tables_for(threshold, bits) tables are compared, by their vectors: a pair at the threshold is missed with the probability 0.01, nearer ones less often.
    """
    return new.join(_near(new, existing.filter(F.col(key).isNotNull()), key, threshold, bits), "id", "left_anti").select(*new.columns)


def greedy_dedup(rows: DataFrame, key: str, order: str, threshold: float = 0.85, bits: int | None = None) -> DataFrame:
    """Rows (id, key, order, vector) that no earlier kept row of their key is more similar to than the threshold.

    Each choice depends on the choices before, so keys are gone through in rounds of ROUND rows: a round's rows are held against
    the rows kept so far (see similar_existing for bits), and what is left is chosen among itself, a key a task. Places in the order are found by range, so no task has
    a whole key. Equal places in the order go by id, which is unique.
    """
    ship(rows.sparkSession)
    with_place = placed(rows.select(key, "id", order, "vector"), key, [order, "id"], "_lk_at")
    rows = cut(with_place.withColumn("_lk_round", F.expr(f"_lk_at div {ROUND}")), "ordered")
    rounds = rows.agg(F.coalesce(F.max("_lk_round"), F.lit(-1))).first()[0] + 1
    schema = rows.schema

    def chosen(table: pa.Table) -> pa.Table:
        table = table.sort_by("_lk_at")
        v, stays = _unit(table), []
        for i in range(len(v)):
            if not (v[stays] @ v[i] > threshold).any():
                stays.append(i)
        return table.take(pa.array(stays, pa.int64()))

    kept = rows.limit(0)
    for n in range(rounds):
        new = rows.filter(F.col("_lk_round") == n)
        if n:
            new = new.join(_near(new, kept, key, threshold, bits), "id", "left_anti").select(*rows.columns)
        kept = kept.unionByName(cut(new.groupBy(key).applyInArrow(chosen, schema), "kept"))
    return kept.select(key, "id", order)
