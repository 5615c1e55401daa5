"""Job pipeline analytics (A5, A6, A12-A17, N5, N6, J16, J22, R6, T4, P1, P6): aggregates and windows over jobs and artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.findings import repeated_findings, severity_items

# Legal moves of the job state machine, and which phases are reviews and fixes (both spellings that logs have).
TRANSITIONS = {
    "queued": ["planning"],
    "planning": ["implementing", "blocked", "failed"],
    "blocked": ["implementing", "planning", "rejected", "failed"],
    "implementing": ["reviewing", "failed"],
    "reviewing": ["qa", "fix_loop", "failed"],
    "qa": ["ready_for_approval", "fix_loop", "failed"],
    "fix_loop": ["implementing", "failed"],
    "ready_for_approval": ["approved", "rejected"],
    "approved": ["deployed"],
    "rejected": [],
    "deployed": [],
    "failed": ["queued"],
}
TERMINAL = ["approved", "rejected", "deployed", "failed"]
REVIEWS, FIXES = ["review", "reviewing", "qa"], ["fix", "fix_loop"]


def matching(df: DataFrame, **filters: object) -> DataFrame:
    """Equality filters for the arguments that aren't None; a list means membership."""
    given = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in filters.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def since(ts: Column, as_of: Column, hours: float) -> Column:
    return ts >= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours * 3600)))


def queue_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id"))


def next_queued(jobs: DataFrame) -> DataFrame:
    return queue_order(jobs.filter("status = 'queued' and archived_at is null")).limit(1)


def phase_counts(artifacts: DataFrame) -> DataFrame:
    """(job_id, phase_counts map, total_findings, total_blocking, phases in order of first appearance)."""
    by_phase = artifacts.groupBy("job_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("findings_count", F.lit(0))).alias("f"), F.sum(F.coalesce("blocking_count", F.lit(0))).alias("b"), F.min(F.struct("created_at", "id")).alias("first"))
    packed = F.array_sort(F.collect_list(F.struct("first", "phase", "n")))
    out = by_phase.groupBy("job_id").agg(packed.alias("p"), F.sum("f").alias("total_findings"), F.sum("b").alias("total_blocking"))
    return out.select("job_id", F.map_from_entries(F.transform("p", lambda x: F.struct(x["phase"], x["n"]))).alias("phase_counts"), "total_findings", "total_blocking", F.transform("p", lambda x: x["phase"]).alias("phases"))


def failure_category(artifacts: DataFrame) -> DataFrame:
    """(job_id, category, blocking, fix_attempts): qa_failure, persistent_blocking or unknown."""
    blocking = F.sum(F.when(F.col("phase").isin(REVIEWS), F.coalesce("blocking_count", F.lit(0))).otherwise(0))
    out = artifacts.groupBy("job_id").agg(blocking.alias("blocking"), F.count_if(F.col("phase").isin(FIXES)).alias("fix_attempts"))
    category = F.when((F.col("blocking") > 0) & (F.col("fix_attempts") > 0), "qa_failure").when(F.col("blocking") > 0, "persistent_blocking").otherwise("unknown")
    return out.select("job_id", category.alias("category"), "blocking", "fix_attempts")


def fix_convergence(artifacts: DataFrame) -> DataFrame:
    """(job_id, converging): the last blocking count of a review is below the first; two at least."""
    rows = artifacts.filter(F.col("phase").isin(REVIEWS) & (F.col("blocking_count") > 0))
    at = F.struct("created_at", "id")
    out = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("blocking_count", at).alias("first"), F.max_by("blocking_count", at).alias("last"))
    found = out.select("job_id", ((F.col("n") >= 2) & (F.col("last") < F.col("first"))).alias("converging"))
    return artifacts.select("job_id").distinct().join(found, "job_id", "left").select("job_id", F.coalesce("converging", F.lit(False)).alias("converging"))


def reduce_checks(checks: DataFrame) -> DataFrame:
    """(job_id, passed, failing): checks (job_id, name, ok)."""
    return checks.groupBy("job_id").agg(F.bool_and("ok").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failing"))


def blocked_recommendation(conflicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, recommendation): wait while a blocking job is active, replan if one has completed, else proceed."""
    status = conflicts.join(jobs.select(F.col("id").alias("blocking_job_id"), "status"), "blocking_job_id", "left")
    active = F.coalesce(F.bool_or(~F.col("status").isin(TERMINAL)), F.lit(False))
    done = F.coalesce(F.bool_or(F.col("status").isin("approved", "deployed")), F.lit(False))
    return status.groupBy("job_id").agg(F.when(active, "wait").when(done, "replan").otherwise("proceed").alias("recommendation"))


def last_round(artifacts: DataFrame, per_round: int = 2) -> DataFrame:
    """The review artifacts of the round before the newest, for jobs that have two rounds."""
    w = Window.partitionBy("job_id")
    numbered = artifacts.filter(F.col("phase").isin("review", "reviewing")).withColumn("_lk_n", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("id")))).withColumn("_lk_all", F.count(F.lit(1)).over(w))
    return numbered.filter((F.col("_lk_n") > per_round) & (F.col("_lk_n") <= 2 * per_round) & (F.col("_lk_all") >= 2 * per_round)).drop("_lk_n", "_lk_all")


def since_marker(artifacts: DataFrame, phases: list[str]) -> DataFrame:
    """Rows after the last row of one of the phases, that row included; all rows if there is none."""
    marker = F.max(F.when(F.col("phase").isin(phases), F.struct("created_at", "id"))).over(Window.partitionBy("job_id"))
    return artifacts.withColumn("_lk_m", marker).filter(F.col("_lk_m").isNull() | (F.struct("created_at", "id") >= F.col("_lk_m"))).drop("_lk_m")


def prior_items(artifacts: DataFrame, severity: str = "BLOCKING") -> DataFrame:
    """(job_id, artifact_type, item): each marked item of every earlier round."""
    newest = F.max(F.struct("created_at", "id")).over(Window.partitionBy("job_id", "artifact_type"))
    earlier = artifacts.withColumn("_lk_new", newest).filter(F.struct("created_at", "id") < F.col("_lk_new"))
    return earlier.select("job_id", "artifact_type", F.explode(severity_items(F.col("content"), severity)).alias("item"))


def oscillation(rounds: DataFrame) -> DataFrame:
    """rounds (job_id, current, prior), arrays of (title, body): what is repeated."""
    return rounds.select("job_id", repeated_findings(F.col("current"), F.col("prior")).alias("repeating"))


def review_gate(reviews: DataFrame, warnings_block: bool) -> DataFrame:
    """(job_id, round, next_status, reason) from two reviewers' counts.

    reviews: job_id, round, blocking_count, warning_count, malformed_multiple, error_count, repeating (a warning that came back).
    """
    silent = F.bool_or(F.col("malformed_multiple") & (F.col("blocking_count") + F.col("warning_count") == 0))
    g = reviews.groupBy("job_id", "round").agg(F.sum("blocking_count").alias("b"), F.sum("warning_count").alias("w"), F.coalesce(silent, F.lit(False)).alias("silent"), F.max("error_count").alias("errors"), F.coalesce(F.bool_or("repeating"), F.lit(False)).alias("repeats"))
    warned = F.lit(warnings_block) & (F.col("w") > 0)
    escalate = (F.col("b") == 0) & warned & (F.col("errors") >= 1) & F.col("repeats")
    status = F.when(escalate, "failed").when((F.col("b") > 0) | warned | F.col("silent"), "fix_loop").otherwise("qa")
    reason = F.when(escalate, "warning_oscillation").when(F.col("b") > 0, "blocking").when(warned, "warnings").when(F.col("silent"), "malformed_review").otherwise("clean")
    return g.select("job_id", "round", status.alias("next_status"), reason.alias("reason"))


def legal(before: Column, after: Column) -> Column:
    """Whether a status may follow another."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, before), after), F.lit(False))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Rows of a status log (job_id, seq, status) that may not follow the one before."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & ~legal(F.col("before"), F.col("status")))


def transition(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Jobs after moves (id, new_status) that are legal; fix_loop adds to error_count. Illegal ones change nothing."""
    m = moves.select("id", "new_status")
    out = jobs.join(m, "id", "left")
    ok = F.col("new_status").isNotNull() & legal(F.col("status"), F.col("new_status"))
    errors = F.col("error_count") + F.when(ok & (F.col("new_status") == "fix_loop"), 1).otherwise(0)
    return out.withColumn("error_count", errors).withColumn("status", F.when(ok, F.col("new_status")).otherwise(F.col("status"))).select(*jobs.columns)


def resolve_blocked(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (id, resolution) on blocked jobs: proceed, replan or cancel."""
    out = jobs.join(decisions.select("id", "resolution"), "id", "left")
    hit = (F.col("status") == "blocked") & F.col("resolution").isin("proceed", "replan", "cancel")
    to = F.when(F.col("resolution") == "proceed", "implementing").when(F.col("resolution") == "replan", "planning").otherwise("rejected")
    return out.withColumn("blocked_resolution", F.when(hit, F.col("resolution")).otherwise(F.col("blocked_resolution"))).withColumn("status", F.when(hit, to).otherwise(F.col("status"))).select(*jobs.columns)
