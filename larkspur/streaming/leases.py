"""Leases on files as state of a stream (R5, R7): jobs ask for all their paths or none, leases run out by timers.

Each project is a key of the state, since any two of its requests may share a path. Its leases lie in the state store, a path an entry, and not in memory. A micro-batch's
requests of a project are taken in the order of their time, then job; how many that are is set by the source's options for a trigger. A path that they name is read from
the state once and written once, and a batch sets one timer a project, for the first expiry of its leases, which then sets the next; so the calls to the state grow with the
paths and not with the requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.session import ship

#: How long a lease lasts.
LEASE_MS = 2 * 60 * 60 * 1000
#: What leases gives.
EVENTS = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("job_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("event", T.StringType()), T.StructField("at_ms", T.LongType()), T.StructField("expires_ms", T.LongType()), T.StructField("owner_job_id", T.LongType())])


class LeaseKeeper(StatefulProcessor):
    """What the requests of a project come to: granted, refused, released and expired leases, a row each."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        path = T.StructType([T.StructField("path", T.StringType())])
        self.leases = handle.getMapState("leases", path, T.StructType([T.StructField("job_id", T.LongType()), T.StructField("expires_ms", T.LongType())]))

    def _stored(self, path: str) -> tuple[int, int] | None:
        """(job, expiry) of the lease on a path."""
        found = self.leases.getValue((path,)) if self.leases.containsKey((path,)) else None
        return (found[0], found[1]) if found else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        stored: dict[str, tuple[int, int] | None] = {}  # the paths of this batch, as the state has them
        now: dict[str, tuple[int, int] | None] = {}  # and as its requests leave them
        for at, job, kind, paths in sorted((r["at_ms"], r["job_id"], r["kind"], sorted({p for p in r["paths"] or [] if p})) for r in rows):
            for p in paths:
                if p not in stored:
                    stored[p] = now[p] = self._stored(p)
            held = {p: now[p] if now[p] and now[p][1] >= at else None for p in paths}  # one that ends now is live
            if kind == "release":
                for p in paths:
                    if held[p] and held[p][0] == job:
                        now[p] = None
                        yield Row(project_id=key[0], job_id=job, path=p, event="released", at_ms=at, expires_ms=held[p][1], owner_job_id=None)
                continue
            others = {p: h for p, h in held.items() if h and h[0] != job}
            for p in paths:
                if others:
                    if p in others:
                        yield Row(project_id=key[0], job_id=job, path=p, event="refused", at_ms=at, expires_ms=others[p][1], owner_job_id=others[p][0])
                elif not held[p]:  # its own live lease isn't asked again
                    now[p] = job, at + self.lease_ms
                    yield Row(project_id=key[0], job_id=job, path=p, event="granted", at_ms=at, expires_ms=at + self.lease_ms, owner_job_id=None)
        fresh = [lease[1] + 1 for p, lease in now.items() if lease and lease != stored[p]]
        for p, lease in now.items():
            if lease is None and stored[p] is not None:
                self.leases.removeKey((p,))
            elif lease is not None and lease != stored[p]:
                self.leases.updateValue((p,), lease)
        if fresh:
            self.handle.registerTimer(min(fresh))  # later ones follow from there

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [(p[0], lease) for p, lease in self.leases.iterator()]
        for path, lease in sorted(x for x in held if x[1][1] < now):
            self.leases.removeKey((path,))
            yield Row(project_id=key[0], job_id=lease[0], path=path, event="expired", at_ms=lease[1] + 1, expires_ms=lease[1], owner_job_id=None)
        left = [lease[1] + 1 for _, lease in held if lease[1] >= now]
        if left:
            self.handle.registerTimer(min(left))

    def close(self) -> None:
        pass


def leases(requests: DataFrame, delay: str = "10 minutes", lease_ms: int = LEASE_MS) -> DataFrame:
    """(project_id, job_id, path, event, at_ms, expires_ms, owner_job_id) from a stream of requests (project_id, job_id, kind, paths, at), kind 'acquire' or 'release'.

    acquire takes all of the paths or none: if a live lease of another job holds one of them the job is refused, with a row for each such path, and takes nothing; else each path that it
    doesn't hold itself is granted. release gives up what the job holds. A lease that ran out doesn't stand in anyone's way, whether or not the watermark has passed it;
    once it has, the lease leaves the state and is told as expired. Requests without a project, job or time are left out; null and empty paths are none. The session needs the RocksDB state store.
    """
    ship(requests.sparkSession)
    known = requests.withWatermark("at", delay).filter("project_id is not null and job_id is not null and at is not null")
    rows = known.select(F.col("project_id").cast("string").alias("project_id"), F.col("job_id").cast("long").alias("job_id"), "kind", "paths", F.unix_millis("at").alias("at_ms"), "at")
    return rows.groupBy("project_id").transformWithState(LeaseKeeper(lease_ms), EVENTS, "append", "EventTime")
