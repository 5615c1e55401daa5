"""Leases over micro-batches, stores that a merge changes in part, and ranges for many requests."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import merge, ports, stores
from larkspur.streaming import leases

HOUR = 3_600_000


def stamp(ms):
    return f"2024-01-01T{ms // HOUR:02d}:{ms // 60_000 % 60:02d}:00.000Z"


def test_leases_over_micro_batches(spark, tmp_path):
    """Refusal, all or nothing, release, a lease that ran out, and expiry by timer, over batches and a restart between each."""
    source = tmp_path / "in"
    source.mkdir()
    number = iter(range(100))
    base = 1704067200000

    def run(*requests):
        got = []
        rows = [{"project_id": p, "job_id": j, "kind": kind, "paths": paths, "at": stamp(at)} for p, j, kind, paths, at in requests]
        (source / f"{next(number):03d}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("project_id string, job_id long, kind string, paths array<string>, at timestamp").json(str(source))
        q = leases.leases(stream, "1 minute").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, i: got.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((p, j, path, event, (at - base) // 60_000, owner) for p, j, path, event, at, _, owner in got)

    ask = lambda j, paths, at, p="p": (p, j, "acquire", paths, at * 60_000)
    # of one batch the earlier time goes first; the refused job takes nothing, so a later one gets what it wanted too
    first = run(ask(2, ["b", "c"], 1), ask(1, ["a", "b"], 0), ask(3, ["c", "c", None, ""], 2), ask(4, ["a"], 1, "q"), (None, 9, "acquire", ["a"], 0))
    assert first == [("p", 1, "a", "granted", 0, None), ("p", 1, "b", "granted", 0, None), ("p", 2, "b", "refused", 1, 1), ("p", 3, "c", "granted", 2, None), ("q", 4, "a", "granted", 1, None)]
    # its own lease isn't asked again; what it gives up another can take
    second = run(ask(1, ["a", "d"], 10), ("p", 1, "release", ["b", "c"], 11 * 60_000), ask(2, ["b"], 12))
    assert second == [("p", 1, "b", "released", 11, None), ("p", 1, "d", "granted", 10, None), ("p", 2, "b", "granted", 12, None)]
    # 120 minutes after its grant a lease is live still, a minute later it is not
    assert run(ask(5, ["a"], 120)) == [("p", 5, "a", "refused", 120, 1)]
    third = run(ask(5, ["a"], 121))
    assert ("p", 5, "a", "granted", 121, None) in third and all(r[3] == "expired" or r[1] == 5 for r in third)
    # much later all others have run out, by their timers, once each
    last = third + run(ask(7, ["z"], 600, "r")) + run(ask(7, ["y"], 601, "r"))
    expired = [r[:3] for r in last if r[3] == "expired"]
    assert sorted(expired) == [("p", 1, "d"), ("p", 2, "b"), ("p", 3, "c"), ("p", 5, "a"), ("q", 4, "a")]


def files_of(store):
    return {p.split("_lk_bucket=")[1] for p in store.rows.inputFiles() if "_lk_bucket=" in p}


def test_a_merge_writes_touched_buckets_only(spark):
    schema = "k string, j int, v int, t int, other int"
    target = spark.createDataFrame([(f"k{i}", i % 3, i, 0, 1) for i in range(300)], schema)
    store = stores.create_store(target, ["k", "j"], buckets=32)
    before = files_of(store)
    rows = spark.createDataFrame([("k5", 2, 50, 1, 1), ("k5", 2, 51, 2, 1), ("new", 0, 1, 1, 1), ("k8", 2, None, 1, 1)], schema)
    want = {tuple(r) for r in merge.upsert(target, rows, ["k", "j"], F.col("t"), keep_old=["v"]).collect()}
    touched = store.upsert(rows, F.col("t"), keep_old=["v"])
    assert 1 <= len(touched) <= 3
    after = files_of(store)
    assert {tuple(r) for r in store.rows.collect()} == want and len(want) == 301
    of = lambda names: {n for n in names if int(n.split("/")[0]) not in touched}
    assert of(before) == of(after) and len(of(before)) > 25
    assert not (before - of(before)) & after
    again = {tuple(r) for r in store.rows.collect()}
    kept = store.upsert(spark.createDataFrame([("k5", 2, 0, 9, 1), ("k9999", 1, 1, 1, 1)], schema), F.col("t"), overwrite=False)
    assert {tuple(r) for r in store.rows.collect()} == again | {("k9999", 1, 1, 1, 1)} and len(kept) <= 2
    gone = store.delete(spark.createDataFrame([("k5", 2), ("none", 1)], "k string, j int"))
    assert store.rows.filter("k = 'k5'").count() == 0 and store.rows.count() == 301 and len(gone) <= 2


def test_small_stores(spark):
    schema = "k string, v int"
    store = stores.create_store(spark.createDataFrame([], schema), ["k"], buckets=2)
    assert store.rows.count() == 0 and store.upsert(spark.createDataFrame([], schema), F.col("v")) == []
    store.upsert(spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], schema), F.col("v"))
    assert sorted((r.v) for r in store.rows.collect()) == [1, 2, 3]
    store.delete(spark.createDataFrame([("a",), ("b",)], "k string"))
    assert [r.v for r in store.rows.collect()] == [2]
    with pytest.raises(ValueError, match="buckets"):
        stores.create_store(store.rows, ["k"], buckets=0)


def sequential(occupied, requests, cap):
    held: dict = {}
    for host, a, b in occupied:
        held.setdefault(host, set()).update(range(a, b + 1))
    out = []
    for host, seq, base, size in sorted(requests, key=lambda r: (r[0], r[1], r[2], r[3])):
        taken = held.setdefault(host, set())
        at = next((s for s in range(max(base, 1), cap - size + 2) if not taken & set(range(s, s + size))), None)
        if at is not None:
            taken.update(range(at, at + size))
        out.append((host, seq, at, None if at is None else at + size - 1))
    return sorted(out, key=str)


def test_ranges_for_many_requests(spark):
    rng = random.Random(6)
    hosts = ["hot"] * 6 + ["a", "b"]
    occupied = [(rng.choice(hosts), a, a + rng.randrange(4)) for a in (rng.randrange(1, 100) for _ in range(25))]
    requests = [(rng.choice(hosts), i // 2, rng.choice([1, 10, 50, 90]), rng.choice([1, 2, 5, 12])) for i in range(90)]
    got = ports.allocate(spark.createDataFrame(occupied, "host string, range_start int, range_end int"), spark.createDataFrame(requests, "host string, seq int, base int, size int").repartition(5), cap=100)
    assert sorted(map(tuple, got.collect()), key=str) == sequential(occupied, requests, 100)
    odd = spark.createDataFrame([("h", 1, None, 1), ("h", 2, 1, 0), ("h", 3, 1, 101), (None, 4, 1, 1), ("h", 5, 0, 100), ("h", 6, 1, 1)], "host string, seq int, base int, size int")
    none = spark.createDataFrame([], "host string, range_start int, range_end int")
    assert {(r.host, r.seq): r.range_start for r in ports.allocate(none, odd, cap=100).collect()} == {("h", 1): None, ("h", 2): None, ("h", 3): None, (None, 4): 1, ("h", 5): 1, ("h", 6): None}


class Kept:
    """A state and its timers in memory, with the calls that each gets."""

    def __init__(self):
        self.of, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):
        return self

    def _called(self, result=None):
        self.calls += 1
        return result

    containsKey = lambda self, k: self._called(k in self.of)
    getValue = lambda self, k: self._called(self.of[k])
    updateValue = lambda self, k, v: self._called(self.of.__setitem__(k, v))
    removeKey = lambda self, k: self._called(self.of.pop(k, None))
    iterator = lambda self: self._called(iter(list(self.of.items())))
    registerTimer = lambda self, t: self._called(self.timers.add(t))


class At(int):
    getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: int(self)


def test_leases_call_the_state_by_the_path(spark):
    """Many requests for few paths in a batch: the state is called for the paths; all leases that are left run out, each once."""
    kept = Kept()
    keeper = leases.LeaseKeeper(100)
    keeper.init(kept)
    asked = [{"at_ms": 1000 * i, "job_id": i, "kind": "acquire", "paths": [f"p{i % 5}"]} for i in range(500)]
    got = list(keeper.handleInputRows(("p",), iter(asked), None))
    assert [r.event for r in got] == ["granted"] * 500 and kept.calls <= 5 * 3 + 1
    told = []
    while kept.timers:
        now = min(kept.timers)
        kept.timers.remove(now)
        told += keeper.handleExpiredTimer(("p",), At(now), At(now))
    assert sorted((r.path, r.job_id, r.at_ms) for r in told) == sorted((f"p{i % 5}", i, 1000 * i + 101) for i in range(495, 500)) and not kept.of


def test_ranges_of_many_sizes_are_searched_once(spark):
    """One request after the other, of 200 sizes: each goes behind the last one, past what is held, without stepping over all that lies before. Runs that touch become one."""
    host, at = ports._Host(2**31 - 1), 3005
    host.hold(3000, 3004)
    for i in range(20_000):
        size = i * 37 % 200 + 1
        assert host.first(3000, size) == at
        host.hold(at, at + size - 1)
        at += size
    assert host.starts == [3000] and host.ends == [at - 1]
