"""Stored tables: scopes, clustering, lakes, custody chains and staged sessions on hand-made rows."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from timeloom import registry
from timeloom.operators import correlation, integrity, sinks
from timeloom.sources import fixture, storage

SF = "/root/testdata/sf0.01"


def test_scopes_remove_what_was_made_inside(spark):
    path = storage.table_path(spark, "kept")
    source = spark.range(10)
    with storage.scope(spark):
        inner = storage.stored(source, "inner")
        with storage.scope(spark):
            nested = storage.stored(inner, "nested")
        assert not storage.exists(spark, nested.stored_at) and storage.exists(spark, inner.stored_at)
        kept = storage.stored(inner, "out", path=path)
        held = storage.derived(spark, f"{SF}/nation.parquet", "of-scope", lambda: spark.range(3))
    assert not storage.exists(spark, inner.stored_at) and kept.count() == 10 and held.count() == 3
    with pytest.raises(ZeroDivisionError), storage.scope(spark):
        lost = storage.stored(source, "lost")
        raise ZeroDivisionError
    assert not storage.exists(spark, lost.stored_at)


def test_cleaning_returns_to_the_sessions_setting(spark):
    spark.conf.set(storage._CLEAN, "false")
    with storage._cleaned(spark):
        with storage._cleaned(spark):
            pass
        assert spark.conf.get(storage._CLEAN) == "true"
    assert spark.conf.get(storage._CLEAN) == "false"


def scanned(df) -> int:
    """Rows that the scans of a plan gave, after row groups and pages were skipped."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_lookups_skip_what_cannot_hold_the_id(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("concat('ev', lpad(cast(id * 7919 % 200000 AS string), 8, '0')) AS event_id", "cast(timestamp_seconds(id) AS string) AS event_time_utc", "uuid() AS ref")
    table = storage.stored(storage.clustered(rows, ["event_time_utc", "event_id"]), "clustered", ("event_id",))
    assert scanned(table.where("event_id = 'absent'")) == 0
    assert 0 < scanned(table.where("event_id = 'ev00000042'")) < 120_000
    assert 0 < scanned(table.where("event_time_utc = '1970-01-01 10:00:00'")) <= 30_000


def test_one_type_of_a_lake_is_replaced(spark, tmp_path):
    folder = str(tmp_path / "lake")
    rows = spark.createDataFrame([(k, "mft" if k % 3 else "evtx", None if k == 4 else "x") for k in range(30)], "id long, artifact_type string, v string")
    sinks.write_lake(rows, folder)
    files = lambda kind: {(f, os.stat(f"{folder}/artifact_type={kind}/{f}").st_mtime_ns) for f in os.listdir(f"{folder}/artifact_type={kind}") if f.endswith("parquet")}
    before, replaced = files("mft"), files("evtx")
    sinks.write_lake(rows.where("artifact_type = 'evtx' AND id < 10").withColumn("v", F.lit("new")), folder)
    assert files("mft") == before and files("evtx").isdisjoint(replaced)
    got = sinks.scan_table(spark, folder, rows.schema)
    assert sorted(tuple(r) for r in got.where("artifact_type = 'evtx'").collect()) == [(k, "evtx", "new") for k in (0, 3, 6, 9)] and got.count() == 24
    plan = got.where("artifact_type = 'evtx'")._jdf.queryExecution().executedPlan().toString()
    assert "artifact_type" in plan.split("PartitionFilters: [")[1].split("]")[0]


def folded(digests, size):
    level = list(digests)
    while True:
        heads = []
        for lo in range(0, len(level), size):
            last = ""
            for d in level[lo : lo + size]:
                last = hashlib.sha256((last + d).encode()).hexdigest()
            heads.append(last)
        if len(heads) == 1:
            return heads[0]
        level = heads


def test_ledger(spark, monkeypatch):
    monkeypatch.setattr(integrity, "SEGMENT", 4)
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(45)]
    log = spark.createDataFrame([*enumerate(digests)], "seq long, digest string")
    ledger = storage.stored(integrity.seal(log), "ledger")
    assert integrity.ledger_root(ledger).first()[0] == folded(digests, 4) and not integrity.ledger_breaks(ledger).count()
    assert {r.status: r.n for r in integrity.custody_counts(ledger, log).collect()} == {"ok": 45}
    now = spark.createDataFrame([(k, digests[{3: 9, 9: 3}.get(k, k)] if k != 20 else "forged") for k in range(45) if k != 30] + [(77, "more")], "seq long, digest string")
    assert {r.status: r.n for r in integrity.custody_counts(ledger, now).collect()} == {"ok": 41, "moved": 2, "changed": 1, "removed": 1, "added": 1}
    at = lambda level, seq: (F.col("level") == level) & (F.col("seq") == seq)
    broken = lambda df: {(r.level, r.seq) for r in integrity.ledger_breaks(df).collect()}
    assert broken(ledger.withColumn("digest", F.when(at(0, 6), "x").otherwise(F.col("digest")))) == {(0, 6)}
    assert (0, 7) in broken(ledger.where(~at(0, 6)))
    swapped = ledger.withColumn("seq", F.when(at(0, 4), 5).when(at(0, 5), 4).otherwise(F.col("seq")))
    assert broken(swapped) >= {(0, 4), (0, 5)}
    whole = log.where("seq < 8 AND seq >= 0").unionByName(spark.createDataFrame([(k, "z") for k in range(8, 12)], "seq long, digest string"))
    other = storage.stored(integrity.seal(whole), "other")
    mixed = ledger.where("NOT (level = 0 AND seq BETWEEN 8 AND 11)").unionByName(other.where("level = 0 AND seq >= 8"))
    assert broken(mixed) == {(0, 8)}  # a segment that is right in itself, but not the one sealed above


def brute_way(stages):
    """The longest rising way, then that with the greatest stages, by all subsets."""
    best = (0, 0)
    for mask in range(1 << 5):
        want, k = [s for s in range(1, 6) if mask >> (s - 1) & 1], 0
        for s in stages:
            if k < len(want) and s == want[k]:
                k += 1
        if k == len(want):
            best = max(best, (len(want), mask))
    return best


def test_stages_of_sessions(spark):
    actions = {1: ("browser", "browser_download"), 2: ("usn_jrnl", "usn_created"), 3: ("prefetch", "prefetch_execution"), 4: ("registry_hive", "registry_run_key"), 5: ("usn_jrnl", "usn_deleted"), 0: ("lnk", "lnk_target_reference")}
    r, rows, want = random.Random(3), [], {}
    for key in range(40):
        t, session, seen = 0, 1, []
        for k in range(r.randint(1, 14)):
            step = r.choice([0, 60, 3600, 3601, 90_000])
            if k and step > 3600:
                want[f"key{key}.exe", session] = seen
                session, seen = session + 1, []
            t += step
            s = r.randint(0, 5)
            seen.append(s)
            rows.append((f"e{key:03}-{k:03}", *actions[s], f"C:/a/key{key}.exe", f"2024-01-{1 + t // 86400:02}T{t // 3600 % 24:02}:{t // 60 % 60:02}:{t % 60:02}Z"))
        want[f"key{key}.exe", session] = seen
    er = spark.createDataFrame(rows, "event_id string, artifact_type string, event_action string, file_path string, event_time_utc string")
    for c in ("process_name", "ip", "hash", "url", "user_name"):
        er = er.withColumn(c, F.lit(None).cast("string"))
    got = {(x.key, x.session): (x.stages, x.events) for x in correlation.chain_windowed(er).collect()}
    ways = {k: (brute_way(v), len(v)) for k, v in want.items()}
    names = list(correlation.STAGES)
    assert got == {k: (">".join(n for j, n in enumerate(names) if mask >> j & 1), size) for k, ((n_, mask), size) in ways.items() if n_ >= 2} and len(got) > 10


def test_fixture_lookups(spark):
    assert fixture.events_full(spark, SF).where("event_id = 'ev00000042'").count() == 1


def test_a_streamed_session_ends_at_a_gap_of_a_second_more(spark, tmp_path):
    from timeloom.streaming import streams

    at = lambda second: f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"
    rows = [("a.exe", at(0), "prefetch"), ("a.exe", at(3600), "evtx"), ("a.exe", at(7201), "prefetch"), ("a.exe", at(7202), "evtx"), ("z.exe", "2024-01-05T00:00:00Z", "evtx")]
    er = spark.createDataFrame([(f"ev{k}", n, t, a, None, None, None, None, None) for k, (n, t, a) in enumerate(rows)], "event_id string, process_name string, event_time_utc string, artifact_type string, file_path string, ip string, hash string, url string, user_name string")
    er.coalesce(1).write.parquet(str(tmp_path / "er"))
    got = streams.run(streams.stream_sessions(spark.readStream.schema(er.schema).parquet(str(tmp_path / "er"))), "stream-gaps")
    assert sorted((r.start.isoformat(), r.events) for r in got.collect()) == [("2024-01-01T00:00:00", 2), ("2024-01-01T02:00:01", 2)]


def test_custody_of_a_ledger_of_more_than_two_levels(spark, monkeypatch):
    from compare import connect, differ

    monkeypatch.setattr(integrity, "SEGMENT", 4)
    sql = registry.ORACLES["custody_counts"].replace(f"// {sinks.SEGMENT}", "// 4")
    assert not differ(spark, connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", lambda spark, sf_dir: sinks._custody((spark, sf_dir)), sql)


def test_postings_by_versions_in_any_order_without_state(spark, tmp_path):
    from timeloom.streaming import streams

    rows = [("a", 1, "x y x"), ("a", 3, "Y-y z"), ("a", 2, "late x"), ("b", 2, None), ("b", 1, "x"), ("c", 1, ""), ("d", 1, None), ("d", 2, "z z")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "doc string, version long, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"v/k={k}"))
    stream = spark.readStream.schema("doc string, version long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    out = streams.stream_postings(stream)
    assert "State" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in streams.current_postings(streams.run(out, "stream-versions")).collect()) == [("y", "a", 2), ("z", "a", 1), ("z", "d", 2)]


def test_events_are_projected_behind_the_shuffle(spark, monkeypatch):
    made = []
    monkeypatch.setattr(fixture, "derived", lambda spark, source, name, make, **_: made.append(make()) or make())
    fixture.event_rows(spark, "/root/testdata/sf0.001")
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "Project [" in above and "Project [" not in below and "event_action" not in below


def test_chains_stream_by_buckets_of_keys(spark, tmp_path):
    from timeloom.streaming import streams

    actions = {1: ("browser", "browser_download"), 2: ("usn_jrnl", "usn_created"), 3: ("prefetch", "prefetch_execution"), 4: ("registry_hive", "registry_run_key"), 5: ("usn_jrnl", "usn_deleted"), 0: ("lnk", "lnk_target_reference")}
    r, rows, names = random.Random(5), [], list(correlation.STAGES)
    for k in range(600):
        t, s = k * 1200 + r.randrange(7200), r.randint(0, 5)  # nine days, some hours out of order
        rows.append((f"e{k:03}", *actions[s], f"C:/a/key{r.randrange(40)}.exe", f"2024-01-{1 + t // 86400:02}T{t // 3600 % 24:02}:{t // 60 % 60:02}:{t % 60:02}Z", t, s))
    end, want, seen = max(x[5] for x in rows) - 86400, {}, {}
    for ident, _, _, path, _, t, s in sorted(rows, key=lambda x: (x[5], x[0])):
        session = seen.get(path)
        if session is None or t - session[-1][0] > 21_600:
            session = seen[path] = want.setdefault((path[5:], t), [])
        session.append((t, s))
    ways = {k: (v[-1][0], len(v), *brute_way([s for _, s in v])) for k, v in want.items()}
    want = {(key, t): (last, size, ">".join(n for j, n in enumerate(names) if mask >> j & 1)) for (key, t), (last, size, n_, mask) in ways.items() if n_ >= 2 and last + 21_600 < end}
    er = spark.createDataFrame([x[:5] for x in rows], "event_id string, artifact_type string, event_action string, file_path string, event_time_utc string")
    for c in ("process_name", "ip", "hash", "url", "user_name"):
        er = er.withColumn(c, F.lit(None).cast("string"))
    table = storage.stored(storage.clustered(er, ["event_time_utc"]), "chain-events")
    out = streams.stream_chains(streams.stream_of(table).repartition(2), seconds=21_600, buckets=4)
    asked = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    asked.awaitTermination()
    base = 1704067200
    got = {(x.key, x.start - base): (x["last"] - base, x.events, x.stages) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and len(got) > 20
    assert max(o.numRowsTotal for p in asked.recentProgress for o in p.stateOperators) <= 4  # a state a bucket, not one a key


def test_events_are_made_in_whole_rounds_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(fixture, "_SIZE", storage.size_of(spark, f"{SF}/events.parquet") // 5)
    made = []
    monkeypatch.setattr(fixture, "derived", lambda spark, source, name, make, **_: made.append(make()) or made[0])
    fixture.event_rows(spark, SF)
    assert made[0].rdd.getNumPartitions() % spark.sparkContext.defaultParallelism == 0
