"""Edge rows that the tables don't have: nulls, blanks, metacharacters, bad times, cycles, streams against batch."""

import pytest
from pyspark.sql import functions as F

from timeloom.functions import columns as C
from timeloom.operators import correlation, defender, filters, findings, graph, integrity, ioc, lineage, sequences, summaries, textindex


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column("x").alias("y")).first()["y"]


@pytest.mark.parametrize("value,want", [("C:\\A\\b.EXE", "b.exe"), ("/usr/x", "x"), ("x", "x"), (None, None), ("", "")])
def test_basename(spark, value, want):
    assert one(spark, value, C.basename) == want


@pytest.mark.parametrize("value,want", [('"C:\\t\\Evil.exe" -x', "evil.exe"), ("run.ps1 a", "run.ps1"), (None, None)])
def test_process_basename(spark, value, want):
    assert one(spark, value, C.process_basename) == want


@pytest.mark.parametrize("value,want", [("xx NT AUTHORITY\\SYSTEM", "NT AUTHORITY\\SYSTEM"), ("bob", "bob"), (None, None)])
def test_sanitize_account(spark, value, want):
    assert one(spark, value, C.sanitize_account) == want


@pytest.mark.parametrize(
    "value,want",
    [("1704067200", "2024-01-01 00:00:00"), ("1704067200000", "2024-01-01 00:00:00"), ("1704067200000000", "2024-01-01 00:00:00"), ("133485408000000000", "2024-01-01 00:00:00"),
     ("13348540800000000", "2024-01-01 00:00:00"), ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"), ("x", None), ("5", None), (None, None)],
)
def test_normalize_time(spark, value, want):
    got = one(spark, value, C.normalize_time)
    assert (got and got.strftime("%Y-%m-%d %H:%M:%S")) == want


def test_metacharacters_are_plain_text(spark):
    rows = spark.createDataFrame([(1, "50%_a.b*c", "x.asp"), (2, "50xya.bxc", "x.aspx")], "event_id int, search_text string, file_path string")
    rows = rows.withColumn("process_name", F.lit(None).cast("string")).withColumn("message_short", F.lit(""))
    ids = lambda c: [r[0] for r in rows.where(c).collect()]
    assert ids(filters.contains("50%_A.B*")) == [1]
    assert ids(filters.word("b*c")) == [1]
    assert ids(filters.extension("asp")) == [1]
    assert ids(filters.glob("search_text", "50?ya*")) == [2]


def test_long_texts_are_searched_whole(spark):
    from timeloom.plans.read_models import compact_rows
    from timeloom.sources import fixture

    ef = fixture.events_full(spark, "/root/testdata/sf0.001").limit(1).drop("message_full", "attributes_json")
    words = "http://one.example/a CVE-2024-11111 http://two.example/b CVE-2024-22222 schtasks /create /tn z lastword"
    for message, attributes in (("x " * 4000 + words, "{}"), ("m", '{"note":"' + "y " * 4000 + words + '"}')):
        er = compact_rows(ef.withColumn("message_full", F.lit(message)).withColumn("attributes_json", F.lit(attributes)))
        assert er.where(filters.contains("CVE-2024-22222") & filters.word("lastword") & F.col("search_text").rlike("schtasks /create")).count() == 1
        assert {r["ioc"] for r in ioc.ioc_match(er, ["http://two.example/b", "cve-2024-11111", "absent"]).collect()} == {"http://two.example/b", "cve-2024-11111"}


def test_no_rows_beyond_a_limit_are_dropped(spark):
    from timeloom.operators import aggregates, triage

    n = 300_001
    hour = F.date_format(F.timestamp_seconds(F.col("id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    names = ["event_action", "process_name", "message_full", "attributes_json", "artifact_type", "host", "user_name", "message_short", "file_path", "ip", "url", "hash", "source_file_id", "parser_name"]
    rows = spark.range(n).select(F.col("id").cast("string").alias("event_id"), hour.alias("event_time_utc"), F.lit("high").alias("severity"), *[F.lit("powershell").alias(c) for c in names])
    assert summaries.detection_candidates(rows).count() == n and summaries.detection_candidates(rows, 5).count() == 5
    assert triage.export_rows(rows).count() == n
    assert {r["truncated"] for r in triage.export_rows(rows, 5).collect()} == {True}
    assert {r["truncated"] for r in triage.export_rows(rows.limit(5), 5).collect()} == {False}
    bins = aggregates.event_timeline(rows)
    assert bins.count() == n and bins.agg(F.sum("high")).first()[0] == n
    got = sorted(map(tuple, aggregates.timeline_columns(bins).collect()))
    assert [r[0] for r in got] == list(range(200)) and sum(r[3] for r in got) == n and {r[3] for r in got[:-1]} == {1501}
    assert got[0][1] == "1970-01-01T00:00:00Z" and all(a[2] < b[1] for a, b in zip(got, got[1:], strict=False))
    codes = spark.createDataFrame([(str(k),) for k in range(60)], "event_code string")
    assert codes.where(filters.form([str(k) for k in range(60)])).count() == 60


def test_heuristics_of_the_survey(spark):
    import json

    from timeloom.operators import aggregates, heuristics

    events = [
        ("c1", "4720", "01", {"TargetUserName": "Bob", "TargetSid": "S-1"}), ("g1", "4732", "02", {"MemberSid": "S-1", "MemberName": "-", "TargetUserName": "Administrators"}),
        ("g2", "4728", "03", {"MemberName": "CN=bob,OU=x", "TargetUserName": "Domain Admins"}), ("g3", "4756", "04", {"MemberSid": "S-2", "MemberName": "DOM\\bob", "TargetUserName": "Z"}),
        ("g4", "4756", "28", {"MemberSid": "S-1", "TargetUserName": "late"}),
        ("l1", "4624", "05", {"LogonType": "3", "AuthenticationPackageName": "NTLM"}), ("l2", "4624", "05", {"LogonType": 9, "LogonProcessName": "NtLmSsp "}), ("l3", "4624", "05", {"LogonType": "2", "AuthenticationPackageName": "NTLM"}),
        ("l4", "4624", "05", {"LogonType": "3", "AuthenticationPackageName": "Kerberos", "TicketEncryptionType": "0x17"}),
        ("t1", "4769", "06", {"TargetUserName": "ann@DOM"}), ("t2", "4768", "07", {"TargetUserName": "ann"}), ("t3", "4769", "08", {"TargetUserName": "ann@DOM"}), ("t4", "4769", "08", {"TargetUserName": "eve@DOM"}),
    ]
    rows = [(i, c, f"2024-01-{d}T00:00:00Z", json.dumps({"data": a})) for i, c, d, a in events]
    er = spark.createDataFrame(rows, "event_id string, event_code string, event_time_utc string, attributes_json string").withColumn("user_name", F.lit(None).cast("string"))
    assert sorted(map(tuple, heuristics.priv_group_added(er).collect())) == [("bob", "administrators", "c1", "g1"), ("bob", "domain admins", "c1", "g2")]
    assert sorted(r[0] for r in heuristics.ntlm_network_logon(er).collect()) == ["l1", "l2"]
    assert sorted(r[0] for r in heuristics.tgs_without_tgt(er).collect()) == ["t1", "t4"]
    logs = spark.createDataFrame([("Microsoft-Windows-Windows Defender/Operational", "threat"), ("Security", "logon")], "channel string, event_action string").withColumn("event_time_utc", F.lit("t")).withColumn("severity", F.lit("high"))
    logs = logs.withColumn("artifact_type", F.lit("evtx")).withColumn("parser_name", F.lit("p")).withColumn("message_short", F.lit(None).cast("string"))
    assert [r["event_action"] for r in defender.defender_summary(logs).collect()] == ["threat"]


def test_triage_has_every_source_and_step(spark):
    from timeloom import queries as library

    got = library.QUERIES["triage_actions"](spark, "/root/testdata/sf0.001").collect()
    assert {r["category"] for r in got} == {"finding", "correlation", "parser_failure", "review"}
    assert [r["priority"] for r in got] == sorted((r["priority"] for r in got), reverse=True)
    assert {r["key"]: r["priority"] for r in got if r["category"] == "review"} == {"retired_rule": 3300} and "service_installed" not in {r["key"] for r in got}
    steps = library.QUERIES["triage_funnel_steps"](spark, "/root/testdata/sf0.001").collect()
    assert [r["name"] for r in steps] == ["collected", "detected", "triaged", "incident"] and steps[0]["percent"] is None


def test_bad_times_are_dropped(spark):
    rows = spark.createDataFrame([(1, "2024-01-01T00:00:00Z"), (2, "soon"), (3, None)], "event_id int, event_time_utc string")
    assert [r[0] for r in rows.where(filters.time_range("2023-01-01T00:00:00Z")).collect()] == [1]


def test_unsupported_rules_are_skipped(spark):
    bad = [{**findings.RULES[1], "id": "m", "selections": {"s": {"CommandLine|base64": ["x"]}}}, {**findings.RULES[1], "id": "r", "selections": {"s": {"CommandLine|re": ["("]}}}, {**findings.RULES[1], "id": "c", "condition": "no"}]
    good, skipped = findings.compile_rules([*findings.RULES, *bad])
    assert len(good) == len(findings.RULES) and [i for i, _ in skipped] == ["m", "r", "c"]


def test_rule_conditions(spark):
    row = spark.createDataFrame([("1", '{"data":{"A":"x","B":null}}', "evtx")], "event_code string, attributes_json string, artifact_type string")
    row = row.withColumn("command_line", F.lit("a –enc b")).withColumn("process_name", F.lit(None).cast("string"))
    hit = lambda sel, cond: row.where(findings.compile_rule({"codes": [], "selections": sel, "condition": cond})).count() == 1
    assert hit({"s": {"a": ["X"]}}, "s") and hit({"s": {"B": [None]}}, "s") and not hit({"s": {"C": ["x"]}}, "s")
    assert hit({"s": {"CommandLine|contains|windash": ["-enc"]}}, "s")
    assert hit({"s1": {"a": ["x"]}, "s2": {"a": ["y"]}}, ("n of", 1, "s")) and not hit({"s1": {"a": ["x"]}, "s2": {"a": ["y"]}}, ("all of", "s"))
    assert hit({}, ("all of", "z")) and not hit({}, ("n of", 1, "z"))


def test_forest_with_a_cycle_and_a_missing_parent(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x")], "key string, parent_key string")
    got = {r["key"]: (r["root"], r["depth"]) for r in sequences.process_forest(nodes).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0)}


def test_ioc_lists_of_any_length(spark, monkeypatch):
    texts = ["abcd she hers", "his abc", None, "", "10.0.0.9 x"]
    er = spark.createDataFrame([(f"e{k}", t, "AB" if k == 2 else None, "10.0.0.9" if k == 4 else None, None) for k, t in enumerate(texts)], "event_id string, search_text string, hash string, ip string, process_name string")
    iocs = ["abc", "ABCD", "he", "she", "hers", "ab", "10.0.0.9", " ", "absent"] + [f"indicator-{k}" for k in range(3000)]
    want = {(v, f"e{k}") for v in ("abc", "abcd", "he", "she", "hers", "ab", "10.0.0.9") for k, t in enumerate(texts) if t and v in t} | {("ab", "e2")}
    for size in (8 << 20, 1000):
        monkeypatch.setattr(ioc, "BLOCK_BYTES", size)
        got = {(r.ioc, r.event_id): r.kind for r in ioc.ioc_match(er, iocs).collect()}
        assert set(got) == want and got["10.0.0.9", "e4"] == "ip" and got["ab", "e2"] == "hash" and got["he", "e0"] == "text"
    assert not ioc.ioc_match(er, []).count()
    assert [r.severity for r in ioc.ioc_findings(er.selectExpr("*", "'t' AS event_time_utc", "'h' AS host", "'u' AS user_name"), ["10.0.0.9"]).collect()] == ["high"]


def test_overrides(spark):
    f = spark.createDataFrame([(f"f{k}", "sigma" if k < 6 else "ioc", f"r{k % 6}", "T" if k % 2 else "U", "low") for k in range(12)], "finding_id string, engine string, rule_id string, title string, severity string")
    rows = [
        ("a", None, None, "T", "set_severity", "high", True, 1), ("b", "sigma", "r1", None, "suppress", None, True, 2), ("c", "sigma", "r1", "T", "set_severity", "info", False, 9), ("d", None, "r3", None, "suppress", None, True, 1),
        ("e", "ioc", None, "T", "set_severity", "medium", True, 5), ("f", None, None, None, "set_severity", "critical", True, 0), ("g", "ioc", "r2", "U", "suppress", None, True, 3), ("h", "sigma", None, None, "note", None, True, 0),
    ]
    o = spark.createDataFrame(rows, "override_id string, engine string, rule_id string, title string, action string, severity string, enabled boolean, created_at int")
    want = {}
    for r in f.collect():
        fits = [x for x in rows if x[6] and all(a is None or a == b for a, b in zip(x[1:4], (r.engine, r.rule_id, r.title), strict=True))]
        last = max(fits, key=lambda x: (x[7], x[0]), default=None)
        if last is None or last[4] != "suppress":
            want[r.finding_id] = last[5] if last and last[4] == "set_severity" else r.severity
    got = findings.with_overrides(f, o)
    assert {r.finding_id: r.severity for r in got.collect()} == want and "critical" in want.values() and len(want) < 12
    assert {r.severity for r in findings.with_overrides(f, o.limit(0)).collect()} == {"low"}


def test_evidence_and_fingerprint(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").write_bytes(b"2")
    import hashlib

    ledger = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("b", "0"), ("c", "0")], "name string, sha256 string")
    got = integrity.evidence_verify(spark, str(tmp_path), ledger)
    assert sorted(map(tuple, got.collect())) == [("a", "ok"), ("b", "mismatch"), ("c", "missing")]
    assert tuple(integrity.verified_counts(got).first()) == (3, 2)
    first = integrity.table_fingerprint(spark, str(tmp_path)).first()["fingerprint"]
    (tmp_path / "d").write_bytes(b"3")
    assert first != integrity.table_fingerprint(spark, str(tmp_path)).first()["fingerprint"]


def test_index_sync(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    assert sorted(map(tuple, textindex.index_sync(old, new, "k").collect())) == [(1, "same"), (2, "changed"), (3, "deleted"), (4, "new")]


def test_subgraph_keeps_the_budget(spark):
    edges = spark.createDataFrame([("k", "a", f"b{i}", 1, f"2024-01-{i + 10}") for i in range(20)], "kind string, src string, dst string, events int, last_seen string")
    assert {r["dst"] for r in graph.subgraph(edges, "a", budget=7).collect()} == {f"b{i}" for i in range(13, 20)}


def test_edges_of_parts_are_united(spark):
    """Evidence ids that two parts share count once; at most 50 stay; empty tables give none."""
    ids = [f"e{i:03}" for i in range(60)]
    parts = spark.createDataFrame(
        [("k", "a", "b", 3, "t1", "t2", "e2,e1,e3"), ("k", "a", "b", 2, "t0", "t1", "e3,e4"), ("k", "a", "c", 60, "t0", "t1", ",".join(ids)), ("k", "a", "c", 1, "t0", "t9", "e000")],
        "kind string, src string, dst string, events long, first_seen string, last_seen string, evidence string",
    )
    got = {r["dst"]: tuple(r)[3:] for r in graph.compact_edges(parts).collect()}
    assert got == {"b": (5, "t0", "t2", "e1,e2,e3,e4"), "c": (61, "t0", "t9", ",".join(ids[:50]))}
    assert graph.compact_edges(parts.limit(0)).count() == 0
    columns = ["event_id", "event_time_utc", *graph.ENTITIES.values()]
    er = spark.createDataFrame([("e1", "t1", "H", None, "P.exe", None, " ", "http://U", None), ("e2", None, None, None, "p.exe", None, None, "http://u ", None)], ", ".join(f"{c} string" for c in columns))
    er = er.withColumn("ip", F.lit("1.2.3.4"))
    got = sorted(tuple(r) for r in graph.extract_edges(er).select(*graph.EDGE, "events", "first_seen", "evidence").collect())
    mentions = [("e1", "h", "t1"), ("e1", "p.exe", "t1"), ("e1", "http://u", "t1"), ("e1", "1.2.3.4", "t1"), ("e2", "p.exe", None), ("e2", "http://u", None), ("e2", "1.2.3.4", None)]
    want = [("event_mentions_entity", a, b, 1, t, a) for a, b, t in mentions] + [("process_connected_ip", "p.exe", "1.2.3.4", 2, "t1", "e1,e2")]
    assert got == sorted(want)


def test_streams_equal_batch(spark, tmp_path):
    from timeloom.sources import fixture
    from timeloom.streaming import streams

    ef = fixture.events_full(spark, "/root/testdata/sf0.001")
    ef.write.parquet(str(tmp_path / "ef"))
    stream = spark.readStream.schema(ef.schema).parquet(str(tmp_path / "ef"))
    q = streams.stream_sigma(streams.stream_event_rows(stream)).writeStream.format("memory").queryName("sigma").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = findings.sigma_eval(fixture.event_rows(spark, "/root/testdata/sf0.001"))
    ids = lambda df: sorted(r[0] for r in df.select("finding_id").collect())
    assert ids(spark.table("sigma")) == ids(batch)


def test_quick_filters_of_each_type(spark):
    """Paths match with either slash, patterns and processes as given, nulls match nothing; unknown types have the common presets."""
    rows = [
        ("amcache", r"C:\\Users\\a\\x.txt", "CMD.exe", "info", "setup aabbccddeeff00112233445566778899", False), ("srum", None, "curl.exe", "info", "to 10.1.2.3", False),
        ("text_observation", None, "mshta.exe", "info", "failed: run x.bat from http://a", False), ("other", None, None, "high", "", True), ("prefetch", None, None, None, None, True),
    ]
    er = spark.createDataFrame(rows, "artifact_type string, file_path string, process_name string, severity string, search_text string, has_finding boolean")
    assert {(r["artifact_type"], r["preset"]) for r in summaries.quick_filter_counts(er).collect()} == {
        ("amcache", "amcache-user-program"), ("amcache", "amcache-lolbin"), ("amcache", "amcache-hash-present"), ("amcache", "amcache-installer-updater"), ("srum", "srum-network"), ("srum", "srum-browser"),
        ("text_observation", "text-errors"), ("text_observation", "text-network"), ("text_observation", "text-exec"), ("text_observation", "text-transfer"),
        ("other", "artifact-finding"), ("other", "artifact-high"), ("prefetch", "pf-finding"),
    }


def test_summaries_of_parts_and_of_groups(spark):
    parts = spark.createDataFrame([("a", "ip", "1", 2, "t1", "t2"), ("a", "ip", "1", 3, "t0", "t1"), ("b", "ip", "2", 9, "t0", "t9")], "entity_id string, type string, canonical string, events long, first_seen string, last_seen string")
    assert [tuple(r) for r in summaries.entity_summary(parts).select("entity_id", "events", "first_seen", "last_seen").collect()] == [("b", 9, "t0", "t9"), ("a", 5, "t0", "t2")]
    assert summaries.entity_summary(parts, 1).count() == 1 and summaries.entity_summary(parts.limit(0)).count() == 0
    found = spark.createDataFrame([("r", "t", "2024-01-01T05:10:00Z", []), ("r", "t", "2024-01-01T09:00:00Z", []), ("s", "t", "2024-01-01T05:00:00Z", ["mitre", "x"]), ("n", "t", None, ["x"])], "rule_id string, title string, event_time_utc string, tactics array<string>")
    assert {tuple(r)[:3] for r in summaries.attack_heatmap(found).collect()} == {("none", "05", 2), ("x", "05", 1)}
    rows = [("medium", "mft", "quiet", False), ("medium", "mft", "lsass_read", False), ("info", "evtx", "  ", True), ("high", "evtx", "plain", False), ("low", "evtx", "mimikatz", False)]
    er = spark.createDataFrame([("c", "2024", "m", *r) for r in rows], "case_id string, event_time_utc string, message_short string, severity string, artifact_type string, event_action string, has_finding boolean")
    er = er.withColumns({c: F.lit(None).cast("string") for c in summaries.ROW_TEXT if c not in er.columns})
    got = {r["title"]: (r["rule_id"], r["attack_json"]) for r in summaries.finding_fallback_summary(er).collect()}
    assert got == {
        "lsass_read (mft)": ('event_row:["medium","mft","lsass_read"]', '["T1003 Credential Access","T1070 Indicator Removal"]'),
        "suspicious_event (evtx)": ('event_row:["info","evtx","  "]', '["event_rows:fallback"]'), "plain (evtx)": ('event_row:["high","evtx","plain"]', '["event_rows:fallback"]'),
    }


def test_quick_filters_shuffle_ids_only(spark):
    from timeloom.plans import read_models
    from timeloom.sources import fixture

    er = fixture.event_rows(spark, "/root/testdata/sf0.001")
    found = findings.sigma_eval(er)
    got = summaries.quick_filter_counts(er, found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, summaries.quick_filter_counts(read_models.with_finding_flag(er, found)).collect()))
    assert "search_text" not in plan.split("Join LeftSemi")[1].split("Aggregate")[0]


def test_edges_are_counted_without_evidence(spark):
    from timeloom import queries as library
    from timeloom.sources import fixture

    er = fixture.event_rows(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, graph.count_edges(er).collect())) == sorted(map(tuple, graph.extract_edges(er).drop("evidence").collect()))
    for name in ("edge_pairs", "entity_degree"):
        plan = library.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan


def test_danger_lineage_gathers_its_nodes_once(spark):
    rows = [("a", None, "e1", "a.exe", "low"), ("b", "a", "e2", "b.exe", "low"), ("c", "b", "e3", "c.exe", "critical"), ("d", "b", "e4", "d.exe", "critical"), ("x", None, "e5", "x.exe", "high")]
    made = spark.createDataFrame(rows, "key string, parent_key string, event_id string, process_name string, severity string")
    found = lineage.danger_lineage(made, spark.createDataFrame([("e3",), ("e3",), ("e1",)], "event_id string"))
    assert sorted(r.key for r in found.collect()) == ["a", "b", "c"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_chains_of_keys_multiply_no_rows(spark):
    from timeloom.sources import fixture

    er = fixture.event_rows(spark, "/root/testdata/sf0.001")
    for chains in (correlation.correlation_chains(er), correlation.correlation_summary(er)):
        plan = chains._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "ObjectHashAggregate" not in plan and not [c for c in chains.columns if c[5:].isdigit()]
