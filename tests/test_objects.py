"""Objects and places of hand-made attributes: counts, keys, places, caps, and attributes that can't be read."""

import json

import pytest
from pyspark.sql import functions as F

from timeloom.operators import objects as O

BASE = {"event_time_utc": "2024-01-01T00:00:00Z", "event_action": "x", "source_file_id": "f1", "process_name": None, "file_path": None, "ip": None, "url": None, "hash": None, "user_name": None}
SCHEMA = "event_id string, artifact_type string, event_time_utc string, event_action string, source_file_id string, process_name string, file_path string, ip string, url string, hash string, user_name string, attributes_json string"


def events(spark, *rows):
    """rows: (artifact type, attributes, other columns)."""
    out = []
    for k, (kind, attributes, more) in enumerate(rows):
        r = BASE | {"event_id": f"e{k}", "artifact_type": kind, "attributes_json": attributes if isinstance(attributes, str) or attributes is None else json.dumps(attributes)} | more
        out.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


MFT = {
    "record_number": 51, "sequence_number": "4", "record_offset": 52224, "record_size": 1024,
    "attributes": [{"type_name": "FILE_NAME", "offset": 152, "length": 112, "id": 2}, {"type_name": "DATA", "offset": 264, "id": 5}],
    "data_runs": [{"attribute_id": 5, "run_index": 1, "runlist_record_offset": 328, "cluster_count": 8, "lcn": 900}],
}
PREFETCH = {
    "executable_name_header": "TOOL.EXE", "prefetch_hash": "ab12", "run_count": 3, "run_count_offset": 200, "run_time_entries": [{"offset": 128, "timestamp": "2024-02-03T04:05:06Z"}, {"timestamp": "no place"}],
    "file_metrics": [{"index": 4, "offset": 300, "length": 999, "filename": "A.DLL"}], "trace_chains": [{"index": 2, "offset": 400, "block_load_count": 7}], "sections": [{"name": "C", "offset": 500, "length": 70}],
}
LINK = {"target_path": "C:/t.exe", "extra_data_blocks": [{"signature": "0xa1", "signature_name": "Tracker", "offset": 80, "property_entries": [{"key": "MachineID", "value_hint": "PC-1", "value_offset": 96}, {"key": " "}]}]}
ESE = {"ese_header": {}, "ese_pages": [{"page_number": 3, "offset": 8192, "tags": [{"tag_index": 1, "offset": 40}, {"tag_index": 2, "absolute_offset": 9000, "length": 5}], "table_name_hints": ["MSysObjects", None]}]}


def test_file_records(spark):
    ef = events(spark, ("mft", MFT, {}))
    got = {r.key: r for r in O.derive_objects(ef, "mft").collect()}
    assert {k: (r.kind, r.offset, r.length) for k, r in got.items()} == {
        "mft:51:4": ("ntfs_file_record", 52224, 1024), "mft_attr:51:4:2:FILE_NAME": ("ntfs_attribute", 52376, 112), "mft_attr:51:4:5:DATA": ("ntfs_attribute", 52488, 1024), "mft_run:51:4:5:1": ("ntfs_data_run", 52552, 16),
    }
    places = [(r.kind, r.offset, r.length) for r in O.derive_spots(ef, "mft").collect()] + [("mft_record", r.offset, r.length) for r in O.offsets(ef).collect()]
    assert sorted(places) == [("mft_attribute", 52376, 112), ("mft_attribute", 52488, 64), ("mft_data_runlist", 52552, 16), ("mft_record", 52224, 1024)]


def test_streams(spark):
    stream = {"record_number": 5, "record_offset": 1000, "resident_value_offset": 24, "resident_value_length": 70_000, "stream_kind": "ads", "stream_name": "Zone.Identifier", "HostUrl": "http://a/b"}
    got = [r for r in O.derive_objects(events(spark, ("mft", stream, {"file_path": "C:/x.exe"}), ("mft", stream | {"stream_kind": None, "stream_name": "-", "HostUrl": None}, {})), "mft").collect() if "resident" in r.kind]
    assert [(r.kind, r.key, r.name, r.offset, r.length, r.confidence) for r in got] == [
        ("ntfs_ads_resident_content", "mft_resident:5:-:zone.identifier:-", "C:/x.exe HostUrl=http://a/b", 1024, 65536, 0.9), ("ntfs_resident_content", "mft_resident:5:-:$data:-", "MFT record 5", 1024, 65536, 0.78),
    ]


def test_prefetch_link_and_database(spark):
    ef = events(spark, ("prefetch", PREFETCH, {"process_name": "Tool.exe"}), ("lnk", LINK, {}), ("ese_database", ESE, {}))
    got = {r.key: (r.kind, r.offset, r.length) for r in O.artifact_objects(ef).collect()}
    assert got == {
        "prefetch:tool.exe:ab12": ("prefetch_execution", None, None), "prefetch_section:tool.exe:ab12:C": ("prefetch_section", 500, 70), "prefetch_run_count:tool.exe:ab12": ("prefetch_run_count", 200, 4),
        "prefetch_run_time:tool.exe:ab12:2024-02-03T04:05:06Z": ("prefetch_run_time", 128, 8), "prefetch_file_metric:tool.exe:ab12:4:A.DLL": ("prefetch_file_metric", 300, 999),
        "prefetch_trace_chain:tool.exe:ab12:2": ("prefetch_trace_chain", 400, 8), "process_reference:tool.exe": ("process_reference", None, None),
        "lnk:c:/t.exe": ("shell_link_target", None, None), "lnk_extra:e1:0xa1:80": ("lnk_extra_block", 80, None), "lnk_property:machineid:pc-1": ("lnk_property_value", 96, 32),
        "ese_row:e2": ("ese_row_signal", None, None), "ese_header:f1": ("ese_database_header", 0, 4096), "ese_page:f1:3": ("ese_database_page", 8192, None), "ese_tag:f1:3:1": ("ese_page_tag", 8232, 16),
        "ese_tag:f1:3:2": ("ese_page_tag", 9000, 5), "ese_table:ese_database:msysobjects": ("ese_table_hint", 8192, None),
    }
    assert sorted((r.kind, r.length) for r in O.derive_spots(ef, "prefetch").collect()) == [("prefetch_file_metric", 256), ("prefetch_run_count", 4), ("prefetch_run_time", 8), ("prefetch_section", 70), ("prefetch_trace_chain", 8)]
    assert O.derive_spots(ef, "link").count() == 2 and O.derive_spots(ef, "ese").count() == 4


def test_windows_events(spark):
    def row(kind, **more):
        return ("evtx", {"event_id": 4769, "semantics": {"event_kind": kind, **more}, "data": {"TargetUserName": "Ann", "IpAddress": "10.0.0.1"}}, {})

    ef = events(spark, row("kerberos_tgs_request", service_name="S", ticket_encryption_name="RC4", labels=["kerberoast_candidate"]), row("kerberos_as_request"), row("firewall_rule_added", rule_name="R"), row("firewall"),
                row("audit_policy_changed", audit_subcategory="Logon"), row("privilege_rights_changed"), row("rdp_logon"), row("other", pipe_name="\\PSEXESVC"), ("evtx", {"data": {}}, {}), ("usn_jrnl", {"semantics": {"event_kind": "rdp_x"}}, {}))
    assert [(r.kind, r.key, r.confidence) for r in O.derive_objects(ef, "windows_event").orderBy("event_id").collect()] == [
        ("kerberos_ticket_request", "kerberos:4769:ann:s:rc4", 0.9), ("kerberos_ticket_request", "kerberos:4769:ann:-:-", 0.75), ("firewall_rule_or_flow", "firewall:firewall_rule_added:r:-", 0.74),
        ("audit_policy_change", "audit_policy:audit_policy_changed:logon", 0.76), ("audit_policy_change", "audit_policy:privilege_rights_changed:-", 0.76), ("rdp_logon_observation", "rdp:ann:10.0.0.1:2024-01-01t00:00:00z", 0.82),
        ("named_pipe_observation", "named_pipe:\\psexesvc", 0.88),
    ]


@pytest.mark.parametrize("attributes", [None, "", "no json", "[]", "{}", '{"attributes":"x","sections":{},"ese_pages":[1,null],"extra_data_blocks":[[]],"record_number":"x"}'])
def test_attributes_that_cannot_be_read(spark, attributes):
    ef = events(spark, *[(kind, attributes, {}) for kind in ("mft", "prefetch", "lnk", "ese_database", "evtx", "unknown")])
    kinds = {r.kind for r in O.artifact_objects(ef).collect()}
    assert kinds <= {"ese_row_signal", "ese_database_page", "lnk_extra_block"}
    assert all(O.derive_spots(ef, g).count() == 0 for g in ("mft", "prefetch", "link", "ese"))


def test_caps(spark):
    many = MFT | {"attributes": [{"id": k, "offset": k} for k in range(40)], "data_runs": [{"run_index": k} for k in range(40)]}
    pages = {"ese_pages": [{"page_number": p, "tags": [{"tag_index": k} for k in range(80)], "table_name_hints": ["a"] * 20} for p in range(10)]}
    ef = events(spark, ("mft", many, {}), ("ese_database", pages, {}))
    n = {r.kind: r["count"] for r in O.artifact_objects(ef).groupBy("kind").count().collect()}
    assert n == {"ntfs_file_record": 1, "ntfs_attribute": 24, "ntfs_data_run": 16, "ese_row_signal": 1, "ese_database_page": 8, "ese_page_tag": 8 * 64, "ese_table_hint": 8 * 12}


def test_one_scan_for_the_chains(spark):
    plan = O.object_chains(events(spark, ("mft", MFT, {})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


def test_every_chained_kind_is_in_the_fixture(spark):
    from timeloom.sources import fixture

    kinds = {r.kind for r in O.artifact_objects(fixture.events_full(spark, "/root/testdata/sf0.01")).select("kind").distinct().collect()}
    assert set(O.CHAINED) <= kinds


def test_chains_hold_no_sets_and_multiply_no_rows(spark):
    """Seventy types, an event id that comes under two types, one that comes twice under one: the chain is that of a plain count."""
    rows = [(f"t{k:02}", "{}", {"process_name": "a.exe"}) for k in range(70)] + [("t00", "{}", {"process_name": "a.exe", "event_id": "e1"}), ("t01", "{}", {"process_name": "a.exe", "event_id": "e1"}), (None, "{}", {"process_name": "a.exe"})]
    chains = O.object_chains(events(spark, *rows, ("mft", MFT, {}), ("mft", MFT, {})))
    one = {r.kind + " " + r.key: r for r in chains.collect()}
    got = one["artifact_object:process_reference process_reference:a.exe"]
    assert (got.events, got.step_count, got.artifact_types) == (73, 71, ",".join(f"t{k:02}" for k in range(70)))
    assert {"artifact_object:ntfs_file_record mft:51:4", "artifact_object:ntfs_data_run mft_run:51:4:5:1"} <= set(one)
    plan = chains._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "ObjectHashAggregate" not in plan


def test_links_are_the_chained_part_of_all_objects(spark):
    from timeloom.sources import fixture

    ef = fixture.events_full(spark, "/root/testdata/sf0.001")
    columns = ["event_id", "artifact_type", "event_time_utc", "kind", "key", "confidence"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(O.chained_objects(ef)) == rows(O.artifact_objects(ef).where(F.col("kind").isin(O.CHAINED)))
