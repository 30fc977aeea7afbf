"""Projections of events: the registered forms of the scalar functions and of the read model."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeloom.functions import columns as C
from timeloom.registry import query
from timeloom.plans.read_models import ATTRIBUTES, PLAIN, SEARCHED, legacy_text

query("project_event_rows", "SELECT " + ", ".join(PLAIN) + " FROM ef", over="ef")(lambda ef: ef.select(*PLAIN))
query("attr_string", "SELECT event_id, coalesce(json_extract_string(attributes_json, '$.process_guid'), json_extract_string(attributes_json, '$.prefetch_hash')) AS value FROM ef", over="ef")(
    lambda ef: ef.select("event_id", C.attr_string("attributes_json", "process_guid", "prefetch_hash").alias("value"))
)
query("attr_i64", "SELECT event_id, coalesce(try_cast(json_extract_string(attributes_json, '$.run_count') AS BIGINT), try_cast(json_extract_string(attributes_json, '$.event_id') AS BIGINT)) AS value FROM ef", over="ef")(
    lambda ef: ef.select("event_id", C.attr_i64("attributes_json", "run_count", "event_id").alias("value"))
)
query("json_regex_attr", "SELECT event_id, " + ", ".join(ATTRIBUTES) + " FROM er")(lambda er: er.select("event_id", *ATTRIBUTES))
query("search_text", "SELECT event_id, search_text FROM er")(lambda er: er.select("event_id", "search_text"))
query("haystack_legacy", "SELECT event_id, coalesce(CASE WHEN artifact_type = 'mft' THEN NULL ELSE search_text END, lower(concat_ws(' ', " + ", ".join(SEARCHED) + "))) AS haystack FROM er")(
    lambda er: er.withColumn("search_text", F.when(F.col("artifact_type") != "mft", F.col("search_text"))).select("event_id", legacy_text().alias("haystack"))
)
query("basename", "SELECT event_id, regexp_replace(lower(file_path), '^.*[\\\\/]', '') AS name FROM er")(lambda er: er.select("event_id", C.basename("file_path").alias("name")))
#: names as they stand in logs, for Spark and the oracle: quoted, with arguments, of several extensions, without one
_NAMED = """CASE length(event_id || base) % 6 WHEN 0 THEN concat('"C:/Windows/', upper(base), '" -x') WHEN 1 THEN concat('/usr/bin/', base) WHEN 2 THEN concat('D:/a/', base, '.js.exe.old')
 WHEN 3 THEN concat(' "', base, '" ') WHEN 4 THEN concat('C:/x/tool.COM /c ', base) ELSE 'noextension' END"""
_WITH_BASE = "(SELECT *, coalesce(process_name, file_path, host) AS base FROM er)"
_CUT = "coalesce(" + ", ".join(f"CASE WHEN instr(n, '{e}') > 0 THEN substr(n, 1, instr(n, '{e}') + {len(e) - 1}) END" for e in C.EXECUTABLE) + ", n)"
query("process_basename", f"SELECT event_id, {_CUT} AS name FROM (SELECT event_id, regexp_replace(lower(trim(replace({_NAMED}, chr(34), ''))), '^.*[\\\\/]', '') AS n FROM {_WITH_BASE})")(
    lambda er: er.withColumn("base", F.coalesce("process_name", "file_path", "host")).select("event_id", C.process_basename(F.expr(_NAMED)).alias("name"))
)
query("event_subject", "SELECT event_id, coalesce(process_name, file_path, ip, hash, user_name, host) AS subject FROM er")(lambda er: er.select("event_id", F.coalesce("process_name", "file_path", "ip", "hash", "user_name", "host").alias("subject")))
query("command_unescape", "SELECT event_id, replace(replace(command_line, '\\\\', '\\'), '\\\"', '\"') AS command FROM er WHERE command_line IS NOT NULL")(
    lambda er: er.where("command_line IS NOT NULL").select("event_id", F.replace(F.replace("command_line", F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"')).alias("command"))
)
query("normalize_time", "SELECT event_id, strftime(make_timestamp(CAST(epoch_us(CAST(event_time_utc AS TIMESTAMP)) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS t FROM er")(
    lambda er: er.select("event_id", F.date_format(C.normalize_time(F.unix_micros(C.timestamp("event_time_utc")).cast("string")), "yyyy-MM-dd HH:mm:ss").alias("t"))
)
#: accounts and messages with what precedes a reserved authority, twice, in another case, or not at all
_ACCOUNT = "CASE length(message_short) % 4 WHEN 0 THEN concat(host, ' nt authority{b}', event_action) WHEN 1 THEN concat('x', event_id, 'BUILTIN{b}', host, ' NT SERVICE{b}a') WHEN 2 THEN concat(host, '{b}', event_action) ELSE 'Window Manager{b}DWM-1' END"
_MESSAGE = "CASE length(message_short) % 4 WHEN 0 THEN concat(message_short, ' user=', host, 'BUILTIN{b}x') WHEN 1 THEN concat('a user=junkNT Authority{b}S user=moreBUILTIN{b}y ', host) WHEN 2 THEN concat('no user ', 'BUILTIN{b}', host) ELSE concat('user=', host, '{b}plain') END"
_SPARK_B, _DUCK_B = "\\\\", "\\"
query("sanitize_account", f"SELECT event_id, regexp_replace({_ACCOUNT.format(b=_DUCK_B)}, '(?i)^.*?{C.ACCOUNTS}\\\\', '\\1\\\\') AS user_name FROM er")(
    lambda er: er.select("event_id", C.sanitize_account(F.expr(_ACCOUNT.format(b=_SPARK_B))).alias("user_name"))
)
query("sanitize_account_in_message", f"SELECT event_id, regexp_replace({_MESSAGE.format(b=_DUCK_B)}, '(?i)^((?s:.*?)user=)[^ ]*?{C.ACCOUNTS}\\\\', '\\1\\2\\\\') AS message_short FROM er")(
    lambda er: er.select("event_id", C.sanitize_account_in_message(F.expr(_MESSAGE.format(b=_SPARK_B))).alias("message_short"))
)
#: lists of hashes: one in order, one in lower case, one cut short, one without
_HASHES = "CASE length(message_short) % 4 WHEN 0 THEN concat('MD5=x,SHA256=', {h}, ',IMP=y') WHEN 1 THEN concat('SHA256=', upper({h})) WHEN 2 THEN concat('sha256=', {h}) ELSE concat('SHA256=', substr({h}, 1, 63), ',SHA1=z') END"
query("sha256_from_hashes", f"SELECT event_id, regexp_extract({_HASHES.format(h='sha256(event_id)')}, 'SHA256=([0-9A-Fa-f]{{64}})', 1) AS sha FROM er")(
    lambda er: er.select("event_id", C.sha256_from_hashes(F.expr(_HASHES.format(h="sha2(event_id, 256)"))).alias("sha"))
)
