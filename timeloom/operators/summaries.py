"""Summaries that take more than one read model: case, entities, tactics by hour, groups of suspicious rows, quick filters, processes with their findings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import severity_max
from timeloom.operators.aggregates import MAX_SQL
from timeloom.operators.findings import FINDINGS, sigma_eval
from timeloom.operators.graph import _ENT, _ENTITIES, extract_entities
from timeloom.operators.sequences import _INST, process_instances
from timeloom.plans.read_models import with_finding_flag
from timeloom.registry import query
from timeloom.sources import fixture


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _pattern(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- case and entities


def case_summary(files: DataFrame, event_rows: DataFrame, parse_runs: DataFrame) -> DataFrame:
    """One row of four counts over three tables, each counted on its own."""
    names = ["file_count", "event_count", "failed_parse_count", "unsupported_file_count"]
    count = lambda df, **of: df.agg(*[of.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    counted = [
        count(files, file_count=F.count("*"), unsupported_file_count=F.count_if(F.col("parser_status") == "unsupported")),
        count(event_rows, event_count=F.count("*")),
        count(parse_runs, failed_parse_count=F.count_if(F.col("status") == "failed")),
    ]
    return reduce(DataFrame.unionByName, counted).agg(*[F.sum(n).alias(n) for n in names])


def entity_summary(parts: DataFrame, limit: int | None = 100) -> DataFrame:
    """Entity rows of several parts, one per id: counts summed, widest times; the most frequent first. limit None: all."""
    out = parts.groupBy("entity_id").agg(
        F.max("type").alias("type"), F.max("canonical").alias("canonical"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("events").alias("events"))
    out = out.orderBy(F.desc("events"), F.desc("last_seen"), "type", "canonical")
    return out if limit is None else out.limit(limit)


# ---------------------------------------------------------------- findings


def attack_heatmap(findings: DataFrame) -> DataFrame:
    """tactic, hour, findings, first_seen, last_seen: groups of findings in the hour in which each began, weighted by their size; without tactic: none."""
    groups = findings.where("event_time_utc IS NOT NULL").groupBy("rule_id", "title").agg(
        F.count("*").alias("findings"), F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen"), F.first("tactics").alias("tactics"))
    named = F.filter("tactics", lambda t: ~t.isin("", "mitre"))
    cells = groups.withColumn("tactic", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("none"))))).withColumn("hour", F.substring("first_seen", 12, 2))
    return cells.groupBy("tactic", "hour").agg(F.sum("findings").alias("findings"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


#: fixed values: words that make a row of medium severity suspicious
ROW_WORDS = [
    "defender", "threat", "malware", "c2", "rat", "merlin", "psexec", "psexesvc", "powershell", "encoded", "base64", "mshta", "rundll32", "regsvr32", "wevtutil",
    "log_tamper", "timestomp", "si_fn", "credential", "lsass", "mimikatz", "dump", "keepass", "filezilla", "scheduled_task", "remote_access", "rdp", "webshell",
    "archive_suspicious", "recovered", "deleted_file", "carved_file", "network_http_request", "network_file_transfer",
]
#: fixed values: words of a group's type and action, and the technique they stand for
GROUP_TAGS = [
    (["powershell", "cmd", "mshta"], "T1059 Command and Scripting Interpreter"),
    (["scheduled_task", "task"], "T1053 Scheduled Task/Job"),
    (["psexec", "service"], "T1569 System Services"),
    (["defender", "tamper", "wevtutil"], "T1562 Impair Defenses"),
    (["credential", "lsass", "keepass", "filezilla"], "T1003 Credential Access"),
    (["network", "c2", "rat"], "T1105 Ingress Tool Transfer"),
    (["mft", "timestomp", "deleted"], "T1070 Indicator Removal"),
]
ROW_TEXT = [
    "artifact_type", "event_action", "severity", "message_short", "host", "user_name", "process_name", "file_path", "ip", "url", "hash", "event_code", "channel", "parser_name",
]


def finding_fallback_summary(er: DataFrame, limit: int | None = None) -> DataFrame:
    """Where no rule found anything: groups of suspicious rows. er has has_finding; the rule id encodes the group, techniques come from words."""
    text = F.lower(F.concat_ws(" ", *ROW_TEXT))
    rows = er.where(F.col("has_finding") | F.col("severity").isin("critical", "high") | ((F.col("severity") == "medium") & text.rlike(_pattern(ROW_WORDS))))
    groups = rows.groupBy("case_id", "severity", "artifact_type", "event_action").agg(
        F.count("*").alias("events"), F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen"), F.min("message_short").alias("sample_message"))
    words = F.lower(F.concat_ws(" ", "artifact_type", "event_action"))
    tags = F.array_compact(F.array(*[F.when(_any([F.contains(words, F.lit(w)) for w in own]), F.lit(tag)) for own, tag in GROUP_TAGS]))
    out = groups.select(
        "case_id", "severity", F.concat(F.when(F.trim("event_action") == "", "suspicious_event").otherwise(F.col("event_action")), F.lit(" ("), "artifact_type", F.lit(")")).alias("title"),
        F.concat(F.lit("event_row:"), F.to_json(F.array("severity", "artifact_type", "event_action"))).alias("rule_id"),
        F.to_json(F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("event_rows:fallback")))).alias("attack_json"),
        F.lit("event_rows").alias("engine"), "events", "first_seen", "last_seen", "sample_message",
    )
    return out if limit is None else out.orderBy(F.desc("events"), F.desc("last_seen"), "rule_id").limit(limit)


def process_overlay(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """Process nodes with what rules found on their first event: flag, highest level, titles, techniques."""
    found = findings.groupBy("event_id").agg(
        severity_max("severity").alias("finding_severity"), F.array_join(F.slice(F.sort_array(F.collect_set("title")), 1, 8), "; ").alias("titles"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("techniques")))), ",").alias("attack"))
    return nodes.join(found, "event_id", "left").withColumn("has_finding", F.col("finding_severity").isNotNull())


# ---------------------------------------------------------------- candidates for rules

#: fixed values: terms that make an event a candidate for detection
CANDIDATE_TERMS = [
    "powershell", "pwsh", "cmd.exe", "wscript", "cscript", "rundll32", "regsvr32", "mshta", "certutil", "bitsadmin", "wevtutil", "schtasks", "sc.exe", " net ", "mimikatz",
    "procdump", "lsass", "comsvcs", "minidump", "ntds.dit", "ntdsutil", "secretsdump", "psexec", "psexesvc", "paexec", "remcom", "wmic", "wmiprvse", "vssadmin", "shadowcopy",
    "wbadmin", "bcdedit", "eventid 7045", '"event_id":"7045"', "eventid 4697", '"event_id":"4697"', "eventid 4624", '"event_id":"4624"', "logontype", "eventid 4724",
    '"event_id":"4724"', "eventid 4738", '"event_id":"4738"', "eventid 4768", '"event_id":"4768"', "eventid 4769", '"event_id":"4769"', "eventid 5136", '"event_id":"5136"',
    "eventid 1102", '"event_id":"1102"', "eventid 4720", '"event_id":"4720"', "eventid 4728", '"event_id":"4728"', "eventid 4732", '"event_id":"4732"', "eventid 4756",
    '"event_id":"4756"', "terminalservices", "remoteconnectionmanager", "defender", "quarantine", "webshell", "backdoor", "moveit", "move.aspx", "moveit.asp", "nmap", "ruby",
    "credential", "password", "dpapi", "keepass", "filezilla", "http://", "https://", "ftp://", ".ps1", ".bat", ".cmd", ".hta", ".vbs", ".js", ".jse", ".wsf", ".scr", "run key",
    "currentversion\\\\run", "amsi", "etw", "firewall", "bloodhound", "sharphound",
]
CANDIDATE_TEXT = [
    "artifact_type", "event_action", "severity", "message_short", "message_full", "host", "user_name", "process_name", "file_path", "ip", "url", "hash", "source_file_id",
    "parser_name", "attributes_json",
]


def detection_candidates(ef: DataFrame, limit: int | None = None) -> DataFrame:
    """Events whose text has a term, all of them in time order, or the oldest up to a limit. One pattern, so one pass over each text."""
    found = ef.where(F.lower(F.concat_ws(" ", *CANDIDATE_TEXT)).rlike(_pattern(CANDIDATE_TERMS))).orderBy("event_time_utc", "event_id")
    return found if limit is None else found.limit(limit)


# ---------------------------------------------------------------- quick filters

#: fixed values: parts of user-writable paths, endings of what runs, tools that attackers live off. Paths are compared with / for \
WRITABLE = ("file", ["/users/", "/appdata/", "/temp/", "/programdata/", "/downloads/"])
RUNNABLE = ("any", [".exe", ".dll", ".ps1", ".bat", ".cmd", ".vbs", ".js", ".jse", ".wsf", ".lnk"])
LOLBINS = ("process", ["powershell", "pwsh", "cmd", "rundll32", "regsvr32", "mshta", "wscript", "cscript", "wmic", "certutil", "bitsadmin", "installutil", "msbuild", "regasm", "regsvcs"])
#: fixed values: the presets of each artifact type, by id; all conditions of one hold
QUICK_FILTERS = {
    "mft": {
        "mft-writable-exec": [WRITABLE, RUNNABLE],
        "mft-delete-rename": [("any", ["delete", "deleted", "removed", "rename", "renamed"])],
        "mft-timestomp": [("any", ["timestomp", "si/fn", "timestamp mismatch", "time mismatch"])],
        "mft-startup-persistence": [("any", ["/startup/", "runonce", "/start menu/programs/startup/"])],
    },
    "prefetch": {
        "pf-lolbin": [LOLBINS],
        "pf-user-writable": [WRITABLE],
        "pf-script-launch": [("any", [".ps1", ".vbs", ".js", ".jse", ".wsf", ".bat", ".cmd"])],
        "pf-finding": [("finding", [])],
    },
    "usn_jrnl": {
        "usn-destructive": [("any", ["delete", "deleted", "truncate", "overwrite", "data overwrite"])],
        "usn-rename": [("any", ["rename", "renamed", "old name", "new name"])],
        "usn-writable-exec": [WRITABLE, RUNNABLE],
        "usn-temp": [("file", ["/temp/", "/appdata/", "/downloads/"])],
    },
    "amcache": {
        "amcache-user-program": [WRITABLE],
        "amcache-lolbin": [LOLBINS],
        "amcache-hash-present": [("pattern", [r"\b[a-f0-9]{32,64}\b"])],
        "amcache-installer-updater": [("any", ["installer", "setup", "updater", "update", "download"])],
    },
    "srum": {
        "srum-network": [("pattern", [r"\b\d{1,3}(?:\.\d{1,3}){3}\b|https?://"])],
        "srum-browser": [("process", ["chrome", "msedge", "firefox", "iexplore", "curl", "wget"])],
        "srum-script-network": [("process", ["powershell", "pwsh", "wscript", "cscript", "mshta"])],
        "srum-admin-tools": [("process", ["psexec", "wmic", "winrm", "rundll32", "regsvr32"])],
    },
    "text_observation": {
        "text-errors": [("any", ["error", "fail", "failed", "warning", "denied"])],
        "text-network": [("pattern", [r"https?://|\b\d{1,3}(?:\.\d{1,3}){3}\b"])],
        "text-exec": [LOLBINS, ("any", [".exe", ".dll", ".ps1", ".bat", ".cmd", ".vbs", ".js"])],
        "text-transfer": [("any", ["download", "upload", "sync", "exfil", "ftp", "http"])],
    },
}
OTHER_FILTERS = {"artifact-finding": [("finding", [])], "artifact-high": [("severity", ["high", "critical"])], "artifact-writable": [WRITABLE]}


def _holds(kind: str, values: list[str]) -> Column:
    if kind == "finding":
        return F.col("has_finding")
    if kind == "severity":
        return F.col("severity").isin(values)
    if kind == "pattern":
        return F.col("search_text").rlike(values[0])
    text = {"any": F.col("search_text"), "file": F.lower(F.coalesce("file_path", F.lit(""))), "process": F.lower(F.coalesce("process_name", F.lit("")))}[kind]
    return _any([F.contains(F.translate(text, "\\", "/"), F.lit(v)) for v in values])


def quick_filters(artifact_type: str) -> dict[str, Column]:
    """The presets of a type as conditions on its rows with has_finding; types without own presets have those of all."""
    return {k: reduce(lambda a, b: a & b, [_holds(*c) for c in own]) for k, own in QUICK_FILTERS.get(artifact_type, OTHER_FILTERS).items()}


def quick_filter_counts(er: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """artifact_type, preset, events: how many rows each preset of the rows' own type keeps.

    Rows have has_finding, or found (event_id) are the events of findings: then only ids of rows whose presets ask for findings meet them,
    and the rows' texts are read where they lie.
    """
    mine = F.col("artifact_type")
    own = [(mine == t, quick_filters(t), QUICK_FILTERS[t]) for t in QUICK_FILTERS] + [(~mine.isin(list(QUICK_FILTERS)), quick_filters(""), OTHER_FILTERS)]
    cases = [(k, of & c, any(kind == "finding" for kind, _ in conditions[k])) for of, presets, conditions in own for k, c in presets.items()]
    columns = ["artifact_type"] if found is None else ["event_id", "artifact_type"]
    kept = lambda rows, some: rows.select(*columns, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c, _ in some]))).alias("preset"))
    if found is None:
        hits = kept(er, cases)
    else:
        asking = kept(er.withColumn("has_finding", F.lit(True)), [c for c in cases if c[2]])
        hits = kept(er, [c for c in cases if not c[2]]).unionByName(asking.join(found.select("event_id").distinct(), "event_id", "left_semi"))
    return hits.groupBy("artifact_type", "preset").agg(F.count("*").alias("events"))


# ---------------------------------------------------------------- registered queries

query("case_summary", "SELECT (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM er) AS event_count, (SELECT count(*) FROM files WHERE parser_status = 'failed') AS failed_parse_count, (SELECT count(*) FROM files WHERE parser_status = 'unsupported') AS unsupported_file_count", over="session")(
    lambda at: case_summary(fixture.files(*at), fixture.event_rows(*at), fixture.files(*at).select(F.col("parser_status").alias("status")))
)
query("entity_summary", f", x AS ({_ENT}), s AS ({_ENTITIES}) SELECT entity_id, type, canonical, first_seen, last_seen, events FROM s ORDER BY events DESC, last_seen DESC, type, canonical LIMIT 100")(
    lambda er: entity_summary(reduce(DataFrame.unionByName, [extract_entities(er.where(F.pmod(F.crc32("event_id"), F.lit(3)) == k)) for k in range(3)]))
)
query("attack_heatmap", FINDINGS + """, g AS (SELECT rule_id, title, count(*) AS findings, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen, first(tactics) AS tactics FROM findings GROUP BY 1, 2),
 c AS (SELECT *, unnest(CASE WHEN len(tactics) > 0 THEN tactics ELSE ['none'] END) AS tactic, substr(first_seen, 12, 2) AS hour FROM g)
 SELECT tactic, hour, CAST(sum(findings) AS BIGINT) AS findings, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM c GROUP BY 1, 2""")(lambda er: attack_heatmap(sigma_eval(er)))
_FLAGGED = FINDINGS + ", fl AS (SELECT *, event_id IN (SELECT event_id FROM findings) AS has_finding FROM er)"
_TAGS = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(words, '{w}')" for w in own) + f" THEN '{tag}' END" for own, tag in GROUP_TAGS) + "]"
query("finding_fallback_summary", _FLAGGED + f""", g AS (SELECT case_id, severity, artifact_type, event_action, count(*) AS events, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen, min(message_short) AS sample_message,
  lower(artifact_type || ' ' || event_action) AS words FROM fl WHERE has_finding OR severity IN ('critical', 'high') OR (severity = 'medium' AND regexp_matches(lower(concat_ws(' ', {', '.join(ROW_TEXT)})), {_literal(_pattern(ROW_WORDS))})) GROUP BY ALL),
 t AS (SELECT *, list_filter({_TAGS}, lambda x: x IS NOT NULL) AS tags FROM g)
 SELECT case_id, severity, event_action || ' (' || artifact_type || ')' AS title, 'event_row:' || to_json([severity, artifact_type, event_action]) AS rule_id,
  CAST(to_json(CASE WHEN len(tags) > 0 THEN tags ELSE ['event_rows:fallback'] END) AS VARCHAR) AS attack_json, 'event_rows' AS engine, events, first_seen, last_seen, sample_message FROM t""")(
    lambda er: finding_fallback_summary(with_finding_flag(er, sigma_eval(er)))
)
query("process_instances", FINDINGS + f""", n AS ({_INST}), fd AS (SELECT event_id, {MAX_SQL} AS finding_severity, array_to_string(list_sort(list(DISTINCT title))[1:8], '; ') AS titles,
  array_to_string(list_sort(list_distinct(flatten(list(techniques)))), ',') AS attack FROM findings GROUP BY 1)
 SELECT n.*, finding_severity, titles, attack, finding_severity IS NOT NULL AS has_finding FROM n LEFT JOIN fd USING (event_id)""")(lambda er: process_overlay(process_instances(er), sigma_eval(er)))
query("detection_candidate_filter", f"SELECT event_id FROM ef WHERE regexp_matches(lower(concat_ws(' ', {', '.join(CANDIDATE_TEXT)})), {_literal(_pattern(CANDIDATE_TERMS))})", over="ef")(lambda ef: detection_candidates(ef).select("event_id"))


def _sql(kind: str, values: list[str]) -> str:
    if kind == "finding":
        return "has_finding"
    if kind == "severity":
        return f"severity IN ({', '.join(map(_literal, values))})"
    if kind == "pattern":
        return f"regexp_matches(search_text, {_literal(values[0])})"
    text = {"any": "search_text", "file": "lower(coalesce(file_path, ''))", "process": "lower(coalesce(process_name, ''))"}[kind]
    return "(" + " OR ".join(f"contains(replace({text}, '\\', '/'), {_literal(v)})" for v in values) + ")"


_OWN = [(f"artifact_type = '{t}'", own) for t, own in QUICK_FILTERS.items()] + [(f"artifact_type NOT IN ({', '.join(map(_literal, QUICK_FILTERS))})", OTHER_FILTERS)]
_COUNTED = [f"SELECT artifact_type, '{k}' AS preset, count(*) AS events FROM fl WHERE {of} AND {' AND '.join(_sql(*c) for c in conditions)} GROUP BY 1" for of, own in _OWN for k, conditions in own.items()]
query("artifact_quick_filters", _FLAGGED + " " + " UNION ALL ".join(_COUNTED))(lambda er: quick_filter_counts(er, sigma_eval(er)))
