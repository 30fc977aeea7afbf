"""The examiner's side: answers, reviews, runs, bookmarks, markers, evaluation of a case."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import severity_rank, timestamp
from timeloom.operators.aggregates import event_timeline, timeline_columns
from timeloom.operators.filters import saved_search_visibility
from timeloom.operators.correlation import CHAINS, correlation_chains
from timeloom.operators.findings import SUMMARY, finding_summary, sigma_eval
from timeloom.registry import query
from timeloom.sources import fixture

# fixed values: what evidence of an answer is searched for
ANSWER_TERMS = [
    "systemhealthcheck", ".hta", "mshta", "whoami", "remoteconnectionmanager", "logontype", "1149", "powerview.ps1", "keepass", ".kdbx", ".dmp", "minidump", "lsass", "filezilla", "zeek_",
    "network_http_request", "network_ftp_command", "network_file_transfer", "network_url_observed", "pcap_conversation_reconstructed", "moveit.asp", "moveitsvc", "guestaccess.aspx", "api/v1/token",
    "nmap", "ruby", "0x17", "mssqlservice", "kerberoast", "kerberoast_candidate", "asrep_roast_candidate", "ticket_encryption", "psexec", "psexesvc", "psexec_named_pipe", "firewall_outbound",
    "firewall_block", "metasploit", "rulename", "rule added", "audit_policy", "audit policy", "other object access", "scheduled_task", "scheduled task", "task created", "eventid 4698",
    '"event_id":"4698"', "defender_threat_detected", "sharphound", "get-filehash", "hash=", "algorithm=md5", "getstreamhash", "terminalservices", "4724", "defender", "webshell", "instlogos",
    "consolehost_history", "psreadline", "wget ",
]
# fixed values: which come first, all others last
ANSWER_ORDER = [
    ("move.aspx", 0), ("ruby", 2), ("nmap", 3), ("moveit.asp", 4), ("api/v1/token", 5), ("guestaccess.aspx", 6), ("kerberoast_candidate", 7), ("asrep_roast_candidate", 7), ("ticket_encryption", 7),
    ("0x17", 7), ("psexesvc", 8), ("psexec_named_pipe", 8), ("browser_secret_decrypted", 9), ("keepass_entry_decrypted", 9), ("defender_threat_detected", 10), ("sharphound", 10),
    ("terminalservices", 11), ("remoteconnectionmanager", 11), ("1149", 11), ("logontype", 11), ("4724", 12), ("metasploit", 13), ("firewall_outbound", 13), ("firewall_block", 13),
    ("audit_policy", 14), ("audit policy", 14), ("other object access", 14), ("scheduled_task", 15), ("scheduled task", 15), ("task created", 15), ("get-filehash", 16), ("hash=", 16),
    ("algorithm=md5", 16), ("getstreamhash", 16), ("instlogos", 17), ("wget ", 18), ("systemhealthcheck", 20), ("powerview.ps1", 21), ("filezilla", 22), ("zeek_", 23),
    ("network_ftp_command", 24), ("archive_recovery_candidate", 25), ("document_sensitive_text_observed", 26), ("browser_encrypted_secret_candidate", 27),
]
_PATTERN = "|".join(re.escape(t) for t in ANSWER_TERMS)


def answer_priority(text: Column) -> Column:
    return reduce(lambda out, p: F.when(F.contains(text, F.lit(p[0])), p[1]).otherwise(out), reversed(ANSWER_ORDER), F.lit(100))


def overlay(rows: DataFrame, full: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of both tables by key: where both have one, the fuller table's filled columns lie over the other's; what only one has is appended.

    Columns are those of rows, then those that only full has; blank text (null, empty, `-`) of full covers nothing. Keys are distinct in each.
    """
    left, right = rows.alias("r"), full.alias("f")
    both = left.join(right, F.col(f"r.{key}") == F.col(f"f.{key}"), "full")
    over = lambda c: F.coalesce(F.when(~F.coalesce(F.col(f"f.{c}").cast("string"), F.lit("")).isin("", "-"), F.col(f"f.{c}")), F.col(f"r.{c}"))
    shared, more = [c for c in rows.columns if c in full.columns], [c for c in full.columns if c not in rows.columns]
    columns = [(over(c) if c in shared else F.col(f"r.{c}")).alias(c) for c in rows.columns] + [F.col(f"f.{c}").alias(c) for c in more]
    source = F.when(F.col(f"r.{key}").isNull(), "full").when(F.col(f"f.{key}").isNull(), "rows").otherwise("both")
    return both.select(*columns, source.alias("found_in"))


def answer_candidate_filter(er: DataFrame, ef: DataFrame, limit: int | None = None) -> DataFrame:
    """Events that may hold an answer by the text of their compact row or of their full record, the full ones laid over the rows; first by what
    they hold, then by time."""
    rows = er.where(F.col("search_text").rlike(_PATTERN)).select("event_id", "event_time_utc", "severity", "message_short", F.col("search_text").alias("text"))
    text = F.lower(F.concat_ws(" ", "message_full", "attributes_json"))
    full = ef.withColumn("text", text).where(F.col("text").rlike(_PATTERN)).select("event_id", "event_time_utc", "message_short", "text", "time_kind", "time_confidence")
    out = overlay(rows, full).withColumn("priority", answer_priority(F.col("text"))).drop("text").orderBy("priority", "event_time_utc", "event_id")
    return out if limit is None else out.limit(limit)


#: questions of ours: key, label, the events to look at, and where the value stands in them
ANSWER_RULES = [
    ("downloader", "Which tool fetched files?", "event_action = 'process_created' AND regexp_like(search_text, '(certutil|bitsadmin|mshta)')", "search_text", "(certutil|bitsadmin|mshta)", 0.8),
    ("weak_ticket", "Which account's ticket was weak?", "event_code = '4769' AND contains(search_text, '0x17')", "search_text", "targetusername\":\"([a-z0-9]+)", 0.9),
    ("detected_file", "Which file did Defender detect?", "event_action = 'defender_threat_detected'", "file_path", "([^/]+)$", 0.95),
]


def answer_rules(er: DataFrame) -> DataFrame:
    """question_key, label, value, events, confidence, severity: values taken out by the rules; one pass over the rows."""
    hits = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit(k).alias("question_key"), F.lit(label).alias("label"), F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).alias("value"), F.lit(sure).alias("confidence"))) for k, label, test, c, pattern, sure in ANSWER_RULES]))
    rows = er.select("event_id", "severity", F.explode(hits).alias("a")).select("event_id", "severity", "a.*").where("value IS NOT NULL")
    return rows.groupBy("question_key", "label", "value").agg(F.count("*").alias("events"), F.max("confidence").alias("confidence"), F.max(severity_rank("severity")).alias("rank"))


def answer_candidates(answers: DataFrame, question: str | None = None, limit: int | None = 100) -> DataFrame:
    out = answers if question is None else answers.where(F.col("question_key") == question)
    out = out.orderBy(F.desc("confidence"), F.desc("rank"), F.desc("events"), "question_key", "value")
    return out if limit is None else out.limit(limit)


def answer_questions(answers: DataFrame) -> DataFrame:
    return answers.select("question_key", "label").distinct().orderBy("label")


def analyzer_runs(runs: DataFrame, limit: int | None = 100) -> DataFrame:
    """runs: run_id, analyzer, status, started_at; the latest first."""
    out = runs.orderBy(F.desc("started_at"), F.desc("run_id"))
    return out if limit is None else out.limit(limit)


def audit_log_view(log: DataFrame, limit: int | None = 200) -> DataFrame:
    out = log.orderBy(F.desc("at"), F.desc("entry_id"))
    return out if limit is None else out.limit(limit)


def bookmark_event_page(er: DataFrame, bookmarks: DataFrame, limit: int = 100) -> DataFrame:
    """A page of the bookmarked events, one row more than the limit where there is one."""
    return er.join(bookmarks.select("event_id").distinct(), "event_id", "left_semi").orderBy("event_time_utc", "event_id").limit(limit + 1)


def timeline_markers(columns: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks (kind, time) counted per column of a timeline (column, start, next); the columns are few, so they are broadcast."""
    inside = (F.col("time") >= F.col("start")) & (F.col("next").isNull() | (F.col("time") < F.col("next")))
    return marks.join(F.broadcast(columns), inside).groupBy("column", "kind").agg(F.count("*").alias("marks"))


OPEN = ["new", "in_review", "needs_context"]
STATUSES = ["new", "in_review", "confirmed", "false_positive", "benign", "needs_context"]


def review_summary(reviews: DataFrame, now: str) -> DataFrame:
    """reviews: status, assignee, due_at, tags (array). One row of counts."""
    is_open = F.col("status").isin(OPEN)
    return reviews.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES], F.count_if(is_open).alias("open_count"),
        F.count_if(is_open & (F.trim(F.coalesce("assignee", F.lit(""))) == "")).alias("unassigned_count"), F.count_if(is_open & F.coalesce(timestamp("due_at") < timestamp(F.lit(now)), F.lit(False))).alias("overdue_count"),
        F.count_if(F.size(F.coalesce("tags", F.array())) > 0).alias("tagged_count"))


# fixed values: what a case should show: id, types of artifact, words of a finding, techniques
OBJECTIVES = [
    ("execution", ["prefetch", "amcache", "evtx"], ["execution", "powershell", "lolbin", "scheduled"], ["T1059", "T1204"]), ("credential_access", ["evtx", "defender"], ["credential", "lsass", "password"], ["T1003", "T1110"]),
    ("persistence", ["registry", "scheduled_task", "evtx"], ["persistence", "service", "scheduled"], ["T1547", "T1543", "T1053"]), ("defense_evasion", ["defender", "mft", "usn_jrnl"], ["defender", "delete", "tamper"], ["T1070", "T1562"]),
    ("lateral_movement", ["evtx", "prefetch"], ["psexec", "remote", "wmi"], ["T1021", "T1570"]), ("filesystem_timeline", ["mft", "usn_jrnl", "lnk", "prefetch"], ["mft", "download", "delete"], ["T1070", "T1105"]),
    ("network_ioc", ["browser", "srum", "evtx"], ["download", "c2", "ioc"], ["T1105", "T1071"]),
]


def _any_starts(column: str, prefix: str) -> Column:
    return F.exists(column, lambda t: F.startswith(t, F.lit(prefix)))


def objectives(groups: DataFrame, types: DataFrame, chains: DataFrame) -> DataFrame:
    """objective, status, groups, findings: covered by a finding group, partial where only the artifacts are there, else missing.

    groups: rule_id, title, engine, techniques, findings; types: artifact_type; chains: any rows. The objectives are eight.
    """
    text = F.lower(F.concat_ws(" ", "engine", "rule_id", "title"))
    fits = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) | reduce(lambda a, b: a | b, [_any_starts("techniques", x) for x in attack]), F.lit(k)) for k, _, words, attack in OBJECTIVES]
    matched = groups.select("findings", F.explode(F.array_compact(F.array(*fits))).alias("objective")).groupBy("objective").agg(F.count("*").alias("groups"), F.sum("findings").alias("findings"))
    hints = [F.when(reduce(lambda a, b: a | b, [F.contains("artifact_type", F.lit(h)) for h in own]), F.lit(k)) for k, own, _, _ in OBJECTIVES]
    present = types.select(F.explode(F.array_compact(F.array(*hints))).alias("objective")).distinct().withColumn("present", F.lit(True))
    all_ = groups.sparkSession.createDataFrame([(k,) for k, *_ in OBJECTIVES], "objective string")
    own = all_.join(F.broadcast(matched), "objective", "left").join(F.broadcast(present), "objective", "left")
    status = F.when(F.col("groups") > 0, "covered").when(F.col("present"), "partial").otherwise("missing")
    own = own.select("objective", status.alias("status"), F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("findings", F.lit(0)).alias("findings"))
    cross = chains.agg(F.count("*").alias("groups")).select(F.lit("cross_artifact_correlation").alias("objective"), F.when(F.col("groups") > 0, "covered").otherwise("partial").alias("status"), "groups", F.col("groups").alias("findings"))
    return own.unionByName(cross)


def case_evaluation(parts: DataFrame, unreviewed_high: Column, parsed_rate: Column, files: Column, approved: bool) -> DataFrame:
    """One row: coverage, readiness, quality of the report and their weighted sum, with the quality gates. parts: objectives, then one-row columns."""
    covered, partial, missing = (F.count_if(F.col("status") == s) for s in ("covered", "partial", "missing"))
    row = parts.agg(covered.alias("covered"), partial.alias("partial"), missing.alias("missing"), F.max(unreviewed_high).alias("unreviewed"), F.max(parsed_rate).alias("rate"), F.max(files).alias("files"), F.max(F.when(F.col("objective") == "cross_artifact_correlation", F.col("groups"))).alias("chains"))
    row = row.withColumn("detection", F.round((F.col("covered") + F.col("partial") * 0.5) * 100 / (F.col("covered") + F.col("partial") + F.col("missing")), 1))
    row = row.withColumn("readiness", F.greatest(F.lit(0.0), F.round(F.lit(100.0) - F.col("unreviewed") * 7 - F.col("missing") * 8, 1)))
    row = row.withColumn("report", F.least(F.lit(100), F.when(F.col("files") == 0, 45).otherwise(0) + F.lit(25 if approved else 0) + 20).cast("double"))
    gate = lambda ok, warn: F.when(ok, "pass").when(warn, "warn").otherwise("fail")
    return row.select(
        "detection", "readiness", "report", F.round(F.col("detection") * 0.45 + F.col("readiness") * 0.35 + F.col("report") * 0.2, 1).alias("overall"), gate(F.col("rate") >= 95, F.col("rate") >= 80).alias("parser_coverage"),
        gate(F.col("unreviewed") == 0, F.col("unreviewed") <= 3).alias("high_finding_review"), gate(F.col("chains") > 0, F.lit(False)).alias("correlation_drilldown"), gate(F.col("files") == 0, F.lit(False)).alias("evidence_verification"),
        F.lit("pass" if approved else "warn").alias("report_bundle_approval"))


def _sql_text(words) -> str:
    return " OR ".join(f"contains(search_text, '{w}')" for w in words)


_ORDERED = "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN {n}" for t, n in ANSWER_ORDER) + " ELSE 100 END"
query("answer_candidate_filter", f""", c AS (SELECT event_id, lower(concat_ws(' ', message_full, attributes_json)) AS text FROM ef), f AS (SELECT * FROM c WHERE {_sql_text(ANSWER_TERMS).replace('search_text', 'text')}),
 r AS (SELECT event_id, severity, search_text AS text FROM er WHERE severity <> 'info' AND ({_sql_text(ANSWER_TERMS)})),
 o AS (SELECT coalesce(f.event_id, r.event_id) AS event_id, r.severity, coalesce(f.text, r.text) AS text, f.event_id AS in_full, CASE WHEN r.event_id IS NULL THEN 'full' WHEN f.event_id IS NULL THEN 'rows' ELSE 'both' END AS found_in FROM r FULL JOIN f ON r.event_id = f.event_id)
 SELECT o.event_id, o.severity, o.found_in, {_ORDERED} AS priority, CASE WHEN in_full IS NOT NULL THEN time_kind END AS time_kind, CASE WHEN in_full IS NOT NULL THEN time_confidence END AS time_confidence FROM o JOIN ef ON ef.event_id = o.event_id""", over="session")(
    lambda at: answer_candidate_filter(fixture.event_rows(*at).where("severity <> 'info'"), fixture.events_full(*at)).select("event_id", "severity", "found_in", "priority", "time_kind", "time_confidence")
)
_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_A = ", a0 AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS question_key, '{label.replace(chr(39), chr(39) * 2)}' AS label, nullif(regexp_extract({c}, '{pattern}', 1), '') AS value, {sure} AS confidence, severity FROM er WHERE {test.replace('regexp_like', 'regexp_matches')}" for k, label, test, c, pattern, sure in ANSWER_RULES
) + f"), a AS (SELECT question_key, label, value, count(*) AS events, CAST(max(confidence) AS DOUBLE) AS confidence, max({_RANK}) AS rank FROM a0 WHERE value IS NOT NULL GROUP BY 1, 2, 3)"
query("answer_rules", _A + " SELECT * FROM a")(answer_rules)
query("answer_candidates", _A + " SELECT * FROM a ORDER BY confidence DESC, rank DESC, events DESC, question_key, value LIMIT 100")(lambda er: answer_candidates(answer_rules(er)))
query("answer_questions", _A + " SELECT DISTINCT question_key, label FROM a")(lambda er: answer_questions(answer_rules(er)))


def _orders(at) -> DataFrame:
    return at[0].read.parquet(f"{at[1]}/orders.parquet")


query("analyzer_runs", "SELECT o_orderkey AS run_id, o_orderpriority AS analyzer, o_orderstatus AS status, CAST(o_orderdate AS VARCHAR) AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100", over="session")(
    lambda at: analyzer_runs(_orders(at).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("analyzer"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("string").alias("started_at")))
)
query("audit_log_view", "SELECT o_orderkey AS entry_id, CAST(o_orderdate AS VARCHAR) AS at, o_orderstatus AS action FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200", over="session")(
    lambda at: audit_log_view(_orders(at).select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").cast("string").alias("at"), F.col("o_orderstatus").alias("action")))
)
_BOOKED = "event_id LIKE '%77'"
query("bookmark_event_page", f"SELECT event_id FROM er WHERE {_BOOKED} ORDER BY event_time_utc, event_id LIMIT 101")(lambda er: bookmark_event_page(er, er.where(_BOOKED).select("event_id")).select("event_id"))


def _markers(er: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    columns = timeline_columns(event_timeline(er))
    columns = columns.select("column", "start", F.lead("start").over(Window.orderBy("start")).alias("next"))  # 200 columns at most
    marks = sigma_eval(er).select(F.lit("finding").alias("kind"), F.col("event_time_utc").alias("time")).unionByName(er.where(_BOOKED).select(F.lit("bookmark").alias("kind"), F.col("event_time_utc").alias("time")))
    return timeline_markers(columns, marks)


query("timeline_markers", SUMMARY + f""", b AS (SELECT DISTINCT substr(event_time_utc, 1, 13) || ':00:00Z' AS bin FROM er), r AS (SELECT bin, row_number() OVER (ORDER BY bin) AS k, count(*) OVER () AS n FROM b),
 c AS (SELECT CAST((k - 1) // CAST(ceil(n / 200.0) AS BIGINT) AS BIGINT) AS "column", min(bin) AS start FROM r GROUP BY 1), d AS (SELECT *, lead(start) OVER (ORDER BY start) AS next FROM c),
 m AS (SELECT 'finding' AS kind, event_time_utc AS time FROM findings UNION ALL SELECT 'bookmark', event_time_utc FROM er WHERE {_BOOKED}) SELECT "column", kind, count(*) AS marks FROM m JOIN d ON time >= start AND (next IS NULL OR time < next) GROUP BY 1, 2""")(_markers)
_NUMBER = "CAST(substr(event_id, 3) AS BIGINT)"


def _reviews(er: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.expr(f"{_NUMBER} % 6") + 1).cast("int"))
    return er.where("severity IN ('critical', 'high')").select(status.alias("status"), F.col("user_name").alias("assignee"), F.col("event_time_utc").alias("due_at"), F.when(F.col("host") == "HOST1", F.array("artifact_type")).otherwise(F.array().cast("array<string>")).alias("tags"))


_V = f", v AS (SELECT [{', '.join(repr(s) for s in STATUSES)}][{_NUMBER} % 6 + 1] AS status, user_name AS assignee, event_time_utc AS due_at, host FROM er WHERE severity IN ('critical', 'high'))"
_O = "status IN ('new', 'in_review', 'needs_context')"
query("review_summary", _V + " SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in STATUSES) + f", count(*) FILTER ({_O}) AS open_count, count(*) FILTER ({_O} AND trim(coalesce(assignee, '')) = '') AS unassigned_count, count(*) FILTER ({_O} AND due_at < '2024-01-15T00:00:00Z') AS overdue_count, count(*) FILTER (host = 'HOST1') AS tagged_count FROM v")(
    lambda er: review_summary(_reviews(er), "2024-01-15T00:00:00Z")
)
query("saved_search_visibility", "SELECT event_id FROM er WHERE user_name = 'user1' OR severity = 'info' OR (severity = 'low' AND (host = 'HOST1' OR user_name = 'user1'))")(
    lambda er: saved_search_visibility(
        er.select("event_id", F.col("user_name").alias("owner"), F.when(F.col("severity") == "info", "public").when(F.col("severity") == "low", "restricted").otherwise("private").alias("visibility"), F.when(F.col("host") == "HOST1", F.array(F.lit("user1"))).otherwise(F.array(F.lit("x"))).alias("members")), "user1").select("event_id")
)


def _objectives(er: DataFrame) -> DataFrame:
    return objectives(finding_summary(sigma_eval(er)), er.select("artifact_type").distinct(), correlation_chains(er))


def _evaluated(at) -> DataFrame:
    er, files = fixture.event_rows(*at), fixture.files(*at)
    high = finding_summary(sigma_eval(er)).agg(F.count_if(severity_rank("severity") >= 4).alias("high"))
    rate = files.agg((F.round(F.count_if(F.col("parser_status") == "parsed") * 1000.0 / F.count("*")) / 10).alias("rate"), F.count("*").alias("n_files"))
    return case_evaluation(_objectives(er).crossJoin(F.broadcast(high)).crossJoin(F.broadcast(rate)), F.col("high"), F.col("rate"), F.col("n_files"), approved=True)  # one row each


_OBJ = ", ob AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS objective, (SELECT count(*) FROM groups WHERE {m}) AS groups, CAST(coalesce((SELECT sum(findings) FROM groups WHERE {m}), 0) AS BIGINT) AS findings, EXISTS (SELECT 1 FROM er WHERE {h}) AS present"
    for k, h, m in ((k, " OR ".join(f"contains(artifact_type, '{x}')" for x in own), " OR ".join([*(f"contains(lower(concat_ws(' ', engine, rule_id, title)), '{w}')" for w in words), *(f"len(list_filter(techniques, lambda t: starts_with(t, '{x}'))) > 0" for x in attack)])) for k, own, words, attack in OBJECTIVES)
) + "), objectives AS (SELECT objective, CASE WHEN groups > 0 THEN 'covered' WHEN present THEN 'partial' ELSE 'missing' END AS status, groups, findings FROM ob UNION ALL SELECT 'cross_artifact_correlation', CASE WHEN count(*) > 0 THEN 'covered' ELSE 'partial' END, count(*), count(*) FROM chains)"
query("case_objectives", SUMMARY + CHAINS + _OBJ + " SELECT * FROM objectives")(_objectives)
query("case_evaluation", SUMMARY + CHAINS + _OBJ + """, s AS (SELECT count(*) FILTER (status = 'covered') AS c, count(*) FILTER (status = 'partial') AS p, count(*) FILTER (status = 'missing') AS m, max(CASE WHEN objective = 'cross_artifact_correlation' THEN groups END) AS chains FROM objectives),
 h AS (SELECT count(*) AS high FROM groups WHERE severity IN ('critical', 'high')), f AS (SELECT round(1000.0 * count(*) FILTER (parser_status = 'parsed') / count(*)) / 10 AS rate, count(*) AS n FROM files),
 x AS (SELECT round((c + 0.5 * p) * 100 / (c + p + m), 1) AS detection, greatest(0.0, round(100.0 - 7 * high - 8 * m, 1)) AS readiness, CAST(45 AS DOUBLE) AS report, rate, high, chains FROM s, h, f)
 SELECT CAST(detection AS DOUBLE) AS detection, CAST(readiness AS DOUBLE) AS readiness, report, CAST(round(detection * 0.45 + readiness * 0.35 + report * 0.2, 1) AS DOUBLE) AS overall, CASE WHEN rate >= 95 THEN 'pass' WHEN rate >= 80 THEN 'warn' ELSE 'fail' END AS parser_coverage,
  CASE WHEN high = 0 THEN 'pass' WHEN high <= 3 THEN 'warn' ELSE 'fail' END AS high_finding_review, CASE WHEN chains > 0 THEN 'pass' ELSE 'fail' END AS correlation_drilldown, 'fail' AS evidence_verification, 'pass' AS report_bundle_approval FROM x""", over="session")(_evaluated)
