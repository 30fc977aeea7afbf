"""Filters: plain Columns, combined with & | ~ and handed to DataFrame.filter. Cheap equalities stay separate conjuncts so that they are pushed down."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import timestamp
from timeloom.registry import query

CONTAINS = {
    "id": "event_id", "time": "event_time_utc", "host": "host", "user": "user_name", "process": "process_name", "path": "file_path", "ip": "ip", "url": "url",
    "channel": "channel", "level": "severity", "message": "message_short", "source": "source_file_id",
}
EXACT = {"type": "artifact_type", "hash": "hash", "action": "event_action", "severity": "severity", "parser": "parser_name", "finding": "has_finding"}
EDGE = r"($|[^\p{Alnum}_])"


def contains(text: str) -> Column:
    """Free text: a substring of the search text."""
    return F.contains("search_text", F.lit(text.lower()))


def field_contains(field: str, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(CONTAINS[field]).cast("string"), F.lit(""))), F.lit(text.lower()))


def field_exact(field: str, text: str) -> Column:
    return F.lower(F.col(EXACT[field]).cast("string")) == text.lower()


def glob(column: str, pattern: str) -> Column:
    """Anchored, * for any text and ? for one character."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower(F.col(column)).rlike(f"(?s)^{body}$")


def regex(column: str, pattern: str) -> Column:
    """The pattern is lower-cased whole, its classes too."""
    return F.lower(F.col(column)).rlike(pattern.lower())


def word(text: str, column: str = "search_text") -> Column:
    return F.col(column).rlike(r"(^|[^\p{Alnum}_])" + re.escape(text.lower()) + EDGE)


def extension(ext: str) -> Column:
    text = F.lower(F.concat_ws(" ", "file_path", "process_name", "message_short"))
    return text.rlike(r"\." + re.escape(ext.lower().lstrip(".")) + EDGE)


def time_range(after: str | None = None, before: str | None = None, before_exclusive: str | None = None) -> Column:
    """Rows whose time can't be read are dropped."""
    t = timestamp("event_time_utc")
    parts = [t >= timestamp(F.lit(after))] * bool(after) + [t <= timestamp(F.lit(before))] * bool(before) + [t < timestamp(F.lit(before_exclusive))] * bool(before_exclusive)
    return reduce(lambda a, b: a & b, parts, t.isNotNull())


def form(codes: list[str] = (), user: str = "", ip: str = "", host: str = "", start: str = "", end: str = "", text: str = "") -> Column:
    """Form fields joined by AND; event codes by OR; times of minute precision end with the minute."""
    parts = [F.col("event_code").isin(list(codes))] if codes else []
    parts += [field_contains(k, v) for k, v in (("user", user), ("ip", ip), ("host", host)) if v]
    pad = lambda t, s: f"{t[:16]}:{s}Z" if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\dZ?", t) else t
    if start or end:
        parts.append(time_range(pad(start, "00") or None, pad(end, "59") or None))
    if text:
        parts.append(contains(text))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def defender() -> Column:
    """Six signs of the Defender log, by OR."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    signs = [("artifact_type", "defender"), ("channel", "defender"), ("event_action", "defender"), ("parser_name", "defender"), ("message_short", "windows defender"), ("message_short", "malware")]
    return reduce(lambda a, b: a | b, [F.contains(low(c), F.lit(v)) for c, v in signs])


def chain_key(kind: str, value: str) -> Column:
    from timeloom.functions.columns import basename

    of = {"file_basename": basename(F.coalesce("file_path", "process_name")), "ip": F.lower("ip"), "hash": F.lower("hash"), "url": F.lower("url"), "user_name": F.lower("user_name")}
    return of[kind] == value.lower()


#: words of interest in messages; fixed values of ours
SUSPICIOUS = (
    "powershell|-enc|certutil|bitsadmin|mshta|rundll32|regsvr32|wmic|schtasks|wevtutil|vssadmin|mimikatz|psexec|cobalt|beacon|\\.ps1|\\.vbs|\\.hta|temp|"
    "downloads|appdata|payload|evil|dump|lsass|ntds|encoded|bypass|hidden|inject|keylog|ransom|exploit|shell"
)


def suspicious() -> Column:
    return F.col("severity").isin("critical", "high") | ((F.col("severity") == "medium") & F.col("search_text").rlike(SUSPICIOUS))


def suspicious_words(ef: DataFrame) -> DataFrame:
    """Events with a word of interest in action, process, message or attributes."""
    return ef.where(F.lower(F.concat_ws(" ", "event_action", "process_name", "message_full", "attributes_json")).rlike(SUSPICIOUS))


def saved_search_visibility(searches: DataFrame, viewer: str | None) -> DataFrame:
    """No viewer sees all; else one's own, those that aren't private, and restricted ones that name the viewer."""
    if viewer is None:
        return searches
    who = F.col("owner") == viewer
    return searches.where(who | (F.col("visibility") == "public") | ((F.col("visibility") == "restricted") & F.array_contains("members", viewer)))


#: presets of the quick filters by artifact type
PRESETS = {
    "evtx": {"failed logons": lambda: field_exact("action", "logon_failure"), "processes": lambda: field_exact("action", "process_created")},
    "usn_jrnl": {"deleted": lambda: field_exact("action", "usn_deleted"), "scripts": lambda: extension("ps1") | extension("js")},
    "browser": {"downloads": lambda: field_exact("action", "browser_download"), "executables": lambda: extension("exe") | extension("msi")},
    "prefetch": {"lolbins": lambda: word("certutil") | word("powershell"), "user writable": lambda: field_contains("path", "/downloads/")},
    "mft": {"user writable": lambda: field_contains("path", "/downloads/")},
}

_IDS = "SELECT event_id FROM er WHERE "


def _filter(name: str, column, sql: str) -> None:
    query(name, _IDS + sql)(lambda er: er.where(column()).select("event_id"))


_filter("filter_structured", lambda: (F.col("artifact_type") == "evtx") & (F.col("user_name") == "user7") & contains("logon"),
        "artifact_type = 'evtx' AND user_name = 'user7' AND contains(search_text, 'logon')")
_filter("dsl_contains", lambda: contains("Evil"), "contains(search_text, 'evil')")
_filter("dsl_field_contains", lambda: field_contains("path", "SETUP") & field_contains("host", "host1"), "contains(lower(coalesce(file_path, '')), 'setup') AND contains(lower(host), 'host1')")
_filter("dsl_field_exact", lambda: field_exact("severity", "HIGH") & field_exact("action", "usn_deleted"), "lower(severity) = 'high' AND lower(event_action) = 'usn_deleted'")
_filter("dsl_glob", lambda: glob("event_code", "472*") | glob("process_name", "evil?.exe"), "regexp_matches(lower(event_code), '^472.*$') OR regexp_matches(lower(process_name), '^evil.\\.exe$')")
_filter("dsl_regex", lambda: regex("file_path", r"downloads/(evil|setup)[0-4]\."), "regexp_matches(lower(file_path), 'downloads/(evil|setup)[0-4]\\.')")
_filter("dsl_word", lambda: word("cmd"), "regexp_matches(search_text, '(^|[^[:alnum:]_])cmd($|[^[:alnum:]_])')")
_filter("dsl_ext", lambda: extension("js"), "regexp_matches(lower(concat_ws(' ', file_path, process_name, message_short)), '\\.js($|[^[:alnum:]_])')")
_filter("dsl_time_range", lambda: time_range("2024-01-05T00:00:00Z", None, "2024-01-06T12:00:00Z"),
        "try_cast(event_time_utc AS TIMESTAMP) >= TIMESTAMP '2024-01-05' AND try_cast(event_time_utc AS TIMESTAMP) < TIMESTAMP '2024-01-06 12:00:00'")
_filter("form_filter", lambda: form(["4624", "4625"], user="user1", start="2024-01-02T00:00Z", end="2024-01-20T10:30"),
        "event_code IN ('4624', '4625') AND contains(lower(coalesce(user_name, '')), 'user1') AND event_time_utc >= '2024-01-02T00:00:00Z' AND event_time_utc <= '2024-01-20T10:30:59Z'")
_filter("bin_window_filter", lambda: (F.col("event_time_utc") >= "2024-01-03T05:00:00Z") & (F.col("event_time_utc") < "2024-01-03T06:00:00Z"),
        "event_time_utc >= '2024-01-03T05:00:00Z' AND event_time_utc < '2024-01-03T06:00:00Z'")
_filter("dsl_negation", lambda: ~field_contains("user", "user1") & ~field_exact("hash", "x"), "NOT contains(lower(coalesce(user_name, '')), 'user1') AND NOT (lower(hash) = 'x')")
_filter("dsl_boolean", lambda: (contains("evil") | contains("payload")) & ~(field_exact("type", "mft") | field_exact("type", "usn_jrnl")),
        "(contains(search_text, 'evil') OR contains(search_text, 'payload')) AND NOT (artifact_type = 'mft' OR artifact_type = 'usn_jrnl')")
_filter("defender_filter", defender, "contains(lower(concat_ws('|', artifact_type, channel, event_action, parser_name)), 'defender') OR contains(lower(message_short), 'windows defender') OR contains(lower(message_short), 'malware')")
_filter("ioc_event_filter", lambda: (F.lower("ip") == "10.0.0.3") | (F.lower("process_name") == "evil1.exe"), "lower(ip) = '10.0.0.3' OR lower(process_name) = 'evil1.exe'")
_filter("chain_key_filter", lambda: chain_key("file_basename", "evil2.exe"), "regexp_replace(lower(coalesce(file_path, process_name)), '^.*[\\\\/]', '') = 'evil2.exe'")
_filter("suspicious_row_filter", suspicious, f"severity IN ('critical', 'high') OR (severity = 'medium' AND regexp_matches(search_text, '{SUSPICIOUS}'))")
_filter("usn_script_filter", lambda: (F.col("artifact_type") == "usn_jrnl") & PRESETS["usn_jrnl"]["scripts"](),
        "artifact_type = 'usn_jrnl' AND regexp_matches(lower(concat_ws(' ', file_path, process_name, message_short)), '\\.(ps1|js)($|[^[:alnum:]_])')")
query("suspicious_word_filter", f"SELECT event_id FROM ef WHERE regexp_matches(lower(concat_ws(' ', event_action, process_name, message_full, attributes_json)), '{SUSPICIOUS}')", over="ef")(
    lambda ef: suspicious_words(ef).select("event_id")
)
