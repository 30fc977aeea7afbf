"""Exports and logs to events: header names are normalised, the first filled column of a list counts, times by their digits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.columns import normalize_time
from timeloom.registry import query
from timeloom.sources import fixture
from timeloom.sources.storage import table_path


def normalised(df: DataFrame) -> DataFrame:
    """Columns named by their letters and digits in lower case; the first of equal names stays. Nested columns are flattened by their path."""
    flat = [c for f in df.schema.fields for c in ([F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}{g}") for g in f.dataType.names] if f.dataType.typeName() == "struct" else [F.col(f"`{f.name}`")])]
    wide = df.select(*flat)
    seen: dict[str, str] = {}
    for name in wide.columns:
        seen.setdefault(re.sub(r"[^a-z0-9]", "", name.lower()), name)
    return wide.select(*[F.col(f"`{old}`").cast("string").alias(new) for new, old in seen.items() if new])


def clean(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~(t.isin("", "-") | (F.lower(t) == "null")), t)


def pick(df: DataFrame, *names: str) -> Column:
    """The first filled of the columns that df has."""
    own = [clean(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def last_part(c: Column) -> Column:
    return F.regexp_replace(c, r"^.*[\\/]", "")


def when(c: Column) -> Column:
    return F.date_format(normalize_time(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_HOST, _USER, _HASH = ("computername", "computer", "host", "hostname"), ("username", "user", "profile"), ("sha1", "sha256", "md5", "hash")
_OUT = ["artifact_type", "event_time_utc", "time_kind", "event_action", "severity", "host", "user_name", "process_name", "file_path", "url", "hash", "message"]


def _event(df: DataFrame, **columns) -> DataFrame:
    text = F.lit(None).cast("string")
    return df.select(*[(columns.get(c, text) if isinstance(columns.get(c, text), Column) else F.lit(columns[c])).alias(c) for c in _OUT])


def normalize_prefetch(export: DataFrame) -> DataFrame:
    """An event for each last and previous run; a row without any is observed without a time."""
    df = normalised(export)
    path = pick(df, "fullpath", "filepath", "path", "executable", "executablename", "filename", "sourcefilename")
    process = F.coalesce(pick(df, "executablename", "executable", "processname", "application"), last_part(path))
    runs = [("lastrun", "prefetch_last_run"), ("lastruntime", "prefetch_last_run"), ("lastrun0", "prefetch_last_run"), *((f"previousrun{k}", "prefetch_previous_run") for k in range(8))]
    each = [F.when(clean(F.col(c)).isNotNull(), F.struct(F.lit(kind).alias("kind"), clean(F.col(c)).alias("t"))) for c, kind in runs if c in df.columns]
    found = F.array_compact(F.array(*each)) if each else F.array()
    none = F.array(F.struct(F.lit("prefetch_observed").alias("kind"), pick(df, "timestamp", "datetime", "time").alias("t")))
    rows = df.withColumns({"p": path, "n": process, "count": pick(df, "runcount"), "h": pick(df, *_HOST), "u": pick(df, *_USER), "d": pick(df, "hash", "sha1", "sha256", "md5")})
    rows = rows.withColumn("r", F.explode(F.when(F.size(found) > 0, found).otherwise(none)) if each else F.explode(none))
    seen = F.when(F.col("r.kind") == "prefetch_observed", F.concat(F.lit("Prefetch execution observed: "), F.coalesce("n", "p"))).otherwise(
        F.concat(F.lit("Prefetch execution: "), F.coalesce("n", "p"), F.coalesce(F.concat(F.lit(" run_count="), "count"), F.lit(""))))
    return _event(rows, artifact_type="prefetch", event_time_utc=when(F.col("r.t")), time_kind=F.col("r.kind"), event_action="process_executed", severity="info", host=F.col("h"), user_name=F.col("u"),
                  process_name=F.col("n"), file_path=F.col("p"), hash=F.col("d"), message=seen)


def normalize_amcache(export: DataFrame) -> DataFrame:
    df = normalised(export)
    path = pick(df, "fullpath", "filepath", "path", "filename", "name", "programname", "value")
    process = F.coalesce(pick(df, "programname", "executablename", "name", "filename", "productname"), last_part(path))
    time = pick(df, "lastwritetimestamp", "lastwrite", "lastmodified", "lastmodifiedtime", "timestamp", "datetime", "created", "firstseen")
    return _event(df, artifact_type="amcache", event_time_utc=when(time), event_action="amcache_program_seen", severity="info", host=pick(df, *_HOST), user_name=pick(df, *_USER), process_name=process, file_path=path,
                  hash=pick(df, *_HASH), message=F.concat(F.lit("Amcache program observed: "), F.coalesce(process, path)))


def usn_action(reason: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(low.contains("delete"), "usn_deleted").when(low.contains("rename"), "usn_renamed").when(low.contains("create"), "usn_created").when(
        low.rlike("overwrite|extend|truncate|data"), "usn_modified").otherwise("usn_changed")


def normalize_usn(export: DataFrame) -> DataFrame:
    df = normalised(export)
    path, reason = pick(df, "fullpath", "filepath", "path", "filename", "name"), pick(df, "reason", "reasons")
    action = usn_action(reason)
    return _event(df, artifact_type="usn_jrnl", event_time_utc=when(pick(df, "timestamp", "datetime", "time", "date", "eventtime", "usntime", "changedtime")), event_action=action,
                  severity=F.when(action.isin("usn_deleted", "usn_renamed"), "medium").otherwise("info"), host=pick(df, *_HOST), user_name=pick(df, "username", "user"), file_path=path,
                  message=F.concat(F.lit("USN "), action, F.lit(": "), path, F.coalesce(F.concat(F.lit(" reason="), reason), F.lit(""))))


def normalize_browser(export: DataFrame) -> DataFrame:
    df = normalised(export)
    url, title = pick(df, "url", "typedurl", "destinationurl", "sourceurl", "downloadurl"), pick(df, "title", "pagetitle", "name")
    path = F.coalesce(pick(df, "targetfilename", "downloadpath", "downloadfilepath", "fullpath", "filepath", "path", "filename"), F.nullif(F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1), F.lit("")))
    time = pick(df, "visittime", "lastvisittime", "lastvisit", "lastvisited", "timestamp", "datetime", "time", "visitdate", "lastaccessed")
    text = F.when(url.isNotNull(), F.concat(F.lit("Browser visit: "), url, F.coalesce(F.concat(F.lit(" title="), title), F.lit("")))).otherwise(F.concat(F.lit("Browser visit: "), F.coalesce(title, F.lit(""))))
    return _event(df, artifact_type="browser", event_time_utc=when(time), event_action="browser_visit", severity="info", host=pick(df, *_HOST), user_name=pick(df, *_USER), url=url, file_path=path, hash=pick(df, *_HASH), message=text)


def windows_action(code: Column) -> Column:
    return F.when(code == "4624", "logon_success").when(code == "4625", "logon_failure").when(code == "4688", "process_created").when(code == "1102", "audit_log_cleared").otherwise("windows_event")


def normalize_windows_event(export: DataFrame) -> DataFrame:
    df = normalised(export)
    code = pick(df, "eventid", "eventcode", "id")
    return _event(df, artifact_type="evtx", event_time_utc=when(pick(df, "timecreated", "timestamp", "datetime", "time")), event_action=windows_action(code),
                  severity=F.when(code == "1102", "critical").when(code == "4625", "high").otherwise("info"), host=pick(df, *_HOST), user_name=pick(df, *_USER), message=pick(df, "message"))


NORMALISERS = {"prefetch": normalize_prefetch, "amcache": normalize_amcache, "usn_jrnl": normalize_usn, "browser": normalize_browser, "evtx": normalize_windows_event}


def ingest_structured(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV or JSON-lines export, read by Spark, to events."""
    read = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.csv(path, header=True, escape='"')
    return NORMALISERS[kind](read)


def ingest_text_log(lines: DataFrame) -> DataFrame:
    """lines (file_path, line) to events; the words ERROR and FAIL, then WARN, set the severity. Empty lines drop out."""
    low = F.lower("line")
    severity = F.when(low.rlike("error|fail"), "high").when(low.contains("warn"), "medium").otherwise("info")
    return lines.where("line <> ''").select("file_path", F.lit("text_log").alias("artifact_type"), F.lit("observed").alias("event_action"), severity.alias("severity"), F.col("line").alias("message"))


def detect_artifact_type(path: Column, header: Column, content: Column | None = None) -> Column:
    """The type of a file by its path and its first line."""
    low, head = F.lower(path), F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), "[^a-z0-9]", "")
    p, h = (lambda *w: low.rlike("|".join(map(re.escape, w)))), (lambda *w: head.rlike("|".join(w)))
    ends = lambda *e: low.rlike(r"(" + "|".join(map(re.escape, e)) + ")$")
    xml = content.contains("<EventID") if content is not None else F.lit(False)
    return (
        F.when(ends(".pf") | p("prefetch", "pecmd") | (h("executable", "sourcefilename") & h("runcount", "lastrun", "previousrun")), "prefetch")
        .when(p("amcache") | (h("sha1", "sha256") & h("programname", "filepath", "fullpath", "path")), "amcache")
        .when(p("usnjrnl", "$j") | (p("usn") & ends(".csv")) | (h("usn") & h("reason") & h("filename", "filereference")), "usn_jrnl")
        .when(p("browser", "places.sqlite") | (p("history") & ends(".csv")) | (h("url") & h("visit", "title")), "browser")
        .when(p("mft") | h("entrynumber"), "mft").when(ends(".evtx", ".xml") | xml | h("eventid"), "evtx").when(ends(".txt", ".log", ".fake"), "text_log")
        .otherwise(F.coalesce(F.nullif(F.element_at(F.split(low, r"\."), -1), F.lit("")), F.lit("unknown")))
    )


_NULLS = {c: "CAST(NULL AS VARCHAR)" for c in _OUT}
_row = lambda **c: "SELECT " + ", ".join(f"{(_NULLS | c)[n]} AS {n}" for n in _OUT) + " FROM er "
_PF = dict(artifact_type="'prefetch'", event_action="'process_executed'", severity="'info'", host="host", process_name="process_name", file_path="file_path", hash="hash", message="'Prefetch execution: ' || process_name || ' run_count=7'")
query("normalize_prefetch", _row(**_PF, event_time_utc="event_time_utc", time_kind="'prefetch_last_run'") + "WHERE artifact_type = 'prefetch' UNION ALL " + _row(**_PF, event_time_utc="'2024-01-01T00:00:00Z'", time_kind="'prefetch_previous_run'") + "WHERE artifact_type = 'prefetch' AND severity = 'high'")(
    lambda er: normalize_prefetch(er.where("artifact_type = 'prefetch'").select(F.col("file_path").alias("Full Path"), F.col("process_name").alias("Executable Name"), F.lit(" 7 ").alias("Run Count"), F.col("event_time_utc").alias("Last Run"),
        F.when(F.col("severity") == "high", "1704067200").otherwise("-").alias("Previous Run 0"), F.col("host").alias("Computer"), F.col("hash").alias("Hash")))
)
query("normalize_amcache", _row(artifact_type="'amcache'", event_time_utc="event_time_utc", event_action="'amcache_program_seen'", severity="'info'", user_name="nullif(nullif(user_name, ''), '-')", process_name="regexp_replace(file_path, '^.*/', '')", file_path="file_path", hash="hash",
      message="'Amcache program observed: ' || regexp_replace(file_path, '^.*/', '')") + "WHERE artifact_type = 'prefetch'")(
    lambda er: normalize_amcache(er.where("artifact_type = 'prefetch'").select(F.col("file_path").alias("File_Path"), F.col("event_time_utc").alias("Last Write"), F.col("hash").alias("SHA-1"), F.col("user_name").alias("User")))
)
_USN = {"usn_created": "FileCreate", "usn_deleted": "FileDelete|Close", "usn_renamed": "RenameNewName", "usn_modified": "DataExtend"}
query("normalize_usn", _row(artifact_type="'usn_jrnl'", event_time_utc="event_time_utc", event_action="event_action", severity="CASE WHEN event_action IN ('usn_deleted', 'usn_renamed') THEN 'medium' ELSE 'info' END", file_path="file_path",
      message="'USN ' || event_action || ': ' || file_path || ' reason=' || CASE event_action " + " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in _USN.items()) + " END") + "WHERE artifact_type = 'usn_jrnl'")(
    lambda er: normalize_usn(er.where("artifact_type = 'usn_jrnl'").select(F.col("file_path").alias("Name"), F.create_map(*[F.lit(x) for p in _USN.items() for x in p])[F.col("event_action")].alias("Reason"), F.col("event_time_utc").alias("Timestamp")))
)
query("normalize_browser", _row(artifact_type="'browser'", event_time_utc="event_time_utc", event_action="'browser_visit'", severity="'info'", url="url", file_path="regexp_replace(url, '^.*/', '')", message="'Browser visit: ' || url || ' title=' || host") + "WHERE artifact_type = 'browser'")(
    lambda er: normalize_browser(er.where("artifact_type = 'browser'").select(F.col("url").alias("URL"), F.col("host").alias("Title"), (F.unix_timestamp(F.try_to_timestamp("event_time_utc")) * 1000).alias("Visit Time")))
)
query("normalize_windows_event", _row(artifact_type="'evtx'", event_time_utc="event_time_utc", event_action="CASE event_code WHEN '4624' THEN 'logon_success' WHEN '4625' THEN 'logon_failure' WHEN '4688' THEN 'process_created' WHEN '1102' THEN 'audit_log_cleared' ELSE 'windows_event' END",
      severity="CASE event_code WHEN '1102' THEN 'critical' WHEN '4625' THEN 'high' ELSE 'info' END", host="host", message="message_full") + "WHERE artifact_type = 'evtx'")(
    lambda er: normalize_windows_event(er.where("artifact_type = 'evtx'").select(F.col("event_code").alias("EventId"), F.col("event_time_utc").alias("TimeCreated"), F.col("host").alias("Computer"), F.col("message_full").alias("Message")))
)


def _csv_round(at) -> DataFrame:
    spark, _ = at
    path = table_path(spark, "export") + ".csv"
    fixture.event_rows(*at).where("artifact_type = 'usn_jrnl'").select(F.col("file_path").alias("File Name"), F.lit('say "DataExtend", once').alias("Reason"), F.col("event_time_utc").alias("Time")).write.csv(path, header=True, escape='"')
    return ingest_structured(spark, path, "usn_jrnl").select("file_path", "event_time_utc", "event_action", "message")


query("ingest_structured_csv", "SELECT file_path, event_time_utc, 'usn_modified' AS event_action, 'USN usn_modified: ' || file_path || ' reason=say \"DataExtend\", once' AS message FROM er WHERE artifact_type = 'usn_jrnl'", over="session")(_csv_round)
query("ingest_text_log", "WITH l AS (SELECT 'doc_' || doc_id AS file_path, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT file_path, 'text_log' AS artifact_type, 'observed' AS event_action, CASE WHEN regexp_matches(lower(line), 'error|fail') THEN 'high' WHEN contains(lower(line), 'warn') THEN 'medium' ELSE 'info' END AS severity, line AS message FROM l WHERE line <> ''", over="documents")(
    lambda d: ingest_text_log(d.select(F.concat(F.lit("doc_"), "doc_id").alias("file_path"), F.explode(F.split("text", "\n")).alias("line")))
)
_PATHS = ["/x/A.PF", "/x/Amcache.hve", "/x/usn_1.csv", "/x/History.csv", "/x/$MFT", "/x/Security.evtx", "/x/app.log", "/x/data.bin"]
_TYPES = ["prefetch", "amcache", "usn_jrnl", "browser", "mft", "evtx", "text_log", "bin"]
query("detect_artifact_type", f"SELECT file_id, CASE WHEN size % 16 < 8 THEN [{', '.join(repr(t) for t in _TYPES)}][size % 8 + 1] ELSE ['prefetch', 'amcache', 'usn_jrnl', 'browser', 'mft', 'evtx', 'text_log', 'text_log'][size % 8 + 1] END AS detected FROM files", over="files")(
    lambda f: f.select("file_id", detect_artifact_type(
        F.when(F.col("size") % 16 < 8, F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("size") % 8 + 1).cast("int"))).otherwise("/x/y.txt"),
        F.when(F.col("size") % 16 >= 8, F.element_at(F.array(*map(F.lit, ["Executable Name,Run Count", "SHA1,Program Name", "USN,Reason,File Name", "URL,Visit Count", "EntryNumber,x", "Event ID,x", "a,b", ""])), (F.col("size") % 8 + 1).cast("int")))).alias("detected"))
)
