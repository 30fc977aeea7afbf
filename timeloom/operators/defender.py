"""The Defender log: summary by action, names of its events, classes of its actions, pages and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import severity_rank
from timeloom.operators.aggregates import MAX_SQL, action_summary
from timeloom.operators.filters import defender
from timeloom.registry import query

# fixed values: names of the log's event codes
NAMES = {
    "1000": "Scan started", "1001": "Scan completed", "1002": "Scan cancelled", "1006": "Malware detected", "1007": "Malware remediation executed", "1008": "Remediation failed", "1009": "Restored from quarantine",
    "1011": "Quarantine item deleted", "1015": "Suspicious behavior detected", "1116": "Malware detected", "1117": "Malware remediation executed", "1118": "Remediation failed", "1119": "Critical remediation error",
    "2000": "Definition update succeeded", "2001": "Definition update failed", "2002": "Engine updated", "2003": "Definition rollback", "2010": "Dynamic signature obtained", "2011": "Dynamic signature removed",
    "5001": "Real-time protection disabled", "5004": "Protection config changed", "5007": "Setting changed", "5010": "Antispyware disabled", "5012": "Antivirus disabled", "5100": "Protection expired",
    "5101": "Protection disabled", "101": "Health report (WHC)",
}
#: classes of actions, the first that fits
CLASSES = [
    ("malware", "malware|threat|detect|quarantine"), ("config", "config|tamper|disable|setting|protect"), ("scan", "scan"), ("update", "signature|definition|update|engine"), ("log", "mplog|log"), ("task", "task|schedule"),
]


def event_name(code: Column, action: Column) -> Column:
    """The code's name, else the action's words, else the code."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    words = F.array_join(F.filter(F.split(action, "_"), lambda w: w != ""), " ")
    return F.coalesce(names[code], F.nullif(words, F.lit("")), code, F.lit("-"))


def category_class(action: Column) -> Column:
    low = F.lower(F.coalesce(action, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in CLASSES], F.lit("other"))


def defender_summary(er: DataFrame, limit: int | None = None) -> DataFrame:
    out = action_summary(er.where(defender())).orderBy(severity_rank("max_severity").desc(), F.desc("events"), F.desc("last_seen"), "event_action")
    return out if limit is None else out.limit(limit)


def defender_event_page(er: DataFrame, category: str | None = None, limit: int = 100) -> DataFrame:
    rows = er.where(defender())
    rows = rows if not category else rows.where(F.col("event_action") == category)
    return rows.orderBy("event_time_utc", "event_id").limit(limit + 1)


def defender_sources(summary: DataFrame) -> DataFrame:
    return summary.select(F.explode(F.split("types", ",")).alias("artifact_type")).where("artifact_type <> ''").distinct()


_IS = "(contains(lower(concat_ws('|', artifact_type, channel, event_action, parser_name)), 'defender') OR contains(lower(message_short), 'windows defender') OR contains(lower(message_short), 'malware'))"
_SUM = f"SELECT event_action, count(*) AS events, max(event_time_utc) AS last_seen, {MAX_SQL} AS max_severity, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS types, min(channel) AS channel FROM er WHERE {_IS} GROUP BY 1"
for _n in ("defender_summary", "defender_event_summary"):
    query(_n, _SUM)(defender_summary)
query("defender_event_page", f"SELECT event_id FROM er WHERE {_IS} AND event_action = 'defender_threat_detected' ORDER BY event_time_utc, event_id LIMIT 101")(lambda er: defender_event_page(er, "defender_threat_detected").select("event_id"))
query("defender_sources", f"SELECT DISTINCT artifact_type FROM er WHERE {_IS}")(lambda er: defender_sources(defender_summary(er)))
query("defender_event_name", "SELECT event_id, coalesce(CASE event_code " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in NAMES.items()) + " END, replace(event_action, '_', ' ')) AS name FROM er")(lambda er: er.select("event_id", event_name(F.col("event_code"), F.col("event_action")).alias("name")))
query("defender_category_class", "SELECT CASE " + " ".join(f"WHEN regexp_matches(event_action, '{p}') THEN '{n}'" for n, p in CLASSES) + " ELSE 'other' END AS class, count(*) AS events FROM er GROUP BY 1")(lambda er: er.groupBy(category_class(F.col("event_action")).alias("class")).agg(F.count("*").alias("events")))
