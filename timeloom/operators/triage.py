"""Triage: funnel, queue, quality gates, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import severity_rank, timestamp
from timeloom.operators.aggregates import coverage
from timeloom.operators.correlation import CHAINS, correlation_chains
from timeloom.operators.findings import FINDINGS, finding_summary, sigma_eval
from timeloom.plans.read_models import with_finding_flag
from timeloom.registry import query
from timeloom.sources import fixture


def triage_funnel(er: DataFrame) -> DataFrame:
    """collected, detected, high: how many events come to each step; one row per step from one pass and one semi-join."""
    found = sigma_eval(er)
    parts = [("collected", 0, er.select("event_id")), ("detected", 1, found.select("event_id").distinct()), ("high", 2, found.where(severity_rank("severity") >= 4).select("event_id").distinct())]
    out = None
    for name, k, df in parts:
        row = df.agg(F.count("*").alias("events")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "events")
        out = row if out is None else out.unionByName(row)
    return out


def triage_queue(er: DataFrame, limit: int = 100) -> DataFrame:
    """Finding groups and chains with a priority, highest first."""
    groups = finding_summary(sigma_eval(er)).select(F.lit("finding").alias("kind"), F.col("rule_id").alias("key"), (severity_rank("severity") * 1000 + F.least("events", F.lit(500))).cast("long").alias("priority"))
    chains = correlation_chains(er).select(F.lit("chain").alias("kind"), F.concat_ws(":", "kind", "key").alias("key"), (severity_rank("max_severity") * 500 + F.col("score")).cast("long").alias("priority"))
    return groups.unionByName(chains).orderBy(F.desc("priority"), "kind", "key").limit(limit)


def triage_funnel_steps(er: DataFrame) -> DataFrame:
    """collected, detected (findings), triaged (finding groups), incident (groups of high or more), with the percentage of the step before."""
    groups = finding_summary(sigma_eval(er)).agg(
        F.coalesce(F.sum("findings"), F.lit(0)).alias("detected"), F.count("*").alias("triaged"), F.count_if(severity_rank("severity") >= 4).alias("incident"))
    counts = er.agg(F.count("*").alias("collected")).crossJoin(groups)
    steps = [F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.col(n).alias("n")) for k, n in enumerate(("collected", "detected", "triaged", "incident"))]
    before = F.lag("n").over(Window.orderBy("step"))  # four rows
    return counts.select(F.inline(F.array(*steps))).select("step", "name", "n", F.when(before > 0, F.round(F.col("n") * 100.0 / before, 6)).when(before.isNotNull(), 0.0).alias("percent"))


CLOSED = ["confirmed", "false_positive", "benign"]


def triage_actions(er: DataFrame, files: DataFrame, reviews: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    """Finding groups, chains of medium or more, parser failures and open reviews without a finding, highest priority first.

    reviews: rule_id, status, due_at, updated_at; the last one of a rule counts, and closed ones take its group out.
    """
    last = reviews.groupBy("rule_id").agg(F.max_by(F.struct("status", "due_at", "updated_at"), "updated_at").alias("r")).select("rule_id", "r.*")
    last = last.withColumn("late", F.coalesce(timestamp("due_at") < timestamp(F.lit(now)), F.lit(False)))
    groups = finding_summary(sigma_eval(er))
    late = F.when(F.col("late"), 700).otherwise(0)
    status = F.coalesce("status", F.lit("new"))
    row = lambda category, key, severity, state, priority, events, seen: [x.alias(n) for x, n in zip(
        (F.lit(category), key, severity, state, priority.cast("long"), events.cast("long"), seen), ("category", "key", "severity", "status", "priority", "events", "last_seen"), strict=True)]
    found = groups.join(last, "rule_id", "left").where(~status.isin(CLOSED)).select(
        row("finding", F.col("rule_id"), F.col("severity"), status, severity_rank("severity") * 1000 + F.least("events", F.lit(500)) + late + F.when(status == "needs_context", 250).otherwise(0), F.col("events"), F.col("last_seen")))
    chains = correlation_chains(er).where(severity_rank("max_severity") >= 3).select(
        row("correlation", F.concat_ws("=", "kind", "key"), F.col("max_severity"), F.lit("open"), severity_rank("max_severity") * 900 + F.least(F.greatest("score", F.lit(0)), F.lit(2000)) + F.least("events", F.lit(500)), F.col("events"), F.col("last_seen")))
    failed = coverage(files).where("failed > 0").select(
        row("parser_failure", F.col("artifact_type"), F.lit("medium"), F.lit("open"), 2000 + F.least(F.col("failed") * 25, F.lit(1000)), F.col("failed"), F.lit(None).cast("string")))
    orphans = last.where(~status.isin(CLOSED)).join(groups, "rule_id", "left_anti").select(
        row("review", F.col("rule_id"), F.when(F.col("late"), "high").otherwise("medium"), status, 2600 + late, F.lit(0), F.col("updated_at")))
    out = found.unionByName(chains).unionByName(failed).unionByName(orphans)
    out = out.orderBy(F.desc("priority"), severity_rank("severity").desc(), F.desc("events"), F.desc("last_seen"), "category", "key")
    return out if limit is None else out.limit(limit)


# fixed values: the columns of an export, in order
EXPORTED = [
    "event_time_utc", "event_id", "artifact_type", "severity", "event_action", "host", "user_name", "process_name", "file_path", "ip", "url", "hash", "event_code", "channel", "level",
    "source_file_id", "parser_name", "has_finding", "message_short",
]


def export_rows(er: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows of an export in time order. With a limit, the first of them, and `truncated` tells whether more would follow."""
    absent = {c: F.lit(None).cast("string") for c in EXPORTED} | {"has_finding": F.lit(False)}  # columns that rows lack are empty
    rows = er.orderBy("event_time_utc", "event_id").select(*[F.col(c) if c in er.columns else absent[c].alias(c) for c in EXPORTED])
    if limit is None:
        return rows
    more = er.select("event_id").limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return rows.limit(limit).crossJoin(F.broadcast(more)).orderBy("event_time_utc", "event_id")


def export_csv(er: DataFrame, path: str, limit: int | None = None) -> None:
    export_rows(er, limit).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def export_jsonl(er: DataFrame, path: str, limit: int | None = None) -> None:
    export_rows(er, limit).write.mode("overwrite").json(path)


query("triage_events", FINDINGS + " SELECT 0 AS step, 'collected' AS name, count(*) AS events FROM er UNION ALL SELECT 1, 'detected', count(DISTINCT event_id) FROM findings UNION ALL SELECT 2, 'high', count(DISTINCT event_id) FROM findings WHERE severity IN ('high', 'critical')")(triage_funnel)
_R = "CASE {} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
query("triage_priorities", FINDINGS + CHAINS + f""", q AS (SELECT 'finding' AS kind, rule_id AS key, CAST(1000 * max({_R.format('severity')}) + least(count(DISTINCT event_id), 500) AS BIGINT) AS priority FROM findings GROUP BY rule_id
 UNION ALL SELECT 'chain', kind || ':' || key, CAST(500 * {_R.format('max_severity')} + score AS BIGINT) FROM chains) SELECT * FROM q ORDER BY priority DESC, kind, key LIMIT 100""")(triage_queue)
for _n in ("triage_funnel", "triage_funnel_steps"):
    query(_n, FINDINGS + """, g AS (SELECT rule_id, count(*) AS f, max(CASE WHEN severity IN ('critical', 'high') THEN 1 ELSE 0 END) AS h FROM findings GROUP BY 1),
 s AS (SELECT 0 AS step, 'collected' AS name, count(*) AS n FROM er UNION ALL SELECT 1, 'detected', CAST(coalesce(sum(f), 0) AS BIGINT) FROM g UNION ALL SELECT 2, 'triaged', count(*) FROM g UNION ALL SELECT 3, 'incident', count(*) FILTER (h = 1) FROM g),
 p AS (SELECT *, lag(n) OVER (ORDER BY step) AS b FROM s) SELECT step, name, n, CASE WHEN b > 0 THEN round(100.0 * n / b, 6) WHEN b IS NOT NULL THEN 0 END AS percent FROM p""")(triage_funnel_steps)
_REVIEWS = [("kerberoast", "needs_context", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("service_installed", "benign", None, "2024-01-01T00:00:00Z"), ("retired_rule", "new", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("other_rule", "confirmed", None, "2024-01-01T00:00:00Z")]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _REVIEWS)
for _n in ("triage_queue", "triage_actions"):
    query(_n, FINDINGS + CHAINS + f""", rv(rule_id, status, due_at, updated_at) AS (VALUES {_VALUES}), v AS (SELECT *, coalesce(due_at < '2024-02-01T00:00:00Z', false) AS late FROM rv),
 g AS (SELECT rule_id, max({_R.format('severity')}) AS r, min(severity) AS severity, count(DISTINCT event_id) AS events, max(event_time_utc) AS last_seen FROM findings GROUP BY 1),
 p AS (SELECT artifact_type, count(*) AS failed FROM files WHERE parser_status = 'failed' GROUP BY 1)
 SELECT 'finding' AS category, g.rule_id AS key, severity, coalesce(status, 'new') AS status, CAST(r * 1000 + least(events, 500) + CASE WHEN late THEN 700 ELSE 0 END + CASE WHEN status = 'needs_context' THEN 250 ELSE 0 END AS BIGINT) AS priority, events, last_seen
 FROM g LEFT JOIN v USING (rule_id) WHERE coalesce(status, 'new') NOT IN ('confirmed', 'false_positive', 'benign')
 UNION ALL SELECT 'correlation', kind || '=' || key, max_severity, 'open', CAST({_R.format('max_severity')} * 900 + least(greatest(score, 0), 2000) + least(events, 500) AS BIGINT), events, last_seen FROM chains WHERE {_R.format('max_severity')} >= 3
 UNION ALL SELECT 'parser_failure', artifact_type, 'medium', 'open', 2000 + least(failed * 25, 1000), failed, NULL FROM p
 UNION ALL SELECT 'review', rule_id, CASE WHEN late THEN 'high' ELSE 'medium' END, status, 2600 + CASE WHEN late THEN 700 ELSE 0 END, 0, updated_at FROM v
 WHERE status NOT IN ('confirmed', 'false_positive', 'benign') AND rule_id NOT IN (SELECT rule_id FROM g)""", over="session")(
    lambda at: triage_actions(fixture.event_rows(*at), fixture.files(*at), at[0].createDataFrame(_REVIEWS, "rule_id string, status string, due_at string, updated_at string"), "2024-02-01T00:00:00Z")
)
query("export_csv", FINDINGS + " SELECT " + ", ".join({"level": "CAST(NULL AS VARCHAR) AS level", "has_finding": "event_id IN (SELECT event_id FROM findings) AS has_finding"}.get(c, c) for c in EXPORTED) + " FROM er")(
    lambda er: export_rows(with_finding_flag(er, sigma_eval(er)))
)
