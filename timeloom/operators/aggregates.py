"""Aggregations: one groupBy each, partially aggregated before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import RANKS, filled, rank_name, severity_max, severity_rank, timestamp, truncate_bin
from timeloom.registry import query
from timeloom.sources import fixture

RANK_SQL = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


def name_sql(rank: str) -> str:
    return f"CASE {rank} WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' END"


MAX_SQL = name_sql(f"max({RANK_SQL})")


def joined(c: str) -> Column:
    """The distinct values in order, as one text; a few artifact types at most."""
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def type_bits(rows: DataFrame) -> tuple[list[Column], Column, Column]:
    """Aggregates of longs whose bits are the artifact types of a group, and behind them how many and which, as `joined` has them.

    The types are read first, a value each: sets of them are aggregated by hash, as strings and lists are not.
    """
    known = sorted((r[0] for r in rows.select("artifact_type").where("artifact_type IS NOT NULL").distinct().collect()), key=str.encode)
    parts = [known[k : k + 63] for k in range(0, len(known), 63)] or [[]]
    bit = lambda part: F.coalesce(*[F.when(F.col("artifact_type") == t, F.lit(1 << k).cast("long")) for k, t in enumerate(part)], F.lit(0).cast("long"))
    bits = [F.bit_or(bit(part)).alias(f"types{k}") for k, part in enumerate(parts)]
    count = sum((F.bit_count(f"types{k}") for k in range(len(parts))), F.lit(0)).cast("long")
    names = [F.when(F.col(f"types{k}").bitwiseAND(F.lit(1 << j).cast("long")) != 0, F.lit(t)) for k, part in enumerate(parts) for j, t in enumerate(part)]
    return bits, count, F.concat_ws(",", *names)


def coverage(files: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("parser_status") == s)
    return files.groupBy("artifact_type").agg(
        F.count("*").alias("files"), is_("parsed").alias("parsed"), is_("failed").alias("failed"), is_("unsupported").alias("unsupported"), F.sum("event_count").alias("events")
    )


def coverage_rates(files: DataFrame) -> DataFrame:
    return coverage(files).select("artifact_type", F.round(F.try_divide(F.col("parsed") * 100.0, F.col("files")), 6).alias("parsed_percent"))


#: supported types of artifact; a matrix has a column for each, and one for all others
ARTIFACT_TYPES = [
    "amcache", "browser", "defender", "ese_database", "evtx", "hayabusa", "jump_list", "lnk", "mft", "pcap", "prefetch", "recovery", "recycle_bin", "registry_hive", "scheduled_task", "srum", "usn_jrnl", "wmi",
]


def coverage_matrix(er: DataFrame) -> DataFrame:
    """host x type of artifact: counts, 0 where there is nothing; `other` has the types that the list doesn't name."""
    kind = F.when(F.col("artifact_type").isin(ARTIFACT_TYPES), F.col("artifact_type")).otherwise("other")
    return er.groupBy("host").agg(*[F.count_if(kind == t).alias(t) for t in (*ARTIFACT_TYPES, "other")])


def failed_parsers(runs: DataFrame) -> DataFrame:
    """parser_name, artifact_type, failures, the last error and its time, of runs (parser_name, artifact_type, error, finished_at)."""
    last = F.max(F.struct("finished_at", "error")).alias("last")
    return runs.where("error IS NOT NULL").groupBy("parser_name", "artifact_type").agg(F.count("*").alias("failures"), last).select(
        "parser_name", "artifact_type", "failures", F.col("last.error").alias("last_error"), F.col("last.finished_at").alias("last_seen"))


def coverage_summary(parts: DataFrame) -> DataFrame:
    """Coverage rows of several parts summed by case and type, the most files first."""
    sums = [F.sum(c).alias(c) for c in ("files", "parsed", "failed", "unsupported", "events")]
    return parts.groupBy("case_id", "artifact_type").agg(*sums).orderBy(F.desc("files"), "case_id", "artifact_type")


def failed_parser_summary(parts: DataFrame) -> DataFrame:
    """Failures of several parts summed by parser and type, with the greatest error and last time, the most failures first."""
    return parts.groupBy("parser_name", "artifact_type").agg(F.sum("failures").alias("failures"), F.max("last_error").alias("last_error"), F.max("last_seen").alias("last_seen")).orderBy(
        F.desc("failures"), "parser_name", "artifact_type")


def timeline_bins(er: DataFrame) -> DataFrame:
    """The read model: hour and type."""
    return er.groupBy(truncate_bin("event_time_utc", "hour").alias("bin"), "artifact_type").agg(F.count("*").alias("events"), severity_max("severity").alias("max_severity"))


def event_timeline(er: DataFrame, unit: str = "hour", newest: int | None = None) -> DataFrame:
    """All bins in time order, or the newest of them, with a count per severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in RANKS]
    bins = er.groupBy(truncate_bin("event_time_utc", unit).alias("bin")).agg(F.count("*").alias("total"), *counts)
    return (bins if newest is None else bins.orderBy(F.desc("bin")).limit(newest)).orderBy("bin")


def timeline_columns(bins: DataFrame, most: int = 200) -> DataFrame:
    """Consecutive bins merged to at most `most` columns. Bins are numbered within their month, and only the months in one window."""
    month = F.coalesce(F.substring("bin", 1, 7), F.lit("")).alias("month")
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    months = bins.groupBy(month).agg(F.count("*").alias("c")).select("month", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n"))
    row = bins.select("bin", "total", month).withColumn("k", F.row_number().over(Window.partitionBy("month").orderBy("bin")))
    return row.join(months, "month").withColumn("k", F.col("k") + F.col("before")).groupBy(F.expr(f"(k - 1) div ceil(n / {most})").alias("column")).agg(F.min("bin").alias("start"), F.max("bin").alias("end"), F.sum("total").alias("events"))


FACETS = ["artifact_type", "event_action", "severity", "host", "user_name", "process_name", "ip", "parser_name", "source_file_id"]


def facets(er: DataFrame, k: int = 8, fields: list[str] = FACETS) -> DataFrame:
    """The k most frequent values of each field, nulls as `-`: one scan and one shuffle for all fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("-")).alias("value")) for f in fields])).alias("p")
    counts = er.select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")


def user_activity(er: DataFrame) -> DataFrame:
    return er.where(filled("user_name").isNotNull()).groupBy("user_name").agg(
        F.count("*").alias("events"), F.countDistinct("host").alias("hosts"), joined("artifact_type").alias("types"), F.min("event_time_utc").alias("first_seen"),
        F.max("event_time_utc").alias("last_seen"), severity_max("severity").alias("max_severity"))


def action_summary(er: DataFrame) -> DataFrame:
    return er.groupBy("event_action").agg(
        F.count("*").alias("events"), F.max("event_time_utc").alias("last_seen"), severity_max("severity").alias("max_severity"), joined("artifact_type").alias("types"), F.min("channel").alias("channel"))


def prefetch_summary(er: DataFrame) -> DataFrame:
    runs = F.regexp_extract("attributes_json", r'"run_count":(\d+)', 1).try_cast("bigint")
    return er.where("artifact_type = 'prefetch'").groupBy("process_name").agg(
        F.max(runs).alias("run_count"), F.countDistinct("source_file_id").alias("sources"), F.countDistinct("event_action").alias("actions"), F.max("event_time_utc").alias("last_run"))


def file_op_timeline(er: DataFrame, newest: int | None = None) -> DataFrame:
    """Hours with their file operations, the last first; all of them, or the newest."""
    ops = ["usn_created", "usn_deleted", "usn_renamed", "usn_modified"]
    counts = [F.count_if(F.col("event_action") == o).alias(o) for o in ops]
    out = er.where(F.col("event_action").isin(ops)).groupBy(truncate_bin("event_time_utc", "hour").alias("bin")).agg(*counts).orderBy(F.desc("bin"))
    return out if newest is None else out.limit(newest)


_g = query
_g("case_totals", "SELECT (SELECT count(*) FROM er) AS events, (SELECT count(DISTINCT source_file_id) FROM er) AS sources, (SELECT count(DISTINCT host) FROM er) AS hosts, (SELECT count(*) FROM er WHERE severity IN ('critical', 'high')) AS high")(
    lambda er: er.agg(F.count("*").alias("events"), F.countDistinct("source_file_id").alias("sources"), F.countDistinct("host").alias("hosts"), F.count_if(F.col("severity").isin("critical", "high")).alias("high"))
)
_g("coverage_build", "SELECT artifact_type, count(*) AS files, count(*) FILTER (parser_status = 'parsed') AS parsed, count(*) FILTER (parser_status = 'failed') AS failed, count(*) FILTER (parser_status = 'unsupported') AS unsupported, CAST(sum(event_count) AS BIGINT) AS events FROM files GROUP BY 1", over="files")(coverage)
_g("coverage_rates", "SELECT artifact_type, round(100.0 * count(*) FILTER (parser_status = 'parsed') / CAST(count(*) AS DOUBLE), 6) AS parsed_percent FROM files GROUP BY 1", over="files")(coverage_rates)
_COUNTS = "count(*) AS files, " + ", ".join(f"count(*) FILTER (parser_status = '{p}') AS {p}" for p in ("parsed", "failed", "unsupported")) + ", CAST(sum(event_count) AS BIGINT) AS events"
#: files in three parts of two cases; runs with the parser of their type and a time from the file's number, for Spark and the oracle
_CASED = "SELECT *, CASE WHEN size % 3 = 0 THEN 'case_b' ELSE 'case_a' END AS case_id FROM files"
_RUNS = "SELECT concat('parser_', artifact_type, CASE WHEN size % 2 = 0 THEN '_v2' ELSE '' END) AS parser_name, artifact_type, error, concat('2024-01-', lpad(cast(size % 28 + 1 AS {str}), 2, '0'), 'T', file_id) AS finished_at, size FROM files"


def _cased(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql(_CASED.replace("files", "{files}"), files=f)


def _runs(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql(_RUNS.replace("files", "{files}").replace("{str}", "STRING"), files=f)


def _in_parts(rows: DataFrame, build, n: int = 3) -> DataFrame:
    return reduce(DataFrame.unionByName, [build(rows.where(f"size % 7 % {n} = {k}")) for k in range(n)])


_g("coverage_summary", f"SELECT case_id, artifact_type, {_COUNTS} FROM ({_CASED}) GROUP BY 1, 2", over="files")(
    lambda f: coverage_summary(_in_parts(_cased(f), lambda p: reduce(DataFrame.unionByName, [coverage(p.where(F.col("case_id") == c)).withColumn("case_id", F.lit(c)) for c in ("case_a", "case_b")])))
)
_DUCK_RUNS = _RUNS.format(str="VARCHAR")
_g("failed_parser_build", f"SELECT parser_name, artifact_type, count(*) AS failures, arg_max(error, (finished_at, error)) AS last_error, max(finished_at) AS last_seen FROM ({_DUCK_RUNS}) WHERE error IS NOT NULL GROUP BY 1, 2", over="files")(
    lambda f: failed_parsers(_runs(f))
)
_g("failed_parser_summary", f"""SELECT parser_name, artifact_type, CAST(sum(n) AS BIGINT) AS failures, max(e) AS last_error, max(t) AS last_seen FROM (
 SELECT parser_name, artifact_type, size % 7 % 3 AS part, count(*) AS n, arg_max(error, (finished_at, error)) AS e, max(finished_at) AS t FROM ({_DUCK_RUNS}) WHERE error IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""", over="files")(
    lambda f: failed_parser_summary(_in_parts(_runs(f), failed_parsers))
)
_KNOWN = ", ".join(f"'{t}'" for t in ARTIFACT_TYPES)
_g("coverage_matrix", "SELECT host, " + ", ".join(f"count(*) FILTER (artifact_type = '{t}') AS {t}" for t in ARTIFACT_TYPES) + f", count(*) FILTER (artifact_type NOT IN ({_KNOWN})) AS other FROM er GROUP BY host")(coverage_matrix)
_g("timeline_bins_build", f"SELECT substr(event_time_utc, 1, 13) || ':00:00Z' AS bin, artifact_type, count(*) AS events, {MAX_SQL} AS max_severity FROM er GROUP BY 1, 2")(timeline_bins)
_g("timeline_bins", f"SELECT substr(event_time_utc, 1, 10) || 'T00:00:00Z' AS bin, artifact_type, count(*) AS events, {MAX_SQL} AS max_severity FROM er GROUP BY 1, 2")(
    lambda er: timeline_bins(er).groupBy(truncate_bin("bin", "day").alias("bin"), "artifact_type").agg(F.sum("events").alias("events"), severity_max("max_severity").alias("max_severity"))
)
_TL = "SELECT substr(event_time_utc, 1, 13) || ':00:00Z' AS bin, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in RANKS) + " FROM er GROUP BY 1"
_g("event_timeline", _TL)(event_timeline)
_g("truncate_bin", "SELECT DISTINCT substr(event_time_utc, 1, 16) || ':00Z' AS minute, substr(event_time_utc, 1, 10) || 'T00:00:00Z' AS day FROM er")(
    lambda er: er.select(truncate_bin("event_time_utc", "minute").alias("minute"), truncate_bin("event_time_utc", "day").alias("day")).distinct()
)
_g("week_bin", "SELECT strftime(date_trunc('week', CAST(event_time_utc AS TIMESTAMP)), '%Y-%m-%d') AS week, count(*) AS events FROM er GROUP BY 1")(
    lambda er: er.groupBy(F.date_format(F.date_trunc("week", timestamp("event_time_utc")), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("events"))
)
_g("timeline_columns", f", b AS ({_TL}), r AS (SELECT *, row_number() OVER (ORDER BY bin) AS k, count(*) OVER () AS n FROM b) SELECT CAST((k - 1) // CAST(ceil(n / 200.0) AS BIGINT) AS BIGINT) AS \"column\", min(bin) AS start, max(bin) AS \"end\", CAST(sum(total) AS BIGINT) AS events FROM r GROUP BY 1")(
    lambda er: timeline_columns(event_timeline(er))
)
_g("overview_timeline", f"SELECT substr(event_time_utc, 1, 13) || ':00:00Z' AS bin, count(*) AS events, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS types, {MAX_SQL} AS max_severity FROM er GROUP BY 1")(
    lambda er: timeline_bins(er).groupBy("bin").agg(F.sum("events").alias("events"), joined("artifact_type").alias("types"), severity_max("max_severity").alias("max_severity"))
)
_g("dow_hour_heatmap", "SELECT CAST(dayofweek(CAST(event_time_utc AS TIMESTAMP)) AS INTEGER) AS dow, CAST(hour(CAST(event_time_utc AS TIMESTAMP)) AS INTEGER) AS hour, count(*) AS events FROM er GROUP BY 1, 2")(
    lambda er: er.groupBy((F.dayofweek(timestamp("event_time_utc")) - 1).alias("dow"), F.hour(timestamp("event_time_utc")).alias("hour")).agg(F.count("*").alias("events"))
)
_FS = " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, '-') AS value FROM er" for f in FACETS)
_g("event_facets", f", f AS ({_FS}), c AS (SELECT field, value, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS k FROM c) SELECT field, value, n FROM r WHERE k <= 8")(facets)


def artifact_options(coverage_rows: DataFrame, er: DataFrame) -> DataFrame:
    """artifact_type, n: each type with the larger of its files in the coverage and its events, blank ones left out, the most first."""
    both = coverage_rows.select("artifact_type", F.col("files").alias("n")).unionByName(er.groupBy("artifact_type").agg(F.count("*").alias("n")))
    return both.where(filled("artifact_type").isNotNull()).groupBy("artifact_type").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "artifact_type")


_g("artifact_options", """, c AS (SELECT CASE source WHEN 'web' THEN 'browser' WHEN 'books' THEN 'mft' ELSE source END AS artifact_type, count(*) AS n FROM documents GROUP BY 1),
 b AS (SELECT * FROM c UNION ALL SELECT artifact_type, count(*) FROM er GROUP BY 1) SELECT artifact_type, max(n) AS n FROM b WHERE artifact_type NOT IN ('', '-') GROUP BY 1""", over="session")(
    lambda at: artifact_options(coverage(fixture.files(*at).replace({"web": "browser", "books": "mft"}, subset=["artifact_type"])), fixture.event_rows(*at))
)
_g("login_outcomes", "SELECT count(*) FILTER (event_code = '4624') AS success, count(*) FILTER (event_code = '4625') AS failure FROM er")(lambda er: er.agg(F.count_if(F.col("event_code") == "4624").alias("success"), F.count_if(F.col("event_code") == "4625").alias("failure")))
_g("artifact_stats", "SELECT artifact_type, count(*) AS events, count(*) FILTER (severity IN ('critical', 'high')) AS high, count(DISTINCT host) AS hosts, count(DISTINCT user_name) FILTER (user_name NOT IN ('', '-')) AS users FROM er GROUP BY 1")(
    lambda er: er.groupBy("artifact_type").agg(F.count("*").alias("events"), F.count_if(F.col("severity").isin("critical", "high")).alias("high"), F.countDistinct("host").alias("hosts"), F.countDistinct(filled("user_name")).alias("users"))
)
_UA = f"SELECT user_name, count(*) AS events, count(DISTINCT host) AS hosts, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS types, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen, {MAX_SQL} AS max_severity FROM er WHERE user_name NOT IN ('', '-') GROUP BY 1"
_g("user_activity", _UA)(user_activity)
_g("user_activity_sorted", _UA)(lambda er: user_activity(er).orderBy(severity_rank("max_severity").desc(), F.desc("events"), "user_name"))
_g("prefetch_summary", "SELECT process_name, max(try_cast(regexp_extract(attributes_json, '\"run_count\":(\\d+)', 1) AS BIGINT)) AS run_count, count(DISTINCT source_file_id) AS sources, count(DISTINCT event_action) AS actions, max(event_time_utc) AS last_run FROM er WHERE artifact_type = 'prefetch' GROUP BY 1")(prefetch_summary)
_g("file_op_timeline", "SELECT substr(event_time_utc, 1, 13) || ':00:00Z' AS bin, " + ", ".join(f"count(*) FILTER (event_action = '{o}') AS {o}" for o in ("usn_created", "usn_deleted", "usn_renamed", "usn_modified")) + " FROM er WHERE event_action IN ('usn_created', 'usn_deleted', 'usn_renamed', 'usn_modified') GROUP BY 1")(file_op_timeline)
_g("severity_rank", f"SELECT severity, {RANK_SQL} AS rank, count(*) AS n FROM er GROUP BY 1, 2")(lambda er: er.groupBy("severity", severity_rank("severity").alias("rank")).agg(F.count("*").alias("n")))
_g("severity_max", f"SELECT host, {MAX_SQL} AS max_severity FROM er GROUP BY 1")(lambda er: er.groupBy("host").agg(rank_name(F.max(severity_rank("severity"))).alias("max_severity")))
