"""Tables as folders of parts: appended, replaced, scanned over parts of different columns, skipped where nothing changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timeloom.operators.integrity import SEGMENT, custody_counts, evidence_verify, ledger_breaks, ledger_root, seal, table_fingerprint
from timeloom.operators.triage import export_csv, export_jsonl
from timeloom.registry import query
from timeloom.sources import fixture
from timeloom.sources.storage import exists, table_path

VERSION = 5  # of the projection of event rows


def append_part(df: DataFrame, folder: str) -> None:
    """Appends parts; the committer makes them seen whole. An empty frame adds none."""
    if df.limit(1).count():
        df.write.mode("append").option("compression", "zstd").parquet(folder)


def replace_table(df: DataFrame, folder: str) -> None:
    """Replaces a table that df does not read."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def write_lake(df: DataFrame, folder: str, by: str = "artifact_type") -> None:
    """A table as one folder for each value of `by`, dealt by it and by the rows' hash, so that a frequent value is written by many tasks."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(by, spread).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)


def scan_table(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All parts of a folder by column names; columns that a part lacks are null, a missing folder is an empty table. Of a lake, filters on its folders' column list only their files."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def rebuild_skip_check(full: DataFrame, rows: DataFrame, findings: DataFrame, version: int) -> DataFrame:
    """One row: whether the event rows are up to date, with equal counts, no findings, no missing search text and the present version."""
    counts = full.agg(F.count("*").alias("full_rows")).crossJoin(rows.agg(F.count("*").alias("event_rows"), F.count_if(F.col("search_text").isNull()).alias("missing"))).crossJoin(findings.agg(F.count("*").alias("findings")))  # one row each
    return counts.withColumn("skip", F.expr(f"full_rows = event_rows AND missing = 0 AND findings = 0 AND {version} = {VERSION}"))


def _parts(at) -> tuple[DataFrame, str]:
    """Event rows in three parts, the second without search_text, and an append of nothing."""
    spark, _ = at
    er = fixture.event_rows(*at).select("event_id", "severity", "search_text")
    folder = table_path(spark, "parts")
    append_part(er.where("severity = 'high'"), folder)
    append_part(er.where("severity = 'low'").drop("search_text"), folder)
    append_part(er.where("severity = 'info'"), folder)
    append_part(er.limit(0), folder)
    return er, folder


def _scanned(at) -> DataFrame:
    er, folder = _parts(at)
    return scan_table(at[0], folder, er.schema)


def _lake(at) -> tuple[DataFrame, str]:
    """Event rows by artifact type, then the file table's rows written anew: only that folder is replaced."""
    er = fixture.event_rows(*at).select("event_id", "severity", "artifact_type")
    folder = table_path(at[0], "lake")
    write_lake(er, folder)
    write_lake(er.where("artifact_type = 'mft' AND severity <> 'info'").withColumn("severity", F.concat(F.lit("reviewed "), "severity")), folder)
    return er, folder


def _replaced(at) -> DataFrame:
    er, folder = _lake(at)
    return scan_table(at[0], folder, er.schema)


def _exported(at, write, read) -> DataFrame:
    er = fixture.event_rows(*at)
    path = table_path(at[0], "export")
    write(er, path)
    return read(path).select("event_id", "event_action", "message_short")


_P = "SELECT event_id, severity, CASE WHEN severity <> 'low' THEN search_text END AS search_text FROM er WHERE severity IN ('high', 'low', 'info')"
query("append_part", f"SELECT severity, count(*) AS n, count(search_text) AS with_text FROM ({_P}) GROUP BY 1", over="session")(lambda at: _scanned(at).groupBy("severity").agg(F.count("*").alias("n"), F.count("search_text").alias("with_text")))
query("scan_evolved", _P, over="session")(_scanned)
query("scan_table", "SELECT artifact_type, count(*) AS n, count(DISTINCT event_id) AS ids, CAST(0 AS BIGINT) AS missing FROM er WHERE artifact_type IN ('browser', 'usn_jrnl') GROUP BY 1", over="session")(
    lambda at: _replaced(at).where("artifact_type IN ('browser', 'usn_jrnl')").groupBy("artifact_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    .withColumn("missing", F.lit(scan_table(at[0], table_path(at[0], "none"), fixture.event_rows(*at).schema).count()).cast("long"))
)
query("replace_table", "SELECT event_id, artifact_type, CASE WHEN artifact_type = 'mft' THEN 'reviewed ' || severity ELSE severity END AS severity FROM er WHERE NOT (artifact_type = 'mft' AND severity = 'info')", over="session")(_replaced)
query("rebuild_skip_check", "SELECT (SELECT count(*) FROM ef) AS full_rows, (SELECT count(*) FROM er) AS event_rows, CAST(0 AS BIGINT) AS missing, (SELECT count(*) FROM er WHERE event_code = '1102') AS findings, (SELECT count(*) FROM er WHERE event_code = '1102') = 0 AS skip", over="session")(
    lambda at: rebuild_skip_check(fixture.events_full(*at), fixture.event_rows(*at), fixture.event_rows(*at).where("event_code = '1102'"), VERSION)
)
query("export_jsonl", "SELECT event_id, event_action, message_short FROM er", over="session")(lambda at: _exported(at, export_jsonl, at[0].read.json))
query("export_csv_file", "SELECT event_id, event_action, message_short FROM er", over="session")(lambda at: _exported(at, export_csv, lambda p: at[0].read.csv(p, header=True, escape='"')))


def _verified_names(at) -> DataFrame:
    """A ledger made from the rows (names of the written objects and what they should hold) against the objects' files."""
    spark = at[0]
    folder = table_path(spark, "objects")
    files = fixture.files(*at).select("file_id", "normalized_path").where("file_id LIKE '%7' OR file_id LIKE '%4'")
    files.where("file_id LIKE '%7'").select("normalized_path", F.concat("file_id", F.lit(".txt")).alias("name")).repartition(max(4, spark.sparkContext.defaultParallelism)).write.partitionBy("name").text(folder)
    content = F.concat(F.when(F.col("file_id").like("%17"), F.lit("other ")).otherwise(F.lit("")), "normalized_path", F.lit("\n"))
    ledger = files.select(F.concat(F.lit("name="), "file_id", F.lit(".txt")).alias("name"), F.sha2(content, 256).alias("sha256"))
    return evidence_verify(spark, folder, ledger, depth=-2)


query("evidence_verify", "SELECT 'name=' || file_id || '.txt' AS name, CASE WHEN file_id LIKE '%4' THEN 'missing' WHEN file_id LIKE '%17' THEN 'mismatch' ELSE 'ok' END AS status FROM files WHERE file_id LIKE '%7' OR file_id LIKE '%4'", over="session")(_verified_names)


def audit_log(er: DataFrame) -> DataFrame:
    """seq, digest: the events as entries of an audit log, numbered by their ids."""
    return er.select(F.substring("event_id", 3, 20).cast("long").alias("seq"), F.sha2(F.concat_ws("|", "event_id", "event_action", "severity"), 256).alias("digest"))


def _custody(at) -> DataFrame:
    """A ledger sealed over a log, then the log with one entry changed, one removed, two swapped and one added.

    All levels are sealed and verified; the root is that of two levels, as the SQL has it: beyond a million entries the smallest of several heads."""
    log = audit_log(fixture.event_rows(*at))
    ledger = seal(log)
    seq = F.col("seq")
    now = log.where(seq != 11).withColumn("digest", F.when(seq == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")))
    now = now.withColumn("seq", F.when(seq == 20, 21).when(seq == 21, 20).when(seq == 500, 1 << 40).otherwise(seq))
    counts = custody_counts(ledger, now)
    forged = ledger.withColumn("digest", F.when((F.col("level") == 0) & (seq == 33), F.sha2(F.lit("y"), 256)).otherwise(F.col("digest")))
    breaks = ledger_breaks(forged).agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "level", "seq")))).alias("forged_at"))  # one entry
    return counts.crossJoin(ledger_root(ledger, 2)).crossJoin(breaks).withColumn("breaks", F.lit(ledger_breaks(ledger).count()).cast("long"))


_FOLD = "list_reduce(list_concat([''], list(digest ORDER BY seq)), lambda a, b: sha256(a || b))"
query("custody_counts", f""", l0 AS (SELECT CAST(substr(event_id, 3) AS BIGINT) AS seq, sha256(concat_ws('|', event_id, event_action, severity)) AS digest FROM er),
 l1 AS (SELECT seq // {SEGMENT} AS seq, {_FOLD} AS digest FROM l0 GROUP BY 1), l2 AS (SELECT seq // {SEGMENT} AS seq, {_FOLD} AS digest FROM l1 GROUP BY 1),
 root AS (SELECT CASE WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT min(digest) FROM l1) ELSE (SELECT min(digest) FROM l2) END AS root),
 s(status, n) AS (SELECT 'ok', count(*) - 5 FROM l0 UNION ALL VALUES ('changed', 1), ('removed', 2), ('moved', 2), ('added', 1)) SELECT status, CAST(n AS BIGINT) AS n, root, '0:33' AS forged_at, CAST(0 AS BIGINT) AS breaks FROM s, root""", over="session")(_custody)


def _fingerprints(at) -> DataFrame:
    """The digest of a table read twice, read part by part, and read after an append."""
    er, folder = _parts(at)
    a, again = (table_fingerprint(at[0], folder).first()["fingerprint"] for _ in range(2))
    append_part(er.limit(5), folder)
    grown = table_fingerprint(at[0], folder).first()["fingerprint"]
    return er.agg(F.count("*").alias("rows")).select("rows", F.lit(a == again).alias("stays"), F.lit(a != grown).alias("changes_by_append"), F.lit(len(a)).alias("digits"))


query("table_fingerprint", "SELECT count(*) AS rows, true AS stays, true AS changes_by_append, CAST(64 AS INTEGER) AS digits FROM er", over="session")(_fingerprints)
