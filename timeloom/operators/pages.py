"""Sorted pages with keyset cursors, point lookups and exports. limit + 1 rows are asked for: TakeOrderedAndProject, no full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import severity_rank
from timeloom.registry import query

SORTS = {
    "time": "event_time_utc", "type": "artifact_type", "action": "event_action", "host": "host", "user": "user_name", "process": "process_name", "path": "file_path", "ip": "ip",
    "url": "url", "hash": "hash", "message": "message_short", "parser": "parser_name", "code": "event_code", "channel": "channel", "source": "source_file_id", "id": "event_id",
}


def bounded_limit(value: int | None, default: int, most: int) -> int:
    return min(max(default if value is None else value, 1), most)


def _sort_key(sort: str) -> Column:
    return severity_rank("severity") if sort == "severity" else F.coalesce(SORTS[sort], F.lit(""))


def event_page(er: DataFrame, sort: str = "time", descending: bool = False, limit: int | None = None, cursor: tuple | None = None, where: Column | None = None) -> DataFrame:
    """A page in (key, event_id) order, one row more than the limit to tell whether another follows. cursor: the last row's (key, id)."""
    key = _sort_key(sort)
    if where is not None:
        er = er.where(where)
    if cursor is not None:
        k, i = F.lit(cursor[0]), F.lit(cursor[1])
        er = er.where(((key < k) if descending else (key > k)) | ((key == k) & (F.col("event_id") > i)))
    return er.orderBy(key.desc() if descending else key.asc(), "event_id").limit(bounded_limit(limit, 100, 500) + 1)


def pages_by_ids(er: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    return event_page(er.join(ids.select("event_id").distinct(), "event_id", "left_semi"), limit=limit)


def file_page(files: DataFrame, limit: int = 100, cursor: tuple | None = None) -> DataFrame:
    if cursor is not None:
        p, i = F.lit(cursor[0]), F.lit(cursor[1])
        files = files.where((F.col("normalized_path") > p) | ((F.col("normalized_path") == p) & (F.col("file_id") > i)))
    return files.orderBy("normalized_path", "file_id").limit(limit + 1)


query("event_page", "SELECT event_id, event_time_utc, severity FROM er ORDER BY CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, event_id LIMIT 101")(
    lambda er: event_page(er, "severity", descending=True).select("event_id", "event_time_utc", "severity")
)
query("event_page_cursor", "SELECT event_id, host FROM er WHERE coalesce(host, '') > 'HOST2' OR (coalesce(host, '') = 'HOST2' AND event_id > 'ev00000500') ORDER BY coalesce(host, ''), event_id LIMIT 51")(
    lambda er: event_page(er, "host", limit=50, cursor=("HOST2", "ev00000500")).select("event_id", "host")
)
query("event_page_by_ids", "SELECT event_id, event_time_utc FROM er WHERE event_id IN (SELECT event_id FROM er WHERE hash IS NOT NULL) ORDER BY coalesce(event_time_utc, ''), event_id LIMIT 201")(
    lambda er: pages_by_ids(er, er.where("hash IS NOT NULL"), 200).select("event_id", "event_time_utc")
)
query("file_page", "SELECT file_id, normalized_path FROM files WHERE normalized_path > '/evidence/a' ORDER BY normalized_path, file_id LIMIT 101", over="files")(
    lambda f: file_page(f, cursor=("/evidence/a", "")).select("file_id", "normalized_path")
)
query("event_detail", "SELECT event_id, message_full, attributes_json, raw_record_ref FROM ef WHERE event_id = 'ev00000042'", over="ef")(
    lambda ef: ef.where(F.col("event_id") == "ev00000042").select("event_id", "message_full", "attributes_json", "raw_record_ref")
)
query("event_raw_record", "SELECT raw_record_ref, evidence_ref, source_file_id FROM ef WHERE raw_record_ref = 'raw_ev00000007'", over="ef")(
    lambda ef: ef.where(F.col("raw_record_ref") == "raw_ev00000007").select("raw_record_ref", "evidence_ref", "source_file_id")
)
query("analyzer_batch", "SELECT event_id, event_time_utc FROM ef WHERE event_time_utc > '2024-01-10T00:00:00Z' OR (event_time_utc = '2024-01-10T00:00:00Z' AND event_id > '') ORDER BY event_time_utc, event_id LIMIT 1000", over="ef")(
    lambda ef: ef.where("event_time_utc > '2024-01-10T00:00:00Z' OR (event_time_utc = '2024-01-10T00:00:00Z' AND event_id > '')").orderBy("event_time_utc", "event_id").limit(1000).select("event_id", "event_time_utc")
)
