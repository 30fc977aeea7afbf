"""Read models: each is one DataFrame -> DataFrame function over the evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import sanitize_account, sanitize_account_in_message
from timeloom.sources.storage import clustered, stored

#: columns that event rows take over from the full events
PLAIN = [
    "event_id", "case_id", "event_time_utc", "artifact_type", "event_action", "severity", "host", "user_name", "process_name", "file_path", "ip", "url", "hash",
    "message_short", "source_file_id", "parser_name", "evidence_ref",
]
#: attributes of the event rows: name -> key of the JSON object, string values of compact JSON only
ATTRIBUTES = {
    "event_code": "event_id", "channel": "channel", "command_line": "command_line", "process_id": "process_id", "process_guid": "process_guid",
    "parent_process_guid": "parent_process_guid", "parent_process": "parent_process",
}
#: columns of the search text, in order
SEARCHED = [
    "event_id", "event_time_utc", "artifact_type", "event_action", "severity", "host", "user_name", "process_name", "file_path", "ip", "url", "hash", "message_short",
    "parser_name",
]


def json_text(column: str, key: str) -> Column:
    """A string value of a compact JSON object; absent or empty: null. The pattern is only tried where its key is."""
    head = f'"{key}":"'
    return F.when(F.contains(F.col(column), F.lit(head)), F.nullif(F.regexp_extract(column, head + '([^"]*)"', 1), F.lit("")))


def typed_attributes() -> list[Column]:
    return [json_text("attributes_json", key).alias(name) for name, key in ATTRIBUTES.items()]


def search_text() -> Column:
    """The whole message and attributes, so no hit lies past a cut."""
    return F.lower(F.concat_ws(" ", *SEARCHED, "message_full", "attributes_json"))


def compact_rows(ef: DataFrame) -> DataFrame:
    """Event rows: typed attributes taken out of the JSON, one lower-cased search text. Narrow, so no shuffle."""
    return ef.select(
        *PLAIN, *typed_attributes(), search_text().alias("search_text"), "attributes_json", "message_full"
    )


def with_finding_flag(er: DataFrame, finding_events: DataFrame) -> DataFrame:
    """has_finding: whether the event's id is among finding_events (event_id)."""
    hit = finding_events.select("event_id").distinct().withColumn("has_finding", F.lit(True))
    return er.join(hit, "event_id", "left").withColumn("has_finding", F.coalesce("has_finding", F.lit(False)))


def rebuild_event_rows(ef: DataFrame, finding_events: DataFrame) -> DataFrame:
    """The stored read model: compact rows with cleaned accounts and messages and the finding flag, clustered by time and id in the shared folder.

    finding_events (event_id) are the events of findings. Full texts stay in the full table; the search text has them.
    """
    rows = compact_rows(ef).drop("attributes_json", "message_full")
    rows = rows.withColumn("user_name", sanitize_account("user_name")).withColumn("message_short", sanitize_account_in_message("message_short"))
    return stored(clustered(with_finding_flag(rows, finding_events), ["event_time_utc", "event_id"]), "event-rows", ("event_id", "ip", "hash"))


def legacy_text() -> Column:
    """The search text of rows of parts that were written without one: their columns alone."""
    return F.coalesce("search_text", F.lower(F.concat_ws(" ", *SEARCHED)))
