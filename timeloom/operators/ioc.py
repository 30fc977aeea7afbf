"""Indicator matching and joins around an anchor event."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import basename, filled, timestamp
from timeloom.registry import query

KINDS = {"hash": "hash", "ip": "ip", "process": "process_name"}
BLOCK_BYTES = 8 << 20  # of the indicators that one automaton holds; longer lists are searched block by block


def _blocks(values: list[str]) -> list[list[str]]:
    out, size = [[]], 0
    for v in values:
        if out[-1] and size + len(v) > BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append(v)
        size += len(v)
    return [b for b in out if b]


def _texts_with(er: DataFrame, values: list[str], keep: list[str]) -> DataFrame:
    """Rows of er whose search text holds one of the values: an Aho-Corasick automaton built once a task reads each text once, however many values there are."""
    shared = er.sparkSession.sparkContext.broadcast(values)

    def search(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for v in shared.value:
            automaton.add_word(v, v)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("search_text").to_pylist()):
                hits = sorted({v for _, v in automaton.iter(text)}) if text else []
                rows += [k] * len(hits)
                found += hits
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(picked.column(c) for c in ("event_id", *keep))], ["ioc", "event_id", *keep])

    source = er.select("event_id", *keep, "search_text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in er.select("event_id", *keep).schema)
    return source.mapInArrow(search, f"ioc string, {kinds}")


def ioc_match(er: DataFrame, iocs: list[str], keep: list[str] | None = None) -> DataFrame:
    """ioc, kind, event_id, then the columns `keep` of er.

    Indicators are lower-cased and distinct; an event matches one indicator once, by the first kind of hash, ip, process, text. The
    first three are an equi-join with the list, the text is searched for all of them at once. Lists may be of any length; blank
    indicators and null columns match nothing.
    """
    keep, spark = keep or [], er.sparkSession
    values = sorted({v.strip().lower() for v in iocs if v.strip()})
    known = spark.createDataFrame([(v,) for v in values], "ioc string")
    fields = F.array(*[F.struct(F.lit(k).alias("rank"), F.lower(c).alias("ioc")) for k, c in enumerate(KINDS.values())])
    exact = er.select("event_id", *keep, F.explode(fields).alias("f")).select("f.ioc", "event_id", *keep, "f.rank").where("ioc IS NOT NULL").join(known, "ioc")
    parts = [exact] + [_texts_with(er, block, keep).withColumn("rank", F.lit(len(KINDS))) for block in _blocks(values)]
    best = reduce(DataFrame.unionByName, parts).groupBy("ioc", "event_id").agg(F.min("rank").alias("rank"), *[F.min(c).alias(c) for c in keep])
    return best.select("ioc", F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "text")]), F.col("rank") + 1).alias("kind"), "event_id", *keep)


#: how grave a match of a kind is; ours
IOC_LEVELS = {"hash": "critical", "ip": "high", "process": "medium", "text": "medium"}


def ioc_findings(er: DataFrame, iocs: list[str]) -> DataFrame:
    """Matches as rows of the schema of findings, engine `ioc`: one for each indicator and event, with a digest of both as id."""
    rows = ioc_match(er, iocs, ["event_time_utc", "host", "user_name", "process_name"])
    level = F.create_map(*[F.lit(x) for pair in IOC_LEVELS.items() for x in pair])[F.col("kind")]
    none = F.array().cast("array<string>")
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("ioc"), "ioc", "event_id"), 256).alias("finding_id"), F.lit("ioc").alias("engine"), "event_id", "event_time_utc", "host", "user_name", "process_name", F.concat(F.lit("ioc:"), "ioc").alias("rule_id"),
        F.concat(F.lit("Indicator of kind "), "kind").alias("title"), level.alias("severity"), none.alias("techniques"), none.alias("tactics"))


RELATIONS = {"user": "user_name", "host": "host", "process": "process_name", "file": "file_path", "ip": "ip", "url": "url", "hash": "hash"}


def event_context(er: DataFrame, anchor_id: str, minutes: int = 15, per_group: int = 50) -> DataFrame:
    """relation, event_id: events near the anchor in time or equal in a field, up to per_group each; one scan against the broadcast anchor row."""
    a = er.where(F.col("event_id") == anchor_id).limit(1).select(F.col("event_id").alias("a_id"), timestamp("event_time_utc").alias("a_t"), *[filled(c).alias(f"a_{k}") for k, c in RELATIONS.items()])
    both = er.join(F.broadcast(a), er["event_id"] != a["a_id"])
    gap = F.abs(F.unix_micros(timestamp("event_time_utc")) - F.unix_micros("a_t"))
    hits = [F.when(gap <= minutes * 60_000_000, F.lit("window")), F.when(basename("file_path") == basename("a_file"), F.lit("basename"))]
    hits += [F.when(F.col(c) == F.col(f"a_{k}"), F.lit(k)) for k, c in RELATIONS.items()]
    rows = both.select("event_id", gap.alias("gap"), F.explode(F.array_compact(F.array(*hits))).alias("relation"))
    order = Window.partitionBy("relation").orderBy("gap", "event_id")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_group).select("relation", "event_id")


IOCS = ["10.0.0.3", "EVIL1.exe", "evil1.exe", "certutil", "http://dl.example.com/payload3.js", "setup2"]
_LIST = ", ".join(f"('{v}')" for v in sorted({v.lower() for v in IOCS}))
_IOC = f""", i(ioc) AS (VALUES {_LIST}), m AS (SELECT ioc, event_id, CASE WHEN lower(hash) = ioc THEN 0 WHEN lower(ip) = ioc THEN 1 WHEN lower(process_name) = ioc THEN 2 ELSE 3 END AS k
 FROM er JOIN i ON lower(hash) = ioc OR lower(ip) = ioc OR lower(process_name) = ioc OR contains(search_text, ioc))"""
query("ioc_match", _IOC + " SELECT ioc, ['hash', 'ip', 'process', 'text'][k + 1] AS kind, event_id FROM m")(lambda er: ioc_match(er, IOCS))
_LEVEL = "CASE ['hash', 'ip', 'process', 'text'][k + 1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IOC_LEVELS.items()) + " END"
query("ioc_findings", _IOC + f""" SELECT sha256('ioc|' || ioc || '|' || event_id) AS finding_id, 'ioc' AS engine, event_id, event_time_utc, host, user_name, process_name, 'ioc:' || ioc AS rule_id,
 'Indicator of kind ' || ['hash', 'ip', 'process', 'text'][k + 1] AS title, {_LEVEL} AS severity, '' AS techniques FROM m JOIN er USING (event_id)""")(
    lambda er: ioc_findings(er, IOCS).select("finding_id", "engine", "event_id", "event_time_utc", "host", "user_name", "process_name", "rule_id", "title", "severity", F.array_join("techniques", ",").alias("techniques"))
)
query("ioc_event_page", "SELECT event_id FROM er WHERE lower(ip) = '10.0.0.3' ORDER BY event_time_utc, event_id LIMIT 101")(lambda er: er.where(F.lower("ip") == "10.0.0.3").orderBy("event_time_utc", "event_id").limit(101).select("event_id"))
_CTX = " UNION ALL ".join(
    [f"SELECT '{k}' AS relation, e.event_id, g FROM e WHERE e.{c} = a_{c} AND a_{c} NOT IN ('', '-')" for k, c in RELATIONS.items()]
    + ["SELECT 'window', event_id, g FROM e WHERE g <= 900000000", "SELECT 'basename', event_id, g FROM e WHERE regexp_replace(lower(file_path), '^.*[\\\\/]', '') = regexp_replace(lower(a_file_path), '^.*[\\\\/]', '')"]
)
query("event_context", f""", e AS (SELECT er.*, {', '.join(f'a.{c} AS a_{c}' for c in RELATIONS.values())},
 abs(epoch_us(CAST(er.event_time_utc AS TIMESTAMP)) - epoch_us(CAST(a.event_time_utc AS TIMESTAMP))) AS g FROM er, (SELECT * FROM er WHERE event_id = 'ev00000042') a WHERE er.event_id <> 'ev00000042'),
 r AS ({_CTX}), k AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY g, event_id) AS k FROM r) SELECT relation, event_id FROM k WHERE k <= 50""")(lambda er: event_context(er, "ev00000042"))
