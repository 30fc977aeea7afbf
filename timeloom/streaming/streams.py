"""Streaming twins of the batch operators: on the same rows they give the batch answer, for windows that the watermark has closed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from timeloom.functions.columns import filled, timestamp
from timeloom.operators.correlation import KEYED, STAGE_SQL, STAGES, WAYS_SQL, keyed, stage_of
from timeloom.operators.findings import FINDINGS, sigma_eval
from timeloom.operators.textindex import words_of
from timeloom.plans.read_models import compact_rows
from timeloom.registry import query
from timeloom.sources import fixture
from timeloom.sources.storage import stored, table_path


def stream_event_rows(ef: DataFrame) -> DataFrame:
    return compact_rows(ef)


def stream_sigma(er: DataFrame) -> DataFrame:
    return sigma_eval(er)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("t", timestamp("event_time_utc")).withWatermark("t", late)


def stream_timeline(er: DataFrame, late: str = "1 day") -> DataFrame:
    """Hourly counts, in all and of each severity, emitted once the watermark has passed the hour."""
    levels = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    return _timed(er, late).groupBy(F.window("t", "1 hour")).agg(F.count("*").alias("total"), *levels).select(F.col("window.start").alias("bin"), "total", *[F.col(s) for s in ("critical", "high", "medium", "low", "info")])


def stream_password_spray(er: DataFrame, users: int = 3, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Addresses from which several users failed to log on within a window.

    Two stateful steps, one behind the other: failures of each user of an address and window, then the users of the address and window.
    The state has a count a user and a row a window, and no list of names.
    """
    failed = _timed(er.where("event_action = 'logon_failure' AND ip IS NOT NULL"), late)
    each = failed.groupBy("ip", filled("user_name").alias("user"), F.window("t", window).alias("w")).agg(F.count("*").alias("n"))
    each = each.select("ip", "user", "n", F.window_time("w").alias("at"))
    out = each.groupBy("ip", F.window("at", window).alias("w")).agg(F.count("user").alias("users"), F.sum("n").alias("failures"))
    return out.where(F.col("users") >= users).select("ip", F.col("w.start").alias("start"), "users", "failures")


def stream_sessions(er: DataFrame, seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """Sessions of a chain key with events of several types, as `chain_sessions` has them: a gap of more than so many whole seconds begins a
    new one. The state of a session has its types (some twenty at most), not its events.

    Spark also joins sessions that only touch, so the window ends a microsecond behind the gap: an event a second later stands alone."""
    rows = _timed(keyed(er), late)
    out = rows.groupBy("kind", "key", F.session_window("t", f"{seconds} seconds 1 microsecond")).agg(F.count("*").alias("events"), F.size(F.collect_set("artifact_type")).alias("types"))
    return out.where("types >= 2").select("kind", "key", F.col("session_window.start").alias("start"), "events", "types")


STAGED = "kind string, key string, start long, last long, events long, stages string"
BUCKETS = 512  # groups of chain keys that share a state
_ROWS = ["kind", "key", "at", "event_id", "stage", "start", "events", *[f"way{k}" for k in range(len(STAGES))]]


def chain_step(seconds: int, least: int) -> Callable[[pa.Table, int], tuple[pd.DataFrame, pa.Table]]:
    """A function of rows and a mark, nested so that it travels to executors by value. It gives sessions that end before the mark and go through enough stages, and the rows to
    hold: events from the mark on, and a row a session that is still open.

    A row (see `_ROWS`) is an event of whole second `at`, or all events of an open session up to `at` with the best way to each stage: such a row has stage 0
    and comes before the other rows of its key.
    """

    def step(rows: pa.Table, mark: int) -> tuple[pd.DataFrame, pa.Table]:
        due = pc.less(rows["at"], mark)
        later, rows = rows.filter(pc.invert(due)), rows.filter(due).sort_by([(c, "ascending") for c in ("kind", "key", "at", "event_id")])
        wide, n = 1 << len(STAGES), rows.num_rows
        at, stage = rows["at"].to_numpy(), rows["stage"].to_numpy()
        other = np.zeros(max(n - 1, 0), bool)
        for c in ("kind", "key"):
            other |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, max(n - 1, 0))).to_numpy()
        new = np.append(np.ones(min(n, 1), bool), other | (np.diff(at) > seconds))
        first = np.flatnonzero(new)
        ways, session = np.array([rows[f"way{k}"].to_numpy() for k in range(len(STAGES))]).reshape(len(STAGES), n), 2 * len(STAGES) * wide * np.cumsum(new)
        best = np.zeros(n, "int64")  # of the lower stages, up to each row of its session
        for k in range(len(STAGES)):
            ways[k] = np.where(stage == k + 1, best + wide + (1 << k), ways[k])
            best = np.maximum(best, np.maximum.accumulate(ways[k] + session) - session)
        if n:
            ways = np.maximum.reduceat(ways, first, axis=1)
            last, events = at[np.append(first[1:], n) - 1], np.add.reduceat(rows["events"].to_numpy(), first)
        else:
            last, events = at, at
        start, way = rows["start"].to_numpy()[first], ways.max(axis=0)
        over = last + seconds < mark
        ready = np.flatnonzero(over & (way >= least * wide))
        out = rows.select(["kind", "key"]).take(first[ready]).to_pandas()
        names = [">".join(name for j, name in enumerate(STAGES) if p >> j & 1) for p in (way[ready] % wide).tolist()]
        out = out.assign(start=start[ready], last=last[ready], events=events[ready], stages=pd.Series(names, dtype="object"))
        left = np.flatnonzero(~over)
        heads = rows.select(["kind", "key"]).take(first[left])
        opened = [*heads.columns, pa.array(last[left]), pa.array([""] * len(left), pa.string()), pa.array(np.zeros(len(left), "int64")), pa.array(start[left]), pa.array(events[left]), *[pa.array(w[left]) for w in ways]]
        return out, pa.concat_tables([pa.table(opened, schema=rows.schema), later])

    return step


def stream_chains(er: DataFrame, seconds: int = 3600, late: str = "1 day", least: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """kind, key, start, last, events, stages of sessions that go through at least so many stages in their order, as `chain_windowed` has them.

    Keyed state with timers in event time: events are held until the watermark has passed them, then taken in their order by the
    automaton, whose state is the best way to each stage. A timer at the session's end (its last event and the gap) emits it. Held
    events are those of the time of lateness, so the state of a key doesn't grow with its history. Keys are dealt to buckets by their hash,
    so a call of Python takes the events of many keys at once.
    """
    rows = _timed(keyed(er), late).select(
        F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).alias("bucket"), "t", "kind", "key", F.unix_seconds("t").alias("at"), "event_id", F.coalesce(stage_of(), F.lit(0)).cast("long").alias("stage")
    )
    schema = pa.schema([(c, pa.string() if c in ("kind", "key", "event_id") else pa.int64()) for c in _ROWS])
    step = chain_step(seconds, least)

    def update(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(pa.py_buffer(bytes(group.get[0]))).read_all()] if group.exists else [schema.empty_table()]
        if not group.hasTimedOut:
            for frame in frames:
                fresh = frame[_ROWS[:5]].assign(start=frame["at"], events=1, **dict.fromkeys(_ROWS[7:], 0))
                parts.append(pa.Table.from_pandas(fresh, schema=schema, preserve_index=False))
        mark = group.getCurrentWatermarkMs() // 1000
        out, held = step(pa.concat_tables(parts), mark)
        if held.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as writer:
                writer.write_table(held.combine_chunks())
            group.update((sink.getvalue().to_pybytes(),))
            at = held["at"].to_numpy()
            ends = np.where(at < mark, at + seconds + 1, at + 1)  # sessions end behind the gap
            group.setTimeoutTimestamp(max(1000 * int(ends.min()), group.getCurrentWatermarkMs() + 1))
        elif group.exists:
            group.remove()
        yield out

    return rows.groupBy("bucket").applyInPandasWithState(update, STAGED, "held binary", "append", "EventTimeTimeout")


def stream_postings(rows: DataFrame) -> DataFrame:
    """doc, version, postings (an array of term, tf; null: deleted) of rows (doc, version, body; body null: deleted).

    What a version writes makes all lower ones of its document void, its absence of a term and a deletion too, whatever the order they come in.
    So no state of documents is held, a batch costs what its rows cost, and a version that comes late changes nothing.
    """
    words = rows.select("doc", "version", F.array_sort(words_of("body")).alias("w"))
    first = F.filter(F.sequence(F.lit(0), F.size("w")), lambda k: (k < F.size("w")) & ((k == 0) | (F.get("w", k) != F.get("w", k - 1))))
    words = words.withColumn("at", F.when(F.col("w").isNotNull(), first))
    return words.select("doc", "version", F.transform("at", lambda k, n: F.struct(F.get("w", k).alias("term"), (F.coalesce(F.get("at", n + 1), F.size("w")) - k).cast("long").alias("tf"))).alias("postings"))


def current_postings(versions: DataFrame) -> DataFrame:
    """term, doc, tf as the last versions have them."""
    last = versions.groupBy("doc").agg(F.max_by("postings", "version").alias("postings"))
    return last.select("doc", F.inline("postings")).select("term", "doc", "tf")


def run(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, into a table of the shared folder."""
    spark = stream.sparkSession
    folder = table_path(spark, name)
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", f"{folder}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def stream_of(table: DataFrame) -> DataFrame:
    """A stored table as a stream of its parts, as many at a time as there are cores. A clustered table's parts arrive in the order of their names, which is that of time."""
    spark = table.sparkSession
    parts = sorted(table.inputFiles())
    folder = parts[0].rsplit("/", 1)[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    first = min(fs.getFileStatus(hadoop(p)).getModificationTime() for p in parts)
    for k, p in enumerate(parts):
        fs.setTimes(hadoop(p), first - 1000 * (len(parts) - k), -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(4, spark.sparkContext.defaultParallelism)).parquet(folder)


def _events(at) -> DataFrame:
    return stream_event_rows(stream_of(fixture.events_full(*at)))


def _indexed(at) -> DataFrame:
    """Events in up to three versions that arrive in any order: some change, some are deleted; the index of the last versions."""
    spark = at[0]
    base = fixture.events_full(*at).select(F.col("event_id").alias("doc"), F.col("message_full").alias("body"))
    versions = base.withColumn("version", F.lit(1).cast("long"))
    versions = versions.unionByName(base.where("doc LIKE '%3'").select("doc", F.concat("body", F.lit(" edited twice twice")).alias("body"), F.lit(3).cast("long").alias("version")))
    versions = versions.unionByName(base.where("doc LIKE '%3'").select("doc", F.lit("stale words").alias("body"), F.lit(2).cast("long").alias("version")))
    versions = versions.unionByName(base.where("doc LIKE '%7'").select("doc", F.lit(None).cast("string").alias("body"), F.lit(2).cast("long").alias("version")))
    parts = 3 * max(4, spark.sparkContext.defaultParallelism)
    written = run(stream_postings(stream_of(stored(versions.repartition(parts, "doc", "version"), "versions"))), "stream-postings")
    return current_postings(written).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


_T = "CAST(event_time_utc AS TIMESTAMP)"
query("stream_event_rows", "SELECT event_id, event_code, search_text FROM er", over="session")(lambda at: run(_events(at).select("event_id", "event_code", "search_text"), "stream-rows"))
query("stream_sigma", FINDINGS + " SELECT finding_id, event_id, rule_id FROM findings", over="session")(lambda at: run(stream_sigma(_events(at)).select("finding_id", "event_id", "rule_id"), "stream-sigma"))
_BY = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
query("stream_timeline", f", b AS (SELECT date_trunc('hour', {_T}) AS bin, count(*) AS total, {_BY} FROM er GROUP BY 1) SELECT * REPLACE (strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin) FROM b WHERE bin + INTERVAL 1 HOUR <= (SELECT max({_T}) - INTERVAL 1 DAY FROM er)", over="session")(
    lambda at: run(stream_timeline(_events(at)), "stream-timeline").withColumn("bin", F.date_format("bin", "yyyy-MM-dd HH:mm:ss"))
)
query("stream_password_spray", f""", f AS (SELECT ip, date_trunc('day', {_T}) AS start, {_T} AS t, CASE WHEN user_name NOT IN ('', '-') THEN user_name END AS u FROM er WHERE event_action = 'logon_failure' AND ip IS NOT NULL)
 SELECT ip, strftime(start, '%Y-%m-%d') AS start, count(DISTINCT u) AS users, count(*) AS failures FROM f GROUP BY ip, f.start HAVING count(DISTINCT u) >= 1 AND f.start + INTERVAL 1 DAY <= (SELECT max(t) - INTERVAL 1 DAY FROM f)""", over="session")(
    lambda at: run(stream_password_spray(_events(at), users=1), "stream-spray").select("ip", F.date_format("start", "yyyy-MM-dd").alias("start"), "users", "failures")
)
_SESSIONS = KEYED + f""", a AS (SELECT *, {_T} AS t, {_T} - lag({_T}) OVER (PARTITION BY kind, key ORDER BY {_T}, event_id) AS gap FROM keyed),
 s AS (SELECT *, sum(CASE WHEN gap <= INTERVAL 3600 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY kind, key ORDER BY t, event_id) AS session FROM a)"""
query("stream_sessions", _SESSIONS + """, g AS (SELECT kind, key, session, min(t) AS start, max(t) AS last, count(*) AS events, CAST(count(DISTINCT artifact_type) AS INTEGER) AS types FROM s GROUP BY 1, 2, 3)
 SELECT kind, key, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, events, types FROM g WHERE types >= 2 AND last + INTERVAL 3601 SECOND <= (SELECT max(t) - INTERVAL 1 DAY FROM a)""", over="session")(
    lambda at: run(stream_sessions(_events(at)), "stream-sessions").select("kind", "key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "types")
)
query("stream_chains", _SESSIONS + f""", w0 AS (SELECT *, {STAGE_SQL} AS stage FROM s), {WAYS_SQL},
 g AS (SELECT kind, key, session, min(t) AS start, max(t) AS last, count(*) AS events, max(coalesce({', '.join(f'way{k}' for k in range(len(STAGES)))})) AS way FROM w{len(STAGES)} GROUP BY 1, 2, 3)
 SELECT kind, key, CAST(epoch(start) AS BIGINT) AS start, CAST(epoch(last) AS BIGINT) AS last, events, concat_ws('>', {', '.join(f"CASE WHEN way & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(STAGES))}) AS stages
 FROM g WHERE way >= {2 << len(STAGES)} AND last + INTERVAL 3600 SECOND < (SELECT max(t) - INTERVAL 1 DAY FROM a)""", over="session")(lambda at: run(stream_chains(_events(at)), "stream-chains"))
query("stream_index_sync", """, b AS (SELECT event_id AS doc, CASE WHEN event_id LIKE '%3' THEN message_full || ' edited twice twice' ELSE message_full END AS body FROM ef WHERE event_id NOT LIKE '%7'),
 t AS (SELECT doc, unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM b) SELECT term, count(DISTINCT doc) AS docs, count(*) AS tf FROM t GROUP BY 1""", over="session")(_indexed)
