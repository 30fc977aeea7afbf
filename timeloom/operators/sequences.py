"""Sequences: windows over keys that spread well, conditional aggregates, bounded iteration for trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import basename, process_basename, timestamp
from timeloom.operators.aggregates import RANK_SQL
from timeloom.registry import query
from timeloom.sources.storage import discard, stored

#: upper bounds of the gap buckets in seconds, the last one open
BUCKETS = [10, 30, 60, 300, 900, 3600, 21600]


def _bucket(gap):
    out = F.lit(len(BUCKETS))
    for k in reversed(range(len(BUCKETS))):
        out = F.when(gap < BUCKETS[k], k).otherwise(out)
    return out


def beacon_intervals(er: DataFrame, part: int = 86_400) -> DataFrame:
    """Gaps between connections to one address, in eight buckets that always come; the address with most gaps, ties to the smallest.

    Gaps are taken within days, so a hot address spreads over tasks; those across days come from each day's first and last time.
    """
    t = er.where("event_action = 'network_connection' AND ip IS NOT NULL").select("ip", "event_id", F.unix_timestamp(timestamp("event_time_utc")).alias("t")).where("t IS NOT NULL")
    t = t.withColumn("part", F.floor(F.col("t") / part))
    inner = t.select("ip", (F.col("t") - F.lag("t").over(Window.partitionBy("ip", "part").orderBy("t", "event_id"))).alias("gap"))
    days = t.groupBy("ip", "part").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    outer = days.select("ip", (F.col("first") - F.lag("last").over(Window.partitionBy("ip").orderBy("part"))).alias("gap"))
    per_ip = inner.unionByName(outer).where("gap IS NOT NULL").groupBy(_bucket(F.col("gap")).alias("bucket"), "ip").agg(F.count("*").alias("n"))
    found = per_ip.groupBy("bucket").agg(F.sum("n").alias("gaps"), F.min(F.struct((-F.col("n")).alias("n"), "ip"))["ip"].alias("top_ip"))
    all_ = er.sparkSession.range(len(BUCKETS) + 1).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(found, "bucket", "left").select("bucket", F.coalesce("gaps", F.lit(0)).alias("gaps"), "top_ip")


def timestomp(er: DataFrame, seconds: int = 3600) -> DataFrame:
    """Paths whose two creation times differ: pivot by conditional maxima, no join."""
    pick = lambda a: F.max(F.when(F.col("event_action") == a, F.unix_timestamp(timestamp("event_time_utc"))))
    both = er.where("artifact_type = 'mft' AND file_path IS NOT NULL").groupBy("file_path").agg(pick("mft_created").alias("si"), pick("mft_filename_created").alias("fn"))
    return both.where("si IS NOT NULL AND fn IS NOT NULL").select("file_path", (F.col("si") - F.col("fn")).alias("delta"), (F.abs(F.col("si") - F.col("fn")) > seconds).alias("mismatch"))


def timestomp_sample(er: DataFrame, most: int = 60) -> DataFrame:
    """Suspects fill up to two thirds, the rest is consistent; each is thinned by a stride over the paths in order.

    Paths are dealt by ranges and stored with their partition; a path's place is the count of the partitions before and its row there.
    """
    ranged = stored(timestomp(er).repartitionByRange("mismatch", "file_path").withColumn("part", F.spark_partition_id()), "timestomp")
    parts = ranged.groupBy("mismatch", "part").agg(F.count("*").alias("c"))  # a row per partition
    over = Window.partitionBy("mismatch").orderBy("part")
    parts = parts.select("mismatch", "part", (F.sum("c").over(over) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("mismatch")).alias("n"))
    row = F.row_number().over(Window.partitionBy("mismatch", "part").orderBy("file_path")) - 1
    ranked = ranged.withColumn("row", row).join(parts, ["mismatch", "part"]).withColumn("k", F.col("row") + F.col("before"))
    budget = F.when(F.col("mismatch"), F.lit(most * 2 // 3)).otherwise(F.lit(most - most * 2 // 3))
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / budget))
    return ranked.where(F.pmod("k", stride) == 0).select("file_path", "delta", "mismatch")


def process_tree_edges(er: DataFrame) -> DataFrame:
    created = er.where("event_action = 'process_created' AND parent_process IS NOT NULL")
    return created.groupBy(basename("parent_process").alias("parent"), process_basename("process_name").alias("child")).agg(F.count("*").alias("n"))


def process_icicle(er: DataFrame, parents: int = 8) -> DataFrame:
    edges = process_tree_edges(er)
    total = edges.withColumn("total", F.sum("n").over(Window.partitionBy("parent")))
    return total.withColumn("k", F.dense_rank().over(Window.orderBy(F.desc("total"), "parent"))).where(F.col("k") <= parents).drop("k")


def process_instances(er: DataFrame) -> DataFrame:
    """The earliest row of each process, keyed by guid, else pid, else event."""
    key = F.coalesce(F.concat(F.lit("guid:"), "process_guid"), F.concat(F.lit("pid:"), "process_id"), F.concat(F.lit("evt:"), "event_id"))
    parent = F.concat(F.lit("guid:"), "parent_process_guid")
    first = F.min(F.struct("event_time_utc", "event_id", "process_name", "command_line", "severity", parent.alias("parent_key"), "host", "user_name", "hash")).alias("e")
    return er.where("event_action = 'process_created'").groupBy(key.alias("key")).agg(first).select("key", "e.*")


def process_forest(nodes: DataFrame, depth: int = 128) -> DataFrame:
    """key, root, depth: pointers up the tree are doubled, so a path of d takes log2(d) joins; cycles end by the bound and have no root.

    Each round is stored: it reads the one before, not all before it. Rounds end when every pointer stands at a root.
    """
    from math import ceil, log2

    nodes = stored(nodes.select("key", "parent_key"), "process-nodes")
    at = nodes.join(nodes.select(F.col("key").alias("parent_key"), F.lit(True).alias("known")), "parent_key", "left")
    at = at.select("key", F.when(F.col("known"), F.col("parent_key")).alias("up"))
    at = stored(at.select("key", F.coalesce("up", "key").alias("root"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("hops"), F.col("up").isNull().alias("ends")), "process-pointers")
    for _ in range(ceil(log2(depth))):
        if not at.where("NOT ends").limit(1).count():
            break
        above = at.select(F.col("key").alias("root"), F.col("root").alias("top"), F.col("hops").alias("more"), "ends")
        new = stored(at.drop("ends").join(above, "root").select("key", F.col("top").alias("root"), (F.col("hops") + F.col("more")).alias("hops"), "ends"), "process-pointers")
        discard(at)
        at = new
    discard(nodes)
    return at.where(F.col("ends") & (F.col("hops") <= depth)).select("key", "root", F.col("hops").alias("depth"))


_T = "CAST(epoch(CAST(event_time_utc AS TIMESTAMP)) AS BIGINT)"
_BUCKET_SQL = "CASE " + " ".join(f"WHEN gap < {b} THEN {k}" for k, b in enumerate(BUCKETS)) + f" ELSE {len(BUCKETS)} END"
query("beacon_intervals", f""", t AS (SELECT ip, {_T} - lag({_T}) OVER (PARTITION BY ip ORDER BY {_T}, event_id) AS gap FROM er WHERE event_action = 'network_connection'),
 b AS (SELECT {_BUCKET_SQL} AS bucket, ip, count(*) AS n FROM t WHERE gap IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS gaps, arg_min(ip, (-n, ip)) AS top_ip FROM b GROUP BY 1)
 SELECT CAST(r.bucket AS INTEGER) AS bucket, coalesce(f.gaps, 0) AS gaps, f.top_ip FROM (SELECT unnest(range(0, 8)) AS bucket) r LEFT JOIN f ON r.bucket = f.bucket""")(beacon_intervals)
_STOMP = f"""SELECT file_path, max(CASE WHEN event_action = 'mft_created' THEN {_T} END) AS si, max(CASE WHEN event_action = 'mft_filename_created' THEN {_T} END) AS fn FROM er
 WHERE artifact_type = 'mft' GROUP BY 1"""
query("timestomp_scatter", f", p AS ({_STOMP}) SELECT file_path, si - fn AS delta, abs(si - fn) > 3600 AS mismatch FROM p WHERE si IS NOT NULL AND fn IS NOT NULL")(timestomp)
query("heur_timestomp", f", p AS ({_STOMP}) SELECT file_path, si - fn AS delta FROM p WHERE abs(si - fn) > 3600")(lambda er: timestomp(er).where("mismatch").select("file_path", "delta"))
query("timestomp_sample", f""", p AS ({_STOMP}), q AS (SELECT file_path, si - fn AS delta, abs(si - fn) > 3600 AS mismatch FROM p WHERE si IS NOT NULL AND fn IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY mismatch ORDER BY file_path) - 1 AS k, count(*) OVER (PARTITION BY mismatch) AS n FROM q)
 SELECT file_path, delta, mismatch FROM r WHERE k % greatest(1, CAST(ceil(n / CASE WHEN mismatch THEN 40.0 ELSE 20.0 END) AS BIGINT)) = 0""")(timestomp_sample)
_EDGE = "SELECT regexp_replace(lower(parent_process), '^.*[\\\\/]', '') AS parent, process_name AS child, count(*) AS n FROM er WHERE event_action = 'process_created' AND parent_process IS NOT NULL GROUP BY 1, 2"
query("process_tree_edges", _EDGE)(process_tree_edges)
query("process_icicle", f", e AS ({_EDGE}), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY parent) AS BIGINT) AS total FROM e), d AS (SELECT *, dense_rank() OVER (ORDER BY total DESC, parent) AS k FROM t) SELECT parent, child, n, total FROM d WHERE k <= 8")(process_icicle)
_INST = """SELECT 'guid:' || process_guid AS key, event_time_utc, event_id, process_name, command_line, severity, 'guid:' || parent_process_guid AS parent_key, host, user_name, hash FROM
 (SELECT *, row_number() OVER (PARTITION BY process_guid ORDER BY event_time_utc, event_id) AS k FROM er WHERE event_action = 'process_created') WHERE k = 1"""
query("process_nodes", _INST)(process_instances)
query("process_forest", f""", n AS ({_INST}), t AS (SELECT key, parent_key FROM n),
 w AS (WITH RECURSIVE r AS (SELECT key, key AS root, 0 AS depth FROM t WHERE parent_key IS NULL OR parent_key NOT IN (SELECT key FROM t)
  UNION ALL SELECT t.key, r.root, r.depth + 1 FROM t JOIN r ON t.parent_key = r.key WHERE r.depth < 128) SELECT * FROM r) SELECT key, root, depth FROM w""")(lambda er: process_forest(process_instances(er)))
_REL = [("network", "network|connection|dns"), ("registry", "registry|run_key"), ("file", "file|usn|mft|download")]
query("related_category", "SELECT CASE " + " ".join(f"WHEN regexp_matches(event_action, '{p}') THEN '{n}'" for n, p in _REL) + " ELSE 'other' END AS category, count(*) AS n FROM er GROUP BY 1")(
    lambda er: er.groupBy(F.when(F.col("event_action").rlike(_REL[0][1]), "network").when(F.col("event_action").rlike(_REL[1][1]), "registry").when(F.col("event_action").rlike(_REL[2][1]), "file").otherwise("other").alias("category")).agg(F.count("*").alias("n"))
)
