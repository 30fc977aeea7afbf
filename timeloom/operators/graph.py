"""Entities and edges: two DataFrames and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import filled
from timeloom.registry import query
from timeloom.sources.storage import stored

ENTITIES = {"host": "host", "user": "user_name", "process": "process_name", "file": "file_path", "ip": "ip", "url": "url", "hash": "hash"}
EDGES = {"user_logged_on_host": ("user", "host"), "process_touched_file": ("process", "file"), "process_connected_ip": ("process", "ip"), "file_has_hash": ("file", "hash")}
MENTIONS = "event_mentions_entity"  # from the event's id to each of its entities

EDGE = ["kind", "src", "dst"]


def _canonical(c: str):
    return F.lower(F.trim(filled(c)))


def extract_entities(er: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), _canonical(c).alias("canonical")) for k, c in ENTITIES.items()])).alias("p")
    rows = er.select("event_id", "event_time_utc", pairs).select("event_id", "event_time_utc", "p.*").where("canonical <> '' AND canonical <> '-'")
    return rows.groupBy("type", "canonical").agg(
        F.sha2(F.concat_ws("|", F.first("type"), F.first("canonical")), 256).alias("entity_id"), F.count("*").alias("events"), F.min("event_time_utc").alias("first_seen"),
        F.max("event_time_utc").alias("last_seen"))


def _evidence(rows: DataFrame) -> DataFrame:
    """The 50 smallest event ids of each edge: ranked first within parts of an edge, then among what the parts keep, so no list grows with a hub."""
    rank = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("event_id"))).where(F.col("k") <= 50)
    some = rank(rank(rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(64))), *EDGE, "part"), *EDGE)
    return some.groupBy(*EDGE).agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("evidence"))


def _mentioned(er: DataFrame) -> DataFrame:
    """event_id, event_time_utc, kind, src, dst: a row for each event of an edge."""
    named = [F.struct(F.lit(k).alias("kind"), _canonical(ENTITIES[a]).alias("src"), _canonical(ENTITIES[b]).alias("dst")) for k, (a, b) in EDGES.items()]
    named += [F.struct(F.lit(MENTIONS).alias("kind"), F.col("event_id").alias("src"), _canonical(c).alias("dst")) for c in ENTITIES.values()]
    pairs = F.explode(F.array(*named)).alias("p")
    return er.select("event_id", "event_time_utc", pairs).select("event_id", "event_time_utc", "p.*").where("src <> '' AND dst <> ''")


def _counted(rows: DataFrame) -> DataFrame:
    seen = [F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen")]
    return rows.groupBy(*EDGE).agg(F.count("*").alias("events"), *seen)


def count_edges(er: DataFrame) -> DataFrame:
    """kind, src, dst, events, first and last time: for what needs no evidence, which takes two sorts of all rows and a join."""
    return _counted(_mentioned(er))


def extract_edges(er: DataFrame) -> DataFrame:
    """kind, src, dst, events, first and last time and the 50 smallest evidence ids."""
    rows = _mentioned(er)
    return _counted(rows).join(_evidence(rows), EDGE)


def edge_pairs(er: DataFrame) -> DataFrame:
    """src, dst, kinds, events: by how many kinds of edges two entities are linked, in one grouping; the kinds are few, so they are bits."""
    bit = reduce(lambda out, k: F.when(F.col("kind") == k[1], 1 << k[0]).otherwise(out), enumerate([*EDGES, MENTIONS]), F.lit(0))
    return _mentioned(er).groupBy("src", "dst").agg(F.bit_count(F.bit_or(bit)).cast("long").alias("kinds"), F.count("*").alias("events"))


def compact_edges(parts: DataFrame) -> DataFrame:
    """Edges of several parts, one row each: counts summed, widest times, evidence ids united (each once, the 50 smallest)."""
    seen = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    ids = parts.select(*EDGE, F.explode(F.split("evidence", ",")).alias("event_id")).distinct()
    return parts.groupBy(*EDGE).agg(F.sum("events").alias("events"), *seen).join(_evidence(ids), EDGE)


def entity_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select("kind", F.explode(F.array("src", "dst")).alias("entity"))
    return ends.groupBy("entity", "kind").agg(F.count("*").alias("degree"))


def subgraph(edges: DataFrame, start: str, hops: int = 2, budget: int = 500) -> DataFrame:
    """Edges within `hops` of an entity, nearest first and newest first among these, up to the budget: each hop is a semi-join with a frontier that the budget bounds."""
    spark = edges.sparkSession
    edges = stored(edges, "edges")  # each hop reads them
    frontier = spark.createDataFrame([(start,)], "entity string")
    seen, out = frontier, None
    for hop in range(1, min(hops, 2) + 1):
        f = F.broadcast(frontier)
        touch = edges.join(f.withColumnRenamed("entity", "src"), "src", "left_semi").unionByName(edges.join(f.withColumnRenamed("entity", "dst"), "dst", "left_semi")).dropDuplicates(["kind", "src", "dst"])
        if out is not None:
            touch = touch.join(out.select("kind", "src", "dst"), ["kind", "src", "dst"], "left_anti")
        new = touch.withColumn("hop", F.lit(hop))
        out = new if out is None else out.unionByName(new)
        out = stored(out.orderBy("hop", F.desc("last_seen"), *EDGE).limit(budget), "hop")  # the next hop and the frontier read it
        frontier = out.select(F.explode(F.array("src", "dst")).alias("entity")).distinct().join(seen, "entity", "left_anti")
        seen = seen.union(frontier).distinct()
    return out


_ENT = " UNION ALL ".join(f"SELECT event_id, event_time_utc, '{k}' AS type, lower(trim({c})) AS canonical FROM er WHERE {c} NOT IN ('', '-')" for k, c in ENTITIES.items())
_ENTITIES = f"SELECT type, canonical, sha256(type || '|' || canonical) AS entity_id, count(*) AS events, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen FROM x GROUP BY 1, 2"
query("extract_entities", f", x AS ({_ENT}) {_ENTITIES}")(extract_entities)
query("entity_types", f", x AS ({_ENT}), s AS ({_ENTITIES}) SELECT type, count(*) AS entities, CAST(sum(events) AS BIGINT) AS events FROM s GROUP BY 1")(
    lambda er: extract_entities(er).groupBy("type").agg(F.count("*").alias("entities"), F.sum("events").alias("events"))
)
_E = " UNION ALL ".join(f"SELECT event_id, event_time_utc, '{k}' AS kind, lower(trim({ENTITIES[a]})) AS src, lower(trim({ENTITIES[b]})) AS dst FROM er WHERE {ENTITIES[a]} NOT IN ('', '-') AND {ENTITIES[b]} NOT IN ('', '-')" for k, (a, b) in EDGES.items())
_E += "".join(f" UNION ALL SELECT event_id, event_time_utc, '{MENTIONS}', event_id, lower(trim({c})) FROM er WHERE {c} NOT IN ('', '-')" for c in ENTITIES.values())
_EDGES = "SELECT kind, src, dst, count(*) AS events, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen, array_to_string(list_sort(list(DISTINCT event_id))[1:50], ',') AS evidence FROM y GROUP BY 1, 2, 3"
query("extract_edges", f", y AS ({_E}) {_EDGES}")(extract_edges)
query("edge_compaction", f", y AS ({_E}) {_EDGES}")(
    lambda er: compact_edges(reduce(DataFrame.unionByName, [extract_edges(er.where(F.pmod(F.crc32("event_id"), F.lit(3)) == k)) for k in range(3)]))
)
query("edge_pairs", f", y AS ({_E}) SELECT src, dst, count(DISTINCT kind) AS kinds, count(*) AS events FROM y GROUP BY 1, 2")(
    edge_pairs
)
query("entity_degree", f", y AS ({_E}), e AS ({_EDGES}), z AS (SELECT kind, src AS entity FROM e UNION ALL SELECT kind, dst FROM e) SELECT entity, kind, count(*) AS degree FROM z GROUP BY 1, 2")(lambda er: entity_degree(count_edges(er)))
query("subgraph", f""", y AS ({_E}), e AS ({_EDGES}), h1 AS (SELECT *, 1 AS hop FROM e WHERE src = 'host1' OR dst = 'host1' ORDER BY last_seen DESC, kind, src, dst LIMIT 500),
 f AS (SELECT src AS n FROM h1 UNION SELECT dst FROM h1),
 h2 AS (SELECT *, 2 AS hop FROM e WHERE (src IN (SELECT n FROM f) OR dst IN (SELECT n FROM f)) AND (kind, src, dst) NOT IN (SELECT (kind, src, dst) FROM h1))
 SELECT kind, src, dst, events, last_seen, hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY hop, last_seen DESC, kind, src, dst LIMIT 500""")(
    lambda er: subgraph(count_edges(er).select("kind", "src", "dst", "events", "last_seen"), "host1")
)
