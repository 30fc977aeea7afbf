"""Integrity jobs, unions and evidence gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.registry import query
from timeloom.sources import fixture
from timeloom.sources.storage import stored


def object_dedup(files: DataFrame) -> DataFrame:
    """One stored object per content."""
    return files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("file_id").alias("kept"))


def evidence_verify(spark: SparkSession, folder: str, ledger: DataFrame, depth: int = -1) -> DataFrame:
    """ledger (name, sha256) against the content of the folder's files: ok, mismatch or missing. depth: which part of a file's path is its name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split("path", "/"), depth).alias("name"), F.sha2("content", 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("mismatch")
    return ledger.join(found, "name", "left").select("name", status.alias("status"))


SEGMENT = 1000  # entries of a chain that are folded in one row


def _folded(entries: DataFrame, level: int) -> DataFrame:
    """entries (seq, digest) -> segment, link of each entry, and the segment's head: link = sha256(link before || digest), '' before the first."""
    step = lambda acc, e: F.struct(F.sha2(F.concat(acc["last"], e["digest"]), 256).alias("last"), acc["links"].alias("links"))
    push = lambda acc, e: F.struct(step(acc, e)["last"].alias("last"), F.concat(acc["links"], F.array(F.struct(e["seq"].alias("seq"), e["digest"].alias("digest"), step(acc, e)["last"].alias("link")))).alias("links"))
    none = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<seq:bigint,digest:string,link:string>>").alias("links"))
    rows = entries.groupBy(F.floor(F.col("seq") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("seq", "digest"))).alias("e"))
    chain = F.aggregate("e", none, push)
    return rows.select("segment", chain.alias("c")).select("segment", F.lit(level).alias("level"), F.col("c.last").alias("head"), F.inline("c.links"))


def seal(entries: DataFrame) -> DataFrame:
    """level, seq, digest, link of a ledger over entries (seq, digest); seq counts from 0 without gaps.

    A hash chain is a sequence, so it is cut: entries of a segment are chained, the segments' heads are the entries of the next level, until
    one segment is left, whose head (the last link of the highest level) stands for all entries and their order. Segments are folded
    in parallel; each level has `SEGMENT` times fewer entries.
    """
    level, out = 0, None
    while True:
        folded = stored(_folded(entries, level), "chain")
        links = folded.select("level", "seq", "digest", "link")
        out = links if out is None else out.unionByName(links)
        heads = folded.groupBy("segment").agg(F.min("head").alias("digest"))
        if heads.limit(2).count() < 2:
            return out
        entries, level = heads.select(F.col("segment").alias("seq"), "digest"), level + 1


def ledger_root(ledger: DataFrame, levels: int | None = None) -> DataFrame:
    """One row, root: the link that stands for the whole ledger. levels: of its lowest levels only; the smallest head of the highest of them."""
    if levels is not None:
        ends = ledger.where(F.col("level") < levels).groupBy("level", F.floor(F.col("seq") / SEGMENT)).agg(F.max_by("link", "seq").alias("head"))
        return ends.agg(F.min(F.struct((-F.col("level")).alias("down"), "head"))["head"].alias("root"))
    return ledger.agg(F.max_by("link", F.struct("level", "seq")).alias("root"))


def ledger_breaks(ledger: DataFrame) -> DataFrame:
    """level, seq of entries of a ledger whose link does not follow from the one before, or whose head differs from the next level's entry.

    Each entry is compared with the one before it within its segment, and each segment's end with its entry a level up; no order over
    the whole ledger is taken.
    """
    segment = F.floor(F.col("seq") / SEGMENT)
    before = F.lag(F.struct("seq", "link")).over(Window.partitionBy("level", "segment").orderBy("seq"))
    rows = ledger.withColumn("segment", segment).withColumn("before", before)
    follows = F.sha2(F.concat(F.coalesce("before.link", F.lit("")), "digest"), 256) == F.col("link")
    gapless = F.coalesce(F.col("before.seq") + 1, F.col("segment") * SEGMENT) == F.col("seq")
    inner = rows.where(~(follows & gapless)).select("level", "seq")
    heads = rows.groupBy("level", "segment").agg(F.max_by("link", "seq").alias("head"))
    up = ledger.select((F.col("level") - 1).alias("level"), F.col("seq").alias("segment"), "digest").where("level >= 0")
    top = ledger.agg(F.max("level").alias("top"))  # one row
    ends = heads.join(up, ["level", "segment"], "full").crossJoin(F.broadcast(top)).where("level < top AND NOT (head <=> digest)")
    return inner.unionByName(ends.select("level", (F.col("segment") * SEGMENT).alias("seq"))).distinct()


def custody_counts(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """status, n over the entries of a sealed ledger and a log (seq, digest) as it is now: ok, moved (another place's content), changed, removed, added."""
    was = ledger.where("level = 0").select("seq", F.col("digest").alias("was"))
    both = was.join(log.select("seq", F.col("digest").alias("now")), "seq", "full")
    elsewhere = was.select(F.col("was").alias("now")).distinct().withColumn("known", F.lit(True))
    odd = both.where("NOT (was <=> now)").join(elsewhere, "now", "left")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("known"), "moved").otherwise("changed")
    return both.where("was = now").select(F.lit("ok").alias("status")).unionByName(odd.select(status.alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


def verified_counts(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("checked"), F.count_if(F.col("status") != "ok").alias("mismatches"))


def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A digest over names, sizes and times of a table's parts, whatever their order; contents are not read and no list of parts is gathered."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    each = F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256)
    words = [F.bit_xor(F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("long")) for k in range(4)]
    return parts.agg(F.sha2(F.concat_ws("|", F.count("*"), *words), 256).alias("fingerprint"), F.max("modificationTime").alias("latest"))


query("object_dedup", "SELECT sha256, count(*) AS copies, min(file_id) AS kept FROM files GROUP BY 1", over="files")(object_dedup)


def evidence_gap(files: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """gap, id: files (file_id) without an event (source_file_id), runs (run_id, source_file_id) without a file, events' files that the inventory lacks."""
    seen = events.select(F.col("source_file_id").alias("file_id")).where("file_id IS NOT NULL").distinct()
    known = files.select("file_id")
    no_event = known.join(seen, "file_id", "left_anti").select(F.lit("file_without_event").alias("gap"), F.col("file_id").alias("id"))
    no_file = runs.join(known.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_anti").select(F.lit("run_without_file").alias("gap"), F.col("run_id").alias("id"))
    unknown = seen.join(known, "file_id", "left_anti").select(F.lit("event_without_file").alias("gap"), F.col("file_id").alias("id"))
    return no_event.unionByName(no_file).unionByName(unknown)


def _gaps(at) -> DataFrame:
    """The inventory names its files as the events do; runs are those of the events and of every file with an error."""
    events, files = fixture.events_full(*at), fixture.files(*at)
    named = files.select(F.concat(F.lit("file_"), F.substring("file_id", 5, 20)).alias("file_id"), "error").where("file_id <> 'file_3'")
    runs = events.select(F.col("parse_run_id").alias("run_id"), "source_file_id").distinct()
    runs = runs.unionByName(named.where("error IS NOT NULL").select(F.concat(F.lit("retry_"), "file_id").alias("run_id"), F.col("file_id").alias("source_file_id")))
    return evidence_gap(named, runs, events)


query("case_evidence_gap", """, n AS (SELECT 'file_' || substr(file_id, 5) AS file_id, error FROM files WHERE file_id <> 'doc_3'), s AS (SELECT DISTINCT source_file_id AS f, parse_run_id AS r FROM ef),
 r AS (SELECT f, r FROM s UNION ALL SELECT file_id, 'retry_' || file_id FROM n WHERE error IS NOT NULL)
 SELECT 'file_without_event' AS gap, file_id AS id FROM n WHERE file_id NOT IN (SELECT f FROM s) UNION ALL SELECT 'run_without_file', r FROM r WHERE f NOT IN (SELECT file_id FROM n)
 UNION ALL SELECT DISTINCT 'event_without_file', f FROM s WHERE f NOT IN (SELECT file_id FROM n)""", over="session")(_gaps)
query("distinct_ids", "SELECT source_file_id, min(event_id) AS first_id FROM er GROUP BY 1")(lambda er: er.groupBy("source_file_id").agg(F.min("event_id").alias("first_id")))
query("union_parts", "SELECT event_id, severity, CAST(NULL AS VARCHAR) AS command_line FROM er WHERE artifact_type = 'mft' UNION ALL SELECT event_id, severity, command_line FROM er WHERE artifact_type = 'evtx'")(
    lambda er: er.where("artifact_type = 'mft'").select("event_id", "severity").unionByName(er.where("artifact_type = 'evtx'").select("event_id", "severity", "command_line"), allowMissingColumns=True)
)
