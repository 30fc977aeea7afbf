"""Correlation chains across sources: one grouping by key with conditional aggregates; step lists are cut before they are gathered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import basename, blank, severity_max, severity_rank, timestamp
from timeloom.operators.aggregates import MAX_SQL, type_bits
from timeloom.operators.objects import OBJECT_CHAINS, ladder, object_chains
from timeloom.registry import query
from timeloom.sources import fixture

STEPS = 50

# fixed values: names too common to tell anything
NOISE = [
    "desktop.ini", "thumbs.db", "iconcache.db", "ntuser.dat", "usrclass.dat", "edb.log", "edb.chk", "setupapi.dev.log", "security.evtx", "system.evtx", "application.evtx",
    "windows", "desktop", "inetcache", "downloads", "favorites", "documents", "pictures", "videos", "music", "recent", "history", "cookies", "cache", "temp", "tmp", "logs",
    "program files", "program files (x86)", "programdata", "users", "public", "appdata", "local", "locallow", "roaming", "microsoft", "google", "chrome", "edge", "mozilla",
    "firefox", "default", "profile", "profiles", "system32", "syswow64", "winsxs", "software", "system", "dismhost.exe", "mighost.exe", "setuphost.exe", "setupdiag.exe",
    "tiworker.exe", "trustedinstaller.exe", "wimserv.exe", "wermgr.exe", "werfault.exe", "mrt.exe", "gatherosstate.exe", "onedrivesetup.exe", "onedrivestandaloneupdater.exe",
    "microsoftedgeupdate.exe", "wmiadap.exe", "conhost.exe", "services.exe", "explorer.exe", "winlogon.exe", "vds.exe", "smss.exe", "wininit.exe", "taskmgr.exe", "userinit.exe",
    "csrss.exe", "compattelrunner.exe", "svchost.exe", "wmiprvse.exe", "am_engine.exe", "microsoft.sharepoint.exe", "onedrive.exe", "diagerr.xml", "opcservices.dll",
    "clusapi.dll", "storagewmi.dll", "software.log1", "software.log2", "system.log1", "system.log2", "security.log1", "security.log2", "sam.log1", "sam.log2", "default.log1",
    "default.log2", "ntuser.dat.log1", "ntuser.dat.log2", "usrclass.dat.log1", "usrclass.dat.log2", "amcache.hve.log1", "amcache.hve.log2",
]
# fixed values: names without a dot that count all the same
DOTLESS = [
    "powershell", "pwsh", "cmd", "rundll32", "regsvr32", "mshta", "wscript", "cscript", "wmic", "certutil", "bitsadmin", "wevtutil", "schtasks", "sc", "net", "net1", "curl",
    "wget", "python", "perl", "ruby", "java", "teamviewer", "anydesk", "screenconnect", "merlin", "sliver", "beacon",
]
# fixed values: of file system records, only files of these kinds make keys
EXECUTABLE = ["exe", "dll", "ps1", "bat", "cmd", "scr", "hta", "js", "jse", "vbs", "vbe", "wsf", "lnk", "msi", "jar"]
#: kinds of files that say little unless they ran or were detected
WEAK = ["dll", "sys", "dat", "xml", "log1", "log2"]


def chain_key() -> tuple[Column, Column]:
    """(kind, key): the first of file, address, hash, url and user that is there; keys of under three characters don't count."""
    name = F.coalesce("file_path", "process_name")
    options = [("file_basename", name != "", basename(name)), ("ip", ~blank("ip"), F.col("ip")), ("hash", F.col("hash") != "", F.lower("hash")), ("url", F.col("url") != "", F.lower("url")), ("user_name", ~blank("user_name"), F.lower("user_name"))]
    first = lambda values: F.coalesce(*[F.when(c, v) for (_, c, _), v in zip(options, values, strict=True)])
    return first([F.lit(k) for k, _, _ in options]), first([v for _, _, v in options])


def telling(kind: str = "kind", key: str = "key") -> Column:
    """Not a file name that is too common or has no dot."""
    return ~((F.col(kind) == "file_basename") & (F.col(key).isin(NOISE) | (~F.contains(F.col(key), F.lit(".")) & ~F.col(key).isin(DOTLESS))))


def bulk_filter(rows: DataFrame) -> DataFrame:
    """Rows of the file system tables only where they name something that can run."""
    of = F.regexp_extract(F.lower(F.coalesce("file_path", "process_name", F.lit(""))), r"\.([a-z0-9]+)$", 1)
    return rows.where(~F.col("artifact_type").isin("mft", "usn_jrnl") | of.isin(EXECUTABLE))


def keyed(er: DataFrame) -> DataFrame:
    kind, key = chain_key()
    rows = bulk_filter(er).withColumn("kind", kind).withColumn("key", key)
    return rows.where((F.length("key") >= 3) & telling())


#: evidence of a chain; each test is of one event
FLAGS = {
    "executed": "artifact_type IN ('prefetch', 'amcache', 'lnk', 'jump_list') OR lower(event_action) IN ('process_created', 'process_exited', 'prefetch_execution', 'prefetch_last_run', 'prefetch_previous_run', 'amcache_program_seen',"
    " 'scheduled_task_suspicious_exec', 'scheduled_task_action_started', 'service_installed', 'registry_userassist_execution', 'registry_shimcache_execution')",
    "downloaded": "artifact_type IN ('browser', 'web_cache', 'onedrive_log') OR lower(event_action) LIKE '%download%'",
    "defender": "artifact_type = 'defender' OR lower(event_action) LIKE 'defender%'",
    "task": "artifact_type = 'scheduled_task' OR lower(event_action) LIKE 'scheduled_task%'",
    "registry": "artifact_type = 'registry_hive' OR lower(event_action) LIKE 'registry%'",
    "service": "lower(event_action) IN ('service_installed', 'registry_service_image')",
    "mft": "artifact_type = 'mft' OR lower(event_action) LIKE 'mft_%'",
    "usn": "artifact_type = 'usn_jrnl' OR lower(event_action) LIKE 'usn_%'",
    "deleted": "lower(event_action) LIKE '%delete%' OR lower(event_action) LIKE '%removed%'",
}
_RAN = "kind = 'file_basename' AND executed = 1 AND "
# fixed values: the titles, levels and explanations of chains, each by the first test that holds
TITLES = [
    (_RAN + "defender = 1", "Defender 検知対象の実行痕跡"), (_RAN + "downloaded = 1", "ダウンロードされたファイルが実行された"), (_RAN + "registry = 1", "Registry 永続化対象の実行痕跡"),
    (_RAN + "task = 1", "Scheduled Task と実行痕跡の連結"), (_RAN + "(usn = 1 OR deleted = 1)", "実行後に削除/変更された痕跡"), (_RAN + "service = 1", "サービス登録と実行痕跡の連結"),
    (_RAN + "mft = 1", "作成され実行されたファイル"), ("kind = 'file_basename' AND types >= 2", "複数アーティファクトに跨るファイル活動"), ("kind = 'hash'", "同一ハッシュの横断出現"),
    ("kind = 'url'", "同一URLの横断出現"), ("kind = 'ip'", "同一IPの横断出現"), ("kind = 'user_name'", "同一ユーザーの反復活動"), ("true", "同一キーの反復活動チェーン"),
]
LEVELS = [
    (_RAN + "(defender = 1 OR downloaded = 1 OR usn = 1 OR deleted = 1)", "critical"), (_RAN + "(registry = 1 OR task = 1 OR service = 1)", "high"), ("types >= 3", "high"),
    (_RAN + "mft = 1", "medium"), ("kind IN ('hash', 'url') AND types >= 2", "medium"), ("true", "low"),
]
REASONS = [
    (_RAN + "defender = 1", "Defender 検知/隔離ログと実行痕跡が同一ファイル名で連結"), (_RAN + "downloaded = 1", "ダウンロード痕跡と実行痕跡が同一ファイル名で連結"),
    (_RAN + "registry = 1", "Registry 永続化/実行痕跡が同一ファイル名で連結"), (_RAN + "task = 1", "Scheduled Task と実行痕跡が同一ファイル名で連結"),
    (_RAN + "(usn = 1 OR deleted = 1)", "実行痕跡と削除/変更痕跡が同一ファイル名で連結"), (_RAN + "service = 1", "サービス登録/実行痕跡が同一ファイル名で連結"),
    (_RAN + "mft = 1", "ファイルシステム痕跡と実行痕跡が同一ファイル名で連結"), ("types >= 2", "複数アーティファクトにまたがる活動チェーン"), ("true", "同一キーの反復活動チェーン"),
]
#: weights of the evidence in the score
WEIGHTS = {"executed": 10, "downloaded": 15, "defender": 35, "registry": 25, "task": 20, "service": 15, "usn": 20, "deleted": 20}


def correlation_chains(er: DataFrame) -> DataFrame:
    """Keys that come twice or in two types of artifact, with their evidence, title, level and score; weak files drop out unless they ran or were detected."""
    bits, types, names = type_bits(er)
    chains = keyed(er).groupBy("kind", "key").agg(
        F.count("*").alias("events"), F.countDistinct("event_id").alias("step_count"), F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen"),
        severity_max("severity").alias("max_severity"), *[F.max(F.expr(c).cast("int")).alias(n) for n, c in FLAGS.items()], *bits).withColumns({"types": types, "artifact_types": names}).drop(*[f"types{k}" for k in range(len(bits))])
    weak = (F.col("kind") == "file_basename") & (F.col("defender") == 0) & (F.col("executed") == 0) & F.regexp_extract("key", r"\.([a-z0-9]+)$", 1).isin(WEAK)
    chains = chains.where((F.col("events") >= 2) | (F.col("types") >= 2)).where(~weak)
    text = {"title": TITLES, "severity": LEVELS, "explanation": REASONS}
    return chains.withColumns({"score": chain_score(), **{n: F.expr(ladder(steps)) for n, steps in text.items()}})


def chain_score() -> Column:
    return (F.col("types") * 30 + F.least("events", F.lit(20)) + sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0)) + severity_rank("max_severity")).cast("long")


# fixed values of the lift
_SUSPICIOUS = [".exe", ".dll", ".ps1", ".bat", ".cmd", ".scr", ".hta", ".js", ".jse", ".vbs", ".wsf", "powershell", "rundll32", "regsvr32", "mshta", "mimikatz", "lsass"]
_WRITABLE = ["\\appdata\\", "/appdata/", "\\temp\\", "/temp/", "\\downloads\\", "/downloads/", "\\startup\\", "/startup/", "\\public\\", "/public/"]
_SIGNS = {
    "ran": (["prefetch", "amcache", "lnk", "jump_list", "scheduled_task", "registry_hive"], ["process_created", "prefetch_", "amcache_program_seen", "scheduled_task_exec_action", "lnk_target_reference", "registry_userassist"]),
    "on_disk": (["mft", "usn_jrnl", "windows_search_log", "jump_list", "lnk"], []), "network": (["browser", "web_cache", "network_capture", "onedrive_log", "filezilla"], []),
    "detected": (["defender"], ["defender_"]), "persistent": (["scheduled_task", "registry_hive"], ["scheduled_task", "run_key", "service_image", "persistence"]),
}
_DEEP = ["ntfs_data_run", "lnk_property_value", "prefetch_trace_chain", "prefetch_run_time"]
LIFTS = [
    (lambda c: c["detected"] & c["ran"], "critical", "Defender 検知と実行痕跡が同一キーで連結"), (lambda c: c["network"] & c["ran"] & c["suspicious"], "critical", "通信/取得痕跡と実行痕跡が同一キーで連結"),
    (lambda c: c["ran"] & c["on_disk"] & (c["suspicious"] | c["writable"]), "high", "実行痕跡とファイルシステム痕跡が高リスクキーで連結"), (lambda c: c["persistent"] & (c["ran"] | c["suspicious"]), "high", "永続化候補と実行候補が連結"),
    (lambda c: c["deep"] & (F.col("step_count") >= 2), "high", "深い構造オブジェクトが複数イベントで一致"), (lambda c: F.contains("title", F.lit("構造")) & (F.col("step_count") >= 3), "medium", "構造抽出キーが複数イベントで一致"),
]
BONUS = {"critical": 80, "high": 45, "medium": 20}
PLAIN_TITLES = ["同一キーの反復活動チェーン", "構造オブジェクトの横断一致"]


def chain_severity_lift(chains: DataFrame) -> DataFrame:
    """Raises levels, never lowers them, by what the types, the steps and the key say together; the score and the explanation follow. steps: actions of the chain, `,` between them."""
    types, steps, key = F.split("artifact_types", ","), F.lower(F.coalesce("steps", F.lit(""))), F.lower("key")
    any_of = lambda text, words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))
    c = {n: F.arrays_overlap(types, F.array(*map(F.lit, kinds))) | any_of(steps, words) for n, (kinds, words) in _SIGNS.items()}
    c["network"] = c["network"] | F.col("kind").isin("ip", "url")
    c |= {"suspicious": any_of(key, _SUSPICIOUS), "writable": any_of(key, _WRITABLE), "deep": F.startswith("kind", F.lit("artifact_object:")) & any_of(F.col("kind"), _DEEP)}
    wanted = F.coalesce(*[F.when(test(c), F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))) for test, level, reason in LIFTS])
    rows = chains.withColumn("w", wanted)
    up = F.coalesce(severity_rank("w.level") > severity_rank("severity"), F.lit(False))
    bonus = F.create_map(*[F.lit(x) for pair in BONUS.items() for x in pair])[F.col("w.level")]
    return rows.select(
        "kind", "key", F.when(up & F.col("title").isin(PLAIN_TITLES), F.col("w.reason")).otherwise(F.col("title")).alias("title"), F.when(up, F.col("w.level")).otherwise(F.col("severity")).alias("severity"),
        "events", "step_count", "first_seen", "last_seen", (F.col("score") + F.when(up, bonus).otherwise(0)).cast("long").alias("score"),
        F.when(up & ~F.contains("explanation", F.col("w.reason")), F.concat("explanation", F.lit("。4構造化補正: "), "w.reason")).otherwise(F.col("explanation")).alias("explanation"))


_OVER = ["kind", "key", "title", "severity", "artifact_types", "events", "step_count", "first_seen", "last_seen", "score", "explanation"]


def with_steps(chains: DataFrame, er: DataFrame) -> DataFrame:
    """steps: the actions of the first STEPS events in order."""
    steps = chain_steps(er).groupBy("kind", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event_action"))), lambda x: x["event_action"]), ",").alias("steps"))  # STEPS rows a key
    return chains.join(steps, ["kind", "key"], "left")


def union_chains(er: DataFrame, ef: DataFrame, limit: int | None = 100) -> DataFrame:
    """Chains of events and of objects, lifted, highest score first."""
    events = with_steps(correlation_chains(er).select(*_OVER), er)
    objects = object_chains(ef).select(*_OVER).withColumn("steps", F.regexp_replace("kind", "^artifact_object:", ""))
    out = chain_severity_lift(events.unionByName(objects)).orderBy(F.desc("score"), F.desc("events"), F.desc("last_seen"), "kind", "key")
    return out if limit is None else out.limit(limit)


def correlation_summary(er: DataFrame, limit: int | None = None) -> DataFrame:
    """One key an event by file, hash, address, user, host; keys that come twice or in two types."""
    name = F.coalesce("file_path", "process_name")
    options = [("file_basename", name != "", basename(name)), ("hash", F.col("hash") != "", F.lower("hash")), ("ip", ~blank("ip"), F.col("ip")), ("user_name", ~blank("user_name"), F.lower("user_name")), ("host", ~blank("host"), F.lower("host"))]
    rows = bulk_filter(er).withColumn("kind", F.coalesce(*[F.when(c, F.lit(k)) for k, c, _ in options])).withColumn("key", F.coalesce(*[F.when(c, v) for _, c, v in options]))
    bits, types, names = type_bits(er)
    out = rows.where(F.col("key").isNotNull() & telling()).groupBy("kind", "key").agg(
        F.count("*").alias("events"), F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen"), severity_max("severity").alias("max_severity"), *bits)
    out = out.select("kind", "key", "events", names.alias("artifact_types"), types.alias("types"), "first_seen", "last_seen", "max_severity").where("events > 1 OR types > 1")
    out = out.orderBy(F.desc("types"), F.desc("events"), F.desc("last_seen"), "kind", "key")
    return out if limit is None else out.limit(limit)


def chain_steps(er: DataFrame) -> DataFrame:
    """The first STEPS events of each chain in order. Row numbers first by part of a hot key, then of what the parts keep."""
    rows = keyed(er).select("kind", "key", "event_time_utc", "event_id", "event_action", F.pmod(F.xxhash64("event_id"), F.lit(32)).alias("part"))
    order = ["event_time_utc", "event_id"]
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("kind", "key", "part").orderBy(*order))).where(F.col("k") <= STEPS)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("kind", "key").orderBy(*order))).where(F.col("k") <= STEPS).select("kind", "key", "k", "event_id", "event_action")


def ordered_pair(er: DataFrame, first: str, then: str) -> DataFrame:
    """Keys where an event of `first` comes before one of `then`: two conditional aggregates in one grouping."""
    return (
        keyed(er).groupBy("kind", "key").agg(F.min(F.when(F.expr(first), F.col("event_time_utc"))).alias("first_time"), F.max(F.when(F.expr(then), F.col("event_time_utc"))).alias("last_time"))
        .where("first_time < last_time")
    )


def chain_rows(er: DataFrame, seconds: int = 3600, part: int = 7 * 86_400) -> DataFrame:
    """Rows of keys with the number of their session: a gap beyond the window begins a new one.

    Gaps are taken within parts of time, so a hot key spreads over tasks; the gap before a part's first event comes
    from the last event of the parts before, and a session's number from the parts' counts.
    """
    rows = keyed(er).withColumn("t", F.unix_timestamp(timestamp("event_time_utc"))).where("t IS NOT NULL").withColumn("part", F.floor(F.col("t") / part))
    within = Window.partitionBy("kind", "key", "part").orderBy("t", "event_id")
    rows = rows.withColumn("gap", F.col("t") - F.lag("t").over(within))
    parts = rows.groupBy("kind", "key", "part").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("gap") > seconds).alias("inner"))
    over = Window.partitionBy("kind", "key").orderBy("part")
    parts = parts.withColumn("opens", F.coalesce((F.col("first") - F.lag("last").over(over) > seconds).cast("int"), F.lit(1)))
    parts = parts.withColumn("before", F.sum(F.col("opens") + F.col("inner")).over(over) - F.col("inner"))
    session = F.col("before") + F.count_if(F.col("gap") > seconds).over(within)
    return rows.join(parts.select("kind", "key", "part", "before"), ["kind", "key", "part"]).withColumn("session", session)


def chain_sessions(er: DataFrame, seconds: int = 3600) -> DataFrame:
    """Sessions of a key with events of several types."""
    return chain_rows(er, seconds).groupBy("kind", "key", "session").agg(
        F.count("*").alias("events"), F.countDistinct("artifact_type").alias("types"), F.min("event_time_utc").alias("first_seen")).where("types >= 2")


#: stages of an attack in their order
STAGES = {
    "downloaded": "artifact_type = 'browser'", "created": "event_action IN ('usn_created', 'mft_created')", "executed": "event_action IN ('prefetch_execution', 'process_created')",
    "persisted": "artifact_type IN ('registry_hive', 'scheduled_task') OR event_action = 'service_installed'", "deleted": "event_action = 'usn_deleted'",
}


def stage_of() -> Column:
    """Number of the first stage that an event belongs to, from 1; null for others."""
    return F.coalesce(*[F.when(F.expr(c), k + 1) for k, c in enumerate(STAGES.values())])


def stage_names(path: Column) -> Column:
    return F.concat_ws(">", *[F.when(path.bitwiseAND(1 << k) != 0, name) for k, name in enumerate(STAGES)])


def chain_windowed(er: DataFrame, seconds: int = 3600, least: int = 2) -> DataFrame:
    """kind, key, session, events, types, first_seen, stages: sessions that go through at least so many stages in their order.

    stages: the longest way through stages of rising number by events one after the other (of equally long ones that with the latest stages). A stage
    that comes before an earlier one's only event is no part of it. For each event and stage the best way so far is a running maximum
    over one sorted session; before that, runs of one stage within a part of time shrink to their first event, so a hot session is small.
    """
    rows = chain_rows(er, seconds).withColumn("stage", stage_of())
    whole = rows.groupBy("kind", "key", "session").agg(F.count("*").alias("events"), F.countDistinct("artifact_type").alias("types"), F.min("event_time_utc").alias("first_seen"))
    run = Window.partitionBy("kind", "key", "session", "part").orderBy("t", "event_id")
    steps = rows.where("stage IS NOT NULL").withColumn("was", F.lag("stage").over(run)).where("was IS NULL OR was <> stage")
    before = Window.partitionBy("kind", "key", "session").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    wide = 1 << len(STAGES)  # a way is its length times `wide` plus a bit for each stage
    for k in range(len(STAGES)):
        best = F.greatest(F.lit(0), *[F.coalesce(F.max(f"way{j}").over(before), F.lit(0)) for j in range(k)]) if k else F.lit(0)
        steps = steps.withColumn(f"way{k}", F.when(F.col("stage") == k + 1, best + wide + (1 << k)))
    ways = steps.groupBy("kind", "key", "session").agg(F.max(F.coalesce(*[f"way{k}" for k in range(len(STAGES))])).alias("way")).where(F.col("way") >= least * wide)
    return whole.join(ways, ["kind", "key", "session"]).select("kind", "key", "session", "events", "types", "first_seen", stage_names(F.col("way")).alias("stages"))


#: techniques of chains that became findings
CHAIN_ATTACK = {"downloaded": "T1105", "deleted": "T1070.004", "registry": "T1547.001", "task": "T1053.005", "service": "T1543.003"}


def chain_to_finding(er: DataFrame) -> DataFrame:
    """Chains of medium level or more as findings; ids repeat on a repeated run."""
    attack = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(t)) for n, t in CHAIN_ATTACK.items()])), ",")
    return correlation_chains(er).where(severity_rank("severity") >= 3).select(
        F.sha2(F.concat_ws("|", F.lit("correlation"), "kind", "key"), 256).alias("finding_id"), F.lit("correlation").alias("engine"), F.concat(F.lit("correlation_"), "kind").alias("rule_id"), "title", "severity", attack.alias("techniques"), "events")


def _sql_name(c: str) -> str:
    return f"regexp_replace(lower({c}), '^.*[\\\\/]', '')"


_NAME = "coalesce(file_path, process_name)"
_OPTS = {
    "file_basename": (f"{_NAME} <> ''", _sql_name(_NAME)), "ip": ("ip NOT IN ('', '-')", "ip"), "hash": ("hash <> ''", "lower(hash)"), "url": ("url <> ''", "lower(url)"),
    "user_name": ("user_name NOT IN ('', '-')", "lower(user_name)"), "host": ("host NOT IN ('', '-')", "lower(host)"),
}
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _keyed_sql(name: str, order: list[str], least: int) -> str:
    pick = lambda k: "CASE " + " ".join(f"WHEN {_OPTS[o][0]} THEN " + (f"'{o}'" if k else _OPTS[o][1]) for o in order) + " END"
    return (
        f", {name}0 AS (SELECT *, {pick(1)} AS kind, {pick(0)} AS key FROM er WHERE artifact_type NOT IN ('mft', 'usn_jrnl') OR regexp_extract(lower({_NAME}), '\\.([a-z0-9]+)$', 1) IN ({_in(EXECUTABLE)})),"
        f" {name} AS (SELECT * FROM {name}0 WHERE length(key) >= {least} AND NOT (kind = 'file_basename' AND (key IN ({_in(NOISE)}) OR (NOT contains(key, '.') AND key NOT IN ({_in(DOTLESS)})))))"
    )


KEYED = _keyed_sql("keyed", ["file_basename", "ip", "hash", "url", "user_name"], 3)
_RANK = "CASE {} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
CHAINS = (
    KEYED + f", c0 AS (SELECT kind, key, count(DISTINCT artifact_type) AS types, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS artifact_types, count(*) AS events, count(DISTINCT event_id) AS step_count, min(event_time_utc) AS first_seen,"
    + f" max(event_time_utc) AS last_seen, {MAX_SQL} AS max_severity, " + ", ".join(f"max(CAST(({c}) AS INTEGER)) AS {n}" for n, c in FLAGS.items()) + " FROM keyed GROUP BY 1, 2 HAVING count(*) >= 2 OR count(DISTINCT artifact_type) >= 2),"
    + f" chains AS (SELECT *, CAST(30 * types + least(events, 20) + " + " + ".join(f"{w} * {n}" for n, w in WEIGHTS.items()) + f" + {_RANK.format('max_severity')} AS BIGINT) AS score, {ladder(TITLES)} AS title, {ladder(LEVELS)} AS severity, {ladder(REASONS)} AS explanation"
    + f" FROM c0 WHERE NOT (kind = 'file_basename' AND defender = 0 AND executed = 0 AND regexp_extract(key, '\\.([a-z0-9]+)$', 1) IN ({_in(WEAK)})))"
)
query("chain_keying", KEYED + " SELECT kind, count(*) AS events, count(DISTINCT key) AS keys FROM keyed GROUP BY 1")(lambda er: keyed(er).groupBy("kind").agg(F.count("*").alias("events"), F.countDistinct("key").alias("keys")))
query("chain_noise_filter", KEYED + " SELECT DISTINCT key FROM keyed WHERE kind = 'file_basename'")(lambda er: keyed(er).where("kind = 'file_basename'").select("key").distinct())
query("correlation_chains", CHAINS + " SELECT * FROM chains")(correlation_chains)
query("chain_score", CHAINS + " SELECT kind, key, score FROM chains ORDER BY score DESC, kind, key LIMIT 100")(lambda er: correlation_chains(er).select("kind", "key", "score").orderBy(F.desc("score"), "kind", "key").limit(100))
query("chain_to_finding", CHAINS + " SELECT sha256('correlation|' || kind || '|' || key) AS finding_id, 'correlation' AS engine, 'correlation_' || kind AS rule_id, title, severity, concat_ws(',', "
      + ", ".join(f"CASE WHEN {n} = 1 THEN '{t}' END" for n, t in CHAIN_ATTACK.items()) + ") AS techniques, events FROM chains WHERE severity IN ('critical', 'high', 'medium')")(chain_to_finding)
query("chain_steps", KEYED + ", r AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY event_time_utc, event_id) AS k FROM keyed) SELECT kind, key, CAST(k AS INTEGER) AS k, event_id, event_action FROM r WHERE k <= 50")(chain_steps)
query("correlation_summary", _keyed_sql("s", ["file_basename", "hash", "ip", "user_name", "host"], 0) + f" SELECT kind, key, count(*) AS events, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS artifact_types, count(DISTINCT artifact_type) AS types, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen, {MAX_SQL} AS max_severity FROM s GROUP BY 1, 2 HAVING count(*) > 1 OR count(DISTINCT artifact_type) > 1")(correlation_summary)
_LIST_OF = lambda kinds: f"list_has_any(string_split(artifact_types, ','), [{_in(kinds)}])"
_ANY = lambda text, words: "(" + " OR ".join([f"contains({text}, '{w}')" for w in words] or ["false"]) + ")"
_SIGN_SQL = ", ".join(f"({_LIST_OF(k)} OR {_ANY('lower(steps)', w)}" + (" OR kind IN ('ip', 'url')" if n == "network" else "") + f") AS {n}" for n, (k, w) in _SIGNS.items())
LIFTED = f""", st AS (SELECT kind, key, string_agg(event_action, ',' ORDER BY event_time_utc, event_id) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY event_time_utc, event_id) AS k FROM keyed) WHERE k <= {STEPS} GROUP BY 1, 2),
 u0 AS (SELECT {', '.join('c.' + c for c in _OVER)}, steps FROM chains c LEFT JOIN st USING (kind, key) UNION ALL SELECT {', '.join(_OVER)}, regexp_replace(kind, '^artifact_object:', '') FROM object_chains),
 u1 AS (SELECT *, {_SIGN_SQL}, {_ANY('lower(key)', _SUSPICIOUS)} AS suspicious, {_ANY('lower(key)', _WRITABLE)} AS writable, starts_with(kind, 'artifact_object:') AND {_ANY('kind', _DEEP)} AS deep FROM u0),
 u2 AS (SELECT *, CASE WHEN detected AND ran THEN 1 WHEN network AND ran AND suspicious THEN 2 WHEN ran AND on_disk AND (suspicious OR writable) THEN 3 WHEN persistent AND (ran OR suspicious) THEN 4 WHEN deep AND step_count >= 2 THEN 5
  WHEN contains(title, '構造') AND step_count >= 3 THEN 6 END AS w FROM u1),
 u3 AS (SELECT *, ['critical', 'critical', 'high', 'high', 'high', 'medium'][w] AS level, [{_in(r for _, _, r in LIFTS)}][w] AS reason FROM u2),
 u4 AS (SELECT *, coalesce({_RANK.format('level')} > {_RANK.format('severity')} AND level IS NOT NULL, false) AS up FROM u3),
 lifted AS (SELECT kind, key, CASE WHEN up AND title IN ({_in(PLAIN_TITLES)}) THEN reason ELSE title END AS title, CASE WHEN up THEN level ELSE severity END AS severity, events, step_count, first_seen, last_seen,
  CAST(score + CASE WHEN up THEN CASE level WHEN 'critical' THEN 80 WHEN 'high' THEN 45 ELSE 20 END ELSE 0 END AS BIGINT) AS score, CASE WHEN up AND NOT contains(explanation, reason) THEN explanation || '。4構造化補正: ' || reason ELSE explanation END AS explanation FROM u4)"""
for _n, _limit in (("chain_severity_lift", None), ("union_chains", 100)):
    query(_n, CHAINS + OBJECT_CHAINS + LIFTED + " SELECT * FROM lifted" + (f" ORDER BY score DESC, events DESC, last_seen DESC, kind, key LIMIT {_limit}" if _limit else ""), over="session")(
        lambda at, limit=_limit: union_chains(fixture.event_rows(*at), fixture.events_full(*at), limit)
    )
query("chain_event_page", KEYED + " SELECT event_id FROM keyed WHERE kind = 'file_basename' AND key = 'evil2.exe' ORDER BY event_time_utc, event_id LIMIT 101")(
    lambda er: keyed(er).where("kind = 'file_basename' AND key = 'evil2.exe'").orderBy("event_time_utc", "event_id").limit(101).select("event_id")
)
_T = "CAST(epoch(CAST(event_time_utc AS TIMESTAMP)) AS BIGINT)"
query("chain_sessions", KEYED + f""", a AS (SELECT *, {_T} - lag({_T}) OVER (PARTITION BY kind, key ORDER BY {_T}, event_id) AS gap FROM keyed),
 s AS (SELECT *, sum(CASE WHEN gap <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY kind, key ORDER BY {_T}, event_id) AS session FROM a)
 SELECT kind, key, CAST(session AS BIGINT) AS session, count(*) AS events, count(DISTINCT artifact_type) AS types, min(event_time_utc) AS first_seen FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT artifact_type) >= 2""")(chain_sessions)
_WIDE = 1 << len(STAGES)
STAGE_SQL = "CASE " + " ".join(f"WHEN {c} THEN {k + 1}" for k, c in enumerate(STAGES.values())) + " END"
_PRIOR = "(PARTITION BY kind, key, session ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
WAYS_SQL = ", ".join(
    f"w{k + 1} AS (SELECT *, CASE WHEN stage = {k + 1} THEN {_WIDE + (1 << k)} + greatest(0" + "".join(f", coalesce(max(way{j}) OVER {_PRIOR}, 0)" for j in range(k)) + f") END AS way{k} FROM w{k})" for k in range(len(STAGES))
)
query("chain_windowed", KEYED + f""", a AS (SELECT *, {_T} AS t, {_T} - lag({_T}) OVER (PARTITION BY kind, key ORDER BY {_T}, event_id) AS gap FROM keyed),
 w0 AS (SELECT *, {STAGE_SQL} AS stage, sum(CASE WHEN gap <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY kind, key ORDER BY t, event_id) AS session FROM a), {WAYS_SQL},
 g AS (SELECT kind, key, CAST(session AS BIGINT) AS session, count(*) AS events, count(DISTINCT artifact_type) AS types, min(event_time_utc) AS first_seen, max(coalesce({', '.join(f'way{k}' for k in range(len(STAGES)))})) AS way FROM w{len(STAGES)} GROUP BY 1, 2, 3)
 SELECT * EXCLUDE (way), concat_ws('>', {', '.join(f"CASE WHEN way & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(STAGES))}) AS stages FROM g WHERE way >= {2 * _WIDE}""")(chain_windowed)
_PAIRS = {
    "chain_download_execute": ("artifact_type = 'browser'", "event_action IN ('prefetch_execution', 'process_created')"), "chain_create_execute": ("event_action IN ('usn_created', 'mft_created')", "event_action IN ('prefetch_execution', 'process_created')"),
    "chain_persist_execute": ("artifact_type IN ('registry_hive', 'scheduled_task') OR event_action = 'service_installed'", "event_action IN ('prefetch_execution', 'process_created')"), "chain_defender_execute": ("artifact_type = 'defender'", "event_action IN ('prefetch_execution', 'process_created')"), "chain_execute_delete": ("event_action IN ('prefetch_execution', 'process_created')", "event_action = 'usn_deleted'"), "heur_exec_then_delete": ("event_action = 'prefetch_execution'", "event_action = 'usn_deleted'"),
}
for _name, (_a, _b) in _PAIRS.items():
    query(_name, KEYED + f" SELECT kind, key, min(CASE WHEN {_a} THEN event_time_utc END) AS first_time, max(CASE WHEN {_b} THEN event_time_utc END) AS last_time FROM keyed GROUP BY 1, 2 HAVING min(CASE WHEN {_a} THEN event_time_utc END) < max(CASE WHEN {_b} THEN event_time_utc END)")(
        lambda er, a=_a, b=_b: ordered_pair(er, a, b)
    )
