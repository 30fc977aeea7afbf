"""Rule detection and findings. Each rule becomes one Column; all rules are evaluated in one pass over the rows."""

from __future__ import annotations

import fnmatch
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import ACCOUNTS, blank, severity_max, severity_rank
from timeloom.operators.aggregates import MAX_SQL
from timeloom.plans.read_models import rebuild_event_rows, with_finding_flag
from timeloom.registry import query
from timeloom.sources import fixture
from timeloom.sources.storage import rename_part, table_path

DASHES = "–—―/"
#: channels of a log source's services
SERVICES = {
    "security": "security", "system": "system", "application": "application", "powershell": "microsoft-windows-powershell/operational", "sysmon": "microsoft-windows-sysmon/operational",
    "windefend": "microsoft-windows-windows defender/operational", "taskscheduler": "microsoft-windows-taskscheduler/operational",
}
CATEGORIES = {"process_creation": ["4688", "1"]}
_PS = ["powershell", "pwsh"]
_MP = ["set-mppreference", "add-mppreference"]


def _rule(id_: str, title: str, level: str, tags: str, selections: dict, condition=None, service: str | None = None) -> dict:
    names = list(selections)
    all_of = names[0] if len(names) == 1 else ("and", *names)
    return {"id": id_, "title": title, "level": level, "tags": [f"attack.{t}" for t in tags.split()], "logsource": {"service": service} if service else {}, "selections": selections, "condition": condition or all_of}


#: selections: a list is searched for in the message and the data, a dict tests fields (field|modifier: values); condition: how they combine.
#: The words and codes are fixed values.
RULES = [
    _rule("log_cleared", "Security log cleared", "high", "t1070.001 defense_evasion", {"s": {"EventID": ["1102"]}}, service="security"),
    _rule("wevtutil_clear", "Event log cleared by wevtutil", "high", "t1070.001 defense_evasion", {"tool": ["wevtutil"], "action": ["cl ", "clear-log", "clearlog"]}),
    _rule("lsass_minidump", "LSASS dumped through comsvcs", "critical", "t1003.001 credential_access", {"dll": ["comsvcs"], "func": ["minidump"]}),
    _rule("ntds_extraction", "NTDS.dit taken out", "critical", "t1003.003 credential_access", {"tool": ["ntdsutil"], "file": ["ntds.dit"]}, ("n of", 1, "")),
    _rule("psexec_service", "Remote execution by a PsExec service", "high", "t1569.002 execution", {"svc": ["psexesvc", "paexec", "remcomsvc"]}),
    _rule("encoded_powershell", "Encoded PowerShell", "high", "t1059.001 execution", {"ps": _PS, "enc": ["-enc", "-encodedcommand", "frombase64string", "-e jab", "-ec "]}),
    _rule("rundll32_suspicious", "Unusual rundll32", "medium", "t1218.011 defense_evasion", {"img": ["rundll32"], "susp": ["javascript:", "mshtml", ",#", "url.dll,openurl", "shell32.dll,control_rundll"]}),
    _rule("kerberoast", "Weak ticket encryption", "high", "t1558.003 credential_access", {"s": {"EventID": ["4769"], "TicketEncryptionType": ["0x17"]}, "f": {"ServiceName|contains": ["krbtgt"]}}, ("and", "s", ("not", "f")), "security"),
    _rule("asrep_roast", "Ticket without pre-authentication", "high", "t1558.004 credential_access", {"s": {"EventID": ["4768"], "PreAuthType": ["0"]}}, service="security"),
    _rule("account_created", "Account created", "medium", "t1136.001 persistence", {"s": {"EventID": ["4720"]}}, service="security"),
    _rule("group_member_added", "Member added to a privileged group", "high", "t1098 persistence", {"s": {"EventID": ["4728", "4732", "4756"]}}, service="security"),
    _rule("defender_disabled", "Defender switched off", "high", "t1562.001 defense_evasion", {"cmd": _MP, "act": ["disable", "-exclusionpath", "-exclusionextension"]}),
    _rule("mimikatz", "Traces of Mimikatz", "critical", "t1003 credential_access", {"words": ["sekurlsa", "privilege::debug", "lsadump", "dumpcreds", "kerberos::", "crypto::", "gentilkiwi"]}),
    _rule("schtasks_create", "Scheduled task created", "high", "t1053.005 execution", {"tool": ["schtasks"], "act": ["/create", "-create"]}),
    _rule("certutil_download", "Download by certutil", "high", "t1105 command_and_control", {"tool": ["certutil"], "dl": ["urlcache", "-split -f", "verifyctl"]}),
    _rule("bitsadmin_download", "Download by bitsadmin", "high", "t1197 t1105 defense_evasion", {"tool": ["bitsadmin"], "act": ["/transfer", "/addfile", "/download"]}),
    _rule("shadow_copies_deleted", "Shadow copies deleted", "critical", "t1490 impact", {"del": ["vssadmin delete shadows", "shadowcopy delete", "wbadmin delete catalog", "win32_shadowcopy", "delete shadows /all"]}),
    _rule("mshta_remote", "Script run by mshta", "high", "t1218.005 defense_evasion", {"tool": ["mshta"], "susp": ["http://", "https://", "javascript:", "vbscript:", ".hta"]}),
    _rule("regsvr32_remote", "Script run by regsvr32", "high", "t1218.010 defense_evasion", {"tool": ["regsvr32"], "susp": ["scrobj", "/i:http", "-i:http", "/i:\\\\"]}),
    _rule("wmic_process", "Process started by wmic", "medium", "t1047 execution", {"tool": ["wmic"], "act": ["process call create", "process call", "/node:"]}),
    _rule("powershell_cradle", "PowerShell download", "high", "t1059.001 t1105 execution", {"ps": _PS, "dl": ["downloadstring", "downloadfile", "invoke-webrequest", "net.webclient", "start-bitstransfer", "iex(", "invoke-expression"]}),
    _rule("run_key", "Run key set", "high", "t1547.001 persistence", {"key": ["currentversion\\run", "currentversion\\runonce", "currentversion/run"], "op": ["reg add", "reg.exe add", "new-itemproperty", "set-itemproperty"]}),
    _rule("defender_exclusion", "Defender exclusion added", "high", "t1562.001 defense_evasion", {"cmd": _MP, "excl": ["exclusionpath", "exclusionextension", "exclusionprocess"]}),
    _rule("localgroup_admin", "Administrator added by net localgroup", "high", "t1098 persistence", {"tool": ["localgroup"], "grp": ["administrators", "administradores", "administratoren"], "act": ["/add"]}),
    _rule("service_installed", "Service installed", "medium", "t1543.003 persistence", {"s": {"EventID": ["7045"]}, "n": {"ServiceName": [None]}}, ("and", "s", ("not", "n"))),
]


def load_rules(spark: SparkSession, folder: str) -> list[dict]:
    """Rules of all files of a folder of the store, in the order of their names: JSON lists, and the documents of YAML files where the library for
    it is there. Conditions are nested lists. Rules are written by people, so their number is small; files over a megabyte are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower("path").rlike(r"\.(json|ya?ml)$")).select("path", "length", F.when(F.col("length") <= 1 << 20, F.col("content")).alias("content")).orderBy("path")
    rules = []
    for path, size, content in files.collect():
        if content is None:
            raise UnsupportedRule(f"{path} has {size} bytes")
        text = bytes(content).decode()
        if path.lower().endswith(".json"):
            found = json.loads(text)
            rules += found if isinstance(found, list) else [found]
            continue
        try:
            import yaml
        except ImportError as e:
            raise UnsupportedRule("no YAML library") from e
        rules += [r for r in yaml.safe_load_all(text) if r]
    return rules


class UnsupportedRule(ValueError):
    """A rule that can't be compiled is skipped whole and counted."""


def field(name: str) -> Column:
    """A value of the event data, its key without regard to case; else the column of that meaning."""
    data = F.transform_keys(F.from_json(F.get_json_object("attributes_json", "$.data"), "map<string,string>"), lambda k, _: F.lower(k))
    alias = {"commandline": "command_line", "image": "process_name", "eventid": "event_code", "channel": "channel", "computer": "host", "user": "user_name"}.get(name.lower())
    value = F.element_at(data, name.lower()) if alias is None else F.coalesce(F.element_at(data, name.lower()), F.col(alias))
    return value


def _test(value: Column, how: str, text) -> Column:
    if text is None:
        return F.coalesce(value, F.lit("")) == ""
    low, t = F.lower(F.coalesce(value, F.lit(""))), str(text).lower()
    if how == "re":
        try:
            re.compile(str(text))
        except re.error as e:
            raise UnsupportedRule(str(e)) from e
        return F.coalesce(value, F.lit("")).rlike(f"(?i){text}")
    tests = {"": low == t, "contains": F.contains(low, F.lit(t)), "startswith": F.startswith(low, F.lit(t)), "endswith": F.endswith(low, F.lit(t))}
    return tests[how]


def rule_text() -> Column:
    """What keywords are searched in."""
    return F.lower(F.concat_ws(" ", "message_full", F.array_join(F.map_values(F.from_json(F.get_json_object("attributes_json", "$.data"), "map<string,string>")), " ")))


def log_source(source: dict) -> Column:
    """service: its channel, without regard to case; category: its event codes."""
    if unknown := set(source) - {"service", "category", "product"}:
        raise UnsupportedRule(f"log source {sorted(unknown)}")
    out = F.lit(True)
    if service := source.get("service"):
        if service.lower() not in SERVICES:
            raise UnsupportedRule(f"service {service}")
        out = out & (F.lower("channel") == SERVICES[service.lower()])
    if category := source.get("category"):
        if category not in CATEGORIES:
            raise UnsupportedRule(f"category {category}")
        out = out & F.col("event_code").isin(CATEGORIES[category])
    return out


def selection(tests: dict | list) -> Column:
    if isinstance(tests, list):
        return reduce(lambda a, b: a | b, [F.contains("rule_text", F.lit(str(t).lower())) for t in tests])
    parts = []
    for key, values in tests.items():
        name, *mods = key.split("|")
        if unknown := set(mods) - {"contains", "startswith", "endswith", "re", "all", "windash", "cased"}:
            raise UnsupportedRule(f"modifier {sorted(unknown)}")
        how = next((m for m in mods if m in ("contains", "startswith", "endswith", "re")), "")
        value = F.translate(field(name), DASHES, "-" * len(DASHES)) if "windash" in mods else field(name)
        each = [_test(value, how, v) for v in values]
        parts.append(reduce((lambda a, b: a & b) if "all" in mods else (lambda a, b: a | b), each))
    return reduce(lambda a, b: a & b, parts)


def compile_rule(rule: dict) -> Column:
    """condition: True, a selection's name, (and | or, ...), (not, x), (n of, n, names), (all of, names)."""
    named = {k: selection(v) for k, v in rule["selections"].items()}

    def walk(c) -> Column:
        if c is True:
            return F.lit(True)
        if isinstance(c, str):
            if c not in named:
                raise UnsupportedRule(f"no selection {c}")
            return named[c]
        op, *rest = list(c)
        if op == "not":
            return ~walk(rest[0])
        if op in ("and", "or"):
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), map(walk, rest))
        if op in ("n of", "all of"):  # the last is a name with `*`, the beginning of names, or `them`
            pattern = "*" if rest[-1] == "them" else rest[-1] if "*" in rest[-1] else rest[-1] + "*"
            own = [v for k, v in named.items() if fnmatch.fnmatchcase(k, pattern)]
            if op == "all of":
                return reduce(lambda a, b: a & b, own, F.lit(True))
            return sum((F.coalesce(v, F.lit(False)).cast("int") for v in own), F.lit(0)) >= rest[0]
        raise UnsupportedRule(f"condition {op}")

    return log_source(rule.get("logsource") or {}) & F.coalesce(walk(rule["condition"]), F.lit(False))


def tags(rule: dict) -> tuple[list[str], list[str]]:
    """Techniques (upper case) and tactics."""
    short = [t.removeprefix("attack.") for t in rule["tags"]]
    return [t.upper() for t in short if re.fullmatch(r"t\d{4}(\.\d{3})?", t)], [t for t in short if not re.match(r"t\d", t)]


def compile_rules(rules: list[dict]) -> tuple[list[tuple[dict, Column]], list[tuple[str, str]]]:
    """(rule, Column) of those that compile, (id, reason) of those skipped."""
    good, bad = [], []
    for r in rules:
        try:
            good.append((r, compile_rule(r)))
        except UnsupportedRule as e:
            bad.append((r["id"], str(e)))
    return good, bad


def sigma_eval(er: DataFrame, rules: list[dict] = RULES) -> DataFrame:
    """A finding per rule and event; ids repeat on a repeated run."""
    good, _ = compile_rules(rules)
    hits = []
    for r, c in good:
        techniques, tactics = tags(r)
        values = {"rule_id": F.lit(r["id"]), "title": F.lit(r["title"]), "severity": F.lit(r["level"]), "techniques": F.array(*map(F.lit, techniques)), "tactics": F.array(*map(F.lit, tactics))}
        hits.append(F.when(c, F.struct(*[v.alias(k) for k, v in values.items()])))
    logs = er.where(F.col("artifact_type").isin("evtx", "hayabusa")).withColumn("rule_text", rule_text())
    kept = ["event_id", "event_time_utc", "host", "user_name", "process_name"]
    rows = logs.select("case_id", "message_short", *kept, F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("sigma"), "f.rule_id", "event_id"), 256).alias("finding_id"), *kept, "f.*", "case_id", F.lit("sigma").alias("engine"),
        F.concat("f.title", F.lit(": "), "message_short").alias("description"))


ENTITIES = {"host": "host", "user": "user_name", "process": "process_name"}


GROUP = ["case_id", "title", "severity", "engine", "rule_id"]


def finding_summary(findings: DataFrame, entities: int = 24) -> DataFrame:
    """A row per case, title, severity, engine and rule with its affected entities, the first of them in order; highest level first."""
    groups = findings.groupBy(*GROUP).agg(
        F.count("*").alias("findings"), F.countDistinct("event_id").alias("events"), F.min("event_time_utc").alias("first_seen"),
        F.max("event_time_utc").alias("last_seen"), F.min("event_id").alias("sample"), F.min_by("description", "event_id").alias("description"), F.first("techniques").alias("techniques"))
    named = F.explode(F.array_compact(F.array(*[F.when(~blank(c), F.concat(F.lit(f"{k}:"), c)) for k, c in ENTITIES.items()]))).alias("entity")
    each = findings.select(*GROUP, named).distinct().withColumn("k", F.row_number().over(Window.partitionBy(*GROUP).orderBy("entity"))).where(F.col("k") <= entities)
    listed = each.groupBy(*GROUP).agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    out = groups.join(listed, GROUP, "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    return out.orderBy(severity_rank("severity").desc(), F.desc("findings"), F.desc("last_seen"), "rule_id", "case_id")


def related_findings(groups: DataFrame, most: int = 6) -> DataFrame:
    """rule_id, related: groups that share a technique or a host, through an equi-join of the keys; the highest `most` of each."""
    keys = F.explode(F.array_distinct(F.concat("techniques", F.filter("entities", lambda e: F.startswith(e, F.lit("host:")))))).alias("shared")
    left = groups.select("rule_id", keys)
    right = groups.select(F.col("rule_id").alias("related"), severity_rank("severity").alias("rank"), "findings", keys)
    pairs = left.join(right, "shared").where("rule_id <> related").select("rule_id", "related", "rank", "findings").distinct()
    order = Window.partitionBy("rule_id").orderBy(F.desc("rank"), F.desc("findings"), "related")
    return pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("rule_id", "related")


def finding_confidence(engine: Column, described: Column, entities: Column, events: Column) -> Column:
    """high from four points on, medium from two."""
    points = F.when(engine.isin("sigma", "ioc", "hayabusa"), 2).when(engine == "correlation", 1).otherwise(0) + described.cast("int") + (entities > 0).cast("int") + (events >= 5).cast("int")
    return F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")


def affected_entities(groups: DataFrame) -> DataFrame:
    """hosts, users and processes of a group's entities."""
    own = lambda k: F.array_join(F.transform(F.filter("entities", lambda e: F.startswith(e, F.lit(f"{k}:"))), lambda e: F.substring(e, len(k) + 2, 10_000)), ",").alias({"host": "hosts", "user": "users", "process": "processes"}[k])
    return groups.select("rule_id", *map(own, ENTITIES))


# fixed values: names of techniques
TECHNIQUES = {
    "T1003": "資格情報ダンプ", "T1003.001": "LSASS メモリ", "T1003.003": "NTDS", "T1027": "難読化", "T1036": "マスカレード", "T1047": "WMI", "T1053": "スケジュールタスク", "T1053.005": "スケジュールタスク",
    "T1055": "プロセスインジェクション", "T1059": "コマンド/スクリプト実行", "T1059.001": "PowerShell", "T1059.003": "Windows コマンドシェル", "T1070": "痕跡消去", "T1070.001": "Windows イベントログ消去",
    "T1070.004": "ファイル削除", "T1070.006": "タイムストンプ", "T1071": "アプリ層プロトコル C2", "T1098": "アカウント操作", "T1105": "ツール転送(ダウンロード)", "T1112": "レジストリ改ざん",
    "T1136": "アカウント作成", "T1136.001": "ローカルアカウント作成", "T1197": "BITS ジョブ", "T1204": "ユーザー実行", "T1218": "署名済バイナリ悪用(LOLBin)", "T1218.005": "Mshta", "T1218.010": "Regsvr32",
    "T1218.011": "Rundll32", "T1490": "シャドウコピー削除", "T1543": "サービス作成", "T1543.003": "Windows サービス", "T1547": "自動起動(永続化)", "T1547.001": "Run キー / スタートアップ",
    "T1548": "昇格制御バイパス(UAC)", "T1558.003": "Kerberoasting", "T1558.004": "AS-REP Roasting", "T1562": "防御回避(無効化)", "T1562.001": "防御ツールの無効化", "T1569": "システムサービス",
    "T1569.002": "サービス実行",
}


def attack_names(rows: DataFrame) -> DataFrame:
    """technique, name (the id itself where it isn't known) and address of each technique of rows (technique)."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(TECHNIQUES.items()), "technique string, name string")  # 40 rows
    url = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(F.upper(F.trim("technique")), F.lit("."), F.lit("/")), F.lit("/"))
    return rows.select("technique").distinct().join(F.broadcast(names), "technique", "left").select("technique", F.coalesce("name", "technique").alias("name"), url.alias("url"))


def risk_summary(findings: DataFrame) -> DataFrame:
    each = findings.withColumn("technique", F.explode(F.when(F.size("techniques") > 0, F.col("techniques")).otherwise(F.array(F.lit("unclassified")))))
    return each.groupBy("technique").agg(F.count("*").alias("findings"), F.countDistinct("event_id").alias("events"), severity_max("severity").alias("max_severity"), F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen"))


def finding_by_event(findings: DataFrame) -> DataFrame:
    """Of each event: the highest severity, up to 8 titles and up to 10 techniques of its findings, in order."""
    titles = F.slice(F.sort_array(F.collect_set("title")), 1, 8)
    techniques = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("techniques")))), 1, 10)
    return findings.groupBy("event_id").agg(severity_max("severity").alias("max_severity"), F.array_join(titles, "; ").alias("titles"), F.array_join(techniques, ",").alias("techniques"))


def finding_score(rank: Column, techniques: Column, events: Column) -> Column:
    return rank * 1000 + techniques * 40 + 20 + F.greatest(F.lit(0), F.floor(70 - 8 * F.log2(events + 1) + 0.5))


def finding_bucket(engine: Column) -> Column:
    return F.when(engine.isin("sigma", "ioc", "yara"), "rule").otherwise("suggest")


def next_action(tactics: Column) -> Column:
    steps = [("credential_access", "reset credentials"), ("persistence", "remove persistence"), ("command_and_control", "block traffic"), ("defense_evasion", "collect logs")]
    return F.coalesce(*[F.when(F.array_contains(tactics, t), F.lit(s)) for t, s in steps], F.lit("review"))


def with_overrides(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """findings (finding_id, engine, rule_id, title, severity, ...) after overrides (override_id, engine, rule_id, title, action, severity, enabled, created_at).

    An override applies where its engine, rule and title equal the finding's, a null one to all. Of the enabled ones that apply the last
    decides (by created_at, then override_id): it suppresses the finding or sets its severity; other actions change nothing. Overrides
    are joined once for each set of columns that some of them leave null, on those they name, so no wildcard is a cross join.
    """
    names = ["engine", "rule_id", "title"]
    order = F.struct("created_at", "override_id").alias("at")
    live = overrides.where("enabled").select(*names, F.struct(order, "action", F.col("severity").alias("level")).alias("o"))
    found = []
    for mask in range(1 << len(names)):
        own = [n for k, n in enumerate(names) if mask >> k & 1]
        some = live.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() if n in own else F.col(n).isNull() for n in names]))
        if own:
            last = some.groupBy(*own).agg(F.max("o").alias("o"))
            found.append(findings.select("finding_id", *own).join(last, own).select("finding_id", "o"))
        else:
            found.append(findings.select("finding_id").crossJoin(F.broadcast(some.agg(F.max("o").alias("o")))).where("o IS NOT NULL"))  # one row
    last = reduce(DataFrame.unionByName, found).groupBy("finding_id").agg(F.max("o").alias("o"))
    joined = findings.join(last, "finding_id", "left").where("o IS NULL OR o.action <> 'suppress'")
    return joined.withColumn("severity", F.when(F.col("o.action") == "set_severity", F.coalesce("o.level", "severity")).otherwise(F.col("severity"))).drop("o")


def _field_sql(name: str) -> str:
    data = f"json_extract_string(attributes_json, '$.data.{name}')"
    alias = {"CommandLine": "command_line", "Image": "process_name", "EventID": "event_code"}.get(name)
    return f"coalesce({data}, {alias})" if alias else data


def _selection_sql(tests) -> str:
    if isinstance(tests, list):
        return "(" + " OR ".join(f"contains(rule_text, '{t}')" for t in tests) + ")"
    forms = {"": "lower({}) = '{}'", "contains": "contains(lower({}), '{}')"}
    each = lambda key, v: f"coalesce({_field_sql(key.split('|')[0])}, '') = ''" if v is None else forms["".join(key.split("|")[1:])].format(f"coalesce({_field_sql(key.split('|')[0])}, '')", v.lower())
    return "(" + " AND ".join("(" + " OR ".join(each(k, v) for v in values) + ")" for k, values in tests.items()) + ")"


def _rule_sql(rule: dict) -> str:
    named = {k: _selection_sql(v) for k, v in rule["selections"].items()}

    def walk(c) -> str:
        if isinstance(c, str):
            return named[c]
        if c[0] == "not":
            return f"NOT {walk(c[1])}"
        if c[0] == "n of":
            return "(" + " + ".join(f"CAST({v} AS INTEGER)" for v in named.values()) + f") >= {c[1]}"
        return "(" + f" {c[0].upper()} ".join(map(walk, c[1:])) + ")"

    source = f"lower(channel) = '{rule['logsource']['service']}' AND " if rule["logsource"] else ""
    return source + walk(rule["condition"])


_RULE_SQL = {r["id"]: _rule_sql(r) for r in RULES}
_TECH = {r["id"]: tags(r) for r in RULES}
FINDINGS = ", fr AS (SELECT *, lower(concat_ws(' ', message_full, array_to_string(json_extract_string(attributes_json, '$.data.*'), ' '))) AS rule_text FROM er WHERE artifact_type IN ('evtx', 'hayabusa')), findings AS (" + " UNION ALL ".join(
    f"SELECT sha256('sigma|{r['id']}|' || event_id) AS finding_id, event_id, event_time_utc, host, user_name, process_name, '{r['id']}' AS rule_id, '{r['title']}' AS title, '{r['level']}' AS severity, {_TECH[r['id']][0]} AS techniques, {_TECH[r['id']][1]} AS tactics, case_id, 'sigma' AS engine, '{r['title']}: ' || message_short AS description FROM fr WHERE {_RULE_SQL[r['id']]}"
    for r in RULES
) + ")"
_F = lambda name, sql: query(name, FINDINGS + sql)
_F("sigma_eval", " SELECT finding_id, event_id, rule_id, title, severity FROM findings")(lambda er: sigma_eval(er).select("finding_id", "event_id", "rule_id", "title", "severity"))
_one = lambda i, tests: {"id": i, "title": i, "level": "low", "tags": [], "logsource": {}, "selections": {"s": tests}, "condition": "s"}
#: a rule for each modifier, and its test in the oracle's SQL
_MODIFIERS = [
    (_one("equals", {"EventID": ["4688", "1102"]}), "event_code IN ('4688', '1102')"), (_one("contains", {"CommandLine|contains": ["URLCACHE", "lsadump"]}), "contains(c, 'urlcache')"),
    (_one("contains_all", {"CommandLine|contains|all": ["certutil", "http"]}), "contains(c, 'certutil') AND contains(c, 'http')"), (_one("startswith", {"CommandLine|startswith": ["PowerShell", "mshta"]}), "starts_with(c, 'powershell') OR starts_with(c, 'mshta')"),
    (_one("endswith", {"CommandLine|endswith": ["/ALL", ".txt"]}), "ends_with(c, '/all') OR ends_with(c, '.txt')"), (_one("re", {"CommandLine|re": [r"^(cmd|net)\s", r"dump\s+\d{3}"]}), r"regexp_matches(c, '^(cmd|net)\s') OR regexp_matches(c, 'dump\s+\d{3}')"),
    (_one("windash", {"CommandLine|windash|contains": ["-urlcache", "-enc"]}), "contains(c, '-urlcache') OR contains(c, '-enc') OR contains(c, '/urlcache')"), (_one("null", {"MemberName": [None]}), "coalesce(json_extract_string(attributes_json, '$.data.MemberName'), '') = ''"),
    (_one("cased", {"TargetUserName|cased": ["USER3"]}), "lower(json_extract_string(attributes_json, '$.data.TargetUserName')) = 'user3'"),
    (_one("two_fields", {"EventID": ["4625"], "TargetUserName|endswith": ["1"]}), "event_code = '4625' AND ends_with(json_extract_string(attributes_json, '$.data.TargetUserName'), '1')"),
]
_F("sigma_modifiers", ", m AS (SELECT *, lower(coalesce(json_extract_string(attributes_json, '$.data.CommandLine'), command_line, '')) AS c FROM fr) " + " UNION ALL ".join(f"SELECT event_id, '{r['id']}' AS rule_id FROM m WHERE {test}" for r, test in _MODIFIERS))(
    lambda er: sigma_eval(er, [r for r, _ in _MODIFIERS]).select("event_id", "rule_id")
)
_F("sigma_tags", " SELECT DISTINCT rule_id, array_to_string(techniques, ',') AS techniques, array_to_string(tactics, ',') AS tactics FROM findings")(lambda er: sigma_eval(er).select("rule_id", F.array_join("techniques", ",").alias("techniques"), F.array_join("tactics", ",").alias("tactics")).distinct())
SUMMARY = FINDINGS + f""", en AS (SELECT DISTINCT rule_id, unnest([{', '.join(f"CASE WHEN {c} NOT IN ('', '-') THEN '{k}:' || {c} END" for k, c in ENTITIES.items())}]) AS entity FROM findings),
 el AS (SELECT rule_id, list(entity ORDER BY entity)[1:24] AS entities FROM en WHERE entity IS NOT NULL GROUP BY 1),
 groups AS (SELECT case_id, title, severity, engine, rule_id, count(*) AS findings, count(DISTINCT event_id) AS events, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen, min(event_id) AS sample,
  arg_min(description, event_id) AS description, first(techniques) AS techniques, coalesce(first(entities), []) AS entities FROM findings LEFT JOIN el USING (rule_id) GROUP BY 1, 2, 3, 4, 5)"""
_groups = lambda er: finding_summary(sigma_eval(er))
_flat = lambda: [F.array_join("techniques", ",").alias("techniques"), F.array_join("entities", ",").alias("entities")]
_S = lambda name, sql: query(name, SUMMARY + sql)
_S("finding_summary", " SELECT * REPLACE (array_to_string(techniques, ',') AS techniques, array_to_string(entities, ',') AS entities) FROM groups")(lambda er: _groups(er).select("case_id", "rule_id", "title", "severity", "findings", "events", "first_seen", "last_seen", "sample", "description", "engine", *_flat()))
_S("related_findings", """, k AS (SELECT DISTINCT rule_id, severity, findings, unnest(list_concat(techniques, list_filter(entities, lambda e: starts_with(e, 'host:')))) AS shared FROM groups),
 p AS (SELECT DISTINCT a.rule_id, b.rule_id AS related, CASE b.severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS rank, b.findings FROM k a JOIN k b ON a.shared = b.shared AND a.rule_id <> b.rule_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY rank DESC, findings DESC, related) AS n FROM p) SELECT rule_id, related FROM r WHERE n <= 6""")(lambda er: related_findings(_groups(er)))
_S("finding_confidence", " SELECT rule_id, CASE WHEN 2 + 1 + CAST(len(entities) > 0 AS INTEGER) + CAST(events >= 5 AS INTEGER) >= 4 THEN 'high' ELSE 'medium' END AS confidence FROM groups")(
    lambda er: _groups(er).select("rule_id", finding_confidence(F.col("engine"), F.col("title") != "", F.size("entities"), F.col("events")).alias("confidence"))
)
_S("affected_entities", " SELECT rule_id, " + ", ".join(f"array_to_string(list_transform(list_filter(entities, lambda e: starts_with(e, '{k}:')), lambda e: substr(e, {len(k) + 2})), ',') AS {n}" for k, n in (("host", "hosts"), ("user", "users"), ("process", "processes"))) + " FROM groups")(lambda er: affected_entities(_groups(er)))
_S("finding_bucket", " SELECT rule_id, CASE WHEN engine IN ('sigma', 'ioc', 'yara') THEN 'rule' ELSE 'suggest' END AS bucket FROM groups")(lambda er: _groups(er).select("rule_id", finding_bucket(F.col("engine")).alias("bucket")))
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in TECHNIQUES.items())
_F("attack_name_lookup", f", n(technique, name) AS (VALUES {_NAMES}), t AS (SELECT DISTINCT unnest(techniques) AS technique FROM findings) SELECT technique, coalesce(name, technique) AS name, 'https://attack.mitre.org/techniques/' || replace(technique, '.', '/') || '/' AS url FROM t LEFT JOIN n USING (technique)")(
    lambda er: attack_names(sigma_eval(er).select(F.explode("techniques").alias("technique")))
)
_F("sigma_bundled_rules", " SELECT rule_id, title, severity, count(*) AS findings, min(event_id) AS first_event FROM findings GROUP BY 1, 2, 3")(lambda er: sigma_eval(er).groupBy("rule_id", "title", "severity").agg(F.count("*").alias("findings"), F.min("event_id").alias("first_event")))
_F("sigma_logsource", " SELECT event_id FROM er WHERE lower(channel) = 'security' AND event_code IN ('4688', '1')")(lambda er: er.where(log_source({"service": "Security", "category": "process_creation"})).select("event_id"))
_F("sigma_keywords", " SELECT event_id FROM fr WHERE contains(rule_text, 'sekurlsa') OR contains(rule_text, 'whoami')")(lambda er: er.where("artifact_type = 'evtx'").withColumn("rule_text", rule_text()).where(selection(["Sekurlsa", "WHOAMI"])).select("event_id"))
_F("sigma_field_resolve", " SELECT event_id, coalesce(json_extract_string(attributes_json, '$.data.TargetUserName'), '') AS target, command_line AS command, event_code AS code FROM fr")(
    lambda er: er.where("artifact_type IN ('evtx', 'hayabusa')").select("event_id", F.coalesce(field("targetUSERname"), F.lit("")).alias("target"), F.nullif(F.coalesce(F.when(F.col("command_line").isNotNull(), field("COMMANDLINE")), F.lit("")), F.lit("")).alias("command"), field("EventID").alias("code"))
)
_CUSTOM = [
    {"id": "any_two", "title": "t", "level": "low", "tags": [], "logsource": {}, "selections": {"sel_a": ["powershell"], "sel_b": ["-enc"], "sel_c": ["whoami"]}, "condition": ["n of", 2, "sel_"]},
    {"id": "all_but", "title": "t", "level": "low", "tags": [], "logsource": {"category": "process_creation"}, "selections": {"k_a": ["cmd"], "k_b": ["whoami"], "f": {"CommandLine|endswith": ["x"]}}, "condition": ["and", ["all of", "k_"], ["not", "f"]]},
    {"id": "bad_modifier", "title": "t", "level": "low", "tags": [], "logsource": {}, "selections": {"s": {"CommandLine|base64": ["x"]}}, "condition": "s"},
    {"id": "bad_selection", "title": "t", "level": "low", "tags": [], "logsource": {}, "selections": {"s": ["x"]}, "condition": "z"},
]
_THEM = {"id": "one_of_them", "title": "t", "level": "low", "tags": [], "logsource": {}, "selections": {"x": ["vssadmin"], "y": ["notepad"]}, "condition": ["n of", 1, "them"]}
_TWO = "(CAST(contains(rule_text, 'powershell') AS INTEGER) + CAST(contains(rule_text, '-enc') AS INTEGER) + CAST(contains(rule_text, 'whoami') AS INTEGER)) >= 2"
_ALL = "event_code IN ('4688', '1') AND contains(rule_text, 'cmd') AND contains(rule_text, 'whoami') AND NOT ends_with(lower(command_line), 'x')"
_F("sigma_condition", f" SELECT event_id, 'any_two' AS rule_id FROM fr WHERE {_TWO} UNION ALL SELECT event_id, 'all_but' FROM fr WHERE {_ALL} UNION ALL SELECT event_id, 'one_of_them' FROM fr WHERE contains(rule_text, 'vssadmin') OR contains(rule_text, 'notepad')")(
    lambda er: sigma_eval(er, [*_CUSTOM, _THEM]).select("event_id", "rule_id")
)


def _from_folder(er: DataFrame) -> DataFrame:
    """Rules written as two files and read again."""
    spark = er.sparkSession
    folder = table_path(spark, "rules")
    for name, rules in (("a", _CUSTOM[:1]), ("b", _CUSTOM[1:])):
        spark.createDataFrame([(json.dumps(rules),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    for name in ("a", "b"):
        rename_part(spark, f"{folder}/{name}", f"{folder}/{name}.json")
    return sigma_eval(er, load_rules(spark, folder))


_F("sigma_custom_rules", f" SELECT event_id, rule_id, severity FROM (SELECT event_id, 'any_two' AS rule_id, 'low' AS severity FROM fr WHERE {_TWO} UNION ALL SELECT event_id, 'all_but', 'low' FROM fr WHERE {_ALL})")(lambda er: _from_folder(er).select("event_id", "rule_id", "severity"))
_F("sigma_skip_unsupported", " SELECT r.id AS rule_id, r.reason, count(*) AS rows_kept_from FROM fr, (VALUES ('bad_modifier', 'modifier [''base64'']'), ('bad_selection', 'no selection z')) r(id, reason) GROUP BY 1, 2")(
    lambda er: er.where("artifact_type IN ('evtx', 'hayabusa')").agg(F.count("*").alias("rows_kept_from")).select(F.inline(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(r).alias("reason")) for i, r in compile_rules(_CUSTOM)[1]])), "rows_kept_from")
)
#: id, engine, rule, title, action, severity, enabled, time
_OVERRIDES = [
    ("o1", "sigma", "kerberoast", None, "suppress", None, True, "2024-01-01"), ("o2", None, "account_created", None, "suppress", None, True, "2024-01-01"), ("o3", None, "account_created", None, "set_severity", "critical", True, "2024-01-02"),
    ("o4", None, None, "Service installed", "set_severity", "low", True, "2024-01-03"), ("o5", "sigma", None, None, "set_severity", "info", True, "2023-01-01"), ("o6", None, None, None, "suppress", None, False, "2025-01-01"),
    ("o7", "ioc", None, None, "suppress", None, True, "2025-01-01"), ("o8", "sigma", "log_cleared", "Other title", "suppress", None, True, "2025-01-01"), ("o9", "sigma", "service_installed", "Service installed", "note", None, True, "2024-01-04"),
]
_OVERRIDE_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in o) + ")" for o in _OVERRIDES)
_F("finding_overrides", f""", o(override_id, engine, rule_id, title, action, level, enabled, created_at) AS (VALUES {_OVERRIDE_ROWS}),
 m AS (SELECT f.*, o.action, o.level, row_number() OVER (PARTITION BY f.finding_id ORDER BY o.created_at DESC, o.override_id DESC) AS n
  FROM findings f LEFT JOIN o ON o.enabled AND coalesce(o.engine, 'sigma') = 'sigma' AND coalesce(o.rule_id, f.rule_id) = f.rule_id AND coalesce(o.title, f.title) = f.title)
 SELECT finding_id, rule_id, CASE WHEN action = 'set_severity' THEN coalesce(level, severity) ELSE severity END AS severity FROM m WHERE n = 1 AND coalesce(action, '') <> 'suppress'""")(
    lambda er: with_overrides(sigma_eval(er), er.sparkSession.createDataFrame(_OVERRIDES, "override_id string, engine string, rule_id string, title string, action string, severity string, enabled boolean, created_at string")).select("finding_id", "rule_id", "severity")
)
_F("rebuild_with_findings", " SELECT event_id, event_time_utc, artifact_type, event_action, severity, event_id IN (SELECT event_id FROM findings) AS has_finding FROM er")(
    lambda er: with_finding_flag(er, sigma_eval(er)).orderBy("event_time_utc", "event_id").select("event_id", "event_time_utc", "artifact_type", "event_action", "severity", "has_finding")
)
_F("risk_summary", f" SELECT technique, count(*) AS findings, count(DISTINCT event_id) AS events, {MAX_SQL} AS max_severity, min(event_time_utc) AS first_seen, max(event_time_utc) AS last_seen FROM (SELECT *, unnest(techniques) AS technique FROM findings) GROUP BY 1")(lambda er: risk_summary(sigma_eval(er)))
_F("risk_donut", f", t AS (SELECT technique, {MAX_SQL} AS s FROM (SELECT *, unnest(techniques) AS technique FROM findings) GROUP BY 1) SELECT s AS max_severity, count(*) AS techniques FROM t GROUP BY 1")(lambda er: risk_summary(sigma_eval(er)).groupBy("max_severity").agg(F.count("*").alias("techniques")))
_F("finding_by_event", f""" SELECT event_id, {MAX_SQL} AS max_severity, array_to_string(list_sort(list(DISTINCT title))[1:8], '; ') AS titles,
 coalesce(array_to_string(list_sort(list_distinct(flatten(list(techniques))))[1:10], ','), '') AS techniques FROM findings GROUP BY 1""")(lambda er: finding_by_event(sigma_eval(er)))
_F("has_finding_flag", " SELECT event_id, event_id IN (SELECT event_id FROM findings) AS has_finding FROM er")(
    lambda er: with_finding_flag(er, sigma_eval(er)).select("event_id", "has_finding")
)
_F("finding_event_page", " SELECT event_id FROM er WHERE event_id IN (SELECT event_id FROM findings WHERE rule_id = 'kerberoast') ORDER BY event_time_utc, event_id LIMIT 101")(
    lambda er: er.join(sigma_eval(er).where("rule_id = 'kerberoast'").select("event_id"), "event_id", "left_semi").orderBy("event_time_utc", "event_id").limit(101).select("event_id")
)
_F("finding_score", f", s AS (SELECT rule_id, max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS r, max(len(techniques)) AS t, count(DISTINCT event_id) AS e FROM findings GROUP BY 1) SELECT rule_id, CAST(1000 * r + 40 * t + 20 + greatest(0, floor(70 - 8 * log2(e + 1) + 0.5)) AS BIGINT) AS score FROM s")(
    lambda er: sigma_eval(er).groupBy("rule_id").agg(F.max(severity_rank("severity")).alias("r"), F.max(F.size("techniques")).alias("t"), F.countDistinct("event_id").alias("e")).select("rule_id", finding_score(F.col("r"), F.col("t"), F.col("e")).cast("long").alias("score"))
)
_F("findings_by_severity", " SELECT severity, count(*) AS findings FROM findings GROUP BY 1")(lambda er: sigma_eval(er).groupBy("severity").agg(F.count("*").alias("findings")))
_F("next_action", " SELECT DISTINCT rule_id, CASE WHEN list_contains(tactics, 'credential_access') THEN 'reset credentials' WHEN list_contains(tactics, 'persistence') THEN 'remove persistence' WHEN list_contains(tactics, 'command_and_control') THEN 'block traffic' WHEN list_contains(tactics, 'defense_evasion') THEN 'collect logs' ELSE 'review' END AS action FROM findings")(
    lambda er: sigma_eval(er).select("rule_id", next_action(F.col("tactics")).alias("action")).distinct()
)
_F("tactic_hours", " SELECT tactic, substr(event_time_utc, 12, 2) AS hour, count(*) AS findings FROM (SELECT *, unnest(tactics) AS tactic FROM findings) GROUP BY 1, 2")(
    lambda er: sigma_eval(er).select(F.explode("tactics").alias("tactic"), F.substring("event_time_utc", 12, 2).alias("hour")).groupBy("tactic", "hour").agg(F.count("*").alias("findings"))
)
_F("suspicious_actions", f" SELECT event_action, {MAX_SQL} AS severity, count(*) AS events FROM er WHERE severity IN ('critical', 'high') GROUP BY 1")(lambda er: er.where("severity IN ('critical', 'high')").groupBy("event_action").agg(severity_max("severity").alias("severity"), F.count("*").alias("events")))


#: events with accounts that need cleaning, for Spark and the oracle
_JUNK = "CASE WHEN length(message_short) % 3 = 0 THEN concat(message_short, ' user=', host, 'BUILTIN{b}', event_action) ELSE message_short END"
_JUNK_USER = "CASE WHEN length(message_short) % 3 = 1 THEN concat(host, 'nt service{b}', event_action) ELSE user_name END"


def _rebuilt(at) -> DataFrame:
    ef = fixture.events_full(*at).withColumn("user_name", F.expr(_JUNK_USER.format(b="\\\\"))).withColumn("message_short", F.expr(_JUNK.format(b="\\\\")))
    return rebuild_event_rows(ef, sigma_eval(fixture.event_rows(*at)).select("event_id")).drop("search_text", "command_line")


_SANE = f"regexp_replace({_JUNK_USER.format(b=chr(92))}, '(?i)^.*?{ACCOUNTS}\\\\', '\\1\\\\') AS user_name, regexp_replace({_JUNK.format(b=chr(92))}, '(?i)^((?s:.*?)user=)[^ ]*?{ACCOUNTS}\\\\', '\\1\\2\\\\') AS message_short"
query("rebuild_event_rows", FINDINGS + f" SELECT * EXCLUDE (attributes_json, message_full, search_text, command_line) REPLACE ({_SANE}), event_id IN (SELECT event_id FROM findings) AS has_finding FROM er", over="session")(_rebuilt)
