"""Behavioural heuristics. Their thresholds are ours and are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.columns import attr_string, filled, timestamp
from timeloom.registry import query

#: tools of the system that intruders use; fixed values of ours
LOLBINS = ["powershell", "certutil", "wevtutil", "schtasks", "bitsadmin", "mshta", "rundll32", "regsvr32", "wmic"]
WRITABLE = r"(?i)[\\/](users[\\/][^\\/]+[\\/](downloads|appdata|desktop)|temp|programdata|public)[\\/]"


def password_spray(er: DataFrame, users: int = 3, minutes: int = 1440) -> DataFrame:
    """Addresses from which many users failed to log on within a window."""
    failed = er.where("event_action = 'logon_failure' AND ip IS NOT NULL").withColumn("t", timestamp("event_time_utc")).where("t IS NOT NULL")
    w = F.window("t", f"{minutes} minutes")
    out = failed.groupBy("ip", w.alias("w")).agg(F.countDistinct(filled("user_name")).alias("users"), F.count("*").alias("failures")).where(F.col("users") >= users)
    return out.select("ip", F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), "users", "failures")


def bruteforce_success(er: DataFrame, failures: int = 2, seconds: int = 5 * 86_400, bucket: int = 7_200) -> DataFrame:
    """Successful logons with at least so many failures of the same user on the same host in the time before.

    The failures between two times are a difference of two prefix sums, each the sum of whole buckets of time before it and an exact
    count within its own bucket; so rows of a user are ordered within a bucket only, and what is summed over a user is a row a bucket.
    """
    rows = er.where("event_action IN ('logon_failure', 'logon_success') AND user_name IS NOT NULL").withColumn("t", F.unix_timestamp(timestamp("event_time_utc"))).where("t IS NOT NULL")
    rows = rows.select(F.coalesce("host", F.lit("")).alias("at"), "host", "user_name", "event_id", "event_action", "t")
    failed = rows.where("event_action = 'logon_failure'").select("at", "host", "user_name", F.lit(None).cast("string").alias("event_id"), F.col("t").alias("x"), F.lit(0).alias("sign"), F.lit(1).alias("hit"))
    ends = F.explode(F.array(F.struct((F.col("t") - 1).alias("x"), F.lit(1).alias("sign")), F.struct((F.col("t") - seconds - 1).alias("x"), F.lit(-1).alias("sign")))).alias("e")
    asked = rows.where("event_action = 'logon_success'").select("at", "host", "user_name", "event_id", ends).select("at", "host", "user_name", "event_id", "e.x", "e.sign", F.lit(0).alias("hit"))
    both = failed.unionByName(asked).withColumn("bucket", F.floor(F.col("x") / bucket))
    inside = F.sum("hit").over(Window.partitionBy("at", "user_name", "bucket").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sums = both.groupBy("at", "user_name", "bucket").agg(F.sum("hit").alias("n"))
    sums = sums.select("at", "user_name", "bucket", (F.sum("n").over(Window.partitionBy("at", "user_name").orderBy("bucket")) - F.col("n")).alias("before"))
    counted = both.withColumn("inside", inside).where("event_id IS NOT NULL").join(sums, ["at", "user_name", "bucket"])
    out = counted.groupBy("event_id", "host", "user_name").agg(F.sum(F.col("sign") * (F.col("before") + F.col("inside"))).alias("failures"))
    return out.where(F.col("failures") >= failures).select("event_id", "host", "user_name", "failures")


def mass_exe_delete(er: DataFrame, n: int = 3) -> DataFrame:
    gone = er.where(r"event_action = 'usn_deleted'").where(F.col("file_path").rlike(r"(?i)\.(exe|dll|msi|bat|ps1|js)$"))
    day = F.substring("event_time_utc", 1, 10).alias("day")
    return gone.groupBy("host", day).agg(F.count("*").alias("deleted")).where(F.col("deleted") >= n)


def account_created_then_used(er: DataFrame, seconds: int = 7 * 86_400, bucket: int = 7_200) -> DataFrame:
    """Accounts created and then, within the time, logged on: the pairs of a creation and a logon are counted, not made.

    Logons between two times are a difference of prefix sums, as in `bruteforce_success`.
    """
    t = F.unix_timestamp(timestamp("event_time_utc"))
    made = er.where("event_action = 'account_created'").where(filled("user_name").isNotNull()).select("user_name", F.col("event_id").alias("created"), t.alias("t")).where("t IS NOT NULL")
    used = er.where("event_action = 'logon_success' AND user_name IS NOT NULL").select("user_name", t.alias("x")).where("x IS NOT NULL")
    ends = F.explode(F.array(F.struct((F.col("t") + seconds).alias("x"), F.lit(1).alias("sign")), F.struct(F.col("t").alias("x"), F.lit(-1).alias("sign")))).alias("e")
    asked = made.select("user_name", "created", ends).select("user_name", "created", "e.x", "e.sign", F.lit(0).alias("hit"))
    both = used.select("user_name", F.lit(None).cast("string").alias("created"), "x", F.lit(0).alias("sign"), F.lit(1).alias("hit")).unionByName(asked).withColumn("bucket", F.floor(F.col("x") / bucket))
    inside = F.sum("hit").over(Window.partitionBy("user_name", "bucket").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    sums = both.groupBy("user_name", "bucket").agg(F.sum("hit").alias("n"))
    sums = sums.select("user_name", "bucket", (F.sum("n").over(Window.partitionBy("user_name").orderBy("bucket")) - F.col("n")).alias("before"))
    counted = both.withColumn("inside", inside).where("created IS NOT NULL").join(sums, ["user_name", "bucket"])
    each = counted.groupBy("user_name", "created").agg(F.sum(F.col("sign") * (F.col("before") + F.col("inside"))).alias("pairs")).where("pairs > 0")
    return each.groupBy("user_name").agg(F.sum("pairs").alias("pairs"), F.min("created").alias("created"))


def _data(*keys: str):
    return F.lower(attr_string("attributes_json", *[f"data.{k}" for k in keys]))


def priv_group_added(er: DataFrame, seconds: int = 7 * 86_400) -> DataFrame:
    """Accounts created (4720) and then, within the time, added to a group (4728, 4732, 4756): by SID, or by name where one side has none."""
    t = F.unix_timestamp(timestamp("event_time_utc"))
    keys = F.explode(F.filter(F.array(F.struct(F.lit("sid").alias("by"), F.col("sid").alias("key")), F.struct(F.lit("name").alias("by"), F.col("name").alias("key"))), lambda x: x["key"].isNotNull())).alias("k")
    member = _data("MemberName")
    cn = F.nullif(F.regexp_extract(member, r"^cn=([^,]+)", 1), F.lit(""))
    made = er.where("event_code = '4720'").select(F.col("event_id").alias("created"), t.alias("t0"), _data("TargetSid").alias("sid"), _data("TargetUserName").alias("name"))
    added = er.where("event_code IN ('4728', '4732', '4756')").select(
        F.col("event_id").alias("added"), t.alias("t1"), _data("MemberSid").alias("sid"), F.coalesce(cn, F.regexp_replace(member, r"^.*\\", "")).alias("name"), _data("TargetUserName").alias("group_name"))
    made = made.select("created", "t0", F.col("sid").alias("sid0"), F.col("name").alias("account"), keys).select("*", "k.*").drop("k")
    added = added.select("added", "t1", "group_name", F.col("sid").alias("sid1"), keys).select("*", "k.*").drop("k")
    pairs = made.join(added, ["by", "key"]).where("t1 >= t0").where(F.col("t1") - F.col("t0") <= seconds).where("by = 'sid' OR sid0 IS NULL OR sid1 IS NULL")
    return pairs.select("account", "group_name", "created", "added").distinct()


def ntlm_network_logon(er: DataFrame) -> DataFrame:
    """Logons (4624) of type 3 or 9 by NTLM: the shape of a passed hash."""
    ntlm = [F.startswith(_data(k), F.lit("ntlm")) for k in ("AuthenticationPackageName", "LogonProcessName", "LmPackageName")]
    return er.where("event_code = '4624'").where(_data("LogonType").isin("3", "9") & F.coalesce(*[F.when(c, F.lit(True)) for c in ntlm], F.lit(False))).select("event_id")


def tgs_without_tgt(er: DataFrame) -> DataFrame:
    """Service tickets (4769) of accounts that got no TGT (4768) before or in the same second."""
    account = F.substring_index(F.lower(F.coalesce(filled("user_name"), attr_string("attributes_json", "data.TargetUserName"))), "@", 1).alias("account")
    t = timestamp("event_time_utc")
    first = er.where("event_code = '4768'").select(account, t.alias("t")).groupBy("account").agg(F.min("t").alias("first"))
    asked = er.where("event_code = '4769'").select("event_id", account, t.alias("t")).where("account IS NOT NULL")
    return asked.join(first, "account", "left").where("first IS NULL OR first > t").select("event_id")


_T = "CAST(epoch(CAST(event_time_utc AS TIMESTAMP)) AS BIGINT)"
query("heur_password_spray", """ SELECT ip, substr(event_time_utc, 1, 10) || 'T00:00:00Z' AS start, count(DISTINCT nullif(nullif(user_name, ''), '-')) AS users, count(*) AS failures FROM er
 WHERE event_action = 'logon_failure' AND ip IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT nullif(nullif(user_name, ''), '-')) >= 3""")(password_spray)
query("heur_bruteforce_success", f""", r AS (SELECT event_id, host, user_name, event_action, count(*) FILTER (event_action = 'logon_failure') OVER (PARTITION BY host, user_name ORDER BY {_T} RANGE BETWEEN 432000 PRECEDING AND 1 PRECEDING) AS failures
 FROM er WHERE event_action IN ('logon_failure', 'logon_success') AND user_name IS NOT NULL) SELECT event_id, host, user_name, failures FROM r WHERE event_action = 'logon_success' AND failures >= 2""")(bruteforce_success)
query("heur_mass_exe_delete", "SELECT host, substr(event_time_utc, 1, 10) AS day, count(*) AS deleted FROM er WHERE event_action = 'usn_deleted' AND regexp_matches(lower(file_path), '\\.(exe|dll|msi|bat|ps1|js)$') GROUP BY 1, 2 HAVING count(*) >= 3")(mass_exe_delete)
query("heur_account_created_then_used", f""", m AS (SELECT user_name, event_id AS created, {_T} AS t0 FROM er WHERE event_action = 'account_created' AND user_name NOT IN ('', '-')),
 l AS (SELECT user_name, {_T} AS t1 FROM er WHERE event_action = 'logon_success') SELECT user_name, count(*) AS pairs, min(created) AS created FROM m JOIN l USING (user_name) WHERE t1 > t0 AND t1 - t0 <= 604800 GROUP BY 1""")(account_created_then_used)
_LOL = "|".join(LOLBINS)
query("heur_lolbin_inventory", f", l AS (SELECT nullif(regexp_extract(lower(command_line), '({_LOL})', 1), '') AS tool, host FROM er WHERE command_line IS NOT NULL) SELECT tool, host, count(*) AS runs FROM l WHERE tool IS NOT NULL GROUP BY 1, 2")(
    lambda er: er.where("command_line IS NOT NULL").select(F.nullif(F.regexp_extract(F.lower("command_line"), f"({_LOL})", 1), F.lit("")).alias("tool"), "host").where("tool IS NOT NULL").groupBy("tool", "host").agg(F.count("*").alias("runs"))
)
query("heur_has_finding", f"SELECT event_id FROM er WHERE regexp_matches(lower(coalesce(command_line, '')), '{_LOL}| -enc |urlcache') OR (url IS NOT NULL AND regexp_matches(url, '\\.(exe|ps1|js)$'))")(
    lambda er: er.where(F.lower(F.coalesce("command_line", F.lit(""))).rlike(f"{_LOL}| -enc |urlcache") | (F.col("url").isNotNull() & F.col("url").rlike(r"\.(exe|ps1|js)$"))).select("event_id")
)


def service_installs(er: DataFrame) -> DataFrame:
    """event_id, event_time_utc, host, user_name, service, image of services that were installed (7045, 4697)."""
    name = attr_string("attributes_json", "data.ServiceName", "data.service_name", "service_name")
    image = attr_string("attributes_json", "data.ImagePath", "data.ServiceFileName", "data.CommandLine")
    return er.where("event_code IN ('7045', '4697')").select("event_id", "event_time_utc", "host", filled("user_name").alias("user_name"), name.alias("service"), image.alias("image"))


query("heur_service_install", """ SELECT event_id, event_time_utc, host, nullif(nullif(user_name, ''), '-') AS user_name, json_extract_string(attributes_json, '$.data.ServiceName') AS service,
 json_extract_string(attributes_json, '$.data.CommandLine') AS image FROM er WHERE event_code IN ('7045', '4697')""")(service_installs)
query("service_installs_by_host", "SELECT host, count(*) AS installs FROM er WHERE event_code IN ('7045', '4697') GROUP BY 1")(lambda er: service_installs(er).groupBy("host").agg(F.count("*").alias("installs")))
query("heur_off_hours_logon", "SELECT event_id FROM er WHERE event_action = 'logon_success' AND (hour(CAST(event_time_utc AS TIMESTAMP)) < 7 OR hour(CAST(event_time_utc AS TIMESTAMP)) >= 19)")(
    lambda er: er.where("event_action = 'logon_success'").where((F.hour(timestamp("event_time_utc")) < 7) | (F.hour(timestamp("event_time_utc")) >= 19)).select("event_id")
)
query("heur_rdp_sources", "SELECT host, ip, count(*) AS logons, min(event_time_utc) AS first_seen FROM er WHERE event_code = '4624' AND ip IS NOT NULL AND json_extract_string(attributes_json, '$.data.LogonType') IN ('7', '10') GROUP BY 1, 2")(
    lambda er: er.where("event_code = '4624' AND ip IS NOT NULL").where(_data("LogonType").isin("7", "10")).groupBy("host", "ip").agg(F.count("*").alias("logons"), F.min("event_time_utc").alias("first_seen"))
)
query("heur_updater_masquerade", "SELECT event_id FROM er WHERE regexp_matches(lower(coalesce(file_path, '')), 'users/.*update[^/]*$')")(lambda er: er.where(F.lower(F.coalesce("file_path", F.lit(""))).rlike("users/.*update[^/]*$")).select("event_id"))
query("heur_user_writable_exec", "SELECT event_id FROM er WHERE event_action = 'prefetch_execution' AND regexp_matches(file_path, '(?i)[\\\\/](users[\\\\/][^\\\\/]+[\\\\/](downloads|appdata|desktop)|temp|programdata|public)[\\\\/]')")(
    lambda er: er.where("event_action = 'prefetch_execution'").where(F.col("file_path").rlike(WRITABLE)).select("event_id")
)
query("heur_ticket_without_logon", "SELECT e.event_id FROM er e WHERE event_action = 'kerberos_tgs_request' AND user_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM er l WHERE l.user_name = e.user_name AND l.event_action = 'logon_success' AND l.event_time_utc < e.event_time_utc)")(
    lambda er: er.alias("e").where("event_action = 'kerberos_tgs_request' AND user_name IS NOT NULL").join(er.where("event_action = 'logon_success'").groupBy("user_name").agg(F.min("event_time_utc").alias("first")), "user_name", "left").where("first IS NULL OR first >= event_time_utc").select("event_id")
)
query("heur_weak_cipher_logon", "SELECT event_id FROM er WHERE event_code = '4624' AND contains(attributes_json, '\"TicketEncryptionType\":\"0x17\"')")(
    lambda er: er.where("event_code = '4624'").where(F.contains("attributes_json", F.lit('"TicketEncryptionType":"0x17"'))).select("event_id")
)
_J = lambda k: f"lower(nullif(nullif(trim(json_extract_string(attributes_json, '$.data.{k}')), ''), '-'))"
for _n in ("heur_priv_account_created", "heur_priv_group_added"):
    query(_n, f""", m AS (SELECT event_id AS created, {_T} AS t0, {_J('TargetSid')} AS sid, {_J('TargetUserName')} AS name FROM er WHERE event_code = '4720'),
 g AS (SELECT event_id AS added, {_T} AS t1, {_J('MemberSid')} AS sid, coalesce(nullif(regexp_extract({_J('MemberName')}, '^cn=([^,]+)', 1), ''), regexp_replace({_J('MemberName')}, '^.*\\\\', '')) AS name,
 {_J('TargetUserName')} AS group_name FROM er WHERE event_code IN ('4728', '4732', '4756'))
 SELECT m.name AS account, group_name, created, added FROM m JOIN g ON m.sid = g.sid OR (m.name = g.name AND (m.sid IS NULL OR g.sid IS NULL)) WHERE t1 >= t0 AND t1 - t0 <= 604800""")(priv_group_added)
for _n in ("heur_pass_the_hash", "heur_ntlm_network_logon"):
    query(_n, f"SELECT event_id FROM er WHERE event_code = '4624' AND {_J('LogonType')} IN ('3', '9') AND regexp_matches(concat_ws('|', {_J('AuthenticationPackageName')}, {_J('LogonProcessName')}, {_J('LmPackageName')}), '(^|\\|)ntlm')")(ntlm_network_logon)
for _n in ("heur_forged_ticket", "heur_tgs_without_tgt"):
    query(_n, f""", a AS (SELECT event_id, event_code, {_T} AS t, split_part(coalesce(lower(nullif(nullif(user_name, ''), '-')), {_J('TargetUserName')}), '@', 1) AS account FROM er WHERE event_code IN ('4768', '4769'))
 SELECT event_id FROM a WHERE event_code = '4769' AND account IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a g WHERE g.event_code = '4768' AND g.account = a.account AND g.t <= a.t)""")(tgs_without_tgt)
_SIGS = {"encoded_command": "-enc [a-z0-9+/=]{6,}", "download_cradle": "urlcache|downloadstring", "log_clearing": "wevtutil cl|clear-eventlog", "scheduled_task": "schtasks /create"}
query("signature_scan", " UNION ALL ".join((", " if not k else "") * 0 + f"SELECT '{n}' AS signature, count(*) AS events, min(event_id) AS first_event FROM er WHERE regexp_matches(search_text, '{p}')" for k, (n, p) in enumerate(_SIGS.items())))(
    lambda er: er.select("event_id", F.explode(F.array_compact(F.array(*[F.when(F.col("search_text").rlike(p), F.lit(n)) for n, p in _SIGS.items()]))).alias("signature")).groupBy("signature").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))
)
