"""Artifact objects and evidence offsets taken out of the attributes' JSON. Ids are digests, so a repeated run gives the same."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.columns import attr_i64, filled
from timeloom.operators.aggregates import type_bits
from timeloom.registry import query
from timeloom.sources.storage import stored

REFERENCES = {"file": "file_path", "process": "process_name", "hash": "hash", "ip": "ip", "url": "url", "user": "user_name"}


def object_id(kind: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", "event_id", kind, key), 256)


def reference_objects(ef: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{k}_reference").alias("kind"), filled(c).alias("name")) for k, c in REFERENCES.items()])).alias("o")
    rows = ef.select("event_id", pairs).select("event_id", "o.kind", "o.name").where("name IS NOT NULL")
    return rows.select(object_id(F.col("kind"), F.col("name")).alias("object_id"), "event_id", "kind", "name", F.lit(0.6).alias("confidence"))


# Objects are rules over the attributes' JSON, in SQL that Spark and the oracle share but for how a value is taken out of the JSON:
# {scope.kind:path}, scope r the row's attributes, e an entry of an array, p the entry around it; kind s text, a text that is not blank,
# i integer, f double, j any, t its JSON text, x the entry itself as text.
_MARK = re.compile(r"\{([rep])\.([saifjtx]):([\w.$]*)\}")
_TYPES = {"s": "string", "a": "string", "i": "bigint", "f": "double", "j": "variant", "x": "string"}


def _in_spark(text: str) -> str:
    def value(m: re.Match) -> str:
        scope, kind, path = m[1].replace("r", "v"), m[2], f"$.{m[3]}" if m[3] else "$"
        if kind == "t":
            return f"get_json_object(attributes_json, '{path}')"
        got = f"try_variant_get({scope}, '{path}', '{_TYPES[kind]}')"
        return f"nullif(nullif(trim({got}), ''), '-')" if kind == "a" else got

    return _MARK.sub(value, text)


def _in_duck(text: str) -> str:
    def value(m: re.Match) -> str:
        scope, kind, path = m[1].replace("r", "attributes_json"), m[2], f"$.{m[3]}" if m[3] else "$"
        if kind in "jt":
            return f"CAST(json_extract({scope}, '{path}') AS VARCHAR)"
        got = f"json_extract_string({scope}, '{path}')"
        if kind in "if":
            return f"TRY_CAST({got} AS {'BIGINT' if kind == 'i' else 'DOUBLE'})"
        return f"nullif(nullif(trim({got}), ''), '-')" if kind == "a" else got

    return _MARK.sub(value, text)


class Rule(NamedTuple):
    """One kind of object. path: the array whose entries are objects ('': the row is one), parent: the array around it, cap and parent_cap: how
    many entries of each count. spot: kind, condition, label, default length and longest length of the object's place in the source."""

    group: str
    kind: str
    key: str
    name: str
    confidence: str
    path: str = ""
    cap: int = 0
    parent: str = ""
    parent_cap: int = 0
    when: str = "true"
    offset: str = "cast(null as bigint)"
    length: str = "cast(null as bigint)"
    spot: tuple[str, str, str, str, int] | None = None


TYPES = {
    "mft": ["mft"], "prefetch": ["prefetch"], "usn": ["usn_jrnl"], "link": ["lnk", "jump_list"], "registry": ["registry_hive", "amcache"], "ese": ["ese_database"], "windows_event": ["evtx", "hayabusa"],
    "recovery": [],
}
_REC, _SEQ = "coalesce({r.i:record_number}, {r.i:entry_number})", "coalesce(cast({r.i:sequence_number} as string), '-')"
_BASE, _SIZE = "{r.i:record_offset}", "coalesce({r.i:record_size}, {r.i:length})"
_ID, _TYPE = "coalesce(cast({e.i:id} as string), '-')", "coalesce({e.s:type_name}, 'UNKNOWN')"
_STREAM = "'mft_resident:' || " + _REC + " || ':' || " + _SEQ + " || ':' || coalesce({r.a:stream_name}, '$DATA') || ':' || coalesce({r.a:resident_sha256}, {r.a:sha256}, '-')"
_ADS = "lower(coalesce({r.a:stream_kind}, 'resident_data')) = 'ads'"
_PROC, _PF = "coalesce({r.s:executable_name_header}, {r.s:prefetch_file_name}, 'prefetch')", "coalesce({r.s:prefetch_hash}, '-')"
_RUN = "coalesce(process_name, {r.a:process_name}, {r.a:executable_name})"
_PFKEY = lambda kind, rest="": f"'{kind}:' || lower({_PROC}) || ':' || {_PF}{rest}"
_KIND = "{r.s:semantics.event_kind}"
_USER, _ADDRESS = "coalesce({r.s:data.TargetUserName}, {r.s:data.User}, '-')", "coalesce({r.s:data.IpAddress}, {r.s:data.ClientAddress}, '-')"
_HINT = "{e.x:}"
RULES = [
    Rule("mft", "ntfs_file_record", f"'mft:' || {_REC} || ':' || {_SEQ}", f"coalesce(file_path, 'MFT record ' || {_REC})", "0.95", when=f"{_REC} is not null", offset=_BASE, length=_SIZE),
    Rule("mft", "ntfs_attribute", f"'mft_attr:' || {_REC} || ':' || {_SEQ} || ':' || {_ID} || ':' || {_TYPE}", f"'MFT ' || {_REC} || ' ' || {_TYPE} || ' attr#' || {_ID}", "0.88", "attributes", 24, when=f"{_REC} is not null",
         offset=f"coalesce({_BASE} + {{e.i:offset}}, {_BASE})", length=f"coalesce({{e.i:length}}, {_SIZE})", spot=("mft_attribute", f"{_BASE} + {{e.i:offset}} is not null", f"'MFT ' || {_TYPE} || ' attr#' || {_ID}", "coalesce({e.i:length}, 64)", 65_536)),
    Rule("mft", "ntfs_data_run", f"'mft_run:' || {_REC} || ':' || {_SEQ} || ':' || coalesce(cast({{e.i:attribute_id}} as string), '-') || ':' || coalesce({{e.i:run_index}}, 0)",
         f"'MFT ' || {_REC} || ' DATA run#' || coalesce({{e.i:run_index}}, 0) || ' LCN ' || coalesce(cast({{e.i:lcn}} as string), 'sparse') || ' clusters ' || coalesce({{e.i:cluster_count}}, 0)", "0.8", "data_runs", 16,
         when=f"{_REC} is not null and {{r.j:attributes}} is not null", offset=f"coalesce({_BASE} + {{e.i:runlist_record_offset}}, {_BASE})", length="16",
         spot=("mft_data_runlist", f"{_BASE} + {{e.i:runlist_record_offset}} is not null", "'MFT DATA runlist #' || coalesce({e.i:run_index}, 0)", "16", 16)),
    Rule("mft", f"case when {_ADS} then 'ntfs_ads_resident_content' else 'ntfs_resident_content' end", f"lower({_STREAM})",
         f"coalesce(file_path, 'MFT record ' || {_REC} || coalesce(':' || {{r.a:stream_name}}, '')) || coalesce(' HostUrl=' || coalesce({{r.a:HostUrl}}, {{r.a:host_url}}), '')", f"case when {_ADS} then 0.9 else 0.78 end",
         when=f"{_REC} is not null and {{r.i:resident_value_offset}} is not null and {{r.i:resident_value_length}} is not null", offset=f"{_BASE} + {{r.i:resident_value_offset}}", length="least(greatest({r.i:resident_value_length}, 1), 65536)",
         spot=(f"case when {_ADS} then 'mft_ads_resident_content' else 'mft_resident_content' end", f"{_BASE} is not null", f"'MFT resident ' || coalesce({{r.a:stream_kind}}, 'resident_data') || ' ' || coalesce({{r.a:stream_name}}, '$DATA') || ' record ' || {_REC}", "{r.i:resident_value_length}", 65_536)),
    Rule("prefetch", "prefetch_execution", f"'prefetch:' || lower({_RUN}) || ':' || coalesce({{r.a:prefetch_hash}}, '-')", _RUN, "0.9", when=f"{_RUN} is not null", offset=_BASE, length=_SIZE),
    Rule("prefetch", "prefetch_section", _PFKEY("prefetch_section", " || ':' || coalesce({e.s:name}, 'section')"), f"'Prefetch ' || {_PROC} || ' ' || coalesce({{e.s:name}}, 'section')", "coalesce({e.f:confidence}, 0.7)", "sections", 16,
         offset="{e.i:offset}", length="{e.i:length}", spot=("prefetch_section", "{e.i:offset} is not null", "'Prefetch ' || coalesce({e.s:name}, 'section') || ' section'", "coalesce({e.i:length}, 256)", 65_536)),
    Rule("prefetch", "prefetch_run_count", _PFKEY("prefetch_run_count"), f"'Prefetch ' || {_PROC} || ' run count'", "0.8", when="{r.i:run_count_offset} is not null", offset="{r.i:run_count_offset}", length="4",
         spot=("prefetch_run_count", "true", "'Prefetch run count'", "4", 4)),
    Rule("prefetch", "prefetch_run_time", _PFKEY("prefetch_run_time", " || ':' || coalesce({e.s:timestamp}, '-')"), f"'Prefetch ' || {_PROC} || ' run time ' || coalesce({{e.s:timestamp}}, '-')", "coalesce({e.f:confidence}, 0.8)", "run_time_entries", 16,
         when="{e.i:offset} is not null", offset="{e.i:offset}", length="8", spot=("prefetch_run_time", "true", "'Prefetch run time ' || coalesce({e.s:timestamp}, '-')", "8", 8)),
    Rule("prefetch", "prefetch_file_metric", _PFKEY("prefetch_file_metric", " || ':' || coalesce({e.i:index}, 0) || ':' || coalesce({e.s:filename}, '-')"),
         f"'Prefetch ' || {_PROC} || ' file metric #' || coalesce({{e.i:index}}, 0) || ' ' || coalesce({{e.s:filename}}, '-')", "coalesce({e.f:confidence}, 0.78)", "file_metrics", 32, when="{e.i:offset} is not null", offset="{e.i:offset}",
         length="coalesce({e.i:length}, 32)", spot=("prefetch_file_metric", "true", "'Prefetch file metric #' || coalesce({e.i:index}, 0)", "coalesce({e.i:length}, 32)", 256)),
    Rule("prefetch", "prefetch_trace_chain", _PFKEY("prefetch_trace_chain", " || ':' || coalesce({e.i:index}, 0)"), f"'Prefetch ' || {_PROC} || ' trace chain #' || coalesce({{e.i:index}}, 0) || ' blocks ' || coalesce({{e.i:block_load_count}}, 0)",
         "coalesce({e.f:confidence}, 0.74)", "trace_chains", 32, when="{e.i:offset} is not null", offset="{e.i:offset}", length="coalesce({e.i:length}, 8)",
         spot=("prefetch_trace_chain", "true", "'Prefetch trace chain #' || coalesce({e.i:index}, 0)", "coalesce({e.i:length}, 8)", 256)),
    Rule("usn", "usn_record", "'usn:' || coalesce({r.a:usn}, {r.a:record_offset}, event_id)", "coalesce({r.a:usn}, {r.a:record_offset}, event_id)", "0.9", offset=_BASE, length=_SIZE),
    Rule("link", "case when artifact_type = 'lnk' then 'shell_link_target' else 'jumplist_target' end", "artifact_type || ':' || lower(coalesce({r.a:target_path}, {r.a:target}))", "coalesce({r.a:target_path}, {r.a:target})", "0.9",
         when="coalesce({r.a:target_path}, {r.a:target}) is not null", offset=_BASE, length=_SIZE),
    Rule("link", "lnk_extra_block", "'lnk_extra:' || event_id || ':' || coalesce({e.s:signature}, 'unknown') || ':' || coalesce(cast({e.i:offset} as string), '-')", "'LNK ' || coalesce({e.s:signature_name}, 'UnknownExtraDataBlock')",
         "coalesce({e.f:confidence}, 0.75)", "extra_data_blocks", 16, offset="{e.i:offset}", length="{e.i:length}",
         spot=("lnk_extra_block", "{e.i:offset} is not null", "'LNK ' || coalesce({e.s:signature_name}, 'UnknownExtraDataBlock')", "coalesce({e.i:length}, 64)", 65_536)),
    Rule("link", "lnk_property_value", "'lnk_property:' || lower({e.s:key}) || ':' || lower(coalesce({e.s:value_hint}, '-'))", "'LNK property ' || {e.s:key} || case when coalesce({e.s:value_hint}, '-') = '-' then '' else '=' || {e.s:value_hint} end",
         "coalesce({e.f:confidence}, 0.6)", "property_entries", 32, "extra_data_blocks", 16, "trim({e.s:key}) <> ''", "coalesce({e.i:value_offset}, {p.i:offset})", "coalesce({e.i:value_length}, 32)",
         ("lnk_property_value", "{p.i:offset} is not null and {e.i:value_offset} is not null", "'LNK property ' || {e.s:key}", "coalesce({e.i:value_length}, 32)", 4096)),
    Rule("registry", "case when artifact_type = 'amcache' then 'amcache_entry' else 'registry_value' end", "artifact_type || ':' || lower(coalesce({r.a:key_path} || '/' || {r.a:value_name}, {r.a:key_path}, {r.a:value_name}, file_path, event_id))",
         "coalesce({r.a:key_path} || '/' || {r.a:value_name}, {r.a:key_path}, {r.a:value_name}, file_path, event_id)", "0.9", offset=_BASE, length=_SIZE),
    Rule("ese", "ese_row_signal", "'ese_row:' || event_id", "event_action", "0.9", offset=_BASE, length=_SIZE),
    Rule("ese", "ese_database_header", "'ese_header:' || source_file_id", "'ESE database header'", "0.75", when="{r.j:ese_header} is not null", offset="coalesce({r.i:ese_header.offset}, 0)", length="coalesce({r.i:ese_header.length}, 4096)",
         spot=("ese_database_header", "true", "'ESE database header'", "coalesce({r.i:ese_header.length}, 4096)", 65_536)),
    Rule("ese", "ese_database_page", "'ese_page:' || source_file_id || ':' || coalesce({e.i:page_number}, 0)", "'ESE page ' || coalesce({e.i:page_number}, 0)", "coalesce({e.f:confidence}, 0.55)", "ese_pages", 8, offset="{e.i:offset}",
         length="{e.i:length}", spot=("ese_database_page", "{e.i:offset} is not null", "'ESE page ' || coalesce({e.i:page_number}, 0)", "coalesce({e.i:length}, 4096)", 65_536)),
    Rule("ese", "ese_page_tag", "'ese_tag:' || source_file_id || ':' || coalesce({p.i:page_number}, 0) || ':' || coalesce({e.i:tag_index}, 0)", "'ESE page ' || coalesce({p.i:page_number}, 0) || ' tag ' || coalesce({e.i:tag_index}, 0)",
         "coalesce({e.f:confidence}, 0.6)", "tags", 64, "ese_pages", 8, offset="coalesce({e.i:absolute_offset}, {p.i:offset} + {e.i:offset})", length="coalesce({e.i:length}, 16)",
         spot=("ese_page_tag", "{p.i:offset} is not null and coalesce({e.i:absolute_offset}, {p.i:offset} + {e.i:offset}) is not null", "'ESE page ' || coalesce({p.i:page_number}, 0) || ' tag ' || coalesce({e.i:tag_index}, 0)", "coalesce({e.i:length}, 16)", 65_536)),
    Rule("ese", "ese_table_hint", f"'ese_table:' || artifact_type || ':' || lower({_HINT})", f"'ESE table hint ' || {_HINT}", "0.5", "table_name_hints", 12, "ese_pages", 8, f"{_HINT} is not null", "{p.i:offset}", "{p.i:length}"),
    Rule("windows_event", "kerberos_ticket_request", "lower('kerberos:' || coalesce({r.s:event_id}, '-') || ':' || coalesce({r.s:data.TargetUserName}, {r.s:data.AccountName}, '-') || ':' || coalesce({r.s:semantics.service_name}, '-') || ':' || coalesce({r.s:semantics.ticket_encryption_name}, '-'))",
         f"'Kerberos ' || {_KIND} || ' user=' || coalesce({{r.s:data.TargetUserName}}, {{r.s:data.AccountName}}, '-') || ' service=' || coalesce({{r.s:semantics.service_name}}, '-') || ' enc=' || coalesce({{r.s:semantics.ticket_encryption_name}}, '-')",
         "case when {r.t:semantics.labels} like '%\"kerberoast_candidate\"%' or {r.t:semantics.labels} like '%\"asrep_roast_candidate\"%' then 0.9 else 0.75 end", when=f"{_KIND} in ('kerberos_as_request', 'kerberos_tgs_request', 'kerberos_preauth_failed')"),
    Rule("windows_event", "firewall_rule_or_flow", f"lower('firewall:' || {_KIND} || ':' || coalesce({{r.s:semantics.rule_name}}, {{r.s:data.RuleName}}, '-') || ':' || coalesce({{r.s:semantics.firewall_direction}}, '-'))",
         f"'Firewall ' || {_KIND} || ' rule=' || coalesce({{r.s:semantics.rule_name}}, {{r.s:data.RuleName}}, '-') || ' direction=' || coalesce({{r.s:semantics.firewall_direction}}, '-')", "0.74", when=f"left({_KIND}, 9) = 'firewall_'"),
    Rule("windows_event", "audit_policy_change", f"lower('audit_policy:' || {_KIND} || ':' || coalesce({{r.s:semantics.audit_subcategory}}, '-'))", f"'Audit policy ' || {_KIND} || ' ' || coalesce({{r.s:semantics.audit_subcategory}}, '-')", "0.76",
         when=f"contains({_KIND}, 'audit_policy') or {_KIND} = 'privilege_rights_changed'"),
    Rule("windows_event", "rdp_logon_observation", f"lower('rdp:' || {_USER} || ':' || {_ADDRESS} || ':' || event_time_utc)", f"'RDP ' || {_KIND} || ' user=' || {_USER} || ' ip=' || {_ADDRESS}", "0.82", when=f"left({_KIND}, 4) = 'rdp_'"),
    Rule("windows_event", "named_pipe_observation", "lower('named_pipe:' || {r.s:semantics.pipe_name})", "'Named pipe ' || {r.s:semantics.pipe_name}", "case when contains(lower({r.s:semantics.pipe_name}), 'psexesvc') then 0.88 else 0.68 end",
         when="{r.s:semantics.pipe_name} is not null"),
    Rule("recovery", "case event_action when 'recovered_file' then 'recovered_file' when 'credential_store_entry' then 'credential_store_entry' when 'pcap_conversation_reconstructed' then 'reconstructed_network_conversation' else 'sidecar_output' end",
         "'recovery:' || lower(coalesce({r.a:recovered_name}, file_path, event_id))", "coalesce({r.a:recovered_name}, file_path, event_id)", "0.9",
         when="event_action in ('recovered_file', 'credential_store_entry', 'pcap_conversation_reconstructed', 'sidecar_output')", offset=_BASE, length=_SIZE),
]


def _kind(text: str) -> str:
    return text if text.startswith("case") else f"'{text}'"


def _entries(rule: Rule, when: str, fields: str) -> str:
    """The array of a rule's structs of one row, in Spark's SQL."""
    def listed(scope: str, path: str, cap: int) -> str:
        return f"slice(coalesce(try_variant_get({scope}, '$.{path}', 'array<variant>'), array()), 1, {cap})"

    if not rule.path:
        return f"case when {when} then array({fields}) else array() end"
    inner = lambda scope: f"transform(filter({listed(scope, rule.path, rule.cap)}, e -> {when}), e -> {fields})"
    return f"flatten(transform({listed('v', rule.parent, rule.parent_cap)}, p -> {inner('p')}))" if rule.parent else inner("v")


_OBJECT = "named_struct('kind', {kind}, 'key', {key}, 'name', {name}, 'offset', cast({offset} as bigint), 'length', cast({length} as bigint), 'confidence', cast({confidence} as double))"
_LINK = "named_struct('kind', {kind}, 'key', {key}, 'confidence', cast({confidence} as double))"
_SPOT = "named_struct('kind', {kind}, 'name', {name}, 'offset', cast({offset} as bigint), 'length', cast({length} as bigint))"


def _clamped(text: str, most: int) -> str:
    return f"least(greatest({text}, 1), {most})"


def _arrays(group: str, spots: bool, links: bool = False) -> str:
    """All rules of a group as one array."""
    out = []
    for r in RULES:
        if r.group != group or (spots and not r.spot) or (links and r.kind not in CHAINED):
            continue
        if spots:
            kind, placed, label, length, most = r.spot
            fields, when = _SPOT.format(kind=_kind(kind), name=label, offset=r.offset, length=_clamped(length, most)), f"({r.when}) and ({placed})"
        else:
            fields, when = (_LINK if links else _OBJECT).format(kind=_kind(r.kind), key=r.key, name=r.name, offset=r.offset, length=r.length, confidence=r.confidence), r.when
        out.append(_in_spark(_entries(r, when, fields)))
    return f"concat({', '.join(out)})"


def _of_group(group: str) -> str:
    return f"artifact_type in ({', '.join(repr(t) for t in TYPES[group])})" if TYPES[group] else "event_action in ('recovered_file', 'credential_store_entry', 'pcap_conversation_reconstructed', 'sidecar_output')"


def _derived(ef: DataFrame, groups: list[str], spots: bool = False, more: str = "", links: bool = False) -> DataFrame:
    """One scan, one parse of the JSON a row of the groups; each row's objects are one array that is inlined."""
    parsed = ef.where(" or ".join(_of_group(g) for g in groups)) if not more else ef
    parsed = parsed.select("event_id", "artifact_type", "event_time_utc", "event_action", "source_file_id", "process_name", "file_path", "attributes_json", *[c for c in REFERENCES.values() if c not in ("process_name", "file_path")])
    parsed = parsed.withColumn("v", F.expr(f"case when {' or '.join(map(_of_group, groups))} then try_parse_json(attributes_json) end"))
    arrays = [f"case when {_of_group(g)} then {_arrays(g, spots, links)} else array() end" for g in groups] + ([more] if more else [])
    return parsed.selectExpr("event_id", "artifact_type", "event_time_utc", f"inline(concat({', '.join(arrays)}))")


def derive_objects(ef: DataFrame, group: str) -> DataFrame:
    """event_id, artifact_type, event_time_utc, kind, key, name, offset, length, confidence of the objects of one group of artifacts.

    Attributes that are no JSON, and entries without the fields a kind needs, give no objects; arrays count up to their caps.
    """
    return _derived(ef, [group])


def derive_spots(ef: DataFrame, group: str) -> DataFrame:
    """event_id, kind, name, offset, length: where the objects of a group lie in their source; those without a known place are left out."""
    return _derived(ef, [group], spots=True).select("event_id", "kind", "name", "offset", "length")


def artifact_objects(ef: DataFrame) -> DataFrame:
    """All objects of all events, references to other things included, from one scan."""
    return _derived(ef, list(TYPES), more=_references(_OBJECT, list(REFERENCES)))


def _references(fields: str, kinds: list[str]) -> str:
    each = (f"case when {c} not in ('', '-') then " + fields.format(kind=f"'{k}_reference'", key=f"lower('{k}_reference:' || {c})", name=c, offset="null", length="null", confidence="0.6") + " end" for k, c in REFERENCES.items() if k in kinds)
    return f"array_compact(array({', '.join(each)}))"


def chained_objects(ef: DataFrame) -> DataFrame:
    """event_id, artifact_type, event_time_utc, kind, key, confidence of the objects that make chains; no other kind and no other field is made."""
    groups = [g for g in TYPES if any(r.group == g and r.kind in CHAINED for r in RULES)]
    return _derived(ef, groups, more=_references(_LINK, [k for k in REFERENCES if f"{k}_reference" in CHAINED]), links=True)


def offsets(ef: DataFrame) -> DataFrame:
    """The row's own place in its source, a length of 4096 where none is known, 1 to 65 536."""
    start = F.coalesce(attr_i64("attributes_json", "record_offset", "offset"), F.lit(0))
    length = F.least(F.greatest(F.coalesce(attr_i64("attributes_json", "record_size", "length"), F.lit(4096)), F.lit(1)), F.lit(65_536))
    return ef.select("event_id", "source_file_id", start.alias("offset"), length.alias("length"), F.concat("artifact_type", F.lit("_record")).alias("kind"))


def _duck(groups: list[str], spots: bool = False) -> str:
    """The same rows for the oracle: one select a rule."""
    out = []
    for r in RULES:
        if r.group not in groups or (spots and not r.spot):
            continue
        source = f"(SELECT * FROM ef WHERE {_of_group(r.group)})"
        if r.parent:
            source = f"(SELECT *, unnest(json_extract(attributes_json, '$.{r.parent}[*]')[1:{r.parent_cap}]) AS p FROM {source})"
        if r.path:
            source = f"(SELECT *, unnest(json_extract({'p' if r.parent else 'attributes_json'}, '$.{r.path}[*]')[1:{r.cap}]) AS e FROM {source})"
        if spots:
            kind, placed, label, length, most = r.spot
            fields = f"{_kind(kind)} AS kind, {label} AS name, CAST({r.offset} AS BIGINT) AS \"offset\", CAST({_clamped(length, most)} AS BIGINT) AS length"
            where = f"({r.when}) AND ({placed})"
        else:
            fields = f"artifact_type, event_time_utc, {_kind(r.kind)} AS kind, {r.key} AS key, {r.name} AS name, CAST({r.offset} AS BIGINT) AS \"offset\", CAST({r.length} AS BIGINT) AS length, CAST({r.confidence} AS DOUBLE) AS confidence"
            where = r.when
        out.append(_in_duck(f"SELECT event_id, {fields} FROM {source} WHERE {where}"))
    return " UNION ALL ".join(out)


def event_objects(kept: DataFrame, ef: DataFrame, event_ids: list[str], limit: int | None = 100) -> DataFrame:
    """Objects of some events, the surest first: those of the stored table kept; events of which it has none get theirs derived."""
    stored_rows = kept.where(F.col("event_id").isin(event_ids))
    missing = ef.where(F.col("event_id").isin(event_ids)).join(stored_rows.select("event_id").distinct(), "event_id", "left_anti")
    columns = ["event_id", "kind", "key", "name", "confidence"]
    out = stored_rows.select(*columns).unionByName(artifact_objects(missing.select(*ef.columns)).select(*columns)).orderBy(F.desc("confidence"), "event_id", "kind", "key", "name")
    return out if limit is None else out.limit(limit)


# fixed values
#: kinds of objects that make chains
CHAINED = [
    "ntfs_file_record", "ntfs_attribute", "ntfs_data_run", "prefetch_section", "prefetch_run_count", "prefetch_run_time", "prefetch_file_metric", "prefetch_trace_chain",
    "lnk_property_value", "ese_page_tag", "ese_table_hint", "file_reference", "process_reference", "hash_reference", "url_reference",
]
COMMON_OBJECTS = [
    "file_reference:/", "file_reference:c:\\program", "file_reference:c:\\programdata\\microsoft\\windows", "file_reference:c:\\windows\\explorer.exe",
    "file_reference:\\device\\harddiskvolume3\\program", "process_reference:winlogon.exe", "process_reference:explorer.exe", "process_reference:onedrive.exe",
    "process_reference:onedrivesetup.exe", "process_reference:onedrivestandaloneupdater.exe", "process_reference:microsoft.sharepoint.exe", "process_reference:filecoauth.exe",
    "process_reference:filecoauthlib64.dll", "process_reference:explorerframe.dll", "process_reference:tiworker.exe", "process_reference:mmres.dll", "process_reference:svchost.exe",
]
#: (test of the kind, title)
OBJECT_TITLES = [
    ("kind = 'ntfs_data_run'", "NTFS DATA runlist の横断一致"), ("kind = 'ntfs_attribute'", "NTFS 属性構造の横断一致"), ("kind LIKE 'prefetch_%'", "Prefetch 構造の横断一致"),
    ("kind = 'lnk_property_value'", "LNK PropertyStore の横断一致"), ("kind IN ('ese_page_tag', 'ese_table_hint')", "ESE 内部構造の横断一致"),
    ("kind IN ('process_reference', 'file_reference')", "構造抽出された実体の横断一致"), ("true", "構造オブジェクトの横断一致"),
]
OBJECT_LEVELS = [
    ("kind IN ('ntfs_data_run', 'lnk_property_value') AND types >= 2", "high"), ("kind IN ('ese_page_tag', 'ese_table_hint') AND types >= 2", "medium"), ("confidence >= 0.85", "medium"), ("true", "low"),
]
OBJECT_REASONS = [
    ("kind = 'lnk_property_value'", "LNK PropertyStore の同一キー/値候補が複数イベントまたは複数アーティファクトで一致"),
    ("kind IN ('ese_page_tag', 'ese_table_hint')", "ESE ページタグまたはテーブル名候補が複数イベントまたは複数アーティファクトで一致"),
    ("kind LIKE 'prefetch_%'", "Prefetch の版別構造/実行時刻/セクションが複数イベントで一致"), ("true", "artifact_objects の構造キーが複数イベントまたは複数アーティファクトで一致"),
]
OBJECT_SCORE = (
    "35 * types + least(events, 25) + 5 * least(step_count, 25) + CASE WHEN kind IN ('ntfs_data_run', 'lnk_property_value') THEN 25 ELSE 0 END"
    " + CASE WHEN kind IN ('ese_page_tag', 'ese_table_hint') THEN 15 ELSE 0 END"
)


def ladder(steps: list[tuple[str, str]]) -> str:
    """The value of the first test that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in steps) + " END"


def object_chains(ef: DataFrame) -> DataFrame:
    """Objects of one kind and key in several events or types of artifact; one partial aggregation, hot keys send one row a task.

    A chain's types are a bit each, so that events are the only distinct values: rows are not multiplied, and no groups hold sets.
    """
    rows = chained_objects(ef).where((F.length("key") >= 3) & ~F.col("key").isin(COMMON_OBJECTS))
    bits, types, names = type_bits(ef)
    grouped = rows.groupBy("kind", "key").agg(
        F.count("*").alias("events"), F.countDistinct("event_id").alias("step_count"), F.min("event_time_utc").alias("first_seen"), F.max("event_time_utc").alias("last_seen"),
        F.max("confidence").alias("confidence"), *bits).withColumns({"types": types, "artifact_types": names})
    return grouped.where("step_count >= 2 OR types >= 2").select(
        F.concat(F.lit("artifact_object:"), "kind").alias("kind"), "key", F.expr(ladder(OBJECT_TITLES)).alias("title"), F.expr(ladder(OBJECT_LEVELS)).alias("severity"), "artifact_types", "events", "step_count",
        "first_seen", "last_seen", F.expr(OBJECT_SCORE).cast("long").alias("score"), F.expr(ladder(OBJECT_REASONS)).alias("explanation"))


_REF = " UNION ALL ".join(f"SELECT event_id, '{k}_reference' AS kind, {c} AS name FROM ef WHERE {c} NOT IN ('', '-')" for k, c in REFERENCES.items())
_J = lambda k: f"json_extract_string(attributes_json, '$.{k}')"
query("derive_reference_objects", f", r AS ({_REF}) SELECT sha256(event_id || '|' || kind || '|' || name) AS object_id, event_id, kind, name, CAST(0.6 AS DOUBLE) AS confidence FROM r", over="ef")(reference_objects)
for _name in TYPES:
    query(f"derive_{_name}_objects", f", o AS ({_duck([_name])}) SELECT * FROM o", over="ef")(lambda ef, g=_name: derive_objects(ef, g))
_OFFSETS = f"""SELECT event_id, source_file_id, coalesce(CAST({_J('record_offset')} AS BIGINT), 0) AS "offset", least(greatest(coalesce(CAST({_J('record_size')} AS BIGINT), 4096), 1), 65536) AS length, artifact_type || '_record' AS kind FROM ef"""
query("derive_offsets", _OFFSETS, over="ef")(offsets)
for _name in ("mft", "prefetch", "link", "ese"):
    query(f"derive_{_name}_offsets", f", o AS ({_duck([_name], spots=True)}) SELECT * FROM o", over="ef")(lambda ef, g=_name: derive_spots(ef, g))
_ALL = f"SELECT event_id, artifact_type, event_time_utc, kind, lower(kind || ':' || name) AS key, name, CAST(NULL AS BIGINT) AS \"offset\", CAST(NULL AS BIGINT) AS length, CAST(0.6 AS DOUBLE) AS confidence FROM ({_REF}) JOIN ef USING (event_id) UNION ALL {_duck(list(TYPES))}"


def _kept_objects(ef: DataFrame) -> DataFrame:
    """A stored table that has objects of some events only, under names of its own, and not of event 42."""
    some = artifact_objects(ef.where("event_id IN ('ev00000040', 'ev00000041', 'ev00000043')")).withColumn("name", F.concat(F.lit("kept "), "name"))
    return event_objects(stored(some, "objects"), ef, ["ev00000040", "ev00000042", "ev00000043", "absent"])


query("event_artifact_objects", f""", r AS ({_ALL}) SELECT event_id, kind, key, CASE WHEN event_id = 'ev00000042' THEN name ELSE 'kept ' || name END AS name, confidence FROM r
 WHERE event_id IN ('ev00000040', 'ev00000042', 'ev00000043') ORDER BY confidence DESC, event_id, kind, key, name LIMIT 100""", over="ef")(_kept_objects)
query("event_evidence_offsets", f"SELECT \"offset\", length FROM ({_OFFSETS}) WHERE event_id IN ('ev00000042', 'ev00000043', 'ev00000045')", over="ef")(
    lambda ef: offsets(ef.where("event_id IN ('ev00000042', 'ev00000043', 'ev00000045')")).select("offset", "length").orderBy("offset").limit(50)
)
OBJECT_CHAINS = f""", o0 AS ({_ALL}), o1 AS (SELECT * FROM o0 WHERE kind IN ({', '.join(f"'{k}'" for k in CHAINED)})),
 o2 AS (SELECT kind, key, count(DISTINCT artifact_type) AS types, string_agg(DISTINCT artifact_type, ',' ORDER BY artifact_type) AS artifact_types, count(*) AS events, count(DISTINCT event_id) AS step_count, min(event_time_utc) AS first_seen,
  max(event_time_utc) AS last_seen, max(confidence) AS confidence FROM o1 WHERE key NOT IN ({', '.join(f"'{k}'" for k in COMMON_OBJECTS)}) GROUP BY 1, 2 HAVING count(DISTINCT event_id) >= 2 OR count(DISTINCT artifact_type) >= 2),
 object_chains AS (SELECT 'artifact_object:' || kind AS kind, key, {ladder(OBJECT_TITLES)} AS title, {ladder(OBJECT_LEVELS)} AS severity, artifact_types, events, step_count, first_seen, last_seen, CAST({OBJECT_SCORE} AS BIGINT) AS score,
  {ladder(OBJECT_REASONS)} AS explanation FROM o2)"""
query("object_chains", OBJECT_CHAINS + " SELECT * FROM object_chains", over="ef")(object_chains)
