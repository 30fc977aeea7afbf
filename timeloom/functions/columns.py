"""Scalar functions of the event model as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
#: cut a process name after the first of these, tried in this order
EXECUTABLE = [".exe", ".dll", ".bat", ".cmd", ".ps1", ".msi", ".js", ".vbs", ".scr", ".com"]


def severity_rank(c: Column | str) -> Column:
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def rank_name(rank: Column) -> Column:
    """The severity of a rank, null for unknown ones."""
    out = F.lit(None).cast("string")
    for name, n in RANKS.items():
        out = F.when(rank == n, name).otherwise(out)
    return out


def severity_max(c: Column | str) -> Column:
    return rank_name(F.max(severity_rank(c)))


def basename(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"^.*[\\/]", ""))


def process_basename(c: Column | str) -> Column:
    name = basename(F.trim(F.translate(F.col(c) if isinstance(c, str) else c, '"', "")))
    cuts = [F.when(F.instr(name, e) > 0, F.substring(name, F.lit(1), F.instr(name, e) + len(e) - 1)) for e in EXECUTABLE]
    return F.coalesce(*cuts, name)


def blank(c: Column | str) -> Column:
    """Null, empty and `-` are blank."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.isin("", "-")


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~blank(c), c)


def attr_string(json: str, *keys: str) -> Column:
    """The first key whose scalar, trimmed, is not blank."""
    return F.coalesce(*[filled(F.trim(F.get_json_object(json, f"$.{k}"))) for k in keys])


def attr_i64(json: str, *keys: str) -> Column:
    return F.coalesce(*[F.get_json_object(json, f"$.{k}").try_cast("bigint") for k in keys])


def truncate_bin(c: Column | str, unit: str) -> Column:
    n, suffix = {"minute": (16, ":00Z"), "hour": (13, ":00:00Z"), "day": (10, "T00:00:00Z")}[unit]
    return F.concat(F.substring(c, 1, n), F.lit(suffix))


def timestamp(c: Column | str) -> Column:
    """An RFC 3339 text as a timestamp, null where it isn't one."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


#: reserved account authorities
ACCOUNTS = r"(NT AUTHORITY|NT SERVICE|Window Manager|Font Driver Host|BUILTIN|WORKGROUP)"


def sanitize_account(c: Column | str) -> Column:
    """Drops what stands before a reserved account authority."""
    return F.regexp_replace(c, rf"(?i)^.*?{ACCOUNTS}\\", r"$1\\")


def sanitize_account_in_message(c: Column | str) -> Column:
    """The same behind the first `user=`."""
    return F.regexp_replace(c, rf"(?i)^((?s:.*?)user=)[^ ]*?{ACCOUNTS}\\", r"$1$2\\")


def sha256_from_hashes(c: Column | str) -> Column:
    """The SHA-256 of a list of named hashes, empty without one."""
    return F.regexp_extract(c, "SHA256=([0-9A-Fa-f]{64})", 1)


def normalize_time(c: Column | str) -> Column:
    """Epoch numbers by their digits (FILETIME, WebKit, micro-, milli-, seconds) within 1990-2100, else an ISO text; else null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    n = F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))
    size = F.length(c)
    seconds = (
        F.when(size >= 18, F.floor(n / 10_000_000) - 11_644_473_600).when((size >= 17), F.floor(n / 1_000_000) - 11_644_473_600)
        .when(size >= 16, F.floor(n / 1_000_000)).when(size >= 13, F.floor(n / 1000)).otherwise(n)
    )
    inside = F.when(seconds.between(631_152_000, 4_102_444_800), F.timestamp_seconds(seconds))
    return F.when(n.isNotNull(), inside).otherwise(F.try_to_timestamp(c))
