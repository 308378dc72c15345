"""Scalar functions for names, versions, durations, log lines and their scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(s, r"\W", " ")), r"\s+", "-"))


def hyphenate(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "-")


def name_of(s: Column) -> Column:
    """The part before the last ``@`` that is not the first character."""
    return F.regexp_extract(s, r"^(.+?)(?:@([^@]*))?$", 1)


def version_of(s: Column) -> Column:
    """The part after that ``@``; null if there is none."""
    return F.nullif(F.regexp_extract(s, r"^(.+?)(?:@([^@]*))?$", 2), F.lit(""))


def aliased_name(s: Column) -> Column:
    return F.concat_ws("_", name_of(s), version_of(s))


def version_key(v: Column) -> Column:
    """For comparison by numbers: (major, minor, patch)."""
    parts = F.split(v, r"\.")
    return F.struct(*[F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("int"), F.lit(0)).alias(f"p{k}") for k in (1, 2, 3)])


def expand_adaptor(s: Column, prefix: str) -> Column:
    return F.when(s.contains("/") | s.endswith(".js"), s).otherwise(F.concat(F.lit(prefix), s))


def duration(ms: Column) -> Column:
    """``250ms``, ``2.5s``, ``1m 5s``; ``ms`` whole."""
    seconds = lambda x: F.regexp_replace(F.format_string("%.3f", x / 1000.0), r"\.?0+$", "")
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(seconds(ms), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m "), seconds(ms % 60_000), F.lit("s")))
    )


def micros_text(ns: Column) -> Column:
    """Whole microseconds of nanoseconds; exact, so in decimals."""
    return F.floor(ns.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("string")


def is_uuid(s: Column) -> Column:
    return s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def host_port(s: Column) -> Column:
    """(host, port) of ``host:port``; null if it is not of that form."""
    return F.when(s.rlike(r"^[^:]+:\d+$"), F.struct(F.split(s, ":")[0].alias("host"), F.split(s, ":")[1].cast("int").alias("port")))


def hash_of(version: Column) -> Column:
    """The hash of ``source:hash``; versions match when these do."""
    return F.try_element_at(F.split(version, ":"), F.lit(-1))


def regex_from(text: str) -> str:
    """``abc``, ``/abc/`` or ``/abc/i`` as a pattern for ``rlike``."""
    if text.startswith("/") and "/" in text[1:]:
        body, flags = text[1:].rsplit("/", 1)
        known = "".join(f for f in flags if f in "ims")
        return (f"(?{known})" if known else "") + body
    return text


def canonical_json(s: Column) -> Column:
    """A JSON text with sorted keys."""
    return F.to_json(F.parse_json(s))


def cache_key(config: Column, adaptor: Column) -> Column:
    return F.sha2(F.concat(canonical_json(config), F.lit("-"), adaptor), 256)


def first_having(key: str, *maps: Column, default: Column | None = None) -> Column:
    """The value in the first map that has ``key``."""
    out = default if default is not None else F.lit(None)
    for m in reversed(maps):
        out = F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(out)
    return out


def json_kind(s: Column) -> Column:
    """``array``, ``object`` or ``value`` of a JSON text."""
    return F.when(F.ltrim(s).startswith("["), "array").when(F.ltrim(s).startswith("{"), "object").otherwise("value")


def sanitize(s: Column, policy: str = "summarize") -> Column:
    """Objects and arrays in JSON form, for the log: ``remove``, ``summarize`` or ``obfuscate``; values as they are."""
    kind = json_kind(s)
    if policy == "remove":
        return F.when(kind == "value", s)
    if policy == "obfuscate":
        return F.when(kind == "value", s).otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    n, keys = F.json_array_length(s), F.json_object_keys(s)
    array = F.when(n == 0, F.lit("(empty array)")).otherwise(F.concat(F.lit("(array with "), n.cast("string"), F.lit(" items)")))
    obj = F.when(F.size(keys) == 0, F.lit("(empty object)")).otherwise(F.concat(F.lit("(object with keys "), F.array_join(F.array_sort(keys), ", "), F.lit(")")))
    return F.when(kind == "array", array).when(kind == "object", obj).otherwise(s)


def mask(configuration: Column) -> Column:
    """Every value of a configuration map hidden."""
    return F.transform_values(configuration, lambda k, v: F.lit("****"))


# Result texts of sanitize and the order of log levels.
LEVELS = {"debug": 0, "info": 1, "log": 1, "default": 2, "always": 2, "warn": 2, "success": 2, "none": 9, "error": 100, "none-really": 1000}


def logged(level: Column, least: str) -> Column:
    """True where a line of ``level`` is written at the logger's level ``least``."""
    table = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(F.element_at(table, level) >= LEVELS[least], F.lit(False))
