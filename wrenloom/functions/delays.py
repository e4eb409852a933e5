"""Waiting times, range arithmetic and display of durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def task_backoff(backoff_ns: Column, attempt: Column) -> Column:
    """Nanoseconds after failed attempt 0, 1 ...: doubled each time, without a cap."""
    return backoff_ns.cast("bigint") * F.pow(F.lit(2), attempt).cast("bigint")


def request_backoff(base_ns: Column, attempt: Column) -> Column:
    """Nanoseconds before attempt 1, 2 ... of a request: from the base (2 s if that is 0), doubled, 10 s at most. None before attempt 0."""
    base = F.when(base_ns <= 0, 2 * SECOND).otherwise(base_ns)
    doubled = base * F.pow(F.lit(2), F.least(attempt - 1, F.lit(30))).cast("bigint")
    return F.when(attempt <= 0, F.lit(0)).otherwise(F.least(doubled, F.lit(10 * SECOND))).cast("bigint")


def part_backoff(attempt: Column) -> Column:
    """Nanoseconds before attempt 1, 2 ... of a segment or chunk: 2, 4, 8, then 10 s. None before attempt 0."""
    return F.when(attempt <= 0, F.lit(0)).otherwise(F.least(F.pow(F.lit(2), F.least(attempt, F.lit(30))).cast("bigint") * SECOND, F.lit(10 * SECOND))).cast("bigint")


def chunk_end(start: Column, chunk: Column, total: Column) -> Column:
    """The last byte, included, of the chunk at start."""
    return F.least(start + chunk - 1, total - 1)


def shown_seconds(ns: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}fs", ns / SECOND)


def json_or_empty(text: Column) -> Column:
    """Stored JSON content: an empty object for none."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("{}"))


def merged_headers(defaults: Column, given: Column) -> Column:
    """Request headers: those given win over the defaults. Null counts as none."""
    none = F.create_map().cast("map<string,string>")
    own, base = F.coalesce(given, none), F.coalesce(defaults, none)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def merged_cookies(defaults: Column, given: Column) -> Column:
    """Cookies: the defaults, then those given."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(defaults, none), F.coalesce(given, none))


def request_headers(user_agent: Column, headers: Column, referer: Column, cookies: Column) -> Column:
    """What is sent: the user agent, the headers over it, then referer and cookies over these. Empty values are left out."""
    one = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.create_map(F.lit(name), value))
    out = merged_headers(one("User-Agent", user_agent), headers)
    out = merged_headers(out, one("Referer", referer))
    return merged_headers(out, one("Cookie", F.array_join(F.coalesce(cookies, F.array().cast("array<string>")), "; ")))
