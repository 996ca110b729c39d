"""Dates, times and durations. Values without an offset count as UTC, which is also the implicit time zone."""

from __future__ import annotations

from dataclasses import replace

from treequill.functions.registry import function
from treequill.functions.values import EMPTY, Val, cast, error, integer, one
from treequill.xpath.errors import XPathError


def _as(v: Val, kind: str) -> Val:
    v = one(v)
    if v.type == "empty":
        return v
    if v.type == "untyped":
        return cast(v, kind)
    if v.type != kind and not (kind == "duration" and v.type in ("yearMonth", "dayTime")):
        raise XPathError("XPTY0004", f"{v.type} is no {kind}")
    return v


@function("current-dateTime", 0)
def current_datetime() -> Val:
    return Val("cast(to_utc_timestamp(current_timestamp(), current_timezone()) as timestamp_ntz)", "dateTime", tz="0")


@function("current-date", 0)
def current_date() -> Val:
    return cast(current_datetime(), "date")


@function("current-time", 0)
def current_time() -> Val:
    return cast(current_datetime(), "time")


@function("implicit-timezone", 0)
def implicit_timezone() -> Val:
    return Val("cast(0 as decimal(28, 6))", "dayTime")


def _part(name: str, kind: str, sql: str, out: str = "integer") -> None:
    @function(f"{name}-from-{kind}", 1)
    def part(v: Val) -> Val:
        v = _as(v, kind)
        return EMPTY if v.type == "empty" else Val(sql.format(v.sql), out)


for _name in ("year", "month", "day"):
    for _kind in ("dateTime", "date"):
        _part(_name, _kind, f"cast({_name}({{0}}) as bigint)")
_part("hours", "dateTime", "cast(hour({0}) as bigint)")
_part("minutes", "dateTime", "cast(minute({0}) as bigint)")
_part("seconds", "dateTime", "cast(extract(SECOND FROM {0}) as decimal(38, 18))", "decimal")
_part("hours", "time", "cast({0} div 3600 as bigint)")
_part("minutes", "time", "cast({0} div 60 % 60 as bigint)")
_part("seconds", "time", "cast({0} % 60 as decimal(38, 18))", "decimal")


def _zone(kind: str) -> None:
    @function(f"timezone-from-{kind}", 1)
    def zone(v: Val) -> Val:
        v = _as(v, kind)
        return Val("cast(null as decimal(28, 6))" if v.type == "empty" or v.tz is None else f"cast({v.tz} * 60 as decimal(28, 6))", "dayTime")

    @function(f"adjust-{kind}-to-timezone", 1, 2)
    def adjust(v: Val, to: Val | None = None) -> Val:
        """With an offset, the same instant there; without, the local value gets it. An empty offset takes the value's away."""
        v = _as(v, kind)
        if v.type == "empty":
            return EMPTY
        if to is not None and to.type == "empty":
            return replace(v, tz=None, node=False)
        secs = "0" if to is None else _as(to, "dayTime").sql
        bad = f"abs({secs}) > 50400 or {secs} % 60 <> 0"
        minutes = f"cast(case when {bad} then {error('FODT0003', 'no such time zone')} else {secs} / 60 end as int)"
        if v.tz is None:
            return replace(v, tz=minutes, node=False)
        delta = f"if({v.tz} is null, 0, {minutes} - {v.tz})"
        if kind == "time":
            local = f"cast((({v.sql} + {delta} * 60) % 86400 + 86400) % 86400 as decimal(14, 6))"
        else:
            moved = f"timestampadd(MINUTE, {delta}, cast({v.sql} as timestamp_ntz))"
            local = f"cast({moved} as date)" if kind == "date" else moved
        return replace(v, sql=local, tz=minutes, node=False)


for _kind in ("dateTime", "date", "time"):
    _zone(_kind)


def _duration_part(name: str, unit: str, sql: str, out: str = "integer") -> None:
    @function(f"{name}-from-duration", 1)
    def part(v: Val) -> Val:
        v = _as(v, "duration")
        if v.type == "empty":
            return EMPTY
        whole = cast(v, "duration")
        return Val(sql.format(whole.sql if unit == "months" else whole.secs), out)


_duration_part("years", "months", "{0} div 12")
_duration_part("months", "months", "{0} % 12")
_duration_part("days", "secs", "cast({0} div 86400 as bigint)")
_duration_part("hours", "secs", "cast({0} div 3600 % 24 as bigint)")
_duration_part("minutes", "secs", "cast({0} div 60 % 60 as bigint)")
_duration_part("seconds", "secs", "cast({0} % 60 as decimal(38, 18))", "decimal")


@function("dateTime", 2)
def date_time(day: Val, clock: Val) -> Val:
    day, clock = _as(day, "date"), _as(clock, "time")
    if "empty" in (day.type, clock.type):
        return EMPTY
    local = f"timestampadd(MICROSECOND, cast({clock.sql} * 1000000 as bigint), cast({day.sql} as timestamp_ntz))"
    if day.tz and clock.tz:
        tz = f"case when {day.tz} <> {clock.tz} then {error('FORG0008', 'two time zones')} else coalesce({day.tz}, {clock.tz}) end"
    else:
        tz = day.tz or clock.tz
    return Val(local, "dateTime", tz=tz)
