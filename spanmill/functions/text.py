"""Scalar functions: names, durations, labels, search terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_function(name: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(name, ".", -1)


def package_of(name: Column) -> Column:
    """Prefix up to the first dot after the last slash."""
    return F.regexp_extract(name, r"^((?:.*/)?[^./]*)", 1)


def package_class(name: Column) -> Column:
    p = package_of(name)
    return F.when(p == "runtime", "runtime").when(p == "main", "main").when(~F.contains(F.split(p, "/")[0], F.lit(".")), "stdlib").otherwise("third-party")


def round_duration(d: Column) -> Column:
    """Exact below 1 ms, to microseconds below 1 s, else to milliseconds; half away from zero."""
    return F.when(d < 1_000_000, d).when(d < 1_000_000_000, F.expr("0") + F.floor((d + 500) / 1000) * 1000).otherwise(F.floor((d + 500_000) / 1_000_000) * 1_000_000).cast("bigint")


def duration_table(d: Column) -> Column:
    """'1.234 µs' with three digits, cut off, of the rounded duration."""
    r = round_duration(d)
    part = lambda unit, label: F.format_string("%d.%03d " + label, F.floor(r / unit).cast("bigint"), F.pmod(F.floor(r / (unit // 1000)).cast("bigint"), F.lit(1000)))
    return F.when(r == 0, "0.000  s").when(r < 1_000_000, part(1000, "µs")).when(r < 1_000_000_000, part(1_000_000, "ms")).otherwise(part(1_000_000_000, " s"))


def duration_exact(d: Column) -> Column:
    return F.format_string("%d.%09d", F.floor(d / 1_000_000_000).cast("bigint"), F.pmod(d, F.lit(1_000_000_000)))


def timestamp_text(ts: Column) -> Column:
    return F.concat(F.format_number(ts, 0), F.lit(" ns"))


def goroutine_label(g: Column, func: Column) -> Column:
    return F.when(func.isNull() | (func == ""), F.concat(F.lit("goroutine "), g)).otherwise(F.concat(F.lit("goroutine "), g, F.lit(": "), func))


def task_label(task: Column, name: Column) -> Column:
    return F.concat(F.lit("task "), F.format_number(task, 0), F.when(name != "", F.concat(F.lit(": "), name)).otherwise(""))


def duration_si(d: Column) -> Column:
    """The rounded duration in its largest unit below a minute, trailing zeros cut off: '1.5ms', '0s'."""
    r = round_duration(d)

    def part(unit: int, digits: int, label: str) -> Column:
        whole, rest = F.floor(r / unit).cast("bigint"), F.pmod(r, F.lit(unit))
        frac = F.rtrim(F.lpad(rest.cast("string"), digits, "0"), F.lit("0"))
        return F.concat(whole.cast("string"), F.when(rest == 0, "").otherwise(F.concat(F.lit("."), frac)), F.lit(label))

    minute, hour = 60_000_000_000, 3_600_000_000_000
    seconds = lambda c: F.concat(F.floor(c / 1_000_000_000).cast("bigint").cast("string"), F.when(F.pmod(c, F.lit(1_000_000_000)) == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(F.pmod(c, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("0")))), F.lit("s"))
    long = F.concat(F.when(r >= hour, F.concat(F.floor(r / hour).cast("bigint").cast("string"), F.lit("h"))).otherwise(""), F.pmod(F.floor(r / minute).cast("bigint"), F.lit(60)).cast("string"), F.lit("m"), seconds(F.pmod(r, F.lit(minute))))
    return F.when(r == 0, "0s").when(r < 1000, F.concat(r.cast("string"), F.lit("ns"))).when(r < 1_000_000, part(1000, 3, "µs")).when(r < 1_000_000_000, part(1_000_000, 6, "ms")).when(r < minute, seconds(r)).otherwise(long)


def duration_scientific(d: Column, digits: int = 2) -> Column:
    """Seconds as '1.23e-04'."""
    return F.format_string(f"%.{digits}e", d / F.lit(1e9))


def zoom_level(ns: Column, pixels: int) -> Column:
    return F.floor(F.log2(ns / F.lit(pixels))).cast("bigint")


def tick_interval(ns_per_px: Column, min_px: int) -> Column:
    """Smallest power of ten that is at least min_px wide."""
    return F.pow(F.lit(10.0), F.ceil(F.log10(ns_per_px * min_px))).cast("bigint")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def timeline_matches(text: str, kind: Column, ident: Column, label: Column) -> Column:
    """All words of `text` must match: g and p: any goroutine or processor, g12 or p3 that one, else part of the label."""

    def one(term: str) -> Column:
        t = term.lower()
        number = t[1:].replace(",", "")
        if t == "g":
            return kind == "G"
        if t == "p:":
            return kind == "P"
        if t[0] in "gp" and number.isdigit():
            return (kind == t[0].upper()) & (ident == int(number))
        return F.contains(F.lower(label), F.lit(t))

    return _all([one(t) for t in text.split()])


def command_matches(text: str, label: Column, secondary: Column, category: Column, aliases: Column) -> Column:
    """All words of `text` stand in the label, secondary label, category or an alias."""
    has = lambda c, t: F.coalesce(F.contains(F.lower(c), F.lit(t)), F.lit(False))
    return _all([has(label, t) | has(secondary, t) | has(category, t) | F.coalesce(F.exists(aliases, lambda a: F.contains(F.lower(a), F.lit(t))), F.lit(False)) for t in text.lower().split()])
