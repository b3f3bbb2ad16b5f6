"""Partial dates as Columns: sort keys, text, shape, filters and spans.

A date is a struct (modifier, quality, d1, m1, y1, s1, d2, m2, y2, s2, text,
sortval); 0 is an unknown day or month. Day numbers are integer arithmetic, so
years before 1 work and no date parsing can fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_DDL = "struct<modifier:int,quality:int,d1:int,m1:int,y1:int,s1:boolean,d2:int,m2:int,y2:int,s2:boolean,text:string,sortval:bigint>"
#: Modifiers of a date.
REGULAR, BEFORE, AFTER, ABOUT, RANGE, SPAN, TEXT_ONLY, FROM, TO = range(9)
#: Words before and after a date's text, by modifier and by quality.
PREFIXES = {BEFORE: "before ", AFTER: "after ", ABOUT: "about ", RANGE: "between ", SPAN: "from ", FROM: "from ", TO: "to "}
SUFFIXES = {1: " (estimated)", 2: " (calculated)"}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("bigint")


def julian_day(y: Column, m: Column, d: Column) -> Column:
    """Julian day number of a Gregorian date; unknown (0) month and day count as 1."""
    m, d, y = F.greatest(m, F.lit(1)).cast("bigint"), F.greatest(d, F.lit(1)).cast("bigint"), y.cast("bigint")
    early = _div(14 - m, 12)
    year, month = y + 4800 - early, m + early * 12 - 3
    return d + _div(month * 153 + 2, 5) + _div(year * 1461, 4) - _div(year, 100) + _div(year, 400) - 32045


def month_days(y: Column, m: Column) -> Column:
    """Length of a month."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(30 + (m + _div(m, 8)) % 2).cast("bigint")


def last_day(y: Column, m: Column, d: Column) -> Column:
    """Julian day number of the last day that a partial date may mean."""
    month = F.when(m == 0, 12).otherwise(m)
    return julian_day(y, month, F.when((m == 0) | (d == 0), month_days(y, month)).otherwise(d))


def sort_key(date: Column) -> Column:
    """Day number of the (first) date; 0 where there is none: no year, or text only."""
    return F.when((date["modifier"] == TEXT_ONLY) | (F.coalesce(date["y1"], F.lit(0)) == 0), F.lit(0)).otherwise(
        julian_day(date["y1"], F.coalesce(date["m1"], F.lit(0)), F.coalesce(date["d1"], F.lit(0)))
    ).cast("bigint")


def _is_day(y: Column, m: Column, d: Column) -> Column:
    return (m >= 1) & (m <= 12) & (d <= month_days(y, m)) & (y <= 9999)


def _one(y: Column, m: Column, d: Column) -> Column:
    month = F.get(F.array(*map(F.lit, MONTHS)), m - 1)
    year4 = F.lpad(y.cast("string"), 4, "0")
    return (
        F.when(~_is_day(y, F.greatest(m, F.lit(1)), d), y.cast("string"))
        .when((m > 0) & (d > 0), F.concat(F.lpad(d.cast("string"), 2, "0"), F.lit(" "), month, F.lit(" "), year4))
        .when(m > 0, F.concat(month, F.lit(" "), year4))
        .otherwise(y.cast("string"))
    )


def date_text(date: Column, formatted: Column | None = None) -> Column:
    """Readable text: the preformatted string if there is one; else the parts the date has; else "date unknown"."""
    n = lambda c: F.coalesce(date[c], F.lit(0))
    modifier = n("modifier")
    second = modifier.isin(RANGE, SPAN) & (n("y2") > 0)
    joiner = F.when(modifier == RANGE, " and ").otherwise(" to ")
    body = F.concat(_one(n("y1"), n("m1"), n("d1")), F.when(second, F.concat(joiner, _one(n("y2"), n("m2"), n("d2")))).otherwise(""))
    prefix, suffix = F.lit(""), F.lit("")
    for k, v in PREFIXES.items():
        prefix = F.when(modifier == k, v).otherwise(prefix)
    for k, v in SUFFIXES.items():
        suffix = F.when(n("quality") == k, v).otherwise(suffix)
    text = (
        F.when(date.isNull(), "date unknown")
        .when(modifier == TEXT_ONLY, F.coalesce(F.nullif(date["text"], F.lit("")), F.lit("date unknown")))
        .when(n("y1") <= 0, "date unknown")
        .otherwise(F.concat(prefix, body, suffix))
    )
    return text if formatted is None else F.coalesce(F.nullif(formatted, F.lit("")), text)


def shape_error(modifier: Column, quality: Column, dateval: Column) -> Column:
    """Why a written date is refused, or null: the length of ``dateval`` must suit the modifier."""
    n = F.coalesce(F.size(dateval), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return (
        F.when(~F.coalesce(modifier, F.lit(0)).between(0, 8), "modifier outside 0..8")
        .when(~F.coalesce(quality, F.lit(0)).between(0, 2), "quality outside 0..2")
        .when(F.coalesce(modifier, F.lit(0)) == TEXT_ONLY, F.lit(None))
        .when(F.coalesce(modifier, F.lit(0)).isin(RANGE, SPAN) & (n != 8), "needs 8 entries")
        .when(~F.coalesce(modifier, F.lit(0)).isin(RANGE, SPAN) & (n < 4), "needs 4 entries")
    )


def date_filter(date: Column, spec: str) -> Column:
    """Filter by ``y/m/d`` with ``*`` wildcards, ``-y/m/d``, ``y/m/d-y/m/d`` or ``y/m/d-``; undated rows fail."""
    key = sort_key(date)
    if "-" not in spec:
        out = key > 0
        for name, want in zip(("y1", "m1", "d1"), spec.split("/")):
            out = out & (F.lit(True) if want == "*" else date[name] == int(want))
        return out
    low, _, high = spec.partition("-")
    bound = lambda t, f: f(*(F.lit(int(x)) for x in (t.split("/") + ["0", "0"])[:3]))
    out = key > 0
    if low:
        out = out & (key >= bound(low, julian_day))
    if high:
        out = out & (key <= bound(high, last_day))
    return out


def span_parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Whole years, months and days from date ``a`` to date ``b`` (unknown parts count as 1)."""
    v = lambda d, c: F.greatest(F.coalesce(d[c], F.lit(0)), F.lit(1 if c != "y1" else 0))
    borrow = F.when(v(b, "d1") < v(a, "d1"), 1).otherwise(0)
    months = (v(b, "y1") * 12 + v(b, "m1")) - (v(a, "y1") * 12 + v(a, "m1")) - borrow
    # days since the last monthly anniversary, counted in the month before b
    january = v(b, "m1") == 1
    length = month_days(v(b, "y1") - january.cast("int"), F.when(january, 12).otherwise(v(b, "m1") - 1))
    days = v(b, "d1") - F.when(borrow == 1, F.least(v(a, "d1").cast("bigint"), length) - length).otherwise(v(a, "d1"))
    return _div(months, 12), months % 12, days.cast("bigint")


def span_text(a: Column, b: Column, precision: int = 2) -> Column:
    """"82 years, 7 months, 28 days": the first ``precision`` units that are not zero; null if either is undated or b is before a."""
    parts = []
    for n, unit in zip(span_parts(a, b), ("year", "month", "day")):
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))))
    text = F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, precision), ", ")
    known = (sort_key(a) > 0) & (sort_key(b) > 0) & (sort_key(b) >= sort_key(a))
    return F.when(known, F.when(text == "", "0 days").otherwise(text))
