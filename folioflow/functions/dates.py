"""Dates as Spark columns: guessing, human and PDF forms, mail dates, ages.

All results are instants in UTC; the session's time zone is expected to be
UTC. Everything but the optional fuzzy reading stays in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Hours from UTC of the zone names that are understood.
ZONES = {"utc": 0, "gmt": 0, "z": 0, "pdt": -7, "pst": -8, "mdt": -6, "mst": -7, "cdt": -5, "cst": -6, "edt": -4, "est": -5, "cest": 2, "cet": 1}
_ZONE = r"(z|[+-]\d{2}:?\d{2}|" + "|".join(k for k in ZONES if k != "z") + r")?"
_CLOCK = rf"(?:[ ,t]+(?:at )?(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?:\.\d+)?\s*([ap]m)?\s*{_ZONE}(?:\s|$|\())?"
_MONTH = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
#: Forms of dates: a pattern and which groups are year, month and day; the clock's groups follow.
_FORMS = (
    (rf"(?i)(?:^|\D)(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_CLOCK}", (1, 2, 3)),
    (rf"(?i)(?:^|\D)(\d{{1,2}})(?:st|nd|rd|th)?[ -]+(?:of )?{_MONTH},?[ -]+(\d{{4}}){_CLOCK}", (3, 2, 1)),
    (rf"(?i)\b{_MONTH} +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}}){_CLOCK}", (3, 1, 2)),
    (rf"(?i)(?:^|\D)(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_CLOCK}", (1, 2, 3)),
)
_US = rf"(?i)(?:^|\D)(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_CLOCK}"
_PDF = r"^(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?\s*(Z|[+-]\d{2}:?\d{2})?"
EPOCH = "1970-01-01 00:00:00"


def pdf_date(text: Column) -> Column:
    """The date of a PDF's metadata less its mark, with a colon in the zone and nothing behind it."""
    text = F.regexp_replace(text, "^D:", "")
    text = F.regexp_replace(text, r"([+-]\d{2})'?(\d{2})'?", "$1:$2")
    return F.regexp_replace(text, r"([+-]\d{2}:\d{2}).*$", "$1")


def _month(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])
    return F.coalesce(F.try_element_at(numbers, F.lower(name)), name)


def _day(year: Column, month: Column, day: Column) -> Column:
    """The day of three numbers, counted from the epoch; null if there is no such day. Nothing is thrown and caught."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when((year >= 0) & month.between(1, 12) & (day >= 1) & (day <= last), F.unix_date(F.make_date(year, month, day)))


def _instant(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None, half: Column | None = None, zone: Column | None = None) -> Column:
    """The instant of the parts, which are texts and may be empty; null if there is no such date."""
    blank = lambda c, by: F.coalesce(F.nullif(c, F.lit("")), F.lit(by)) if c is not None else F.lit(by)
    h = blank(hour, "0").cast("int")
    if half is not None:
        h = F.when(F.lower(half) == "pm", h % 12 + 12).when(F.lower(half) == "am", h % 12).otherwise(h)
    local = _day(year.try_cast("int"), blank(month, "1").try_cast("int"), blank(day, "1").try_cast("int"))
    named = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v * 60)])
    sign = F.when(zone.startswith("-"), -1).otherwise(1) if zone is not None else F.lit(1)
    digits = F.regexp_replace(zone, r"\D", "") if zone is not None else F.lit("")
    given = sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))
    offset = F.when(F.length(digits) == 4, given).otherwise(F.coalesce(F.try_element_at(named, F.lower(zone)), F.lit(0))) if zone is not None else F.lit(0)
    seconds = h * 3600 + blank(minute, "0").cast("int") * 60 + blank(second, "0").cast("int") - offset * 60
    ok = (h < 24) & (blank(minute, "0").cast("int") < 60) & (blank(second, "0").cast("int") < 61)
    return F.when(ok, F.timestamp_seconds(local.cast("bigint") * 86400 + seconds))


def human_date(text: Column) -> Column:
    """The day of a date such as ``11 Oct 2017`` within a text, at midnight; null without one."""
    group = lambda i: F.regexp_extract(text, r"(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})", i)
    month = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))]), F.lower(F.substring(group(2), 1, 3)))
    return F.when(month.isNotNull(), _instant(group(3), month, group(1)))


def iso_date(text: Column) -> Column:
    """An ISO date or instant; one without a zone is in UTC, what is none is null."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")))


@F.pandas_udf(T.TimestampType())
def _fuzzy(text: pd.Series) -> pd.Series:
    from dateutil import parser, tz

    zones = {k.upper(): tz.tzoffset(k.upper(), v * 3600) for k, v in ZONES.items()}

    def one(value: str | None) -> pd.Timestamp | None:
        try:
            found = parser.parse(value, fuzzy=True, tzinfos=zones)
        except (ValueError, OverflowError, TypeError):
            return None
        return pd.Timestamp(found).tz_localize("UTC") if found.tzinfo is None else pd.Timestamp(found).tz_convert("UTC")

    return pd.to_datetime(text.map(one, na_action="ignore"), utc=True)


def _named(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """The instant of the first place that a pattern finds, by its groups of year to zone (0 for none); null without one.

    All groups come from one search: the text becomes them, behind a mark
    that the text itself can't have. Both are bound to names by functions over
    lists of one, so neither is worked out again for each part.
    """
    wanted = "\x01".join(f"${g}" if g else "" for g in groups)
    found = F.regexp_replace(F.translate(text, "\x01", "\x02"), rf"(?s)^.*?{pattern}.*$", "\x01" + wanted)
    parts = F.filter(F.transform(F.array(found), lambda x: F.when(x.startswith("\x01"), F.split(x, "\x01"))), lambda x: x.isNotNull())
    return F.try_element_at(F.transform(parts, lambda x: _instant(x[1], _month(x[2]), *[x[i] for i in range(3, 9)])), F.lit(1))


def guess_date(text: Column, fuzzy: bool = False) -> Column:
    """The instant that a text names in one of the usual forms; null if none does.

    ISO forms, day and month names in either order, years first, month before
    day (day first where the first number is above 12), PDF dates, clocks
    with and without zones. The first form that gives a date wins, in that
    order. With ``fuzzy``, texts that none of them reads go through a general
    parser, in Arrow batches.
    """
    pdf = pdf_date(text)
    # Eight digits or more: a year alone is no date, unless it is marked as a PDF's.
    marked = text.rlike(r"^D:\d{4}") | text.rlike(r"^\d{8}(\d{6})?\s*(Z|[+-]\d{2}.?\d{2}|$)")
    # A form is read only where those before it give no date.
    out = F.coalesce(
        F.when(marked, _named(pdf, _PDF, (1, 2, 3, 4, 5, 6, 0, 7))),
        *[_named(text, pattern, (y, m, d, 4, 5, 6, 7, 8)) for pattern, (y, m, d) in _FORMS],
        *[_named(text, _US, (y, m, d, 4, 5, 6, 7, 8)) for y, m, d in ((3, 1, 2), (3, 2, 1))],
    )
    if fuzzy:
        out = F.coalesce(out, F.when(text.rlike(r"\d"), _fuzzy(text)))
    return F.coalesce(out, human_date(text))


def ago(now: Column, months: int = 0, weeks: int = 0, days: int = 0) -> Column:
    """The instant so many months, weeks and days before another."""
    return now - F.make_interval(F.lit(0), F.lit(months), F.lit(weeks), F.lit(days))


def mail_date(headers: Column) -> Column:
    """A message's date: its ``date`` header, also as ``dd-mm-yyyy``, else ``delivery-date``, else the epoch."""
    get = lambda k: F.try_element_at(headers, F.lit(k))
    numeric = r"(\d{1,2})-(\d{1,2})-(\d{4})"
    g = lambda i: F.regexp_extract(get("date"), numeric, i)
    day_first = F.when(get("date").rlike(r"^\s*" + numeric), _instant(g(3), g(2), g(1)))
    return F.coalesce(day_first, guess_date(get("date")), guess_date(get("delivery-date")), F.lit(EPOCH).cast("timestamp"))


def age_days(date: Column, now: Column) -> Column:
    """How many days, with fractions, a date is before ``now``."""
    return (F.unix_micros(now) - F.unix_micros(date)) / F.lit(86_400_000_000)


def stamp(date: Column) -> Column:
    """The date as a log writes it."""
    return F.date_format(date, "yyyy-MM-dd HH:mm:ss")
