"""Column functions over dates. Nothing reads the clock: each takes the instant it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def age_days(ts: Column, as_of: Column) -> Column:
    """Age in days, rounded half up."""
    return F.floor((_micros(as_of) - _micros(ts)) / F.lit(DAY_MICROS) + 0.5).cast("long")


def age_days_floor(ts: Column, as_of: Column) -> Column:
    """Age in whole days begun, rounded down."""
    return F.floor((_micros(as_of) - _micros(ts)) / F.lit(DAY_MICROS)).cast("long")


def age_bucket(days: Column) -> Column:
    return F.when(days <= 14, "<=14d").when(days <= 30, "15-30d").when(days <= 90, "31-90d").when(days <= 365, "91-365d").otherwise(">1yr")


def recency_rank(ts: Column, as_of: Column) -> Column:
    """4, 3, 2, 1 within 1, 7, 30, 180 days, else 0; not rounded."""
    days = (_micros(as_of) - _micros(ts)) / F.lit(DAY_MICROS)
    return F.when(days <= 1, 4).when(days <= 7, 3).when(days <= 30, 2).when(days <= 180, 1).otherwise(0).cast("long")


def recency_tier(ts: Column, as_of: Column) -> Column:
    rank = recency_rank(ts, as_of)
    return F.when(rank >= 3, "week").when(rank == 2, "recent").otherwise("historical")


def _rounded(n: Column, unit: int) -> Column:
    """n over a whole unit, half up."""
    return F.floor(n / unit + 0.5).cast("string")


def _years(days: Column) -> Column:
    """Years to one decimal."""
    return F.format_string("%.1f", F.round(days / 365, 1))


def age_phrase(days: Column) -> Column:
    """How long ago something was published, in words; what is dated ahead counts as today."""
    years = F.regexp_replace(_years(days), r"\.0$", "")
    return (
        F.when(days <= 0, "published today")
        .when(days == 1, "published yesterday")
        .when(days < 14, F.concat(F.lit("published "), days.cast("string"), F.lit(" days ago")))
        .when(days < 61, F.concat(F.lit("published "), _rounded(days, 7), F.lit(" weeks ago")))
        .when(days < 365, F.concat(F.lit("published "), _rounded(days, 30), F.lit(" months ago")))
        .when(days.isNotNull(), F.concat(F.lit("published "), years, F.when(years == "1", " year ago").otherwise(" years ago")))
    )


def age_on_card(days: Column) -> Column:
    """The age of a current reference, coarser with time; empty if unknown."""
    return (
        F.when(days <= 1, "today")
        .when(days <= 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days <= 14, "this fortnight")
        .when(days <= 31, "this month")
        .when(days <= 92, "this quarter")
        .when(days.isNotNull(), F.concat(_rounded(days, 30), F.lit(" months ago")))
        .otherwise("")
    )


def age_in_context(days: Column) -> Column:
    """The age of a reference kept for context; null if unknown."""
    return (
        F.when(days <= 92, F.concat(days.cast("string"), F.lit(" days old")))
        .when(days <= 365, F.concat(_rounded(days, 30), F.lit(" months old")))
        .when(days.isNotNull(), F.concat(_years(days), F.lit(" years old")))
    )


#: Days after the ceiling at which each way of rounding an age and comparing it lets a source expire.
EXPIRY_OFFSETS = {"round>": 0.5, "round>=": -0.5, "floor>": 1.0, "floor>=": 0.0, "ceil>": 0.0, "ceil>=": -1.0}


def expires_at(ts: Column, ceiling: int, rule: str) -> Column:
    """The instant, in microseconds, at which a source of that time passes the ceiling in days under a rule."""
    return _micros(ts) + F.lit(int((ceiling + EXPIRY_OFFSETS[rule]) * DAY_MICROS))


def expired(due: Column, as_of: Column, rule: str) -> Column:
    """Whether expires_at() has come: rules that round up let a source stay at the instant itself."""
    return due < _micros(as_of) if rule.startswith("ceil") else due <= _micros(as_of)


def year_band(year: Column, first: int) -> Column:
    """Uncertainty in months: 2, and one more for each year after the first."""
    return (F.lit(2) + F.greatest(F.lit(0), year - first)).cast("long")


def precision(band: Column) -> Column:
    return F.when(band <= 2, "month").when(band <= 4, "quarter").when(band <= 7, "half").otherwise("year")


def timing_label(year: Column, month: Column, precision: Column) -> Column:
    """`May 2026`, `Q2 2027`, `H1 2029` or `Mid 2033`, no more precise than stated; null without a month."""
    y = year.cast("string")
    names = F.array(*map(F.lit, "January February March April May June July August September October November December".split()))
    phase = F.when(month <= 4, "Early").when(month <= 8, "Mid").otherwise("Late")
    label = (
        F.when(precision == "month", F.concat_ws(" ", F.try_element_at(names, month.cast("int")), y))
        .when(precision == "quarter", F.concat(F.lit("Q"), F.ceil(month / 3).cast("string"), F.lit(" "), y))
        .when(precision == "half", F.concat(F.lit("H"), F.when(month <= 6, "1").otherwise("2"), F.lit(" "), y))
        .otherwise(F.concat_ws(" ", phase, y))
    )
    return F.when(month.between(1, 12), label)


def band_text(band: Column) -> Column:
    """`±1 month`, `±3 months`; empty without a band."""
    return F.when(band.isNull(), "").otherwise(F.concat(F.lit("±"), band.cast("string"), F.when(band == 1, " month").otherwise(" months")))


def window_end(year: Column, month: Column, band: Column) -> Column:
    """Last day of the month that the band still reaches; without a band that of the month itself."""
    first = F.when(month.between(1, 12), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    return F.last_day(F.add_months(first, F.coalesce(band.cast("int"), F.lit(0))))


def probability_band(p: Column) -> Column:
    return F.when(p.isNull(), "unstated").when(p >= 80, "very likely").when(p >= 60, "likely").when(p >= 40, "even").otherwise("low")


def hours_since(ts: Column, as_of: Column) -> Column:
    """Hours to as_of; infinity for what can't be read."""
    return F.coalesce((_micros(as_of) - _micros(ts)) / 3.6e9, F.lit(float("inf")))


def share_percent(part: Column, whole: Column) -> Column:
    """One decimal, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 1000 / whole + 0.5) / 10).otherwise(F.lit(0.0))


def day_bar(ts: Column) -> Column:
    """What a later day must pass: the instant itself, or for a bare date the last microsecond of its day."""
    bare = _micros(ts) % DAY_MICROS == 0
    return F.when(bare, _micros(ts) + DAY_MICROS - 1000).otherwise(_micros(ts))
