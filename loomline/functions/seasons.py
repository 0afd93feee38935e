"""Dates, times, seasons and lifecycles as column expressions.

Dates are ``YYYY-MM-DD`` strings and times ``HH:mm`` strings, as in the files.
A season is struct(year, quarter); :func:`season_order` makes it an integer
that sorts.  Predicates are two-valued: a null operand makes them false.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QUARTERS

#: From this day of a quarter's last month on, a start counts for the next quarter.
LEAD_DAY = {3: 18, 6: 17, 9: 17, 12: 18}
#: A season is over so many days after its last one.
GRACE_DAYS = 90
QUARTER_LABELS = {"winter": "一月新番", "spring": "四月新番", "summer": "七月新番", "fall": "十月新番"}
WEEKDAYS = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")

JAPAN, CHINA = "Asia/Tokyo", "Asia/Shanghai"


def yes(condition: Column) -> Column:
    """A condition that is false where it would be null."""
    return F.coalesce(condition, F.lit(False))


def date_of(date: Column) -> Column:
    """A real calendar date from a strict ``YYYY-MM-DD`` string, else null."""
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date.try_cast("date"))


def is_date(date: Column) -> Column:
    return date_of(date).isNotNull()


def is_time(time: Column) -> Column:
    return yes(time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"))


def is_instant(text: Column) -> Column:
    """An ISO 8601 date, or date and time."""
    return yes(F.try_to_timestamp(text).isNotNull() & text.rlike(r"^\d{4}-\d{2}"))


def text_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def month_quarter(month: Column) -> Column:
    """Name of the quarter that a month lies in."""
    return F.element_at(F.array(*map(F.lit, QUARTERS)), F.ceil(month / F.lit(3)).cast("int"))


def quarter_month(quarter: Column) -> Column:
    """First month of a quarter; null for another name."""
    place = F.array_position(F.array(*map(F.lit, QUARTERS)), quarter)
    return F.when(place > 0, place * 3 - 2).cast("int")


def season(year: Column, quarter: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), quarter.alias("quarter"))


def season_order(value: Column) -> Column:
    """An integer that sorts seasons: 12 to a year."""
    return value["year"] * 12 + quarter_month(value["quarter"])


def season_of_order(order: Column) -> Column:
    """The season that :func:`season_order` makes an integer of."""
    month = F.pmod(order - 1, F.lit(12)) + 1
    return season(F.floor((order - 1) / 12), month_quarter(month))


def _quarter_order(month: Column) -> Column:
    """Order of the season that a month (counted from the year 0) lies in."""
    return (month - F.pmod(month, F.lit(3)) + 1).cast("int")


def calendar_order(date: Column) -> Column:
    """Order of the season whose months hold the date; null if it isn't one."""
    day = date_of(date)
    return _quarter_order(F.year(day) * 12 + F.month(day) - 1)


def primary_order(date: Column) -> Column:
    """Order of the season that a start counts for: late in a quarter's last month it is the next.

    Arithmetic without branches: a null date makes a null, and Spark evaluates
    the date once.
    """
    day = date_of(date)
    month = F.month(day)
    late = F.lit(0)
    for last, first in LEAD_DAY.items():
        late = late + ((month == last) & (F.dayofmonth(day) >= first)).cast("int")
    return _quarter_order(F.year(day) * 12 + month - 1 + late)


def _season_or_null(order: Column) -> Column:
    return F.when(order.isNotNull(), season_of_order(order))


def calendar_season(date: Column) -> Column:
    """The season whose months hold the date; null if it isn't one."""
    return _season_or_null(calendar_order(date))


def primary_season(date: Column) -> Column:
    """The season that a start counts for; see :func:`primary_order`."""
    return _season_or_null(primary_order(date))


def current_season(now: Column) -> Column:
    """The season that a start today, in China, would count for."""
    return primary_season(F.date_format(F.from_utc_timestamp(now, CHINA), "yyyy-MM-dd"))


def order_now(now: datetime) -> int:
    """Order of the :func:`current_season` of an instant, which is UTC if it names no zone."""
    day = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(timezone(timedelta(hours=8)))
    month = day.year * 12 + day.month - 1 + (day.day >= LEAD_DAY.get(day.month, 32))
    return month - month % 3 + 1


def start_bounds(order: int) -> tuple[date, date]:
    """The first day whose start counts for a season, and the first day after those: a plain range that scans can use."""
    year, month = divmod(order - 1, 12)
    before = date(year, month, 1) if month else date(year - 1, 12, 1)
    return before.replace(day=LEAD_DAY[before.month]), date(year, month + 3, LEAD_DAY[month + 3])


def same_season(left: Column, right: Column) -> Column:
    return yes((left["year"] == right["year"]) & (left["quarter"] == right["quarter"]))


def distinct_seasons(seasons: Column) -> Column:
    """Distinct seasons in order."""
    return F.transform(F.array_sort(F.array_distinct(F.transform(seasons, season_order))), season_of_order)


def active_orders(schedule: Column) -> Column:
    """Distinct orders of the calendar seasons of a schedule's days, ascending."""
    return F.array_sort(F.array_distinct(F.transform(schedule, lambda e: calendar_order(e["airDate"]))))


def active_seasons(schedule: Column, primary: Column) -> Column:
    """Calendar seasons of a schedule's days; without a schedule the primary season, if there is one."""
    nothing = F.filter(F.array(primary), lambda s: s.isNotNull() & s["year"].isNotNull())
    return F.when(yes(F.size(schedule) > 0), F.transform(active_orders(schedule), season_of_order)).otherwise(nothing)


def weekday(date: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(date_of(date)) + 1).cast("int")


def update_weekday(given: Column, schedule: Column, start: Column) -> Column:
    """A given weekday; else none if the schedule was moved; else that of its first day, or of the start."""
    moved = yes(F.exists(schedule, lambda e: yes(e["status"].isin("delayed", "changed"))))
    first = F.array_min(F.filter(F.transform(schedule, lambda e: e["airDate"]), is_date))
    return F.when(yes(given.between(1, 7)), given).when(~moved, F.coalesce(weekday(first), weekday(start)))


def membership(primary: Column, active: Column, order: Column) -> Column:
    """not_active, new or continuing in the season of the given order."""
    is_active = yes(F.exists(active, lambda s: yes(season_order(s) == order)))
    earlier = yes(season_order(primary) < order)
    return F.when(~is_active, F.lit("not_active")).when(earlier, F.lit("continuing")).otherwise(F.lit("new"))


def minutes(time: Column) -> Column:
    """Minute of the day; null unless the time is valid."""
    return F.when(is_time(time), F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 4, 2).cast("int"))


def clock(minute: Column) -> Column:
    return F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(minute, F.lit(60)).cast("string"), 2, "0"))


def week_minute(day: Column, time: Column, zone: Column) -> Column:
    """Minute of the week in China of a weekly slot; Japan is an hour ahead. Null without a valid slot."""
    hour = F.when(yes(zone == CHINA), F.lit(0)).otherwise(F.lit(60))
    return F.when(yes(day.between(1, 7)), F.pmod((day - 1) * 1440 + minutes(time) - hour, F.lit(10080)))


def china_slot(day: Column, time: Column, zone: Column) -> Column:
    """struct(weekday, time) of a weekly slot in China; null without a valid one."""
    at = week_minute(day, time, zone)
    return F.when(at.isNotNull(), F.struct((F.floor(at / 1440) + 1).cast("int").alias("weekday"), clock(F.pmod(at, F.lit(1440)).cast("int")).alias("time")))


def weekday_label(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), day)


def slot_label(status: Column, day: Column, time: Column, zone: Column) -> Column:
    """What a page shows for a slot."""
    slot = china_slot(day, time, zone)
    return (
        F.when(yes(status == "finished"), F.lit("已完结"))
        .when(slot.isNotNull(), F.concat_ws(" ", weekday_label(slot["weekday"]), slot["time"]))
        .when(yes(day.between(1, 7)), F.concat_ws(" ", weekday_label(day), F.lit("时间待定")))
        .otherwise(F.lit("暂未确定"))
    )


def china_clock(now: Column) -> Column:
    """struct(weekday, minute) of an instant in China."""
    there = F.from_utc_timestamp(now, CHINA)
    return F.struct((F.weekday(there) + 1).alias("weekday"), (F.hour(there) * 60 + F.minute(there)).alias("minute"))


def days_between(old: Column, new: Column) -> Column:
    """Days from one date to another; 0 if either isn't one."""
    return F.coalesce(F.datediff(date_of(new), date_of(old)), F.lit(0))


def shift(date: Column, days: Column) -> Column:
    """A date moved by days; what isn't a date stays."""
    return F.coalesce(text_of(F.date_add(date_of(date), days.cast("int"))), date)


def instant_slot(text: Column) -> Column:
    """struct(date, time) in China of an instant; a bare date is midnight in Japan."""
    bare = F.length(text) == 10
    at = F.when(bare, F.to_utc_timestamp(F.try_to_timestamp(text), JAPAN)).otherwise(F.try_to_timestamp(text))
    there = F.from_utc_timestamp(at, CHINA)
    return F.when(at.isNotNull(), F.struct(F.date_format(there, "yyyy-MM-dd").alias("date"), F.date_format(there, "HH:mm").alias("time")))


def instant(date: Column, time: str, hours: int) -> Column:
    """UTC instant of a date's time at an offset of hours."""
    return F.try_to_timestamp(F.concat(text_of(date_of(date)), F.lit(f"T{time}"))) - F.make_interval(hours=F.lit(hours))


def season_end(date: Column) -> Column:
    """Last day of the calendar quarter of a date."""
    return text_of(F.last_day(F.add_months(F.trunc(date_of(date), "quarter"), 2)))


def long_past(date: Column, now: Column) -> Column:
    """Whether the date's season ended more than GRACE_DAYS ago."""
    return yes(F.unix_timestamp(now) - F.unix_timestamp(instant(season_end(date), "23:59:59", 9)) > GRACE_DAYS * 86400)


def lifecycle(start: Column, now: Column) -> Column:
    """struct(status, endDate) of a row that only a start is known of."""
    return (
        F.when(yes(instant(start, "00:00:00", 9) > now), F.struct(F.lit("announced").alias("status"), F.lit(None).cast("string").alias("endDate")))
        .when(long_past(start, now), F.struct(F.lit("finished").alias("status"), season_end(start).alias("endDate")))
        .otherwise(F.struct(F.lit("airing").alias("status"), F.lit(None).cast("string").alias("endDate")))
    )


def status_of(start: Column, end: Column, now: Column, hours: int = 9) -> Column:
    """announced, finished, airing or unknown from a row's dates at an offset of hours."""
    return (
        F.when(yes(instant(start, "00:00:00", hours) > now), F.lit("announced"))
        .when(yes(instant(end, "23:59:59", hours) < now), F.lit("finished"))
        .when(start.isNull(), F.lit("unknown"))
        .otherwise(F.lit("airing"))
    )


def weekly_end(start: Column, episodes: Column) -> Column:
    """Day of the last of so many weekly episodes."""
    return F.when(yes(episodes > 0) & is_date(start), shift(start, (episodes - 1) * 7))


def end_of(last: Column, known: Column, start: Column, episodes: Column, now: Column) -> Column:
    """End date: the last scheduled day, unless episodes are missing from the schedule; else weekly; else that of a past season."""
    weekly = weekly_end(start, episodes)
    past = F.when(long_past(start, now), season_end(start))
    return F.when(yes(known > 0), F.when(yes(known < episodes), weekly).otherwise(last)).when(episodes.isNotNull(), weekly).otherwise(past)


def precision(date: Column) -> Column:
    return F.when(is_date(date), F.lit("day")).when(yes(date.rlike(r"^\d{4}-\d{2}$")), F.lit("month")).when(yes(date.rlike(r"^\d{4}$")), F.lit("year")).otherwise(F.lit("unknown"))


def weekly_days(start: Column, episodes: Column) -> Column:
    """Days of so many weekly episodes from the start on; empty without either."""
    days = F.transform(F.sequence(F.lit(0), episodes - 1), lambda k: shift(start, k * 7))
    return F.when(yes(episodes > 0) & is_date(start), days).otherwise(F.array().cast("array<string>"))


def aired(days: Column, today: Column, episodes: Column) -> Column:
    """Days up to today, no more than the episodes there are, if that is known."""
    n = F.size(F.filter(days, lambda d: yes(d <= today)))
    return F.when(episodes.isNotNull(), F.least(n, episodes)).otherwise(n)


def lookup_months(year: int, first: int) -> list[tuple[int, int]]:
    """Months whose snapshots a season is looked up in: from the one before its first to the one after that and the next."""
    return [((year * 12 + first - 1 + k) // 12, (year * 12 + first - 1 + k) % 12 + 1) for k in range(-1, 3)]
