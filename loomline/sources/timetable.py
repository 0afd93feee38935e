"""Free-text timetables: titles and slots by line, with the last title and day carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seasons as S
from ..functions import text as X
from ..operators import records as R
from .library import empty_rating, item_from

NAME = "Bahamut Anime Crazy"
#: Forms of titles, days and times in a line.
QUOTED = r"[《「『](.+?)[》」』]"
AFTER_TIME = r"(?:[01]?\d|2[0-3])[:：][0-5]?\d\s*(?:更新|上架|播出|開播|起)?\s*([^,，。;；|｜]+)"
LEAD_IN, TAIL = r"^(?:更新|上架|播出|開播|動畫|節目)\s*", r"\s*(?:更新|上架|播出|開播|第\d+話|第\d+集).*$"
DAY = r"(?:(\d{4})[/.-])?(\d{1,2})[/.-](\d{1,2})"
TIME = r"([01]?\d|2[0-3])[:：]([0-5]?\d)"
RECURRING = rf"{DAY}.{{0,32}}?(?:每週|每周|每|週|周)\s*[一二三四五六日天].{{0,16}}?{TIME}"
EXPLICIT = rf"{DAY}(?:\s*[（(][^）)]*[）)])?.{{0,24}}?{TIME}"
TIME_ALONE = rf"(?:^|\s){TIME}(?:\s|$|[《「『])"


def _title(line: Column, pattern: str) -> Column:
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, pattern, 1), LEAD_IN, ""), TAIL, "")
    return X.filled(found)


def _two(text: Column) -> Column:
    return F.lpad(text.cast("int").cast("string"), 2, "0")


def _day(line: Column, pattern: str, year: Column) -> Column:
    """A day as the line has it, of the timetable's year unless it names one; null for no day of the calendar's form."""
    part = [X.given(F.regexp_extract(line, pattern, k)) for k in (1, 2, 3)]
    good = part[1].cast("int").between(1, 12) & part[2].cast("int").between(1, 31)
    return F.when(S.yes(good), F.concat_ws("-", F.coalesce(part[0], year.cast("string")), _two(part[1]), _two(part[2])))


def _time(line: Column, pattern: str, first: int) -> Column:
    hour, minute = (X.given(F.regexp_extract(line, pattern, k)) for k in (first, first + 1))
    return F.when(hour.isNotNull(), F.concat_ws(":", _two(hour), _two(minute)))


def entries(pages: DataFrame) -> DataFrame:
    """Entries of timetables (url, text, year, retrievedAt): title, url, sn, uploadDate, uploadTime, format, retrievedAt.

    A recurring slot counts before an explicit one, that before a time alone,
    which takes the last day that a line named.
    """
    text = X.nfkc(X.named_entities(X.markup_to_text(F.col("text"))))
    rows = pages.select("url", "year", "retrievedAt", F.posexplode(F.split(text, r"\r?\n")).alias("place", "line"))
    rows = rows.withColumn("line", X.trim(F.regexp_replace("line", f"[{X.SPACE}]+", " "))).where(F.length("line") > 0)
    line, year = F.col("line"), F.col("year")
    rows = rows.withColumns({"_day": _day(line, DAY, year), "_title": F.coalesce(_title(line, QUOTED), _title(line, AFTER_TIME))})
    rows = rows.withColumns({"_last_day": R.carried(F.col("_day"), "url", ["place"]), "title": R.carried(F.col("_title"), "url", ["place"])})
    found = F.coalesce(
        *(F.when(_day(line, p, year).isNotNull(), F.struct(_day(line, p, year).alias("d"), _time(line, p, 4).alias("t"))) for p in (RECURRING, EXPLICIT)),
        F.when(_time(line, TIME_ALONE, 1).isNotNull() & F.col("_last_day").isNotNull(), F.struct(F.col("_last_day").alias("d"), _time(line, TIME_ALONE, 1).alias("t"))),
    )
    rows = rows.withColumn("_slot", found).where(F.col("_slot").isNotNull() & F.col("title").isNotNull())
    out = rows.select(X.trim(F.col("title")).alias("title"), "url", X.given(F.regexp_extract("url", r"[?&]sn=(\d+)", 1)).alias("sn"), F.col("_slot.d").alias("uploadDate"), F.col("_slot.t").alias("uploadTime"), F.lit(None).cast("long").alias("bangumiSubjectId"), F.lit("tv").alias("format"), "retrievedAt", "place")
    return R.first_by_key(out.withColumn("_t", X.identity_title(F.col("title"))), ["_t", "uploadDate", "uploadTime"], ["url", "place"]).drop("_t").select(*out.columns)


def to_items(found: DataFrame, now: str) -> DataFrame:
    """Items of entries with a real day; Taipei's clock is China's."""
    c = F.col
    none = F.lit(None).cast("string")
    rows = found.where(S.is_date(c("uploadDate"))).withColumn("_at", F.coalesce(X.given(c("retrievedAt")), F.lit(now)))
    source = F.struct(F.lit(NAME).alias("name"), F.lit("streaming_platform").alias("type"), c("url").alias("url"), c("_at").alias("retrievedAt"), F.lit(None).cast("double").alias("confidence"), F.lit("taiwan_streaming").alias("scope"))
    time = F.when(S.is_time(c("uploadTime")), c("uploadTime"))
    episode = F.struct(F.lit(None).cast("int").alias("episodeNumber"), none.alias("episodeTitle"), c("uploadDate").alias("airDate"), time.alias("airTime"), F.lit(S.CHINA).alias("timezone"), F.lit("confirmed").alias("status"), source.alias("source"), none.alias("rawTimeText"))
    schedule, primary, life = F.array(episode), S.primary_season(c("uploadDate")), S.lifecycle(c("uploadDate"), F.try_to_timestamp("_at"))
    over, subject = life["status"] == "finished", c("bangumiSubjectId")
    return item_from(
        rows, id=F.when(subject.isNotNull(), F.concat(F.lit("anime:"), subject.cast("string"))).otherwise(F.concat(F.lit("anime:bahamut:"), F.coalesce("sn", X.slugified(c("title"))))),
        title=F.struct(c("title").alias("original"), none.alias("japanese"), c("title").alias("chinese"), none.alias("english"), F.array().cast("array<string>").alias("aliases")), format=F.coalesce("format", F.lit("unknown")), status=life["status"],
        startDate=c("uploadDate"), endDate=life["endDate"], datePrecision=F.lit("day"), primarySeason=primary, activeSeasons=S.active_seasons(schedule, primary), updateWeekday=F.when(~over, S.update_weekday(F.lit(None).cast("int"), schedule, c("uploadDate"))),
        updateTime=F.when(~over, time), timezone=F.lit(S.CHINA), isJapaneseAnime=F.lit(True), inclusionStatus=F.when(c("format").isin("tv", "web"), F.lit("included")).otherwise(F.lit("needs_review")),
        externalIds=F.struct(subject.alias("bangumiSubjectId"), c("sn").alias("bahamutSn")), bangumi=empty_rating(subject), schedule=schedule, sources=F.array(source), dataStatus=F.lit("partial"), updatedAt=c("_at"), createdAt=c("_at"),
    )
