"""The catalogue's season pages: entries between comment markers of HTML, and their items."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seasons as S
from ..functions import text as X
from ..operators import records as R
from .library import empty_rating, item_from

NAME = "YucWiki"
#: Markers that begin an entry, and what ends the last one of a section.
MARKER = r"<!--#([A-Za-z](?:\d{2}|-[A-Za-z0-9]+)?)-->"
SECTION_END = r'(?s)(?:<p class="future_intro_|<div style="clear:both"></div>\s*<br>\s*<br>|</body>).*$'
#: Formats that an entry's texts tell, in the order that they are asked.
FORMATS = (("movie", "剧场|劇場|映画|movie|电影|電影"), ("ova", r"\bova\b|oad"), ("sp", r"\bsp\b|特别篇|特別篇"))
ADVANCE, REGULAR = "网络先行|網絡先行|配信先行", r"周|晚间|深夜|朝|午前|午後|\d{1,2}:\d{2}"
WEB = "网络放送|web|网播"
WORKS = (("original", "原创"), ("manga", "漫画|漫改"), ("novel", "小说|轻改"), ("game", "游戏"))
AHEAD = "先行|先播|先導|提前"


_NUMERIC = re.compile(r"&#(?:x([0-9a-f]{1,6})|(\d{1,7}));", re.I)
_NAMED = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"'}
_MARKUP = ((re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.S | re.I), "\n"), (re.compile(r"<br\s*/?>", re.I), "\n"), (re.compile(r"</(?:p|div|li|tr|td|h[1-6]|section|article)>", re.I), "\n"), (re.compile(r"<[^>]+>"), " "))


def decode(text: str) -> str:
    """Numeric references, then the named ones one after the other: decoding comes before markup here."""
    text = _NUMERIC.sub(lambda m: chr(n) if (n := int(m[1], 16) if m[1] else int(m[2])) < 0x110000 else m[0], text)
    for name, char in _NAMED.items():
        text = re.sub(f"&{name};", char, text, flags=re.I)
    return text


def one_line(html: str) -> str:
    text = decode(html)
    for pattern, to in _MARKUP:
        text = pattern.sub(to, text)
    return X.single_spaced(text)


_decoded, _one_line = X.string_udf(decode), X.string_udf(one_line)


def decoded(text: Column) -> Column:
    return _decoded(text)


def plain(html: Column) -> Column:
    """Text of a cell in one line; null if nothing is left."""
    return X.given(_one_line(html))


def _cell(pattern: str) -> Column:
    return plain(X.given(F.regexp_extract("block", f"(?s){pattern}", 1)))


def entries(pages: DataFrame) -> DataFrame:
    """Entries of pages (url, html, year, season, retrievedAt).

    An entry reaches from its marker to the next, or to the end of its section.
    Markers without a number are numbered after the highest of their letter so
    far; markers of one page meet in one window.
    """
    starts = F.split("html", MARKER)
    names = F.regexp_extract_all("html", F.lit(MARKER), F.lit(1))
    rows = pages.select("url", "year", "season", "retrievedAt", F.posexplode(F.arrays_zip(names.alias("anchor"), F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))).alias("block"))).alias("place", "e")).select("*", "e.*").drop("e")
    rows = rows.withColumn("block", F.regexp_replace("block", SECTION_END, "")).withColumn("letter", F.upper(F.substring("anchor", 1, 1)))
    number = F.when(F.col("anchor").rlike(r"^[A-Za-z]\d{2}$"), F.substring("anchor", 2, 2).cast("int"))
    rows = rows.withColumn("number", number)
    # An unnumbered marker is one more than the last: a numbered one before it starts the count anew, if it is higher.
    by = Window.partitionBy("url", "letter").orderBy("place")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    unnumbered = F.count_if(F.col("number").isNull()).over(upto)
    lead = F.max(F.col("number") - F.col("_before")).over(upto)
    rows = rows.withColumn("_before", unnumbered).withColumn("_lead", lead)
    rows = rows.withColumn("number", F.coalesce("number", F.greatest(F.coalesce("_lead", F.lit(0)), F.lit(0)) + F.col("_before")))
    rows = rows.withColumn("id", F.concat("letter", F.lpad(F.col("number").cast("string"), 2, "0")))
    anchors = F.regexp_extract_all("block", F.lit(r"(?s)(<a\s+[^>]*href=\"[^\"]+\"[^>]*>.*?</a>)"), F.lit(1))
    site = F.get(F.filter(anchors, lambda a: X.matches(X.markup_to_text(a), "动画官网|動畫官網|官网|公式")), F.lit(0))
    rows = rows.withColumn("_site", F.regexp_extract(site, 'href="([^"]+)"', 1))
    found = rows.select(
        "id", F.col("year").alias("pageYear"), F.col("season").alias("pageSeason"), _cell(r'<p class="title_cn[^"]*">(.*?)</p>').alias("titleChinese"), _cell(r'<p class="title_jp[^"]*">(.*?)</p>').alias("titleJapanese"),
        _cell(r'<td class="type_(?!tag)[^"]*">(.*?)</td>').alias("typeText"), _cell(r'<td class="type_tag[^"]*">(.*?)</td>').alias("tagText"), _cell(r'<td[^>]+class="staff_[^"]*"[^>]*>(.*?)</td>').alias("staffText"),
        _cell(r'<p class="broadcast[^"]*">(.*?)</p>').alias("broadcastText"), _cell(r'<p class="broadcast_ex[^"]*">(.*?)</p>').alias("broadcastExtraText"), X.given(X.trim(decoded(F.col("_site")))).alias("officialUrl"),
        X.given(X.trim(decoded(F.regexp_extract("block", r'<img\b[^>]*(?:data-src|src)="([^"]+)"', 1)))).alias("coverImageUrl"), F.concat("url", F.lit("#"), "anchor").alias("url"), "retrievedAt", F.col("url").alias("page"), "place",
    )
    named = found.where(F.coalesce("titleJapanese", "titleChinese").isNotNull()).withColumns({"_j": F.coalesce("titleJapanese", F.lit("")), "_c": F.coalesce("titleChinese", F.lit(""))})
    return R.first_by_key(named, ["page", "id", "_j", "_c"], ["place"]).drop("_j", "_c").select("id", *[c for c in found.columns if c != "id"])


_DAY, _TIME, _AHEAD = re.compile(r"(\d{1,2})/(\d{1,2})"), re.compile(r"([01]?\d|2[0-3]):([0-5]\d)"), re.compile(AHEAD)


def first_showing(text: str) -> tuple[int | None, int | None, str | None]:
    """Month, day and time of a broadcast's text: the first day that isn't an advance showing, else the first."""
    text = unicodedata.normalize("NFKC", text)
    days = list(_DAY.finditer(text))
    day = next((d for d in days if not _AHEAD.search(text[d.start() : d.start() + 18])), days[0] if days else None)
    time = _TIME.search(text)
    return (int(day[1]) if day else None, int(day[2]) if day else None, f"{int(time[1]):02d}:{time[2]}" if time else None)


_SHOWING = T.StructType([T.StructField("month", T.IntegerType()), T.StructField("day", T.IntegerType()), T.StructField("time", T.StringType())])


@F.pandas_udf(_SHOWING)
def _showing(texts: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([first_showing(t or "") for t in texts], columns=["month", "day", "time"], dtype=object)
    return found.astype({"month": "Int32", "day": "Int32"})


def slot(text: Column, year: Column, season: Column) -> Column:
    """struct(date, time) of a broadcast, null without a day; December on a January page is the year before."""
    shown = _showing(text)
    date = F.format_string("%d-%02d-%02d", F.when((season == 1) & (shown["month"] == 12), year - 1).otherwise(year), shown["month"], shown["day"])
    return F.when(shown["month"].isNotNull(), F.struct(date.alias("date"), shown["time"].alias("time")))


def entry_format() -> Column:
    text = F.lower(X.nfkc(F.concat_ws(" ", "typeText", "tagText", "broadcastText", "broadcastExtraText")))
    out = F.when(X.matches(text, WEB) | (X.matches(text, ADVANCE) & ~X.matches(text, REGULAR)), F.lit("web")).otherwise(F.lit("tv"))
    for name, pattern in reversed(FORMATS):
        out = F.when(X.matches(text, pattern), F.lit(name)).otherwise(out)
    return out


def work_type(text: Column) -> Column:
    out = X.given(text)
    for name, pattern in reversed(WORKS):
        out = F.when(X.matches(text, pattern), F.lit(name)).otherwise(out)
    return out


def studios(text: Column) -> Column:
    """Studios that a staff text names, split at commas and slashes."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n| {2,}"), lambda s: X.trim(s)), lambda s: F.length(s) > 0)
    said = F.filter(F.transform(lines, lambda s: F.regexp_extract(s, r"动画制作[:：]\s*(.+)$", 1)), lambda s: F.length(s) > 0)
    names = F.flatten(F.transform(said, lambda s: F.split(s, "[、,，/]")))
    return F.coalesce(F.array_distinct(F.filter(F.transform(names, lambda n: X.trim(n)), lambda n: F.length(n) > 0)), F.array().cast("array<string>"))


def english(title: Column) -> Column:
    """The first part between slashes that is Latin."""
    return F.get(F.filter(F.transform(F.split(title, "/"), lambda p: X.trim(p)), lambda p: p.rlike(r"^[\p{IsLatin}\d\s:;'\",.!?&∞+\-()]+$")), F.lit(0))


def to_items(found: DataFrame, now: str) -> DataFrame:
    """Items of entries with a day; see :func:`unscheduled` for the others."""
    c = F.col
    at = F.coalesce(X.given(c("retrievedAt")), F.lit(now))
    rows = found.withColumn("_slot", slot(c("broadcastText"), c("pageYear"), c("pageSeason"))).withColumn("_at", at).where(S.is_date(F.col("_slot.date")))
    source = F.struct(F.lit(NAME).alias("name"), F.lit("third_party").alias("type"), c("url").alias("url"), c("_at").alias("retrievedAt"), F.lit(0.9).alias("confidence"), F.lit("japan_broadcast").alias("scope"))
    none = F.lit(None).cast("string")
    day, time = c("_slot.date"), c("_slot.time")
    episode = F.struct(F.lit(None).cast("int").alias("episodeNumber"), none.alias("episodeTitle"), day.alias("airDate"), time.alias("airTime"), F.lit(S.CHINA).alias("timezone"), F.lit("confirmed").alias("status"), source.alias("source"), X.given(F.concat_ws(" ", "broadcastText", "broadcastExtraText")).alias("rawTimeText"))
    schedule, primary, life = F.array(episode), S.primary_season(day), S.lifecycle(day, F.try_to_timestamp("_at"))
    over = life["status"] == "finished"
    title = F.struct(F.coalesce("titleJapanese", "titleChinese").alias("original"), c("titleJapanese").alias("japanese"), c("titleChinese").alias("chinese"), english(c("titleJapanese")).alias("english"), F.filter(F.array("titleChinese", "titleJapanese", english(c("titleJapanese"))), lambda t: S.yes(F.length(X.trim(t)) > 0)).alias("aliases"))
    image = c("coverImageUrl")
    subject = F.lit(None).cast("long")
    return item_from(
        rows.withColumn("_format", entry_format()), id=F.concat(F.lit("anime:yucwiki:"), c("pageYear").cast("string"), F.lpad(c("pageSeason").cast("string"), 2, "0"), F.lit(":"), F.lower("id")), title=title, format=c("_format"), status=life["status"],
        startDate=day, endDate=life["endDate"], datePrecision=F.lit("day"), primarySeason=primary, activeSeasons=S.active_seasons(schedule, primary), updateWeekday=F.when(~over, S.update_weekday(F.lit(None).cast("int"), schedule, day)),
        updateTime=F.when(~over, time), timezone=F.lit(S.CHINA), episodeCount=X.given(F.regexp_extract("broadcastExtraText", r"全\s*(\d+)\s*话", 1)).cast("int"), isJapaneseAnime=F.lit(True),
        inclusionStatus=F.when(c("_format") == "tv", F.lit("included")).otherwise(F.lit("needs_review")), officialUrl=c("officialUrl"), coverImage=F.when(image.isNotNull(), F.struct(image.alias("large"), image.alias("medium"), image.alias("small"), F.lit("manual").alias("source"))),
        externalIds=F.struct(subject.alias("bangumiSubjectId"), none.alias("bahamutSn")), bangumi=empty_rating(subject), schedule=schedule,
        staff=F.struct(studios(c("staffText")).alias("studio"), F.array().cast("array<string>").alias("productionCommittee"), work_type(c("typeText")).alias("originalWorkType")), sources=F.array(source), dataStatus=F.lit("partial"), updatedAt=c("_at"), createdAt=c("_at"),
    )


def unscheduled(found: DataFrame) -> DataFrame:
    """Entries without a day, by which older rows stay (see refresh.inherited)."""
    day = slot(F.col("broadcastText"), F.col("pageYear"), F.col("pageSeason"))["date"]
    return found.where(~S.is_date(F.coalesce(day, F.lit("")))).select("id", "titleChinese", "titleJapanese", "url", "retrievedAt")


def next_season(year: int, month: int) -> tuple[int, int]:
    return (year + 1, 1) if month == 10 else (year, month + 3)


def with_next_page(current: DataFrame, following: DataFrame | None) -> DataFrame:
    """Entries of a season's page and, if there are any and the next season's page is at hand, of that page."""
    return current if following is None or current.isEmpty() else current.unionByName(following)
