"""Series listed as JSON-LD in HTML pages.

Scripts are cut out by a pattern; the payloads nest in lists, ``item``,
``itemListElement`` and ``@graph`` to any depth, which is why they are walked
in an Arrow function and not by an expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.seasons import active_seasons, instant_slot, lifecycle, primary_season, update_weekday
from ..operators import records as R
from .. import schema as T

NAME = "YourAnimes"
ENTRY = "title string, aliases array<string>, url string, publishedAt string, episodeCount int, bangumiSubjectId long, retrievedAt string, ordinal long"
_SCRIPT = re.compile(r"""<script\s+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.S | re.I)
_REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&#x22;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"))
_SUBJECT = re.compile(r"(?:bgm\.tv|bangumi\.tv)/subject/(\d+)")


def series(value: object) -> Iterator[dict]:
    """All records of type TVSeries in a payload; an element of a list may wrap its record as ``item``."""
    if isinstance(value, list):
        for part in value:
            yield from series(part)
    elif isinstance(value, dict):
        if value.get("@type") == "TVSeries":
            yield value
        elements = value.get("itemListElement")
        for element in elements if isinstance(elements, list) else ():
            yield from series(element["item"] if isinstance(element, dict) and "item" in element else element)
        yield from series(value.get("item"))
        if isinstance(value.get("@graph"), list):
            yield from series(value["@graph"])


def _many(value: object) -> list[str]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, str)]


def _count(value: object) -> int | None:
    try:
        number = float(value) if isinstance(value, str | int | float) and not isinstance(value, bool) else 0
    except ValueError:
        return None
    return int(number) if number > 0 and number == int(number) else None


def page_entries(html: str | None, url: str | None, retrieved: str | None) -> list[tuple]:
    """Rows of ENTRY, without its last column, from one page; scripts that aren't JSON are skipped."""
    out = []
    for found in _SCRIPT.findall(html or ""):
        for name, char in _REFERENCES:
            found = re.sub(name, char, found, flags=re.I)
        try:
            payload = json.loads(found)
        except ValueError:
            continue
        for record in series(payload):
            title = X.trimmed(record["name"]) if isinstance(record.get("name"), str) else ""
            published = record.get("datePublished")
            if title and isinstance(published, str) and published:
                subject = next((int(m[1]) for u in _many(record.get("sameAs")) if (m := _SUBJECT.search(u))), None)
                aliases = list(dict.fromkeys(a for a in map(X.trimmed, _many(record.get("alternateName"))) if a))
                out.append((title, aliases, record["url"] if isinstance(record.get("url"), str) else url, published, _count(record.get("numberOfEpisodes")), subject, retrieved))
    return out


def entries(pages: DataFrame) -> DataFrame:
    """Entries of pages (url, html, retrievedAt): the first of those equal in subject, folded title and date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*entry, k) for html, url, at in zip(*(batch.column(c).to_pylist() for c in ("html", "url", "retrievedAt")), strict=True) for k, entry in enumerate(page_entries(html, url, at))]
            if rows:
                kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
                names = [c.split(" ")[0] for c in ENTRY.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = pages.select("url", "html", "retrievedAt").mapInArrow(run, ENTRY)
    keyed = found.withColumn("_s", F.coalesce(F.col("bangumiSubjectId").cast("string"), F.lit(""))).withColumn("_t", X.search_text(F.col("title")))
    return R.first_by_key(keyed, ["_s", "_t", "publishedAt"], ["url", "ordinal"]).select(*[c.split(" ")[0] for c in ENTRY.split(", ")])


def source_struct(url: Column, retrieved: Column) -> Column:
    return F.struct(F.lit(NAME).alias("name"), F.lit("third_party").alias("type"), url.alias("url"), retrieved.alias("retrievedAt"), F.lit(None).cast("double").alias("confidence"), F.lit("japan_broadcast").alias("scope"))


def to_items(found: DataFrame, now: str) -> DataFrame:
    """Items from entries; those whose date can't be read are left out."""
    from .library import empty_rating, item_from

    retrieved = F.coalesce(X.given(F.col("retrievedAt")), F.lit(now))
    slot = instant_slot(F.col("publishedAt"))
    rows = found.withColumn("_slot", slot).where(F.col("_slot").isNotNull()).withColumn("_at", retrieved)
    day, source = F.col("_slot.date"), source_struct(F.col("url"), F.col("_at"))
    episode = F.struct(F.lit(None).cast("int").alias("episodeNumber"), F.lit(None).cast("string").alias("episodeTitle"), day.alias("airDate"), F.col("_slot.time").alias("airTime"), F.lit("Asia/Shanghai").alias("timezone"), F.lit("confirmed").alias("status"), source.alias("source"), F.lit(None).cast("string").alias("rawTimeText"))
    life, subject = lifecycle(day, F.try_to_timestamp("_at")), F.col("bangumiSubjectId")
    schedule, primary, over = F.array(episode), primary_season(day), lifecycle(day, F.try_to_timestamp("_at"))["status"] == "finished"
    return item_from(
        rows, id=F.when(subject.isNotNull(), F.concat(F.lit("anime:"), subject.cast("string"))).otherwise(F.concat(F.lit("anime:youranimes:"), X.slugified(F.col("title")))),
        title=F.struct(F.col("title").alias("original"), F.lit(None).cast("string").alias("japanese"), F.col("title").alias("chinese"), F.lit(None).cast("string").alias("english"), F.col("aliases")),
        format=F.lit("tv"), status=life["status"], startDate=day, endDate=life["endDate"], datePrecision=F.lit("day"), primarySeason=primary, activeSeasons=active_seasons(schedule, primary),
        updateWeekday=F.when(~over, update_weekday(F.lit(None).cast("int"), schedule, day)), updateTime=F.when(~over, F.col("_slot.time")), timezone=F.lit("Asia/Shanghai"),
        episodeCount=F.col("episodeCount"), airedEpisodeCount=F.when(over, F.col("episodeCount")), isJapaneseAnime=F.lit(True), inclusionStatus=F.lit("included"),
        officialUrl=F.when(F.col("url").startswith("http"), F.col("url")), externalIds=F.struct(subject.alias("bangumiSubjectId"), F.lit(None).cast("string").alias("bahamutSn")),
        bangumi=empty_rating(subject), schedule=schedule, sources=F.array(source), dataStatus=F.lit("partial"), updatedAt=F.col("_at"), createdAt=F.col("_at"),
    ).select(*T.ITEM.fieldNames())
