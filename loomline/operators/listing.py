"""Reading the library: season pages, search, lookups, sort modes and the weekly follow list.

Every function takes the items as a DataFrame (see :mod:`..schema`) and plans
one query.  JavaScript's stable sorts end in the order of the input: a column
``ordinal`` is the last key wherever the items have one.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seasons as S
from ..functions import text as X
from ..schema import DATA_STATUSES, QUARTERS
from . import rules

#: Results of a search, at first and at most; ids of a lookup at most; the years that can be asked for.
SEARCH_LIMIT, SEARCH_MOST, LOOKUP_MOST, YEARS = 20, 50, 500, (1900, 2100)
SORT_MODES = ("default", "ratingAsc", "ratingDesc", "startDateAsc", "startDateDesc", "updateTimeAsc", "updateTimeDesc")


class QueryError(ValueError):
    """A request that can't be answered, with the public code of the error."""

    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code, self.status = code, status


def asked_season(year: int, month: int) -> tuple[int, str]:
    """Year and quarter of a request; the month is the first of a quarter."""
    if isinstance(year, bool) or not isinstance(year, int) or not YEARS[0] <= year <= YEARS[1]:
        raise QueryError("INVALID_QUERY", "year is invalid")
    if month not in (1, 4, 7, 10):
        raise QueryError("INVALID_QUERY", "season must be one of 1, 4, 7, 10")
    return year, QUARTERS[(month - 1) // 3]


def search_limit(limit: int | None) -> int:
    return SEARCH_LIMIT if isinstance(limit, bool) or not isinstance(limit, int) else min(max(limit, 1), SEARCH_MOST)


def wanted_ids(ids: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(i for i in (X.trimmed(x) for x in ids) if i))[:LOOKUP_MOST]


def visible(primary: Column, active: Column, asked: Column, actual: Column) -> Column:
    """Counts for the season asked for; or that is the actual one, and an older row still runs in it."""
    order = S.season_order(primary)
    runs = F.exists(active, lambda s: S.yes(S.season_order(s) == asked))
    return S.yes(order == asked) | (S.yes(asked == actual) & S.yes(order < asked) & S.yes(runs))


def included(status: Column, optional: bool = True, review: bool = True) -> Column:
    return S.yes(status.isin("included", *["optional"] * optional, *["needs_review"] * review))


def _last(items: DataFrame) -> list[Column]:
    return [F.col("ordinal")] if "ordinal" in items.columns else []


def title_order() -> Column:
    """Titles as a dictionary sorts them, not by code point."""
    return F.collate(F.col("title.original"), "UNICODE")


def page_order() -> list[Column]:
    return [F.col("updateWeekday").asc_nulls_last(), F.col("updateTime").asc_nulls_last(), F.col("startDate").asc_nulls_last(), title_order()]


def library_order() -> list[Column]:
    return [S.season_order(F.col("primarySeason")).desc_nulls_last(), F.col("startDate").asc_nulls_last(), title_order()]


def update_rank(day: Column, time: Column, zone: Column) -> Column:
    """Minute of the week in China; a weekday without a time comes last on its day."""
    return F.coalesce(S.week_minute(day, time, zone), F.when(S.yes(day.between(1, 7)), (day - 1) * 1440 + 1439))


def mode_order(mode: str, rating: Column, start: Column, update: Column, title: Column) -> list[Column]:
    """Sort keys of a mode: what is not known comes last in both directions, equal ones by title."""
    if mode not in SORT_MODES:
        raise QueryError("INVALID_QUERY", f"unknown sort mode: {mode}")
    if mode == "default":
        return []
    value = {"rating": rating, "startDate": start, "updateTime": update}[mode.removesuffix("Asc").removesuffix("Desc")]
    return [value.asc_nulls_last() if mode.endswith("Asc") else value.desc_nulls_last(), title]


def sort_items(items: DataFrame, mode: str) -> DataFrame:
    """Items in the order of one of SORT_MODES."""
    update = update_rank(F.col("updateWeekday"), F.col("updateTime"), F.col("timezone"))
    keys = mode_order(mode, F.col("bangumi.rating"), F.col("startDate"), update, title_order()) + _last(items)
    return items.orderBy(*keys) if keys else items


def season_page(items: DataFrame, year: int, month: int, now: datetime, include_optional: bool = True, include_needs_review: bool = True) -> DataFrame:
    """The page of a season, in its order.

    Of a table that is partitioned by season only the season's files are read;
    for the actual season, whose page shows older rows that still run, those up
    to it.
    """
    year, quarter = asked_season(year, month)
    asked, actual = F.lit(year * 12 + month), F.lit(S.order_now(now))
    if "season_year" in items.columns:
        own = (F.col("season_year") == year) & (F.col("season_quarter") == quarter)
        items = items.where(F.col("season_year") <= year if S.order_now(now) == year * 12 + month else own)
    shown = items.where(visible(F.col("primarySeason"), F.col("activeSeasons"), asked, actual) & included(F.col("inclusionStatus"), include_optional, include_needs_review))
    return shown.where(rules.eligible()).orderBy(*page_order(), *_last(items))


def status_summary(items: DataFrame) -> DataFrame:
    """One row: how many items have each data status, zeros included."""
    return items.agg(*(F.count_if(F.col("dataStatus") == s).alias(s) for s in DATA_STATUSES))


def title_score(title: Column, query: str) -> Column:
    """Score of a normalised title for a normalised query; null if nothing of it occurs."""
    tokens = [t for t in query.split(" ") if t]
    hits = sum((F.contains(title, F.lit(t)).cast("int") for t in tokens), F.lit(0))
    return (
        F.when(title == query, F.lit(100)).when(F.startswith(title, F.lit(query)), F.lit(80)).when(F.contains(title, F.lit(query)), F.lit(65))
        .when(hits == len(tokens), F.lit(45) + hits).when(hits > 0, hits * 10)
    )


def best_title(titles: Column, query: str) -> Column:
    """struct(score, place) of the best of the normalised titles, the first of equal ones; null if none matches."""
    scored = F.transform(titles, lambda t, i: F.when(F.length(t) > 0, F.struct(title_score(t, query).alias("score"), (-i).alias("back"))))
    top = F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))
    return F.when(top.isNotNull(), F.struct(top["score"].alias("score"), (-top["back"]).alias("place")))


def search(items: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """The best items for a query: score, then the later season, then title; nothing for an empty one."""
    key = X.search_key(query)
    forms = F.array("title.chinese", "title.japanese", "title.original", "title.english")
    raw = F.filter(F.concat(forms, F.coalesce("title.aliases", F.array().cast("array<string>"))), lambda t: S.yes(F.length(X.trim(t)) > 0))
    shown = items.where(S.yes(F.col("format") == "tv") & S.yes(F.col("inclusionStatus") != "excluded") & F.coalesce("isJapaneseAnime", F.lit(True)))
    shown = (shown if key else shown.where(F.lit(False))).where(rules.eligible()).withColumn("_raw", raw).withColumn("_keys", X.search_texts(F.col("_raw")))
    found = shown.withColumn("_best", best_title(F.col("_keys"), key)).where(F.col("_best").isNotNull())
    order = [F.col("_best.score").desc(), S.season_order(F.col("primarySeason")).desc_nulls_last(), F.collate(F.get("_keys", F.col("_best.place")), "UNICODE"), *_last(items)]
    return found.orderBy(*order).limit(search_limit(limit)).select(*search_result())


def search_result() -> list[Column]:
    """What a result shows: an empty title counts as none."""
    shown = F.coalesce(X.given(F.col("title.chinese")), X.given(F.col("title.japanese")), F.col("title.original"))
    second = F.filter(F.array("title.japanese", "title.original", "title.english"), lambda t: S.yes((F.length(t) > 0) & (t != shown)))
    return [F.col("id"), F.col("title"), shown.alias("displayTitle"), F.get(second, F.lit(0)).alias("secondaryTitle"), F.get("_raw", F.col("_best.place")).alias("matchedTitle"), F.col("startDate"), F.col("primarySeason"), F.col("status")]


def items_by_id(items: DataFrame, ids: Iterable[str]) -> DataFrame:
    """The items with the ids asked for, the latest season first."""
    wanted = wanted_ids(ids)
    return items.where(F.col("id").isin(wanted)).where(rules.eligible()).orderBy(*library_order(), *_last(items))  # LOOKUP_MOST ids at most


def follow_list(items: DataFrame, weekday: int, ids: DataFrame | None = None) -> DataFrame:
    """Running or delayed items of a weekday in China, by time; only those in ``ids`` (a column id), if given."""
    slot = S.china_slot(F.col("updateWeekday"), F.col("updateTime"), F.col("timezone"))
    day = F.coalesce(slot["weekday"], F.when(F.col("updateWeekday").between(1, 7), F.col("updateWeekday")))
    shown = items.where(S.yes(day == weekday) & S.yes(F.col("status").isin("airing", "delayed")))
    shown = shown if ids is None else shown.join(ids.select("id").distinct(), "id", "left_semi")
    return shown.orderBy(slot["time"].asc_nulls_last(), title_order(), *_last(items))


def filter_view(items: DataFrame, statuses: Iterable[str], scope: str, year: int, month: int) -> DataFrame:
    """A page's own filter: some statuses, and all rows, those new in the season, or those that go on from an older one."""
    year, quarter = asked_season(year, month)
    order = S.season_order(F.col("primarySeason"))
    scopes = {"all": F.lit(True), "new": ~S.yes(order < year * 12 + month), "continuing": S.yes(order < year * 12 + month)}
    if scope not in scopes:
        raise QueryError("INVALID_QUERY", f"unknown scope: {scope}")
    return items.where(S.yes(F.col("status").isin(*statuses)) & scopes[scope])
